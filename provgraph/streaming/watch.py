"""Continuously changing corpora and event streams.

Not every part of this has a batch equivalent in the engine's model: windows over
event time, and running template counts, are additions for streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import log_template
from ..sinks.store import upsert

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Calls ``on_batch`` with each batch of new files (``path, extension, content``); with ``once`` ends when
    all present files have been taken.  A corpus may not contain its own output."""
    if checkpoint.rstrip("/").startswith(path.rstrip("/") + "/"):
        raise ValueError("the checkpoint may not lie inside the corpus")
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path)
    files = stream.select("path", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("extension"), "content")
    writer = files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def changed(listing: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``path, signature`` tables: the new or changed rows, and the paths that are gone (which a file
    stream doesn't report)."""
    fresh = listing.join(known, ["path", "signature"], "left_anti")
    gone = known.select("path").join(listing.select("path"), "path", "left_anti")
    return fresh, gone


def apply_changes(table: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """A per-document table after an incremental build: equal to a full build."""
    return upsert(table.join(gone.select(key), key, "left_anti"), fresh, key)


def template_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Running counts per log template of a stream of lines (complete or update mode)."""
    return lines.groupBy(log_template(line).alias("template")).agg(F.count(F.lit(1)).alias("occurrences"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, with late events within the watermark."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: a gap ends one."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
