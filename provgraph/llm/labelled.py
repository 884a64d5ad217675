"""Labelled rows, all or a bounded, repeatable sample of them, its training, and word pieces for classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import trimmed
from .kernel import Words, slices, string_buffers

SAMPLE_BYTES = 128 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def pieces(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """Runs of letters and digits, and runs of other signs, of each slice of a column."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        kind = _KIND[part]
        edges = np.zeros(len(part), dtype=bool)
        edges[1:] = kind[1:] != kind[:-1]
        yield i, j, Words(part, offsets[i : j + 1] - offsets[i], lower, edges)


def known(labels: DataFrame, label: str, modulus: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """All labelled ids outside the held-out remainder.  Repeated ids count once (greatest label),
    null ids or labels not at all."""
    own = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    return own.filter(remainder("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(labels: DataFrame, label: str, modulus: int, held_out: int, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` of the ``known`` ids, in the order of a hash of the id."""
    return known(labels, label, modulus, held_out, key).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learned(examples: DataFrame, fit: Callable[[list[tuple[int, str, bytes]]], object], sample_bytes: int = SAMPLE_BYTES) -> object:
    """What ``fit`` makes of ``examples`` (``doc_id, label, lang, x``), given as ``(label, lang, x)``.

    One executor task trains, so the driver holds only the model.  It reads the examples in
    the order of a hash of the id, one for each id (of rows that repeat an id the one of least ``x``), and leaves out
    those that would bring the bytes of ``x`` over ``sample_bytes``, a documented bound like the sample's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for label, lang, x in zip(*(batch.column(c) for c in range(3)), strict=True):
                own = len(x.as_buffer())
                if size + own <= sample_bytes:
                    rows.append((label.as_py(), lang.as_py(), x.as_py()))
                    size += own
        yield pa.record_batch([pa.array([pickle.dumps(fit(rows), 5)], pa.binary())], names=["model"])

    one = examples.groupBy("doc_id").agg(F.min(F.struct("x", "label", "lang")).alias("e"))
    ordered = one.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("e.label", "e.lang", "e.x")
    rows = ordered.mapInArrow(trimmed(run), "model binary").collect()  # one model
    return pickle.loads(rows[0].model) if rows else fit([])
