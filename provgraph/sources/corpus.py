"""A folder of documents as tables: documents and blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCKS, DOCS
from . import formats

DERIVED = (".html", ".htm", ".xhtml", ".docx", ".odt", ".rtf", ".epub", ".pdf")


def list_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``path, extension, content`` of the files in a folder and below, that have a known extension;
    read by Spark's binary source, so the path may be in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return files.select("path", ext.alias("extension"), "content").filter(F.col("extension").isin(*[e for e in formats.READERS if e]))


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents`` and ``blocks`` of ``path, extension, content`` rows; each document is parsed once
    per table, by the tasks.  Files that can't be read in their format are left out (``unreadable`` lists them)."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, raw in zip(pdf.path, pdf.extension, pdf.content, strict=True):
                try:
                    text, _ = formats.parse(raw, ext)
                except formats.Unsupported:
                    continue
                kept = text.encode() if ext in DERIVED else raw
                rows.append(("sha256:" + hashlib.sha256(kept).hexdigest(), path, ext.lstrip("."), kept, text, len(kept)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ext, raw in zip(pdf.extension, pdf.content, strict=True):
                try:
                    text, found = formats.parse(raw, ext)
                except formats.Unsupported:
                    continue
                doc = "sha256:" + hashlib.sha256(text.encode() if ext in DERIVED else raw).hexdigest()
                rows += [(doc, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "parent", "kind", "level", "start", "end", "text", "props"])

    return files.mapInPandas(documents, DOCS), files.select("extension", "content").mapInPandas(blocks, BLOCKS)


def file_blocks(files: DataFrame) -> DataFrame:
    """``path, ord, kind, level, text``: the blocks of every file, also of files whose texts, and so ids, are equal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, raw in zip(pdf.path, pdf.extension, pdf.content, strict=True):
                try:
                    _, found = formats.parse(raw, ext)
                except formats.Unsupported:
                    continue
                rows += [(path, i, kind, level, text) for i, (_, kind, level, _, _, text, _) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "level", "text"])

    return files.select("path", "extension", "content").mapInPandas(run, "path string, ord int, kind string, level int, text string")


def unreadable(files: DataFrame) -> DataFrame:
    """``path, reason`` of files that their format's reader refuses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, raw in zip(pdf.path, pdf.extension, pdf.content, strict=True):
                try:
                    formats.parse(raw, ext)
                except formats.Unsupported as e:
                    rows.append((path, str(e)))
            yield pd.DataFrame(rows, columns=["path", "reason"], dtype=object)

    return files.mapInPandas(run, "path string, reason string")


def raw_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Code-point spans ``doc_id, start, end`` with their byte range and its hash: the proof that
    a citation can be checked against the source."""
    joined = spans.join(documents.select("doc_id", "raw"), "doc_id")
    columns = [c for c in spans.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, runs, a, b, h = None, [], [], [], []
            for raw, start, end in zip(pdf.raw, pdf.start, pdf.end, strict=True):
                if raw is not last:
                    last, runs = raw, formats.offset_runs(raw)
                x, y = formats.to_raw(runs, len(raw), start), formats.to_raw(runs, len(raw), end)
                a.append(x), b.append(y), h.append(hashlib.sha256(raw[x:y]).hexdigest())
            yield pdf[columns].assign(raw_start=a, raw_end=b, hash=h)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields) + ", raw_start long, raw_end long, hash string"
    return joined.mapInPandas(run, schema)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph stored as Parquet by ``sinks.store``."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A ``graph.json``; edges keep their ids where the file has them."""
    g = spark.read.option("multiLine", "true").json(path)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*")
    edges = g.select(F.posexplode("edges").alias("i", "e")).select("i", "e.*")
    made = F.concat(F.lit("edge:"), F.col("i").cast("string"))
    edges = edges.withColumn("edge_id", F.coalesce("edge_id", made) if "edge_id" in edges.columns else made)
    return nodes, edges.drop("i")
