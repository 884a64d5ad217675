"""Routing of packed number columns between tasks.

Rows of a few bytes are expensive to shuffle one by one.  ``Router`` gathers
them per task and emits one row for each destination block with the columns
packed into binary fields; the reading side streams a partition block by block.
A block is a range or residue of a key, so all rows of a key share one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER_ROWS = 1_000_000
BLOCK_ROWS = 2_000_000


Batches = Iterator[pa.RecordBatch]


_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, one thing at a time (a vocabulary with its recent words)."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def trimmed(run: Callable[[Batches], Batches], keeps: bool = False) -> Callable[[Batches], Batches]:
    """A task function that gives its freed memory back when a task ends, and, unless it ``keeps`` a
    resident, what an earlier operator left: Python workers live on for later tasks."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        if not keeps:
            _resident.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Router:
    """Packs rows ``(block, key, columns...)`` of one kind into a few rows per block.

    ``key`` (64-bit) is stored by runs: field ``a`` has the values, ``b`` the
    lengths; ``dtypes`` names the types of the two further columns at most.  With ``sort``
    the rows of an emission are ordered by block and key, else they keep their order within a block.
    """

    def __init__(self, kind: int, dtypes: list[str], sort: bool = False, buffer_rows: int = BUFFER_ROWS):
        self.kind, self.dtypes, self.sort, self.limit = kind, dtypes, sort, buffer_rows
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, block: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(block):
            self.parts.append((block.astype(np.int32), key.astype(np.int64), *(c.astype(t, copy=False) for c, t in zip(columns, self.dtypes, strict=True))))
            self.size += len(block)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        block, key, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((key, block)) if self.sort else np.argsort(block, kind="stable")
        block, key = block[order], key[order]
        columns = [c[order] for c in columns]
        cuts = np.flatnonzero(np.diff(block)) + 1
        begin, end = np.r_[0, cuts], np.r_[cuts, len(block)]
        fields: list[list[bytes]] = [[], []]
        for i, j in zip(begin, end, strict=True):
            own = key[i:j]
            run = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            fields[0].append(own[run].tobytes())
            fields[1].append(np.diff(np.r_[run, j - i]).astype(np.uint32).tobytes())
        yield pack(block[begin], self.kind, fields + [[c[i:j].tobytes() for i, j in zip(begin, end, strict=True)] for c in columns])


def pack(block: np.ndarray, kind: int, fields: list[list[bytes]]) -> pa.RecordBatch:
    n = len(block)
    fields = fields + [[None] * n] * (4 - len(fields))
    return pa.record_batch(
        [pa.array(block, pa.int32()), pa.array(np.full(n, kind, np.int32)), *(pa.array(f, pa.binary()) for f in fields)],
        names=["block", "kind", "a", "b", "c", "d"],
    )


SCHEMA = "block int, kind int, a binary, b binary, c binary, d binary"


def deal(frame: DataFrame, blocks: int) -> DataFrame:
    """Brings each block into a task of its own, kinds in order."""
    return frame.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[bytes]]]]]:
    """``(block, [(kind, fields)])`` from what ``deal`` returned."""
    current, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for block, kind, *fields in zip(*cols, strict=True):
            if block != current:
                if rows:
                    yield current, rows
                current, rows = block, []
            rows.append((kind, fields))
    if rows:
        yield current, rows


def column(rows: list[tuple[int, list[bytes]]], kind: int, i: int, dtype: str) -> np.ndarray:
    """Column ``i`` of all rows of a kind, unpacked."""
    parts = [np.frombuffer(f[i], dtype=dtype) for k, f in rows if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def keys(rows: list[tuple[int, list[bytes]]], kind: int) -> np.ndarray:
    """The keys of all rows of a kind."""
    return np.repeat(column(rows, kind, 0, "i8"), column(rows, kind, 1, "u4"))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a 64-bit hash by its range: the high bits choose it."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


def plan_blocks(rows: int, rows_per_block: int = BLOCK_ROWS) -> int:
    """Blocks for so many packed rows: a block fits a task's memory, and their number follows
    the data only, so that a task never packs into more pieces than its rows fill."""
    return max(48, -(-rows // rows_per_block))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Long texts and packed rows pass between the JVM and Python in batches of at most so many
    rows, so that neither holds many megabytes for one batch.  Spark takes this from the session when a
    result is computed, so it stays lowered; a lower setting is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def clean(docs: DataFrame, *columns: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key, the text (null as empty) and further columns, whatever else the table has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *columns)
