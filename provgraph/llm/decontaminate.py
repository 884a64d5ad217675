"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is *found* in a document when at least ``threshold`` of the item's
distinct k-word shingles occur anywhere in the document.

* **Size partitions.**  Items are partitioned by shingle count ``q`` (powers of
  two).  A document with fewer distinct shingles than a partition's least
  possible overlap is not compared with it.
* **Sketch.**  An item's sketch is the bottom part of its MinHash order: its
  ``q - ceil(threshold * q) + 1`` shingles of smallest hash.  The chance that one
  sketch shingle occurs in a document equals the containment, however long the
  document is (a Jaccard signature would drown in a long document); and by the
  pigeonhole principle a document that holds ``threshold`` of the item holds at
  least one sketch shingle, so the search loses nothing.
* **Verification.**  A candidate's containment is counted exactly: shingles are met by hash and compared as words, byte by byte.

Documents are read in one narrow pass per block of items.  Items travel to the
tasks in blocks of at most ``BLOCK_BYTES`` of text (a longer item is a block of its own), as the text with the places of its words and
the hashes of its shingles, about five times the text; one pass per block, so what
is sent is bounded however large the benchmark is.

Cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer
than ``k`` words is one shingle; items and documents without words (null or empty) match nothing; texts of any length are searched
whole, slice by slice; a containment of just ``threshold`` (a tie) is a find; null ids are kept; repeated rows are rows of their own;
without items or documents nothing is found; further columns are ignored, ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import clean, trimmed
from .kernel import Words, shingles, words_of

BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def least_overlap(q: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * q, 9)))


def shingle_table(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, first word)`` of each row's distinct shingles, by row, then hash."""
    h, row, first = shingles(words, k, True)
    order = np.lexsort((first, h, row))
    h, row, first = h[order], row[order], first[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new], first[new]


@dataclass
class Index:
    """Items as words, their shingles by item and hash, and sketch tables by size partition."""

    ids: list[int]
    slices: list[Words]
    part: np.ndarray  # of each item: its slice
    size: np.ndarray  # its words in a shingle
    cut: np.ndarray  # where its shingles begin and end
    hash: np.ndarray
    first: np.ndarray  # each shingle's first word in the slice
    partitions: list[tuple[int, np.ndarray, np.ndarray]]  # least overlap, sketch hashes in order, their items
    threshold: float
    k: int

    def shingles(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.cut[item], self.cut[item + 1])
        return self.hash[at], self.first[at]


def build_index(items: list[tuple[int, str]], threshold: float, k: int) -> Index:
    ids, parts, sizes, counts, slices, hashes, firsts = [], [], [], [], [], [], []
    for i, j, words in words_of(pa.array([t for _, t in items], pa.string()), True):
        row, h, first = shingle_table(words, k)
        n, n_words = np.bincount(row, minlength=j - i), words.counts()
        some = np.flatnonzero(n)
        ids += [items[i + r][0] for r in some]
        parts.append(np.full(len(some), len(slices), np.int32))
        sizes.append(np.minimum(n_words[some], k))
        counts.append(n[some])
        hashes.append(h)
        firsts.append(first.astype(np.uint32))
        words.start, words.end, words.row, words._hash = words.start.astype(np.uint32), words.end.astype(np.uint32), words.row[:0], None
        slices.append(words)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    cut = np.r_[0, np.cumsum(count)]
    need = np.array([least_overlap(int(q), threshold) for q in count], np.int64)
    sketch = np.arange(len(h)) - np.repeat(cut[:-1], count) <= np.repeat(count - need, count)
    owner, level = np.repeat(np.arange(len(count)), count), np.floor(np.log2(np.maximum(count, 1))).astype(int)
    partitions = []
    for own in np.unique(level):
        at = np.flatnonzero(sketch & (level[owner] == own))
        order = at[np.argsort(h[at], kind="stable")]
        partitions.append((int(need[level == own].min()), h[order], owner[order].astype(np.int32)))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Index(ids, slices, join(parts, np.int32), join(sizes, np.int64), cut, h, join(firsts, np.uint32), partitions, threshold, k)


def same_words(a: Words, i: int, b: Words, j: int, n: int) -> bool:
    return all(a.text(i + x) == b.text(j + x) for x in range(n))


def search(index: Index, words: Words) -> Iterator[tuple[int, int, int]]:
    """``(row, item, shared shingles)`` of verified finds in a slice of documents."""
    row, h, first = shingle_table(words, index.k)
    size = np.bincount(row, minlength=words.n_rows)
    found = []
    for least, sketch, owners in index.partitions:
        a, b = np.searchsorted(sketch, h, "left"), np.searchsorted(sketch, h, "right")
        met = np.flatnonzero((b > a) & (size[row] >= least))
        n = (b - a)[met]
        at = np.repeat(a[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.repeat(row[met], n) * len(index.ids) + owners[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    n_words = words.counts()
    for r, item in zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist(), strict=True):
        a, b = np.searchsorted(row, [r, r + 1])
        own, at = index.shingles(item)
        near = np.minimum(np.searchsorted(h[a:b], own), b - a - 1)
        hit = np.flatnonzero(h[a:b][near] == own)
        n, need = int(index.size[item]), least_overlap(len(own), index.threshold)
        if len(hit) < need or n != min(index.k, n_words[r]):
            continue
        other = index.slices[index.part[item]]
        shared = sum(same_words(words, int(first[a + near[x]]), other, int(at[x]), n) for x in hit)
        if shared >= need:
            yield r, item, shared


def item_blocks(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block in the driver's memory at a time."""
    block, size = [], 0
    for r in clean(items, text=text, key=key).orderBy("doc_id").toLocalIterator():
        block.append((r.doc_id, r.text))
        size += len(r.text) + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Pairs ``doc_id, item_id, item_shingles, shared, containment``, one per find."""
    spark = docs.sparkSession
    source = clean(docs, text=text, key=key)
    out = None
    for block in item_blocks(items, item_text, item_key):
        shipped = spark.sparkContext.broadcast(build_index(block, threshold, k))  # at most BLOCK_BYTES of items

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index: Index = shipped.value
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, _, words in words_of(batch.column(1), True):
                    rows += [(ids[i + r].as_py(), index.ids[item], int(index.cut[item + 1] - index.cut[item]), shared) for r, item, shared in search(index, words)]
                if rows:
                    d, item, q, s = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                    share = pa.array([b / a for _, _, a, b in rows], pa.float64())
                    yield pa.record_batch([d, item, q, s, share], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        found = source.mapInArrow(trimmed(scan), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, text: str = "text") -> DataFrame:
    """The documents, all columns, in which no item is found.

    The same search runs inside the scan, so documents are not shuffled for it.
    """
    spark = docs.sparkSession
    out = docs
    for block in item_blocks(items, "text", "item_id"):
        shipped = spark.sparkContext.broadcast(build_index(block, threshold, k))  # at most BLOCK_BYTES of items
        at = out.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clear = np.ones(batch.num_rows, dtype=bool)
                for i, _, words in words_of(batch.column(at), True):
                    for r, _, _ in search(shipped.value, words):
                        clear[i + r] = False
                yield batch.filter(pa.array(clear))

        out = out.mapInArrow(trimmed(keep), out.schema)
    return out


def contaminated_summary(pairs: DataFrame) -> DataFrame:
    """Per document: how many items it holds, and the best containment."""
    return pairs.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("containment").alias("max_containment"))
