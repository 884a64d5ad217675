"""Substring deduplication over a log-structured fingerprint index.

A *window* is ``window`` consecutive words of one document.  A word is removed
when a window that covers it has the same words as a window that starts earlier
(smaller ``doc_id``, or the same document and an earlier start).

* **Fingerprints.**  Of the word grams inside each window the one of least hash is
  the window's fingerprint, so equal windows have equal fingerprints, and only
  about one gram in seven is ever selected.
* **Runs.**  A task sorts its fingerprints when its buffer is full and deals the sorted
  pieces to blocks by hash range; a block merges them with the sorted, immutable runs of
  earlier batches, marks fingerprints that occur twice, and writes the batch's
  fingerprints as a new run: with its document while it has occurred once, without
  once it is marked.  ``SubstringIndex.compact`` merges a block's runs into one once
  there are more than ``max_runs``.
* **Verification.**  Only windows over marked fingerprints are compared: by a
  96-bit hash of their whole word sequence, independent of the fingerprint; the
  least (document, start) of each sequence stays, all later ones are removed.  The
  sequences' hashes are a second set of sorted runs, so that a later batch meets
  every earlier window over a marked fingerprint there; a fingerprint that
  occurred once before has its one document read again.
* **Hot passages.**  A buffer forwards one (the earliest) occurrence of a
  fingerprint or sequence and settles the others itself, so a passage that
  every document holds reaches its block as one row per buffer.

Documents travel packed and compressed, by a hash of their id.

Cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null, empty and short texts
have no windows and lose nothing; rows that repeat a ``doc_id`` are read one after
the other, in the order of their texts, as parts of one document that no window spans; rows with a
null ``doc_id`` come after all others, in the order of a hash of their texts, each a document (rows of equal texts
one after the other), so that they spread over all blocks; ids are under ``2**62``, a greater one is an error; texts of any length are read
whole; of equal windows (ties) the earliest stays; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import SCHEMA, Router, block_of, by_block, clean, column, deal, keys, pack, plan_blocks, trimmed
from .kernel import Words, sequence_hash, words_of
from .ngram_join import doc_block
from .shared import fresh_path, stored

GRAM = 8
NULL_ID = 1 << 62  # ids from here on stand for rows without one
WINDOW_TYPE = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("pos", "<u4")])
BYTES = 16 << 20
BUFFER_ROWS = 500_000

RUN, PRINT, MARK, DOC, SEEN, WINDOW, CUT, PAST = range(8)
MARKED = -1
REPEATED = np.uint64(0xFFFFFFFFFFFFFFFE)  # fingerprints are odd; an even one is known to occur twice
SEQUENCE_TYPE = np.dtype([("h1", "<u8"), ("h2", "<u4")])


def _sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each ``n`` consecutive values."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word index of the gram, its hash)`` of the selected grams."""
    h, row = words.hash, words.row
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = sequence_hash([h[i : len(h) - gram + 1 + i] for i in range(gram)], seed=3) | np.uint64(1)
    span = window - gram + 1
    least = _sliding(grams, span, np.minimum)
    least[row[:n] != row[window - 1 :]] = 0
    reach = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span, np.maximum)
    chosen = np.flatnonzero(reach == grams)
    return chosen, grams[chosen]


def window_hashes(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [words.hash[at + i] for i in range(window)]
    return sequence_hash(parts, seed=11), sequence_hash(parts[::-1], seed=17) >> np.uint64(32)


class Buffer:
    """Occurrences gathered until the buffer is full, then settled and dealt.

    Of equal values only the earliest goes on to the value's block, as ``kind``; what is
    settled here goes to the document's block as ``done``.
    """

    def __init__(self, kind: int, dtype, done: int, done_type, blocks: int, all_repeated: bool):
        self.out, self.done = Router(kind, [dtype]), Router(done, [done_type], sort=True)
        self.blocks, self.all_repeated = blocks, all_repeated
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((doc, value))
        self.size += len(doc)
        if self.size >= BUFFER_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            doc, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.size = [], 0
            doc, value, first, repeated = settle(doc, value)
            mark = repeated if self.all_repeated else ~first
            h = value["h1"] if value.dtype.names else value
            yield from self.done.add(doc_block(doc[mark], self.blocks), doc[mark], value["pos"][mark] if value.dtype.names else value[mark])
            if self.all_repeated:
                value = np.where(repeated, value & REPEATED, value)
            yield from self.out.add(block_of(h[first], self.blocks), doc[first], value[first])
        yield from self.done.flush()
        yield from self.out.flush()


def settle(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by value, then document and start; which are the first of their value,
    and which belong to a value that occurs twice."""
    if value.dtype.names:
        order = np.lexsort((value["pos"], doc, value["h2"], value["h1"]))
        doc, value = doc[order], value[order]
        new = (value["h1"][1:] != value["h1"][:-1]) | (value["h2"][1:] != value["h2"][:-1])
    else:
        order = np.lexsort((doc, value))
        doc, value = doc[order], value[order]
        new = value[1:] != value[:-1]
    first = np.r_[True, new] if len(doc) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(first), len(doc)])
    return doc, value, first, np.repeat(size > 1, size)


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """The ids; a row without one gets a number of its text, after all ids."""
    ids = np.array(batch.column(0).fill_null(NULL_ID), np.int64)
    for i in np.flatnonzero(~np.asarray(batch.column(0).is_valid())):
        ids[i] |= int.from_bytes(hashlib.blake2b(batch.column(1)[i].as_buffer(), digest_size=8).digest(), "little") >> 2
    return ids


def print_rows(docs: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(PRINT, "u8", MARK, "u8", blocks, all_repeated=True)
        for batch in batches:
            ids = ids_of(batch)
            for i, _, words in words_of(batch.column(1), False):
                at, h = fingerprints(words, window, gram)
                yield from buffer.add(ids[i + words.row[at]], h)
        yield from buffer.flush()

    return docs.mapInArrow(trimmed(run), SCHEMA)


def merge_prints(dealt: DataFrame, blocks: int) -> DataFrame:
    """Per block: earlier runs (RUN) and the batch's sorted pieces merged; marks dealt by
    document (PAST for documents of earlier batches), and the batch's new run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, past = Router(MARK, ["u8"], sort=True), Router(PAST, ["u8"], sort=True)
        for block, rows in by_block(batches):
            for kind, fields in rows:
                if kind == MARK:  # settled by a buffer
                    yield pack(np.array([block]), MARK, [[f] for f in fields[:3]])
            old, old_doc = column(rows, RUN, 2, "u8"), keys(rows, RUN)
            new, new_doc = column(rows, PRINT, 2, "u8"), keys(rows, PRINT)
            if not len(new):
                continue
            doc, value, first, repeated = settle(new_doc, new | ~REPEATED)
            known = np.unique(new[(new & ~REPEATED) == 0] | ~REPEATED)
            seen = repeated | np.isin(value, known, kind="sort")
            if len(old):
                order = np.argsort(old, kind="stable")
                old, old_doc = old[order], old_doc[order]
                at = np.minimum(np.searchsorted(old, value), len(old) - 1)
                seen = seen | (old[at] == value)
                back = np.minimum(np.searchsorted(value, old), len(value) - 1)
                met = (value[back] == old) & (old_doc != MARKED)
                yield from past.add(doc_block(old_doc[met], blocks), old_doc[met], old[met])
            yield from marks.add(doc_block(doc[seen], blocks), doc[seen], value[seen])
            router = Router(RUN, ["u8"])
            yield from router.add(np.full(int(first.sum()), block), np.where(seen, MARKED, doc)[first], value[first])
            yield from router.flush()
        yield from marks.flush()
        yield from past.flush()

    return dealt.mapInArrow(trimmed(run), SCHEMA)


def packed_docs(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents dealt by id, compressed: ``a`` ids, ``b`` lengths in bytes, ``c`` the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block in sorted(held):
                ids, texts = held[block]
                yield pack(np.array([block]), DOC, [[np.array(ids, "i8").tobytes()], [np.array([len(t) for t in texts], "i8").tobytes()], [coder.compress(b"".join(texts))]])
            held.clear()

        for batch in batches:
            ids = ids_of(batch)
            for i, block in enumerate(doc_block(ids, blocks).tolist()):
                text = batch.column(1)[i].as_buffer()
                text = text.to_pybytes() if text is not None else b""
                own = held.setdefault(block, ([], []))
                own[0].append(int(ids[i]))
                own[1].append(text)
                size += len(text)
                if size >= BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(trimmed(run), SCHEMA)


def documents_of(rows: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, Words]]:
    """``(id, position offset, words)`` of a block's documents, by id and text."""
    coder, docs = zstandard.ZstdDecompressor(), []
    for kind, fields in rows:
        if kind == DOC:
            data = coder.decompress(fields[2])
            end = np.cumsum(np.frombuffer(fields[1], "i8"))
            docs += [(i, data[b - n : b]) for i, n, b in zip(np.frombuffer(fields[0], "i8").tolist(), np.frombuffer(fields[1], "i8").tolist(), end.tolist(), strict=True)]
    docs.sort()
    last, offset = None, 0
    for i, text in docs:
        words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), False)
        offset = offset if i == last else 0
        yield i, offset, words
        last, offset = i, offset + len(words.start) + 1


def window_rows(dealt: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """Per document block: the windows over marked fingerprints, dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(WINDOW, WINDOW_TYPE, CUT, "u4", blocks, all_repeated=False)
        for _, rows in by_block(batches):
            doc, mark = keys(rows, MARK), column(rows, MARK, 2, "u8")
            order = np.lexsort((mark, doc))
            doc, mark = doc[order], mark[order]
            for i, offset, words in documents_of(rows):
                a, b = np.searchsorted(doc, [i, i + 1], "left")
                if a == b:
                    continue
                at, h = fingerprints(words, window, gram)
                near = np.minimum(np.searchsorted(mark[a:b], h), b - a - 1)
                at = at[mark[a:b][near] == h]
                cover = np.zeros(len(words.start) + 1, np.int32)
                np.add.at(cover, np.maximum(at - (window - gram), 0), 1)
                np.add.at(cover, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[: max(0, len(words.start) - window + 1)] > 0)
                if len(starts):
                    value = np.empty(len(starts), WINDOW_TYPE)
                    value["h1"], value["h2"] = window_hashes(words, starts, window)
                    value["pos"] = starts + offset
                    yield from buffer.add(np.full(len(starts), i, np.int64), value)
        yield from buffer.flush()

    return dealt.mapInArrow(trimmed(run), SCHEMA)


def seen_before(old: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the sequences ``own`` are among ``old``."""
    both = np.concatenate([old, own])
    order = np.lexsort((np.arange(len(both)), both["h2"], both["h1"]))  # of equal ones an old one comes first
    sorted_ = both[order]
    new = np.r_[True, (sorted_["h1"][1:] != sorted_["h1"][:-1]) | (sorted_["h2"][1:] != sorted_["h2"][:-1])]
    known = np.empty(len(both), bool)
    known[order] = (order[new] < len(old))[np.cumsum(new) - 1]
    return known[len(old) :]


def later_windows(dealt: DataFrame, blocks: int) -> DataFrame:
    """Per hash block: the starts of all but the earliest window of each sequence (CUT), and
    the batch's sequences as a new sorted run (SEEN)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Router(CUT, ["u4"], sort=True)
        for block, rows in by_block(batches):
            for kind, fields in rows:
                if kind == CUT:  # settled by a buffer
                    yield pack(np.array([block]), CUT, [[f] for f in fields[:3]])
            parts = [np.frombuffer(f[2], WINDOW_TYPE) for k, f in rows if k == WINDOW]
            if not parts:
                continue
            doc, value, first, _ = settle(keys(rows, WINDOW), np.concatenate(parts))
            own = np.empty(len(value), SEQUENCE_TYPE)
            own["h1"], own["h2"] = value["h1"], value["h2"]
            later = ~first
            runs = [np.frombuffer(f[2], SEQUENCE_TYPE) for k, f in rows if k == SEEN]
            if runs:
                later = later | seen_before(np.concatenate(runs), own)
            yield from cuts.add(doc_block(doc[later], blocks), doc[later], value["pos"][later])
            yield pack(np.array([block]), SEEN, [[None], [None], [own[first].tobytes()]])
        yield from cuts.flush()

    return dealt.mapInArrow(trimmed(run), SCHEMA)


def cut_documents(dealt: DataFrame, window: int, digest: bool) -> DataFrame:
    """Per document block: the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_block(batches):
            doc, pos = keys(rows, CUT), column(rows, CUT, 2, "u4")
            order = np.argsort(doc, kind="stable")
            doc, pos = doc[order], pos[order].astype(np.int64)
            out: list[tuple] = []
            for i, offset, words in documents_of(rows):
                n = len(words.start)
                a, b = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
                at = pos[a:b] - offset
                at = at[(at >= 0) & (at < n)]
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, np.minimum(at + window, n), -1)
                gone = np.cumsum(cover)[:n] > 0
                kept = kept_text(words, ~gone)
                out.append((None if i >= NULL_ID else i, n, int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")))
                if len(out) == 256:
                    yield rows_of(out, digest)
                    out = []
            if out:
                yield rows_of(out, digest)

    last = "kept_sha256" if digest else "kept_text"
    return dealt.mapInArrow(trimmed(run), f"doc_id long, n_words long, n_removed long, {last} string")


def kept_text(words: Words, keep: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    start, end = words.start[keep], words.end[keep]
    if not len(start):
        return b""
    size = end - start + 1
    stop = np.cumsum(size)
    source = np.arange(stop[-1]) + np.repeat(start - (stop - size), size)
    source[stop - 1] = 0
    out = words.data[source]
    out[stop - 1] = 0x20
    return out[:-1].tobytes()


def rows_of(out: list[tuple], digest: bool) -> pa.RecordBatch:
    i, n, r, text = zip(*out, strict=True)
    return pa.record_batch([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])


class SubstringIndex:
    """Runs of fingerprints, by block, and the batches they came from.

    ``add`` deduplicates a batch against itself and all earlier batches, whose ids must be
    smaller; the number of blocks is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, blocks: int, window: int = 20, gram: int = GRAM, max_runs: int = 4):
        self.spark, self.blocks = spark, blocks
        self.window, self.gram, self.max_runs = window, min(gram, window), max_runs
        self.path = fresh_path(spark, "fingerprints")
        self.runs: list[str] = []
        self.sequences: list[str] = []
        self.batches: list[DataFrame] = []

    def add(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """``doc_id, n_words, n_removed, kept_text`` (or ``kept_sha256``) of the batch."""
        prints = print_rows(docs, self.window, self.gram, self.blocks)
        if self.runs:
            prints = prints.unionByName(self._stored(self.runs, RUN))
        merged = merge_prints(deal(prints, self.blocks), self.blocks)
        at = f"{self.path}/run-{len(self.batches)}"
        merged.write.partitionBy("kind").parquet(at)
        marks = self._stored([at], MARK)
        sources = packed_docs(docs, self.blocks)
        if self.runs:
            past = self._stored([at], PAST)
            marks = marks.unionByName(past.withColumn("kind", F.lit(MARK)))
            sources = sources.unionByName(packed_docs(self._past_documents(past), self.blocks))
        windows = window_rows(deal(marks.unionByName(sources), self.blocks), self.window, self.gram, self.blocks)
        if self.sequences:
            windows = windows.unionByName(self._stored(self.sequences, SEEN))
        settled = f"{self.path}/sequences-{len(self.batches)}"
        later_windows(deal(windows, self.blocks), self.blocks).write.partitionBy("kind").parquet(settled)
        cuts = self._stored([settled], CUT)
        result = cut_documents(deal(cuts.unionByName(packed_docs(docs, self.blocks)), self.blocks), self.window, digest)
        self.runs.append(at)
        self.sequences.append(settled)
        self.batches.append(docs)
        return result

    def _past_documents(self, past: DataFrame) -> DataFrame:
        """Earlier documents that hold a fingerprint of the batch."""

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in batch.column(0):
                    yield pa.record_batch([pa.array(np.unique(np.frombuffer(a.as_py(), "i8")))], names=["doc_id"])

        wanted = past.select("a").mapInArrow(trimmed(ids), "doc_id long").distinct()
        history = self.batches[0]
        for more in self.batches[1:]:
            history = history.unionByName(more)
        return history.join(wanted, "doc_id", "left_semi")

    def _stored(self, paths: list[str], kind: int) -> DataFrame:
        """Rows of one kind from the folders of several batches, any of which may hold none."""
        out = None
        for path in paths:
            own = self.spark.read.schema(SCHEMA).option("basePath", path).parquet(path).filter(F.col("kind") == kind).select("block", "kind", "a", "b", "c", "d")
            out = own if out is None else out.unionByName(own)
        return out

    def compact(self) -> None:
        """Merges the runs of each block into one sorted run when there are too many."""
        if len(self.runs) <= self.max_runs:
            return

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, rows in by_block(batches):
                value, doc = column(rows, RUN, 2, "u8"), keys(rows, RUN)
                if len(value):
                    doc, value, first, _ = settle(doc, value)
                    keep = first | (doc != MARKED)  # MARKED sorts first and stands for all marks
                    router = Router(RUN, ["u8"])
                    yield from router.add(np.full(int(keep.sum()), block), doc[keep], value[keep])
                    yield from router.flush()
                seen = [np.frombuffer(f[2], SEQUENCE_TYPE) for k, f in rows if k == SEEN]
                if seen:
                    yield pack(np.array([block]), SEEN, [[None], [None], [np.unique(np.concatenate(seen)).tobytes()]])

        at = f"{self.path}/compact-{len(self.batches)}"
        both = self._stored(self.runs, RUN).unionByName(self._stored(self.sequences, SEEN))
        deal(both, self.blocks).mapInArrow(trimmed(merge), SCHEMA).write.partitionBy("kind").parquet(at)
        self.runs, self.sequences = [at], [at]


def dedup_substrings(docs: DataFrame, window: int = 20, batches: int = 1, digest: bool = False, text: str = "text", key: str = "doc_id", max_runs: int = 4) -> DataFrame:
    """The whole table through a new index, in ``batches`` parts by rising ``doc_id``; over ``max_runs`` runs are compacted."""
    spark = docs.sparkSession
    source = clean(docs, text=text, key=key)
    n_bytes, last = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.max("doc_id")).first()
    if last is not None and last >= NULL_ID:
        raise ValueError(f"doc_id {last} is not under 2**62")
    blocks = plan_blocks(int(n_bytes) // 8)
    index = SubstringIndex(spark, blocks, window, max_runs=max_runs)
    if batches == 1:
        return index.add(source, digest)
    cuts = source.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    out = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = source if low is None else source.filter((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        part = part if high is None else part.filter(F.col("doc_id") <= high)
        found = index.add(part, digest)
        if high is not None:
            found = stored(found, "substrings")
            index.compact()
        out = found if out is None else out.unionByName(found)
    return out
