"""Subword lattice likelihood of documents.

A fixed, public vocabulary of pieces spans a lattice over every word (a leading
mark, then the word's bytes): each way to cut it into pieces is a path, weighted by its pieces' weights.  The sum
over all segmentations is found by a forward recursion in log space; a document's probability is the product over its words and
one end symbol.  Since pieces with and without the mark tile the stream, the probabilities of all texts sum to at most 1.

The vocabulary's own scores give every piece its first weight, and keep the share ``PRIOR`` of the weights at
any size of the corpus.  The rest follows the training tokens: in each of ``ROUNDS`` rounds of expectation-maximisation a piece's
share is its expected number in all of them.  The vocabulary itself is never changed, and no word has an arc of its
own unless it is a piece.

* **Words, not tokens.**  Counts are combined per task and dealt by word hash, so a
  word's lattice is computed once however often it occurs.
* **E-step.**  One pass over the word table per round; only one number per piece
  reaches the driver.
* **Scoring.**  A table of the most frequent words (``HEAD`` at most, 24 bytes each, so 12.6 MB: a fixed bound)
  goes to every task; all other words of a document are dealt to the blocks that hold
  their score and return as sums.  Both paths are exact.

Cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text is
the end symbol alone; single bytes have pieces, so any text has a probability; words of over ``LONG`` bytes are summed
one by one, with a bounded stretch of the recursion in memory; a row
with a null id is training data; ties and repeated rows are rows of their own; an empty table gives an empty result; further
columns are ignored; with no training text the first weights are used.  Words are told
apart by a 64-bit hash, without comparing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SCHEMA, Router, block_of, by_block, clean, column, deal, keys, pack, plan_blocks, trimmed
from .kernel import words_of
from .labelled import remainder
from .shared import stored

MARK = b" "
HEAD = 1 << 19
LONG = 192
STRETCH = 4096
BATCH = 8192
ROUNDS = 3
PRIOR = 0.2
COUNT_TYPE = np.dtype([("train", "<i8"), ("all", "<i8")])
_B = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(model_file: str) -> list[tuple[bytes, float]]:
    """``(bytes, score)`` of the pieces of a sentencepiece model; byte pieces are single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append((bytes([int(model.id_to_piece(i)[3:5], 16)]), model.get_score(i)))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)))
    return out


def usable(piece: bytes) -> bool:
    """Can occur in a marked, lower-cased word."""
    return not any(65 <= b <= 90 or b in b"\t\n\x0b\x0c\r" for b in piece) and b" " not in piece[1:]


def first_weights(pieces: list[tuple[bytes, float]]) -> dict[bytes, float]:
    """Weights from the vocabulary's scores: a merge vocabulary scores a piece by minus its
    rank, and by Zipf's law its weight falls as 1 / rank.  Byte pieces rank last."""
    last = max((-s for _, s in pieces if s > -1e6), default=0.0) + 1
    weights: dict[bytes, float] = {bytes([b]): 1 / (last + 10) for b in range(256)}
    for piece, score in pieces:
        if len(piece) > 0 and usable(piece) and -1e6 < score < 0:
            weights[piece] = weights.get(piece, 0.0) + 1 / (10 - score)
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


@dataclass
class Table:
    """Pieces by substring hash: open addressing, one entry in thirty filled."""

    pieces: list[bytes]
    bits: int = 20

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.id = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        with np.errstate(over="ignore"):
            for i, piece in enumerate(self.pieces):
                h = substring_hash(prefix_sums(np.frombuffer(piece, np.uint8)[None, :]), 0, len(piece))[0]
                slot, n = int(h >> np.uint64(64 - self.bits)), 1
                while self.id[slot] >= 0:
                    slot, n = (slot + 1) % (1 << self.bits), n + 1
                self.key[slot], self.id[slot] = h, i
                self.probes = max(self.probes, n)
        self.ids = {p: i for i, p in enumerate(self.pieces)}

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            own = slot[open_]
            hit = self.key[own] == h[open_]
            out[open_[hit]] = self.id[own[hit]]
            open_ = open_[~hit & (self.id[own] >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % (1 << self.bits)
        return out


_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = out[i - 1] * base
    return out


with np.errstate(over="ignore"):
    _POW, _INV = _powers(_B, LONG + 64), _powers(_INVERSE, LONG + 64)
    _VALUE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of words of one length, one per row: running sums whose differences hash substrings."""
    out = np.zeros((data.shape[1] + 1, data.shape[0]), np.uint64)
    np.cumsum(_VALUE[data.T] * _POW[: data.shape[1], None], axis=0, out=out[1:])
    return out


def substring_hash(sums: np.ndarray, i: int, j: int) -> np.ndarray:
    x = (sums[j] - sums[i]) * _INV[i] + np.uint64(j - i)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Lattice:
    """Sums over segmentations, for many words of one length at a time."""

    def __init__(self, table: Table, log_p: np.ndarray):
        self.table, self.log_p = table, log_p

    def arcs(self, data: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """By end position: ``(start, word, piece)`` of the pieces that fit there."""
        n, size = data.shape
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        with np.errstate(over="ignore"):
            sums = prefix_sums(data)
            for j in range(1, size + 1):
                for i in range(max(0, j - self.table.longest), j):
                    piece = self.table.find(substring_hash(sums, i, j))
                    word = np.flatnonzero(piece >= 0)
                    if len(word):
                        out[j].append((i, word, piece[word]))
        return out

    def forward(self, data: np.ndarray, arcs) -> np.ndarray:
        """Log of the sum over all paths from the start to each position."""
        alpha = np.full((data.shape[1] + 1, data.shape[0]), -np.inf)
        alpha[0] = 0
        for j in range(1, data.shape[1] + 1):
            for i, word, piece in arcs[j]:
                alpha[j, word] = np.logaddexp(alpha[j, word], alpha[i, word] + self.log_p[piece])
        return alpha

    def expected(self, data: np.ndarray, count: np.ndarray, into: np.ndarray) -> None:
        """Adds the pieces' expected counts, each word weighted by its count."""
        arcs = self.arcs(data)
        alpha = self.forward(data, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for j in range(data.shape[1], 0, -1):
            for i, word, piece in arcs[j]:
                step = self.log_p[piece] + beta[j, word]
                beta[i, word] = np.logaddexp(beta[i, word], step)
                share = np.exp(alpha[i, word] + step - alpha[-1, word]) * count[word]
                into += np.bincount(piece, share, len(into))

    def log_likelihood(self, data: np.ndarray) -> np.ndarray:
        return self.forward(data, self.arcs(data))[-1]

    def long_word(self, word: bytes) -> float:
        """The same recursion for one long word, keeping only the last positions."""
        recent = [0.0]
        for j in range(1, len(word) + 1):
            terms = []
            for back in range(1, min(self.table.longest, j) + 1):
                piece = self.table.ids.get(word[j - back : j])
                if piece is not None:
                    terms.append(recent[-back] + self.log_p[piece])
            top = max(terms)
            recent.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            if len(recent) > self.table.longest:
                recent.pop(0)
        return recent[-1]

    def long_steps(self, word: bytes, a: int, b: int, alpha: list[float]) -> list[list[tuple[int, int]]]:
        """Extends the log sums up to position ``a`` to ``b``; the arcs ``(length, piece)`` by end position."""
        arcs = []
        for j in range(a + 1, b + 1):
            own = [(back, piece) for back in range(1, min(self.table.longest, j) + 1) if (piece := self.table.ids.get(word[j - back : j])) is not None]
            terms = [alpha[-back] + float(self.log_p[piece]) for back, piece in own]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            arcs.append(own)
        return arcs

    def expected_long(self, word: bytes, count: float, into: np.ndarray) -> None:
        """``expected`` of one long word, from its last stretch to its first: only the sums
        before each stretch are kept, those within are computed again."""
        keep, kept, alpha = self.table.longest, [], [0.0]
        for a in range(0, len(word), STRETCH):
            kept.append(alpha)
            alpha = list(alpha)
            self.long_steps(word, a, min(len(word), a + STRETCH), alpha)
            alpha = alpha[-keep:]
        whole, beta = alpha[-1], {len(word): 0.0}
        for k in range(len(kept) - 1, -1, -1):
            a, b = k * STRETCH, min(len(word), (k + 1) * STRETCH)
            alpha = kept[k]
            first = a + 1 - len(alpha)
            arcs = self.long_steps(word, a, b, alpha)
            for j in range(b, a, -1):
                after = beta.pop(j)
                for back, piece in arcs[j - a - 1]:
                    step = float(self.log_p[piece]) + after
                    into[piece] += count * math.exp(alpha[j - back - first] + step - whole)
                    other = beta.get(j - back, -math.inf)
                    top = max(step, other)
                    beta[j - back] = top + math.log1p(math.exp(min(step, other) - top))
            kept.pop()


def grouped(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(index, marked bytes)`` of words by length, at most ``BATCH`` at a time."""
    if not len(size):
        return
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, a, b in zip(lengths.tolist(), first, np.r_[first[1:], len(order)], strict=True):
        if length > LONG:
            continue
        for s in range(a, b, BATCH):
            at = order[s : min(b, s + BATCH)]
            data = np.full((len(at), length + 1), MARK[0], np.uint8)
            data[:, 1:] = blob[start[at][:, None] + np.arange(length)]
            yield at, data


def word_counts(docs: DataFrame, blocks: int) -> DataFrame:
    """The distinct words of all texts by block: hash, counts in training and in all texts, length, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            train = ~np.asarray(batch.column(2))
            for i, _, words in words_of(batch.column(1), True):
                h, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                count = np.zeros(len(h), COUNT_TYPE)
                count["all"] = np.bincount(inverse, minlength=len(h))
                count["train"] = np.bincount(inverse, train[i + words.row], len(h))
                length = (words.end - words.start)[first]
                stop = np.cumsum(length)
                at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(words.start[first] - (stop - length), length)
                held.append((h, count, length, words.data[at]))
                size += len(h)
                if size > 400_000:
                    h, count, length, data = held[0] = merged(held)
                    del held[1:]
                    size = len(h)
                    if size > 200_000:
                        yield from emit(h, count, length, data, blocks)
                        held, size = [], 0
        if held:
            yield from emit(*merged(held), blocks)

    return docs.mapInArrow(trimmed(run), SCHEMA)


def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of words added up, in hash order."""
    h, count, length, data = (np.concatenate(x) for x in zip(*held, strict=True))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.zeros(len(u), COUNT_TYPE)
    for f in ("train", "all"):
        np.add.at(total[f], inverse, count[f])
    start = np.cumsum(length) - length
    own = length[first]
    stop = np.cumsum(own)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start[first] - (stop - own), own)
    return u, total, own, data[at]


def emit(h: np.ndarray, count: np.ndarray, length: np.ndarray, data: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """In hash order, and so in block order."""
    block = block_of(h, blocks)
    cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(1, np.int64)
    at = np.r_[0, np.cumsum(length)]
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    if spans:
        yield pack(
            block[cut[:-1]], 0, [[h[a:b].tobytes() for a, b in spans], [count[a:b].tobytes() for a, b in spans], [length[a:b].astype("u4").tobytes() for a, b in spans], [data[at[a] : at[b]].tobytes() for a, b in spans]]
        )


def unpack(fields: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(fields[0], "u8"), np.frombuffer(fields[1], COUNT_TYPE), np.frombuffer(fields[2], "u4").astype(np.int64), np.frombuffer(fields[3], np.uint8)


def word_table(dealt: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_block(batches):
            h, count, length, data = merged([unpack(f) for _, f in rows])
            yield pack(np.array([block]), 0, [[x.tobytes()] for x in (h, count, length.astype("u4"), data)])

    return dealt.mapInArrow(trimmed(run), SCHEMA)


def totals(words: DataFrame) -> tuple[int, int]:
    """Training words, and distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                c = np.frombuffer(b.as_py(), COUNT_TYPE)["train"]
                yield pa.record_batch([pa.array([int(x)]) for x in (c.sum(), (c > 0).sum())], names=["n", "v"])

    return tuple(words.select("b").mapInArrow(trimmed(run), "n long, v long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v"))).first())


def expectation(words: DataFrame, table: Table, log_p: np.ndarray) -> np.ndarray:
    shipped = words.sparkSession.sparkContext.broadcast((table, log_p))  # a vocabulary: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, log_p = shipped.value
        lattice, total = Lattice(table, log_p), np.zeros(len(log_p))
        for batch in batches:
            for fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, count, length, data = unpack(list(fields))
                train = np.flatnonzero(count["train"] > 0)
                start = np.cumsum(length) - length
                for at, marked in grouped(data, start[train], length[train]):
                    lattice.expected(marked, count["train"][train[at]].astype(float), total)
                for i in train[length[train] > LONG]:
                    lattice.expected_long(MARK + data[start[i] : start[i] + length[i]].tobytes(), float(count["train"][i]), total)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "x"])

    out = np.zeros(len(log_p))
    for r in words.select("a", "b", "c", "d").mapInArrow(trimmed(run), "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect():  # one row per piece
        out[r.piece] = r.x
    return out


def score_words(words: DataFrame, table: Table, log_p: np.ndarray) -> DataFrame:
    """Adds each word's log10 probability: kind 0, ``a`` hash, ``b`` counts, ``c`` scores."""
    shipped = words.sparkSession.sparkContext.broadcast((table, log_p))  # a vocabulary: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shipped.value)
        for block, rows in by_block(batches):
            for _, fields in rows:
                h, count, length, data = unpack(fields)
                start, score = np.cumsum(length) - length, np.zeros(len(h))
                for at, marked in grouped(data, start, length):
                    score[at] = lattice.log_likelihood(marked)
                for i in np.flatnonzero(length > LONG):
                    score[i] = lattice.long_word(MARK + data[start[i] : start[i] + length[i]].tobytes())
                yield pack(np.array([block]), 0, [[h.tobytes()], [count.tobytes()], [(score / math.log(10)).tobytes()]])

    return words.mapInArrow(trimmed(run), SCHEMA)


def frequent(scored: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, training count and score of the words above the least frequency that leaves at most ``most``."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(512, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount((8 * np.log2(np.frombuffer(b.as_py(), COUNT_TYPE)["all"])).astype(np.int64), minlength=512)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["level", "n"])

    levels = {r.level: r.n for r in scored.select("b").mapInArrow(trimmed(sizes), "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}  # at most 512 rows
    least, total = 512, 0
    for level in sorted(levels, reverse=True):
        if total + levels[level] > most:
            break
        least, total = level, total + levels[level]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                count = np.frombuffer(b, COUNT_TYPE)
                keep = (8 * np.log2(count["all"])).astype(np.int64) >= least
                if keep.any():
                    yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (np.frombuffer(a, "u8")[keep], count["train"][keep], np.frombuffer(c, "f8")[keep])], names=["a", "b", "c"])

    rows = scored.select("a", "b", "c").mapInArrow(trimmed(chosen), "a binary, b binary, c binary").collect()  # at most `most` words
    h, c, s = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) if rows else np.zeros(0, t) for i, t in enumerate(("u8", "i8", "f8")))
    order = np.argsort(h)
    return h[order], c[order], s[order]


DOC_TYPE = np.dtype([("row", "<i8"), ("doc", "<i8"), ("null", "?"), ("held", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
OUT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def lookup(table: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(found, count, score)`` of hashes in a table sorted by hash."""
    keys_, count, score = table
    if not len(keys_):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys_, h), len(keys_) - 1)
    return keys_[at] == h, count[at], score[at]


def doc_sums(docs: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int) -> DataFrame:
    """Per row: sums over its frequent words (kind 2); its other words dealt by hash (kind 1)."""
    shipped = docs.sparkSession.sparkContext.broadcast(head)  # HEAD words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, part = Router(1, ["u8", "u4"], sort=True), 0
        for batch in batches:
            ids, held = batch.column(0), np.asarray(batch.column(2))
            rows = np.asarray(batch.column(3))
            for i, j, words in words_of(batch.column(1), True):
                out = np.zeros(j - i, DOC_TYPE)
                out["row"], out["held"] = rows[i:j], held[i:j]
                out["doc"] = np.asarray(ids.slice(i, j - i).fill_null(0), np.int64)
                out["null"] = ~np.asarray(ids.slice(i, j - i).is_valid())
                out["tokens"] = words.counts() + 1
                found, count, score = lookup(shipped.value, words.hash)
                row = words.row
                out["known"] = np.bincount(row[found], count[found] > 0, j - i)
                out["base"] = np.bincount(row[found], np.log10(count[found] + 0.5), j - i)
                out["score"] = np.bincount(row[found], score[found], j - i)
                h, r = words.hash[~found], row[~found]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(h)])
                yield from router.add(block_of(h[first], blocks), rows[i + r[first]], h[first], times)
                part = (part * 1103515245 + 12345 + int(rows[i])) % (1 << 31)
                yield pack(np.array([part % blocks]), 2, [[out.tobytes()]])
        yield from router.flush()

    return docs.mapInArrow(trimmed(run), SCHEMA)


def add_up(dealt: DataFrame) -> DataFrame:
    """Per block: the dealt words' counts and scores, summed per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_block(batches):
            for kind, fields in rows:
                if kind == 2:
                    d = np.frombuffer(fields[0], DOC_TYPE)
                    yield pa.record_batch([pa.array(d["row"]), pa.array(d["doc"], mask=d["null"]), *(pa.array(d[c]) for c in ("held", "tokens", "known", "base", "score"))], names=OUT_NAMES)
            row, h, times = keys(rows, 1), column(rows, 1, 2, "u8"), column(rows, 1, 3, "u4")
            if not len(row):
                continue
            words = column(rows, 0, 0, "u8"), column(rows, 0, 1, COUNT_TYPE)["train"], column(rows, 0, 2, "f8")
            order = np.argsort(words[0])
            _, count, score = lookup(tuple(x[order] for x in words), h)
            u, at = np.unique(row, return_inverse=True)
            sums = [np.bincount(at, w, len(u)) for w in (times * (count > 0), times * np.log10(count + 0.5), times * score)]
            none = pa.nulls(len(u))
            yield pa.record_batch([pa.array(u), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=OUT_NAMES)

    return dealt.mapInArrow(trimmed(run), OUT)


OUT_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def score_documents(docs: DataFrame, model_file: str, modulus: int = 5, held_out: int = 1, rounds: int = ROUNDS, head: int = HEAD, prior: float = PRIOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; ``prior`` is the share of the vocabulary's scores."""
    held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held")
    source = clean(docs, text=text, key=key).select("doc_id", "text", held)
    n_docs, n_bytes = source.filter("not held").count(), source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = plan_blocks(int(n_bytes) // 32)
    words = stored(word_table(deal(word_counts(source, blocks), blocks)), "words")
    n_words, v_words = totals(words)
    n, v = n_words + n_docs, v_words + (n_docs > 0)

    weights = first_weights(read_pieces(model_file))
    table, first = Table(list(weights)), np.array(list(weights.values()))
    p, end = first, 0.5
    for _ in range(rounds if n_words else 0):
        found = expectation(words, table, np.log(p))
        p, end = (1 - prior) * found / found.sum() + prior * first, n_docs / (found.sum() + n_docs)
    scored = stored(score_words(words, table, np.log(p * (1 - end))), "scored-words")
    top = frequent(scored, head)
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    parts = add_up(deal(scored.unionByName(doc_sums(numbered, top, blocks)), blocks))
    end_base = math.log10(n_docs + 0.5)
    each = math.log10(n + 0.5 * (v + 1)) if n else math.log10(0.5)
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("k") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") + end_base - F.col("n_tokens") * each).alias("base_score"),
        (F.col("s") + math.log10(end)).alias("score"),
    )
