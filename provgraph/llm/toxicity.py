"""Toxicity: a convolutional text classifier, trained in numpy.

A lower-cased word piece is the sum of hashed embeddings (``BUCKETS`` rows) of the
whole word and of its beginnings of ``PREFIXES`` bytes, so that inflected and
compound forms share their stem; filters of several widths slide over the whole text, rectified and max-pooled, then one logistic
unit.  Max pooling sends a gradient to one window per filter only, so training
is cheap at any text length.  Scoring projects each distinct word of a slice
through the filter positions once, and then only gathers and adds.

Training reads every labelled row that is not held out.  Rows are dealt by a hash of the id to shards of about
``SHARD_BYTES`` of text; in each of ``ROUNDS`` rounds every shard's task goes on from the same network, and each number
then moves by the mean of the shards' moves, weighted by the squared gradients that each shard has seen for it (so shards
without a word have no say in its embedding).  The means are taken by ranges of the network's tables; the driver only holds
these tables, whose size is fixed.  Tables of one shard are trained in one round of as many epochs.  A decision threshold is
calibrated for each language (falling back to the overall one where a language has under ``LEAST`` positives); language selects the
threshold only and is never an input of a score.  Thresholds need scores by a network that has not seen the row: when ``crossed``,
two networks learn one half of the labelled rows each and score the other half, so that thresholds come from every labelled row, and
the network that is kept learns from every one too.  Otherwise every fourth labelled row is left out of the only training and
gives the thresholds, at under half of the cost.

Cases: null and empty texts get the score of an all-padding text; texts of any length are read
whole, slice by slice; rows are independent, so ties and repeated rows get equal scores, and a null ``doc_id`` is
scored but never held out or learnt from; of rows that repeat an id each different one is learnt from; without labelled rows of both kinds every score is 0; an empty
table gives an empty result; a null or unknown language
uses the overall threshold; further columns are kept by ``drop_toxic`` and ignored elsewhere.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SCHEMA, Batches, by_block, deal, pack, small_batches, trimmed
from .kernel import Words
from .labelled import known, pieces, remainder

BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
PREFIXES = (4, 5, 6, 8)
FEATURES = 1 + len(PREFIXES)
LEAST = 20
THRESHOLD = 0.3
SHARD_BYTES = 64 << 20  # of texts that may be labelled
ROUNDS, EPOCHS = 4, 8
ASIDE = 4
HALVES = (0, 2), (1, 3)  # of the ASIDE folds
RANGE = 1 << 12  # lines of a network's numbers that are averaged together
SLICES = "block int, start long, n long, hits long, labels binary, langs array<string>, buckets binary, word binary, cuts binary"  # the last three by ``shrunk``


def token_ids(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, end row, buckets of each distinct word, word of each piece, row of each piece)``.

    A word has ``1 + len(PREFIXES)`` buckets; bucket 0 is padding and stands for a
    beginning that is not shorter than the word.
    """
    for i, j, words in pieces(column, lower=True):
        h = words.hash
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        size = (words.end - words.start)[first]
        own = Words.__new__(Words)
        own.data, own.start, own.end, own._hash = words.data, words.start[first], words.end[first], None
        order = np.argsort(own.start)
        own.start, own.end = own.start[order], own.end[order]
        buckets = np.zeros((len(first), FEATURES), np.int64)
        buckets[:, 0] = h[first] % np.uint64(BUCKETS - 1) + np.uint64(1)
        for k, (n, x) in enumerate(zip(PREFIXES, own.prefix_hashes(list(PREFIXES)), strict=True), 1):
            back = np.empty_like(x)
            back[order] = x
            buckets[:, k] = np.where(size > n, (back + np.uint64(k)) % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0))
        yield i, j, buckets, word, words.row


@dataclass
class Cnn:
    embed: np.ndarray  # BUCKETS x DIM
    filters: dict[int, np.ndarray]  # width -> (width * DIM) x FILTERS
    bias: dict[int, np.ndarray]
    out: np.ndarray
    intercept: float

    @staticmethod
    def fresh(seed: int = 11) -> Cnn:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)  # small: an unseen word says little
        embed[0] = 0
        filters = {w: r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS}
        return Cnn(embed, filters, {w: np.zeros(FILTERS) for w in WIDTHS}, r.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)

    @staticmethod
    def of(lines: np.ndarray) -> Cnn:
        """From what ``lines`` gave."""
        embed, rest = lines[:BUCKETS].copy(), lines[BUCKETS:].ravel().astype(float)
        cuts = np.cumsum([w * DIM * FILTERS for w in WIDTHS] + [FILTERS] * len(WIDTHS) + [len(WIDTHS) * FILTERS, 1])
        *parts, out, intercept, _ = np.split(rest, cuts)
        filters = {w: x.reshape(w * DIM, FILTERS) for w, x in zip(WIDTHS, parts, strict=False)}
        return Cnn(embed, filters, dict(zip(WIDTHS, parts[len(WIDTHS) :], strict=True)), out, float(intercept[0]))

    def lines(self) -> np.ndarray:
        """All numbers in lines of ``DIM``, one for each bucket first."""
        rest = np.concatenate([*(self.filters[w].ravel() for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out, [self.intercept]])
        return np.concatenate([self.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float32)

    def forward(self, buckets: np.ndarray, word: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Logit, and for each width the winning windows' starts and pooled values."""
        buckets, word = padded(buckets, word)
        x = self.embed[buckets].sum(1)[word]
        pooled = []
        for w in WIDTHS:
            windows = np.lib.stride_tricks.sliding_window_view(x.ravel(), w * DIM)[::DIM] if w > 1 else x
            a = windows @ self.filters[w] + self.bias[w]
            at = a.argmax(0)
            pooled.append((at, np.maximum(a[at, np.arange(FILTERS)], 0)))
        return float(np.concatenate([p for _, p in pooled]) @ self.out + self.intercept), pooled


def padded(buckets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text of fewer pieces than the widest filter gets padding."""
    short = max(WIDTHS) - len(word)
    if short <= 0:
        return buckets, word
    return np.concatenate([buckets, np.zeros((1, FEATURES), buckets.dtype)]), np.concatenate([word, np.full(short, len(buckets), word.dtype)])


def packed(buckets: np.ndarray, word: np.ndarray) -> bytes:
    """A text's distinct words' buckets and its words, as bytes."""
    own, at = np.unique(word, return_inverse=True)
    return b"".join((np.uint32(len(own)).tobytes(), buckets[own].astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes()))


def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(x, np.uint32)
    end = 1 + int(data[0]) * FEATURES
    return data[1:end].reshape(-1, FEATURES), data[end:]


def untouched() -> Cnn:
    """Adagrad's sums of squared gradients before training."""
    return Cnn(
        np.full((BUCKETS, DIM), 1e-4, np.float32), {w: np.full((w * DIM, FILTERS), 1e-4) for w in WIDTHS}, {w: np.full(FILTERS, 1e-4) for w in WIDTHS},
        np.full(len(WIDTHS) * FILTERS, 1e-4), 1e-4,
    )


def shrunk(x: np.ndarray) -> bytes:
    """Small numbers, compressed, after their count."""
    data = x.astype(np.uint32).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], 4 * int.from_bytes(x[:8], "little"), "zstd", asbytes=True), np.uint32)


def fit(examples: list[tuple[int, bytes]] | Shard, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 5, net: Cnn | None = None, grown: Cnn | None = None) -> Cnn:
    """Adagrad, one text at a time; goes on from ``net`` and its sums ``grown``, both changed in place."""
    net, grown = net or Cnn.fresh(), grown or untouched()
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            label, x = examples[k]
            buckets, word = padded(*unpacked(x))
            logit, pooled = net.forward(buckets, word)
            g = 1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label
            if abs(g) < 0.02:
                continue
            values = np.concatenate([p for _, p in pooled])
            back = g * net.out
            d = g * values
            grown.out += d * d
            net.out -= rate * d / np.sqrt(grown.out)
            grown.intercept += g * g
            net.intercept -= rate * g / np.sqrt(grown.intercept)
            for i, w in enumerate(WIDTHS):
                at, p = pooled[i]
                delta = np.where(p > 0, back[i * FILTERS : (i + 1) * FILTERS], 0.0)
                tokens = buckets[word[at[:, None] + np.arange(w)]]  # FILTERS x w x FEATURES
                x = net.embed[tokens].sum(2).reshape(FILTERS, w * DIM)
                dx = np.repeat((net.filters[w] * delta).T.reshape(FILTERS * w, DIM), FEATURES, 0)
                df = (x * delta[:, None]).T
                grown.filters[w] += df * df
                net.filters[w] -= rate * df / np.sqrt(grown.filters[w])
                grown.bias[w] += delta * delta
                net.bias[w] -= rate * delta / np.sqrt(grown.bias[w])
                flat = tokens.ravel()
                np.add.at(grown.embed, flat, dx * dx)
                np.add.at(net.embed, flat, (-rate * dx / np.sqrt(grown.embed[flat])).astype(np.float32))
                net.embed[0] = 0
    return net


class Scorer:
    """The network, for the texts of a slice."""

    def __init__(self, net: Cnn):
        self.embed = net.embed.astype(np.float32)
        self.filters = {w: [np.ascontiguousarray(net.filters[w][k * DIM : (k + 1) * DIM], np.float32) for k in range(w)] for w in WIDTHS}
        self.bias = {w: net.bias[w].astype(np.float32) for w in WIDTHS}
        self.out, self.intercept = net.out, net.intercept

    def logits(self, buckets: np.ndarray, word: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Of each row, in blocks of positions; word 0 is padding here."""
        embed = np.zeros((len(buckets) + 1, DIM), np.float32)
        for k in range(FEATURES):
            embed[1:] += self.embed[buckets[:, k]]
        counts = np.bincount(row, minlength=n_rows)
        size = np.maximum(counts, max(WIDTHS))  # short texts are padded
        begin = np.cumsum(size) - size
        seq = np.zeros(int(size.sum()), np.int64)
        seq[begin[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = word + 1
        owner = np.repeat(np.arange(n_rows), size)
        out = np.zeros((n_rows, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            tables = [embed @ f for f in self.filters[w]]
            best = np.full((n_rows, FILTERS), -np.inf, np.float32)
            starts = np.flatnonzero(owner[: len(owner) - w + 1] == owner[w - 1 :])
            for a in range(0, len(starts), 1 << 16):
                s = starts[a : a + (1 << 16)]
                act = tables[0][seq[s]]
                for k in range(1, w):
                    act += tables[k][seq[s + k]]
                rows = owner[s]
                first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
                np.maximum.at(best, rows[first], np.maximum.reduceat(act, first))
            out[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(best + self.bias[w], 0)
        return out @ self.out + self.intercept


@dataclass
class Model:
    scorer: Scorer | None
    overall: float
    by_language: dict[str, float]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut between neighbouring different scores of greatest F1."""
    order = np.lexsort((y, -p))
    hit, all_ = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (y * weight).sum())
    p = p[order]
    k = int(np.where(np.r_[p[1:] < p[:-1], True], f1, -1).argmax())
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


class Shard:
    """A shard's texts that are ``aside`` (in one of ``folds``), or the others: as examples, and their languages."""

    def __init__(self, aside: bool, folds: tuple[int, ...] = (ASIDE - 1,)):
        self.aside, self.folds = aside, folds
        self.label: list[int] = []
        self.lang: list[str] = []
        self.place: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, start: int, labels: bytes, langs: list[str], buckets: bytes, word: bytes, cuts: bytes) -> None:
        table, words, at = widened(buckets).reshape(FEATURES, -1).T, widened(word), widened(cuts)
        for k, label in enumerate(labels):
            if ((start + k) % ASIDE in self.folds) == self.aside:
                self.label.append(label)
                self.lang.append(langs[k])
                self.place.append((table, words[at[k] : at[k + 1]]))

    def __len__(self) -> int:
        return len(self.label)

    def __getitem__(self, k: int) -> tuple[int, bytes]:
        return self.label[k], packed(*self.place[k])


def shards(batches: Batches, aside: bool, folds: tuple[int, ...] = (ASIDE - 1,)) -> Iterator[tuple[int, Shard]]:
    """Blocks and their texts, from rows of ``SLICES``."""
    current, shard = None, Shard(aside, folds)
    for batch in batches:
        for row in batch.select(["block", "start", "labels", "langs", "buckets", "word", "cuts"]).to_pylist():
            block = row.pop("block")
            if block != current:
                if len(shard):
                    yield current, shard
                current, shard = block, Shard(aside, folds)
            shard.add(**row)
    if len(shard):
        yield current, shard


def labelled_texts(docs: DataFrame, own: DataFrame, modulus: int, held_out: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """Rows of ``SLICES`` with the buckets and words of every text (``doc_id, text, lang``) that has a label in ``own``, and
    the number of shards.  A shard's rows are ordered by a hash of the id; each label comes just before its texts."""
    texts = docs.filter(remainder("doc_id", modulus) != held_out)
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    named = own.select("doc_id", F.lit(0).alias("kind"), "label", F.lit("").alias("text"), F.lit("").alias("lang"))
    both = named.unionByName(texts.select("doc_id", F.lit(1).alias("kind"), F.lit(0).alias("label"), "text", "lang")).withColumn("order", F.xxhash64("doc_id"))
    dealt = both.withColumn("block", F.pmod("order", F.lit(n)).cast("int")).repartitionById(n, "block")
    dealt = dealt.sortWithinPartitions("block", "order", "doc_id", "kind", "text", "lang").select("block", "doc_id", "kind", "label", "text", "lang")

    def sliced(batches: Batches) -> Batches:
        current, start, named, label, last = None, 0, None, 0, None
        for batch in batches:
            chosen: dict[int, list[tuple[int, int]]] = {}
            texts, langs = batch.column(4), batch.column(5)
            for i, (block, key, kind, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if not kind:
                    named, label, last = key, y, None
                elif key == named:
                    row = texts[i], langs[i]
                    if last != row:  # rows that are the same in all count once
                        chosen.setdefault(block, []).append((i, label))
                    last = row
            for block, rows in chosen.items():
                if block != current:
                    current, start = block, 0
                part, y = batch.take(pa.array([i for i, _ in rows])), np.array([y for _, y in rows], np.uint8)
                for i, j, buckets, word, row in token_ids(part.column(4)):
                    cuts = np.searchsorted(row, np.arange(j - i + 1))
                    one = [block, start + i, j - i, int(y[i:j].sum()), y[i:j].tobytes(), part.column(5).slice(i, j - i).to_pylist()]
                    one += [shrunk(x) for x in (buckets.T.ravel(), word, cuts)]
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(one, types, strict=True)], names=[c.split()[0] for c in SLICES.split(", ")])
                start += len(rows)

    return dealt.mapInArrow(trimmed(sliced), SLICES), n


def trained_round(texts: DataFrame, lines: np.ndarray, grown: np.ndarray, epochs: int, seed: int, folds: tuple[int, ...] = (ASIDE - 1,)) -> tuple[np.ndarray, np.ndarray]:
    """A network's lines and their sums after every shard's task went on from the same ones, without the texts of ``folds``."""
    shipped = texts.sparkSession.sparkContext.broadcast((lines, grown))  # two tables of BUCKETS rows

    def moved(batches: Batches) -> Batches:
        before, sums = shipped.value
        for block, shard in shards(batches, aside=False, folds=folds):
            net, own = Cnn.of(before), Cnn.of(sums)
            fit(shard, epochs, seed=seed, net=net, grown=own)
            move, more = net.lines() - before, own.lines() - sums
            at = np.flatnonzero((more > 0).any(1))
            for ids in np.split(at, np.flatnonzero(np.diff(at // RANGE)) + 1) if len(at) else []:
                yield pack(ids[:1] // RANGE, block, [[ids.astype(np.uint32).tobytes()], [move[ids].tobytes()], [more[ids].tobytes()]])

    def merged(batches: Batches) -> Batches:
        for block, rows in by_block(batches):
            top, base, squares = np.zeros((3, RANGE, DIM))
            for kind, fields in rows:  # shards in order
                ids = np.frombuffer(fields[0], np.uint32).astype(np.int64) - block * RANGE
                move, more = (np.frombuffer(f, np.float32).reshape(-1, DIM).astype(float) for f in fields[1:3])
                top[ids] += move * more
                base[ids] += more
                squares[ids] += more * more
            ids = np.flatnonzero(base.any(1))
            under = np.where(base[ids] > 0, base[ids], 1)
            means = [(x[ids] / under).astype(np.float32).tobytes() for x in (top, squares)]
            yield pack(np.array([block]), 0, [[(ids + block * RANGE).astype(np.uint32).tobytes()], *([m] for m in means)])

    parts = deal(texts.mapInArrow(trimmed(moved), SCHEMA), -(-len(lines) // RANGE))
    rows = parts.mapInArrow(trimmed(merged), SCHEMA).collect()  # no more than the two tables
    lines, grown = lines.copy(), grown.copy()
    for r in rows:
        ids = np.frombuffer(r.a, np.uint32)
        for table, x in ((lines, r.b), (grown, r.c)):
            table[ids] += np.frombuffer(x, np.float32).reshape(-1, DIM)
    shipped.destroy()
    return lines, grown


def thresholds(texts: DataFrame, nets: list[tuple[np.ndarray, tuple[int, ...]]]) -> tuple[float, dict[str, float]]:
    """The overall threshold and those of languages, from the texts of the folds that each network left aside."""
    shipped = [texts.sparkSession.sparkContext.broadcast(lines) for lines, _ in nets]

    def scorer(shared: Broadcast, folds: tuple[int, ...]) -> Callable[[Batches], Batches]:
        def scored(batches: Batches) -> Batches:
            net = Cnn.of(shared.value)
            for _, shard in shards(batches, aside=True, folds=folds):
                p = 1 / (1 + np.exp(-np.array([net.forward(*unpacked(x))[0] for _, x in shard])))
                yield pa.record_batch([pa.array(p), pa.array(shard.label, pa.int32()), pa.array(shard.lang, pa.string())], names=["p", "y", "lang"])

        return scored

    def cuts(batches: Batches) -> Batches:
        rows = [[c.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1), b.column(2).cast(pa.large_string()))] for b in batches]
        p, y, langs = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0), np.zeros(0, object))
        one = np.ones(len(p))
        overall = best_threshold(p, y, one) if y.sum() >= LEAST else THRESHOLD
        own = {g: langs == g for g in set(langs) if g}
        found = {str(g): best_threshold(p[at], y[at], one[at]) for g, at in own.items() if y[at].sum() >= LEAST and (1 - y[at]).sum() >= LEAST}
        yield pa.record_batch([pa.array([pickle.dumps((overall, found), 5)], pa.binary())], names=["cuts"])

    scores = [texts.mapInArrow(trimmed(scorer(b, folds)), "p double, y int, lang string") for b, (_, folds) in zip(shipped, nets, strict=True)]
    rows = functools.reduce(DataFrame.unionByName, scores).repartition(1).mapInArrow(trimmed(cuts), "cuts binary").collect()  # a score, label and language a text
    for b in shipped:
        b.destroy()
    return pickle.loads(rows[0].cuts) if rows else (THRESHOLD, {})


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, shard_bytes: int = SHARD_BYTES, text: str = "text", lang: str = "lang", key: str = "doc_id",
    crossed: bool = True,
) -> Model:
    """Network and thresholds from all labelled rows that are not held out, both from each of them if ``crossed``."""
    small_batches(docs.sparkSession)
    own = known(labels, label, modulus, held_out).filter(F.col("label").isin(0, 1))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    texts, n = labelled_texts(source, own, modulus, held_out, shard_bytes)
    texts = texts.persist(StorageLevel.DISK_ONLY)  # what an executor loses is made again
    try:
        rows, hits = texts.agg(F.sum("n"), F.sum("hits")).first()
        if not 0 < (hits or 0) < (rows or 0):
            return Model(None, THRESHOLD, {})
        rounds = ROUNDS if n > 1 else 1

        def trained(folds: tuple[int, ...]) -> np.ndarray:
            lines, grown = Cnn.fresh().lines(), untouched().lines()
            for k in range(rounds):
                lines, grown = trained_round(texts, lines, grown, EPOCHS // rounds, 5 + k, folds)
            return lines

        if crossed:
            cuts, lines = thresholds(texts, [(trained(folds), folds) for folds in HALVES]), trained(())
        else:
            lines = trained((ASIDE - 1,))
            cuts = thresholds(texts, [(lines, (ASIDE - 1,))])
        return Model(Scorer(Cnn.of(lines)), *cuts)
    finally:
        texts.unpersist()


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    p = np.zeros(len(texts))
    if model.scorer:
        for i, j, *slice_ in token_ids(texts):
            p[i:j] = 1 / (1 + np.exp(-np.clip(model.scorer.logits(*slice_, j - i), -35, 35)))
    return p


def rejected(model: Model, p: np.ndarray, langs: pa.Array) -> np.ndarray:
    cut = np.array([model.by_language.get(g, model.overall) for g in langs.to_pylist()])
    return p >= cut


def score(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted, rejected``: predicted at 0.3, rejected at the language's threshold."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of BUCKETS rows

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(shipped.value, batch.column(1))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(rejected(shipped.value, p, batch.column(3)))],
                names=["doc_id", "held_out", "score", "predicted", "rejected"],
            )

    held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held, "lang")
    return source.mapInArrow(trimmed(scored), "doc_id long, held_out boolean, score double, predicted int, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns, that the model doesn't reject."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at, by = docs.columns.index(text), docs.columns.index(lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(shipped.value, batch.column(at))
            yield batch.filter(pa.array(~rejected(shipped.value, p, batch.column(by))))

    return docs.mapInArrow(trimmed(keep), docs.schema)
