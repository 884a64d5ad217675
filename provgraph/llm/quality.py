"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features of a text are hashed to ``2**bits`` columns, each with weight ``1 / sqrt(number of
features)``, and a bias: its distinct 1- and 2-grams of word pieces (letter runs
and sign runs, case kept), and, since new words share none of those with training, its distinct
1- to 3-grams of word *classes*: a piece's kind (by its first byte: letter or digit, upper-case letter, sign), the
power of two of its length, and whether it repeats the piece before it.  Nothing else is an input.

Training reads at most ``sample_rows`` labelled rows in whole length, and of them at most
``sample_bytes`` of features (documented bounds, ordered by a hash of the id), in one sequential pass per
epoch of one executor task; the driver only holds the ``2**bits`` weights.  Scoring is one narrow pass.

Cases: null and empty texts get the bias' score; texts of any length are read whole, slice by slice; rows are
independent, so ties and repeated rows get equal scores, and a null ``doc_id`` is scored but never held
out or learnt from; no labelled rows: every score is 0.5; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import clean, trimmed
from .kernel import Words, distinct_per_row, mix, sequence_hash
from .labelled import SAMPLE_BYTES, learned, pieces, remainder, sample

BITS = 20


def classes(words: Words, h: np.ndarray) -> np.ndarray:
    """A hash of each piece's class."""
    size = words.end - words.start
    first = words.data[words.start]
    kind = np.where((first >= 65) & (first <= 90), 1, np.where((first < 48) | (first > 57) & (first < 97) | (first > 122) & (first < 128), 2, 0))
    again = np.zeros(len(h), np.int64)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    return mix((np.log2(size).astype(np.int64) * 8 + kind * 2 + again + (1 << 40)).astype(np.uint64))


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, feature, row)`` of each slice, distinct per row, sorted by row."""
    for i, j, words in pieces(column, lower=False):
        h, row = words.hash, words.row
        own = classes(words, h)
        grams, rows = [h, own], [row, row]
        for n in (2, 3):
            at = np.flatnonzero(row[: -n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
            for x in (h, own) if n == 2 else (own,):
                grams.append(sequence_hash([x[at + k] for k in range(n)]))
                rows.append(row[at])
        yield i, j, *distinct_per_row(np.concatenate(grams) >> np.uint64(64 - bits), np.concatenate(rows))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    size: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example; the last coordinate is the bias."""
        at = np.append(at, self.size)
        x = np.full(len(at), 1 / np.sqrt(max(1, len(at) - 1)))
        x[-1] = 1.0
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[int, str, bytes]], bits: int, epochs: int) -> np.ndarray:
    """Weights (bias last) from ``(label, lang, features)``."""
    model, order = Ftrl(1 << bits), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(np.frombuffer(rows[i][2], np.uint32).astype(np.int64), rows[i][0])
    return model.weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, sample_rows: int = 16_000, epochs: int = 3, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights (bias last) from at most ``sample_rows`` labelled rows."""
    chosen = sample(labels, label, modulus, held_out, sample_rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, feature, row in features(batch.column(1), bits):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                x = pa.array([feature[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in (0, 2)), pa.nulls(j - i, pa.string()), x], names=["doc_id", "label", "lang", "x"])

    joined = clean(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # sample_rows at most
    examples = joined.mapInArrow(trimmed(packed), "doc_id long, label int, lang string, x binary")
    return learned(examples, functools.partial(fit, bits=bits, epochs=epochs), sample_bytes)


def score(docs: DataFrame, weights: np.ndarray, modulus: int, held_out: int, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    bits = (len(weights) - 1).bit_length() - 1
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j, feature, row in features(batch.column(1), bits):
                total[i:j] = np.bincount(row, w[feature.astype(np.int64)], j - i)
                n[i:j] = np.bincount(row, minlength=j - i)
            p = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(n, 1)) + w[-1], -35, 35)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out")
    return clean(docs).select("doc_id", "text", held).mapInArrow(trimmed(scored), "doc_id long, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, sample_rows: int = 16_000) -> DataFrame:
    return score(docs, train(docs, labels, label, modulus, held_out, sample_rows), modulus, held_out)
