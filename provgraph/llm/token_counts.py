"""Exact token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string is put through the merges by
itself; those that end as exactly one token are *proved* to be whole tokens.
A pre-token that is one of them counts 1 by a table lookup; only the rest is
merged (with a bounded table of recent results), pre-tokens of over ``STREAM`` bytes window by
window, so that memory stays bounded.

Special strings in a text count as one token each, as the library does by
default; a null text is empty and has 0 tokens and bytes; texts of any length
are read pre-token by pre-token; rows are independent (ties and repeated rows keep their own
results), a null ``doc_id`` is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .blocks import clean, resident, trimmed
from .bpe import Bounded, MergeTable
from .bpe_stream import StreamEncoder, sufficient_lookahead

#: Fixed value: how the byte-level vocabularies cut texts into pre-tokens (white space as Unicode has it).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG = 1 << 20
STREAM = 1 << 14


def prove_whole_tokens(table: MergeTable) -> frozenset[str]:
    """Texts whose bytes the merges turn into one token, found by merging each vocabulary string."""
    proved = set()
    for name, number in table.vocab.items():
        data = bytes(table.byte_of[c] for c in name if c in table.byte_of)
        if len(data) == len(name) and table.merge(table.symbols(data)) == [number]:
            try:
                proved.add(data.decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: no text equals it
                continue
    return frozenset(proved)


class Counter:
    def __init__(self, table: MergeTable, whole: frozenset[str]):
        self.table = table
        self.find = regex.compile(PRE_TOKENS)
        self.lookahead = sufficient_lookahead(table)
        self.counts = Bounded(dict.fromkeys(whole, 1), self.merged)

    def merged(self, piece: str) -> int:
        """Tokens of a pre-token that isn't a whole token."""
        data = piece.encode("utf-8")
        if len(data) <= STREAM:
            return len(self.table.merge(self.table.symbols(data)))
        stream = StreamEncoder(self.table, self.lookahead)
        return sum(1 for _ in stream.feed(data)) + sum(1 for _ in stream.finish())

    def count(self, text: str) -> int:
        n, get = 0, self.counts.__getitem__
        for special, part in self.table.segments(text):
            if special:
                n += 1
            elif len(part) < LONG:
                n += sum(map(get, self.find.findall(part)))
            else:
                n += sum(get(m.group()) for m in self.find.finditer(part))
        return n


def count_tokens(docs: DataFrame, vocab: bytes, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, in one narrow pass."""
    whole = prove_whole_tokens(MergeTable(vocab))
    shipped = docs.sparkSession.sparkContext.broadcast((vocab, whole))  # a vocabulary: of fixed size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, whole = shipped.value
        counter = resident(("counter", hash(vocab)), lambda: Counter(MergeTable(vocab), whole))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                s = value.as_py() or ""
                n_bytes.append(len(s.encode("utf-8")))
                n_tokens.append(counter.count(s))
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return clean(docs, text=text, key=key).mapInArrow(trimmed(counted, keeps=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
