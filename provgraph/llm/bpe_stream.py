"""BPE encoding as a bounded-lookahead transducer, and incremental decoding.

**Lookahead.**  Let two runs of the merges differ only to the right of a cut.
A difference moves left across the symbol ``u`` only when a merge ``(u, x)``
happens in one run and not in the other, and every further step needs a merge
of a higher rank whose right side begins, on its left spine, with the left side
of an earlier one.  ``sufficient_lookahead`` sums ``len(u)`` over the worst such
chain by dynamic programming over the merge list: tokens that end further left
of the cut than that are final.

**Encoder.**  ``StreamEncoder`` takes a pre-token's bytes piece by piece, keeps at
most a window of ``2 * lookahead + longest token`` bytes, emits tokens once they are stable, and
continues after the last emitted token (no merge crosses a final boundary, so
the rest is encoded as if it stood alone).  Every pre-token of every text goes through it: a text is read in
blocks, a pre-token that goes on in the next block stays open in the encoder, and for one that ends within the
window a bounded table remembers what the encoder gave for it lately.

**Decoder.**  ``StreamDecoder`` turns ids into text as they come, in two forms: the library's (this kind of vocabulary file
has no decoder, so token strings are joined by spaces) and the running text, for which it holds the
bytes of an unfinished UTF-8 character.  At a word's end it is back in its first state, so a bounded table
remembers what it gave for whole words.

Beside the text itself, memory is a block, a window and those tables, however long the text or a word
of it is; only a run of combining marks, which normalising may reorder as a whole, is kept in one piece.

Cases: null and empty texts have no tokens and decode to nothing; special strings are single tokens; rows are
independent, so ties and repeated rows get equal results; a null ``doc_id`` is kept; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .blocks import clean, resident, trimmed
from .bpe import FINAL, SPECIAL, Bounded, MergeTable

#: Fixed value: the word vocabulary's pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Its pre-tokens that can be of any length.
LETTERS, SIGNS = r"\p{L}+", r"[^\p{White_Space}\p{L}\p{N}]+"
BLOCK = 1 << 16


def sufficient_lookahead(table: MergeTable) -> int:
    """Bytes to the right of a token's end that decide whether it is final."""
    width = {i: 1 for i in table.single} | {i: 1 for i in table.final}
    left_part: dict[int, int] = {}
    reach: dict[int, int] = {}  # symbol -> worst chain that starts with a merge whose left side it is
    worst = 0
    for a, b, c in table.parts:
        width.setdefault(c, width[a] + width[b])
        left_part.setdefault(c, a)
        spine, before = b, 0
        while spine is not None:
            before = max(before, reach.get(spine, 0))
            spine = left_part.get(spine)
        total = width[a] + before
        reach[a] = max(reach.get(a, 0), total)
        worst = max(worst, total)
    table.widest = max(width.values())
    return worst


class StreamEncoder:
    """Encodes one pre-token given in pieces; ``feed`` and ``finish`` yield final ids."""

    def __init__(self, table: MergeTable, lookahead: int):
        self.table, self.lookahead = table, lookahead
        self.window = 2 * lookahead + table.widest
        self.held = b""

    def feed(self, data: bytes) -> Iterator[int]:
        for i in range(0, len(data), self.window):
            self.held += data[i : i + self.window]
            while len(self.held) > self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        view = self.held[: self.window]
        end, final = 0, len(view) - self.lookahead
        for token in self.table.merge(self.table.symbols(view, ends=False)):
            size = len(self.table.names[token])
            if end + size > final:
                break
            end += size
            yield token
        self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        yield from self.table.merge(self.table.symbols(self.held))
        self.held = b""


class StreamDecoder:
    """Ids to text, as they come: ``names`` as the library decodes, ``text`` the running text, where an
    end-of-word mark is a space and bytes wait for their character."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def names(self, ids: Iterable[int]) -> str:
        glue = "" if self.first else " "
        self.first = False
        return glue + " ".join(map(self.table.names.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        out, held = [], []
        for token in ids:
            own, kind = self.table.parsed[token]
            if kind == SPECIAL:
                out += self.bytes.decode(b"".join(held), True), self.table.names[token]
                held.clear()
                continue
            held.append(own)
            if kind == FINAL:
                out += self.bytes.decode(b"".join(held), True), " "
                held.clear()
        out.append(self.bytes.decode(b"".join(held)))
        return "".join(out)

    def finish(self) -> str:
        return self.bytes.decode(b"", True)


#: What left encoder and decoder for some ids: how many, the ids as decimals and as 32-bit numbers, both decoded forms.
Shown = tuple[int, bytes, bytes, bytes, bytes]


class Transcoder:
    """Texts to ids and back, for vocabularies with an end-of-word mark."""

    def __init__(self, table: MergeTable, lookahead: int):
        self.table, self.lookahead = table, lookahead
        self.find, self.letters, self.signs = (regex.compile(x) for x in (PRE_TOKENS, LETTERS, SIGNS))
        self.encoder, self.decoder = StreamEncoder(table, lookahead), StreamDecoder(table)
        self.window = self.encoder.window
        self.words = Bounded({}, self._word)

    def _word(self, word: str) -> Shown:
        """A whole word through encoder and decoder, which then are in their first states again."""
        return self._shown((*self.encoder.feed(word.encode("utf-8")), *self.encoder.finish()), self.decoder)

    def _shown(self, ids: tuple[int, ...], decoder: StreamDecoder) -> Shown:
        decoder.first = True
        return len(ids), " ".join(map(str, ids)).encode(), array("i", ids).tobytes(), decoder.names(ids).encode(), decoder.text(ids).encode()

    def _singly(self, ids: Iterable[int], decoder: StreamDecoder) -> Iterator[list[Shown]]:
        """Ids of a word longer than the window, one by one as they come."""
        each = ((i,) for i in ids)
        while some := [self._shown(i, decoder) for i in islice(each, 4096)]:
            yield some

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case letter by letter (no final-sigma rule); white space only separates."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def blocks(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text in blocks of about ``BLOCK`` characters, cut at white space if they hold any; true: the cut is within a word."""
        i, n = 0, len(text)
        while n - i > BLOCK:
            cut = max(text.rfind(" ", i, i + BLOCK), text.rfind("\n", i, i + BLOCK))
            inside = cut <= i
            if inside:
                cut = seam(text, i + BLOCK)
            yield text[i:cut], inside
            i = cut
        if i < n:
            yield text[i:], False

    def shown(self, text: str) -> Iterator[list[Shown]]:
        """What leaves encoder and decoder: together for a word that fits the window, of a longer one id by id."""
        stream, decoder = StreamEncoder(self.table, self.lookahead), StreamDecoder(self.table)
        for special, part in self.table.segments(text):
            if special:
                yield [self._shown((self.table.special[part],), decoder)]
                continue
            run = None  # what goes on the pre-token that is open in the encoder
            for block, inside in self.blocks(part):
                block, at = self.normalise(block), 0
                if run:
                    more = run.match(block)
                    at = more.end() if more else 0
                    yield from self._singly(stream.feed(block[:at].encode("utf-8")), decoder)
                    if at == len(block) and inside:
                        continue
                    yield from self._singly(stream.finish(), decoder)
                    run = None
                words = self.find.findall(block, at)
                tail = words[-1] if words and inside and block.endswith(words[-1]) else ""
                for kind in (self.letters, self.signs):
                    run = kind if tail and kind.fullmatch(tail) else run
                if run:
                    words.pop()
                if not words or 4 * len(max(words, key=len)) <= self.window:
                    yield list(map(self.words.__getitem__, words))
                else:
                    for word in words:
                        if 4 * len(word) <= self.window:
                            yield [self.words[word]]
                        else:
                            yield from self._singly(stream.feed(word.encode("utf-8")), decoder)
                            yield from self._singly(stream.finish(), decoder)
                if run:
                    yield from self._singly(stream.feed(tail.encode("utf-8")), decoder)
            if run:
                yield from self._singly(stream.finish(), decoder)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(s[2] for some in self.shown(text) for s in some), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The running text of ids."""
        stream = StreamDecoder(self.table)
        return stream.text(ids) + stream.finish()

    def names(self, ids: Iterable[int]) -> str:
        """What the library's ``decode`` gives for a vocabulary file without a decoder."""
        return StreamDecoder(self.table).names(ids)

    def transcoded(self, text: str, columns: tuple[int, ...]) -> Iterator[tuple[int, list[bytes]]]:
        """What leaves encoder and decoder for the text, in stretches to be put one behind the other: the number of ids, and
        these columns of ``Shown``."""
        glue = b""
        for some in self.shown(text):
            if some:
                yield sum(map(itemgetter(0), some)), [glue + b" ".join(map(itemgetter(c), some)) if c in (1, 3) else b"".join(map(itemgetter(c), some)) for c in columns]
                glue = b" "


def seam(text: str, at: int) -> int:
    """The first place from ``at`` on where a text can be cut within a word: nothing composes across it, and no
    contraction's apostrophe is next before it."""
    while at < len(text):
        c = text[at]
        if (c < "\u0300" or unicodedata.category(c)[0] != "M" and not "\u1160" <= c <= "\u11ff") and ("'" not in text[at - 2 : at] or text[at - 4 : at] == "'" * 4):
            break
        at += 1
    return at


def transcoder(vocab: bytes, lookahead: int) -> Transcoder:
    def make() -> Transcoder:
        table = MergeTable(vocab)
        sufficient_lookahead(table)  # also sets the widest token
        return Transcoder(table, lookahead)

    return resident(("transcoder", hash(vocab)), make)


def transcode(docs: DataFrame, vocab: bytes, digest: bool = False, running: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for each row; ``decoded`` as the library decodes, or
    with ``running`` the running text.  With ``digest`` SHA-256 of the ids and of both
    decoded forms (``ids_sha256, decoded_sha256, running_sha256``), taken as they leave encoder and decoder."""
    lookahead = sufficient_lookahead(MergeTable(vocab))
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary: of fixed size

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transcoder(shipped.value, lookahead)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                n, ids, decoded = [], [], []
                for value in part.column(1):
                    stretches = list(coder.transcoded(value.as_py(), (2, 4 if running else 3)))
                    n.append(sum(s[0] for s in stretches))
                    ids.append(b"".join(s[1][0] for s in stretches))
                    decoded.append(b"".join(s[1][1] for s in stretches))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), lists, pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transcoder(shipped.value, lookahead)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, hashes = 0, [hashlib.sha256() for _ in range(3)]
                for own, columns in coder.transcoded(value.as_py(), (1, 3, 4)):
                    n += own
                    for h, x in zip(hashes, columns, strict=True):
                        h.update(x)
                rows.append((n, *(h.hexdigest() for h in hashes)))
            n, *sums = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "running_sha256"])

    source = clean(docs, text=text, key=key)
    if digest:
        return source.mapInArrow(trimmed(digests, keeps=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, running_sha256 string")
    return source.mapInArrow(trimmed(full, keeps=True), "doc_id long, n_tokens long, ids array<int>, decoded string")
