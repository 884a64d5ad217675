"""Byte-pair merging by rank, shared by token counting and encoding.

The vocabulary file is an argument everywhere: the driver reads it and sends
its bytes with the tasks (a vocabulary is of fixed size).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import regex

SHORT = 48
SYMBOL, NONE = (1 << 20) - 1, 1 << 62


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


PLAIN, FINAL, SPECIAL = range(3)


class Parsed(dict):
    """Of each token asked for: its bytes, and whether it ends a word or is special."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, token: int) -> tuple[bytes, int]:
        name, mark = self.table.names[token], self.table.suffix
        if token in self.table.marks:
            self[token] = name.encode(), SPECIAL
        else:
            ends = bool(mark) and name.endswith(mark)
            self[token] = bytes(map(self.table.byte_of.__getitem__, name.removesuffix(mark) if ends else name)), FINAL if ends else PLAIN
        return self[token]


class MergeTable:
    """A BPE model read from a ``tokenizers`` JSON file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = frozenset(self.special.values())
        self.names: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.char = byte_chars()
        self.parsed = Parsed(self)
        self.byte_of = {c: b for b, c in enumerate(self.char)}
        self.single = [self.vocab[c] for c in self.char]
        self.final = [self.vocab[c + self.suffix] for c in self.char]
        #: pair key -> rank << 20 | id of the merged symbol; parts: (left, right) by rank
        self.pairs: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.pairs.setdefault(a << 20 | b, rank << 20 | c)
            self.parts.append((a, b, c))
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_pattern = regex.compile(marks) if marks else None

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """``(is special, string)`` pieces, special strings matched as the library does."""
        at = 0
        if self.special_pattern and any(s in text for s in self.special):
            for found in self.special_pattern.finditer(text):
                if found.start() > at:
                    yield False, text[at : found.start()]
                yield True, found.group()
                at = found.end()
        if at < len(text):
            yield False, text[at:] if at else text

    def symbols(self, data: bytes, ends: bool = True) -> list[int]:
        """First symbols of a word's bytes; with ``ends`` the last carries the end mark."""
        out = [self.single[b] for b in data]
        if ends and out:
            out[-1] = self.final[data[-1]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Applies merges by rank, leftmost first, until none applies."""
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        open_ = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while open_:
            best = min(open_)
            if best == NONE:
                break
            i = open_.index(best)
            ids[i : i + 2] = [best & SYMBOL]
            del open_[i]
            if i:
                open_[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(open_):
                open_[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        following, previous, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int, j: int) -> None:
            found = pairs.get(ids[i] << 20 | ids[j])
            if found is not None:
                entry = found >> 20, i, ids[i], ids[j], found & SYMBOL
                heapq.heappush(heap, entry) if heap_ready else heap.append(entry)

        heap_ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        heap_ready = True
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j] = new, False
            following[i] = after = following[j]
            if after < n:
                previous[after] = i
                offer(i, after)
            if previous[i] >= 0:
                offer(previous[i], i)
        return [ids[i] for i in range(n) if live[i]]


class Bounded(dict):
    """A table of fixed entries and a bounded number of computed ones: the ``limit`` / 2 latest, and of as many
    before them those that were asked for again."""

    def __init__(self, fixed: dict, compute, limit: int = 200_000):
        super().__init__(fixed)
        self.fixed, self.compute, self.limit, self.older = fixed, compute, limit // 2 + len(fixed), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value
