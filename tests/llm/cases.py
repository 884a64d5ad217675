"""Hostile small tables and brute-force answers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, label string, row long"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def texts(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, odd white space, other scripts, empties and nulls."""
    r = random.Random(seed)
    pool = ["ring", "Table", "das", "élan", "中文", "a", "the", "of", "x&&&", "STONE!!", "river", "moon", "tea", "7", "ß", "und", "<|endoftext|>", "don't", "été"]
    passage = " ".join(r.choice(pool) for _ in range(70))
    base = [r.choice(pool) + str(r.randint(0, 40)) for _ in range(60)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one two"), (4, "ONE  two "), (5, "one two"), (6, "a b c d e"), (7, "A B\tC D E"), (8, "x" * 3000), (9, "")]
    for i in range(10, n):
        own = [r.choice(pool) + str(r.randint(0, 99)) for _ in range(r.randint(1, 50))]
        kind = i % 6
        if kind == 0:
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "edit" + str(r.randint(0, 9))
        elif kind == 1:
            own += passage.split() + own[:3]
        elif kind == 2 and i > 20:
            own = words(out[-6][1])
        out.append((i, r.choice([" ", "\n", "  "]).join(own)))
    return out


def frame(spark, rows):
    """With every column of ``documents``, and extra ones whose names clash with what operators use."""
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "src0", None if t is None else len(t), "w", None, k) for k, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_groups(rows, percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and label[a] > label[b] and 100 * len(x & y) >= percent * len(x | y):
                    label[a], changed = label[b], True
    return label


def cut_words(rows, window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def late_word(spark, where: str) -> None:
    """Tables of 13,000 labelled rows and two more, -1 and -2: of the toxic rows the first 4,100 by the hash of
    their ids (over 3,000 of them not held out) have one bad word, the others another, which row -1 has too."""
    from pyspark.sql import functions as F

    order = [r.id for r in spark.range(13_000).orderBy(F.xxhash64("id"), "id").collect()]
    r, rows, toxic = random.Random(3), [], 0
    for k, i in enumerate(order):
        bad = k % 3 == 0
        own = [f"word{r.randrange(400)}" for _ in range(r.randrange(4, 9))]
        if bad:
            own[r.randrange(len(own))] = "blargh" if toxic < 4_100 else "zorblax"
            toxic += 1
        rows.append((i, " ".join(own), ("en", "de")[i % 2], int(bad)))
    rows += [(-1, "word1 word2 zorblax word3", "en", None), (-2, "word1 word2 word4 word3", "en", None)]
    both = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    both.selectExpr("doc_id", "text", "lang", "'s' source", "cast(length(text) as int) n_chars").write.parquet(f"{where}/documents.parquet")
    both.filter("toxic is not null").selectExpr("doc_id", "1 quality", "toxic").write.parquet(f"{where}/labels.parquet")
