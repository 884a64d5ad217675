"""N-gram Jaccard join as a blocked sparse matrix product.

The documents-by-n-grams incidence matrix ``A`` is never multiplied in full:

1. *Rows.*  Each text becomes its set of distinct n-gram hashes.  Texts with the
   same set (equal size and 128-bit signature) are one row from here on.
2. *Column blocks.*  The entries are dealt by n-gram range into column blocks
   that fit a task; a block counts its columns and drops those with one entry,
   which add nothing to any product.
3. *Row bounds.*  With ``s`` the similarity, a row of ``n`` n-grams has a partner only
   if ``m >= s * n`` of them are shared with anyone; others leave.  Of the rest,
   ordered by rising column count, only the first ``m - ceil(s * n) + 1`` shared
   columns (the row's prefix) can be where a linked pair first meets.
4. *Product.*  Pairs that meet in a prefix column and can pass the size bound
   ``overlap >= s / (1 + s) * (n1 + n2)`` have their overlap accumulated over all
   columns, and are links if it reaches the bound.  Where a pair meets first, the
   overlap is at most the columns that either row still has from there on.

   A group of near copies meets in every column, so pairs are taken in rounds:
   first every row with one leader of its columns (the row with the fewest rare n-grams), then,
   while that still finds links, other leaders among rows not yet connected,
   and at last *all* pairs in a column whose rows lie in different components.
   Pairs inside a component need no test, so no link is lost and groups are not squared.
   Columns that are in the prefix of the same rows (those of a shared passage) stand for one another: only the first of them is kept.
   Rows of the last step carry the parities of their columns' hashes to ``BITS`` bins; where two rows' parities differ,
   a column is in one of them only, so the pair is dropped, before it is shuffled, if too many do.
   Texts made of the same passages that never link are still compared where they meet, pair by pair, but only such pairs as
   the parities can't tell apart leave the column.

The hash of an n-gram within a pair's union is 40 bits plus the block's, so a wrong
overlap needs a collision between two n-grams of two texts that are compared.

Cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer than ``k`` words
are one n-gram; null, empty or blank texts have none and link with nothing (their own
component); texts of any length are read whole.  Links are between rows: where ids repeat or are null, rows are numbered, each text
links for itself, and a component is named by the least id in it (null if it has none).  Equal sets (ties) are one
component.  Further columns are ignored, ``drop_near_copies`` keeps them; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SCHEMA, Router, block_of, by_block, clean, column, deal, keys, plan_blocks, trimmed
from .components import components
from .kernel import Words, distinct_per_row, mix, shingles, string_buffers, words_of
from .shared import stored

LOW = np.uint64((1 << 40) - 1)
ROUNDS = 4
BITS = 512


def row_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, row, _ = shingles(words, k, True)
    return distinct_per_row(h, row)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, s1, s2``: size and two order-free sums over the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in words_of(batch.column(1), True):
                h, row = row_sets(words, k)
                n = np.bincount(row, minlength=j - i).astype(np.int64)
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (np.uint64(0x51ED270B), np.uint64(0xA3C59AC3)):
                        total = np.r_[np.uint64(0), np.cumsum(mix(h ^ salt * _ODD), dtype=np.uint64)]
                        cut = np.r_[0, np.cumsum(n)]
                        sums.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n), *map(pa.array, sums)], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, s1 long, s2 long")


_ODD = np.uint64(0x9E3779B97F4A7C15)


def doc_block(doc: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return block_of(mix(doc.astype(np.int64).view(np.uint64)), blocks)


def column_blocks(docs: DataFrame, k: int, blocks: int) -> DataFrame:
    """Entries dealt by n-gram: per block, document runs and the hashes' low 40 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(0, ["u4", "u1"])
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            valid = np.asarray(batch.column(0).is_valid())
            for i, _, words in words_of(batch.column(1), True):
                h, row = row_sets(words, k)
                keep = valid[i + row]
                h, row = h[keep], row[keep]
                low = h & LOW
                yield from router.add(block_of(h, blocks), ids[i + row], low & np.uint64(0xFFFFFFFF), low >> np.uint64(32))
        yield from router.flush()

    return docs.mapInArrow(trimmed(run), SCHEMA)


def shared_entries(dealt: DataFrame, doc_blocks: int) -> DataFrame:
    """Per column block: entries of columns with two rows at least, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(1, ["u8", "u1"], sort=True)
        for block, rows in by_block(batches):
            doc = keys(rows, 0)
            low = column(rows, 0, 2, "u4").astype(np.uint64) | column(rows, 0, 3, "u1").astype(np.uint64) << np.uint64(32)
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            new = np.ones(len(low), dtype=bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])  # repeated rows count once
            low, doc = low[new], doc[new]
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(low)])
            weight = np.minimum(255, 8 * np.log2(np.maximum(count, 1))).astype(np.uint8)
            keep = np.repeat(count > 1, count)
            yield from router.add(doc_block(doc[keep], doc_blocks), doc[keep], low[keep] | np.uint64(block << 40), np.repeat(weight, count)[keep])
        yield from router.flush()

    return dealt.mapInArrow(trimmed(run), SCHEMA)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with anything: ceil(s * n)."""
    return -(-n * percent // 100)


def candidate_rows(dealt: DataFrame, percent: int) -> DataFrame:
    """Rows that pass the row bound: ``vid, n, m, prefix, cols`` (columns by rising count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_block(batches):
            ids, sizes = keys(rows, 0), column(rows, 0, 2, "i8")
            order = np.argsort(ids)
            ids, sizes = ids[order], sizes[order]
            doc, col, weight = keys(rows, 1), column(rows, 1, 2, "u8"), column(rows, 1, 3, "u1")
            order = np.lexsort((col, weight, doc))
            doc, col = doc[order], col[order]
            a, b = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            m = b - a
            ok = np.flatnonzero((m > 0) & (m >= need(sizes, percent)))
            for s in range(0, len(ok), 256):
                part = ok[s : s + 256]
                yield pa.record_batch(
                    [pa.array(ids[part]), pa.array(sizes[part]), pa.array(m[part].astype(np.int64)), pa.array((m[part] - need(sizes[part], percent) + 1).astype(np.int64)), pa.array([col[a[x] : b[x]].tobytes() for x in part], pa.binary())],
                    names=["vid", "n", "m", "prefix", "cols"],
                )

    return dealt.mapInArrow(trimmed(run), "vid long, n long, m long, prefix long, cols binary")


def prefix_entries(rows: DataFrame) -> DataFrame:
    """``col, vid, n, m, rank, rest``; rank: per mille of the row that is rarer; rest: shared
    columns of the row from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                vid, n, m, prefix = (np.asarray(part.column(i)) for i in range(4))
                cols = [np.frombuffer(c.as_py(), np.int64)[:p] for c, p in zip(part.column(4), prefix, strict=True)]
                at = np.concatenate([np.arange(p) for p in prefix]) if len(prefix) else np.zeros(0, np.int64)
                v, nn, mm = (np.repeat(x, prefix) for x in (vid, n, m))
                yield pa.record_batch([pa.array(np.concatenate(cols)), pa.array(v), pa.array(nn), pa.array(mm), pa.array(((nn - mm + at) * 1000 // nn).astype(np.int32)), pa.array(mm - at)], names=["col", "vid", "n", "m", "rank", "rest"])

    return rows.select("vid", "n", "m", "prefix", "cols").mapInArrow(trimmed(run), "col long, vid long, n long, m long, rank int, rest long")


def may_link(n1: Column, m1: Column, n2: Column, m2: Column, percent: int) -> Column:
    """The size bound, where the overlap is at most ``m1`` and ``m2``."""
    return F.least(m1, m2) * (100 + percent) >= (n1 + n2) * percent


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit numbers packed in a binary column, and where each row's begin and end."""
    data, offsets = string_buffers(column)
    return data.view(np.int64), offsets // 8


def accumulate(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among ``pairs``: overlaps accumulated over all columns, for all partners of a ``b`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n1, n2 = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            (x, x_at), (y, y_at) = numbers(batch.column(4)), numbers(batch.column(5))
            overlap = np.zeros(len(b), np.int64)
            cut = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)] if len(b) else np.zeros(1, np.int64)
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                own, other = x[x_at[i] : x_at[j]], np.sort(y[y_at[i] : y_at[i + 1]])
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                overlap[i:j] = np.add.reduceat((other[at] == own).astype(np.int64), x_at[i:j] - x_at[i])
            keep = pa.array(overlap * (100 + percent) >= (n1 + n2) * percent)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = rows.select(F.col("vid").alias("a"), F.col("n").alias("n1"), F.col("cols").alias("x"))
    right = rows.select(F.col("vid").alias("b"), F.col("n").alias("n2"), F.col("cols").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def parities(rows: DataFrame) -> DataFrame:
    """``vid, p0, p1, ...``: of each row, whether an odd number of its columns falls into each of ``BITS`` bins."""
    words = BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, at = numbers(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            bin_ = (mix(cols.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
            odd = (np.bincount(row * BITS + bin_, minlength=batch.num_rows * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
            packed = np.packbits(odd, axis=1).view(np.int64).reshape(-1, words)
            yield pa.record_batch([batch.column(0), *(pa.array(packed[:, i]) for i in range(words))], names=["vid", *(f"p{i}" for i in range(words))])

    return rows.select("vid", "cols").mapInArrow(trimmed(run), "vid long, " + ", ".join(f"p{i} long" for i in range(words)))


def leader_pairs(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each row with one leader of its columns, of another component."""
    order = F.col("rank") if turn == 0 else F.xxhash64("vid", F.lit(turn))
    leaders = entries.groupBy("col").agg(F.min(F.struct(order.alias("o"), F.col("vid").alias("lead"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("label").alias("l2"))).alias("x"), F.count(F.lit(1)).alias("c"))
    leaders = stored(leaders.filter("c > 1").select("col", "x.*"), "leaders")  # a plain scan: the join can be split
    met = entries.join(leaders, "col").filter((F.col("label") != F.col("l2")) & may_link(F.col("n"), F.col("m"), F.col("n2"), F.col("m2"), percent))
    best = met.groupBy("vid", "lead").agg(F.sum("weight").alias("c")).groupBy("vid").agg(F.max(F.struct("c", "lead")).alias("x"))
    return best.select(F.col("vid").alias("a"), F.col("x.lead").alias("b"))


def remaining_pairs(entries: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """All pairs that meet in a column, lie in different components and pass the size and parity bounds."""
    names = [f"p{i}" for i in range(BITS // 64)]
    live = stored(entries.select("vid").distinct(), "live")
    own = stored(entries.join(parities(rows.join(live, "vid", "left_semi")), "vid"), "last")  # plain scans: the join can be split
    other = own.select("col", *(F.col(c).alias(f"{c}_b") for c in ("vid", "n", "m", "rest", "label", *names)))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
    bound = may_link(F.col("n"), F.col("rest"), F.col("n_b"), F.col("rest_b"), percent)
    near = (F.col("m") + F.col("m_b") - differ) * (100 + percent) >= (F.col("n") + F.col("n_b")) * (2 * percent)
    apart = (F.col("vid") < F.col("vid_b")) & (F.col("label") != F.col("label_b"))
    return own.join(other, (own.col == other.col) & apart & bound & near).select(F.col("vid").alias("a"), F.col("vid_b").alias("b")).distinct()


def first_columns(entries: DataFrame) -> DataFrame:
    """Of columns with the same rows the first, with their number as ``weight``.  A pair that meets in one of them meets in all, and
    first in the first, where the bounds on what follows hold."""
    columns = entries.groupBy("col").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("vid").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("vid", F.lit(7)).cast("decimal(38,0)")).alias("s2"), F.sum("rest").alias("r")
    )
    first = columns.filter("c > 1").groupBy("c", "s1", "s2").agg(F.max(F.struct("r", "col")).alias("x"), F.count(F.lit(1)).alias("weight"))
    return entries.join(stored(first.select(F.col("x.col").alias("col"), "weight"), "columns"), "col")


def open_columns(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """Prefix entries with their component, of the columns where components meet."""
    if links is None:
        labelled = entries.withColumn("label", F.col("vid"))
    else:
        labels = components(links)
        labelled = entries.join(labels, "vid", "left").withColumn("label", F.coalesce("label", "vid"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("col").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("col")
    return labelled.join(stored(mixed, "mixed"), "col")


def links_between(rows: DataFrame, percent: int) -> DataFrame | None:
    """Links that connect what the full product connects; None for no rows."""
    entries = stored(first_columns(stored(prefix_entries(rows), "prefix")), "entries")
    links: DataFrame | None = None
    for turn in range(ROUNDS):
        live = stored(open_columns(entries, links).select("col", "vid", "n", "m", "rank", "rest", "label", "weight"), "open")
        sizes = live.groupBy("col").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()
        if not sizes[0]:
            return links
        if turn == ROUNDS - 1 or (turn and sizes[1] <= 2 * sizes[0]):
            break
        found = stored(accumulate(leader_pairs(live, percent, turn), rows, percent), "found")
        fresh = found.count()
        links = found if links is None else links.unionByName(found)
        if turn and not fresh:
            break
    final = stored(accumulate(remaining_pairs(live, rows, percent), rows, percent), "found")
    return final if links is None else links.unionByName(final)


def near_rows(source: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for rows ``doc_id, text`` of different ids, none null, whose stored ``signatures`` are ``sets``."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    blocks = plan_blocks(int(total))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(0, ["i8"])
        for batch in batches:
            rep = np.asarray(batch.column(0), np.int64)
            yield from router.add(doc_block(rep, blocks), rep, np.asarray(batch.column(1), np.int64))
        yield from router.flush()

    shared = shared_entries(deal(column_blocks(source, k, blocks), blocks), blocks)
    reps = classes.select("rep", "n").mapInArrow(trimmed(sizes), SCHEMA)
    rows = stored(candidate_rows(deal(reps.unionByName(shared), blocks), percent), "rows")
    links = links_between(rows, percent)
    labelled = classes if links is None else classes.join(components(links), classes.rep == F.col("vid"), "left").drop("vid")
    label = F.col("rep") if links is None else F.coalesce("label", "rep")
    named = stored(labelled.select("n", "s1", "s2", label.alias("component_id")), "classes")  # a plain scan: the join can be split
    return sets.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_components(docs: DataFrame, percent: int = 80, k: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    source = clean(docs, text=text, key=key)
    sets = stored(signatures(source, k), "sets")
    total, ids = sets.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if total == ids:
        return near_rows(source, sets, percent, k)
    numbered = stored(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    source = numbered.select(F.col("row").alias("doc_id"), "text")
    found = near_rows(source, stored(signatures(source, k), "sets"), percent, k).withColumnRenamed("doc_id", "row")
    found = stored(found.join(numbered.select("row", "doc_id"), "row"), "found-rows")
    least = stored(found.groupBy("component_id").agg(F.min("doc_id").alias("least")), "least-ids")
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 80, k: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, all columns, with one row of each component: the one of least id, nulls last."""
    numbered = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    source = clean(numbered.select("row", F.col(f"doc.{text}").alias("text")), key="row")
    found = near_rows(source, stored(signatures(source, k), "sets"), percent, k)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    grouped = stored(found.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", F.col(f"doc.{key}").cast("long").alias("doc_id")), "row"), "found-rows")
    first = stored(grouped.groupBy("component_id").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("component_id", F.col("x.row").alias("first")), "firsts")
    dropped = grouped.join(first, "component_id").filter("row <> first").select("row")
    return numbered.join(dropped, "row", "left_anti").select("doc.*")
