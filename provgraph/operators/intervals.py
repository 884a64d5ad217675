"""As-of, containment and overlap joins of spans.

Spans of one document are joined on the document and, where both sides may be
long, on buckets of ``width`` positions, so that a long document is spread over
tasks and a pair is only compared where it can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: int) -> Column:
    """All buckets that a half-open span touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b`` of the same key."""
    left = a.withColumn("__row", F.struct(*a.columns)).select(key, "start", "end", "__row", buckets(F.col("start"), F.col("end"), width).alias("__b"))
    right = b.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"), buckets(F.col("start"), F.col("end"), width).alias("__b2"))
    met = left.join(right, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_semi")
    return met.select("__row").distinct().select("__row.*")


def not_overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Rows of ``a`` that overlap no row of ``b`` of the same key."""
    met = overlapping(a, b, key, width)
    return a.join(met, [a[c].eqNullSafe(met[c]) for c in a.columns], "left_anti")


def smallest_container(inner: DataFrame, outer: DataFrame, key: str, inner_id: str, outer_id: str, width: int = 4096) -> DataFrame:
    """For each inner span the smallest outer span that holds it (then the least id)."""
    o = outer.select(F.col(key).alias("__k"), F.col(outer_id), F.col("start").alias("__s"), F.col("end").alias("__e"), buckets(F.col("start"), F.col("end"), width).alias("__b"))
    i = inner.select(key, inner_id, "start", "end", F.floor(F.col("start") / width).alias("__b2"))
    met = i.join(o, (F.col(key) == F.col("__k")) & (F.col("__b2") == F.col("__b")) & (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e")))
    return met.groupBy(key, inner_id).agg(F.min_by(outer_id, F.struct(F.col("__e") - F.col("__s"), F.col(outer_id))).alias(outer_id))


def _carried(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str, back: bool) -> DataFrame:
    """Points and marks in one sorted line, cut into ranges of (key, place), so that a hot key is many ranges: within a
    range the nearest mark's value is found by a window, and a range without one yet takes that of the ranges before it
    (after it, with ``back``).  Only one row a range and key is carried over."""
    from .analytics import cut

    m = marks.select(F.col(key), F.col(mark_at).alias("__at"), F.lit(int(back)).alias("__kind"), F.col(value).alias("__v"))
    p = points.select(F.col(key), F.col(at).alias("__at"), F.lit(int(not back)).alias("__kind"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"), F.struct(*points.columns).alias("__row"))
    both = m.withColumn("__row", F.lit(None).cast(p.schema["__row"].dataType)).unionByName(p).withColumn("__tie", F.xxhash64("__row", "__v"))
    ranges = max(1, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = cut(both.repartitionByRange(ranges, key, "__at", "__kind", "__tie").withColumn("__part", F.spark_partition_id()))
    order = [F.col(c).desc() if back else F.col(c).asc() for c in ("__at", "__kind", "__tie")]
    parts = F.col("__part").desc() if back else F.col("__part").asc()
    nearest = F.min_by if back else F.max_by
    ends = line.groupBy(key, "__part").agg(nearest(F.col("__v"), F.when(F.col("__v").isNotNull(), F.struct("__at", "__tie"))).alias("__end"))
    before = W.partitionBy(key).orderBy(parts).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("__ck"), F.col("__part").alias("__cp"), F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    within = F.last("__v", ignorenulls=True).over(W.partitionBy(key, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    own = line.withColumn("__near", within).filter(F.col("__kind") != int(back))
    own = own.join(carry, (F.col("__part") == F.col("__cp")) & F.col(key).eqNullSafe(F.col("__ck")), "left")
    return own.select("__row.*", F.coalesce("__near", "__carry").alias(value))


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """Each point with the value of the last mark at or before it (as-of join)."""
    return _carried(points, marks, key, at, mark_at, value, back=False)


def first_after(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """Each point with the value of the first mark at or after it."""
    return _carried(points, marks, key, at, mark_at, value, back=True)
