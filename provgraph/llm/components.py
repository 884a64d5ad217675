"""Connected components of a table of links, by alternating large and small stars.

Every round is two shuffles with map-side combining and cuts lineage with
tables in the shared folder; nothing is gathered in a task or the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each vertex's greater (large) or smaller (small) neighbours on its least one."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:  # the centre of a star is hot: the join of plain scans can be split
        least = stored(least, "least")
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``vid, label`` (the least vertex of the component) for every vertex of ``links(a, b)``."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    spokes = edges.select(F.col("a").alias("vid"), F.col("b").alias("label"))
    return spokes.union(edges.select(F.col("b").alias("vid"), F.col("b").alias("label")).distinct())
