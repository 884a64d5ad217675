"""One-hop tools, statistics and views over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: predicates that wire claims and aliases and are no relations of their own.
PLUMBING = ("MENTIONS", "SAME_AS", "SUBJECT_OF", "HAS_OBJECT")


def merge_layers(layers: list[DataFrame], key: str, first_wins: bool = False) -> DataFrame:
    """Union by key; the last layer that has a key wins (or the first)."""
    out = None
    for rank, layer in enumerate(layers):
        own = layer.select(key, F.lit(-rank if first_wins else rank).alias("rank"), F.struct(*layer.columns).alias("row"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.max_by("row", "rank").alias("row")).select("row.*")


def both_ways(edges: DataFrame) -> DataFrame:
    """``here, there, direction`` for each end of each edge."""
    rest = [c for c in edges.columns if c not in ("subject", "object")]
    out = edges.select(F.col("subject").alias("here"), F.col("object").alias("there"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("object").alias("here"), F.col("subject").alias("there"), F.lit("in").alias("direction"), *rest))


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, k: int = 20) -> DataFrame:
    """The ``k`` surest neighbours of a node, both directions, without plumbing."""
    near = both_ways(edges.filter(~F.col("predicate").isin(*PLUMBING))).filter(F.col("here") == node_id)
    named = near.join(nodes.select(F.col("node_id").alias("there"), "name"), "there")
    return named.select("there", "name", "predicate", "direction", "confidence", "edge_id").orderBy(F.desc("confidence"), "predicate", "there", "edge_id", "direction").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges per node; a self-loop counts twice."""
    return both_ways(edges.select("subject", "object")).groupBy(F.col("here").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    return nodes.select("node_id", "name").join(degrees(edges), "node_id").orderBy(F.desc("degree"), "node_id").limit(k)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "node_id", "left_anti")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "name", "n")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges, by label and by predicate: ``kind, name, n``."""
    whole = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), F.lit("").alias("name"), "n")
    whole = whole.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), F.lit("").alias("name"), "n"))
    predicates = edges.groupBy(F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("predicate").alias("kind"), "name", "n")
    return whole.unionByName(label_counts(nodes)).unionByName(predicates)


def tag_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def observed_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels and predicates that occur, with the labels at either end of each predicate."""
    labels = nodes.select("node_id", F.element_at("labels", -1).alias("label"))
    ends = edges.select("predicate", "subject", "object").join(labels.select(F.col("node_id").alias("subject"), F.col("label").alias("from_label")), "subject")
    ends = ends.join(labels.select(F.col("node_id").alias("object"), F.col("label").alias("to_label")), "object")
    return ends.groupBy("predicate").agg(F.array_sort(F.collect_set("from_label")).alias("from_labels"), F.array_sort(F.collect_set("to_label")).alias("to_labels"), F.count(F.lit(1)).alias("n"))


def graph_view(nodes: DataFrame, edges: DataFrame, score: DataFrame, k: int = 600) -> DataFrame:
    """Edges among the ``k`` nodes of greatest score."""
    top = nodes.select("node_id").join(score, "node_id").orderBy(F.desc("score"), "node_id").limit(k).select("node_id")
    inner = edges.join(top.withColumnRenamed("node_id", "subject"), "subject", "left_semi")
    return inner.join(top.withColumnRenamed("node_id", "object"), "object", "left_semi").select("edge_id", "subject", "predicate", "object", "confidence")


def resolve_name(nodes: DataFrame, score: DataFrame, text: str) -> DataFrame:
    """The node a text names: by id, else exact lower-case name, else most shared words, then
    score, then id; one row or none."""
    from ..functions.text import tokens

    asked = F.lit(text)
    own = nodes.join(score, "node_id", "left")
    shared = F.size(F.array_intersect(tokens(F.col("name")), tokens(asked)))
    tier = F.when(F.col("node_id") == asked, 0).when(F.lower("name") == F.lower(asked), 1).when(shared > 0, 2)
    ranked = own.withColumns({"tier": tier, "shared": shared}).filter("tier is not null")
    tie = F.when(F.col("tier") == 2, F.col("score")).otherwise(0.0)
    by_id = [F.when(F.col("tier") < 2, F.col("node_id")).asc_nulls_last(), F.when(F.col("tier") == 2, F.col("node_id")).desc_nulls_last()]
    return ranked.orderBy("tier", F.when(F.col("tier") == 2, -F.col("shared")).otherwise(0), F.desc_nulls_last(tie), *by_id).limit(1).select("node_id", "name", "tier")


def reply_threads(messages: DataFrame, thread: str, order: str, speaker: str) -> DataFrame:
    """Each message with the one before it in its thread."""
    w = W.partitionBy(thread).orderBy(order)
    return messages.select(thread, order, speaker, F.lag(order).over(w).alias("replies_to"), F.lag(speaker).over(w).alias("replies_to_speaker"))


def cache_misses(current: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't cached: what an incremental build works on."""
    return current.join(cached.select(key).distinct(), key, "left_anti")
