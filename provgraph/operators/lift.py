"""Relational tables in graph shape: nodes, edges, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ids import edge_id

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, parts, suppliers, nations and regions as nodes with a name and an amount."""

    def node(table: str, label: str, id_: str, name: Column, amount: Column) -> DataFrame:
        own = read(spark, sf_dir, table)
        return own.select(key(label.lower(), id_).alias("node_id"), F.array(F.lit("Entity"), F.lit(label)).alias("labels"), name.cast("string").alias("name"), amount.cast("double").alias("amount"))

    none = F.lit(None)
    parts = [
        node("customer", "Customer", "c_custkey", F.col("c_name"), F.col("c_acctbal")),
        node("orders", "Order", "o_orderkey", F.col("o_orderkey"), F.col("o_totalprice")),
        node("part", "Part", "p_partkey", F.col("p_name"), F.col("p_retailprice")),
        node("supplier", "Supplier", "s_suppkey", F.col("s_name"), F.col("s_acctbal")),
        node("nation", "Nation", "n_nationkey", F.col("n_name"), none),
        node("region", "Region", "r_regionkey", F.col("r_name"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED, CONTAINS, SUPPLIED_BY, IN_NATION, IN_REGION with confidence and evidence."""

    def edge(table: str, subject: tuple[str, str], predicate: str, obj: tuple[str, str], confidence: Column, evidence: Column) -> DataFrame:
        return read(spark, sf_dir, table).select(
            key(*subject).alias("subject"), F.lit(predicate).alias("predicate"), key(*obj).alias("object"), confidence.cast("double").alias("confidence"), evidence.cast("long").alias("evidence_count")
        )

    one = F.lit(1)
    parts = [
        edge("orders", ("customer", "o_custkey"), "PLACED", ("order", "o_orderkey"), one, one),
        edge("lineitem", ("order", "l_orderkey"), "CONTAINS", ("part", "l_partkey"), 1 - F.col("l_discount"), F.col("l_linenumber")),
        edge("lineitem", ("part", "l_partkey"), "SUPPLIED_BY", ("supplier", "l_suppkey"), 1 - F.col("l_tax"), F.col("l_linenumber")),
        edge("customer", ("customer", "c_custkey"), "IN_NATION", ("nation", "c_nationkey"), one, one),
        edge("supplier", ("supplier", "s_suppkey"), "IN_NATION", ("nation", "s_nationkey"), one, one),
        edge("nation", ("nation", "n_nationkey"), "IN_REGION", ("region", "n_regionkey"), one, one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_id", edge_id("subject", "predicate", "object", "evidence_count", "confidence"))


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The small graph of suppliers, nations and regions."""
    nodes = trade_nodes(spark, sf_dir).filter(F.col("labels")[1].isin("Supplier", "Nation", "Region"))
    edges = trade_edges(spark, sf_dir).filter(F.col("predicate").isin("IN_NATION", "IN_REGION") & ~F.col("subject").startswith("customer:"))
    return nodes, edges


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: user, event kind, a value band; errors deny, the rest affirm."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("error", "click"), "CONTROLS").otherwise("DIRECTOR_OF")
    return e.select(
        F.concat(F.lit("claim:"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("claim_id"),
        key("user", "user_id").alias("subject"),
        kind.alias("predicate"),
        F.concat(F.lit("band:"), F.pmod(F.col("event_id"), F.lit(7)).cast("string")).alias("object"),
        F.when(F.col("event_type") == "error", "neg").otherwise("pos").alias("polarity"),
        F.when(F.pmod(F.col("event_id"), F.lit(11)) != 0, F.date_format("ts", "yyyy-MM-dd")).alias("t_valid"),
        F.lit(None).cast("string").alias("t_invalid"),
        (F.round(F.pmod(F.col("event_id"), F.lit(100)) / 100, 2)).alias("confidence"),
        F.concat(F.lit("doc:"), F.pmod(F.col("event_id"), F.lit(13)).cast("string")).alias("doc_id"),
    )
