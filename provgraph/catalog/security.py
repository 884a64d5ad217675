"""Relations, attributes and masked graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_tools, security
from ..operators.lift import read
from .common import Catalog

_c = Catalog()
TUPLES = [
    ("src1", "owner", "user:ann"), ("src2", "viewer", "group:eng#member"), ("group:eng", "member", "group:leads#member"), ("group:leads", "member", "user:ann"), ("src3", "parent", "src1"),
    ("src4", "viewer", "user:bo"), ("src5", "viewer", "group:loop#member"), ("group:loop", "member", "group:loop#member"), ("src6", "parent", "src3"),
]
T = "t(object, relation, subject) AS (VALUES " + ", ".join(map(str, TUPLES)) + ")"
HELD = f"""{T}, rules AS (SELECT subject AS a, object, relation FROM t UNION ALL SELECT object || '#owner', object, 'viewer' FROM t WHERE relation = 'owner'
        UNION ALL SELECT subject || '#viewer', object, 'viewer' FROM t WHERE relation = 'parent' UNION ALL SELECT subject || '#owner', object, 'viewer' FROM t WHERE relation = 'parent'),
    held(object, relation) AS (SELECT object, relation FROM t WHERE subject = 'user:ann' UNION SELECT r.object, r.relation FROM held h JOIN rules r ON r.a = h.object || '#' || h.relation)"""
POLICY = security.Policy(min_clearance={"en": 1, "fr": 3}, ip_allowlist=("10.",), not_before="2026-01-01", not_after="2026-12-31")
ANN = security.Context("user:ann", (), 2, "10.1.2.3", "2026-06-01")


def _tuples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TUPLES, "object string, relation string, subject string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("label"), F.col("doc_id").alias("row_id"))


@_c.add("rebac_check", f"WITH RECURSIVE {HELD} SELECT DISTINCT object, relation FROM held")
def rebac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.granted(_tuples(spark), ["user:ann"])


@_c.add("abac_filter", "SELECT doc_id AS row_id, lang = 'en' AS allowed FROM documents")
def abac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("row_id", security.attributes_allow(POLICY, ANN).alias("allowed"))


OK = f"{HELD}, ok AS (SELECT doc_id AS row_id, source FROM documents WHERE lang = 'en' AND 'src' || substr(source, 4) IN (SELECT object FROM held WHERE relation = 'viewer'))"


@_c.add("authorized_docs", f"WITH RECURSIVE {OK} SELECT row_id, source AS doc_id FROM ok")
def authorized_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.authorized_docs(_docs(spark, sf_dir), _tuples(spark), POLICY, ANN).select("row_id", "doc_id")


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents")
    nodes = d.select(F.col("doc_id").cast("string").alias("node_id"), F.array(F.lit("Row")).alias("labels"), F.col("lang").alias("name"))
    edges = d.select(F.concat(F.lit("edge:"), F.col("doc_id").cast("string")).alias("edge_id"), F.col("doc_id").cast("string").alias("subject"), F.lit("NEXT").alias("predicate"), (F.col("doc_id") + 20).cast("string").alias("object"), F.lit(1.0).alias("confidence"), F.col("source").alias("doc_id"))
    edges = edges.join(nodes.select(F.col("node_id").alias("object")), "object", "left_semi")
    docs = _docs(spark, sf_dir).select("doc_id").distinct().withColumn("label", F.lit(""))
    allowed = security.authorized_docs(docs, _tuples(spark), POLICY, ANN)
    return security.visible_graph(nodes, edges, d.select(F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("doc_id")), allowed)


SEEN = f"""{HELD}, v AS (SELECT doc_id, lang FROM documents WHERE source IN (SELECT object FROM held WHERE relation = 'viewer')),
    e AS (SELECT d.doc_id AS a, d.doc_id + 20 AS b FROM documents d WHERE d.source IN (SELECT object FROM held WHERE relation = 'viewer') AND d.doc_id IN (SELECT doc_id FROM v) AND d.doc_id + 20 IN (SELECT doc_id FROM v))"""


@_c.add("secured_neighbors", f"WITH RECURSIVE {SEEN}, s AS (SELECT min(a) AS a FROM e) SELECT CAST(b AS VARCHAR) AS there, 'out' AS direction FROM e WHERE a = (SELECT a FROM s) UNION ALL SELECT CAST(a AS VARCHAR), 'in' FROM e WHERE b = (SELECT a FROM s)")
def secured_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _masked(spark, sf_dir)
    first = edges.agg(F.min(F.col("subject").cast("long"))).first()[0]
    return graph_tools.neighbors(nodes, edges, str(first)).select("there", "direction")


@_c.add("secured_stats", f"WITH RECURSIVE {SEEN} SELECT 'nodes' AS kind, '' AS name, count(*) AS n FROM v UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'label', 'Row', count(*) FROM v UNION ALL SELECT 'predicate', 'NEXT', count(*) FROM e")
def secured_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tools.graph_stats(*_masked(spark, sf_dir))


QUERIES, SQL = _c.queries, _c.sql
