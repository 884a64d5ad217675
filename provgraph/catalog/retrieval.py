"""Ranking, fusion, budgets, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import retrieval as ops
from ..operators.lift import read
from .common import Catalog

_c = Catalog()

BM25 = """t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
    q(term, times) AS (VALUES ('the', 1), ('license', 2), ('software', 1)),
    h AS (SELECT doc_id, len(w) AS dl, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q),
    df AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
    b AS (SELECT doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""
ASKED = "The license software license"


@_c.add("bm25_topk", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bm25(read(spark, sf_dir, "documents"), ASKED, k=None).select("doc_id", F.round("score", 6).alias("score"))


@_c.add(
    "similar_decisions",
    """WITH d(id, statement) AS (VALUES ('d1', 'move the ring store to parquet files'), ('d2', 'keep the store in memory'), ('d3', 'parquet files beat text files'), ('d4', 'nothing alike')),
        t AS (SELECT id, list_filter(regexp_extract_all(lower(statement), '[a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM d), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
        h AS (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (VALUES ('parquet'), ('store')) q(term)), df AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term)
       SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN df USING (term), s WHERE tf > 0 GROUP BY id""",
)
def similar_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("d1", "move the ring store to parquet files"), ("d2", "keep the store in memory"), ("d3", "parquet files beat text files"), ("d4", "nothing alike")]
    found = ops.bm25(spark.createDataFrame(rows, "id string, statement string"), "parquet store", k=10, key="id", text="statement")
    return found.select("id", F.round("score", 6).alias("score"))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


@_c.add(
    "dense_topk",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS score FROM embeddings, q
       WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20""",
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dense_rank(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 20).select("vec_id", F.round("score", 5).alias("score"))


@_c.add(
    "maxsim_pages",
    """WITH q AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (0, 1)), d AS (SELECT vec_id // 4 AS page, q_id, max(list_dot_product(embedding::DOUBLE[], q)) AS best FROM embeddings, q GROUP BY ALL)
       SELECT page, round(sum(best), 5) AS score FROM d GROUP BY page""",
)
def maxsim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("page"), "embedding")
    return ops.max_sim(pages, [_vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)], "page", "embedding").select("page", F.round("score", 5).alias("score"))


@_c.add(
    "rrf_fusion",
    """WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS r FROM customer QUALIFY r < 50), s AS (SELECT o_custkey AS id, sum(o_totalprice) AS v FROM orders GROUP BY 1),
        b AS (SELECT id, row_number() OVER (ORDER BY v DESC, id) - 1 AS r FROM s QUALIFY r < 50) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return ops.fuse([a, b], "id").select("id", F.round("score", 9).alias("score"))


@_c.add(
    "rerank_interleave",
    """WITH h(id, kind, name, score) AS (VALUES ('e1', 'entity', 'Ring Store', 0.5), ('e2', 'entity', 'Red Ring Works', 0.49), ('c1', 'chunk', 'a ring in the store', 0.4), ('c2', 'chunk', 'nothing', 0.45), ('e3', 'entity', 'Other', 0.1)),
        l AS (SELECT id, kind, score + 0.02 * len(list_intersect(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) >= 2), ['ring', 'store'])) AS lifted FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY lifted DESC, id) AS rank FROM l) SELECT id, kind, rank, round(lifted::DOUBLE, 6) AS lifted FROM r ORDER BY rank, kind DESC, id LIMIT 4""",
)
def rerank_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("e1", "entity", "Ring Store", 0.5), ("e2", "entity", "Red Ring Works", 0.49), ("c1", "chunk", "a ring in the store", 0.4), ("c2", "chunk", "nothing", 0.45), ("e3", "entity", "Other", 0.1)]
    return ops.rerank(spark.createDataFrame(rows, "id string, kind string, name string, score double"), "ring store", 4)


@_c.add(
    "token_budget",
    """WITH c AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS cost FROM conversations), r AS (SELECT *, row_number() OVER w AS position, sum(cost) OVER w AS running FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, turn, position, running::BIGINT AS running FROM r WHERE running <= 200 OR position = 1""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.within_budget(read(spark, sf_dir, "conversations"), [F.col("turn")], "text", 200, ["conv_id"])
    return kept.select("conv_id", "turn", "position", "running")


@_c.add("page_concat", """SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS page_hash FROM conversations GROUP BY conv_id""")
def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_texts(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.sha2("page", 256).alias("page_hash"))


QUESTIONS = [
    "Why did Northwind pay?", "how is A connected to B", "explain the ring", "neighbours of X", "what is related to Y", "timeline of Z", "does anything contradict this", "which claims conflict",
    "what led to the decision", "find the decision on files", "show topic clusters", "how many nodes", "MATCH (n) RETURN n", "tell me more",
]
LOW = "lower(trim(q))"


def _any(cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({LOW}, '{c}')" for c in cues) + ")"


ROUTE = f"""CASE WHEN starts_with({LOW}, 'match ') OR contains({LOW}, ' return ') THEN 'gql' WHEN {_any(fx.PATH_CUES)} THEN 'path' WHEN starts_with({LOW}, 'why') OR contains({LOW}, 'explain') THEN 'why'
    WHEN {_any(("neighbo", "related to"))} THEN 'neighbors' WHEN {_any(("timeline", "when did", "over time", "history of"))} THEN 'timeline' WHEN contains({LOW}, 'contradict') THEN 'contradictions'
    WHEN contains({LOW}, 'conflict') THEN 'conflicts' WHEN {_any(("decision", "rationale"))} THEN CASE WHEN {_any(fx.TRACE_CUES)} THEN 'trace' ELSE 'decisions' END
    WHEN {_any(("communit", "cluster", "topic"))} THEN 'communities' WHEN starts_with({LOW}, 'stats') OR contains({LOW}, 'how many') OR starts_with({LOW}, 'count') THEN 'stats' ELSE 'reason' END"""
STRATEGY = "CASE tool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.STRATEGIES.items()) + " ELSE 'hybrid-multi-tool' END"


@_c.add(
    "route_questions",
    f"""WITH t(q) AS (SELECT text FROM conversations UNION ALL VALUES {", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS)}), r AS (SELECT q, {ROUTE} AS tool FROM t)
        SELECT sha256(q) AS question, tool, {STRATEGY} AS strategy FROM r""",
)
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "conversations").select(F.col("text").alias("q")).unionByName(spark.createDataFrame([(q,) for q in QUESTIONS], "q string"))
    routed = asked.withColumn("tool", fx.route_tool("q"))
    return routed.select(F.sha2("q", 256).alias("question"), "tool", fx.route_strategy("tool").alias("strategy"))


@_c.add(
    "grounding_confidence",
    """WITH g AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'stats' ELSE 'why' END AS tool, (o_orderkey % 7)::INT AS n, o_orderkey % 2 = 0 AS focus FROM orders)
       SELECT id, CASE WHEN tool = 'stats' THEN 1.0 WHEN n <= 0 THEN 0.0 ELSE round(least(1.0, 0.45::DOUBLE + 0.15::DOUBLE * least(n, 4)) * CASE WHEN focus THEN 1.0 ELSE 0.8::DOUBLE END, 3) END AS confidence FROM g""",
)
def grounding_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "search").when(k % 3 == 1, "stats").otherwise("why").alias("tool"), (k % 7).cast("int").alias("n"), (k % 2 == 0).alias("focus"))
    return o.select("id", fx.grounding("tool", "n", F.col("focus")).alias("confidence"))


@_c.add(
    "retrieval_quality",
    """WITH r AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT DISTINCT o_custkey AS query, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
        p AS (SELECT g.query, count(*) AS n, count(*) FILTER (rank <= 5) AS hits, min(rank) FILTER (rank <= 5) AS first FROM g JOIN r USING (query, id) GROUP BY g.query)
       SELECT round(avg(hits / n), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM p""",
)
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), rank.alias("rank"))
    gold = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id")).distinct()
    return ops.retrieval_quality(ranked, gold, 5)


@_c.add(
    "ppr_seeds",
    """WITH e(node_id, name) AS (VALUES ('n1', 'Ring Store'), ('n2', 'Harbor Trust')), c(node_id, score) AS (VALUES ('c1', 1.5::DOUBLE), ('c2', 0.5)), m(chunk, entity) AS (VALUES ('c1', 'n2'), ('c2', 'n2'), ('c1', 'n1')),
        u AS (SELECT 'n1' AS node_id, 2.0::DOUBLE AS seed UNION ALL SELECT node_id, score FROM c UNION ALL SELECT entity, score * 0.5 FROM m JOIN c ON chunk = node_id) SELECT node_id, round(sum(seed), 6) AS seed FROM u GROUP BY node_id""",
)
def ppr_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("n1", "Ring Store"), ("n2", "Harbor Trust")], "node_id string, name string")
    c = spark.createDataFrame([("c1", 1.5), ("c2", 0.5)], "node_id string, score double")
    m = spark.createDataFrame([("c1", "n2"), ("c2", "n2"), ("c1", "n1")], "chunk string, entity string")
    return ops.ppr_seeds("ring store", e, c, m).select("node_id", F.round("seed", 6).alias("seed"))


@_c.add("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", ops.hash_embedding_column("text").alias("vector"))


QUERIES, SQL = _c.queries, _c.sql
