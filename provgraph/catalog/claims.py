"""Claims over events, and date grounding over lineitems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as ops
from ..operators.lift import event_claims, read, trade_edges, trade_nodes
from .common import CLAIMS, EDGES, Catalog

_c = Catalog()

WINDOWS = f"""{CLAIMS},
    own AS (SELECT * FROM claims WHERE predicate IN ('BENEFICIAL_OWNER_OF', 'CONTROLS', 'DIRECTOR_OF') AND polarity = 'pos'),
    win AS (SELECT a.*, t_valid AS w_start, coalesce(t_invalid, (SELECT min(b.t_valid) FROM own b WHERE b.subject = a.subject AND b.predicate = a.predicate AND b.object <> a.object AND b.t_valid > a.t_valid)) AS w_end FROM own a),
    con AS (SELECT * FROM win a WHERE EXISTS (SELECT 1 FROM win b WHERE a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object
        AND (a.w_start IS NULL OR b.w_end IS NULL OR a.w_start < b.w_end) AND (b.w_start IS NULL OR a.w_end IS NULL OR b.w_start < a.w_end)))"""


@_c.add(
    "claims_reify",
    f"""WITH {EDGES} SELECT DISTINCT 'claim:' || sha256(subject || '|' || predicate || '|' || object) AS claim_id, subject, predicate, object FROM edges""",
)
def claims_reify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reify(trade_edges(spark, sf_dir), trade_nodes(spark, sf_dir)).select("claim_id", "subject", "predicate", "object")


@_c.add(
    "claim_nearest_date",
    """WITH c AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey || '-' || l_linenumber AS claim_id, l_partkey AS start, l_partkey + 20 AS "end" FROM lineitem WHERE l_linenumber = 1),
            d AS (SELECT l_orderkey % 500 AS doc_id, l_partkey AS start, l_partkey + 10 AS "end", strftime(l_shipdate, '%Y-%m-%d') AS name FROM lineitem WHERE l_linenumber = 2),
            g AS (SELECT c.claim_id, name, d.start, greatest(0, c.start - d."end", d.start - c."end") AS gap FROM c JOIN d USING (doc_id))
       SELECT claim_id, arg_min(name, (gap, start, name)) AS t_valid FROM g WHERE gap <= 160 GROUP BY claim_id""",
)
def claim_nearest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") % 500)
    c = li.filter("l_linenumber = 1").select("doc_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 20).alias("end"))
    d = li.filter("l_linenumber = 2").select("doc_id", F.col("l_partkey").alias("start"), (F.col("l_partkey") + 10).alias("end"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("name"))
    return ops.nearest_dates(c, d)


@_c.add(
    "claim_supersede",
    f"""WITH {CLAIMS}, d AS (SELECT * FROM claims WHERE t_valid IS NOT NULL)
        SELECT a.claim_id, arg_min(b.claim_id, (b.t_valid, b.claim_id)) AS superseded_by, min(b.t_valid) AS t_invalid
        FROM d a JOIN d b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object AND a.polarity <> b.polarity AND b.t_valid > a.t_valid GROUP BY a.claim_id""",
)
def claim_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.supersede(event_claims(spark, sf_dir))


@_c.add("conflict_windows", f"WITH {WINDOWS} SELECT claim_id, w_start, w_end FROM win")
def conflict_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.effective_windows(event_claims(spark, sf_dir)).select("claim_id", "w_start", "w_end")


@_c.add(
    "conflict_overlap",
    f"""WITH {WINDOWS} SELECT 'conflict:' || sha256(subject || '|' || predicate || '|' || array_to_string(list_sort(list(DISTINCT object)), '|')) AS conflict_id, subject, predicate,
        CASE WHEN predicate = 'CONTROLS' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, list_sort(list(DISTINCT object)) AS objects, count(*) AS claim_count
        FROM con GROUP BY subject, predicate HAVING count(*) >= 2""",
)
def conflict_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.conflicts(_contending(spark, sf_dir))


def _contending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contenders(ops.effective_windows(event_claims(spark, sf_dir)))


@_c.add(
    "conflict_voting",
    f"""WITH {WINDOWS}, s AS (SELECT subject, predicate, object, count(DISTINCT doc_id)::DOUBLE AS score, min(doc_id) AS d FROM con GROUP BY ALL)
        SELECT subject, predicate, object AS winner, score FROM s QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY score DESC, d, object DESC) = 1""",
)
def conflict_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve(_contending(spark, sf_dir), "voting")


@_c.add(
    "conflict_most_recent",
    f"""WITH {WINDOWS}, s AS (SELECT subject, predicate, object, max(t_valid) AS score FROM con WHERE t_valid IS NOT NULL GROUP BY ALL)
        SELECT subject, predicate, object AS winner, score FROM s QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY score DESC, object DESC) = 1""",
)
def conflict_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve(_contending(spark, sf_dir), "most_recent")


@_c.add(
    "conflict_credibility",
    f"""WITH {WINDOWS}, w(doc_id, weight) AS (VALUES ('doc:1', 0.2), ('doc:2', 2.5), ('doc:12', 0.5)), d AS (SELECT DISTINCT subject, predicate, object, doc_id FROM con),
        s AS (SELECT subject, predicate, object, round(sum(coalesce(weight, 1.0))::DOUBLE, 6) AS score, min(doc_id) AS d FROM d LEFT JOIN w USING (doc_id) GROUP BY ALL)
        SELECT subject, predicate, object AS winner, score FROM s QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY score DESC, d, object DESC) = 1""",
)
def conflict_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("doc:1", 0.2), ("doc:2", 2.5), ("doc:12", 0.5)], "doc_id string, weight double")
    return ops.resolve(_contending(spark, sf_dir), "credibility_weighted", weights)


@_c.add(
    "conflict_demoted",
    f"""WITH {WINDOWS}, s AS (SELECT subject, predicate, object, count(DISTINCT doc_id) AS score, min(doc_id) AS d FROM con GROUP BY ALL),
        w AS (SELECT subject, predicate, object AS winner FROM s QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY score DESC, d, object DESC) = 1),
        b AS (SELECT subject, predicate, min(claim_id) AS best FROM con JOIN w USING (subject, predicate) WHERE object = winner GROUP BY ALL)
        SELECT claim_id, best AS superseded_by, 'voting' AS resolved_by FROM con JOIN w USING (subject, predicate) JOIN b USING (subject, predicate) WHERE object <> winner""",
)
def conflict_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    contending = _contending(spark, sf_dir)
    return ops.demote(contending, ops.resolve(contending, "voting"), "voting")


@_c.add(
    "contradiction_pairs",
    f"""WITH {CLAIMS} SELECT a.subject, a.predicate, a.object, least(a.claim_id, b.claim_id) AS claim_a, greatest(a.claim_id, b.claim_id) AS claim_b, least(a.confidence, b.confidence) AS confidence
        FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object AND a.polarity = 'pos' AND b.polarity = 'neg'""",
)
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contradictions(event_claims(spark, sf_dir))


@_c.add("timeline_entity", f"""WITH {CLAIMS} SELECT claim_id, predicate, object, polarity, t_valid FROM claims WHERE subject = 'user:7' OR object = 'user:7'""")
def timeline_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.timeline(event_claims(spark, sf_dir), "user:7")


@_c.add(
    "why_claims",
    f"""WITH {CLAIMS} SELECT claim_id, subject, predicate, object, confidence FROM claims WHERE subject = 'user:7' OR object = 'user:7' ORDER BY confidence DESC, claim_id LIMIT 8""",
)
def why_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.why(event_claims(spark, sf_dir), "user:7", 8)


@_c.add(
    "inspect_tiers",
    f"""WITH {CLAIMS} SELECT CASE WHEN confidence >= 0.75 THEN 'EXTRACTED' WHEN confidence >= 0.25 THEN 'INFERRED' ELSE 'GENERATED' END AS tag, count(*) AS n FROM claims WHERE subject = 'user:7' GROUP BY 1""",
)
def inspect_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph_tools import tag_counts

    tag = F.when(F.col("confidence") >= 0.75, "EXTRACTED").when(F.col("confidence") >= 0.25, "INFERRED").otherwise("GENERATED")
    return tag_counts(event_claims(spark, sf_dir).filter("subject = 'user:7'").withColumn("tag", tag))


@_c.add(
    "canonical_claims",
    f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN subject = 'user:7' THEN 'user:1' ELSE subject END AS subject, CASE WHEN object = 'band:3' THEN 'band:2' ELSE object END AS object FROM claims""",
)
def canonical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = spark.createDataFrame([("user:7", "user:1"), ("band:3", "band:2")], "subject string, object string")
    return ops.canonical_ends(event_claims(spark, sf_dir), same).select("claim_id", "subject", "object")


QUERIES, SQL = _c.queries, _c.sql
