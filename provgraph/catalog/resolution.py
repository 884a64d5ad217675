"""Entity resolution over part names and a small list of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution as ops
from ..operators.lift import read
from .common import Catalog

_c = Catalog()
COMPANIES = ["Northwind Corp", "Northwind Corporation", "Northwind", "Northwind Bank", "Blue Ridge Holdings Ltd", "Blue Ridge Holding", "BR", "Harbor Trust", "Harbour Trust", "Delta Fund", "Delta Funds Co"]
VALUES = "c(id, name) AS (VALUES " + ", ".join(f"('e{i:02d}', '{n}')" for i, n in enumerate(COMPANIES)) + ")"
NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS name_a, b.name AS name_b FROM n a JOIN n b ON a.name < b.name AND string_split(a.name, ' ')[1] = string_split(b.name, ' ')[1])"


def _companies(spark: SparkSession) -> DataFrame:
    return ops.records(spark.createDataFrame([(f"e{i:02d}", "Organization", n) for i, n in enumerate(COMPANIES)], "id string, etype string, name string"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    first = F.split("name", " ")[0]
    a, b = names.select(F.col("name").alias("name_a"), first.alias("k")), names.select(F.col("name").alias("name_b"), first.alias("k"))
    return a.join(b, "k").filter("name_a < name_b").select("name_a", "name_b")


STRIP = r"""lower(trim(regexp_replace(name, '(?i)\b(?:corp(?:oration)?|ltd|limited|llc|inc(?:orporated)?|plc|gmbh|s\.?a\.?|bank|group|holdings?|trust|fund|partners|co)\b\.?', '', 'g')))"""
BLOCKS = rf"""r AS (SELECT id, lower(name) AS norm, regexp_replace({STRIP}, '\s+', ' ', 'g') AS s FROM c),
    k AS (SELECT id, 'strip:Organization:' || s AS block FROM r WHERE s <> ''
          UNION SELECT id, 'acr:Organization:' || array_to_string(list_transform(string_split(s, ' '), lambda w: w[1]), '') FROM r WHERE s LIKE '% %'
          UNION SELECT id, 'tok0:Organization:' || string_split(norm, ' ')[1] FROM r)"""


@_c.add("er_blocking_pairs", f"WITH {VALUES}, {BLOCKS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.block = b.block AND a.id < b.id")
def er_blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.candidate_pairs(ops.blocking_keys(_companies(spark)))


@_c.add(
    "er_jaro_winkler",
    f"""WITH {NAMES}, x AS (SELECT *, jaro_similarity(name_a, name_b) AS j, CASE WHEN name_a[1:4] = name_b[1:4] THEN 4 WHEN name_a[1:3] = name_b[1:3] THEN 3 WHEN name_a[1:2] = name_b[1:2] THEN 2 WHEN name_a[1] = name_b[1] THEN 1 ELSE 0 END AS n FROM p)
        SELECT name_a, name_b, round(j + n * 0.1 * (1 - j), 6) AS similarity FROM x""",
)
def er_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("name_a", "name_b", F.round(ops.jaro_winkler_column("name_a", "name_b"), 6).alias("similarity"))


@_c.add(
    "er_jaccard",
    f"""WITH {NAMES} SELECT name_a, name_b, round(len(list_intersect(string_split(name_a, ' '), string_split(name_b, ' '))) / len(list_distinct(list_concat(string_split(name_a, ' '), string_split(name_b, ' ')))), 6) AS similarity FROM p""",
)
def er_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("name_a", "name_b", F.round(ops.token_jaccard("name_a", "name_b"), 6).alias("similarity"))


FAMILIES = "CASE regexp_extract(norm, '[^ ]+$') WHEN 'corp' THEN 'corp' WHEN 'corporation' THEN 'corp' WHEN 'ltd' THEN 'ltd' WHEN 'bank' THEN 'bank' WHEN 'holding' THEN 'holdings' WHEN 'trust' THEN 'trust' WHEN 'fund' THEN 'fund' WHEN 'co' THEN 'co' ELSE '' END"


@_c.add(
    "er_pair_score",
    f"""WITH {VALUES}, {BLOCKS}, q AS (SELECT id, norm, s, {FAMILIES} AS f, CASE WHEN s LIKE '% %' THEN array_to_string(list_transform(string_split(s, ' '), lambda w: w[1]), '') ELSE '' END AS i FROM r),
        p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.block = b.block AND a.id < b.id),
        x AS (SELECT id_a, id_b, a.s AS sa, b.s AS sb, a.f AS fa, b.f AS fb, a.i AS ia, b.i AS ib, jaro_similarity(a.norm, b.norm) AS j,
              len(list_filter(range(1, 5), lambda n: n <= least(length(a.norm), length(b.norm)) AND a.norm[1:n] = b.norm[1:n])) AS n,
              len(list_intersect(string_split(a.norm, ' '), string_split(b.norm, ' '))) / len(list_distinct(list_concat(string_split(a.norm, ' '), string_split(b.norm, ' ')))) AS t
              FROM p JOIN q a ON a.id = id_a JOIN q b ON b.id = id_b),
        y AS (SELECT id_a, id_b, CASE WHEN sa = sb AND sa <> '' THEN CASE WHEN fa <> '' AND fb <> '' AND fa <> fb THEN 0.70 ELSE 0.95 END
              ELSE greatest(j + n * 0.1 * (1 - j), t, CASE WHEN (ia <> '' AND ia = sb) OR (ib <> '' AND ib = sa) THEN 0.9 ELSE 0 END) END AS v FROM x)
        SELECT id_a, id_b, round(v::DOUBLE, 6) AS score, v >= 0.86 AS matched FROM y""",
)
def er_pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _companies(spark)
    scored = ops.score_pairs(ops.pair_features(ops.candidate_pairs(ops.blocking_keys(recs)), recs))
    return scored.select("id_a", "id_b", F.round("score", 6).alias("score"), (F.col("score") >= ops.MATCH).alias("matched"))


@_c.add("complete_linkage")
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _companies(spark)
    return ops.clusters(recs, ops.score_pairs(ops.pair_features(ops.candidate_pairs(ops.blocking_keys(recs)), recs)))


@_c.add(
    "er_canonical_name",
    r"""SELECT p_brand AS cluster, arg_min(p_name, (-len(string_split_regex(p_name, '\s+')), -length(p_name), p_name)) AS canonical, count(*) AS size FROM part GROUP BY p_brand""",
)
def er_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.canonical_names(read(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")))


@_c.add(
    "er_bcubed",
    """WITH b AS (SELECT doc_id, quality AS p, toxic AS t FROM labels), x AS (SELECT a.doc_id, count(*) FILTER (a.p = b.p AND a.t = b.t) AS nb, count(*) FILTER (a.p = b.p) AS np, count(*) FILTER (a.t = b.t) AS nt FROM b a, b GROUP BY a.doc_id),
       s AS (SELECT avg(nb / np) AS p, avg(nb / nt) AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
)
def er_bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return ops.b_cubed(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("cluster")), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("cluster")))


TRUTH = [("e00", "e01"), ("e00", "e02"), ("e01", "e02"), ("e04", "e05"), ("e04", "e06"), ("e07", "e08")]


@_c.add(
    "er_blocking_recall",
    f"""WITH {VALUES}, {BLOCKS}, p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.block = b.block AND a.id < b.id), t(id_a, id_b) AS (VALUES {", ".join(map(str, TRUTH))})
        SELECT round((SELECT count(*) FROM t JOIN p USING (id_a, id_b)) / (SELECT count(*) FROM t), 6) AS recall, round(1 - (SELECT count(*) FROM p) / ({len(COMPANIES)} * ({len(COMPANIES)} - 1) / 2), 6) AS reduction""",
)
def er_blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ops.candidate_pairs(ops.blocking_keys(_companies(spark)))
    return ops.blocking_quality(pairs, spark.createDataFrame(TRUTH, "id_a string, id_b string"), len(COMPANIES))


@_c.add(
    "er_shared_neighbors",
    """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), q AS (SELECT s_suppkey AS id_a, s_suppkey + 1 AS id_b FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
            n AS (SELECT s, count(*) AS n FROM l GROUP BY s), m AS (SELECT id_a, id_b, count(*) AS shared FROM q JOIN l a ON a.s = id_a JOIN l b ON b.s = id_b AND a.p = b.p GROUP BY ALL)
       SELECT 's' || id_a AS id_a, 's' || id_b AS id_b, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS near FROM q JOIN n x ON x.s = id_a JOIN n y ON y.s = id_b LEFT JOIN m USING (id_a, id_b)""",
)
def er_shared_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    s = read(spark, sf_dir, "supplier")
    after = s.select(F.col("s_suppkey").alias("k"))
    pairs = s.join(after, F.col("s_suppkey") + 1 == F.col("k")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id_a"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("id_b"))
    return ops.shared_neighbors(pairs, links).select("id_a", "id_b", F.round("near", 6).alias("near"))


QUERIES, SQL = _c.queries, _c.sql
