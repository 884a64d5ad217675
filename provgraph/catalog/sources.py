"""Formats, extraction and the sinks' records; small texts of our own with their expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import analytics, extraction, resolution, structure
from ..operators.lift import read
from ..sinks import store
from ..sources import corpus
from .common import Catalog

_c = Catalog()

NOTES = [
    ("n1", "On 2026-03-04 Larch Corp transferred USD 4,000 to Rowan Ltd. It did not transfer funds to Hazel Trust."),
    ("n2", "Rowan Ltd is controlled by Alder Holdings. Dr. Mary Birch is director of Larch Corp. LARCH reportedly owns Elm Bank."),
    ("n3", "The payment from Elm Bank to Pine Co was small. Write to ann@birch.example about account 12345."),
    ("n4", ""),
]


def values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _notes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    docs = spark.createDataFrame(NOTES, "doc_id string, text string")
    return docs, structure.paragraph_blocks(docs)


E = "entity:Organization:"
RELATIONS = [
    ("n1", E + "larch corp", "TRANSFERRED", E + "rowan ltd", "pos", "asserted", False, "USD 4,000"),
    ("n1", E + "rowan ltd", "TRANSFERRED", E + "hazel trust", "neg", "asserted", True, ""),
    ("n2", E + "rowan ltd", "CONTROLLED_BY", E + "alder holdings", "pos", "asserted", False, ""),
    ("n2", "entity:Person:mary birch", "DIRECTOR_OF", E + "larch corp", "pos", "asserted", False, ""),
    ("n2", E + "larch", "CONTROLS", E + "elm bank", "pos", "hedged", False, ""),
    ("n3", E + "elm bank", "TRANSFERRED", E + "pine co", "pos", "asserted", False, ""),
]


@_c.add("relations", f"SELECT * FROM ({values(RELATIONS)}) t(doc_id, subject_id, predicate, object_id, polarity, modality, inferred, amount)")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_relations(*_notes(spark)).select("doc_id", "subject_id", "predicate", "object_id", "polarity", "modality", "inferred", "amount")


MENTIONS = [
    ("n1", "Date", "2026-03-04"), ("n1", "Organization", "Larch Corp"), ("n1", "Money", "USD 4,000"), ("n1", "Organization", "Rowan Ltd"), ("n1", "Organization", "Hazel Trust"),
    ("n2", "Organization", "Rowan Ltd"), ("n2", "Organization", "Alder Holdings"), ("n2", "Person", "Mary Birch"), ("n2", "Organization", "Larch Corp"), ("n2", "Organization", "LARCH"), ("n2", "Organization", "Elm Bank"),
    ("n3", "Organization", "Elm Bank"), ("n3", "Organization", "Pine Co"), ("n3", "Email", "ann@birch.example"), ("n3", "Account", "account 12345"),
]
TEXTS = f"t(doc_id, text) AS ({values(NOTES)}), m(doc_id, etype, surface) AS ({values(MENTIONS)})"


@_c.add("entities", f"WITH {TEXTS} SELECT doc_id, etype, surface, strpos(text, surface) - 1 AS start, strpos(text, surface) - 1 + length(surface) AS \"end\" FROM m JOIN t USING (doc_id)")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_mentions(*_notes(spark)).select("doc_id", "etype", "surface", "start", "end")


@_c.add("entity_nodes", f"WITH {TEXTS} SELECT 'entity:' || etype || ':' || lower(surface) AS node_id, etype, arg_min(surface, (doc_id, strpos(text, surface))) AS name, count(*) AS mention_count FROM m JOIN t USING (doc_id) GROUP BY ALL")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.entities(extraction.extract_mentions(*_notes(spark)))


@_c.add(
    "mention_edges",
    f"""WITH {TEXTS} SELECT 'doc:' || doc_id AS subject, 'entity:' || etype || ':' || lower(surface) AS object, count(*) AS evidence_count,
        'edge:' || sha256('doc:' || doc_id || '|MENTIONS|entity:' || etype || ':' || lower(surface)) AS edge_id FROM m GROUP BY ALL""",
)
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.mention_edges(extraction.extract_mentions(*_notes(spark))).select("subject", "object", "evidence_count", "edge_id")


@_c.add("sentence_spans", f"SELECT * FROM ({values([('n1', 0, 60), ('n1', 61, 102), ('n2', 0, 42), ('n2', 43, 84), ('n2', 85, 116), ('n3', 0, 47), ('n3', 48, 95)])}) t(doc_id, start, \"end\")")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sentences(_notes(spark)[1]).select("doc_id", "start", "end")


@_c.add("extraction_quality", "SELECT 1.0::DOUBLE AS precision, round(6 / 7, 6) AS recall, round(12 / 13, 6) AS f1, 0.0::DOUBLE AS false_rate")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["doc_id", "subject_id", "predicate", "object_id"]
    gold = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in RELATIONS] + [("n4", "x", "Y", "z")], "doc_id string, subject_id string, predicate string, object_id string")
    return extraction.precision_recall(extraction.extract_relations(*_notes(spark)), gold, key)


@_c.add("pronoun_coverage", "SELECT * FROM (VALUES ('n1', 1, 1), ('n2', 0, 0), ('n3', 0, 0)) t(doc_id, pronouns, resolved)")
def pronoun_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.pronoun_coverage(*_notes(spark))


@_c.add(
    "prov_decisions",
    """SELECT 'd1' AS node_id, '{"@id":"d1","@type":"prov:Activity","rdfs:label":"keep","prov:used":["r1"],"prov:wasInformedBy":["d0"]}' AS json
       UNION ALL SELECT 'd2', '{"@id":"d2","@type":"prov:Activity","rdfs:label":"go"}'""",
)
def prov_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.rdf import decision_activities

    made = spark.createDataFrame([("d1", "keep"), ("d2", "go")], "node_id string, name string")
    links = spark.createDataFrame([("d1", "DERIVED_FROM", "r1"), ("d1", "CAUSED", "d0")], "subject string, predicate string, object string")
    return decision_activities(made, links)


@_c.add("html_blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed blocks of all pages."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit(".html").alias("extension"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return corpus.file_blocks(pages).select(F.col("path").cast("long").alias("page_id"), "ord", "kind", "level", "text")


@_c.add(
    "canonical_names",
    r"""WITH t(name, norm, stripped, family, initials) AS (VALUES ('Blue  Ridge Holdings Ltd.', 'blue ridge holdings ltd', 'Blue  Ridge', 'ltd', 'brhl'), ('"Acme Corp"', 'acme corp', '"Acme "', 'corp', '"c'),
          ('IBM', 'ibm', 'IBM', '', ''), ('Delta Bank', 'delta bank', 'Delta', 'bank', 'db')) SELECT * FROM t""",
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Blue  Ridge Holdings Ltd.",), ('"Acme Corp"',), ("IBM",), ("Delta Bank",)], "name string")
    return names.select("name", fx.normal_name("name").alias("norm"), fx.stripped_name("name").alias("stripped"), fx.suffix_family("name").alias("family"), fx.acronym("name").alias("initials"))


SURFACES = sorted(fx.PREDICATES.items()) + [("sold to", "SOLD_TO")]


@_c.add("canonical_predicates", f"SELECT * FROM ({values(SURFACES)}) t(surface, predicate)")
def canonical_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _ in SURFACES], "surface string").select("surface", fx.canonical_predicate(F.concat(F.lit("  "), F.upper("surface"), F.lit(" "))).alias("predicate"))


@_c.add("rtf_text", r"SELECT 1 AS id, 'Bold' || chr(10) || 'plain text' AS body")
def rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(1, rb"{\rtf1\b Bold\par plain text}")], "id int, raw binary")
    return raw.select("id", fx.rtf_text("raw").alias("body"))


@_c.add("canonical_bytes", r"SELECT 1 AS id, 'a' || chr(10) || 'b' || chr(10) || 'c' AS body")
def canonical_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(1, b"\xef\xbb\xbfa\r\nb\rc")], "id int, raw binary")
    return raw.select("id", fx.canonical_text("raw").alias("body"))


MARKS = [("d1", "r1", "ADR-1", "# ADR-1: keep"), ("d2", "r2", "ADR-2", "ADR-2: go SUPERSEDES ADR-1"), ("d2", "r3", "ADR-1", "ADR-2: go SUPERSEDES ADR-1"), ("d3", "r4", "WHY:", "WHY: because of ADR-2"), ("d3", "r5", "NOTE", "NOTE x")]


@_c.add("decisions", "SELECT * FROM (VALUES ('r1', 'adr', 1), ('r2', 'adr', 2), ('r4', 'why', NULL)) t(id, category, adr)")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.decisions(spark.createDataFrame(MARKS, "doc_id string, id string, marker string, line string")).select("id", "category", "adr")


@_c.add("causal_links", "SELECT * FROM (VALUES ('r1', 'PRECEDENT_FOR', 'r2'), ('r2', 'CAUSED', 'r4')) t(subject, predicate, object)")
def causal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.causal_links(structure.decisions(spark.createDataFrame(MARKS, "doc_id string, id string, marker string, line string")))


@_c.add("store_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END AS v FROM customer UNION ALL SELECT -1, 1.5")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = old.filter("id % 4 = 0").withColumn("v", F.lit(0.0)).unionByName(spark.createDataFrame([(-1, 1.5)], "id long, v double"))
    return store.upsert(old, new, "id")


@_c.add(
    "template_stream_batch",
    """SELECT event_type || ' <NUM>' AS template, count(*) AS occurrences FROM events GROUP BY event_type""",
)
def template_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.watch import template_counts

    return template_counts(read(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("value")))


@_c.add("event_windows", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.watch import event_windows as windows

    found = windows(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_c.add(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.watch import sessions

    found = sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@_c.add("enrich_nodes", "SELECT 'supplier:' || s_suppkey AS node_id, round(s_acctbal / 7, 8) AS pagerank, CASE WHEN s_nationkey < 10 THEN s_nationkey END AS community FROM supplier")
def enrich_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").withColumn("node_id", F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")))
    return analytics.enrich(s.select("node_id"), pagerank=s.select("node_id", (F.col("s_acctbal") / 7).alias("v")), community=s.filter("s_nationkey < 10").select("node_id", F.col("s_nationkey").alias("v")))


@_c.add("linkage_golden", "SELECT * FROM (VALUES ('e00', 'e00'), ('e01', 'e00'), ('e02', 'e00'), ('e03', 'e03')) t(id, cluster)")
def linkage_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("e00", "Organization", "Northwind Corp"), ("e01", "Organization", "Northwind Corporation"), ("e02", "Organization", "Northwind"), ("e03", "Person", "Northwind")]
    recs = resolution.records(spark.createDataFrame(rows, "id string, etype string, name string"))
    scored = resolution.score_pairs(resolution.pair_features(resolution.candidate_pairs(resolution.blocking_keys(recs)), recs))
    return resolution.clusters(recs, scored)


LINKS = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]


def _small(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node_id string")
    edges = spark.createDataFrame([(x, y, 0.5 if (x, y) == ("c", "d") else 1.0) for x, y in LINKS], "subject string, object string, weight double")
    return nodes, analytics.adjacency(nodes, edges)


PATHS = f"""l(a, b) AS (SELECT * FROM ({values(LINKS)}) UNION ALL SELECT y, x FROM ({values(LINKS)}) v(x, y)), n(v) AS (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g')),
    p AS (SELECT v AS s, v AS t, [v] AS path FROM n UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN l ON a = t WHERE NOT list_contains(path, b)),
    q AS (SELECT *, min(len(path)) OVER (PARTITION BY s, t) AS shortest FROM p), k AS (SELECT s, t, path, count(*) OVER (PARTITION BY s, t) AS n FROM q WHERE len(path) = shortest)"""


@_c.add("betweenness_golden", f"WITH RECURSIVE {PATHS}, u AS (SELECT unnest(path[2:-2]) AS v, n FROM k) SELECT n.v AS node_id, round(coalesce(sum(1.0::DOUBLE / u.n), 0) / 30, 8) AS score FROM n LEFT JOIN u ON u.v = n.v GROUP BY n.v")
def betweenness_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.betweenness(*_small(spark)).select("node_id", F.round("score", 8).alias("score"))


@_c.add("communities_golden", "SELECT * FROM (VALUES ('a', 0), ('b', 0), ('c', 0), ('d', 1), ('e', 1), ('f', 1), ('g', 2)) t(node_id, community)")
def communities_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj = _small(spark)
    return analytics.label_propagation(nodes, adj)


@_c.add("community_bridges", "SELECT 'c' AS a, 'd' AS b")
def community_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj = _small(spark)
    return analytics.community_bridges(analytics.bridges(nodes, adj), analytics.label_propagation(nodes, adj)).select("a", "b")


QUERIES, SQL = _c.queries, _c.sql
