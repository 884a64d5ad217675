"""Text structure, spans and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..ids import content_id, doc_id, span_hash
from ..operators import graph_tools, intervals, structure
from ..operators.lift import read
from .common import Catalog

_c = Catalog()
LINES = """ lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) """


@_c.add(
    "tokenize_counts",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2)) AS n_terms,
        len(regexp_extract_all(text, '\S+')) AS n_tokens, greatest(1, length(text) // 4) AS estimate FROM documents""",
)
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(fx.tokens("text")).alias("n_terms"), fx.token_count("text").alias("n_tokens"), fx.token_estimate("text").alias("estimate"))


@_c.add(
    "polarity_modality",
    rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){fx.NEGATION.replace("'", "''")}') THEN 'neg' ELSE 'pos' END AS polarity,
        CASE WHEN regexp_matches(text, '(?i){fx.HEDGE}') THEN 'hedged' ELSE 'asserted' END AS modality FROM documents""",
)
def polarity_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", fx.polarity("text").alias("polarity"), fx.modality("text").alias("modality"))


@_c.add("normalize_keys", r"""SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || upper(p_brand) || ' ', '\s+', ' ', 'g'))) AS k FROM part""")
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), F.upper("p_brand"), F.lit(" "))
    return read(spark, sf_dir, "part").select("p_partkey", fx.normal_key(raw).alias("k"))


@_c.add(
    "content_address",
    r"""SELECT doc_id AS id, 'sha256:' || sha256(text) AS doc_hash, 'edge:' || sha256(coalesce(source, '') || '|HAS|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS edge_hash,
        CASE WHEN strlen(text) >= 20 THEN sha256(unhex(substr(hex(encode(text)), 1, 40))) END AS span FROM documents""",
)
def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the UTF-8 bytes of all rows, and of a span of them."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), doc_id("text").alias("doc_hash"), content_id("edge", "source", F.lit("HAS"), "doc_id").alias("edge_hash"), span_hash("text", F.lit(0), F.lit(20)).alias("span"))


@_c.add(
    "log_templates",
    rf"""WITH {LINES}, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
          '{fx.LOG_MASKS[0][0]}', '<TS>', 'g'), '{fx.LOG_MASKS[1][0]}', '<IP>', 'g'), '{fx.LOG_MASKS[2][0]}', '<UUID>', 'g'), '{fx.LOG_MASKS[3][0]}', '<HEX>', 'g'),
          '{fx.LOG_MASKS[4][0]}', '<STR>', 'g'), '{fx.LOG_MASKS[5][0]}', '<NUM>', 'g')) AS template FROM lines WHERE trim(line) <> '')
        SELECT sha256(template) AS template_hash, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM t GROUP BY template""",
)
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.lines(read(spark, sf_dir, "documents"), "doc_id", "text").filter(F.trim("line") != "")
    t = structure.template_counts(lines, "doc_id", "line")
    return t.groupBy("template").agg(F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("docs")).select(F.sha2("template", 256).alias("template_hash"), "occurrences", "docs")


@_c.add("json_fields", """SELECT event_id, 'k' AS path, props ->> '$.k' AS value FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.json_fields(read(spark, sf_dir, "events"), "event_id", "props")


@_c.add(
    "html_links",
    r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages""",
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(fx.matches("html", 'href="([^"]+)"', 1)).alias("target"))


@_c.add("emails_extract", rf"""SELECT doc_id, unnest(regexp_extract_all(text, '{fx.EMAIL}')) AS email FROM documents""")
def emails_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(fx.matches("text", fx.EMAIL)).alias("email"))


@_c.add(
    "inline_markers",
    rf"""WITH t(id, body) AS (VALUES (1, 'WHY: [[Ring Plan|plan]] and [x](http://a.b/c "t") see [12], §2.1 and Table 3'), (2, 'Owners MUST NOT or SHOULD wait. DECISION: go. ADR-7'),
        (3, 'Grace period: ten days for arXiv:2101.00001 and 10.1000/xyz'), (4, 'Note: nothing here'))
        SELECT id, 'wikilink' AS kind, trim(unnest(regexp_extract_all(body, '{fx.WIKILINK}', 1))) AS value FROM t
        UNION ALL SELECT id, 'link', unnest(regexp_extract_all(body, '{fx.MDLINK}', 1)) FROM t
        UNION ALL SELECT id, 'citation', unnest(regexp_extract_all(body, '{fx.CITATION}', 1)) FROM t
        UNION ALL SELECT id, 'xref', unnest(regexp_extract_all(body, '{fx.XREF}')) FROM t
        UNION ALL SELECT id, 'rationale', unnest(regexp_extract_all(body, '{fx.RATIONALE}')) FROM t
        UNION ALL SELECT id, 'requirement', unnest(regexp_extract_all(body, '{fx.RFC2119}')) FROM t
        UNION ALL SELECT id, 'doi', unnest(regexp_extract_all(body, '{fx.DOI}')) FROM t
        UNION ALL SELECT id, 'arxiv', unnest(regexp_extract_all(body, '{fx.ARXIV}')) FROM t
        UNION ALL SELECT id, 'term', regexp_extract(body, '{fx.DEFINITION}', 1) FROM t WHERE regexp_matches(body, '{fx.DEFINITION}')
           AND lower(regexp_extract(body, '{fx.DEFINITION}', 1)) NOT IN {fx.DEFINITION_STOP}""",
)
def inline_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, 'WHY: [[Ring Plan|plan]] and [x](http://a.b/c "t") see [12], §2.1 and Table 3'),
        (2, "Owners MUST NOT or SHOULD wait. DECISION: go. ADR-7"),
        (3, "Grace period: ten days for arXiv:2101.00001 and 10.1000/xyz"),
        (4, "Note: nothing here"),
    ]
    return structure.inline_signals(spark.createDataFrame(rows, "id int, body string"), "id", "body")


@_c.add("reply_threads", """SELECT conv_id, turn, role, lag(turn) OVER w AS replies_to, lag(role) OVER w AS replies_to_speaker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tools.reply_threads(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@_c.add(
    "transcript_turns",
    r"""WITH t(line) AS (VALUES ('[2026-08-01 10:00] Ann: hello there'), ('Bo: fine: thanks'), ('no turn here'), ('  '), ('A very long speaker name that is over forty signs: x'))
        SELECT trim(regexp_extract(line, '^(?:\[([^\]]+)\]\s*)?([^:\n]{1,40}):\s(.*)$', 1)) AS at, trim(regexp_extract(line, '^(?:\[([^\]]+)\]\s*)?([^:\n]{1,40}):\s(.*)$', 2)) AS speaker,
        trim(regexp_extract(line, '^(?:\[([^\]]+)\]\s*)?([^:\n]{1,40}):\s(.*)$', 3)) AS message FROM t WHERE regexp_matches(line, '^(?:\[([^\]]+)\]\s*)?([^:\n]{1,40}):\s(.*)$')""",
)
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("[2026-08-01 10:00] Ann: hello there",), ("Bo: fine: thanks",), ("no turn here",), ("  ",), ("A very long speaker name that is over forty signs: x",)]
    return structure.turns(spark.createDataFrame(rows, "line string"), "line").select("at", "speaker", "message")


@_c.add(
    "section_asof",
    """SELECT o_orderkey AS id, o_custkey AS doc, (SELECT max(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderkey <= o.o_orderkey AND o2.o_orderstatus = 'F') AS heading FROM orders o""",
)
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    points = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"))
    marks = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("heading"))
    return intervals.last_before(points, marks, "doc", "id", "at", "heading")


@_c.add(
    "nearest_mention_asof",
    """WITH p AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase'), m AS (SELECT event_id AS "at", user_id FROM events WHERE event_type = 'view')
       SELECT user_id, event_id, (SELECT max(m."at") FROM m WHERE m.user_id = p.user_id AND m."at" <= p.event_id) AS before, (SELECT min(m."at") FROM m WHERE m.user_id = p.user_id AND m."at" >= p.event_id) AS after FROM p""",
)
def nearest_mention_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    points = e.filter("event_type = 'purchase'").select("user_id", "event_id")
    marks = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("before"))
    near = intervals.last_before(points, marks, "user_id", "event_id", "at", "before")
    return intervals.first_after(near, marks.withColumnRenamed("before", "after"), "user_id", "event_id", "at", "after")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("int")).alias("end"))
    return li.filter("id <= 2"), li.filter("id > 2")


SPANS = """ s AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_partkey % 200 AS start, l_partkey % 200 + CAST(l_quantity AS INT) AS "end" FROM lineitem) """


@_c.add("span_overlap_antijoin", f"""WITH {SPANS} SELECT * FROM s a WHERE id <= 2 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.id > 2 AND a.doc = b.doc AND a.start < b."end" AND b.start < a."end")""")
def span_overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _spans(spark, sf_dir)
    return intervals.not_overlapping(a, b, "doc", width=64)


@_c.add(
    "chunk_containment",
    f"""WITH {SPANS}, m AS (SELECT doc, id, start, start + 1 AS "end" FROM s WHERE id <= 2), c AS (SELECT doc, id AS chunk, start, "end" FROM s WHERE id > 2)
        SELECT m.doc, m.id, arg_min(chunk, (c."end" - c.start, chunk)) AS chunk FROM m JOIN c ON m.doc = c.doc AND c.start <= m.start AND m."end" <= c."end" GROUP BY m.doc, m.id""",
)
def chunk_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _spans(spark, sf_dir)
    return intervals.smallest_container(a.withColumn("end", F.col("start") + 1).distinct(), b.withColumnRenamed("id", "chunk"), "doc", "id", "chunk", width=64)


@_c.add("cache_misses", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tools.cache_misses(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@_c.add(
    "line_index",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
       SELECT doc_id, n - 1 AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS len FROM l""",
)
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.line_index(read(spark, sf_dir, "documents"), "doc_id", "text")


@_c.add(
    "paragraphs",
    r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\.\n', E'.\n\n', 'g'), '\n\n+')) AS body, generate_subscripts(string_split_regex(regexp_replace(text, '\.\n', E'.\n\n', 'g'), '\n\n+'), 1) AS n FROM documents)
        SELECT doc_id, count(*) AS n, sum(length(rtrim(body)))::BIGINT AS chars FROM p WHERE rtrim(body) <> '' GROUP BY doc_id""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"\.\n", ".\n\n"))
    return structure.paragraphs(d, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("paragraph")).alias("chars"))


@_c.add("chunks_greedy")
def chunks_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return structure.chunks(structure.paragraph_blocks(d), target=200)


@_c.add("sentences")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return structure.sentences(structure.paragraph_blocks(d))


QUERIES, SQL = _c.queries, _c.sql
