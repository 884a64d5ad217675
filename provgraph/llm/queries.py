"""Registered queries of the operators in this folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import toxicity
from .bpe_stream import transcode
from .decontaminate import find_items
from .exact_dedup import exact_dedup
from .lattice import score_documents
from .ngram_join import near_components
from .perspectives import render, rotate
from .quality import classify_quality
from .shared import table
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens


def vocabulary(name: str) -> bytes:
    """A public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(rotate(table(spark, sf_dir, "conversations")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), crossed=False))


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), batches=3, digest=True, max_runs=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_bpe_stream": op7_bpe_stream,
    "op8_perspectives": op8_perspectives,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
}

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (
                 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
                   FROM w WHERE len(w) > 0),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
             e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r AS (SELECT DISTINCT x AS doc_id, x AS reach FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) USING (doc_id)
    """,
    "op8_perspectives": r"""
        WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS content,
                          CASE WHEN role IS NULL THEN '%null' WHEN role = '' THEN '%empty'
                               ELSE replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D')
                          END AS speaker FROM conversations),
             v AS (SELECT DISTINCT conv_id AS view_conv, speaker AS perspective FROM t),
             j AS (SELECT *, speaker = perspective AS own,
                          CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
                               ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head,
                          length(head) + length(content) + 11 AS size
                   FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.view_conv),
             s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, content
                                                  ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM j)
        SELECT conv_id, perspective, s.start // 65536 AS piece, min(s.start) AS start,
               string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY s.start) AS dialogue,
               coalesce(string_agg(CASE WHEN own THEN (s.start + length(head)) || ':' || (length(content) + 11) END, ',' ORDER BY s.start), '') AS masks
        FROM s GROUP BY conv_id, perspective, s.start // 65536
    """,
    "op9_decontaminate": r"""
        WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
             w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM t),
             s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
                   FROM w WHERE len(w) > 0),
             q AS (SELECT id, count(*) AS item_shingles FROM s WHERE kind = 'i' GROUP BY id),
             p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
                   FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
        SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
        FROM p JOIN q ON q.id = item_id WHERE shared * 10 >= item_shingles * 8
    """,
    "op10_substring_dedup": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             v AS MATERIALIZED (SELECT doc_id, i AS p, array_to_string(w[i : i + 19], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 18, 1))) AS u(i)),
             f AS (SELECT s, min((doc_id, p)) AS first FROM v GROUP BY s HAVING count(*) > 1),
             c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM v JOIN f USING (s) WHERE (doc_id, p) > first),
             g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
             k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                          CASE WHEN gone IS NULL THEN w
                               ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
                   FROM t LEFT JOIN g USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
}
