"""Lexical, graph, dense and late-interaction ranking, and their fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_estimate, tokens

K1, B = 1.5, 0.75


def query_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 2]


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, dl``: the inverted index, with document lengths, from one pass."""
    t = docs.select(key, tokens(text).alias("t")).withColumn("dl", F.size("t"))
    return t.select(key, "dl", F.explode("t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, query: str, k: int | None = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: repeated query words count repeatedly.  Only query words are exploded and
    shuffled, so the cost is a scan and one aggregation of the matching rows."""
    asked = query_tokens(query)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(t, asked.count(t)) for t in sorted(set(asked))] or [("", 0)], "term string, times int")
    t = docs.select(key, tokens(text).alias("t")).select(key, "t", F.size("t").alias("dl"))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = t.select(key, "dl", F.explode(F.filter("t", lambda x: x.isin(asked or [""]))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    both = hits.join(F.broadcast(df), "term").join(F.broadcast(wanted), "term").join(F.broadcast(stats))  # as many rows as query words, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = both.groupBy(key).agg(F.sum(part).alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), key).limit(k) if k is not None else out


def cosine(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def dense_rank(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, score`` of positive cosine, best first."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, cosine(vector, asked).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def max_sim(pages: DataFrame, query: list[list[float]], key: str, vector: str) -> DataFrame:
    """``key, score``: over the query's vectors, the sum of the best dot product with any vector of
    the page.  ``pages`` has one row per page vector; each row computes all query
    vectors, and the maxima are combined on the map side."""
    dots = [F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in q)), lambda p, r: p.cast("double") * r), F.lit(0.0), lambda s, v: s + v) for q in query]
    best = pages.select(key, *(d.alias(f"q{i}") for i, d in enumerate(dots))).groupBy(key).agg(*(F.max(f"q{i}").alias(f"q{i}") for i in range(len(query))))
    total = F.lit(0.0)
    for i in range(len(query)):
        total = total + F.col(f"q{i}")
    return best.select(key, total.alias("score"))


def fuse(rankings: list[DataFrame], key: str, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``key, score`` lists: the sum of 1 / (60 + rank from 0)."""
    out = None
    for ranking in rankings:
        rank = F.row_number().over(W.orderBy(F.desc("score"), key)) - 1  # a list is cut to a few rows before
        own = ranking.select(key, rank.alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"))


def rerank(hits: DataFrame, query: str, k: int, key: str = "id") -> DataFrame:
    """``hits(id, kind, name, score)``: word overlap lifts a hit within its kind by 0.02 each, then
    kinds alternate."""
    asked = F.array(*(F.lit(t) for t in sorted(set(query_tokens(query))))) if query_tokens(query) else F.array().cast("array<string>")
    lifted = hits.withColumn("lifted", F.col("score") + 0.02 * F.size(F.array_intersect(tokens("name"), asked)))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("lifted"), key))
    return lifted.withColumn("rank", rank).orderBy("rank", F.desc("kind"), key).limit(k).select(key, "kind", "rank", F.round("lifted", 6).alias("lifted"))


def within_budget(hits: DataFrame, order: list[Column], text: str, budget: int, partition: list[str] | None = None) -> DataFrame:
    """The hits, in order, whose running token estimate stays within the budget; the first always."""
    w = W.partitionBy(*(partition or [])).orderBy(*order)
    cost = hits.withColumn("cost", token_estimate(text))
    kept = cost.withColumns({"position": F.row_number().over(w), "running": F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return kept.filter((F.col("running") <= budget) | (F.col("position") == 1))


def page_texts(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """A document's chunks in order, joined by line ends."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda c: c[text]), "\n").alias("page"))


def ppr_seeds(query: str, entities: DataFrame, chunk_scores: DataFrame, mentions: DataFrame) -> DataFrame:
    """``node_id, seed``: shared words per entity, the chunk's lexical score, and half of it for each
    entity that the chunk mentions."""
    asked = query_tokens(query)
    own = entities.select("node_id", F.size(F.filter(F.array_distinct(tokens("name")), lambda t: t.isin(asked or [""]))).cast("double").alias("seed")).filter("seed > 0")
    lexical = chunk_scores.select(F.col("node_id"), F.col("score").alias("seed"))
    passed = mentions.select("chunk", "entity").join(chunk_scores.withColumnRenamed("node_id", "chunk"), "chunk").select(F.col("entity").alias("node_id"), (F.col("score") * 0.5).alias("seed"))
    return own.unionByName(lexical).unionByName(passed).groupBy("node_id").agg(F.sum("seed").alias("seed"))


def hash_embedding(text: str, size: int = 256) -> list[float]:
    """Signed hash of each word, normalised."""
    out = np.zeros(size)
    for t in query_tokens(text or ""):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "big") % size] += 1.0 if d[4] & 1 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding_column(texts: pd.Series) -> pd.Series:
    return texts.map(hash_embedding)


def word_vectors(text: str, size: int = 48) -> list[list[float]]:
    """One normalised vector per word, from an extendable hash."""
    out = []
    for t in query_tokens(text or ""):
        v = np.frombuffer(hashlib.shake_256(t.encode()).digest(size), np.uint8) / 127.5 - 1
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def embed_missing(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """``key, vector`` for the texts whose digest isn't cached."""
    keyed = texts.select(F.sha2(text, 256).alias("key"), text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vector": pdf[text].map(hash_embedding)})

    return keyed.mapInPandas(run, "key string, vector array<double>")


def retrieval_quality(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``recall_at_k, mrr`` of ``query, id, rank`` against ``query, id``."""
    n = gold.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.filter(F.col("rank") <= k).join(gold, ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    per = n.join(hit, "query", "left").select(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    return per.agg(F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("rr"), 6).alias("mrr"))
