"""A training-corpus pipeline of five operators, each stage over all rows that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame with the columns of ``documents``, except the last, which returns
``doc_id, n_tokens, ids, decoded``.  All decisions are about rows: of copies one row stays, whatever ids repeat or
are null, and no text goes because another one has its id.

Cases: null and empty texts are copies of one another, toxic only if an empty text is, and hold no benchmark item; texts of any length are read
whole; ties are settled by the operators (least id, then least row); empty tables give empty results; a table ``labels`` without
rows of both kinds keeps every document; further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provgraph.llm import toxicity
from provgraph.llm.bpe_stream import transcode
from provgraph.llm.decontaminate import drop_contaminated
from provgraph.llm.exact_dedup import drop_copies
from provgraph.llm.ngram_join import drop_near_copies
from provgraph.llm.queries import vocabulary
from provgraph.llm.shared import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transcode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
