"""What a language model may add, through a client that the caller supplies.

A client is ``ask(prompt) -> str``.  Without one nothing is generated.  Everything
made here is tagged GENERATED, cites the chunk it came from, and is bounded by a
budget of calls; answers are cached by the digest of their prompt.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Client = Callable[[str], str]
MOST_TRIPLES, LEAST_CHARS, CONFIDENCE = 12, 40, 0.5


class Cached:
    """A client whose answers are kept in a folder, one file per prompt digest; a broken file is asked again."""

    def __init__(self, ask: Client, folder: str):
        self.ask, self.folder, self.calls = ask, folder, 0
        os.makedirs(folder, exist_ok=True)

    def __call__(self, prompt: str) -> str:
        path = os.path.join(self.folder, hashlib.sha256(prompt.encode()).hexdigest() + ".json")
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["answer"]
        except (OSError, ValueError, KeyError):
            answer = self.ask(prompt)
            self.calls += 1
            with open(path, "w", encoding="utf-8") as f:
                json.dump({"answer": answer}, f)
            return answer


def parse_triples(answer: str) -> list[tuple[str, str, str]]:
    """Triples from a JSON array, with or without a fence around it; anything else gives none."""
    inner = re.search(r"\[.*\]", answer or "", re.DOTALL)
    try:
        items = json.loads(inner.group()) if inner else []
    except ValueError:
        return []
    out = []
    for item in items:
        if isinstance(item, dict):
            item = [item.get("subject"), item.get("predicate"), item.get("object")]
        if isinstance(item, list) and len(item) == 3 and all(isinstance(x, str) and x.strip() for x in item):
            out.append((item[0].strip(), re.sub(r"\W+", "_", item[1].strip().upper()), item[2].strip()))
    return out[:MOST_TRIPLES]


def generated_relations(spark: SparkSession, chunks: DataFrame, ask: Client | None, budget: int) -> DataFrame:
    """``node_id, subject, predicate, object, tag, confidence``: for at most ``budget`` chunks of enough text."""
    rows = []
    if ask:
        for c in chunks.filter(F.length("text") >= LEAST_CHARS).orderBy("node_id").limit(budget).toLocalIterator():
            rows += [(c.node_id, *t, "GENERATED", CONFIDENCE) for t in parse_triples(ask(f"List the relations stated in this text as a JSON array of [subject, predicate, object].\n\n{c.text}"))]
    return spark.createDataFrame(rows, "node_id string, subject string, predicate string, object string, tag string, confidence double")


def summaries(spark: SparkSession, members: DataFrame, score: DataFrame, ask: Client | None, budget: int) -> DataFrame:
    """``community, summary, about``: the largest communities first, from their three members of greatest score."""
    rows = []
    if ask:
        ranked = members.join(score, "node_id").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", F.struct("score", "node_id")).alias("best"))
        place = F.row_number().over(W.partitionBy("community").orderBy(F.desc("score"), "node_id"))
        top = members.join(score, "node_id").withColumn("place", place).filter("place <= 3").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("top"))
        ranked = ranked.join(top, "community")
        for c in ranked.orderBy(F.desc("n"), "community").limit(budget).toLocalIterator():
            names = [t["name"] for t in c.top]
            rows.append((c.community, ask("Say in one sentence what connects: " + "; ".join(names)), names))
    return spark.createDataFrame(rows, "community long, summary string, about array<string>")


def narrate(question: str, passages: list[tuple[str, str]], ask: Client | None) -> str:
    """An answer from cited passages only; without a client, the passages themselves."""
    cited = "\n".join(f"[{i}] {text}" for i, (_, text) in enumerate(passages, 1))
    if not ask or not passages:
        return cited
    return ask(f"Answer from these passages only and cite them by number.\n{cited}\n\nQuestion: {question}")


def encoder_mentions(found: DataFrame, labels: dict[str, str], least: float = 0.5) -> DataFrame:
    """Mentions of an encoder model, ``doc_id, start, end, label, surface, score``, mapped to the engine's types."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    kept = found.filter(F.col("score") >= least).withColumn("etype", table[F.lower("label")]).filter("etype is not null")
    return kept.select("doc_id", "etype", "surface", "start", "end").dropDuplicates(["doc_id", "start", "end"])
