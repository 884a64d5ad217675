"""Graphs as Parquet, canonical JSON, reports and records for other tools."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Keys in order, no spaces, UTF-8, no NaN, one line end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def write_store(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces the stored graph; edges are laid out by predicate, so that typed hops read only theirs.

    The new tables are written beside the old ones and take their names when both are complete, so a graph can be
    written where it was read from.
    """
    spark, staged = nodes.sparkSession, f"{path}/staged-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{staged}/nodes")
    edges.write.partitionBy("predicate").parquet(f"{staged}/edges")
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("nodes", "edges"):
        files.delete(at(f"{path}/{name}"), True)
        if not files.rename(at(f"{staged}/{name}"), at(f"{path}/{name}")):
            raise OSError(f"{staged}/{name} could not take the place of {path}/{name}")
    files.delete(at(staged), True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key isn't in the new ones, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON records in a stable order, for a distributed text sink; map keys are sorted."""

    def ordered(frame: DataFrame) -> DataFrame:
        maps = {c: F.map_from_entries(F.array_sort(F.map_entries(c))) for c, t in frame.dtypes if t.startswith("map")}
        return frame.withColumns(maps) if maps else frame

    n = ordered(nodes).select(F.lit("node").alias("part"), F.col("node_id").alias("id"), F.to_json(F.struct(*sorted(nodes.columns))).alias("json"))
    e = ordered(edges).select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), F.to_json(F.struct(*sorted(edges.columns))).alias("json"))
    return n.unionByName(e).orderBy(F.desc("part"), "id")


def graph_json(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> str:
    """One canonical JSON document; for graphs that fit the driver (over ``most`` rows it refuses,
    use ``graph_lines``)."""
    lines = graph_lines(nodes, edges).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"more than {most} nodes and edges: write graph_lines instead")
    parts: dict[str, list] = {"node": [], "edge": []}
    for row in lines:
        parts[row.part].append(json.loads(row.json))
    tags: dict[str, int] = {}
    for e in parts["edge"]:
        tags[e.get("tag", "")] = tags.get(e.get("tag", ""), 0) + 1
    return canonical_json({"stats": {"nodes": len(parts["node"]), "edges": len(parts["edge"]), "tags": tags}, "nodes": parts["node"], "edges": parts["edge"]})


def coverage(documents: DataFrame, edges: DataFrame) -> dict[str, int]:
    """How many documents there are, how many of them an edge cites, and how many edges cite any."""
    cited = edges.select("edge_id", F.explode("source_spans").alias("s")).select("edge_id", F.col("s.doc_id").alias("doc_id"))
    known = cited.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    row = known.agg(F.countDistinct("doc_id").alias("documents_cited"), F.countDistinct("edge_id").alias("edges_citing")).first()
    return {"documents": documents.select("doc_id").distinct().count(), "edges": edges.count(), **row.asDict()}


def manifest(config: dict[str, Any], stages: list[dict[str, Any]], covered: dict[str, int] | None = None) -> str:
    """Version, a digest of the configuration, the stages with their times and counts, and the coverage."""
    import hashlib

    digest = hashlib.sha256(canonical_json(config).encode()).hexdigest()
    return canonical_json({"tool_version": "0.1.0", "config_hash": digest, "stages": stages} | ({"coverage": covered} if covered else {}))


#: Questions about the busiest nodes of a label, and how many of them.
ASK = {
    "Organization": ("How does {} relate to the others, and on what grounds?", 2), "Person": ("Whom does {} direct or speak for?", 2), "Rationale": ("What led to \"{}\"?", 1),
    "Requirement": ("Where does the corpus ask for \"{}\"?", 1), "Term": ("How is {} defined?", 1), "Section": ("What is said under \"{}\"?", 1), "Participant": ("What did {} say, and to whom?", 1),
    "Conflict": ("Which sources disagree: {}?", 1),
}
ASK_ALWAYS = ("Which nodes hold the graph together?", "Which claims were superseded, and by what?", "Which documents contradict each other?", "What was decided, and what followed?", "Who controls whom?", "Where did money go?", "What do the communities stand for?", "Which nodes have no links?", "Which sources are cited most?", "What changed last?")


def questions(nodes: DataFrame, edges: DataFrame, most: int = 10) -> list[str]:
    """Questions that the graph can answer: about its busiest nodes by label, then general ones."""
    from ..operators.graph_tools import degrees

    named = nodes.select("node_id", "name", F.explode("labels").alias("label")).filter(F.col("label").isin(list(ASK)) & F.col("name").isNotNull())
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "name", "node_id"))
    top = named.join(degrees(edges), "node_id").withColumn("place", place).filter(F.col("place") <= max(n for _, n in ASK.values())).collect()  # a few per label
    rows = {(r.label, r.place): r["name"] for r in top}
    asked = [text.format(rows[label, i]) for label, (text, n) in ASK.items() for i in range(1, n + 1) if (label, i) in rows]
    return list(dict.fromkeys([*asked, *ASK_ALWAYS]))[:most]


def report(nodes: DataFrame, edges: DataFrame, k: int = 10) -> str:
    """A Markdown report: counts, busiest nodes, conflicts, and questions worth asking."""
    from ..operators.graph_tools import graph_stats, top_degrees

    out = ["# Graph report", "", "## Counts", ""]
    out += [f"- {r.kind} {r['name']}: {r.n}".replace("  ", " ") for r in graph_stats(nodes, edges).orderBy("kind", F.desc("n"), "name").limit(60).collect()]
    top = top_degrees(nodes.filter(F.array_contains("labels", "Entity")), edges, k).collect()
    out += ["", "## Most connected", "", *[f"- {r.name} ({r.degree})" for r in top]]
    open_ = nodes.filter(F.array_contains("labels", "Conflict")).orderBy("name").limit(k).collect()
    out += ["", "## Conflicts", "", *([f"- {r.name}" for r in open_] or ["- none"])]
    return "\n".join([*out, "", "## Questions", "", *[f"{i}. {q}" for i, q in enumerate(questions(nodes, edges), 1)], ""])


def html_page(nodes: DataFrame, edges: DataFrame, most: int = 2_000) -> str:
    """A page that holds the graph's data and lists it, without further files."""
    data = graph_json(nodes.limit(most), edges.limit(most)).replace("</", "<\\/")
    script = "const g=JSON.parse(document.getElementById('g').textContent);document.getElementById('n').innerHTML=g.nodes.map(n=>'<li>'+String(n.name).replace(/[<&]/g,'')+'</li>').join('')"
    return f"<!doctype html><meta charset=utf-8><title>graph</title><script id=g type=application/json>{data}</script><ul id=n></ul><script>{script}</script>\n"


def records(hits: DataFrame) -> list[dict[str, Any]]:
    """Search hits as plain dictionaries with their citations, as retrieval frameworks take them."""
    return [{"page_content": r["name"], "metadata": {k: v for k, v in r.asDict(recursive=True).items() if k != "name"}} for r in hits.toLocalIterator()]
