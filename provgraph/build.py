"""A corpus folder to a provenance graph: the whole build as one plan of tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ids import content_id
from .operators import analytics, claims, extraction, resolution, structure
from .operators.graph_tools import merge_layers
from .sources import corpus


@dataclass
class Graph:
    """The tables of a built graph."""

    documents: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    claims: DataFrame
    conflicts: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stages: list[dict] = field(default_factory=list)  # what each stage took, for the manifest


NODE = ["node_id", "labels", "name", "props"]
EDGE = ["edge_id", "subject", "predicate", "object", "tag", "confidence", "evidence_count", "source_spans", "props"]
SPANS = "array<struct<doc_id:string,start:bigint,end:bigint>>"


def _nodes(frame: DataFrame, label: str, **props: str) -> DataFrame:
    pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    labels = F.array(F.lit("Entity"), F.col("etype")) if label == "Entity" else F.array(F.lit(label))
    return frame.select("node_id", labels.alias("labels"), F.col("name").cast("string").alias("name"), table.cast("map<string,string>").alias("props"))


def _edges(frame: DataFrame, tag: str = "STRUCTURAL", confidence: float = 1.0, **props: str) -> DataFrame:
    from .ids import edge_id

    have = frame.columns
    pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    spans = F.col("source_spans") if "source_spans" in have else F.array(F.struct("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return frame.select(
        F.col("edge_id") if "edge_id" in have else edge_id("subject", "predicate", "object", "doc_id", "start", "end").alias("edge_id"),
        "subject",
        "predicate",
        "object",
        (F.col("tag") if "tag" in have else F.lit(tag)).alias("tag"),
        (F.col("confidence") if "confidence" in have else F.lit(confidence)).alias("confidence"),
        (F.col("evidence_count") if "evidence_count" in have else F.lit(1)).cast("long").alias("evidence_count"),
        spans.cast(SPANS).alias("source_spans"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("props"),
    )


def structural(documents: DataFrame, blocks: DataFrame, chunk_table: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes and edges that the documents' own structure states."""
    doc = F.concat(F.lit("doc:"), "doc_id")
    nodes = [_nodes(documents.select(doc.alias("node_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", "format"), "Document", path="path", format="format")]
    edges: list[DataFrame] = []
    heads = blocks.filter("kind = 'heading'").withColumn("node_id", content_id("section", "doc_id", "start", "end", "text"))
    nodes.append(_nodes(heads.withColumn("name", F.col("text")), "Section", level="level"))
    edges.append(_edges(heads.select(doc.alias("subject"), F.lit("CONTAINS").alias("predicate"), F.col("node_id").alias("object"), "doc_id", "start", "end")))

    prose = blocks.filter(F.col("kind").isin("heading", "paragraph", "list_item", "quote", "transcript_turn") & (F.col("text") != ""))
    row = F.concat_ws("|", "doc_id", F.col("start").cast("string"), F.col("end").cast("string")).alias("row")
    found = structure.inline_signals(prose.select(row, "text").distinct(), "row", "text")
    part = F.split("row", "\\|")
    found = found.select("kind", "value", part[0].alias("doc_id"), part[1].cast("int").alias("start"), part[2].cast("int").alias("end"))
    key = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    local = F.concat_ws(":", "kind", "doc_id", key)
    marker = content_id("mark", "kind", "doc_id", "start", "value")
    targets = F.when(F.col("kind").isin("wikilink", "link", "url"), F.concat(F.lit("ref:"), key)).when(F.col("kind").isin("doi", "arxiv"), F.concat_ws(":", F.lit("ref"), "kind", key)).when(F.col("kind") == "term", F.concat(F.lit("term:"), key)).when(F.col("kind").isin("citation", "xref"), local).otherwise(marker)
    labels = {"wikilink": "Reference", "link": "Reference", "url": "Reference", "citation": "Citation", "doi": "Work", "arxiv": "Work", "xref": "CrossRef", "rationale": "Rationale", "requirement": "Requirement", "term": "Term"}
    verbs = {"wikilink": "LINKS_TO", "link": "LINKS_TO", "url": "LINKS_TO", "citation": "CITES", "doi": "CITES", "arxiv": "CITES", "xref": "REFERENCES", "rationale": "APPLIES_TO", "requirement": "STATES_REQUIREMENT", "term": "DEFINES"}
    named = found.withColumns({"node_id": targets, "label": F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("kind")], "verb": F.create_map(*(F.lit(x) for kv in verbs.items() for x in kv))[F.col("kind")]})
    nodes.append(named.groupBy("node_id", "label").agg(F.min("value").alias("name"), F.min("kind").alias("kind")).select("node_id", F.array("label").alias("labels"), "name", F.create_map(F.lit("kind"), "kind").alias("props")))
    backwards = F.col("kind") == "rationale"
    edges.append(_edges(named.select(F.when(backwards, F.col("node_id")).otherwise(doc).alias("subject"), F.col("verb").alias("predicate"), F.when(backwards, doc).otherwise(F.col("node_id")).alias("object"), "doc_id", "start", "end")))

    turns = blocks.filter("kind = 'transcript_turn'").withColumns({"speaker": F.col("props")["speaker"], "said": F.col("props")["message"]})
    turns = turns.withColumns({"message": content_id("message", "doc_id", "start"), "person": F.concat(F.lit("participant:"), F.lower(F.trim("speaker")))})
    nodes.append(_nodes(turns.select(F.col("person").alias("node_id"), F.col("speaker").alias("name")).dropDuplicates(["node_id"]), "Participant"))
    nodes.append(_nodes(turns.select(F.col("message").alias("node_id"), F.substring("said", 1, 200).alias("name"), "speaker"), "Message", speaker="speaker"))
    edges.append(_edges(turns.select(F.col("message").alias("subject"), F.lit("SENT_BY").alias("predicate"), F.col("person").alias("object"), "doc_id", "start", "end")))
    edges.append(_edges(turns.select(F.col("person").alias("subject"), F.lit("PARTICIPANT").alias("predicate"), doc.alias("object"), "doc_id", "start", "end")))
    from pyspark.sql import Window as W

    replies = turns.withColumn("object", F.lag("message").over(W.partitionBy("doc_id").orderBy("start"))).filter("object is not null")
    edges.append(_edges(replies.select(F.col("message").alias("subject"), F.lit("REPLIES_TO").alias("predicate"), "object", "doc_id", "start", "end")))

    logs = blocks.filter("kind = 'log_line'").groupBy("doc_id", F.col("props")["template"].alias("name")).agg(F.count(F.lit(1)).alias("evidence_count"), F.min(F.struct("start", "end")).alias("s")).select("doc_id", "name", "evidence_count", "s.start", "s.end")
    logs = logs.withColumn("node_id", content_id("logtpl", "name"))
    nodes.append(_nodes(logs.select("node_id", "name").distinct(), "LogTemplate"))
    edges.append(_edges(logs.select(doc.alias("subject"), F.lit("EMITS").alias("predicate"), F.col("node_id").alias("object"), "doc_id", "start", "end", "evidence_count")))
    leaves = blocks.filter("kind = 'field'").withColumns({"node_id": content_id("field", "doc_id", F.col("props")["path"]), "name": F.col("props")["path"], "value": F.col("props")["value"]})
    nodes.append(_nodes(leaves, "Field", value="value"))
    edges.append(_edges(leaves.select(doc.alias("subject"), F.lit("HAS_FIELD").alias("predicate"), F.col("node_id").alias("object"), "doc_id", "start", "end")))
    nodes.append(_nodes(chunk_table.withColumn("name", F.substring("text", 1, 80)), "Chunk", text="text", index="index"))
    edges.append(_edges(chunk_table.select(doc.alias("subject"), F.lit("HAS_CHUNK").alias("predicate"), F.col("node_id").alias("object"), "doc_id", "start", "end")))
    return nodes, edges


def build(spark: SparkSession, path: str, strategy: str | None = None) -> Graph:
    """Reads a folder and returns the graph's tables, lazily; ``strategy`` also resolves conflicts."""
    from .ids import chunk_id

    stages: list[dict] = []
    began = time.perf_counter()

    def done(layer: str) -> None:
        stages.append({"layer": layer, "wall_ms": round((time.perf_counter() - began) * 1000) - sum(s["wall_ms"] for s in stages)})

    files = corpus.list_corpus(spark, path)
    documents, blocks = corpus.ingest(files)
    documents, blocks = analytics.cut(documents.dropDuplicates(["doc_id"])), analytics.cut(blocks.dropDuplicates(["doc_id", "ord"]))
    done("reading")
    chunk_table = structure.chunks(blocks, texts=documents).withColumn("node_id", chunk_id("doc_id", "start", "end", "breadcrumb"))
    nodes, edges = structural(documents, blocks, chunk_table)

    mentions = analytics.cut(extraction.extract_mentions(documents, blocks))
    found = analytics.cut(extraction.extract_relations(documents, blocks))
    done("extraction")
    ents = extraction.entities(mentions)
    nodes.append(_nodes(ents, "Entity", mention_count="mention_count", etype="etype"))
    edges.append(_edges(extraction.mention_edges(mentions)))
    rel = extraction.relation_edges(found)
    edges.append(_edges(rel, polarity="polarity", modality="modality", amount="amount"))

    recs = resolution.records(ents.select(F.col("node_id").alias("id"), "etype", "name"))
    links = rel.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    pairs = resolution.shared_neighbors(resolution.candidate_pairs(resolution.blocking_keys(recs)), links)
    scored = resolution.score_pairs(resolution.pair_features(pairs, recs))
    clustered = resolution.clusters(recs, scored).join(recs.select("id", "name", "etype"), "id")
    names = resolution.canonical_names(clustered).filter("size > 1")
    members = clustered.join(names, "cluster").withColumn("canonical_id", F.concat_ws(":", F.lit("canonical"), "etype", F.lower("canonical")))
    spans = mentions.select(F.concat_ws(":", F.lit("entity"), "etype", "norm").alias("id"), "doc_id", "start", "end").groupBy("id").agg(F.min(F.struct("doc_id", "start", "end")).alias("s"))
    same = members.join(spans, "id").select(F.col("id").alias("subject"), F.lit("SAME_AS").alias("predicate"), F.col("canonical_id").alias("object"), "s.doc_id", "s.start", "s.end")
    same = analytics.cut(same)
    done("resolution")
    nodes.append(_nodes(members.select(F.col("canonical_id").alias("node_id"), F.col("canonical").alias("name")).dropDuplicates(["node_id"]), "Canonical"))
    edges.append(_edges(same, "INFERRED", 0.95))

    made = claims.reify(rel, ents.select("node_id")).drop("edge_id").join(rel.select("subject", "predicate", "object", F.col("source_spans")[0]["doc_id"].alias("doc_id"), F.col("source_spans")[0]["start"].alias("start"), "polarity", "modality"), ["subject", "predicate", "object", "doc_id", "start"])
    dates = mentions.filter("etype = 'Date'").select("doc_id", "start", "end", F.col("surface").alias("name"))
    dated = made.join(claims.nearest_dates(made, dates), "claim_id", "left").withColumn("t_invalid", F.lit(None).cast("string"))
    closed = claims.supersede(dated)
    final = analytics.cut(dated.drop("t_invalid").join(closed, "claim_id", "left"))
    done("claims")
    nodes.append(_nodes(final.select(F.col("claim_id").alias("node_id"), F.concat_ws(" ", "subject", "predicate", "object").alias("name"), "polarity", "modality", "t_valid", "t_invalid"), "Claim", polarity="polarity", modality="modality", t_valid="t_valid", t_invalid="t_invalid"))
    cite = final.select("claim_id", "doc_id", "start", "end")
    wires = claims.claim_edges(final).withColumn("claim_id", F.when(F.col("predicate") == "SUBJECT_OF", F.col("object")).otherwise(F.col("subject"))).join(cite, "claim_id")
    edges.append(_edges(wires.drop("claim_id"), "INFERRED"))
    edges.append(_edges(closed.join(cite, "claim_id").select(F.col("superseded_by").alias("subject"), F.lit("SUPERSEDES").alias("predicate"), F.col("claim_id").alias("object"), "doc_id", "start", "end"), "INFERRED", 0.9))
    canonical = claims.canonical_ends(final, same)
    contending = claims.contenders(claims.effective_windows(canonical))
    conflict_table = claims.conflicts(contending)
    against = contending.join(conflict_table.select("conflict_id", "subject", "predicate"), ["subject", "predicate"])
    nodes.append(_nodes(conflict_table.select(F.col("conflict_id").alias("node_id"), F.concat_ws(" ", F.lit("conflicting"), "predicate", F.lit("of"), "subject").alias("name"), "severity"), "Conflict", severity="severity"))
    edges.append(_edges(against.select(F.col("conflict_id").alias("subject"), F.lit("CONTENDS").alias("predicate"), F.col("claim_id").alias("object"), "confidence").join(cite, F.col("object") == F.col("claim_id")).drop("claim_id"), "INFERRED"))
    if strategy:
        losers = claims.demote(contending, claims.resolve(contending, strategy, documents.select("doc_id", F.lit(1.0).alias("weight"))), strategy)
        edges.append(_edges(losers.join(cite, "claim_id").select(F.col("claim_id").alias("subject"), F.lit("SUPERSEDED_BY").alias("predicate"), F.col("superseded_by").alias("object"), "doc_id", "start", "end"), "INFERRED", 0.9))
    opposed = claims.contradictions(final).select(F.col("claim_a").alias("subject"), F.lit("CONTRADICTS").alias("predicate"), F.col("claim_b").alias("object"), "confidence")
    edges.append(_edges(opposed.join(cite, F.col("subject") == F.col("claim_id")).drop("claim_id"), "INFERRED"))

    all_nodes = merge_layers([n.select(*NODE) for n in nodes], "node_id")
    all_edges = merge_layers([e.select(*EDGE) for e in edges], "edge_id")
    all_nodes, all_edges = analytics.cut(all_nodes), analytics.cut(all_edges)
    done("graph")
    tables = {"mentions": mentions, "relations": found, "same_as": same, "contending": contending}
    return Graph(documents, blocks, chunk_table, all_nodes, all_edges, final, conflict_table, tables, stages)


def entity_graph(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Entities (canonical ones too) and their weighted adjacency."""
    nodes = graph.nodes.filter(F.array_contains("labels", "Entity") | F.array_contains("labels", "Canonical"))
    edges = analytics.entity_weights(graph.edges.filter(~F.col("predicate").isin("MENTIONS")))
    return nodes, analytics.adjacency(nodes, edges)
