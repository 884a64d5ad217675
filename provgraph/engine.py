"""A thin facade over the operators: one object, the tools by name."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build as builds
from .functions import text as fx
from .operators import analytics, claims, graph_tools, paths, retrieval, security, structure
from .plans import gql
from .sinks import ontology, rdf, store

TOOLS = ("search", "neighbors", "path", "why", "inspect", "timeline", "contradictions", "conflicts", "trace", "decisions", "communities", "stats", "gql", "vision")


class Engine:
    """Answers over a graph's nodes and edges; with a policy, over what its context may see: the
    tables are masked first and every tool, queries included, works on what is left."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None = None):
        self.nodes, self.edges, self.chunks = nodes, edges, chunks
        self._scores: DataFrame | None = None

    @staticmethod
    def from_graph(graph: builds.Graph) -> Engine:
        return Engine(graph.nodes, graph.edges, graph.chunks)

    @staticmethod
    def from_path(spark: SparkSession, path: str) -> Engine:
        return Engine.from_graph(builds.build(spark, path))

    def restricted(self, docs: DataFrame, tuples: DataFrame, policy: security.Policy, context: security.Context) -> Engine:
        """The engine for a context; ``docs(doc_id, label)``."""
        allowed = analytics.cut(security.authorized_docs(docs, tuples, policy, context).select("doc_id").distinct())
        cited = self.edges.select("subject", "object", F.explode("source_spans").alias("s"))
        seen = cited.select(F.explode(F.array("subject", "object")).alias("node_id"), F.col("s.doc_id").alias("doc_id"))
        own = self.edges.withColumn("doc_id", F.explode(F.transform("source_spans", lambda s: s["doc_id"]))).dropDuplicates(["edge_id", "doc_id"])
        nodes, edges = security.visible_graph(self.nodes, own, seen.distinct(), allowed)
        edges = edges.dropDuplicates(["edge_id"]).withColumn("source_spans", F.col("source_spans")).drop("doc_id")
        chunks = self.chunks.join(allowed, "doc_id", "left_semi") if self.chunks is not None else None
        return Engine(analytics.cut(nodes), analytics.cut(edges), chunks)

    @property
    def entities(self) -> DataFrame:
        return self.nodes.filter(F.array_contains("labels", "Entity") | F.array_contains("labels", "Canonical"))

    @property
    def relations(self) -> DataFrame:
        return self.edges.filter(~F.col("predicate").isin(*graph_tools.PLUMBING, "HAS_CHUNK", "CONTAINS"))

    def scores(self) -> DataFrame:
        if self._scores is None:
            adj = analytics.adjacency(self.entities, analytics.entity_weights(self.relations))
            self._scores = analytics.cut(analytics.pagerank(self.entities, adj, iterations=50, tolerance=1e-9))
        return self._scores

    def resolve(self, name: str) -> str | None:
        row = graph_tools.resolve_name(self.entities, self.scores(), name).first()
        return row.node_id if row else None

    def gql(self, text: str) -> DataFrame:
        return gql.run(text, self.nodes, self.edges)

    def search(self, query: str, k: int = 5, budget: int = 1500) -> DataFrame:
        """Lexical, graph and dense ranks of chunks and entities, fused, reranked and cut to a budget; ``routing`` is
        ``local`` where the question names an entity that the walk ranks, else ``global``."""
        wide = max(2 * k, 10)
        chunks = self.nodes.filter(F.array_contains("labels", "Chunk")).select("node_id", F.col("props")["text"].alias("text"))
        lexical = analytics.cut(retrieval.bm25(chunks, query, wide, key="node_id"))
        asked = retrieval.hash_embedding(query)
        dense = retrieval.dense_rank(chunks.select("node_id", retrieval.hash_embedding_column("text").alias("v")), asked, wide, key="node_id", vector="v")
        mentions = self.edges.filter("predicate = 'MENTIONS'").join(self.edges.filter("predicate = 'HAS_CHUNK'").select("subject", F.col("object").alias("chunk")), "subject").select("chunk", F.col("object").alias("entity"))
        seeds = analytics.cut(retrieval.ppr_seeds(query, self.entities, lexical, mentions))
        both = self.entities.select("node_id").unionByName(chunks.select("node_id"))
        links = self.edges.filter(~F.col("predicate").isin("SUBJECT_OF", "HAS_OBJECT")).withColumn("weight", F.greatest(F.lit(1e-6), "confidence"))
        adj = analytics.adjacency(both, links).unionByName(mentions.select(F.col("chunk").alias("a"), F.col("entity").alias("b"), F.lit(0.9).alias("w"))).unionByName(mentions.select(F.col("entity").alias("a"), F.col("chunk").alias("b"), F.lit(0.9).alias("w")))
        # Without a seed there is nowhere to walk from: the graph's list stays empty.
        walked = analytics.cut(analytics.pagerank(both, adj, iterations=15, seeds=seeds)) if seeds.limit(1).count() else seeds.select("node_id", F.col("seed").alias("score"))
        top = walked.join(self.entities.select("node_id"), "node_id", "left_semi").filter("score > 0").orderBy(F.desc("score"), "node_id").limit(wide)
        fused = retrieval.fuse([lexical, top, dense], "node_id").orderBy(F.desc("score"), "node_id").limit(max(4 * k, 24))
        kind = F.when(F.array_contains("labels", "Chunk"), "chunk").otherwise("entity")
        named = fused.join(self.nodes.select("node_id", kind.alias("kind"), F.coalesce(F.col("props")["text"], "name").alias("name")), "node_id").withColumnRenamed("node_id", "id")
        hits = retrieval.rerank(named, query, k).join(named.select("id", "name"), "id")
        routed = self.resolve(query)
        routing = "local" if routed and not top.filter(F.col("node_id") == routed).isEmpty() else "global"
        return retrieval.within_budget(hits, [F.col("rank"), F.desc("kind"), F.col("id")], "name", budget).withColumn("routing", F.lit(routing)).orderBy("position")

    def neighbors(self, name: str, k: int = 20) -> DataFrame:
        return graph_tools.neighbors(self.nodes, self.edges, self.resolve(name) or name, k)

    def path(self, start: str, goal: str, k: int = 1) -> DataFrame:
        return paths.k_best(self.relations, self.resolve(start) or start, self.resolve(goal) or goal, k)

    def claims(self) -> DataFrame:
        """Claim nodes with their ends."""
        ends = self.edges.filter("predicate = 'SUBJECT_OF'").select(F.col("object").alias("claim_id"), "subject", "confidence")
        objects = self.edges.filter("predicate = 'HAS_OBJECT'").select(F.col("subject").alias("claim_id"), "object")
        own = self.nodes.filter(F.array_contains("labels", "Claim")).select(F.col("node_id").alias("claim_id"), F.split("name", " ")[0].alias("_"), "name", *(F.col("props")[c].alias(c) for c in ("polarity", "modality", "t_valid", "t_invalid")))
        return own.join(ends, "claim_id").join(objects, "claim_id").withColumn("predicate", F.regexp_extract("name", r" ([A-Z_]+) ", 1)).drop("_", "name")

    def why(self, name: str, k: int = 8) -> DataFrame:
        return claims.why(self.claims(), self.resolve(name) or name, k)

    def rationale(self, name: str, most: int = 5) -> DataFrame:
        """Names of the rationale marks in the documents that a node's claims cite (in all, if they cite none)."""
        cites = self.edges.filter("predicate in ('SUBJECT_OF', 'HAS_OBJECT')").select(F.when(F.col("predicate") == "SUBJECT_OF", F.col("object")).otherwise(F.col("subject")).alias("claim_id"), F.explode("source_spans").alias("s"))
        docs = analytics.cut(cites.join(claims.why(self.claims(), self.resolve(name) or name, None), "claim_id", "left_semi").select(F.col("s.doc_id").alias("doc_id")).distinct())
        return claims.rationale_names(self.nodes, self.edges, docs, most)

    def timeline(self, name: str) -> DataFrame:
        return claims.timeline(self.claims(), self.resolve(name) or name)

    def inspect(self, name: str) -> DataFrame:
        """``section, key, value``: tags of a node's relations, its canonical node and that one's members, the documents that
        cite it, and its claims, those with an end as superseded."""
        at = self.resolve(name) or name
        touching = (F.col("subject") == at) | (F.col("object") == at)
        tags = graph_tools.tag_counts(self.relations.filter(touching))
        same = self.edges.filter("predicate = 'SAME_AS'")
        own = same.filter(F.col("subject") == at).select(F.col("object").alias("canonical"))
        members = same.join(own, F.col("object") == F.col("canonical"), "left_semi").select(F.col("subject").alias("node_id")).join(self.nodes.select("node_id", "name"), "node_id")
        cited = self.edges.filter(touching).select(F.explode("source_spans").alias("s")).select(F.col("s.doc_id").alias("doc_id")).distinct()
        about = claims.timeline(self.claims().withColumn("predicate", F.concat_ws(" ", "subject", "predicate", "object")), at, "t_invalid")
        ended = F.when(F.col("t_invalid").isNotNull(), "superseded").otherwise("claim")
        rows = [
            tags.select(F.lit("tag").alias("section"), F.col(tags.columns[0]).cast("string").alias("key"), F.col(tags.columns[-1]).cast("string").alias("value")),
            own.join(self.nodes.select(F.col("node_id").alias("canonical"), "name"), "canonical").select(F.lit("canonical"), "canonical", "name"),
            members.select(F.lit("member"), "node_id", "name"),
            cited.select(F.lit("document"), "doc_id", F.lit(None).cast("string")),
            about.select(ended, "claim_id", "predicate"),
        ]
        out = rows[0]
        for more in rows[1:]:
            out = out.union(more)
        return out.orderBy("section", "key")

    def contradictions(self) -> DataFrame:
        return self.edges.filter("predicate = 'CONTRADICTS'").select("subject", "object", "confidence")

    def conflicts(self) -> DataFrame:
        own = self.nodes.filter(F.array_contains("labels", "Conflict")).select("node_id", "name", F.col("props")["severity"].alias("severity"))
        n = self.edges.filter("predicate = 'CONTENDS'").groupBy(F.col("subject").alias("node_id")).agg(F.count(F.lit(1)).alias("claims"))
        return own.join(n, "node_id").filter("claims >= 2").orderBy("severity", "name")

    def decisions(self) -> DataFrame:
        marks = self.nodes.filter(F.array_contains("labels", "Rationale"))
        cited = self.edges.filter("predicate = 'APPLIES_TO'").select(F.col("subject").alias("node_id"), F.col("source_spans")[0].alias("s"))
        placed = marks.select("node_id", "name").join(cited, "node_id")
        line = placed.join(self.chunks.select("doc_id", F.col("start").alias("cs"), F.col("end").alias("ce"), "text"), (F.col("s.doc_id") == F.col("doc_id")) & (F.col("s.start") >= F.col("cs")) & (F.col("s.start") < F.col("ce"))) if self.chunks is not None else placed
        return structure.decisions(line.select(F.col("node_id").alias("id"), F.col("name").alias("marker"), F.coalesce("text", "name").alias("line") if self.chunks is not None else F.col("name").alias("line"), F.col("s.doc_id").alias("doc_id")))

    def trace(self, decision: str) -> DataFrame:
        return structure.trace(structure.causal_links(self.decisions()), decision)

    def find_decisions(self, query: str, k: int = 5) -> DataFrame:
        return retrieval.bm25(self.decisions(), query, k, key="id", text="line")

    def communities(self, k: int = 8) -> DataFrame:
        adj = analytics.adjacency(self.entities, analytics.entity_weights(self.relations))
        return analytics.community_rosters(analytics.label_propagation(self.entities, adj), self.scores(), k)

    def vision(self, query: str, k: int = 5) -> DataFrame:
        """Late interaction over pages of hashed word vectors."""
        pages = retrieval.page_texts(self.chunks, "doc_id", "index", "text")
        words = pages.select("doc_id", F.explode(F.array_distinct(fx.tokens("page"))).alias("word"))
        vector = F.pandas_udf(lambda s: s.map(lambda w: (retrieval.word_vectors(w) or [[0.0] * 48])[0]), "array<double>")
        scored = retrieval.max_sim(words.select("doc_id", vector("word").alias("v")), retrieval.word_vectors(query), "doc_id", "v")
        return scored.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)

    def stats(self) -> DataFrame:
        return graph_tools.graph_stats(self.nodes, self.edges)

    def export(self, what: str, path: str) -> None:
        if what == "parquet":
            store.write_store(self.nodes, self.edges, path)
        elif what == "turtle":
            rdf.write_turtle(self.nodes, self.edges, path)
        elif what == "owl":
            ontology.owl_lines(self.nodes, self.edges).orderBy("line").write.mode("overwrite").text(path)
        elif what == "shacl":
            ontology.shacl_lines(self.nodes, ["name"]).orderBy("line").write.mode("overwrite").text(path)
        elif what == "json":
            store.graph_lines(self.nodes, self.edges).select("json").write.mode("overwrite").text(path)
        else:
            raise ValueError(f"unknown export {what!r}")

    def call(self, tool: str, **arguments: Any) -> DataFrame:
        """A tool by name, as agents and servers call it."""
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool!r}; there are {', '.join(TOOLS)}")
        return getattr(self, {"decisions": "find_decisions"}.get(tool, tool))(**arguments)
