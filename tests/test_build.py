"""The whole build over small folders of our own texts."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provgraph import build as builds
from provgraph.engine import Engine
from provgraph.operators import extraction, security
from provgraph.reason import reason
from provgraph.sinks import ontology, rdf, store
from provgraph.sources import corpus

TEXTS = {
    "ledger.md": """# Ledger review

On 2026-03-04 Larch Corp transferred USD 4,000 to Rowan Ltd. It did not transfer funds to Hazel Trust.
Rowan Ltd is controlled by Alder Holdings. Dr. Mary Birch is director of Larch Corp.

## Notes

WHY: see [[Ring Plan]] and [site](http://example.org/x) [3], Table 2. Owners MUST keep records.

- first item for Larch Corporation
- second item
""",
    "adr1.md": "# ADR-1: keep tables\n\nDECISION: keep tables in Parquet.\n",
    "adr2.md": "# ADR-2: drop text SUPERSEDES ADR-1\n\nText files go.\n",
    "other.md": "On 2026-03-04 Elm Group controls Rowan Ltd. On 2026-03-04 Willow Bank controls Rowan Ltd.\n\nLarch Corp never transferred money to Rowan Ltd.\n",
    "third.txt": "On 2026-03-04 Elm Group controls Aspen Fund.\n\nOn 2026-03-04 Elm Group controls Maple Fund.\n",
    "talk.chat": "[2026-01-01 10:00] Ann: WHY: we must move\nBo: fine\nAnn: done\n",
    "run.log": '2026-01-01 10:00:00 job 12 from 10.0.0.1 said "ok"\n2026-01-01 10:00:05 job 99 from 10.0.0.2 said "no"\n',
    "data.json": '{"a": {"b": [1, "two", null]}, "c": true}',
    "bad.json": "{nope",
    "page.html": "<html><head><title>x</title></head><body><nav>menu</nav><h1>Oak Report</h1><p>Oak Partners owns Pine Co.</p><script>1</script></body></html>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    for name, text in TEXTS.items():
        (d / name).write_text(text, encoding="utf-8")
    (d / "skip.bin").write_bytes(b"\x00")
    return str(d)


@pytest.fixture(scope="module")
def graph(spark, folder):
    return builds.build(spark, folder, strategy="voting")


def test_listing_and_unreadable(spark, folder):
    files = corpus.list_corpus(spark, folder)
    assert files.count() == len(TEXTS)
    bad = corpus.unreadable(files).collect()
    assert len(bad) == 1 and bad[0].path.endswith("bad.json")


def test_relations(graph):
    rows = {(r.subject_id.split(":")[-1], r.predicate, r.object_id.split(":")[-1], r.polarity, r.inferred) for r in graph.tables["relations"].collect()}
    assert ("larch corp", "TRANSFERRED", "rowan ltd", "pos", False) in rows
    assert ("larch corp", "TRANSFERRED", "rowan ltd", "neg", False) in rows
    assert ("rowan ltd", "CONTROLLED_BY", "alder holdings", "pos", False) in rows
    assert ("mary birch", "DIRECTOR_OF", "larch corp", "pos", False) in rows
    assert any(r[2] == "hazel trust" and r[3] == "neg" and r[4] for r in rows)
    amounts = {r.amount for r in graph.tables["relations"].filter("predicate = 'TRANSFERRED' and polarity = 'pos'").collect()}
    assert "USD 4,000" in amounts


def test_claims_conflicts_and_contradictions(graph):
    assert graph.claims.filter("t_valid = '2026-03-04'").count() > 0
    rows = graph.conflicts.collect()
    assert any("elm group" in r.subject and r.severity == "HIGH" and len(r.objects) == 3 for r in rows)
    assert graph.edges.filter("predicate = 'CONTRADICTS'").count() >= 1
    assert graph.edges.filter("predicate = 'SUPERSEDED_BY'").count() >= 1


def test_resolution_joins_spellings(graph):
    names = {r.subject for r in graph.tables["same_as"].collect()}
    assert {"entity:Organization:larch corp", "entity:Organization:larch corporation"} <= names
    assert not any("willow" in n for n in names)


def test_every_edge_is_cited_and_ends_exist(graph):
    assert graph.edges.filter(F.size("source_spans") < 1).count() == 0
    known = graph.nodes.select("node_id")
    for end in ("subject", "object"):
        assert graph.edges.join(known.withColumnRenamed("node_id", end), end, "left_anti").count() == 0


def test_spans_hash_to_the_source(spark, graph):
    docs = graph.documents
    spans = graph.tables["mentions"].select("doc_id", "surface", "start", "end")
    rows = corpus.raw_spans(docs, spans).collect()
    raw = {r.doc_id: bytes(r.raw) for r in docs.select("doc_id", "raw").collect()}
    assert rows
    for r in rows:
        own = raw[r.doc_id][r.raw_start : r.raw_end]
        assert own.decode() == r.surface and hashlib.sha256(own).hexdigest() == r.hash


def test_rebuild_is_equal(spark, folder, graph):
    again = builds.build(spark, folder, strategy="voting")
    assert store.graph_json(again.nodes, again.edges) == store.graph_json(graph.nodes, graph.edges)


def test_structure_labels(graph):
    labels = {r.label for r in graph.nodes.select(F.explode("labels").alias("label")).distinct().collect()}
    assert {"Document", "Section", "Reference", "Citation", "CrossRef", "Rationale", "Requirement", "Participant", "Message", "LogTemplate", "Field", "Chunk", "Entity", "Claim", "Conflict"} <= labels
    assert graph.edges.filter("predicate = 'REPLIES_TO'").count() == 2
    assert graph.nodes.filter(F.array_contains("labels", "LogTemplate")).count() == 1
    assert {r.name for r in graph.nodes.filter(F.array_contains("labels", "Field")).collect()} == {"a.b[0]", "a.b[1]", "a.b[2]", "c"}


def test_engine_tools(spark, graph):
    e = Engine.from_graph(graph)
    assert e.resolve("Larch Corp") == "entity:Organization:larch corp"
    hits = e.search("who controls Rowan", k=5).collect()
    assert hits and any("rowan" in h.id.lower() or "rowan" in h["name"].lower() for h in hits)
    assert any(r.there == "entity:Organization:rowan ltd" for r in e.neighbors("Larch Corp").collect())
    assert e.path("Alder Holdings", "Larch Corp").first().path[0] == "entity:Organization:alder holdings"
    assert e.why("Rowan Ltd").count() > 0 and e.timeline("Rowan Ltd").count() > 0
    assert e.conflicts().count() > 0 and e.contradictions().count() > 0
    assert e.communities().count() > 0 and e.stats().count() > 0
    assert e.vision("rowan larch").count() > 0
    rows = e.gql("MATCH (a:Organization)-[r:TRANSFERRED]->(b) WHERE r.polarity = 'pos' RETURN a.name AS a, b.name AS b").collect()
    assert ("Larch Corp", "Rowan Ltd") in {(r.a, r.b) for r in rows}
    found = e.decisions()
    assert {r.category for r in found.collect()} >= {"decision", "why"}
    with pytest.raises(ValueError):
        e.call("nothing")


def test_reasoning_is_bounded_and_grounded(graph):
    e = Engine.from_graph(graph)
    short, long = reason(e, "who is Larch Corp"), reason(e, "who is Larch Corp", adaptive=False)
    assert short.calls <= long.calls <= 16
    assert all(t.evidence for t in short.items if t.role in ("finding", "answer"))


def test_security_hides_what_isnt_authorized(spark, graph):
    e = Engine.from_graph(graph)
    docs = graph.documents.select("doc_id", F.lit("").alias("label"), "path")
    open_ = [r.doc_id for r in docs.filter("path like '%other.md'").collect()]
    tuples = spark.createDataFrame([(d, "viewer", "user:ann") for d in open_], "object string, relation string, subject string")
    ann = e.restricted(docs, tuples, security.Policy(), security.Context("user:ann"))
    seen = {r.node_id for r in ann.nodes.collect()}
    assert "entity:Organization:elm group" in seen and "entity:Organization:alder holdings" not in seen
    assert ann.gql("MATCH (a)-[]->(b) RETURN id(a) AS a, id(b) AS b").filter("a like '%alder%' or b like '%alder%'").count() == 0
    assert e.gql("MATCH (a)-[]->(b) RETURN id(a) AS a, id(b) AS b").filter("a like '%alder%' or b like '%alder%'").count() > 0
    nobody = e.restricted(docs, tuples, security.Policy(), security.Context("user:bo"))
    assert nobody.nodes.count() == 0


def test_sinks(spark, graph, tmp_path):
    store.write_store(graph.nodes, graph.edges, str(tmp_path / "g"))
    nodes, edges = corpus.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == graph.nodes.count() and edges.count() == graph.edges.count()
    data = json.loads(store.graph_json(graph.nodes, graph.edges))
    assert data["stats"]["nodes"] == len(data["nodes"])
    (tmp_path / "g.json").write_text(store.graph_json(graph.nodes, graph.edges))
    n2, e2 = corpus.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n2.count() == nodes.count() and {r.edge_id for r in e2.collect()} == {r.edge_id for r in edges.collect()}
    rdf.write_turtle(graph.nodes, graph.edges, str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines and all(x.endswith(" .") for x in lines)
    assert any("owl:Class" in r.line for r in ontology.owl_lines(graph.nodes, graph.edges).collect())
    assert any("sh:minCount 1" in r.line for r in ontology.shacl_lines(graph.nodes, ["name"]).collect())
    assert "# Graph report" in store.report(graph.nodes, graph.edges)
    assert "<script id=g" in store.html_page(graph.nodes, graph.edges)
    assert json.loads(store.manifest({"a": 1}, []))["config_hash"]
    made = json.loads(store.manifest({"a": 1}, graph.stages, store.coverage(graph.documents, graph.edges)))
    assert [s["layer"] for s in made["stages"]] == ["reading", "extraction", "resolution", "claims", "graph"] and all(s["wall_ms"] >= 0 for s in made["stages"])
    assert 0 < made["coverage"]["documents_cited"] <= made["coverage"]["documents"] and made["coverage"]["edges_citing"] <= made["coverage"]["edges"]
    asked = store.questions(graph.nodes, graph.edges)
    assert len(asked) == len(set(asked)) == 10 and any("Larch" in q or "Rowan" in q or "Elm" in q for q in asked)
    store.write_store(nodes, edges, str(tmp_path / "g"))  # where it is read from
    assert corpus.read_graph(spark, str(tmp_path / "g"))[0].count() == graph.nodes.count()


def test_extraction_quality(spark, graph):
    gold = spark.createDataFrame([("larch corp", "TRANSFERRED", "rowan ltd"), ("rowan ltd", "CONTROLLED_BY", "alder holdings"), ("mary birch", "DIRECTOR_OF", "larch corp"), ("elm group", "CONTROLS", "rowan ltd"), ("willow bank", "CONTROLS", "rowan ltd"), ("larch corp", "TRANSFERRED", "hazel trust"), ("elm group", "CONTROLS", "aspen fund"), ("elm group", "CONTROLS", "maple fund"), ("oak partners", "CONTROLS", "pine co")], "s string, p string, o string")
    last = lambda c: F.element_at(F.split(c, ":"), -1)
    found = graph.tables["relations"].select(last("subject_id").alias("s"), F.col("predicate").alias("p"), last("object_id").alias("o"))
    row = extraction.precision_recall(found, gold, ["s", "p", "o"]).first()
    assert row.f1 >= 0.8 and row.false_rate <= 0.2
