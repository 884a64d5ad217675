"""Chat, HTTP, generated parts with stub clients, and the command line's pieces."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from provgraph import chat, serve
from provgraph.__main__ import doctor
from provgraph.catalog.retrieval import QUESTIONS
from provgraph.engine import TOOLS, Engine
from provgraph.functions.text import route_tool
from provgraph.operators import generated, resolution


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame(
        [("o:ring", ["Entity", "Organization"], "Ring Works", {}), ("o:tea", ["Entity", "Organization"], "Tea House", {}), ("c1", ["Chunk"], "Ring Works pays", {"text": "Ring Works pays the Tea House every month"})],
        "node_id string, labels array<string>, name string, props map<string,string>",
    )
    edges = spark.createDataFrame(
        [("e1", "o:ring", "PAYS", "o:tea", "EXTRACTED", 0.8, 1, [("d1", 0, 5)], {}), ("e2", "doc:d1", "MENTIONS", "o:ring", "EXTRACTED", 0.9, 1, [("d1", 0, 5)], {}), ("e3", "doc:d1", "HAS_CHUNK", "c1", "STRUCTURAL", 1.0, 1, [("d1", 0, 40)], {})],
        "edge_id string, subject string, predicate string, object string, tag string, confidence double, evidence_count long, source_spans array<struct<doc_id:string,start:bigint,end:bigint>>, props map<string,string>",
    )
    chunks = spark.createDataFrame([("d1", 0, 0, 40, "Ring Works pays the Tea House every month", "c1")], "doc_id string, index int, start int, end int, text string, node_id string")
    return Engine(nodes, edges, chunks)


def test_routing_agrees_with_the_column(spark):
    frame = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    assert [r.t for r in frame.select(route_tool("q").alias("t")).collect()] == [chat.classify(q) for q in QUESTIONS]


def test_chat(engine):
    a = chat.answer(engine, "How is Ring Works connected to Tea House?")
    assert a.tool == "path" and "o:tea" in a.citations
    b = chat.answer(engine, "what is related to Ring Works")
    assert b.tool == "neighbors" and "Tea House" in b.text and b.focus == "o:ring"
    c = chat.answer(engine, "what is related to it", focus=b.focus)
    assert "Tea House" in c.text
    assert chat.answer(engine, "why Nobody Here").text == chat.ABSTAIN
    assert chat.answer(engine, "who pays").citations


def test_http(engine):
    current = serve.Current(engine)
    with pytest.raises(ValueError):
        serve.server(current, "")
    s = serve.server(current, "secret")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def call(path, body=None, token="secret"):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"})
        return json.load(urllib.request.urlopen(r, timeout=60))

    try:
        assert set(call("/api/tools")) == set(TOOLS)
        assert call("/api/call", {"tool": "neighbors", "arguments": {"name": "Ring Works"}})[0]["there"] == "o:tea"
        for path, body, token, code in (("/api/tools", None, "wrong", 401), ("/api/call", {"tool": "nope"}, "secret", 404), ("/api/call", {"tool": "stats", "arguments": {"x": 1}}, "secret", 400), ("/x", None, "secret", 404), ("/api/call", {"tool": "gql", "arguments": {"text": "MATCH"}}, "secret", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                call(path, body, token)
            assert e.value.code == code
    finally:
        s.shutdown()
    current.swap(Engine(engine.nodes.limit(0), engine.edges.limit(0)))
    assert current.get() is not engine


def test_uploads():
    assert serve.safe_name("../../x y.md") == "x_y.md" and serve.safe_name("a\\b\\c.txt") == "c.txt"
    with pytest.raises(ValueError):
        serve.safe_name("...")
    assert serve.acceptable("a.md", 5) and not serve.acceptable("a.exe", 5) and not serve.acceptable("a.md", serve.MOST_BYTES + 1) and not serve.acceptable("a", 5)


def test_generated(spark, tmp_path):
    assert generated.parse_triples('```json\n[["A", "pays for", "B"], {"subject": "C", "predicate": "owns", "object": "D"}, [1, 2]]\n```') == [("A", "PAYS_FOR", "B"), ("C", "OWNS", "D")]
    assert generated.parse_triples("no") == [] and generated.parse_triples("[{") == []
    chunks = spark.createDataFrame([("c1", "x" * 50), ("c2", "short"), ("c3", "y" * 60)], "node_id string, text string")
    asked = []
    ask = generated.Cached(lambda p: asked.append(p) or '[["A", "r", "B"]]', str(tmp_path))
    rows = generated.generated_relations(spark, chunks, ask, 5).collect()
    assert {(r.node_id, r.tag, r.confidence) for r in rows} == {("c1", "GENERATED", 0.5), ("c3", "GENERATED", 0.5)}
    generated.generated_relations(spark, chunks, ask, 5)
    assert len(asked) == 2
    for f in tmp_path.iterdir():
        f.write_text("{broken")
    generated.generated_relations(spark, chunks, ask, 1)
    assert len(asked) == 3
    assert generated.generated_relations(spark, chunks, None, 5).count() == 0
    members = spark.createDataFrame([("a", "A", 0), ("b", "B", 0), ("c", "C", 1)], "node_id string, name string, community long")
    score = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "node_id string, score double")
    got = generated.summaries(spark, members, score, lambda p: p[-4:], 1).collect()
    assert [(r.community, r.about) for r in got] == [(0, ["B", "A"])]
    assert generated.narrate("q", [("c1", "text")], None) == "[1] text" and "text" in generated.narrate("q", [("c1", "text")], lambda p: p)
    found = spark.createDataFrame([("d", 0, 3, "company", "Abc", 0.9), ("d", 5, 8, "thing", "x", 0.9), ("d", 9, 12, "Company", "y", 0.1)], "doc_id string, start int, end int, label string, surface string, score double")
    assert [r.etype for r in generated.encoder_mentions(found, {"company": "Organization"}).collect()] == ["Organization"]


def test_audit_and_doctor(spark):
    c = spark.createDataFrame([("1", "a", "Ring"), ("2", "a", "Ring Works")], "id string, cluster string, name string")
    assert "**Ring Works** (2)" in resolution.audit(c, resolution.canonical_names(c))
    assert dict(doctor())["pyspark"]
