"""Formats, offsets, streaming and the operators that have no SQL."""

from __future__ import annotations

import hashlib
import html
import io
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provgraph.catalog.analytics import layout, yen_k_paths
from provgraph.catalog.sources import html_blocks
from provgraph.catalog.text import content_address
from provgraph.operators import analytics, claims, intervals, paths, resolution, structure
from provgraph.operators.lift import supply_graph
from provgraph.sources import formats
from provgraph.streaming import watch

from .conftest import SF


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_h", ".h"), body)
    return out.getvalue()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"\r\n", b"\r", b"\n", "é".encode(), "中".encode(), "😀".encode(), b"\xff", b"\xc3"]), max_size=20), st.booleans())
def test_offsets_go_back_to_bytes(parts, mark):
    raw = (b"\xef\xbb\xbf" if mark else b"") + b"".join(parts)
    text, runs = formats.canonical(raw), formats.offset_runs(raw)
    assert sum(n for _, _, n, _ in runs) == len(text)
    at = [formats.to_raw(runs, len(raw), i) for i in range(len(text) + 1)]
    assert at == sorted(at) and (not text or at[-1] == len(raw))
    for i, ch in enumerate(text):
        own = raw[at[i] : at[i + 1]]
        assert (own in (b"\n", b"\r", b"\r\n")) if ch == "\n" else formats.canonical(own) == ch


def test_markdown_blocks():
    text, blocks = formats.markdown(b"Title\n=====\n\n# A `b`\n\npara one\nline two\n\n> quoted\n> more\n\n1. one\n2. two\n   more\n\n```py\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [(b[1], b[2]) for b in blocks if b[1] == "heading"] == [("heading", 1), ("heading", 1)]
    kinds = [b[1] for b in blocks]
    assert kinds.count("list_item") == 3 and "quote" in kinds and "code" in kinds and "table" in kinds
    assert all(0 <= b[3] <= b[4] <= len(text) for b in blocks)
    assert next(b for b in blocks if b[1] == "code")[5] == "code\n"


def test_rich_formats():
    word = zipped(word__document_xml='<w:document xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>')
    assert [(b[1], b[2], b[5]) for b in formats.docx(word)[1]] == [("heading", 2, "Top"), ("paragraph", 0, "Body")]
    open_ = zipped(content_xml='<o xmlns:t="u"><t:h t:outline-level="3">Top</t:h><t:p>Body</t:p></o>')
    assert [(b[1], b[2]) for b in formats.odt(open_)[1]] == [("heading", 3), ("paragraph", 0)]
    book = zipped(b_html="<h1>Two</h1>", a_html="<p>One</p><script>x</script>")
    assert formats.epub(book)[0] == "One\n\nTwo"
    assert formats.rtf(rb"{\rtf1\b Bold\par plain}")[0] == "Bold\n\nplain"
    for bad in (formats.docx, formats.odt, formats.epub):
        with pytest.raises(formats.Unsupported):
            bad(b"not a zip")
    text, blocks = formats.html(b"<p>a <b>b</b></p><ul><li>c</ul><h2>d</h2>")
    assert [b[5] for b in blocks] == ["a b", "c", "d"] and all(text[b[3] : b[4]] == b[5] for b in blocks)


def test_structured_fields():
    text, blocks = formats.json_document(b'{"a": [1, {"b": "x"}], "n": null}')
    assert {b[6]["path"]: b[6]["value"] for b in blocks} == {"a[0]": "1", "a[1].b": "x", "n": ""}
    assert all(text[b[3] : b[4]] == b[6]["value"] for b in blocks if b[6]["value"])
    assert formats.toml_document(b"a = 1\n[t]\nb = 'c'")[1][1][6]["path"] == "t.b"
    with pytest.raises(formats.Unsupported):
        formats.json_document(b"{")


def test_sentences():
    text = 'Mr. Birch left. He said "yes." Then E. Oak, e.g. the other, stayed! Why? ok'
    assert [text[a:b] for a, b in structure.split_sentences(text)] == ["Mr. Birch left.", 'He said "yes.', "Then E. Oak, e.g. the other, stayed!", "Why?", "ok"]


def test_chunks_keep_blocks_whole(spark):
    blocks = [("heading", 1, 0, 2, "T"), ("paragraph", 0, 3, 9, "a b c"), ("paragraph", 0, 10, 15, "d e"), ("heading", 2, 16, 18, "U"), ("paragraph", 0, 19, 30, "f " * 9)]
    assert [(t, held[0][2], held[-1][3]) for t, held in structure.fill_chunks(blocks, 4)] == [(["T"], 3, 9), (["T"], 10, 15), (["T", "U"], 19, 30)]


def test_decisions_and_links(spark):
    rows = [("d1", "r1", "ADR-1", "# ADR-1: keep"), ("d2", "r2", "ADR-2", "ADR-2: go SUPERSEDES ADR-1"), ("d2", "r3", "ADR-1", "ADR-2: go SUPERSEDES ADR-1"), ("d3", "r4", "WHY:", "WHY: because of ADR-2"), ("d3", "r5", "NOTE", "NOTE x")]
    found = structure.decisions(spark.createDataFrame(rows, "doc_id string, id string, marker string, line string"))
    assert {(r.id, r.category, r.adr) for r in found.collect()} == {("r1", "adr", 1), ("r2", "adr", 2), ("r4", "why", None)}
    links = {(r.subject, r.predicate, r.object) for r in structure.causal_links(found).collect()}
    assert links == {("r1", "PRECEDENT_FOR", "r2"), ("r2", "CAUSED", "r4")}


def test_intervals_against_brute_force(spark):
    r = random.Random(2)
    a = [(r.randint(0, 2), i, s := r.randint(0, 300), s + r.randint(1, 90)) for i in range(60)]
    b = [(r.randint(0, 2), i, s := r.randint(0, 300), s + r.randint(1, 90)) for i in range(40)]
    fa, fb = (spark.createDataFrame(x, "doc int, id int, start int, end int") for x in (a, b))
    hit = lambda x: any(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for y in b)
    assert {x.id for x in intervals.overlapping(fa, fb, "doc", 32).collect()} == {x[1] for x in a if hit(x)}
    assert {x.id for x in intervals.not_overlapping(fa, fb, "doc", 32).collect()} == {x[1] for x in a if not hit(x)}


def test_effective_windows_against_brute_force(spark):
    r = random.Random(3)
    rows = [(f"c{i:03d}", f"s{r.randint(0, 2)}", "CONTROLS", f"o{r.randint(0, 2)}", "pos", None if r.random() < 0.2 else f"2026-01-{r.randint(1, 9):02d}", None, 0.5, "d") for i in range(60)]
    frame = spark.createDataFrame(rows, "claim_id string, subject string, predicate string, object string, polarity string, t_valid string, t_invalid string, confidence double, doc_id string")
    got = {x.claim_id: x.w_end for x in claims.effective_windows(frame).collect()}
    for c in rows:
        later = [o[5] for o in rows if c[5] and o[1] == c[1] and o[3] != c[3] and o[5] and o[5] > c[5]]
        assert got[c[0]] == (min(later) if later else None)


def random_graph(spark, seed, n=9, m=12):
    r = random.Random(seed)
    links = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", round(r.uniform(0.1, 1), 2)) for _ in range(m)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "node_id string")
    edges = spark.createDataFrame([(f"e{i}", a, "R", b, w, w) for i, (a, b, w) in enumerate(links)], "edge_id string, subject string, predicate string, object string, confidence double, weight double")
    return n, links, nodes, edges


def reach(n, links, start):
    seen = {start}
    while more := {y for a, b, _ in links for x, y in ((a, b), (b, a)) if x in seen} - seen:
        seen |= more
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_algorithms_against_brute_force(spark, seed):
    n, links, nodes, edges = random_graph(spark, seed)
    adj = analytics.adjacency(nodes, edges)
    comp = {r.node_id: r.component for r in analytics.connected_components(nodes, adj).collect()}
    assert comp == {f"n{i}": min(reach(n, links, f"n{i}")) for i in range(n)}
    got = {(r.a, r.b) for r in analytics.bridges(nodes, adj).collect()}
    want = {(min(a, b), max(a, b)) for a, b, _ in links if a != b and b not in reach(n, [x for x in links if {x[0], x[1]} != {a, b}], a)}
    assert got == want
    score = {r.node_id: r.score for r in analytics.betweenness(nodes, adj).collect()}
    whole = dict.fromkeys(score, 0.0)
    near = {}
    for a, b, _ in links:
        if a != b:
            near.setdefault(a, []).append(b), near.setdefault(b, []).append(a)
    for s in score:
        for t in score:
            found, front = [], [[s]]
            while front and not found and s != t:
                found = [p for p in front if p[-1] == t]
                front = [] if found else [[*p, x] for p in front for x in near.get(p[-1], []) if x not in p]
            for p in found:
                for v in p[1:-1]:
                    whole[v] += 1 / len(found)
    assert all(abs(score[v] - whole[v] / ((n - 1) * (n - 2))) < 1e-9 for v in score)
    ranks = {r.node_id: r.score for r in analytics.pagerank(nodes, adj, iterations=60, tolerance=1e-10).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6
    groups = {r.node_id: r.community for r in analytics.label_propagation(nodes, adj).collect()}
    assert all(comp[a] == comp[b] for a in groups for b in groups if groups[a] == groups[b])
    placed = analytics.layout(nodes, adj, analytics.label_propagation(nodes, adj), 5).collect()
    assert placed == analytics.layout(nodes, adj, analytics.label_propagation(nodes, adj), 5).collect() and len(placed) == n


def test_paths_against_brute_force(spark):
    n, links, _, edges = random_graph(spark, 5, 7, 12)
    best = {}
    for a, b, w in links:
        if a != b:
            best[a, b] = best[b, a] = max(w, best.get((a, b), 0))
    every = []

    def walk(path, p):
        if path[-1] == "n1":
            every.append((round(p, 6), path))
            return
        for (x, y), w in best.items():
            if x == path[-1] and y not in path:
                walk([*path, y], p * w)

    walk(["n0"], 1.0)
    want = sorted((p for p, _ in every), reverse=True)[:3]
    assert [r.likelihood for r in paths.k_best(edges, "n0", "n1", 3).orderBy("rank").collect()] == want
    top = {r.node_id: round(r.likelihood, 6) for r in paths.best_likelihood(edges, "n0", 6).collect()}
    if want:
        assert top["n1"] == want[0]


def test_k_best_searches_all_parts(spark, tmp_path):
    """The likeliest path runs over a part of a high number."""
    links = [(1, 1, 0.0), (50, 1, 0.0), (50, 2, 0.0), (2, 2, 0.0), (1, 3, 0.08), (2, 3, 0.08)]
    tables = {
        "orders": ([(1, 1)], "o_custkey long, o_orderkey long"),
        "lineitem": ([(1, p, s, i, t, 0.0) for i, (p, s, t) in enumerate(links)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_tax double, l_discount double"),
        "customer": ([(1, 1)], "c_custkey long, c_nationkey long"),
        "supplier": ([(i, i) for i in (1, 2, 3)], "s_suppkey long, s_nationkey long"),
        "nation": ([(i, 1) for i in (1, 2, 3)], "n_nationkey long, n_regionkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = yen_k_paths(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.path, r.likelihood) for r in got] == [(["part:1", "supplier:1", "part:50", "supplier:2", "part:2"], 1.0), (["part:1", "supplier:3", "part:2"], 0.8464)]


def test_k_best_in_a_large_component(spark, monkeypatch):
    """A component of more links than one search may hold: only the links near the likeliest paths are searched."""
    monkeypatch.setattr(analytics, "MAX_COMPONENT", 3)
    rows = [("a", "b", 0.9), ("b", "z", 0.9), ("a", "z", 0.5), ("a", "c", 0.8), ("c", "z", 0.8)] + [("z", f"x{i}", 0.1) for i in range(20)] + [(f"x{i}", f"x{i + 1}", 0.1) for i in range(19)]
    edges = spark.createDataFrame(rows, "subject string, object string, confidence double")
    assert [(r.path, r.likelihood) for r in paths.k_best(edges, "a", "z", 3).orderBy("rank").collect()] == [(["a", "b", "z"], 0.81), (["a", "c", "z"], 0.64), (["a", "z"], 0.5)]
    assert paths.k_best(edges, "a", "nowhere").count() == 0


def test_jaro_winkler():
    assert resolution.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert resolution.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert resolution.jaro("", "a") == 0 and resolution.jaro("a", "a") == 1


def test_complete_linkage_needs_every_pair(spark):
    names = ["Alder Works", "Alder Workss", "Alder Worksss Two"]
    recs = resolution.records(spark.createDataFrame([(f"e{i}", "Organization", n) for i, n in enumerate(names)], "id string, etype string, name string"))
    pairs = resolution.score_pairs(resolution.pair_features(resolution.candidate_pairs(resolution.blocking_keys(recs)), recs))
    got = {r.id: r.cluster for r in resolution.clusters(recs, pairs).collect()}
    s = {(a, b): resolution.jaro_winkler(names[a].lower(), names[b].lower()) for a in range(3) for b in range(a)}
    if s[2, 0] < resolution.MATCH:
        assert not got["e0"] == got["e1"] == got["e2"]


def test_incremental_equals_full(spark):
    known = spark.createDataFrame([("a", "1", 10), ("b", "1", 20), ("c", "1", 30)], "path string, signature string, v int")
    now = spark.createDataFrame([("a", "1", 10), ("b", "2", 21), ("d", "1", 40)], "path string, signature string, v int")
    fresh, gone = watch.changed(now, known.select("path", "signature"))
    after = watch.apply_changes(known, fresh, gone)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, now.collect()))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("job 1 done\njob 2 done\n")
    seen = []
    q = watch.watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, i: seen.extend(r.extension for r in df.collect()))
    q.awaitTermination(60)
    assert seen == [".log"]
    with pytest.raises(ValueError):
        watch.watch_folder(spark, str(tmp_path), str(tmp_path / "x"), lambda df, i: None)
    lines = spark.readStream.text(str(tmp_path / "in"))
    q = watch.template_counts(lines).writeStream.format("memory").queryName("templates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.template, r.occurrences) for r in spark.sql("SELECT * FROM templates").collect()] == [("job <NUM> done", 2)]
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, frame in (("windows", watch.event_windows(events)), ("visits", watch.sessions(events))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.sql(f"SELECT * FROM {name}").count() > 0


def test_content_address_of_all_texts(spark, tmp_path):
    """Spans are cut by bytes, also within a character; no text is left out."""
    texts = ["plain ascii of over twenty bytes", "é" * 9 + "x中 cut within a character", "中😀" * 4, "ß" * 10, "short é", ""]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.doc_hash, r.edge_hash, r.span) for r in content_address(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: ("sha256:" + sha(t.encode()), "edge:" + sha(f"web|HAS|{i}".encode()), sha(t.encode()[:20]) if len(t.encode()) >= 20 else None) for i, t in enumerate(texts)}


PAGES = [
    "<html><head><title>t</title></head><body><nav>menu</nav><h1>A <em>marked</em> &amp; <a href='x'>linked</a> top</h1><p>one</p><p>two<br>three</body></html>",
    "<ul><li>a</li><li>b <b>c</b> <i>d</i></li></ul><table><tr><th>k</th><td>1</td></tr><tr><td>2</td></tr></table><h3>low</h3>tail",
    "<dl><dt>term</dt><dd>meaning</dd></dl><figure><figcaption>shown</figcaption></figure><script>var t='<p>x</p>';</script><footer>end</footer>",
    "<h2>same</h2>",
    "<p>same</p>",
    "<p>no heading, é中😀 &lt;kept&gt;</p><!-- <p>gone</p> --><pre>x\n  y</pre>",
    "",
    None,
]


def brute_blocks(page):
    """By regular expressions alone."""
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head|nav|footer)\b.*?</\1\s*>", "", page or "")
    level, out = 0, []
    for piece in re.split(r"(?i)(</?(?:h[1-6]|p|li|td|th|div|section|article|blockquote|pre|tr|br|ul|ol|table|dd|dt|figcaption)\b[^>]*>)", page):
        if m := re.match(r"(?i)<(/?)h([1-6])\b", piece):
            level = 0 if m[1] else int(m[2])
        elif body := " ".join(html.unescape(re.sub(r"<[^>]+>", "", piece)).split()):
            out.append(("heading" if level else "paragraph", level, body))
    return out


def test_blocks_of_all_pages_against_brute_force(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for where in (str(tmp_path), SF):
        pages = {r.page_id: r.html for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
        got = sorted((r.page_id, r.ord, r.kind, r.level, r.text) for r in html_blocks(spark, where).collect())
        assert got == sorted((i, n, *b) for i, page in pages.items() for n, b in enumerate(brute_blocks(page)))


def test_layout_runs_all_rounds(spark):
    nodes, edges = supply_graph(spark, SF)
    adj = analytics.adjacency(nodes, analytics.entity_weights(edges))
    assert nodes.count() <= 400
    whole = analytics.layout(nodes, adj, analytics.label_propagation(nodes, adj), 300).collect()
    assert sorted(layout(spark, SF).collect()) == sorted(whole)
