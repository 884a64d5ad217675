"""The query compiler against a brute-force matcher on small random graphs, and its errors."""

from __future__ import annotations

import itertools
import random

import pytest

from provgraph.plans import gql


def graph(spark, seed):
    r = random.Random(seed)
    n = r.randint(3, 6)
    nodes = [(f"n{i}", r.sample(["A", "B"], r.randint(1, 2)), f"name{i % 3}", r.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]
    edges = [(f"e{j:02d}", f"n{r.randrange(n)}", r.choice(["R", "S"]), f"n{r.randrange(n)}", round(r.random(), 2)) for j in range(r.randint(3, 9))]
    frames = spark.createDataFrame(nodes, "node_id string, labels array<string>, name string, size double"), spark.createDataFrame(edges, "edge_id string, subject string, predicate string, object string, confidence double")
    return nodes, edges, *frames


def steps(edges, here, kinds, direction):
    for e in edges:
        if kinds and e[2] not in kinds:
            continue
        if direction in ("out", "both") and e[1] == here:
            yield e[3], e
        if direction in ("in", "both") and e[3] == here:
            yield e[1], e


def walks(edges, path, kinds, direction, least, most):
    """(end, edges) of loop-free hops from the last of ``path`` that avoid all end points so far."""
    front = [(path[-1], [], set(path))]
    for depth in range(1, most + 1):
        nxt = []
        for here, used, seen in front:
            for there, e in steps(edges, here, kinds, direction):
                if there not in seen:
                    nxt.append((there, [*used, e], seen | {there}))
        if depth >= least:
            yield from ((t, u) for t, u, _ in nxt)
        front = nxt


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    nodes, edges, nf, ef = graph(spark, seed)
    by = {n[0]: n for n in nodes}
    for (kinds, arrow, least, most), label in itertools.product([(["R"], "out", 1, 1), ([], "both", 1, 2), (["R", "S"], "in", 2, 3)], ["A", None]):
        types = ":" + "|".join(kinds) if kinds else ""
        left, right = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}[arrow]
        text = f"MATCH p = (a{':' + label if label else ''}){left}[r{types}*{least}..{most}]{right}(b)-[s:S]->(c) WHERE a.size <> b.size OR c.size >= 2.0 RETURN id(a) AS a, id(b) AS b, id(c) AS c, type(r) AS t, p AS p"
        got = sorted((x.a, x.b, x.c, x.t, tuple(x.p)) for x in gql.run(text, nf, ef).collect())
        want = []
        for a in nodes:
            if label and label not in a[1]:
                continue
            for b, used in walks(edges, [a[0]], kinds, arrow, least, most):
                for c, _ in walks(edges, [a[0], b], ["S"], "out", 1, 1):
                    if a[3] != by[b][3] or (by[c][3] is not None and by[c][3] >= 2.0):
                        want.append((a[0], b, c, used[-1][2], (a[2], by[b][2], by[c][2])))
        assert got == sorted(want), text


def test_aggregates_order_and_limits(spark):
    _, edges, nf, ef = graph(spark, 3)
    rows = gql.run("MATCH (a)-[r]->(b) RETURN a.name AS name, count(*) AS n ORDER BY n DESC, name LIMIT 2", nf, ef).collect()
    assert len(rows) <= 2 and all(x.n >= y.n for x, y in zip(rows, rows[1:], strict=False))
    assert gql.run("MATCH (a:Nope)-[r]->(b) RETURN count(*) AS n", nf, ef).count() == 0
    assert gql.run("MATCH (a)-[*]->(a) RETURN id(a) AS a", nf, ef).count() == 0
    first = gql.run("MATCH (a) RETURN a.size AS s ORDER BY s ASC", nf, ef).collect()
    assert first == sorted(first, key=lambda x: (x.s is not None, x.s or 0))


@pytest.mark.parametrize(
    "text", ["", "MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a)<-[r]->(b) RETURN a", "MATCH (a) RETURN a ORDER BY z", "MATCH (a) WHERE a.x RETURN a", "MATCH (a) RETURN a LIMIT 1.5", "MATCH (a) RETURN a; x", "MATCH (a)-[*3..1]->(b) RETURN a", "MATCH (a) RETURN foo(a)"]
)
def test_errors(spark, text):
    _, _, nf, ef = graph(spark, 1)
    with pytest.raises(gql.GQLError):
        gql.run(text, nf, ef)
