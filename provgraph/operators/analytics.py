"""Centrality, components, communities, bridges and layout of the entity graph.

Iterations over the whole graph are DataFrame loops whose state is cut with
``checkpoint()``; algorithms that depend on visiting order run per connected
component (nothing they do crosses one), and refuse a component over
``MAX_COMPONENT`` nodes with a clear error rather than sampling it.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_COMPONENT = 200_000
#: Rows of a table that is sent to all tasks at most; larger ones are joined by shuffles.
FEW = 100_000


def cut(frame: DataFrame) -> DataFrame:
    """Cuts lineage in the cluster's checkpoint folder; a temporary one only where none is set for a session in one JVM."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="provgraph-"))
    return frame.checkpoint()


def between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes.  Only distinct ends are compared with the nodes, and edges pass by the
    ends that are not among them: few as a rule, so that edges aren't shuffled."""
    lone = [edges.select(F.col(c).alias("node_id")).filter("node_id is not null").distinct() for c in ("subject", "object")]
    lost = cut(lone[0].unionByName(lone[1]).join(nodes.select("node_id"), "node_id", "left_anti").distinct())
    few = lost.limit(FEW + 1).count() <= FEW
    known = edges.filter("subject is not null and object is not null")
    for c in ("subject", "object"):
        own = lost.withColumnRenamed("node_id", c)
        known = known.join(F.broadcast(own) if few else own, c, "left_anti")
    return known


def adjacency(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``a, b, w`` in both directions; parallel edges stay, self-loops and unknown ends go."""
    known = between(nodes, edges.filter("subject <> object"))
    out = known.select(F.col("subject").alias("a"), F.col("object").alias("b"), F.col(weight).alias("w"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def entity_weights(edges: DataFrame) -> DataFrame:
    """Confidence times the logarithm of one plus the evidence."""
    return edges.withColumn("weight", F.col("confidence") * F.log1p(F.greatest("evidence_count", F.lit(0)).cast("double")))


def pagerank(nodes: DataFrame, adj: DataFrame, iterations: int = 20, damping: float = 0.85, seeds: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """``node_id, score``.  The mass of nodes without edges, and of the teleport, goes to the seeds
    (evenly to all nodes without any).  A tolerance stops early, at one aggregate an iteration."""
    total = adj.groupBy("a").agg(F.sum("w").alias("out"))
    steps = adj.join(total, "a").filter("out > 0").groupBy("a", "b").agg(F.sum(F.col("w") / F.col("out")).alias("p"))
    base = nodes.select("node_id").distinct()
    if seeds is not None:
        seed = base.join(seeds.select("node_id", F.greatest("seed", F.lit(0.0)).alias("seed")), "node_id", "left").fillna(0.0, ["seed"])
        weight = seed.agg(F.sum("seed")).first()[0] or 0.0
    n = base.count()
    if not n:
        return base.withColumn("score", F.lit(0.0))
    if seeds is None or weight <= 0:
        state = base.withColumn("t", F.lit(1.0 / n))
    else:
        state = seed.select("node_id", (F.col("seed") / weight).alias("t"))
    dangling = total.filter("out > 0").select(F.col("a").alias("node_id"), F.lit(True).alias("linked"))
    state = cut(state.join(dangling, "node_id", "left").select("node_id", "t", F.coalesce("linked", F.lit(False)).alias("linked")).withColumn("score", F.col("t")))
    steps = cut(steps)
    dangles = state.filter("not linked").limit(1).count() > 0
    for _ in range(iterations):
        loose = state.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("score"))), F.lit(0.0))).first()[0] if dangles else 0.0
        moved = steps.join(state.select(F.col("node_id").alias("a"), "score"), "a").groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("p") * F.col("score")).alias("in"))
        after = state.withColumnRenamed("score", "old").join(moved, "node_id", "left").withColumn("score", (1 - damping + damping * loose) * F.col("t") + damping * F.coalesce("in", F.lit(0.0)))
        # Each round reads its state twice, so every state is cut: else the work would double per round.
        after = cut(after.select("node_id", "t", "linked", "old", "score"))
        state = after.drop("old")
        if tolerance is not None and after.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < tolerance:
            break
    return state.select("node_id", "score")


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node_id, component``: the least node that is reachable, by repeated least labels and jumps."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = cut(edges)
    state = cut(nodes.select("node_id").distinct().withColumn("component", F.col("node_id")))
    while True:
        near = edges.join(state.select(F.col("node_id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = state.join(near.withColumnRenamed("a", "node_id"), "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = step.select(F.col("node_id").alias("next"), F.col("next").alias("far"))
        after = cut(step.join(jump, "next", "left").select("node_id", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = after.filter("next <> component").limit(1).count()
        state = after.select("node_id", F.col("next").alias("component"))
        if not changed:
            return state


def _per_component(nodes: DataFrame, adj: DataFrame, work: Callable[[list[str], dict[str, list[tuple[str, float]]]], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``work(sorted ids, adjacency)`` on each component's rows."""
    comp = connected_components(nodes, adj.select("a", "b"))
    rows = comp.select("component", F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.unionByName(adj.join(comp.select(F.col("node_id").alias("a"), "component"), "a").select("component", "a", "b", F.col("w").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.b.isna(), "a"])
        if len(ids) > MAX_COMPONENT:
            raise ValueError(f"a component of {len(ids)} nodes exceeds {MAX_COMPONENT}")
        near: dict[str, list[tuple[str, float]]] = {i: [] for i in ids}
        for a, b, w in pdf.loc[pdf.b.notna(), ["a", "b", "w"]].itertuples(index=False):
            near[a].append((b, w))
        return work(ids, near)

    return rows.groupBy("component").applyInPandas(run, schema)


def label_propagation(nodes: DataFrame, adj: DataFrame, rounds: int = 20) -> DataFrame:
    """``node_id, community``: in id order each node takes the label of most weight around it (the
    least on a tie), until nothing changes; labels never leave a component."""

    def work(ids: list[str], near: dict[str, list[tuple[str, float]]]) -> pd.DataFrame:
        label = {i: i for i in ids}
        for _ in range(rounds):
            moved = False
            for i in ids:
                pull: dict[str, float] = {}
                for j, w in near[i]:
                    pull[label[j]] = pull.get(label[j], 0.0) + w
                if pull:
                    best = min(pull, key=lambda x: (-pull[x], x))
                    moved |= best != label[i]
                    label[i] = best
            if not moved:
                break
        least: dict[str, str] = {}
        for i in ids:
            least.setdefault(label[i], i)
        return pd.DataFrame({"node_id": ids, "member": [least[label[i]] for i in ids]})

    return number_communities(_per_component(nodes, adj, work, "node_id string, member string"))


def number_communities(members: DataFrame) -> DataFrame:
    """Dense numbers by least member; only the communities (not the nodes) are ordered globally."""
    heads = members.select("member").distinct()
    numbered = heads.withColumn("community", F.dense_rank().over(W.orderBy("member")) - 1)
    return members.join(numbered, "member").select("node_id", "community")


def _folded(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes and links that are left when nodes with one neighbour are merged into it, round after round, and the rounds'
    ``node_id, into, size, inner``.  ``size`` counts a node and what was merged into it, ``inner`` the ordered pairs of
    these that only meet over the node.  Ends early where a round takes little; what is left is folded in its task."""
    left, rounds = cut(nodes.withColumns({"size": F.lit(1).cast("double"), "inner": F.lit(0.0)})), []
    links = cut(links)
    n = left.count()
    while True:
        lone = links.groupBy("a").agg(F.count(F.lit(1)).alias("near"), F.min("b").alias("b")).filter("near = 1").select(F.col("a").alias("node_id"), F.col("b").alias("into"))
        # Of two nodes that are each other's only neighbour the lesser one goes.
        back = lone.select(F.col("node_id").alias("into"), F.col("into").alias("node_id"), F.lit(True).alias("mutual"))
        gone = cut(lone.join(back, ["node_id", "into"], "left").filter("mutual is null or node_id < into").drop("mutual").join(left, "node_id"))
        taken = gone.count()
        if not taken:
            return left, links, rounds
        rounds.append(gone.select("node_id", "into", "size", "inner"))
        # Pairs of different branches: what grows by one branch after another.
        come = gone.groupBy(F.col("into").alias("node_id")).agg(F.sum("size").alias("come"), F.sum(F.col("size") * F.col("size")).alias("squares"))
        rest = left.join(gone.select("node_id"), "node_id", "left_anti").join(come, "node_id", "left").fillna(0.0, ["come", "squares"])
        left = cut(rest.select("node_id", (F.col("size") + F.col("come")).alias("size"), (F.col("inner") + F.col("come") * F.col("come") - F.col("squares") + 2 * (F.col("size") - 1) * F.col("come")).alias("inner")))
        out = gone.select("node_id")
        links = cut(links.join(out.withColumnRenamed("node_id", "a"), "a", "left_anti").join(out.withColumnRenamed("node_id", "b"), "b", "left_anti"))
        n -= taken
        if taken * 16 < n:
            return left, links, rounds


def _passed(ids: np.ndarray, size: np.ndarray, links: np.ndarray, ways: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Brandes from some sources, whose nodes stand for ``size`` nodes and whose links for ``ways`` parallel ones."""
    tails, heads = np.searchsorted(ids, links[:, 0]), np.searchsorted(ids, links[:, 1])
    order = np.argsort(tails, kind="stable")
    heads, ways = heads[order], ways[order]
    first = np.searchsorted(tails[order], np.arange(len(ids) + 1))
    score = np.zeros(len(ids))
    for s in sources:
        depth, paths, steps = np.full(len(ids), -1), np.zeros(len(ids)), []
        depth[s], paths[s], front = 0, 1.0, np.array([s])
        while len(front):
            n = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
            a, b, w = np.repeat(front, n), heads[at], ways[at]
            depth[b[depth[b] < 0]] = len(steps) + 1
            on = depth[b] == len(steps) + 1
            a, b, w = a[on], b[on], w[on]
            np.add.at(paths, b, paths[a] * w)
            steps.append((a, b, w))
            front = np.unique(b)
        part = np.zeros(len(ids))
        for a, b, w in reversed(steps):
            np.add.at(part, a, paths[a] * w / paths[b] * (size[b] + part[b]))
        part[s] = 0.0
        score += size[s] * part
    return score


def betweenness(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``node_id, score``: Brandes, unweighted, parallel edges as paths of their own; scaled by the
    size of the whole graph.

    Trees are folded first (``_folded``), which gives the scores of their nodes by counts alone.  What is left needs a
    search from each of its nodes: these are dealt to many tasks, each of which holds the links of one component."""
    base = nodes.select("node_id").distinct()
    n = base.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    left, links, rounds = _folded(base, adj.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("ways")))
    linked = links.select(F.col("a").alias("node_id")).distinct()
    core = cut(left.join(linked, "node_id").withColumn("i", F.monotonically_increasing_id()))
    if core.limit(1).count():
        comp = connected_components(core, links)
        whole = cut(core.join(comp, "node_id").withColumns({"all": F.sum("size").over(W.partitionBy("component")), "many": F.count(F.lit(1)).over(W.partitionBy("component"))}))
        largest = whole.agg(F.max("many")).first()[0]
        if largest > MAX_COMPONENT:
            raise ValueError(f"a component of {largest} nodes that lie on cycles exceeds {MAX_COMPONENT}")
        number = whole.select(F.col("node_id").alias("a"), "component", "many", F.col("i").alias("x"))
        rows = whole.select("component", "many", F.col("i").alias("x"), F.lit(-1).cast("long").alias("y"), F.col("size").alias("w"))
        rows = rows.unionByName(links.join(number, "a").join(core.select(F.col("node_id").alias("b"), F.col("i").alias("y")), "b").select("component", "many", "x", "y", F.col("ways").alias("w")))
        parts = F.least(F.lit(64), F.ceil(F.col("many") / 32)).cast("int")
        dealt = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf.y < 0].sort_values("x")
            between_ = pdf[pdf.y >= 0]
            ids = own.x.to_numpy()
            sources = np.arange(int(pdf.part.iloc[0]), len(ids), int(pdf.parts.iloc[0]))
            score = _passed(ids, own.w.to_numpy(), between_[["x", "y"]].to_numpy(), between_.w.to_numpy(), sources)
            return pd.DataFrame({"i": ids, "passed": score})

        passed = dealt.groupBy("component", "part").applyInPandas(run, "i long, passed double").groupBy("i").agg(F.sum("passed").alias("passed"))
        whole = whole.select("node_id", "i", "all").join(passed, "i").select("node_id", "all", "passed")
        left = left.join(whole, "node_id", "left")
    else:
        left = left.withColumns({"all": F.lit(None).cast("double"), "passed": F.lit(None).cast("double")})
    # A node that nothing is left around stands for its whole component.
    done = cut(left.select("node_id", F.coalesce("all", "size").alias("all"), "size", "inner", F.coalesce("passed", F.lit(0.0)).alias("passed")))
    for gone in reversed(rounds):
        above = done.select(F.col("node_id").alias("into"), "all")
        done = done.unionByName(gone.join(above, "into").select("node_id", "all", "size", "inner", F.lit(0.0).alias("passed")))
        done = cut(done)
    score = F.col("inner") + 2 * (F.col("size") - 1) * (F.col("all") - F.col("size")) + F.col("passed")
    return done.select("node_id", (score * scale).alias("score"))


def bridges(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``a, b`` (in order): pairs whose removal, with all parallel edges, disconnects them."""

    def work(ids: list[str], near: dict[str, list[tuple[str, float]]]) -> pd.DataFrame:
        simple = {i: sorted({j for j, _ in near[i]}) for i in ids}
        seen: dict[str, int] = {}
        low: dict[str, int] = {}
        out = []
        for root in ids:
            if root in seen:
                continue
            stack = [(root, "", iter(simple[root]))]
            seen[root] = low[root] = len(seen)
            while stack:
                v, parent, rest = stack[-1]
                for x in rest:
                    if x == parent:
                        continue
                    if x in seen:
                        low[v] = min(low[v], seen[x])
                    else:
                        seen[x] = low[x] = len(seen)
                        stack.append((x, v, iter(simple[x])))
                        break
                else:
                    stack.pop()
                    if parent:
                        low[parent] = min(low[parent], low[v])
                        if low[v] > seen[parent]:
                            out.append((min(v, parent), max(v, parent)))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return _per_component(nodes, adj, work, "a string, b string")


def community_bridges(found: DataFrame, communities: DataFrame) -> DataFrame:
    """Bridges between different communities."""
    a = communities.select(F.col("node_id").alias("a"), F.col("community").alias("community_a"))
    b = communities.select(F.col("node_id").alias("b"), F.col("community").alias("community_b"))
    return found.join(a, "a").join(b, "b").filter("community_a <> community_b")


def community_terms(members: DataFrame, k: int = 3) -> DataFrame:
    """``community, terms``: the ``k`` words of most weight, tf * ln(1 + C / (1 + df)), over names."""
    from ..functions.text import tokens

    words = members.select("community", F.explode(tokens("name")).alias("term"))
    tf = words.groupBy("community", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = members.agg(F.countDistinct("community").alias("n"))
    scored = tf.join(df, "term").join(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log(1 + F.col("n") / (1 + F.col("df"))), 6))  # n: one row
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("weight"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("community", "rank", "term", "weight")


def community_rosters(members: DataFrame, score: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` members of greatest score per community."""
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("score"), "node_id"))
    return members.join(score, "node_id").withColumn("rank", rank).filter(F.col("rank") <= k).select("community", "rank", "node_id", "score")


def god_nodes(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Nodes among the top ``k`` of both scores."""
    a = first.orderBy(F.desc("score"), "node_id").limit(k)
    b = second.orderBy(F.desc("score"), "node_id").limit(k)
    return a.join(b.select("node_id"), "node_id", "left_semi").select("node_id", "score")


def enrich(nodes: DataFrame, **tables: DataFrame) -> DataFrame:
    """Nodes with further columns, each from a ``node_id, value`` table; scores to 8 places."""
    out = nodes
    for name, frame in tables.items():
        value = next(c for c in frame.columns if c != "node_id")
        col = F.round(value, 8) if dict(frame.dtypes)[value] == "double" else F.col(value)
        out = out.join(frame.select("node_id", col.alias(name)), "node_id", "left")
    return out


def repulsion(pos: np.ndarray, strength: float, wide: int = 1024, deep: int = 32) -> np.ndarray:
    """What all others push each point, the strength over the distance, in tiles that stay in a processor's cache.
    Each point's terms are added in the order of the others (a tile's first row is the sum so far), whatever the tiles."""
    x, y = np.ascontiguousarray(pos[:, 0]), np.ascontiguousarray(pos[:, 1])
    push = np.zeros_like(pos)
    dx, dy, far, square = (np.empty((deep + 1, wide)) for _ in range(4))
    for s in range(0, len(x), wide):
        own = slice(s, s + wide)
        n = len(x[own])
        sums = np.zeros((2, n))
        for t in range(0, len(x), deep):
            m = len(x[t : t + deep])
            a, b, f = dx[1 : m + 1, :n], dy[1 : m + 1, :n], far[1 : m + 1, :n]
            np.subtract(x[None, own], x[t : t + deep, None], out=a)
            np.subtract(y[None, own], y[t : t + deep, None], out=b)
            np.multiply(a, a, out=f)
            f += np.multiply(b, b, out=square[1 : m + 1, :n])
            f += 1e-9
            np.divide(strength, f, out=f)
            a *= f
            b *= f
            dx[0, :n], dy[0, :n] = sums
            sums = np.stack((dx[: m + 1, :n].sum(0), dy[: m + 1, :n].sum(0)))
        push[own] = sums.T
    return push


def layout(nodes: DataFrame, adj: DataFrame, communities: DataFrame, iterations: int | None = None) -> DataFrame:
    """``node_id, x, y``: force-directed, started from a hash of the ids, drawn to the middle of
    its community; 300 rounds up to 400 nodes of a component, else 120."""
    named = nodes.join(communities, "node_id").select("node_id", F.col("community").cast("string").alias("c"))
    marks = named.select(F.col("node_id").alias("a"), F.concat(F.lit("\x00"), "c").alias("b"), F.lit(0.0).alias("w"))
    comp = connected_components(nodes, adj.select("a", "b"))
    rows = comp.join(marks.withColumnRenamed("a", "node_id"), "node_id").select("component", F.col("node_id").alias("a"), "b", "w")
    rows = rows.unionByName(adj.join(comp.withColumnRenamed("node_id", "a"), "a").select("component", "a", "b", F.col("w").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.b.str.startswith("\x00")].sort_values("a")
        ids = list(own.a)
        if len(ids) > MAX_COMPONENT:
            raise ValueError(f"a component of {len(ids)} nodes exceeds {MAX_COMPONENT}")
        at = {v: i for i, v in enumerate(ids)}
        group = pd.factorize(own.b)[0]
        links = pdf[~pdf.b.str.startswith("\x00")].sort_values(["a", "b", "w"])  # so that sums don't follow the order of rows
        ia, ib = links.a.map(at).to_numpy(), links.b.map(at).to_numpy()
        digest = [hashlib.sha256(v.encode()).digest() for v in ids]
        pos = np.array([[int.from_bytes(d[:4], "big") / 2**32 - 0.5, int.from_bytes(d[4:8], "big") / 2**32 - 0.5] for d in digest])
        n, ideal = len(ids), 1 / math.sqrt(max(1, len(ids)))
        rounds = iterations or (300 if n <= 400 else 120)
        for r in range(rounds):
            push = repulsion(pos, ideal**2)
            if len(ia):
                d = pos[ia] - pos[ib]
                pull = d * (np.sqrt((d**2).sum(-1)) / ideal)[:, None] / 2
                np.add.at(push, ia, -pull)
                np.add.at(push, ib, pull)
            middle = np.zeros((group.max() + 1, 2))
            np.add.at(middle, group, pos)
            middle /= np.bincount(group)[:, None]
            push += 0.1 * (middle[group] - pos)
            size = np.sqrt((push**2).sum(-1, keepdims=True)) + 1e-12
            pos = pos + push / size * np.minimum(size, 0.1 * (1 - r / rounds))
        return pd.DataFrame({"node_id": ids, "x": pos[:, 0].round(3), "y": pos[:, 1].round(3)})

    return rows.groupBy("component").applyInPandas(run, "node_id string, x double, y double")
