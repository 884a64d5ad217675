"""Entity resolution: blocking, pair scores, complete-linkage clusters, metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import acronym, normal_name, stripped_name, suffix_family

MATCH = 0.86
MAX_LINKED = 3_000  # 4.5 million pairs


def jaro(a: str, b: str) -> float:
    """Share of matching signs within half the longer length, less half the transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for up to four common first signs whatever the score."""
    base, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return base + n * 0.1 * (1 - base)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all distinct words; 0 where neither has any."""
    words = [F.array_distinct(F.filter(F.split(F.col(x) if isinstance(x, str) else x, r"\s+"), lambda w: w != "")) for x in (a, b)]
    union = F.size(F.array_union(*words))
    return F.when(union > 0, F.size(F.array_intersect(*words)) / union).otherwise(0.0)


def records(entities: DataFrame) -> DataFrame:
    """``id, etype, name`` with the forms that blocking and scoring use."""
    out = entities.filter(F.col("etype").isin("Organization", "Person"))
    return out.withColumns({"norm": normal_name("name"), "stripped": normal_name(stripped_name("name")), "family": suffix_family("name"), "initials": acronym(stripped_name("name"))})


def blocking_keys(recs: DataFrame) -> DataFrame:
    """Up to three keys a record: stripped name, initials, first word."""
    first = F.split("norm", " ")[0]
    keys = F.array(
        F.when(F.col("stripped") != "", F.concat_ws(":", F.lit("strip"), "etype", "stripped")),
        F.when(F.col("initials") != "", F.concat_ws(":", F.lit("acr"), "etype", "initials")),
        F.when(first != "", F.concat_ws(":", F.lit("tok0"), "etype", first)),
    )
    return recs.select("id", F.explode(F.array_distinct(F.array_compact(keys))).alias("block"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    a, b = keys.select(F.col("id").alias("id_a"), "block"), keys.select(F.col("id").alias("id_b"), "block")
    return a.join(b, "block").filter("id_a < id_b").select("id_a", "id_b").distinct()


def pair_features(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    side = ["etype", "norm", "stripped", "family", "initials"]
    a = recs.select(F.col("id").alias("id_a"), *(F.col(c).alias(f"{c}_a") for c in side))
    b = recs.select(F.col("id").alias("id_b"), *(F.col(c).alias(f"{c}_b") for c in side))
    return pairs.join(a, "id_a").join(b, "id_b")


def shared_neighbors(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with ``near``: the neighbours they share over all of both, in ``links(a, b)`` both ways.

    Counts of a join instead of sets of neighbours, so that a hub is never gathered.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    size = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.select("id_a", "id_b").join(both.select(F.col("a").alias("id_a"), F.col("b").alias("x")), "id_a").join(both.select(F.col("a").alias("id_b"), F.col("b").alias("x")), ["id_b", "x"])
    shared = met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["id_a", "id_b"], "left").join(size.select(F.col("a").alias("id_a"), F.col("n").alias("na")), "id_a", "left").join(size.select(F.col("a").alias("id_b"), F.col("n").alias("nb")), "id_b", "left")
    union = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - F.coalesce("shared", F.lit(0))
    return out.withColumn("near", F.when(union > 0, F.coalesce("shared", F.lit(0)) / union).otherwise(0.0)).select(*pairs.columns, "near")


def score_pairs(features: DataFrame) -> DataFrame:
    """``id_a, id_b, score``: different types 0; equal stripped names 0.95 (0.70 where their
    suffixes are of different families); else the best of name similarity, shared words and a
    matching acronym (0.9); shared neighbours add up to 0.1."""
    clash = (F.col("family_a") != "") & (F.col("family_b") != "") & (F.col("family_a") != F.col("family_b"))
    same = (F.col("stripped_a") == F.col("stripped_b")) & (F.col("stripped_a") != "")
    short = ((F.col("initials_a") != "") & (F.col("initials_a") == F.col("stripped_b"))) | ((F.col("initials_b") != "") & (F.col("initials_b") == F.col("stripped_a")))
    loose = F.greatest(jaro_winkler_column("norm_a", "norm_b"), token_jaccard("norm_a", "norm_b"), F.when(short, 0.9).otherwise(0.0))
    base = F.when(F.col("etype_a") != F.col("etype_b"), 0.0).when(same & clash, 0.70).when(same, 0.95).otherwise(loose)
    if "near" in features.columns:
        base = F.when(base == 0.0, 0.0).otherwise(base + F.coalesce("near", F.lit(0.0)) * 0.1)
    return features.select("id_a", "id_b", F.least(F.lit(1.0), base).alias("score"))


def clusters(recs: DataFrame, matched: DataFrame, threshold: float = MATCH) -> DataFrame:
    """``id, cluster``: complete linkage.  Merges never cross a connected component of the matches,
    so each component is clustered by itself (pairs that weren't candidates are scored afresh).  It takes all pairs of
    a component in one task, so one of over ``MAX_LINKED`` records is refused."""
    from .analytics import connected_components

    linked = matched.filter(F.col("score") >= threshold)
    comp = connected_components(recs.select(F.col("id").alias("node_id")), linked.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    members = recs.join(comp.select(F.col("node_id").alias("id"), "component"), "id")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_LINKED:
            raise ValueError(f"{len(pdf)} records are connected by matches; complete linkage takes {MAX_LINKED} at most: raise the threshold or block more narrowly")
        rows = {r.id: r for r in pdf.itertuples()}
        ids = sorted(rows)

        def score(x: str, y: str) -> float:
            a, b = rows[x], rows[y]
            if a.etype != b.etype:
                return 0.0
            if a.stripped and a.stripped == b.stripped:
                return 0.70 if a.family and b.family and a.family != b.family else 0.95
            s, t = set(a.norm.split()), set(b.norm.split())
            short = (a.initials and a.initials == b.stripped) or (b.initials and b.initials == a.stripped)
            return max(jaro_winkler(a.norm, b.norm), len(s & t) / len(s | t) if s | t else 0.0, 0.9 if short else 0.0)

        pair = {(x, y): score(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :]}
        group = {x: [x] for x in ids}
        owner = {x: x for x in ids}
        for (x, y), s in sorted(pair.items(), key=lambda kv: (-kv[1], kv[0])):
            if s < threshold:
                break
            a, b = owner[x], owner[y]
            if a != b and all(pair[min(p, q), max(p, q)] >= threshold for p in group[a] for q in group[b]):
                keep, gone = min(a, b), max(a, b)
                group[keep] += group.pop(gone)
                owner.update(dict.fromkeys(group[keep], keep))
        return pd.DataFrame({"id": ids, "cluster": [owner[x] for x in ids]})

    return members.select("id", "etype", "norm", "stripped", "family", "initials", "component").groupBy("component").applyInPandas(cluster, "id string, cluster string")


def canonical_names(clustered: DataFrame) -> DataFrame:
    """``cluster, canonical``: the name of most words, then longest, then first."""
    words = F.size(F.split("name", r"\s+"))
    return clustered.groupBy("cluster").agg(F.min_by("name", F.struct(-words, -F.length("name"), F.col("name"))).alias("canonical"), F.count(F.lit(1)).alias("size"))


def b_cubed(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``precision, recall, f1`` of ``id, cluster`` tables, from cell counts (no pairs of items)."""
    both = pred.select("id", F.col("cluster").alias("p")).join(truth.select("id", F.col("cluster").alias("t")), "id")
    cell = both.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    sizes_p, sizes_t = cell.groupBy("p").agg(F.sum("n").alias("np")), cell.groupBy("t").agg(F.sum("n").alias("nt"))
    sums = cell.join(sizes_p, "p").join(sizes_t, "t").agg(F.sum(F.col("n") * F.col("n") / F.col("np")).alias("ps"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("rs"), F.sum("n").alias("total"))
    out = sums.select(F.coalesce(F.col("ps") / F.col("total"), F.lit(1.0)).alias("p"), F.coalesce(F.col("rs") / F.col("total"), F.lit(1.0)).alias("r"))
    return out.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 6).alias("f1"))


def blocking_quality(pairs: DataFrame, truth_pairs: DataFrame, n_records: int) -> DataFrame:
    """``recall, reduction`` of blocking against true pairs."""
    hit = truth_pairs.join(pairs, ["id_a", "id_b"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    true, made = truth_pairs.agg(F.count(F.lit(1)).alias("truth")), pairs.agg(F.count(F.lit(1)).alias("made"))
    all_pairs = n_records * (n_records - 1) / 2
    return hit.join(true).join(made).select(
        F.round(F.when(F.col("truth") == 0, 1.0).otherwise(F.col("hit") / F.col("truth")), 6).alias("recall"),
        F.round(F.lit(1.0) - F.col("made") / F.lit(float(all_pairs) if all_pairs else 1.0), 6).alias("reduction"),
    )




def audit(clustered: DataFrame, names: DataFrame, most: int = 200) -> str:
    """The largest clusters of more than one spelling, in Markdown."""
    spellings = clustered.groupBy("cluster").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = names.filter("size > 1").join(spellings, "cluster").orderBy(F.desc("size"), "canonical").limit(most).collect()
    return "\n".join(["# Resolved names", "", *[f"- **{r.canonical}** ({r.size}): {', '.join(r.names)}" for r in rows], ""])
