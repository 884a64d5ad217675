"""Claims, their time windows, conflicts and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ids import claim_id, conflict_id, edge_id
from .analytics import between

# Predicates with one true object at a time, and those whose conflicts weigh most.
SINGLE_TRUTH = ("BENEFICIAL_OWNER_OF", "CONTROLS", "DIRECTOR_OF")
HIGH_SEVERITY = ("BENEFICIAL_OWNER_OF", "CONTROLS")
NOT_CLAIMS = ("SAME_AS", "MENTIONS")
DATE_REACH = 160


def reify(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """A claim for every entity-to-entity relation edge: ``claim_id, subject, predicate, object, confidence, doc_id, start, end``."""
    kept = between(entities, edges.filter(~F.col("predicate").isin(*NOT_CLAIMS)))
    place = ["doc_id", "start", "end"] if "source_spans" in edges.columns else []
    if place:
        span = F.element_at("source_spans", 1)
        kept = kept.withColumns({c: span[c] for c in place})
    # Grouped by what the id is made of, and hashed once a claim: neither hashes nor unread columns are shuffled.
    parts = ["subject", "predicate", "object", *place]
    made = kept.groupBy(*parts).agg(F.min(F.struct("edge_id", "confidence")).alias("x"))
    return made.select(claim_id(*parts).alias("claim_id"), "subject", "predicate", "object", "x.confidence", "x.edge_id", *place)


def claim_edges(claims: DataFrame) -> DataFrame:
    """SUBJECT_OF and HAS_OBJECT edges of claims."""
    a = claims.select(F.col("subject"), F.lit("SUBJECT_OF").alias("predicate"), F.col("claim_id").alias("object"), "confidence")
    b = claims.select(F.col("claim_id").alias("subject"), F.lit("HAS_OBJECT").alias("predicate"), F.col("object"), "confidence")
    return a.unionByName(b).withColumn("edge_id", edge_id("subject", "predicate", "object"))


def nearest_dates(claims: DataFrame, dates: DataFrame, reach: int = DATE_REACH) -> DataFrame:
    """``claim_id, t_valid``: the date mention of the same document nearest to the claim's span,
    within ``reach`` bytes (no gap where they overlap; then the earlier, then the lesser name).

    Both sides are joined on buckets of ``reach`` positions, so a long document is split.
    """
    width = max(reach, 1) * 4
    c = claims.select("claim_id", "doc_id", "start", "end", F.explode(F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))).alias("b"))
    d = dates.select(F.col("doc_id").alias("d_doc"), F.col("start").alias("ds"), F.col("end").alias("de"), "name", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("db"))
    gap = F.greatest(F.lit(0), F.col("start") - F.col("de"), F.col("ds") - F.col("end"))
    near = c.join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("b") == F.col("db"))).withColumn("gap", gap).filter(F.col("gap") <= reach)
    return near.groupBy("claim_id").agg(F.min_by("name", F.struct("gap", "ds", "name")).alias("t_valid"))


def supersede(claims: DataFrame) -> DataFrame:
    """``claim_id, superseded_by, t_invalid``: per triple, the first strictly later dated claim of
    the other polarity closes a claim's window.  One sort per triple and no self-join."""
    dated = claims.filter(F.col("t_valid").isNotNull())
    # The earliest claim of each polarity strictly after a date is the least (t_valid, id) above it:
    # read per date first, so that ties on a date don't close each other.
    days = dated.groupBy("subject", "predicate", "object", "t_valid").agg(
        F.min(F.when(F.col("polarity") == "pos", F.col("claim_id"))).alias("pos"), F.min(F.when(F.col("polarity") != "pos", F.col("claim_id"))).alias("neg")
    )
    after = W.partitionBy("subject", "predicate", "object").orderBy("t_valid").rowsBetween(1, W.unboundedFollowing)

    def first(side: str) -> Column:
        return F.first(F.when(F.col(side).isNotNull(), F.struct(F.col(side).alias("id"), "t_valid")), ignorenulls=True).over(after)

    next_ = days.withColumns({"next_pos": first("pos"), "next_neg": first("neg")}).select("subject", "predicate", "object", "t_valid", "next_pos", "next_neg")
    flip = F.when(F.col("polarity") == "pos", F.col("next_neg")).otherwise(F.col("next_pos"))
    return dated.join(next_, ["subject", "predicate", "object", "t_valid"]).withColumn("x", flip).filter("x is not null").select("claim_id", F.col("x.id").alias("superseded_by"), F.col("x.t_valid").alias("t_invalid"))


def canonical_ends(claims: DataFrame, same_as: DataFrame) -> DataFrame:
    """Claims with aliases replaced by their canonical ids."""
    a = same_as.select(F.col("subject").alias("subject"), F.col("object").alias("__s"))
    b = same_as.select(F.col("subject").alias("object"), F.col("object").alias("__o"))
    out = claims.join(a, "subject", "left").join(b, "object", "left")
    return out.withColumns({"subject": F.coalesce("__s", "subject"), "object": F.coalesce("__o", "object")}).select(claims.columns)


def effective_windows(claims: DataFrame) -> DataFrame:
    """Positive single-truth claims with ``w_start, w_end``: a stated end, else the next later
    date at which another object is claimed for the same subject and predicate.

    Per group only its dates are compared (each with its only object, if it has one),
    so a group of many claims is not squared.
    """
    own = claims.filter(F.col("predicate").isin(*SINGLE_TRUTH) & (F.col("polarity") == "pos"))
    days = own.filter("t_valid is not null").groupBy("subject", "predicate", "t_valid").agg(F.min("object").alias("lo"), F.max("object").alias("hi"))
    ordered = W.partitionBy("subject", "predicate").orderBy("t_valid")
    # A later date has another object than o unless all its objects are o (lo = hi = o).  So the end
    # is the next date, or, where that has o only, the first date after its run of dates with o only.
    days = days.withColumn("only", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    days = days.withColumn("turn", F.col("only").isNull() | ~F.col("only").eqNullSafe(F.lag("only").over(ordered)))
    days = days.withColumn("run_end", F.first(F.when(F.col("turn"), F.col("t_valid")), ignorenulls=True).over(ordered.rowsBetween(1, W.unboundedFollowing)))
    following = days.select("subject", "predicate", "t_valid", *(F.lead(c).over(ordered).alias(f"next_{c}") for c in ("t_valid", "only", "run_end")))
    joined = own.join(following.withColumnRenamed("next_t_valid", "next_day"), ["subject", "predicate", "t_valid"], "left")
    implied = F.when(F.col("next_only").eqNullSafe(F.col("object")), F.col("next_run_end")).otherwise(F.col("next_day"))
    end = F.coalesce("t_invalid", implied)
    return joined.withColumns({"w_start": F.col("t_valid"), "w_end": end}).select("claim_id", "subject", "predicate", "object", "t_valid", "w_start", "w_end", "confidence", "doc_id")


def contenders(windows: DataFrame) -> DataFrame:
    """Claims whose window overlaps that of a claim of another object in the same group."""
    w = windows.alias("a")
    o = windows.select(F.col("subject").alias("s2"), F.col("predicate").alias("p2"), F.col("object").alias("o2"), F.col("w_start").alias("ws2"), F.col("w_end").alias("we2")).distinct()
    left = F.col("w_start").isNull() | F.col("we2").isNull() | (F.col("w_start") < F.col("we2"))
    right = F.col("ws2").isNull() | F.col("w_end").isNull() | (F.col("ws2") < F.col("w_end"))
    return w.join(o, (F.col("subject") == F.col("s2")) & (F.col("predicate") == F.col("p2")) & (F.col("object") != F.col("o2")) & left & right, "left_semi")


def conflicts(contending: DataFrame) -> DataFrame:
    """``conflict_id, subject, predicate, severity, objects, claim_count`` per group."""
    grouped = contending.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("objects"), F.count(F.lit(1)).alias("claim_count"))
    severity = F.when(F.col("predicate").isin(*HIGH_SEVERITY), "HIGH").otherwise("MEDIUM")
    return grouped.filter("claim_count >= 2").select(conflict_id("subject", "predicate", "objects").alias("conflict_id"), "subject", "predicate", severity.alias("severity"), "objects", "claim_count")


def resolve(contending: DataFrame, strategy: str, credibility: DataFrame | None = None) -> DataFrame:
    """The winning object per group: ``subject, predicate, winner, score``.

    ``most_recent``: latest date (undated objects can't win), ties to the greatest object;
    ``voting``: most documents; ``credibility_weighted``: greatest sum of the documents' weights
    (1 where unknown); ties to the earliest document, then the greatest object.
    """
    docs = contending.select("subject", "predicate", "object", "doc_id").distinct()
    if strategy == "most_recent":
        ranked = contending.filter("t_valid is not null").groupBy("subject", "predicate", "object").agg(F.max("t_valid").alias("score"))
        order = [F.desc("score"), F.desc("object")]
    elif strategy == "voting":
        ranked = docs.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).cast("double").alias("score"), F.min("doc_id").alias("first_doc"))
        order = [F.desc("score"), F.asc("first_doc"), F.desc("object")]
    elif strategy == "credibility_weighted":
        weighted = docs.join(credibility, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        ranked = weighted.groupBy("subject", "predicate", "object").agg(F.round(F.sum("weight"), 6).alias("score"), F.min("doc_id").alias("first_doc"))
        order = [F.desc("score"), F.asc("first_doc"), F.desc("object")]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rank = F.row_number().over(W.partitionBy("subject", "predicate").orderBy(*order))
    return ranked.withColumn("rank", rank).filter("rank = 1").select("subject", "predicate", F.col("object").alias("winner"), "score")


def demote(contending: DataFrame, winners: DataFrame, strategy: str) -> DataFrame:
    """Losing claims with the winning claim they yield to; nothing is deleted."""
    best = contending.join(winners, ["subject", "predicate"]).filter(F.col("object") == F.col("winner")).groupBy("subject", "predicate").agg(F.min("claim_id").alias("superseded_by"))
    losing = contending.join(winners, ["subject", "predicate"]).filter(F.col("object") != F.col("winner"))
    return losing.join(best, ["subject", "predicate"]).select("claim_id", "superseded_by", F.lit(strategy).alias("resolved_by"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of claims of one triple with opposite polarity, ids in order."""
    pos, neg = claims.filter("polarity = 'pos'"), claims.filter("polarity = 'neg'")
    triple = ["subject", "predicate", "object"]
    pairs = pos.select(*triple, F.col("claim_id").alias("p"), F.col("confidence").alias("cp")).join(neg.select(*triple, F.col("claim_id").alias("n"), F.col("confidence").alias("cn")), triple)
    return pairs.select(*triple, F.least("p", "n").alias("claim_a"), F.greatest("p", "n").alias("claim_b"), F.least("cp", "cn").alias("confidence"))


def timeline(claims: DataFrame, node_id: str, *more: str) -> DataFrame:
    """Claims about a node by date, undated last."""
    about = claims.filter((F.col("subject") == node_id) | (F.col("object") == node_id))
    return about.select("claim_id", "predicate", "object", "polarity", "t_valid", *more).orderBy(F.asc_nulls_last("t_valid"), "claim_id")


def rationale_names(nodes: DataFrame, edges: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """``name``: the first names of rationale marks whose edges cite one of ``docs(doc_id)``, or any if there are none."""
    marks = nodes.filter(F.array_contains("labels", "Rationale")).select("node_id", "name")
    ends = edges.select(F.explode(F.array("subject", "object")).alias("node_id"), F.explode("source_spans").alias("s")) if "source_spans" in edges.columns else None
    if ends is not None and not docs.isEmpty():
        near = ends.select("node_id", F.col("s.doc_id").alias("doc_id")).join(docs, "doc_id", "left_semi").select("node_id")
        marks = marks.join(near, "node_id", "left_semi")
    return marks.select("name").distinct().orderBy("name").limit(most)


def why(claims: DataFrame, node_id: str, k: int | None) -> DataFrame:
    """The surest claims about a node, all of them without ``k``."""
    about = claims.filter((F.col("subject") == node_id) | (F.col("object") == node_id))
    return about.select("claim_id", "subject", "predicate", "object", "confidence").orderBy(F.desc("confidence"), "claim_id").limit(k if k is not None else (1 << 31) - 1)
