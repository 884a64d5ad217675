"""Document-level access control, applied before anything is computed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 16


@dataclass(frozen=True)
class Context:
    """Who asks: subject and groups, clearance, address and time."""

    principal: str
    groups: tuple[str, ...] = ()
    clearance: int = 0
    ip: str | None = None
    as_of: str | None = None


@dataclass(frozen=True)
class Policy:
    """Attribute rules; relation tuples are a table."""

    min_clearance: dict[str, int] = field(default_factory=dict)
    ip_allowlist: tuple[str, ...] = ()
    not_before: str | None = None
    not_after: str | None = None


def granted(tuples: DataFrame, subjects: list[str], depth: int = DEPTH) -> DataFrame:
    """``object, relation`` pairs held by any of the subjects, through groups (``g#member``), owners
    (who are viewers) and parents (whose viewers see the children); each round is one join, ended when it adds nothing."""
    spark = tuples.sparkSession
    t = tuples.select("object", "relation", "subject")
    parents = t.filter("relation = 'parent'").select(F.col("object").alias("child"), F.col("subject").alias("parent"))
    held = t.filter(F.col("subject").isin(subjects or [""])).select("object", "relation").distinct()
    for _ in range(depth):
        usersets = held.select(F.concat_ws("#", "object", "relation").alias("subject"))
        by_group = t.join(usersets, "subject").select("object", "relation")
        by_owner = held.filter("relation = 'owner'").select("object", F.lit("viewer").alias("relation"))
        by_parent = held.filter("relation in ('viewer', 'owner')").select(F.col("object").alias("parent")).join(parents, "parent").select(F.col("child").alias("object"), F.lit("viewer").alias("relation"))
        after = held.unionByName(by_group).unionByName(by_owner).unionByName(by_parent).distinct()
        from .analytics import cut

        after = cut(after)
        if after.count() == held.count():
            return after
        held = after
    return held if held is not None else spark.createDataFrame([], "object string, relation string")


def attributes_allow(policy: Policy, context: Context, label: str | Column = "label") -> Column:
    """Clearance, address and time rules on a document's label; what isn't mapped is denied."""
    c = F.col(label) if isinstance(label, str) else label
    ok = F.lit(True)
    if policy.min_clearance:
        table = F.create_map(*(F.lit(x) for kv in policy.min_clearance.items() for x in kv))
        ok = ok & (F.coalesce(c, F.lit("")).eqNullSafe("") | F.coalesce(table[c] <= context.clearance, F.lit(False)))
    if policy.ip_allowlist:
        ok = ok & F.lit(bool(context.ip) and any(context.ip.startswith(p) for p in policy.ip_allowlist))
    if policy.not_before or policy.not_after:
        now = context.as_of
        inside = now is not None and (policy.not_before is None or now >= policy.not_before) and (policy.not_after is None or now <= policy.not_after)
        ok = ok & F.lit(inside)
    return ok


def authorized_docs(docs: DataFrame, tuples: DataFrame, policy: Policy, context: Context) -> DataFrame:
    """Documents (``doc_id, label``) that the context may view: relations and all attribute rules."""
    viewable = granted(tuples, [context.principal, *context.groups]).filter("relation = 'viewer'").select(F.col("object").alias("doc_id"))
    return docs.filter(attributes_allow(policy, context)).join(viewable, "doc_id", "left_semi")


def visible_graph(nodes: DataFrame, edges: DataFrame, provenance: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What touches an authorized document: a node with provenance there, an edge of such nodes
    with its own document authorized; no provenance, no access.  ``provenance(node_id, doc_id)``."""
    ok = docs.select("doc_id")
    seen = provenance.join(ok, "doc_id", "left_semi").select("node_id").distinct()
    v = nodes.join(seen, "node_id", "left_semi")
    e = edges.join(ok, "doc_id", "left_semi")
    e = e.join(seen.withColumnRenamed("node_id", "subject"), "subject", "left_semi").join(seen.withColumnRenamed("node_id", "object"), "object", "left_semi")
    return v, e
