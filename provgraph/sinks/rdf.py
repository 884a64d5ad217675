"""Turtle and PROV-O, as sorted lines of text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n@prefix prov: <http://www.w3.org/ns/prov#> ."


def iri(column: str) -> Column:
    """A resource name; spaces are percent-encoded."""
    return F.concat(F.lit("<urn:graph:"), F.replace(F.col(column), F.lit(" "), F.lit("%20")), F.lit(">"))


def literal(column: str) -> Column:
    c = F.replace(F.replace(F.col(column), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def turtle_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One triple a line: relations, and the nodes' names."""
    triples = edges.select(F.concat_ws(" ", iri("subject"), F.concat(F.lit("<urn:graph:p:"), F.col("predicate"), F.lit(">")), iri("object"), F.lit(".")).alias("line"))
    return triples.unionByName(nodes.filter("name is not null").select(F.concat_ws(" ", iri("node_id"), F.lit("rdfs:label"), literal("name"), F.lit(".")).alias("line")))


def type_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.explode("labels").alias("label")).select(F.concat_ws(" ", iri("node_id"), F.lit("rdf:type"), F.concat(F.lit("<urn:graph:c:"), F.col("label"), F.lit(">")), F.lit(".")).alias("line"))


def provenance_lines(edges: DataFrame) -> DataFrame:
    """A reified statement per cited span of a relation."""
    spans = edges.select("edge_id", F.explode("source_spans").alias("s"))
    place = F.concat_ws("#", "s.doc_id", F.concat_ws("-", F.col("s.start").cast("string"), F.col("s.end").cast("string")))
    return spans.select(F.concat_ws(" ", iri("edge_id"), F.lit("prov:wasDerivedFrom"), F.concat(F.lit("<urn:graph:"), place, F.lit(">")), F.lit(".")).alias("line"))


def write_turtle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    lines = turtle_lines(nodes, edges).unionByName(type_lines(nodes))
    if "source_spans" in edges.columns:
        lines = lines.unionByName(provenance_lines(edges))
    lines.distinct().orderBy("line").write.mode("overwrite").text(path)


def decision_activities(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions as PROV-O activities, one JSON-LD object a row; ``links(subject, predicate, object)``."""
    used = links.groupBy(F.col("subject").alias("node_id")).agg(F.array_sort(F.collect_set(F.struct("predicate", "object"))).alias("links"))
    return decisions.join(used, "node_id", "left").select(
        "node_id",
        F.to_json(
            F.struct(
                F.col("node_id").alias("@id"),
                F.lit("prov:Activity").alias("@type"),
                F.col("name").alias("rdfs:label"),
                F.transform(F.filter("links", lambda x: x["predicate"] == "DERIVED_FROM"), lambda x: x["object"]).alias("prov:used"),
                F.transform(F.filter("links", lambda x: x["predicate"] != "DERIVED_FROM"), lambda x: x["object"]).alias("prov:wasInformedBy"),
            )
        ).alias("json"),
    )


def json_ld_context() -> str:
    return json.dumps({"@context": {"prov": "http://www.w3.org/ns/prov#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}}, sort_keys=True)
