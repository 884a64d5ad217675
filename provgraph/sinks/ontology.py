"""OWL and SHACL induced from what the graph holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph_tools import observed_schema


def object_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``predicate, domain, range``: the label at either end where it is always the same."""
    seen = observed_schema(nodes, edges)
    return seen.select("predicate", F.when(F.size("from_labels") == 1, F.col("from_labels")[0]).alias("domain"), F.when(F.size("to_labels") == 1, F.col("to_labels")[0]).alias("range"))


def owl_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    classes = nodes.select(F.explode("labels").alias("label")).distinct().select(F.concat(F.lit("<urn:graph:c:"), F.col("label"), F.lit("> rdf:type owl:Class .")).alias("line"))
    props = object_properties(nodes, edges)
    name = F.concat(F.lit("<urn:graph:p:"), F.col("predicate"), F.lit(">"))
    lines = props.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(name, F.lit(" rdf:type owl:ObjectProperty .")),
                    F.concat(name, F.lit(" rdfs:domain <urn:graph:c:"), F.col("domain"), F.lit("> .")),
                    F.concat(name, F.lit(" rdfs:range <urn:graph:c:"), F.col("range"), F.lit("> .")),
                )
            )
        ).alias("line")
    )
    return classes.unionByName(lines)


def shapes(nodes: DataFrame, property_columns: list[str]) -> DataFrame:
    """``label, property, least, most``: per class, whether a property is on every node (least 1)."""
    has = nodes.select(F.explode("labels").alias("label"), *(F.col(c).isNotNull().alias(c) for c in property_columns))
    counts = has.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("int")).alias(c) for c in property_columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).alias("m")) for c in property_columns)))
    return counts.select("label", "n", rows.alias("x")).filter("x.m > 0").select("label", F.col("x.property").alias("property"), F.when(F.col("x.m") == F.col("n"), 1).otherwise(0).alias("least"), F.lit(1).alias("most"))


def shacl_lines(nodes: DataFrame, property_columns: list[str]) -> DataFrame:
    s = shapes(nodes, property_columns)
    return s.select(F.concat(F.lit("<urn:graph:s:"), F.col("label"), F.lit("> sh:property [ sh:path <urn:graph:p:"), F.col("property"), F.lit("> ; sh:minCount "), F.col("least").cast("string"), F.lit(" ; sh:maxCount 1 ] .")).alias("line"))
