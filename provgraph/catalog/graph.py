"""Graph patterns, one-hop tools, statistics and sinks over the lifted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_tools as tools
from ..operators.lift import supply_graph, trade_edges, trade_nodes
from ..plans import gql
from ..sinks import ontology, rdf
from .common import EDGES, NODES, SUPPLY, Catalog

_c = Catalog()


def _trade(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gql.run(text, trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir))

    return run


def _supply(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gql.run(text, *supply_graph(spark, sf_dir))

    return run


def _gql(name: str, make, text: str, sql: str) -> None:
    _c.add(name, sql)(make(text))


_gql(
    "gql_two_hop_count",
    _trade,
    "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE p.name CONTAINS 'ring' RETURN p.name AS part, count(*) AS n ORDER BY n DESC LIMIT 10",
    """SELECT p_name AS part, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN part ON p_partkey = l_partkey WHERE contains(p_name, 'ring') GROUP BY p_name ORDER BY n DESC, part LIMIT 10""",
)
_gql(
    "gql_where_nullsafe",
    _trade,
    "MATCH (n:Entity) WHERE n.amount = NULL OR (n.amount > 9000 AND NOT n.name STARTS WITH 'C') OR n.name ENDS WITH '99' RETURN n.name AS name, n.amount AS amount, id(n) AS id",
    f"""WITH {NODES} SELECT name, amount, node_id AS id FROM nodes
        WHERE amount IS NULL OR (coalesce(amount > 9000, false) AND NOT starts_with(name, 'C')) OR suffix(name, '99')""",
)
_gql(
    "gql_mixed_types",
    _trade,
    "MATCH (n:Nation) WHERE n.name <> 5 AND NOT n.name < 5 AND NOT n.nothing > 1 RETURN n.name AS name, n.nothing AS nothing",
    "SELECT n_name AS name, CAST(NULL AS VARCHAR) AS nothing FROM nation",
)
_gql(
    "gql_undirected",
    _supply,
    "MATCH (n:Nation)-[r]-(m) RETURN n.name AS nation, m.name AS other, type(r) AS rel",
    f"WITH {SUPPLY} SELECT x.name AS nation, y.name AS other, predicate AS rel FROM sboth JOIN snodes x ON x.node_id = a JOIN snodes y ON y.node_id = b WHERE a LIKE 'nation:%'",
)
_gql(
    "gql_quantified_1_3",
    _supply,
    "MATCH (r:Region)-[*1..3]-(s:Supplier) RETURN r.name AS region, count(*) AS n",
    """SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name""",
)
_gql(
    "gql_path_var",
    _supply,
    "MATCH p = (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN p AS path, r.name AS region",
    """SELECT [s_name, n_name, r_name] AS path, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""",
)
_gql(
    "gql_distinct_skip",
    _trade,
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN DISTINCT n.name AS nation, r.name AS region ORDER BY nation DESC SKIP 3 LIMIT 15",
    """SELECT DISTINCT n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       ORDER BY nation DESC, region OFFSET 3 LIMIT 15""",
)
_gql(
    "gql_labels_id_type",
    _supply,
    "MATCH (a)-[r:IN_REGION]->(b) WHERE r.confidence >= 0.5 RETURN labels(a) AS labels, id(b) AS target, type(r) AS rel, r AS bare, a AS node, id(r) AS none",
    """SELECT ['Entity', 'Nation'] AS labels, 'region:' || n_regionkey AS target, 'IN_REGION' AS rel, 'IN_REGION' AS bare, n_name AS node, CAST(NULL AS VARCHAR) AS none FROM nation""",
)
_gql(
    "gql_keyless_count",
    _trade,
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.amount > 100000 RETURN count(o) AS n",
    "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 HAVING count(*) > 0",
)
_gql(
    "gql_in",
    _supply,
    "MATCH (n)-[:IN_REGION]->(r:Region) WHERE 'Nation' IN labels(n) AND NOT n.name IN labels(r) RETURN id(n) AS id, r.name AS region",
    "SELECT 'nation:' || n_nationkey AS id, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey",
)
_gql(
    "gql_same_region",
    _supply,
    "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE b.name > 'J' RETURN a.name AS a, r.name AS region, b.name AS b",
    """SELECT x.n_name AS a, r_name AS region, y.n_name AS b FROM nation x JOIN region ON r_regionkey = x.n_regionkey
       JOIN nation y ON y.n_regionkey = r_regionkey AND y.n_nationkey <> x.n_nationkey WHERE y.n_name > 'J'""",
)


@_c.add(
    "gql_row_cap",
    """SELECT id, c_name AS name, count(*) OVER () > 40 AS truncated FROM (
         SELECT 'order:' || o_orderkey AS id, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY 1, 2 LIMIT 41) ORDER BY 1, 2 LIMIT 40""",
)
def gql_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gql.run_capped("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN id(o) AS id, c.name AS name", trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir), most=40)


@_c.add(
    "neighbors_1hop",
    f"""WITH {NODES}, {EDGES}, near AS (SELECT object AS there, predicate, 'out' AS direction, confidence FROM edges WHERE subject = 'supplier:7'
        UNION ALL SELECT subject, predicate, 'in', confidence FROM edges WHERE object = 'supplier:7')
        SELECT there, name, predicate, direction, round(confidence, 6) AS confidence FROM near JOIN nodes ON node_id = there
        ORDER BY near.confidence DESC, predicate, there LIMIT 50""",
)
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir)
    out = tools.neighbors(nodes, edges, "supplier:7", k=50)
    return out.select("there", "name", "predicate", "direction", F.round("confidence", 6).alias("confidence"))


@_c.add(
    "degree_top10",
    f"""WITH {NODES}, {EDGES}, ends AS (SELECT subject AS node_id FROM edges UNION ALL SELECT object FROM edges)
        SELECT node_id, name, count(*) AS degree FROM ends JOIN nodes USING (node_id) GROUP BY node_id, name ORDER BY degree DESC, node_id LIMIT 10""",
)
def degree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.top_degrees(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


@_c.add(
    "orphans",
    """SELECT 'customer:' || c_custkey AS node_id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)""",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trade_nodes(spark, sf_dir).filter(F.array_contains("labels", "Customer"))
    large = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F' and o_totalprice > 200000").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    return tools.orphans(nodes, trade_edges(spark, sf_dir).filter("predicate = 'PLACED'").join(large, "object", "left_semi")).select("node_id", "name")


@_c.add(
    "stats_labels_predicates",
    f"""WITH {NODES}, {EDGES} SELECT 'nodes' AS kind, '' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
        UNION ALL SELECT 'label', label, count(*) FROM nodes GROUP BY label UNION ALL SELECT 'label', 'Entity', count(*) FROM nodes
        UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY predicate""",
)
def stats_labels_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.graph_stats(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


@_c.add(
    "graph_view_topn",
    f"""WITH {NODES}, {EDGES}, ends AS (SELECT subject AS node_id FROM edges UNION ALL SELECT object FROM edges),
        top AS (SELECT node_id FROM ends GROUP BY node_id ORDER BY count(*) DESC, node_id LIMIT 600)
        SELECT subject, predicate, object, round(confidence, 6) AS confidence FROM edges WHERE subject IN (SELECT node_id FROM top) AND object IN (SELECT node_id FROM top)""",
)
def graph_view_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir)
    score = tools.degrees(edges).withColumnRenamed("degree", "score")
    return tools.graph_view(nodes, edges, score).select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"))


@_c.add(
    "layer_merge_last_wins",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS value FROM orders""",
)
def layer_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    late = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("late").alias("value"))
    return tools.merge_layers([first, late], "id")


@_c.add(
    "schema_observed",
    f"""WITH {NODES}, {EDGES} SELECT predicate, list_sort(list(DISTINCT x.label)) AS from_labels, list_sort(list(DISTINCT y.label)) AS to_labels, count(*) AS n
        FROM edges JOIN nodes x ON x.node_id = subject JOIN nodes y ON y.node_id = object GROUP BY predicate""",
)
def schema_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.observed_schema(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


@_c.add(
    "resolve_name",
    """SELECT 'supplier:' || s_suppkey AS node_id, s_name AS name, 1 AS tier FROM supplier WHERE lower(s_name) = (SELECT lower(min(s_name)) FROM supplier)
       ORDER BY node_id LIMIT 1""",
)
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trade_nodes(spark, sf_dir).filter(F.array_contains("labels", "Supplier"))
    least = nodes.agg(F.min("name")).first()[0]
    return tools.resolve_name(nodes, nodes.select("node_id", F.col("amount").alias("score")), least.lower())


@_c.add(
    "turtle_lines",
    f"""WITH {SUPPLY} SELECT '<urn:graph:' || replace(subject, ' ', '%20') || '> <urn:graph:p:' || predicate || '> <urn:graph:' || replace(object, ' ', '%20') || '> .' AS line FROM sedges
        UNION ALL SELECT '<urn:graph:' || node_id || '> rdfs:label "' || replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" .' FROM snodes""",
)
def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.turtle_lines(*supply_graph(spark, sf_dir))


@_c.add(
    "owl_domain_range",
    f"""WITH {NODES}, {EDGES}, s AS (SELECT predicate, list_sort(list(DISTINCT x.label)) AS f, list_sort(list(DISTINCT y.label)) AS t
        FROM edges JOIN nodes x ON x.node_id = subject JOIN nodes y ON y.node_id = object GROUP BY predicate)
        SELECT predicate, CASE WHEN len(f) = 1 THEN f[1] END AS domain, CASE WHEN len(t) = 1 THEN t[1] END AS range FROM s""",
)
def owl_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.object_properties(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


QUERIES, SQL = _c.queries, _c.sql
