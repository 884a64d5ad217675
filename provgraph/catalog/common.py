"""Registration, and the SQL of the lifted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register


NODES = """
    nodes AS (
        SELECT 'customer:' || c_custkey AS node_id, 'Customer' AS label, c_name AS name, c_acctbal AS amount FROM customer
        UNION ALL SELECT 'order:' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR), o_totalprice FROM orders
        UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_retailprice FROM part
        UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, s_acctbal FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, 'Region', r_name, NULL FROM region)
"""
EDGES = """
    edges AS (
        SELECT 'customer:' || o_custkey AS subject, 'PLACED' AS predicate, 'order:' || o_orderkey AS object, 1.0::DOUBLE AS confidence, 1 AS evidence_count FROM orders
        UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, 1 - l_discount, l_linenumber FROM lineitem
        UNION ALL SELECT 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey, 1 - l_tax, l_linenumber FROM lineitem
        UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 1.0, 1 FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 1.0, 1 FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey, 1.0, 1 FROM nation)
"""
SUPPLY = """
    snodes AS (
        SELECT 'supplier:' || s_suppkey AS node_id, s_name AS name FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region),
    sedges AS (
        SELECT 'supplier:' || s_suppkey AS subject, 'IN_NATION' AS predicate, 'nation:' || s_nationkey AS object, 1.0::DOUBLE AS confidence, 1 AS evidence_count FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey, 1.0, 1 FROM nation),
    sboth AS (SELECT subject AS a, object AS b, predicate FROM sedges UNION ALL SELECT object, subject, predicate FROM sedges)
"""
CLAIMS = """
    claims AS (
        SELECT 'claim:' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS claim_id, 'user:' || user_id AS subject,
               CASE WHEN event_type IN ('error', 'click') THEN 'CONTROLS' ELSE 'DIRECTOR_OF' END AS predicate,
               'band:' || (event_id % 7) AS object, CASE WHEN event_type = 'error' THEN 'neg' ELSE 'pos' END AS polarity,
               CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS t_valid, CAST(NULL AS VARCHAR) AS t_invalid,
               round((event_id % 100) / 100, 2) AS confidence, 'doc:' || (event_id % 13) AS doc_id
        FROM events)
"""
