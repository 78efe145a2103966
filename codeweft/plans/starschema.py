"""A property graph over the star schema: nodes and edges in the engine's own form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.graph import first_edges
from codeweft.storage import table

NODE_SQL = """
SELECT 'region:' || r_regionkey AS id, 'Region' AS kind, r_name AS name, r_name AS fqn, CAST(NULL AS VARCHAR) AS owner FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 'world.' || n_name, 'region:' || n_regionkey FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'Method', c_name, c_mktsegment || '.' || c_name, c_mktsegment FROM customer
UNION ALL SELECT 'order:' || o_orderkey, 'Method', 'order', o_orderpriority || '.order' || o_orderkey, o_orderpriority FROM orders
UNION ALL SELECT 'part:' || p_partkey, 'Method', p_name, p_brand || '.' || p_name, p_brand FROM part
UNION ALL SELECT 'supplier:' || s_suppkey, 'Method', s_name, 'supply.' || s_name, 'supply' FROM supplier
"""

EDGE_SQL = """
SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'HIGH' AS confidence, 0 AS line FROM nation
UNION ALL SELECT 'DECLARES', 'nation:' || c_nationkey, 'customer:' || c_custkey, 'HIGH', 0 FROM customer
UNION ALL SELECT 'CALLS', 'customer:' || o_custkey, 'order:' || o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END, 0 FROM orders
UNION ALL SELECT 'CALLS', 'order:' || l_orderkey, 'part:' || l_partkey,
  CASE l_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END, min(l_linenumber) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'CALLS', 'part:' || l_partkey, 'supplier:' || l_suppkey, 'HIGH', 0 FROM lineitem GROUP BY l_partkey, l_suppkey
"""


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """``id, kind, name, fqn, owner`` of the six tables' rows."""

    def part(name: str, kind: str, key: str, as_kind: str, label, fqn, owner) -> DataFrame:
        return table(spark, sf, name).select(_id(kind, key).alias("id"), F.lit(as_kind).alias("kind"), label.alias("name"), fqn.alias("fqn"), owner.alias("owner"))

    c, dot = F.col, F.lit(".")
    parts = [
        part("region", "region", "r_regionkey", "Region", c("r_name"), c("r_name"), F.lit(None).cast("string")),
        part("nation", "nation", "n_nationkey", "Nation", c("n_name"), F.concat(F.lit("world."), "n_name"), _id("region", "n_regionkey")),
        part("customer", "customer", "c_custkey", "Method", c("c_name"), F.concat("c_mktsegment", dot, "c_name"), c("c_mktsegment")),
        part("orders", "order", "o_orderkey", "Method", F.lit("order"), F.concat("o_orderpriority", F.lit(".order"), c("o_orderkey").cast("string")), c("o_orderpriority")),
        part("part", "part", "p_partkey", "Method", c("p_name"), F.concat("p_brand", dot, "p_name"), c("p_brand")),
        part("supplier", "supplier", "s_suppkey", "Method", c("s_name"), F.concat(F.lit("supply."), "s_name"), F.lit("supply")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """``type, src, dst, confidence, line``: one edge for each distinct pair."""

    def part(df: DataFrame, kind: str, src, dst, confidence, line) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), confidence.alias("confidence"), line.alias("line"))

    high, zero = F.lit("HIGH"), F.lit(0)
    lines = table(spark, sf, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("LOW")
    quarter = F.col("l_partkey") % 4
    of_part = F.when(quarter == 0, "HIGH").when(quarter == 1, "MEDIUM").when(quarter == 2, "LOW").otherwise("UNKNOWN")
    out = part(table(spark, sf, "nation"), "CONTAINS", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), high, zero)
    out = out.unionByName(part(table(spark, sf, "customer"), "DECLARES", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), high, zero))
    out = out.unionByName(part(table(spark, sf, "orders"), "CALLS", _id("customer", "o_custkey"), _id("order", "o_orderkey"), status, zero))
    bought = part(lines, "CALLS", _id("order", "l_orderkey"), _id("part", "l_partkey"), of_part, F.col("l_linenumber"))
    supplied = lines.select("l_partkey", "l_suppkey").distinct()
    return out.unionByName(first_edges(bought, F.col("line"))).unionByName(part(supplied, "CALLS", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), high, zero))
