"""Java sources written from the rows of ``part``: code of any size whose graph SQL can derive from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.wholegraph import whole_edges, whole_graph
from codeweft.operators.javagraph import JavaTables
from codeweft.plans.tabletree import once
from codeweft.sources import java
from codeweft.storage import dealt, materialize, table

#: For each part k of size s: its class, the class of k / 2 that it calls, and what s adds to it.
CODE_SQL = """
c AS (SELECT p_partkey AS k, p_partkey // 2 AS k2, p_size AS s, 'shop.g' || p_partkey % 10 || '.P' || p_partkey AS fqn,
  'shop.g' || p_partkey // 2 % 10 || '.P' || p_partkey // 2 AS fqn2, 'src/main/java/shop/g' || p_partkey % 10 || '/P' || p_partkey || '.java' AS file FROM part),
d AS (SELECT c.*, o.s AS s2, o.k IS NOT NULL AS known FROM c LEFT JOIN c o ON o.k = c.k2)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """``relative_path, content``: one file for each part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    other = F.expr("p_partkey div 2")  # k / 2 is a double, which is not exact for keys beyond 2^53
    text = lambda c: c.cast("string")
    fill = F.format_string(
        "package shop.g%s;\n\nimport shop.g%s.P%s;\n\n%spublic class P%s {\n%s    private P%s next;\n\n    public String run(int n) throws IllegalStateException {\n        return next.run(%s);\n    }\n%s%s}\n",
        text(k % 10), text(other % 10), text(other), F.when(s % 5 == 0, "@Service\n").when(s % 5 == 1, "@RestController\n").otherwise(""), text(k),
        F.when(s % 5 == 0, "    @Autowired\n").otherwise(""), text(other), text(k),
        F.when(s % 5 == 1, F.format_string("\n    @GetMapping(\"/p/%s\")\n    public String get() {\n        return run(1);\n    }\n", text(k))).otherwise(""),
        F.when(s % 4 == 0, F.format_string("\n    void load() {\n        jdbc.query(\"SELECT a FROM t%s WHERE id = %s\");\n    }\n", text(s), text(k))).otherwise(""),
    )
    path = F.format_string("src/main/java/shop/g%s/P%s.java", text(k % 10), text(k))
    return dealt(table(spark, sf, "part").select("p_partkey", "p_size")).select(path.alias("relative_path"), F.encode(fill, "UTF-8").alias("content"))


def java_tables(spark: SparkSession, sf: str) -> JavaTables:
    return once(spark, sf, "code-java", lambda: (JavaTables(java.parse_files(sources(spark, sf))),))[0]


def edges(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    """The whole graph's edges of some types, and no more than these need."""
    return whole_edges(java_tables(spark, sf), sources(spark, sf), types)


def graph(spark: SparkSession, sf: str) -> tuple[JavaTables, DataFrame, DataFrame, DataFrame]:
    """(tables, nodes, edges, sources) of that code."""

    def make():
        own, parsed = sources(spark, sf), java_tables(spark, sf)
        nodes, edges = whole_graph(parsed, own)
        return parsed, materialize(nodes, "nodes"), edges, own

    return once(spark, sf, "code-graph", make)
