"""Property graphs as two tables, and the questions asked of them.

``nodes``: id, kind, name, fqn and further columns; ``edges``: type, src, dst, confidence, evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import ENTRY_NAMES

IMPACT_TYPES = [
    "CALLS", "IMPLEMENTS", "EXTENDS", "OVERRIDES", "INJECTS", "EXPOSES", "MAPPED_TO", "EXECUTES_SQL", "READS_TABLE",
    "WRITES_TABLE", "USES_TYPE",
]


def first_edges(edges: DataFrame, ordinal: Column) -> DataFrame:
    """One edge for each (type, src, dst): the one with the least ordinal. Combines before the shuffle."""
    rest = [c for c in edges.columns if c not in ("type", "src", "dst")]
    kept = edges.groupBy("type", "src", "dst").agg(F.min_by(F.struct(*rest), ordinal).alias("_first"))
    return kept.select("type", "src", "dst", *[F.col(f"_first.{c}").alias(c) for c in rest])


def merge_nodes(nodes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One node for each id: a real one replaces placeholders; of each property the first value wins."""
    order = F.struct(F.coalesce(F.col("placeholder"), F.lit(False)), F.col(ordinal))
    rest = [c for c in nodes.columns if c not in ("id", ordinal)]
    first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return nodes.groupBy("id").agg(*first)


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two node or edge tables; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form: nodes by kind, edges by type, calls by confidence, unresolved nodes."""
    part = lambda df, column, what: counts_by(df, column).select(F.lit(what).alias("what"), "key", "n")
    unresolved = nodes.where(F.coalesce(F.col("placeholder"), F.lit(False))).agg(F.count("*").alias("n"))
    return (
        part(nodes, "kind", "nodes")
        .unionByName(part(edges, "type", "edges"))
        .unionByName(part(edges.where("type = 'CALLS'"), "confidence", "calls"))
        .unionByName(unresolved.select(F.lit("unresolved").alias("what"), F.lit("").alias("key"), "n"))
    )


def resolution_rate(edges: DataFrame) -> DataFrame:
    """Calls, calls whose target is known, and their share; null without calls."""
    calls = edges.where("type = 'CALLS'")
    found = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("confidence") != "UNKNOWN").alias("resolved"))
    return found.select("calls", "resolved", F.round(F.try_divide("resolved", "calls"), 3).alias("rate"))


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ids(id); ids that are no node have no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def find_nodes(nodes: DataFrame, kind: str | None = None, name_contains: str | None = None, fqn: str | None = None) -> DataFrame:
    """Nodes for which all given conditions hold; the part of a name is sought in id, name and fqn."""
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    if fqn is not None:
        nodes = nodes.where(F.col("fqn") == fqn)
    if name_contains is not None:
        part = F.lit(name_contains.lower())
        nodes = nodes.where(F.contains(F.lower("id"), part) | F.contains(F.lower("name"), part) | F.coalesce(F.contains(F.lower("fqn"), part), F.lit(False)))
    return nodes


def resolve_symbol(nodes: DataFrame, term: str) -> DataFrame:
    """At most one id: the term itself, then with a namespace, then as fqn or name, then as part of a name."""
    prefixes = ["", "method:", "type:", "field:", "endpoint:", "table:"]
    exact = F.lit(None)
    for i, p in reversed(list(enumerate(prefixes))):
        exact = F.when(F.col("id") == p + term, F.lit(i)).otherwise(exact)
    by_name = F.when((F.col("fqn") == term) | (F.col("name") == term), 10).otherwise(11)
    found = find_nodes(nodes, name_contains=term).withColumn("priority", F.coalesce(exact, by_name))
    return found.orderBy("priority", F.length("id"), "id").limit(1).select("id")


def neighbors(edges: DataFrame, nodes: DataFrame, node_ids: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """``id, direction, type, other, confidence, other_kind, other_name`` around each id of ``node_ids``."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    sides = []
    for way, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (way, "both"):
            own = edges.select(F.col(near).alias("id"), F.col(far).alias("other"), "type", "confidence", F.lit(way).alias("direction"))
            sides.append(own.join(node_ids, "id", "left_semi"))
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return found.join(nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name")), "other", "left")


def sources_of(edges: DataFrame, types: list[str], target: str) -> DataFrame:
    """Distinct sources of edges into a node: callers, implementations, overriding methods."""
    return edges.where(F.col("type").isin(types) & (F.col("dst") == target)).select(F.col("src").alias("id")).distinct()


def sources_of_each(edges: DataFrame, types: list[str], targets: DataFrame) -> DataFrame:
    """``target, id``: distinct sources of edges into each of targets(id)."""
    into = edges.where(F.col("type").isin(types)).select(F.col("dst").alias("target"), F.col("src").alias("id")).distinct()
    return into.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def targets_of(edges: DataFrame, types: list[str], source: str) -> DataFrame:
    return edges.where(F.col("type").isin(types) & (F.col("src") == source)).select(F.col("dst").alias("id")).distinct()


def impact_related(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None) -> DataFrame:
    """For each seed and edge type, the ids at the other end in either direction, in order."""
    edges = edges.where(F.col("type").isin(types or IMPACT_TYPES))
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type"))
    return both.join(seeds, "id", "left_semi").groupBy("id", "type").agg(F.sort_array(F.collect_set("other")).alias("related"))


def entrypoints(nodes: DataFrame, edges: DataFrame, target_prefix: str = "method:") -> DataFrame:
    """Methods that nothing calls or maps to and that call something: ``id, name_hint, call_count``.

    Placeholders, Spark jobs and methods whose owner's name holds "test" are left out. In order,
    likely entry names come first, then those with more calls.
    """
    calls = edges.where("type = 'CALLS'")
    methods = nodes.where(
        F.col("kind").isin("Method", "Constructor")
        & ~F.coalesce(F.col("placeholder"), F.lit(False))
        & ~F.coalesce(F.col("spark_job"), F.lit(False))
        & ~F.contains(F.lower(F.coalesce("owner", F.lit(""))), F.lit("test"))
    )
    fan = calls.where(F.col("dst").startswith(target_prefix)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("call_count"))
    called = calls.select(F.col("dst").alias("id")).unionByName(edges.where("type = 'MAPPED_TO'").select(F.col("dst").alias("id"))).distinct()
    return methods.join(fan, "id").join(called, "id", "left_anti").select("id", F.col("name").isin(ENTRY_NAMES).alias("name_hint"), "call_count")


def table_usage(edges: DataFrame) -> DataFrame:
    """``table, read_by, written_by``: methods that run statements on a table, or use it themselves."""
    uses = edges.where(F.col("type").isin("READS_TABLE", "WRITES_TABLE")).select("type", F.col("src").alias("user"), F.col("dst").alias("table"))
    runs = edges.where("type = 'EXECUTES_SQL'").select(F.col("dst").alias("user"), F.col("src").alias("method"))
    by = uses.join(runs, "user", "left").withColumn("by", F.when(F.col("user").startswith("sql:"), F.col("method")).otherwise(F.col("user")))
    side = lambda kind: F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.col("by"))))
    return by.groupBy("table").agg(side("READS_TABLE").alias("read_by"), side("WRITES_TABLE").alias("written_by"))


def uncovered(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes that are not among the reached ids."""
    return nodes.join(reached.select("id").distinct(), "id", "left_anti")
