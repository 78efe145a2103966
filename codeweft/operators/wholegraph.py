"""The whole graph of a source tree: Java declarations and references, web, Spark and SQL facts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators import frameworks
from codeweft.operators.graph import first_edges, merge_nodes
from codeweft.operators.javagraph import EDGE_TYPES, JavaTables, declared, java_edges, java_graph
from codeweft.sources import sqltext
from codeweft.storage import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), column)


#: Types of edges that web, Spark and SQL facts give; Java files give none of these.
WEB_TYPES, TABLE_TYPES = ("EXPOSES", "MAPPED_TO", "INJECTS", "HANDLES"), ("READS_TABLE", "WRITES_TABLE")
MORE_TYPES = (*WEB_TYPES, *TABLE_TYPES, "EXECUTES_SQL")


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, confidence: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), (F.lit("HIGH") if confidence is None else confidence).alias("confidence"), "file", F.col("line").cast("int").alias("line"))


def _facts(j: JavaTables) -> list[DataFrame]:
    """Nodes and properties of nodes by web and Spark facts."""
    e = frameworks.endpoints(j)
    note = lambda name: F.exists("annotations", lambda a: F.substring_index(a["name"], ".", -1) == name)
    component = j.methods.join(frameworks.stereotypes(j).select(F.col("fqn").alias("owner_fqn")), "owner_fqn", "left_semi")
    jobs, real = frameworks.spark_jobs(j), F.lit(False).alias("placeholder")
    return [
        frameworks.stereotypes(j).select(_id("type", "fqn").alias("id"), "stereotype", real),
        e.select("id", F.lit("Endpoint").alias("kind"), F.concat_ws(" ", "http_method", "path").alias("name"), "http_method", "path", "controller", "handler", "file", F.col("line").alias("line_start"), "line_end", real),
        component.where(note("Bean")).select(_id("method", "fqn").alias("id"), F.lit(True).alias("bean"), real),
        component.where(note("ExceptionHandler")).select(_id("method", "fqn").alias("id"), F.lit(True).alias("exception_handler"), real),
        jobs.select(_id("method", "method").alias("id"), F.lit(True).alias("spark_job"), F.col("transformations").alias("spark_transformations"), F.col("actions").alias("spark_actions"), real),
    ]


def _links(j: JavaTables, types: Iterable[str]) -> list[DataFrame]:
    """Edges of some types by web and Spark facts."""
    links = []
    if {"EXPOSES", "MAPPED_TO"} & set(types):
        e = frameworks.endpoints(j)
        links += [_edge(e, "EXPOSES", _id("type", "controller"), F.col("id")), _edge(e, "MAPPED_TO", F.col("id"), _id("method", "handler"))]
    if "INJECTS" in types:
        injected = frameworks.injections(j).join(j.types.select(F.col("fqn").alias("src"), "file", F.col("location.line_start").alias("line")), "src")
        links.append(_edge(injected, "INJECTS", _id("type", "src"), _id("type", "dst"), F.col("confidence")))
    if "HANDLES" in types:
        links.append(_edge(frameworks.handles(j), "HANDLES", F.col("src"), F.col("dst"), F.col("confidence")))
    if set(TABLE_TYPES) & set(types):
        placed = frameworks.spark_jobs(j).join(j.methods.select(F.col("fqn").alias("method"), "file", F.col("location.line_start").alias("line")), "method")
        for kind, tables in (("READS_TABLE", "reads_tables"), ("WRITES_TABLE", "writes_tables")):
            links.append(_edge(placed.select("method", "file", "line", F.explode(tables).alias("t")), kind, _id("method", "method"), _id("table", "t"), F.lit("MEDIUM")))
    return links


def _sql(j: JavaTables, sources: DataFrame, statements: DataFrame | None) -> tuple[list[DataFrame], DataFrame]:
    """(nodes, edges) of SQL files and statements."""
    files = sources.where(F.lower("relative_path").endswith(".sql"))
    hits = sqltext.java_statements(j.parsed).unionByName(sqltext.file_statements(files))
    methods = j.methods.select("fqn", "file", F.col("location.line_start").alias("lo"), F.col("location.line_end").alias("hi"))
    found, uses = sqltext.statements(materialize(hits, "sql-hits"), methods, statements)
    real = F.lit(False).alias("placeholder")
    facts = [
        files.select(_id("file", "relative_path").alias("id"), F.lit("SourceFile").alias("kind"), F.col("relative_path").alias("name"), F.col("relative_path").alias("file"), F.lit("sql").alias("file_kind"), real),
        found.select("id", F.lit("SQLStatement").alias("kind"), F.col("id").alias("name"), "statement_type", "parsed_ok", "text", "tables_read", "tables_written", "origins", real),
    ]
    return facts, uses.select("type", "src", "dst", "confidence", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


def _merged(parts: list[DataFrame]) -> DataFrame:
    return merge_nodes(_union(parts).withColumn("ordinal", F.coalesce("file", F.lit(""))))


def declared_nodes(j: JavaTables) -> DataFrame:
    """The nodes that Java files declare, with their web and Spark facts, and endpoints; of the whole graph's nodes all but
    statements, tables, SQL files and placeholders."""
    return _merged([declared(j), *_facts(j)])


def whole_edges(j: JavaTables, sources: DataFrame, types: Iterable[str]) -> DataFrame:
    """The whole graph's edges of some types; what only other types need is neither read nor resolved."""
    parts, links = [], _links(j, types)
    if set(types) & set(EDGE_TYPES):
        parts.append(java_edges(j, types))
    if set(types) & {*TABLE_TYPES, "EXECUTES_SQL"}:
        links.append(_sql(j, sources, None)[1])
    if links:
        parts.append(first_edges(_union(links), F.struct("file", "line")))
    return _union(parts).where(F.col("type").isin(*types))


def whole_graph(j: JavaTables, sources: DataFrame, statements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed Java tables and of sources(relative_path, content), whose ``.sql`` files are read too.

    ``statements`` can hold what was read of SQL statements before, by id. Facts about a node that is there already are merged into it; an end that nothing describes becomes a placeholder.
    """
    nodes, edges = java_graph(j)
    nodes, more = _with_facts(j, materialize(nodes, "java-nodes"), sources, statements)
    return nodes, _union([edges, more])


def fact_graph(j: JavaTables, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of declarations and of web, Spark and SQL facts: the whole graph without the edges of Java code and the
    placeholders that only these name."""
    return _with_facts(j, merge_nodes(declared(j).withColumn("ordinal", F.col("file"))), sources)


def _with_facts(j: JavaTables, nodes: DataFrame, sources: DataFrame, statements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with web, Spark and SQL facts and the ends of their edges, these edges)."""
    facts, uses = _sql(j, sources, statements)
    facts = [*_facts(j), *facts]
    more = materialize(first_edges(_union([*_links(j, MORE_TYPES), uses]), F.struct("file", "line")), "more-edges")
    known = nodes.select("id").unionByName(_union(facts).select("id"))
    ends = more.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
    return _merged([nodes, *facts, _ends(ends)]), more


def _ends(ends: DataFrame) -> DataFrame:
    """Nodes of ends(id) that nothing describes."""
    name = F.regexp_replace("id", "^[^:]*:", "")
    table = F.col("id").startswith("table:")
    return ends.select("id", F.when(table, "Table").otherwise("Type").alias("kind"), F.when(table, name).otherwise(F.substring_index(name, ".", -1)).alias("name"), (~table).alias("placeholder"))
