"""SQL statements: found in Java sources, split out of files, and read for the tables they use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import decoded, normal_sql, sql_identity, starts_like_sql
from codeweft.operators.spans import innermost_span
from codeweft.sources.java import entities
from codeweft.sources.sqlread import tables_of
from codeweft.storage import materialize

FACTS = "statement_type string, tables_read array<string>, tables_written array<string>, parsed_ok boolean"


def statement_facts(sql: Column | str) -> Column:
    """What :func:`tables_of` finds in each statement; a null is an unknown one."""
    names = [c.split(" ")[0] for c in FACTS.split(", ")]
    return F.pandas_udf(lambda texts: pd.DataFrame([tables_of(x or "") for x in texts], columns=names), FACTS)(sql)


def java_statements(parsed: DataFrame) -> DataFrame:
    """``file, sql, line, origin`` of the statements in parsed Java files: queries, and literals that begin like one."""
    found = entities(parsed, "texts").where((F.col("text") != "") & ((F.col("origin") != "java-literal") | starts_like_sql(F.col("text"))))
    return found.select("file", F.col("text").alias("sql"), "line", "origin")


def file_statements(sources: DataFrame) -> DataFrame:
    """The same of sources(relative_path, content) that hold nothing but SQL.

    A file is cut at every semicolon; a piece's line follows from the newlines of the pieces before it.
    """
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    cut = sources.select(F.col("relative_path").alias("file"), F.posexplode(F.split(decoded("content"), ";")).alias("n", "piece"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("first", F.coalesce(F.sum(newlines(F.col("piece"))).over(before), F.lit(0)) + 1)
    # Whole comment lines before a statement are no part of it.
    body = cut.withColumn("lines", F.split(F.regexp_replace("piece", r"^\s+|\s+$", ""), "\n"))
    note = lambda x: F.ltrim(x).startswith("--")
    kept = F.array_position(F.transform("lines", lambda x: ~note(x)), F.lit(True)).cast("int")
    body = body.withColumn("kept", kept).where("kept > 0")
    text = F.regexp_replace(F.array_join(F.slice("lines", F.col("kept"), F.size("lines")), "\n"), r"^\s+|\s+$", "")
    found = body.select("file", text.alias("sql"), (F.col("first") + F.col("kept") - 1).cast("int").alias("line"), F.lit("sql-file").alias("origin"))
    return found.where("sql <> ''")


def statements(hits: DataFrame, methods: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements by identity with their sources, graph edges) of hits(file, sql, line, origin).

    A hit belongs to the innermost of methods(fqn, file, lo, hi) around its line, else to its file. What was read of a
    statement before can be given: known(id, statement_type, tables_read, tables_written, parsed_ok).
    """
    hits = hits.withColumn("id", sql_identity(F.col("sql"))).withColumn("point_id", F.concat_ws("|", "file", F.col("line").cast("string")))
    owners = innermost_span(hits.select("point_id", "file", "line").distinct(), methods.select(F.col("fqn").alias("span_id"), "file", "lo", "hi"))
    placed = hits.join(owners, "point_id", "left").withColumn("src", F.coalesce(F.concat(F.lit("method:"), "span_id"), F.concat(F.lit("file:"), "file")))
    grouped = placed.groupBy("id").agg(
        F.min_by("sql", F.struct("file", "line")).alias("sql"),
        F.sort_array(F.collect_set(F.struct("src", "file", "line"))).alias("sources"),
        F.sort_array(F.collect_set("origin")).alias("origins"),
    )
    facts = ["statement_type", "tables_read", "tables_written", "parsed_ok"]
    shown = ["id", F.substring(normal_sql(F.col("sql")), 1, 500).alias("text"), "sources", "origins"]
    fresh = grouped if known is None else grouped.join(known.select("id"), "id", "left_anti")
    found = fresh.select(*shown, statement_facts("sql").alias("p")).select("id", "p.*", "text", "sources", "origins")
    if known is not None:
        found = found.unionByName(grouped.join(known.select("id", *facts), "id").select("id", *facts, *shown[1:]))
    found = materialize(found, "statements")
    sure = F.when(~F.col("parsed_ok") | (F.array_contains("origins", "jpa-query") & (F.size("origins") == 1)), "MEDIUM").otherwise("HIGH")
    runs = found.select(F.lit("EXECUTES_SQL").alias("type"), F.explode("sources.src").alias("src"), F.col("id").alias("dst"), F.lit("HIGH").alias("confidence")).distinct()
    uses = [found.select(F.lit(t).alias("type"), F.col("id").alias("src"), F.explode(F.transform(c, lambda x: F.concat(F.lit("table:"), x))).alias("dst"), sure.alias("confidence")) for t, c in (("READS_TABLE", "tables_read"), ("WRITES_TABLE", "tables_written"))]
    return found, runs.unionByName(uses[0]).unionByName(uses[1])
