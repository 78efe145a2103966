"""The rows behind report pages: each page is one or two aggregates over the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import short_id, simple_name
from codeweft.operators.graph import IMPACT_TYPES, entrypoints, impact_related
from codeweft.operators.spans import overlapping_spans
from codeweft.operators.traversal import call_flow, khop, reachable
from codeweft.sources.files import application_style, java_lines
from codeweft.storage import materialize

# Fixed values of the data model: layers in order, each with the stereotypes and the parts of package names that put a type there.
LAYERS = [
    ("Controller/API", ["RestController", "Controller"], ["controller", "web", "rest", "api", "resource", "endpoint"]),
    ("Service", ["Service"], ["service", "svc", "usecase", "application"]),
    ("Repository/DAO", ["Repository"], ["repository", "repo", "dao", "persistence", "store", "mapper"]),
    ("Configuration", ["Configuration"], ["config", "configuration"]),
    ("ETL/Spark", [], ["etl", "job", "spark", "pipeline", "batch"]),
    ("Domain/Model", [], ["domain", "model", "entity", "dto", "dbo", "vo", "pojo"]),
    ("Integration", [], ["client", "gateway", "integration", "external", "adapter"]),
    ("Utility", [], ["util", "utils", "helper", "common", "support"]),
]
SPARK_LAYER, NO_LAYER = "ETL/Spark", "Unclassified"
TEST_ANNOTATIONS = ["Test", "ParameterizedTest"]


def layer_of(package: Column, stereotype: Column, spark_job: Column) -> Column:
    """The first layer whose stereotypes or parts of package names hold; a Spark job's type is of the Spark layer at its turn."""
    low, out = F.lower(F.coalesce(package, F.lit(""))), F.lit(NO_LAYER)
    for name, labels, parts in reversed(LAYERS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(low, F.lit(part))
        if labels:
            hit = hit | F.coalesce(stereotype.isin(labels), F.lit(False))
        if name == SPARK_LAYER:
            hit = hit | F.coalesce(spark_job, F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out


def looks_like_test() -> Column:
    """Whether a node is a test: by a part of its name before the ``#``, or an annotation."""
    name = F.split_part(F.coalesce("fqn", "owner", "id"), F.lit("#"), F.lit(1))
    noted = F.exists(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: simple_name(a).isin(TEST_ANNOTATIONS))
    return F.contains(name, F.lit("Test")) | F.contains(name, F.lit("test")) | noted


def find_impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> dict[str, DataFrame]:
    """Callers and callees of each seed within some calls, tests among the callers, and related ids by edge type."""
    callers, callees = khop(edges, seeds, max_depth, "in", ["CALLS"]), khop(edges, seeds, max_depth, "out", ["CALLS"])
    tests = nodes.where(looks_like_test())
    return {
        "direct_callers": callers.where("depth = 1"),
        "callers": callers,
        "callees": callees,
        "tests": callers.join(tests.select("id"), "id", "left_semi"),
        "related": impact_related(edges, seeds, IMPACT_TYPES),
    }


def impact_of_any(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> dict[str, DataFrame]:
    """What :func:`find_impact` finds around any of the seeds, by ``id, depth``: without pairs of a seed and a node, and without related ids."""
    callers, callees = reachable(edges, seeds, max_depth, "in", ["CALLS"]), reachable(edges, seeds, max_depth, "out", ["CALLS"])
    tests = nodes.where(looks_like_test())
    return {"direct_callers": callers.where("depth = 1"), "callers": callers, "callees": callees, "tests": callers.join(tests.select("id"), "id", "left_semi")}


def impact_summary(impact: dict[str, DataFrame]) -> DataFrame:
    """``what, n`` of distinct ids."""
    parts = [df.select("id").distinct().agg(F.lit(k).alias("what"), F.count("*").alias("n")).select("what", "n") for k, df in impact.items() if k != "related"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _endpoint_steps(edges: DataFrame, max_depth: int) -> DataFrame:
    """The call flow behind each endpoint's handler, with the ``endpoint``."""
    mapped = edges.where("type = 'MAPPED_TO'").groupBy(F.col("src").alias("endpoint")).agg(F.min("dst").alias("seed"))
    return mapped.join(call_flow(edges, mapped.select(F.col("seed").alias("id")), max_depth), "seed")


def endpoint_flows(nodes: DataFrame, edges: DataFrame, max_depth: int = 4, most: int = 10) -> DataFrame:
    """``endpoint, position, id, depth`` of the first steps behind each endpoint's handler."""
    return _endpoint_steps(edges, max_depth).where(F.col("position") <= most).select("endpoint", "position", "id", "depth")


def flow_lines(nodes: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """``endpoint, position, line``: each step as text, with the stereotype of its owner (``?`` without one) and its confidence."""
    owner = nodes.select("id", F.concat(F.lit("type:"), "owner").alias("owner_id"))
    label = nodes.where("stereotype IS NOT NULL").select(F.col("id").alias("owner_id"), "stereotype")
    found = _endpoint_steps(edges, max_depth).join(owner, "id", "left").join(label, "owner_id", "left")
    line = F.format_string("%s-> %s [%s] (%s)", F.repeat(F.lit("  "), F.col("depth")), short_id(F.col("id")), F.coalesce("stereotype", F.lit("?")), F.col("confidence"))
    return found.select("endpoint", "position", line.alias("line"))


def data_flow(nodes: DataFrame, edges: DataFrame, starts: int = 5, max_depth: int = 6, most: int = 10) -> DataFrame:
    """The first steps from the likeliest entry points."""
    first = entrypoints(nodes, edges).orderBy(F.desc("name_hint"), F.desc("call_count"), "id").limit(starts)
    return call_flow(edges, first.select("id"), max_depth).where(F.col("position") <= most)


def package_rollup(edges: DataFrame) -> DataFrame:
    """``package, files, types`` from CONTAINS and DECLARES edges."""
    files = edges.where("type = 'CONTAINS'").select(F.col("src").alias("package"), F.col("dst").alias("file"))
    types = edges.where("type = 'DECLARES'").select(F.col("src").alias("file"), F.col("dst").alias("declared"))
    both = files.join(types.where(F.col("declared").startswith("type:")), "file", "left")
    return both.groupBy(short_id(F.col("package")).alias("package")).agg(F.countDistinct("file").alias("files"), F.countDistinct("declared").alias("types"))


def table_statements(edges: DataFrame) -> DataFrame:
    """``table, reads, writes``: statements that use each table."""
    uses = edges.where(F.col("type").isin("READS_TABLE", "WRITES_TABLE"))
    return uses.groupBy(F.col("dst").alias("table")).agg(F.count_if(F.col("type") == "READS_TABLE").alias("reads"), F.count_if(F.col("type") == "WRITES_TABLE").alias("writes"))


def exception_pages(edges: DataFrame, most: int = 6) -> DataFrame:
    """``exception, thrown_by, caught_by``: the first methods of each, in order. Ranked first, so no list outgrows ``most``."""
    own = edges.where(F.col("type").isin("THROWS", "CATCHES")).select("type", F.col("dst").alias("exception"), "src").distinct()
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("type", "exception").orderBy("src"))).where(F.col("k") <= most)
    side = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("src"))))
    return first.groupBy("exception").agg(side("THROWS").alias("thrown_by"), side("CATCHES").alias("caught_by"))


def dependency_page(facts: DataFrame, most: int = 6) -> DataFrame:
    """``group, artifact, files, versions``: build files that ask for each dependency, and its first versions in order."""
    own = facts.where("fact = 'dependency'")
    files = own.groupBy("group", "artifact").agg(F.countDistinct("file").alias("files"))
    versions = own.where("value <> ''").select("group", "artifact", "value").distinct()
    versions = versions.withColumn("k", F.row_number().over(Window.partitionBy("group", "artifact").orderBy("value"))).where(F.col("k") <= most)
    versions = versions.groupBy("group", "artifact").agg(F.sort_array(F.collect_list("value")).alias("versions"))
    return files.join(versions, ["group", "artifact"], "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<string>")))


def logging_page(logged: DataFrame, interesting: DataFrame) -> DataFrame:
    """``what, key, n``: logging calls by level, methods that log, and methods worth a log line with and without one."""
    calls = logged.groupBy(F.col("level").alias("_k")).agg(F.sum("calls").alias("_n"))
    worth = interesting.groupBy(F.when(F.col("logged"), "logged").otherwise("unlogged").alias("_k")).agg(F.count("*").alias("_n"))
    return long_rows(calls=(calls, F.col("_k"), F.col("_n")), methods=_total(logged.select("fqn").distinct()), worth=(worth, F.col("_k"), F.col("_n")))


def layers(types: DataFrame, most: int = 60) -> DataFrame:
    """``layer, status, types, members`` of types(fqn, package, stereotype, spark_job).

    A layer is observed if a stereotype stands in it, else inferred; types of no layer are unknown.
    """
    placed = types.select("fqn", layer_of(F.col("package"), F.col("stereotype"), F.col("spark_job")).alias("layer"), F.col("stereotype").isNotNull().alias("seen"))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("fqn")))
    status = F.when(F.col("layer") == NO_LAYER, "unknown").when(F.bool_or("seen"), "observed").otherwise("inferred")
    members = F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.col("fqn"))))
    return ranked.groupBy("layer").agg(status.alias("status"), F.count("*").alias("types"), members.alias("members"))


def unresolved(nodes: DataFrame) -> DataFrame:
    return nodes.where("placeholder").select("id", "kind", "name")


def test_coverage(nodes: DataFrame, edges: DataFrame, max_depth: int = 4, most: int = 80) -> DataFrame:
    """Methods outside tests that no test reaches, the first in order; external placeholders do not count."""
    methods = nodes.where(F.col("kind").isin("Method", "Constructor") & ~F.coalesce("placeholder", F.lit(False)))
    is_test = looks_like_test()
    reached = reachable(edges, methods.where(is_test), max_depth, "out", ["CALLS"])
    return methods.where(~is_test).join(reached.select("id"), "id", "left_anti").select("id").orderBy("id").limit(most)


def long_rows(**parts: tuple[DataFrame, Column, Column]) -> DataFrame:
    """``what, key, n`` rows of several aggregates."""
    out = None
    for what, (df, key, n) in parts.items():
        part = df.select(F.lit(what).alias("what"), key.cast("string").alias("key"), n.cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _counted(df: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    return df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")), F.col("_k"), F.col("_n")


def _total(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    return df.agg(F.count("*").alias("_n")), F.lit(""), F.col("_n")


def sql_counts(nodes: DataFrame) -> DataFrame:
    """``what, key, n``: statements, those by type, those that parsed, and tables."""
    own = nodes.where("kind = 'SQLStatement'")
    return long_rows(statements=_total(own), by_type=_counted(own, "statement_type"), parsed_ok=_total(own.where("parsed_ok")), tables=_total(nodes.where("kind = 'Table'")))


def spring_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, key, n``: components by stereotype, endpoints, beans, exception handlers, injections."""
    return long_rows(
        stereotypes=_counted(nodes.where("stereotype IS NOT NULL"), "stereotype"), endpoints=_total(edges.where("type = 'MAPPED_TO'")), beans=_total(nodes.where("bean")),
        exception_handlers=_total(nodes.where("exception_handler")), injections=_total(edges.where("type = 'INJECTS'")),
    )


def spark_counts(jobs: DataFrame) -> DataFrame:
    """``what, key, n``: Spark jobs, their SQL calls, and the jobs that read or write each table."""
    uses = lambda c: jobs.select(F.explode(c).alias("t"))
    calls = jobs.agg(F.coalesce(F.sum("sql_calls"), F.lit(0)).alias("_n")), F.lit(""), F.col("_n")
    return long_rows(jobs=_total(jobs), sql_calls=calls, input_tables=_counted(uses("reads_tables"), "t"), output_tables=_counted(uses("writes_tables"), "t"))


def scan_stats(files: DataFrame, parsed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, key, n`` of a scan: files by kind, parsed files by status, nodes, edges, SQL and framework facts."""
    own = long_rows(files=_counted(files, "kind"), parsed=_counted(parsed, "status"), nodes=_counted(nodes, "kind"), edges=_counted(edges, "type"), unresolved=_total(nodes.where("placeholder")))
    part = lambda df, name: df.withColumn("what", F.concat(F.lit(name), "what"))
    return own.unionByName(part(sql_counts(nodes), "sql_")).unionByName(part(spring_counts(nodes, edges), "spring_"))


def sql_dashboard(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """``id, statement_type, tables_read, tables_written, callers``: each statement with the first of those that run it."""
    runs = edges.where("type = 'EXECUTES_SQL'").select(F.col("dst").alias("id"), "src").distinct()
    first = runs.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("src"))).where(F.col("k") <= most)
    callers = first.groupBy("id").agg(F.sort_array(F.collect_list("src")).alias("callers"))
    own = nodes.where("kind = 'SQLStatement'").select("id", "statement_type", "tables_read", "tables_written")
    return own.join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))


def endpoint_dashboard(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """``id, http_method, path, handler, steps``: endpoints by path and method, each with the first steps of its flow."""
    steps = endpoint_flows(nodes, edges, 8, most).groupBy(F.col("endpoint").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("steps"))
    own = nodes.where("kind = 'Endpoint'").select("id", "http_method", "path", "handler")
    return own.join(steps, "id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>"))).orderBy("path", "http_method")


def overview(files: DataFrame, build: DataFrame) -> DataFrame:
    """The one row of build facts with the style of the application, files and lines of Java."""
    own = java_lines(files)
    configured = files.agg(F.count_if(F.col("kind") == "spark_config").alias("n")).scalar() > 0
    row = build.withColumns({"files": own.select("files").scalar(), "java_lines": own.select("java_lines").scalar(), "_configured": configured})
    return application_style(row.withColumn("_spark", F.col("spark_version").isNotNull() | F.col("_configured"))).drop("_spark", "_configured")


def change_impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, max_depth: int = 4) -> DataFrame:
    """``what, id``: what a diff(path, status, lo, hi) touches.

    Symbols whose lines it changes, callers of these within some calls, tests among them, SQL statements and endpoints
    next to them; files that are new, deleted, or hold no known symbol.
    """
    kinds = ["Method", "Constructor", "Class", "Interface", "Enum", "Record"]
    known = nodes.where(F.col("kind").isin(kinds) & F.col("line_start").isNotNull() & ~F.coalesce("placeholder", F.lit(False)))
    known = known.select(F.col("id").alias("span_id"), "file", F.col("line_start").alias("lo"), F.col("line_end").alias("hi"))
    ranges = hunks.where("status <> 'A'").select(F.concat_ws("|", "path", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("range_id"), F.col("path").alias("file"), "lo", "hi")
    changed = materialize(overlapping_spans(ranges, known).select(F.col("span_id").alias("id")).distinct(), "changed")
    callers = reachable(edges, changed, max_depth, "in", ["CALLS"])
    tests = callers.join(nodes.where(looks_like_test()).select("id"), "id", "left_semi")
    # Statements and endpoints at the other end of an edge; no list of all that is related to one symbol is made.
    beside = edges.where(F.col("type").isin(IMPACT_TYPES))
    beside = beside.select(F.col("src").alias("near"), F.col("dst").alias("id")).unionByName(beside.select(F.col("dst").alias("near"), F.col("src").alias("id")))
    related = beside.where(F.col("id").startswith("sql:") | F.col("id").startswith("endpoint:")).join(changed.withColumnRenamed("id", "near"), "near", "left_semi").select("id")
    mapped = edges.where("type = 'MAPPED_TO'").join(changed.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    unmapped = hunks.where("status NOT IN ('A', 'D')").join(known.select(F.col("file").alias("path")), "path", "left_anti")
    parts = {
        "changed_symbol": changed, "impacted_caller": callers, "impacted_test": tests, "impacted_sql": related.where(F.col("id").startswith("sql:")),
        "impacted_endpoint": related.where(F.col("id").startswith("endpoint:")).unionByName(mapped), "new_file": hunks.where("status = 'A'").select(F.col("path").alias("id")),
        "deleted_file": hunks.where("status = 'D'").select(F.col("path").alias("id")), "unmapped_file": unmapped.select(F.col("path").alias("id")),
    }
    out = None
    for what, df in parts.items():
        part = df.select(F.lit(what).alias("what"), "id").distinct()
        out = part if out is None else out.unionByName(part)
    return out
