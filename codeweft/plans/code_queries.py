"""Queries of the operators that read source code, over code written from the rows of ``part``; SQL derives the same facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import context, frameworks, graph, incremental, reports, spans
from codeweft.operators.graph import first_edges
from codeweft.operators.javagraph import EDGE_TYPES, java_edges
from codeweft.operators.wholegraph import MORE_TYPES
from codeweft.plans import tablecode, tabletree as tree
from codeweft.sources import build, config, files, git, java, sqltext
from codeweft.storage import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def from_tree(sql: str):
    """Register with an oracle that derives the rows from ``part``, for the tree of :mod:`codeweft.plans.tabletree`."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {tree.TREE_SQL} {sql}"
        return f

    return add


def _tables(spark, sf):
    return tree.java_tables(spark, sf)


#: Lines of a class file: nine line ends, those of its parts, and the last line.
LINES = "10 + (s % 6 = 0)::INT * 6 + (s % 7 < 3)::INT + (s % 2 = 0)::INT + (s % 4 = 1)::INT + (s % 3 = 0)::INT * 5 + (s % 5 = 0)::INT * 4 + (s % 7 = 0)::INT * 8"
YML, PROPERTIES_FILE = "'conf/g' || k % 10 || '/application-' || k || '.yml'", "'conf/g' || k % 10 || '/extra-' || k || '.properties'"
INVENTORY = f"""SELECT file AS relative_path, 'java_main' AS kind, {LINES} AS lines FROM d UNION ALL SELECT test, 'java_test', 11 FROM d WHERE s % 8 = 0
UNION ALL SELECT {YML}, 'app_config', 7 FROM d WHERE s % 9 = 0 UNION ALL SELECT {PROPERTIES_FILE}, 'build_other', 7 FROM d WHERE s % 9 = 1
UNION ALL SELECT 'db/f' || k || '.sql', 'sql', 8 FROM d WHERE s % 10 = 0 UNION ALL SELECT 'm' || k || '/pom.xml', 'maven_pom', 7 FROM d WHERE s % 11 = 0
UNION ALL SELECT 'm' || k || '/build.gradle', 'gradle_build', 10 FROM d WHERE s % 11 = 1"""


@from_tree(f"SELECT relative_path, kind, lines::INT AS lines FROM ({INVENTORY})")
def file_inventory(spark, sf):
    return files.inventory(tree.files(spark, sf)).select("relative_path", "kind", "lines")


@from_tree("""SELECT 'types' AS entity, file, fqn FROM d UNION ALL SELECT 'types', file, pkg || '.Trouble' || k FROM d WHERE s % 7 = 0 UNION ALL SELECT 'types', test, fqn || 'Test' FROM d WHERE s % 8 = 0
UNION ALL SELECT 'fields', test, fqn || 'Test#own' FROM d WHERE s % 8 = 0 UNION ALL SELECT 'methods', test, fqn || 'Test#runs()' FROM d WHERE s % 8 = 0
UNION ALL SELECT 'methods', file, fqn || '#code(int)' FROM d UNION ALL SELECT 'methods', file, fqn || '#save(String)' FROM d WHERE s % 5 = 0
UNION ALL SELECT 'methods', file, fqn || '#job(SparkSession)' FROM d WHERE s % 6 = 0 UNION ALL SELECT 'methods', file, fqn || '#failed(Trouble' || k || ')' FROM d WHERE s % 7 = 0
UNION ALL SELECT 'imports', file, fqn2 FROM d UNION ALL SELECT 'imports', file, 'org.apache.spark.sql.SparkSession' FROM d WHERE s % 6 = 0""")
def java_entities(spark, sf):
    parsed = materialize(java.parse_files(tree.files(spark, sf, "class", "test")), "parsed")
    part = lambda what, name: java.entities(parsed, what).select(F.lit(what).alias("entity"), "file", F.col(name).alias("fqn"))
    return part("types", "fqn").unionByName(part("fields", "fqn")).unionByName(part("methods", "fqn")).unionByName(part("imports", "fqn"))


@from_tree("""SELECT n + t + b AS files, n + t AS success, b AS partial, CAST(0 AS BIGINT) AS failed, round(100.0::DOUBLE * (n + t) / (n + t + b), 1) AS rate
FROM (SELECT count(*) AS n, count(*) FILTER (s % 8 = 0) AS t, count(*) FILTER (s % 13 = 0) AS b FROM d)""")
def parse_report(spark, sf):
    both = tree.files(spark, sf, "class", "test").select("relative_path", "content").unionByName(tree.broken(spark, sf))
    return java.parse_report(java.parse_files(both))


JOB, SAVE, FAILED = "'method:' || fqn || '#job(SparkSession)'", "'method:' || fqn || '#save(String)'", "'method:' || fqn || '#failed(Trouble' || k || ')'"
RUNS, TROUBLE = "'method:' || fqn || 'Test#runs()'", "'type:' || pkg || '.Trouble' || k"
CALLS = f"""SELECT 'CALLS' AS type, code AS src, 'method:' || above || '#code(int)' AS dst, CASE WHEN k2 = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM a
UNION ALL SELECT 'CALLS', code, 'extmethod:super.code', 'UNKNOWN' FROM d WHERE NOT known UNION ALL SELECT 'CALLS', code, 'extmethod:log.warn', 'UNKNOWN' FROM d WHERE s % 4 = 1
UNION ALL SELECT 'CALLS', {SAVE}, 'extmethod:jdbc.update', 'UNKNOWN' FROM d WHERE s % 5 = 0
UNION ALL SELECT 'CALLS', {RUNS}, code, CASE WHEN known THEN 'LOW' ELSE 'HIGH' END FROM d WHERE s % 8 = 0 UNION ALL SELECT 'CALLS', {RUNS}, 'method:' || above || '#code(int)', 'LOW' FROM a WHERE s % 8 = 0"""


@from_tree(f""", o AS (SELECT a.*, c.s AS s2 FROM a JOIN c ON c.k = a.k >> a.i) {CALLS} UNION ALL SELECT 'CONTAINS', 'package:' || pkg, 'file:' || file, 'HIGH' FROM d UNION ALL SELECT 'CONTAINS', 'package:' || pkg, 'file:' || test, 'HIGH' FROM d WHERE s % 8 = 0
UNION ALL SELECT 'IMPORTS', 'file:' || file, 'type:' || fqn2, 'HIGH' FROM d UNION ALL SELECT 'IMPORTS', 'file:' || file, 'type:org.apache.spark.sql.SparkSession', 'HIGH' FROM d WHERE s % 6 = 0
UNION ALL SELECT 'DECLARES', 'file:' || file, 'type:' || fqn, 'HIGH' FROM d UNION ALL SELECT 'DECLARES', 'file:' || file, {TROUBLE}, 'HIGH' FROM d WHERE s % 7 = 0
UNION ALL SELECT 'DECLARES', 'file:' || test, 'type:' || fqn || 'Test', 'HIGH' FROM d WHERE s % 8 = 0 UNION ALL SELECT 'DECLARES', 'type:' || fqn || 'Test', {RUNS}, 'HIGH' FROM d WHERE s % 8 = 0
UNION ALL SELECT 'DECLARES', 'type:' || fqn || 'Test', 'field:' || fqn || 'Test#own', 'HIGH' FROM d WHERE s % 8 = 0 UNION ALL SELECT 'DECLARES', 'type:' || fqn, code, 'HIGH' FROM d
UNION ALL SELECT 'DECLARES', 'type:' || fqn, {SAVE}, 'HIGH' FROM d WHERE s % 5 = 0 UNION ALL SELECT 'DECLARES', 'type:' || fqn, {JOB}, 'HIGH' FROM d WHERE s % 6 = 0
UNION ALL SELECT 'DECLARES', 'type:' || fqn, {FAILED}, 'HIGH' FROM d WHERE s % 7 = 0
UNION ALL SELECT 'EXTENDS', 'type:' || fqn, 'type:' || fqn2, CASE WHEN known THEN 'HIGH' ELSE 'MEDIUM' END FROM d UNION ALL SELECT 'EXTENDS', {TROUBLE}, 'type:java.lang.Exception', 'MEDIUM' FROM d WHERE s % 7 = 0
UNION ALL SELECT 'ANNOTATED_WITH', 'type:' || fqn, 'type:' || ['RestControllerAdvice', 'Service', 'Repository'][s % 7 + 1], 'UNKNOWN' FROM d WHERE s % 7 < 3
UNION ALL SELECT 'ANNOTATED_WITH', code, 'type:java.lang.Override', 'MEDIUM' FROM d WHERE s % 2 = 0 UNION ALL SELECT 'ANNOTATED_WITH', {FAILED}, 'type:ExceptionHandler', 'UNKNOWN' FROM d WHERE s % 7 = 0
UNION ALL SELECT 'ANNOTATED_WITH', {RUNS}, 'type:Test', 'UNKNOWN' FROM d WHERE s % 8 = 0 UNION ALL SELECT 'THROWS', {SAVE}, 'type:Problem', 'UNKNOWN' FROM d WHERE s % 5 = 0
UNION ALL SELECT 'USES_TYPE', {SAVE}, 'type:java.lang.String', 'MEDIUM' FROM d WHERE s % 5 = 0 UNION ALL SELECT 'USES_TYPE', {JOB}, 'type:org.apache.spark.sql.SparkSession', 'MEDIUM' FROM d WHERE s % 6 = 0
UNION ALL SELECT 'USES_TYPE', {FAILED}, {TROUBLE}, 'HIGH' FROM d WHERE s % 7 = 0 UNION ALL SELECT 'USES_TYPE', 'field:' || fqn || 'Test#own', 'type:' || fqn, 'HIGH' FROM d WHERE s % 8 = 0
UNION ALL SELECT 'RETURNS_TYPE', {FAILED}, 'type:java.lang.String', 'MEDIUM' FROM d WHERE s % 7 = 0 UNION ALL SELECT 'CREATES', code, 'type:java.lang.IllegalStateException', 'MEDIUM' FROM d WHERE s % 3 = 0
UNION ALL SELECT 'CATCHES', code, 'type:java.lang.IllegalArgumentException', 'MEDIUM' FROM d WHERE s % 3 = 0
UNION ALL SELECT 'CATCHES', code, CASE WHEN s % 7 = 0 THEN {TROUBLE} ELSE 'type:Trouble' || k END, CASE WHEN s % 7 = 0 THEN 'HIGH' ELSE 'UNKNOWN' END FROM d WHERE s % 3 = 0
UNION ALL SELECT 'OVERRIDES', code, 'method:' || above || '#code(int)', CASE WHEN s % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END FROM a
UNION ALL SELECT 'OVERRIDES', {JOB}, 'method:' || above || '#job(SparkSession)', 'MEDIUM' FROM o WHERE s % 6 = 0 AND s2 % 6 = 0 UNION ALL SELECT 'OVERRIDES', {SAVE}, 'method:' || above || '#save(String)', 'MEDIUM' FROM o WHERE s % 5 = 0 AND s2 % 5 = 0
UNION ALL SELECT 'OVERRIDES', {FAILED}, 'method:' || above || '#failed(Trouble' || (k >> i) || ')', 'MEDIUM' FROM o WHERE s % 7 = 0 AND s2 % 7 = 0""")
def java_graph(spark, sf):
    """Every edge of the Java files but the calls inside jobs, whose receivers are chains of calls."""
    edges = java_edges(_tables(spark, sf))
    return edges.where("NOT (type = 'CALLS' AND contains(src, '#job('))").select("type", "src", "dst", "confidence")


@from_tree(f"SELECT src, dst, confidence FROM ({CALLS})")
def java_calls(spark, sf):
    edges = tree.edges(spark, sf, "CALLS")
    return edges.where("NOT contains(src, '#job(')").select("src", "dst", "confidence")


@from_tree(f"SELECT src, dst, confidence FROM ({CALLS}) WHERE NOT (dst = 'extmethod:jdbc.update' AND src IN (SELECT {SAVE} FROM d WHERE s = 50))")
def patched_calls(spark, sf):
    """Calls after the classes of the largest size lost a method: the analysis is patched, not made anew."""
    rows = tree.parts(spark, sf).where("s = 50").select(tree.filled(tree.FILES["class"][0]).alias("relative_path"), tree.filled(tree.CLASS).alias("text"))
    edited = rows.select("relative_path", F.encode(F.regexp_replace("text", r"\n    void save[^}]*}\n", ""), "UTF-8").alias("content"))
    before = incremental.state(_tables(spark, sf))
    after, _ = incremental.patched(before, java.parse_files(edited), edited.select(F.col("relative_path").alias("file")))
    return first_edges(after.calls.where("NOT contains(src, '#job(')"), F.col("ordinal")).select("src", "dst", "confidence")


@from_tree("SELECT fqn, ['ControllerAdvice', 'Service', 'Repository'][s % 7 + 1] AS stereotype FROM d WHERE s % 7 < 3")
def stereotypes(spark, sf):
    return frameworks.stereotypes(_tables(spark, sf))


@from_tree("SELECT fqn || '#failed(Trouble' || k || ')' AS method, 'Trouble' || k AS raw FROM d WHERE s % 7 = 0")
def handled_exceptions(spark, sf):
    return frameworks.handled_exceptions(_tables(spark, sf))


@from_tree("""SELECT fqn || '#job(SparkSession)' AS method, ['filter', 'groupBy'] AS transformations, ['count', 'saveAsTable', 'write'] AS actions, ['raw.r' || s] AS reads_tables,
['mart.m' || s] AS writes_tables, CAST([] AS VARCHAR[]) AS paths, CAST(1 AS BIGINT) AS sql_calls FROM d WHERE s % 6 = 0""")
def spark_job_summary(spark, sf):
    return frameworks.spark_jobs(_tables(spark, sf))


@from_tree("SELECT 'warn' AS level, count(*) AS calls, count(DISTINCT fqn) AS methods FROM d WHERE s % 4 = 1 HAVING count(*) > 0")
def log_levels(spark, sf):
    return frameworks.log_levels(_tables(spark, sf))


@from_tree("SELECT fqn || '#code(int)' AS fqn, 'warn' AS level, CAST(1 AS BIGINT) AS calls FROM d WHERE s % 4 = 1")
def logged_methods(spark, sf):
    return frameworks.logged(_tables(spark, sf))


@from_tree("""SELECT 'calls' AS what, 'warn' AS key, count(*) AS n FROM d WHERE s % 4 = 1 HAVING count(*) > 0 UNION ALL SELECT 'methods', '', count(*) FROM d WHERE s % 4 = 1
UNION ALL SELECT 'worth', 'logged', count(*) FROM d WHERE s % 3 = 0 AND s % 4 = 1 HAVING count(*) > 0
UNION ALL SELECT 'worth', 'unlogged', count(*) FILTER (s % 3 = 0 AND s % 4 <> 1) + count(*) FILTER (s % 5 = 0) + count(*) FILTER (s % 6 = 0) + count(*) FILTER (s % 7 = 0) FROM d""")
def logging_page(spark, sf):
    j = _tables(spark, sf)
    return reports.logging_page(frameworks.logged(j), frameworks.interesting(j))


def _statements(spark, sf):
    j = _tables(spark, sf)
    hits = sqltext.java_statements(j.parsed).unionByName(sqltext.file_statements(tree.files(spark, sf, "sql")))
    methods = j.methods.select("fqn", "file", F.col("location.line_start").alias("lo"), F.col("location.line_end").alias("hi"))
    return sqltext.statements(hits, methods)


@from_tree("""SELECT 'INSERT' AS statement_type, CAST([] AS VARCHAR[]) AS tables_read, ['w' || s] AS tables_written, ['java-literal'] AS origins FROM d WHERE s % 5 = 0
UNION ALL SELECT DISTINCT 'SELECT', ['people' || s], CAST([] AS VARCHAR[]), ['java-literal'] FROM d WHERE s % 6 = 0 UNION ALL SELECT DISTINCT 'CREATE', CAST([] AS VARCHAR[]), ['c' || s], ['sql-file'] FROM d WHERE s % 10 = 0
UNION ALL SELECT 'INSERT', ['st.i' || k], ['c' || s], ['sql-file'] FROM d WHERE s % 10 = 0 UNION ALL SELECT DISTINCT 'DELETE', CAST([] AS VARCHAR[]), ['old' || k % 10], ['sql-file'] FROM d WHERE s % 10 = 0""")
def sql_statements(spark, sf):
    return _statements(spark, sf)[0].select("statement_type", "tables_read", "tables_written", "origins")


@from_tree(f"""SELECT {SAVE} AS src, 'table:w' || s AS dst, 'HIGH' AS confidence FROM d WHERE s % 5 = 0 UNION ALL SELECT {JOB}, 'table:people' || s, 'HIGH' FROM d WHERE s % 6 = 0
UNION ALL SELECT 'file:db/f' || k || '.sql', unnest(['table:c' || s, 'table:st.i' || k, 'table:old' || k % 10]), 'HIGH' FROM d WHERE s % 10 = 0""")
def sql_owners(spark, sf):
    edges = _statements(spark, sf)[1]
    runs = edges.where("type = 'EXECUTES_SQL'").select("src", F.col("dst").alias("statement"))
    uses = edges.where("type <> 'EXECUTES_SQL'").select(F.col("src").alias("statement"), "dst", "confidence")
    return runs.join(uses, "statement").select("src", "dst", "confidence").distinct()


@from_tree("""SELECT 'CREATE TABLE c' || s || ' (id INT)' AS sql, 2 AS line FROM d WHERE s % 10 = 0 UNION ALL SELECT 'INSERT INTO c' || s || ' SELECT * FROM st.i' || k, 2 FROM d WHERE s % 10 = 0
UNION ALL SELECT 'DELETE FROM old' || k % 10, 6 FROM d WHERE s % 10 = 0""")
def sql_split(spark, sf):
    return sqltext.file_statements(tree.files(spark, sf, "sql")).select("sql", "line")


#: Statements by size modulo eight: what each says, and what it reads, writes and is.
FORMS = [
    ("SELECT extract(year FROM ts) FROM t<s> x, u<k2> WHERE trim(both FROM x.z) = 'from q'", "SELECT", ["t<s>", "u<k2>"], [], True),
    ("DELETE a FROM t<s> a JOIN u<k2> b ON a.id = b.id", "DELETE", ["u<k2>"], ["t<s>"], True),
    ("WITH c AS (WITH d AS (SELECT * FROM t<s>) SELECT * FROM d) SELECT * FROM c JOIN (SELECT 1 FROM u<k2>) z ON 1 = 1", "SELECT", ["c", "d", "t<s>", "u<k2>"], [], True),
    ("INSERT INTO t<s> (a) SELECT x FROM `db`.`u<k2>` # FROM nothing", "INSERT", ["db.u<k2>"], ["t<s>"], True),
    ("MERGE INTO t<s> AS m USING (SELECT max(y) FROM u<k2>) q ON 1 = 1 WHEN MATCHED THEN UPDATE SET x = 1", "MERGE", ["u<k2>"], ["t<s>"], True),
    ("UPDATE t<s> SET x = (SELECT y FROM u<k2> WHERE k IS NOT DISTINCT FROM t<s>.k)", "UPDATE", ["u<k2>"], ["t<s>"], True),
    ("SELECT [a from b] FROM [dbo].[t<s>] WITH (NOLOCK) LEFT JOIN [u<k2>] ON 1 = 1", "SELECT", ["dbo.t<s>", "u<k2>"], [], True),
    ("SELECT (a FROM t<s> JOIN u<k2>", "SELECT", ["t<s>", "u<k2>"], [], False),
]


def _sql_text(text: str) -> str:
    """The DuckDB expression of a text with <names>."""
    return "'" + text.replace("'", "''").replace("<s>", "' || s || '").replace("<k2>", "' || k2 || '") + "'"


def _sql_list(names: list[str]) -> str:
    return f"list_sort([{', '.join(_sql_text(n) for n in names)}]::VARCHAR[])"


@from_tree("SELECT sql, statement_type, tables_read, tables_written, parsed_ok FROM (" + " UNION ALL ".join(
    f"SELECT {_sql_text(q)} AS sql, '{kind}' AS statement_type, {_sql_list(r)} AS tables_read, {_sql_list(w)} AS tables_written, {ok} AS parsed_ok FROM d WHERE s % 8 = {i}" for i, (q, kind, r, w, ok) in enumerate(FORMS)
) + ")")
def table_sql_parse(spark, sf):
    """Statements with scopes, aliases, quotes of four dialects, and one that only the reading without grammar takes."""
    sql = tree.by_size([(i, 8, tree.filled(q)) for i, (q, *_) in enumerate(FORMS)], F.lit(None))
    return tree.parts(spark, sf).select(sql.alias("sql")).select("sql", sqltext.statement_facts("sql").alias("p")).select("sql", "p.*")


@from_tree(f"""SELECT {YML} AS file, unnest(['db.url', 'db.password', 'ports[0]', 'ports[1].name']) AS key, unnest(['jdbc:x' || k, '***REDACTED***', s::VARCHAR, 'n' || k]) AS value, unnest([false, true, false, false]) AS secret FROM d WHERE s % 9 = 0
UNION ALL SELECT {PROPERTIES_FILE}, unnest(['a.b', 'api_key', 'empty', 'url']), unnest([s::VARCHAR, '***REDACTED***', '', 'http://h:' || k]), unnest([false, true, false, false]) FROM d WHERE s % 9 = 1""")
def config_flatten(spark, sf):
    return config.config_rows(tree.files(spark, sf, "yaml", "properties"))


@from_tree("""SELECT (SELECT 'shop' || k FROM d WHERE s % 11 = 0 ORDER BY 'm' || k || '/pom.xml' LIMIT 1) AS "artifactId", '21' AS java_version,
(SELECT '3.' || s || '.1' FROM d WHERE s % 11 = 0 ORDER BY 'm' || k || '/pom.xml' LIMIT 1) AS spring_boot_version, (SELECT min('4.0.' || s) FROM d WHERE s % 11 = 0) AS spark_version, '2.13' AS scala_version""")
def build_facts(spark, sf):
    return build.build_info(build.build_facts(tree.files(spark, sf, "pom"))).select("artifactId", "java_version", "spring_boot_version", "spark_version", "scala_version")


@from_tree("""SELECT 'm' || k || '/pom.xml' AS file, unnest(['build_system', 'groupId', 'artifactId', 'version', 'java_version', 'spring_boot_version', 'dependency', 'dependency', 'dependency']) AS fact,
unnest(['', '', '', '', '', '', 'org.apache.spark', 'org.postgresql', 'org.junit.jupiter']) AS "group", unnest(['', '', '', '', '', '', 'spark-sql_2.13', 'postgresql', 'junit-jupiter']) AS artifact,
unnest(['maven', 'org.springframework.boot', 'shop' || k, '3.' || s || '.1', '21', '3.' || s || '.1', '4.0.' || s, '', '5.' || s]) AS value FROM d WHERE s % 11 = 0
UNION ALL SELECT 'm' || k || '/build.gradle', unnest(['build_system', 'spring_boot_version', 'java_version', 'dependency', 'dependency']), unnest(['', '', '', 'org.h2', 'org.mockito']), unnest(['', '', '', 'h2', 'mockito-core']),
unnest(['gradle', '2.' || s || '.0', '17', '1.' || s, '']) FROM d WHERE s % 11 = 1""")
def table_build_facts(spark, sf):
    return build.build_facts(tree.files(spark, sf, "pom", "gradle"))


@from_tree("""SELECT 'org.apache.spark' AS "group", 'spark-sql_2.13' AS artifact, count(*) AS files, list_sort(list(DISTINCT '4.0.' || s))[1:6] AS versions FROM d WHERE s % 11 = 0
UNION ALL SELECT 'org.postgresql', 'postgresql', count(*), CAST([] AS VARCHAR[]) FROM d WHERE s % 11 = 0 UNION ALL SELECT 'org.junit.jupiter', 'junit-jupiter', count(*), list_sort(list(DISTINCT '5.' || s))[1:6] FROM d WHERE s % 11 = 0
UNION ALL SELECT 'org.h2', 'h2', count(*), list_sort(list(DISTINCT '1.' || s))[1:6] FROM d WHERE s % 11 = 1 UNION ALL SELECT 'org.mockito', 'mockito-core', count(*), CAST([] AS VARCHAR[]) FROM d WHERE s % 11 = 1""")
def dependency_page(spark, sf):
    return reports.dependency_page(build.build_facts(tree.files(spark, sf, "pom", "gradle")))


@from_tree("""SELECT DISTINCT unnest(['database', 'testing', 'testing']) AS what, unnest(['PostgreSQL', 'JUnit 4', 'JUnit 5']) AS label FROM d WHERE s % 11 = 0
UNION ALL SELECT DISTINCT unnest(['database', 'testing']), unnest(['H2', 'Mockito']) FROM d WHERE s % 11 = 1""")
def dependency_labels(spark, sf):
    return build.dependency_labels(build.dependencies(build.build_facts(tree.files(spark, sf, "pom", "gradle"))))


@from_tree("""SELECT file AS path, 'M' AS status, unnest([5, 10]) AS lo, unnest([6, 10]) AS hi, CAST(2 AS BIGINT) AS added, CAST(3 AS BIGINT) AS removed FROM d WHERE s % 12 = 0
UNION ALL SELECT file, 'R', -1, -1, 0, 0 FROM d WHERE s % 12 = 1 UNION ALL SELECT 'new' || k || '.sql', 'A', 1, 1, 1, 0 FROM d WHERE s % 12 = 2 UNION ALL SELECT 'gone' || k || '.txt', 'D', 0, 0, 0, 1 FROM d WHERE s % 12 = 3""")
def diff_hunks(spark, sf):
    return git.hunks(tree.diffs(spark, sf)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("lo", "hi")})


@from_tree("""SELECT file || '|5' AS range_id, 'type:' || fqn AS span_id FROM d WHERE s % 12 = 0 UNION ALL SELECT file || '|10', unnest(['type:' || fqn, code]) FROM d WHERE s % 12 = 0""")
def change_impact(spark, sf):
    """Changed ranges of a diff and the symbols that share a line with them."""
    known = tree.nodes(spark, sf).where("line_start IS NOT NULL AND kind IN ('Class', 'Method')")
    changed = git.hunks(tree.diffs(spark, sf)).where("status = 'M'").select(F.concat_ws("|", "path", F.col("lo").cast("string")).alias("range_id"), F.col("path").alias("file"), "lo", "hi")
    return spans.overlapping_spans(changed, known.select(F.col("id").alias("span_id"), "file", F.col("line_start").alias("lo"), F.col("line_end").alias("hi")))


TEST_BODY = "'    @Test' || chr(10) || '    public void runs() {' || chr(10) || '        own.code(1);' || chr(10) || '    }'"


@from_tree(f"""SELECT {RUNS} AS node_id, 'Method ' || fqn || 'Test#runs() returns void. Annotations: Test.' || chr(10) || {TEST_BODY} AS text FROM d WHERE s % 8 = 0
UNION ALL SELECT 'type:' || fqn || 'Test', 'Class ' || fqn || 'Test. ' || chr(10) || 'public class Q' || k || 'Test {{' || chr(10) || '    private Q' || k || ' own;' || chr(10) || chr(10) || {TEST_BODY} || chr(10) || '}}' FROM d WHERE s % 8 = 0""")
def code_chunks(spark, sf):
    nodes = tree.graph(spark, sf)[0]
    return frameworks.chunks(nodes.where("contains(id, 'Test') AND kind IN ('Class', 'Method')"), tree.files(spark, sf, "test")).select("node_id", "text")


@from_tree("""SELECT pkg AS package, count(*) + count(*) FILTER (s % 8 = 0) AS files, count(*) + count(*) FILTER (s % 8 = 0) + count(*) FILTER (s % 7 = 0) AS types FROM d GROUP BY pkg""")
def package_rollup(spark, sf):
    return reports.package_rollup(tree.edges(spark, sf, "CONTAINS", "DECLARES"))


CALLERS = f"""below AS (SELECT DISTINCT a.code AS id FROM a JOIN seed ON seed.k = a.k >> a.i), checks AS (SELECT {RUNS} AS id FROM d WHERE s % 8 = 0 AND (k IN (SELECT k FROM seed) OR code IN (SELECT id FROM below)))"""


@from_tree(f""", seed AS (SELECT k FROM d WHERE s = 1), {CALLERS}, near AS (SELECT id FROM below UNION SELECT id FROM checks),
far AS (SELECT DISTINCT above AS id FROM a WHERE k IN (SELECT k FROM seed) UNION SELECT unnest(['log', 'super']) FROM seed)
SELECT 'direct_callers' AS what, count(*) AS n FROM near UNION ALL SELECT 'callers', count(*) FROM near UNION ALL SELECT 'callees', count(*) FROM far UNION ALL SELECT 'tests', count(*) FROM checks""")
def impact_summary(spark, sf):
    """Around the methods of all parts of the least size."""
    seeds = tree.parts(spark, sf).where("s = 1").select(tree.filled("method:fam.g<g>.Q<k>#code(int)").alias("id"))
    return reports.impact_summary(reports.impact_of_any(tree.nodes(spark, sf), tree.edges(spark, sf, "CALLS"), seeds))


@from_tree(f""", e AS (SELECT 'type:Problem' AS exception, {SAVE} AS src, 't' AS way FROM d WHERE s % 5 = 0 UNION ALL SELECT 'type:java.lang.IllegalArgumentException', code, 'c' FROM d WHERE s % 3 = 0
UNION ALL SELECT CASE WHEN s % 7 = 0 THEN {TROUBLE} ELSE 'type:Trouble' || k END, code, 'c' FROM d WHERE s % 3 = 0)
SELECT exception, coalesce(list_sort(list(src) FILTER (way = 't'))[1:6], CAST([] AS VARCHAR[])) AS thrown_by, coalesce(list_sort(list(src) FILTER (way = 'c'))[1:6], CAST([] AS VARCHAR[])) AS caught_by FROM e GROUP BY exception""")
def exception_pages(spark, sf):
    return reports.exception_pages(tree.edges(spark, sf, "THROWS", "CATCHES"))


@from_tree("""SELECT layer, CASE WHEN layer = 'Unclassified' THEN 'unknown' WHEN bool_or(seen) THEN 'observed' ELSE 'inferred' END AS status, count(*) AS types FROM (
SELECT CASE WHEN s % 7 = 1 THEN 'Service' WHEN s % 7 = 2 THEN 'Repository/DAO' WHEN s % 6 = 0 THEN 'ETL/Spark' ELSE 'Unclassified' END AS layer, s % 7 < 3 AS seen FROM d
UNION ALL SELECT 'Unclassified', false FROM d WHERE s % 7 = 0 UNION ALL SELECT 'Unclassified', false FROM d WHERE s % 8 = 0) GROUP BY layer""")
def code_layers(spark, sf):
    nodes = tree.graph(spark, sf)[0]
    jobs = nodes.where("spark_job").select(F.col("owner").alias("fqn"), F.lit(True).alias("job")).distinct()
    types = nodes.where("kind IN ('Class', 'Interface') AND NOT placeholder").drop("spark_job").join(jobs, "fqn", "left")
    return reports.layers(types.withColumn("spark_job", F.coalesce("job", F.lit(False)))).select("layer", "status", "types")


@from_tree("""SELECT 'type:java.lang.IllegalArgumentException' AS id FROM d WHERE s % 3 = 0 GROUP BY 1 UNION ALL SELECT 'type:Problem' FROM d WHERE s % 5 = 0 GROUP BY 1 UNION ALL SELECT 'type:Trouble' || k FROM d WHERE s % 3 = 0 AND s % 7 <> 0""")
def unresolved_types(spark, sf):
    nodes, edges = tree.graph(spark, sf)
    named = edges.where("type IN ('CATCHES', 'THROWS')").select(F.col("dst").alias("id"))
    return reports.unresolved(nodes).join(named, "id", "left_semi").select("id")


@from_tree("""SELECT fqn FROM (SELECT fqn || '#code(int)' AS fqn FROM d WHERE s % 3 = 0 AND s % 4 <> 1 UNION ALL SELECT fqn || '#save(String)' FROM d WHERE s % 5 = 0
UNION ALL SELECT fqn || '#job(SparkSession)' FROM d WHERE s % 6 = 0 UNION ALL SELECT fqn || '#failed(Trouble' || k || ')' FROM d WHERE s % 7 = 0) ORDER BY fqn LIMIT 80""")
def unlogged_methods(spark, sf):
    return frameworks.unlogged(_tables(spark, sf))


@from_tree("SELECT code AS id, false AS name_hint, CAST(floor(log2(k)) AS BIGINT) AS call_count FROM d WHERE 2 * k > (SELECT count(*) FROM d) AND s % 8 <> 0 AND k > 1")
def code_entrypoints(spark, sf):
    return graph.entrypoints(tree.nodes(spark, sf), tree.edges(spark, sf, "CALLS", "MAPPED_TO"))


@from_tree("SELECT 'type:' || fqn2 AS target, 'type:' || fqn AS id FROM d WHERE k2 IN (SELECT k FROM d WHERE s % 7 = 1)")
def type_implementations(spark, sf):
    """Types below every service type."""
    types = ["EXTENDS", "IMPLEMENTS"]
    return graph.sources_of_each(tree.edges(spark, sf, *types), types, tree.nodes(spark, sf).where("stereotype = 'Service'"))


@from_tree("SELECT 'method:' || above || '#code(int)' AS target, code AS id FROM a WHERE (k >> i) % 20 = 0")
def method_overrides(spark, sf):
    asked = tree.parts(spark, sf).where("k % 20 = 0").select(tree.filled("method:fam.g<g>.Q<k>#code(int)").alias("id"))
    return graph.sources_of_each(tree.edges(spark, sf, "OVERRIDES"), ["OVERRIDES"], asked)


@from_tree(f"SELECT {FAILED} AS src, {TROUBLE} AS dst, 'HIGH' AS confidence FROM d WHERE s % 7 = 0")
def handler_edges(spark, sf):
    return tree.graph(spark, sf)[1].where("type = 'HANDLES'").select("src", "dst", "confidence")


@from_tree("""SELECT 'jobs' AS what, '' AS key, count(*) AS n FROM d WHERE s % 6 = 0 UNION ALL SELECT 'sql_calls', '', count(*) FROM d WHERE s % 6 = 0
UNION ALL SELECT 'input_tables', 'raw.r' || s, count(*) FROM d WHERE s % 6 = 0 GROUP BY s UNION ALL SELECT 'output_tables', 'mart.m' || s, count(*) FROM d WHERE s % 6 = 0 GROUP BY s""")
def spark_counts(spark, sf):
    return reports.spark_counts(frameworks.spark_jobs(_tables(spark, sf)))


@from_tree(f"SELECT 'maven' AS build_system, 'mixed' AS style, count(*) AS files, sum(CASE WHEN kind LIKE 'java%' THEN lines ELSE 0 END)::BIGINT AS java_lines FROM ({INVENTORY})")
def project_overview(spark, sf):
    found = files.inventory(tree.files(spark, sf))
    return reports.overview(found, build.build_info(build.build_facts(tree.files(spark, sf, "pom")))).select("build_system", "style", "files", "java_lines")


@from_tree(f""", seed AS (SELECT k FROM d WHERE s % 12 < 2), {CALLERS}
SELECT 'changed_symbol' AS what, unnest(['type:' || fqn, code]) AS id FROM d WHERE s % 12 < 2 UNION ALL SELECT 'changed_symbol', {SAVE} FROM d WHERE s % 12 = 1 AND s % 5 = 0
UNION ALL SELECT 'changed_symbol', unnest([{FAILED}, {TROUBLE}]) FROM d WHERE s % 12 = 1 AND s % 7 = 0
UNION ALL SELECT 'impacted_caller', id FROM below UNION ALL SELECT 'impacted_caller', id FROM checks UNION ALL SELECT 'impacted_test', id FROM checks
UNION ALL SELECT 'impacted_sql', 'sql:' || substr(sha1('insert into w' || s || ' (a) values (' || k || ')'), 1, 12) FROM d WHERE s % 12 = 1 AND s % 5 = 0
UNION ALL SELECT 'new_file', 'new' || k || '.sql' FROM d WHERE s % 12 = 2 UNION ALL SELECT 'deleted_file', 'gone' || k || '.txt' FROM d WHERE s % 12 = 3""")
def diff_impact(spark, sf):
    """The changed lines of a diff, the symbols there, and what calls them; a renamed file counts as a whole."""
    # Of what stands beside a symbol only statements and endpoints are asked for, and these edges lead to them.
    edges = tree.edges(spark, sf, "CALLS", "EXPOSES", "MAPPED_TO", "EXECUTES_SQL")
    return reports.change_impact(tree.nodes(spark, sf), edges, materialize(git.hunks(tree.diffs(spark, sf)), "hunks"))


@from_tree("""SELECT 'files' AS what, kind AS key, count(*) AS n FROM (""" + INVENTORY + """) GROUP BY kind UNION ALL SELECT 'parsed', 'success', count(*) + count(*) FILTER (s % 8 = 0) FROM d
UNION ALL SELECT 'sql_statements', '', (SELECT count(*) FROM d WHERE s % 5 = 0) + (SELECT count(DISTINCT s) FROM d WHERE s % 6 = 0) + (SELECT count(DISTINCT s) + count(*) + count(DISTINCT k % 10) FROM d WHERE s % 10 = 0)
UNION ALL SELECT 'sql_parsed_ok', '', (SELECT count(*) FROM d WHERE s % 5 = 0) + (SELECT count(DISTINCT s) FROM d WHERE s % 6 = 0) + (SELECT count(DISTINCT s) + count(*) + count(DISTINCT k % 10) FROM d WHERE s % 10 = 0)
UNION ALL SELECT 'sql_by_type', 'INSERT', (SELECT count(*) FROM d WHERE s % 5 = 0) + (SELECT count(*) FROM d WHERE s % 10 = 0) UNION ALL SELECT 'sql_by_type', 'SELECT', count(DISTINCT s) FROM d WHERE s % 6 = 0
UNION ALL SELECT 'sql_by_type', 'CREATE', count(DISTINCT s) FROM d WHERE s % 10 = 0 UNION ALL SELECT 'sql_by_type', 'DELETE', count(DISTINCT k % 10) FROM d WHERE s % 10 = 0
UNION ALL SELECT 'sql_tables', '', (SELECT count(DISTINCT s) FROM d WHERE s % 5 = 0) + (SELECT 3 * count(DISTINCT s) FROM d WHERE s % 6 = 0) + (SELECT count(DISTINCT s) + count(*) + count(DISTINCT k % 10) FROM d WHERE s % 10 = 0)
UNION ALL SELECT 'spring_stereotypes', ['ControllerAdvice', 'Service', 'Repository'][s % 7 + 1], count(*) FROM d WHERE s % 7 < 3 GROUP BY 2
UNION ALL SELECT 'spring_' || w, '', 0 FROM (VALUES ('endpoints'), ('beans'), ('injections')) v(w) UNION ALL SELECT 'spring_exception_handlers', '', count(*) FROM d WHERE s % 7 = 0""")
def scan_statistics(spark, sf):
    """The numbers of a scan, but those of nodes and edges by kind."""
    nodes, edges = tree.facts(spark, sf)
    found = reports.scan_stats(files.inventory(tree.files(spark, sf)), _tables(spark, sf).files, nodes, edges)
    return found.where("what NOT IN ('nodes', 'edges', 'unresolved')")


@from_tree(f"""SELECT id FROM (SELECT code AS id, k, s FROM d WHERE k NOT IN (SELECT k FROM d WHERE s % 8 = 0 UNION SELECT a.k >> i FROM a WHERE s % 8 = 0)
UNION ALL SELECT {SAVE}, k, s FROM d WHERE s % 5 = 0 UNION ALL SELECT {JOB}, k, s FROM d WHERE s % 6 = 0 UNION ALL SELECT {FAILED}, k, s FROM d WHERE s % 7 = 0) ORDER BY id LIMIT 80""")
def uncovered_methods(spark, sf):
    """Methods that no test reaches: a test covers its class's method and all above it."""
    return reports.test_coverage(tree.nodes(spark, sf), tree.edges(spark, sf, "CALLS"))


# -- code written from the rows of part, of any size ---------------------------------------------


def from_tables(sql: str):
    """Register with an oracle that derives the same rows from ``part``."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {tablecode.CODE_SQL} {sql}"
        return f

    return add


RUN, STATEMENT = "'method:' || fqn || '#run(int)'", "'SELECT a FROM t' || s || ' WHERE id = ' || k"
SQL_ID = f"'sql:' || substr(sha1(lower({STATEMENT})), 1, 12)"


@from_tables(f"""SELECT 'CALLS' AS type, {RUN} AS src, CASE WHEN known THEN 'method:' || fqn2 || '#run(int)' ELSE 'extmethod:' || fqn2 || '.run' END AS dst, CASE WHEN known THEN 'HIGH' ELSE 'UNKNOWN' END AS confidence FROM d
UNION ALL SELECT 'CALLS', 'method:' || fqn || '#get()', {RUN}, 'HIGH' FROM d WHERE s % 5 = 1
UNION ALL SELECT 'CALLS', 'method:' || fqn || '#load()', 'extmethod:jdbc.query', 'UNKNOWN' FROM d WHERE s % 4 = 0
UNION ALL SELECT 'THROWS', {RUN}, 'type:java.lang.IllegalStateException', 'MEDIUM' FROM d
UNION ALL SELECT 'RETURNS_TYPE', {RUN}, 'type:java.lang.String', 'MEDIUM' FROM d UNION ALL SELECT 'RETURNS_TYPE', 'method:' || fqn || '#get()', 'type:java.lang.String', 'MEDIUM' FROM d WHERE s % 5 = 1
UNION ALL SELECT 'USES_TYPE', 'field:' || fqn || '#next', 'type:' || fqn2, CASE WHEN known THEN 'HIGH' ELSE 'MEDIUM' END FROM d
UNION ALL SELECT 'INJECTS', 'type:' || fqn, 'type:' || fqn2, CASE WHEN s2 % 5 IN (0, 1) THEN 'HIGH' ELSE 'MEDIUM' END FROM d WHERE s % 5 = 0 AND known
UNION ALL SELECT 'EXPOSES', 'type:' || fqn, 'endpoint:GET /p/' || k, 'HIGH' FROM d WHERE s % 5 = 1 UNION ALL SELECT 'MAPPED_TO', 'endpoint:GET /p/' || k, 'method:' || fqn || '#get()', 'HIGH' FROM d WHERE s % 5 = 1
UNION ALL SELECT 'EXECUTES_SQL', 'method:' || fqn || '#load()', {SQL_ID}, 'HIGH' FROM d WHERE s % 4 = 0 UNION ALL SELECT 'READS_TABLE', {SQL_ID}, 'table:t' || s, 'HIGH' FROM d WHERE s % 4 = 0
UNION ALL SELECT 'CONTAINS', 'package:shop.g' || k % 10, 'file:' || file, 'HIGH' FROM d UNION ALL SELECT 'IMPORTS', 'file:' || file, 'type:' || fqn2, 'HIGH' FROM d""")
def table_code_edges(spark, sf):
    """Edges of parsed code, all of their types but declarations and annotations."""
    types = [t for t in (*EDGE_TYPES, *MORE_TYPES) if t not in ("DECLARES", "ANNOTATED_WITH")]
    return tablecode.edges(spark, sf, *types).select("type", "src", "dst", "confidence")


@from_tables("""SELECT fqn, 'Class' AS kind, file FROM d UNION ALL SELECT fqn || '#next', 'Field', file FROM d UNION ALL SELECT fqn || '#run(int)', 'Method', file FROM d
UNION ALL SELECT fqn || '#get()', 'Method', file FROM d WHERE s % 5 = 1 UNION ALL SELECT fqn || '#load()', 'Method', file FROM d WHERE s % 4 = 0""")
def table_code_entities(spark, sf):
    return tablecode.graph(spark, sf)[1].where("NOT placeholder AND kind IN ('Class', 'Field', 'Method')").select("fqn", "kind", "file")


@from_tables(f"SELECT {RUN} AS id, true AS name_hint, CAST(1 AS BIGINT) AS call_count FROM d WHERE known AND s % 5 <> 1 AND k NOT IN (SELECT k2 FROM d)")
def table_code_entrypoints(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return graph.entrypoints(nodes, edges)


@from_tables("""SELECT 'endpoint:GET /p/' || k AS endpoint, i + 1 AS position, 'method:shop.g' || (k >> i) % 10 || '.P' || (k >> i) || '#run(int)' AS id, CAST(i AS INTEGER) AS depth
FROM d, range(4) r(i) WHERE s % 5 = 1 AND (k >> i > 0 OR i = 0 OR k >> (i - 1) > 0)""")
def table_endpoint_flows(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.endpoint_flows(nodes, edges)


@from_tables("""SELECT 'table:t' || s AS "table", list_sort(list('method:' || fqn || '#load()')) AS read_by, CAST([] AS VARCHAR[]) AS written_by FROM d WHERE s % 4 = 0 GROUP BY s""")
def table_code_usage(spark, sf):
    return graph.table_usage(tablecode.graph(spark, sf)[2])


@from_tables(f"""SELECT 'endpoint:GET /p/' || k AS node_id, 'HTTP endpoint GET /p/' || k || ' handled by ' || fqn || '#get() in controller ' || fqn || '.' AS text FROM d WHERE s % 5 = 1
UNION ALL SELECT {SQL_ID}, 'SQL SELECT statement. reads tables: t' || s || '. writes tables: -.' || chr(10) || {STATEMENT} FROM d WHERE s % 4 = 0
UNION ALL SELECT 'method:' || fqn || '#get()', 'Method ' || fqn || '#get() returns String. Annotations: GetMapping.' || chr(10) || '    @GetMapping("/p/' || k || '")' || chr(10) || '    public String get() {{' || chr(10) || '        return run(1);' || chr(10) || '    }}' FROM d WHERE s % 5 = 1""")
def table_code_chunks(spark, sf):
    _, nodes, _, own = tablecode.graph(spark, sf)
    return frameworks.chunks(nodes, own).where("kind IN ('Endpoint', 'SQLStatement') OR node_id LIKE '%#get()'").select("node_id", "text")


@from_tables("""SELECT CASE s % 5 WHEN 0 THEN 'Service' WHEN 1 THEN 'Controller/API' ELSE 'Unclassified' END AS layer, CASE WHEN s % 5 < 2 THEN 'observed' ELSE 'unknown' END AS status, count(*) AS types FROM d GROUP BY 1, 2""")
def table_code_layers(spark, sf):
    nodes = tablecode.graph(spark, sf)[1].where("kind = 'Class'")
    return reports.layers(nodes.withColumn("spark_job", F.lit(False))).select("layer", "status", "types")


@from_tables("""SELECT 'stereotypes' AS what, CASE s % 5 WHEN 0 THEN 'Service' ELSE 'RestController' END AS key, count(*) AS n FROM d WHERE s % 5 < 2 GROUP BY 2
UNION ALL SELECT 'endpoints', '', count(*) FROM d WHERE s % 5 = 1 UNION ALL SELECT 'beans', '', 0 UNION ALL SELECT 'exception_handlers', '', 0 UNION ALL SELECT 'injections', '', count(*) FROM d WHERE s % 5 = 0 AND known""")
def table_spring_counts(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.spring_counts(nodes, edges)


@from_tables("""SELECT 'statements' AS what, '' AS key, count(*) AS n FROM d WHERE s % 4 = 0 UNION ALL SELECT 'by_type', 'SELECT', count(*) FROM d WHERE s % 4 = 0
UNION ALL SELECT 'parsed_ok', '', count(*) FROM d WHERE s % 4 = 0 UNION ALL SELECT 'tables', '', count(DISTINCT s) FROM d WHERE s % 4 = 0""")
def table_sql_counts(spark, sf):
    return reports.sql_counts(tablecode.graph(spark, sf)[1])


@from_tables(f"SELECT {SQL_ID} AS id, 'SELECT' AS statement_type, ['t' || s] AS tables_read, ['method:' || fqn || '#load()'] AS callers FROM d WHERE s % 4 = 0")
def table_sql_dashboard(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.sql_dashboard(nodes, edges).select("id", "statement_type", "tables_read", "callers")


@from_tables(f"SELECT 'method:' || fqn || '#' || m AS id FROM d, (VALUES ('run(int)', 5, 9), ('get()', 5, 1), ('load()', 4, 0)) v(m, a, b) WHERE b = 9 OR s % a = b ORDER BY 1 LIMIT 80")
def table_uncovered_methods(spark, sf):
    """No class there is a test, so every method is uncovered; the first 80 in order are reported."""
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.test_coverage(nodes, edges)


def _run(k: str) -> str:
    return f"'method:shop.g' || ({k}) % 10 || '.P' || ({k}) || '#run(int)'"


@from_tables(f"""SELECT 'endpoint:GET /p/' || d.k AS endpoint, i + 1 AS position, repeat('  ', CAST(i AS INTEGER)) || '-> ' || substr({_run("d.k >> i")}, 8) || ' [' ||
CASE c.s % 5 WHEN 0 THEN 'Service' WHEN 1 THEN 'RestController' ELSE '?' END || '] (HIGH)' AS line
FROM d, range(4) r(i), c WHERE c.k = d.k >> i AND d.s % 5 = 1 AND (d.k >> i > 0 OR i = 0 OR d.k >> (i - 1) > 0)""")
def table_flow_lines(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.flow_lines(nodes, edges)


@from_tables("""SELECT 'shop.g' || k % 10 AS package, count(*) AS files, count(*) AS types FROM d GROUP BY 1""")
def table_package_rollup(spark, sf):
    return reports.package_rollup(tablecode.graph(spark, sf)[2])


@from_tables("""SELECT 'table:t' || s AS "table", count(*) AS reads, CAST(0 AS BIGINT) AS writes FROM d WHERE s % 4 = 0 GROUP BY s""")
def table_statement_counts(spark, sf):
    return reports.table_statements(tablecode.graph(spark, sf)[2])


@from_tables(f"""SELECT {RUN} AS id, 'Method' AS kind, 'run' AS name, fqn || '#run(int)' AS fqn, file FROM d WHERE k % 20 = 0""")
def table_get_nodes(spark, sf):
    """Nodes of a stated set of ids, one of which is unknown."""
    _, nodes, _, _ = tablecode.graph(spark, sf)
    asked = _hits(spark, sf).where("id LIKE '%#run(int)'").select("id").unionByName(spark.createDataFrame([("method:none",)], "id string"))
    return graph.get_nodes(nodes, asked).select("id", "kind", "name", "fqn", "file")


@from_tables(f"""SELECT e.id AS seed, i AS position, {_run("e.k >> i")} AS id, CAST(i - 1 AS INTEGER) AS depth
FROM (SELECT k, {RUN} AS id FROM d WHERE s % 5 <> 1 AND k NOT IN (SELECT k2 FROM d) ORDER BY id LIMIT 5) e, range(1, 7) r(i) WHERE e.k >> (i - 1) > 0""")
def table_data_flow(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.data_flow(nodes, edges).select("seed", "position", "id", "depth")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """``id, rank`` of hits: methods and types of every tenth or twentieth part."""
    k = F.col("p_partkey")
    fqn = F.format_string("shop.g%s.P%s", (k % 10).cast("string"), k.cast("string"))
    what = F.when(k % 20 == 0, F.concat(F.lit("method:"), fqn, F.lit("#run(int)"))).when((k % 20 == 5) & (F.col("p_size") % 4 == 0), F.concat(F.lit("method:"), fqn, F.lit("#load()")))
    what = what.when(k % 20 == 10, F.concat(F.lit("type:"), fqn))
    return table(spark, sf, "part").select(what.alias("id"), k.alias("rank")).where("id IS NOT NULL")


LOAD = "'method:' || fqn || '#load()'"
FOCUS = f"""h AS (SELECT {RUN} AS id, k, k2, 0 AS role, file, s, fqn FROM d WHERE k % 20 = 0 UNION ALL SELECT {LOAD}, k, k2, 1, file, s, fqn FROM d WHERE k % 20 = 5 AND s % 4 = 0),
e AS (SELECT * FROM h ORDER BY k LIMIT 50),
f AS (SELECT id, 0 AS role, file FROM h
UNION ALL SELECT {RUN.replace("fqn", "d.fqn")}, 1, d.file FROM e JOIN d ON d.k2 = e.k WHERE e.role = 0 UNION ALL SELECT 'method:' || fqn || '#get()', 1, file FROM e WHERE e.role = 0 AND s % 5 = 1
UNION ALL SELECT {_run("e.k >> i")}, 2, c.file FROM e, range(1, 4) r(i), c WHERE c.k = e.k >> i AND e.role = 0 UNION ALL SELECT 'extmethod:jdbc.query', 2, NULL FROM e WHERE e.role = 1
UNION ALL SELECT 'type:' || fqn, 3, file FROM d WHERE k % 20 = 10),
g AS (SELECT id, min(role) AS role, min(file) AS file FROM f GROUP BY id)"""


@from_tables(f", {FOCUS} SELECT id, CAST(role AS INTEGER) AS role FROM g")
def table_focus(spark, sf):
    """The focus of a task: hits, callers, callees within three calls."""
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return context.task_focus(nodes, edges, _hits(spark, sf))["focus"].select("id", "role")


@from_tables(f""", {FOCUS}, p AS (SELECT 'files' AS page, file AS id, -count(*) AS n FROM g WHERE file IS NOT NULL GROUP BY file
UNION ALL SELECT 'callers', id, 0 FROM f WHERE role = 1 GROUP BY id UNION ALL SELECT 'callees', id, 0 FROM f WHERE role = 2 GROUP BY id
UNION ALL SELECT 'sql', {SQL_ID}, 0 FROM e WHERE e.role = 1)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY n, id) AS INTEGER) AS position, id FROM p
QUALIFY position <= CASE page WHEN 'files' THEN 30 ELSE 50 END""")
def table_task_pack(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return context.task_pack(nodes, edges, _hits(spark, sf)).where("page IN ('files', 'callers', 'callees', 'sql')")


@from_tables("SELECT 'endpoint:GET /p/' || k AS id, fqn || '#get()' AS handler FROM d WHERE s % 5 = 1")
def web_endpoints(spark, sf):
    return frameworks.endpoints(tablecode.graph(spark, sf)[0]).select("id", "handler")


@from_tables("SELECT fqn AS src, fqn2 AS dst, CASE WHEN s2 % 5 IN (0, 1) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM d WHERE s % 5 = 0 AND known AND k <> k2")
def injections(spark, sf):
    return frameworks.injections(tablecode.graph(spark, sf)[0])


@from_tables("""SELECT endpoint, count(*) AS steps, max(depth) AS deepest FROM (
SELECT 'endpoint:GET /p/' || k AS endpoint, CAST(i AS INTEGER) AS depth FROM d, range(4) r(i) WHERE s % 5 = 1 AND (k >> i > 0 OR i = 0 OR k >> (i - 1) > 0)) GROUP BY endpoint""")
def endpoint_flows(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.endpoint_flows(nodes, edges).groupBy("endpoint").agg(F.count("*").alias("steps"), F.max("depth").alias("deepest"))


@from_tables(f"""SELECT 'endpoint:GET /p/' || k AS id, 'GET' AS http_method, '/p/' || k AS path, fqn || '#get()' AS handler,
list_transform(list_filter(range(8), lambda i: i = 0 OR k >> (i - 1) > 0), lambda i: 'method:shop.g' || (k >> i) % 10 || '.P' || (k >> i) || '#run(int)') AS steps FROM d WHERE s % 5 = 1""")
def endpoint_dashboard(spark, sf):
    _, nodes, edges, _ = tablecode.graph(spark, sf)
    return reports.endpoint_dashboard(nodes, edges)
