"""A source tree written from the rows of ``part``: classes that inherit, tests, jobs, statements, configuration, build files.

Each part k (its key plus one) of size s has a class that extends the one of k / 2; s decides what else it has. SQL
can derive every fact of that tree from the same rows (:data:`TREE_SQL`).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.wholegraph import declared_nodes, fact_graph, whole_edges, whole_graph
from codeweft.operators.javagraph import JavaTables
from codeweft.sources import java
from codeweft.storage import dealt, materialize, table

#: For each k: the class, its file, the class it extends, and whether that one is there.
TREE_SQL = """
c AS (SELECT p_partkey + 1 AS k, (p_partkey + 1) // 2 AS k2, p_size AS s, 'fam.g' || (p_partkey + 1) % 10 AS pkg, 'fam.g' || (p_partkey + 1) % 10 || '.Q' || (p_partkey + 1) AS fqn,
  'src/main/java/fam/g' || (p_partkey + 1) % 10 || '/Q' || (p_partkey + 1) || '.java' AS file, 'src/test/java/fam/g' || (p_partkey + 1) % 10 || '/Q' || (p_partkey + 1) || 'Test.java' AS test FROM part),
d AS (SELECT c.*, 'fam.g' || k2 % 10 || '.Q' || k2 AS fqn2, k2 > 0 AS known, 'method:' || fqn || '#code(int)' AS code, 'method:fam.g' || k2 % 10 || '.Q' || k2 || '#code(int)' AS code2 FROM c),
a AS (SELECT d.*, i, 'fam.g' || (k >> i) % 10 || '.Q' || (k >> i) AS above FROM d, range(1, 40) r(i) WHERE k >> i > 0)"""

CLASS = """package fam.g<g>;

import fam.g<g2>.Q<k2>;
<spark_import>
<note>public class Q<k> extends Q<k2> {
<override>    public int code(int n) {
<log><attempt>        return super.code(n);
    }
<save><job><handler>}
<trouble>"""
#: Parts of a class by the sizes that have them: (remainder, divisor, text).
PARTS = {
    "spark_import": [(0, 6, "import org.apache.spark.sql.SparkSession;\n")],
    "note": [(0, 7, "@RestControllerAdvice\n"), (1, 7, "@Service\n"), (2, 7, "@Repository\n")],
    "override": [(0, 2, "    @Override\n")],
    "log": [(1, 4, '        log.warn("n");\n')],
    "attempt": [(0, 3, "        try {\n            n = n + 1;\n        } catch (IllegalArgumentException | Trouble<k> e) {\n            throw new IllegalStateException();\n        }\n")],
    "save": [(0, 5, '\n    void save(String body) throws Problem {\n        jdbc.update("INSERT INTO w<s> (a) VALUES (<k>)");\n    }\n')],
    "job": [(0, 6, '\n    static void job(SparkSession spark) {\n        spark.table("Raw.R<s>").filter("a").groupBy("k").count().write().saveAsTable("mart.m<s>");\n        spark.sql("SELECT id FROM people<s>");\n    }\n')],
    "handler": [(0, 7, '\n    @ExceptionHandler(Trouble<k>.class)\n    public String failed(Trouble<k> e) {\n        return "no";\n    }\n')],
    "trouble": [(0, 7, "\nclass Trouble<k> extends Exception {\n}\n")],
}
TEST = "package fam.g<g>;\n\npublic class Q<k>Test {\n    private Q<k> own;\n\n    @Test\n    public void runs() {\n        own.code(1);\n    }\n}\n"
YAML = "db:\n  url: jdbc:x<k>\n  password: pw<k>\nports:\n  - <s>\n  - name: n<k>\n"
PROPERTIES = "# note\na.b = <s>\napi_key: k<k>\nempty=\nno separator\nurl=http://h:<k>\n"
STATEMENTS = "-- tables\nCREATE TABLE c<s> (id INT);\n\nINSERT INTO c<s> SELECT * FROM st.i<k>;\n-- only a comment\n;\nDELETE FROM old<g>\n"
POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.springframework.boot</groupId>
<artifactId>spring-boot-starter-parent</artifactId><version>3.<s>.1</version></parent><artifactId>shop<k></artifactId>
<properties><java.version>21</java.version><spark>4.0.<s></spark></properties><dependencies>
<dependency><groupId>org.apache.spark</groupId><artifactId>spark-sql_2.13</artifactId><version>${spark}</version></dependency>
<dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency>
<dependency><groupId>org.junit.jupiter</groupId><artifactId>junit-jupiter</artifactId><version>5.<s></version></dependency>
</dependencies></project>"""
GRADLE = "plugins {\n    id 'org.springframework.boot' version '2.<s>.0'\n}\n// note\nsourceCompatibility = '17'\ndependencies {\n    implementation 'org.h2:h2:1.<s>'\n    testImplementation(\"org.mockito:mockito-core\")\n}\n"
BROKEN = "package bad;\n\nclass B<k> {\n    void f( { }\n}\n"
#: Files of the tree: (path, remainder and divisor of the sizes that have one, text).
FILES = {
    "class": ("src/main/java/fam/g<g>/Q<k>.java", 0, 1, CLASS),
    "test": ("src/test/java/fam/g<g>/Q<k>Test.java", 0, 8, TEST),
    "yaml": ("conf/g<g>/application-<k>.yml", 0, 9, YAML),
    "properties": ("conf/g<g>/extra-<k>.properties", 1, 9, PROPERTIES),
    "sql": ("db/f<k>.sql", 0, 10, STATEMENTS),
    "pom": ("m<k>/pom.xml", 0, 11, POM),
    "gradle": ("m<k>/build.gradle", 1, 11, GRADLE),
}
DIFFS = [  # of classes, by size
    (0, 12, "diff --git a/<f> b/<f>\nindex 1..2 100644\n--- a/<f>\n+++ b/<f>\n@@ -5 +5,2 @@ class\n-old\n+new\n+more\n@@ -9,2 +10,0 @@\n-x\n-y\n"),
    (1, 12, "diff --git a/old<k>.java b/<f>\nsimilarity index 100%\nrename from old<k>.java\nrename to <f>\n"),
    (2, 12, "diff --git a/new<k>.sql b/new<k>.sql\nnew file mode 100644\n--- /dev/null\n+++ b/new<k>.sql\n@@ -0,0 +1 @@\n+-- select\n"),
    (3, 12, "diff --git a/gone<k>.txt b/gone<k>.txt\ndeleted file mode 100644\n--- a/gone<k>.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n--- bye\n"),
]


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """``k, k2, g, g2, s`` of all parts, dealt to all cores: a file of few splits holds the rows of very much text."""
    k = F.col("p_partkey") + 1
    rows = dealt(table(spark, sf, "part").select("p_partkey", "p_size")).select(k.alias("k"), F.expr("(p_partkey + 1) div 2").alias("k2"), F.col("p_size").alias("s"))
    return rows.withColumns({"g": F.col("k") % 10, "g2": F.col("k2") % 10})


def filled(text: str) -> Column:
    """A text with columns, or the parts of a class, in place of <names>."""
    pieces = []
    for piece in re.split(r"(<\w+>)", text):
        name = piece[1:-1] if re.fullmatch(r"<\w+>", piece) else None
        if name in PARTS:
            pieces.append(by_size([(r, m, filled(t)) for r, m, t in PARTS[name]], F.lit("")))
        elif name == "f":
            pieces.append(filled(FILES["class"][0]))
        elif name in ("k", "k2", "g", "g2", "s"):
            pieces.append(F.col(name).cast("string"))
        else:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def by_size(cases: list[tuple[int, int, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(F.col("s") % case[1] == case[0], case[2]).otherwise(rest), reversed(cases), otherwise)


def files(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """``relative_path, size_bytes, content, text`` of the tree, or of some kinds of its files."""
    found = []
    for kind in kinds or FILES:
        path, rest, divisor, text = FILES[kind]
        found.append(parts(spark, sf).where(F.col("s") % divisor == rest).select(filled(path).alias("relative_path"), filled(text).alias("text")))
    out = reduce(DataFrame.unionByName, found).withColumn("content", F.encode("text", "UTF-8"))
    return out.select("relative_path", F.octet_length("content").cast("long").alias("size_bytes"), "content", "text")


def broken(spark: SparkSession, sf: str) -> DataFrame:
    """Java files with an error, one for every thirteenth size."""
    rows = parts(spark, sf).where("s % 13 = 0")
    return rows.select(filled("bad/B<k>.java").alias("relative_path"), F.encode(filled(BROKEN), "UTF-8").alias("content"))


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """``text``: one diff for each part of some sizes."""
    return parts(spark, sf).select(by_size([(r, m, filled(t)) for r, m, t in DIFFS], F.lit(None)).alias("text")).where("text IS NOT NULL")


_KEPT: dict[tuple[str, str, str], tuple] = {}


def once(spark: SparkSession, sf: str, what: str, make) -> tuple:
    """What ``make`` builds, written once for each application and folder: several queries ask for the same graph."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def java_tables(spark: SparkSession, sf: str) -> JavaTables:
    return once(spark, sf, "tree-java", lambda: (JavaTables(java.parse_files(files(spark, sf, "class", "test"))),))[0]


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole tree."""

    def make():
        nodes, edges = whole_graph(java_tables(spark, sf), files(spark, sf))
        return materialize(nodes, "nodes"), edges

    return once(spark, sf, "tree-graph", make)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that the tree's classes declare; see :func:`declared_nodes`."""
    return declared_nodes(java_tables(spark, sf))


def edges(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    """The whole graph's edges of some types, and no more than these need."""
    return whole_edges(java_tables(spark, sf), files(spark, sf, "sql"), types)


def facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole graph but references of Java code and what only these name; see :func:`fact_graph`."""
    nodes, edges = fact_graph(java_tables(spark, sf), files(spark, sf, "sql"))
    return materialize(nodes, "fact-nodes"), edges
