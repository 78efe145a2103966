"""Kind of a file by its path: ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: kinds in rule order, as (kind, condition on the lower-case file
# name `lower`, or on the slash-enclosed path `p`), in SQL so that other engines can be given the same.
RULES = [
    ("java_test", r"lower LIKE '%.java' AND (p LIKE '%/src/test/%' OR p LIKE '%/test/%' OR p LIKE '%/tests/%' OR lower LIKE '%test.java' OR lower LIKE '%tests.java' OR lower LIKE '%it.java' OR lower LIKE '%spec.java')"),
    ("java_main", r"lower LIKE '%.java'"),
    ("scala", r"lower LIKE '%.scala' OR lower LIKE '%.sc'"),
    ("maven_pom", r"lower = 'pom.xml'"),
    ("gradle_build", r"lower IN ('build.gradle', 'build.gradle.kts')"),
    ("gradle_settings", r"lower IN ('settings.gradle', 'settings.gradle.kts')"),
    ("gradle_properties", r"lower = 'gradle.properties'"),
    ("app_config", r"(lower LIKE 'application%' OR lower LIKE 'bootstrap%') AND (lower LIKE '%.yml' OR lower LIKE '%.yaml' OR lower LIKE '%.properties')"),
    ("spark_config", r"(lower LIKE '%spark%' AND (lower LIKE '%.conf' OR lower LIKE '%.properties')) OR lower IN ('spark-defaults.conf', 'spark-env.sh')"),
    ("sql", r"lower LIKE '%.sql'"),
    ("docker", r"lower = 'dockerfile' OR lower LIKE '%.dockerfile' OR lower LIKE 'dockerfile.%' OR lower LIKE 'docker-compose%'"),
    ("readme", r"lower LIKE 'readme%'"),
    ("doc", r"lower LIKE '%.md' OR lower LIKE '%.adoc' OR lower LIKE '%.rst'"),
    ("script", r"lower IN ('mvnw', 'mvnw.cmd', 'gradlew', 'gradlew.bat') OR lower LIKE '%.sh' OR lower LIKE '%.bash' OR lower LIKE '%.ps1' OR p LIKE '%/scripts/%' OR p LIKE '%/bin/%'"),
    ("build_other", r"lower IN ('.classpath', '.project', '.factorypath', '.gitattributes', '.gitignore', '.editorconfig', '.dockerignore') OR p LIKE '%/.settings/%'"),
    ("test_resource", r"p LIKE '%/src/test/resources/%'"),
    ("resource", r"p LIKE '%/src/main/resources/%'"),
    ("build_other", r"lower LIKE '%.xml' OR lower LIKE '%.yml' OR lower LIKE '%.yaml' OR lower LIKE '%.properties' OR lower LIKE '%.json' OR lower LIKE '%.toml' OR lower LIKE '%.conf' OR lower LIKE '%.ini' OR lower LIKE '%.cfg'"),
]


def case_sql(path: str) -> str:
    """The rules as one CASE over a SQL expression; runs in Spark and DuckDB alike."""
    slashed = f"replace({path}, chr(92), '/')"
    p = f"concat('/', {slashed}, '/')"
    lower = f"lower(regexp_replace({slashed}, '^.*/', ''))"
    rules = [(kind, f" {rule} ".replace(" p ", f" {p} ").replace("(p ", f"({p} ").replace(" lower ", f" {lower} ").replace("(lower ", f"({lower} ")) for kind, rule in RULES]
    return "CASE " + " ".join(f"WHEN {rule.strip()} THEN '{kind}'" for kind, rule in rules) + " ELSE 'other' END"


def classify_path(path: str) -> Column:
    """The kind for the path column or expression named by ``path``."""
    return F.expr(case_sql(path))
