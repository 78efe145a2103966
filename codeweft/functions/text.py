"""Column functions over names, paths, keys and texts. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: endings of text files, markers of secret keys, entry-point names.
TEXT_ENDINGS = [
    ".java", ".scala", ".kt", ".xml", ".yml", ".yaml", ".properties", ".sql", ".json", ".conf", ".md", ".adoc",
    ".rst", ".txt", ".sh", ".bash", ".py", ".gradle", ".toml", ".cfg", ".ini", ".dockerfile",
]
SECRET_MARKERS = [
    "password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "privatekey", "credential",
    "access_key", "client_secret",
]
ENTRY_NAMES = ["main", "run", "execute", "process", "start", "call", "launch", "doWork", "doExecute", "runJob", "runPipeline"]
# Fixed values of the data model: words, and pairs of words, that begin a statement.
STATEMENT_WORDS = ["WITH", "SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE"]
STATEMENT_PAIRS = ["MERGE INTO", "REPLACE INTO", "CREATE TABLE", "CREATE VIEW", "CREATE TEMPORARY", "CREATE GLOBAL", "DROP TABLE", "ALTER TABLE"]
REDACTED = "***REDACTED***"
CHARS_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and underscores; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)))


def rerank_tokens(text: Column) -> Column:
    """Tokens and, of each, the parts between underscores that are longer than two signs."""
    own = tokens(text)
    parts = F.flatten(F.transform(own, lambda t: F.split(t, "_+")))
    return F.array_union(own, F.filter(parts, lambda p: F.length(p) > 2))


def identifier_terms(query: str) -> list[str]:
    """The first six words of a query that look like identifiers; repeats stay."""
    found = re.findall(r"[A-Za-z0-9_]+", query)
    return [t for t in found if len(t) >= 4 or re.search(r"[a-z][A-Z]", t)][:6]


def identifier_terms_of(query: Column) -> Column:
    """:func:`identifier_terms` of a column."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    return F.slice(F.filter(found, lambda t: (F.length(t) >= 4) | t.rlike("[a-z][A-Z]")), 1, 6)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN))


def is_secret_key(key: Column, markers: list[str] | None = None) -> Column:
    """Whether the key holds a marker, in either case; configured markers add to the usual ones."""
    low = F.lower(key)
    found = F.lit(False)
    for m in dict.fromkeys([*SECRET_MARKERS, *(markers or [])]):
        found = found | F.contains(low, F.lit(m.lower()))
    return F.coalesce(found, F.lit(False))


def redacted(value: Column, secret: Column) -> Column:
    """The value, or a mark in place of a secret that is not empty."""
    return F.when(secret & (F.length(value) > 0), F.lit(REDACTED)).otherwise(value)


def is_text_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(TEXT_ENDINGS)


def decoded(content: Column | str) -> Column:
    """Bytes as text; what is not UTF-8 becomes replacement signs, so no file ends a scan."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def short_id(node_id: Column) -> Column:
    """The id without its namespace."""
    return F.regexp_replace(node_id, "^[^:]*:", "")


def bare_type(text: Column) -> Column:
    """A type's name without type arguments, arrays, varargs and annotations; the last word of the rest."""
    plain = F.regexp_replace(F.regexp_replace(text, "<.*>", ""), r"\[\]|\.\.\.", "")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.startswith("@"))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def normal_sql(sql: Column) -> Column:
    """One blank for each run of white space, none at the ends, no closing semicolons."""
    return F.regexp_replace(F.trim(F.regexp_replace(sql, r"\s+", " ")), ";+$", "")


def sql_identity(sql: Column) -> Column:
    return F.concat(F.lit("sql:"), F.substring(F.sha1(F.lower(normal_sql(sql))), 1, 12))


def join_path(base: Column, sub: Column) -> Column:
    """Two parts of a web path, each without slashes at its ends, empty ones left out."""
    parts = F.filter(F.array(*[F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "") for c in (base, sub)]), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def starts_like_sql(text: Column) -> Column:
    """Whether a statement keyword comes first, after comments and white space."""
    head = F.ltrim(F.regexp_replace(text, "^(?:[ \\t\\r\\n]*--[^\n]*\n)+", ""))
    words = F.split(F.upper(F.regexp_replace(head, "^[ \\t\\r\\n]+", "")), "[^A-Z0-9_]+", 4)
    one, two, three = (F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(3))
    pair = F.concat(one, F.lit(" "), two)
    return F.coalesce(one.isin(STATEMENT_WORDS) | pair.isin(STATEMENT_PAIRS) | ((pair == "CREATE OR") & (three == "REPLACE")), F.lit(False))


def numbered_snippet(text: Column, first: Column, last: Column, most: int) -> Column:
    """Lines first..last (from 1), at most so many, each after its number in five places."""
    lines = F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)), F.least(last - F.greatest(first, F.lit(1)) + 1, F.lit(most)))
    return F.array_join(F.transform(lines, lambda x, i: F.format_string("%5d  %s", i + F.greatest(first, F.lit(1)), x)), "\n")


def snippet(text: Column, first: Column, last: Column, most: int = 40) -> Column:
    lines = F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)), F.least(last - F.greatest(first, F.lit(1)) + 1, F.lit(most)))
    return F.array_join(lines, "\n")
