"""Name and call resolution as cascades of equi-joins with a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import bare_type, simple_name

# Fixed values of the data model: simple names that the language imports by itself.
LANGUAGE_TYPES = [
    "String", "Object", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Number", "Void",
    "Math", "System", "Thread", "Runnable", "Exception", "RuntimeException", "Error", "Throwable", "Iterable", "Comparable",
    "CharSequence", "Class", "Override", "Deprecated", "SuppressWarnings", "FunctionalInterface", "SafeVarargs", "StringBuilder",
    "IllegalArgumentException", "IllegalStateException", "NullPointerException", "Cloneable",
]


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds ``target, confidence, declared`` to refs(ref_id, file, package, raw).

    In order: a dotted name (HIGH if declared, else MEDIUM); an import with that simple name (HIGH if
    declared, else MEDIUM); a type of the same package (HIGH); the only declared type of that simple name
    (MEDIUM); a type of the language (MEDIUM); else the name itself (UNKNOWN). ``types(fqn, package)``;
    ``imports(file, fqn, ordinal, wildcard, static)``, of which wildcard imports do not count.
    """
    named = refs.withColumn("name", bare_type(F.col("raw")))
    declared = types.select("fqn", "package").distinct().withColumn("simple", simple_name(F.col("fqn")))
    exact = declared.select(F.col("fqn").alias("name"), F.lit(True).alias("is_declared")).distinct()
    own = imports.where("NOT wildcard").withColumn("name", simple_name(F.col("fqn")))
    own = own.groupBy("file", "name").agg(F.min_by("fqn", "ordinal").alias("import_fqn"))
    own = own.join(exact.select(F.col("name").alias("import_fqn"), F.col("is_declared").alias("import_declared")), "import_fqn", "left")
    beside = declared.groupBy("package", F.col("simple").alias("name")).agg(F.min("fqn").alias("package_fqn"))
    single = declared.groupBy(F.col("simple").alias("name")).agg(F.min("fqn").alias("single_fqn"), F.count("*").alias("c")).where("c = 1").drop("c")
    j = named.join(exact, "name", "left").join(own, ["file", "name"], "left").join(beside, ["package", "name"], "left").join(single, "name", "left")
    dotted = F.contains("name", F.lit("."))
    language = F.col("name").isin(LANGUAGE_TYPES)
    target = (
        F.when(dotted, F.col("name"))
        .when(F.col("import_fqn").isNotNull(), F.col("import_fqn"))
        .when(F.col("package_fqn").isNotNull(), F.col("package_fqn"))
        .when(F.col("single_fqn").isNotNull(), F.col("single_fqn"))
        .when(language, F.concat(F.lit("java.lang."), F.col("name")))
        .otherwise(F.col("name"))
    )
    high = lambda c: F.when(F.coalesce(c, F.lit(False)), "HIGH").otherwise("MEDIUM")
    confidence = (
        F.when(dotted, high(F.col("is_declared")))
        .when(F.col("import_fqn").isNotNull(), high(F.col("import_declared")))
        .when(F.col("package_fqn").isNotNull(), "HIGH")
        .when(F.col("single_fqn").isNotNull() | language, "MEDIUM")
        .otherwise("UNKNOWN")
    )
    is_declared = (
        F.when(dotted, F.coalesce("is_declared", F.lit(False)))
        .when(F.col("import_fqn").isNotNull(), F.coalesce("import_declared", F.lit(False)))
        .otherwise(F.col("package_fqn").isNotNull() | F.col("single_fqn").isNotNull())
    )
    return j.select(*refs.columns, target.alias("target"), confidence.alias("confidence"), is_declared.alias("declared"))


def call_targets(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """``owner, name, arity, target, confidence`` of distinct asked(owner, name, arity) by candidates(owner, name, arity, id).

    One candidate of that arity is HIGH, several are all linked, LOW; without one, a single candidate
    by name is MEDIUM and several are all linked, LOW; with none at all one external target, UNKNOWN.
    """
    j = asked.join(candidates.select("owner", "name", F.col("arity").alias("has_arity"), F.col("id").alias("target")), ["owner", "name"], "left")
    w = Window.partitionBy("owner", "name", "arity")
    same = F.coalesce(F.col("has_arity") == F.col("arity"), F.lit(False))
    j = j.withColumn("exact", F.sum(same.cast("int")).over(w)).withColumn("named", F.count("target").over(w))
    kept = j.where(F.when(F.col("exact") > 0, same).otherwise(F.lit(True)))
    confidence = F.when(F.col("exact") == 1, "HIGH").when(F.col("exact") > 1, "LOW").when(F.col("named") == 1, "MEDIUM").when(F.col("named") > 1, "LOW").otherwise("UNKNOWN")
    external = F.concat(F.lit("extmethod:"), F.coalesce("owner", F.lit("?")), F.lit("."), F.col("name"))
    return kept.select("owner", "name", "arity", F.coalesce("target", external).alias("target"), confidence.alias("confidence")).distinct()


def resolve_calls(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """``call_id, target, confidence`` of calls(call_id, owner, name, arity); see :func:`call_targets`."""
    found = call_targets(calls.select("owner", "name", "arity").distinct(), candidates).withColumnsRenamed({"owner": "_owner", "name": "_name", "arity": "_arity"})
    same = F.col("owner").eqNullSafe(F.col("_owner")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("arity").eqNullSafe(F.col("_arity"))
    return calls.join(found, same).select("call_id", "target", "confidence").distinct()


def link_constructors(creates: DataFrame, constructors: DataFrame) -> DataFrame:
    """``call_id, target, confidence``: the one constructor of that arity, HIGH, or a sole one, MEDIUM."""
    found = resolve_calls(creates, constructors)
    only = Window.partitionBy("call_id")
    return found.withColumn("n", F.count("*").over(only)).where("n = 1 AND confidence IN ('HIGH', 'MEDIUM')").drop("n")
