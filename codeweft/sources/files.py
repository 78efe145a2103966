"""File inventory: a recursive scan, filtered before contents are read, classified and hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.classify import classify_path
from codeweft.functions.text import decoded, is_text_name, line_count
from codeweft.sources.tree import MAX_BYTES, list_tree, scan_tree


def read_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``relative_path, size_bytes, content`` of the files below a folder that can be read and are not too large."""
    return scan_tree(spark, root, excluded, max_bytes).where("warning IS NULL").drop("warning")


def oversized(spark: SparkSession, root: str, excluded: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``relative_path, size_bytes, warning`` of what :func:`read_tree` leaves out by its listing, in order of paths."""
    return list_tree(spark, root, excluded, max_bytes).where("warning IS NOT NULL").orderBy("relative_path")


def inventory(files: DataFrame, tests: bool = True, resources: bool = True) -> DataFrame:
    """``relative_path, kind, size_bytes, sha256, lines`` of files(relative_path, size_bytes, content), in order of paths.

    Lines are counted for names of text files, whatever their bytes.
    """
    kind = classify_path("relative_path")
    lines = F.when(is_text_name(F.col("relative_path")), line_count(decoded("content")))
    found = files.select("relative_path", kind.alias("kind"), "size_bytes", F.sha2("content", 256).alias("sha256"), lines.cast("int").alias("lines"))
    if not tests:
        found = found.where(~F.col("kind").isin("java_test", "test_resource"))
    if not resources:
        found = found.where(~F.col("kind").isin("resource", "test_resource"))
    return found.orderBy("relative_path")


def java_lines(files: DataFrame) -> DataFrame:
    """Lines of all Java files; files without a count add none."""
    own = F.when(F.col("kind").isin("java_main", "java_test"), F.coalesce("lines", F.lit(0))).otherwise(0)
    return files.agg(F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("java_lines"), F.count("*").alias("files"))


def application_style(build: DataFrame) -> DataFrame:
    """Adds ``style`` to build(spring_boot_version, _spark): mixed, spark, spring or plain."""
    spring, spark = F.col("spring_boot_version").isNotNull(), F.col("_spark")
    return build.withColumn("style", F.when(spark & spring, "mixed").when(spark, "spark").when(spring, "spring").otherwise("plain"))
