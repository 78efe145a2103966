"""Configuration files flattened to keys and values, secrets redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import is_secret_key, redacted


def flatten_yaml(text: str) -> list[tuple[str, str]]:
    """Dotted keys, list places in brackets; nothing for text that is not YAML."""
    import yaml

    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    out: list[tuple[str, str]] = []
    stack = [("", tree)]
    while stack:
        key, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{key}.{k}" if key else str(k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{key}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            out.append((key, "" if value is None else str(value)))
    return out


def yaml_pairs(files: DataFrame) -> DataFrame:
    """``file, key, value`` of files(relative_path, text)."""
    flatten = F.udf(flatten_yaml, "array<struct<key:string,value:string>>", useArrow=True)
    return files.select(F.col("relative_path").alias("file"), F.inline(flatten(F.coalesce("text", F.lit("")))))


def properties_pairs(files: DataFrame) -> DataFrame:
    """The same of properties files: the first ``=`` separates, or without one the first ``:``."""
    line = files.select(F.col("relative_path").alias("file"), F.explode(F.split("text", r"\r?\n")).alias("line")).select("file", F.trim("line").alias("line"))
    line = line.where(~F.col("line").rlike("^([#!]|$)") & F.col("line").rlike("[=:]"))
    at = F.when(F.contains("line", F.lit("=")), F.instr("line", "=")).otherwise(F.instr("line", ":"))
    return line.select("file", F.trim(F.substring("line", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value"))


def config_rows(files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """``file, key, value, secret`` of all configuration files; configured markers add to the usual ones."""
    yaml_file = F.lower("relative_path").rlike(r"\.ya?ml$")
    pairs = yaml_pairs(files.where(yaml_file)).unionByName(properties_pairs(files.where(~yaml_file)))
    secret = is_secret_key(F.col("key"), markers)
    return pairs.select("file", "key", redacted(F.col("value"), secret).alias("value"), secret.alias("secret"))
