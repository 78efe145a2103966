"""Java sources to tables: one Arrow pass parses each file, the rest is plain DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.sources.javaparser import parse

LOCATION = "struct<relative_path:string,line_start:int,line_end:int,byte_start:int,byte_end:int>"
NOTES = "array<struct<name:string,arguments_text:string,words:array<string>,texts:array<string>>>"
PARSED = (
    "relative_path string, status string, package string, "
    "imports array<struct<relative_path:string,fqn:string,static:boolean,wildcard:boolean,ordinal:int>>, "
    f"types array<struct<fqn:string,name:string,kind:string,package:string,enclosing_fqn:string,modifiers:array<string>,annotations:{NOTES},"
    f"type_parameters:array<string>,extends:array<string>,implements:array<string>,location:{LOCATION}>>, "
    f"fields array<struct<fqn:string,owner_fqn:string,name:string,type_text:string,modifiers:array<string>,annotations:{NOTES},location:{LOCATION}>>, "
    f"methods array<struct<fqn:string,owner_fqn:string,name:string,kind:string,return_type:string,"
    f"parameters:array<struct<name:string,type_text:string,index:int,varargs:boolean>>,throws:array<string>,modifiers:array<string>,annotations:{NOTES},"
    f"type_parameters:array<string>,location:{LOCATION}>>, "
    "refs array<struct<method_fqn:string,kind:string,name:string,receiver_text:string,arg_count:int,type_text:string,line:int,first_string_arg:string,ref_ordinal:int>>, "
    "errors array<string>, texts array<struct<text:string,line:int,origin:string>>"
)


def parse_files(sources: DataFrame) -> DataFrame:
    """One row for each of sources(relative_path, content); files that cannot be read are ``failed``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse(p, c) for p, c in zip(frame["relative_path"], frame["content"], strict=True)], columns=[c.split(" ")[0] for c in PARSED.split(", ")])

    return sources.select("relative_path", "content").mapInPandas(run, PARSED)


def entities(parsed: DataFrame, what: str) -> DataFrame:
    """The rows of ``types``, ``fields``, ``methods``, ``refs``, ``imports`` or ``texts``, with their file."""
    return parsed.select(F.col("relative_path").alias("file"), F.col("package").alias("file_package"), F.explode(what).alias("_x")).select("file", "file_package", "_x.*")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Files by status and the share that parsed without errors, in per cent with one decimal."""
    return parsed.agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.round(100 * F.avg((F.col("status") == "success").cast("double")), 1).alias("rate"),
    )
