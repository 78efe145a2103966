"""Helpers shared by the operators: inputs, shared storage, safe column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one process a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeweft-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Names of the folders that this process has written; each holds a random id of its own.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of shared files, not a recomputation.
    """
    spark = df.sparkSession
    folder = f"codeweft-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(f"{shared_dir(spark)}/{folder}")
    _WRITTEN.add(folder)
    return spark.read.schema(df.schema).parquet(f"{shared_dir(spark)}/{folder}")


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote here and that no later plan reads; any other table stays."""
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if (name := folder.rpartition("/")[2]) in _WRITTEN:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN.discard(name)


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under private names, so that extra columns of any name can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


#: Words of 64 bits in a bit table, at least and at most: 2**19 words are 4 MB wherever it is sent.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 19


def table_words(keys: int) -> int:
    """Words for about so many keys, eight bits for each. A fuller table marks more by chance and never less."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, keys // 8 - 1).bit_length()))


def _place(code, words) -> tuple[F.Column, F.Column]:
    word = F.pmod(F.shiftrightunsigned(code, 6), words).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(64)).cast("int"))


def bit_table(keys: DataFrame, code: F.Column, name: str, words: int = 1 << 16) -> DataFrame:
    """One row of ``words`` words that marks the 64-bit codes of all ``keys``; unmarked codes are surely absent."""
    word, bit = _place(code, F.lit(words))
    none = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    found = keys.select(word.alias("w"), bit.alias("bits")).unionByName(none).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    marks = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("m"))
    return materialize(marks, name)


def marked(marks: DataFrame, code: F.Column) -> F.Column:
    """Whether a code is marked; by chance a few are that no key has."""
    word, bit = _place(code, F.size(marks.scalar()))
    return F.get(marks.scalar(), word).bitwiseAND(bit) != 0


def crc32_of_id(col) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(col.cast("string").cast("binary"))
