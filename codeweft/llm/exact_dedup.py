"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are compared after each white-space run became one space; a null text counts as empty.
Every stage looks only at what the stage before left undecided:

1. one narrow pass takes each text's normalised length and the hash of its first characters;
2. lengths that occur once are settled; within the other lengths, prefix hashes are counted;
3. groups that still hold two rows or more are marked in a bit table of bounded size, and the pass
   that takes full SHA-256 digests does so only for rows whose (length, prefix hash) is marked.
   A bit shared by accident costs one digest too many and never changes the result.

The counting passes are map-side combined and move no text. The one join, of rows with their
group, is a plain equi-join, so adaptive execution splits a group that holds a third of all rows.

Defined results: null and empty texts are one group; texts that hold only white space are equal
to each other (one space) but not to the empty text. A row that repeats another row's id and text
is the same document and gets the same result. A null id never stays while the group has another
row. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import bit_table, marked, materialize, narrowed, table_words

PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept`` and the ``extra`` columns.

    ``extra`` maps names to expressions over ``_norm``, the normalised text; they are taken in
    the pass that reads full contents.
    """
    extra = extra or {}
    rows = narrowed(docs, id_col, text_col).select("_id", normalized(F.col("_text")).alias("_norm"))
    length = F.octet_length("_norm").cast("long")
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars))

    # Stages 1 and 2: lengths met twice or more, then prefix hashes within them.
    by_prefix = rows.select(length.alias("len"), prefix.alias("pre")).groupBy("len", "pre").agg(F.count("*").alias("n"))
    by_length = by_prefix.groupBy("len").agg(F.sum("n").alias("of_length"))
    undecided = (
        by_prefix.where("n > 1").join(by_length.where("of_length > 1").select("len"), "len", "left_semi").select("len", "pre")
    )
    marks = bit_table(undecided, F.xxhash64("len", "pre"), "dedup-marks", table_words(docs.count()))

    # Stage 3: full digests of what is left. The table of marks is one row of at most 4 MB.
    signed = rows.withColumns({"_len": length, "_pre": prefix}).withColumn("_marked", marked(marks, F.xxhash64("_len", "_pre")))
    signed = signed.select(
        "_id",
        "_len",
        "_pre",
        F.when(F.col("_marked"), F.sha2("_norm", 256)).alias("_full"),
        *[e.alias(k) for k, e in extra.items()],
    )
    signed = materialize(signed, "dedup-signed")
    groups = (
        signed.where("_full IS NOT NULL")
        .groupBy("_len", "_pre", "_full")
        .agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    return signed.join(groups, ["_len", "_pre", "_full"], "left").select(
        F.col("_id").alias("doc_id"),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id").eqNullSafe(F.coalesce("_keep", "_id")), F.lit(True)).alias("kept"),
        *extra,
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from codeweft.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"), extra={"text_sha256": F.sha2("_norm", 256)})


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
