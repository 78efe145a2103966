"""A corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Every stage takes and returns rows with the columns of ``documents`` (the last returns packed
pieces), works on all rows that the stage before kept, and is written and read again before the next.
Stages never look at extra columns, keep them whatever their names, and accept empty tables. Copies are
told apart by id and text together, so a row never goes because another text has its id. Of copies the one
with the least id stays; of rows that repeat an id and a text, the one with the least hash of all its columns.
Rows without an id are never dropped as copies, since nothing could name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm import exact_dedup, jaccard_join, language_id, packing, secrets
from codeweft.llm.common import discard, materialize, table

#: A text goes if its language holds fewer of its letter n-grams than this part of what the language's labelled texts reach.
PART_OF_USUAL = 0.5
#: Texts of fewer letters are too short for that and go only below the fixed coverage.
SHORT_LETTERS = 20
LEAST_COVERAGE = 0.05
TOKENIZER = "byte_bpe_50k.json"


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of no known language; fills in a missing ``lang``."""
    labelled = docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    model = language_id.fit(labelled)
    found = language_id.identify(docs, model, keep=[_row(docs)], within="_row")
    if model is not None:
        floor = F.lit(LEAST_COVERAGE)
        for name, usual in language_id.usual_coverage(labelled, model).items():
            floor = F.when(F.col("lang_pred") == name, max(LEAST_COVERAGE, PART_OF_USUAL * usual)).otherwise(floor)
        enough = F.col("_row.text").rlike(rf"(?:\p{{L}}\P{{L}}*+){{{SHORT_LETTERS}}}")
        found = found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= F.when(enough, floor).otherwise(LEAST_COVERAGE)))
    else:
        found = found.where(F.coalesce(F.col("_row.text").rlike(r"\p{L}"), F.lit(False)))
    lang = F.coalesce(F.col("_row.lang"), F.col("lang_pred"))
    return found.select(F.col("_row").withField("lang", lang).alias("_row")).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    found = exact_dedup.exact_dedup(docs, extra={"_key": F.xxhash64("_norm")})
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "_key", F.lit(True).alias("_gone")).distinct()
    rows = docs.select(_row(docs), F.col("doc_id").alias("_id"), F.xxhash64(exact_dedup.normalized(F.col("text"))).alias("_key"))
    # One shuffle of the texts: the join deals by id and key, and so does the choice among rows that repeat both.
    first = Window.partitionBy("_id", "_key").orderBy(F.xxhash64("_row"))
    left = rows.join(gone, ["_id", "_key"], "left").where("_gone IS NULL").withColumn("_k", F.row_number().over(first))
    return left.where("_k = 1 OR _id IS NULL").select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    groups = jaccard_join.rooted_sets(docs, words=5, num=80, den=100).where("root IS NOT NULL AND _id IS NOT NULL")
    first = groups.groupBy("root").agg(F.min(F.struct("_id", "_key")).alias("first"))
    gone = groups.join(first, "root").where(F.struct("_id", "_key") != F.col("first")).select("_id", "_key").distinct()
    rows = docs.select(_row(docs), F.col("doc_id").alias("_id"), jaccard_join.row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    return rows.join(gone, ["_id", "_key"], "left_anti").select("_row.*")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the new text."""
    clean = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 tokens: one row per piece, with its ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("secret_scan", secret),
    ("packing", pack),
]

#: SQL can state neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # never the input
            discard(spark, before)
        docs = before = after
    return docs
