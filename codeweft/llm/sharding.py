"""Sharding by minimax contiguous partition over ordered atomic groups.

A group is all rows with equal texts; it never crosses shards. Groups stand in order of their digests and are
taken together by the leading digits of these: a unit is all groups with one beginning, at most
``UNITS_PER_SHARD`` units for each shard, so the driver gets a bounded number of unit sizes and never the groups.
With few groups nearly every unit is one group; with many, a unit is a small part of a shard.

The smallest shard capacity for which a greedy left-to-right cut needs no more than the given number of shards is
found by binary search over the units. A group as large as an even share of what is left takes a shard of its own
first and the search goes on over the rest, so one huge group neither raises the capacity of the other shards nor
leaves shards empty.

Shards then follow from comparing beginnings of digests with at most ``n_shards`` literals. Slots count from 0
within a shard: rows are dealt to 4096 parts by a hash of all they have and a number of their own, numbered inside
(shard, part), and the parts' counts are summed up; no part grows with a hot id or text.

Defined results: a null text has size 1, like the empty text, and is equal to it. Repeated rows
each get a slot of their own. Fewer groups than shards leave shards empty. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import discard, materialize, narrowed, table

UNITS_PER_SHARD = 4096
SLOT_RANGES = 4096


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Places before which a greedy walk begins the next shard, or None if it needs more shards."""
    cuts: list[int] = []
    held = 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if held + size > capacity:
            cuts.append(i)
            held = 0
            if len(cuts) >= shards:
                return None
        held += size
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the smallest feasible capacity."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)) - 1, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy_cuts(sizes, shards, middle) is not None else (middle, high)
    return greedy_cuts(sizes, shards, high) or []


def alone(largest: list[int], total: int, shards: int) -> int:
    """How many of the largest sizes, in descending order, take a shard of their own."""
    n = 0
    while n < len(largest) and shards > 1 and largest[n] * shards >= total:
        total, shards, n = total - largest[n], shards - 1, n + 1
    return n


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``."""
    spark = docs.sparkSession
    rows = narrowed(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    rows = materialize(
        rows.select(
            "_id",
            (F.octet_length("_text") + 1).cast("long").alias("size"),
            F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
            F.sha2("_text", 256).alias("digest"),
        ),
        "shard-rows",
    )
    digits = max(1, -(-((UNITS_PER_SHARD * n_shards - 1).bit_length()) // 4))  # hexadecimal digits of a beginning
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("total")), "shard-groups")
    # At most n_shards groups and UNITS_PER_SHARD * 16 * n_shards units come to the driver.
    total = groups.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    large = groups.orderBy(F.desc("total"), "digest").limit(n_shards).collect()
    own = large[: alone([r["total"] for r in large], total, n_shards)]
    is_own = F.col("digest").isin([r["digest"] for r in own]) if own else F.lit(False)
    units = groups.where(~is_own).groupBy(F.substring("digest", 1, digits).alias("unit")).agg(F.sum("total").alias("total")).collect()
    units = sorted((r["unit"], r["total"]) for r in units)
    cuts = [units[i][0] for i in minimax_cuts([n for _, n in units], n_shards - len(own))]
    shard = F.lit(len(own))
    for beginning in cuts:
        shard = shard + (F.substring("digest", 1, digits) >= beginning).cast("int")
    for i, r in reversed(list(enumerate(own))):
        shard = F.when(F.col("digest") == r["digest"], i).otherwise(shard)

    part = F.pmod(F.xxhash64("_id", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(SLOT_RANGES)).cast("int").alias("part")
    placed = materialize(rows.select("_id", "size", "text_crc32", shard.alias("shard"), part), "shard-placed")
    discard(spark, groups)
    discard(spark, rows)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = Window.partitionBy("shard", "part").orderBy("_id", "text_crc32", "size")
    return (
        placed.withColumn("within", F.row_number().over(number) - 1)
        .join(starts, ["shard", "part"])
        .select(F.col("_id").alias("doc_id"), "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
    )


def op2_minimax_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
