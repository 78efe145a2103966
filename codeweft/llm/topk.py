"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets whose lengths differ by less than a tenth. A query
meets the buckets from the longest on and keeps its k best scores; the k-th is its threshold.
A bucket whose longest vector cannot reach the threshold ends the query's search. Otherwise the
threshold becomes a local cosine threshold of the bucket, threshold / (query length * longest
length), which chooses the pruning: a high one bounds each coordinate of the normalised vector, so
the query's largest coordinate selects candidates (coordinate pruning); a low one selects the vectors
long enough on their own (length pruning). The candidates' integer products are then taken exactly.

Buckets are global: every vector's length gives its bucket, and the table of buckets (a few hundred rows at most)
comes to the driver. They are searched in two rounds, the longest first. The first round gives each query a
threshold; in the second a query is sent only to buckets whose longest vector can still reach it. Within a round
queries form blocks of ``BLOCK_QUERIES`` and a bucket's vectors slices of ``SLICE_VECTORS``; a task searches one
slice for one block with bounded memory, and k rows per query and slice at most meet in one ranking. Queries are a
stated set, so a block meets every slice that its queries may need, but no pair of rows is ever emitted.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; vectors are compared with queries of their own dimension only; ties go to the
smaller id; repeated ids are one query, each of their rows is a candidate of other ids; scores
must fit 64 bits; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import materialize, table

BLOCK_QUERIES = 32_768
SLICE_VECTORS = 32_768
BUCKETS_PER_DOUBLING = 8
#: The part of all vectors, the longest, that the first round searches.
FIRST_PART = 0.1
#: Places in which the bucket of a zero vector lies below all others.
NO_LENGTH = -10_000
COORDINATE_FROM = 0.75


def integers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double")))


class Bucket:
    """Vectors of about one length, longest first."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.ints, self.lengths = ids, ints, lengths
        self.real = ints.astype(np.float64)
        self.directions = self.real / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.most = np.abs(self.real).max(initial=0.0)

    def candidates(self, direction: np.ndarray, length: float, threshold: float) -> np.ndarray | None:
        """Numbers of the vectors that may reach the threshold; None if none can."""
        slack = 1e-9
        if not np.isfinite(threshold) or threshold <= 0 or length == 0:
            return np.arange(len(self.ids))
        if self.lengths[0] * length * (1 + slack) < threshold:
            return None
        cosine = threshold / (length * self.lengths[0]) * (1 - slack)
        if cosine >= COORDINATE_FROM:
            c = int(np.abs(direction).argmax())
            x = direction[c]
            room = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - cosine * cosine)) + slack
            own = self.directions[:, c]
            return np.flatnonzero(own * np.sign(x) >= abs(x) * cosine - room)
        return np.arange(np.searchsorted(-self.lengths, -(threshold / length) * (1 - slack), side="right"))


def buckets_of(ids: np.ndarray, ints: np.ndarray) -> list[Bucket]:
    lengths = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, ints, lengths = ids[order], ints[order], lengths[order]
    group = np.floor(np.log2(np.maximum(lengths, 1e-9)) * BUCKETS_PER_DOUBLING)
    cuts = np.flatnonzero(np.diff(group)) + 1
    return [Bucket(i, v, n) for i, v, n in zip(np.split(ids, cuts), np.split(ints, cuts), np.split(lengths, cuts), strict=True) if len(i)]


def search(queries: tuple[np.ndarray, np.ndarray], buckets: list[Bucket], k: int, floors: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best of each query; scores below its floor, if it has one, don't matter."""
    out = []
    floors = np.full(len(queries[0]), -np.inf) if floors is None else floors
    for query_id, query, floor in zip(*queries, floors.tolist(), strict=True):
        real = query.astype(np.float64)
        length = float(np.sqrt((real**2).sum()))
        direction = real / length if length else real
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in buckets:
            threshold = max(floor, float(best[k - 1]) if len(best) >= k else -np.inf)
            at = b.candidates(direction, length, threshold)
            if at is None:
                break
            exact = b.most * np.abs(real).max(initial=0.0) * len(real) < 2**52
            scores = (b.real[at] @ real).astype(np.int64) if exact else b.ints[at] @ query
            good = (b.ids[at] != query_id) & (scores >= threshold)
            best_ids, best = np.concatenate([best_ids, b.ids[at][good]]), np.concatenate([best, scores[good]])
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        out.append((int(query_id), best_ids, best))
    return out


def _searched(queries: DataFrame, candidates: DataFrame, slices: list[tuple[int, int, float]], blocks: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: k best at most of each query(id, v, size, floor) and slice of (bucket, slices, longest)."""
    names = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("n"), F.lit(float(top)).alias("top")) for b, n, top in slices])
    # A query goes to the slices of the buckets that its floor leaves open; a vector goes once to each block of queries.
    open_to = F.filter(names, lambda b: F.col("floor").isNull() | (b["top"] * F.col("size") * (1 + 1e-9) >= F.col("floor")))
    each = F.flatten(F.transform(open_to, lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: F.struct(b["bucket"].alias("bucket"), i.alias("slice")))))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = queries.select("id", "v", "floor", block.alias("block"), F.explode(each).alias("s")).select("block", "s.bucket", "s.slice", "id", "v", "floor", F.lit(True).alias("q"))
    own = F.create_map(*[x for b, n, _ in slices for x in (F.lit(b), F.lit(n))])[F.col("bucket")]
    found = candidates.where(own.isNotNull()).select("bucket", F.pmod(F.xxhash64("id"), own).cast("int").alias("slice"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    both = asked.unionByName(found.select("block", "bucket", "slice", "id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("q"))).withColumn("dim", F.size("v"))

    def work(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        ids, q = found["id"].to_numpy(), found["q"].to_numpy(zero_copy_only=False).astype(bool)
        values = found["v"].combine_chunks()
        flat = (values.flatten() if isinstance(values, pa.Array) else values.chunk(0).flatten()).to_numpy(zero_copy_only=False)
        ints = flat.astype(np.int64).reshape(len(ids), -1)
        floors = np.nan_to_num(found["floor"].to_numpy(zero_copy_only=False).astype(np.float64)[q], nan=-np.inf)
        out = search((ids[q], ints[q]), buckets_of(ids[~q], ints[~q]), k, floors) if (~q).any() else []
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([np.full(len(i), x, np.int64) for x, i, _ in out]) if out else np.zeros(0, np.int64)),
                "vec_id": pa.array(np.concatenate([i for _, i, _ in out]) if out else np.zeros(0, np.int64)),
                "score": pa.array(np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64)),
            }
        )

    return both.groupBy("block", "bucket", "slice", "dim").applyInArrow(work, "query_id long, vec_id long, score long")


def topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best other rows."""
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("q"))
    good = good.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "q", integers(F.col("v"), scale).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bucket = F.when(F.col("size") > 0, F.floor(F.log2("size") * BUCKETS_PER_DOUBLING).cast("int")).otherwise(NO_LENGTH)
    good = materialize(good.withColumn("size", size).withColumn("bucket", bucket), "vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = good.where("q").dropDuplicates(["id"]).withColumn("floor", F.lit(None).cast("double"))
    blocks = max(1, -(-good.where("q").count() // BLOCK_QUERIES))
    sizes = sorted(((r["bucket"], r["n"], r["top"]) for r in good.groupBy("bucket").agg(F.count("*").alias("n"), F.max("size").alias("top")).collect()), reverse=True)
    total, before, rounds = sum(n for _, n, _ in sizes), 0, ([], [])
    for b, n, top in sizes:
        rounds[before > FIRST_PART * total].append((b, max(1, -(-n // SLICE_VECTORS)), top))
        before += n
    if not rounds[0]:
        return ranked(queries.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)).select("query_id", "rank", "vec_id", "score")
    first = ranked(_searched(queries, good, rounds[0], blocks, k))
    if rounds[1]:
        first = materialize(first, "first-round")
        reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        second = _searched(queries.drop("floor").join(reached, "id", "left"), good, rounds[1], blocks, k)
        first = ranked(first.drop("rank").unionByName(second))
    return first.select("query_id", "rank", "vec_id", "score")


def op7_norm_bucket_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 10
"""
