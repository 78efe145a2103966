"""Vector, lexical and symbol search, rank fusion and reranking, for many queries at once.

A query set is a table ``queries(query_id, query)``. It meets the texts or vectors in passes of ``topk.PASS_QUERIES``
queries, which are sent to all tasks; a task keeps its own best ``k`` of each query, so no pair of a query and a row
is ever a row of a table and only k rows of a task and query are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions.text import rerank_tokens, tokens
from codeweft.operators import topk
from codeweft.operators.indexes import name_index, name_search, text_search, vector_search
from codeweft.operators.topk import POOL, SMALL_POOL, TaskBest, arrow_type, best, in_passes
from codeweft.storage import materialize

# Fixed values of the data model: what a source adds to the fused score, and the fusion constant.
SOURCE_BONUS = {"symbol": 0.30, "vector": 0.0, "lexical": 0.05, "graph-caller": 0.12, "graph-callee": 0.10}
SOURCE_ORDER = ["vector", "lexical", "symbol", "graph-caller", "graph-callee"]
RANK_OFFSET = 10
RERANK_WEIGHT = 0.35
GRAPH_SEEDS = 5


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = POOL, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``query_id, id, score, rank``: exact cosine of every vector with each vector of query(query_id, query_vector).

    Vectors meet queries of their own dimension; those that are null or hold a null take no part; a zero vector counts as
    of length 1. Scores are rounded to twelve places; ties go to the smaller id.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    kinds = (query.schema["query_id"].dataType, rows.schema["id"].dataType)
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])
    types = (arrow_type(kinds[0]), arrow_type(kinds[1]))

    def make(block: list[Row]) -> DataFrame:
        names = [r["query_id"] for r in block]
        sides: dict[int, tuple[list[int], np.ndarray]] = {}
        for dim in {len(r["query_vector"]) for r in block if r["query_vector"] is not None}:
            at = [i for i, r in enumerate(block) if r["query_vector"] is not None and len(r["query_vector"]) == dim]
            own = np.array([block[i]["query_vector"] for i in at], dtype=np.float64).reshape(len(at), dim)
            size = np.sqrt((own * own).sum(axis=1))
            sides[dim] = at, own / np.where(size > 0, size, 1.0)[:, None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = TaskBest(len(names), k)
            for batch in batches:
                lists = batch.column("v")
                sizes, ids = pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.array(batch.column("id").to_pylist(), dtype=object)
                for dim, (at, own) in sides.items():
                    here = np.flatnonzero(sizes == dim)
                    if not len(here):
                        continue
                    v = lists.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(len(here), dim)
                    size = np.sqrt((v * v).sum(axis=1))
                    for start in range(0, len(at), topk.QUERY_BLOCK):
                        scores = np.round(v @ own[start : start + topk.QUERY_BLOCK].T / np.where(size > 0, size, 1.0)[:, None], 12)
                        for j, q in enumerate(at[start : start + topk.QUERY_BLOCK]):
                            best.add(q, ids[here], scores[:, j])
            yield best.rows(names, types)

        return rows.mapInArrow(run, schema)

    return best(in_passes(query.select("query_id", "query_vector"), make), k, [F.desc("score"), F.col("id")], ["query_id"])


def lexical_topk(texts: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """``query_id, id, score, rank``: share of a query's tokens that a text(id, text) or its id holds."""
    rows = texts.select("id", tokens(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.col("id").cast("string"))).alias("t"))
    kinds = (queries.schema["query_id"].dataType, rows.schema["id"].dataType)
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])
    types = (arrow_type(kinds[0]), arrow_type(kinds[1]))

    def make(block: list[Row]) -> DataFrame:
        names, sets = [r["query_id"] for r in block], [r["t"] for r in block]
        words = sorted({w for s in sets for w in s})
        place = {w: i for i, w in enumerate(words)}
        asked = [np.array([place[w] for w in s], dtype=np.int64) for s in sets]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, known = TaskBest(len(names), k), pa.array(words, pa.string())
            most = max(16, (1 << 24) // max(1, len(words)))  # texts at a time: 64 MB
            for batch in batches if words else ():
                for first in range(0, batch.num_rows, most):
                    part = batch.slice(first, most)
                    lists, ids = part.column("t"), np.array(part.column("id").to_pylist(), dtype=object)
                    row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    word = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False)
                    held = np.zeros((len(ids), len(words)), dtype=np.float32)
                    held[row[word >= 0], word[word >= 0]] = 1.0
                    for start in range(0, len(block), topk.QUERY_BLOCK):
                        side = np.zeros((len(words), len(block[start : start + topk.QUERY_BLOCK])), dtype=np.float32)
                        for j, own in enumerate(asked[start : start + topk.QUERY_BLOCK]):
                            side[own, j] = 1.0
                        counts = held @ side
                        for j in range(side.shape[1]):
                            some = np.flatnonzero(counts[:, j])
                            best.add(start + j, ids[some], counts[some, j].astype(np.float64) / max(1, len(sets[start + j])))
            yield best.rows(names, types)

        return rows.mapInArrow(run, schema)

    found = in_passes(queries.select("query_id", tokens(F.col("query")).alias("t")), make)
    return best(found, k, [F.desc("score"), F.col("id")], ["query_id"])


def symbol_pool(nodes: DataFrame, queries: DataFrame, k: int = SMALL_POOL) -> DataFrame:
    """:func:`indexes.name_search` over an index that is made for this one set of queries."""
    return name_search(name_index(nodes), queries, k)


def graph_pools(edges: DataFrame, vector: DataFrame, symbol: DataFrame, prefix: str = "method:", k: int = SMALL_POOL) -> tuple[DataFrame, DataFrame]:
    """Callers and callees of the methods among the first five of the vector and symbol pools."""
    seeds = vector.where(F.col("rank") < GRAPH_SEEDS).select("query_id", "id", F.lit(0).alias("pool"), "rank")
    seeds = seeds.unionByName(symbol.where(F.col("rank") < GRAPH_SEEDS).select("query_id", "id", F.lit(1).alias("pool"), "rank"))
    seeds = seeds.where(F.col("id").startswith(prefix)).groupBy("query_id", "id").agg(F.min(F.struct("pool", "rank")).alias("seed"))
    calls = edges.where("type = 'CALLS'")
    out = []
    for near, far in (("dst", "src"), ("src", "dst")):
        around = calls.select(F.col(near).alias("id"), F.col(far).alias("other")).join(seeds, "id").select("query_id", "seed", F.col("other").alias("id"), F.lit(1.0).alias("score"))
        out.append(best(around, k, [F.col("seed"), F.col("id")], ["query_id"]).drop("seed"))
    return out[0], out[1]


def fuse(pools: dict[str, DataFrame]) -> DataFrame:
    """``query_id, id, fused, sources, first_pool, first_rank``: reciprocal ranks and bonuses, summed.

    Each occurrence counts, also of one id twice in one pool.
    """
    parts = None
    for source in SOURCE_ORDER:
        if source in pools:
            part = pools[source].select(
                "query_id", "id", F.lit(source).alias("source"), F.lit(SOURCE_ORDER.index(source)).alias("pool"), "rank", (1.0 / (F.col("rank") + RANK_OFFSET) + SOURCE_BONUS[source]).alias("part")
            )
            parts = part if parts is None else parts.unionByName(part)
    first = F.min(F.struct("pool", "rank"))
    fused = parts.groupBy("query_id", "id").agg(F.sum("part").alias("fused"), F.sort_array(F.collect_set("source")).alias("sources"), first.alias("first"))
    return fused.select("query_id", "id", "fused", "sources", F.col("first.pool").alias("first_pool"), F.col("first.rank").alias("first_rank"))


def jaccard_rerank(fused: DataFrame, texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, score, sources, rank``: fused score and token overlap, 0.65 to 0.35.

    A query without a token keeps the order of the pools.
    """
    # Tokens are compared by 64-bit hashes: sets of longs are shuffled and met faster than sets of strings.
    hashes = lambda text: F.array_distinct(F.transform(rerank_tokens(text), lambda t: F.xxhash64(t)))
    asked = queries.select("query_id", hashes(F.col("query")).alias("q"))
    held = texts.select("id", hashes(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.col("id").cast("string"))).alias("t"))
    shared = fused.join(held, "id").join(asked, "query_id").withColumn("n", F.size(F.array_intersect("q", "t")))
    both = shared.select(*fused.columns, "q", "n", F.size("t").alias("m"))
    overlap = F.col("n") / F.greatest(F.lit(1), F.size("q") + F.col("m") - F.col("n"))
    score = F.when(F.size("q") == 0, F.col("fused")).otherwise((1 - RERANK_WEIGHT) * F.col("fused") + RERANK_WEIGHT * overlap)
    scored = both.select("query_id", "id", score.alias("score"), "sources", F.when(F.size("q") == 0, F.struct("first_pool", "first_rank")).alias("keep"))
    return best(scored, k, [F.col("keep"), F.desc("score"), F.col("id")], ["query_id"]).drop("keep")


def no_rerank(fused: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` by first pool, then by rank there; scores do not matter."""
    kept = best(fused, k, [F.col("first_pool"), F.col("first_rank"), F.col("id")], ["query_id"])
    return kept.select("query_id", "id", F.col("fused").alias("score"), "sources", "rank")


def incremental_vectors(chunks: DataFrame, old: DataFrame, embed) -> DataFrame:
    """``id, text_hash, vector, reused``: vectors of chunks(id, text), reusing old(text_hash, vector).

    Old rows of vanished chunks fall away; only texts without an old vector are embedded.
    """
    hashed = chunks.withColumn("text_hash", F.sha1(F.coalesce("text", F.lit(""))))
    known = old.groupBy("text_hash").agg(F.first("vector").alias("vector"))
    both = hashed.join(known, "text_hash", "left")
    reused = both.where("vector IS NOT NULL").select("id", "text_hash", "vector", F.lit(True).alias("reused"))
    fresh = both.where("vector IS NULL").select("id", "text_hash", embed(F.col("text")).alias("vector"), F.lit(False).alias("reused"))
    return reused.unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def hydrate(fused: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``text, kind, file, line, fqn`` from nodes(id, kind, name, fqn, file, line_start) and chunks(node_id, text, ...).

    The node's own values come first, the text is the chunk's; what is neither node nor chunk falls away.
    """
    ids = fused.select("id").distinct()
    n = nodes.join(ids, "id", "left_semi").select("id", *[F.col(c).alias(f"n_{c}") for c in ("kind", "name", "fqn", "file", "line_start")], F.lit(True).alias("is_node"))
    c = chunks.select(F.col("node_id").alias("id"), *[F.col(c).alias(f"c_{c}") for c in ("text", "kind", "fqn", "file", "line_start")], F.lit(True).alias("is_chunk")).join(ids, "id", "left_semi").dropDuplicates(["id"])
    both = fused.join(n, "id", "left").join(c, "id", "left").where("is_node OR is_chunk")
    first = lambda name: F.coalesce(f"n_{name}", f"c_{name}")
    return both.select(*fused.columns, F.coalesce("c_text", "n_name", F.lit("")).alias("text"), first("kind").alias("kind"), first("file").alias("file"), first("line_start").alias("line"), first("fqn").alias("fqn"))


def hybrid_retrieve(
    chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 10, vector_k: int = POOL, kind: str | None = None,
    index: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """``query_id, id, score, sources, rank, text, kind, file, line, fqn``: all pools, fused, hydrated and reranked.

    ``chunks(node_id, text, kind, fqn, file, line_start)``; ``vectors(node_id, vector)``; ``queries(query_id, query)``;
    ``query_vectors(query_id, query_vector)``. ``kind`` restricts the vector pool. With an ``index`` (the tables of
    :mod:`codeweft.operators.indexes`, by node id) texts, names and vectors are sought there; results are the same.
    """
    of_kind = None if kind is None else chunks.where(F.col("kind") == kind).select(F.col("node_id").alias("id")).distinct()
    vectors = vectors.select(F.col("node_id").alias("id"), "vector")
    if index is None:
        found = vector_topk(vectors if of_kind is None else vectors.join(of_kind, "id", "left_semi"), query_vectors, vector_k)
        names, lexical = symbol_pool(nodes, queries), lexical_topk(chunks.select(F.col("node_id").alias("id"), "text"), queries, vector_k)
    else:
        held = index["cell_vectors"] if of_kind is None else index["cell_vectors"].join(of_kind, "id", "left_semi")
        found = vector_search(index | {"cell_vectors": held}, query_vectors, vector_k)
        names, lexical = name_search(index, queries), text_search(index, queries, vector_k)
    # Read by the fusion and, for their seeds, by the graph pools.
    vector, symbol = materialize(found, "vector-pool"), materialize(names, "symbol-pool")
    callers, callees = graph_pools(edges, vector, symbol)
    fused = fuse({"vector": vector, "lexical": lexical, "symbol": symbol, "graph-caller": callers, "graph-callee": callees})
    # Read for the ids to hydrate and by the reranking; a text is fetched once however many queries found it.
    fused = materialize(fused, "fused")
    found = materialize(hydrate(fused.select("id").distinct(), nodes, chunks), "found")
    ranked = jaccard_rerank(fused, found.select("id", "text"), queries, k).join(found, "id")
    return ranked.select("query_id", "id", "score", "sources", "rank", "text", "kind", "file", "line", "fqn")
