"""Indexes that are built once, stored as tables, and answer many sets of queries exactly.

Each index is a dictionary of DataFrames, to be kept in one commit (:class:`codeweft.sources.stores.Committed`):

* ``vector_index``: vectors in cells around centres, with each cell's radius. The cosine of a query with any vector of a
  cell is at most that of the angle between query and centre less the radius, so cells that cannot hold one of the best
  are not read.
* ``text_index``: postings of tokens by blocks of ``BLOCK`` texts. How many of a query's tokens a block holds at all bounds
  what any text there can score; blocks below the k-th best so far are passed over.
* ``name_index``: names by the grams of their words. A term looks only at the words that hold its rarest gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions.text import identifier_terms_of, tokens
from codeweft.operators.topk import POOL, SMALL_POOL, TaskBest, arrow_type, best, in_passes
from codeweft.storage import materialize

#: The tables of all indexes.
TABLES = ("cells", "cell_vectors", "postings", "places", "name_words", "name_grams", "gram_counts")
#: Centres at most; what is sent to tasks is so many vectors, whatever the size of the table.
CELLS = 1024
#: Vectors of a cell that one task meets at a time; larger cells are cut.
PART = 1 << 14
#: Slack for the bounds, which come from rounded angles.
SLACK = 1e-9
#: Texts of a block of postings.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS


# -- vectors ------------------------------------------------------------------------------------


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((v * v).sum(axis=1))
    return v / np.where(size > 0, size, 1.0)[:, None], size


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim).astype(np.float64)


def vector_index(vectors: DataFrame, dim: int, cells: int = CELLS) -> dict[str, DataFrame]:
    """``{cells, cell_vectors}`` of vectors(id, vector): those of another dimension, null or with a null are left out.

    The centres are the rows with the least hashes of their ids, about as many as the root of the table's size. Vectors of
    length zero have a cell of their own, number -1.
    """
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") == dim) & F.col("id").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    many = int(min(cells, max(1, rows.count() ** 0.5)))
    chosen = rows.where(F.exists("vector", lambda x: x != 0)).select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(many).collect()
    centres = _unit(np.array([r["vector"] for r in chosen], dtype=np.float64).reshape(len(chosen), dim))[0]
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, size = _unit(_matrix(batch.column("vector"), dim))
            near = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))
            cell = np.where(size > 0, near.argmax(axis=1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near.max(axis=1) if len(near) else np.zeros(0))], schema.names)

    found = materialize(rows.mapInArrow(run, schema), "cell-vectors")
    sizes = found.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    known = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    made = sizes.join(known, "cell", "left").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    dealt = found.drop("near").join(made.select("cell", "parts"), "cell").select("id", "vector", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    return {"cells": made, "cell_vectors": dealt}


def vector_search(index: dict[str, DataFrame], queries: DataFrame, k: int = POOL, report: dict | None = None) -> DataFrame:
    """``query_id, id, score, rank`` as :func:`retrieval.vector_topk`, over an index.

    Every query first meets the cells with the highest bounds until they hold ``k`` vectors; the k-th score there
    decides which other cells can hold a better one. ``report`` receives how many pairs of query and vector were met, of how many.
    """
    cells = [r.asDict() for r in index["cells"].orderBy("cell").collect()]
    total = sum(c["n"] for c in cells)
    dim = next((len(c["centre"]) for c in cells if c["centre"] is not None), None)
    rows = index["cell_vectors"]
    kinds = (queries.schema["query_id"].dataType, rows.schema["id"].dataType)
    out = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])
    types = tuple(arrow_type(x) for x in kinds)
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("q")).where(F.col("q").isNotNull())
    if dim is None:  # nothing but vectors of length zero
        dim = next((len(r["vector"]) for r in rows.select("vector").limit(1).collect()), 1)
    asked = asked.where((F.size("q") == dim) & ~F.exists("q", lambda x: x.isNull()))
    centres = np.array([c["centre"] or [0.0] * dim for c in cells], dtype=np.float64).reshape(len(cells), dim)
    radius = np.array([np.arccos(np.clip(c["least"], -1, 1)) if c["cell"] >= 0 else 0.0 for c in cells])
    sizes, names, parts = (np.array([c[x] for c in cells], dtype=np.int64) for x in ("n", "cell", "parts"))
    real = names >= 0
    pairs = T.StructType([queries.schema["query_id"], *[T.StructField(c, T.IntegerType()) for c in ("cell", "part", "n")], T.StructField("q", T.ArrayType(T.DoubleType()))])

    def bounds(v: np.ndarray) -> np.ndarray:
        unit, size = _unit(v)
        angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) - radius
        out = np.cos(np.maximum(angle, 0.0))
        out[:, ~real] = 0.0
        out[size == 0] = 0.0  # every score of such a query is zero
        return out

    def chosen(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = bounds(_matrix(batch.column("q"), dim)) if batch.num_rows else np.zeros((0, len(cells)))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                opening = np.zeros_like(bound, dtype=bool)
                np.put_along_axis(opening, order, held < k, axis=1)
                if first:
                    take = opening
                else:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False)
                    take = ~opening & (bound >= np.nan_to_num(floor, nan=-2.0)[:, None] - SLACK)
                query, cell = np.nonzero(take)
                again = parts[cell]
                query, cell = np.repeat(query, again), np.repeat(cell, again)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
                at = pa.array(query)
                columns = [batch.column("query_id").take(at), pa.array(names[cell].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((sizes[cell] // parts[cell]).astype(np.int32)), batch.column("q").take(at)]
                yield pa.RecordBatch.from_arrays(columns, pairs.names)

        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one part of a cell for the queries that ask for it."""
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types] + [pa.array([], pa.float64())], names=out.names)
        q, _ = _unit(_matrix(left.column("q"), dim))
        v = _matrix(right.column("vector"), dim)
        ids, size = np.array(right.column("id").to_pylist(), dtype=object), _unit(v)[1]
        scores = np.round(v @ q.T / np.where(size > 0, size, 1.0)[:, None], 12)
        found = TaskBest(left.num_rows, k)
        for j in range(left.num_rows):
            found.add(j, ids, scores[:, j])
        return pa.Table.from_batches([found.rows(left.column("query_id").to_pylist(), types)])

    def scan(wanted: DataFrame) -> DataFrame:
        met = wanted.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(meet, out)
        return best(met, k, [F.desc("score"), F.col("id")], ["query_id"]).drop("rank")

    asked = materialize(asked, "asked")
    opening = materialize(asked.mapInArrow(chosen(True), pairs), "opening-cells")
    first = materialize(scan(opening), "first-cells")
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = materialize(asked.join(floor, "query_id", "left").select("query_id", "q", "floor").mapInArrow(chosen(False), pairs), "other-cells")
    if report is not None:
        met = opening.unionByName(rest).agg(F.sum(F.col("n").cast("long")).alias("n")).first()["n"]
        report.update(pairs_met=met or 0, pairs=total * asked.count())
    both = first.unionByName(scan(rest))
    return best(both, k, [F.desc("score"), F.col("id")], ["query_id"])


# -- texts --------------------------------------------------------------------------------------


def text_index(texts: DataFrame) -> dict[str, DataFrame]:
    """``{postings, places}`` of texts(id, text): for each block and token the places in the block, and each block's ids.

    Texts are numbered in order of id, range by range, so a lower number is a smaller id.
    """
    rows = texts.select("id", tokens(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.col("id").cast("string"))).alias("t"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id())
    rows = materialize(rows.select("id", "t", F.shiftright("n", BLOCK_BITS).alias("block"), F.col("n").bitwiseAND(BLOCK - 1).cast("int").alias("place")), "numbered-texts")
    held = rows.select("block", "place", F.explode("t").alias("token"))
    postings = held.groupBy("block", "token").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return {"postings": postings, "places": rows.select("block", "place", "id")}


def text_search(index: dict[str, DataFrame], queries: DataFrame, k: int = POOL) -> DataFrame:
    """``query_id, id, score, rank`` as :func:`retrieval.lexical_topk`, over an index; texts are not read."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("t"))
    kind = asked.schema["query_id"].dataType
    types = (arrow_type(kind), pa.int64())
    out = T.StructType([T.StructField("query_id", kind), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])

    def make(block: list) -> DataFrame:
        names, sets = [r["query_id"] for r in block], [r["t"] for r in block]
        known = sorted({w for s in sets for w in s})
        place = {w: i for i, w in enumerate(known)}
        asks = [np.array([place[w] for w in s], dtype=np.int64) for s in sets]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = TaskBest(len(names), k)
            lists: list = [None] * len(known)
            now, held = None, []

            def settle() -> None:
                """All postings of a block are there: score it for every query that it can still serve."""
                present = np.zeros(len(known), dtype=bool)
                present[held] = True
                for j, own in enumerate(asks):
                    here = own[present[own]]
                    if not len(here) or len(here) / len(own) < found.floor(j):
                        continue
                    counts = np.bincount(np.concatenate([lists[w] for w in here]), minlength=1)
                    some = np.flatnonzero(counts)
                    found.add(j, (now << BLOCK_BITS) + some, counts[some] / len(own))

            for batch in batches:
                offsets, values = batch.column("places").offsets.to_numpy(), batch.column("places").values.to_numpy()
                for i, (b, w) in enumerate(zip(batch.column("block").to_pylist(), batch.column("token").to_pylist(), strict=True)):
                    if b != now:
                        if held:
                            settle()
                        now, held = b, []
                    held.append(place[w])
                    lists[place[w]] = values[offsets[i] : offsets[i + 1]].copy()
            if held:
                settle()
            yield found.rows(names, types)

        spark = queries.sparkSession
        wanted = spark.createDataFrame([(w,) for w in known], "token string")
        rows = index["postings"].join(F.broadcast(wanted), "token", "left_semi").select("block", "token", "places")
        # Blocks come in order of ids, so of equal scores the smaller ids are met first.
        return rows.repartition("block").sortWithinPartitions("block", "token").mapInArrow(run, out)

    met = best(in_passes(asked, make), k, [F.desc("score"), F.col("id")], ["query_id"])
    met = met.select("query_id", F.shiftright("id", BLOCK_BITS).alias("block"), F.col("id").bitwiseAND(BLOCK - 1).cast("int").alias("place"), "score", "rank")
    return met.join(index["places"], ["block", "place"]).select("query_id", "id", "score", "rank")


# -- names --------------------------------------------------------------------------------------


def name_index(nodes: DataFrame) -> dict[str, DataFrame]:
    """``{name_words, name_grams, gram_counts}`` of nodes(id, name, fqn): the words of names, and their grams of two and three signs."""
    words = nodes.select("id", F.explode(tokens(F.concat_ws(" ", "id", "name", "fqn"))).alias("token"))
    window = lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - (n - 1)), lambda i: F.substr("token", i, F.lit(n)))
    both = F.when(F.length("token") >= 3, F.concat(window(2), window(3))).when(F.length("token") == 2, F.array("token"))
    grams = materialize(words.select("token").distinct().select("token", F.explode(F.array_distinct(both)).alias("gram")), "name-grams")
    return {"name_words": words, "name_grams": grams, "gram_counts": grams.groupBy("gram").agg(F.count("*").alias("n"))}


def name_search(index: dict[str, DataFrame], queries: DataFrame, k: int = SMALL_POOL) -> DataFrame:
    """``query_id, id, score, rank``: nodes whose id, name or fqn holds a term of the query.

    Terms are at most six a query; a node found by two terms is there twice. A term is made of letters, digits and
    underscores, so it stands inside one word of a name, and that word holds every gram of the term: it is sought
    among the words of the gram that the fewest have.
    """
    terms = queries.select("query_id", F.posexplode(identifier_terms_of(F.col("query"))).alias("term_no", "term"))
    distinct = materialize(terms.select(F.lower("term").alias("part")).distinct(), "terms")
    size = F.when(F.length("part") >= 3, 3).otherwise(2)
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length("part") - size + 1, F.lit(1))), lambda i: F.substr("part", i, size))
    asked = distinct.select("part", F.explode(F.array_distinct(own)).alias("gram"))
    # A gram that no word has shows that the term is nowhere; it is the rarest.
    counted = asked.join(index["gram_counts"], "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    holds = index["name_grams"].join(counted, "gram").where(F.contains("token", F.col("part"))).select("part", "token")
    # Nodes of a term come in order of id, so no term needs more than its first ``k``; tasks drop the rest before the shuffle.
    first = Window.partitionBy("part").orderBy("id")
    hits = index["name_words"].join(holds, "token").select("part", "id", F.dense_rank().over(first).alias("r")).where(F.col("r") <= k).select("part", "id").distinct()
    found = terms.join(hits, F.lower("term") == F.col("part")).select("query_id", "term_no", "id", F.lit(1.0).alias("score"))
    return best(found, k, [F.col("term_no"), F.col("id")], ["query_id"]).drop("term_no")
