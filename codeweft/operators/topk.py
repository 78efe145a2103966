"""The best k of many queries: kept by each task, then chosen among the tasks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codeweft.storage import materialize

# Fixed values of the data model: how many each pool of a search holds.
POOL = 30
SMALL_POOL = 20
#: Queries that meet a batch of rows together, and that one pass over the rows serves.
QUERY_BLOCK = 1024
PASS_QUERIES = 8 * QUERY_BLOCK


def best(df: DataFrame, k: int, by: list[Column], partition: list[str]) -> DataFrame:
    """The first ``k`` rows of each partition in order, with ``rank`` from 0."""
    order = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


class TaskBest:
    """The best ``k`` (score, id) of each query of a block, among the rows that a task has seen."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, object)] * queries

    def floor(self, query: int) -> float:
        """The score that a row must reach to be among the best."""
        return self.scores[query][-1] if len(self.scores[query]) >= self.k else -np.inf

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor(query)
        if len(scores) > self.k:
            floor = max(floor, np.partition(scores, -self.k)[-self.k])
        at = np.flatnonzero(scores >= floor)
        if not len(at):
            return
        every, own = np.concatenate([self.scores[query], scores[at]]), np.concatenate([self.ids[query], ids[at]])
        order = sorted(range(len(own)), key=lambda i: (-every[i], own[i]))[: self.k]
        self.scores[query], self.ids[query] = every[order], own[order]

    def rows(self, names: list, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        query = [n for n, s in zip(names, self.scores, strict=True) for _ in s]
        columns = [pa.array(query, types[0]), pa.array([i for own in self.ids for i in own], types[1]), pa.array(np.concatenate([np.zeros(0), *self.scores]))]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])


def in_passes(queries: DataFrame, make: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """The rows of ``make(block)`` over the blocks of a query set.

    One block is a plan of its own; where there are more, each is one pass whose result is written, so neither the plan nor
    the driver grows with the number of queries.
    """
    rows, paths, first = queries.toLocalIterator(), [], None
    while block := list(islice(rows, PASS_QUERIES)):
        if first is None:
            first = make(block)
            continue
        if not paths:
            paths += materialize(first, "pass").inputFiles()
        paths += materialize(make(block), "pass").inputFiles()
    if first is None:
        return make([])
    return queries.sparkSession.read.schema(first.schema).parquet(*paths) if paths else first


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of an id column."""
    return to_arrow_type(kind)
