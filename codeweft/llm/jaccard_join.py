"""Near-duplicate groups by an exact Jaccard join of word shingles over signature trees.

1. One pass turns each text into its set of shingle hashes and, from it, a set id and segment
   signatures. Token hashes are cut into m equal ranges. Two sets with at most d differing tokens
   differ in at most d ranges, so if one of them has tokens in more than d ranges, they share the
   signature of one of those. m is chosen so that nearly all sets do; the few others of a class share
   one signature. A set keeps its d + 1 rarest signatures only: of those that two linked sets share, the
   rarest is among both's. A task sends the signatures of equal sets once. d follows from the threshold for each class of sizes; a linked pair lies in one class
   or in two neighbouring ones. No link can be missed.
2. Set ids with a signature in common fall into one cluster (connected components of narrow
   rows). Equal sets have one id and are one node, so copies never multiply.
3. Every cluster's sets go into signature trees (:mod:`codeweft.llm.signature_tree`), which find
   the links exactly. A cluster beyond ``UNIT_SETS`` sets or ``UNIT_TOKENS`` tokens is cut into parts by size
   class and hash, and every pair of parts that can hold a link is a task of its own: memory stays bounded.
4. Links are joined into components and joined back to all rows.

Defined results: null, empty and white-space texts have an empty set (``n_shingles`` 0) and are
linked with nothing; rows with equal sets are linked; repeated rows get equal results; rows that repeat an
id with other texts are rows of their own; a row without an id links others, but a null id is never a component's
id unless no linked row has one; empty tables give no rows; extra columns are ignored. Set ids and tokens are
64-bit hashes of the words' bytes, each word hashed by steps that mix the whole state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.arrays import U64, mixed, over_slices, signed, text_bytes
from codeweft.llm.common import bit_table, discard, marked, materialize, narrowed, table, table_words
from codeweft.llm.components import components
from codeweft.llm.shingles import Shingler
from codeweft.llm.signature_tree import link_within

UNIT_SETS = 4096
#: Tokens of a unit's sets, 64 MB of them.
UNIT_TOKENS = 1 << 23
#: Occupied ranges a set should have, as a multiple of those needed: the spare ones need no comparison.
SPARE = 1.2


class Classes:
    """Size classes for a threshold, and the number of ranges that each class's scheme uses."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.first = [1]  # smallest size of each class
        self.schemes: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def scheme(self, k: int) -> tuple[int, int]:
        """(ranges, occupied ranges needed) for pairs whose smaller set is of class ``k``.

        (0, 0) if only equal sets link; no ranges if no number of them leaves enough occupied.
        """
        if k not in self.schemes:
            while len(self.first) <= k + 1:
                self.of(self.first[-1])
            differing = (self.first[k + 1] - 1) * (self.den - self.num) // self.num
            self.schemes[k] = (0, 0) if differing == 0 else (self._ranges(self.first[k], differing + 1), differing + 1)
        return self.schemes[k]

    @staticmethod
    def _ranges(size: int, needed: int) -> int:
        """Ranges of which a set of ``size`` tokens occupies enough, but for one in 3000 or so, and some to spare."""
        m, found = needed, 0
        while m <= 4 * size:
            if size <= 256:  # the exact distribution of the number of occupied ranges
                occupied = np.zeros(needed + 1)
                occupied[0] = 1.0
                for _ in range(size):
                    move = occupied[:-1] * (m - np.arange(needed)) / m
                    occupied[:-1] -= move
                    occupied[1:] += move
                enough = occupied[:-1].sum() <= 3e-4
            else:
                empty = math.exp(-size / m)
                spread = math.sqrt(max(0.0, m * empty * (1 - (1 + size / m) * empty)))
                enough = m * (1 - empty) - 3.5 * spread >= needed
            found = found or (m if enough else 0)
            if found and m * (1 - math.exp(-size / m)) >= SPARE * needed:
                return m
            m += max(1, m // 64)
        return found


def signatures(tokens: np.ndarray, classes: Classes) -> tuple[np.ndarray, list[int]]:
    """(signatures of a sorted token set under the schemes of its class and of the one below; spare ones).

    The lowest bit of a signature is its scheme's parity; spare ones are counted by parity.
    """
    own = classes.of(len(tokens))
    out, spare = [], [0, 0]
    for k in (own, own - 1):
        m, needed = classes.scheme(k) if k >= 0 else (0, 0)
        place = np.zeros(0, U64)
        if m:
            of_range = ((tokens >> U64(32)) * U64(m)) >> U64(32)
            starts = np.flatnonzero(np.diff(of_range, prepend=U64(m)))
            place = of_range[starts]
            value = np.add.reduceat(mixed(tokens ^ U64(0x2545F4914F6CDD1D)), starts)
            out.append((mixed(value + mixed(place + U64(k) * U64(1 << 32) + U64(1 << 63))) & ~U64(1)) | U64(k & 1))
        if len(place) < needed:  # too few occupied ranges: it meets the others of its kind
            out.append((mixed(np.array([k], dtype=U64) + U64(0x6C62272E07BB0142)) & ~U64(1)) | U64(k & 1))
        spare[k & 1] = max(0, len(place) - needed)
    return np.concatenate(out) if out else np.zeros(0, U64), spare


def set_id(tokens: np.ndarray) -> int:
    return int(signed(mixed(np.array([mixed(tokens ^ U64(0x853C49E6748FEA9B)).sum() + U64(len(tokens))], dtype=U64)))[0])


def rooted_sets(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``_id, _key, n, set, root``; linked sets have one root.

    ``_key`` is :func:`row_key` of the row; ``set`` and ``root`` are null without words.
    """
    spark = docs.sparkSession
    rows = narrowed(docs, id_col, text_col).withColumn("_key", row_key(F.col("_id"), F.col("_text")))
    kind = rows.schema["_id"].dataType

    def make_sets():
        shingler, classes = Shingler(words), Classes(num, den)
        met: set[int] = set()  # sets of this task so far: a copy sends no signatures again

        def signs_of(tokens: np.ndarray, own: int | None) -> tuple[np.ndarray, list[int]]:
            if own is None or own in met:
                return np.zeros(0, U64), [0, 0]
            met.add(own)
            return signatures(tokens, classes)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingler.of(*text_bytes(batch.column("_text")))
            ids = [set_id(s) if len(s) else None for s in sets]
            found = [signs_of(s, i) for s, i in zip(sets, ids, strict=True)]
            signs = [signed(x) for x, _ in found]
            ends = np.cumsum([0, *map(len, signs)], dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int64))),
                    *(pa.array([spare[i] for _, spare in found], pa.int32()) for i in (0, 1)),
                ],
                ["_id", "_key", "n", "set", "signs", "spare0", "spare1"],
            )

        return work

    long, integer = T.LongType(), T.IntegerType()
    fields = [("_id", kind), ("_key", long), ("n", long), ("set", long), ("signs", T.ArrayType(long)), ("spare0", integer), ("spare1", integer)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    sets = materialize(rows.mapInArrow(over_slices("_text", make_sets), schema), "sets")

    # Clusters: sets that share a signature, by stars around the least set of each signature. The most
    # frequent ones of a set are left out as far as it has spare ones; signatures of one set never count.
    # Dealt by signature once, a set that several tasks met is reduced to one row before anything is counted.
    odd = F.col("sign").bitwiseAND(F.lit(1)) != 0
    signs = sets.select("set", "spare0", "spare1", F.explode("signs").alias("sign")).select("set", "sign", F.when(odd, F.col("spare1")).otherwise(F.col("spare0")).alias("spare"))
    signs = signs.repartition("sign").groupBy("sign", "set").agg(F.min("spare").alias("spare"))
    of_sign = Window.partitionBy("sign")
    shared = signs.withColumns({"least": F.min("set").over(of_sign), "most": F.max("set").over(of_sign), "c": F.count("*").over(of_sign)}).where("least < most")
    rarest = Window.partitionBy("set", odd).orderBy(F.desc("c"), F.desc("sign"))
    kept = shared.withColumn("frequent", F.dense_rank().over(rarest)).where(F.col("frequent") > F.col("spare"))
    stars = kept.select("set", "sign").withColumn("least", F.min("set").over(of_sign)).where("set > least")
    clusters = components(stars.select(F.col("set").alias("big"), F.col("least").alias("small")))

    # One row for every set of a cluster, with the row that its text is taken from and its place in the units of work.
    known = sets.where("set IS NOT NULL").groupBy("set").agg(F.min("_key").alias("_key"), F.first("n").alias("n"))
    members = known.join(clusters.select(F.col("node").alias("set"), F.col("root").alias("cluster")), "set")
    members = materialize(_units(members, num, den), "members")

    # The bit table keeps most texts that no cluster asks for out of the shuffle.
    marks = bit_table(members, F.col("_key"), "asked", table_words(docs.count()))
    chosen = rows.where("_text IS NOT NULL").where(marked(marks, F.col("_key"))).join(members, "_key").select("unit", "part", "set", "_text")

    def make_members():
        shingler = Shingler(words)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = shingler.of(*text_bytes(batch.column("_text")))
            ok = [len(s) > 0 and set_id(s) == i for s, i in zip(found, batch.column("set").to_pylist(), strict=True)]  # keys can collide
            blobs = [s.tobytes() if k else b"" for s, k in zip(found, ok, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("part"), batch.column("set"), pa.array(blobs, pa.binary())], ["unit", "part", "set", "tokens"])

        return work

    tokens = chosen.mapInArrow(over_slices("_text", make_members), "unit array<string>, part array<int>, set long, tokens binary").where("octet_length(tokens) > 0")
    placed = tokens.select(F.explode(F.arrays_zip("unit", "part")).alias("u"), "set", "tokens").select("u.unit", "u.part", "set", "tokens")
    placed = placed.repartition("unit").sortWithinPartitions("unit", "part", "set")
    links = placed.mapInArrow(_link_units(num, den), "big long, small long")
    roots = components(links)
    discard(spark, members)
    discard(spark, marks)
    every = sets.select("_id", "_key", "n", "set").join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    return every.select("_id", "_key", "n", "set", F.coalesce("root", "set").alias("root"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit hash of a row's id and text; a null id or text counts as well."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def jaccard_groups(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``; links need similarity num / den."""
    rows = rooted_sets(docs, words, num, den, id_col, text_col)
    # Of each component only its least id goes back to the rows; equal sets are combined before the shuffle.
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("_id").alias("component"))
    return rows.join(least, "root", "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id")
    )


def _units(members: DataFrame, num: int, den: int) -> DataFrame:
    """Adds ``unit`` and ``part`` arrays: the tasks that a set takes part in, and its side there."""
    classes = Classes(num, den)
    while classes.first[-1] < 1 << 40:
        classes.of(classes.first[-1])
    bounds = F.array(*[F.lit(x).cast("long") for x in classes.first[1:]])
    members = members.withColumn("k", F.size(F.filter(bounds, lambda b: b <= F.col("n"))))
    counts = members.groupBy("cluster", "k").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    cuts = F.ceil(F.greatest(F.col("c") / (UNIT_SETS // 2), F.col("t") / (UNIT_TOKENS // 2))).cast("int")
    whole = (F.sum("c") <= UNIT_SETS) & (F.sum("t") <= UNIT_TOKENS)
    totals = counts.groupBy("cluster").agg(whole.alias("whole"), F.map_from_entries(F.collect_list(F.struct("k", cuts))).alias("parts"))
    placed = members.join(totals, "cluster").withColumn("p", F.pmod(F.xxhash64("set"), F.coalesce(F.try_element_at("parts", F.col("k")), F.lit(1))).cast("int"))
    name = lambda k, p, k2, p2: F.concat_ws(":", F.col("cluster").cast("string"), k, p, k2, p2)
    text = lambda c: c.cast("string")
    own = F.coalesce(F.try_element_at("parts", F.col("k")), F.lit(0))
    above = F.coalesce(F.try_element_at("parts", F.col("k") + 1), F.lit(0))
    below = F.coalesce(F.try_element_at("parts", F.col("k") - 1), F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    k, p = F.col("k"), F.col("p")
    split = F.concat(
        F.transform(upto(own), lambda q: F.struct(name(text(k), text(F.least(p, q)), text(k), text(F.greatest(p, q))).alias("unit"), F.when(q == p, 0).when(p < q, 1).otherwise(2).alias("part"))),
        F.transform(upto(above), lambda q: F.struct(name(text(k), text(p), text(k + 1), text(q)).alias("unit"), F.lit(1).alias("part"))),
        F.transform(upto(below), lambda q: F.struct(name(text(k - 1), text(q), text(k), text(p)).alias("unit"), F.lit(2).alias("part"))),
    )
    one = F.array(F.struct(F.col("cluster").cast("string").alias("unit"), F.lit(0).alias("part")))
    placed = placed.withColumn("u", F.when(F.col("whole"), one).otherwise(split))
    return placed.select("_key", "set", F.transform("u", lambda x: x["unit"]).alias("unit"), F.transform("u", lambda x: x["part"]).alias("part"))


def _link_units(num: int, den: int):
    """For mapInArrow over rows sorted by unit: the links of each unit; one unit is held at a time."""

    def links(unit: list[tuple]) -> list[tuple[int, int]]:
        distinct = {s: (p, t) for p, s, t in unit}
        if len(distinct) < 2:
            return []
        ids = list(distinct)
        sets = [np.frombuffer(distinct[s][1], dtype=U64) for s in ids]
        parts = [distinct[s][0] for s in ids]
        if any(parts) and len(set(parts)) < 2:
            return []
        found = link_within(sets, num, den, parts if any(parts) else None)
        return [(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for name, part, own, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != now:
                    out += links(unit)
                    now, unit = name, []
                unit.append((part, own, tokens))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["big", "small"])
        out = links(unit)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["big", "small"])

    return run


def op4_signature_tree_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
