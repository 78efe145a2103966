"""Bounded walks over an edge table. Every walk takes many seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.ranking import placed
from codeweft.storage import materialize

#: Seeds that share one row of a walk: the bits of a long.
LANES = 64
#: Longs of a row in walks of which only counts are asked.
WORDS = 16


def steps(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Distinct (id, next) pairs in walking direction."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(near).alias("id"), F.col(far).alias("next")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbered(seeds: DataFrame, words: int = 1) -> DataFrame:
    """``seed, lane, word, bit``: seeds in order of id, ``LANES`` times ``words`` of them to a lane, numbered range by range."""
    rows = seeds.select(F.col("id").alias("seed")).distinct().repartitionByRange("seed").sortWithinPartitions("seed")
    word = F.shiftright(F.monotonically_increasing_id(), 6)
    rows = rows.select("seed", word.alias("n"), F.monotonically_increasing_id().bitwiseAND(LANES - 1).cast("int").alias("bit"))
    return materialize(rows.select("seed", F.floor(F.col("n") / words).cast("long").alias("lane"), (F.col("n") % words).cast("int").alias("word"), "bit"), "lanes")


def _flag(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def reached_lanes(moves: DataFrame, start: DataFrame, max_depth: int, with_seed: bool = True, write_last: bool = True) -> DataFrame:
    """``id, lane, bits, depth``: the seeds, as bits of lanes, that first reach a node after so many steps.

    ``start`` holds ``id, lane, bits``; a lane can be several words wide, with a column ``bits...`` for each. A step joins the
    frontier with the moves and combines bits by OR, before the shuffle and after, so it has one row for each node and lane,
    however many seeds come there. If the last step is not to be written, it may hold rows without bits.
    """
    none, words = F.lit(0).cast("long"), [c for c in start.columns if c.startswith("bits")]
    some = reduce(Column.bitwiseOR, [F.col(w) for w in words]) != 0
    frontier, found = start, []
    before = [] if with_seed else [start]
    for depth in range(1, max_depth + 1):
        arrived = frontier.join(moves, "id").select(F.col("next").alias("id"), "lane", *words, *[none.alias(f"old_{w}") for w in words])
        met = [x.select("id", "lane", *[none.alias(w) for w in words], *[F.col(w).alias(f"old_{w}") for w in words]) for x in (*before, *found)]
        # What arrives and what was there meet in one aggregate, so a step is one join and one shuffle more.
        both = _union([arrived, *met]).groupBy("id", "lane").agg(*[F.bit_or(c).alias(c) for c in arrived.columns[2:]])
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.col(f"old_{w}"))).alias(w) for w in words]
        arrived = both.select("id", "lane", *fresh).withColumn("depth", F.lit(depth))
        if depth < max_depth or write_last:
            arrived = materialize(arrived.where(some), "hop")
        if depth < max_depth and arrived.isEmpty():
            break
        found.append(arrived)
        frontier = arrived.select("id", "lane", *words)
    return _union(found) if found else start.limit(0).withColumn("depth", F.lit(0))


def khop(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", types: list[str] | None = None, with_seed: bool = True) -> DataFrame:
    """``seed, id, depth`` of every node within ``max_depth`` steps, at its least depth.

    A seed is in its own result if a cycle leads back to it, unless ``with_seed`` is false. Seeds walk together, as bits;
    pairs of seed and node are rows only in the result.
    """
    moves = materialize(steps(edges, direction, types), "steps")
    lanes = _numbered(seeds)
    start = materialize(lanes.groupBy(F.col("seed").alias("id"), "lane").agg(F.bit_or(_flag(F.col("bit"))).alias("bits")), "start")
    found = reached_lanes(moves, start, max_depth, with_seed)
    bits = F.filter(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda b: F.col("bits").bitwiseAND(_flag(b)) != 0)
    return found.select("id", "lane", "depth", F.explode(bits).alias("bit")).join(lanes, ["lane", "bit"]).select("seed", "id", "depth")


def khop_counts(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """``seed, depth, reached``: how many nodes each seed reaches at each least depth, as :func:`khop` finds them.

    Lanes are wide, so few rows arrive at a node. Bits are counted by word before they become seeds: no pair of seed and
    node is dealt, and the last step is not written.
    """
    moves = materialize(steps(edges, direction, types), "steps")
    words = WORDS if seeds.select("id").distinct().limit(LANES + 1).count() > LANES else 1
    lanes = _numbered(seeds, words)
    each = [F.bit_or(F.when(F.col("word") == w, _flag(F.col("bit"))).otherwise(0)).alias(f"bits{w}") for w in range(words)]
    start = materialize(lanes.groupBy(F.col("seed").alias("id"), "lane").agg(*each), "start")
    found = reached_lanes(moves, start, max_depth, write_last=False)
    by_word = found.select("lane", "depth", F.posexplode(F.array(*[f"bits{w}" for w in range(words)])).alias("word", "bits")).where("bits <> 0")
    counts = [F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"n{b}") for b in range(LANES)]
    by_word = by_word.groupBy("lane", "word", "depth").agg(*counts)
    by_bit = by_word.select("lane", "word", "depth", F.posexplode(F.array(*[f"n{b}" for b in range(LANES)])).alias("bit", "reached")).where("reached > 0")
    return by_bit.join(lanes, ["lane", "word", "bit"]).select("seed", "depth", "reached")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """``id, depth`` of every node that any of the seeds reaches: all seeds as one bit."""
    moves = materialize(steps(edges, direction, types), "steps")
    start = seeds.select("id", F.lit(0).cast("long").alias("lane"), F.lit(1).cast("long").alias("bits")).distinct()
    return reached_lanes(moves, start, max_depth).select("id", "depth")


def call_flow(edges: DataFrame, seeds: DataFrame, max_depth: int = 8, target_prefix: str = "method:") -> DataFrame:
    """``seed, id, depth, parent, confidence, position``: calls breadth first, each at its first finding.

    Depth counts from 0; the seed is not in its own flow. Callees of one caller come in order of id;
    callers in the order in which they were found. ``position`` numbers the flow of each seed: what shallower depths hold
    of it, plus the place at its own depth.
    """
    calls = edges.where((F.col("type") == "CALLS") & F.col("dst").startswith(target_prefix))
    moves = materialize(calls.select(F.col("src").alias("id"), F.col("dst").alias("next"), "confidence").groupBy("id", "next").agg(F.min("confidence").alias("confidence")), "calls")
    start = materialize(seeds.select(F.col("id").alias("seed"), "id").distinct(), "flow-seeds")
    frontier = start.withColumn("position", F.lit(0).cast("long"))
    found = []
    for depth in range(max_depth):
        near = frontier.join(moves, "id").select("seed", F.col("id").alias("parent"), F.col("position").alias("parent_position"), F.col("next").alias("id"), "confidence")
        first = near.groupBy("seed", "id").agg(F.min_by(F.struct("parent", "parent_position", "confidence"), F.struct("parent_position", "parent")).alias("p"))
        visited = _union([start, *[x.select("seed", "id") for x in found]])
        fresh = first.join(visited, ["seed", "id"], "left_anti").select("seed", "id", "p.*")
        fresh = placed(fresh, "seed", ["parent_position", "id"])
        if found:
            before = _union([x.select("seed") for x in found]).groupBy("seed").agg(F.count("*").alias("_before"))
            fresh = fresh.join(before, "seed").withColumn("position", F.col("position") + F.col("_before")).drop("_before")
        fresh = materialize(fresh.withColumn("depth", F.lit(depth)), "flow")
        if fresh.isEmpty():
            break
        found.append(fresh)
        frontier = fresh.select("seed", "id", "position")
    if not found:
        return start.limit(0).select("seed", "id", F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("").alias("confidence"), F.lit(0).cast("long").alias("position"))
    return _union(found).select("seed", "id", "depth", "parent", "confidence", "position")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6, types: list[str] | None = None) -> DataFrame:
    """``src, dst, path``: every path without a repeated node from a source to a target, ending there.

    The least number of steps from each node to a target is found first, backwards from all targets at once. A path is
    carried on only over nodes from which a target is still in reach of the steps that are left, and is dropped as soon as
    it meets a target or a node it already holds. So what is carried is bounded by the walks that do arrive.
    """
    moves = materialize(steps(edges, "out", types or ["CALLS"]), "steps")
    goal = targets.select("id").distinct()
    start = goal.select("id", F.lit(0).cast("long").alias("lane"), F.lit(1).cast("long").alias("bits"))
    left = reached_lanes(moves.select(F.col("next").alias("id"), F.col("id").alias("next")), start, max_hops - 1).select("id", F.col("depth").alias("left"))
    # A target ends a path wherever it stands, so it counts as arrived.
    left = goal.withColumn("left", F.lit(0)).unionByName(left.join(goal, "id", "left_anti"))
    moves = materialize(moves.join(left.withColumnRenamed("id", "next"), "next"), "moves-that-arrive")
    open_paths = sources.select("id").distinct().select(F.col("id").alias("src"), "id", F.array("id").alias("path"))
    found = []
    for hop in range(1, max_hops + 1):
        grown = open_paths.join(moves.where(F.col("left") <= max_hops - hop), "id").where(~F.array_contains("path", F.col("next")))
        grown = materialize(grown.select("src", F.col("next").alias("id"), F.array_append("path", F.col("next")).alias("path"), (F.col("left") == 0).alias("goal")), "paths")
        if grown.isEmpty():
            break
        found.append(grown.where("goal").select("src", F.col("id").alias("dst"), "path"))
        open_paths = grown.where("NOT goal").select("src", "id", "path")
    return _union(found) if found else open_paths.limit(0).select("src", F.col("id").alias("dst"), "path")
