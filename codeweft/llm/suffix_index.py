"""Removal of long repeated byte strings through a logarithmic family of suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts earlier: in a document with a
smaller id, or earlier in the same document. Strings are judged on the input.

Suffixes are sampled without loss: of the 32-byte strings inside a ``length``-byte window the one with
the least hash is the window's anchor, so equal windows have equal anchors at equal places (about
one byte in 35 is an anchor). A suffix array here holds anchors, ordered by the fingerprints of the
anchor and of its context, which is all bytes that any window with this anchor can cover.

* Each batch of text gets its array, which is merge-scanned against the levels of the family that
  the task has built so far; then it becomes a level itself, and levels of equal size merge, so a
  task keeps few levels and sorts each entry a logarithmic number of times. A context met before is
  wholly repeated; only the first is kept. This combines hot passages before anything is shuffled.
* The kept entries are dealt by fingerprint range, in as many ranges as their volume asks for; each range
  runs the same family over the batches of all tasks. Contexts met before are wholly repeated. Anchors with
  two or more different contexts are where repeats begin and end: the bytes of these contexts are fetched and
  ordered, once by what follows the anchor and once by what precedes it, read backwards. Common prefixes of
  neighbours in both orders tell which windows are equal, byte by byte and without hashes. An anchor with more than
  ``HOT_CONTEXTS`` contexts is not held by one task; its windows are grouped by all executors instead.
* Repeats become byte ranges per document, and one join with the texts cuts them out.

:class:`SuffixFamily` keeps the family between batches of documents: levels of entries and texts in a folder. A new
batch gets its arrays, meets the stored levels, loses what they hold already and becomes a level; levels of about
equal size merge, so there are few and each entry is rewritten a logarithmic number of times.

Defined results: a null or empty text keeps nothing and loses nothing; texts under ``length`` bytes
stay whole; ids are integers, a null id counts as the smallest; rows that repeat an id and its text
are one document and get the same result (rows with one id but different texts are compared by their
places, and a place is cut from both); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.arrays import U64, Powers, mixed, over_slices, slices, text_bytes
from codeweft.llm.common import discard, materialize, table

LENGTH = 100
GRAM = 32
#: Entries held by a task before they are sent on.
HELD = 1 << 20
#: Bytes of text whose entries make one range; entries weigh nearly as much.
RANGE_BYTES = 32 << 20
#: Contexts of one anchor that a task may hold: 20 MB of bytes.
HOT_CONTEXTS = 100_000
#: Ranges of a stored family, and how much larger an older level stays than the next.
STORED_RANGES = 256
GROWTH = 2
NO_ID = -(1 << 63)

#: ``gen`` is the batch of documents; of earlier batches every place comes before those of later ones.
ENTRY = np.dtype([("key", "<u8"), ("full", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("gen", "<u2"), ("left", "u1"), ("right", "u1")])
MARK = "gen int, doc long, pos int, left int, right int, key long"


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``least`` over each window of ``width`` values, by running values within blocks."""
    n = len(x) - width + 1
    padded = np.resize(x, -(-len(x) // width) * width)
    padded[len(x) :] = x[-1]
    blocks = padded.reshape(-1, width)
    forward = least.accumulate(blocks, axis=1).ravel()
    backward = least.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(backward[:n], forward[width - 1 : width - 1 + n])


class Anchors:
    """Finds the anchors of many texts at once."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, gen: int = 0) -> None:
        if not gram < length < 256:
            raise ValueError(f"length must lie between {gram} and 256")
        self.length, self.gram, self.gen = length, gram, gen
        self.powers = Powers()

    def of(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> np.ndarray:
        length, gram = self.length, self.gram
        inside = length - gram + 1
        n = len(data)
        if n < length:
            return np.zeros(0, ENTRY)
        prefix = self.powers.prefix(data)
        at = np.arange(n - gram + 1)
        hashes = mixed((prefix[gram:] - prefix[: n - gram + 1]) * self.powers.down[: n - gram + 1]) | U64(1)
        least = sliding(np.minimum, hashes, inside)
        valid = np.zeros(len(least) + 1, dtype=np.int32)
        whole = np.flatnonzero(np.diff(offsets) >= length)
        np.add.at(valid, offsets[whole], 1)
        np.add.at(valid, offsets[whole + 1] - length + 1, -1)
        least[np.cumsum(valid[:-1]) == 0] = 0
        reach = np.zeros(len(hashes) + inside - 1, dtype=U64)
        reach[inside - 1 : inside - 1 + len(least)] = least
        at = at[sliding(np.maximum, reach, inside) == hashes]
        row = np.searchsorted(offsets, at, side="right") - 1
        start = np.maximum(offsets[row], at - (length - gram))
        end = np.minimum(offsets[row + 1], at + length)
        out = np.zeros(len(at), ENTRY)
        out["key"] = hashes[at]
        out["full"] = self.powers.of_spans(prefix, start, end) + mixed((at - start).astype(U64) + U64(1))
        out["doc"], out["pos"] = docs[row], at - offsets[row]
        out["left"], out["right"], out["gen"] = at - start, end - at, self.gen
        return out


def earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries of ``a`` start before those of ``b``."""
    inside = (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & (a["pos"] < b["pos"]))
    return (a["gen"] < b["gen"]) | ((a["gen"] == b["gen"]) & inside)


def suffix_array(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries in order, first of each context; the rest, which repeat one of these)."""
    entries = entries[np.lexsort((entries["pos"], entries["doc"], entries["gen"], entries["full"], entries["key"]))]
    again = np.zeros(len(entries), dtype=bool)
    again[1:] = (entries["key"][1:] == entries["key"][:-1]) & (entries["full"][1:] == entries["full"][:-1])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(entries))))
    later = again & earlier(entries[first], entries)  # the same place of a repeated row is no repeat
    return entries[~again], entries[later]


class Family:
    """Levels of suffix arrays, each at least twice as large as the next."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries that are first with their context so far, repeats); the batch becomes a level."""
        own, repeats = suffix_array(batch)
        repeats = [repeats]
        fresh = np.ones(len(own), dtype=bool)
        for level in self.levels:
            at, found = self._scan(level, own)
            before = found.copy()
            before[found] = earlier(level[at[found]], own[found])
            same = found & ~before & ~earlier(own, level[at])
            repeats.append(own[before & fresh])
            fresh &= ~before & ~same
        own = own[fresh]
        if len(own):
            self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            small = self.levels.pop()
            merged, late = suffix_array(np.concatenate([self.levels.pop(), small]))
            repeats.append(late)
            self.levels.append(merged)
        return own, np.concatenate(repeats)

    @staticmethod
    def _scan(level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each entry of the batch has its context in the level, and whether it is there."""
        code = lambda x: x["key"] ^ mixed(x["full"])
        order = np.argsort(code(level))
        at = np.searchsorted(code(level)[order], code(batch))
        at[at == len(level)] = 0
        at = order[at]
        return at, (level["key"][at] == batch["key"]) & (level["full"][at] == batch["full"])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All first entries in order, and repeats found on the way."""
        return suffix_array(np.concatenate([np.zeros(0, ENTRY), *self.levels]))


def as_ranges(entries: np.ndarray) -> pa.RecordBatch:
    """Rows of wholly repeated contexts: key is null."""
    return _rows(entries, pa.nulls(len(entries), pa.int64()))


def _rows(entries: np.ndarray, key: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(entries[c].astype(np.int64 if c == "doc" else np.int32)) for c in ("gen", "doc", "pos", "left", "right")]
    return pa.RecordBatch.from_arrays([*columns, key], ["gen", "doc", "pos", "left", "right", "key"])


def _by_range(entries: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, its entries) for the ranges that have some; anchors are least hashes, so they are mixed again first."""
    of = ((mixed(entries["key"]) >> U64(32)) * U64(ranges)) >> U64(32)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(ranges + 1).astype(U64))
    entries = entries[order]
    for b in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
        yield b, entries[cuts[b] : cuts[b + 1]].tobytes()


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "gen", "entries"])


def _collect(length: int, ranges: int, gen: int):
    """For mapInArrow over (_id, _text): entries by range, and repeats found within the task under negative numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, family = Anchors(length, gen=gen), Family()
        held, repeats, count = [], [], 0
        turn = TaskContext.get().partitionId() * 7919  # so that tasks deal their repeats out differently

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            yield _blobs([(b, gen, x) for b, x in _by_range(np.concatenate([np.zeros(0, ENTRY), *held]), ranges)])
            late = np.concatenate([np.zeros(0, ENTRY), *repeats])
            parts = [late[i : i + 50_000].tobytes() for i in range(0, len(late), 50_000)]
            yield _blobs([(-1 - (turn + i) % ranges, gen, p) for i, p in enumerate(parts)])
            turn += len(parts)

        for batch in batches:
            for part in slices(batch, "_text"):
                own, late = family.add(anchors.of(*text_bytes(part.column("_text")), part.column("_id").to_numpy(zero_copy_only=False)))
                held.append(own)
                repeats.append(late)
                count += len(own) + len(late)
                if count >= HELD:
                    yield from send()
                    family, held, repeats, count = Family(), [], [], 0
        yield from send()

    return run


def _over_ranges(finish):
    """For mapInArrow over rows sorted by range: one family for each, then ``finish(range, family)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family = None, Family()
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                entries = np.frombuffer(blob, dtype=ENTRY)
                if bucket < 0:
                    yield from finish(None, None, entries)
                    continue
                if bucket != now:
                    if now is not None:
                        yield from finish(now, family, None)
                    now, family = bucket, Family()
                yield from finish(None, None, family.add(entries)[1])
        if now is not None:
            yield from finish(now, family, None)

    return run


def _resolve(gen: int):
    """Repeats of batch ``gen``, and contexts that need their bytes: those of anchors with several, one of that batch."""

    def finish(bucket: int | None, family: Family | None, repeats: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if family is not None:
            entries, repeats = family.all()
            starts = np.flatnonzero(np.diff(entries["key"], prepend=~entries["key"][:1]) != 0) if len(entries) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(entries)))
            newest = np.maximum.reduceat(entries["gen"], starts) if len(entries) else np.zeros(0, np.uint16)
            asked = entries[np.repeat((sizes > 1) & (newest == gen), sizes)]
            yield _rows(asked, pa.array(np.ascontiguousarray(asked["key"]).view(np.int64)))
        yield as_ranges(repeats[repeats["gen"] == gen])

    return _over_ranges(finish)


def _merge(bucket: int | None, family: Family | None, repeats: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The first entries of each range as one array."""
    if family is not None:
        entries, _ = family.all()
        yield _blobs([(bucket, int(entries["gen"].max()), entries.tobytes())])


def _contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, gen, doc, pos, left, bytes) of each asked context of each text."""
    out: list[tuple] = []
    for gen, doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("gen", "_id", "_text", "asked")), strict=True):
        data = text.encode("utf-8")
        out += [(a["key"], gen, doc, a["pos"], a["left"], data[a["pos"] - a["left"] : a["pos"] + a["right"]]) for a in asked]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "gen", "doc", "pos", "left", "context"])


class Ordered:
    """Byte strings in order within their keys, with the lengths of common prefixes of neighbours."""

    def __init__(self, keys: np.ndarray, strings: list[bytes], width: int) -> None:
        n, wide = len(strings), -(-width // 8) * 8
        data = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), dtype=np.uint8).reshape(n, wide)
        words = data.view(">u8")
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.order = np.lexsort((self.size, *(words[:, w] for w in range(words.shape[1] - 1, -1, -1)), keys))
        a, b = self.order[:-1], self.order[1:]
        differ = data[a] != data[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        common = np.minimum(common, np.minimum(self.size[a], self.size[b]))
        self.common = np.where(keys[a] == keys[b], common, -1)

    def classes(self, length: int) -> np.ndarray:
        """A number for each string, equal for strings of one key that share their first ``length`` bytes."""
        out = np.zeros(len(self.order), dtype=np.int64)
        out[self.order[1:]] = np.cumsum(self.common < length)
        return out


def repeated_windows(keys: np.ndarray, places: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, most and least bytes before the anchor) of the windows that an earlier context of the key holds too.

    ``places`` rank the contexts; equal ranks are one place. A window has the anchor at some offset; the windows of
    a context all hold the anchor, so the repeated ones cover one stretch, from the greatest offset to the least.
    """
    after = Ordered(keys, [c[n:] for c, n in zip(contexts, left.tolist(), strict=True)], length)
    before = Ordered(keys, [c[:n][::-1] for c, n in zip(contexts, left.tolist(), strict=True)], length - gram)
    by_place = np.argsort(places, kind="stable")
    most, least = np.full(len(contexts), -1), np.full(len(contexts), length)
    for offset in range(length - gram + 1):
        has = by_place[(before.size[by_place] >= offset) & (after.size[by_place] >= length - offset)]
        code = after.classes(length - offset)[has] * len(contexts) + before.classes(offset)[has]
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        again = has[places[has] > places[has[first[which]]]]
        most[again] = np.maximum(most[again], offset)
        least[again] = np.minimum(least[again], offset)
    found = np.flatnonzero(most >= 0)
    return found, most[found], least[found]


def _compare(length: int, gen: int):
    """For mapInArrow over contexts sorted by key: ranges of repeated windows of one batch; whole keys are held at a time."""

    def ranges(unit: list[tuple]) -> pa.RecordBatch:
        keys, gens, docs, pos, left, contexts = zip(*unit, strict=True) if unit else [()] * 6
        place = np.zeros(len(unit), dtype=[("gen", "<i4"), ("doc", "<i8"), ("pos", "<i4")])
        place["gen"], place["doc"], place["pos"] = gens, docs, pos
        _, ranks = np.unique(place, return_inverse=True)
        found, most, least = repeated_windows(np.array(keys, np.int64), ranks, np.array(left, np.int64), list(contexts), length)
        own = place["gen"][found] == gen
        found, most, least = found[own], most[own], least[own]
        out = np.zeros(len(found), ENTRY)
        out["gen"], out["doc"], out["pos"] = gen, place["doc"][found], place["pos"][found]
        out["left"], out["right"] = most, length - least
        return as_ranges(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if len(held) >= 2000 and row[0] != held[-1][0]:
                    yield ranges(held)
                    held = []
                held.append(row)
        if held:
            yield ranges(held)

    return run


def _compare_hot(contexts: DataFrame, length: int, gen: int, gram: int = GRAM) -> DataFrame:
    """The same ranges for anchors of very many contexts: windows are grouped by what they hold, by all executors."""
    starts = F.sequence(F.lit(0), F.octet_length("context") - length)
    windows = contexts.where(F.octet_length("context") >= length).withColumn("s", F.explode(starts)).withColumn("offset", F.col("left") - F.col("s"))
    windows = windows.where(F.col("offset").between(0, length - gram)).withColumn("held", F.sha2(F.substring("context", F.col("s") + 1, F.lit(length)), 256))
    place = F.struct("gen", "doc", "pos")
    windows = windows.select("key", "offset", "held", place.alias("place"))
    first = windows.groupBy("key", "offset", "held").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(first, ["key", "offset", "held"]).where((F.col("place") > F.col("first")) & (F.col("place.gen") == gen))
    found = again.groupBy("place").agg(F.max("offset").alias("most"), F.min("offset").alias("least"))
    return found.select("place.gen", "place.doc", "place.pos", F.col("most").cast("int").alias("left"), (F.lit(length) - F.col("least")).cast("int").alias("right"), F.lit(None).cast("long").alias("key"))


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, n_bytes, spans, kept) of each text, given its repeated ranges."""
    sizes, spans, kept = [], [], []
    for text, found in zip(batch.column("_text").to_pylist(), batch.column("ranges"), strict=True):
        data = (text or "").encode("utf-8")
        sizes.append(len(data))
        if found is None or found.as_py() is None:
            spans.append([])
            kept.append(data)
            continue
        packed = np.sort(np.asarray(found.values, dtype=np.int64))
        start, end = packed >> 32, np.maximum.accumulate((packed >> 32) + (packed & 0xFFFFFFFF))
        head = np.ones(len(start), dtype=bool)
        head[1:] = start[1:] > end[:-1]
        first = np.flatnonzero(head)
        end = end[np.append(first[1:], len(start)) - 1]
        start = start[first]
        own = np.column_stack([start, end]).tolist()
        spans.append([{"start": a, "end": b} for a, b in own])
        edges = [0, *(x for ab in own for x in ab), len(data)]
        kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.col(f"`{text_col}`").alias("_text"))


def _cut_batch(rows: DataFrame, entries: DataFrame, ranges: int, length: int, gen: int, old_texts: DataFrame | None = None) -> DataFrame:
    """The batch ``gen`` of rows(_id, _text) without what ``entries`` of it and of earlier batches hold earlier."""
    spark = rows.sparkSession
    ordered = entries.repartition(ranges, "bucket").sortWithinPartitions("bucket", "gen")
    marks = materialize(ordered.mapInArrow(_resolve(gen), MARK), "marks")

    texts = rows.repartition("_id")
    wanted = marks.where("key IS NOT NULL")
    asked = wanted.groupBy("gen", F.col("doc").alias("_id")).agg(F.collect_list(F.struct("key", "pos", "left", "right")).alias("asked"))
    every = texts.select(F.lit(gen).alias("gen"), "_id", "_text")
    every = every if old_texts is None else every.unionByName(old_texts)
    contexts = every.where("_text IS NOT NULL").join(asked, ["gen", "_id"]).mapInArrow(over_slices("_text", lambda: _contexts), "key long, gen int, doc long, pos int, left int, context binary")
    hot = wanted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CONTEXTS).select("key")
    repeats = marks.where("key IS NULL")
    if not hot.isEmpty():
        contexts = materialize(contexts, "contexts")
        repeats = repeats.unionByName(_compare_hot(contexts.join(hot, "key", "left_semi"), length, gen))
        contexts = contexts.join(hot, "key", "left_anti")
    contexts = contexts.repartition("key").sortWithinPartitions("key")
    windows = contexts.mapInArrow(_compare(length, gen), MARK)
    found = materialize(repeats.unionByName(windows).select("doc", "pos", "left", "right"), "ranges")
    discard(spark, marks)
    start = F.col("pos") - F.col("left")
    packed = F.call_function("shiftleft", start.cast("long"), F.lit(32)) + (F.col("right") + F.col("left")).cast("long")
    of_doc = found.groupBy(F.col("doc").alias("_id")).agg(F.collect_set(packed).alias("ranges"))
    cut = texts.join(of_doc, "_id", "left").select("_id", "_text", "ranges").mapInArrow(
        over_slices("_text", lambda: _cut), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``; spans are the removed byte ranges."""
    rows = _narrow(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)
    entries = rows.where(F.octet_length("_text") >= length).mapInArrow(_collect(length, ranges, 0), "bucket int, gen int, entries binary")
    return _cut_batch(rows, entries, ranges, length, 0)


class SuffixFamily:
    """A family kept in a folder: ``level-a-b`` holds the entries and texts of the batches a to b."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, ranges: int = STORED_RANGES) -> None:
        self.spark, self.path, self.length, self.ranges = spark, path.rstrip("/"), length, ranges

    def _folder(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._folder().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def levels(self) -> list[tuple[int, int]]:
        """(first, last batch) of each whole level; one that a merged level contains does not count."""
        files = self._files()
        if not files.exists(self._folder()):
            return []
        names = [f.getPath().getName() for f in files.listStatus(self._folder())]
        found = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("level-") and files.exists(self._folder(f"{n}/entries/_SUCCESS"))]
        return sorted(x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found))

    def _entries(self, level: tuple[int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level-{level[0]}-{level[1]}/entries")

    def _texts(self, level: tuple[int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level-{level[0]}-{level[1]}/texts")

    def size(self, level: tuple[int, int]) -> int:
        return self._entries(level).agg(F.coalesce(F.sum(F.octet_length("entries")), F.lit(0))).first()[0] // ENTRY.itemsize

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Cut a new batch by what it and all batches before it hold earlier; then keep it as a level.

        The result is that of :func:`remove_repeats` for the batch's rows; batches before stay as they were.
        """
        rows, old = _narrow(docs, id_col, text_col), self.levels()
        gen = old[-1][1] + 1 if old else 0
        long = rows.where(F.octet_length("_text") >= self.length)
        entries = materialize(long.mapInArrow(_collect(self.length, self.ranges, gen), "bucket int, gen int, entries binary"), "entries")
        both, old_texts = entries, None
        for level in old:
            both = both.unionByName(self._entries(level))
            old_texts = self._texts(level) if old_texts is None else old_texts.unionByName(self._texts(level))
        cut = materialize(_cut_batch(rows, both, self.ranges, self.length, gen, old_texts), "cut")
        self._write((gen, gen), entries.where("bucket >= 0"), long.select(F.lit(gen).alias("gen"), "_id", "_text"))
        discard(self.spark, entries)
        levels = self.levels()
        while len(levels) > 1 and self.size(levels[-2]) < GROWTH * self.size(levels[-1]):
            small, large = levels.pop(), levels.pop()
            merged = (large[0], small[1])
            self._write(merged, self._entries(large).unionByName(self._entries(small)), self._texts(large).unionByName(self._texts(small)))
            for part in (large, small):
                self._files().delete(self._folder(f"level-{part[0]}-{part[1]}"), True)
            levels.append(merged)
        return cut

    def _write(self, level: tuple[int, int], entries: DataFrame, texts: DataFrame) -> None:
        """Texts first: a level counts when its entries are whole."""
        folder = f"{self.path}/level-{level[0]}-{level[1]}"
        texts.write.mode("overwrite").parquet(f"{folder}/texts")
        ordered = entries.repartition("bucket").sortWithinPartitions("bucket", "gen")
        ordered.mapInArrow(_over_ranges(_merge), "bucket int, gen int, entries binary").write.mode("overwrite").parquet(f"{folder}/entries")


def op6_suffix_family(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
