"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over an index of all their terms.

Terms are lower-cased words and their beginnings of four, six and eight bytes. The examples are a bounded
sample of labelled rows (``EXAMPLES_PER_CLASS`` of each class, chosen by a hash of the id), indexed
with all their terms. A term weighs (1 + log times) * idf * relevance: document frequencies are
counted over all documents, and the relevance log2(2 + rate among toxic / rate among clean examples)
is at least 1. Every term of a text counts in its norm; one that no example holds weighs as if it were in
one document.

The index is an inverted list for each term, over examples that are ordered so that alike ones stand together and cut
into blocks of ``BLOCK``. Lists of terms that few examples hold are taken whole and summed up exactly; for terms that
many hold there is the greatest weight in each block. Both together bound every cosine of a block. The blocks with the
highest bounds are scored first and give each text its k-th best cosine; of the others only blocks whose bound
reaches it are scored, the rest is passed over. Scoring is a single-precision product for a slice of texts whose error
is bounded by ``ROUGH``; examples that may be among the k best are taken exactly, so the neighbours are exact. They vote
with weight 1 / (1.05 - cosine), each class scaled to its share of all labelled rows, and the vote is calibrated by
isotonic regression on the examples themselves, each scored without itself. The neighbours are the evidence.

Defined results: texts without a term of an example (null and empty ones too) have no neighbour
and get the share of toxic rows among such examples; without any labelled row every score is 0;
repeated label rows count once, as toxic if one of them is; repeated rows get equal results; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.arrays import U64, over_slices, signed, slices, span_hashes, text_bytes
from codeweft.llm.common import crc32_of_id, materialize, table

EXAMPLES_PER_CLASS = 2000
BEGINNINGS = (4, 6, 8)
NEIGHBOURS = 31
#: A term is one of many examples if more than this share of them hold it.
MANY = 0.08
ROUGH = 1e-4
#: Examples of a block, and the blocks of a text that are scored before any is passed over.
BLOCK = 64
FIRST_BLOCKS = 8
SLICE_TEXTS = 512
THRESHOLD = 0.3


class Terms:
    """Hashed terms of many texts at once."""

    def __init__(self) -> None:
        self.letter = np.zeros(256, dtype=bool)
        self.letter[97:123] = True
        self.letter[128:] = True

    def all_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every term of each text, as often as it is there."""
        column = pa.array([(t or "").lower() for t in texts], pa.large_string())
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, U64)
        letter = self.letter[data]
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        stop = letter.copy()
        stop[:-1] &= ~letter[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[begins] = letter[begins]
        stop[begins[1:] - 1] = letter[begins[1:] - 1]
        at, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        row = np.searchsorted(offsets, at, side="right") - 1
        terms, rows = [span_hashes(data, at, end)], [row]
        for n in BEGINNINGS:
            long = end - at > n
            terms.append(span_hashes(data, at[long], at[long] + n) ^ U64(n))
            rows.append(row[long])
        return np.concatenate(rows), np.concatenate(terms)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the distinct terms of each text."""
        return distinct(*self.all_of(texts))

    def among(self, texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, times) of the distinct terms of the vocabulary; (row, times) of all others."""
        row, term = self.all_of(texts)
        place = vocabulary.places(term)
        other = place < 0
        key, times = np.unique(row[~other] * np.int64(len(vocabulary.terms) + 1) + place[~other], return_counts=True)
        other_row, _, other_times = distinct(row[other], term[other])
        return *np.divmod(key, len(vocabulary.terms) + 1), times, other_row, other_times


def distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    head = np.ones(len(term), dtype=bool)
    head[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    return row[first], term[first], np.diff(np.append(first, len(term)))


class Vocabulary:
    """Sorted hashes of terms; the leading bits of a hash tell where to look."""

    def __init__(self, terms: np.ndarray) -> None:
        bits = max(1, len(terms).bit_length())
        self.terms, self.shift = terms, U64(64 - bits)
        lead = np.searchsorted(terms >> self.shift, np.arange((1 << bits) + 1, dtype=U64))
        self.start, self.longest = lead.astype(np.int32), int(np.diff(lead).max(initial=0))

    def places(self, term: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those not held."""
        out = np.full(len(term), -1, dtype=np.int64)
        lead = (term >> self.shift).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        left = np.flatnonzero(at < end)
        for k in range(self.longest):
            here = at[left] + k
            same = self.terms[here] == term[left]
            out[left[same]] = here[same]
            left = left[~same & (here + 1 < end[left])]
        return out


class BlockMaxIndex:
    """Unit vectors of examples as inverted lists, and as a table of the terms that many examples hold."""

    def __init__(self, idf: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, beyond: float = 0.0) -> None:
        self.idf, self.n, self.beyond = idf, n, beyond
        weight = self.weights(row, term, times, n)
        order = np.lexsort((row, term))
        self.term_start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.rows, self.values = row[order].astype(np.int32), weight[order]
        self._fill()

    def _fill(self) -> None:
        size = np.diff(self.term_start)
        many = np.flatnonzero(size > max(1, MANY * self.n))
        self.many = np.full(len(self.idf), -1, dtype=np.int32)
        self.many[many] = np.arange(len(many))
        column = np.repeat(self.many, size)
        self.full = np.zeros((self.n, len(many)))
        self.full[self.rows[column >= 0], column[column >= 0]] = self.values[column >= 0]
        self.single = self.full.T.astype(np.float32)
        self.starts = np.arange(0, max(1, self.n), BLOCK)
        self.most = np.maximum.reduceat(self.full, self.starts, axis=0).T.astype(np.float32) if self.n else np.zeros((len(many), 1), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("many", "full", "single", "starts", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fill()

    def weights(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, other_row: np.ndarray | None = None, other_times: np.ndarray | None = None) -> np.ndarray:
        """Of unit vectors; ``other_*`` are terms that no example holds."""
        weight = (1 + np.log(times)) * self.idf[term]
        norm = np.bincount(row, weight**2, minlength=n)
        if other_row is not None:
            norm = norm + np.bincount(other_row, ((1 + np.log(other_times)) * self.beyond) ** 2, minlength=n)
        return weight / np.sqrt(norm)[row]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, weights): (examples, cosines) of the k nearest with a term in common, best first, ties by number.

        If asked, each is searched without the example of its own number.
        """
        for first in range(0, len(vectors), SLICE_TEXTS):
            part = vectors[first : first + SLICE_TEXTS]
            without = np.arange(first, first + len(part)) if leave_out else np.full(len(part), -1)
            yield from self._nearest(part, k, without)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self._nearest([(term, weight)], k, np.array([without])))

    def _rare(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For every example the exact sum over the terms that few examples hold."""
        rare = self.many[term] < 0
        start = self.term_start[term[rare]]
        size = self.term_start[term[rare] + 1] - start
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return np.bincount(self.rows[at], self.values[at] * np.repeat(weight[rare], size), minlength=self.n)

    def _nearest(self, part: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        table = np.zeros((len(part), len(self.single)), dtype=np.float32)
        total = np.zeros((len(part), self.n))
        for i, (term, weight) in enumerate(part):
            held = self.many[term] >= 0
            table[i, self.many[term[held]]] = weight[held]
            total[i] = self._rare(term, weight)
        if not self.n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in part)
            return
        slack = ROUGH * np.maximum(1.0, table.sum(axis=1))
        bound = table @ self.most + np.maximum.reduceat(total, self.starts, axis=1) + 2 * slack[:, None]
        about = np.full((len(part), self.n), -1.0)  # of examples in blocks that were scored

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                at, own = np.flatnonzero(wanted[:, b]), slice(self.starts[b], min(self.n, self.starts[b] + BLOCK))
                about[at, own] = total[at, own] + table[at] @ self.single[:, own]

        out = np.flatnonzero(without >= 0)
        m = min(FIRST_BLOCKS + -(-k // BLOCK), len(self.starts))
        early = bound >= np.partition(bound, -m, axis=1)[:, [-m]]
        score(early)
        about[out, without[out]] = -1.0
        enough = self.n > k
        floor = (np.partition(about, -k, axis=1)[:, -k] if enough else np.zeros(len(part))) - 2 * slack
        score(~early & (bound >= floor[:, None]) & (bound > 2 * slack[:, None]))
        about[out, without[out]] = -1.0
        floor = (np.partition(about, -k, axis=1)[:, -k] if enough else np.zeros(len(part))) - 2 * slack
        for i, (term, weight) in enumerate(part):
            found = np.flatnonzero((about[i] > 0) & (about[i] >= floor[i]))
            cosine, held = total[i, found], self.many[term] >= 0
            if held.any():
                cosine = cosine + (self.full[np.ix_(found, self.many[term[held]])] * weight[held]).sum(axis=1)
            order = np.lexsort((found, -cosine))[:k]
            yield found[order], cosine[order]


def alike_together(row: np.ndarray, term: np.ndarray, n: int, n_terms: int, most: int = 256) -> np.ndarray:
    """An order of examples in which those with the same frequent terms stand together: by their leading component."""
    frequent = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:most]
    place = np.full(n_terms, -1)
    place[frequent] = np.arange(len(frequent))
    held = np.zeros((n, len(frequent)))
    some = place[term] >= 0
    held[row[some], place[term[some]]] = 1.0
    held -= held.mean(axis=0)
    lead = np.linspace(1.0, 2.0, len(frequent))
    for _ in range(20):
        lead = held.T @ (held @ lead)
        lead /= max(1e-12, np.abs(lead).max(initial=0.0))
    return np.argsort(np.round(held @ lead, 9), kind="stable")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function that fits y best."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [highest x, mean, weight]
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a, b, c])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            top, mean, weight = pools.pop()
            low = pools[-1]
            low[1] = (low[1] * low[2] + mean * weight) / (low[2] + weight)
            low[0], low[2] = top, low[2] + weight
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


class Model:
    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, ids: list, toxic: np.ndarray, scale: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vocabulary, self.index, self.ids, self.toxic, self.scale = vocabulary, index, ids, toxic, scale
        some = np.array([len(t) > 0 for t, _ in own])
        without = scale * ~some
        self.none = float((without * toxic).sum() / without.sum()) if without.sum() else float((scale * toxic).sum() / scale.sum())
        votes = np.array([self.vote(*found) for found in index.nearest_of(own, NEIGHBOURS, leave_out=True)])
        good = ~np.isnan(votes)
        self.knots = isotonic(votes[good], toxic[good].astype(float), scale[good]) if good.any() else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        if not len(found):
            return np.nan
        weight = self.scale[found] / (1.05 - np.minimum(cosine, 1.0))
        return float((weight * self.toxic[found]).sum() / weight.sum())

    def score(self, vote: float) -> float:
        if np.isnan(vote):
            return self.none
        # Halfway between the calibrated and the plain vote, so that equal pools keep their order.
        return float(np.clip(0.9 * np.interp(vote, *self.knots) + 0.1 * vote, 0, 1))


def _vectors(row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, index: BlockMaxIndex, *other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    weight = index.weights(row, term, times, n, *other)
    cuts = np.searchsorted(row, np.arange(n + 1))
    return [(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = EXAMPLES_PER_CLASS) -> Model | None:
    """Learn from labels(id, label); statistics of terms come from all ``docs``."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    shares = {r["_toxic"]: r["n"] for r in labels.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = labels.where("_toxic = 1").orderBy(*order).limit(per_class).unionByName(labels.where("_toxic = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    # At most 2 * per_class rows of an id and a label are sent to the texts.
    examples = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    examples = materialize(examples, "examples")

    sizes = {r["_toxic"]: r["n"] for r in examples.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if n_toxic + n_clean == 0:
        return None

    def make_vectors():
        terms = Terms()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, term, times = terms.of(batch.column("_text").to_pylist())
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            arrays = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (signed(term), times.astype(np.int32))]
            return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_toxic"), *arrays], ["_id", "_toxic", "term", "times"])

        return work

    schema = T.StructType([examples.schema["_id"], examples.schema["_toxic"], T.StructField("term", T.BinaryType()), T.StructField("times", T.BinaryType())])
    rows = sorted(examples.mapInArrow(over_slices("_text", make_vectors), schema).collect(), key=lambda r: r["_id"])  # 2 * per_class rows
    toxic = np.array([r["_toxic"] for r in rows])
    scale = np.where(toxic == 1, shares.get(1, 0) / max(1, n_toxic), shares.get(0, 0) / max(1, n_clean))
    row = np.repeat(np.arange(len(rows)), [len(r["times"]) // 4 for r in rows])
    hashes, term = np.unique(np.frombuffer(b"".join(r["term"] for r in rows), U64), return_inverse=True)
    times = np.frombuffer(b"".join(r["times"] for r in rows), np.int32).astype(np.float64)
    order = alike_together(row, term, len(rows), len(hashes))
    number = np.argsort(order)
    rows, toxic, scale, row = [rows[i] for i in order], toxic[order], scale[order], number[row]
    by_row = np.argsort(row, kind="stable")
    row, term, times = row[by_row], term[by_row], times[by_row]
    vocabulary = Vocabulary(hashes)

    n_docs, frequency = _frequencies(texts, vocabulary)
    in_toxic = np.bincount(term[toxic[row] == 1], minlength=len(hashes))
    in_clean = np.bincount(term[toxic[row] == 0], minlength=len(hashes))
    relevance = np.log2(2 + in_toxic / max(1, n_toxic) * n_clean / np.maximum(1, in_clean))
    idf = np.log((n_docs + 1) / (frequency + 1)) + 1
    index = BlockMaxIndex(idf * relevance, row, term, times, len(rows), float(np.log((n_docs + 1) / 2) + 1))
    return Model(vocabulary, index, [r["_id"] for r in rows], toxic, scale, _vectors(row, term, times, len(rows), index))


def _frequencies(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each term."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        terms, own, n = Terms(), shared.value, 0
        total = np.zeros(len(own.terms) + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                _, place, *_ = terms.among(part.column("_text").to_pylist(), own)
                total[:-1] += np.bincount(place, minlength=len(own.terms))
                n += part.num_rows
        total[-1] = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    summed = texts.select("_text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # a row for each term of the examples, and one
    out = np.zeros(len(vocabulary.terms) + 1, dtype=np.int64)
    out[summed["place"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return int(out[-1]), out[:-1]


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns, then ``score, evidence``: the voting examples with cosine and label."""
    rows = docs.select(F.struct(*(keep if keep is not None else [F.col("doc_id")])).alias("_keep"), F.col(f"`{text_col}`").alias("_text"))
    id_type = T.LongType() if model is None or not model.ids or isinstance(model.ids[0], int) else T.StringType()
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", id_type), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.string()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms, own = Terms(), shared.value
        kind = pa.list_(pa.struct([("doc_id", arrow_id), ("cosine", pa.float64()), ("toxic", pa.int32())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            scores, why = np.zeros(n), [[] for _ in range(n)]
            if own is not None:
                row, term, times, *other = terms.among(batch.column("_text").to_pylist(), own.vocabulary)
                vectors = _vectors(row, term, times, n, own.index, *other)
                for i, (found, cosine) in enumerate(own.index.nearest_of(vectors, NEIGHBOURS)):
                    scores[i] = own.score(own.vote(found, cosine))
                    why[i] = [{"doc_id": own.ids[j], "cosine": c, "toxic": int(own.toxic[j])} for j, c in zip(found.tolist(), cosine.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(why, kind)], schema.names)

        return work

    return rows.mapInArrow(over_slices("_text", make), schema).select("_keep.*", "score", "evidence")


def op10_toxicity_neighbours(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = fit(docs, labels.where(~held_out))
    scored = score_toxicity(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
