"""Language ID by language-bitmask n-gram filters.

The model is a bit-sliced Bloom filter: a table of slots, each a bit mask with one bit per
language (in as many words of 64 bits as the languages need). An n-gram (3 and 4 letters, words padded by one blank) sets its languages' bits in each
of its slots; the AND of an n-gram's slots is the set of all languages that hold it, found in one
look-up for every language at once. A text's score for a language is the number of its n-grams
whose mask has the language's bit, corrected for the filter's false positives: of N look-ups a
share p = fill**hashes hits by chance, so (hits - N * p) / (1 - p) remain. The most hits decide;
ties go to the language with more n-grams held by no other language, then to the first by name.

Which n-grams a language holds is learned from every whole labelled text: those that it uses twice or more,
and twice or more in each 1000 of its texts, so that a language holds the same n-grams however many texts there
are; stray n-grams, which another language uses ten times as often, are left out. Tasks count n-grams and
combine the bits of each slot; the driver gets the marked slots alone. The table has a fixed number of
slots and is the only thing sent to executors. Prediction reads every whole text in one pass, without a shuffle.

Defined results: ``und`` with score 0 for null texts and texts without a letter; a text with
letters but no known n-gram gets the most frequent language with score 0; with no labelled text
at all every text is ``und``. Repeated rows get equal results. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.arrays import U64, mixed, over_slices, signed
from codeweft.llm.common import crc32_of_id, discard, materialize, table

#: Bytes of text that are worked on at a time; their n-grams take about 100 times as much.
SLICE = 1 << 18
LENGTHS = (3, 4)
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
HASHES = 2
#: A language holds an n-gram that all its labelled texts together use so often for each 1000 of them.
LEAST_PER_1000 = 2
WORD_BITS = 64
#: A language holds an n-gram if it uses it at this share, at least, of the rate of the language that uses it most.
LEAST_SHARE = 0.1


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class NGrams:
    """Hashes of the n-grams of many texts at once."""

    def __init__(self) -> None:
        self.letter = _letters()
        self.factors = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of its text) of every n-gram."""
        lowered = [(t or "").lower() for t in texts]
        joined = "\n" + "\n".join(lowered) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum([1] + [len(t) + 1 for t in lowered])[:-1]
        codes = np.where(self.letter[codes], codes, 0)
        kept = np.ones(len(codes), dtype=bool)
        kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        where = np.flatnonzero(kept)
        codes = codes[where].astype(U64)
        blank = codes == 0
        out, rows = [], []
        for n in LENGTHS:
            if len(codes) < n:
                continue
            size = len(codes) - n + 1
            valid = ~blank[1 : 1 + size]
            for k in range(2, n - 1):
                valid &= ~blank[k : k + size]
            at = np.flatnonzero(valid)
            value = np.full(len(at), n, dtype=U64)
            for k in range(n):
                value += codes[at + k] * self.factors[k]
            out.append(mixed(value))
            rows.append(np.searchsorted(starts, where[at + 1], side="right") - 1)
        if not out:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(rows)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams >> U64(SLOT_BITS * k)) & U64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Model:
    """The filter, the languages by bit, and each bit's false-positive rate."""

    def __init__(self, languages: list[str], first: str, grams: Sequence[np.ndarray] = (), marks: Iterable[tuple[int, np.ndarray, np.ndarray]] = ()) -> None:
        """Of each language's ``grams``, or of ``marks``: words of languages, their slots and the bits of these."""
        self.languages, self.first = languages, first
        self.tables: list[np.ndarray] = []  # one for each word of WORD_BITS languages, in the least type that holds it
        self.false_rate = np.zeros(len(languages))
        for at in range(0, len(languages), WORD_BITS):
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages[at : at + WORD_BITS]) <= np.iinfo(k).bits)
            self.tables.append(np.zeros(SLOTS, dtype=kind))
        for bit, held in enumerate(grams):
            table = self.tables[bit // WORD_BITS]
            for slot in slots_of(held):
                table[slot] |= table.dtype.type(1 << bit % WORD_BITS)
        for word, slot, bits in marks:
            self.tables[word][slot] |= bits.astype(self.tables[word].dtype)
        for bit in range(len(languages)):
            table = self.tables[bit // WORD_BITS]
            self.false_rate[bit] = np.mean((table >> table.dtype.type(bit % WORD_BITS)) & table.dtype.type(1)) ** HASHES

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each word of languages, the mask of those that hold each n-gram."""
        slots, out = slots_of(grams), []
        for table in self.tables:
            mask = table[slots[0]]
            for slot in slots[1:]:
                mask &= table[slot]
            out.append(mask)
        return out

    def predict(self, ngrams: NGrams, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of the text's n-grams that the language holds."""
        grams, row = ngrams.of(texts)
        n = len(texts)
        masks = self.masks(grams)
        several = len(masks) > 1
        holders = sum(np.bitwise_count(m).astype(np.int64) for m in masks) if several else None
        looked = np.bincount(row, minlength=n)
        known = np.zeros((len(self.languages), n))
        alone = np.zeros_like(known)
        for b, p in enumerate(self.false_rate):
            mask, kind = masks[b // WORD_BITS], masks[b // WORD_BITS].dtype.type
            own = kind(1 << b % WORD_BITS)
            held = (mask & own) != 0
            hits = np.bincount(row[held], minlength=n)
            known[b] = np.maximum(0.0, (hits - looked * p) / max(1e-9, 1 - p))
            alone[b] = np.bincount(row[held & (holders == 1) if several else mask == own], minlength=n)
        rank = known + alone / (1.0 + 2 * looked)  # under one half: decides ties of whole hits only
        best = rank.argmax(axis=0)
        most = known[best, np.arange(n)]
        total = known.sum(axis=0)
        score = np.where(total > 0, most / np.where(total > 0, total, 1), 0.0)
        held = most / np.maximum(1, looked)
        names = [self.languages[b] if m > 0 else self.first for b, m in zip(best, most, strict=True)]
        return names, np.clip(score, 0, 1), np.clip(held, 0, 1)


#: An n-gram seen once counts in a language of fewer labelled texts than this; more texts repeat what matters.
FEW_TEXTS = 10
#: Shares of n-grams are taken of so many at least, so that a few texts outweigh no large language.
LEAST_GRAMS = 20_000


def fit(labelled: DataFrame) -> Model | None:
    """Learn from every row of labelled(_text, _lang); None if there is no labelled text."""
    labelled = labelled.where("_lang IS NOT NULL AND _text IS NOT NULL")
    found = labelled.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").collect()  # one row for each language
    if not found:
        return None
    languages = sorted(r["_lang"] for r in found)
    texts = {r["_lang"]: r["n"] for r in found}
    bit = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    least = F.array(*[F.lit(1 if texts[k] < FEW_TEXTS else max(2, -(-LEAST_PER_1000 * texts[k] // 1000))).cast("long") for k in languages])

    def make():
        ngrams = NGrams()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams, row = ngrams.of(batch.column("_text").to_pylist())
            bits = np.asarray(batch.column("bit").to_pylist(), dtype=np.int64)[row]
            parts = []
            for b in np.unique(bits):
                own, counts = np.unique(grams[bits == b], return_counts=True)
                parts.append((np.full(len(own), b, np.int32), signed(own), counts.astype(np.int64)))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bit", "gram", "n"])

        return work

    counted = labelled.select(bit[F.col("_lang")].alias("bit"), "_text").mapInArrow(over_slices("_text", make, SLICE), "bit int, gram long, n long")
    counted = counted.groupBy("bit", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("n") >= F.get(least, F.col("bit"))), "ngrams")
    sums = {r["bit"]: r["n"] for r in counted.groupBy("bit").agg(F.sum("n").alias("n")).collect()}  # one row for each language
    total = F.array(*[F.lit(max(LEAST_GRAMS, sums.get(i, 0))).cast("long") for i in range(len(languages))])
    rated = counted.select("bit", "gram", (F.col("n") / F.get(total, F.col("bit"))).alias("rate"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    held = rated.withColumn("most", most).where(F.col("rate") >= LEAST_SHARE * F.col("most"))
    slots = [F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for k in range(HASHES)]
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % WORD_BITS)
    marks = held.select(F.floor(F.col("bit") / WORD_BITS).cast("int").alias("word"), own.alias("bits"), F.explode(F.array(*slots)).alias("slot"))
    # At most ``SLOTS`` rows for each word of languages, whatever the input.
    got = marks.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    discard(labelled.sparkSession, counted)
    word, slot, bits = (got.column(c).to_numpy() for c in ("word", "slot", "bits"))
    return Model(languages, found[0]["_lang"], marks=[(w, slot[word == w], bits[word == w].view(U64)) for w in np.unique(word).tolist()])


#: Shares of n-grams are rounded down to this part before they are counted, so that their number is bounded.
COVERAGE_PARTS = 100_000


def usual_coverage(labelled: DataFrame, model: Model, low: float = 0.01) -> dict[str, float]:
    """The coverage that all but a share ``low`` of each language's labelled texts with a letter reach."""
    chosen = labelled.where(F.col("_lang").isin(model.languages) & F.col("_text").isNotNull())
    found = identify(chosen, model, "_text", [F.col("_lang")]).where("lang_pred = _lang")
    part = F.floor(F.col("coverage") * COVERAGE_PARTS) / COVERAGE_PARTS
    counts = found.groupBy("_lang", part.alias("part")).agg(F.count("*").alias("n"))
    return {r["_lang"]: r["c"] for r in counts.groupBy("_lang").agg(F.percentile("part", F.lit(low), F.col("n")).alias("c")).collect()}


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[Column] | None = None, within: str | None = None) -> DataFrame:
    """``keep`` columns of each row, then ``lang_pred, score, coverage``.

    ``within`` names the column of ``keep`` that is a struct of whole rows: the text is read there and sent to Python once.
    """
    keep = keep if keep is not None else [F.col("doc_id")]
    text = F.col(f"`{text_col}`")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    rows = docs.select(F.struct(*keep).alias("_keep"), *([] if within else [text.alias("_text")]), letters)
    schema = T.StructType([rows.schema.fields[0]] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = rows.schema["_keep"].dataType[within].dataType.names if within else []
    at = min(range(len(names)), key=lambda i: (names[i] != text_col, names[i].lower() != text_col.lower()), default=0)

    def texts(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(0).field(within).field(at) if within else batch.column("_text")

    def make():
        ngrams = NGrams()
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            if own is None:
                lang, score, held = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            else:
                lang, score, held = own.predict(ngrams, texts(batch).to_pylist())
                lang = [x if ok else "und" for x, ok in zip(lang, letters, strict=True)]
                score, held = np.where(letters, score, 0.0), np.where(letters, held, 0.0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(held)], schema.names)

        return work

    return rows.mapInArrow(over_slices(texts, make, SLICE), schema).select("_keep.*", "lang_pred", "score", "coverage")


def op1_language_bitmask(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out).select(F.col("text").alias("_text"), F.col("lang").alias("_lang")))
    return identify(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])
