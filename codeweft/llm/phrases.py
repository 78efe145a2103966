"""Phrase collocation mining by Toivonen's method: a sample proposes, full passes count, border failures expand.

Texts are lower-cased (A-Z) and split at punctuation into pieces and these into words; a phrase is 1 to ``LONGEST`` words in a
row within a piece. Phrases are counted for each language.

1. One document in ``SAMPLE`` is mined level by level at a lowered threshold. What it finds, closed under shortening, is
   proposed.
2. A full pass counts every proposed phrase and the negative border: every other phrase that occurs and whose parts (all words
   but the last, all but the first) are proposed; every word is in the border.
3. Border phrases that reach the threshold are failures of the sample. A further pass counts whatever can follow from all
   that is known to be frequent then: pairs of such words and longer phrases of such pairs, as far as they were not
   counted. If new pairs turn up, another one follows; otherwise nothing is left that could be frequent.

The proposed sets grow with the corpus, so they are not sent out: tasks get bit tables of at most 4 MB, which
mark every proposed phrase and by chance some others. A fuller table only counts more phrases; what is missing from a table is
surely not proposed, so nothing is lost at any size. These passes count by 64-bit codes of language and phrase, which only
ever add up too much. When the border is closed, a last pass counts the phrases whose codes reached the threshold as strings.
So every result is exact.

A candidate of at least ``LEAST`` occurrences is scored at its weakest cut, score = floor(1000 a n / (l r)), and dropped where
a longer phrase holds it just as often. (The phrases between the two are then as frequent, so one word more is enough to
look at.)

Scale: no row per position leaves a task; slices of text are counted in arrays. Parts and
longer phrases are found by joins on equal phrases, whose hot keys adaptive execution splits.

Defined results: a null text has no words; a null language is ``und``; repeated rows count each; equal scores and counts are
ordered by phrase; an empty table gives no rows; extra columns are ignored. The sample decides which pass counts a phrase,
never a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.arrays import U64, mixed, signed, slices, span_hashes, text_bytes
from codeweft.llm.bytewords import ByteWords, byte_class
from codeweft.llm.common import bit_table, discard, materialize, table, table_words

LEAST = 100
LONGEST = 5
TOP = 2000
SAMPLE = 8
NO_LANGUAGE = "und"
#: Bytes of text whose phrases are counted together before they leave a task.
SLICE = 1 << 20
#: Signs that end a piece; blanks and tabs only part words.
ENDS = byte_class([ord(c) for c in ".,;:!?"] + [10, 11, 12, 13])
WORD_BYTES = ~(ENDS | byte_class([9, 32]))
FACTORS = [U64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(LONGEST)]
SPELLED = "lang string, size int, phrase string, c long"


def lowered(least: int, part: int) -> int:
    """The threshold in a sample of one in ``part``: two deviations below what a phrase at the threshold has there."""
    usual = least / part
    return max(1, math.ceil(usual - 2 * math.sqrt(usual)))


class Phrases:
    """Phrases of one slice: words, their pieces, and the codes of all phrases by length."""

    def __init__(self, part: pa.RecordBatch) -> None:
        data, offsets = text_bytes(part.column("_text"))
        words = ByteWords(data, offsets, WORD_BYTES)
        self.words, self.word = words.words, words.code
        ended = np.cumsum(ENDS[data])
        #: Differs between words of different pieces or texts.
        self.piece = (ended[words.start] if len(data) else words.start) + words.row
        lang = part.column("_lang").dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[words.row]
        self.salt = self._hashes(self.langs)[self.lang]
        self.hash = self._hashes(self.words)[self.word]

    @staticmethod
    def _hashes(names: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(names)
        return span_hashes(data, offsets[:-1], offsets[1:])

    def codes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, codes of the phrases that begin at each word, whether there is one), from single words on.

        The three lowest bits of a code are the size.
        """
        rolled = np.zeros(len(self.hash), U64)
        for k in range(LONGEST):
            n = max(0, len(self.hash) - k)
            rolled = rolled[:n] + self.hash[k:] * FACTORS[k]
            code = mixed(rolled ^ mixed(self.salt[:n] + U64(k + 1)))
            yield k + 1, code & ~U64(7) | U64(k + 1), self.piece[:n] == self.piece[k:]

    def tallied(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct code, how often it occurs) among the phrases that begin at ``at``."""
        coded = pa.array(signed(code[at])).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        times = np.bincount(coded)
        place = np.zeros(len(times), dtype=np.int64)
        place[coded[::-1]] = at[::-1]
        return place, times

    def exactly(self, code: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``tallied``, by the words themselves: codes shared by different phrases are told apart."""
        if not len(at):
            return at, at
        coded = pa.array(signed(code[at])).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place, times = self.tallied(code, at)
        same = self.lang[at] == self.lang[place[coded]]
        for k in range(size):
            same &= self.word[at + k] == self.word[place[coded] + k]
        if same.all():
            return place, times
        keys = np.stack([self.lang[at], *[self.word[at + k] for k in range(size)]], axis=1)
        _, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
        return at[first], times

    def spelled(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.word[at + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]).cast(pa.string())

    def counted(self, code: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """(code, c) of the phrases that begin at ``at``."""
        place, times = self.tallied(code, at)
        return pa.RecordBatch.from_arrays([pa.array(signed(code[place])), pa.array(times.astype(np.int64))], ["code", "c"])

    def rows(self, at: np.ndarray, size: int, times: np.ndarray) -> pa.RecordBatch:
        """(lang, size, phrase, c); of size 0, the words of a language."""
        names = self.spelled(at, size) if size else pa.nulls(len(at), pa.string())
        columns = [self.langs.take(pa.array(self.lang[at])), pa.array(np.full(len(at), size, np.int32)), names, pa.array(times.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "c"])


class Marks:
    """A bit table in a task."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.view(U64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        word = (code >> U64(6)).astype(np.int64) % len(self.bits)
        return (self.bits[word] >> (code & U64(63)) & U64(1)).astype(bool)


def _marks(keys: DataFrame) -> np.ndarray:
    """The bit table of the codes in ``keys``, at most 4 MB."""
    made = bit_table(keys, F.col("code"), "phrase-marks", table_words(keys.count()))
    bits = np.array(made.head()["m"], dtype=np.int64)
    discard(keys.sparkSession, made)
    return bits


def parts_marked(shorter: np.ndarray) -> np.ndarray:
    """Whether both parts of each phrase are marked, by the marks of the phrases that are one word shorter."""
    return shorter[:-1] & shorter[1:]


def _sampled(bits) -> callable:
    """Counts by code: without marks all words and pairs, with marks what is longer and has only marked pairs."""

    def work(own: Phrases, marks: Marks | None) -> Iterator[pa.RecordBatch]:
        whole = None
        for size, code, inside in own.codes():
            if marks and size == 2:
                whole = marks(code) & inside
            if (size > 2) == bool(marks):
                if marks:
                    whole = parts_marked(whole)  # all pairs of the phrase
                    inside = inside & whole
                yield own.counted(code, np.flatnonzero(inside))

    return _over_texts(work, bits)


def _bordered(known: list) -> callable:
    """Counts by code of the last of some passes. ``known`` holds for each pass the marks of what it took as frequent.

    The first pass counts these and their border. Later ones count all that can follow from what is known, as far as no pass
    before did: pairs of frequent words, and longer phrases of frequent pairs alone, whatever lies between.
    """

    def work(own: Phrases, *marks: Marks) -> Iterator[pa.RecordBatch]:
        shorter: list[np.ndarray] = []
        whole: list[np.ndarray] = []
        for size, code, inside in own.codes():
            marked = [m(code) for m in marks]
            if size == 1:
                wanted = inside if len(marks) == 1 else np.zeros_like(inside)  # the first pass counts all words
            else:
                if size > 2:
                    whole = [parts_marked(w) for w in whole]
                due = [m | (parts_marked(shorter[j]) if j == 0 or size == 2 else whole[j]) for j, m in enumerate(marked)]
                wanted = inside & due[-1]
                for done in due[:-1]:
                    wanted &= ~done
                if size == 2:
                    whole = [m & inside for m in marked]
            yield own.counted(code, np.flatnonzero(wanted))
            shorter = marked

    return _over_texts(work, *known)


def _spelled(bits) -> callable:
    """Counts of the marked phrases by their words, and of all words of a language."""

    def work(own: Phrases, marks: Marks) -> Iterator[pa.RecordBatch]:
        times = np.bincount(own.lang)
        first = np.zeros(len(times), np.int64)
        first[own.lang[::-1]] = np.arange(len(own.lang))[::-1]
        held = np.flatnonzero(times)
        yield own.rows(first[held], 0, times[held])
        for size, code, inside in own.codes():
            place, times = own.exactly(code, np.flatnonzero(inside & marks(code)), size)
            yield own.rows(place, size, times)

    return _over_texts(work, bits)


def _over_texts(work, *bits) -> callable:
    """A function for mapInArrow that gives ``work`` the phrases of each slice, and bit tables (None for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [Marks(b.value) if b is not None else None for b in bits]
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                own = Phrases(part)
                if len(own.word):
                    yield from work(own, *marks)
                del own
            pa.default_memory_pool().release_unused()

    return run


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, part: int = SAMPLE) -> DataFrame:
    """``lang, size, phrase, c``: every phrase of at least ``least`` occurrences; rows of size 0 hold the words of a language."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("_lang")
    rows = docs.select(lang, F.col(f"`{text_col}`").alias("_text"), F.col(f"`{id_col}`").alias("_id"))
    texts = rows.select("_lang", "_text")
    chosen = rows.where(F.pmod(F.xxhash64("_id"), F.lit(part)) == 0).select("_lang", "_text")

    def reaching(of: DataFrame, how: callable, floor: int, name: str) -> DataFrame:
        """Codes that occur so often. Most codes of a slice are rare, so combining slices before the shuffle would save little:
        counts are dealt by code and added there; a code has a row for each slice at most."""
        found = of.mapInArrow(how, "code long, c long").repartition("code").groupBy("code").agg(F.sum("c").alias("c"))
        return materialize(found.where(F.col("c") >= floor).select("code"), name)

    def sent(codes: DataFrame):
        return spark.sparkContext.broadcast(_marks(codes))

    short = reaching(chosen, _sampled(None), lowered(least, part), "phrase-sample")
    proposed = short.unionByName(reaching(chosen, _sampled(sent(short)), lowered(least, part), "phrase-sample"))
    passes, frequent = [sent(proposed)], None
    while True:
        found = reaching(texts, _bordered(passes), least, "phrase-counts")
        frequent = found if frequent is None else frequent.unionByName(found)
        # Failures: frequent, but not taken as such so far. What was taken as frequent and is not does not matter. After the
        # first pass only pairs that were not known can lead to phrases that no pass has counted.
        failed = found.join(proposed, "code", "left_anti") if len(passes) == 1 else found.where(F.col("code").bitwiseAND(7) == 2)
        if failed.isEmpty():
            break
        passes.append(sent(frequent))
    counts = texts.mapInArrow(_spelled(sent(frequent)), SPELLED).groupBy("lang", "size", "phrase").agg(F.sum("c").alias("c"))
    return counts.where((F.col("c") >= least) | (F.col("size") == 0))


def collocations(frequent: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of :func:`frequent_phrases`."""
    phrases = frequent.where("size > 0").select("lang", "phrase", F.col("c").alias("a"), "size")
    totals = frequent.where("size = 0").select("lang", F.col("c").alias("n"))
    candidates = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))

    def joined(first, count) -> Column:
        return F.array_join(F.slice("words", first, count), " ")

    k = F.col("k")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("size") - k).alias("right"))
    counts = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")

    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(17,0)")

    score = F.call_function("div", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # One word more on either side: where such a phrase occurs as often, this one never stands alone.
    inner = F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1)))
    held = candidates.where("size > 2").select("lang", inner.alias("phrase"), "a").distinct()
    alone = best.join(held, ["lang", "phrase", "a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_toivonen_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(materialize(frequent_phrases(table(spark, sf_dir, "documents")), "phrases"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, phrase, count(*) AS a
  FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS size))
  GROUP BY lang, size, phrase HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cut AS (
  SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS x, array_to_string(words[k + 1:], ' ') AS y
  FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < size),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, k, l.a AS l, r.a AS r, n.n,
    ((1000::HUGEINT * cut.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = x JOIN f AS r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m) WHERE i + m - 1 <= size AND m < size),
o AS (
  SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.lang = b.lang AND held.phrase = b.phrase AND held.a >= b.a)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""
