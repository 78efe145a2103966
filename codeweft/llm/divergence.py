"""Source divergence audit: how far the words of each source of a language are from those of every other.

Every language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. A group (language and source) gives each
kept term the rate p = 1 + floor(SCALE * (count + 1) / (N + V)), where N is its count of kept terms and V their number; the
divergence of p from a rate q is floor((p - q)**2 / q), summed over the kept terms for a pair of sources.

The pairs come from Gustavson's row accumulation. The kept terms of a language are dealt to cells by hash; a cell holds the
term-major index of its terms, and each group scatters its own terms through that index into a dense accumulator with one
place for every peer. No pair of postings is ever emitted. Sums over absent terms are corrected: with a hat for the rate of
a count of zero,

    sum f(p, q) = sum over shared terms of [f(p, q) - f(p, q^) - f(p^, q) + f(p^, q^)]
                + sum over own terms of [f(p, q^) - f(p^, q^)] + sum over peer's terms of [f(p^, q) - f(p^, q^)] + V f(p^, q^)

where the second and third sums need only how often each count occurs, not the terms. All numbers are integers.

Scale: terms are counted per slice of text and combined before every shuffle; a cell holds about ``CELL`` entries, or as
many as it emits sums, whatever share of the rows one source has; only sums and ranks are grouped by source.

Defined results: a null text has no terms; null languages and sources count as ''; a language without kept terms still
gives each pair of its sources, with value 0; a language of one source gives no pairs; repeated rows count each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.arrays import slices, text_bytes
from codeweft.llm.bytewords import ByteWords, byte_class
from codeweft.llm.common import materialize, table
from codeweft.llm.piecetable import spread

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Entries of a cell at least (or as many as pairs of sources), and at most.
CELL, LARGEST_CELL = 1 << 15, 1 << 22
#: Bytes of text whose terms are counted together before they leave a task.
SLICE = 8 << 20
#: Postings that one step of a scatter holds.
STEP = 1 << 18
#: Bytes of terms: letters, and all of code points beyond ASCII.
TERM_BYTES = byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])


def _count_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", SLICE):
            data, offsets = text_bytes(part.column("_text"))
            words = ByteWords(data, offsets, TERM_BYTES)
            if not len(words.start):
                continue
            lang, source = part.column("_lang").dictionary_encode(), part.column("_source").dictionary_encode()
            of_row = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            several = len(words.words)
            in_row, times = np.unique(words.row * several + words.code, return_counts=True)
            key = of_row[in_row // several] * several + in_row % several
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group, term = key[first] // several, key[first] % several
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    source.dictionary.take(pa.array(group % len(source.dictionary))),
                    words.words.take(pa.array(term)).cast(pa.string()),
                    pa.array(np.add.reduceat(times[order], first)),
                    pa.array(np.diff(np.r_[first, len(key)]).astype(np.int64)),
                ],
                ["lang", "source", "term", "c", "d"],
            )


def kept_counts(rows: DataFrame) -> DataFrame:
    """``lang, source, term, c, total`` of the kept terms; ``lead`` marks one row of each language's term."""
    counts = rows.mapInArrow(_count_slices, "lang string, source string, term string, c long, d long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    whole = Window.partitionBy("lang", "term")
    over = {"docs": F.sum("d").over(whole), "total": F.sum("c").over(whole), "lead": F.min("source").over(whole) == F.col("source")}
    return counts.withColumns(over).where(F.col("docs") >= LEAST_DOCS).select("lang", "source", "term", "c", "total", "lead")


def group_facts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per group: its number among the language's groups, N and V, the language's N, and how many cells it has."""
    own = entries.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("size"), F.count_if("lead").alias("leads"))
    groups = rows.select(F.col("_lang").alias("lang"), F.col("_source").alias("source")).distinct()
    whole = Window.partitionBy("lang")
    filled = groups.join(own, ["lang", "source"], "left").fillna(0, ["n", "size", "leads"])
    most = F.least(F.lit(LARGEST_CELL), F.greatest(F.lit(CELL), F.count("*").over(whole) * F.count("*").over(whole)))
    return filled.select(
        "lang",
        "source",
        (F.row_number().over(whole.orderBy("source")) - 1).alias("sid"),
        "n",
        F.sum("leads").over(whole).alias("v"),
        F.sum("n").over(whole).alias("lang_n"),
        F.greatest(F.lit(1), F.ceil(F.sum("size").over(whole) / most)).cast("int").alias("cells"),
    )


def scaled(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), exactly, by long division in steps of three digits (whole < 2**53)."""
    out, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(sid: np.ndarray, code: np.ndarray, count: np.ndarray, terms: int, n: np.ndarray, v: int) -> Iterator[np.ndarray]:
    """For each group in turn, the sums of divergences from every group over ``terms`` terms.

    ``sid, code, count`` are the entries in order of term; ``n`` holds the N of all groups, ``v`` the language's V.
    """
    if not terms:
        yield from np.zeros((len(n), len(n)), dtype=np.int64)
        return
    begins = np.searchsorted(code, np.arange(terms + 1))
    rate = scaled(count, n[sid] + v)
    zero = scaled(np.zeros_like(n), n + v)
    own = np.argsort(sid, kind="stable")
    bounds = np.searchsorted(sid[own], np.arange(len(n) + 1))
    # How often each count occurs in each group: all that the corrections need.
    pairs, times = np.unique(np.stack([sid, rate]), axis=1, return_counts=True)
    of_group = np.searchsorted(pairs[0], np.arange(len(n) + 1))
    for g in range(len(n)):
        none = divergence(zero[g], zero)
        acc = terms * none
        for i in range(of_group[g], of_group[g + 1]):
            acc += times[i] * (divergence(pairs[1, i], zero) - none)
        np.add.at(acc, pairs[0], times * (divergence(zero[g], pairs[1]) - none[pairs[0]]))
        mine = own[bounds[g] : bounds[g + 1]]
        size = begins[code[mine] + 1] - begins[code[mine]]
        cuts = np.searchsorted(np.cumsum(size), np.arange(STEP, size.sum() + STEP, STEP))
        for part in np.split(mine, np.unique(cuts)):
            first = begins[code[part]]
            each = begins[code[part] + 1] - first
            peer = spread(first, each)
            p, q, h = np.repeat(rate[part], each), rate[peer], sid[peer]
            np.add.at(acc, h, divergence(p, q) - divergence(p, zero[h]) - divergence(zero[g], q) + none[h])
        yield acc


def _cell(key: tuple, cell: pa.Table) -> pa.Table:
    """Sums of one cell: rows without a term are the groups, the others are entries."""
    groups = cell.filter(pa.compute.is_null(cell.column("term"))).sort_by("sid")
    entries = cell.filter(pa.compute.is_valid(cell.column("term")))
    coded = entries.column("term").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(code, kind="stable")
    sid, count = entries.column("sid").to_numpy()[order].astype(np.int64), entries.column("c").to_numpy()[order]
    n, v = groups.column("c").to_numpy(), groups.column("v").to_numpy()
    several = len(n)
    sums = list(accumulate(sid, code[order], count, len(coded.dictionary), n, int(v[0])))
    a, b = np.divmod(np.arange(several * several, dtype=np.int32), np.int32(several))
    apart = a != b
    lang = pa.array([key[0].as_py()]).take(pa.array(np.zeros(int(apart.sum()), np.int8)))
    return pa.table([lang, pa.array(a[apart]), pa.array(b[apart]), pa.array(np.concatenate(sums)[apart])], ["lang", "sid", "peer", "value"])


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language, part ``term`` the
    ``top`` terms that the source has more of than its language."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "_text"), (lang_col, "_lang"), (source_col, "_source"))]
    rows = docs.select(*filled)
    entries = materialize(kept_counts(rows), "divergence-entries")
    facts = materialize(group_facts(rows, entries), "divergence-groups")
    joined = entries.join(facts, ["lang", "source"])

    cells = joined.select("lang", F.pmod(F.xxhash64("term"), "cells").cast("int").alias("cell"), "sid", "term", "c", "v")
    every = facts.select("lang", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "sid", F.lit(None).cast("string").alias("term"), F.col("n").alias("c"), "v")
    sums = cells.unionByName(every).groupBy("lang", "cell").applyInArrow(_cell, "lang string, sid int, peer int, value long")
    sums = sums.groupBy("lang", "sid", "peer").agg(F.sum("value").alias("value"))
    names = facts.select("lang", "sid", "source")
    pairs = sums.join(names, ["lang", "sid"]).join(names.select("lang", F.col("sid").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])

    def rate(count: F.Column, whole: F.Column) -> F.Column:
        exact = count.cast("decimal(18,0)") + F.lit(1).cast("decimal(18,0)")
        return F.call_function("div", exact * F.lit(SCALE).cast("decimal(10,0)"), (whole + F.col("v")).cast("decimal(18,0)")) + 1

    p, q = F.col("p"), F.col("q")
    rated = joined.select("lang", "source", F.col("term").alias("item"), rate(F.col("c"), F.col("n")).alias("p"), rate(F.col("total"), F.col("lang_n")).alias("q"))
    terms = rated.where(p > q).select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))

    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": ranks}).select(columns)
    return pairs.unionByName(terms.withColumns({"part": F.lit("term"), "rank": ranks}).where(F.col("rank") <= top).select(columns))


def op11_row_accumulation(spark, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
n AS (
  SELECT lang, source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.n), 0) AS lang_n, coalesce(sum(c), 0) AS n
  FROM g LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n.n + n.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (n.lang_n + n.v)::HUGEINT AS q
  FROM n JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
