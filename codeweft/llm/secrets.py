"""Secret scans over an incremental blob ledger.

Every historical version of a text is a blob, addressed by its SHA-256. The ledger holds one row
per scanned (blob, rule, rule version) with the findings. A scan takes each distinct blob that the
ledger lacks for some rule at its present version, runs just those rules, appends the findings and
joins them back to all paths (rows) that hold the blob. Copies, however many, are scanned once.

Positions come without Python: splitting a text at a rule's matches and listing the matches gives
alternating pieces whose running lengths, summed by a window over narrow rows, are the code-point offsets.

Defined results: a null text is an empty text and has no findings; repeated rows each get their
blob's findings; empty tables give no rows; extra columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import bit_table, discard, marked, materialize, narrowed, table, table_words


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the least length that makes a finding."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones can be passed over at once
)

FINDINGS = "array<struct<start:int,end:int>>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
CUTS = "array<struct<gap:int,len:int,counted:int>>"


def cuts(text: Column, rule: Rule) -> Column:
    """Array of (gap, len, counted) of the rule's matches: the code points before each, its own, and those that count."""
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pairs = F.zip_with(matches, counted, lambda m, c: F.struct(F.length(m).alias("len"), F.length(c).alias("counted")))
    lengths = F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        pairs,
        lambda gap, m: F.struct(F.length(gap).alias("gap"), m["len"].alias("len"), m["counted"].alias("counted")),
    )
    return F.when(F.size(pieces) > 1, lengths).otherwise(F.array().cast(CUTS))


def _found(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of scanned(blob, kind, version, cuts): lengths summed up to places, failing matches dropped.

    Sums run over narrow rows, one for each match, so the work grows with the number of matches of a text.
    """
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    key = ["blob", "kind", "version"]
    each = scanned.where(F.size("cuts") > 0).select(*key, F.posexplode("cuts").alias("n", "c"))
    before = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("c.gap") + F.col("c.len")).over(before).cast("int"))
    span = F.struct((F.col("end") - F.col("c.len")).alias("start"), F.col("end"))
    found = placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("c.counted") >= least[F.col("kind")], span))).alias("found"))
    none = scanned.where("size(cuts) = 0")
    return found.unionByName(none.select(*key, F.array().cast(FINDINGS).alias("found")))


def _scanned(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, cuts) of blobs(blob, body) for the rules that the ledger lacks, in one pass over the bodies."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), cuts(F.col("body"), r).alias("cuts")) for i, r in enumerate(rules)])
    if ledger is not None:
        done = [((F.col("kind") == r.kind) & (F.col("version") == r.version)) for r in rules]
        seen = ledger.groupBy("blob").agg(*[F.bool_or(d).alias(f"done{i}") for i, d in enumerate(done)])
        blobs = blobs.join(seen, "blob", "left")
        each = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"done{i}"), F.lit(False)), each[i]) for i in range(len(rules))]))
    return blobs.select("blob", F.inline(each)).select("blob", "kind", "version", "cuts")


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, found) for blobs(blob, body) and rules not in the ledger."""
    return _found(_scanned(blobs, ledger, rules), rules)


def _scan(texts: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """New ledger rows for texts(body), each distinct one scanned once.

    A first pass takes digests only. Those that several rows hold, or the ledger knows, are marked in a bit
    table: a text that is not marked is new and alone, and is scanned where it lies; only marked ones are shuffled.
    """
    spark = texts.sparkSession
    blob = F.sha2("body", 256)
    digests = texts.groupBy(blob.alias("blob")).agg(F.count("*").alias("n"))
    several = digests.where("n > 1").select("blob")
    if ledger is not None:
        several = several.unionByName(ledger.select("blob").distinct())
    marks = bit_table(several, F.xxhash64("blob"), "several", table_words(texts.count()))
    known = texts.select(blob.alias("blob"), "body").withColumn("_marked", marked(marks, F.xxhash64("blob")))
    alone = _scanned(known.where("NOT _marked").select("blob", "body"), None, rules)
    shared = known.where("_marked").groupBy("blob").agg(F.first("body").alias("body"))
    scanned = materialize(alone.unionByName(_scanned(shared, ledger, rules)), "scanned")
    out = materialize(_found(scanned, rules), "ledger")
    discard(spark, scanned)
    discard(spark, marks)
    return out


def scan_secrets(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): one row per input row with ``doc_id, blob, spans``, and all ledger rows.

    ``spans`` is an array of (start, end, rank, kind) sorted by start, then by the rules' order.
    """
    rows = narrowed(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    ledger_rows = _scan(rows.select(F.col("_text").alias("body")), ledger, rules)
    if ledger is not None:
        ledger_rows = ledger.unionByName(ledger_rows)
    paths = rows.select("_id", F.sha2("_text", 256).alias("blob"))
    findings = paths.join(current_spans(ledger_rows, rules), "blob", "left")
    return findings.select(F.col("_id").alias("doc_id"), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), ledger_rows


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, rank, kind, found`` of the rules at their present versions."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return ledger.where(now & (F.size("found") > 0)).select("blob", rank[F.col("kind")].alias("rank"), "kind", "found")


def current_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` for the blobs in which the rules, at their present versions, found something."""
    span = lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))
    return _current(ledger, rules).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(F.transform("found", span)))).alias("spans"))


def _runs(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, runs``: overlapping spans joined, each run (prev, start, end, kind) with the end of the run before."""
    each = _current(ledger, rules).select("blob", "rank", "kind", F.inline("found"))
    order = Window.partitionBy("blob").orderBy("start", "rank", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    headed = each.withColumn("head", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    number = F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = headed.withColumn("run", number).groupBy("blob", "run").agg(F.min(F.struct("start", "rank", "end", "kind")).alias("h"), F.max("end").alias("end"))
    prev = F.lag("end", 1, 0).over(Window.partitionBy("blob").orderBy("run"))
    runs = runs.select("blob", prev.alias("prev"), F.col("h.start").alias("start"), "end", F.col("h.kind").alias("kind"))
    return runs.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("prev", "start", "end", "kind"))).alias("runs"))


def redact(text: Column, runs: Column) -> Column:
    """The text with each run replaced by a mark of its kind.

    Pieces are cut from the text in four bytes a code point, where a place is found without counting.
    """

    def joined(wide: Column) -> Column:
        part = lambda a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")
        pieces = F.transform(runs, lambda r: F.concat(part(r["prev"], r["start"] - r["prev"]), F.lit("[secret:"), r["kind"], F.lit("]")))
        last = F.element_at(runs, -1)["end"]
        return F.concat(F.array_join(pieces, ""), part(last, F.floor(F.octet_length(wide) / 4).cast("int") - last))

    return F.when(F.size(runs) == 0, text).otherwise(F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), joined), 1))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows with every finding replaced by a mark of its kind; all columns stay, null texts too."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    runs = _runs(_scan(rows.select(F.col("_text").alias("body")), None, rules), rules)
    # Texts without findings stay where they are; the bit table sends the others to their runs.
    runs = materialize(runs, "runs")
    marks = bit_table(runs, F.xxhash64("blob"), "found", table_words(docs.count()))
    known = rows.withColumn("blob", F.sha2("_text", 256)).withColumn("_marked", marked(marks, F.xxhash64("blob")))
    clean = known.where("NOT _marked").select("_row")
    found = known.where("_marked").join(runs, "blob", "left")
    text = F.when(F.col("runs").isNull(), F.col(f"_row.`{text_col}`")).otherwise(redact(F.col("_text"), F.col("runs")))
    return clean.unionByName(found.select(F.col("_row").withField(f"`{text_col}`", text).alias("_row"))).select("_row.*")


def op3_secret_ledger(spark, sf_dir: str) -> DataFrame:
    findings, _ = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return findings.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _sql_rule(i: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind,
  list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s,
  length(found[i]) AS n, length(counted[i]) AS c
FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}', 0) AS found,
  regexp_extract_all(t, '{pattern}', {rule.group}) AS counted FROM d), range(1, len(found) + 1) r(i)
WHERE length(counted[i]) >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
