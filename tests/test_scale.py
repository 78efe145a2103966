"""What queries leave undone at any size: each builds no more of the graph than it asks for."""

import random

import pytest
from pyspark.sql import functions as F

import codeweft.plans.code_queries as code
import codeweft.plans.queries as plans
from codeweft.operators import javagraph, reports, spans, traversal, wholegraph
from codeweft.plans import tabletree
from codeweft.sources import java, sqltext
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"
STATEMENTS, CALLS, RESOLVE = (sqltext, "statements"), (javagraph, "call_edges"), (javagraph, "resolve_types")
NODES, JAVA_NODES = (wholegraph, "merge_nodes"), (javagraph, "merge_nodes")
KHOP = (reports, "khop")
#: By query: what it has no need of.
SPARED = {
    "change_impact": [RESOLVE, CALLS, STATEMENTS],
    "code_entrypoints": [STATEMENTS],
    "scan_statistics": [CALLS],
    "type_implementations": [CALLS, STATEMENTS],
    "uncovered_methods": [STATEMENTS],
    "impact_summary": [STATEMENTS, KHOP],
    "diff_impact": [KHOP],
    "method_overrides": [CALLS, STATEMENTS],
    "package_rollup": [RESOLVE, CALLS, STATEMENTS],
    "exception_pages": [CALLS, STATEMENTS],
    "java_calls": [STATEMENTS, NODES],
    "java_graph": [JAVA_NODES],
}


@pytest.mark.parametrize("name", SPARED)
def test_only_what_is_asked_for(spark, name, monkeypatch):
    monkeypatch.setattr(tabletree, "_KEPT", {})
    for module, function in SPARED[name]:
        monkeypatch.setattr(module, function, lambda *_, **__: pytest.fail("not needed"))
    assert rows(code.QUERIES[name](spark, SF).toPandas()) == rows(oracle(SF, code.ORACLES[name]))


def test_keys_that_no_double_holds(spark, tmp_path):
    """Halves of keys beyond 2^53 are exact, so classes find those that they call or extend."""
    odd = 2**53 + 1
    keys = [odd, odd // 2, 2 * odd + 1, 2 * odd]
    spark.createDataFrame([(k, 5 if i % 2 else 4) for i, k in enumerate(keys)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    part = spark.read.parquet(str(tmp_path / "part.parquet")).toPandas()
    for name in ("table_code_edges", "package_rollup", "type_implementations"):
        assert rows(code.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(oracle(SF, code.ORACLES[name], part=part))


def test_parts_are_dealt(spark):
    """One split of narrow rows stands for very much text."""
    cores = spark.sparkContext.defaultParallelism
    assert tabletree.parts(spark, SF).rdd.getNumPartitions() >= cores


def test_supertypes_double_their_reach(spark, monkeypatch):
    """A chain of 40 types over a ring of three: every pair at its least depth, in few rounds."""
    texts = [f"package p;\n\npublic class T{i} extends T{i - 1 if i else 2} {{\n}}\n" for i in range(40)]
    sources = spark.createDataFrame([(f"T{i}.java", bytearray(t, "utf-8")) for i, t in enumerate(texts)], "relative_path string, content binary")
    written = []
    keep = javagraph.materialize
    monkeypatch.setattr(javagraph, "materialize", lambda df, name: written.append(name) or keep(df, name))
    got = {(r["fqn"], r["super"]): r["depth"] for r in javagraph.JavaTables(java.parse_files(sources)).supertypes.collect()}
    want = {}
    for i in range(40):
        at = i
        for depth in range(1, 45):
            at = at - 1 if at else 2
            want.setdefault((f"p.T{i}", f"p.T{at}"), depth)
    assert got == want
    assert written.count("supers") <= 8


@pytest.mark.parametrize("chunk", [4, 50, 1 << 16])
def test_overlaps_are_counted_without_pairs(spark, chunk, monkeypatch):
    """Many spans and ranges with the same lines, files that are cut and files that are not; ranges without ends."""
    rng = random.Random(chunk)
    own = [(rng.randrange(1000) * 100 + i, rng.choice(["x", "x", "y"]), lo := rng.randrange(40), lo + rng.choice([0, 1, 5, 50])) for i in range(90)] + [(7, "x", 9, 3), (8, None, 1, 9)]
    ranges = [(i, rng.choice(["x", "y", "z"]), lo := rng.randrange(60), lo + rng.choice([0, 3, 30])) for i in range(90)] + [(990, "y", None, None), (991, None, 1, 2), (992, "x", 5, 2)]
    monkeypatch.setattr(spans, "overlapping_spans", lambda *_: pytest.fail("pairs"))
    frame = lambda what, of: spark.createDataFrame(of, f"{what}_id long, file string, lo int, hi int").repartition(3)
    got = {r["range_id"]: (r["spans"], r["first_span"]) for r in spans.overlap_counts(frame("range", ranges), frame("span", own), chunk).collect()}
    met = {r: [s for s, g, lo, hi in own if f and f == g and (a is None or a <= b and lo <= hi and a <= hi and lo <= b)] for r, f, a, b in ranges}
    assert got == {r: (len(x), min(x)) for r, x in met.items() if x and r != 990} | {990: (len([x for x in own if x[1] == "y"]), min(x[0] for x in own if x[1] == "y"))}
    if chunk == 4:
        assert rows(plans.hunk_overlap(spark, SF).toPandas()) == rows(oracle(SF, plans.ORACLES["hunk_overlap"]))


def test_counts_of_walks_make_no_pairs(spark, monkeypatch):
    """More seeds than bits in a word, and few; cycles; only the counts of pairs are made, and the last step is not written."""
    rng = random.Random(8)
    pairs = sorted({(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(150)})
    edges = spark.createDataFrame([("CALLS", a, b) for a, b in pairs], "type string, src string, dst string").repartition(3)
    for n in (90, 5):
        seeds = spark.createDataFrame([(f"n{i}",) for i in range(n)] + [("none",)], "id string")
        want = {(r["seed"], r["depth"]): r["n"] for r in traversal.khop(edges, seeds, 3).groupBy("seed", "depth").agg(F.count("*").alias("n")).collect()}
        written = []
        keep = traversal.materialize
        with monkeypatch.context() as m:
            m.setattr(traversal, "materialize", lambda df, name: written.append(name) or keep(df, name))
            got = {(r["seed"], r["depth"]): r["reached"] for r in traversal.khop_counts(edges, seeds, 3).collect()}
        assert got == want and written.count("hop") == 2
    monkeypatch.setattr(traversal, "khop", lambda *_, **__: pytest.fail("pairs"))
    assert rows(plans.transitive_callers(spark, SF).toPandas()) == rows(oracle(SF, plans.ORACLES["transitive_callers"]))
