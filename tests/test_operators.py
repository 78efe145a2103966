"""Small ground truths for operators whose rules the oracles do not reach."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.functions import text as X
from codeweft.functions.embedding import embed_text, features, hashing_embedding
from codeweft.operators import context, graph, indexes, resolution, retrieval, snapshot, topk, traversal
from codeweft.operators.ranking import placed
from codeweft.operators.spans import innermost_span, overlapping_spans
from codeweft.sources import build, git, sqltext
from codeweft.sources.config import flatten_yaml
from codeweft.sources.files import inventory, oversized, read_tree
from codeweft.sources.javaparser import parse
from codeweft.storage import materialize, spread


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(kind, a, b, "HIGH") for a, b in pairs], "type string, src string, dst string, confidence string")


def test_khop_is_true_breadth_first_and_meets_cycles(spark):
    # d is four steps from s on one way and two on another; the short one counts.
    e = edges(spark, [("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("s", "x"), ("x", "d"), ("d", "e"), ("e", "s")])
    got = {r["id"]: r["depth"] for r in traversal.khop(e, spark.createDataFrame([("s",)], "id string"), 4).collect()}
    assert got == {"a": 1, "x": 1, "b": 2, "d": 2, "c": 3, "e": 3, "s": 4}
    no_seed = traversal.khop(e, spark.createDataFrame([("s",)], "id string"), 4, with_seed=False)
    assert "s" not in {r["id"] for r in no_seed.collect()}


def test_khop_grows_with_depth(spark):
    e = edges(spark, [(str(i), str((i * 7 + k) % 40)) for i in range(40) for k in (1, 5)])
    seeds = spark.createDataFrame([("0",), ("3",)], "id string")
    sizes = [traversal.khop(e, seeds, k).count() for k in (1, 2, 3)]
    assert sizes == sorted(sizes)


def test_walks_of_many_lanes(spark):
    """More seeds than bits in a lane: each pair once, at its least depth, as a walk seed by seed finds it."""
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(150)}
    graph_ = edges(spark, sorted(pairs)).repartition(3)
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(90)] + [("none",)], "id string")
    for with_seed in (True, False):
        want = set()
        for i in range(90):
            front, seen = {f"n{i}"}, set() if with_seed else {f"n{i}"}
            for depth in range(1, 5):
                front = {b for a, b in pairs if a in front} - seen
                seen |= front
                want |= {(f"n{i}", x, depth) for x in front}
        got = [tuple(r) for r in traversal.khop(graph_, seeds, 4, with_seed=with_seed).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    some = seeds.limit(3)
    one = {r["id"]: r["depth"] for r in traversal.reachable(graph_, some, 4).collect()}
    all_ = {}
    for r in traversal.khop(graph_, some, 4).collect():
        all_[r["id"]] = min(r["depth"], all_.get(r["id"], 9))
    assert one == all_


def test_paths_that_arrive(spark):
    rng = random.Random(6)
    pairs = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(45)})
    want = []

    def walk(path):
        if len(path) > 1 and path[-1] in ("n3", "n7"):
            want.append(tuple(path))
        elif len(path) <= 5:
            for a, b in pairs:
                if a == path[-1] and b not in path:
                    walk([*path, b])

    for s in ("n0", "n1", "n3"):
        walk([s])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = [tuple(r["path"]) for r in traversal.simple_paths(edges(spark, pairs), ids("n0", "n1", "n3"), ids("n3", "n7"), 5).collect()]
    assert sorted(got) == sorted(want) and len(want) > 3
    assert traversal.simple_paths(edges(spark, pairs), ids("n0"), ids("no"), 5).count() == 0


def test_places_in_groups(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 101) for i in range(100)]
    got = sorted(map(tuple, placed(spark.createDataFrame(rows, "g string, v int").repartition(4), "g", ["v"]).select("g", "position", "v").collect()))
    assert got == [(g, i, v) for g in "ab" for i, v in enumerate(sorted(v for h, v in rows if h == g), 1)]


@pytest.mark.parametrize("chunk", [4, 50, 1 << 16])
def test_spans_by_sweep(spark, chunk):
    """Any spans, nested or not, in files that are cut and files that are not."""
    rng = random.Random(chunk)
    spans_ = [(f"s{i:03}", rng.choice(["x", "x", "y"]), lo := rng.randrange(60), lo + rng.choice([0, 1, 5, 70])) for i in range(60)] + [("odd", "x", 9, 3), ("none", None, 1, 9)]
    points = [(i, rng.choice(["x", "x", "y", "z"]), rng.randrange(140)) for i in range(80)] + [(999, None, 4), (998, "x", None)]
    ranges = [(i, f, line, line + i % 4) for i, f, line in points[:60]] + [(990, "y", None, None)]
    sp = spark.createDataFrame(spans_, "span_id string, file string, lo int, hi int").repartition(3)
    got = dict(map(tuple, innermost_span(spark.createDataFrame(points, "point_id long, file string, line int"), sp, chunk).collect()))
    want = {p: min(found)[1] for p, f, line in points if (found := [(hi - lo, s) for s, g, lo, hi in spans_ if f == g and f and line is not None and lo <= line <= hi])}
    assert got == want
    pairs = [tuple(r) for r in overlapping_spans(spark.createDataFrame(ranges, "range_id long, file string, lo int, hi int"), sp, chunk).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(r, s) for r, f, a, b in ranges for s, g, lo, hi in spans_ if f == g and f and (a is None or (lo <= hi and a <= hi and lo <= b))}


def test_call_flow_order(spark):
    e = edges(spark, [("method:m", "method:b"), ("method:m", "method:a"), ("method:a", "method:c"), ("method:b", "method:c"), ("method:b", "extmethod:z"), ("method:c", "method:m")])
    flow = traversal.call_flow(e, spark.createDataFrame([("method:m",)], "id string")).orderBy("position").collect()
    assert [(r["id"], r["depth"], r["parent"]) for r in flow] == [("method:a", 0, "method:m"), ("method:b", 0, "method:m"), ("method:c", 1, "method:a")]


def test_first_edge_and_node_merge(spark):
    raw = spark.createDataFrame([("CALLS", "a", "b", "LOW", 5), ("CALLS", "a", "b", "HIGH", 2)], "type string, src string, dst string, confidence string, line int")
    assert graph.first_edges(raw, F.col("line")).collect()[0]["confidence"] == "HIGH"
    nodes = spark.createDataFrame([("t", None, True, 1), ("t", "real", False, 2), ("t", "late", False, 3)], "id string, name string, placeholder boolean, ordinal int")
    assert graph.merge_nodes(nodes).collect()[0]["name"] == "real"


def test_resolve_types_cascade(spark):
    types = spark.createDataFrame([("a.b.Thing", "a.b"), ("c.Thing", "c"), ("c.Only", "c")], "fqn string, package string")
    imports = spark.createDataFrame([("f", "x.y.Thing", 0, False, False), ("f", "z", 1, True, False)], "file string, fqn string, ordinal int, wildcard boolean, static boolean")
    refs = spark.createDataFrame([(1, "f", "c", "Thing"), (2, "g", "c", "List<Thing>"), (3, "g", "c", "Thing[]"), (4, "g", "q", "Only"), (5, "g", "q", "String"), (6, "g", "q", "c.Only"), (7, "g", "q", "no.Where")], "ref_id int, file string, package string, raw string")
    got = {r["ref_id"]: (r["target"], r["confidence"]) for r in resolution.resolve_types(refs, types, imports).collect()}
    assert got == {1: ("x.y.Thing", "MEDIUM"), 2: ("List", "UNKNOWN"), 3: ("c.Thing", "HIGH"), 4: ("c.Only", "MEDIUM"), 5: ("java.lang.String", "MEDIUM"), 6: ("c.Only", "HIGH"), 7: ("no.Where", "MEDIUM")}


def test_hash_embedding(spark):
    assert features("Ab_c1 x")[:2] == ["ab_c1", "x"]
    v = embed_text("save the order order")
    assert math.isclose(float(np.linalg.norm(v)), 1.0) and not embed_text("").any()
    got = spark.createDataFrame([("save the order order",), (None,)], "t string").select(hashing_embedding(F.col("t")).alias("v")).collect()
    assert np.allclose(got[0]["v"], v) and not any(got[1]["v"])
    near, far = embed_text("save order") @ v, embed_text("delete user") @ v
    assert near > far


def test_fusion_counts_each_occurrence(spark):
    pool = lambda ids: spark.createDataFrame([(1, i, 1.0, k) for k, i in enumerate(ids)], "query_id int, id string, score double, rank int")
    got = {r["id"]: r["fused"] for r in retrieval.fuse({"symbol": pool(["a", "b", "a"]), "vector": pool(["b"])}).collect()}
    assert got["a"] == pytest.approx(1 / 10 + 0.3 + 1 / 12 + 0.3) and got["b"] == pytest.approx(1 / 11 + 0.3 + 1 / 10)
    kept = retrieval.no_rerank(retrieval.fuse({"symbol": pool(["a", "b"]), "vector": pool(["b"])})).orderBy("rank").collect()
    assert [r["id"] for r in kept] == ["b", "a"]


def test_incremental_vectors(spark):
    old = spark.createDataFrame([("x", [1.0])], "text string, vector array<double>").select(F.sha1("text").alias("text_hash"), "vector")
    chunks = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, text string")
    got = {r["id"]: r["reused"] for r in retrieval.incremental_vectors(chunks, old, lambda t: F.array(F.lit(0.0))).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_snapshot(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "relative_path string, sha256 string")
    b = spark.createDataFrame([("q", "2"), ("r", "x"), ("s", "4")], "relative_path string, sha256 string")
    got = {r["relative_path"]: r["change"] for r in snapshot.snapshot_diff(a, b).collect()}
    assert got == {"p": "added", "q": "unchanged", "r": "modified", "s": "deleted"}
    assert {r["change"] for r in snapshot.snapshot_diff(a, a).collect()} == {"unchanged"}
    assert snapshot.upsert_files(b, a).count() == 4 and snapshot.delete_files(a, b).count() == 1


def test_budget_cut(spark):
    s = spark.createDataFrame([("k", 1, "a" * 40), ("k", 2, "b" * 40), ("k", 3, "c" * 40)], "pack string, ordinal int, body string")
    got = context.budget_cut(s, 15).orderBy("ordinal").collect()
    assert [(len(r["body"]), r["cut"]) for r in got] == [(40, False), (20, True)]
    assert context.prompt_reserve(1000) == 400 and context.prompt_reserve(24_000) == 3000


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    assert one(X.bare_type(F.lit("Map<String, List<A>>[]"))) == "Map" and one(X.bare_type(F.lit("final Foo..."))) == "Foo"
    assert one(X.is_secret_key(F.lit("My.ApiKey"))) and not one(X.is_secret_key(F.lit("name")))
    assert one(X.is_secret_key(F.lit("PIN"), ["pin"]))
    assert one(X.starts_like_sql(F.lit("-- c\n select 1"))) and not one(X.starts_like_sql(F.lit("selection")))
    assert one(X.rerank_tokens(F.lit("get_user_Id x"))) == ["get_user_id", "x", "get", "user"]
    assert X.identifier_terms("a findAll xY the name") == ["findAll", "xY", "name"]
    assert one(X.numbered_snippet(F.lit("a\nb\nc"), F.lit(2), F.lit(3), 60)) == "    2  b\n    3  c"
    assert one(X.sql_identity(F.lit(" SELECT  1;"))) == one(X.sql_identity(F.lit("select 1")))


def test_sql_tables():
    t = sqltext.tables_of
    assert t("MERGE INTO a.t USING s ON 1=1 WHEN MATCHED THEN UPDATE SET x = 1")["tables_written"] == ["a.t"]
    assert t("MERGE INTO a.t USING s ON 1=1")["tables_read"] == ["s"]
    assert t("WITH c AS (SELECT * FROM x) SELECT * FROM c, d JOIN e ON 1=1") == {"statement_type": "SELECT", "tables_read": ["c", "d", "e", "x"], "tables_written": [], "parsed_ok": True}
    assert t("INSERT INTO t SELECT * FROM t")["tables_read"] == []
    assert t("TRUNCATE TABLE z")["tables_written"] == ["z"] and t("hello")["statement_type"] == "UNKNOWN"


def test_sql_scopes_dialects_and_fallback():
    t = lambda q: tuple(sqltext.tables_of(q).values())
    assert t("SELECT extract(year FROM ts), trim(both FROM z), substring(x FROM 2) FROM orders") == ("SELECT", ["orders"], [], True)
    assert t("SELECT 1 FROM a WHERE x IS NOT DISTINCT FROM y") == ("SELECT", ["a"], [], True)
    assert t("DELETE a FROM t a JOIN u b ON a.id = b.id") == ("DELETE", ["u"], ["t"], True)
    assert t("DELETE FROM s USING x, y WHERE s.a = x.a") == ("DELETE", ["x", "y"], ["s"], True)
    assert t("UPDATE a SET x = 1 FROM tt a JOIN q ON 1 = 1") == ("UPDATE", ["q"], ["tt"], True)
    assert t("WITH c AS (WITH d AS (SELECT * FROM x) SELECT * FROM d) SELECT * FROM c JOIN (SELECT 1 FROM u) z ON 1=1") == ("SELECT", ["c", "d", "u", "x"], [], True)
    assert t("WITH c AS (SELECT 1 FROM x) INSERT INTO t (a) SELECT * FROM c") == ("INSERT", ["c", "x"], ["t"], True)
    assert t("CREATE OR REPLACE VIEW v AS SELECT * FROM (a JOIN b ON 1=1) LEFT JOIN c USING (id)") == ("CREATE", ["a", "b", "c"], ["v"], True)
    assert t("SELECT * FROM generate_series(1, (SELECT max(i) FROM n)) g, x") == ("SELECT", ["n", "x"], [], True)
    # Quotes of four dialects, with texts that hold a FROM.
    assert t("""SELECT "from a" FROM "S"."T" -- FROM b""") == ("SELECT", ["s.t"], [], True)
    assert t("""SELECT 'it\\'s from a', "from b" FROM `db`.`t` # from c""") == ("SELECT", ["db.t"], [], True)
    assert t("SELECT $x$ from a $x$::text FROM t WHERE b[1] = E'\\' from c'") == ("SELECT", ["t"], [], True)
    assert t("SELECT [a from b] FROM [dbo].[t] WITH (NOLOCK) CROSS APPLY [dbo].f(1) z") == ("SELECT", ["dbo.t"], [], True)
    # What no dialect explains is read without grammar, and says so.
    assert t("SELECT (a FROM t JOIN u") == ("SELECT", ["t", "u"], [], False)
    assert t("INSERT INTO t SELECT 'open FROM u") == ("INSERT", ["u"], ["t"], False)
    assert t("DELETE FROM t WHERE ((a)") == ("DELETE", [], ["t"], False)
    assert t("SELECT * FROM weird `backtick`.tbl SAMPLE (10)")[3] is False and t("")[0] == "UNKNOWN"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("SELECT FROM JOIN ( ) , . ; ' \" ` [ ] -- /* */ WITH AS a b INSERT INTO UPDATE DELETE USING MERGE CREATE TABLE ON $$ # : ? \n".split(" ")), max_size=25))
def test_any_words_are_read(words):
    found = sqltext.tables_of(" ".join(words))
    assert set(found) == {"statement_type", "tables_read", "tables_written", "parsed_ok"}


def test_java_parser_is_tolerant():
    r = parse("A.java", "package p; class A { int x = ; void f() { g(h(1), \"a\"); } void broken( { } } class B { }")
    assert r["status"] == "partial" and {t["fqn"] for t in r["types"]} >= {"p.A"}
    r = parse("B.java", "class A<T> { static <R> List<R> of(R... xs) throws E1, E2 { return new ArrayList<>(1) { void in() { call(2); } }; } enum K { X, Y; K() { } } }")
    assert [m["fqn"] for m in r["methods"]] == ["A#of(R...)", "A.K#K()"]
    assert [(x["kind"], x["name"]) for x in r["refs"]] == [("call", "call"), ("create", "ArrayList")]
    assert r["methods"][0]["throws"] == ["E1", "E2"] and r["status"] == "success"
    assert parse("C.java", "")["types"] == []


def test_yaml_and_build(spark):
    assert flatten_yaml("a: [1, {b: 2}]\nc:") == [("a[0]", "1"), ("a[1].b", "2"), ("c", "")]
    assert flatten_yaml("a: [") == []
    pom = "<project><version>1</version><properties><v>7</v></properties><dependencies><dependency><groupId>org.scala-lang</groupId><artifactId>scala-library</artifactId><version>2.12.${x}</version></dependency><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>"
    files = spark.createDataFrame([("pom.xml", "<not xml"), ("m/pom.xml", pom), ("n/pom.xml", None)], "relative_path string, text string")
    got = {(r["file"], r["fact"], r["artifact"], r["value"]) for r in build.maven_facts(files).collect()}
    assert ("m/pom.xml", "version", "", "1") in got and ("m/pom.xml", "dependency", "a", "7") in got and {g[0] for g in got} == {"m/pom.xml"}
    info = build.build_info(build.build_facts(files.where("relative_path LIKE 'm/%'"))).first()
    assert info["build_system"] == "maven" and info["scala_version"] == "2.12"
    assert ("java_version", "", "", "21") in build.gradle_facts("# x\njavaVersion=21\n") and ("java_version", "", "", "17") in build.gradle_facts("java { toolchain { languageVersion = JavaLanguageVersion.of(17) } }")
    assert ("java_version", "", "", "1.8") in build.gradle_facts("sourceCompatibility = JavaVersion.VERSION_1_8 // note")
    facts = build.gradle_facts("plugins { id 'org.springframework.boot' version '3.1.0' }\nsourceCompatibility = '17'\ndependencies { implementation 'g:a:1.0'\n testImplementation(\"g:b\") }")
    assert ("spring_boot_version", "", "", "3.1.0") in facts and ("java_version", "", "", "17") in facts and ("dependency", "g", "b", "") in facts


def test_git_head(tmp_path):
    assert git.head(str(tmp_path)) == {"branch": None, "commit": None}
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "packed-refs").write_text("# pack\nabc refs/heads/main\n")
    assert git.head(str(tmp_path)) == {"branch": "main", "commit": "abc"}
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("def\n")
    assert git.head(str(tmp_path))["commit"] == "def"
    (tmp_path / ".git" / "HEAD").write_text("123\n")
    assert git.head(str(tmp_path)) == {"branch": None, "commit": "123"}


def test_read_tree(spark, tmp_path):
    for p, t in {"src/main/java/A.java": "class A {}\n", ".git/x": "no", "big.txt": "x" * 50, "a.txt": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r["relative_path"]: (r["kind"], r["lines"]) for r in inventory(read_tree(spark, tmp_path.as_uri(), max_bytes=40)).collect()}
    assert got == {"src/main/java/A.java": ("java_main", 2), "a.txt": ("other", 1)}
    (tmp_path / "Empty.java").write_text("")
    (tmp_path / "odd [name]*.sql").write_text("SELECT 1")
    got = {r["relative_path"]: r["size_bytes"] for r in read_tree(spark, tmp_path.as_uri(), max_bytes=40).collect()}
    assert got == {"src/main/java/A.java": 11, "a.txt": 1, "Empty.java": 0, "odd [name]*.sql": 8}
    assert [r["relative_path"] for r in oversized(spark, tmp_path.as_uri(), max_bytes=40).collect()] == ["big.txt"]


def test_tree_of_odd_files(spark, tmp_path):
    """Files that are not UTF-8, files and folders that vanish, links: rows and warnings, in order of paths."""
    from codeweft.sources import tree

    root = tmp_path / "t"
    for p, b in {"e.java": b"class E {}", "a b/{x}/y.sql": b"SELECT 1", "a b/q.java": b"class \xe9 {\n}", "deep/1/2/3/4/5/6/7/z.txt": b"", "gone.txt": b"x", "big.bin": b"x" * 99, "build/no": b""}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    (root / "link").symlink_to(root)
    listed = materialize(tree.list_tree(spark, str(root), max_bytes=50, folders=3), "listed")
    (root / "gone.txt").unlink()
    got = {r["relative_path"]: (r["warning"], r["content"]) for r in tree.with_contents(listed, str(root), 3).collect()}
    assert got["gone.txt"] == ("cannot be read: FileNotFoundError", None) and got["big.bin"] == ("larger than 50 bytes", None)
    assert got["a b/q.java"] == (None, b"class \xe9 {\n}") and got["deep/1/2/3/4/5/6/7/z.txt"] == (None, b"") and len(got) == 6
    reader = tree._Reader(str(root), [], 50, 3)
    parts = reader.partitions()
    parts[0].value.append(("nowhere", True))
    assert ("nowhere", None, "folder cannot be listed: FileNotFoundError") in [r for p in parts for r in reader.read(p)]
    found = inventory(read_tree(spark, str(root)).where("relative_path <> 'big.bin'")).collect()
    assert [(r["relative_path"], r["lines"]) for r in found] == [("a b/q.java", 2), ("a b/{x}/y.sql", 1), ("deep/1/2/3/4/5/6/7/z.txt", 1), ("e.java", 1)]
    assert list(read_tree(spark, (tmp_path / "t/deep/1/2/3/4/5/6/7").as_uri()).columns) == ["relative_path", "size_bytes", "content"]
    (tmp_path / "empty").mkdir()
    assert read_tree(spark, str(tmp_path / "empty")).count() == 0


def test_patched_analysis_equals_a_full_one(spark):
    """Edits of all sorts: patched tables are those of a new analysis, and few files are read again."""
    from codeweft.operators import incremental
    from codeweft.operators.javagraph import JavaTables
    from codeweft.sources import java

    def parsed(code):
        rows = [(p, f"package {p.split('/')[0]};\n{text}\n".encode()) for p, text in code.items()]
        return java.parse_files(spark.createDataFrame(rows, "relative_path string, content binary"))

    code = {
        "a/Base.java": "public class Base { Helper helper; int f(int n) { return 1; } }",
        "a/Helper.java": "public class Helper { void go() { } }",
        "b/Mid.java": "import a.Base; public class Mid extends Base { }",
        "c/Low.java": "import b.Mid; public class Low extends Mid { void x() { helper.go(); f(1); } }",
        "d/User.java": "import c.Low; public class User { Low low; void y() { low.f(2); new Thing(); } void z(Single s) { s.run(); } }",
        "e/Single.java": "public class Single { void run() { } }",
        "f/Far.java": "public class Far { void a() { b(); } void b() { } }",
    }
    tables = JavaTables(parsed(code))

    def edit(full, **texts):
        nonlocal tables
        changed = {p.replace("__", "/") + ".java": t for p, t in texts.items()}
        new = {p: t for p, t in changed.items() if t is not None}
        code.update(new)
        for p in changed.keys() - new.keys():
            del code[p]
        files = spark.createDataFrame([(p,) for p in changed], "file string")
        tables, numbers = incremental.patched(incremental.state(tables), parsed(new) if new else tables.parsed.limit(0), files)
        if full:
            for name, theirs in incremental.state(JavaTables(parsed(code))).items():
                columns = sorted(c for c in theirs.columns if c not in ("texts",))
                got, want = (sorted(map(repr, df.select(columns).distinct().collect())) for df in (incremental.state(tables)[name], theirs))
                assert got == want, name
        return numbers

    assert edit(False, f__Far="public class Far { void a() { int k = 1; b(); } void b() { } }") == {"parsed": 1, "resolved": 1, "linked": 1}  # inside a body
    # Members seen through an inherited field and an inherited method: all but Single and Far.
    found = edit(True, a__Helper="public class Helper { void go() { } void go(int more) { } }", a__Base="public class Base { Helper helper; int f(long n, int m) { return 1; } }")
    assert found["parsed"] == 2 and found["linked"] == 5
    # A name that was clear is not any more; a type between two others goes.
    found = edit(True, g__Single="public class Single { }", b__Mid=None)
    assert found["parsed"] == 1 and found["linked"] < 6
    edit(True, h__Mid="public class Mid { int f(int n) { return 3; } class In { } }", c__Low="public class Low { void x() { } }")


def test_scan_survives_odd_files(spark, tmp_path):
    """Bad bytes and files that are too large leave a scan partial, with one warning each."""
    from codeweft.plans.scan import Project

    root = tmp_path / "code"
    root.mkdir()
    (root / "A.java").write_bytes(b"class A { String s = \"\xe9\"; }")
    (root / "b.sql").write_bytes(b"SELECT '\xff' FROM t")
    (root / "c.bin").write_bytes(b"0" * (11 << 20))
    project = Project(spark, str(root), (tmp_path / "store").as_uri(), dim=64)
    scan = project.scan()
    assert [r["relative_path"] for r in scan.warnings.collect()] == ["c.bin"]
    assert project.metadata.latest_scan().first()["status"] == "partial"
    assert project.metadata.events.read().where("level = 'warning'").count() == 1
    nodes, edges = project.graph.read()
    assert nodes.where("id = 'type:A'").count() == 1 and edges.where("type = 'READS_TABLE' AND dst = 'table:t'").count() == 1


def test_diffs_of_several_files(spark, tmp_path):
    from tests.samples import DIFF

    want = {("src/A.java", "M", 3, 4, 2, 3), ("src/A.java", "M", 12, 12, 2, 3), ("src/C.java", "R", None, None, 0, 0), ("new.sql", "A", 1, 1, 1, 0), ("gone.txt", "D", 0, 0, 0, 1)}
    for diffs in (git.diff_rows(spark, DIFF), spark.createDataFrame([(DIFF,)], "text string")):
        assert set(map(tuple, git.hunks(diffs).collect())) == want
    assert git.hunks(git.diff_rows(spark, "")).count() == 0
    with pytest.raises(git.GitUnavailable):
        git.read_diff(str(tmp_path))


def test_prompts_leave_room(spark):
    heads = spark.createDataFrame([("a", "do it"), ("b", "nothing")], "pack string, head string")
    sections = [("a", 1, "one", "x" * 400), ("a", 2, "blank", " \n "), ("a", 3, "two", "y" * 4000), ("a", 4, "three", "z")]
    got = {r["pack"]: r for r in context.assemble_prompts(heads, spark.createDataFrame(sections, "pack string, ordinal int, title string, body string"), budget=800).collect()}
    # 800 less 400 for the answer is below the least room of 600 tokens.
    assert got["a"]["prompt"] == "do it\n\n---\n# one\n\n" + "x" * 400 + "\n\n---\n# two\n\n" + "y" * (4 * (600 - 1 - 100)) and got["a"]["sections"] == 2
    assert (got["b"]["prompt"], got["b"]["sections"]) == ("nothing", 0)


def test_streaming_ingest(spark, tmp_path):
    from codeweft.streaming.ingest import level_counts, start_ingest

    schema = "relative_path string, sha256 string, version int"
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), schema)
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"relative_path": p, "sha256": s, "version": v}) for p, s, v in [("a", "1", 1), ("a", "2", 2), ("b", "1", 1)]))
    start_ingest(*args).awaitTermination(60)
    (tmp_path / "in" / "2.json").write_text(json.dumps({"relative_path": "b", "sha256": "9", "version": 2}))
    start_ingest(*args).awaitTermination(60)
    got = {r["relative_path"]: r["sha256"] for r in spark.read.parquet(str(tmp_path / "out" / "files" / "v=1")).collect()}
    assert got == {"a": "2", "b": "9"}
    assert [r["change"] for r in spark.read.parquet(str(tmp_path / "out" / "changes" / "v=1")).collect()] == ["modified"]
    events = spark.createDataFrame([("x", "2024-01-01 00:10:00")], "event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert level_counts(events).collect()[0]["n"] == 1


def test_short_terms_are_found(spark):
    nodes = spark.createDataFrame([("method:a", "getaXbValue", None), ("method:b", "other", None)], "id string, name string, fqn string")
    queries = spark.createDataFrame([(1, "call aX now")], "query_id int, query string")
    assert [r["id"] for r in retrieval.symbol_pool(nodes, queries).collect()] == ["method:a"]


def test_searches_in_blocks(spark, monkeypatch):
    """More queries than a block holds give the rows of single queries."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = vectors.where("id % 5 = 0 AND vector IS NOT NULL").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = sorted(map(tuple, retrieval.vector_topk(vectors, asked, 7).collect()))
    texts = spark.createDataFrame([(str(i), f"w{i % 3} w{i % 7} common") for i in range(50)], "id string, text string")
    words = spark.createDataFrame([(i, f"w{i} common") for i in range(6)] + [(9, None)], "query_id long, query string")
    lexical = sorted(map(tuple, retrieval.lexical_topk(texts, words, 5).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "PASS_QUERIES", 4)
    assert sorted(map(tuple, retrieval.vector_topk(vectors, asked, 7).collect())) == whole
    assert sorted(map(tuple, retrieval.lexical_topk(texts, words, 5).collect())) == lexical and len(lexical) == 30
    by = {(q, r): (i, s) for q, i, s, r in whole}
    for q, v in rows[:60:5]:
        cosine = sorted(((-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w in rows[:60]))[:7]
        assert [by[q, r][0] for r in range(7)] == [i for _, i in cosine]


def test_indexes_equal_plain_searches(spark, monkeypatch):
    """Cells, blocks and grams change no result: ties, zero vectors, odd dimensions, queries without an answer, large cells."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 5))
    rows = [(f"v{i:03}", [float(x) for x in np.round(centre[i % 6] + rng.normal(size=5) * 0.1, 3)]) for i in range(180)]
    rows += [(f"z{i}", [0.0] * 5) for i in range(4)] + [("null", None), ("short", [1.0]), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("twin", rows[7][1])]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3)
    asked = [(i, rows[i * 9][1]) for i in range(12)] + [(50, [0.0] * 5), (51, None), (52, [1.0]), (53, [-1.0, 2.0, 0.5, 0.0, 9.0])]
    queries = spark.createDataFrame(asked, "query_id int, query_vector array<double>")
    plain = retrieval.vector_topk(vectors.where("id <> 'short'"), queries, 8)
    report: dict = {}
    monkeypatch.setattr(indexes, "PART", 16)
    index = {k: materialize(v, k) for k, v in indexes.vector_index(vectors, 5).items()}
    assert sorted(map(tuple, indexes.vector_search(index, queries, 8, report).collect())) == sorted(map(tuple, plain.collect()))
    assert 0 < report["pairs_met"] < 0.8 * report["pairs"]
    none = {k: materialize(v, k) for k, v in indexes.vector_index(vectors.limit(0), 5).items()}
    assert indexes.vector_search(none, queries, 8).count() == 0

    monkeypatch.setattr(indexes, "BLOCK_BITS", 3)
    monkeypatch.setattr(indexes, "BLOCK", 8)
    texts = spark.createDataFrame([(f"t{i:02}", f"w{i % 3} w{i % 7} common") for i in range(50)] + [("u", None)], "id string, text string").repartition(3)
    words = spark.createDataFrame([(i, f"w{i} common") for i in range(6)] + [(9, None), (10, "t07"), (11, "absent words")], "query_id long, query string")
    index = {k: materialize(v, k) for k, v in indexes.text_index(texts).items()}
    for blocks in (topk.PASS_QUERIES, 4):
        monkeypatch.setattr(topk, "PASS_QUERIES", blocks)
        assert sorted(map(tuple, indexes.text_search(index, words, 5).collect())) == sorted(map(tuple, retrieval.lexical_topk(texts, words, 5).collect()))

    names = [("method:a.OrderStore#save", "save", "a.OrderStore#save"), ("type:xY", "xY", None), ("t", "longer_name_here", "p.Q"), ("n", None, None)]
    nodes = spark.createDataFrame(names, "id string, name string, fqn string")
    index = {k: materialize(v, k) for k, v in indexes.name_index(nodes).items()}
    sought = spark.createDataFrame([(1, "the orderstore saves"), (2, "find xY now"), (3, "name_ or nothere"), (4, None)], "query_id int, query string")
    assert {(r["query_id"], r["id"]) for r in indexes.name_search(index, sought).collect()} == {(1, "method:a.OrderStore#save"), (2, "type:xY"), (3, "t")}


def test_scan_end_to_end(spark, tmp_path):
    """A folder becomes a graph with all facts; a second scan reuses vectors, records changes and answers searches."""
    from tests.samples import FILES
    from codeweft.plans.scan import Project

    root, store = tmp_path / "code", (tmp_path / "store").as_uri()
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    project = Project(spark, str(root), store, dim=512)
    first = project.scan()
    assert {r["change"] for r in first.changes.collect()} == {"added"} and first.vectors["reused"] == 0 and first.vectors["embedded"] == first.vectors["chunks"] > 20
    nodes, edges = project.graph.read()
    kinds = {r["type"] for r in edges.select("type").distinct().collect()}
    assert {"EXPOSES", "MAPPED_TO", "INJECTS", "HANDLES", "EXECUTES_SQL", "READS_TABLE", "WRITES_TABLE", "CALLS", "OVERRIDES"} <= kinds
    assert nodes.where("spark_job").count() == 1 and nodes.where("stereotype = 'Service'").count() == 1
    (root / "db/schema.sql").unlink()
    store_file = root / "src/main/java/shop/data/OrderStore.java"
    store_file.write_text(store_file.read_text().replace("String load(long id);", "String load(long id, int more);"))
    second = project.scan()
    changes = {r["relative_path"]: r["change"] for r in second.changes.where("change <> 'unchanged'").collect()}
    assert changes == {"db/schema.sql": "deleted", "src/main/java/shop/data/OrderStore.java": "modified"}
    assert second.reread == {"parsed": 1, "resolved": 2, "linked": 2} and 0 < second.vectors["embedded"] < 6 and second.vectors["pruned"] >= 3 and second.vectors["reused"] > 15
    assert project.metadata.latest_scan().first()["status"] == "success" and project.metadata.files.read().count() == len(FILES) - 1
    found = project.search(spark.createDataFrame([(1, "place an order and save it in the OrderStore")], "query_id int, query string"))
    hits = {r["id"]: r["sources"] for r in found.collect()}
    assert len(hits) == 10 and {"graph-caller", "graph-callee", "symbol", "vector"} <= {s for x in hits.values() for s in x}
    assert any(r["secret"] for r in project.configuration().collect())


def test_hybrid_retrieve_hydrates_what_several_queries_found(spark):
    """Nodes without a chunk show their name, chunks without a node their text; what is neither falls away."""
    none = "CAST(NULL AS STRING)"
    chunks = spark.sql(f"SELECT 'type:A' AS node_id, 'alpha beta' AS text, 'Class' AS kind, {none} AS fqn, 'A.java' AS file, 3 AS line_start UNION ALL SELECT 'type:gone', 'alpha', 'Class', {none}, 'G.java', 1")
    nodes = spark.sql(f"SELECT 'type:A' AS id, 'Class' AS kind, 'A' AS name, 'x.A' AS fqn, {none} AS file, 9 AS line_start UNION ALL SELECT 'method:m', 'Method', 'alphaM', 'x.A#alphaM()', 'A.java', 5")
    edges = spark.sql("SELECT 'CALLS' AS type, 'method:lost' AS src, 'method:m' AS dst")
    vectors = spark.sql("SELECT 'type:A' AS node_id, array(1.0D, 0.0D) AS vector")
    queries = spark.sql("SELECT 1 AS query_id, 'alpha' AS query UNION ALL SELECT 2, 'alpha' UNION ALL SELECT 3, '...'")
    asked = queries.selectExpr("query_id", "array(1.0D, 0.0D) AS query_vector")
    found = {(r["query_id"], r["id"]): r for r in retrieval.hybrid_retrieve(chunks, vectors, nodes, edges, queries, asked).collect()}
    assert set(found) == {(q, i) for q in (1, 2) for i in ("type:A", "type:gone", "method:m")} | {(3, "type:A")}
    for q in (1, 2):
        assert (found[q, "type:A"]["text"], found[q, "type:A"]["file"], found[q, "type:A"]["line"]) == ("alpha beta", "A.java", 9)
        assert (found[q, "method:m"]["text"], found[q, "type:gone"]["text"]) == ("alphaM", "alpha")
        # Four tokens in all, one shared: alpha; alpha, beta, type, a.
        assert found[q, "type:A"]["score"] == pytest.approx(0.65 * (1 / 10 + 1 / 10 + 0.05) + 0.35 / 4)


def test_spread_keeps_rows_and_leaves_wide_tables(spark):
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(few).count() == 100
    assert spread(many) is many
