"""Stores keep what was written last, whole; JSON is found in noisy text."""

from pyspark.sql import functions as F

from codeweft.functions.jsontext import extract_json
from codeweft.sources.stores import GraphStore, Metadata, VectorStore


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, tmp_path.as_uri())
    nodes = spark.createDataFrame([("b", "T"), ("a", "T")], "id string, kind string")
    edges = spark.createDataFrame([("CALLS", "b", "a"), ("CALLS", "a", "b")], "type string, src string, dst string")
    store.replace(nodes, edges)
    store.replace(nodes.where("id = 'a'"), edges)
    got = store.read()
    assert [r["id"] for r in got[0].collect()] == ["a"] and got[1].count() == 2
    store.export_json(str(tmp_path / "json"))
    assert [r["src"] for r in spark.read.json(str(tmp_path / "json" / "edges")).collect()] == ["a", "b"]
    store.clear()
    assert store.read()[0].count() == 0


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, tmp_path.as_uri(), "hashing", 2)
    rows = lambda *x: spark.createDataFrame(x, "id string, text_hash string, vector array<double>")
    store.upsert(rows(("a", "1", [1.0, 0.0]), ("b", "2", [0.0, 1.0])))
    store.upsert(rows(("a", "3", [0.5, 0.5])))
    assert {r["id"]: r["text_hash"] for r in store.read().collect()} == {"a": "3", "b": "2"}
    store.prune_to(spark.createDataFrame([("a",)], "id string"))
    assert store.read().count() == 1 and VectorStore(spark, tmp_path.as_uri(), "other", 2).read().count() == 0


def test_metadata(spark, tmp_path):
    m = Metadata(spark, tmp_path.as_uri())
    assert m.known_hashes().count() == 0
    m.start_scan("s1", "p", "full")
    files = spark.createDataFrame([("x", "sql", 1, "h1", 1), ("y", "sql", 1, "h2", None)], "relative_path string, kind string, size_bytes long, sha256 string, lines int")
    m.upsert_files(files, "s1")
    m.upsert_files(files.where("relative_path = 'x'").withColumn("sha256", F.lit("h3")), "s1")
    m.delete_files(spark.createDataFrame([("y",)], "relative_path string"))
    assert [tuple(r) for r in m.known_hashes().collect()] == [("x", "h3")]
    m.record_event("s1", "info", "scan", "done")
    m.record_artifact("s1", "a.md", "page", 3)
    m.record_artifact("s1", "a.md", "page", 4)
    m.finish_scan("s1", "done", files=1, added=1)
    assert m.artifacts.read().select("size_bytes").collect() == [(4,)] and m.events.read().count() == 1
    row = m.latest_scan().first()
    assert row["status"] == "done" and row["added"] == 1 and row["finished_at"] is not None
    assert tuple(m.summary().first()) == (1, 1, "s1")


def test_json_in_noise():
    assert extract_json('text ```json\n{"a": 1}\n``` more {') == {"a": 1}
    assert extract_json('x {"a": {"b": "}"}} y') == {"a": {"b": "}"}}
    assert extract_json('x {"a": 1} and {broken') == {"a": 1}
    assert extract_json("none {at all") is None and extract_json(None) is None


def test_versions_are_whole_and_few(spark, tmp_path):
    from codeweft.sources.stores import Versioned

    t = Versioned(spark, tmp_path.as_uri())
    for k in range(4):
        before = t.read() if k else None
        t.replace(spark.range(k + 1))
        assert t.read().count() == k + 1 and (before is None or before.count() == k)  # who read before still can
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 2
    t.append(spark.range(2))
    assert t.read().count() == 6


def test_of_two_writers_one_wins(spark, tmp_path):
    """The loser changes nothing; nodes and edges of one commit stay together."""
    import pytest

    from codeweft.sources.stores import Committed, ConcurrentCommit

    store, other = GraphStore(spark, tmp_path.as_uri()), GraphStore(spark, tmp_path.as_uri())
    rows = lambda n: spark.range(n).select(F.lit(n).alias("scan"))
    store.replace(rows(1), rows(1))
    base = other.log.newest()
    store.replace(rows(2), rows(2))
    with pytest.raises(ConcurrentCommit):
        other.replace(rows(3), rows(3), base)
    nodes, edges = other.read()
    assert {r["scan"] for r in nodes.collect()} == {r["scan"] for r in edges.collect()} == {2}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("draft")]
    assert tuple(store.summary().first()) == (2, 2)
    # Appends meet no one; a table that nobody named stays as it was.
    log = Committed(spark, tmp_path.as_uri())
    log.append("events", rows(1))
    log.append("events", rows(1))
    assert log.read("events")[0].count() == 2 and log.read("nodes")[0].count() == 2
    assert {r["scan"] for r in log.read("nodes", at=1)[0].collect()} == {2}


def test_a_write_that_fails_is_not_seen(spark, tmp_path):
    import pytest

    store = GraphStore(spark, tmp_path.as_uri())
    good = spark.range(2).select(F.col("id"))
    store.replace(good, good)
    with pytest.raises(Exception):
        store.replace(good.limit(1), good.select(F.raise_error(F.lit("no")).alias("id")))
    assert [df.count() for df in store.read()] == [2, 2]


def test_old_folders_go(spark, tmp_path):
    from codeweft.sources.stores import Committed

    log = Committed(spark, tmp_path.as_uri())
    for k in range(4):
        log.commit(a=spark.range(k))
        log.append("b", spark.range(1))
    folders = [p.name for p in tmp_path.iterdir() if p.is_dir()]
    assert sum(f.startswith("data-a") for f in folders) <= 2 and log.read("b")[0].count() == 4 and log.read("a")[0].count() == 3
