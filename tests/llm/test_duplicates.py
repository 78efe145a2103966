"""The Jaccard join and the suffix-array family against brute force, and the pipeline's stages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeweft.llm import suffix_index
from codeweft.llm.components import components
from codeweft.llm.jaccard_join import jaccard_groups
from tests.llm.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(docs, words, num):
    """(id, set size, component) of each row, by comparing every pair."""
    sets = []
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[k:] for k in range(words)])) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i is None, i or 0, len(s), least.get(find(k), i)) for k, ((i, _), s) in enumerate(zip(docs, sets))), key=repr)


def near_copies(n=60):
    rng, out = random.Random(7), []
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    for i in range(n):
        text = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))] if i % 4 == 0 else list(base)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(len(text))] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(text) if i % 9 else " ".join(text).upper()))
    return out + [(1000 + i, "short text " + "of " * (i % 4)) for i in range(8)]


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (2, 50)])
def test_join_equals_brute_force(spark, odd, words, num, monkeypatch):
    for source in (spark.createDataFrame(near_copies(), "doc_id long, text string"), odd):
        docs = [tuple(r) for r in source.select("doc_id", "text").collect()]
        got = jaccard_groups(source, words, num, 100).collect()
        assert sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in got), key=repr) == brute_groups(docs, words, num)


def test_join_in_many_units(spark, monkeypatch):
    monkeypatch.setattr("codeweft.llm.jaccard_join.UNIT_SETS", 6)
    source = spark.createDataFrame(near_copies(), "doc_id long, text string")
    got = jaccard_groups(source, 3, 90, 100).collect()
    assert sorted(((False, r[0], r[1], r[2]) for r in got), key=repr) == brute_groups(near_copies(), 3, 90)


def test_join_of_tables(spark, docs, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_groups(docs, 3, 90, 100).collect()
    assert sorted(((False, r[0], r[1], r[2]) for r in got), key=repr) == brute_groups(rows, 3, 90)
    assert jaccard_groups(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 330)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs], "big long, small long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


def brute_repeats(docs, length):
    """(bytes, removed, runs, digest of the rest) by id; equal ids are one document."""
    seen, out = {}, {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if seen.setdefault(window, (i, p)) != (i, p):
                cover[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(data, cover) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out[i] = (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


def test_repeats_equal_brute_force(spark, odd, none):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(90, 400))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(150))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(3), p[rng.randrange(40) :])
        rows.append((i * 3 % 80, "".join(parts)))
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, "a" * 130), (203, None), (204, ""), (205, passages[0][:99])]
    assert result(suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_repeats(rows, 100)
    simple = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert result(suffix_index.remove_repeats(odd)) == brute_repeats(list(dict.fromkeys(simple)), 100)
    assert suffix_index.remove_repeats(none).count() == 0


def test_repeats_of_tables(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(suffix_index.remove_repeats(docs)) == brute_repeats(rows, 100)


def repeating_rows(n=80, seed=3):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(90, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(150))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(3), p[rng.randrange(40) :])
        rows.append((i, "".join(parts)))
    return rows


def test_hot_anchors_are_compared_by_all_executors(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT_CONTEXTS", 3)
    rows = repeating_rows(60, 5) + [(200, "a" * 500), (201, "ab" * 300), (202, "a" * 130)]
    assert result(suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_repeats(rows, 100)


def test_stored_family_meets_later_batches(spark, tmp_path):
    """Five batches, one after the other, give what all of them give at once; few levels stay."""
    rows = repeating_rows(75, 9)
    family = suffix_index.SuffixFamily(spark, tmp_path.as_uri(), ranges=8)
    got = {}
    for b in range(5):
        batch = spark.createDataFrame(rows[15 * b : 15 * b + 15], "doc_id long, text string").repartition(2)
        got |= result(family.add(batch))
    assert got == brute_repeats(rows, 100)
    sizes = [family.size(x) for x in family.levels()]
    assert 0 < len(sizes) <= 3 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_family_keeps_few_levels():
    import numpy as np

    family = suffix_index.Family()
    rng = np.random.default_rng(1)
    total = 0
    for k in range(40):
        batch = np.zeros(50, suffix_index.ENTRY)
        batch["key"] = rng.integers(0, 500, 50)
        batch["doc"], batch["pos"] = k, np.arange(50)
        own, late = family.add(batch)
        total += len(own)
    assert len(family.add(batch)[0]) == 0  # a batch that brings nothing new
    sizes = [len(x) for x in family.levels]
    assert 0 not in sizes and len(sizes) <= 8 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    entries, _ = family.all()
    assert len(np.unique(entries["key"])) == len(entries) == total


def test_pipeline_stages(spark, odd, none):
    rows = odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(20).cast("long")).withColumn("text", F.lit(" ".join(f"word{k}" for k in range(60))))).unionByName(
        odd.where("doc_id = 2").withColumn("doc_id", F.lit(21).cast("long")).withColumn("text", F.lit(" ".join(f"word{k}" for k in range(60)) + " more"))
    )
    kept, now = {}, rows
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, SF), f"test-{name}")
        if name != "packing":
            assert sorted(now.columns) == sorted(rows.columns)
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now.select("doc_id").distinct().collect())
    ids = lambda *x: [(False, i) for i in x]
    assert kept["language_id"] == [*ids(1, 2, 6, 7, 9, 10, 20, 21), (True, 0)]
    assert kept["exact_dedup"] == [*ids(1, 6, 9, 10, 20, 21), (True, 0)]
    assert kept["ngram_jaccard_join"] == kept["secret_scan"] == kept["packing"] == [*ids(1, 6, 9, 10, 20), (True, 0)]
    now = none
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, SF), f"none-{name}")
        assert now.count() == 0


def test_pipeline_equals_brute_force(spark, docs):
    """Exact and near stages against pairwise comparison of what they are given."""
    first = corpus_pipeline.language(spark, docs, SF)
    texts = [tuple(r) for r in first.select("doc_id", "text").collect()]
    seen = {}
    for i, t in sorted(texts):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    second = corpus_pipeline.materialize(corpus_pipeline.exact(spark, first, SF), "second")
    assert sorted(r[0] for r in second.select("doc_id").collect()) == sorted(i for i, _ in seen.values())
    third = corpus_pipeline.near(spark, second, SF)
    want = sorted(i for _, i, _, c in brute_groups(sorted(seen.values()), 5, 80) if i == c)
    assert sorted(r[0] for r in third.select("doc_id").collect()) == want


def test_language_stage_drops_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swojej godności i swych praw. Są oni obdarzeni rozumem.",
        "xqzv kwjfh pqxz vvkjq zzxw hgfq wkxjv qpzx jjkwq xvzq fkqwx",
    ]
    clean = docs.where("lang IS NOT NULL AND length(text) BETWEEN 30 AND 400").orderBy("doc_id").limit(40)
    added = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    rows = docs.unionByName(added.unionByName(clean.selectExpr("doc_id - 1000000 AS doc_id", "text")), allowMissingColumns=True)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, rows, None).select("doc_id").collect()}
    assert not got & {-1, -2, -3, -4}
    assert {r["doc_id"] for r in clean.collect()} <= got and {r["doc_id"] - 1000000 for r in clean.collect()} <= got
    labelled = docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'").select("doc_id").collect()
    assert sum(r["doc_id"] in got for r in labelled) >= 0.995 * len(labelled)


THUE_MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
OTHER = THUE_MORSE.translate(str.maketrans("ab", "ba"))


def test_words_of_repeating_patterns_do_not_meet(spark):
    """Two long words that sums of powers modulo 2**64 cannot tell apart; and a bridge without an id."""
    middle = " ".join(f"w{k}" for k in range(118))
    rows = [(1, THUE_MORSE), (2, OTHER), (3, f"x {THUE_MORSE} y"), (4, f"x {OTHER} y"), (5, f"a {middle} a"), (None, f"a {middle} b"), (6, f"b {middle} b")]
    got = {r[0]: r[2] for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 97, 100).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and got[6] == got[None] == got[5] == 5


def test_pipeline_keeps_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(3, text, "en"), (5, text + " more", "en"), (5, "something wholly different stands here", "en"), (None, text, "en"), (None, text, "en"), (3, text, "de"), (7, "one  text", "a"), (7, "one text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.exact(spark, docs, SF)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in left.collect())
    assert [g for g in got if g[0] != 7] == [(0, text), (0, text), (3, text), (5, "something wholly different stands here"), (5, text + " more")]
    assert sum(g[0] == 7 for g in got) == 1
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near(spark, docs, SF).collect())
    assert (5, "something wholly different stands here") in got and (5, text + " more") not in got and got.count((3, text)) == 2 and got.count((0, text)) == 2
