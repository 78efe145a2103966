"""Language ID, toxicity, tokenizers, packing and top-k: held-out accuracy, round trips, brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codeweft.llm import language_id, packing, queries, topk, toxicity
from codeweft.llm.automaton import Automaton
from codeweft.llm.tokenizing import WordTokenizer, decode, encode
from tests.llm.conftest import SF

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_bitmask"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.98 and held.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.select("doc_id", "held_out").collect())


def test_language_odd_rows(odd, none, docs):
    model = language_id.fit(docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang")))
    got = language_id.identify(odd, model, keep=[F.col("doc_id"), F.col("_text")]).toPandas()
    by = dict(zip(got.doc_id.fillna(-1), got.lang_pred))
    assert by[3] == by[4] == by[5] == by[8] == "und" and by[1] == "en" and by[10] != "und" and len(got) == 12
    assert language_id.identify(none, model).count() == 0
    nothing = language_id.fit(none.select(F.col("text").alias("_text"), F.col("lang").alias("_lang")))
    assert nothing is None and {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_a_language_of_one_text_is_found(spark, docs):
    """One labelled text is enough for its own words, and takes nothing from a language of many texts."""
    english = docs.where("lang = 'en' AND length(text) > 200").select(F.col("text").alias("_text"), F.col("lang").alias("_lang")).limit(40)
    own = "zyx qwvk jjrx kzzq wyxv qqkz vvjw xkqy zzwv"
    labelled = english.unionByName(spark.createDataFrame([(own, "xx")], "_text string, _lang string"))
    model = language_id.fit(labelled)
    got = language_id.identify(labelled, model, "_text", [F.col("_lang")]).collect()
    assert model.languages == ["en", "xx"] and sum(r["lang_pred"] == r["_lang"] for r in got) == 41


def test_language_model_learns_from_every_text(spark):
    """Counts of n-grams and thresholds are those of all texts of a language, however many it has."""
    rng = random.Random(5)
    letters = {"en": "abcdefghij", "de": "ghijklmnop"}
    words = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
    rows = [(words(k), k) for k, n in (("en", 2600), ("de", 1300)) for _ in range(n)] + [(None, "en"), ("zzz", None)]
    labelled = spark.createDataFrame(rows, "_text string, _lang string").repartition(5)
    model = language_id.fit(labelled)
    ngrams, rate = language_id.NGrams(), {}
    for k, least in (("de", 3), ("en", 6)):  # twice in each 1000 texts
        own, n = np.unique(ngrams.of([t for t, lang in rows if lang == k])[0], return_counts=True)
        own, n = own[n >= least], n[n >= least]
        rate[k] = dict(zip(own.tolist(), (n / max(n.sum(), language_id.LEAST_GRAMS)).tolist()))
    held = [np.array([g for g, r in rate[k].items() if r >= language_id.LEAST_SHARE * max(x.get(g, 0) for x in rate.values())], np.uint64) for k in ("de", "en")]
    want = language_id.Model(["de", "en"], "en", held)
    assert model.languages == want.languages and model.first == want.first and (model.false_rate == want.false_rate).all()
    assert all((a == b).all() for a, b in zip(model.tables, want.tables, strict=True))
    usual = language_id.usual_coverage(labelled, model)
    for k in ("de", "en"):
        names, _, coverage = want.predict(ngrams, [t for t, lang in rows if lang == k])
        assert usual[k] == pytest.approx(np.quantile([c for c, x in zip(coverage, names) if x == k], 0.01), abs=2 / language_id.COVERAGE_PARTS)


def test_language_stage_sends_texts_once_in_small_slices(spark, odd, docs, monkeypatch):
    """Python gets no text twice, and works on so few at a time that n-grams take little memory."""
    sent, mapped = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: sent.append((f, self.schema)) or mapped(self, f, schema, *a, **b))
    kept = corpus_pipeline.language(spark, docs, SF)
    (fit, _), whole, _ = sent  # the last is for the usual coverage
    assert whole[1].simpleString().count("string") == docs.schema.simpleString().count("string")
    texts = [r["text"] for r in docs.where("length(text) > 200").select("text").limit(150).collect()]
    texts *= 3_000_000 // sum(map(len, texts)) + 1
    columns = {"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [0] * len(texts)}
    row = pa.StructArray.from_arrays([pa.array(columns[c]) for c in docs.columns], docs.columns)
    whole_rows = pa.RecordBatch.from_pydict({"_keep": pa.StructArray.from_arrays([row], ["_row"]), "_text": texts, "_letters": [True] * len(texts)})
    for f, batch in ((fit, pa.RecordBatch.from_pydict({"bit": [0] * len(texts), "_text": texts})), (whole[0], whole_rows)):
        tracemalloc.start()
        rows = sum(part.num_rows for part in f(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50e6 and rows >= len(texts)
    # Rows and texts stay together, also where the column is written otherwise and slices begin within a batch.
    monkeypatch.setattr(language_id, "SLICE", 64)
    model = language_id.fit(docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang")))
    for rows in (odd, odd.withColumnRenamed("text", "Text")):
        apart = language_id.identify(rows.drop("_text", "lang_pred"), model, keep=[F.col("doc_id"), F.xxhash64("text").alias("h")])
        inside = language_id.identify(rows.drop("_text", "lang_pred"), model, keep=[F.struct("doc_id", *[c for c in rows.columns if c.lower() == "text"]).alias("_row")], within="_row")
        inside = inside.select("_row.doc_id", F.xxhash64("_row.text").alias("h"), "lang_pred", "score", "coverage")
        assert sorted(apart.collect(), key=str) == sorted(inside.collect(), key=str) and apart.count() == 12
    assert kept.count() == corpus_pipeline.language(spark, docs.withColumnRenamed("text", "Text"), SF).count() > 0


def test_filter_returns_all_languages_of_an_ngram():
    grams = language_id.NGrams()
    own, _ = grams.of(["shared"])
    other, _ = grams.of(["private"])
    model = language_id.Model(["aa", "bb"], "aa", [np.union1d(own, other), own])
    names, score, held = model.predict(grams, ["shared", "private", "nothing like it"])
    assert names == ["aa", "aa", "aa"] and score[0] == pytest.approx(0.5) and score[1] == 1.0 and score[2] == 0


def test_toxicity_held_out(spark):
    got = queries.QUERIES["op10_toxicity_neighbours"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    t = got.join(labels, "doc_id").toPandas()
    hit = ((t.predicted == 1) & (t.toxic == 1)).sum()
    assert hit / t.toxic.sum() > 0.85 and hit / t.predicted.sum() > 0.9


def test_toxicity_odd_rows(spark, odd, none):
    bad = [(i, f"plain words number{i} here " + ("awful" if i % 3 == 0 else "fine"), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(bad, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")))
    got = {r["doc_id"]: (r["score"], r["evidence"]) for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(s for i, (s, _) in got.items() if i % 3 == 0) > 0.9 and max(s for i, (s, _) in got.items() if i % 3) < 0.1
    assert got[0][1][0]["toxic"] == 1
    assert toxicity.score_toxicity(odd, model).count() == 12 and toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert {r["score"] for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    n, terms = 300, 40
    row = np.repeat(np.arange(n), 5)
    term = np.concatenate([rng.choice(terms, 5, replace=False) for _ in range(n)])
    index = toxicity.BlockMaxIndex(rng.uniform(1, 3, terms), row, term, rng.integers(1, 4, len(row)).astype(float), n)
    dense = np.zeros((n, terms))
    for t in range(terms):
        dense[index.rows[index.term_start[t] : index.term_start[t + 1]], t] = index.values[index.term_start[t] : index.term_start[t + 1]]
    for _ in range(20):
        own = rng.choice(terms, 4, replace=False)
        w = rng.uniform(0.1, 1, 4)
        q = np.zeros(terms)
        q[own] = w
        found, cosine = index.nearest(own, w, 7)
        full = dense @ q
        order = np.lexsort((np.arange(n), -full))[:7]
        assert np.allclose(cosine, full[order])


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), WordTokenizer.of(WORDS), Tokenizer.from_file(BYTES), packing.ByteTokenizer.of(BYTES)


ALPHABET = "abeht'sdrvlm \n\t12!?.éßÀñ<|>Ş中́İ"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=8))
def test_tokenizers_equal_the_library(libraries, texts):
    word_lib, word, byte_lib, byte = libraries
    texts = [*texts, "<|endoftext|> a<|startoftext|>it's", ""]
    for lib, own in ((word_lib, word), (byte_lib, byte)):
        assert [list(x) for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids = word_lib.encode(texts[0], add_special_tokens=False).ids
    assert word.decode(np.array(ids)) == word_lib.decode(ids, skip_special_tokens=False)


def test_tokenizers_tell_words_of_repeating_patterns_apart(libraries):
    """Two 1024-letter words whose sums of powers modulo 2**64 are equal, in one batch, and one very long word."""
    word_lib, word, byte_lib, byte = libraries
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts = [one, one.translate(str.maketrans("ab", "ba")), "x" * 20_000, one]
    for lib, own in ((word_lib, word), (byte_lib, byte)):
        assert [list(x) for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def merged(word, merges):
    parts = list(word)
    for a, b in merges:  # reference semantics: the lowest merge everywhere, left to right, again and again
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.text(alphabet="ab", max_size=14))
def test_automaton_on_random_merges(seed, word):
    rng, tokens, merges = random.Random(seed), ["a", "b"], []
    for _ in range(6):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    automaton = Automaton({t: i for i, t in enumerate(tokens)}, merges)
    assert automaton.decode(automaton.encode(word)) == merged(word, merges)


def test_encode_and_decode_odd_rows(odd, none):
    lib = Tokenizer.from_file(WORDS)
    got = decode(encode(odd, WORDS, keep=[F.col("doc_id"), F.col("text").alias("t")]), WORDS).collect()
    assert len(got) == 12
    for r in got:
        ids = lib.encode(r["t"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert encode(none, WORDS).count() == 0


def check_packing(docs, got):
    lib = Tokenizer.from_file(BYTES)
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, copies in left.items():
        assert len(copies) == 1 or all((c == copies[0]).all() for c in copies)
        want = copies[0].tobytes()
        total = b"".join(p["ids"] for p in sorted(pieces[i], key=lambda p: (p["start"], p["sequence_id"])) ) if len(copies) == 1 else None
        assert total is None or total == want
        assert sum(p["length"] for p in pieces[i]) == len(copies) * len(copies[0]) and {p["doc_tokens"] for p in pieces[i]} == {len(copies[0])}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0 and {r["sequence_length"] for r in rows} == {at}


def test_packing(docs, odd, none):
    for d in (docs, odd):
        check_packing([tuple(r) for r in d.select("doc_id", "text").collect()], packing.pack_documents(d, BYTES).collect())
    assert packing.pack_documents(none, BYTES).count() == 0


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-3.0, 2.0]), (7, [2.0, 1.0]), (100, [-1.0, 0.2]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "id": F.lit(1)})
    got = topk.topk(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=3).orderBy("query_id", "rank").collect()
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i in (0, 1, 2, 6, 7, 100)}
    for q in (0, 100):
        want = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:3]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == want
    assert topk.topk(vectors.limit(0), F.lit(True)).count() == 0


def test_topk_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    ints = np.round(rng.normal(size=(500, 8)) * rng.lognormal(3, 1.5, (500, 1)) * 50).astype(np.int64)
    ids = np.arange(500)
    for query_id, found, scores in topk.search((ids[:25], ints[:25]), topk.buckets_of(ids, ints), 10):
        full = ints @ ints[query_id]
        want = [i for i in np.lexsort((ids, -full)) if i != query_id][:10]
        assert found.tolist() == want and scores.tolist() == full[want].tolist()


def test_toxicity_keeps_rare_terms_and_norms_whole_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k // 26] * 2 + letters[k % 26] * 2
    # 40 insults of two toxic examples each: none is in four of them.
    rows = [(i, f"{name(i % 40)}zz plain common words", 1) for i in range(80)] + [(100 + i, f"plain common words {name(i)}yy", 0) for i in range(160)]
    long = " ".join(f"{name(i)}yy" for i in range(120))
    more = [(500, f"{name(7)}zz", None), (501, f"plain {name(7)}zz common {long}", None), (502, "unseen", None), (503, f"{name(7)}zz other", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert {e["doc_id"] for e in got[500]["evidence"]} >= {7, 47} and got[500]["score"] > toxicity.THRESHOLD and got[502]["evidence"] == []
    nearest = lambda i: {e["doc_id"]: e["cosine"] for e in got[i]["evidence"]}
    assert nearest(500)[7] > 3 * nearest(501).get(7, 0.0)
    # Cosines by their definition, over every term of both texts.
    terms = lambda t: [x for w in t.split() for x in (w, *(w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) > n))]
    bags = {i: terms(t) for i, t, _ in rows + more}
    df, of = {}, lambda kind, x: sum(x in bags[i] for i, _, y in rows if y == kind)
    for bag in bags.values():
        for x in set(bag):
            df[x] = df.get(x, 0) + 1
    weigh = lambda x: (np.log((len(bags) + 1) / (df[x] + 1)) + 1) * np.log2(2 + of(1, x) / 80 * 160 / max(1, of(0, x)))
    vectors = {i: {x: (1 + np.log(bags[i].count(x))) * weigh(x) for x in set(bags[i])} for i in (7, 47, 107, 500, 501, 503)}
    size = lambda v: np.sqrt(sum(w * w for w in v.values()))
    for q in (500, 501, 503):
        for i, cosine in nearest(q).items():
            if i in vectors:
                assert cosine == pytest.approx(sum(w * vectors[i].get(x, 0) for x, w in vectors[q].items()) / size(vectors[q]) / size(vectors[i]))


def test_search_with_few_and_many_holders_is_exact():
    rng = np.random.default_rng(4)
    n, terms = 700, 500
    share = np.where(np.arange(terms) < 20, 0.5, 0.01)
    row, term = np.nonzero(rng.random((n, terms)) < share)
    index = toxicity.BlockMaxIndex(rng.uniform(1, 3, terms), row, term, rng.integers(1, 4, len(row)).astype(float), n)
    assert 0 < index.full.shape[1] < terms
    dense = np.zeros((n, terms))
    for t in range(terms):
        dense[index.rows[index.term_start[t] : index.term_start[t + 1]], t] = index.values[index.term_start[t] : index.term_start[t + 1]]
    for without in range(20):
        own = np.flatnonzero(rng.random(terms) < share * 2)
        w = rng.uniform(0.1, 1, len(own))
        full = dense[:, own] @ w
        full[without] = 0
        found, cosine = index.nearest(own, w, 9, without)
        assert found.tolist() == np.lexsort((np.arange(n), -full))[:9].tolist() and np.allclose(cosine, full[found])


def test_fit_of_more_than_64_languages(spark):
    """Bits of the second word of languages and the sign bit of the first are learned through Spark as they are from n-grams at hand."""
    rng = random.Random(3)
    words = ["".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(40)) for _ in range(70)]
    names = [f"l{i:02}" for i in range(70)]
    model = language_id.fit(spark.createDataFrame(list(zip(words, names)), "_text string, _lang string"))
    want = language_id.Model(names, "l00", [np.unique(language_id.NGrams().of([w])[0]) for w in words])
    assert all((a == b).all() for a, b in zip(model.tables, want.tables, strict=True)) and (model.false_rate == want.false_rate).all()
    nothing = language_id.fit(spark.createDataFrame([("1 2", "en")], "_text string, _lang string"))
    assert nothing.languages == ["en"] and not nothing.tables[0].any()


def test_filter_of_more_than_64_languages():
    """Languages beyond one mask word are as good as the others."""
    ngrams = language_id.NGrams()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i // 26] * 3 + letters[i % 26] * 3 for i in range(150)]
    model = language_id.Model([f"l{i:03}" for i in range(150)], "l000", [np.unique(ngrams.of([w])[0]) for w in words])
    names, score, _ = model.predict(ngrams, [f"{w} {w}" for w in words])
    assert names == model.languages and len(model.tables) == 3 and score.min() > 0.05


def test_topk_in_rounds_and_slices(spark, monkeypatch):
    """Lengths over several doublings: two rounds, many slices and blocks, the same ten as by brute force."""
    monkeypatch.setattr(topk, "SLICE_VECTORS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 6)) * rng.lognormal(0, 1.0, (400, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.topk(df, F.col("vec_id") % 40 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ints = np.floor(1024 * vectors).astype(np.int64)
    for q in range(0, 400, 40):
        full = ints @ ints[q]
        assert got[q] == [(i, full[i]) for i in np.lexsort((np.arange(400), -full)) if i != q][:10]
