"""Divergence audit, token files and phrases: brute force, odd rows, exact round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeweft.llm import divergence, phrases, queries, token_files
from codeweft.llm.elias_fano import EliasFano
from tests.llm.conftest import LONG, ROWS, SF

WORDS = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_audit(rows, least=3, top=200):
    """All (lang, source, part, item, value, rank), by the definition."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        of[None] = {t: sum(of[s][t] for s in of) for t in kept}
        rate = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in of.items()}
        for s in of.keys() - {None}:
            pair = [(-sum((rate[s][t] - rate[o][t]) ** 2 // rate[o][t] for t in kept), o.encode(), o) for o in of.keys() - {None, s}]
            over = [(-((rate[s][t] - rate[None][t]) ** 2 // rate[None][t]), t.encode(), t) for t in kept if of[s][t] and rate[s][t] > rate[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.divergence_audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_odd_rows(odd, none):
    assert audited(odd) == brute_audit([(r[1], r[2], r[3]) for r in ROWS])
    assert audited(none) == []


def test_divergence_cells_and_ties(spark, monkeypatch):
    """Many cells for each language, a hot source, a source without terms, a language without kept terms."""
    monkeypatch.setattr(divergence, "CELL", 4)
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in "abcdéß" for b in "xyz"]
    rows = [(" ".join(rng.choices(pool, k=rng.randrange(30))), rng.choice(["p", "q", None]), rng.choice(["hot", "hot", "s1", "s2", "S2", None])) for _ in range(120)]
    rows += [("123 --", "p", "empty"), (None, "p", "null"), ("once", "lone", "a"), ("twice", "lone", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert audited(df, top=3) == brute_audit(rows, top=3)


def test_rates_are_exact():
    rng = random.Random(3)
    whole = [rng.randrange(1, 1 << 52) for _ in range(2000)]
    count = [rng.randrange(w) for w in whole]
    assert divergence.scaled(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count, whole)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**62)), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert code.values().tolist() == values and [code[i] for i in range(len(values))] == values
    for v in [0, 7, *values[:5]]:
        assert code.first_at_least(v) == sum(x < v for x in values)
    with pytest.raises(IndexError):
        code[len(values)]


def test_elias_fano_is_small():
    """Boundaries of documents of 500 ids on average: far less than 64 bits each, by any stretch between samples."""
    lengths = np.random.default_rng(1).integers(0, 1000, 100_000)
    lengths[5000:9000] = 0
    bounds = np.cumsum(lengths, dtype=np.uint64)
    data = EliasFano.of(bounds).to_bytes()
    code = EliasFano.from_bytes(data)
    assert len(data) * 8 / len(bounds) < 12
    assert all(code[i] == bounds[i] for i in [*range(0, 100_000, 997), *range(4990, 9010)])
    with pytest.raises(ValueError):
        EliasFano.from_bytes(data[:-1])


def library_ids(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_op12(spark, docs):
    got = queries.QUERIES["op12_elias_fano_files"](spark, SF).orderBy("doc_id").collect()
    library, at, want = Tokenizer.from_file(WORDS), 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_odd_rows(spark, odd, none, tmp_path):
    path = (tmp_path / "a").as_uri()
    token_files.write_token_files(odd, path, WORDS)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    texts, at = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library_ids(texts[r["doc_id"]]) and (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
    with pytest.raises(Exception, match="already holds"):
        token_files.write_token_files(odd, path, WORDS)
    with pytest.raises(TypeError):
        token_files.write_token_files(odd.withColumn("doc_id", F.lit("x")), (tmp_path / "c").as_uri(), WORDS)
    path = (tmp_path / "b").as_uri()
    token_files.write_token_files(none, path, WORDS)
    assert token_files.read_token_files(spark, path).count() == 0


def test_files_outside_the_manifest_do_not_count(spark, odd, tmp_path):
    """What a lost task leaves behind is never read."""
    path = (tmp_path / "a").as_uri()
    token_files.write_token_files(odd, path, WORDS)
    before = token_files.read_token_files(spark, path).count()
    stray = token_files.FileWriter(fs.LocalFileSystem(), str(tmp_path / "a"), "part-000000-0000-lost.tokens", 2)
    stray.add(77, b"\1\0")
    stray.close()
    assert token_files.read_token_files(spark, path).count() == before


@pytest.mark.parametrize("width", [2, 4])
def test_random_access(tmp_path, width):
    rng = np.random.default_rng(width)
    writer = token_files.FileWriter(fs.LocalFileSystem(), str(tmp_path), "f.tokens", width)
    ids = [rng.integers(0, 1 << 15, n).astype(f"<u{width}") for n in [0, 3, 0, 700, 1, *rng.integers(0, 50, 900)]]
    names = [None, None, *sorted(rng.integers(-(2**62), 2**62, len(ids) - 2).tolist())]
    for name, x in zip(names, ids):
        writer.add(name, x.tobytes())
    writer.close()
    file, at = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "f.tokens")), 0
    assert len(file) == len(ids)
    for i, x in enumerate(ids):
        assert file.offset(i) == at and file.ids(i).tolist() == x.tolist() and file.doc_id(i) == names[i]
        at += len(x)


def test_a_file_is_read_in_parts(tmp_path, monkeypatch):
    """Parts of a reader give every document once, whatever their size, with documents that have no ids."""
    folder = str(tmp_path)
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    lengths = [0, 0, 7, 0, 30, 1, 0, 20, 3, 3, 0, 64, 0, 0, 2, 0]
    files = fs.LocalFileSystem()
    writer, done, doc = None, [], 0
    for n in lengths:
        writer = writer or token_files.FileWriter(files, folder, f"{len(done)}.tokens", 2)
        writer.add(doc, np.arange(n, dtype="<u2").tobytes())
        doc += 1
        if writer.full():
            done.append(writer.close())
            writer = None
    done.append(writer.close())
    assert len(done) == 3
    token_files._Writer(tmp_path.as_uri(), 2).commit([token_files._Written(1, done[1:]), token_files._Written(0, done[:1]), None])
    for part, batch in ((1 << 22, 1 << 18), (8, 4), (1, 1)):
        monkeypatch.setattr(token_files, "PART_IDS", part)
        monkeypatch.setattr(token_files, "BATCH_IDS", batch)
        reader = token_files._Reader(tmp_path.as_uri())
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_tokens"]) for r in got] == list(enumerate(lengths))
        assert [r["start"] for r in got] == [sum(lengths[:i]) for i in range(len(lengths))]


def brute_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {q for p, a in good.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if f[q := p[i : i + m]] <= a}
        scored = []
        for p, a in good.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p, -a, l, r, total[lang], -s) for i, (s, a, _, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(df, least, part, top=2000):
    return sorted(tuple(r) for r in phrases.collocations(phrases.frequent_phrases(df, least=least, part=part), top).collect())


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_phrases(spark, part):
    """Exact whatever the sample: all rows, some, or (with one in a thousand) none, where the border fails at every length."""
    rng = random.Random(11)
    pool = ["der", "Die", "und", "ein", "ß", "x-y", "the"]
    rows = []
    for i in range(80):
        words = [rng.choice(pool) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words[3:3] = ["New", "York", "City", "Hall", "Park", "Zoo"]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert mined(df, 6, part, 40) == brute_phrases([r[1:] for r in rows], 6, 40)


def test_phrases_odd_rows(odd, none):
    assert mined(odd, 3, 2) == brute_phrases([(r[1], r[2]) for r in ROWS], 3, 2000)
    assert mined(none, 3, 2) == [] and len(LONG.split()) > 3


def test_shared_codes_are_told_apart(monkeypatch):
    """Phrases whose codes meet are counted by their words."""
    import pyarrow as pa

    own = phrases.Phrases(pa.RecordBatch.from_arrays([pa.array(["a b a b c b a b"]), pa.array(["en"])], ["_text", "_lang"]))
    _, code, inside = list(own.codes())[1]
    place, times = own.exactly(np.zeros_like(code), np.flatnonzero(inside), 2)
    assert dict(zip(own.spelled(place, 2).to_pylist(), times.tolist())) == {"a b": 3, "b a": 2, "b c": 1, "c b": 1}


def test_lowered():
    assert phrases.lowered(100, 8) == 6 and phrases.lowered(100, 1) == 80 and phrases.lowered(3, 100) == 1
