"""The registered queries against brute force, column by column of their contracts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeweft.llm import queries
from tests.llm.conftest import SF
from tests.llm.test_duplicates import brute_groups, brute_repeats


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_op4(spark, texts):
    got = queries.QUERIES["op4_signature_tree_join"](spark, SF).collect()
    want = {i: (n, c) for _, i, n, c in brute_groups(sorted(texts.items()), 3, 90)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(want)


def test_op5(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.QUERIES["op5_tiered_packing"](spark, SF).toPandas()
    for doc, own in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        assert set(own.doc_tokens) == {len(ids)} and own.length.sum() == len(ids)
        at = 0
        for start, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
    assert set(got.doc_id) == set(texts)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.cumsum(own.length.to_numpy()) - own.length.to_numpy()).all() and own.length.sum() <= 1024


def test_op6(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op6_suffix_family"](spark, SF).collect()}
    assert got == brute_repeats(list(texts.items()), 100)


def test_op9(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.QUERIES["op9_bpe_automaton"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
