"""Byte-pair encoding and decoding of whole texts by a tokenization automaton.

``encode`` splits each text into the pieces of the tokenizer's own pattern and encodes each distinct
piece once by the automaton (see :mod:`codeweft.llm.automaton`); ``decode`` emits the arc labels,
joined as the tokenizer's file says. Both are one pass without a shuffle. The automaton is compiled
on each worker from the tokenizer's file, whose path is a parameter; tables are bounded.

Texts of plain Latin code points are split with array operations. Any other text, and one that
holds a special token's string, is split by the library's normaliser and splitter.

Defined results: a null text is an empty text and has no tokens; repeated rows get equal results;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.arrays import over_slices
from codeweft.llm.automaton import Automaton
from codeweft.llm.common import table
from codeweft.llm.piecetable import PieceTable
from codeweft.llm.presplit import PLAIN, code_points, split_words

#: Working tables by tokenizer file, kept while a worker lives.
_MADE: dict[str, WordTokenizer] = {}


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies.

    Fixed rule of the format: printable Latin-1 signs stand for themselves, the rest follow from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordTokenizer:
    """Encoder and decoder for a word-end vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") is not None:
            raise ValueError("only vocabularies whose tokens are decoded joined by blanks are supported")
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        self.pieces = PieceTable(self._encode_pieces)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        encode, symbols = self.automaton.encode, self.symbols
        return [encode(p.encode("utf-8").decode("latin-1").translate(symbols)) for p in pieces]

    def encode_slowly(self, text: str) -> np.ndarray:
        """Any text: special tokens cut out, then the library's normaliser and splitter."""
        out: list[int] = []
        while text:
            at, token = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            if part := text[:at]:
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                for piece, _ in split:
                    out += self.automaton.encode(piece)
            if token:
                out.append(self.special[token])
            text = text[at + len(token) :]
        return np.array(out, dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        lowered = [(t or "").lower() for t in texts]
        codes, begins = code_points(lowered)
        odd = np.add.reduceat(codes >= PLAIN, begins[:-1]) > 0 if len(codes) else np.zeros(0, bool)
        for i, t in enumerate(texts):
            if t and any(s in t for s in self.special):
                odd[i] = True
        slow = np.flatnonzero(odd)
        plain = ["" if odd[i] else t for i, t in enumerate(lowered)] if len(slow) else lowered
        if len(slow):
            codes, begins = code_points(plain)
        start, end = split_words(codes, begins)
        where, size = self.pieces.lookup("\0".join([*plain, ""]), codes, start, end)
        ids, before = self.pieces.gather(where, size)
        cut = before[np.searchsorted(start, begins)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in slow.tolist():
            out[i] = self.encode_slowly(texts[i])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns and ``ids``: the tokens as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.struct(*(keep if keep is not None else [F.col("doc_id")])).alias("_keep"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("ids", T.BinaryType())])

    def make():
        own = WordTokenizer.of(tokenizer)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = own.encode(batch.column("_text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema.names)

        return work

    return rows.mapInArrow(over_slices("_text", make), schema).select("_keep.*", "ids")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the labels of the arcs."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def make():
        own = WordTokenizer.of(tokenizer)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(ids_col).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

        return work

    return encoded.mapInArrow(over_slices(ids_col, make), schema)


def op9_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
