"""Hierarchical multi-length packing of documents into token sequences.

A document's tokens (ids of a byte-level tokenizer, then an end id) are routed to context-size
tiers. Whole windows of the longest tier are cut off first; the rest goes to the shortest tier
(a power of two) that holds it. Tiers are packed from the longest: the longest rest opens a window of
its tier, and the gap behind it is filled from shorter tiers, the longest that fits first; if none
fits, the shortest is cut to size and its remainder goes back to the tier it now belongs to. So
every window is full. What is left when a partition ends is cut at powers of two. A full
sequence has a power-of-two length and needs no padding.

Sequences are balanced over step groups: each goes to the open step with the fewest tokens that
still has room, so steps hold ``STEP_TOKENS`` tokens each, whatever mix of tiers they get.

Everything happens in one streaming pass over each input partition, without a shuffle, with at
most ``BUFFER`` rests in memory; ids of sequences hold the partition's number and are the same when
a lost task is run again.

Defined results: a null or empty text is a document of one token, the end id; repeated rows are
packed each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.arrays import slices
from codeweft.llm.common import narrowed, table
from codeweft.llm.piecetable import PieceTable
from codeweft.llm.presplit import PLAIN, code_points, split_keeping_blanks
from codeweft.llm.tokenizing import byte_symbols

WINDOW = 1024
SHORTEST_TIER = 128
END_ID = 0
BUFFER = 8192
STEP_TOKENS = 65_536
OPEN_STEPS = 4
PARTITION_SHIFT = 36

_MADE: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file.

    Pieces of plain Latin texts are merged by tiktoken with the file's vocabulary as ranks; any
    other text, and one with a special token's string, goes through the library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(of_symbol[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merge = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = PieceTable(lambda found: [merge(p.encode("utf-8")) for p in found])

    @classmethod
    def of(cls, path: str) -> ByteTokenizer:
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        codes, begins = code_points(texts)
        odd = np.add.reduceat(codes >= PLAIN, begins[:-1]) > 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                odd[i] = True
        slow = np.flatnonzero(odd)
        plain = ["" if odd[i] else t for i, t in enumerate(texts)] if len(slow) else texts
        if len(slow):
            codes, begins = code_points(plain)
        start, end = split_keeping_blanks(codes, begins)
        where, size = self.pieces.lookup("\0".join([*plain, ""]), codes, start, end)
        ids, before = self.pieces.gather(where, size)
        cut = before[np.searchsorted(start, begins)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in slow.tolist():
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


def tier_of(length: int, window: int = WINDOW) -> int:
    """The shortest tier that holds so many tokens."""
    return min(window, max(SHORTEST_TIER, 1 << (length - 1).bit_length()))


class Packer:
    """Packs pieces (length, order, document, start, ids) as they come."""

    def __init__(self, first_id: int, window: int = WINDOW) -> None:
        self.window, self.next_id = window, first_id
        self.rests: list[tuple] = []  # sorted by length
        self.order = 0
        self.rows: list[tuple] = []
        self.step_id = first_id
        self.steps: list[list[int]] = []  # open steps: [tokens, id]

    def add(self, doc, ids: np.ndarray) -> None:
        n, window = len(ids), self.window
        for start in range(0, n - window + 1, window):
            self._emit([(window, 0, (doc, n), start, ids[start : start + window])], window)
        if n % window:
            self._put((doc, n), n - n % window, ids[n - n % window :])

    def _put(self, doc, start: int, ids: np.ndarray) -> None:
        self.order += 1
        insort(self.rests, (len(ids), self.order, doc, start, ids))

    def pack(self) -> None:
        """Pack all rests; those of a window that could not be filled stay for later."""
        rests = self.rests
        while rests:
            members = [rests.pop()]
            tier = tier_of(members[0][0], self.window)
            gap = tier - members[0][0]
            while gap and rests:
                at = bisect_right(rests, (gap, float("inf"))) - 1
                if at >= 0:
                    members.append(rests.pop(at))
                    gap -= members[-1][0]
                else:
                    _, _, doc, start, ids = rests.pop(0)
                    members.append((gap, 0, doc, start, ids[:gap]))
                    self._put(doc, start + gap, ids[gap:])
                    gap = 0
            if gap:
                for _, _, doc, start, ids in members:
                    self._put(doc, start, ids.copy())
                return
            self._emit(members, tier)

    def finish(self) -> None:
        """Cut what is left at powers of two."""
        self.pack()
        left = self.rests[::-1]
        self.rests = []
        total = sum(m[0] for m in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            members = []
            while size:
                n, _, doc, start, ids = left.pop(0)
                if n > size:
                    left.insert(0, (n - size, 0, doc, start + size, ids[size:]))
                    n, ids = size, ids[:size]
                members.append((n, 0, doc, start, ids))
                size -= n
            self._emit(members, sum(m[0] for m in members))

    def _emit(self, members: list[tuple], length: int) -> None:
        fitting = [s for s in self.steps if s[0] + length <= STEP_TOKENS]
        if fitting:
            step = min(fitting)
        else:
            if len(self.steps) >= OPEN_STEPS:
                self.steps.remove(max(self.steps))
            step = [0, self.step_id]
            self.step_id += 1
            self.steps.append(step)
        step[0] += length
        if step[0] == STEP_TOKENS:
            self.steps.remove(step)
        offset = 0
        for n, _, (doc, tokens), start, ids in members:
            self.rows.append((doc, start, n, ids.astype("<u4").tobytes(), tokens, self.next_id, offset, length, step[1]))
            offset += n
        self.next_id += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, step_id``."""
    rows = narrowed(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType
    long = T.LongType()
    names = ("start", "length"), ("doc_tokens", "sequence_id", "offset", "sequence_length", "step_id")
    schema = T.StructType(
        [T.StructField("doc_id", kind), *[T.StructField(n, long) for n in names[0]], T.StructField("ids", T.BinaryType()), *[T.StructField(n, long) for n in names[1]]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteTokenizer.of(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << PARTITION_SHIFT, window)
        id_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [()] * 9
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                id_type = part.schema.field("_id").type
                for doc, ids in zip(part.column("_id").to_pylist(), own.encode(part.column("_text").to_pylist()), strict=True):
                    packer.add(doc, np.append(ids, np.uint32(END_ID)))
                if len(packer.rests) >= BUFFER:
                    packer.pack()
                yield out()
        if id_type is not None:
            packer.finish()
            yield out()

    return rows.mapInArrow(run, schema)


def op5_tiered_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id"
    )
