"""Token files: ids of all documents end to end, with Elias-Fano coded document boundaries, as a Spark data source.

A file is a head, the ids as little-endian unsigned integers of two or four bytes, two Elias-Fano codes (document boundaries
and document ids; see :mod:`codeweft.llm.elias_fano`), and a foot that says where they lie. A folder is what its manifest
lists: files in ascending order of documents. Tasks write files under names of their own, and only the commit of a whole
job writes the manifest, so files of lost or repeated tasks never count. Files are opened through ``pyarrow.fs``, so a
folder can be any place that it reaches.

``write_token_files`` encodes, orders by document id and writes; ``spark.read.format("token_files")`` gives ``doc_id, start,
n_tokens, ids`` back, where ``start`` counts the ids of all documents before; ``TokenFile`` gives one document's offset or ids
by its place, reading no more than that.

Scale: texts are dealt once, by ranges of id; a task streams ids to its file and keeps only boundaries, and begins a new file
after ``FILE_IDS`` ids or ``FILE_DOCS`` documents. Ranges are cut by id, hash of text and row, so many rows of one id are no
single task. Readers take a file in parts of ``PART_IDS``. Only the manifest, an entry per file, passes the driver.

Defined results: a null text has the end id alone; rows that repeat an id stand one after the other, by hash of text; rows
without an id come first; an empty table gives a folder without files, which reads as no rows; extra columns are ignored;
ids other than whole numbers are refused; a folder that has a manifest is never written again.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from codeweft.llm.arrays import over_slices
from codeweft.llm.common import shared_dir, table
from codeweft.llm.elias_fano import EliasFano
from codeweft.llm.piecetable import PieceTable
from codeweft.llm.tokenizing import WordTokenizer, byte_symbols

HEAD = struct.Struct("<4sHH")
MAGIC, VERSION = b"CWTK", 1
TAIL = struct.Struct("<I4s")
MANIFEST = "manifest.json"
#: A file ends after so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 22
#: Ids of one task of a reader, and of one batch.
PART_IDS, BATCH_IDS = 1 << 22, 1 << 18
END_ID = 2
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class LibraryWords(WordTokenizer):
    """Ids of a word-end vocabulary file as the tokenizers library gives them.

    Each distinct word is merged once by the library's model; texts beyond plain Latin go through the whole library.
    """

    _made: dict[str, LibraryWords] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        self.pieces = PieceTable(self._encode_pieces)

    @classmethod
    def of(cls, path: str) -> LibraryWords:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        tokens, symbols = self.model.tokenize, self.symbols
        return [[t.id for t in tokens(p.encode("utf-8").decode("latin-1").translate(symbols))] for p in pieces]

    def encode_slowly(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class FileWriter:
    """Writes one file: ids as they come, then the tables."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str, width: int) -> None:
        self.name, self.width = name, width
        self.out = files.open_output_stream(f"{folder}/{name}")
        self.out.write(HEAD.pack(MAGIC, VERSION, width))
        self.lengths: list[int] = []
        self.docs: list[int] = []
        self.n_ids = self.nulls = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.out.write(ids)
        if doc is None:
            self.nulls += 1
        else:
            self.docs.append(doc)
        self.lengths.append(len(ids) // self.width)
        self.n_ids += self.lengths[-1]

    def full(self) -> bool:
        return self.n_ids >= FILE_IDS or len(self.lengths) >= FILE_DOCS

    def close(self) -> dict:
        least = self.docs[0] if self.docs else 0
        bounds = EliasFano.of(np.cumsum([0, *self.lengths], dtype=np.uint64)).to_bytes()
        # Differences of ids from the least fit in 64 unsigned bits, whatever the ids.
        docs = EliasFano.of(np.array(self.docs, dtype=np.int64).view(np.uint64) - np.uint64(least & (1 << 64) - 1)).to_bytes()
        foot = {"docs": len(self.lengths), "ids": self.n_ids, "nulls": self.nulls, "least": least, "bounds": len(bounds), "doc_ids": len(docs), "crc": zlib.crc32(bounds + docs)}
        text = json.dumps(foot).encode()
        self.out.write(bounds + docs + text + TAIL.pack(len(text), MAGIC))
        self.out.close()
        return {"name": self.name, "docs": foot["docs"], "ids": foot["ids"]}


class TokenFile:
    """Random access to one file: the tables are read once, ids only where they are asked for."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self.file = files.open_input_file(path)
        size = self.file.size()
        length, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        head, version, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or head != MAGIC or version != VERSION:
            raise ValueError(f"not a token file: {path}")
        self.foot = json.loads(self.file.read_at(length, size - TAIL.size - length))
        both = self.foot["bounds"] + self.foot["doc_ids"]
        tables = self.file.read_at(both, size - TAIL.size - length - both)
        if zlib.crc32(tables) != self.foot["crc"]:
            raise ValueError(f"damaged tables: {path}")
        self.bounds = EliasFano.from_bytes(tables[: self.foot["bounds"]])
        self.docs = EliasFano.from_bytes(tables[self.foot["bounds"] :])

    def __len__(self) -> int:
        return self.foot["docs"]

    def doc_id(self, i: int) -> int | None:
        """The id of the i-th document; those without one come first."""
        return None if i < self.foot["nulls"] else self.foot["least"] + self.docs[i - self.foot["nulls"]]

    def offset(self, i: int) -> int:
        """The number of ids in this file before the i-th document."""
        return self.bounds[i]

    def raw(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to ``end``, as unsigned 32-bit integers."""
        data = self.file.read_at((end - start) * self.width, HEAD.size + start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.raw(self.bounds[i], self.bounds[i + 1])


@dataclass
class _Written(WriterCommitMessage):
    task: int
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width
        files, folder = fs.FileSystem.from_uri(path)
        if files.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} already holds token files")
        files.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = fs.FileSystem.from_uri(self.path)
        task, done, own = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own is None:
                    own = FileWriter(files, folder, f"part-{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.tokens", self.width)
                own.add(doc, ids.as_buffer())
                if own.full():
                    done.append(own.close())
                    own = None
        if own is not None:
            done.append(own.close())
        return _Written(task, done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = fs.FileSystem.from_uri(self.path)
        listed = [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        draft = f"{folder}/{MANIFEST}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"width": self.width, "files": listed}).encode())
        files.move(draft, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else []:
                files.delete_file(f"{folder}/{f['name']}")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, folder = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
            listed = json.loads(f.read())["files"]
        out, before = [], 0
        for f in listed:
            parts = max(1, -(-f["ids"] // PART_IDS))
            out += [InputPartition((f["name"], before, k, parts)) for k in range(parts)]
            before += f["ids"]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, before, k, parts = partition.value
        files, folder = fs.FileSystem.from_uri(self.path)
        file = TokenFile(files, f"{folder}/{name}")
        # A part has the documents that begin in it; the boundaries of all documents but the last are their beginnings.
        first = file.bounds.first_at_least(k * PART_IDS)
        last = min(len(file), file.bounds.first_at_least((k + 1) * PART_IDS)) if k + 1 < parts else len(file)
        bounds, docs = file.bounds.values().astype(np.int64), file.docs.values()
        docs = (docs + np.uint64(file.foot["least"] & (1 << 64) - 1)).view(np.int64)
        while first < last:
            stop = max(first + 1, min(last, int(np.searchsorted(bounds, bounds[first] + BATCH_IDS, side="right")) - 1))
            ids, at = file.raw(int(bounds[first]), int(bounds[stop])), bounds[first : stop + 1]
            offsets = ((at - at[0]) * 4).astype(np.int64)
            nulls = min(max(0, file.foot["nulls"] - first), stop - first)
            own = docs[max(0, first - file.foot["nulls"]) : max(0, stop - file.foot["nulls"])]
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
            columns = [pa.array([None] * nulls + own.tolist(), pa.int64()), pa.array(at[:-1] + before), pa.array(np.diff(at)), blobs.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
            first = stop


class TokenFiles(DataSource):
    """``token_files``: reads a folder's manifest; writes rows of (id, ids as bytes of ``width`` each) in their order."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("token files are written once; choose a new folder")
        return _Writer(self.options["path"], int(self.options["width"]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write all in ascending order of ids."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    width = 2 if max(_vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text"), F.col("_at")]
    ordered = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")

    def make():
        own = LibraryWords.of(tokenizer)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x.astype(f"<u{width}").tobytes() + end for x in own.encode(batch.column("_text").to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return work

    docs.sparkSession.dataSource.register(TokenFiles)
    encoded = ordered.mapInArrow(over_slices("_text", make), "doc_id long, ids binary")
    encoded.write.format("token_files").option("width", width).mode("append").save(path)


def _vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a folder, ids as little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def op12_elias_fano_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/codeweft-token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
