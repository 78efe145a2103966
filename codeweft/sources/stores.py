"""Where graphs, vectors and scan records live between runs: Parquet tables that change in commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.retrieval import upsert
from codeweft.operators.snapshot import delete_files, latest, upsert_files

SCANS = "scan_id string, project string, mode string, status string, started_at timestamp, finished_at timestamp, branch string, commit string, files long, added long, modified long, deleted long, scanner_version string"
FILES = "relative_path string, kind string, size_bytes long, sha256 string, lines int, scan_id string, scanner_version string, updated_at timestamp"
EVENTS = "event_id string, scan_id string, ts timestamp, level string, stage string, message string, path string"
ARTIFACTS = "scan_id string, path string, kind string, size_bytes long, created_at timestamp"


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; nothing of this one is visible."""


class Committed:
    """Tables that change together. The state is what the newest mark ``commit-N`` says: for each table, its folders.

    Every writer writes folders of its own, named by a random id, and then takes the mark after the one it started from.
    A mark appears whole and only if it is not there yet (a rename that refuses to replace; atomic on HDFS and the like),
    so of two writers one wins and the other changes nothing, and readers never see tables of different commits.
    Marks are never deleted, so a number is never taken twice; folders are, once neither of the two newest marks names them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str = ""):
        return self._hadoop().Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        files = self._files()
        found = files.listStatus(self._path()) if files.exists(self._path()) else []
        return [n for n in (f.getPath().getName() for f in found) if n.startswith(prefix)]

    def newest(self) -> int:
        """The number of the newest commit; -1 before the first."""
        return max((int(n.removeprefix("commit-")) for n in self._names("commit-")), default=-1)

    def state(self, number: int | None = None) -> dict[str, list[str]]:
        """The folders of each table at a commit."""
        number = self.newest() if number is None else number
        if number < 0:
            return {}
        stream = self._files().open(self._path(f"commit-{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, *tables: str, at: int | None = None) -> list[DataFrame]:
        """Several tables of one commit, the newest or ``at``."""
        state = self.state(at)
        missing = [t for t in tables if t not in state]
        if missing:
            raise FileNotFoundError(f"{self.path}: {', '.join(missing)}")
        return [self.spark.read.parquet(*[f"{self.path}/{f}" for f in state[t]]) for t in tables]

    def _written(self, tables: dict[str, DataFrame]) -> dict[str, list[str]]:
        folders = {}
        for name, df in tables.items():
            folders[name] = [f"data-{name}-{uuid.uuid4().hex}"]
            df.write.parquet(f"{self.path}/{folders[name][0]}")
        return folders

    def _mark(self, number: int, state: dict[str, list[str]]) -> bool:
        """Take a mark; false if another writer has it."""
        jvm, files = self.spark._jvm, self._files()
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = getattr(self._hadoop(), "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        where = files.makeQualified(self._path(f"commit-{number}"))
        try:
            self._hadoop().FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), where, how)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _delete(self, folders: list[str]) -> None:
        for f in folders:
            self._files().delete(self._path(f), True)

    def commit(self, base: int | None = None, **tables: DataFrame) -> int:
        """Replace tables, all at once; others stay. ``base`` is the commit that they were made from, else the newest now."""
        base = self.newest() if base is None else base
        folders = self._written(tables)
        before = self.state(base)
        if not self._mark(base + 1, before | folders):
            self._delete([f for own in folders.values() for f in own])
            raise ConcurrentCommit(f"{self.path}: commit {base + 1} is another writer's")
        self._expire(base)
        return base + 1

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table without rewriting it; appends never exclude one another."""
        own = self._written({name: df})[name]
        while True:
            base = self.newest()
            before = self.state(base)
            if self._mark(base + 1, before | {name: before.get(name, []) + own}):
                return self._expire(base)

    def _expire(self, last: int) -> None:
        """Delete folders that the commit before ``last`` names and later ones do not: no reader can start on them."""
        if last > 0:
            kept = {f for k in (last, last + 1) for own in self.state(k).values() for f in own}
            self._delete([f for own in self.state(last - 1).values() for f in own if f not in kept])


class Versioned:
    """One table of a commit log, by itself."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, name: str = "rows", log: Committed | None = None) -> None:
        self.spark, self.schema, self.name = spark, schema, name
        self.log = log or Committed(spark, path)

    def read(self, at: int | None = None) -> DataFrame:
        at = self.log.newest() if at is None else at
        if self.schema is not None and self.name not in self.log.state(at):
            return self.spark.createDataFrame([], self.schema)
        return self.log.read(self.name, at=at)[0]

    def update(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows by what ``change`` makes of them; fails if another writer comes between."""
        base = self.log.newest()
        self.log.commit(base, **{self.name: change(self.read(base))})

    def replace(self, df: DataFrame) -> None:
        self.log.commit(**{self.name: df})

    def append(self, df: DataFrame) -> None:
        self.log.append(self.name, df)

    def clear(self) -> None:
        self.update(lambda df: df.limit(0))


class GraphStore:
    """Nodes and edges, and whatever is made from them; replaced in one commit, exported in order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = Committed(spark, path)

    def replace(self, nodes: DataFrame, edges: DataFrame, base: int | None = None, **more: DataFrame) -> None:
        self.log.commit(base, nodes=nodes, edges=edges, **more)

    def read(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.log.read("nodes", "edges")
        return nodes, edges

    def clear(self) -> None:
        base = self.log.newest()
        nodes, edges = self.log.read("nodes", "edges", at=base)
        self.replace(nodes.limit(0), edges.limit(0), base)

    def summary(self) -> DataFrame:
        """``nodes, edges`` of the newest commit, counted together."""
        nodes, edges = self.read()
        return nodes.agg(F.count("*").alias("nodes")).withColumn("edges", edges.agg(F.count("*").alias("n")).scalar())

    def export_json(self, path: str) -> DataFrame:
        """JSON lines, nodes by id and edges by (type, src, dst); the order runs through the part files. Returns the summary."""
        nodes, edges = self.read()
        nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes")
        edges.orderBy("type", "src", "dst").write.mode("overwrite").json(f"{path}/edges")
        return self.summary()


class VectorStore:
    """Vectors by chunk id, with the name and size of the embedding that made them."""

    def __init__(self, spark: SparkSession, path: str, embedding: str, dim: int, log: Committed | None = None) -> None:
        self.table = Versioned(spark, path, "id string, text_hash string, vector array<double>, embedding string, dim int", "vectors", log)
        self.embedding, self.dim = embedding, dim

    def read(self, at: int | None = None) -> DataFrame:
        """Vectors that this embedding can reuse; those of another one do not count."""
        return self.table.read(at).where((F.col("embedding") == self.embedding) & (F.col("dim") == self.dim))

    def rows(self, vectors: DataFrame) -> DataFrame:
        """Vectors as they are stored."""
        return vectors.select("id", "text_hash", "vector", F.lit(self.embedding).alias("embedding"), F.lit(self.dim).alias("dim"))

    def upsert(self, vectors: DataFrame) -> None:
        self.table.update(lambda old: upsert(old, self.rows(vectors)))

    def prune_to(self, ids: DataFrame) -> None:
        self.table.update(lambda old: old.join(ids.select("id"), "id", "left_semi"))


class Metadata:
    """Scans, files, events and artifacts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.log = Committed(spark, path)
        self.scans, self.files = Versioned(spark, path, SCANS, "scans", self.log), Versioned(spark, path, FILES, "files", self.log)
        self.events, self.artifacts = Versioned(spark, path, EVENTS, "events", self.log), Versioned(spark, path, ARTIFACTS, "artifacts", self.log)

    def start_scan(self, scan_id: str, project: str, mode: str, scanner_version: str = "1") -> None:
        row = self.spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(project).alias("project"), F.lit(mode).alias("mode"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"), F.lit(scanner_version).alias("scanner_version"))
        self.scans.update(lambda old: old.unionByName(row, allowMissingColumns=True))

    def finish_scan(self, scan_id: str, status: str, branch: str | None = None, commit: str | None = None, **counts: int) -> None:
        own = F.col("scan_id") == scan_id
        named = {k: F.lit(v) for k, v in (("branch", branch), ("commit", commit)) if v is not None}
        new = {**named, "status": F.lit(status), "finished_at": F.current_timestamp(), **{k: F.lit(v).cast("long") for k, v in counts.items()}}
        self.scans.update(lambda old: old.withColumns({k: F.when(own, v).otherwise(F.col(k)) for k, v in new.items()}))

    def record_event(self, scan_id: str, level: str, stage: str, message: str, path: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(message).alias("message"), F.lit(path).cast("string").alias("path"))
        self.record_events(scan_id, level, stage, row)

    def record_events(self, scan_id: str, level: str, stage: str, found: DataFrame) -> None:
        """One event for each row of found(message, path), in one append."""
        rows = found.select(F.uuid().alias("event_id"), F.lit(scan_id).alias("scan_id"), F.current_timestamp().alias("ts"), F.lit(level).alias("level"), F.lit(stage).alias("stage"), "message", "path")
        self.events.append(rows)

    def record_artifact(self, scan_id: str, path: str, kind: str, size_bytes: int) -> None:
        """One row for each scan and path; a second call replaces it."""
        row = self.spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(size_bytes).cast("long").alias("size_bytes"), F.current_timestamp().alias("created_at"))
        self.artifacts.update(lambda old: old.where((F.col("scan_id") != scan_id) | (F.col("path") != path)).unionByName(row))

    def upsert_files(self, files: DataFrame, scan_id: str, scanner_version: str = "1") -> None:
        new = files.select("relative_path", "kind", "size_bytes", "sha256", "lines", F.lit(scan_id).alias("scan_id"), F.lit(scanner_version).alias("scanner_version"), F.current_timestamp().alias("updated_at"))
        self.files.update(lambda old: upsert_files(old, new))

    def delete_files(self, paths: DataFrame) -> None:
        self.files.update(lambda old: delete_files(old, paths))

    def known_hashes(self) -> DataFrame:
        return self.files.read().select("relative_path", "sha256")

    def latest_scan(self) -> DataFrame:
        return latest(self.scans.read())

    def summary(self) -> DataFrame:
        """Numbers of scans and files, and the last scan's id."""
        files = self.files.read().agg(F.count("*").alias("n"))
        last = self.latest_scan().select("scan_id")
        return self.scans.read().agg(F.count("*").alias("scans")).select("scans", files.scalar().alias("files"), last.scalar().alias("last_scan"))
