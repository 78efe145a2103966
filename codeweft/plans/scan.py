"""One scan of a source tree: inventory, differences, graph, vectors and records, joined end to end."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.embedding import DIM, hashing_embedding
from codeweft.functions.text import decoded
from codeweft.operators import frameworks, graph, incremental, indexes, reports, retrieval
from codeweft.operators.wholegraph import whole_graph
from codeweft.operators.javagraph import JavaTables
from codeweft.operators.snapshot import snapshot_diff
from codeweft.sources import config, files, git, java, tree
from codeweft.sources.stores import GraphStore, Metadata, VectorStore
from codeweft.storage import materialize


@dataclass
class Scan:
    """What a scan found; the tables are read from the store."""

    scan_id: str
    changes: DataFrame
    warnings: DataFrame
    vectors: dict[str, int]
    reread: dict[str, int]


class Project:
    """A source tree and the folder that keeps its graph, vectors and records.

    What a scan finds (nodes, edges, chunks, vectors) becomes visible in one commit; file records follow it, so
    a scan that fails leaves the old state and the next one sees the same changes again.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, embed=hashing_embedding, embedding: str = "hashing", dim: int = DIM) -> None:
        self.spark, self.root, self.embed = spark, root, embed
        self.graph, self.metadata = GraphStore(spark, f"{store}/graph"), Metadata(spark, f"{store}/metadata")
        self.vectors = VectorStore(spark, f"{store}/graph", embedding, dim, self.graph.log)

    def scan(self, mode: str = "incremental") -> Scan:
        """Read the tree, record what changed, patch the graph, embed only texts that have no vector yet.

        Only changed files are parsed, and only what can resolve otherwise is resolved again. With mode ``full`` every file is
        parsed and every text is embedded anew. Files that cannot be read and folders that cannot be listed are warnings.
        """
        spark, own, base = self.spark, str(uuid.uuid4()), self.graph.log.newest()
        where = git.head(self.root) if self.root.startswith("/") else {"branch": None, "commit": None}
        self.metadata.start_scan(own, self.root.rstrip("/").rpartition("/")[2], mode)
        try:
            tree_rows = materialize(tree.scan_tree(spark, self.root), "tree")
            found = tree_rows.where("warning IS NULL").drop("warning")
            warnings = tree_rows.where("warning IS NOT NULL").select("relative_path", "size_bytes", "warning").orderBy("relative_path")
            inventory = materialize(files.inventory(found), "inventory")
            changes = materialize(snapshot_diff(inventory, self.metadata.known_hashes()), "changes")

            parsed, reread, known = self._analysed(found, changes, base if mode != "full" else -1)
            nodes, edges = whole_graph(parsed, found, known)
            nodes = materialize(nodes, "scan-nodes")
            chunks = materialize(frameworks.chunks(nodes, found), "scan-chunks")
            vectors, counts = self.vectors_of(chunks, mode == "full")
            vectors = materialize(vectors, "scan-vectors")
            index = self.index_of(chunks, nodes, vectors)
            self.graph.replace(nodes, edges, base, chunks=chunks, vectors=vectors, inventory=inventory, **incremental.state(parsed), **index)
            self.metadata.upsert_files(inventory, own)
            self.metadata.delete_files(changes.where("change = 'deleted'"))
            self.metadata.record_artifact(own, f"{self.graph.log.path}/commit-{base + 1}", "graph", 0)

            failed = parsed.files.where("status <> 'success'").select(F.col("status").alias("message"), F.col("relative_path").alias("path"))
            self.metadata.record_events(own, "warning", "inventory", warnings.select(F.col("warning").alias("message"), F.col("relative_path").alias("path")))
            self.metadata.record_events(own, "warning", "parse", failed)
            by = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
            done = {"files": sum(n for c, n in by.items() if c != "deleted"), **{k: by.get(k, 0) for k in ("added", "modified", "deleted")}}
            self.metadata.finish_scan(own, "partial" if not warnings.isEmpty() else "success", where.get("branch"), where.get("commit"), **done)
        except Exception as e:
            self.metadata.record_event(own, "error", "scan", str(e)[:500])
            self.metadata.finish_scan(own, "failed")
            raise
        return Scan(own, changes, warnings, counts, reread)

    def _analysed(self, found: DataFrame, changes: DataFrame, base: int) -> tuple[JavaTables, dict[str, int], DataFrame | None]:
        """(Java tables, numbers of files read again, statements known): patched if the store holds an analysis, else made anew."""
        sources = found.where(F.col("relative_path").endswith(".java"))
        if base < 0 or not set(incremental.TABLES) <= set(self.graph.log.state(base)):
            tables = JavaTables(java.parse_files(sources))
            n = tables.files.count()
            return tables, {"parsed": n, "resolved": n, "linked": n}, None
        before = dict(zip(incremental.TABLES, self.graph.log.read(*incremental.TABLES, at=base), strict=True))
        touched = changes.where("change <> 'unchanged'").select("relative_path")
        parsed = java.parse_files(sources.join(touched, "relative_path", "left_semi"))
        tables, numbers = incremental.patched(before, parsed, touched.select(F.col("relative_path").alias("file")))
        (nodes,) = self.graph.log.read("nodes", at=base)
        return tables, numbers, nodes.where("kind = 'SQLStatement'").select("id", "statement_type", "tables_read", "tables_written", "parsed_ok")

    def vectors_of(self, chunks: DataFrame, anew: bool = False) -> tuple[DataFrame, dict[str, int]]:
        """(vectors to keep, numbers): one for each chunk, reused by text, the rest embedded; vanished chunks are pruned."""
        old = self.vectors.read()
        pruned = old.join(chunks.select("id"), "id", "left_anti").count()
        known = old.select("text_hash", "vector")
        found = materialize(retrieval.incremental_vectors(chunks.select("id", "text"), known.limit(0) if anew else known, self.embed), "vectors")
        count = found.agg(F.count("*").alias("chunks"), F.count_if(~F.col("reused")).alias("embedded"), F.count_if("reused").alias("reused")).first()
        return self.vectors.rows(found), {**count.asDict(), "pruned": pruned}

    def index_of(self, chunks: DataFrame, nodes: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
        """The tables of all indexes, by node id."""
        of_nodes = vectors.join(chunks.select("id", "node_id"), "id").select(F.col("node_id").alias("id"), "vector")
        texts = chunks.select(F.col("node_id").alias("id"), "text")
        return indexes.vector_index(of_nodes, self.vectors.dim) | indexes.text_index(texts) | indexes.name_index(nodes)

    def search(self, queries: DataFrame, k: int = 10, kind: str | None = None) -> DataFrame:
        """Hybrid retrieval of queries(query_id, query) over the stored graph, chunks and indexes."""
        at = self.graph.log.newest()
        nodes, edges, chunks = self.graph.log.read("nodes", "edges", "chunks", at=at)
        index = dict(zip(indexes.TABLES, self.graph.log.read(*indexes.TABLES, at=at), strict=True))
        vectors = self.vectors.read(at).join(chunks.select("id", "node_id"), "id").select("node_id", "vector")
        asked = queries.select("query_id", self.embed(F.col("query")).alias("query_vector"))
        return retrieval.hybrid_retrieve(chunks, vectors, nodes, edges, queries, asked, k, kind=kind, index=index)

    def impact_of_diff(self, ref: str = "HEAD") -> DataFrame:
        """``what, id`` of what the changes since a git ref touch; see :func:`reports.change_impact`.

        Where git has no answer, one row ``unavailable`` with its message.
        """
        nodes, edges = self.graph.read()
        try:
            changed = git.diff_rows(self.spark, git.read_diff(self.root, ref, "*.java"))
        except git.GitUnavailable as e:
            return self.spark.createDataFrame([("unavailable", str(e))], "what string, id string")
        return reports.change_impact(nodes, edges, materialize(git.hunks(changed), "hunks"))

    def configuration(self, markers: list[str] | None = None) -> DataFrame:
        """Configuration rows of the tree, secrets redacted."""
        kinds: Column = F.lower("relative_path").rlike(r"\.(ya?ml|properties)$")
        found = files.read_tree(self.spark, self.root).where(kinds)
        return config.config_rows(found.select("relative_path", decoded("content").alias("text")), markers)

    def statistics(self) -> DataFrame:
        nodes, edges = self.graph.read()
        return graph.graph_counts(nodes, edges)
