"""The code index: files, chunks and vectors of a source tree, in a store that can be made anew at any time."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.predicates import is_denied, language_of
from kelpie.operators import chunkers
from kelpie.operators.embedding import Embedder, embed_missing
from kelpie.operators.joins import change_classes
from kelpie.sources.store import Store


def is_indexable(path: Column) -> Column:
    """Source in a known language that isn't a minified bundle."""
    return language_of(path).isNotNull() & ~F.element_at(F.split(path, "/"), -1).contains(".min.")


@dataclass(frozen=True)
class IndexStatus:
    """What an index holds."""

    exists: bool
    files: int = 0
    chunks: int = 0
    vectors: int = 0
    last_head: str | None = None


class CodeIndex:
    """The index of one repository, below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def exists(self) -> bool:
        return (Path(self.root) / "manifest.json").exists()

    def refresh(self, files: DataFrame, deny: list[str], head: str | None = None) -> DataFrame:
        """Brings the index up to files (path, mtime, size, content_hash, text), and gives how many files changed how.

        Only new and changed files are chunked; the chunks of the others stay, those of deleted files go.
        """
        wanted = files.where(is_indexable(F.col("path")) & ~is_denied(F.col("path"), deny) & F.col("text").isNotNull())
        store = Store(self.spark, self.root)
        known = "indexed_files" in store.manifest.tables
        before = store.table("indexed_files") if known else self.spark.createDataFrame([], "path string, mtime long, size long, content_hash string, language string")
        changes = change_classes(wanted, before, "path", "content_hash", "mtime")
        todo = wanted.join(changes.where(F.col("change").isin("new", "changed")), "path", "left_semi")
        located = todo.select(F.xxhash64("path").alias("file_id"), "path", "text", language_of(F.col("path")).alias("language"))
        fresh = chunkers.explode_chunks(located, "file_id", ["text", "language"], chunkers.code_chunks, "kind string, symbol string, first_line long, last_line long, body string")
        body = F.concat_ws("\n\n", "path", "body")  # path, blank line, body
        fresh = fresh.join(located.select("file_id", "path"), "file_id").withColumn("embed_text", body).drop("body")
        fresh = fresh.withColumn("content_hash", F.sha2(F.encode("embed_text", "UTF-8"), 256)).withColumn("chunk_id", F.xxhash64("path", "ord"))
        if known:
            kept = store.table("code_chunks").join(changes.where(F.col("change").isin("unchanged", "touched")), "path", "left_semi")
            fresh = kept.unionByName(fresh.select(*kept.columns))
        meta = self.spark.createDataFrame([("last_head", head)], "key string, value string")
        counted = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
        out = self.spark.createDataFrame(counted.collect(), counted.schema)  # five classes; the old tables go
        store.save({"indexed_files": wanted.select("path", "mtime", "size", "content_hash", language_of(F.col("path")).alias("language")), "code_chunks": fresh, "index_meta": meta})
        return out

    def embed(self, embedder: Embedder) -> int:
        """Embeds the chunks that lack a current vector, and drops the vectors of chunks that went; how many were embedded."""
        store = Store(self.spark, self.root)
        chunks = store.table("code_chunks")
        old = store.table("code_embeddings") if "code_embeddings" in store.manifest.tables else self.spark.createDataFrame([], "chunk_id long, content_hash string, vector array<float>")
        added = embed_missing(chunks, old, "chunk_id", "embed_text", embedder)
        current = old.join(chunks.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
        total = chunks.count() - current.count()
        store.save({"code_embeddings": current.select("chunk_id", "content_hash", "vector").unionByName(added)})
        return total

    def status(self) -> IndexStatus:
        """Counts and the commit the index was made at; an index that isn't there has none."""
        if not self.exists():
            return IndexStatus(False)
        store = Store(self.spark, self.root)
        count = lambda name: store.table(name).count() if name in store.manifest.tables else 0
        meta = store.table("index_meta").where("key = 'last_head'").first() if "index_meta" in store.manifest.tables else None
        return IndexStatus(True, count("indexed_files"), count("code_chunks"), count("code_embeddings"), meta and meta["value"])

    def remove(self) -> bool:
        """Deletes the index, which can be made again; whether there was one."""
        if not self.exists():
            return False
        Store(self.spark, self.root).remove()
        return True
