"""Embedding of texts behind an interface, and vectors as bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 16  # texts given to a model at once, which bounds its memory


class Embedder(Protocol):
    """Embeds texts in order; made on the driver and sent to the executors, which load its model once."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """A stand-in where no model is at hand: words hashed with a sign into so many dimensions, of length 1.

    Texts without words have the zero vector. Its cosines are no model's cosines.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[code % self.dimension] += 1 if code >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(length > 0, out / np.maximum(length, 1e-12), out)


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, vector) of texts, `BATCH` at a time; a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch[text]]
            parts = [embedder.embed(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            yield pd.DataFrame({key: batch[key], "vector": [v for part in parts for v in part]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def embed_missing(rows: DataFrame, stored: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, content_hash, vector) for the rows whose text isn't stored with its hash: each text is embedded once, however many rows have it."""
    hashed = rows.select(key, text, F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256).alias("content_hash"))
    todo = hashed.join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")
    distinct = todo.groupBy("content_hash").agg(F.max(text).alias(text))
    return todo.select(key, "content_hash").join(embed(distinct, "content_hash", text, embedder), "content_hash").select(key, "content_hash", "vector")


def with_bytes(rows: DataFrame, vector: str, out: str = "blob") -> DataFrame:
    """`rows` with the vector as little-endian 32-bit floats; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blobs, pa.binary())], names=[*batch.schema.names, out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {out} binary")


def with_vector(rows: DataFrame, blob: str, out: str = "vector") -> DataFrame:
    """`rows` with the floats of a blob; what is left over at its end, as in a damaged one, is ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4").tolist() for b in batch.column(blob).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {out} array<float>")
