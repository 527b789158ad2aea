"""Reranking of a pool: a scorer per executor, a floor, and the order by its scores alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Scores (query, text) pairs; greater is better. Made on the driver, sent to the executors."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class LexicalOverlap:
    """A stand-in for a cross-encoder where no model is at hand: the share of query words in the text.

    Its scores are no logits, so floors made for a model don't apply to it.
    """

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for query, text in zip(queries, texts):
            asked, held = set(query.lower().split()), set((text or "").lower().split())
            out.append(len(asked & held) / len(asked) if asked else 0.0)
        return out


def reranked(pool: DataFrame, scorer: Scorer, floor: float | None = None) -> DataFrame:
    """The pool (query_id, query, id, title, body) with `rerank`, best first.

    A query with a single candidate isn't reranked, so the floor can't drop it: its score is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [f"{t or ''}\n\n{b or ''}" for t, b in zip(batch["title"], batch["body"])]
            scores = scorer.score(list(batch["query"]), texts)
            yield pd.DataFrame({"query_id": batch["query_id"], "id": batch["id"], "lone": batch["lone"], "rerank": scores})

    counted = pool.withColumn("lone", F.count(F.lit(1)).over(Window.partitionBy("query_id")) == 1)  # a pool is small
    scored = counted.select("query_id", "query", "id", "title", "body", "lone").mapInPandas(run, "query_id long, id long, lone boolean, rerank double")
    scored = scored.withColumn("rerank", F.when(~F.col("lone"), F.col("rerank")))
    kept = scored if floor is None else scored.where(F.col("rerank").isNull() | (F.col("rerank") >= floor))
    return kept.orderBy("query_id", F.desc_nulls_last("rerank"), "id").select("query_id", "id", "rerank")
