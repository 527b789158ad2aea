"""Review of proposals: propose, probe for contradictions, accept. Batches of any size; one writer publishes the result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.lifecycle import upsert
from kelpie.operators.rerank import Scorer
from kelpie.operators.series import so_far

PROBE_THRESHOLD = 2.0  # from this rerank score an existing row contradicts; made for a model's logits
PROBE_NEWEST = 200  # existing rows that are scored


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def is_proposable(kind: Column, key: Column, value: Column, title: Column, rationale: Column) -> Column:
    """Whether a proposal has what its kind needs: a fact key and value, a decision a title, both a rationale."""
    needs = F.when(kind == "fact", ~_blank(key) & ~_blank(value)).when(kind == "decision", ~_blank(title)).otherwise(F.lit(False))
    return F.coalesce(needs & ~_blank(rationale), F.lit(False))


def numbered_after(rows: DataFrame, order: str, taken: DataFrame, out: str = "id") -> DataFrame:
    """`rows` numbered in their order from the number after the greatest id of `taken`; nothing is sorted in one place."""
    last = taken.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    counted = so_far(rows.withColumn("_all", F.lit(0)), "_all", [F.col(order)], {"_n": ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(out, F.lit(last).cast("long") + F.col("_n")).drop("_all", "_n")


def propose(pending: DataFrame, proposals: DataFrame, at: Column) -> DataFrame:
    """Appends proposals (seq, kind, key, value, title, target, rationale, actor) that are complete to the queue.

    The payload is JSON of the fields that are given; `target` global sends the accepted row to the
    machine's store. Incomplete proposals are left out.
    """
    good = proposals.where(is_proposable(F.col("kind"), F.col("key"), F.col("value"), F.col("title"), F.col("rationale")))
    of_fact = F.struct(F.col("key"), F.col("value"), F.col("target"))
    payload = F.when(F.col("kind") == "fact", F.to_json(of_fact)).otherwise(F.to_json(F.struct(F.col("title"), F.col("target"))))
    rows = numbered_after(good, "seq", pending).select(
        "id", "kind", payload.alias("payload_json"), F.trim("rationale").alias("rationale"), F.lit("pending").alias("status"), "actor", at.alias("created_at"), F.lit(None).cast("timestamp").alias("reviewed_at")
    )
    return pending.unionByName(rows.select(*pending.columns))


def probe(incoming: DataFrame, existing: DataFrame, scorer: Scorer, threshold: float = PROBE_THRESHOLD, newest: int = PROBE_NEWEST) -> DataFrame:
    """(query_id, id, score): for each incoming text (query_id, key, text) the best of the newest existing rows
    (id, key, text), if it scores at least the threshold.

    A row of the same key is no candidate, as keys are compared exactly. `newest` bounds what is sent.
    """
    rows = existing.orderBy(F.desc("id")).limit(newest).select("id", "key", "text").collect()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query_id, key, text in zip(batch["query_id"], batch["key"], batch["text"]):
                others = [r for r in rows if key is None or r["key"] != key]
                scores = scorer.score([text] * len(others), [r["text"] for r in others]) if others and text else []
                if len(scores):
                    best = max(range(len(others)), key=lambda i: (scores[i], others[i]["id"]))
                    if scores[best] >= threshold:
                        out.append((query_id, others[best]["id"], float(scores[best])))
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return incoming.select("query_id", "key", "text").mapInPandas(run, "query_id long, id long, score double")


@dataclass
class Accepted:
    """The tables as they will be: save them together, so that all of it or nothing is published."""

    facts: DataFrame
    pending: DataFrame
    log: DataFrame
    outcomes: DataFrame  # id, outcome (accepted, conflict, invalid, not_pending), conflict_id


def derived_source(actor: Column) -> Column:
    """Who a row counts as written by when a person accepted it."""
    return F.when(actor == "user", "user").otherwise(F.concat(F.lit("user+agent:"), F.regexp_replace(actor, "^agent:", "")))


def accept(facts: DataFrame, pending: DataFrame, wanted: DataFrame, at: Column, force: bool = False, semantic: DataFrame | None = None) -> Accepted:
    """Accepts proposed facts of the queue, in the order of their ids.

    A proposal whose key exists with another value, or was given another value by an earlier proposal,
    is a conflict and stays pending; so is one that `semantic` (query_id, id: see `probe`) names.
    `force` takes all, the last value wins. Payloads that are no JSON or lack a field are invalid.
    """
    chosen = pending.join(wanted.select("id").distinct(), "id", "left_semi").where("kind = 'fact'")
    sound = F.try_parse_json("payload_json").isNotNull()
    read = chosen.select(
        "id", "status", "actor", *[F.when(sound, F.get_json_object("payload_json", f"$.{c}")).alias(c) for c in ("key", "value")]
    ).withColumn("_fit", (F.col("status") == "pending") & F.col("key").isNotNull() & F.col("value").isNotNull())
    current = facts.where("superseded_by is null").groupBy("key").agg(F.max("id").alias("_fact"), F.max_by("value", "id").alias("_old"))
    first = read.where("_fit").groupBy("key").agg(F.min_by("value", "id").alias("_first"))
    judged = read.join(current, "key", "left").join(first, "key", "left")
    if semantic is not None:
        judged = judged.join(semantic.select(F.col("query_id").alias("id"), F.col("id").alias("_near")).dropDuplicates(["id"]), "id", "left")
    else:
        judged = judged.withColumn("_near", F.lit(None).cast("long"))
    same = F.lit(force) | ((F.col("value") == F.coalesce("_old", "_first")) & F.col("_near").isNull())
    outcome = F.when(F.col("status") != "pending", "not_pending").when(~F.col("_fit"), "invalid").when(same, "accepted").otherwise("conflict")
    judged = judged.withColumn("outcome", outcome)
    taken = judged.where("outcome = 'accepted'")
    written = taken.groupBy("key").agg(F.max_by("value", "id").alias("value"), F.max_by("actor", "id").alias("actor"), F.min("id").alias("seq"), F.max("_fact").alias("_fact"))
    fresh = numbered_after(written.where("_fact is null"), "seq", facts)
    kept = written.where("_fact is not null").withColumn("id", F.col("_fact"))
    rows = fresh.unionByName(kept.select(*fresh.columns)).select(
        "id", "key", "value", derived_source(F.col("actor")).alias("source"), F.lit(None).cast("long").alias("superseded_by")
    )
    marks = taken.select("id", F.lit(True).alias("_taken"))
    queue = pending.join(marks, "id", "left").withColumns(
        {"status": F.when(F.col("_taken"), "accepted").otherwise(F.col("status")), "reviewed_at": F.when(F.col("_taken"), at).otherwise(F.col("reviewed_at"))}
    )
    log = taken.select(F.col("id").alias("row_id"), F.lit("pending_writes").alias("table_name"), F.lit("accept").alias("action"), at.alias("at"))
    outcomes = judged.select("id", "outcome", F.when(F.col("outcome") == "conflict", F.coalesce("_fact", "_near")).alias("conflict_id"))
    return Accepted(upsert(facts.select(*rows.columns), rows, ["id"]), queue.select(*pending.columns), log, outcomes)
