import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import rerank, review

PENDING = "id long, kind string, payload_json string, rationale string, status string, actor string, created_at timestamp, reviewed_at timestamp"
FACTS = "id long, key string, value string, source string, superseded_by long"


def now():
    return F.lit(dt.datetime(2026, 1, 2))


def test_propose_and_accept(spark):
    empty = spark.createDataFrame([], PENDING)
    given = [(3, "fact", "k", "v", None, None, "why", "agent:x"), (1, "decision", None, None, "T", "global", "why", "user"), (2, "fact", "k", " ", None, None, "why", "user"), (4, "note", "k", "v", "T", None, "why", "user"), (5, "fact", "z", "1", None, None, "", "user")]
    queue = review.propose(empty, spark.createDataFrame(given, "seq long, kind string, key string, value string, title string, target string, rationale string, actor string"), now())
    assert rows(queue, "id", "kind", "payload_json", "status") == [(1, "decision", '{"title":"T","target":"global"}', "pending"), (2, "fact", '{"key":"k","value":"v"}', "pending")]
    more = review.propose(queue, spark.createDataFrame([(9, "fact", "k2", "w", None, None, "why", "user")], "seq long, kind string, key string, value string, title string, target string, rationale string, actor string"), now())
    assert max(r["id"] for r in more.collect()) == 3
    facts = spark.createDataFrame([(5, "other", "x", "user", None)], FACTS)
    done = review.accept(facts, more, more.select("id"), now())
    assert rows(done.facts) == [(5, "other", "x", "user", None), (6, "k", "v", "user+agent:x", None), (7, "k2", "w", "user", None)]
    assert rows(done.pending, "id", "status") == [(1, "pending"), (2, "accepted"), (3, "accepted")]
    assert rows(done.log, "row_id", "action") == [(2, "accept"), (3, "accept")]


def test_conflicts(spark):
    facts = spark.createDataFrame([(1, "a", "old", "user", None), (2, "gone", "x", "user", 1)], FACTS)
    payload = lambda k, v: f'{{"key": "{k}", "value": "{v}"}}'
    given = [payload("a", "new"), payload("a", "old"), payload("gone", "y"), payload("b", "1"), payload("b", "2"), payload("b", "1"), "{", '{"key": "c"}', None]
    queue = spark.createDataFrame([(i, "fact", p, "why", "accepted" if i == 99 else "pending", "user", None, None) for i, p in enumerate([*given], 10)] + [(99, "fact", payload("d", "1"), "w", "accepted", "user", None, None)], PENDING)
    done = review.accept(facts, queue, queue.select("id").union(queue.select("id")), now())
    assert [r["outcome"] for r in done.outcomes.orderBy("id").collect()] == ["conflict", "accepted", "accepted", "accepted", "conflict", "accepted", "invalid", "invalid", "invalid", "not_pending"]
    assert rows(done.outcomes.where("conflict_id is not null"), "id", "conflict_id") == [(10, 1)]
    assert rows(done.facts, "key", "value") == [("a", "old"), ("b", "1"), ("gone", "x"), ("gone", "y")]
    forced = review.accept(facts, queue, queue.select("id"), now(), force=True)
    assert rows(forced.facts.where("superseded_by is null"), "key", "value") == [("a", "new" if False else "old"), ("b", "1"), ("gone", "y")]  # the last proposal of a key wins
    near = spark.createDataFrame([(13, 1)], "query_id long, id long")
    assert rows(review.accept(facts, queue, queue.select("id"), now(), semantic=near).outcomes.where("id = 13"), "outcome", "conflict_id") == [("conflict", 1)]
    nothing = review.accept(facts.limit(0), queue.limit(0), queue.select("id").limit(0), now())
    assert nothing.facts.count() == nothing.pending.count() == nothing.outcomes.count() == 0


def test_probe(spark):
    existing = spark.createDataFrame([(1, "a", "red fox"), (2, "b", "red hot fox"), (3, "c", None), (4, "d", "red fox")], "id long, key string, text string")
    incoming = spark.createDataFrame([(7, "d", "red fox"), (8, "e", "blue sky"), (9, None, None), (10, "a", "")], "query_id long, key string, text string")
    assert rows(review.probe(incoming, existing, rerank.LexicalOverlap(), threshold=1.0)) == [(7, 2, 1.0)]
    assert rows(review.probe(incoming, existing, rerank.LexicalOverlap(), threshold=1.0, newest=1)) == []
