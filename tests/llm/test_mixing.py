from conftest import rows

from kelpie.llm import mixing, tokens

TARGETS = "mix_id long, source string, target_share double, max_repeats long, size_share double"


def docs(spark, n=2000):
    return spark.range(n).selectExpr("id as doc_id", "case when id % 10 = 0 then 'b' else 'a' end as source", "20 + id % 37 as n_tokens", "'clash' as copies")


def test_shares_and_caps(spark):
    d = docs(spark)
    targets = spark.createDataFrame([(1, "a", 0.5, 1, 0.5), (1, "b", 0.5, 4, 0.5), (2, "a", 0.1, 2, 2.0), (2, "b", 0.9, 3, 2.0), (3, "a", 1.0, 1, 0.0), (1, "a", 0.5, 1, 0.5)], TARGETS)
    mixed = mixing.mixtures(d, targets).cache()
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    shares = {(r["mix_id"], r["source"]): r for r in mixing.mixture_shares(d, targets, mixed).collect()}
    for r in shares.values():
        assert r["most_copies"] is None or r["most_copies"] <= r["max_repeats"]
        if not r["short"]:
            assert abs(r["mixed_tokens"] - r["wanted_tokens"]) <= 57 / 2 + 1
    assert shares[2, "b"]["short"] and shares[2, "b"]["mixed_tokens"] == 3 * d.where("source = 'b'").agg({"n_tokens": "sum"}).first()[0]
    assert shares[3, "a"]["mixed_tokens"] == 0 and shares[3, "a"]["actual_share"] is None
    assert rows(mixing.unmet(d, targets)) == [(2, "b")]
    assert rows(mixing.mixtures(d, targets)) == rows(mixed)


def test_edges(spark):
    d = spark.createDataFrame([(1, "a", 10), (2, None, 5), (3, "a", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 1.0), (1, "none", 0.5, 9, 1.0), (1, "zero", 0.0, 1, 1.0), (2, None, 0.5, 1, 1.0), (3, "a", None, None, 1.0)], TARGETS)
    assert rows(mixing.unmet(d, targets), "mix_id", "source") == [(1, "a"), (1, "none"), (2, None)]
    assert rows(mixing.mixtures(d, targets), "mix_id", "doc_id", "copies") == [(1, 1, 1), (1, 3, 1)]
    assert mixing.mixtures(d.limit(0), targets).count() == 0 and mixing.unmet(d, targets.limit(0)).count() == 0


def test_found_goes_through_the_mixture(spark):
    d = spark.createDataFrame([(1, "a", 10), (2, None, 5), (3, "a", 0), (4, "b", 7)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 1.0), (1, "none", 0.5, 9, 1.0), (1, "b", 0.1, 1, 1.0), (2, None, 0.5, 1, 1.0), (3, "a", None, None, 1.0), (4, "b", 1.0, 2, 0.5)], TARGETS)
    found = mixing.unmet_by_mixture(d, targets)
    assert rows(found) == rows(mixing.unmet(d, targets)) and len(rows(found)) == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "_key" in plan  # steps of the rank key are summed


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 50_000)], "doc_id long, text string")
    counts = dict(rows(tokens.with_token_counts(df, "text", ["doc_id"])))
    assert counts[1] == 2 and counts[2] == counts[3] == 0 and counts[4] > 1 and counts[5] > 1000
