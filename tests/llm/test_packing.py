import itertools
import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import packing
from pyspark.sql import functions as F


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(1, 30))
def test_fill_is_closest(counts, room):
    chosen = packing.fill(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    best = max((s for s in (sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*[range(c + 1) for c in counts.values()])) if s <= room), default=0)
    assert sum(k * n for k, n in chosen.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=12))
def test_plan_places_every_item_once(counts):
    plan = packing.plan_containers(counts, 40)
    used, load = dict.fromkeys(counts, 0), {}
    for length in counts:
        ranges = sorted(r[1:] for r in plan.ranges if r[0] == length)
        ends = [r[0] for r in ranges[1:]] + [counts[length]]
        for (start, first, each), end in zip(ranges, ends):
            assert start == used[length]
            for n in range(start, end):
                box = first + (n - start) // each
                load[box] = load.get(box, 0) + length
            used[length] = end
    assert used == counts and max(load.values()) <= 40 and set(load) == set(range(plan.containers))


def test_pack(spark):
    random.seed(6)
    lengths = [random.choice([5, 5, 5, 7, 30, 100, 101, 250, 0]) for _ in range(600)] + [None]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long").withColumn("container_id", F.lit("clash"))
    out = packing.pack(df, 100).collect()
    load, pieces = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["piece_size"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    for i, n in enumerate(lengths):
        mine = sorted(pieces[i], key=lambda r: r["piece_no"])
        assert sum(r["piece_size"] for r in mine) == (n or 0) and len(mine) == max(1, -(-(n or 0) // 100)) == mine[0]["n_pieces"]
        assert [r["start_at"] for r in mine] == [100 * k for k in range(len(mine))]
    total = sum(n or 0 for n in lengths)
    assert len(load) <= -(-total // 100) + 1
    assert rows(packing.oversized(packing.pack(df, 100))) == sorted([(i,) for i, n in enumerate(lengths) if (n or 0) > 100], key=repr)
    assert packing.pack(df.limit(0), 100).count() == 0


def test_sum_before(spark):
    df = spark.createDataFrame([(i % 2, i, i) for i in range(100)], "g long, k long, w long")
    out = packing.sum_before(df, "g", "k", F.col("w"), slices=7).collect()
    for g in (0, 1):
        order = sorted((r for r in out if r["g"] == g), key=lambda r: (r["_before"], r["w"]))
        at = 0
        for r in order:
            assert r["_before"] == at
            at += r["w"]
