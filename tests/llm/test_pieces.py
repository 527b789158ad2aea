import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import pieces


def test_sections():
    text = "intro\r\n# A\r\none\r```\n# hidden\n~~~\n```\n  ## B\n\n#tag\n####### seven\n# #\n### C #x\nend"
    assert pieces.sections(text) == ["intro", "# A\none\n```\n# hidden\n~~~\n```", "## B\n\n#tag\n####### seven\n# #", "### C #x\nend"]
    assert pieces.sections(None) == [] and pieces.sections(" \n\n") == [] and pieces.sections("\n# A") == ["# A"]
    assert pieces.sections("~~~\n# open to the end") == ["~~~\n# open to the end"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=600), st.integers(20, 80), st.integers(0, 15))
def test_text_pieces_cover_with_overlap(text, limit, overlap):
    ranges = pieces.text_pieces(text, limit, overlap)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text) and all(b - a <= limit for a, b in ranges)
    for (_, before), (start, _) in zip(ranges, ranges[1:]):
        assert before - start == min(overlap, before)
    cuts = [0, *[b for _, b in ranges]]
    assert "".join(text[a:b] for a, b in zip(cuts, cuts[1:])) == text


def test_strongest_boundary_near_the_middle():
    text = "word " * 10 + "end.\n\n" + "next " * 10
    assert pieces.text_pieces(text, 60, 0)[0] == (0, text.index("next"))
    assert [b - a for a, b in pieces.text_pieces("x" * 100, 50, 0)] == [50, 50]


def test_line_pieces():
    body = ["x"] * 30 + [""] + ["def f():"] + ["    y"] * 28
    ranges = pieces.line_pieces(1, 60, 50, 5, body, 1)
    assert ranges == [(1, 31), (27, 60)]
    assert pieces.line_pieces(1, 50, 50, 5, None, 1) == [(1, 50)]
    random.seed(1)
    for _ in range(50):
        n = random.randrange(51, 400)
        got = pieces.line_pieces(10, 9 + n, 50, 5, None, 10)
        assert got[0][0] == 10 and got[-1][1] == 9 + n and all(b - a < 50 for a, b in got)
        assert all(b - a2 + 1 == 5 for (_, b), (a2, _) in zip(got, got[1:]))


LIMITS = [("section", "character", 100, 10), ("hit", "line", 50, 5)]


def test_found(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "w " * 100 + "\n\n\n# B\nshort", "c"), (2, None, "c"), (3, "", "c"), (4, "ä" * 100, "c"), (5, "ä" * 101, "c")], "prep_id long, content string, rule string")
    hits = spark.createDataFrame([(1, 7, 1, 51), (2, 7, 1, 50), (3, 7, 1, None), (4, 99, 5, 200), (5, None, 1, 90), (1, 7, 1, 51)], "hit_id long, chunk_id long, start_line long, end_line long")
    chunks = spark.createDataFrame([(7, 1, "p\n\n" + "\n".join(["x"] * 60), "k"), (8, 1, None, "k")], "id long, start_line long, embed_text string, hit_id string")
    limits = spark.createDataFrame(LIMITS, "item_kind string, size_unit string, max_size long, overlap_size long")
    got = rows(pieces.oversized_items(docs, hits, chunks, limits).distinct())
    assert got == [("hit", 1, 0), ("hit", 4, 0), ("hit", 5, 0), ("section", 1, 0), ("section", 5, 0)]
    made = pieces.all_pieces(docs, hits, chunks, limits).collect()
    assert all(r["piece_size"] <= (100 if r["item_kind"] == "section" else 50) for r in made)
    assert {r["piece_text"] for r in made if r["item_kind"] == "hit" and r["item_id"] == 4} == {None}
    none = pieces.oversized_items(docs.limit(0), hits.limit(0), chunks.limit(0), limits)
    assert none.count() == 0


def test_no_room():
    for limit, overlap in ((100, 100), (100, 130), (5, -1)):
        with pytest.raises(ValueError):
            pieces.text_pieces("a" * 2000, limit, overlap)
        with pytest.raises(ValueError):
            pieces.line_pieces(1, 2000, limit, overlap, None, 1)
