"""Splitting oversized items at natural boundaries (problem 2).

Method: recursive bisection. Cut at the strongest boundary near the midpoint, recurse on the halves
that still exceed the limit minus the overlap, then start every piece but the first `overlap` earlier.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"\s*#{1,6}\s+(?=.*[^#\s])")
_FENCE = re.compile(r"\s*(```|~~~)")


def unify_ends(text: str) -> str:
    """Every line end as one line feed."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def sections(content: str | None) -> list[str]:
    """The sections of a Markdown text that aren't blank, in order, trimmed; fences hide headings."""
    if not content:
        return []
    found: list[list[str]] = [[]]
    fence = ""
    for line in unify_ends(content).split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1] == fence:
                fence = ""
        elif mark:
            fence = mark[1]
        elif _HEADING.match(line):
            found.append([])
        found[-1].append(line)
    trimmed = ("\n".join(lines).strip() for lines in found)
    return [s for s in trimmed if s]


def bisect(start: int, end: int, room: int, strength: Callable[[int], int]) -> list[tuple[int, int]]:
    """Ranges covering [start, end), none longer than `room`, cut where `strength` is greatest.

    A cut is sought in the middle half of a range; among equals the one nearest the midpoint, then the
    earlier one. Strengths compare as numbers, 0 is no boundary at all and still a possible cut.
    """
    done, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            done.append((a, b))
            continue
        middle, reach = (a + b) // 2, max(1, (b - a) // 4)
        lowest, highest = max(a + 1, middle - reach), min(b - 1, middle + reach)
        best, best_key = middle, (-1, 0, 0)
        for at in range(lowest, highest + 1):
            key = (strength(at), -abs(at - middle), -at)
            if key > best_key:
                best, best_key = at, key
        todo += [(best, b), (a, best)]
    return sorted(done)


def _room(limit: int, overlap: int) -> int:
    """What a piece may hold besides its overlap; ValueError where nothing is left."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} leaves no room within a limit of {limit}")
    return limit - overlap


def text_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of a text's pieces: a blank line is the strongest cut, then a line end, a
    sentence end, white space. The text itself if it is within the limit."""
    room = _room(limit, overlap)
    if len(text) <= limit:
        return [(0, len(text))]
    marks = bytearray(len(text) + 1)
    for rank, pattern in ((1, r"\s+"), (2, r"[.!?;:]['\")\]]*\s+"), (3, r"\n"), (4, r"\n[ \t]*\n\s*")):
        for match in re.finditer(pattern, text):
            marks[match.end()] = max(rank, marks[match.end()])
    cuts = bisect(0, len(text), room, marks.__getitem__)
    return [(a if i == 0 else max(0, a - overlap), b) for i, (a, b) in enumerate(cuts)]


def line_pieces(first: int, last: int, limit: int, overlap: int, body: list[str] | None, body_start: int) -> list[tuple[int, int]]:
    """Line ranges (inclusive) of a hit's pieces; blank lines are the strongest cuts, then lines that
    begin at the margin. Without the chunk's text all cuts are equal and halves result."""
    room = _room(limit, overlap)
    if last - first + 1 <= limit:
        return [(first, last)]

    def strength(at: int) -> int:
        i = at - body_start
        if body is None or not 0 <= i < len(body):
            return 0
        if i > 0 and not body[i - 1].strip():
            return 3
        return 2 if body[i][:1].strip() and not body[i][0] in "})]" else 1 if not body[i].strip() else 0

    cuts = bisect(first, last + 1, room, strength)
    return [(a if i == 0 else max(first, a - overlap), b - 1) for i, (a, b) in enumerate(cuts)]


_PIECES = (
    "item_kind string, item_id long, section_no long, item_size long, piece_no long, n_pieces long, "
    "start_at long, end_at long, piece_size long, piece_text string"
)
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def section_pieces(docs: DataFrame, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of every section of `docs` (prep_id, content): places are characters in the trimmed section.

    A null or blank content has no sections. Sections within the limit come out as one piece.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, content in zip(batch["prep_id"], batch["content"]):
                for number, text in enumerate(sections(content)):
                    ranges = text_pieces(text, limit, overlap)
                    out += [
                        ("section", item, number, len(text), i, len(ranges), a, b, b - a, text[a:b] if with_text else None)
                        for i, (a, b) in enumerate(ranges)
                    ]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return docs.select("prep_id", "content").mapInPandas(cut, _PIECES)


def hit_pieces(hits: DataFrame, chunks: DataFrame, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of every hit over the limit: places are lines. The text comes from the hit's chunk, so
    that cuts fall on its boundaries; hits whose chunk is missing are cut in halves, without text.

    A hit with a null start or end has no size and no pieces. Only hits over the limit are joined, on
    the chunk's id; a chunk that many hits share is sent to each, its hits are spread by AQE.
    """
    oversized = hits.where(F.col("end_line") - F.col("start_line") + 1 > limit).select(
        "hit_id", "start_line", "end_line", "chunk_id"
    )
    bodies = chunks.select(F.col("id").alias("chunk_id"), F.col("start_line").alias("chunk_start"), "embed_text")
    joined = oversized.join(bodies, "chunk_id", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, first, last, text, text_start in zip(
                batch["hit_id"], batch["start_line"], batch["end_line"], batch["embed_text"], batch["chunk_start"]
            ):
                body = (text.partition("\n\n")[2] if "\n\n" in text else text).split("\n") if isinstance(text, str) else None
                from_line = int(text_start) if body is not None and text_start == text_start else int(first)
                ranges = line_pieces(int(first), int(last), limit, overlap, body, from_line)
                for i, (a, b) in enumerate(ranges):
                    shown = "\n".join(body[max(0, a - from_line) : max(0, b - from_line + 1)]) if with_text and body is not None else None
                    out.append(("hit", item, 0, int(last) - int(first) + 1, i, len(ranges), a, b, b - a + 1, shown))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return joined.mapInPandas(cut, _PIECES)


def limits(size_limits: DataFrame, item_kind: str) -> tuple[int, int]:
    """(max_size, overlap_size) of a kind; the table is one row per kind."""
    row = size_limits.where(F.col("item_kind") == item_kind).select("max_size", "overlap_size").first()
    if row is None:
        raise ValueError(f"size_limits has no {item_kind}")
    return int(row[0]), int(row[1])


def all_pieces(docs: DataFrame, hits: DataFrame, chunks: DataFrame, size_limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of sections and of oversized hits, under the limits of `size_limits`.

    ValueError for a kind whose overlap isn't smaller than its limit, or that has no limit.
    """
    section_limit, section_overlap = limits(size_limits, "section")
    hit_limit, hit_overlap = limits(size_limits, "hit")
    _room(section_limit, section_overlap), _room(hit_limit, hit_overlap)
    return section_pieces(docs, section_limit, section_overlap, with_text).unionByName(
        hit_pieces(hits, chunks, hit_limit, hit_overlap, with_text)
    )


def oversized_items(docs: DataFrame, hits: DataFrame, chunks: DataFrame, size_limits: DataFrame) -> DataFrame:
    """(item_kind, item_id, section_no) of the items that had to be split."""
    pieces = all_pieces(docs, hits, chunks, size_limits, with_text=False)
    return pieces.where("n_pieces > 1 and piece_no = 0").select("item_kind", "item_id", "section_no")
