"""A trigram index over lines of text, and the trigrams that a regular expression requires.

The index holds the trigrams that the detection expressions require, a fixed set that doesn't grow with
the data. It is built by segments, one per some millions of characters, each an inverted index in
memory: for every trigram the lines that hold it, in order. A query intersects the postings of each of
its alternatives and unites the results, so no posting is shuffled and no segment needs another.
`TrigramIndex.table` gives the same postings as rows, where one index is to serve many scans.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ALTERNATIVES = 256

#: Alternatives, each a set of trigrams of which all must occur; an empty set: anything may match.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _runs(nodes, flags: int) -> list[tuple[str, ...]]:
    """Alternatives of a sequence, each a tuple of literal runs in order; '' marks a gap between runs."""
    out: list[tuple[str, ...]] = [("",)]
    for code, arg in nodes:
        if code is op.LITERAL:
            options = [(chr(arg).lower(),)]
        elif code is op.IN and (few := _few(arg)):
            options = [(c,) for c in few]
        elif code is op.SUBPATTERN:
            options = _runs(arg[3], flags)
        elif code is op.BRANCH:
            options = [o for branch in arg[1] for o in _runs(branch, flags)]
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = arg
            if low == 0:
                options = [("",), *_runs(inner, flags)] if high == 1 else [("", "")]
            else:
                options = [(*o, "") if high != 1 else o for o in _runs(inner, flags)]
                options = [o if low == high == 1 else ("", *o, "") if low != 1 else (*o, "") for o in options]
        elif code in (op.ASSERT, op.ASSERT_NOT, op.AT):
            options = [("",)] if code is op.AT else [("",)]
        else:  # any character, large sets, back references: a gap
            options = [("", "")]
        if len(out) * len(options) > MAX_ALTERNATIVES:
            options = [("", "")]  # keep what is required so far, ask nothing of the rest
        out = [_join(a, b, code) for a in out for b in options]
    return list(dict.fromkeys(out))


def _few(items) -> list[str]:
    """The characters of a small set; nothing for a large one."""
    chars = set()
    for code, arg in items:
        if code is op.LITERAL:
            chars.add(chr(arg).lower())
        elif code is op.RANGE and arg[1] - arg[0] < 10:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return []
    return sorted(chars) if len(chars) <= 10 else []


def _join(a: tuple[str, ...], b: tuple[str, ...], code) -> tuple[str, ...]:
    """Appends runs: a zero-width node leaves the last run open, a gap ends it."""
    if b == ("",):
        return a
    return (*a[:-1], a[-1] + b[0], *b[1:])


def required(pattern: str) -> Query:
    """What any match of `pattern` must contain, in lower case, as an OR of ANDs of trigrams."""
    tree = parser.parse(pattern)
    alternatives = set()
    for runs in _runs(tree, tree.state.flags):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        alternatives.add(grams)
    if frozenset() in alternatives:
        return ANY
    minimal = {a for a in alternatives if not any(b < a for b in alternatives)}
    return frozenset(minimal)


def _slots(points: np.ndarray) -> np.ndarray:
    """A number of 16 bits for each three points in a row; different trigrams rarely share one."""
    near = np.minimum(points, 255).astype(np.uint16)
    return near[:-2] * np.uint16(40503) ^ near[1:-1] * np.uint16(2531) ^ near[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Segment:
    """The postings of some texts. Lines are numbered through; trigrams in one slot share their postings,
    so what a query gives is never too few lines."""

    def __init__(self, slots: np.ndarray, texts: list[str]):
        points = _points("\n".join(texts))
        breaks = np.flatnonzero(points == 10)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        text_starts = np.cumsum(lengths + 1) - lengths - 1
        starts = np.concatenate(([0], breaks + 1))
        #: of each line: its text, where in the text it begins and ends, and its number there from 1
        self.text = np.searchsorted(text_starts, starts, side="right") - 1
        self.start = starts - text_starts[self.text]
        self.end = np.concatenate((breaks, [len(points)])) - text_starts[self.text]
        self.line_no = np.arange(len(starts)) - np.searchsorted(starts, text_starts)[self.text] + 1
        number = slots[_slots(points)] if len(points) > 2 else np.zeros(0, slots.dtype)
        at = np.flatnonzero(number)
        line, last = np.searchsorted(breaks, at), np.searchsorted(breaks, at + 2)
        over = line != last  # a trigram with a line end in it is in both lines
        key = np.concatenate((number[at] * len(starts) + line, number[at[over]] * len(starts) + last[over]))
        key = np.unique(key)
        self.lines = key % len(starts)
        self.begins = np.searchsorted(key, np.arange(int(slots.max()) + 2) * len(starts))

    def postings(self, number: int) -> np.ndarray:
        """The lines that hold a trigram, in order."""
        return self.lines[self.begins[number] : self.begins[number + 1]]


class TrigramIndex:
    """The trigrams that a set of queries requires, numbered by slot, and the queries in these numbers."""

    def __init__(self, queries: Mapping[str, Query]):
        self.trigrams = sorted({g for query in queries.values() for alternative in query for g in alternative})
        slot = {g: int(_slots(_points(g))[0]) for g in self.trigrams}
        numbers = {s: i for i, s in enumerate(sorted(set(slot.values())), 1)}
        self.number = {g: numbers[s] for g, s in slot.items()}
        self.slots = np.zeros(1 << 16, dtype=np.int64)
        for s, n in numbers.items():
            self.slots[s] = n
        self.queries = {name: sorted({tuple(sorted({self.number[g] for g in grams})) for grams in query}) for name, query in queries.items()}

    def segment(self, lowered: list[str]) -> Segment:
        """The postings of lower-cased texts."""
        return Segment(self.slots, lowered)

    def candidates(self, segment: Segment, name: str) -> np.ndarray:
        """The lines that hold all trigrams of one of a query's alternatives: postings intersected, the shortest first."""
        found = [np.zeros(0, dtype=np.int64)]
        for numbers in self.queries[name]:
            lists = sorted((segment.postings(n) for n in numbers), key=len)
            if not lists:
                return np.arange(len(segment.text))  # nothing is required
            lines = lists[0]
            for other in lists[1:]:
                if not len(lines):
                    break
                lines = lines[other[np.minimum(np.searchsorted(other, lines), len(other) - 1)] == lines]
            found.append(lines)
        return np.unique(np.concatenate(found))

    def table(self, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
        """(keys, line_no, numbers): for every line with indexed trigrams their numbers, as rows to be stored."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for low, high, lowered in segments(batch[text]):
                    segment = self.segment(lowered)
                    number = np.repeat(np.arange(len(segment.begins) - 1), np.diff(segment.begins))
                    order = np.argsort(segment.lines, kind="stable")
                    held, first = np.unique(segment.lines[order], return_index=True)
                    out = batch.iloc[low:high].iloc[segment.text[held]][keys].reset_index(drop=True)
                    yield out.assign(line_no=segment.line_no[held], numbers=[x.tolist() for x in np.split(number[order], first[1:])] if len(held) else [])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
        return texts.where(F.length(text) > 0).select(*keys, text).mapInPandas(run, f"{fields}, line_no long, numbers array<long>")


def lowered(text: str) -> str:
    """The text in lower case, letter by letter where a letter's lower case is longer."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def segments(texts: Iterable[str], size: int = 1 << 22) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, lower-cased texts) of parts of a batch of about `size` characters; a longer text is a part by itself."""
    held, low, total, i = [], 0, 0, 0
    for i, text in enumerate(texts, 1):
        held.append(lowered(text))
        total += len(text)
        if total >= size:
            yield low, i, held
            held, low, total = [], i, 0
    if held:
        yield low, i, held
