"""Subject areas of documents (problem 8).

Method: normalised document vectors (hashed words, weighed by idf) are clustered by bisecting k-means;
each leaf is labelled by its discriminative terms, read through the documents labelled by hand; every
sentence is placed in the leaf whose terms speak for it, and a document gets the subjects of which the
mixture of its leaves holds at least a quarter.

A leaf that mixes two subjects, as documents do, counts as two parts, one per subject. A term speaks for
a subject in which it is concentrated, over all leaves that have a part of it, and among these for the
leaves whose documents hold it most.

The first splits separate languages and styles. Terms that are common within one of these branches say
nothing of subjects there and have no weight in its vectors, whatever the number of documents.

Every split, centre and count is taken over all documents. A node of more than `LOCAL` documents is split
by passes over them, one for all such nodes; the documents of a smaller one are brought together and
split further by one task. Terms are hashed to a fixed number of buckets, so leaves x dimensions and
buckets x leaves are all that reaches the driver or is sent to the executors.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.session import cut

WORDS = 1 << 16  # buckets of words; as many again hold pairs of adjacent words
BUCKETS = 2 * WORDS
DIMENSIONS = 1 << 13  # of document vectors
LOCAL = 1 << 15  # documents of a node that one task splits further
BRANCHES = 8  # first splits, within which terms are found common
COMMON = 0.3  # of a branch's documents; terms above it have no weight there
LEAVES = 192
PASSES = 2  # over all documents, in which the centres of a tree are computed
CLEAR = 0.75  # of a leaf's evidence that its two best subjects must hold
PART = 0.2  # of a leaf's evidence from which a subject is a part of the leaf
BY_HAND = 4.0  # how many documents of a leaf one labelled document weighs
CONCENTRATED = 0.7  # of a term's occurrences, corrected for the subjects' sizes, that one subject must have
MIN_SHARE = 0.25  # of the sentences with a subject that must deal with one for it to count

_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)]|>|#{1,6}|\|)\s+")
_END = re.compile(r"(?<=[.!?…])[\"')\]»]*(?:\s+|(?=[A-ZÀ-ÖØ-Þ¿¡]))")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: headings and titles are none, list items are; wrapped lines are joined."""
    if not text:
        return []
    plain = text
    for _ in range(2):  # damaged twice over
        if "&" in plain:
            plain = html.unescape(plain)
    if not plain.isascii():
        plain = unicodedata.normalize("NFC", plain)
    plain = plain.replace("\r\n", "\n").replace("\r", "\n")
    blocks: list[str] = []
    for line in plain.split("\n"):
        stripped = line.strip()
        if not stripped:
            blocks.append("")
            continue
        heading = stripped.startswith("#")
        item = _ITEM.match(line)
        if item:
            stripped = line[item.end() :].strip()
        if heading and not stripped.endswith((".", "!", "?")):
            blocks.append("")
            continue
        previous = blocks[-1] if blocks else ""
        if previous and not item and not previous.endswith((".", "!", "?", "…", ":")) and (stripped[:1].islower() or len(previous) > 60):
            blocks[-1] = f"{previous} {stripped}"
        else:
            blocks.append(stripped)
    out = []
    for block in blocks:
        for part in _END.split(block) if block else ():
            # a title is short and has no stop
            words = part.count(" ") + 1 if part.endswith((".", "!", "?", "…")) else 0
            if words > 8 or (words := len(_WORD.findall(part))) > 6 or words >= 3 and part.endswith((".", "!", "?", "…")):
                out.append(part)
    return out


# --- terms -----------------------------------------------------------------------------------------


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_P, _Q, _R = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))  # odd
_INVERSE = np.uint32(pow(int(_P), -1, 1 << 32))
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint32, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 32; tables grow by doubling and are kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n).bit_length()), base, dtype=np.uint32)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have, dtype=np.uint32)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _Q
    return h ^ (h >> np.uint32(13))


def _distinct(owner: np.ndarray, value: np.ndarray, values: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, owner) of the distinct pairs, by owner and value; `values` is a power of two."""
    kind = np.uint32 if owners * values < 1 << 32 else np.uint64  # half as long keys sort twice as fast
    key = np.sort(owner.astype(kind) * kind(values) + value.astype(kind))
    key = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))]
    return (key & kind(values - 1)).astype(np.int32), (key // kind(values)).astype(np.int64)


def term_arrays(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence) of the distinct terms of each sentence, in order: its words of three letters or
    more and all pairs of adjacent words, letter case aside. All sentences are hashed at once: a word's
    hash is a polynomial of its letters, whose powers count from the first letter of all."""
    points = np.frombuffer("\n".join(parts).casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    turns = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sentence = np.searchsorted(np.flatnonzero(points == 10), starts)
    first = np.cumsum(lengths) - lengths
    letters = (points[letter] + _R) * _powers_of(_P, int(lengths.sum()))
    hashed = _mixed(np.add.reduceat(letters, first, dtype=np.uint32) * _powers_of(_INVERSE, int(first[-1]) + 1)[first])
    joined = _mixed(hashed[:-1] * _P + hashed[1:] * _R)
    single, pair = lengths > 2, sentence[:-1] == sentence[1:]
    if not single.any() and not pair.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bucket = np.concatenate((hashed[single] & np.uint32(WORDS - 1), np.uint32(WORDS) + (joined[pair] & np.uint32(WORDS - 1))))
    return _distinct(np.concatenate((sentence[single], sentence[:-1][pair])), bucket, BUCKETS, len(parts))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists in a row, and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _listed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def sentence_terms(documents: DataFrame) -> DataFrame:
    """(doc_id, terms, sizes, words): the buckets of each document's sentences in a row, how many each
    sentence has, and the distinct dimensions of its words. The only pass over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                found = [sentences(t) for t in small.column("text").to_pylist()]
                terms, sentence = term_arrays([s for of in found for s in of])
                total = sum(map(len, found))
                per_sentence = np.bincount(sentence, minlength=total)
                count = np.array([len(of) for of in found], dtype=np.int64)
                document = np.repeat(np.arange(len(found)), count)
                per_document = np.bincount(document, weights=per_sentence, minlength=len(found)).astype(np.int64)
                word = terms < WORDS
                owner = document[sentence[word]]
                words, holder = _distinct(owner, terms[word] % DIMENSIONS, DIMENSIONS, len(found)) if word.any() else (owner, owner)
                yield pa.record_batch(
                    [
                        small.column("doc_id").cast(pa.int64()),
                        _listed(terms, per_document),
                        _listed(per_sentence, count),
                        _listed(words, np.bincount(holder, minlength=len(found))),
                    ],
                    names=["doc_id", "terms", "sizes", "words"],
                )

    schema = "doc_id long, terms array<int>, sizes array<int>, words array<int>"
    return documents.select("doc_id", "text").where("length(text) > 0").mapInArrow(run, schema).where(F.size("terms") > 0)


# --- bisecting k-means -----------------------------------------------------------------------------


@dataclass
class Tree:
    """Binary splits below some roots: node n's children are child[n] and child[n] + 1, 0 for a leaf. A
    document goes to the child whose centre is nearer by cosine."""

    roots: int
    child: list[int] = field(default_factory=list)
    centres: np.ndarray | None = None  # (nodes, DIMENSIONS), of length 1
    scatter: list[float] = field(default_factory=list)  # of each node's vectors about their centre

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.child) == 0)

    def descend(self, root: np.ndarray, owner: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The leaf of each vector; its entries are given as owner, dimension, value."""
        child, node = np.array(self.child), root.astype(np.int64)
        apart = self.centres[child + 1] - self.centres[child] if child.any() else self.centres
        open_ = child[node] > 0
        while open_.any():
            live = open_[owner]
            of, at = owner[live], dims[live]
            lean = np.bincount(of, weights=values[live] * apart[node[of], at], minlength=len(node))
            node = np.where(open_, child[node] + (lean > 0), node)
            open_ = child[node] > 0
        return node

    def recentre(self, sums: np.ndarray) -> None:
        """Centres from the sums over each leaf's vectors; where no vector came, the old ones stay."""
        sums = sums.copy()
        for n in range(len(self.child) - 1, -1, -1):
            if self.child[n]:
                sums[n] = sums[self.child[n]] + sums[self.child[n] + 1]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        self.centres = np.where(length > 0, sums / np.maximum(length, 1e-12), self.centres).astype(np.float32)


def _vectors(dims: np.ndarray, lengths: np.ndarray, weights: np.ndarray, branch: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, dimension, value) of vectors of length 1; entries without weight are left out."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    values = weights[dims] if branch is None else weights[branch[owner], dims]
    held = values > 0
    owner, dims, values = owner[held], dims[held], values[held]
    norm = np.sqrt(np.bincount(owner, weights=values * values, minlength=len(lengths)))
    return owner, dims, values / norm[owner]


def _split(owner: np.ndarray, dims: np.ndarray, values: np.ndarray, n: int, random: np.random.Generator) -> np.ndarray:
    """Which of two halves each of n vectors belongs to: by the principal direction, then by 2-means."""
    onto = lambda p: np.bincount(dims, weights=values * p[owner], minlength=DIMENSIONS)
    along = lambda v: np.bincount(owner, weights=values * v[dims], minlength=n)
    mean = onto(np.ones(n)) / n
    p = random.standard_normal(n)
    for _ in range(4):
        v = onto(p) - mean * p.sum()
        p = along(v / max(np.linalg.norm(v), 1e-12))
        p -= p.mean()
    side = p > 0
    for _ in range(10):
        sums = [onto(x.astype(float)) for x in (side, ~side)]
        right, left = (s / max(np.linalg.norm(s), 1e-12) for s in sums)
        new = along(right - left) > 0
        if (new == side).all():
            break
        side = new
    return side


def seed_tree(dims: np.ndarray, lengths: np.ndarray, weights: np.ndarray, branch: np.ndarray | None, roots: int, leaves: int, seed: int, least: float = 0.0) -> Tree:
    """A tree over vectors at hand: the leaf whose vectors scatter most about its centre is bisected next,
    until there are so many leaves or none whose vectors differ, or scatter by `least`."""
    random = np.random.default_rng(seed)
    owner, dims, values = _vectors(dims, lengths, weights, branch)
    held = np.unique(owner)
    ends = np.cumsum(np.bincount(owner, minlength=len(lengths)))
    tree = Tree(roots, [0] * roots)
    sums = [np.zeros(DIMENSIONS) for _ in range(roots)]
    heap: list[tuple[float, int]] = []
    members: dict[int, np.ndarray] = {}

    def entries(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = ends[docs] - np.where(docs > 0, ends[docs - 1], 0)
        at = np.repeat(ends[docs] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(docs)), sizes), dims[at], values[at]

    def add(node: int, docs: np.ndarray) -> None:
        _, d, v = entries(docs)
        sums[node] = np.bincount(d, weights=v, minlength=DIMENSIONS)
        members[node] = docs
        scatter = len(docs) - np.linalg.norm(sums[node])
        tree.scatter.append(float(scatter))
        if len(docs) > 1 and scatter > 1e-6 * len(docs):
            heapq.heappush(heap, (-scatter, node))

    for r in range(roots):
        add(r, held if branch is None else held[branch[held] == r])
    while heap and len(tree.leaves()) < leaves and -heap[0][0] >= least:
        _, node = heapq.heappop(heap)
        docs = members[node]
        side = _split(*entries(docs), len(docs), random)
        if side.all() or not side.any():
            continue
        tree.child[node] = len(tree.child)
        tree.child += [0, 0]
        sums += [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
        add(tree.child[node], docs[~side])
        add(tree.child[node] + 1, docs[side])
    tree.centres = np.zeros((len(tree.child), DIMENSIONS), dtype=np.float32)
    tree.recentre(np.stack(sums))
    return tree


def _fetch(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a small table as arrays; as Arrow batches, for rows of Python objects weigh many times more."""
    arrow = df.toArrow()
    return {name: arrow[name].to_numpy() for name in arrow.column_names}


def _summed(docs: DataFrame, columns: list[str], shape: tuple[int, ...], add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum of what `add` puts into an array of the shape for each batch, over all partitions.

    Each task keeps one array and gives its entries that aren't 0, which are combined by place; what
    reaches the driver is the array, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            add(batch, total)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            yield pa.record_batch([pa.array(part), pa.array(flat[part])], names=["at", "n"])

    sums = _fetch(docs.select(*columns).mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")))
    out = np.zeros(int(np.prod(shape)))
    out[sums["at"]] = sums["n"]
    return out.reshape(shape)


def _counted(docs: DataFrame, columns: list[str], keys: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys that `keys` gives for all batches, and how often each; counts combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(keys(batch), return_counts=True)
            yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["at", "n"])

    sums = _fetch(docs.select(*columns).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")))
    return sums["at"], sums["n"]


@dataclass
class Clusters:
    """The branches and leaves of documents: two trees, the second below the first's leaves with weights of their own."""

    branches: Tree
    plain: np.ndarray  # weights of the first tree's vectors
    leaves: Tree | None = None
    weights: np.ndarray | None = None  # (branches, DIMENSIONS)

    def place(self, batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The leaf of each document of a batch (the branch while there are no leaves), and the vectors it was found by."""
        dims, lengths = _lists(batch.column("words"))
        vectors = _vectors(dims, lengths, self.plain, None)
        branch = self.branch(self.branches.descend(np.zeros(len(lengths), dtype=np.int64), *vectors))
        if self.leaves is None:
            return branch, vectors
        vectors = _vectors(dims, lengths, self.weights, branch)
        return self.leaves.descend(branch, *vectors), vectors

    def branch(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.branches.leaves(), node)

    def numbers(self) -> np.ndarray:
        """Each node's number among the leaves, -1 for inner nodes."""
        out = np.full(len(self.leaves.child), -1)
        out[self.leaves.leaves()] = np.arange(len(self.leaves.leaves()))
        return out


def _pack(node: np.ndarray, kind: np.ndarray, dims: np.ndarray, lengths: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
    """A row for each node that documents are in: node, kind of weights, and their dimensions in a row, with the lengths
    that their vectors have before they are normalised. Documents without dimensions are left out."""
    out: list[tuple] = []
    owner = np.repeat(node, lengths)
    for n in np.unique(node[lengths > 0]):
        of = (node == n) & (lengths > 0)
        out.append((int(n), int(kind[of][0]), lengths[of].astype(np.int32).tobytes(), norms[of].tobytes(), dims[owner == n].astype(np.uint16).tobytes()))
    columns = list(zip(*out)) if out else [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "kind", "lengths", "norms", "dims"])


_PACKED = "node int, kind int, lengths binary, norms binary, dims binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(node, kind, lengths, first entry of each document, dims, norms) of each packed row. A vector's entries are the
    weights of its dimensions divided by its norm, so the weights are applied to directions and sums, not to entries."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths, dims = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["dims"], np.uint16).astype(np.intp)
            yield row["node"], row["kind"], lengths, np.cumsum(lengths) - lengths, dims, np.frombuffer(row["norms"], np.float64)


def _sweep(packed: DataFrame, weights: np.ndarray, along: dict[int, tuple[np.ndarray, float]] | None, sides: bool) -> dict[int, tuple[np.ndarray, float, float]]:
    """{node: (sum of the vectors times their factors, sum of the factors, documents)} of the nodes in `along`, or of all.

    The factor is how far a vector lies along the node's direction, or for `sides` whether that is more than the
    node's threshold; 1 without directions. A task gives an array for each node, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        kinds: dict[int, int] = {}  # of weights, one for each node
        for node, kind, lengths, first, dims, norms in _unpacked(batches):
            if along is not None and node not in along:
                continue
            factor = np.ones(len(lengths))
            if along is not None:
                direction, threshold = along[node]
                factor = np.add.reduceat((direction * weights[kind])[dims], first) / norms
                factor = (factor > threshold).astype(float) if sides else factor
            own = total.setdefault(node, np.zeros(DIMENSIONS + 2))
            own[:DIMENSIONS] += np.bincount(dims, weights=np.repeat(factor / norms, lengths), minlength=DIMENSIONS)
            own[DIMENSIONS:] += factor.sum(), len(lengths)
            kinds[node] = kind
        for node, own in total.items():
            own[:DIMENSIONS] *= weights[kinds[node]]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["node", "sums"])

    def add(table: pa.Table) -> pa.Table:
        whole = sum(sorted((np.frombuffer(x, np.float64) for x in table["sums"].to_pylist()), key=lambda x: x.tobytes()))  # in one order
        return pa.table({"node": table["node"][:1].cast(pa.int32()), "sums": pa.array([whole.tobytes()], pa.binary())})

    found = packed.mapInArrow(run, "node int, sums binary").groupBy("node").applyInArrow(add, "node int, sums binary").toArrow()
    arrays = {n: np.frombuffer(x, np.float64) for n, x in zip(found["node"].to_pylist(), found["sums"].to_pylist())}
    return {n: (x[:DIMENSIONS], x[DIMENSIONS], x[DIMENSIONS + 1]) for n, x in arrays.items()}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.linalg.norm(v), 1e-12)


def _halves(packed: DataFrame, weights: np.ndarray, whole: dict[int, tuple[np.ndarray, float]], random: np.random.Generator) -> dict[int, tuple[np.ndarray, float, np.ndarray, float]]:
    """`_split` of several nodes {node: (sum, documents)} at once, by passes over all their documents: {node: (direction,
    threshold, sum of the right half, its documents)}; nodes that can't be divided are missing."""
    along = {n: (random.standard_normal(DIMENSIONS), 0.0) for n in whole}
    for _ in range(4):
        for n, (onto, factors, size) in _sweep(packed, weights, along, False).items():
            direction = _unit(onto - whole[n][0] / size * factors)
            along[n] = direction, float(direction @ whole[n][0] / size)
    out: dict[int, tuple[np.ndarray, float, np.ndarray, float]] = {}
    for step in range(11):
        for n, (right, held, size) in _sweep(packed, weights, along, True).items():
            same = n in out and out[n][3] == held and np.allclose(out[n][2], right)
            out[n] = (*along[n], right, held)
            if same or not 0 < held < size:
                del along[n]
            elif step < 10:
                along[n] = _unit(right) - _unit(whole[n][0] - right), 0.0
        if not along:
            break
    return {n: x for n, x in out.items() if 0 < x[3] < whole[n][1]}


def grow(docs: DataFrame, place: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray, roots: int, leaves: int, seed: int) -> Tree:
    """The tree of `seed_tree` over all of `docs`, of which `place` gives (root, dimensions, lengths); `weights` are by root.

    A child scatters no more than its parent, so the splits of the nodes that scatter most are the same
    whatever order they are made in: all that may be among them are made, and the best kept.
    """
    random, wanted = np.random.default_rng(seed), leaves - roots

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, dims, lengths = place(batch)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            values = weights[root[owner], dims]
            held, norms = values > 0, np.sqrt(np.bincount(owner, weights=values * values, minlength=len(lengths)))
            yield _pack(root, root, dims[held], np.bincount(owner[held], minlength=len(lengths)), norms)

    packed = cut(docs.select("words").mapInArrow(pack, _PACKED))
    nodes = [(np.zeros(DIMENSIONS), 0.0)] * roots  # sum and documents of each
    for n, (own, _, size) in _sweep(packed, weights, None, False).items():
        nodes[n] = own, size
    child, done = [0] * roots, set[int]()
    scatter = lambda n: nodes[n][1] - np.linalg.norm(nodes[n][0])

    def best() -> list[int]:
        return sorted((n for n in range(len(nodes)) if child[n] or n not in done), key=lambda n: (-scatter(n), n))[: max(0, wanted)]

    opened = lambda n: not child[n] and n not in done and nodes[n][1] > 1 and scatter(n) > 1e-6 * nodes[n][1]
    while large := [n for n in best() if opened(n) and nodes[n][1] > LOCAL]:
        halves = _halves(packed, weights, {n: nodes[n] for n in large}, random)
        done |= {*large} - {*halves}
        turn: dict[int, tuple[int, np.ndarray, float]] = {}
        for n, (direction, threshold, right, held) in sorted(halves.items()):
            child[n] = len(nodes)
            turn[n] = child[n], direction, threshold
            nodes += [(nodes[n][0] - right, nodes[n][1] - held), (right, held)]
            child += [0, 0]

        def divide(batches: Iterator[pa.RecordBatch], turn: dict = turn) -> Iterator[pa.RecordBatch]:
            for node, kind, lengths, first, dims, norms in _unpacked(batches):
                to = np.full(len(lengths), node)
                if node in turn:
                    left, direction, threshold = turn[node]
                    to = left + (np.add.reduceat((direction * weights[kind])[dims], first) / norms > threshold)
                yield _pack(to, np.full(len(lengths), kind), dims, lengths, norms)

        packed = cut(packed.mapInArrow(divide, _PACKED))
    known = [scatter(n) for n in best()]
    least = known[-1] if len(known) == wanted and known else 0.0
    small = [n for n in best() if opened(n)]

    def below(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["kind", "lengths", "dims"]).to_pylist(), key=lambda r: (r["dims"], r["lengths"]))  # in one order
        lengths, dims = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("lengths", np.int32), ("dims", np.uint16)))
        node = table["node"][0].as_py()
        tree = seed_tree(dims, lengths, weights[rows[0]["kind"]], None, 1, wanted + 1, seed, least)
        count = len(tree.child)
        centres = pa.array([c.astype(np.float32).tobytes() for c in tree.centres], pa.binary())
        return pa.table({"node": pa.array([node] * count, pa.int32()), "at": pa.array(range(count), pa.int32()), "child": pa.array(tree.child, pa.int32()), "scatter": pa.array(tree.scatter), "centre": centres})

    # (node of `nodes`, number below it) stands for a node from here on
    splits = {(n, 0): (scatter(n), (child[n], 0), (child[n] + 1, 0)) for n in range(len(nodes)) if child[n]}
    grown = None
    if small:
        grown = cut(packed.where(F.col("node").isin(small)).groupBy("node").applyInArrow(below, "node int, at int, child int, scatter double, centre binary"))
        for r in grown.where("child > 0").select("node", "at", "child", "scatter").toArrow().to_pylist():
            splits[r["node"], r["at"]] = r["scatter"], (r["node"], r["child"]), (r["node"], r["child"] + 1)
    kept = {*sorted(splits, key=lambda k: (-splits[k][0], k))[: max(0, wanted)]}
    tree, order = Tree(roots, [0] * roots), [(n, 0) for n in range(roots)]
    for k, key in enumerate(order):  # which grows
        if key in kept:
            tree.child[k] = len(order)
            order += splits[key][1:]
            tree.child += [0, 0]
    tree.centres = np.stack([_unit(nodes[n][0]) if at == 0 else np.zeros(DIMENSIONS) for n, at in order]).astype(np.float32)
    if below_ := [key for key in order if key[1]]:
        number = {key: k for k, key in enumerate(order)}
        chosen = grown.sparkSession.createDataFrame(below_, "node int, at int")  # fewer than twice the leaves
        found = grown.join(F.broadcast(chosen), ["node", "at"]).select("node", "at", "centre").toArrow()
        for n, at, centre in zip(*(found[c].to_pylist() for c in ("node", "at", "centre"))):
            tree.centres[number[n, at]] = np.frombuffer(centre, np.float32)
    return tree


def cluster(docs: DataFrame, branches: int, leaves: int, seed: int) -> Clusters:
    """Bisecting k-means over the word vectors of `docs` (doc_id, words)."""
    plain = np.ones(DIMENSIONS)

    def together(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims, lengths = _lists(batch.column("words"))
        return np.zeros(len(lengths), dtype=np.int64), dims, lengths

    found = Clusters(grow(docs, together, plain[None], 1, branches, seed), plain)
    kinds = len(found.branches.leaves())

    def branch_sums(batch: pa.RecordBatch, total: np.ndarray) -> None:
        branch, (owner, at, values) = found.place(batch)
        for row, w in ((0, values), (1, np.ones(len(at)))):
            total[row] += np.bincount(branch[owner] * DIMENSIONS + at, weights=w, minlength=total[row].size).reshape(kinds, -1)
        total[2, :, 0] += np.bincount(branch, minlength=kinds)

    for step in range(PASSES):
        sums = _summed(docs, ["words"], (3, kinds, DIMENSIONS), branch_sums)
        if step + 1 < PASSES:
            whole = np.zeros((len(found.branches.child), DIMENSIONS))
            whole[found.branches.leaves()] = sums[0]
            found.branches.recentre(whole)
    frequency, size = sums[1], np.maximum(sums[2, :, :1], 1)
    rare = (frequency > 0) & (frequency <= COMMON * size)
    found.weights = np.where(rare, np.log(size / np.maximum(frequency, 1)), 0.0)

    def by_branch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return found.place(batch)[0], *_lists(batch.column("words"))

    tree = grow(docs, by_branch, found.weights, kinds, leaves, seed)
    found.leaves = tree

    def leaf_sums(batch: pa.RecordBatch, total: np.ndarray) -> None:
        leaf, (owner, at, values) = found.place(batch)
        total += np.bincount(leaf[owner] * DIMENSIONS + at, weights=values, minlength=total.size).reshape(total.shape)

    for _ in range(PASSES):
        tree.recentre(_summed(docs, ["words"], (len(tree.child), DIMENSIONS), leaf_sums))
    return found


# --- labels of leaves ------------------------------------------------------------------------------


def _document_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket): the distinct terms of each document."""
    terms, lengths = _lists(batch.column("terms"))
    term, document = _distinct(np.repeat(np.arange(len(lengths)), lengths), terms, BUCKETS, len(lengths))
    return document, term


def _term_counts(counted: tuple[np.ndarray, np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (kind, bucket), and by kind alone, of keys kind * (BUCKETS + 1) + bucket; BUCKETS stands for the document itself."""
    at, n = counted
    out = np.zeros((kinds, BUCKETS + 1), dtype=np.float32)
    out.reshape(-1)[at] = n
    return out[:, :BUCKETS], out[:, BUCKETS].astype(np.float64)


def _kind_keys(kind: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    document, term = _document_terms(batch)
    return np.concatenate((kind[document] * (BUCKETS + 1) + term, kind * (BUCKETS + 1) + BUCKETS))


def leaf_terms(docs: DataFrame, found: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each leaf hold each term, and how many documents each leaf has."""
    number = found.numbers()
    keys = lambda batch: _kind_keys(number[found.place(batch)[0]], batch)
    return _term_counts(_counted(docs, ["words", "terms"], keys), len(found.leaves.leaves()))


def told_terms(docs: DataFrame, labels: DataFrame, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """How many labelled documents of each subject hold each term, and how many documents each subject has.

    `labels` has doc_id and subject, a number; it is joined to the documents.
    """
    keys = lambda batch: _kind_keys(batch.column("subject").to_numpy(), batch)
    return _term_counts(_counted(docs.join(labels, "doc_id"), ["terms", "subject"], keys), subjects)


def leaf_parts(held: np.ndarray, size: np.ndarray, told: np.ndarray, labelled: np.ndarray, top: int = 60) -> np.ndarray:
    """(leaf, subject): the parts that subjects have in each leaf, by its `top` most discriminative terms.

    A term's weight in a leaf is how much more often the leaf's documents have it than all documents;
    what it says of subjects is how much more of its labelled documents one subject has than by chance.
    A leaf whose terms don't speak for one or two subjects, as where documents hold stock phrases only,
    has no parts.
    """
    spread = np.maximum(held.sum(axis=0), 1e-12) / max(size.sum(), 1)
    rate = told / np.maximum(labelled[:, None], 1)
    says = np.maximum(rate / np.maximum(rate.sum(axis=0), 1e-12) - 1.0 / len(rate), 0) * (told.sum(axis=0) > 1)
    parts = np.zeros((len(held), len(told)))
    for leaf in range(len(held)):
        share = held[leaf] / max(size[leaf], 1)
        weight = share * np.log(np.maximum(share, 1e-12) / spread)
        best = np.argsort(-weight, kind="stable")[:top]
        best = best[weight[best] > 0]
        score = (says[:, best] @ weight[best]) ** 2
        if score.sum() > 0:
            parts[leaf] = score / score.sum()
    clear = np.sort(parts, axis=1)[:, -2:].sum(axis=1) >= CLEAR
    return np.where(clear[:, None] & (parts >= PART), parts, 0.0)


# --- mixtures of leaves ----------------------------------------------------------------------------


def subject_counts(parts: np.ndarray, held: np.ndarray, told: np.ndarray, rounds: int = 3) -> np.ndarray:
    """(subject, bucket): the documents that hold each term, by leaf parts, and those labelled by hand.

    The documents of a leaf with two parts are divided for each term: in proportion to the parts and to
    the subjects' shares of the term, first as the labelled documents have them, then as all leaves do.
    """
    pure = (parts > 0).sum(axis=1) == 1
    alone = (parts[pure] > 0).T.astype(np.float32) @ held[pure] + np.float32(BY_HAND) * told
    counts = alone
    for step in range(rounds):
        share = _shares(told if step == 0 else counts) + 0.02
        counts = alone.copy()
        for leaf in np.flatnonzero(parts.any(axis=1) & ~pure):
            of = np.flatnonzero(parts[leaf])
            lean = share[of] * parts[leaf, of][:, None]
            counts[of] += held[leaf] * lean / lean.sum(axis=0)
    return counts


@dataclass
class Mixture:
    """The parts of leaves with the weights that terms have in them.

    A term speaks for one subject, so its weights are kept for that subject's parts alone: part
    `first[s] + j` is the j-th of subject s.
    """

    subject: np.ndarray  # of each part; parts are in order of their subjects
    first: np.ndarray  # part of each subject
    row: np.ndarray  # of each bucket in `weights`, -1 where no part has the term
    speaks: np.ndarray  # the subject of each row
    weights: np.ndarray  # (rows, most parts of a subject)

    def assign(self, terms: np.ndarray, sizes: np.ndarray, least: float = 1.0) -> np.ndarray:
        """The part of each sentence, -1 where no term speaks for one."""
        out = np.full(len(sizes), -1)
        row = self.row[terms]
        held = np.flatnonzero(row >= 0)
        if not len(held):
            return out
        row = row[held]
        key = np.repeat(np.arange(len(sizes)), sizes)[held] * len(self.first) + self.speaks[row]
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))  # of a sentence's terms that speak for one subject
        best, score = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
        step, at = max(1, (1 << 22) // self.weights.shape[1]), 0
        while at < len(starts):  # so many entries at a time
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
            last = starts[end] if end < len(starts) else len(row)
            scores = np.add.reduceat(self.weights[row[starts[at] : last]], starts[at:end] - starts[at], axis=0)
            best[at:end] = scores.argmax(axis=1)
            score[at:end] = scores[np.arange(end - at), best[at:end]]
            at = end
        sentence, subject = np.divmod(key[starts], len(self.first))
        rank = np.lexsort((subject, -score, sentence))
        top = rank[np.diff(sentence[rank], prepend=-1) > 0]
        top = top[score[top] >= least]
        out[sentence[top]] = self.first[subject[top]] + best[top]
        return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Each bucket's shares of the subjects (rows); a large subject doesn't attract terms."""
    rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return rate / np.maximum(rate.sum(axis=0, keepdims=True), 1e-12)


def mixture(parts: np.ndarray, held: np.ndarray, size: np.ndarray, share: np.ndarray, strong: np.ndarray) -> Mixture:
    """The mixture in which a term speaks for the subject that it is strong in, and among that subject's
    leaves more for those whose documents hold it more often.

    `share` and `strong` are (subject, bucket); a term is strong in one subject at most.
    """
    subject, leaf = np.nonzero(parts.T)
    first = np.searchsorted(subject, np.arange(len(share)))
    active = np.flatnonzero(strong.any(axis=0) & np.isin(share.argmax(axis=0), subject))
    row = np.full(BUCKETS, -1, dtype=np.int32)
    row[active] = np.arange(len(active))
    speaks = share[:, active].argmax(axis=0)
    weights = np.zeros((len(active), np.bincount(subject).max()), dtype=np.float32)
    for s in np.unique(subject):
        of, terms = leaf[subject == s], np.flatnonzero(speaks == s)
        often = (held[of][:, active[terms]] + 0.5) / (size[of][:, None] + 1)
        lean = np.maximum(np.log(often / often.max(axis=0)), -5.0)  # 0 for the leaf that has it most
        weights[terms, : len(of)] = (np.log(share[s, active[terms]] * len(share)) * (1 + 0.05 * lean)).T
    return Mixture(subject, first, row, speaks, weights)


def _by_document(batch: pa.RecordBatch, mixed: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, sizes, document, part) of the sentences of a batch."""
    terms, _ = _lists(batch.column("terms"))
    sizes, count = _lists(batch.column("sizes"))
    return terms, sizes, np.repeat(np.arange(len(batch)), count), mixed.assign(terms, sizes)


def document_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, leaves: int = LEAVES, seed: int = 7
) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document and the share of its sentences.

    A subject counts from a quarter of the sentences that have one. Documents without such sentences,
    null and empty texts have no row; null, unknown and repeated labels are ignored. Ids that repeat
    give a row per text.
    """
    names = sorted(r[0] for r in subjects.where(F.col("subject").isNotNull()).select("subject").distinct().collect())  # a fixed table
    spark = documents.sparkSession
    nothing = spark.createDataFrame([], "doc_id long, subject string, share double")
    if not names:
        return nothing
    spoken = cut(sentence_terms(documents))
    found = cluster(spoken, BRANCHES, leaves, seed)
    held, size = leaf_terms(spoken, found)
    numbered = spark.createDataFrame(list(enumerate(names)), "_number long, subject string")
    known = labels.join(F.broadcast(numbered), "subject").select("doc_id", F.col("_number").alias("subject")).distinct()  # a row per subject is sent
    told, labelled = told_terms(spoken, known, len(names))
    parts = leaf_parts(held, size, told, labelled)
    if not parts.any():
        return nothing
    counts = subject_counts(parts, held, told)
    share = _shares(counts)
    mixed = mixture(parts, held, size, share, (share >= CONCENTRATED) & (counts.sum(axis=0) >= 3))
    of_part = np.zeros((len(mixed.subject), len(names)))
    of_part[np.arange(len(mixed.subject)), mixed.subject] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, document, part = _by_document(batch, mixed)
            clear = part >= 0
            kinds = len(mixed.subject)
            of_leaves = np.bincount(document[clear] * kinds + part[clear], minlength=len(batch) * kinds).reshape(-1, kinds)
            of_leaves = of_leaves / np.maximum(of_leaves.sum(axis=1, keepdims=True), 1)  # the document as a mixture of leaves
            shares = of_leaves @ of_part
            at, subject = np.nonzero(shares >= MIN_SHARE - 1e-9)
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at)), pa.array([names[s] for s in subject], pa.string()), pa.array(shares[at, subject])],
                names=["doc_id", "subject", "share"],
            )

    return spoken.mapInArrow(run, "doc_id long, subject string, share double")


def corpus_by_subject(found: DataFrame) -> DataFrame:
    """Per subject: documents, and documents weighed by their share of it."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("share"), 3).alias("weight"))
