"""Retrieval: postings, phrase matching, BM25, vector scan, hybrid fusion, over batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.scalars import age_decay, clamp01, cosine, min_max, tokens
from kelpie.session import cut


def of_ids(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `df` (id and others) whose id `chosen` has. The ids are sent to them a block at a time; `df`, whose
    texts Spark takes to be a few bytes each, is neither broadcast nor moved."""
    found = None
    for block in _in_blocks(cut(chosen.select("id").distinct()), "id", ID_BLOCK):
        part = df.join(block, "id")
        found = part if found is None else found.unionByName(part)
    return found


def tokenised(df: DataFrame, id_column: str, texts: list[str], besides: tuple[str, ...] = ()) -> DataFrame:
    """(id, terms, length), and columns kept besides: the tokens of all text columns in a row, and how many there are."""
    terms = F.concat(*[tokens(F.col(t)) for t in texts])
    return df.select(F.col(id_column).alias("id"), terms.alias("terms"), *besides).withColumn("length", F.size("terms").cast("long"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, phrases, words) of queries (query_id, query): each phrase's number, how many there are, its tokens.

    A query is split at white space, its words stripped of quotes and stops; each word is a phrase of
    the tokens in it. Words without tokens are dropped; a query without phrases has no row.
    """
    words = F.transform(F.split(F.trim(F.col("query")), r"\s+"), lambda w: F.btrim(w, F.lit("\"',.:;")))
    phrases = F.filter(F.transform(words, tokens), lambda p: F.size(p) > 0)
    return queries.select("query_id", phrases.alias("_p")).select(
        "query_id", F.size("_p").alias("phrases"), F.posexplode("_p").alias("phrase", "words")
    )


ALL = ""  # stands for a word that every document has once; no token is empty
PHRASE_BLOCK = 1 << 16  # phrases that are sent to the executors at once
TEXT_BLOCK = 4096  # texts of queries, likewise
ID_BLOCK = 1 << 16  # ids of rows that are looked up, likewise


def _in_blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """`df`, which is materialised, in parts of about `most` rows that may be broadcast."""
    blocks = max(1, -(-df.count() // most))
    number = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [F.broadcast(df.where(number == n) if blocks > 1 else df) for n in range(blocks)]


def _numbered(asked: DataFrame) -> DataFrame:
    """`asked`, materialised, with `number`, an int from 0 on without gaps."""
    placed = cut(asked.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    before, offsets = 0, [F.lit(-1), F.lit(0)]  # no part is -1
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per partition
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    row = F.col("_row") - F.shiftleft(part, 33)
    return placed.withColumn("number", (row + F.create_map(*offsets)[part.cast("int")]).cast("int")).drop("_row")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a document's columns, then `number`) of each document that follow one another as a row, with the
    numbers and how often each."""
    for batch in batches:
        if not len(batch):
            continue
        own = pc.fill_null(batch.column("id"), 0).to_numpy()
        first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        number = batch.column("number").to_numpy().astype(np.int64)
        run = np.repeat(np.arange(len(first)), np.diff(first, append=len(own)))
        key, n = np.unique(run << 32 | number, return_counts=True)
        offsets = pa.array(np.searchsorted(key >> 32, np.arange(len(first) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, n)]
        documents = [batch.column(i).take(pa.array(first)) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*documents, *lists], names=[*batch.schema.names[:-1], "numbers", "counts"])


def documents_held(docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, length, held) and the other columns of `docs`, materialised: every document with a map of the numbers of the
    asked `phrases` (words) that it holds and how often; and (phrase, number) of these, their words with blanks between.
    Every document holds `ALL` once.

    Documents are never joined by word and never broadcast, for Spark takes them to be no more when they
    are exploded. The phrases are sent to them instead, a block at a time, and found where their first word
    stands; tokens that begin none are dropped in the scan. A document's phrases are put in one row where it lies,
    as numbers, so that a row per document is all that is moved and kept.
    """
    asked = phrases.select("words").unionByName(phrases.sparkSession.createDataFrame([([ALL],)], "words array<string>")).distinct()
    asked = _numbered(asked.select(F.col("words")[0].alias("word"), F.array_join("words", " ").alias("phrase"), "words"))
    own = [c for c in docs.columns if c != "terms"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*own).schema)
    placed = docs.select(*own, "terms", F.posexplode(F.concat("terms", F.array(F.lit(ALL)))).alias("_at", "word"))
    found = None
    for block in _in_blocks(asked.select("word", "words", "number"), "word", PHRASE_BLOCK):
        part = placed.join(block, "word").where((F.size("words") == 1) | (F.slice("terms", F.col("_at") + 1, F.size("words")) == F.col("words")))
        part = part.select(*own, "number").mapInArrow(_gathered, f"{fields}numbers array<int>, counts array<int>")
        found = part if found is None else found.unionByName(part)
    parts = found.groupBy(*own).agg(F.collect_list(F.struct("numbers", "counts")).alias("_parts"))  # more than one where batches or blocks meet
    flat = parts.select(*own, *[F.flatten(F.col("_parts")[c]).alias(c) for c in ("numbers", "counts")])
    summed = lambda k: F.aggregate(F.arrays_zip("numbers", "counts"), F.lit(0), lambda n, e: n + F.when(e["numbers"] == k, e["counts"]).otherwise(0))
    keys = F.array_distinct("numbers")
    counts = F.when(F.size(keys) == F.size("numbers"), F.col("counts")).otherwise(F.transform(keys, summed))
    return cut(flat.select(*own, F.map_from_arrays(keys, counts).alias("held"))), asked.select("phrase", "number")


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, id, length, f): the documents that hold each of the distinct `phrases` (words), f times. Every
    document has a row for the phrase `ALL`."""
    held, numbered = documents_held(docs, phrases)
    hits, found = held.select("id", "length", F.explode("held").alias("number", "f")), None
    for block in _in_blocks(numbered, "number", PHRASE_BLOCK):
        part = hits.join(block, "number").select("phrase", "id", "length", F.col("f").cast("long").alias("f"))
        found = part if found is None else found.unionByName(part)
    return found


def holding_all(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id) of the documents that hold every phrase of a query (query_id, phrase)."""
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    held = asked.join(hits, "phrase").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("_held"))
    return held.join(wanted, "query_id").where("_held = _n").select("query_id", "id")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25), and the columns that `docs` has besides, of the documents that hold every phrase; smaller is better.

    k1 = 1.2, b = 0.75; an idf that isn't above 0 counts as 1e-6, so words of more than half of the
    documents hardly count. `docs` comes from `tokenised`. A document that holds every phrase holds the
    query's rarest one, so it meets only the queries whose rarest phrase it holds, a block of queries at a
    time; it is scored where it lies. A query with a phrase that no document holds has no row.
    """
    asked = query_phrases(queries).groupBy("query_id", "phrases", "words").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("phrase", F.array_join("words", " "))
    held, numbered = documents_held(docs, asked)
    besides = [c for c in docs.columns if c not in ("id", "terms", "length")]
    corpus = held.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()  # a row
    if not corpus["n"]:
        return held.select(F.lit(0).cast("long").alias("query_id"), "id", *besides, F.lit(0.0).alias("bm25"))  # no row
    known = held.select(F.explode(F.map_keys("held")).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(numbered, "phrase").join(known, "number").select("query_id", "phrases", "phrase", "number", "times", "df", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    whole = weighed.groupBy("query_id", "phrases").agg(
        F.min(F.struct("df", "phrase", "number"))["number"].alias("number"), F.array_sort(F.collect_list(F.struct("phrase", "number", "times", "idf"))).alias("all"), F.sum("times").alias("known")
    ).where("known = phrases").select("query_id", "number", F.transform("all", lambda p: F.struct(p["number"].alias("number"), p["times"].alias("times"), p["idf"].alias("idf"))).alias("all"))
    length = 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(corpus["mean"]))
    f = lambda p: F.col("held")[p["number"]]
    score = F.aggregate("all", F.lit(0.0), lambda total, p: total - p["times"] * p["idf"] * f(p) * 2.2 / (f(p) + length))
    exploded = held.select("id", "length", *besides, "held", F.explode(F.map_keys("held")).alias("number"))
    found = None
    for block in _in_blocks(cut(whole), "query_id", TEXT_BLOCK):
        part = exploded.join(block, "number").where(F.forall("all", lambda p: f(p).isNotNull())).select("query_id", "id", *besides, score.alias("bm25"))
        found = part if found is None else found.unionByName(part)
    return found


def once_per_text(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of queries (query_id, query), under the smallest query_id of each, and (asked_as, query_id) of all queries."""
    first = queries.groupBy("query").agg(F.min("query_id").alias("asked_as"))
    return first.select(F.col("asked_as").alias("query_id"), "query"), queries.join(first, "query").select("asked_as", "query_id")


def for_every_query(ranked: DataFrame, asked_as: DataFrame) -> DataFrame:
    """Rows of the distinct texts (query_id and others) as rows of all queries that ask them."""
    return ranked.withColumnRenamed("query_id", "asked_as").join(asked_as, "asked_as").drop("asked_as")


def top_per_query(scored: DataFrame, order: list, k: int, within: list[str] | None = None) -> DataFrame:
    """The first k rows per query (and other columns) in a total order, with their 1-based `rank`.

    Spark prunes each partition to k rows per group before the shuffle.
    """
    window = Window.partitionBy("query_id", *(within or [])).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


QUERY_BLOCK = 4096  # query vectors that are sent to the executors at once


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the right dimension, of length 1, and which rows they are; those without length stay 0."""
    good = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dimension)
    values = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return np.where(length > 1e-12, values / np.maximum(length, 1e-300), 0.0), good


def nearest(
    vectors: DataFrame, queries: DataFrame, dimension: int, k: int, least: float | None = 0.0, extra: tuple[str, ...] = (), score: Callable[..., np.ndarray] | None = None
) -> DataFrame:
    """(query_id, id, cos, score) of the k best vectors (id, vector, extra columns) for each query vector.

    Exact: every vector is scored against every query, a block of queries at a time. A block is bounded,
    so it may be sent to all executors; each task keeps k rows per query, by score and then id, and only
    those are compared across tasks. The score is the cosine rounded to 6 places unless
    `score(cosines, *extra)` says otherwise, cosines given as (vectors, queries). Vectors of another
    length or null are left out (see `corrupt`), those without length have cosine 0. Recall drops
    cosines under `least`, the code locator passes None.
    """
    names = ["query_id", "id", "cos", "score"]
    schema = "query_id long, id long, cos double, score double"
    fitting = vectors.where(F.size("vector") == dimension).select("id", "vector", *extra)
    asked = queries.where(F.size("vector") == dimension).select("query_id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))

    def scan(ids: np.ndarray, wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # query, id, cos, score
            bar = np.full(len(ids), -np.inf)  # the score of each query's k-th row so far
            for batch in batches:
                matrix, good = _matrix(batch.column("vector"), dimension)
                own = batch.column("id").to_numpy()[good]
                rest = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[good] for c in extra]
                at, step = 0, max(64, k)
                while at < len(own):
                    part = slice(at, at + step)
                    cos = matrix[part] @ wanted.T
                    points = np.round(cos, 6) if score is None else score(cos, *[r[part, None] for r in rest])
                    kept = points >= bar if least is None else (points >= bar) & (cos >= least)
                    row, query = np.nonzero(kept)
                    new = [query, own[part][row], cos[row, query], points[row, query]]
                    best = [np.concatenate(pair) for pair in zip(best, new)]
                    order = np.lexsort((best[1], -best[3], best[0]))
                    best = [b[order] for b in best]
                    first = np.searchsorted(best[0], best[0])
                    top = np.arange(len(first)) - first < k
                    best = [b[top] for b in best]
                    count = np.bincount(best[0], minlength=len(ids))
                    last = np.cumsum(count) - 1
                    bar = np.where(count == k, best[3][last] if len(last) and len(best[3]) else -np.inf, -np.inf)
                    at, step = at + step, min(2 * step, 1024)
            yield pa.record_batch([pa.array(ids[best[0]]), *map(pa.array, best[1:])], names=names)

        return run

    found = None
    for number in range(blocks):
        arrow = (asked if blocks == 1 else asked.where(block == number)).toArrow().combine_chunks()
        if not len(arrow):
            continue
        wanted, good = _matrix(arrow["vector"].chunk(0), dimension)
        part = fitting.mapInArrow(scan(arrow["query_id"].to_numpy()[good], wanted), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return top_per_query(found, [F.desc("score"), F.col("id")], k)


# --- approximate search ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Centres of the cells of an inverted file, of length 1."""

    centres: np.ndarray

    def number(self, vectors: DataFrame, probes: int = 1) -> DataFrame:
        """`vectors` (with `vector`) with `cell`, a row for each of its `probes` nearest cells."""
        centres, dimension = self.centres, self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix, good = _matrix(batch.column("vector"), dimension)
                near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
                out = batch.take(pa.array(np.repeat(good, near.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32))], names=[*out.schema.names, "cell"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
        return vectors.mapInArrow(run, f"{fields}, cell int")


def fit_cells(vectors: DataFrame, dimension: int, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 1) -> Cells:
    """Cells by k-means over at most `sample` vectors, those with the smallest hash of id; every vector is indexed by them later."""
    taken = vectors.where(F.size("vector") == dimension).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().combine_chunks()
    matrix = _matrix(taken["vector"].chunk(0), dimension)[0] if len(taken) else np.zeros((1, dimension))
    centres = matrix[np.random.default_rng(seed).permutation(len(matrix))[:cells]]
    for _ in range(rounds):
        owner = (matrix @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, matrix)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return Cells(centres)


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, cells: Cells, k: int, probes: int = 32) -> DataFrame:
    """(query_id, id, cos, rank) of about the k nearest: only vectors in a query's `probes` nearest cells are compared.

    Queries and vectors meet on cell and slice of the vector's id, so a full cell is no hot task. `nearest` is the exact way.
    """
    slices = 16
    stored = cells.number(vectors.select("id", "vector")).withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    asked = cells.number(queries.select("query_id", F.col("vector").alias("vector")), probes).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    paired = asked.withColumnRenamed("vector", "_asked").join(stored, ["cell", "_slice"])
    scored = paired.select("query_id", "id", F.round(cosine(F.col("vector"), F.col("_asked")), 6).alias("cos")).where("cos >= 0")
    return top_per_query(scored, [F.desc("cos"), F.col("id")], k)


def corrupt(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors that aren't of the dimension, null ones too."""
    return vectors.where(F.coalesce(F.size("vector") != dimension, F.lit(True)))


@dataclass(frozen=True)
class Weights:
    """Weights of the fusion; the penalties are subtracted after decay."""

    text: float = 0.5
    vector: float = 0.5
    stale: float = 0.3
    superseded: float = 0.4
    half_life_days: float = 0.0
    test_path: float = 0.9


def merge_candidates(lexical: DataFrame, vector: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of text and vector candidates: bm25 and cos, null where a side lacks the row."""
    return lexical.join(vector, keys, "full_outer").select(*keys, "bm25", "cos")


def normalised(candidates: DataFrame, per: list[str]) -> DataFrame:
    """`fts01`: bm25 scaled over the surviving pool of each query; the best is 1, the weakest 0, a lone one 1."""
    pool = Window.partitionBy(*per)  # at most the candidates of one query
    return candidates.withColumn("fts01", min_max(F.col("bm25"), F.min("bm25").over(pool), F.max("bm25").over(pool)))


def fused(candidates: DataFrame, weights: Weights) -> DataFrame:
    """`score` of candidates (fts01, cos, age_days, stale, superseded): decay before penalties, no floor."""
    relevance = weights.text * F.col("fts01") + weights.vector * clamp01(F.coalesce("cos", F.lit(0.0)))
    penalty = F.when(F.col("stale"), weights.stale).otherwise(0.0) + F.when(F.col("superseded"), weights.superseded).otherwise(0.0)
    return candidates.withColumn("score", relevance * age_decay(F.col("age_days"), weights.half_life_days) - penalty)


def fused_code(candidates: DataFrame, weights: Weights, is_test) -> DataFrame:
    """`score` of code candidates: text and vector parts, test paths discounted."""
    relevance = weights.text * F.col("fts01") + weights.vector * clamp01(F.coalesce("cos", F.lit(0.0)))
    return candidates.withColumn("score", relevance * F.when(is_test, weights.test_path).otherwise(1.0))
