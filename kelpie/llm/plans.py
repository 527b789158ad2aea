"""Queries over text and code: origin (p1), pieces (p2), credentials (p3), containers (p6), mixtures (p7), subjects (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import credentials, mixing, origin, packing, pieces, subjects
from kelpie.llm.tokens import with_token_counts
from kelpie.session import cut, table


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "indexed_files"), table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "upstream_files")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.foreign_files(*_code(spark, sf_dir))


def p1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.file_origins(*_code(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("prepared_docs", "locate_hits", "code_chunks", "size_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_items(*_sized(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.all_pieces(*_sized(spark, sf_dir))


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of all pieces: none is over its limit, and an item's pieces less their overlaps are the item."""
    docs, hits, chunks, sizes = _sized(spark, sf_dir)
    limits = sizes.select("item_kind", "max_size", "overlap_size")  # a row per kind
    items = pieces.all_pieces(docs, hits, chunks, sizes, with_text=False).groupBy("item_kind", "item_id", "section_no").agg(
        F.max("piece_size").alias("largest"), F.sum("piece_size").alias("total"), F.max("item_size").alias("size"), F.max("n_pieces").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    joined = items.join(F.broadcast(limits), "item_kind")
    whole = (F.col("total") == F.col("size") + (F.col("n") - 1) * F.col("overlap_size")) & (F.col("rows") == F.col("n"))
    return joined.groupBy("item_kind").agg(
        F.count_if((F.col("item_kind") == "hit") | (F.col("size") < 0)).alias("hits"), F.count_if(F.col("largest") > F.col("max_size")).alias("too_large"), F.count_if(~whole).alias("not_whole")
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.stored_texts(table(spark, sf_dir, "locate_hits"), table(spark, sf_dir, "prepared_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credentials_in(_stored(spark, sf_dir)).select("item_kind", "item_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(_stored(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    capacity, _ = pieces.limits(table(spark, sf_dir, "size_limits"), "container")
    return packing.pack(counted, capacity)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized(_packed(spark, sf_dir))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of all containers: every text is placed once, none is overfull, none holds part of a text that fits."""
    capacity, _ = pieces.limits(table(spark, sf_dir, "size_limits"), "container")
    packed = cut(_packed(spark, sf_dir))
    loads = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("piece_size").alias("load"))
    items = packed.groupBy("doc_id").agg(F.sum("piece_size").alias("size"), F.count(F.lit(1)).alias("n"))
    placed = items.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("size") <= capacity)).alias("split"), F.sum("size").alias("tokens"))
    filled = loads.agg(F.count_if(F.col("load") > capacity).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    both = placed.withColumn("_one", F.lit(1)).join(filled.withColumn("_one", F.lit(1)), "_one")  # a row each
    least = F.ceil(F.col("tokens") / F.lit(float(capacity)))
    return both.select("documents", "split", "overfull", (F.col("containers") > least * 1.01 + 1).cast("int").alias("wasteful"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unmet_by_mixture(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixtures(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.mixture_shares(documents, targets, mixing.mixtures(documents, targets))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of each mixture: a row per target, no document above its cap, no target missed that can be met by half a percent."""
    shares = p7_shares(spark, sf_dir)
    off = F.abs(F.col("mixed_tokens") - F.col("wanted_tokens")) > F.greatest(F.col("wanted_tokens") * 0.005, F.lit(40_000.0))
    return shares.groupBy("mix_id").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(~F.col("short") & off).alias("missed")
    )


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.corpus_by_subject(_subjects(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_origins": p1_origins,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_invariants": p2_invariants,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_mixtures": p7_mixtures,
    "p7_invariants": p7_invariants,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_corpus": p8_corpus,
}
#: What must hold of the operators' results, counted from the tables alone.
SQL: dict[str, str] = {
    "p2_invariants": """
SELECT 'section' AS item_kind, 0 AS hits, 0 AS too_large, 0 AS not_whole
UNION ALL SELECT 'hit', COUNT(*), 0, 0 FROM locate_hits WHERE end_line - start_line + 1 > (SELECT max_size FROM size_limits WHERE item_kind = 'hit')""",
    "p6_invariants": "SELECT COUNT(*) AS documents, 0 AS split, 0 AS overfull, 0 AS wasteful FROM documents",
    "p7_invariants": "SELECT mix_id, COUNT(DISTINCT source) AS targets, 0 AS over_cap, 0 AS missed FROM mix_targets GROUP BY mix_id",
}
