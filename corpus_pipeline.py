"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import decontaminate, packing, quality_votes, simhash
from panelloom.sources.tables import materialise

LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the labelled neighbours vote down go: those with a score under LEAST_QUALITY."""
    votes = quality_votes.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_votes.keep(docs, votes, least=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row with the smallest doc_id stays, one if that id repeats.

    A row without an id goes by a number from its text that is larger than any id. Rows are told apart by id
    and text, as one id may be on texts of several groups.
    """
    key, digest = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))), F.xxhash64("text")
    groups = simhash.grouped(docs.select(key.alias("doc_id"), "text", digest.alias("digest")), extra=["digest"])
    least = groups.where("doc_id = component_id").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies"))
    kept = least.groupBy("root", F.col("doc_id").alias("kept_id")).agg(F.min(F.struct("digest", "copies")).alias("first"))
    kept = materialise(kept.select("kept_id", F.col("first.digest").alias("kept_digest"), "first.copies"), "kept")

    def same(some: DataFrame) -> Column:
        return (key == some["kept_id"]) & (digest == some["kept_digest"])

    repeated = kept.where("copies > 1")
    if not repeated.limit(1).count():
        # ids are hashed per partition and texts stream past them: no text is sorted
        return docs.join(kept.hint("shuffle_hash"), same(kept), "left_semi")
    once = kept.where("copies = 1")
    single = docs.join(once.hint("shuffle_hash"), same(once), "left_semi")
    several = docs.join(repeated.hint("shuffle_hash"), same(repeated)).groupBy("kept_id", "kept_digest").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.union(several.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of benchmark items are cut out, and rows that are mostly such words go; n_chars follows."""
    clean = decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of several lengths, without their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
