"""Corpus preparation: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.llm.blocks import block_count
from kinolake.llm.mixing import mix_sources
from kinolake.llm.near_copies import drop_near_copies
from kinolake.llm.packing import pack_documents
from kinolake.llm.queries import packable
from kinolake.llm.simhash_dedup import keep_with_prints
from kinolake.llm.toxicity import fit_toxicity, score_toxicity
from kinolake.llm.window_dedup import dedup_windows
from kinolake.session import in_buckets, scratch_path

BUCKET_BYTES = 32 << 20  # text of one bucket


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores as toxic go; it learns from the labels outside the held-out fifth."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("score < 0.5").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Groups of fingerprints within two bits first; of what stays, near copies that further SimHash views
    bring together and five-word shingles confirm (similarity 0.8 or more).
    """
    # in buckets of the fingerprint, so that the second step moves no texts but those that meet a candidate
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), block_count(docs, F.col("text"), BUCKET_BYTES))
    kept = in_buckets(keep_with_prints(docs, name="_llm_print", partitions=buckets), "_llm_print", buckets, "near-duplicates")
    return drop_near_copies(kept, "_llm_print").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows seen before go; the others are joined by one space."""
    kept = dedup_windows(docs)
    return (kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long"))
            .select(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none."""
    mixed, _ = mix_sources(docs)
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.where("taken > 0").withColumn("_llm_copy", F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin; copies of a document lie in different bins."""
    return pack_documents(packable(docs))


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_duplicate_stage),
          ("substring_dedup", substring_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
