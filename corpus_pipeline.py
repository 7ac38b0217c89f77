"""The corpus pipeline: documents go through the stages in order, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brackwater.llm import mixing, packing, quality, similar, simhash, toxicity
from brackwater.llm.common import read, ship, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return toxicity.toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the fences of their language and source go, and those that fail the base rules."""
    return quality.quality_verdicts(docs).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: those whose five-word shingles are similar at 0.8 or more. They are grouped by SimHash fingerprints and measured; what these miss is found by bands."""
    ship(spark)
    return simhash.one_of_each(docs, printed=similar.prints, grouped=similar.similar_roots)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the raked weights."""
    return mixing.mixed(docs).where("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences, with digests of their ids."""
    ship(spark)
    return packing.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the trained coders, the components and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
