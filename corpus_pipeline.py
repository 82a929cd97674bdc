"""The corpus pipeline: quality, exact dedup, near dedup, mixing and packing, each stage over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.common import staged, table
from quarry.llm.exact import exact_deduplicated
from quarry.llm.mixing import mix, substance
from quarry.llm.packing import pack
from quarry.llm.queries import bpe_50k
from quarry.llm.simhash import near_deduplicated


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the neighbour vote predicts to be of label 1."""
    voter = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, kept = ("_".join([*docs.columns, mark]) for mark in ("score", "kept"))  # longer than any column's name, so none of them
    return quality.score(docs, voter, to=(score, kept)).where(F.col(kept) == 1).drop(score, kept)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target: a document stands in the result 0, 1 or 2 times.

    Stages hand on the documents' own columns, and this one is of DataFrame operations only, so the first stage's score isn't at hand:
    the weight is computed from the text.
    """
    return mix(docs, weight=substance(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, bpe_50k())


STAGES = [("quality", good_quality), ("exact-dedup", without_copies), ("near-dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: The fitted classifier and the linking of fingerprints have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
