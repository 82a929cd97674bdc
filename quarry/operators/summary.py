"""Inventories and summaries of workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FILE_TYPES


def by_type(files: DataFrame) -> DataFrame:
    """file_type, count, size_bytes, the most frequent first, ties in the types' order; types without files are left out."""
    rows = files.groupBy("file_type").agg(F.count("*").alias("count"), F.sum("size_bytes").alias("size_bytes"))
    return rows.orderBy(F.desc("count"), F.array_position(F.array(*map(F.lit, FILE_TYPES)), F.col("file_type")))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))


def inventory(files: DataFrame) -> DataFrame:
    """A workspace's files without their content, in the order of their paths."""
    return files.drop("content").orderBy("path")
