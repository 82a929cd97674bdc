"""Checks of an upload batch: extension, emptiness, size, repeated names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import MAX_MB, UPLOADS
from ..functions.text import extension


def allowed(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("filename")).isin(UPLOADS))


def not_empty(files: DataFrame) -> DataFrame:
    return files.where(F.octet_length("content") > 0)


def small_enough(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    return files.where(F.octet_length("content") <= max_mb * 1024 * 1024)


def repeated_names(files: DataFrame, name: str = "filename", order: str | None = None) -> DataFrame:
    """The second and later files of each name, whatever its case."""
    w = Window.partitionBy(F.lower(name)).orderBy(order or name)
    return files.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def rejected(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    """filename, reason: for each file that fails, the first check it fails, in this order: repeated, extension, empty, too large."""
    w = Window.partitionBy(F.lower("filename")).orderBy("filename")
    ext = extension(F.col("filename"))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = (
        F.when(F.row_number().over(w) > 1, "duplicate file name").when(~ext.isin(UPLOADS), F.concat(F.lit("unsupported extension '"), ext, F.lit(f"'; allowed: {', '.join(sorted(UPLOADS))}")))
        .when(size == 0, "file is empty").when(size > max_mb * 1024 * 1024, f"file is larger than {max_mb} MB")
    )
    return files.select("filename", reason.alias("reason")).where("reason IS NOT NULL")
