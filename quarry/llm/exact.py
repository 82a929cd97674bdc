"""Exact dedup against a persistent digest index, bucketed and sorted by digest. DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Manifest, names_in, only, partitions, qualified, remove, row_id, scratch, staged, table_name

INDEX = "digest string, keep_id long, batch string"
#: What Spark names the files of one write by.
_WRITE = re.compile(r"^part-\d+-([0-9a-f-]{36})")


def normalised(text: str) -> F.Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, "")


class DigestIndex:
    """Digests of all texts seen so far, each with the id of the row that stays for it.

    A table of Parquet files at `path`, in buckets by digest and sorted within them, so that new digests meet it in a sort-merge join
    without moving it. Each batch appends its files; the path alone opens the index again in another session. The number of buckets
    is that of shuffle partitions when the index is made, unless given, and stays with the index.

    A manifest names the batches that are in and the write that brought each. Files of other writes are what a lost driver left: they
    are removed before the next batch, so a batch that was cut short can be added again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, qualified(spark, path)
        self.manifest = Manifest(spark, self.path)
        state = self.manifest.read()
        if not state:
            state = {"buckets": buckets or partitions(spark), "batches": {}}
            self.manifest.write(state)
        if buckets is not None and buckets != state["buckets"]:
            raise ValueError(f"the index at {path} has {state['buckets']} buckets, not {buckets}")
        self.buckets = state["buckets"]
        self.name = f"{table_name('digest_index', self.path)}_{self.buckets}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def batches(self) -> list[str]:
        return list(self.manifest.read()["batches"])

    def _writes(self) -> dict[str, list[str]]:
        """The files that are there, by the write they come from."""
        found: dict[str, list[str]] = {}
        for n in names_in(self.spark, f"{self.path}/digests"):
            if m := _WRITE.match(n):
                found.setdefault(m[1], []).append(n)
        return found

    def _clean(self) -> None:
        """Removes what a lost driver left."""
        known = set(self.manifest.read()["batches"].values())
        for write, names in self._writes().items():
            if write not in known:
                for n in names:
                    remove(self.spark, f"{self.path}/digests/{n}")
        self.spark.catalog.refreshTable(self.name)

    def _append(self, rows: DataFrame, batch: str) -> None:
        state = self.manifest.read()
        known = set(state["batches"].values())
        rows.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        new = [w for w in self._writes() if w not in known]
        if len(new) > 1:
            raise RuntimeError(f"two writers at {self.path}")
        self.manifest.write(state | {"batches": state["batches"] | {batch: new[0] if new else ""}})

    def add(self, docs: DataFrame, *, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Deduplicates a batch against the index and itself, and appends its new digests.

        Returns one row for each row of `docs`: key, keep_id, group_size (rows of this batch with the text), kept, text_sha256. A text
        that the index has keeps the row it had; of a new text the row with the most code points, then the smallest key, stays. Null
        and empty texts are one group. Rows that repeat the key are rows of their own; if the same key and text length repeat, all of
        them are the row that stays, so `kept` marks each. Null keys come last. Other columns are not read.

        `batch` names the batch. One that is in the index is not appended again, and gives the result that it gave; ValueError if it
        had other texts then.
        """
        return self._add(docs, key, text, batch).drop("_k", "_h")

    def _add(self, docs: DataFrame, key: str, text: str, batch: str) -> DataFrame:
        rows = docs.select(*row_id(key, text), F.col(key).cast("long").alias("key"), F.sha2(normalised(text), 256).alias("digest"), F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("chars"))
        rows = staged(rows, "digests")
        groups = rows.groupBy("digest").agg(F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("key").isNull().alias("no_key"), "key")).alias("first"), F.count("*").alias("group_size"))
        groups = staged(groups.select("digest", F.col("first.key").alias("keep_id"), F.col("first.shorter").alias("shorter"), "group_size"), "groups")
        self._clean()
        new = groups.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        if batch not in self.batches():
            self._append(new, batch)
        elif not new.isEmpty():
            raise ValueError(f"batch {batch!r} is in the index, with other texts")
        stays = self.table().select("digest", F.col("keep_id").alias("index_keep"), (F.col("batch") == batch).alias("is_new"))
        # written first, so that both sides of the next join are dealt anew and a digest with very many rows can be split
        groups = staged(groups.join(stays.hint("merge"), "digest").select("digest", "index_keep", "is_new", "shorter", "group_size"), "decided")
        return (
            rows.join(groups.hint("merge"), "digest")
            .select(F.col("key").alias(key), F.col("index_keep").alias("keep_id"), "group_size", (F.col("is_new") & F.col("key").eqNullSafe(F.col("index_keep")) & (F.col("chars") == -F.col("shorter"))).alias("kept"), F.col("digest").alias("text_sha256"), "_k", "_h")
        )


def exact_groups(docs: DataFrame, **columns: str) -> DataFrame:
    """`DigestIndex.add` over all of `docs` with a fresh index in the shared folder."""
    spark = docs.sparkSession
    return DigestIndex(spark, scratch(spark, "digest-index")).add(docs, batch="all", **columns)


def exact_deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' own columns, one row of each group of equal texts."""
    spark = docs.sparkSession
    groups = DigestIndex(spark, scratch(spark, "digest-index"))._add(docs, key, text, "all")
    return only(docs, groups.where("kept"), key=key, text=text)
