"""Files as rows: scans, archives, ingestion into workspaces.

`files` has workspace_id, path, filename, extension, content, size_bytes, sha256, encoding, file_type, scanned_at.
"""

from __future__ import annotations

import io
import zipfile
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import MAX_MB
from ..functions.text import decoded, decoded_replacing, encoding, extension, file_type, sha256

_MEMBERS = "path string, filename string, content binary, damage string"


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of every file below a folder; paths are relative to it. Empty files, which Spark's source passes over, are there."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    listed = spark.createDataFrame([(unquote(f),) for f in rows.inputFiles()], "listed string")  # names alone, as the source's own index has them
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    empty = listed.join(rows.select(bare("path").alias("seen")), bare(F.col("listed")) == F.col("seen"), "left_anti").select(F.col("listed").alias("path"), F.lit(b"").alias("content"))
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    inside = F.element_at(F.split(F.col("path"), "\\Q" + root + "/\\E", 2), 2)
    return rows.unionByName(empty).select(inside.alias("path"), F.element_at(F.split(inside, "/"), -1).alias("filename"), "content")


def members(files: DataFrame) -> DataFrame:
    """path, filename, content, damage of what archives hold: a row for each member up to the first that can't be read.

    In the place of what can't be read there is one row with the archive's path and what is wrong (`damage`; null elsewhere): a file
    that is no archive has that row alone. Folders are left out. Only archives go through Python, one member at a time.
    """

    def unzip(batches):
        import zlib

        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("filename", pa.string()), ("content", pa.binary()), ("damage", pa.string())])
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield pa.RecordBatch.from_pydict({"path": [f"{path}!/{i.filename}"], "filename": [i.filename.rsplit("/", 1)[-1]], "content": [z.read(i)], "damage": [None]}, schema)
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError) as e:  # no archive, cut short, data that don't inflate, a checksum, a password, an unknown method
                    yield pa.RecordBatch.from_pydict({"path": [path], "filename": [None], "content": [None], "damage": [f"{type(e).__name__}: {e}"]}, schema)

    return files.select("path", "content").mapInArrow(unzip, _MEMBERS)


def expanded(files: DataFrame, *, keep: list[str] | None = None, flat: bool = False) -> DataFrame:
    """files, each archive replaced by its members: path `archive!/member` (or its base name if flat). Archives in archives stay closed.

    Folders are left out, and with `keep` members with other extensions. Of a damaged archive the members before the damage are given,
    and `damaged` tells of it; of a file that is no archive, none.
    """
    archive = extension(F.col("filename")) == ".zip"
    found = members(files.where(archive)).where("damage IS NULL").drop("damage")
    if keep is not None:
        found = found.where(extension(F.col("filename")).isin([e for e in keep if e != ".zip"]))
    if flat:
        found = found.withColumn("path", F.col("filename"))
    return files.where(~archive).select("path", "filename", "content").unionByName(found)


def damaged(files: DataFrame) -> DataFrame:
    """path, damage of archives that can't be read to their end."""
    return members(files.where(extension(F.col("filename")) == ".zip")).where("damage IS NOT NULL").select("path", "damage")


def described(files: DataFrame, workspace_id: Column | str, at: Column | None = None, mode: str = "reference") -> DataFrame:
    """files with extension, size, hash, encoding and type: one projection."""
    content = F.col("content")
    return files.select(
        (F.lit(workspace_id) if isinstance(workspace_id, str) else workspace_id).alias("workspace_id"), "path", "filename", extension(F.col("filename")).alias("extension"), "content",
        F.octet_length("content").cast("long").alias("size_bytes"), sha256(content).alias("sha256"), encoding(content, mode).alias("encoding"),
        file_type(F.col("filename"), content).alias("file_type"), (F.current_timestamp() if at is None else at).alias("scanned_at"),
    )


def scan(spark: SparkSession, folder: str, workspace_id: str = "default", at: Column | None = None) -> DataFrame:
    """A workspace folder's files, archives opened, in the order of their paths."""
    return described(expanded(scan_folder(spark, folder)), workspace_id, at).orderBy("path")


class Workspaces:
    """Workspaces as partitions of one Parquet table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, workspace_id: str) -> str:
        if not workspace_id or "/" in workspace_id or workspace_id.startswith("."):
            raise ValueError(f"{workspace_id!r} can't name a workspace")
        return f"{self.root}/workspace_id={workspace_id}"

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, workspace_id: str) -> bool:
        self._recover(workspace_id)
        fs, p = self._at(self.path(workspace_id))
        return fs.exists(p)

    def _recover(self, workspace_id: str) -> None:
        """Puts back what a lost driver had moved aside and not replaced."""
        fs, to = self._at(self.path(workspace_id))
        old = self._at(f"{self.root}/_old-{workspace_id}")[1]
        if fs.exists(old):
            if fs.exists(to):
                fs.delete(old, True)
            elif not fs.rename(old, to):
                raise OSError(f"{to} can't be put back")

    def save(self, workspace_id: str, files: DataFrame) -> None:
        """Writes a workspace whole or not at all: to a folder beside it, which then takes its place.

        The old one is moved aside before and removed after, so that a driver that is lost between leaves one of the two.
        """
        self._recover(workspace_id)
        fs, to = self._at(self.path(workspace_id))
        beside, old = (self._at(f"{self.root}/{kind}-{workspace_id}")[1] for kind in ("_new", "_old"))
        files.drop("workspace_id").write.mode("overwrite").parquet(beside.toString())
        if fs.exists(to) and not fs.rename(to, old):
            raise OSError(f"{to} can't be moved aside")
        self._move(fs, beside, to)
        fs.delete(old, True)

    def _move(self, fs, beside, to) -> None:
        if not fs.rename(beside, to):
            raise OSError(f"{to} can't be written")

    def get(self, workspace_id: str) -> DataFrame:
        if not self.exists(workspace_id):
            raise FileNotFoundError(f"workspace {workspace_id!r} not found")
        return self.spark.read.parquet(self.path(workspace_id)).withColumn("workspace_id", F.lit(workspace_id))

    def all(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(f"{self.root}/workspace_id=*")

    def delete(self, workspace_id: str) -> bool:
        self._recover(workspace_id)
        fs, p = self._at(self.path(workspace_id))
        return fs.delete(p, True)


#: Rejected files that an error names; it says how many more there are.
TOLD = 20


def ingest(uploads: DataFrame, workspaces: Workspaces, workspace_id: str, *, max_mb: int | None = None, at: Column | None = None) -> DataFrame:
    """Validates a batch of (filename, content), opens its archives and saves it as a workspace; one bad file rejects the batch.

    Names lose any folder, so that none leaves the workspace; members that end up with the same name are kept, marked by `collides`.
    """
    from ..functions.fixed import UPLOADS
    from ..operators.validate import rejected

    bad = rejected(uploads, max_mb or MAX_MB)
    told = bad.orderBy("filename").limit(TOLD).collect()
    if told:
        more = bad.count() - len(told)
        raise ValueError("; ".join(f"{r.filename}: {r.reason}" for r in told) + (f"; and {more} more" if more else ""))
    base = F.element_at(F.split(F.regexp_replace("filename", r"\\", "/"), "/"), -1)
    files = expanded(uploads.select(base.alias("path"), base.alias("filename"), "content"), keep=UPLOADS, flat=True)
    from pyspark.sql import Window

    rows = described(files, workspace_id, at).withColumn("collides", F.count("*").over(Window.partitionBy(F.lower("filename"))) > 1)
    workspaces.save(workspace_id, rows)
    return workspaces.get(workspace_id)


def sources(files: DataFrame, strict: bool = True) -> DataFrame:
    """path, text of files: strictly decoded, or with replacement characters for what isn't valid."""
    text = decoded(F.col("content")) if strict else decoded_replacing(F.col("content"))
    return files.select("path", text.alias("text")).where("text IS NOT NULL")


def undecodable(files: DataFrame) -> DataFrame:
    """Files that no strict encoding reads: the quarantine of `sources`."""
    return files.where(decoded(F.col("content")).isNull())


def read_sources(spark: SparkSession, folder: str, strict: bool = True, max_mb: int | None = None) -> DataFrame:
    """path, text of the COBOL files below a folder, none over the upload limit: that bounds what one task holds. `too_large` has the others."""
    return sources(_cobol(spark, folder).where(F.octet_length("content") <= _bytes(max_mb)), strict)


def too_large(spark: SparkSession, folder: str, max_mb: int | None = None) -> DataFrame:
    """path, size_bytes of the COBOL files that `read_sources` leaves out."""
    return _cobol(spark, folder).select("path", F.octet_length("content").cast("long").alias("size_bytes")).where(F.col("size_bytes") > _bytes(max_mb))


def _cobol(spark: SparkSession, folder: str) -> DataFrame:
    return scan_folder(spark, folder).where(file_type(F.col("filename")) == "COBOL")


def _bytes(max_mb: int | None) -> int:
    return (MAX_MB if max_mb is None else max_mb) * 1024 * 1024


FILES = "workspace_id string, path string, filename string, extension string, content binary, size_bytes long, sha256 string, encoding string, file_type string, scanned_at timestamp"
