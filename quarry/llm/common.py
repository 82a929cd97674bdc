"""What the training-data operators share: shared folders, code shipping, batch walking."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the data contracts define it: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (local runs)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(sc, "_quarry_root", None)
    if not root:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = sc._quarry_root = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system; one without a scheme is in the cluster's default file system."""
    fs, at = file_system(spark, path)
    full = fs.makeQualified(at).toString().rstrip("/")
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def table_name(kind: str, path: str) -> str:
    """A catalog name that no other path has."""
    return f"{kind}_{hashlib.md5(path.encode()).hexdigest()}"


class Manifest:
    """What counts of a folder of immutable files: numbered JSON files, of which the last one holds.

    A change is one rename of a finished file to the next number, so a driver that is lost at any point leaves the old state or the
    new one. One driver writes to a folder at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_manifest"  # Spark's readers skip names with an underscore

    def read(self) -> dict:
        """The state, empty where none has been written."""
        numbers = self._numbers()
        if not numbers:
            return {}
        fs, at = file_system(self.spark, f"{self.path}/{numbers[-1]:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names_in(self.spark, self.path) if n.endswith(".json")]

    def write(self, state: dict) -> None:
        numbers = self._numbers()
        to = f"{self.path}/{(numbers or [0])[-1] + 1:012d}.json"
        fs, beside = file_system(self.spark, f"{self.path}/new-{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(beside, file_system(self.spark, to)[1]):
            raise OSError(f"{to} can't be written")
        for n in numbers[:-1]:  # the one before stays, for whoever is reading it now
            remove(self.spark, f"{self.path}/{n:012d}.json")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_root(spark)}/quarry-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's file systems; a stopped session leaves it to the cluster's own clean-up."""
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the gateway may be gone by now
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that Python workers import it whatever their path is.

    Rows then go to Python in Arrow batches of at most ARROW_BYTES, so that texts of any length take little memory there.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if getattr(sc, "_quarry_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(at)
    sc._quarry_shipped = True


def slices(batches, rows: int = 256, chars: int = 4_000_000):
    """Cuts Arrow batches into small ones of at most `rows` rows (fewer where texts are very long), so that Python holds little at a time."""
    for b in batches:
        start = 0
        while start < b.num_rows:
            part = b.slice(start, rows)
            if part.num_rows > 1 and part.nbytes > chars:
                part = part.slice(0, max(1, part.num_rows * chars // part.nbytes))
            start += part.num_rows
            yield part


def rows_to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


ARROW_BYTES = 8 << 20
#: Stands for a null key where one is joined by it.
NO_KEY = -(1 << 63)


def row_id(key: str, text: str) -> list[Column]:
    """What tells rows apart by key and whole text, without nulls: _k and _h."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_k"), F.xxhash64(text_or_empty(text).cast("string")).alias("_h")]


def only(docs: DataFrame, kept: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose (_k, _h) is in `kept`; of rows that are equal in both, one. Texts are moved once."""
    rows = docs.select(F.struct("*").alias("_row"), *row_id(key, text)).join(kept.select("_k", "_h").hint("merge"), ["_k", "_h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_k", "_h").orderBy(F.lit(1)))
    return rows.withColumn("_n", first).where("_n = 1").select("_row.*")


def words_of(text: Column) -> Column:
    """A text's words `[^\\x20\\x09-\\x0D]+`; null has none. One compiled split, which several uses in a projection share."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def words_in(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")
