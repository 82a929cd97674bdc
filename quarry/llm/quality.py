"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Hashed byte trigrams a text is counted in; features beside them (words that repeat the word 1, 2 or 3 before); latent dimensions.
GRAMS, LAGS, DIMENSIONS = 2048, (1, 2, 3), 48
FEATURES = GRAMS + len(LAGS)
#: A repeated word counts as so many trigrams.
REPEAT = 16
#: At most so many labelled rows are fitted and broadcast: with 48 numbers each, 0.8 MB.
LABELLED = 4096
NEIGHBOURS, SHARPNESS = 25, 8


def counts(text: str) -> np.ndarray:
    """Counts of the whole text's byte trigrams, hashed to GRAMS numbers, and of its words that soon repeat. A text under three bytes has none."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    total = np.zeros(FEATURES, np.int64)
    if len(b) < 3:
        return total.astype(np.float32)
    words = text.split()
    for i, lag in enumerate(LAGS):
        total[GRAMS + i] = REPEAT * sum(map(eq, words, words[lag:]))
    for at in range(0, len(b) - 2, 1 << 20):  # a very long text takes no more memory than this
        c = b[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)
        total[:GRAMS] += np.bincount(h >> np.uint32(21), minlength=GRAMS)
    return total.astype(np.float32)


def scaled(x: np.ndarray, idf: np.ndarray | None = None) -> np.ndarray:
    x = np.sqrt(x) if idf is None else np.sqrt(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voter:
    """Latent vectors of the labelled sample; scores texts by their neighbours' labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        self.idf = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
        self.prior = float(y.mean()) if n else 0.5
        self.y = y.astype(np.float32)
        z = scaled(x, self.idf)
        rng = np.random.default_rng(0)
        d = max(1, min(DIMENSIONS, n, x.shape[1]))
        q = rng.standard_normal((x.shape[1], d)).astype(np.float32)
        for _ in range(8):  # subspace iteration: the leading right singular vectors
            q, _ = np.linalg.qr(z.T @ (z @ q)) if n else (q, None)
        self.basis = q.astype(np.float32)
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = scaled(x, self.idf) @ self.basis
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with every labelled vector, a block of texts at a time."""
        if not len(self.y):
            return np.full(len(x), self.prior)
        near = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(near, at, 1), 0, 1).astype(np.float64) ** SHARPNESS
        total = w.sum(axis=1)
        return np.where(total > 1e-12, (w * self.y[at]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 when divided by 3. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED) -> Voter:
    """Learns from at most `most` labelled documents that aren't held out, the first by a hash of the key.

    Only their hashed counts come to the driver (8 KB each). Null labels and keys are skipped; contradicting labels of a key count
    by their mean, and of texts that share a key the least counts. Without labels every text scores 0.5.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).cast("long").alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key").limit(most)
    )
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "_y").agg(F.min("_t").alias("_t")).select("_key", "_t", "_y")  # at most `most`, however often a key is there

    def count(batches):
        for b in slices(batches):
            ks, ts, ys = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.int64()), "y": pa.array(ys, pa.int32()), "x": pa.array([counts(t or "").tobytes() for t in ts], pa.binary())})

    got = rows.mapInArrow(count, "k long, y int, x binary").toPandas().sort_values(["k", "x"])
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(-1, FEATURES)
    return Voter(x, got.y.to_numpy())


def score(docs: DataFrame, voter: Voter, *, text: str = "text", to: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs' own columns, then a score (0 to 1) and a prediction (1 from 0.5 on), named by `to`. Only the text is an input of the score.

    Null and empty texts have no features and score the labels' mean. Equal texts score alike; columns that are already named so are
    replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(voter)
    docs = docs.drop(*(c for c in to if c != text))
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            s = known.value.score(np.stack([counts(t or "") for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, *to])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to[0], T.DoubleType()), T.StructField(to[1], T.IntegerType())]))
