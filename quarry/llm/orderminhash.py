"""Document fingerprints by Order MinHash, in the form with one hash and buckets.

A text's k-mers of code points are numbered by occurrence, and each (k-mer, occurrence) is hashed once; the hash's high bits name
one of BUCKETS buckets. In each bucket the PICK smallest hashes are selected, put in text order, and their tuple is hashed to one
component. Two texts agree in a component if they share the bucket's minimal k-mers in the same order, so that moved text counts as
changed: what edit distance feels and plain MinHash doesn't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, ship, slices, staged

K, BUCKETS, PICK = 8, 64, 2
#: Hex digits of a component; an empty bucket is written as so many dashes.
DIGITS = 4
_A, _B, _C = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bits of a place in a text; a hash keeps the others, whatever the text's length.
_LOW = 24
_MASK = np.uint64((1 << _LOW) - 1)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> _S30) * _B
    z = (z ^ z >> _S27) * _C
    return z ^ z >> _S31


def _kmers(x: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of K code points (of all, where there are fewer), by doubling."""
    h = _mix(x.astype(np.uint64) + _A)
    size, factor = 1, int(_A)
    while size < K and len(h) > size:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor & 0xFFFFFFFFFFFFFFFF
    return _mix(h) if size == K else _mix(h[:1])


def _ordered(h: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes' high bits in ascending order, ties by place, and their places. One sort of (bits, place) in a word if places fit in."""
    place = np.arange(len(h), dtype=np.uint64) if place is None else place
    if len(h) <= 1 << _LOW:
        s = np.sort(h & ~_MASK | place)
        return s >> np.uint64(_LOW), s & _MASK
    order = np.lexsort((place, h >> np.uint64(_LOW)))
    return (h >> np.uint64(_LOW))[order], place[order]


def components_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The signature: BUCKETS numbers, and which of them stand for a bucket that isn't empty."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(x):
        return np.zeros(BUCKETS, np.uint64), np.zeros(BUCKETS, bool)
    h = _kmers(x)
    n = len(h)
    s = _ordered(h)  # equal k-mers stand together, in text order
    place, kmer = s[1], s[0]
    same = kmer[1:] == kmer[:-1]
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        kmer = kmer + (at - first).astype(np.uint64) * _C
    g, place = _ordered(_mix(kmer + _A), place)
    edges = np.searchsorted(g, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - _LOW - BUCKETS.bit_length() + 1))
    sizes = np.diff(np.append(edges, n))
    at = np.minimum(edges[:, None] + np.arange(PICK), n - 1)
    there = np.arange(PICK) < sizes[:, None]
    order = np.argsort(np.where(there, place[at], np.uint64(n)), axis=1, kind="stable")
    picked, there = np.take_along_axis(g[at], order, 1), np.take_along_axis(there, order, 1)
    out = np.zeros(BUCKETS, np.uint64)
    for i in range(PICK):
        out = np.where(there[:, i], _mix(out * _A + picked[:, i] + np.uint64(1)), out)
    return out, sizes > 0


def written(signature: tuple[np.ndarray, np.ndarray]) -> str:
    return "".join(f"{v:0{DIGITS}x}" if t else "-" * DIGITS for v, t in zip((signature[0] >> np.uint64(64 - 4 * DIGITS)).tolist(), signature[1].tolist(), strict=True))


def fingerprint(text: str) -> str:
    return written(components_of(text))


def likeness(a: str, b: str) -> float:
    """Share of components in which two fingerprints agree, of those that at least one of them has; 1 for two empty texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v.encode(), f"S{DIGITS}") for v in (a, b))
    either = (x != b"-" * DIGITS) | (y != b"-" * DIGITS)
    return float(((x == y) & either).sum() / either.sum())


def fingerprints(docs: DataFrame, *, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs' own columns and the fingerprint of each whole text. Null counts as empty; equal texts have equal fingerprints.

    A column that is already named so is replaced.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    docs = docs.drop(to) if to != text else docs
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            prints = pa.array([fingerprint(t or "") for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]))


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ROW = _DONE + ", part int, role string, text string"


def _compared(key, text: str, after: str, print_: str, after_print: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    edited_print = print_ if edited == text else fingerprint(edited)
    return key, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, after_print)


def edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of the same text with its last quarter replaced by the next document's start, and their likeness.

    Next is by (key, text), nulls first, and after the last comes the first; a single row follows itself. Texts are moved once, by
    ranges of the key; a task looks one row ahead, and the last row of each range is finished with the first row of the next, of which
    there is one for each range. Null texts count as empty; equal rows follow each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "t")

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for b in slices(batches):
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = fingerprint(t)
                if held is None:
                    out.append((k, None, None, p, None, None, None, part, "first", t))
                else:
                    out.append((*_compared(held[0], held[1], t, held[2], p), part, "done", None))
                held = k, t, p
            yield rows_out(out)
        if held is not None:
            yield rows_out([(held[0], None, None, held[2], None, None, None, part, "last", held[1])])

    def rows_out(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])

    made = staged(rows.mapInArrow(run, _ROW), "order-minhash")
    ends = made.where("role <> 'done'")
    order = Window.orderBy("part")
    firsts = ends.where("role = 'first'").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    ranges = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))  # a row for each range
    joined = ends.where("role = 'last'").join(ranges, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after", "fingerprint", "after_print")

    def finish(batches):
        for b in slices(batches):
            out = [_compared(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _DONE.split(", ")])

    done = made.where("role = 'done'").select(*(c.split()[0] for c in _DONE.split(", ")))
    return done.unionByName(joined.mapInArrow(finish, _DONE)).withColumnRenamed("doc_id", key)
