"""Substring dedup with a log-structured fingerprint index.

Each window of WINDOW consecutive words has an anchor: of the runs of GRAM words in it, the one with the least hash, the leftmost
of equals. Equal windows have equal anchors at equal places, so only windows whose anchor's hash occurs twice can repeat. About one
in fifteen positions is an anchor; their hashes are what the index holds.

Each batch writes one immutable run: tables of anchor hashes and of their places, in buckets by hash and sorted within them, so that
runs meet in merge joins that move nothing. Anchors that also occur elsewhere, in the batch or in an older run, are candidates; the
texts of just those documents then give digests of the whole windows, which verify each candidate. Runs are compacted into one when
there are many. Verification reads old documents' texts from where they are kept (`history`); the index has none.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Manifest, names_in, partitions, qualified, remove, scratch, ship, slices, staged, table_name

WINDOW, GRAM = 35, 8
_NO_KEY = -(1 << 63)
_LOW, _BLOCK = 24, 1 << 22
_MASK = 31  # windows that one mask tells of; an anchor with more has several
#: Places that no hash is split for, however few there are in all.
FEW = 1024
_GRAM_BY, _WINDOW_BY = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def share(rows: int, parts: int) -> int:
    """A quarter of what a part has of the rows: at most 4 keys a part have more."""
    return max(FEW, rows // (4 * parts))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(x: np.ndarray, length: int, by: int) -> np.ndarray:
    """A number for each run of so many words, from runs of 1, 2, 4 ... words."""
    whole, done, size, factor = None, 0, 1, by
    while True:
        if length & size:
            whole = x if whole is None else whole[: len(x) - done] * np.uint64(factor) + x[done:]
            done += size
        if done == length:
            return whole[: len(whole)]
        x = x[:-size] * np.uint64(factor) + x[size:]
        size, factor = 2 * size, factor * factor & 0xFFFFFFFFFFFFFFFF


def least_in(x: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == span else np.minimum(x[: len(x) - (span - size)], x[span - size :])


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes with at least one window: each anchor's hash and place, and the first and last + 1 window that has it."""
    g = rolling(h, gram, _GRAM_BY)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    span, m, low = window - gram + 1, len(h) - window + 1, np.uint64((1 << _LOW) - 1)
    places = []
    for at in range(0, m, _BLOCK):  # places within a block fit beside the hash
        part = g[at : min(at + _BLOCK, m) + span - 1]
        places.append((least_in(part & ~low | np.arange(len(part), dtype=np.uint64), span) & low).astype(np.int64) + at)
    place = np.concatenate(places)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return g[place[first]], place[first], first, np.append(first[1:], m)


def cover(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _identified(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """(k1, k2, t): a document is its key and its text's hash; the same plan each time, so that texts are moved once."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("t"))
    return rows.repartition(parts, "k1", "k2")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class WindowIndex:
    """The runs of anchor hashes under a path in the shared folder. Opening the path again, in any session, finds the runs there.

    A run has two tables, in buckets and sorted: keys (h, n, salts), how often an anchor hash occurs, and places (h, s, k1, k2, place).
    s is 0, but the places of a hash that has more than its share of them (FEW at least, a quarter of a bucket's) are dealt to `salts`
    numbers s, and so to as many buckets: a line that a third of all documents have fills no task alone. At most 4 hashes for each
    bucket can have that many, so what tells them is broadcast.

    A manifest names the runs that count, each with the batches in it. A run is named there once it is whole, and a merged run in one
    change with those it replaces; other folders are what a lost driver left, and go before the next batch.
    """

    def __init__(self, spark: SparkSession, path: str, *, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, most_runs: int = 8):
        if not 0 < gram <= window:
            raise ValueError("an anchor has 1 to `window` words")
        self.spark, self.path, self.window, self.gram, self.most_runs = spark, qualified(spark, path), window, gram, most_runs
        self.buckets = buckets or partitions(spark)
        self.manifest = Manifest(spark, self.path)
        state = self.manifest.read()
        if not state:
            self.manifest.write({"window": window, "gram": gram, "runs": []})
        elif (state["window"], state["gram"]) != (window, gram):
            raise ValueError(f"the index at {path} is of windows of {state['window']} words with anchors of {state['gram']}")

    def runs(self) -> list[dict]:
        """The runs that count, in the order in which their batches came: name, batches, places (a number), buckets."""
        return self.manifest.read()["runs"]

    def places(self, run: dict) -> DataFrame:
        return self._table(run, "places", "h long, s int, k1 long, k2 long, place int", "h, s")

    def keys(self, run: dict) -> DataFrame:
        return self._table(run, "keys", "h long, n long, salts int", "h")

    def _table(self, run: dict, kind: str, columns: str, by: str) -> DataFrame:
        at = table_name(f"anchor_{kind}", f"{self.path}/{run['name']}")
        if not self.spark.catalog.tableExists(at):
            self.spark.sql(f"CREATE TABLE {at} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['name']}/{kind}'")
        return self.spark.table(at)

    def _put(self, rows: DataFrame, run: dict, kind: str, by: list[str]) -> None:
        at = table_name(f"anchor_{kind}", f"{self.path}/{run['name']}")
        rows.repartition(run["buckets"], *by).sortWithinPartitions(*by).write.format("parquet").bucketBy(run["buckets"], *by).sortBy(*by).option("path", f"{self.path}/{run['name']}/{kind}").saveAsTable(at)

    def _write(self, placed: DataFrame, batches: list[str]) -> dict:
        """Writes a run of stored rows (h, k1, k2, place), which doesn't count yet."""
        run = {"name": f"run-{uuid.uuid4().hex}", "batches": batches, "places": placed.count(), "buckets": self.buckets}
        many = share(run["places"], self.buckets)
        keys = placed.groupBy("h").agg(F.count("*").alias("n"))
        self._put(keys.select("h", "n", F.ceil(F.col("n") / many).cast("int").alias("salts")), run, "keys", ["h"])
        hot = F.broadcast(self.keys(run).where("salts > 1").select("h", "salts"))
        s = F.coalesce(F.pmod(F.xxhash64("k1", "k2"), F.col("salts")).cast("int"), F.lit(0))
        self._put(placed.join(hot, "h", "left").select("h", s.alias("s"), "k1", "k2", "place"), run, "places", ["h", "s"])
        return run

    def _clean(self) -> None:
        """Removes what a lost driver left."""
        known = {r["name"] for r in self.runs()}
        for n in names_in(self.spark, self.path):
            if n.startswith("run-") and n not in known:
                remove(self.spark, f"{self.path}/{n}")

    def compact(self) -> None:
        """Merges all runs into one. The old ones go once the new one counts, so results of `add` must have been written by then."""
        self._clean()
        state = self.manifest.read()
        if len(state["runs"]) > 1:
            rows = functools.reduce(DataFrame.unionByName, [self.places(r).select("h", "k1", "k2", "place") for r in state["runs"]])
            self.manifest.write(state | {"runs": [self._write(rows, [b for r in state["runs"] for b in r["batches"]])]})
            self._clean()

    def _run(self, placed: DataFrame, batch: str) -> tuple[dict, list[dict]]:
        """The batch's run and those before it; the run is made unless the batch is in the index."""
        runs = self.runs()
        for i, r in enumerate(runs):
            if r["batches"] == [batch]:
                return r, runs[:i]
            if batch in r["batches"]:
                raise ValueError(f"batch {batch!r} is in the index and merged with others")
        if len(runs) > self.most_runs:  # before this batch's plans read them
            self.compact()
        self._clean()
        state, path = self.manifest.read(), scratch(self.spark, "anchors")
        placed.write.parquet(path)
        run = self._write(self.spark.read.schema(placed.schema).parquet(path), [batch])
        self.manifest.write(state | {"runs": [*state["runs"], run]})
        remove(self.spark, path)
        return run, state["runs"]

    def add(self, docs: DataFrame, *, batch: str, key: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
        """Finds what repeats in `docs` and in documents added before, and adds docs' run.

        Returns (k1, k2, covered): documents with removed words, and the first windows and masks of what covers them. `history` has the
        documents of older runs, with the same columns; it is needed once there are runs, and may have this batch's documents too.

        `batch` names the batch. One that is in the index is not added again: it meets the runs before its own and gives the result
        that it gave, until it is merged with others, when it raises ValueError.
        """
        spark, window, gram = self.spark, self.window, self.gram
        ship(spark)
        if history is None and any(r["batches"] != [batch] for r in self.runs()[:1]):
            raise ValueError("verification needs the documents that the index has seen")

        def placed(batches):
            for b in slices(batches):
                out = [[], [], [], []]
                for k1, k2, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = t.encode("utf-8", "replace").split()
                    if len(words) >= window:
                        h, place, _, _ = anchors(word_hashes(words), window, gram)
                        for c, v in zip(out, (h, np.full(len(h), k1), np.full(len(h), k2), place), strict=True):
                            c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3]).astype(np.int32))], names=["h", "k1", "k2", "place"])

        t = F.coalesce(F.col(text).cast("string"), F.lit(""))
        scanned = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("t"))
        run, old = self._run(scanned.mapInArrow(placed, "h long, k1 long, k2 long, place int"), batch)
        times = self.keys(run)
        for r in old:  # merge joins of sorted runs
            times = times.join(self.keys(r).select("h", F.col("n").alias("m")).hint("merge"), "h", "left").select("h", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), "salts")
        repeated = staged(times.where("n > 1"), "repeated")
        found = self._windows(docs, self._at(run, repeated), key, text).withColumn("is_new", F.lit(True))
        for r in old:
            known = self.keys(r).join(self.keys(run).select("h").hint("merge"), "h", "left_semi")
            found = found.unionByName(self._windows(history, self._at(r, known), key, text).withColumn("is_new", F.lit(False)))
        masks = self._verified(staged(found, "windows"), repeated, share(sum(r["places"] for r in [run, *old]), self.buckets))
        return masks.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "mask")).alias("covered"))

    def _at(self, run: dict, keys: DataFrame) -> DataFrame:
        """A run's places of these hashes; the run's rows aren't moved."""
        wanted = keys.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
        return self.places(run).join(wanted.hint("merge"), ["h", "s"])

    def _verified(self, found: DataFrame, repeated: DataFrame, many: int) -> DataFrame:
        """(k1, k2, first, mask) of windows in new documents whose digest occurs again, from stored (h, k1, k2, first, digests, is_new).

        Anchors are brought together by hash. Those of a hash with more than `many` places are not: their windows' digests are counted
        where they are, then by digest, and only what repeats goes back, in a join whose large partitions Spark can split.
        """
        hot = F.broadcast(repeated.where(F.col("n") > many).select("h"))
        each = lambda rows: rows.select("h", "k1", "k2", "first", "is_new", F.posexplode("digests").alias("i", "d"))
        few = each(found.join(hot, "h", "left_anti").repartition(self.buckets, "h"))
        few = few.withColumn("n", F.count("*").over(Window.partitionBy("h", "d"))).where("n > 1 AND is_new")  # within what is there for an anchor: nothing moves
        lots = each(found.join(hot, "h", "left_semi"))
        again = staged(lots.groupBy("h", "d").agg(F.count("*").alias("n")).where("n > 1").select("h", "d"), "again")
        lots = lots.where("is_new").join(again.hint("merge"), ["h", "d"])
        mask = lambda rows, *by: rows.groupBy(*by, "k1", "k2", F.expr(f"first + i - i % {_MASK}").alias("first")).agg(F.bit_or(F.expr(f"shiftleft(1, i % {_MASK})")).alias("mask")).select("k1", "k2", "first", "mask")
        return mask(few, "h").unionByName(mask(lots))

    def _windows(self, docs: DataFrame, candidates: DataFrame, key: str, text: str) -> DataFrame:
        """(h, k1, k2, first, digests): for each candidate anchor the digests of its windows, from the documents' texts."""
        window, gram = self.window, self.gram
        wanted = candidates.groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))

        def digests(batches):
            for b in slices(batches):
                out, sizes = [[], [], [], [], []], []
                for k1, k2, t, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    h = word_hashes(t.encode("utf-8", "replace").split())
                    hashes, place, first, stop = anchors(h, window, gram)
                    at = np.flatnonzero(np.isin(place, places))
                    d = rolling(h, window, _WINDOW_BY)
                    for c, v in zip(out, (hashes[at], np.full(len(at), k1), np.full(len(at), k2), first[at], np.concatenate([d[f:s] for f, s in zip(first[at], stop[at], strict=True)] or [d[:0]])), strict=True):
                        c.append(v)
                    sizes.append((stop - first)[at])
                if sizes:
                    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(out[4])))
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out[0])), *(pa.array(np.concatenate(c)) for c in out[1:3]), pa.array(np.concatenate(out[3]).astype(np.int32)), lists], names=["h", "k1", "k2", "first", "digests"])

        texts = _identified(docs, key, text, self.buckets)
        return texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "t", "places").mapInArrow(digests, "h long, k1 long, k2 long, first int, digests array<long>")


def without_repeats(docs: DataFrame, index: WindowIndex, *, batch: str, key: str = "doc_id", text: str = "text", history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Adds a batch to the index; key, n_words, n_removed, kept_sha256 (and kept, the text, if wanted) for each row of docs.

    A word goes if a window that covers it also starts elsewhere, in its own document, in another or in the index. Null, empty and
    short texts have no window and lose nothing. Rows that repeat a key and text are documents of their own, so each repeats the
    other; null keys stay null; an empty table gives no rows; other columns are not read.
    """
    window = index.window
    found = index.add(docs, batch=batch, key=key, text=text, history=history)
    texts = _identified(docs, key, text, index.buckets)
    rows = texts.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select("k1", "t", F.col("covered.first").alias("first"), F.col("covered.mask").alias("mask"))

    def kept(batches):
        for b in slices(batches):
            cols = [[], [], [], [], []]
            for k1, t, first, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = t.encode("utf-8", "replace").split()
                n = len(words)
                if first:
                    bits = np.array(mask, np.int64)[:, None] >> np.arange(_MASK) & 1
                    gone = cover(n, (np.array(first)[:, None] + np.arange(_MASK))[bits.astype(bool)], window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(words)
                for c, v in zip(cols, (None if k1 == _NO_KEY else k1, n, n - len(words), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])

    out = rows.mapInArrow(kept, "key long, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("key", key)
    return out if with_text else out.drop("kept")


def repeats_removed(docs: DataFrame, **columns) -> DataFrame:
    """`without_repeats` over all of docs with a fresh index in the shared folder."""
    spark = docs.sparkSession
    return without_repeats(docs, WindowIndex(spark, scratch(spark, "window-index")), batch="all", **columns)
