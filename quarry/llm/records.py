"""Token-ID output as length-delimited binary records with a separate offset index.

A shard is a run of frames in the order of the key. A frame is

    length  unsigned 64-bit, little-endian
    masked CRC-32 of the length bytes, unsigned 32-bit
    payload
    masked CRC-32 of the payload, unsigned 32-bit

and a payload is: key (signed 64-bit), 1 if the key is null else 0 (one byte), bytes per id (one byte), then the ids. The mask
rotates the checksum right by 15 bits and adds 0xA282EAD8, so that data which hold checksums don't check themselves. The index
beside a shard (`.idx`) holds, for each record, the frame's offset and its number of ids, both signed 64-bit: a shuffled reader
seeks by it without reading the shard.

Files are named by task attempt, and only those that the manifest names count: a task that is lost or run twice leaves a file
that nobody reads. Any file system that pyarrow opens by URI serves; the root must be shared by all executors.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, ship, slices, staged
from .tokens import encoder

_HEAD, _SUM, _KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBB")
#: Bytes of a record beside its ids.
OVERHEAD = _HEAD.size + _KEY.size + _SUM.size
MANIFEST = "shard long, path string, records long, ids long"
READ = pa.schema([("shard", pa.int64()), ("record", pa.int64()), ("key", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    payload = _KEY.pack(0 if key is None else key, key is None, width) + ids
    size = struct.pack("<Q", len(payload))
    return size + _SUM.pack(masked(size)) + payload + _SUM.pack(masked(payload))


def unframe(read) -> tuple[int | None, int, bytes] | None:
    """The next record of a stream: key, bytes per id, ids. None at the end; ValueError where a checksum or length is off."""
    head = read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("a record ends in its head")
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    payload, tail = read(length), read(_SUM.size)
    if len(payload) < length or len(tail) < _SUM.size or masked(payload) != _SUM.unpack(tail)[0]:
        raise ValueError("a record's payload is damaged")
    key, null, width = _KEY.unpack_from(payload)
    return (None if null else key), width, payload[_KEY.size :]


def crc_of_ids(ids: bytes, width: int) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write_records(docs: DataFrame, root: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_bytes: int = 256_000_000) -> DataFrame:
    """Encodes each whole text, appends `end_id` and writes shards under `root` in ascending order of `key` (nulls first).

    Returns the manifest (shard, path, records, ids), one row for each shard, ordered by `shard`. Every row is written: null and
    empty texts are records of the end id alone; rows with equal keys follow each other in the order of their texts. An empty
    table gives an empty manifest. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "text")

    def write(batches):
        enc, (store, top) = encoder(tokenizer), filesystem(root)
        store.create_dir(top, recursive=True)
        end, width, part, attempt, made = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize, TaskContext.get().partitionId(), uuid.uuid4().hex[:8], []
        out = None
        for b in slices(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    path = f"{top}/part-{part:06d}-{len(made):04d}-{attempt}.rec"
                    out, at, total, index = store.open_output_stream(path), 0, 0, []
                ids = enc.encode(t or "") + end
                record = frame(k, ids, width)
                out.write(record)
                index += at, len(ids) // width
                at, total = at + len(record), total + len(ids) // width
                if at >= shard_bytes:
                    made.append(close(store, out, path, index, total))
                    out = None
        if out is not None:
            made.append(close(store, out, path, index, total))
        yield pa.RecordBatch.from_pydict({"shard": [part << 20 | i for i in range(len(made))], "path": [m[0] for m in made], "records": [m[1] for m in made], "ids": [m[2] for m in made]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    def close(store, out, path, index, total):
        out.close()
        with store.open_output_stream(path[:-4] + ".idx") as f:
            f.write(np.array(index, "<i8").tobytes())
        return path, len(index) // 2, total

    # a shard's row goes by a shuffle, so the manifest is a few files and not one for each task that writes records
    return staged(rows.mapInArrow(write, MANIFEST).repartition("shard"), "manifest").orderBy("shard")


def read_records(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Reads shards back, each checksum verified: a row for each record, with its ids' number, the ids before it in its shard and their crc32."""
    ship(spark)

    def read(batches):
        store, _ = filesystem(root)
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = np.frombuffer(store.open_input_file(path[:-4] + ".idx").read(), "<i8").reshape(-1, 2)
                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    n, at, before, cols = 0, 0, 0, [[], [], [], []]
                    while (record := unframe(f.read)) is not None:
                        k, width, ids = record
                        count = len(ids) // width
                        if index[n].tolist() != [at, count]:
                            raise ValueError(f"the index of {path} doesn't fit record {n}")
                        for c, v in zip(cols, (k, before, count, crc_of_ids(ids, width)), strict=True):
                            c.append(v)
                        n, at, before = n + 1, at + OVERHEAD + len(ids), before + count
                        if len(cols[0]) == 4096:
                            yield batch(shard, n, cols)
                            cols = [[], [], [], []]
                    if n != len(index):
                        raise ValueError(f"{path} ends early")
                    yield batch(shard, n, cols)

    def batch(shard, n, cols):
        size = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array([shard] * size, pa.int64()), pa.array(range(n - size, n), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], schema=READ)

    spread = manifest.select("shard", "path").repartition(partitions(spark))
    return spread.mapInArrow(read, "shard long, record long, key long, ids_before long, n_ids long, ids_crc32 long")


def read_at(root: str, path: str, record: int) -> tuple[int | None, int, bytes]:
    """One record of a shard, found by the index: what a shuffled reader does."""
    store, _ = filesystem(root)
    with store.open_input_file(path[:-4] + ".idx") as f:
        f.seek(16 * record)
        at = struct.unpack("<q", f.read(8))[0]
    with store.open_input_file(path) as f:
        f.seek(at)
        return unframe(f.read)


def token_records(docs: DataFrame, tokenizer: str, *, root: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes records and reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where a shard starts among all ids is a running sum over the manifest, which has one row for each 256 MB or task.
    """
    spark = docs.sparkSession
    root = root or scratch(spark, "records")
    manifest = write_records(docs, root, tokenizer, end_id=end_id)
    starts = manifest.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("shard_start"))
    return (
        read_records(spark, manifest, root).join(starts, "shard")
        .select(F.col("key").alias("doc_id"), (F.coalesce("shard_start", F.lit(0)) + F.col("ids_before")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
    )
