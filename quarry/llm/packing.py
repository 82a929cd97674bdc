"""Packing by vector bin packing: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .records import crc_of_ids
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


class Packer:
    """Places examples in sequences, one partition's at a time.

    An example may be cut anywhere. A piece demands (tokens, 1 segment, loss-bearing tokens); of the pieces that fit, the one whose
    demand has the largest dot product with what the sequence still has, each as a share of its limit, goes next. Where none fits
    whole, the best by the same product is cut to what is left. What is over at the end goes to sequences of a power of two tokens.
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("limits start at 1")
        self.limit = np.array([capacity, max_segments, max_loss], float)
        self.open: list[tuple] = []  # examples not yet placed: (example, start, end); example: (key, ids, width, loss_from)
        self.sequence = 0

    @staticmethod
    def loss(example, start: int, end: int) -> int:
        return max(0, end - max(start, example[3]))

    def cut(self, example, start: int, end: int, tokens: int, loss: int) -> int:
        """Where a piece from start must end to fit in so many tokens and loss-bearing tokens."""
        return min(end, start + tokens, max(start, example[3]) + loss)

    def emit(self, pieces, out) -> None:
        offset = 0
        for example, start, end in pieces:
            key, ids, width, _ = example
            out.append((key, start, end - start, crc_of_ids(ids[start * width : end * width], width), len(ids) // width, self.sequence, offset, self.loss(example, start, end)))
            offset += end - start
        self.sequence += 1

    def add(self, example, out) -> None:
        """Takes an example; what fills sequences alone goes out at once.

        Where loss-bearing tokens alone can't fill a sequence, a long example's sequences take as many of them as may be and the rest
        from its head, and what its head doesn't reach for is left open in pieces that fit.
        """
        n = len(example[1]) // example[2]
        capacity, _, most = (int(v) for v in self.limit)
        head, body = min(max(example[3], 0), n), min(max(example[3], 0), n)  # places up to which head and body are taken: the head from 0
        if n < capacity and n - body <= most:
            self.open.append((example, 0, n))
            return
        if most >= capacity:
            for start in range(0, n - capacity + 1, capacity):
                self.emit([(example, start, start + capacity)], out)
            if n % capacity:
                self.open.append((example, n - n % capacity, n))
            return
        done, spare = 0, capacity - most
        while n - body >= most and head - done >= spare:
            self.emit([(example, done, done + spare), (example, body, body + most)], out)
            done, body = done + spare, body + most
        while head - done >= capacity:
            self.emit([(example, done, done + capacity)], out)
            done += capacity
        if body == head and n - done < capacity and n - body <= most:
            self.open.append((example, done, n))
            return
        self.open += [(example, s, e) for s, e in ((done, head), *((s, min(s + most, n)) for s in range(body, n, most))) if e > s]

    def place(self, out, capacity: int | None = None) -> None:
        """Fills sequences while the open pieces have tokens for a whole one; with a capacity given, fills one of that size."""
        size = int(self.limit[0]) if capacity is None else capacity
        pool, once = self.open, capacity is not None
        tokens, losses = (np.array(v, float) for v in ([e - s for _, s, e in pool], [self.loss(*p) for p in pool]))
        alive, total, most = np.ones(len(pool), bool), int(tokens.sum()), self.limit.tolist()
        while total >= size and alive.any():
            left, taken = [float(size), *most[1:]], []
            while left[0] > 0 and left[1] > 0:
                # demand's shares of the limits, times the shares that are left; the segment's own is the same for all
                score = tokens * (left[0] / most[0] ** 2) + losses * (left[2] / most[2] ** 2)
                score[~alive] = -1
                fits = np.where((tokens <= left[0]) & (losses <= left[2]), score, -1)
                i = int(np.argmax(fits))
                if fits[i] < 0:
                    i = int(np.argmax(score))
                    if score[i] < 0:
                        break
                example, start, end = pool[i]
                stop = self.cut(example, start, end, int(left[0]), int(left[2]))
                if stop == start:  # no loss-bearing token fits any more: take a piece that starts with others, if one is there
                    i = next((j for j in np.flatnonzero(alive) if pool[j][1] < pool[j][0][3]), None)
                    if i is None:
                        break
                    example, start, end = pool[i]
                    stop = self.cut(example, start, end, int(left[0]), int(left[2]))
                taken.append((example, start, stop))
                left = [left[0] - (stop - start), left[1] - 1, left[2] - self.loss(example, start, stop)]
                total -= stop - start
                if stop < end:
                    pool[i], tokens[i], losses[i] = (example, stop, end), end - stop, self.loss(example, stop, end)
                else:
                    alive[i] = False
            self.emit(taken, out)
            if once:
                break
            if 2 * alive.sum() < len(pool):  # what is placed isn't looked at again
                at = np.flatnonzero(alive)
                pool, tokens, losses, alive = [pool[i] for i in at], tokens[at], losses[at], np.ones(len(at), bool)
        self.open = [pool[i] for i in np.flatnonzero(alive)]

    def finish(self, out) -> None:
        """Places what is over: whole sequences first, then the largest power of two that is left, so that hardly any is padded."""
        self.place(out)
        while self.open:
            total = sum(e - s for _, s, e in self.open)
            self.place(out, min(int(self.limit[0]), 1 << (total.bit_length() - 1)))


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", loss_from: str | None = None, end_id: int = 1, capacity: int = 2048, max_segments: int = 256, max_loss: int = 2048, block: int = 2048) -> DataFrame:
    """Packs every row's ids (its whole text's, then `end_id`) into sequences; one row for each piece.

    `loss_from` names a column with the position from which an example's ids bear loss (null or absent: all do). Each task packs its
    own partition, in blocks of `block` examples, and carries on what is open: nothing is shuffled, and a task holds one block.
    Sequence ids are unique, the partition's number in the high bits. Null and empty texts are the end id alone; a null key stays
    null; equal rows are packed each; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    lossy = F.lit(0) if loss_from is None else F.coalesce(F.col(loss_from), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), lossy.cast("long").alias("l"))

    def run(batches):
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        packer, first, seen = Packer(capacity, max_segments, max_loss), TaskContext.get().partitionId() << 40, 0
        out: list[tuple] = []
        for b in slices(batches):
            for k, t, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                packer.add((k, enc.encode(t or "") + end, width, loss), out)
                seen += 1
                if seen % block == 0:
                    packer.place(out)
                    yield rows_out(out, first)
                    out = []
        packer.finish(out)
        yield rows_out(out, first)

    def rows_out(out, first):
        cols = list(zip(*out, strict=True)) or [[] for _ in _SCHEMA]
        cols[5] = [first + s for s in cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_SCHEMA)

    return rows.mapInArrow(run, PIECES)
