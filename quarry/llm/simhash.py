"""Near-dedup by SimHash: tiled exact comparison of fingerprints.

Distinct fingerprints are put in tiles by population count. Every two tiles whose counts are within the radius of each other are
compared in full, with exclusive-or and bit counts; other tile pairs can't hold a link and are skipped. A tile pair gives a
spanning forest of its links, at most one for each fingerprint, never all pairs. The work grows with the square of the number of
distinct fingerprints over the number of classes of population count; memory does not grow, as a task holds two tiles.

`near_groups` links what the fingerprints link. `near_deduplicated` takes them as a search for candidates only, among texts whose sets
of shingles are of like sizes: what they connect in a tile pair goes on as pieces of bounded size, where the sets of every two
candidates are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, row_id, ship, slices, staged, text_or_empty
from .components import components

TILE = 4096
#: Bytes of texts that are compared exactly in one piece.
PIECE = 8 << 20
#: Near copies share at least 4 of 5 of what the sets of their shingles have together.
SHARED, OF = 4, 5


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words where there are fewer. ASCII letters are lower-cased."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, n)


def mixed_again(h: np.ndarray, n: int) -> np.ndarray:
    """Further 64 bits from each hash: the n-th step of a splitmix64 sequence."""
    z = h + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprint(text: str, words: int, bits: int) -> bytes:
    """A bit, from the highest down, is 1 if it is set in over half the shingles' hashes. A text without words gives zero."""
    return majorities(shingle_hashes(text, words), bits)


def majorities(h: np.ndarray, bits: int) -> bytes:
    out = []
    for n in range(bits // 64):
        g = h if n == 0 else mixed_again(h, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(g), 8192):
            ones += np.unpackbits(g[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
        out.append(np.packbits(2 * ones > len(g)).tobytes())
    return b"".join(out)


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; label points each node to the least of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of a and of b (numbered on from a's) that connect what is within the radius of each other."""
    n, m = len(a), len(b)
    label = np.arange(n + m)
    if same:
        label[n:] = np.arange(n)
    step = max(1, (1 << 18) // m)
    lead = next((w for w in (1, 2) if 32 * w - 8 * w**0.5 >= radius), 3)  # words in which few unlike texts come within the radius
    left, right = ([np.ascontiguousarray(x[:, w]) for w in range(min(lead, x.shape[1]))] for x in (a, b))
    for at in range(0, n, step):
        part, to = a[at : at + step], (at if same else 0)  # of a tile with itself only what is to the right
        apart = np.bitwise_count(left[0][at : at + step, None] ^ right[0][None, to:])
        for x, y in zip(left[1:], right[1:], strict=True):
            apart += np.bitwise_count(x[at : at + step, None] ^ y[None, to:])
        near = np.flatnonzero(apart <= radius)
        if not len(near):
            continue
        i, j = near // (m - to), near % (m - to) + to
        if a.shape[1] > lead:
            ok = np.bitwise_count(part[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= radius
            i, j = i[ok], j[ok]
        union(label, i + at, label[j + n] if same else j + n)
    if same:
        label = label[:n]
    at = np.flatnonzero(label != np.arange(len(label)))
    return at, label[at]


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 64) -> DataFrame:
    """(key, _k, _h, fp, ones): the fingerprint of every whole text as bytes, and its population count. Null and empty texts give zero."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            prints = [fingerprint(t or "", words, bits) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "_k": b.column(1), "_h": b.column(2), "fp": pa.array(prints, pa.binary()), "ones": pa.array([int.from_bytes(p, "big").bit_count() for p in prints], pa.int32())})

    return docs.select(F.col(key).cast("long").alias("key"), *row_id(key, text), F.col(text).cast("string").alias("t")).mapInArrow(run, "key long, _k long, _h long, fp binary, ones int")


#: Stands for a null key among nodes: the greatest, so that it names a component only if all keys in it are null.
_NO_FIRST = (1 << 63) - 1


def node(first: Column, fp: Column) -> Column:
    """A fingerprint as a node: 8 bytes for the least key that has it, in the order of keys, then the fingerprint."""
    return F.concat(F.unhex(F.lpad(F.hex(F.coalesce(first, F.lit(_NO_FIRST)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), fp)


def first_of(node: Column) -> Column:
    """The key that a node starts with."""
    key = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.nullif(key, F.lit(_NO_FIRST))


def _tile_pairs(prints: DataFrame, radius: int, tile: int, width: int | None = None) -> DataFrame:
    """prints: distinct node with ones, and maybe g. Returns (place, a, b, same): every two tiles that may hold a link.

    Tiles are of classes of population count, `width` wide. With g, which differs by 1 at most where nodes may be linked, classes are
    of both.
    """
    n, width = partitions(prints.sparkSession), width or max(1, radius // 8)
    reach = (radius + width - 1) // width  # classes further apart differ by more than the radius
    rows = prints.select("node", *([F.col("g").cast("int").alias("g")] if "g" in prints.columns else [F.lit(0).alias("g")]), F.floor(F.col("ones") / width).cast("int").alias("c"))
    classes = rows.groupBy("g", "c").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # at most bits + 1 rows for each g, of which there are 200 for sets up to 2 ** 64
    tiles = rows.join(F.broadcast(classes), ["g", "c"]).groupBy("g", "c", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("k")).agg(F.listagg("node").alias("blob"))
    tiles = staged(tiles, "tiles")
    beside = F.sequence("ag", F.col("ag") + (1 if "g" in prints.columns else 0))
    left = (
        tiles.select(F.col("g").alias("ag"), F.col("c").alias("ac"), F.col("k").alias("ak"), F.col("blob").alias("a"))
        .withColumn("g", F.explode(beside)).withColumn("c", F.explode(F.sequence(F.when(F.col("g") == F.col("ag"), F.col("ac")).otherwise(F.col("ac") - reach), F.col("ac") + reach)))
        .join(F.broadcast(classes), ["g", "c"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .where("g > ag OR c > ac OR k >= ak").drop("tiles").repartition(n, "g", "c", "k")
    )
    pairs = left.join(tiles.withColumnRenamed("blob", "b").repartition(n, "g", "c", "k").hint("shuffle_hash"), ["g", "c", "k"])
    return pairs.select(F.array("ag", "ac", "ak", "g", "c", "k").alias("place"), "a", "b", F.expr("g = ag AND c = ac AND k = ak").alias("same"))


def _both_tiles(batches, width: int):
    """(place, a, b, same) of each tile pair; a and b have so many 8-byte numbers a row."""
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[i].as_py(), ">u8").astype(np.uint64).reshape(-1, width) for c in ("a", "b"))
            yield batch.column("place")[i].as_py(), a, b, batch.column("same")[i].as_py()


def links(prints: DataFrame, radius: int, bits: int, tile: int = TILE) -> DataFrame:
    """prints: distinct node with ones. Returns links (a, b) of nodes that connect all fingerprints within the radius, a forest for each tile pair."""
    words = bits // 64

    def run(batches):
        for _, a, b, same in _both_tiles(batches, 1 + words):
            u, v = forest(a[:, 1:], b[:, 1:], radius, same)
            both = a if same else np.concatenate([a, b])
            yield pa.RecordBatch.from_pydict({x: pa.array([r.tobytes() for r in both[at].astype(">u8")], pa.binary()) for x, at in (("a", u), ("b", v))})

    ship(prints.sparkSession)
    return _tile_pairs(prints, radius, tile).mapInArrow(run, "a binary, b binary")


#: Sides of a piece: rows of LEFT meet those of RIGHT, rows of EACH meet each other.
LEFT, RIGHT, EACH = 0, 1, 2


def blocks(at: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Cuts rows into runs of at most so many bytes, or of one row."""
    out, start, held = [], 0, 0
    for i, n in enumerate(size[at].tolist()):
        if i > start and held + n > most:
            out.append(at[start:i])
            start, held = i, 0
        held += n
    return [*out, at[start:]] if len(at) else out


def pieces(u: np.ndarray, v: np.ndarray, size: np.ndarray, n: int, same: bool, most: int):
    """Sides and rows of each piece, for the forest (u, v) of a tile pair whose first n rows are a's.

    Every two rows that a forest connects meet in one piece (of two tiles: every row of a and every row of b). Small trees share a
    piece; one of more than `most` bytes is cut into blocks, and each two blocks are a piece.
    """
    label = np.arange(len(size))
    label[u] = v
    at = np.unique(np.concatenate([u, v]))
    at = at[np.argsort(label[at], kind="stable")]
    plain = lambda r: (np.full(len(r), EACH) if same else np.where(r < n, LEFT, RIGHT), r)
    held, total = [], 0
    for tree in np.split(at, np.flatnonzero(np.diff(label[at])) + 1):
        here = int(size[tree].sum())
        if total and total + here > most:
            yield plain(np.concatenate(held))
            held, total = [], 0
        if here <= most:
            held.append(tree)
            total += here
            continue
        left, right = (blocks(r, size, most // 2) for r in ((tree, tree) if same else (tree[tree < n], tree[tree >= n])))
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if same and i == j:
                    yield plain(x)
                elif not same or i < j:
                    yield np.repeat([LEFT, RIGHT], [len(x), len(y)]), np.concatenate([x, y])
    if held:
        yield plain(np.concatenate(held))


def candidates(prints: DataFrame, radius: int, bits: int, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """prints: distinct node (with 8 more bytes after the fingerprint), ones, size and g. Returns (piece, side, node): every two nodes
    within the radius whose g differ by 1 at most meet in one piece of at most so many bytes, or of two nodes."""
    words = bits // 64

    def run(batches):
        for place, a, b, same in _both_tiles(batches, words + 3):
            u, v = forest(a[:, 1 : words + 1], b[:, 1 : words + 1], radius, same)
            if not len(u):
                continue
            both = a if same else np.concatenate([a, b])
            for k, (side, at) in enumerate(pieces(u, v, both[:, -1].astype(np.int64), len(a), same, piece)):
                name = np.array([*place, k], ">i4").tobytes()
                yield pa.RecordBatch.from_pydict({"piece": pa.array([name] * len(at), pa.binary()), "side": pa.array(side, pa.int32()), "node": pa.array([r.tobytes() for r in both[at, :-1].astype(">u8")], pa.binary())})

    ship(prints.sparkSession)
    sized = prints.select(F.concat("node", F.unhex(F.lpad(F.hex(F.col("size").cast("long")), 16, "0"))).alias("node"), "ones", "g")
    return _tile_pairs(sized, radius, tile, radius).mapInArrow(run, "piece binary, side int, node binary")


def alike(prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of a piece whose fingerprints are within the radius and whose sets are near copies, a forest of them.

    Every such two rows are compared, unless links that were found before connect them.
    """
    label, n = np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start, mark = np.cumsum(n) - n, np.zeros(len(values), bool)
    right = np.flatnonzero(side != LEFT)
    others, m = prints[right], n[right]
    for i in np.flatnonzero((side != RIGHT) & (n > 0)).tolist():
        ok = (label[right] != label[i]) & (OF * np.minimum(m, n[i]) >= SHARED * np.maximum(m, n[i]))
        if side[i] == EACH:
            ok &= right > i
        near = np.flatnonzero(ok)
        j = right[near[np.bitwise_count(prints[i] ^ others[near]).sum(axis=1, dtype=np.int64) <= radius]]
        if not len(j):
            continue
        mine, to = ids[start[i] : start[i] + n[i]], np.cumsum(n[j]) - n[j]
        mark[mine] = True
        both = np.add.reduceat(mark[ids[np.repeat(start[j] - to, n[j]) + np.arange(n[j].sum())]], to, dtype=np.int64)
        mark[mine] = False
        j = j[OF * both >= SHARED * (n[i] + n[j] - both)]
        union(label, np.full(len(j), i), j)
    at = np.flatnonzero(label != np.arange(len(label)))
    return at, label[at]


def alike_links(texts: DataFrame, members: DataFrame, radius: int, bits: int, words: int) -> DataFrame:
    """texts: (_k, _h, t); members: (piece, side, node, _k, _h). Returns links (a, b) that connect near copies, from the nodes' texts."""

    def linked(held):
        nodes = list(held)
        prints = np.frombuffer(b"".join(nodes), ">u8").astype(np.uint64).reshape(len(nodes), -1)[:, 1 : 1 + bits // 64]
        u, v = alike(prints, [s for _, s in held.values()], np.array([x for x, _ in held.values()]), radius)
        return pa.RecordBatch.from_pydict({x: pa.array([nodes[k] for k in at], pa.binary()) for x, at in (("a", u), ("b", v))})

    def run(batches):
        now, held = None, {}
        for b in slices(batches):
            for name, side, at, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now and held:
                    yield linked(held)
                    held = {}
                now = name
                if at not in held:  # rows that repeat have the same text
                    held[at] = side, np.unique(shingle_hashes(t, words))
        if held:
            yield linked(held)

    spark = texts.sparkSession
    ship(spark)
    rows = texts.join(members.hint("merge"), ["_k", "_h"]).select("piece", "side", "node", "t")
    return rows.repartition(partitions(spark), "piece").sortWithinPartitions("piece").mapInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 64, radius: int = 4, tile: int = TILE) -> DataFrame:
    """key, fingerprint (hex), component_id: the least key that links of `radius` or fewer bits reach, its own included.

    Null and empty texts have fingerprint zero, which links like any other. Rows that repeat a key are rows of their own; null keys
    are in a component, and are its id only if it has no other. An empty table gives no rows; other columns are not read.
    """
    rows = _grouped(docs, key, text, words, bits, radius, tile)
    return rows.select(F.col("key").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, key: str, text: str, words: int, bits: int, radius: int, tile: int) -> DataFrame:
    rows = staged(fingerprints(docs, key=key, text=text, words=words, bits=bits), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("key").alias("first"), F.first("ones").alias("ones"))
    prints = staged(prints.select("fp", node(F.col("first"), F.col("fp")).alias("node"), "ones"), "distinct")
    roots = components(staged(links(prints, radius, bits, tile), "forest"))
    # nodes start with their least key, so a component's root names it: no group is brought together
    root = F.coalesce("root", "node")
    of = staged(prints.join(roots, "node", "left").select("fp", root.alias("root"), first_of(root).alias("component_id")), "members")
    return rows.join(of, "fp")


def size_class(n: int) -> int:
    """Sets whose sizes are 4 to 5 at most are in one class or in neighbours; -1 for empty ones."""
    return math.floor(math.log(n) / math.log(OF / SHARED)) if n else -1


def near_deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, bits: int = 256, radius: int = 72, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """docs' own columns, one row of each group of near copies: the one with the least key.

    Near copies are texts whose sets of five-word shingles (as 64-bit hashes) have a similarity J of 0.8 or more; links are closed
    transitively, so a row that goes has a near copy, which may be another one than the row that stays. Fingerprints of 256 bits, of
    each shingle once, only tell which pairs to compare exactly: they differ in 256 acos(2J / (1 + J)) / pi bits, give or take 6, which is 39 at J = 0.8, and
    48 for texts of 4 and 5 shingles. Radius 72 lets a pair from 0.8 on pass by four deviations; unlike texts differ in 128. Only texts
    whose sets are of like sizes are compared: near copies' sizes are 4 to 5 at most, so classes by their logarithm to base 5/4 are
    the same or next to each other.
    """
    ship(docs.sparkSession)
    texts = docs.select(*row_id(key, text), text_or_empty(text).cast("string").alias("t"), F.col(key).cast("long").alias("key"))

    def run(batches):
        for b in slices(batches):
            out = [[], [], [], [], []]
            for t in b.column("t").to_pylist():
                h = np.unique(shingle_hashes(t, words))  # a set, as similarity is that of sets
                p = majorities(h, bits)
                for c, v in zip(out, (p, xxhash.xxh3_64_digest(h.tobytes()), int.from_bytes(p, "big").bit_count(), len(t), size_class(len(h))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("_k"), b.column("_h"), *(pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()), strict=True))], names=["key", "_k", "_h", "fp", "of", "ones", "size", "g"])

    rows = staged(texts.mapInArrow(run, "key long, _k long, _h long, fp binary, of binary, ones int, size long, g int"), "fingerprints")
    prints = rows.groupBy("fp", "of").agg(F.min("key").alias("first"), F.first("ones").alias("ones"), F.first("g").alias("g"), F.min(F.struct("_k", "_h", "size")).alias("s"))
    prints = staged(prints.select("fp", "of", node(F.col("first"), F.concat("fp", "of")).alias("node"), "ones", "g", "s._k", "s._h", "s.size"), "distinct")
    near = staged(candidates(prints, radius, bits, tile, piece), "candidates")
    members = near.join(prints.select("node", "_k", "_h").hint("merge"), "node")
    roots = components(staged(alike_links(texts.drop("key"), members, radius, bits, words), "links"))
    of = staged(prints.join(roots, "node", "left").select("fp", "of", F.coalesce("root", "node").alias("root")), "members")
    stays = rows.join(of, ["fp", "of"]).groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "_k", "_h")).alias("s")).select("s._k", "s._h")
    return only(docs, stays, key=key, text=text)
