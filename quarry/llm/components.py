"""Connected components of a table of links, by alternating large-star and small-star steps.

Both steps only take minima and equi-joins: no neighbour list is ever gathered. Minima are aggregated before they move. A hub's links
don't meet in one task: nodes with more than their share of the links are so few that their minima are broadcast, and only the links
of the others are dealt by node. Each step is written to the shared folder, so that lineage stays short.

Links that are few enough for one task, whatever the input's size, take no rounds: each is a plan of some 40 exchanges and joins that
the driver makes, holds and tells of, for a table of a few MB.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remove, scratch, ship

#: More rounds than any input needs: two steps at least halve the longest way within a component.
ROUNDS = 1000
#: Links that no hub has, whatever the number of partitions.
FEW = 64
#: Links that one task joins; more go through rounds.
TASK = 1 << 16
#: Types whose values Python puts in the same order as Spark.
_ORDERED = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def components(links: DataFrame, task: int = TASK) -> DataFrame:
    """links: columns a, b of any orderable type. Returns (node, root), one row for each node with a link; root is the least node reachable.

    At most `task` links are joined in one task; more go through rounds, with the same result.
    Loops, repeated links and links with a null are ignored; an empty table gives no rows.
    """
    spark, schema, old = links.sparkSession, None, None
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    state = None
    for n in range(ROUNDS):
        path = scratch(spark, f"links-{n}")
        edges.write.parquet(path)
        schema = schema or edges.schema
        edges = spark.read.schema(schema).parquet(path)
        if old is not None:
            remove(spark, old)
        old = path
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.max("v").alias("v")).first()
        if now == state or not now.n:
            break
        if now.n <= task and dict(edges.dtypes)["u"] in _ORDERED:
            return _joined(edges)
        state = now
        # a node with more than `many` of the 2n ends of links is a hub: there are at most 8 for each partition
        many = max(FEW, now.n // (4 * partitions(spark)))
        edges = _small_star(_large_star(edges, many), many)
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of links (u, v) that fit in one task: each node points to a lesser one of its component, or to itself."""
    ship(edges.sparkSession)

    def run(batches):
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]  # halves the way for the next one
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(u), top(v)
                up[max(x, y)] = min(x, y)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["node", "root"])

    of = dict(edges.dtypes)["u"]
    kind = _ORDERED[of]
    return edges.select("u", "v").repartition(1).mapInArrow(run, f"node {of}, root {of}")


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """edges (u, v) with m, what `least` (u, m, n) has for u: hubs' by broadcast, the others' by a join on u."""
    hubs = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= many).select("u", "m").hint("merge"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = _with_least(edges, least, many).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
