"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Each document has the exponential key -ln(u) / w, u a hash of its id and w its quality weight: in ascending order the keys draw
documents without replacement with chances in proportion to w. A source's target gives whole epochs first, and the rest is the
prefix of its documents by key whose running size comes nearest to it.

A running sum over a source would put a hot source in one task. Keys are dealt to cells instead, 4,096 slices of the key's
range: sums by source and cell are running-summed over at most 4,096 rows a source, and documents only within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, words_in, words_of

CELLS = 4096


#: Marks that clean prose hardly has.
MARKS = "!|*$"


def substance(text: Column) -> Column:
    """A quality weight from the text alone, 0.05 to 1: the share of its words that are distinct, times the share of its characters that
    are no MARKS. What repeats itself or is full of marks weighs little; so do null texts and texts without words."""
    words = words_of(text)
    size = F.char_length(text)
    marks = sum((size - F.char_length(F.replace(text, F.lit(m), F.lit(""))) for m in MARKS), F.lit(0))
    share = F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double"))
    return F.greatest(F.lit(0.05), share * (1.0 - F.try_divide(marks.cast("double"), size.cast("double"))))  # no branches, so that words are cut once


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def keyed(docs: DataFrame, *, key: str, text: str, size: str | None, source: str, weight: Column | None, seed: str) -> DataFrame:
    """docs' rows as _row, with _key, _src, _size, _es and _cell. The size is counted from the text unless a column has it."""
    sizes = words_in(F.col(text).cast("string")) if size is None else F.coalesce(F.col(size).cast("long"), F.lit(0))
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1e-9))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(key).cast("long").alias("_key"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_src"), sizes.alias("_size"),
        (-F.log(uniform(F.col(key), seed)) / w).alias("_es"),
    )
    return rows.withColumn("_cell", F.least(F.floor((1 - F.exp(-F.col("_es"))) * CELLS), F.lit(CELLS - 1)).cast("int"))


def targets(rows: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """_src, source_size, target, epochs, rest: one row for each source.

    Targets share `share` times all sizes by weight, none over `most` times its source's size. Sources that reach that, in ascending
    order of limit by weight, are a prefix; what they leave is shared by the others, so one running sum finds them all.
    """
    sizes = rows.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_src") == "n", "_src")
    sizes = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("_n") - 1, F.lit(len(cycle))) + 1).cast("int")))
    sizes = sizes.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_cap"))
    final = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_n"), F.col("_level")))).over(all_rows)["_level"]
    sizes = sizes.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(final * F.col("_w"), F.col("_cap"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return sizes.select("_src", "source_size", "target", epochs.alias("_epochs"), (F.col("target") - epochs * F.col("source_size")).alias("_rest"))


def decided(rows: DataFrame, *, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For each row of `keyed` (without texts): its source's size and target, whole epochs, and whether the fractional part takes it."""
    cells = rows.groupBy("_src", "_cell").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_src").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(targets(rows, cycle, share, most), "_src")
    within = Window.partitionBy("_src", "_cell").orderBy("_es", "_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(cells.drop("_sum"), ["_src", "_cell"]).withColumn("_run", F.col("_base") + F.sum("_size").over(within))
    return out.withColumn("_extra", 2 * F.col("_run") - F.col("_size") < 2 * F.col("_rest"))


def mix_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str | None = None, source: str = "source", weight: Column | None = None, seed: str = "mix", **shares) -> DataFrame:
    """key, size, source_size, target, taken, for every row of docs.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source, the last; a null key is hashed as such.
    Equal rows are drawn each; rows with equal keys and sizes are interchangeable. An empty table gives no rows.
    """
    rows = keyed(docs, key=key, text=text, size=size, source=source, weight=weight, seed=seed).select("_key", "_src", "_size", "_es", "_cell")
    out = decided(staged(rows, "sizes"), **shares)
    taken = F.col("_size") * (F.col("_epochs") + F.col("_extra").cast("long"))
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str | None = None, source: str = "source", weight: Column | None = None, seed: str = "mix", **shares) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it (0 to `most` times).

    What a source's fraction takes is a prefix by (exponential key, key, size), so one bound for each source says it and texts
    aren't moved. Rows that are equal in all three are taken together.
    """
    rows = keyed(docs, key=key, text=text, size=size, source=source, weight=weight, seed=seed)
    out = decided(staged(rows.select("_key", "_src", "_size", "_es", "_cell"), "sizes"), **shares)
    place = F.struct("_es", "_key", "_size")
    bounds = staged(out.groupBy("_src").agg(F.max(F.when(F.col("_extra"), place)).alias("_last"), F.max("_epochs").alias("_epochs")), "bounds")
    times = F.col("_epochs") + F.coalesce(place <= F.col("_last"), F.lit(False)).cast("long")
    return rows.join(bounds, "_src").withColumn("_time", F.explode(F.sequence(F.lit(0), times.cast("int")))).where(F.col("_time") > 0).select("_row.*")
