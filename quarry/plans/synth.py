"""COBOL programs made from tables, so that what a plan finds in them can be told from the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def order_statement(key: Column, amount: Column, status: Column, customer: Column) -> Column:
    """One statement for each order; its key says which verb."""
    name, n = text("O-", key), amount.cast("long")
    forms = [
        text("    DISPLAY ", name, "."), text("    MOVE ", n, " TO ", name, "."), text("    ADD ", n, " TO ", name, "."), text("    SUBTRACT ", n, " FROM ", name, "."),
        text("    MULTIPLY ", n, " BY ", name, "."), text("    DIVIDE ", n, " INTO ", name, "."), text('    CALL "SUB-', status, '" USING ', name, " ", n, "."), text("    MOVE NAME-", customer, " TO ", name, "."),
    ]
    chosen = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        chosen = F.when(key % 8 == i, f).otherwise(chosen)
    return chosen


def order_programs(orders: DataFrame) -> DataFrame:
    """path, text: a program for each customer, with a data item and a statement for each order.

    An item is left out where the key is a multiple of 7, and there twice where it is a multiple of 11.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = text("01 O-", k, " PIC 9(7).\n")
    items = F.when(k % 7 == 0, "").when(k % 11 == 0, F.concat(item, item)).otherwise(item)
    rows = orders.select(c.alias("c"), k.alias("k"), items.alias("item"), order_statement(k, F.col("o_totalprice"), F.col("o_orderstatus"), c).alias("step"))
    grouped = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "item", "step"))).alias("o"))
    body = text(
        "IDENTIFICATION DIVISION.\nPROGRAM-ID. CUST-", F.col("c"), ".\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n01 NAME-", F.col("c"), " PIC X(20) VALUE SPACES.\n",
        F.array_join("o.item", ""), "PROCEDURE DIVISION.\nMAIN-PARA.\n", F.array_join("o.step", "\n"), "\n    STOP RUN.\n",
    )
    return grouped.select(text("cust-", F.col("c"), ".cbl").alias("path"), body.alias("text"))


def item_programs(parts: DataFrame) -> DataFrame:
    """path, text: a program for each part, with pictures whose sizes come from its columns."""
    k = F.col("p_partkey")
    size, digits = F.col("p_size"), F.pmod(k, F.lit(9)) + 1
    body = text(
        "IDENTIFICATION DIVISION.\nPROGRAM-ID. PART-", k, ".\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n01 PART-REC.\n05 PART-NAME PIC X(", size, ").\n05 PART-PRICE PIC S9(", digits, ")V9(2) VALUE 0.\n",
        "05 PART-CODE PIC ", F.expr("repeat('9', cast(pmod(p_partkey, 9) + 1 as int))"), ".\n05 PART-EDIT PIC ZZ9.\n88 IS-BIG VALUE ", size, ".\n77 PART-SPARE PIC XX.\n",
    )
    return parts.select(text("part-", k, ".cbl").alias("path"), body.alias("text"))


def broken_programs(suppliers: DataFrame) -> DataFrame:
    """path, text: a program for each supplier that the reading leaves early, in a way that its key says.

    0 a verb that is not supported, 1 a statement whose error sticks to its last word, 2 one whose error is read past, 3 no paragraph,
    4 no program name and a reserved data name.
    """
    k = F.col("s_suppkey")
    kind = F.pmod(k, F.lit(5))
    head = F.when(kind == 4, "IDENTIFICATION DIVISION.\n").otherwise(text("IDENTIFICATION DIVISION.\nPROGRAM-ID. SUPP-", k, ".\n"))
    data = F.when(kind == 4, "DATA DIVISION.\nWORKING-STORAGE SECTION.\n01 SORT PIC 9.\n").otherwise("")
    odd = F.when(kind == 0, "    COMPUTE X = 1.\n").when(kind == 1, "    MOVE TO X.\n").when(kind == 2, "    ADD TO 5.\n").otherwise("")
    label = F.when(kind == 3, "").otherwise("MAIN-PARA.\n")
    return suppliers.select(text("supp-", k, ".cbl").alias("path"), text(head, data, "PROCEDURE DIVISION.\n", label, "    DISPLAY 1.\n", odd, "    DISPLAY ", k, ".\n    GOBACK.\n").alias("text"))


def fixed_sources(lineitem: DataFrame) -> DataFrame:
    """path, text: fixed-format lines, one for each line item of an order, with sequence numbers and a comment area."""
    line = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 6, "0"), F.lit(" "), F.rpad(text("    MOVE ", F.col("l_quantity").cast("long"), " TO Q-", F.col("l_partkey"), "."), 65, " "), F.lit("COMMENT\n"))
    rows = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), line.alias("line"))
    return rows.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "p", "line")))["line"], "").alias("text")).select(text("order-", F.col("k"), ".cbl").alias("path"), "text")
