"""Preference formatting: the turns that a chosen and a rejected conversation share become the prompt, the rest masked completions.
DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: How a turn is rendered: OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _loss(turns: Column, before: Column, role: str) -> Column:
    """Spans `start:end` in code points, end exclusive, of what bears loss: the texts of `role` with their end marks."""
    spans = F.transform(turns, lambda t: F.when(t["role"] == role, F.concat_ws(":", t["end"] - before - F.char_length(t["text"]) - F.lit(len(END)), t["end"] - before)))
    return F.array_join(F.array_compact(spans), ",")


def _gathered(turns: DataFrame, pair: Column, sides: dict[str, Column], turn: str, role: str, text: str) -> DataFrame:
    """pair_id and an array of (turn, role, text, end) for each side; `end` is where a turn ends, rendered. One shuffle, by pair."""
    rows = turns.select(pair.cast("long").alias("pair_id"), *(F.coalesce(c, F.lit(False)).alias(f"_is{s}") for s, c in sides.items()), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    among = [f"_is{s}" for s in sides]
    rows = rows.where(F.col("pair_id").isNotNull() & (F.greatest(*among) if len(among) > 1 else F.col(among[0]))).repartition(partitions(turns.sparkSession), "pair_id")
    order = Window.partitionBy("pair_id", *among).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("role") + F.char_length("text") + F.lit(len(OPEN) + len(CLOSE) + len(END))
    rows = rows.withColumn("_turn", F.struct("turn", "role", "text", F.sum(size).over(order).alias("end")))
    return rows.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col(f"_is{s}"), F.col("_turn")))).alias(s) for s in sides))


def _formatted(both: DataFrame, learn: str) -> DataFrame:
    """both: pair_id, the turns _c of the chosen and _r of the rejected side."""
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"], t["text"]))
    same = F.zip_with(plain(F.col("_c")), plain(F.col("_r")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    both = both.withColumn("_n", F.when((F.size("_c") > 0) & (F.size("_r") > 0), F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))).otherwise(0).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c), F.lit(1)))
    before = F.when(F.col("_n") > 0, F.get("_c", F.col("_n") - 1)["end"]).otherwise(F.lit(0))  # of what both share
    there = lambda c, v: F.when(F.size(c) > 0, v)
    return both.select(
        "pair_id", F.col("_n").cast("long").alias("prompt_turns"), _rendered(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
        *(there(c, _rendered(rest(c))).alias(n) for c, n in (("_c", "chosen"), ("_r", "rejected"))),
        *(there(c, _loss(rest(c), before, learn)).alias(n) for c, n in (("_c", "chosen_loss"), ("_r", "rejected_loss"))),
    )


def preferences(turns: DataFrame, *, pair: Column, side: Column, turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss.

    `side` is 0 for turns of the chosen conversation, 1 for those of the rejected one. Turns are in the order of (turn, role, text);
    null roles and texts count as empty, null turns come first, and turns that repeat stay repeated. Turns with a null pair or another
    side are left out. Where one side is missing the prompt is empty and that side null. What stands in one row is one pair's turns;
    nothing else is gathered. An empty table gives no rows; other columns are not read.
    """
    return _formatted(_gathered(turns, pair, {"_c": side == 0, "_r": side == 1}, turn, role, text), learn)


def against_earlier_answers(turns: DataFrame, *, conversation: Column, declined: str, turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Preference pairs from single conversations, as `preferences` gives them; pair_id is the conversation.

    Chosen is the conversation as it is. Rejected has the same turns, but its last turn of role `learn` repeats the conversation's
    first one, or says `declined` where that is the only one. So the prompt is what comes before the last answer. A conversation
    without such a turn, or whose two answers are equal, is all prompt. Turns are ordered, and nulls and other columns treated, as in
    `preferences`; turns with a null conversation are left out. Texts are moved once.
    """
    both = _gathered(turns, conversation, {"_c": F.lit(True)}, turn, role, text)
    answers = F.filter(F.transform("_c", lambda t, i: F.when(t["role"] == learn, i)), lambda i: i.isNotNull())
    both = both.withColumns({"_first": F.get(answers, F.lit(0)), "_last": F.get(answers, F.size(answers) - 1)})
    other = F.when(F.col("_first") < F.col("_last"), F.get("_c", "_first")["text"]).otherwise(F.lit(declined))
    both = both.withColumn("_other", other).withColumn("_more", F.char_length("_other") - F.char_length(F.get("_c", "_last")["text"]))

    def replaced(t: Column, i: Column) -> Column:
        text_ = F.when(i == F.col("_last"), F.col("_other")).otherwise(t["text"])
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text_.alias("text"), (t["end"] + F.when(i >= F.col("_last"), F.col("_more")).otherwise(0)).alias("end"))

    return _formatted(both.withColumn("_r", F.transform("_c", replaced)), learn)
