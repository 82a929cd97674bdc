"""The lexer: one regular expression over whole sources, then windows for places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cobol import is_keyword
from ..functions.text import ascii_upper, quoted

#: White space, then in order: comments, strings, numbers, words, any one character, the end. Every character falls in one match.
PATTERN = r"""(?s)[ \t\r\n]*+(?:\*>[^\r\n]*|(?<![^\r\n])\*[^\r\n]*|"[^"\r\n]*"|'[^'\r\n]*'|[0-9]+|[A-Za-z][A-Za-z0-9-]*|.|\z)"""
_BREAK = r"\r\n|\r|\n"


def matches(sources: DataFrame) -> DataFrame:
    """path, i, m, offset, line, col of what isn't white space. Sources are dealt by path once; all that follows stays there."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("i", "x")
    rows = sources.select("path", "text").repartition(parts, "path").select("path", found).withColumn("m", F.ltrim("x", F.lit(" \t\r\n"))).where("m <> ''")
    rows = rows.select("path", "i", "m", F.expr("left(x, char_length(x) - char_length(m))").alias("gap"))
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.col("gap").rlike("[\r\n]")
    rows = rows.withColumns({"n": F.char_length("m"), "breaks": F.when(broken, F.regexp_count("gap", F.lit(_BREAK))).otherwise(0), "tail": F.when(broken, F.char_length(F.regexp_extract("gap", r"([^\r\n]*)\z", 1)))})
    rows = rows.withColumn("offset", (F.sum(F.char_length("gap") + F.col("n")).over(order) - F.col("n")).cast("int")).withColumn("line", (1 + F.sum("breaks").over(order)).cast("int"))
    start = F.coalesce(F.max(F.col("offset") - F.col("tail")).over(order), F.lit(0))  # where the line begins
    return rows.select("path", "i", "m", "offset", "line", (F.col("offset") - start + 1).cast("int").alias("col"))


def typed(found: DataFrame) -> DataFrame:
    """Matches without comments, with type and lexeme; type null is a lexical error."""
    m = F.col("m")
    word = m.rlike("^[A-Za-z]")
    lexeme = F.when(word, ascii_upper(F.regexp_replace(m, "-+$", ""))).otherwise(m)
    comment = m.startswith("*>") | (m.startswith("*") & (F.col("col") == 1))
    kind = (
        F.when(word, F.when(is_keyword(lexeme), "keyword").otherwise("identifier")).when(m.rlike("^[0-9]"), "number")
        .when(m.rlike("""(?s)^["'].*["']$""") & (F.char_length(m) >= 2), "string").when(m == ".", "period").when(m == ",", "comma")
        .when(m == "(", "lparen").when(m == ")", "rparen").when(m.isin(list(";:+-*/=<>")), "unknown")
    )
    return found.where(~comment).select("path", "i", kind.alias("type"), lexeme.alias("lexeme"), "line", "col", "offset")


def lexed(sources: DataFrame) -> DataFrame:
    """path, tok_idx, type, lexeme, line, col, offset. A source with a lexical error has one row, its first error's, with type null."""
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrong = F.min(F.when(F.col("type").isNull(), F.col("i"))).over(order)
    rows = typed(matches(sources)).withColumn("wrong", wrong).where("wrong IS NULL OR i = wrong")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("i")) - 1).alias("tok_idx"), "type", "lexeme", "line", "col", "offset")


def tokens(sources: DataFrame) -> DataFrame:
    """The tokens of sources without lexical errors; a source with one gives no tokens."""
    return lexed(sources).where("type IS NOT NULL")


def lex_errors(sources: DataFrame) -> DataFrame:
    """The first lexical error of each source that has one."""
    return errors(lexed(sources).where("type IS NULL"))


def errors(rows: DataFrame) -> DataFrame:
    """path, line, col, offset, message of lexical errors."""
    opened = F.col("lexeme").isin('"', "'")
    message = F.when(opened, "unterminated string literal").otherwise(F.concat(F.lit("unexpected character "), quoted(F.col("lexeme"))))
    return rows.select("path", "line", "col", "offset", message.alias("message"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """Tokens by kind for each source; the total counts the end of file."""
    kinds = ("keyword", "identifier", "number", "string", "period", "unknown")
    return tokens.groupBy("path").agg((F.count("*") + 1).alias("total"), *(F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds))


def sentences(tokens: DataFrame) -> DataFrame:
    """path, sent, toks, stop, ended, error: tokens up to each period, which is left out; `ended` is false for what stands after the last one.

    A row without a type, as `lexed` has it, is a sentence that is an error and nothing else.
    """
    before = Window.partitionBy("path").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumn("sent", F.coalesce(F.sum(F.when(F.col("type") == "period", 1).otherwise(0)).over(before), F.lit(0)).cast("int"))
    place = F.struct("tok_idx", "type", "lexeme", "line", "col", "offset")
    words = F.sort_array(F.collect_list(F.when(F.col("type") != "period", place)))
    stop = F.max(F.when(F.col("type") == "period", place))
    ended = F.coalesce(F.max(F.col("type") == "period"), F.lit(False))
    return rows.groupBy("path", "sent").agg(words.alias("toks"), stop.alias("stop"), ended.alias("ended"), F.max(F.when(F.col("type").isNull(), place)).alias("error"))
