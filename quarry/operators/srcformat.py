"""Source layout: detection of free and fixed format, and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CODE_COLUMNS, FIXED_LINES, FIXED_SHARE
from ..functions.text import ascii_upper


def lines(text: Column) -> Column:
    """A text's lines; any kind of break ends one, and an empty last line is none."""
    one = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    split = F.split(one, "\n", -1)
    return F.when(one == "", F.array().cast("array<string>")).when(one.endswith("\n"), F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def looks_numbered(line: Column) -> Column:
    """Digits or blanks in columns 1-6 and an indicator in column 7."""
    return line.rlike(r"^[0-9 ]{6}[ */\-D]")


def starts_in_area_a(line: Column) -> Column:
    """Columns 1-7 blank, column 8 not."""
    return line.rlike(r"^ {7}[^ ]") & ~line.rlike(r"^ {7}\s")


def evidence(lines: Column) -> Column:
    """Share of the lines that aren't blank that look fixed; null where there are fewer than FIXED_LINES."""
    shown = F.size(F.filter(lines, lambda s: s.rlike(r"\S")))
    fixed = F.size(F.filter(lines, lambda s: s.rlike(r"\S") & (looks_numbered(s) | starts_in_area_a(s))))
    return F.when(shown >= FIXED_LINES, fixed / shown)


def directive(lines: Column) -> Column:
    """free or fixed by the first `>>SOURCE` line that says so."""
    said = F.transform(F.filter(lines, lambda s: s.contains(">>")), lambda s: F.regexp_extract(ascii_upper(F.regexp_replace(s, r"^\s+|\s+$", "")), r"^>>SOURCE\s*(FREE|FIXED)$", 1))
    return F.lower(F.get(F.filter(said, lambda s: s != ""), F.lit(0)))


def has_free_comment(lines: Column) -> Column:
    """A line that starts with `*>`, or has it after an even number of quotes of either kind."""
    def even(s: Column) -> Column:
        before = F.substring_index(s, "*>", 1)
        count = lambda q: F.char_length(before) - F.char_length(F.replace(before, F.lit(q), F.lit("")))
        return s.contains("*>") & (s.rlike(r"^\s*\*>") | ((count('"') % 2 == 0) & (count("'") % 2 == 0)))

    return F.exists(lines, even)


def with_format(sources: DataFrame) -> DataFrame:
    """sources with source_format (free, fixed or unknown: by directive, then by free-format comments, then by evidence) and evidence.

    A text is cut into lines once.
    """
    cut = sources.withColumn("_lines", lines(F.col("text")))
    shown = cut.withColumn("evidence", evidence(F.col("_lines")))
    found = F.coalesce(directive(F.col("_lines")), F.when(has_free_comment(F.col("_lines")), "free"), F.when(F.col("evidence") >= FIXED_SHARE, "fixed"), F.lit("unknown"))
    return shown.withColumn("source_format", found).drop("_lines")


def source_format(text: Column) -> Column:
    """The same for a text alone."""
    cut = lines(text)
    return F.coalesce(directive(cut), F.when(has_free_comment(cut), "free"), F.when(evidence(cut) >= FIXED_SHARE, "fixed"), F.lit("unknown"))


def with_endings(text: Column) -> Column:
    """Lines with the breaks that end them."""
    return F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"), F.lit(0))


def normalised(text: Column, source_format: Column) -> Column:
    """Free text as it is; of fixed text columns 7-72 of each line with its break; null for an unknown format."""
    start, stop = CODE_COLUMNS
    cut = F.regexp_replace(text, rf"(?m)(?<![^\r\n])[^\r\n]{{0,{start}}}([^\r\n]{{0,{stop - start}}})[^\r\n]*", "$1")
    return F.when(source_format == "free", text).when(source_format == "fixed", cut)


def normalise(sources: DataFrame, extended: bool = False) -> DataFrame:
    """sources with source_format, and the text normalised by it; in extended mode text of an unknown format stays as it is."""
    rows = with_format(sources).drop("evidence")
    clean = normalised(F.col("text"), F.col("source_format"))
    return rows.withColumn("text", F.coalesce(clean, F.col("text")) if extended else clean)
