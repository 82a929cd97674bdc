"""Scalar functions of the COBOL model: literals, pictures, usages, names and types, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FIGURATIVE, KEYWORDS, RESERVED, USAGE
from .text import ascii_lower, ascii_upper, lookup

CTYPE = "struct<category:string,digits:int,signed:boolean,decimal_places:int,length:int,usage:string>"
_NUMERIC = r"(?i)^(S?)9(?:\(([0-9]+)\)|(9*))(?:V9(?:\(([0-9]+)\)|(9*)))?$"
_ALPHA = r"(?i)^X(?:\(([0-9]+)\)|(X*))$"


def is_keyword(word: Column) -> Column:
    return word.isin(KEYWORDS)


def is_reserved(word: Column) -> Column:
    return ascii_upper(word).isin(RESERVED)


def is_literal(text: Column, empty: bool = True) -> Column:
    """Quoted, numeric (a digit or sign first) or a figurative constant. Resolution counts empty text as literal, type checks don't."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty)).otherwise(text.rlike(r"""^["'0-9+\-]""") | ascii_upper(text).isin(FIGURATIVE))


def is_numeric_literal(text: Column) -> Column:
    """Any signs, then digits with at most one dot; a dot alone counts."""
    return F.coalesce(text.rlike(r"^[+\-]*([0-9]+\.?[0-9]*|\.[0-9]*)$"), F.lit(False))


def operand(text: Column) -> Column:
    """An operand as instructions have it: double-quoted and numeric literals as they are, names in upper case."""
    t = F.trim(text)
    return F.when((t.startswith('"') & t.endswith('"') & (F.char_length(t) >= 2)) | is_numeric_literal(t), t).otherwise(ascii_upper(t))


def picture_type(picture: Column) -> Column:
    """The type that a picture declares, as CTYPE: numeric, alphanumeric, group without a picture, else null. Usage is always DISPLAY."""
    p = F.trim(picture)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(p, pattern, group)

    def digits(n: int, bare: int) -> Column:
        return F.when(part(_NUMERIC, n) != "", part(_NUMERIC, n).cast("int")).otherwise(F.char_length(part(_NUMERIC, bare)) + 1)

    decimals = F.when(p.rlike("(?i)V9"), digits(4, 5)).otherwise(F.lit(0))
    none = F.lit(None)
    make = lambda c, d, s, f, n: F.struct(F.lit(c).alias("category"), d.cast("int").alias("digits"), s.cast("boolean").alias("signed"), f.cast("int").alias("decimal_places"), n.cast("int").alias("length"), F.lit("DISPLAY").alias("usage"))
    return (
        F.when(picture.isNull(), make("group", none, none, none, none))
        .when(p.rlike(_NUMERIC), make("numeric", digits(2, 3) + decimals, part(_NUMERIC, 1) != "", decimals, none))
        .when(p.rlike(_ALPHA), make("alphanumeric", none, none, none, F.when(part(_ALPHA, 1) != "", part(_ALPHA, 1).cast("int")).otherwise(F.char_length(part(_ALPHA, 2)) + 1)))
    )


def usage(word: Column) -> Column:
    return F.coalesce(lookup(USAGE, ascii_upper(F.trim(word))), F.lit("DISPLAY"))


def movable(source: Column, target: Column) -> Column:
    """Whether a MOVE between two categories is allowed: only alphanumeric to numeric is not."""
    return ~((source == "alphanumeric") & (target == "numeric"))


def spark_type(ctype: Column) -> Column:
    """The SQL type that holds a value of a COBOL type; numbers over 38 digits stay text."""
    d, f = ctype["digits"].cast("string"), ctype["decimal_places"].cast("string")
    return F.when((ctype["category"] == "numeric") & (ctype["digits"] <= 38), F.concat(F.lit("decimal("), d, F.lit(","), f, F.lit(")"))).when(ctype.isNotNull(), "string")


def java_type(ctype: Column) -> Column:
    """int, double or String; null where there is no mapping."""
    numeric = F.when(ctype["decimal_places"] == 0, "int").otherwise("double")
    return F.when(ctype["category"] == "numeric", numeric).when(ctype["category"].isin("alphanumeric", "group"), "String")


def _capital(s: Column) -> Column:
    return F.concat(ascii_upper(F.substring(s, 1, 1)), ascii_lower(F.substring(s, 2, 1 << 30)))


def java_field_name(name: Column) -> Column:
    """lowerCamelCase: first part lower, others capitalised, invalid characters dropped; `f` before a digit; `field` if nothing is left."""
    parts = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), "[-_]+"), lambda s: s != "")
    joined = F.regexp_replace(F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, ascii_lower(s)).otherwise(_capital(s))), ""), "[^A-Za-z0-9$_]", "")
    return F.when(joined == "", "field").when(joined.rlike("^[0-9]"), F.concat(F.lit("f"), joined)).otherwise(joined)


def java_class_name(name: Column) -> Column:
    """PascalCase: parts in one case are capitalised, mixed ones keep their tail; `P` before a non-letter; GeneratedProgram if empty."""
    parts = F.split(F.trim(F.coalesce(name, F.lit(""))), "[-_]+")
    one_case = lambda s: s.rlike("[A-Za-z]") & ((ascii_upper(s) == s) | (ascii_lower(s) == s))
    pascal = F.transform(parts, lambda s: F.when(one_case(s), _capital(s)).otherwise(F.concat(ascii_upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))))
    joined = F.regexp_replace(F.array_join(pascal, ""), "[^A-Za-z0-9$_]", "")
    return F.when(joined == "", "GeneratedProgram").when(~joined.rlike("^[A-Za-z]"), F.concat(F.lit("P"), joined)).otherwise(joined)


def java_field(java_type: Column, java_name: Column, value: Column | None = None) -> Column:
    """A field's declaration line."""
    head = F.concat(F.lit("    private "), java_type, F.lit(" "), java_name)
    return F.concat(head, F.lit(";")) if value is None else F.when(value.isNull(), F.concat(head, F.lit(";"))).otherwise(F.concat(head, F.lit(" = "), value, F.lit(";")))
