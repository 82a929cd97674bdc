"""Scalar functions over text and bytes, as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import EBCDIC_LEAST, EBCDIC_ODD, EBCDIC_PRINTABLE, SAMPLE, TYPE_OF


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def ascii_upper(c: Column) -> Column:
    """Upper case for a-z alone, so that every engine agrees."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def quoted(c: Column) -> Column:
    """A word in single quotes, or in double quotes if it has single but no double ones, as diagnostics show it."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def extension(name: Column) -> Column:
    """Lower-case text from the last dot on; empty without a dot or with one at the end."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _bytes(content: Column) -> Column:
    """One character for each of the first SAMPLE bytes."""
    return F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")


def is_ebcdic(content: Column) -> Column:
    s = _bytes(content)
    n = F.char_length(s)
    printable = F.char_length(F.regexp_replace(s, r"[^\x20-\x7E]", ""))
    odd = F.char_length(F.regexp_replace(s, r"[\x20-\x7E\x09\x0A\x0D]", ""))
    return (F.octet_length(content) >= EBCDIC_LEAST) & (printable / n < EBCDIC_PRINTABLE) & (odd / n > EBCDIC_ODD)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def encoding(content: Column, mode: str = "reference") -> Column:
    """UNKNOWN, UTF-16, UTF-8, EBCDIC or ASCII.

    Empty content is UNKNOWN; then byte-order marks count; then the EBCDIC test, which in extended mode spares valid UTF-8; then ASCII
    is all bytes under 0x80, and valid UTF-8 is UTF-8. The last step stands for a statistical detector.
    """
    head = F.hex(F.substring(content, 1, 3))
    ebcdic = is_ebcdic(content) if mode == "reference" else is_ebcdic(content) & ~is_utf8(content)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "UNKNOWN").when(head.startswith("FFFE") | head.startswith("FEFF"), "UTF-16")
        .when(head == "EFBBBF", "UTF-8").when(ebcdic, "EBCDIC").when(~F.decode(content, "ISO-8859-1").rlike(r"[^\x00-\x7F]"), "ASCII")
        .when(is_utf8(content), "UTF-8").otherwise("UNKNOWN")
    )


def decoded(content: Column) -> Column:
    """Strict text of UTF-8 bytes without a byte-order mark; null where they are not valid."""
    return F.when(is_utf8(content), F.regexp_replace(content.cast("string"), "^﻿", ""))


def decoded_replacing(content: Column) -> Column:
    """Text of UTF-8 bytes, with U+FFFD for what is not valid."""
    return F.make_valid_utf8(content.cast("string"))


def sniffed(content: Column) -> Column:
    """JCL or BMS by the first bytes, else null."""
    s = F.regexp_replace(_bytes(content), r"^[\x09-\x0D\x1C-\x20\x85\xA0]+", "")
    return F.when(s.startswith("//"), "JCL").when(ascii_upper(s).rlike("DFHMSD|DFHMDI|DFHMDF"), "BMS")


def file_type(name: Column, content: Column | None = None) -> Column:
    """The extension's type unless it is Text or not known; then what the content shows; then Text for .txt, else Unknown."""
    known = lookup(TYPE_OF, extension(name))
    seen = F.lit(None).cast("string") if content is None else sniffed(content)
    return F.when(known.isNotNull() & (known != "Text"), known).otherwise(F.coalesce(seen, known, F.lit("Unknown")))
