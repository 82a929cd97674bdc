"""Value tables of scalar functions."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import cobol, text
from quarry.functions.fixed import FIGURATIVE, KEYWORDS, RESERVED
from quarry.operators import srcformat


def column(spark, values, *exprs):
    schema = "v binary" if any(isinstance(v, (bytes, bytearray)) for v in values) else "v string"
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [tuple(r)[1:] for r in rows.select("i", *exprs).orderBy("i").collect()]


def test_word_lists():
    assert (len(KEYWORDS), len(RESERVED), len(FIGURATIVE)) == (26, 50, 14)


def test_pictures(spark):
    numeric = {"9": (1, False, 0), "9(5)": (5, False, 0), "S9(7)": (7, True, 0), "9(5)V9(2)": (7, False, 2), "S9(9)V9(2)": (11, True, 2), "99": (2, False, 0), "S99": (2, True, 0), "9(10)": (10, False, 0), "S9(3)V9(4)": (7, True, 4), "s9v99": (3, True, 2)}
    text_ = {"X": 1, "X(30)": 30, "XX": 2, "X(1)": 1, "X(100)": 100, "XXX": 3}
    t = cobol.picture_type(F.col("v"))
    got = column(spark, [*numeric, *text_, "ZZZZ", None], t["category"], t["digits"], t["signed"], t["decimal_places"], t["length"])
    assert got[: len(numeric)] == [("numeric", *v, None) for v in numeric.values()]
    assert got[len(numeric) : -2] == [("alphanumeric", None, None, None, n) for n in text_.values()]
    assert got[-2] == (None,) * 5 and got[-1][0] == "group"


def test_spark_types(spark):
    got = column(spark, ["S9(5)V9(2)", "X(3)", "9(39)", "Z"], cobol.spark_type(cobol.picture_type(F.col("v"))))
    assert [g[0] for g in got] == ["decimal(7,2)", "string", "string", None]


def test_literals(spark):
    values = ['"A"', "'A'", "1", "+1", "-1", "spaces", "WS-X", "", "ALL"]
    got = column(spark, values, cobol.is_literal(F.col("v")), cobol.is_literal(F.col("v"), empty=False))
    assert [g[0] for g in got] == [True] * 6 + [False, True, True]
    assert got[7] == (True, False)


def test_numeric_literals_and_operands(spark):
    values = ["1", "-1.5", ".", "1.2.3", "", "+", "A1", '"x y"', "'abc'", " ws-x "]
    got = column(spark, values, cobol.is_numeric_literal(F.col("v")), cobol.operand(F.col("v")))
    assert [g[0] for g in got] == [True, True, True, False, False, False, False, False, False, False]
    assert [g[1] for g in got[7:]] == ['"x y"', "'ABC'", "WS-X"]


def test_usage_and_moves(spark):
    assert [g[0] for g in column(spark, ["comp-3", " BINARY ", "PACKED-DECIMAL", "x", None], cobol.usage(F.col("v")))] == ["COMP-3", "COMP", "COMP-3", "DISPLAY", "DISPLAY"]
    kinds = ["numeric", "alphanumeric", "group"]
    got = {(s, t): column(spark, [s], cobol.movable(F.col("v"), F.lit(t)))[0][0] for s in kinds for t in kinds}
    assert [k for k, ok in got.items() if not ok] == [("alphanumeric", "numeric")]


def test_names(spark):
    fields = {"WS-COUNT": "wsCount", "CUSTOMER-NAME": "customerName", "EMPLOYEE-ID": "employeeId", "TOTAL": "total", "WS_COUNT": "wsCount", "WS-TOTAL-COUNT": "wsTotalCount", "": "field", "  ": "field", "1INVALID": "f1invalid", "--": "field"}
    assert [g[0] for g in column(spark, list(fields), cobol.java_field_name(F.col("v")))] == list(fields.values())
    classes = {"HELLO": "Hello", "HELLO-WORLD": "HelloWorld", "hello_world": "HelloWorld", "payroll": "Payroll", "myProgram": "MyProgram", "CALC-PAYROLL-REPORT": "CalcPayrollReport", "A": "A", "": "GeneratedProgram", " ": "GeneratedProgram", "9X": "P9x"}
    assert [g[0] for g in column(spark, list(classes), cobol.java_class_name(F.col("v")))] == list(classes.values())


def test_extensions_and_types(spark):
    names = {"A.CBL": (".cbl", "COBOL"), "a.cob": (".cob", "COBOL"), "x.cpy": (".cpy", "Copybook"), "j.jcl": (".jcl", "JCL"), "p.proc": (".proc", "PROC"), "p.prc": (".prc", "PROC"), "m.bms": (".bms", "BMS"), "a.xml": (".xml", "XML"), "a.json": (".json", "JSON"), "r.txt": (".txt", "Text"), "none": ("", "Unknown"), "dot.": ("", "Unknown"), "a.b.c": (".c", "Unknown")}
    assert column(spark, list(names), text.extension(F.col("v")), text.file_type(F.col("v"))) == list(names.values())


def test_sniffing(spark):
    got = column(spark, [b"  //JOB", b"MAP DFHMSD x", b"plain", b""], text.file_type(F.lit("a.txt"), F.col("v")), text.file_type(F.lit("a"), F.col("v")))
    assert got == [("JCL", "JCL"), ("BMS", "BMS"), ("Text", "Unknown"), ("Text", "Unknown")]


def test_encodings(spark):
    values = [b"", b"\xff\xfeA\x00", b"\xfe\xff\x00A", b"\xef\xbb\xbfhi", bytes([0xC1, 0xC2, 0x00, 0x01] * 8), b"plain text", "größe und maß".encode(), b"abcdefgh\xff\xfe tail", "ÄÖÜäöüß".encode()]
    got = [g[0] for g in column(spark, values, text.encoding(F.col("v")))]
    assert got == ["UNKNOWN", "UTF-16", "UTF-16", "UTF-8", "EBCDIC", "ASCII", "UTF-8", "UNKNOWN", "EBCDIC"]
    assert column(spark, [values[-1]], text.encoding(F.col("v"), "extended"))[0][0] == "UTF-8"


def test_decoding(spark):
    got = column(spark, [b"\xef\xbb\xbfhi", b"a\xffb", "ß".encode()], text.decoded(F.col("v")), text.decoded_replacing(F.col("v")))
    assert [g[0] for g in got] == ["hi", None, "ß"] and got[1][1] == "a�b"


FIVE = "       DISPLAY 1.\n" * 5


@pytest.mark.parametrize(
    ("source", "expected"),
    [(">>SOURCE FREE\nX", "free"), ("  >>source free", "free"), (">>SOURCE FIXED\n*> x", "fixed"), ("*> note", "free"), ("  DISPLAY 1. *> note", "free"), ("DISPLAY \"a *> b\".", "unknown"), ("A\nB", "unknown"), ("A\n" * 5, "unknown"), ("", "unknown"), (" \n ", "unknown"), (FIVE, "fixed"), ("000100 A\n" * 5, "fixed"), (FIVE + "A\n" * 4, "unknown")],
)
def test_source_format(spark, source, expected):
    assert column(spark, [source], srcformat.source_format(F.col("v"))) == [(expected,)]


def test_normalising(spark):
    source = "000100 A" + "x" * 70 + "\r\nshort\r\n000200*note\n"
    got = column(spark, [source], srcformat.normalised(F.col("v"), F.lit("fixed")), srcformat.normalised(F.col("v"), F.lit("free")), srcformat.normalised(F.col("v"), F.lit("unknown")))
    assert got == [(" A" + "x" * 64 + "\r\n\r\n*note\n", source, None)]


def test_lines(spark):
    got = column(spark, ["a\r\nb\rc\n", "", "\n", "a"], srcformat.lines(F.col("v")), srcformat.with_endings(F.col("v")))
    assert got == [(["a", "b", "c"], ["a\r\n", "b\r", "c\n"]), ([], []), ([""], ["\n"]), (["a"], ["a"])]
