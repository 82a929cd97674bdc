"""Queries over programs that are wrong, odd or extended in ways that a row's key says, each with the SQL that tells what must be found.

They complete `queries`, whose programs are mostly sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cobol, text
from .functions.fixed import UPLOADS
from .operators import ir, java, lexer, semantics, srcformat, validate
from .plans.synth import text as joined
from .queries import compiled, compiled_orders, query, read, uploads
from .sources import files

_PATH = "'s-' || s_suppkey || '.cbl'"


def k() -> Column:
    return F.col("s_suppkey")


def programs(spark: SparkSession, sf_dir: str, *parts: str | Column) -> DataFrame:
    """path, text: a source for each supplier; parts that are null are left out."""
    rows = read(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL")
    return rows.select(joined("s-", k(), ".cbl").alias("path"), F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


def named(*after: str | Column) -> list[str | Column]:
    return ["IDENTIFICATION DIVISION.\nPROGRAM-ID. S-", k().cast("string"), ".\n", *after]


def some(test: Column, *parts: str | Column) -> Column:
    return F.when(test, joined(*parts))


# --- semantics ---


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs(
        spark, sf_dir, *named("DATA DIVISION.\nWORKING-STORAGE SECTION.\n01 ITEM-", k(), " PIC 9.\nPROCEDURE DIVISION.\nP-", k(), ".\n    DISPLAY 1.\n"),
        some(k() % 3 == 0, "P-", k(), ".\n    DISPLAY 2.\n    DISPLAY 3.\n"), some(k() % 4 == 1, "ITEM-", k(), ".\n    DISPLAY 4.\n"),
    )


_DUPLICATES = f"""dup AS (
  SELECT {_PATH} AS path, 9 AS line, 'duplicate paragraph declaration: ''P-' || s_suppkey || ''' (first declared at s-' || s_suppkey || '.cbl:7)' AS message FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT {_PATH}, CASE WHEN s_suppkey % 3 = 0 THEN 12 ELSE 9 END, 'duplicate paragraph declaration: ''ITEM-' || s_suppkey || ''' (first declared at s-' || s_suppkey || '.cbl:5)' FROM supplier WHERE s_suppkey % 4 = 1)"""


@query(f"WITH {_DUPLICATES} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line)::INT AS seq, 'SEM002' AS code, message, line::INT AS line FROM dup")
def sem002_j06_o04_duplicate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_paragraphs(spark, sf_dir)).diagnostics.select("path", "seq", "code", "message", "line")


@query(f"WITH {_DUPLICATES} SELECT path, path || ':' || line || ':1 [ERROR SEM002] ' || message AS text FROM dup")
def x28_diagnostics_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.as_text(compiled(_paragraphs(spark, sf_dir)).diagnostics).select("path", "text")


@query(f"""SELECT {_PATH} AS path, u.para_ord::INT AS para_ord, u.verb, u.operand FROM supplier, LATERAL (VALUES (1, 'DISPLAY', '1'), (2, 'DISPLAY', '2'), (2, 'DISPLAY', '3'),
  (CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END, 'DISPLAY', '4')) u(para_ord, verb, operand)
WHERE u.operand = '1' OR (s_suppkey % 3 = 0 AND u.operand IN ('2', '3')) OR (s_suppkey % 4 = 1 AND u.operand = '4')""")
def w04_g13_g15_statements_of_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_paragraphs(spark, sf_dir), keep=False).statements.select("path", "para_ord", "verb", F.col("operands")[0].alias("operand"))


@query(f"""SELECT {_PATH} AS path, u.kind, u.name, u.ord::INT AS ord FROM supplier, LATERAL (VALUES ('program', 'S-' || s_suppkey, 0), ('variable', 'ITEM-' || s_suppkey, 1), ('paragraph', 'P-' || s_suppkey, 1)) u(kind, name, ord)""")
def f11_o05_w05_symbols_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = compiled(_paragraphs(spark, sf_dir)).symbols
    kinds = [semantics.symbols_of_kind(symbols, k).select("path", "kind", "name", "ord") for k in ("program", "variable", "paragraph")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(f"SELECT {_PATH} AS path, 'ITEM-' || s_suppkey AS name, 'alphanumeric' AS category, (s_suppkey % 7 + 1)::INT AS length FROM supplier")
def j07_types_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = compiled(_paragraphs(spark, sf_dir)).symbols
    size = F.regexp_extract("name", r"([0-9]+)$", 1).cast("long") % 7 + 1
    put = semantics.with_type(symbols, F.when(F.col("kind") == "variable", cobol.picture_type(joined("X(", size, ")"))))
    return put.where("ctype IS NOT NULL").select("path", "name", "ctype.category", "ctype.length")


@query(f"""SELECT {_PATH} AS path, 'SEM012' AS code, CASE s_suppkey % 3 WHEN 0 THEN 'MOVE target ''E-' WHEN 1 THEN 'MOVE source ''E-' ELSE 'DISPLAY operand ''E-' END || s_suppkey || '''' AS said FROM supplier
UNION ALL SELECT {_PATH}, 'SEM003', 'identifier ''P-' || s_suppkey || ''' refers to a paragraph but a variable was expected' FROM supplier WHERE s_suppkey % 2 = 0""")
def sem012_j02_j04_untyped_and_wrong_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = programs(
        spark, sf_dir, *named("DATA DIVISION.\nWORKING-STORAGE SECTION.\n01 E-", k(), " PIC ZZ9.\n01 N-", k(), " PIC 9.\nPROCEDURE DIVISION.\nP-", k(), ".\n"),
        some(k() % 3 == 0, "    MOVE 1 TO E-", k(), ".\n"), some(k() % 3 == 1, "    MOVE E-", k(), " TO N-", k(), ".\n"), some(k() % 3 == 2, "    DISPLAY E-", k(), ".\n"), some(k() % 2 == 0, "    DISPLAY P-", k(), ".\n"),
    )
    return compiled(source).diagnostics.select("path", "code", F.split("message", " has no resolved")[0].alias("said"))


@query("""SELECT * FROM (SELECT 'cust-' || o_custkey || '.cbl' AS path, sum(CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 > 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 8 IN (0, 1, 7) THEN 1 ELSE 0 END
  + CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 8 = 7 THEN 1 ELSE 0 END)::BIGINT AS error_count, true AS has_errors FROM orders GROUP BY o_custkey) WHERE error_count > 0""")
def a03_r05_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.error_counts(compiled_orders(spark, sf_dir, keep=["findings"]).diagnostics)


# --- extended mode, and what the classic front end makes of it ---


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs(
        spark, sf_dir, *named("AUTHOR. A-", k(), " AND OTHERS.\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n01 T-", k(), " PIC X.\nPROCEDURE DIVISION.\nP-", k(), ".\n    DISPLAY 1.\n    ACCEPT T-", k(), ".\n"),
        some(k() % 2 == 0, "    PERFORM P-", k(), ".\n"), some(k() % 2 == 1, "    PERFORM Q-", k(), ".\n"), some(k() % 3 == 0, "    ADD 1 TO T-", k(), ".\n"), some(k() % 5 == 0, "    CALL ' '.\n"), some(k() % 7 == 0, "    GO TO P-", k(), ".\n"),
    )


@query(f"""SELECT {_PATH} AS path, u.verb, u.operands FROM supplier, LATERAL (VALUES ('DISPLAY', '1', true), ('ACCEPT', 'T-' || s_suppkey, true), ('PERFORM', CASE WHEN s_suppkey % 2 = 0 THEN 'P-' ELSE 'Q-' END || s_suppkey, true),
  ('ADD', '1|T-' || s_suppkey, s_suppkey % 3 = 0), ('CALL', ''' ''', s_suppkey % 5 = 0), ('GO TO', 'P-' || s_suppkey, s_suppkey % 7 = 0)) u(verb, operands, there) WHERE u.there""")
def g26_g27_extended_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_extended(spark, sf_dir), "extended", keep=False).statements.select("path", "verb", F.array_join("operands", "|").alias("operands"))


@query(f"""SELECT {_PATH} AS path, u.code FROM supplier, LATERAL (VALUES ('SEM004', s_suppkey % 2 = 1), ('SEM009', s_suppkey % 5 = 0), ('SEM011', s_suppkey % 3 = 0)) u(code, there) WHERE u.there""")
def sem004_sem009_sem011_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_extended(spark, sf_dir), "extended").diagnostics.select("path", "code")


@query(f"""SELECT {_PATH} AS path, 'Program S-' || s_suppkey || E'\\n\\n  Module S-' || s_suppkey || E'\\n\\n    Function __entry__\\n\\n      entry:\\n        DISPLAY 1\\n        ACCEPT T-' || s_suppkey || E'\\n        CALL ' || CASE WHEN s_suppkey % 2 = 0 THEN 'P-' ELSE 'Q-' END || s_suppkey
  || CASE WHEN s_suppkey % 3 = 0 THEN E'\\n        ADD 1 TO T-' || s_suppkey ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN E'\\n        CALL  ' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN E'\\n        JUMP P-' || s_suppkey ELSE '' END AS text FROM supplier""")
def i03_i08_i10_extended_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_extended(spark, sf_dir), "extended").ir_text


@query(f"SELECT {_PATH} AS path, u.clause, u.value FROM supplier, LATERAL (VALUES ('PROGRAM-ID', 'S-' || s_suppkey), ('AUTHOR', 'A-' || s_suppkey || ' AND OTHERS')) u(clause, value)")
def g04_extended_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_extended(spark, sf_dir), "extended", keep=False).clauses.select("path", "clause", "value")


@query(f"""SELECT {_PATH} AS path, u.seq::INT AS seq, u.message, u.sync_point, u.skipped::INT AS tokens_skipped FROM supplier, LATERAL (VALUES (1, 'expected a clause keyword, got ''AUTHOR''', 'PARAGRAPH', 1),
  (2, 'expected a clause keyword, got ''A-' || s_suppkey || '''', 'PARAGRAPH', 3), (3, 'unsupported statement keyword ''ACCEPT''', 'PARAGRAPH', 2)) u(seq, message, sync_point, skipped)""")
def g04_g26_r02_r03_classic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment clauses don't lex as keywords, and ACCEPT has no rule: both are read past, the second to the division's end."""
    return compiled(_extended(spark, sf_dir)).syntax_diagnostics.select("path", "seq", "message", "sync_point", "tokens_skipped")


@query(f"SELECT {_PATH} AS path, 1::BIGINT AS statements FROM supplier")
def g26_w07_accept_ends_the_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_extended(spark, sf_dir), keep=False).statements.groupBy("path").agg(F.count("*").alias("statements"))


# --- divisions ---


@query(f"""SELECT {_PATH} AS path, s_suppkey % 6 NOT IN (0, 4, 5) AS fatal, CASE WHEN s_suppkey % 6 IN (0, 5) THEN 0 WHEN s_suppkey % 6 = 4 THEN 0 ELSE 2 END AS code, s_suppkey % 6 = 0 AS has_procedure FROM supplier""")
def r04_g01_g02_g06_g12_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key: sound, more words in one of three headers, ENVIRONMENT before the procedure division, a division out of order."""
    source = programs(
        spark, sf_dir, F.when(k() % 6 == 1, "IDENTIFICATION DIVISION X.\n").otherwise("IDENTIFICATION DIVISION.\n"), joined("PROGRAM-ID. S-", k(), ".\n"), some(k() % 6 == 4, "ENVIRONMENT DIVISION.\n"),
        F.when(k() % 6 == 5, "PROCEDURE.\n").otherwise(""), "DATA DIVISION.\nWORKING-STORAGE SECTION", F.when(k() % 6 == 2, " X.\n").otherwise(".\n"), "01 A PIC 9.\nPROCEDURE DIVISION", F.when(k() % 6 == 3, " USING A.\n").otherwise(".\n"), "P.\n    DISPLAY A.\n    GOBACK.\n",
    )
    c = compiled(source)
    return c.program.join(c.exit_codes, "path").select("path", "fatal", "code", (F.col("has_procedure") & ~F.col("fatal")).alias("has_procedure"))


@query(f"""SELECT {_PATH} AS path, u.ord::INT AS item_ord, u.kind, u.picture, u.value FROM supplier, LATERAL (VALUES (1, 'group', NULL, NULL), (2, 'elementary', 'S9(' || s_suppkey % 9 + 1 || ')V99', '7'), (3, 'condition', NULL, '''Y'''), (4, 'elementary', 'X(3)', 'SPACES'), (5, 'elementary', '9(2)', NULL)) u(ord, kind, picture, value)""")
def g07_g08_g09_g11_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, pictures in several tokens, conditions, levels; an item of level 50 and one without a name are read past."""
    source = programs(spark, sf_dir, *named("DATA DIVISION.\nWORKING-STORAGE SECTION.\n01 R.\n05 N PIC S9(", (k() % 9 + 1).cast("string"), ")V99 VALUE 7.\n88 OK VALUE 'Y'.\n50 BAD PIC 9.\n77 T PIC X(3) VALUE SPACES.\n05 12 PIC 9.\n49 D PIC 9(2).\n"))
    return compiled(source, keep=False).items.select("path", "item_ord", "kind", "picture", "value")


# --- lexer and layout ---


@query("""SELECT 's-' || s_suppkey AS path, u.type, u.n::BIGINT AS n FROM supplier, LATERAL (VALUES ('identifier', 1), ('unknown', 9), ('lparen', 1), ('rparen', 1), ('comma', 1), ('period', 1 + s_suppkey % 2), ('number', s_suppkey % 2)) u(type, n) WHERE u.n > 0""")
def l02_l03_l05_l07_token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("* a note . 1\nX-"), k().cast("string"), F.lit(" ; : + - * / = < > ( ) , . *> tail 2 .\n*> 3\n"), F.when(k() % 2 == 1, "12.").otherwise(""), F.lit("\n*"))
    found = lexer.tokens(read(spark, sf_dir, "supplier").select(joined("s-", k()).alias("path"), body.alias("text")))
    return found.groupBy("path", "type").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, list_extract(['free', 'fixed', 'free', 'unknown', 'unknown', 'free', 'fixed'], (s_suppkey % 7 + 1)::INT) AS source_format FROM supplier""")
def x09_x10_a07_f07_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directive in either letter case, comments outside and inside literals, five lines that start in area A."""
    forms = ["A.\n>>SOURCE FREE\n", "  >>source   fixed\n*> x\n", "DISPLAY 1. *> note\n", 'DISPLAY "*> x".\n', "A.\n>>SOURCE OTHER\n", "\t*> first\n", "       A.\n" * 5]
    body = F.element_at(F.array(*map(F.lit, forms)), (k() % 7 + 1).cast("int"))
    return srcformat.with_format(read(spark, sf_dir, "supplier").select("s_suppkey", body.alias("text"))).select("s_suppkey", "source_format")


@query("""SELECT s_suppkey, (3 + s_suppkey % 2)::BIGINT AS n, 'a' || chr(13) || chr(10) AS first, CASE WHEN s_suppkey % 2 = 1 THEN 'd' ELSE 'c' || chr(10) END AS last FROM supplier""")
def x13_lines_with_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = srcformat.with_endings(F.concat(F.lit("a\r\nb\rc\n"), F.when(k() % 2 == 1, "d").otherwise("")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.size(cut).cast("long").alias("n"), cut[0].alias("first"), F.element_at(cut, -1).alias("last"))


# --- bytes and files ---


def _bytes(*parts: str | Column) -> Column:
    return F.concat(*(F.unhex(F.lit(p)) if isinstance(p, str) else p.cast("string").cast("binary") for p in parts))


@query("""SELECT s_suppkey, list_extract(['UTF-8', 'UTF-16', 'UTF-16', 'EBCDIC', 'UNKNOWN', 'UNKNOWN', 'ASCII'], (s_suppkey % 7 + 1)::INT) AS encoding FROM supplier""")
def x03_x04_marks_and_ebcdic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-order marks, EBCDIC bytes, none at all, bytes that no test knows, ASCII."""
    name = joined("SUPPLIER NUMBER ", k(), " OF A LIST")
    forms = [_bytes("EFBBBF", name), _bytes("FFFE", name), _bytes("FEFF", name), _bytes("C1C2C3C4C5C6C7C80001", k()), _bytes(""), _bytes("FF", name), _bytes(name)]
    content = F.element_at(F.array(*forms), (k() % 7 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.encoding(content).alias("encoding"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'S ' || s_suppkey END AS strict, CASE WHEN s_suppkey % 3 = 2 THEN chr(65279) ELSE '' END || 'S ' || s_suppkey || CASE WHEN s_suppkey % 3 = 1 THEN chr(65533) ELSE '' END AS replaced FROM supplier""")
def s02_s03_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text, text with a byte that is none, text after a byte-order mark, which only strict reading drops."""
    name = joined("S ", k())
    content = F.when(k() % 3 == 1, _bytes(name, "FF")).when(k() % 3 == 2, _bytes("EFBBBF", name)).otherwise(_bytes(name))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.decoded(content).alias("strict"), text.decoded_replacing(content).alias("replaced"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'COBOL' ELSE list_extract(['JCL', 'BMS', 'Text', 'JCL'], (s_suppkey % 4 + 1)::INT) END AS file_type FROM supplier""")
def x06_x07_sniffed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extension tells, but for texts: job cards and map macros at the start of the content."""
    content = F.element_at(F.array(*map(F.lit, ["//J JOB", "MAP dfhmdi x", "plain //", " \n\t//J"])), (k() % 4 + 1).cast("int")).cast("binary")
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.file_type(F.when(k() % 2 == 0, "a.CBL").otherwise("a.txt"), content).alias("file_type"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each supplier: a/<k>.cbl, b.exe, inner.zip, a folder, c.txt; by key whole, with damaged data in c.txt, or cut."""

    def zipped(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for n in b.column(0).to_pylist():
                with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in (("a/", b""), (f"a/{n}.cbl", f"S {n}".encode()), ("b.exe", b"x"), ("inner.zip", b"y"), ("c.txt", b"text " * 99)):
                        z.writestr(name, content)
                data = out.getvalue()
                if n % 3 == 1:
                    at = data.index(b"c.txt") + 5
                    data = data[:at] + b"\xff" * 6 + data[at + 6 :]
                elif n % 3 == 2:
                    data = data[:-9]
                yield pa.RecordBatch.from_pydict({"path": [f"s-{n}.zip"], "filename": [f"s-{n}.zip"], "content": [data]})

    return read(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(zipped, "path string, filename string, content binary")


@query("""SELECT 's-' || s_suppkey || '.zip!/' || u.path AS path, sha256(u.content) AS sha256 FROM supplier, LATERAL (VALUES ('a/' || s_suppkey || '.cbl', 'S ' || s_suppkey, true), ('b.exe', 'x', true), ('inner.zip', 'y', true), ('c.txt', repeat('text ', 99), s_suppkey % 3 = 0)) u(path, content, there)
WHERE u.there AND s_suppkey % 3 < 2""")
def s06_u06_damaged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members before the damage are there; an archive without its directory has none."""
    return files.expanded(_archives(spark, sf_dir)).select("path", text.sha256(F.col("content")).alias("sha256"))


@query("SELECT 's-' || s_suppkey || '.zip' AS path FROM supplier WHERE s_suppkey % 3 > 0")
def s06_damage_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.damaged(_archives(spark, sf_dir)).select("path")


@query("""SELECT u.path, u.path AS filename FROM supplier, LATERAL (VALUES (s_suppkey || '.cbl', true), ('c.txt', s_suppkey % 3 = 0)) u(path, there) WHERE u.there AND s_suppkey % 3 < 2""")
def s07_f05_o06_expanded_on_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without folders; members that no upload may be, archives among them, are left out."""
    return files.expanded(_archives(spark, sf_dir), keep=UPLOADS, flat=True).select("path", "filename")


@query("""SELECT 'doc-' || doc_id || list_extract(['.cbl', '.COB', '.cpy', '.jcl', '.txt'], (doc_id % 10 + 1)::INT) AS filename, list_extract(['.cbl', '.cob', '.cpy', '.jcl', '.txt'], (doc_id % 10 + 1)::INT) AS extension,
  strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256, false AS collides FROM documents WHERE doc_id % 10 < 5 AND strlen(text) BETWEEN 1 AND 20 * 1024 * 1024""")
def s01_s08_s09_f13_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads that pass, taken in as a workspace and read again; the workspace is replaced each time."""
    given = uploads(spark, sf_dir).select("filename", "content")
    good = given.join(validate.rejected(given).select("filename"), "filename", "left_anti")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quarry-workspaces"
    got = files.ingest(good, files.Workspaces(spark, root), "uploads-" + "".join(c if c.isalnum() else "-" for c in sf_dir))
    return got.select("filename", "extension", "size_bytes", "sha256", "collides")


@query("""SELECT 'doc-' || doc_id || e AS filename, CASE WHEN lower(e) NOT IN ('.cbl', '.cob', '.cpy', '.jcl', '.txt') THEN 'unsupported extension ''' || lower(e) || '''; allowed: .cbl, .cob, .cpy, .jcl, .txt, .zip' ELSE 'file is empty' END AS reason
FROM (SELECT *, list_extract(['.cbl', '.COB', '.cpy', '.jcl', '.txt', '.xml', '.json', '.bms', '.dat', ''], (doc_id % 10 + 1)::INT) AS e FROM documents) WHERE lower(e) NOT IN ('.cbl', '.cob', '.cpy', '.jcl', '.txt') OR text = ''""")
def o03_rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejected(uploads(spark, sf_dir).select("filename", "content"))


# --- scalar functions ---


@query("""SELECT s_suppkey, list_extract(['WS-' || s_suppkey, '"' || s_suppkey || '"', '-' || s_suppkey, 'spaces', ''], (s_suppkey % 5 + 1)::INT) AS operand, s_suppkey % 5 > 0 AS resolved_as_literal, s_suppkey % 5 IN (1, 2, 3) AS checked_as_literal,
  list_extract(['COMP', 'COMP-3', 'DISPLAY', 'COMP-1', 'INDEX'], (s_suppkey % 5 + 1)::INT) AS usage FROM supplier""")
def x15_x16_x21_literals_and_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in v)), (k() % 5 + 1).cast("int"))
    value = pick(joined("WS-", k()), joined('"', k(), '"'), joined("-", k()), "spaces", "")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", value.alias("operand"), pick("comp-4", " Packed-Decimal", "UNHEARD", "COMP-1", "index ").alias("word"))
    return rows.select("s_suppkey", "operand", cobol.is_literal(F.col("operand")).alias("resolved_as_literal"), cobol.is_literal(F.col("operand"), empty=False).alias("checked_as_literal"), cobol.usage(F.col("word")).alias("usage"))


@query("""SELECT s_suppkey, list_extract(['RETURN', 'RETURN ' || s_suppkey, 'ASSIGN A-' || s_suppkey || ' = 1', 'ACCEPT B-' || s_suppkey, '; OTHER'], (s_suppkey % 5 + 1)::INT) AS text FROM supplier""")
def i11_i12_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that no statement gives are printed too."""
    pick = lambda *v: F.element_at(F.array(*v), (k() % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    args = pick(F.array(F.lit("")), F.array(k().cast("string")), F.array(F.lit("1")), F.array().cast("array<string>"), F.array().cast("array<string>"))
    line = ir.instruction_text(pick(*map(F.lit, ("RETURN", "RETURN", "ASSIGN", "ACCEPT", "OTHER"))), pick(none, none, joined("A-", k()), joined("B-", k()), none), args)
    return read(spark, sf_dir, "supplier").select("s_suppkey", line.alias("text"))


# --- instructions and back-end ---


@query("SELECT 'cust-' || o_custkey || '.cbl' AS path, 1::BIGINT AS blocks, count(*)::BIGINT AS instructions FROM orders GROUP BY o_custkey")
def a08_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.sizes(compiled_orders(spark, sf_dir, keep=False).ir)


def _nested(spark: SparkSession, sf_dir: str, depth: int = 12) -> DataFrame:
    node = lambda i, verb, operand: F.struct(F.lit(i).alias("node"), F.lit(i - 1 if i > 1 else None).cast("int").alias("parent"), F.lit("then" if i > 1 else None).cast("string").alias("branch"), F.lit(verb).alias("verb"), F.array(operand).alias("operands"))
    tree = F.array(*(node(i, "IF", F.lit(f"C{i}")) for i in range(1, depth + 1)), node(depth + 1, "DISPLAY", F.col("n_nationkey").cast("string")))
    return read(spark, sf_dir, "nation").select(joined("n-", F.col("n_nationkey")).alias("path"), F.explode(tree).alias("n")).select("path", "n.*")


@query("""WITH d AS (SELECT n_nationkey, i FROM nation, range(0, 13) t(i))
SELECT 'n-' || n_nationkey AS path, i::INT AS block_ord, CASE WHEN i = 0 THEN 'entry' ELSE 'if_then_' || 2 * i - 1 END AS block, 1 AS instr_ord, CASE WHEN i < 12 THEN 'IF C' || i + 1 || ' THEN if_then_' || 2 * i + 1 || ' ELSE if_merge_' || 2 * i + 2 ELSE 'DISPLAY ' || n_nationkey END AS text FROM d
UNION ALL SELECT 'n-' || n_nationkey, 12, 'if_then_23', 2, 'JUMP if_merge_24' FROM nation
UNION ALL SELECT 'n-' || n_nationkey, (25 - i)::INT, 'if_merge_' || 2 * i, 1, 'JUMP if_merge_' || 2 * i - 2 FROM d WHERE i > 1""")
def i09_i10_w06_nested_ifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IFs nested twelve deep."""
    return ir.lower_ifs(_nested(spark, sf_dir))[0].select("path", "block_ord", "block", "instr_ord", "text")


@query("""WITH d AS (SELECT n_nationkey, i FROM nation, range(1, 13) t(i))
SELECT 'n-' || n_nationkey AS path, (i - 1)::INT AS from_block, 'if_then_' || 2 * i - 1 AS target, i::INT AS to_block FROM d
UNION ALL SELECT 'n-' || n_nationkey, (i - 1)::INT, 'if_merge_' || 2 * i, (25 - i)::INT FROM d
UNION ALL SELECT 'n-' || n_nationkey, 12, 'if_merge_24', 13 FROM nation
UNION ALL SELECT 'n-' || n_nationkey, (25 - i)::INT, 'if_merge_' || 2 * i - 2, (26 - i)::INT FROM d WHERE i > 1""")
def j08_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.cfg_edges(*ir.lower_ifs(_nested(spark, sf_dir))).select("path", "from_block", "target", "to_block")


def _nameless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs(spark, sf_dir, "IDENTIFICATION DIVISION.\n", some(k() % 2 == 1, "PROGRAM-ID. S-", k(), ".\n"), "PROCEDURE DIVISION.\nP.\n    DISPLAY ", k().cast("string"), ".\n")


@query(f"""SELECT {_PATH} AS path, 'public class ' || CASE WHEN s_suppkey % 2 = 1 THEN 'S' || s_suppkey ELSE 'GeneratedProgram' END || E' {{\\n\\n    public static void main(String[] args) {{\\n\\n        // IR: DISPLAY ' || s_suppkey || E'\\n\\n    }}\\n\\n}}\\n' AS source FROM supplier""")
def b03_x26_nameless_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_nameless(spark, sf_dir)).java_sources


@query(f"SELECT {_PATH} AS path, 'BE001' AS code, 'warning' AS severity FROM supplier WHERE s_suppkey % 2 = 0")
def b05_nameless_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(_nameless(spark, sf_dir)).java_diagnostics.select("path", "code", "severity")


# --- hooks ---


@query("SELECT 'part-' || p_partkey || '.cbl' AS path, u.kind, u.n::BIGINT AS n FROM part, LATERAL (VALUES ('group', 1), ('condition', 1), ('elementary', 5)) u(kind, n)")
def u01_items_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook for each kind of data item."""
    from .plans import synth

    count = lambda rows: rows.groupBy("path", "kind").agg(F.count("*").alias("n"))
    got = compiled(synth.item_programs(read(spark, sf_dir, "part")), keep=False).visit("items", dict.fromkeys(("group", "condition", "elementary"), count), by="kind")
    return got["group"].unionByName(got["condition"]).unionByName(got["elementary"])


@query("SELECT 'MOVE' AS opcode, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 8 IN (1, 7) UNION ALL SELECT 'CALL', count(*)::BIGINT FROM orders WHERE o_orderkey % 8 = 6")
def u03_instructions_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda rows: rows.groupBy("opcode").agg(F.count("*").alias("n"))
    got = compiled_orders(spark, sf_dir).visit("ir", {"MOVE": count, "CALL": count}, by="opcode")
    return got["MOVE"].unionByName(got["CALL"])


@query(f"SELECT {_PATH} AS path, 'Program N-' || s_suppkey || E'\\n\\n  Module N-' || s_suppkey || E'\\n\\n    Function __entry__\\n\\n      entry:\\n        DISPLAY 0' AS text FROM supplier")
def u04_u05_replaced_names_and_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by another rule, and a lexer that reads each number as 0."""
    lex = lambda sources: lexer.lexed(sources).withColumn("lexeme", F.when(F.col("type") == "number", "0").otherwise(F.col("lexeme")))
    source = _nameless(spark, sf_dir)
    names = lambda _: source.select("path", F.regexp_replace(F.regexp_replace("path", "^s", "N"), ".cbl$", "").alias("program"))
    return compiled(source, lex=lex, names=names).ir_text


@query(f"SELECT {_PATH} AS path, 'n' || s_suppkey AS java_name, 'double' AS java_type FROM supplier")
def x22_x27_b01_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = programs(spark, sf_dir, *named("DATA DIVISION.\nWORKING-STORAGE SECTION.\n01 N", k().cast("string"), " PIC 9(3)V9.\n"))
    return java.fields(compiled(source).symbols).select("path", "java_name", "java_type")
