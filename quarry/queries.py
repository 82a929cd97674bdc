"""The engine's queries over the driver's tables, and the SQL that each is held against.

The tables hold no COBOL, so programs are made from their rows; the SQL tells what must be found from the rows alone, without parsing.
Names start with the operators' ids in the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cobol, text
from .operators import ir, lexer, srcformat, summary, validate
from .plans import synth
from .plans.compile import Compilation
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_EXTENSIONS = [".cbl", ".COB", ".cpy", ".jcl", ".txt", ".xml", ".json", ".bms", ".dat", ""]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files with names in ten extensions."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), ext)
    return read(spark, sf_dir, "documents").select("doc_id", name.alias("path"), name.alias("filename"), F.col("text").cast("binary").alias("content"))


_NAMED = """named AS (SELECT doc_id, text, list_extract(['.cbl','.cob','.cpy','.jcl','.txt','.xml','.json','.bms','.dat',''], (doc_id % 10 + 1)::INT) AS extension,
  list_extract(['COBOL','COBOL','Copybook','JCL','Text','XML','JSON','BMS','Unknown','Unknown'], (doc_id % 10 + 1)::INT) AS by_name FROM documents),
typed AS (SELECT *, CASE WHEN doc_id % 10 IN (4, 8, 9) AND ltrim(text) LIKE '//%' THEN 'JCL' WHEN doc_id % 10 IN (4, 8, 9) AND regexp_matches(upper(text), 'DFHM(SD|DI|DF)') THEN 'BMS' ELSE by_name END AS file_type FROM named)"""


@query(f"WITH {_NAMED} SELECT doc_id, extension, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256, file_type FROM typed")
def x05_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X01, X02, X05, X06, X07: extension, hash, size and type of each file."""
    rows = uploads(spark, sf_dir)
    return rows.select("doc_id", text.extension(F.col("filename")).alias("extension"), F.octet_length("content").cast("long").alias("size_bytes"), text.sha256(F.col("content")).alias("sha256"), text.file_type(F.col("filename"), F.col("content")).alias("file_type"))


@query("""WITH b AS (SELECT doc_id, text, regexp_extract_all(substr(hex(encode(text)), 1, 8192), '..') AS b FROM documents),
n AS (SELECT doc_id, text, len(b) AS n, len(list_filter(b, lambda x: x >= '20' AND x <= '7E')) AS shown, len(list_filter(b, lambda x: x > '7E' OR (x < '20' AND x NOT IN ('09', '0A', '0D')))) AS odd FROM b)
SELECT doc_id, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n >= 8 AND shown::DOUBLE / n < 0.5 AND odd::DOUBLE / n > 0.1 THEN 'EBCDIC' WHEN strlen(text) = length(text) THEN 'ASCII' ELSE 'UTF-8' END AS encoding FROM n""")
def x03_x04_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", text.encoding(F.col("content")).alias("encoding"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.[^.]+$') THEN lower(regexp_extract(url, '(\\.[^.]+)$', 1)) ELSE '' END AS extension FROM pages")
def x01_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.extension(F.col("url")).alias("extension"))


@query(f"WITH {_NAMED} SELECT doc_id FROM typed WHERE extension IN ('.cbl', '.cob', '.cpy', '.jcl', '.txt', '.zip') AND strlen(text) BETWEEN 1 AND 20 * 1024 * 1024")
def f01_f02_f03_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.small_enough(validate.not_empty(validate.allowed(uploads(spark, sf_dir)))).select("doc_id")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part) WHERE n > 1")
def f04_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_names(read(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "p_name")


@query(f"WITH {_NAMED} SELECT file_type, count(*)::BIGINT AS count, sum(strlen(text))::BIGINT AS size_bytes FROM typed GROUP BY file_type")
def a01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_type(files.described(uploads(spark, sf_dir), "w")).select("file_type", "count", "size_bytes")


@query("SELECT count(*)::BIGINT AS total_files, sum(strlen(text))::BIGINT AS total_size_bytes FROM documents")
def a02_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(files.described(uploads(spark, sf_dir), "w"))


@query("SELECT 'doc-' || doc_id || '.zip!/a/' || doc_id || '.cbl' AS path, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'doc-' || doc_id || '.zip!/b.jcl', sha256(lang) FROM documents")
def s06_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of two members each, opened again."""

    def zipped(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for i, t, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
                    z.writestr("a/", b"")
                    z.writestr(f"a/{i}.cbl", t.encode())
                    z.writestr("b.jcl", g.encode())
                yield pa.RecordBatch.from_pydict({"path": [f"doc-{i}.zip"], "filename": [f"doc-{i}.zip"], "content": [out.getvalue()]})

    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").mapInArrow(zipped, "path string, filename string, content binary")
    return files.expanded(rows).select("path", text.sha256(F.col("content")).alias("sha256"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END::BIGINT AS lines FROM documents")
def x08_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(srcformat.lines(F.col("text"))).cast("long").alias("lines"))


@query("SELECT 'order-' || l_orderkey || '.cbl' AS path, CASE WHEN count(*) >= 5 THEN 'fixed' ELSE 'unknown' END AS source_format, CASE WHEN count(*) >= 5 THEN 1.0::DOUBLE END AS evidence FROM lineitem GROUP BY l_orderkey")
def x11_a04_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcformat.with_format(synth.fixed_sources(read(spark, sf_dir, "lineitem"))).select("path", "source_format", "evidence")


@query("""SELECT 'order-' || l_orderkey || '.cbl' AS path, string_agg(' ' || rpad('    MOVE ' || trunc(l_quantity)::BIGINT || ' TO Q-' || l_partkey || '.', 65, ' ') || chr(10), '' ORDER BY l_linenumber, l_partkey, trunc(l_quantity)::BIGINT::VARCHAR) AS text FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5""")
def x12_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcformat.normalise(synth.fixed_sources(read(spark, sf_dir, "lineitem"))).where("text IS NOT NULL").select("path", "text")


@query("""SELECT 'cust-' || o_custkey || '.cbl' AS path, (32 + sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 16 ELSE 8 END + CASE o_orderkey % 8 WHEN 0 THEN 3 WHEN 6 THEN 6 ELSE 5 END))::BIGINT AS total,
  (13 + sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END + 1))::BIGINT AS keywords,
  sum(CASE WHEN o_orderkey % 8 = 6 THEN 1 ELSE 0 END)::BIGINT AS strings FROM orders GROUP BY o_custkey""")
def l01_l09_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexer.token_counts(lexer.tokens(synth.order_programs(read(spark, sf_dir, "orders")))).select("path", "total", "keywords", "strings")


@query("""SELECT 's-' || s_suppkey AS path, u.i::BIGINT AS tok_idx, u.lexeme AS lexeme, (1 + s_suppkey % 3)::INT AS line, (1 + s_suppkey % 5 + u.gap)::INT AS col, (s_suppkey % 3 + s_suppkey % 5 + u.gap)::INT AS offset
FROM supplier, LATERAL (VALUES (0, 'DISPLAY', 0), (1, 'S-' || s_suppkey, 8), (2, '.', 10 + length(s_suppkey::VARCHAR))) u(i, lexeme, gap)""".replace(" AS offset", ' AS "offset"'))
def w01_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.concat(F.expr("repeat('\n', cast(s_suppkey % 3 as int))"), F.expr("repeat(' ', cast(s_suppkey % 5 as int))"), F.lit("display s-"), k.cast("string"), F.lit(". *> a note"))
    rows = lexer.tokens(read(spark, sf_dir, "supplier").select(synth.text("s-", k).alias("path"), body.alias("text")))
    return rows.select("path", F.col("tok_idx").cast("long").alias("tok_idx"), "lexeme", "line", "col", "offset")


@query("""SELECT 'n-' || n_nationkey AS path, 1 AS line, (9 + length(n_nationkey::VARCHAR))::INT AS col, CASE n_nationkey % 3 WHEN 1 THEN 'unexpected character ''@''' ELSE 'unterminated string literal' END AS message
FROM nation WHERE n_nationkey % 3 > 0""")
def l04_l08_lex_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.concat(F.lit("DISPLAY "), k.cast("string"), F.when(k % 3 == 0, ".").when(k % 3 == 1, "@.").otherwise('"open.\n'))
    return lexer.lex_errors(read(spark, sf_dir, "nation").select(synth.text("n-", k).alias("path"), body.alias("text"))).select("path", "line", "col", "message")


_PATH = "'cust-' || o_custkey || '.cbl'"
_N = "trunc(o_totalprice)::BIGINT"
_VERBS = {
    "g17_display": (0, "DISPLAY", "'O-' || o_orderkey"), "g18_move": (1, "MOVE", f"{_N} || '|O-' || o_orderkey"), "g21_add": (2, "ADD", f"{_N} || '|O-' || o_orderkey"),
    "g22_subtract": (3, "SUBTRACT", f"{_N} || '|O-' || o_orderkey"), "g23_multiply": (4, "MULTIPLY", f"{_N} || '|O-' || o_orderkey"), "g24_divide": (5, "DIVIDE", f"{_N} || '|O-' || o_orderkey"),
    "g25_call": (6, "CALL", f"'\"SUB-' || o_orderstatus || '\"|O-' || o_orderkey || '|' || {_N}"),
}


_held: list[Compilation] = []


def compiled(sources: DataFrame, mode: str = "reference", **how) -> Compilation:
    """A compilation that keeps its sentences until the next one of a query is made, so that many queries don't fill a session's storage."""
    while _held:
        _held.pop().close()
    _held.append(Compilation(sources, mode, **how))
    return _held[0]


def compiled_orders(spark: SparkSession, sf_dir: str, **how) -> Compilation:
    return compiled(synth.order_programs(read(spark, sf_dir, "orders")), **how)


def _verb(name: str, rest: int, verb: str, operands: str) -> None:
    also = f" UNION ALL SELECT {_PATH}, 'NAME-' || o_custkey || '|O-' || o_orderkey FROM orders WHERE o_orderkey % 8 = 7" if verb == "MOVE" else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiled_orders(spark, sf_dir, keep=False).statements.where(F.col("verb") == verb).select("path", F.array_join("operands", "|").alias("operands"))

    query(f"SELECT {_PATH} AS path, {operands} AS operands FROM orders WHERE o_orderkey % 8 = {rest}{also}", name)(run)


for _name, _args in _VERBS.items():
    _verb(_name, *_args)


@query(f"SELECT DISTINCT {_PATH} AS path, 'STOP RUN' AS verb, 1 AS para_ord FROM orders")
def g19_stop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir, keep=False).statements.where("verb = 'STOP RUN'").select("path", "verb", "para_ord")


@query(f"SELECT DISTINCT {_PATH} AS path, 'PROGRAM-ID' AS clause, 'CUST-' || o_custkey AS value, 'MAIN-PARA' AS paragraph FROM orders")
def g03_g14_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compiled_orders(spark, sf_dir)
    return c.clauses.select("path", "clause", "value").join(c.paragraphs.select("path", F.col("name").alias("paragraph")), "path")


@query(f"""SELECT {_PATH} AS path, 1 AS level, 'O-' || o_orderkey AS name, 'elementary' AS kind, '9(7)' AS picture, NULL AS value FROM orders, range(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END)
UNION ALL SELECT DISTINCT {_PATH}, 1, 'NAME-' || o_custkey, 'elementary', 'X(20)', 'SPACES' FROM orders""")
def g10_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir, keep=False).items.select("path", "level", "name", "kind", "picture", "value")


@query("""SELECT 'part-' || p_partkey || '.cbl' AS path, u.* FROM part, LATERAL (VALUES
  ('PART-REC', 1, 'group', NULL::INT, NULL::BOOLEAN, NULL::INT, NULL::INT), ('PART-NAME', 5, 'alphanumeric', NULL, NULL, NULL, p_size),
  ('PART-PRICE', 5, 'numeric', (p_partkey % 9 + 3)::INT, true, 2, NULL), ('PART-CODE', 5, 'numeric', (p_partkey % 9 + 1)::INT, false, 0, NULL),
  ('PART-EDIT', 5, NULL, NULL, NULL, NULL, NULL), ('IS-BIG', 88, 'group', NULL, NULL, NULL, NULL), ('PART-SPARE', 77, 'alphanumeric', NULL, NULL, NULL, 2)) u(name, level, category, digits, signed, decimal_places, length)""")
def x19_x20_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compiled(synth.item_programs(read(spark, sf_dir, "part")), keep=False)
    return c.symbols.where("kind = 'variable'").select("path", "name", "level", *(F.col(f"ctype.{f}").alias(f) for f in ("category", "digits", "signed", "decimal_places", "length")))


@query(f"""SELECT {_PATH} AS path, 'SEM001' AS code, 'O-' || o_orderkey AS name FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 > 0
UNION ALL SELECT {_PATH}, 'SEM003', 'O-' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 8 IN (0, 1, 7)
UNION ALL SELECT {_PATH}, 'SEM010', 'O-' || o_orderkey FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 8 = 7""")
def j01_j03_sem001_sem003_sem010(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compiled_orders(spark, sf_dir)
    return c.diagnostics.select("path", "code", F.regexp_extract("message", r".*'([^']+)'", 1).alias("name"))


@query("""SELECT 'supp-' || s_suppkey || '.cbl' AS path, u.code FROM supplier, LATERAL (VALUES (3, 'SEM007'), (4, 'SEM006'), (4, 'SEM008')) u(kind, code) WHERE s_suppkey % 5 = u.kind""")
def sem006_sem007_sem008(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(synth.broken_programs(read(spark, sf_dir, "supplier"))).diagnostics.select("path", "code")


@query("""SELECT 'supp-' || s_suppkey || '.cbl' AS path, CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 0 ELSE 3 END::BIGINT AS statements FROM supplier""")
def w07_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compiled(synth.broken_programs(read(spark, sf_dir, "supplier")))
    n = c.statements.groupBy("path").agg(F.count("*").alias("statements"))
    return c.program.select("path").join(n, "path", "left").select("path", F.coalesce("statements", F.lit(0)).alias("statements"))


@query("""SELECT 'supp-' || s_suppkey || '.cbl' AS path, u.message, u.sync_point, u.skipped::INT AS tokens_skipped FROM supplier, LATERAL (VALUES
  (0, 'expected ''.'' after paragraph label ''COMPUTE'', got ''X''', 'PERIOD', 4), (1, 'expected source operand after MOVE', 'PARAGRAPH', 2), (2, 'expected operand after ADD', 'PERIOD', 3)) u(kind, message, sync_point, skipped) WHERE s_suppkey % 5 = u.kind""")
def r01_synchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(synth.broken_programs(read(spark, sf_dir, "supplier"))).syntax_diagnostics.select("path", "message", "sync_point", "tokens_skipped")


@query("SELECT list_extract(['DISPLAY', 'MOVE', 'ADD', 'SUBTRACT', 'MULTIPLY', 'DIVIDE', 'CALL', 'MOVE'], (o_orderkey % 8 + 1)::INT) AS opcode, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def i01_i08_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir, keep=False).ir.groupBy("opcode").agg(F.count("*").alias("n"))


_LINES = f"""CASE o_orderkey % 8 WHEN 0 THEN 'DISPLAY O-' || o_orderkey WHEN 1 THEN 'MOVE ' || {_N} || ' -> O-' || o_orderkey WHEN 2 THEN 'ADD ' || {_N} || ' TO O-' || o_orderkey
  WHEN 3 THEN 'SUBTRACT ' || {_N} || ' FROM O-' || o_orderkey WHEN 4 THEN 'MULTIPLY ' || {_N} || ' BY O-' || o_orderkey WHEN 5 THEN 'DIVIDE ' || {_N} || ' INTO O-' || o_orderkey
  WHEN 6 THEN 'CALL SUB-' || o_orderstatus || ' USING O-' || o_orderkey || ' ' || {_N} ELSE 'MOVE NAME-' || o_custkey || ' -> O-' || o_orderkey END"""


@query(f"""SELECT {_PATH} AS path, 'Program CUST-' || o_custkey || E'\\n\\n  Module CUST-' || o_custkey || E'\\n\\n    Function __entry__\\n\\n      entry:\\n' || string_agg('        ' || {_LINES}, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""")
def a06_x29_ir_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir).ir_text


@query(f"""WITH items AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 > 0),
f AS (SELECT o_custkey, string_agg('    private int o' || o_orderkey || ';' || chr(10), '' ORDER BY o_orderkey) AS f FROM items GROUP BY o_custkey),
s AS (SELECT o_custkey, string_agg('        // IR: ' || {_LINES} || chr(10), '' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT 'cust-' || s.o_custkey || '.cbl' AS path, 'public class Cust' || s.o_custkey || E' {{\\n\\n    private String name' || s.o_custkey || E';\\n' || coalesce(f, '') || E'\\n    public static void main(String[] args) {{\\n\\n' || s || E'\\n    }}\\n\\n}}\\n' AS source FROM s LEFT JOIN f USING (o_custkey)""")
def b04_java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir).java_sources


@query("""SELECT 'part-' || p_partkey || '.cbl' AS path, u.* FROM part, LATERAL (VALUES ('partRec', 'String', 'PART-REC'), ('partName', 'String', 'PART-NAME'), ('partPrice', 'double', 'PART-PRICE'), ('partCode', 'int', 'PART-CODE'), ('isBig', 'String', 'IS-BIG'), ('partSpare', 'String', 'PART-SPARE')) u(java_name, java_type, cobol_name)""")
def b01_x23_java_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(synth.item_programs(read(spark, sf_dir, "part"))).java_fields.select("path", "java_name", "java_type", "cobol_name")


@query("""SELECT 'part-' || p_partkey || '.cbl' AS path, 'BE003' AS code, 'variable ''PART-EDIT'' has no resolved COBOL type; skipping field generation.' AS message FROM part""")
def b01_java_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(synth.item_programs(read(spark, sf_dir, "part"))).java_diagnostics.select("path", "code", "message")


_CAP = "upper(x[1]) || lower(x[2:])"


@query(f"""WITH n AS (SELECT n_nationkey, 'WS-' || replace(n_name, ' ', '_') || '-' || n_nationkey AS name FROM nation),
p AS (SELECT *, list_filter(regexp_split_to_array(name, '[-_]+'), lambda x: x <> '') AS p FROM n)
SELECT n_nationkey, lower(p[1]) || array_to_string([{_CAP} FOR x IN p[2:]], '') AS field_name, array_to_string([{_CAP} FOR x IN p], '') AS class_name FROM p""")
def x24_x25_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("WS-"), F.replace(F.col("n_name"), F.lit(" "), F.lit("_")), F.lit("-"), F.col("n_nationkey").cast("string"))
    return read(spark, sf_dir, "nation").select("n_nationkey", cobol.java_field_name(name).alias("field_name"), cobol.java_class_name(name).alias("class_name"))


@query("""SELECT n_nationkey, u.block_ord::INT AS block_ord, u.block, u.text FROM nation, LATERAL (VALUES
  (0, 'entry', 'IF X > ' || n_nationkey || ' THEN if_then_1 ELSE ' || CASE WHEN n_nationkey % 2 = 0 THEN 'if_else_3' ELSE 'if_merge_2' END),
  (1, 'if_then_1', 'DISPLAY A'), (1, 'if_then_1', 'JUMP if_merge_2'), (2, 'if_else_3', 'DISPLAY B'), (2, 'if_else_3', 'JUMP if_merge_2')) u(block_ord, block, text)
WHERE u.block_ord < 2 OR n_nationkey % 2 = 0""")
def i09_i10_if_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    node = lambda i, parent, branch, verb, operand: F.struct(F.lit(i).alias("node"), F.lit(parent).cast("int").alias("parent"), F.lit(branch).cast("string").alias("branch"), F.lit(verb).alias("verb"), F.array(operand).alias("operands"))
    tree = F.array(node(1, None, None, "IF", F.concat(F.lit("X > "), k.cast("string"))), node(2, 1, "then", "DISPLAY", F.lit("A")), node(3, 1, "else", "DISPLAY", F.lit("B")))
    nodes = read(spark, sf_dir, "nation").select(k.cast("string").alias("path"), F.explode(F.when(k % 2 == 0, tree).otherwise(F.slice(tree, 1, 2))).alias("n")).select("path", "n.*")
    rows, _ = ir.lower_ifs(nodes)
    return rows.select(F.col("path").cast("int").alias("n_nationkey"), "block_ord", "block", "text")


@query(f"SELECT {_PATH} AS path, CASE WHEN bool_or((o_orderkey % 11 = 0 AND o_orderkey % 7 > 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 8 IN (0, 1, 7)) OR (o_orderkey % 7 > 0 AND o_orderkey % 8 = 7)) THEN 2 ELSE 0 END AS code FROM orders GROUP BY o_custkey")
def s10_a03_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_orders(spark, sf_dir, keep=["findings"]).exit_codes


@query("SELECT list_extract(['DISPLAY', 'MOVE', 'ADD', 'SUBTRACT', 'MULTIPLY', 'DIVIDE', 'CALL', 'MOVE'], (o_orderkey % 8 + 1)::INT) AS verb, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def u02_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor that counts statements by verb, one hook for each."""
    import functools

    verbs = ["DISPLAY", "MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "CALL"]
    found = compiled_orders(spark, sf_dir).visit("statements", {v: lambda rows: rows.groupBy("verb").agg(F.count("*").alias("n")) for v in verbs})
    return functools.reduce(DataFrame.unionByName, found.values())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs made from orders, lexed, parsed and lowered: instructions by opcode."""
    return i01_i08_opcodes(spark, sf_dir)





from . import conformance  # noqa: E402, F401  its queries join these
