"""Symbols and the five semantic passes, as windows over (path, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cobol import CTYPE, is_literal, is_numeric_literal, is_reserved, movable, picture_type
from ..functions.text import ascii_upper, quoted

_PLACE = ("line", "col", "offset")


def programs(clauses: DataFrame) -> DataFrame:
    """path, name, place of programs that have a name."""
    return clauses.where("clause = 'PROGRAM-ID' AND value <> ''").select("path", ascii_upper(F.col("value")).alias("name"), *_PLACE)


def declarations(clauses: DataFrame, items: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """All declared names in the order of registration: program, data items, paragraphs."""
    none = lambda t: F.lit(None).cast(t)
    program = programs(clauses).select("path", F.lit(0).alias("family"), F.lit(0).alias("ord"), "name", F.lit("program").alias("kind"), none("int").alias("level"), none("string").alias("picture"), *_PLACE)
    data = items.select("path", F.lit(1).alias("family"), F.col("item_ord").alias("ord"), "name", F.lit("variable").alias("kind"), "level", "picture", *_PLACE)
    labels = paragraphs.select("path", F.lit(2).alias("family"), F.col("para_ord").alias("ord"), "name", F.lit("paragraph").alias("kind"), none("int").alias("level"), none("string").alias("picture"), *_PLACE)
    return program.unionByName(data).unionByName(labels)


def _ranked(declared: DataFrame) -> DataFrame:
    name = Window.partitionBy("path", "name").orderBy("family", "ord")
    return declared.withColumns({"rank": F.row_number().over(name), "first_line": F.first("line").over(name)})


def symbols(declared: DataFrame) -> DataFrame:
    """path, name, kind, level, picture, ctype, place: the first declaration of each name, variables with the type of their picture."""
    ctype = F.when(F.col("kind") == "variable", picture_type(F.col("picture"))).cast(CTYPE)
    return _ranked(declared).where("rank = 1").select("path", "family", "ord", "name", "kind", "level", "picture", ctype.alias("ctype"), *_PLACE)


def symbols_of_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("kind") == kind)


def with_type(symbols: DataFrame, ctype: Column) -> DataFrame:
    """Replaces the symbols' types; their order and the other columns stay."""
    return symbols.withColumn("ctype", ctype.cast(CTYPE))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def findings(rows: DataFrame, mode: str = "reference") -> DataFrame:
    """path, pass, key, code, message, place of what the passes find in `grammar.marked` sentences; pass 0 are sources that have no tree.

    1: SEM001 and SEM002, every declaration of a name but the first, program names apart. 2: SEM003 (SEM004 for labels), names that are
    not declared, or as something else. 3: SEM006 to SEM009, no program name, no paragraph, reserved names; blank CALL targets in
    extended mode. 5: SEM010 and SEM012 (SEM011 in extended mode), moves of text to numbers, operands without a type, arithmetic on what
    is no number.

    Sentences give declarations, references and findings of their own; a window over (path, name) puts the first declaration beside
    each, and a second one over a source the source of a MOVE beside its target. So nothing is read twice, joined or moved.
    """
    facts = rows.select("path", "sent", *_PLACE, "verb", F.explode(_facts(mode)).alias("f")).select("path", "sent", *_PLACE, "verb", "f.*")
    name = Window.partitionBy("path", "name").orderBy("role", "family", "sent", "k")
    facts = facts.withColumns({"rank": F.row_number().over(name), "first": F.first(F.struct("role", "kind", "picture", "line")).over(name)})
    declared = F.col("first.role") == 0
    facts = facts.withColumn("found", F.when((F.col("role") == 1) & declared, F.col("first.kind")))
    facts = facts.withColumn("ctype", F.when(F.col("found") == "variable", picture_type(F.col("first.picture"))).cast(CTYPE))
    again = (F.col("role") == 0) & (F.col("rank") > 1) & (F.col("family") > 0)
    facts = facts.where(again | (F.col("role") > 0))
    before = Window.partitionBy("path").orderBy("sent", "role", "k")
    facts = facts.withColumn("prev", F.lag(F.struct("text", "found", "ctype")).over(before))
    return facts.withColumn("x", _finding(again, mode)).where("x IS NOT NULL").select("path", "x.*", *_PLACE)


def _facts(mode: str) -> Column:
    """What a sentence declares (role 0), refers to (1) and shows by itself (2)."""
    fields = {"role": "int", "family": "int", "k": "int", "name": "string", "kind": "string", "picture": "string", "text": "string", "code": "string", "key": "array<int>"}
    fact = lambda **v: F.struct(*((F.lit(x) if not isinstance(x := v.get(f), Column) else x).cast(t).alias(f) for f, t in fields.items()))
    shows = lambda number, code, a, b, text: fact(role=2, family=number, code=code, key=F.array(F.lit(a).cast("int"), b.cast("int")), text=text)
    tree, sent, item = ~F.col("wrong") & ~F.col("fatal"), F.col("sent"), F.col("item")
    zero = F.lit(0)
    facts = [
        F.when(F.col("wrong") | (F.col("fatal") & (sent == 0)), shows(0, None, 0, zero, F.lit(None))),
        F.when(F.col("program").isNotNull(), fact(role=0, family=0, k=0, name=F.col("program"), kind="program")),
        F.when(item.isNotNull(), fact(role=0, family=1, k=0, name=item["name"], kind="variable", picture=item["picture"])),
        F.when(F.col("label").isNotNull(), fact(role=0, family=2, k=0, name=F.col("label"), kind="paragraph")),
        F.when(tree & (F.col("opens") == "identification") & ~F.col("named"), shows(3, "SEM006", 0, zero, F.lit("PROGRAM-ID is missing or blank"))),
        F.when(tree & (F.col("opens") == "procedure") & ~F.col("labelled"), shows(3, "SEM007", 2, zero, F.lit("PROCEDURE DIVISION is empty — no paragraphs declared"))),
        F.when(item.isNotNull() & is_reserved(item["name"]), shows(3, "SEM008", 1, sent, _text("data-item name ", quoted(item["name"]), " is a COBOL reserved word"))),
    ]
    verbs, labels = ["MOVE", "DISPLAY"], []
    if mode == "extended":
        verbs, labels = verbs + ["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "ACCEPT"], ["PERFORM", "GO TO"]
        target = F.get("operands", F.lit(0))
        blank = (F.col("verb") == "CALL") & (F.trim(F.regexp_replace(target, "^[\"']|[\"']$", "")) == "")
        facts.append(F.when(blank, shows(3, "SEM009", 3, sent, _text("static CALL target ", quoted(target), " is blank or invalid"))))
    refers = F.when(F.col("verb").isin(verbs + labels), F.col("operands")).otherwise(F.array().cast("array<string>"))
    expected = F.when(F.col("verb").isin(labels), "paragraph").otherwise("variable")
    refs = F.transform(refers, lambda t, i: fact(role=1, family=0, k=i, name=ascii_upper(F.trim(t)), kind=expected, text=F.trim(t)))
    return F.array_compact(F.concat(F.array(*facts), refs))


def _finding(again: Column, mode: str) -> Column:
    """What a fact beside its first declaration and the fact before it comes to; a reference that is not resolved has no type to be wrong."""
    row = lambda number, code, message, *key: F.struct(F.lit(number).alias("pass"), F.array(*(k.cast("int") for k in key)).alias("key"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"))
    sent, k, verb, s, found, ctype, prev = (F.col(c) for c in ("sent", "k", "verb", "text", "found", "ctype", "prev"))
    of = lambda v: (F.col("role") == 1) & (verb == v)
    label = F.col("kind") == "paragraph"
    named = (F.col("role") == 1) & (label | ~is_literal(s))
    code = F.when(label, "SEM004").otherwise("SEM003")
    says = " has no resolved semantic type; TypeBuilder may not have processed it."
    # of a MOVE: the row of the target, and before it that of the source
    target = of("MOVE") & (k == 1) & (found == "variable")
    source = ~is_literal(prev["text"], empty=False) & F.coalesce(prev["found"] == "variable", F.lit(False))
    cases = [
        (again, row(1, F.when(F.col("kind") == "variable", "SEM001").otherwise("SEM002"), _text("duplicate ", F.col("kind"), " declaration: ", quoted(F.col("name")), " (first declared at ", F.col("path"), ":", F.col("first.line").cast("string"), ")"), F.col("family"), sent)),
        (F.col("role") == 2, F.struct(F.col("family").alias("pass"), "key", "code", F.col("text").alias("message"))),
        (named & found.isNull(), row(2, code, _text("undefined ", F.col("kind"), ": ", quoted(s)), sent, k)),
        (named & (found != F.col("kind")), row(2, code, _text("identifier ", quoted(s), " refers to a ", found, " but a ", F.col("kind"), " was expected"), sent, k)),
        (target & ctype.isNull(), row(5, "SEM012", _text("MOVE target ", quoted(s), says), sent, F.lit(0))),
        (target & source & prev["ctype"].isNull(), row(5, "SEM012", _text("MOVE source ", quoted(prev["text"]), says), sent, F.lit(0))),
        (target & source & ~movable(prev["ctype"]["category"], ctype["category"]), row(5, "SEM010", _text("incompatible MOVE: cannot move ", quoted(prev["ctype"]["category"]), " value (", quoted(prev["text"]), ") to numeric target ", quoted(s), "."), sent, F.lit(0))),
        (of("DISPLAY") & ~is_literal(s, empty=False) & (found == "variable") & ctype.isNull(), row(5, "SEM012", _text("DISPLAY operand ", quoted(s), says), sent, F.lit(0))),
    ]
    if mode == "extended":
        sum_ = (F.col("role") == 1) & verb.isin("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE") & ~is_numeric_literal(s) & (found == "variable") & (ctype["category"] != "numeric")
        cases.append((sum_, row(5, "SEM011", _text("arithmetic operand ", quoted(F.col("name")), " is not numeric"), sent, k)))
    return F.coalesce(*(F.when(c, x) for c, x in cases))


def diagnostics(found: DataFrame) -> DataFrame:
    """path, pass, seq, code, severity, message, place: all passes' findings in their order."""
    seq = F.row_number().over(Window.partitionBy("path").orderBy("pass", "key"))
    return found.where(F.col("pass") > 0).select("path", "pass", seq.alias("seq"), "code", F.lit("error").alias("severity"), "message", *_PLACE)


def as_text(diagnostics: DataFrame, file: str = "path") -> DataFrame:
    """path, seq, text: `file:line:col [ERROR code] message`, or `file:line:col: message` where there is no code."""
    where = F.concat_ws(":", F.col(file), F.col("line"), F.col("col"))
    text = _text(where, " [", F.upper("severity"), " ", F.col("code"), "] ", F.col("message")) if "code" in diagnostics.columns else _text(where, ": ", F.col("message"))
    return diagnostics.select("path", "seq", text.alias("text"))


def error_counts(diagnostics: DataFrame) -> DataFrame:
    """path, error_count, has_errors of sources with a diagnostic."""
    severe = F.col("severity") == "error" if "severity" in diagnostics.columns else F.lit(True)
    return diagnostics.groupBy("path").agg(F.count_if(severe).alias("error_count"), F.bool_or(severe).alias("has_errors"))
