"""The grammar as relations over sentences: each rule reads one sentence, and windows over a source say which rule holds where.

Everything is partitioned by path, as the sentences already are; nothing is moved. `mode="reference"` keeps the classic front end's
behaviour, its early stops included; `mode="extended"` also reads ACCEPT, PERFORM and GO TO statements and the comment clauses, and
goes on after what it can't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.fixed import AFTER_DATA, AFTER_IDENTIFICATION, AFTER_PROCEDURE, CLAUSES, EXTENDED_VERBS, LEVELS, SPLIT, VERBS
from ..functions.text import ascii_upper, quoted


def _whole() -> WindowSpec:
    return Window.partitionBy("path")


def _before() -> WindowSpec:
    return Window.partitionBy("path").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)


def _at(i: int, field: str) -> Column:
    return F.get("toks", F.lit(i))[field]


def _word(kind: Column) -> Column:
    return F.coalesce(kind.isin("keyword", "identifier"), F.lit(False))


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _join(words: Column) -> Column:
    return F.array_join(words, " ")


def read(sentences: DataFrame) -> DataFrame:
    """Sentences with what all rules look at: number of words, first words, and whether a division header starts."""
    rows = sentences.withColumns({"n": F.size("toks"), "k0": _at(0, "type"), "w0": _at(0, "lexeme"), "k1": _at(1, "type"), "w1": _at(1, "lexeme")})
    head = _is((F.col("k0") == "keyword") & (F.col("k1") == "keyword") & (F.col("w1") == "DIVISION"))
    return rows.withColumn("division", F.when(head, F.col("w0")))


def worded(parts: DataFrame) -> DataFrame:
    """`divisions` with the words' texts and the place of the start, which are cheaper to make again than to carry along."""
    return parts.withColumns({"lex": F.transform("toks", lambda t: t["lexeme"]), "start": F.coalesce(F.get("toks", F.lit(0)), F.col("stop"))})


def divisions(sentences: DataFrame, mode: str = "reference") -> DataFrame:
    """Sentences with `part` (identification, data or procedure; null outside) and the sentence that ends each division.

    Divisions come in this order, each at most once, and the first thing that fits none ends the program; ENVIRONMENT hides the rest.
    A header with more words in its sentence is fatal: `fatal` marks the source, which has no tree. In extended mode the data and
    procedure divisions are found wherever they stand.
    """
    r = read(sentences)
    sent, first = F.col("sent"), lambda c: F.min(F.when(c, F.col("sent"))).over(_whole())
    r = r.withColumn("id_at", first((sent == 0) & _is(F.col("division") == "IDENTIFICATION")))
    after = F.coalesce(F.col("id_at"), F.lit(-1))
    stops = _is((F.col("k0") == "keyword") & (F.col("w0").isin(AFTER_IDENTIFICATION) | (F.col("w0") == "DIVISION")))
    r = r.withColumn("id_end", F.when(F.col("id_at").isNull(), F.lit(0)).otherwise(F.coalesce(first((sent > after) & stops), F.lit(1 << 30))))
    at_end = _is(F.col("division") == "DATA")
    r = r.withColumn("data_at", first(at_end & (sent == F.col("id_end") if mode == "reference" else sent >= F.col("id_end"))))

    in_data = sent > F.col("data_at")
    storage = _is((F.col("k0") == "keyword") & (F.col("w0") == "WORKING-STORAGE"))
    number = _is(F.col("k0") == "number")
    ends = _is((F.col("k0") == "keyword") & F.col("w0").isin(AFTER_DATA))
    empty = F.col("n") == 0
    # in the data division a sentence is an item, or skipped, only after WORKING-STORAGE and before anything else
    turn = F.when(_is(in_data) & storage, 1).when(_is(in_data) & ~storage & ~number & ~empty & ~ends, 0)
    r = r.withColumn("listing", F.coalesce(F.last(turn, ignorenulls=True).over(_before()), F.lit(0)) == 1)
    data_stop = ends | (number & ~F.col("listing")) if mode == "reference" else _is(F.col("division") == "PROCEDURE")
    r = r.withColumn("data_end", F.when(F.col("data_at").isNull(), F.col("id_end")).otherwise(F.coalesce(first(_is(in_data) & data_stop), F.lit(1 << 30))))
    r = r.withColumn("last_storage", F.max(F.when(_is(in_data) & storage & (sent < F.col("data_end")), sent)).over(_whole()))
    r = r.withColumn("proc_at", first(_is(F.col("division") == "PROCEDURE") & (sent == F.col("data_end") if mode == "reference" else sent >= F.col("data_end"))))

    headers = (sent == F.col("id_at")) | (sent == F.col("data_at")) | (sent == F.col("proc_at"))
    bad_header = _is(headers) & ((F.col("n") != 2) | ~F.col("ended"))
    bad_section = _is(in_data & (sent < F.col("data_end"))) & storage & ((F.coalesce(F.col("w1"), F.lit("")) != "SECTION") | (F.col("n") != 2) | ~F.col("ended"))
    r = r.withColumn("fatal", F.max(bad_header | bad_section).over(_whole()))
    part = (
        F.when(_is(F.col("id_at").isNotNull() & (sent > F.col("id_at")) & (sent < F.col("id_end"))), "identification")
        .when(_is(in_data & (sent < F.col("data_end"))), "data").when(_is(sent > F.col("proc_at")), "procedure")
    )
    return r.withColumn("part", part)


def program(parts: DataFrame) -> DataFrame:
    """One row for each source: which divisions it has, and whether a fatal error left it without a tree."""
    return parts.groupBy("path").agg(
        F.bool_or(F.col("id_at").isNotNull()).alias("has_identification"), F.bool_or(F.col("data_at").isNotNull()).alias("has_data"),
        F.bool_or(F.col("proc_at").isNotNull()).alias("has_procedure"), F.max("fatal").alias("fatal"),
        F.min(F.when(F.col("sent") == F.col("proc_at"), F.col("start"))).alias("proc_start"), F.min(F.when(F.col("sent") == F.col("id_at"), F.col("start"))).alias("id_start"),
    )


def _with_clause(parts: DataFrame, mode: str) -> DataFrame:
    """Adds `clause`, the kind of clause that a sentence starts and the next one completes, null elsewhere, and that one's words."""
    by_file = Window.partitionBy("path").orderBy("sent")
    rows = parts.withColumns({"next_lex": F.lead("lex").over(by_file), "next_kind": F.lead("toks").over(by_file)[0]["type"], "next_ended": F.lead("ended").over(by_file)})
    named = (F.col("w0") == "PROGRAM-ID") & (F.col("n") == 1) & F.col("ended") & (F.size("next_lex") == 1) & _word(F.col("next_kind")) & F.col("next_ended")
    comment = (F.lit(mode) == "extended") & F.col("w0").isin(CLAUSES) & (F.col("n") == 1) & F.col("next_ended")
    return rows.withColumn("clause", F.when(_is(F.col("part") == "identification") & ~F.col("fatal") & _is(named | comment), F.col("w0")))


def clauses(parts: DataFrame, mode: str = "reference") -> DataFrame:
    """path, clause, value, line, col, offset. PROGRAM-ID and, in extended mode, the comment clauses; the last of a kind counts."""
    rows = _with_clause(parts, mode).where("clause IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("path", "clause").orderBy(F.desc("sent")))).where("rank = 1")
    return rows.select("path", "clause", _join(F.col("next_lex")).alias("value"), "start.line", "start.col", "start.offset")


def program_names(parts: DataFrame, mode: str = "reference") -> DataFrame:
    """path, program: every source with a tree, the name empty where there is none. One aggregate by path, so a join with it that uses no name goes away."""
    name = F.when(F.col("clause") == "PROGRAM-ID", F.struct("sent", ascii_upper(_join(F.col("next_lex"))).alias("name")))
    return _with_clause(parts, mode).where("NOT fatal").groupBy("path").agg(F.coalesce(F.max(name)["name"], F.lit("")).alias("program"))


def _picture(words: Column) -> Column:
    """How many words a picture takes: up to VALUE, or a number outside brackets that isn't the first."""
    step = lambda a, w: F.when(
        a["done"] | ((w["type"] == "keyword") & (w["lexeme"] == "VALUE")) | ((w["type"] == "number") & (a["depth"] == 0) & (a["n"] > 0)),
        F.struct(a["n"].alias("n"), a["depth"].alias("depth"), F.lit(True).alias("done")),
    ).otherwise(F.struct((a["n"] + 1).alias("n"), (a["depth"] + F.when(w["type"] == "lparen", 1).when((w["type"] == "rparen") & (a["depth"] > 0), -1).otherwise(0)).alias("depth"), F.lit(False).alias("done")))
    return F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("done")), step)["n"]


def _listed() -> Column:
    return (F.col("part") == "data") & ~F.col("fatal") & F.col("listing") & (F.col("k0") == "number")


def _items(parts: DataFrame) -> DataFrame:
    """Sentences of the data division's item list, read as items; `error` says why one is none."""
    return _as_items(parts.where(_listed()))


def _as_items(rows: DataFrame) -> DataFrame:
    """Any sentences read as items, which only the listed ones are."""
    rest = lambda i: F.slice("toks", i + 1, F.greatest(F.col("n"), F.lit(1)))
    level = F.col("w0").try_cast("int") if hasattr(F.col("w0"), "try_cast") else F.expr("try_cast(w0 AS int)")
    rows = rows.withColumns({"level": level, "name": F.col("w1"), "pic": _is((_at(2, "type") == "keyword") & (_at(2, "lexeme") == "PIC")) & (level != 88)})
    rows = rows.withColumn("took", F.when(F.col("pic"), _picture(rest(3))).otherwise(0))
    value_at = F.when(F.col("pic"), 3 + F.col("took")).otherwise(F.lit(2))
    rows = rows.withColumn("value_at", value_at).withColumn("has_value", _is((F.get("toks", F.col("value_at"))["type"] == "keyword") & (F.get("toks", F.col("value_at"))["lexeme"] == "VALUE")))
    rows = rows.withColumn("ends_at", F.when(F.col("has_value"), F.col("value_at") + 2).otherwise(F.col("value_at")))
    value_kind = F.get("toks", F.col("value_at") + 1)["type"]
    got = lambda i: F.coalesce(F.get("lex", i), F.when(F.col("ended"), ".").otherwise(""))
    pic_ok = _is(_at(3, "type").isin("identifier", "keyword", "number"))
    error = (
        F.when(~_is(F.col("level").isin(LEVELS)), F.concat(F.lit("invalid level number "), F.coalesce(F.col("level").cast("string"), F.col("w0")), F.lit("; supported: 01–49, 66, 77, 78, 88")))
        .when(~_word(F.col("k1")), F.concat(F.lit("expected data-name after level "), F.col("level").cast("string"), F.lit(", got "), quoted(got(F.lit(1)))))
        .when(F.col("pic") & ~pic_ok, F.concat(F.lit("expected picture string after PIC for "), quoted(F.col("name")), F.lit(", got "), quoted(got(F.lit(3)))))
        .when((F.col("level") == 88) & F.col("has_value") & ~_is(value_kind.isin("string", "number", "identifier", "keyword")), F.concat(F.lit("expected literal after VALUE for condition "), quoted(F.col("name")), F.lit(", got "), quoted(got(F.col("value_at") + 1))))
        .when(F.col("ends_at") != F.col("n"), F.concat(F.lit("expected '.' to terminate data item, got "), quoted(got(F.col("ends_at")))))
        .when(~F.col("ended"), "expected '.' to terminate data item, got EOF")
    )
    bad_at = F.when(~_is(F.col("level").isin(LEVELS)), 0).when(~_word(F.col("k1")), 1).when(F.col("pic") & ~pic_ok, 3).when((F.col("level") == 88) & F.col("has_value") & ~_is(value_kind.isin("string", "number", "identifier", "keyword")), F.col("value_at") + 1).otherwise(F.col("ends_at"))
    return rows.withColumns({"error": error, "bad_at": F.least(bad_at, F.col("n"))})


def data_items(parts: DataFrame) -> DataFrame:
    """path, item_ord, level, name, kind (elementary, group, condition), picture, value, line, col, offset."""
    rows = _items(parts).where("error IS NULL AND sent > last_storage")
    kind = F.when(F.col("level") == 88, "condition").when(F.col("pic"), "elementary").otherwise("group")
    picture = F.when(F.col("pic"), F.array_join(F.slice("lex", F.lit(4), F.col("took")), ""))
    value = F.when(F.col("has_value") & (kind != "group"), F.get("lex", F.col("value_at") + 1))
    order = F.row_number().over(Window.partitionBy("path").orderBy("sent"))
    return rows.select("path", order.alias("item_ord"), "level", "name", kind.alias("kind"), picture.alias("picture"), value.alias("value"), "start.line", "start.col", "start.offset")


def procedure(parts: DataFrame, mode: str = "reference") -> DataFrame:
    """Sentences of procedure divisions with what each is, up to and with the one that ends the reading.

    what: label, statement, error; `resumes` tells whether reading goes on after an error. `bad_at` is the word at which an error is
    noticed: if the sentence ends in a word after it, resynchronisation stops on that word and the division ends.
    """
    return _as_steps(parts.where(_in_procedure()), mode).where("what IS NOT NULL")


def _in_procedure() -> Column:
    return _is((F.col("part") == "procedure") & ~F.col("fatal"))


def _as_steps(rows: DataFrame, mode: str) -> DataFrame:
    """`procedure` over any sentences: `what` is null for those that are no step."""
    extended = mode == "extended"
    verbs = VERBS + (EXTENDED_VERBS if extended else [])
    here = _in_procedure()
    word, verb, n = _word(F.col("k0")), F.col("w0").isin(verbs), F.col("n")
    rows = rows.withColumn("rest", F.slice("lex", 2, F.greatest(n, F.lit(1))))
    split = F.coalesce(*(F.when(F.col("w0") == v, F.lit(s)) for v, s in SPLIT.items()), F.when(F.col("w0") == "CALL", F.lit("USING")))
    rows = rows.withColumn("split", split).withColumn("p", F.coalesce(F.array_position("rest", F.col("split")), F.lit(0)).cast("int"))
    got = lambda i: quoted(F.coalesce(F.get("lex", i), F.when(F.col("ended"), ".").otherwise("")))
    left_empty = (F.col("p") == 1) | (F.size("rest") == 0)
    two = F.col("w0").isin(list(SPLIT))
    operand_word = F.when(F.col("w0") == "MOVE", "source operand").otherwise("operand")
    say = lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    cases = [  # condition, word at which it is noticed, message
        (two & left_empty, F.lit(1), say("expected ", operand_word, " after ", F.col("w0"))),
        (two & (F.col("p") == 0), n, say("expected '", F.col("split"), "' in ", F.col("w0"), " statement, got ", got(n))),
        (two & (F.col("p") == F.size("rest")), n, F.when(F.col("w0") == "MOVE", "expected target operand after TO in MOVE statement").otherwise(say("expected target operand after ", F.col("split")))),
        ((F.col("w0") == "DISPLAY") & (n == 1), n, F.lit("expected operand after DISPLAY")),
        ((F.col("w0") == "STOP") & ~_is((F.col("k1") == "keyword") & (F.col("w1") == "RUN")), F.lit(1), say("expected 'RUN' after STOP, got ", got(F.lit(1)))),
        ((F.col("w0") == "STOP") & (n > 2), F.lit(2), say("expected '.' after STOP RUN, got ", got(F.lit(2)))),
        ((F.col("w0") == "GOBACK") & (n > 1), F.lit(1), say("expected '.' after GOBACK, got ", got(F.lit(1)))),
        ((F.col("w0") == "CALL") & left_empty, F.lit(1), F.lit("expected target after CALL")),
    ]
    if extended:
        cases += [((F.col("w0").isin("ACCEPT", "PERFORM")) & (n != 2), F.lit(1), say("expected one operand after ", F.col("w0"))), ((F.col("w0") == "GO") & ~_is((F.col("w1") == "TO") & (n == 3)), F.lit(1), F.lit("expected 'TO' and a label after GO"))]
    else:
        cases += [(F.col("w0") == "ACCEPT", F.lit(0), F.lit("unsupported statement keyword 'ACCEPT'"))]
    bad_verb = F.coalesce(*(F.when(c, F.struct(k.cast("int").alias("k"), m.alias("m"))) for c, k, m in cases), F.when(~F.col("ended"), F.struct(n.cast("int").alias("k"), say("expected '.' after ", F.when(F.col("w0") == "STOP", "STOP RUN").otherwise(F.col("w0")), ", got EOF").alias("m"))))
    bad_label = F.when((n > 1) | ~F.col("ended"), F.struct(F.least(F.lit(1), n).alias("k"), say("expected '.' after paragraph label ", quoted(F.col("w0")), ", got ", got(F.lit(1))).alias("m")))
    rows = rows.withColumns({"starts": word & verb, "names": word & ~verb, "bad": F.when(word & verb, bad_verb).when(word, bad_label)})
    last_is_word = _word(F.get("toks", n - 1)["type"])
    sticks = F.col("bad").isNotNull() & (F.col("bad.k") < n) & last_is_word & F.lit(not extended)
    turn = F.when(here & F.col("names") & F.col("bad").isNull(), 1).when(here & F.col("names") & F.lit(not extended), 0)
    rows = rows.withColumns({"sticks": sticks, "inside": F.coalesce(F.last(turn, ignorenulls=True).over(_before()), F.lit(0)) == 1})
    header = _is(F.col("division").isin(AFTER_PROCEDURE))
    skipped = (n == 0) | ~word
    ends = header | (F.lit(False) if extended else skipped | (F.col("starts") & ~F.col("inside")) | sticks)
    rows = rows.withColumn("end_at", F.min(F.when(here & ends, F.col("sent"))).over(_whole()))
    read = here & (F.col("end_at").isNull() | (F.col("sent") <= F.col("end_at")))
    at_end = _is(F.col("sent") == F.col("end_at"))
    reached = ~at_end | (sticks & (F.col("inside") | F.col("names")) & ~header)
    if extended:
        reached &= ~skipped & (F.col("inside") | F.col("names"))
    what = F.when(~(read & reached), None).when(F.col("bad").isNotNull(), "error").when(F.col("names"), "label").otherwise("statement")
    rows = rows.withColumn("what", what)
    paragraph = F.sum(F.when(F.col("what") == "label", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("sent").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"para_ord": paragraph.cast("int"), "error": F.col("bad.m"), "bad_at": F.col("bad.k")})


def paragraphs(found: DataFrame) -> DataFrame:
    """path, para_ord, name, line, col, offset."""
    return found.where("what = 'label'").select("path", "para_ord", F.col("w0").alias("name"), "start.line", "start.col", "start.offset")


def statements(found: DataFrame) -> DataFrame:
    """path, para_ord, stmt_ord, verb, operands, line, col, offset.

    Operands are texts of words joined by a blank: the two sides of MOVE and arithmetic, DISPLAY's all, CALL's target and then each
    argument as it stands.
    """
    order = F.row_number().over(Window.partitionBy("path").orderBy("sent"))
    return found.where("what = 'statement'").select("path", "para_ord", order.alias("stmt_ord"), _verb().alias("verb"), _operands().alias("operands"), "start.line", "start.col", "start.offset")


def _operands() -> Column:
    n, p = F.size("rest"), F.col("p")
    sides = F.array(_join(F.slice("rest", F.lit(1), p - 1)), _join(F.slice("rest", p + 1, n)))
    call = F.when(p == 0, F.array(_join(F.col("rest")))).otherwise(F.concat(F.array(_join(F.slice("rest", F.lit(1), p - 1))), F.slice("rest", p + 1, F.greatest(n, F.lit(1)))))
    return (
        F.when(F.col("w0").isin(list(SPLIT)), F.when(p > 0, sides)).when(F.col("w0") == "CALL", F.when(p != 1, call)).when(F.col("w0") == "DISPLAY", F.array(_join(F.col("rest"))))
        .when(F.col("w0") == "GO", F.slice("rest", 2, 1)).when(F.col("w0").isin("ACCEPT", "PERFORM"), F.col("rest")).otherwise(F.array().cast("array<string>"))
    )


def _verb() -> Column:
    return F.when(F.col("w0") == "STOP", "STOP RUN").when(F.col("w0") == "GO", "GO TO").otherwise(F.col("w0"))


def marked(parts: DataFrame, mode: str = "reference") -> DataFrame:
    """Every sentence with what the passes look at, in one reading: path, sent, place, wrong, fatal, label, item, verb, operands, opens, named.

    label is a paragraph's name, item a data item, verb and operands a statement's, each null elsewhere; program is the name of the
    program, where its clause starts. opens tells which division starts there, named and labelled whether the source has such a clause
    or a paragraph. A source with a lexical error is one row, with `wrong`.
    """
    rows = worded(parts).withColumn("wrong", F.col("error").isNotNull()).drop("error")
    rows = _with_clause(rows, mode).withColumn("named_at", F.max(F.when(F.col("clause") == "PROGRAM-ID", F.col("sent"))).over(_whole()))
    rows = rows.withColumn("program", F.when(F.col("sent") == F.col("named_at"), ascii_upper(_join(F.col("next_lex"))))).drop("next_lex", "next_kind", "next_ended")
    rows = _as_items(rows)
    item = F.when(_is(_listed() & F.col("error").isNull() & (F.col("sent") > F.col("last_storage"))), F.struct(F.col("name"), F.when(F.col("pic"), F.array_join(F.slice("lex", F.lit(4), F.col("took")), "")).alias("picture")))
    rows = _as_steps(rows.withColumn("item", item).drop("error", "bad_at"), mode)
    rows = rows.withColumn("label", F.when(F.col("what") == "label", F.col("w0")))
    rows = rows.withColumn("labelled", F.max(F.col("label").isNotNull()).over(_whole()))
    opens = F.when(F.col("sent") == F.col("id_at"), "identification").when(F.col("sent") == F.col("proc_at"), "procedure")
    step = F.col("what") == "statement"
    return rows.select(
        "path", "sent", "start.line", "start.col", "start.offset", "wrong", "fatal", "program", "item", "label", F.when(step, _verb()).alias("verb"), F.when(step, _operands()).alias("operands"),
        opens.alias("opens"), F.col("named_at").isNotNull().alias("named"), "labelled",
    )


def synchronised(toks: Column, ended: Column, k: Column) -> Column:
    """Where resynchronisation from word k of a sentence stops, and the tokens it skips: (anchor, skipped).

    A division header or a section keyword stops it before itself, a word at the sentence's end on its period, else the period is
    taken too; without one it runs to the end of file.
    """
    rest = F.slice(toks, k + 1, F.greatest(F.size(toks), F.lit(1)))
    n = F.size(rest)
    key = lambda t, words: (t["type"] == "keyword") & t["lexeme"].isin(words)
    pairs = F.transform(rest, lambda t, i: F.when(key(t, ["IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE"]) & _is(key(F.get(rest, i + 1), ["DIVISION"])), "DIVISION").when(key(t, ["WORKING-STORAGE"]), "SECTION"))
    found = F.filter(F.transform(pairs, lambda a, i: F.struct(i.alias("i"), a.alias("a"))), lambda s: s["a"].isNotNull())
    last_word = (n > 0) & _word(F.get(rest, n - 1)["type"])
    out = lambda a, s: F.struct(F.lit(a).alias("anchor") if isinstance(a, str) else a.alias("anchor"), s.cast("int").alias("skipped"))
    return F.when(F.size(found) > 0, out(found[0]["a"], found[0]["i"])).when(~ended, out("EOF", n)).when(last_word, out("PARAGRAPH", n)).otherwise(out("PERIOD", n + 1))


def syntax_diagnostics(parts: DataFrame, found: DataFrame, mode: str = "reference") -> DataFrame:
    """path, seq, message, line, col, offset, context, sync_point, tokens_skipped for what was read past."""
    by_file = Window.partitionBy("path").orderBy("sent")
    ident = parts.where("part = 'identification' AND NOT fatal").withColumns({"prev": F.lag("w0").over(by_file), "prev_n": F.lag("n").over(by_file), "next_n": F.lead("n").over(by_file), "next_kind": F.lead("k0").over(by_file), "prev_ended": F.lag("ended").over(by_file)})
    is_name = _is((F.col("prev") == "PROGRAM-ID") & (F.col("prev_n") == 1))
    comments = _is((F.lit(mode) == "extended") & (F.col("w0").isin(CLAUSES) | (F.col("prev").isin(CLAUSES) & (F.col("prev_n") == 1))))
    got = lambda i: quoted(F.coalesce(F.get("lex", F.lit(i)), F.when(F.col("ended"), ".").otherwise("")))
    message = (
        F.when(comments | (F.col("n") == 0) & ~is_name, None)
        .when(is_name & (F.col("n") == 0), "expected program name, got '.'")
        .when(is_name & ~_word(F.col("k0")), F.concat(F.lit("expected program name, got "), got(0)))
        .when(is_name & ((F.col("n") > 1) | ~F.col("ended")), F.when(F.col("n") > 1, F.concat(F.lit("unexpected token "), got(1), F.lit(" (got '"), F.col("k1"), F.lit("', expected 'period')"))).otherwise("unexpected end of file"))
        .when(is_name, None).when(F.col("k0") != "keyword", F.concat(F.lit("expected a clause keyword, got "), got(0)))
        .when(F.col("w0") != "PROGRAM-ID", F.concat(F.lit("unknown IDENTIFICATION DIVISION clause: "), got(0)))
        .when(F.col("n") > 1, F.concat(F.lit("unexpected token "), got(1), F.lit(" (got '"), F.col("k1"), F.lit("', expected 'period')")))
    )
    k = F.when(is_name & ~_word(F.col("k0")), 0).when(is_name | (F.col("w0") == "PROGRAM-ID"), 1).otherwise(0)
    ident = ident.withColumns({"error": message, "bad_at": k.cast("int"), "context": F.lit("identification_division")})
    data = parts.where((F.col("part") == "data") & ~F.col("fatal") & ~F.col("listing") & ~((F.col("k0") == "keyword") & (F.col("w0") == "WORKING-STORAGE")) | ((F.col("part") == "data") & ~F.col("fatal") & F.col("listing") & (F.col("n") > 0) & ~_is(F.col("k0") == "number") & ~_is((F.col("k0") == "keyword") & (F.col("w0") == "WORKING-STORAGE"))))
    data = data.withColumns({"error": F.concat(F.lit("unexpected token "), got(0), F.lit(" at DATA DIVISION level")), "bad_at": F.lit(0), "context": F.lit("data_division")})
    sticks = (F.col("n") > 0) & F.col("ended") & _word(F.get("toks", F.col("n") - 1)["type"])  # the period is then met as a token of its own
    data = data.unionByName(data.where(sticks).withColumns({"error": F.lit("unexpected token '.' at DATA DIVISION level"), "bad_at": F.col("n")}))
    items = _items(parts).withColumn("context", F.lit("working_storage_section"))
    steps = found.where("what = 'error'").withColumn("context", F.when(F.col("names"), "procedure_division").otherwise("statement"))
    cols = ["path", "sent", "error", "bad_at", "context", "toks", "ended", "stop", "start"]
    rows = ident.select(*cols).unionByName(data.select(*cols)).unionByName(items.select(*cols)).unionByName(steps.select(*cols)).where("error IS NOT NULL")
    place = F.coalesce(F.get("toks", F.col("bad_at")), F.col("stop"), F.col("start"))
    sync = synchronised(F.col("toks"), F.col("ended"), F.col("bad_at"))
    return rows.withColumns({"place": place, "sync": sync}).select(
        "path", F.row_number().over(Window.partitionBy("path").orderBy("sent", "bad_at")).alias("seq"), F.col("error").alias("message"), "place.line", "place.col", "place.offset", "context",
        F.col("sync.anchor").alias("sync_point"), F.col("sync.skipped").alias("tokens_skipped"),
    )
