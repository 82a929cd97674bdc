"""Whole sources through the compiler, and the procedure windows against a plain reader."""

import random

import pytest

from quarry.operators import ir, lexer
from quarry.plans.compile import Compilation

HELLO = """IDENTIFICATION DIVISION.
PROGRAM-ID. HELLO.

DATA DIVISION.
WORKING-STORAGE SECTION.
01 WS-GREETING PIC X(20) VALUE SPACES.
01 WS-COUNT    PIC 9(3)  VALUE ZEROS.

PROCEDURE DIVISION.
MAIN-PARA.
    DISPLAY "HELLO WORLD".
    MOVE "WELCOME" TO WS-GREETING.
    DISPLAY WS-GREETING.
    MOVE 1 TO WS-COUNT.
    STOP RUN.
"""

FAULTY = """IDENTIFICATION DIVISION.
PROGRAM-ID. FAULTY.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 A PIC X.
01 A PIC 9.
01 N PIC 9.
01 E PIC ZZ9.
01 SORT.
01 MAIN-PARA PIC 9.
05 RATE PIC S9(4) COMP-3.
01 D PIC 9 VALUE 0.05.
PROCEDURE DIVISION.
MAIN-PARA.
    MOVE A TO N.
    MOVE E TO N.
    MOVE N TO E.
    MOVE B TO C.
    DISPLAY E.
    DISPLAY A B.
    DISPLAY 'x y'.
OTHER.
OTHER.
    CALL 'SUB' USING A, B.
    GOBACK.
"""

SOURCES = {
    "hello": HELLO,
    "faulty": FAULTY,
    "author": "IDENTIFICATION DIVISION.\nAUTHOR. ME.\nPROGRAM-ID. X.\nPROCEDURE DIVISION.\nP.\n  GOBACK.\n",
    "environment": "IDENTIFICATION DIVISION.\nPROGRAM-ID. X.\nENVIRONMENT DIVISION.\nDATA DIVISION.\nPROCEDURE DIVISION.\nP.\n GOBACK.\n",
    "banner": "      * note\nIDENTIFICATION DIVISION.\nPROGRAM-ID. X.\n",
    "nolabel": "PROCEDURE DIVISION.\n  DISPLAY 1.\n",
    "fatal": "PROCEDURE DIVISION USING X.\nP.\n GOBACK.\n",
    "file": "DATA DIVISION.\nFILE SECTION.\n01 X PIC 9.\nPROCEDURE DIVISION.\nP.\n GOBACK.\n",
    "accept": "PROCEDURE DIVISION.\nP.\n DISPLAY 1.\n ACCEPT X.\n DISPLAY 2.\n",
    "literal": "PROCEDURE DIVISION.\nP.\n PERFORM Q 3.\nR.\n DISPLAY 2.\n EXIT.\n",
    "bad": "DISPLAY @.\n",
    "open": 'DISPLAY "abc\n',
    "empty": "",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string")


class Collected:
    """A compilation's tables, each collected once."""

    def __init__(self, compilation):
        self.compilation, self.tables = compilation, {}

    def __getattr__(self, name):
        if name not in self.tables:
            self.tables[name] = getattr(self.compilation, name).collect()
        return self.tables[name]


@pytest.fixture(scope="module")
def compiled(sources):
    c = Compilation(sources)
    yield Collected(c)
    c.close()


def rows(found, *cols, path=None):
    found = found if isinstance(found, list) else found.collect()
    found = [r for r in found if path is None or r.path == path]
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in found]


def test_ir_text(compiled):
    texts = dict(rows(compiled.ir_text, "path", "text"))
    assert texts["hello"] == "\n".join(["Program HELLO", "", "  Module HELLO", "", "    Function __entry__", "", "      entry:", '        DISPLAY "HELLO WORLD"', '        MOVE "WELCOME" -> WS-GREETING', "        DISPLAY WS-GREETING", "        MOVE 1 -> WS-COUNT"])
    assert texts["environment"].endswith("      entry:\n        ; (empty block)")
    assert "bad" not in texts and "fatal" not in texts


def test_diagnostics(compiled):
    found = sorted(rows(compiled.diagnostics, "seq", "code", "message", "line", path="faulty"))
    assert [(c, n) for _, c, _, n in found] == [("SEM001", 6), ("SEM002", 14), ("SEM002", 23), ("SEM003", 18), ("SEM003", 18), ("SEM003", 20), ("SEM008", 9), ("SEM010", 15), ("SEM012", 16), ("SEM012", 17), ("SEM012", 19)]
    assert found[0][2] == "duplicate variable declaration: 'A' (first declared at faulty:5)"
    assert [m for _, c, m, _ in found if c == "SEM003"] == ["undefined variable: 'B'", "undefined variable: 'C'", "undefined variable: 'A B'"]
    assert found[7][2] == "incompatible MOVE: cannot move 'alphanumeric' value ('A') to numeric target 'N'."
    codes = dict(rows(compiled.exit_codes, "path", "code"))
    assert codes["hello"] == codes["environment"] == codes["banner"] == 0 and codes["faulty"] == codes["bad"] == codes["open"] == codes["fatal"] == codes["nolabel"] == 2


def test_items(compiled):
    found = {r[0]: r[1:] for r in rows(compiled.items, "name", "picture", "value", path="faulty")}
    assert found["RATE"] == ("S9(4)COMP-3", None) and found["D"] == ("9", "0")
    errors = rows(compiled.syntax_diagnostics, "message", "sync_point", path="faulty")
    assert errors == [("expected data-name after level 5, got '.'", "PERIOD")]


def test_reading_stops(compiled):
    said = lambda path: sorted(rows(compiled.syntax_diagnostics, "seq", "message", "sync_point", "tokens_skipped", path=path))
    verbs = lambda path: [v for _, v in sorted(rows(compiled.statements, "stmt_ord", "verb", path=path))]
    assert said("author") == [(1, "expected a clause keyword, got 'AUTHOR'", "PARAGRAPH", 1), (2, "expected a clause keyword, got 'ME'", "PARAGRAPH", 1)] and verbs("author") == ["GOBACK"]
    assert verbs("environment") == [] and not rows(compiled.program, "has_procedure", path="environment")[0]
    assert rows(compiled.program, "has_identification", path="banner") == [False]
    assert rows(compiled.diagnostics, "code", path="nolabel") == ["SEM007"]
    assert rows(compiled.program, "fatal", path="fatal") == [True]
    assert not rows(compiled.program, "has_procedure", path="file")[0] and len(said("file")) == 2
    assert verbs("accept") == ["DISPLAY"] and said("accept") == [(1, "unsupported statement keyword 'ACCEPT'", "PARAGRAPH", 2)]
    # an error before a final literal is read past; then a label must come. EXIT. is a label
    assert verbs("literal") == ["DISPLAY"] and sorted(rows(compiled.paragraphs, "name", path="literal")) == ["EXIT", "P", "R"]


def test_lex_errors(compiled):
    assert sorted(rows(compiled.lex_errors, "path", "line", "col", "offset", "message")) == [("bad", 1, 9, 8, "unexpected character '@'"), ("open", 1, 9, 8, "unterminated string literal")]


def test_extended_mode(spark):
    source = "IDENTIFICATION DIVISION.\nAUTHOR. ME TOO.\nPROGRAM-ID. X.\nENVIRONMENT DIVISION.\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n01 T PIC X.\nPROCEDURE DIVISION.\nP.\n ACCEPT T.\n COMPUTE X = Y.\n ADD 1 TO T.\n PERFORM Q.\n GO TO P.\n"
    c = Compilation(spark.createDataFrame([("x", source)], "path string, text string"), "extended", keep=False)
    assert sorted(rows(c.clauses, "clause", "value")) == [("AUTHOR", "ME TOO"), ("PROGRAM-ID", "X")]
    assert [r[1] for r in sorted(rows(c.statements, "stmt_ord", "verb"))] == ["ACCEPT", "ADD", "PERFORM", "GO TO"]
    assert sorted(rows(c.diagnostics, "code")) == ["SEM004", "SEM011"]
    assert c.ir_text.first().text.endswith("        ACCEPT T\n        ADD 1 TO T\n        CALL Q\n        JUMP P")


def test_java(compiled):
    text = dict(rows(compiled.java_sources, "path", "source"))["hello"]
    assert text == 'public class Hello {\n\n    private String wsGreeting;\n    private int wsCount;\n\n    public static void main(String[] args) {\n\n        // IR: DISPLAY "HELLO WORLD"\n        // IR: MOVE "WELCOME" -> WS-GREETING\n        // IR: DISPLAY WS-GREETING\n        // IR: MOVE 1 -> WS-COUNT\n\n    }\n\n}\n'
    codes = rows(compiled.java_diagnostics, "path", "code")
    assert ("faulty", "BE003") in codes and ("nolabel", "BE001") in codes


def test_nested_ifs(spark):
    nodes = [("n", 1, None, None, "IF", ["A"]), ("n", 2, 1, "then", "IF", ["B"]), ("n", 3, 2, "then", "DISPLAY", ["1"]), ("n", 4, None, None, "DISPLAY", ["2"])]
    df = spark.createDataFrame(nodes, "path string, node int, parent int, branch string, verb string, operands array<string>")
    found, blocks = ir.lower_ifs(df)
    assert sorted((r.block_ord, r.block) for r in blocks.collect()) == [(0, "entry"), (1, "if_then_1"), (2, "if_then_3"), (3, "if_merge_4"), (4, "if_merge_2")]
    assert sorted((r.block_ord, r.instr_ord, r.text) for r in found.collect()) == [(0, 1, "IF A THEN if_then_1 ELSE if_merge_2"), (1, 1, "IF B THEN if_then_3 ELSE if_merge_4"), (2, 1, "DISPLAY 1"), (2, 2, "JUMP if_merge_4"), (3, 1, "JUMP if_merge_2"), (4, 1, "DISPLAY 2")]
    edges = {(r.from_block, r.target, r.to_block) for r in ir.cfg_edges(found, blocks).collect()}
    assert (0, "if_then_1", 1) in edges and (0, "if_merge_2", 4) in edges and (3, "if_merge_2", 4) in edges


def lowered(tree):
    """Blocks and lines of a tree of nodes, by plain recursion. A node is a text, or (condition, then, else)."""
    blocks, used = [["entry"]], 0

    def walk(nodes):
        nonlocal used
        for n in nodes:
            if isinstance(n, str):
                blocks[-1].append(f"DISPLAY {n}")
                continue
            cond, then, other = n
            a, b, c = f"if_then_{used + 1}", f"if_merge_{used + 2}", f"if_else_{used + 3}" if other else None
            used += 3 if other else 2
            blocks[-1].append(f"IF {cond} THEN {a} ELSE {c or b}")
            for label, part in ((a, then), (c, other)):
                if label:
                    blocks.append([label])
                    walk(part)
                    blocks[-1].append(f"JUMP {b}")
            blocks.append([b])

    walk(tree)
    return blocks


def as_nodes(path, tree):
    rows = []

    def put(nodes, parent, branch):
        for n in nodes:
            at = len(rows) + 1
            rows.append((path, at, parent, branch, "DISPLAY" if isinstance(n, str) else "IF", [n if isinstance(n, str) else n[0]]))
            if not isinstance(n, str):
                put(n[1], at, "then")
                put(n[2], at, "else")

    put(tree, None, None)
    return rows


def test_ifs_of_any_depth(spark):
    rng = random.Random(11)

    def tree(depth):
        return [f"D{rng.randint(0, 9)}" if depth == 0 or rng.random() < 0.5 else (f"C{rng.randint(0, 9)}", tree(depth - 1), tree(depth - 1) if rng.random() < 0.5 else []) for _ in range(rng.randint(1, 3))]

    trees = {f"t{i}": tree(i % 6) for i in range(40)}
    deep = ["X"]
    for i in range(200):
        deep = [(f"C{i}", deep, ["E"] if i % 3 == 0 else [])]
    trees["deep"] = deep
    df = spark.createDataFrame([r for p, t in trees.items() for r in as_nodes(p, t)], "path string, node int, parent int, branch string, verb string, operands array<string>")
    found, blocks = ir.lower_ifs(df)
    made = {(r.path, r.block_ord): [r.block] for r in blocks.collect()}
    for r in sorted(found.collect(), key=lambda r: (r.path, r.block_ord, r.instr_ord)):
        made[r.path, r.block_ord].append(r.text)
    for p, t in trees.items():
        assert [v for (q, _), v in sorted(made.items()) if q == p] == lowered(t), p
    for bad in ([("x", 1, 2, "then", "DISPLAY", ["A"]), ("x", 2, 1, "then", "DISPLAY", ["A"])], [("x", 1, None, None, "IF", ["A"]), ("x", 2, 1, "so", "DISPLAY", ["A"])]):
        with pytest.raises(Exception, match="node"):
            ir.lower_ifs(spark.createDataFrame(bad, df.schema))[0].collect()


def plain_reader(sentences):
    """A cursor over tokens: what a procedure division's paragraphs and statements are. Its own code, for the windows to agree with."""
    verbs = {"DISPLAY", "MOVE", "STOP", "GOBACK", "ACCEPT", "ADD", "CALL"}
    toks = [t for s in sentences for t in [*s, "."]]
    word = lambda t: t[0].isalpha()
    at, out = 0, []

    def sync(i):
        while i < len(toks):
            if toks[i] == ".":
                return i + 1
            if word(toks[i]) and i + 1 < len(toks) and toks[i + 1] == ".":
                return i + 1
            i += 1
        return i

    def statement(i):
        """(node or None, where an error is, where it ends)"""
        verb, end = toks[i], toks.index(".", i)
        body = toks[i + 1 : end]
        if verb == "ACCEPT":
            return None, i, None
        if verb == "DISPLAY":
            return (("DISPLAY", " ".join(body)), None, end + 1) if body else (None, end, None)
        if verb == "STOP":
            if body[:1] != ["RUN"]:
                return None, i + 1, None
            return (("STOP RUN",), None, end + 1) if len(body) == 1 else (None, i + 2, None)
        if verb == "GOBACK":
            return (("GOBACK",), None, end + 1) if not body else (None, i + 1, None)
        if verb == "CALL":
            k = body.index("USING") if "USING" in body else len(body)
            return (("CALL", " ".join(body[:k]), *body[k + 1 :]), None, end + 1) if k else (None, i + 1, None)
        k = body.index("TO") if "TO" in body else len(body)
        if k == 0:
            return None, i + 1, None
        if k == len(body) or k == len(body) - 1:
            return None, end, None
        return (verb, " ".join(body[:k]), " ".join(body[k + 1 :])), None, end + 1

    while at < len(toks) and word(toks[at]) and toks[at] not in verbs:
        label = toks[at]
        at += 1
        if toks[at] != ".":
            at = sync(at)
            continue
        at += 1
        out.append((label,))
        while at < len(toks) and word(toks[at]):
            if toks[at] not in verbs:
                break
            node, wrong, after = statement(at)
            if node:
                out.append(node)
                at = after
            else:
                at = sync(wrong)
    return out


def test_windows_agree_with_a_plain_reader(spark):
    rng = random.Random(5)
    pool = ["P", "Q", "R", "DISPLAY", "MOVE", "TO", "STOP", "RUN", "GOBACK", "ACCEPT", "ADD", "CALL", "USING", "1", "'s'", "X", "IF"]
    good = [["P"], ["DISPLAY", "X"], ["MOVE", "1", "TO", "X"], ["ADD", "1", "TO", "X"], ["CALL", "'s'", "USING", "X"], ["GOBACK"], ["STOP", "RUN"]]
    programs = [[["P"] if k == 0 and rng.random() < 0.8 else rng.choice(good) if rng.random() < 0.7 else [rng.choice(pool) for _ in range(rng.randint(0, 4))] for k in range(rng.randint(1, 9))] for _ in range(1500)]
    source = lambda p: "PROCEDURE DIVISION.\n" + "\n".join(" ".join(s) + "." for s in p) + "\n"
    c = Compilation(spark.createDataFrame([(str(i), source(p)) for i, p in enumerate(programs)], "path string, text string"))
    got = {}
    for r in c.paragraphs.collect():
        got.setdefault(r.path, []).append(((r.line, r.col), (r.name,)))
    for r in c.statements.collect():
        got.setdefault(r.path, []).append(((r.line, r.col), (r.verb, *r.operands)))
    c.close()
    for i, p in enumerate(programs):
        assert [n for _, n in sorted(got.get(str(i), []))] == plain_reader(p), source(p)


def test_lexer_counts_and_places(spark):
    source = "* note\r\n  move  x--  to y1. *> end\r\n\"a b\" 'c' () ; : = 12\n"
    found = rows(lexer.tokens(spark.createDataFrame([("s", source)], "path string, text string")), "tok_idx", "type", "lexeme", "line", "col", "offset")
    assert sorted(found) == [(0, "keyword", "MOVE", 2, 3, 10), (1, "identifier", "X", 2, 9, 16), (2, "identifier", "TO", 2, 14, 21), (3, "identifier", "Y1", 2, 17, 24), (4, "period", ".", 2, 19, 26), (5, "string", '"a b"', 3, 1, 36), (6, "string", "'c'", 3, 7, 42), (7, "lparen", "(", 3, 11, 46), (8, "rparen", ")", 3, 12, 47), (9, "unknown", ";", 3, 14, 49), (10, "unknown", ":", 3, 16, 51), (11, "unknown", "=", 3, 18, 53), (12, "number", "12", 3, 20, 55)]
