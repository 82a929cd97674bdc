"""The flat intermediate representation: one row for each instruction, blocks in order, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cobol import operand

ENTRY, FUNCTION = "entry", "__entry__"


def _target(text: Column) -> Column:
    """CALL's target: an operand less one layer of quotes."""
    t = operand(text)
    single = t.startswith("'") & t.endswith("'") & (F.char_length(t) >= 1)
    double = t.startswith('"') & t.endswith('"')
    return F.when(double | single, F.substring(t, 2, F.greatest(F.char_length(t) - 2, F.lit(0)))).otherwise(t)


def instructions(statements: DataFrame, names: DataFrame) -> DataFrame:
    """path, program, block_ord, block, instr_ord, opcode, result, args, from flat statements. Paragraphs run into the entry block.

    `names` has path and program. STOP RUN and GOBACK give nothing. PERFORM is a call of the label as it stands, GO TO a jump.
    """
    a, b = F.col("operands")[0], F.col("operands")[1]
    verb = F.col("verb")
    one = lambda *v: F.array(*v).cast("array<string>")
    rows = statements.where(~verb.isin("STOP RUN", "GOBACK")).select(
        "path", "stmt_ord",
        F.when(verb == "PERFORM", "CALL").when(verb == "GO TO", "JUMP").otherwise(verb).alias("opcode"),
        F.when(verb == "MOVE", operand(b)).when(verb == "ACCEPT", F.upper(F.trim(a))).alias("result"),
        F.when(verb == "CALL", F.concat(one(_target(a)), F.transform(F.slice("operands", 2, F.greatest(F.size("operands"), F.lit(1))), operand)))
        .when(verb.isin("PERFORM", "GO TO"), F.col("operands")).when(verb.isin("MOVE", "DISPLAY"), one(operand(a))).when(verb == "ACCEPT", one()).otherwise(one(operand(a), operand(b))).alias("args"),
    )
    rows = rows.join(names.select("path", "program"), "path", "left").withColumn("program", F.coalesce("program", F.lit("")))
    order = F.row_number().over(Window.partitionBy("path").orderBy("stmt_ord"))
    return rows.select("path", "program", F.lit(0).alias("block_ord"), F.lit(ENTRY).alias("block"), order.alias("instr_ord"), "opcode", "result", "args")


_LOWERED = "block_ord int, block string, instr_ord int, opcode string, args array<string>"


def _lowered(nodes):
    """One source's statement trees as blocks (rows without instr_ord) and instructions, in order; nested to any depth."""
    import pandas as pd

    nodes = nodes.sort_values("node")
    path, known, kids = nodes["path"].iloc[0], {}, {}
    for n, parent, branch, verb, operands in zip(nodes["node"], nodes["parent"], nodes["branch"], nodes["verb"], nodes["operands"], strict=True):
        above = None if pd.isna(parent) else int(parent)
        if n in known or (above is not None and (above not in known or branch not in ("then", "else"))):
            raise ValueError(f"{path}: node {n} is there twice, or its parent {above} isn't there before it, or its branch is {branch!r}")
        known[n] = verb, [] if operands is None else list(operands)
        kids.setdefault((above, branch if above is not None else None), []).append(n)
    out, used, block, instr = [(0, ENTRY, None, None, None)], 0, (0, ENTRY), 0
    todo = [("node", n) for n in reversed(kids.get((None, None), []))]  # what comes next is last
    while todo:
        kind, what = todo.pop()
        if kind == "block":
            block, instr = (block[0] + 1, what), 0
            out.append((*block, None, None, None))
            continue
        verb, args = known[what] if kind == "node" else ("JUMP", [what])
        if verb in ("STOP RUN", "GOBACK"):
            continue
        if verb == "IF":
            then, merge = f"if_then_{used + 1}", f"if_merge_{used + 2}"
            other = f"if_else_{used + 3}" if (what, "else") in kids else None
            used += 3 if other else 2
            args = [args[0] if args else "", then, other or merge]
            steps = [("block", then), *(("node", k) for k in kids.get((what, "then"), [])), ("jump", merge)]
            if other:
                steps += [("block", other), *(("node", k) for k in kids[what, "else"]), ("jump", merge)]
            todo += reversed([*steps, ("block", merge)])
        instr += 1
        out.append((*block, instr, verb, args))
    rows = pd.DataFrame(out, columns=[c.split()[0] for c in _LOWERED.split(", ")])
    rows["instr_ord"] = rows["instr_ord"].astype("Int32")
    rows.insert(0, "path", path)
    return rows


def lower_ifs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instructions and blocks of statement trees with IF nodes: (ir, blocks).

    nodes: path, node (in the order of reading, parents first), parent (null at the top), branch ('then' or 'else' under an IF), verb,
    operands. One counter numbers labels in that order: then, merge, and else where there are else statements, without which the false
    edge goes to the merge. A block row is there for each block, empty ones too. Trees may be nested to any depth; a parent that isn't
    there before its node is an error. A tree's order is a walk that columns can't express, so a task takes one source's nodes, of
    which the upload limit bounds the number, and walks them once.
    """
    path = f"path {nodes.schema['path'].dataType.simpleString()}"
    rows = nodes.select("path", "node", "parent", "branch", "verb", "operands").groupBy("path").applyInPandas(_lowered, f"{path}, {_LOWERED}")
    opcode = F.col("opcode")
    args = F.when(opcode == "JUMP", F.col("args")).when(opcode == "IF", F.concat(F.array(operand(F.col("args")[0])), F.slice("args", 2, 2))).otherwise(F.transform("args", operand))
    instr = rows.where("instr_ord IS NOT NULL").select("path", "block_ord", "instr_ord", instruction_text(opcode, F.lit(None), args).alias("text"), "block")
    return instr, rows.where("instr_ord IS NULL").select("path", "block_ord", "block")


def instruction_text(opcode: Column, result: Column, args: Column) -> Column:
    """An instruction's line. Sources of MOVE are its first argument; without a result its second is where it goes."""
    a, b = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    join = lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    two = F.coalesce(*(F.when(opcode == v, F.lit(w)) for v, w in (("ADD", "TO"), ("SUBTRACT", "FROM"), ("MULTIPLY", "BY"), ("DIVIDE", "INTO"))))
    rest = F.array_join(F.slice(args, 2, F.greatest(F.size(args), F.lit(1))), " ")
    return (
        F.when(opcode == "MOVE", join("MOVE ", a, " -> ", F.coalesce(result, b))).when(opcode == "ASSIGN", join("ASSIGN ", result, " = ", a))
        .when(opcode == "DISPLAY", join("DISPLAY ", a)).when(opcode == "ACCEPT", join("ACCEPT ", F.coalesce(result, a)))
        .when(two.isNotNull(), join(opcode, " ", a, " ", two, " ", b)).when(opcode == "CALL", F.when(rest != "", join("CALL ", a, " USING ", rest)).otherwise(join("CALL ", a)))
        .when(opcode == "RETURN", F.when(F.coalesce(a, F.lit("")) != "", join("RETURN ", a)).otherwise("RETURN"))
        .when(opcode == "IF", join("IF ", a, " THEN ", b, " ELSE ", F.get(args, F.lit(2)))).when(opcode == "JUMP", join("JUMP ", a)).otherwise(join("; ", opcode))
    )


def ir_text(names: DataFrame, ir: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """path, text of whole programs, blocks without instructions included.

    names: path and program, one row for each source to print. `blocks` are its blocks; without it there is the entry block alone.
    """
    line = F.col("text") if "text" in ir.columns else instruction_text(F.col("opcode"), F.col("result"), F.col("args"))
    body = ir.groupBy("path", "block_ord").agg(F.sort_array(F.collect_list(F.struct("instr_ord", F.concat(F.lit("        "), line).alias("line")))).alias("lines"))
    heads = names.select("path", F.lit(0).alias("block_ord"), F.lit(ENTRY).alias("block")) if blocks is None else blocks.select("path", "block_ord", "block")
    whole = heads.join(body, ["path", "block_ord"], "left")
    text = F.concat(F.lit("\n\n      "), F.col("block"), F.lit(":\n"), F.coalesce(F.array_join("lines.line", "\n"), F.lit("        ; (empty block)")))
    texts = whole.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block_ord", text.alias("text")))).alias("blocks"))
    head = F.concat(F.lit("Program "), F.col("program"), F.lit("\n\n  Module "), F.col("program"), F.lit(f"\n\n    Function {FUNCTION}"))
    return names.join(texts, "path").select("path", F.concat(head, F.array_join("blocks.text", "")).alias("text"))


def sizes(ir: DataFrame) -> DataFrame:
    """Blocks and instructions of each program."""
    return ir.groupBy("path").agg(F.countDistinct("block_ord").alias("blocks"), F.count("*").alias("instructions"))


def cfg_edges(ir: DataFrame, blocks: DataFrame) -> DataFrame:
    """Jumps and branches with the block that each leads to; null where no block has that label. An addition to the classic front end."""
    jump = F.regexp_extract_all(F.col("text"), F.lit(r"^JUMP (.+)$"), F.lit(1))
    branch = F.concat(F.regexp_extract_all(F.col("text"), F.lit(r" THEN (\S+) ELSE \S+$"), F.lit(1)), F.regexp_extract_all(F.col("text"), F.lit(r" ELSE (\S+)$"), F.lit(1)))
    edges = ir.where(F.col("text").rlike("^(JUMP|IF) ")).select("path", F.col("block_ord").alias("from_block"), F.explode(F.when(F.col("text").startswith("JUMP "), jump).otherwise(branch)).alias("target"))
    return edges.join(blocks.select("path", F.col("block").alias("target"), F.col("block_ord").alias("to_block")), ["path", "target"], "left")
