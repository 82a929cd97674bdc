"""The command line: compiles files, prints their instructions, and tells what is wrong by text and exit code.

    python -m quarry FILE [FILE ...]

Files are read by Spark, so paths may be of any file system that it knows.
"""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import decoded_replacing
from .plans.compile import MODES, Compilation

#: Exit codes: compiled, a file that can't be read, errors in a source.
DONE, UNREADABLE, FAULTY = 0, 1, 2


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(path, text) of the files that can be read, undecodable bytes replaced; what is wrong with the others."""
    wrong, out = {}, spark.createDataFrame([], "path string, text string")
    for p in dict.fromkeys(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            wrong[p] = f"error: file not found: {p}"
        elif not fs.getFileStatus(at).isFile():
            wrong[p] = f"error: cannot read file '{p}': it is a folder"
        elif not fs.getFileStatus(at).getLen():  # Spark's source passes over empty files
            out = out.unionByName(spark.createDataFrame([(p, "")], out.schema))
        else:
            out = out.unionByName(spark.read.format("binaryFile").load(p).select(F.lit(p).alias("path"), decoded_replacing(F.col("content")).alias("text")))
    return out, wrong


def compile_files(spark: SparkSession, paths: list[str], *, mode: str = "reference", out: TextIO | None = None, err: TextIO | None = None) -> int:
    """Compiles files; instructions go to `out`, errors and diagnostics to `err`. Returns the highest of the files' exit codes.

    A source with a lexical error or a damaged division header prints no instructions. What is collected is these files' own text.
    """
    out, err = out or sys.stdout, err or sys.stderr
    sources, wrong = read_files(spark, paths)
    with Compilation(sources, mode) as c:
        by_path = lambda df: {p: [r for r in rows if r.path == p] for rows in [df.collect()] for p in paths}
        lexical, semantic, text, codes = by_path(c.lex_errors), by_path(c.diagnostics.orderBy("path", "seq")), by_path(c.ir_text), {r.path: r.code for r in c.exit_codes.collect()}
        fatal = {r.path for r in c.program.where("fatal").collect()}
    worst = DONE
    for p in dict.fromkeys(paths):
        if p in wrong:
            print(wrong[p], file=err)
        for r in lexical[p]:
            print(f"lex error: {p}:{r.line}:{r.col}: {r.message}", file=err)
        if p in fatal:
            print(f"parse error: {p}: a division or section header is damaged", file=err)
        if semantic[p]:
            print("\nSemantic Diagnostics:", "-" * 40, sep="\n", file=err)
        for r in semantic[p]:
            print(f"  [{r.severity.upper()}] {p}:{r.line}:{r.col}\n  {r.message}\n", file=err)
        for r in text[p]:
            print(r.text, file=out)
        worst = max(worst, UNREADABLE if p in wrong else codes.get(p, DONE))
    return worst


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .session import session

    parser = argparse.ArgumentParser(prog="python -m quarry", description="Compiles COBOL files and prints their instructions.")
    parser.add_argument("source", nargs="+", help="a COBOL file")
    parser.add_argument("--mode", choices=MODES, default=MODES[0])
    args = parser.parse_args(argv)
    return compile_files(spark or session("quarry"), args.source, mode=args.mode)
