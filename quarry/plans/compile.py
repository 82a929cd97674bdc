"""Compilation of any number of sources as one lazy plan for each table.

    sources -> tokens -> sentences -> divisions -> clauses, items, paragraphs, statements
            -> symbols, diagnostics -> instructions -> text, Java

Sources are dealt by path once, in the lexer; every step after it stays within a path.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grammar, ir, java, lexer, semantics

MODES = ("reference", "extended")
KEPT = ("_read", "statements", "declarations", "symbols", "findings")


class Compilation:
    """Tables of a set of sources (path, text). Each is a DataFrame, made when it is first asked for.

    All tables start from the same sentences, with their divisions. With `keep` these are kept by path, so that several tables lex and deal the sources
    once, as are the narrow tables that most others join: statements, declarations, symbols and findings. They are kept on disk: in memory
    they would take what sorts need, and another executor would get a part as one piece of the heap. A reader of a kept table still holds
    up to 100 batches of 10,000 rows, which is much for sentences: who wants one table may name what is kept, as in
    `keep=["findings"]`, and the sources are read for that alone. A lost executor's part is made anew from the sources. `close` drops
    them, as leaving a `with` block does.

    `lex` and `names` may be replaced: any functions from sources to tokens (a source's lexical error being a row without a type), and
    from symbols to (path, program).
    """

    def __init__(self, sources: DataFrame, mode: str = "reference", *, keep: bool | Collection[str] = True, lex: Callable[[DataFrame], DataFrame] = lexer.lexed, names: Callable[[DataFrame], DataFrame] | None = None):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.keep = (KEPT if keep else ()) if isinstance(keep, bool) else tuple(keep)
        if not set(self.keep) <= set(KEPT):
            raise ValueError(f"what can be kept is {KEPT}")
        self.sources, self.mode, self._lex, self._names = sources, mode, lex, names
        # Spark 4.1 plans unions as partitioned like their inputs, but adaptive execution may then run them with the sum of their partitions
        sources.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")

    def __enter__(self) -> Compilation:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def tokens(self) -> DataFrame:
        return self._lex(self.sources).where("type IS NOT NULL")

    @cached_property
    def _read(self) -> DataFrame:
        """Sentences with their divisions; a source with a lexical error is one row."""
        return self._kept("_read", grammar.divisions(lexer.sentences(self._lex(self.sources)), self.mode))

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.persist(StorageLevel.DISK_ONLY) if name in self.keep else rows

    @cached_property
    def lex_errors(self) -> DataFrame:
        return lexer.errors(self._read.where("error IS NOT NULL").select("path", "error.*"))

    @cached_property
    def parts(self) -> DataFrame:
        return grammar.worded(self._read.where("error IS NULL").drop("error"))

    def close(self) -> None:
        for name in self.keep:
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def program(self) -> DataFrame:
        return grammar.program(self.parts)

    @cached_property
    def clauses(self) -> DataFrame:
        return grammar.clauses(self.parts, self.mode)

    @cached_property
    def items(self) -> DataFrame:
        return grammar.data_items(self.parts)

    @cached_property
    def procedure(self) -> DataFrame:
        return grammar.procedure(self.parts, self.mode)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return grammar.paragraphs(self.procedure)

    @cached_property
    def statements(self) -> DataFrame:
        return self._kept("statements", grammar.statements(self.procedure))

    @cached_property
    def syntax_diagnostics(self) -> DataFrame:
        return grammar.syntax_diagnostics(self.parts, self.procedure, self.mode)

    @cached_property
    def declarations(self) -> DataFrame:
        return self._kept("declarations", semantics.declarations(self.clauses, self.items, self.paragraphs))

    @cached_property
    def symbols(self) -> DataFrame:
        return self._kept("symbols", semantics.symbols(self.declarations))

    @cached_property
    def findings(self) -> DataFrame:
        """What the passes find, and as pass 0 the sources without a tree."""
        return self._kept("findings", semantics.findings(grammar.marked(self._read, self.mode), self.mode))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return semantics.diagnostics(self.findings)

    @cached_property
    def names(self) -> DataFrame:
        """path, program: every source with a tree, the name empty where there is none."""
        if self._names is not None:
            return self._names(self.symbols)
        return grammar.program_names(self.parts, self.mode)

    @cached_property
    def ir(self) -> DataFrame:
        return ir.instructions(self.statements, self.names)

    @cached_property
    def ir_text(self) -> DataFrame:
        return ir.ir_text(self.names, self.ir)

    @cached_property
    def java_fields(self) -> DataFrame:
        return java.fields(self.symbols)

    @cached_property
    def java_sources(self) -> DataFrame:
        return java.sources(self.names, self.java_fields, self.ir)

    @cached_property
    def java_diagnostics(self) -> DataFrame:
        return java.diagnostics(self.symbols, self.names)

    @cached_property
    def exit_codes(self) -> DataFrame:
        """path, code: 2 for sources with a lexical, fatal or semantic error, else 0."""
        bad = self.findings.select("path").distinct()
        return self.sources.select("path").join(bad.withColumn("code", F.lit(2)), "path", "left").withColumn("code", F.coalesce("code", F.lit(0)))

    def visit(self, table: str, hooks: dict[str, Callable[[DataFrame], DataFrame]], by: str = "verb") -> dict[str, DataFrame]:
        """Visits a table's rows by kind: each hook gets the rows whose `by` column is its name, and returns a DataFrame of its own."""
        rows = getattr(self, table)
        return {kind: hook(rows.where(F.col(by) == kind)) for kind, hook in hooks.items()}

    def write(self, to: str, tables: tuple[str, ...] = ("statements", "symbols", "diagnostics", "ir", "ir_text")) -> None:
        for t in tables:
            getattr(self, t).write.mode("overwrite").parquet(f"{to.rstrip('/')}/{t}")
