"""Java class skeletons from symbols and instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cobol import java_class_name, java_field, java_field_name, java_type
from ..functions.text import quoted
from .ir import instruction_text


def fields(symbols: DataFrame) -> DataFrame:
    """path, ord, java_name, java_type, initial_value, cobol_name of variables with a type that maps."""
    rows = symbols.where("kind = 'variable'").withColumn("java_type", java_type(F.col("ctype"))).where("java_type IS NOT NULL")
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("family", "ord")).alias("ord"), java_field_name(F.col("name")).alias("java_name"), "java_type", F.lit(None).cast("string").alias("initial_value"), F.col("name").alias("cobol_name"))


def diagnostics(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """path, code, severity, message: BE001 no program name, BE003 no type, BE002 no mapping."""
    say = lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    variables = symbols.where("kind = 'variable'")
    tail = "skipping field generation."
    untyped = variables.where("ctype IS NULL").select("path", F.lit("BE003").alias("code"), say("variable ", quoted(F.col("name")), " has no resolved COBOL type; ", tail).alias("message"))
    unmapped = variables.where(F.col("ctype").isNotNull() & java_type(F.col("ctype")).isNull()).select("path", F.lit("BE002").alias("code"), say("variable ", quoted(F.col("name")), ": unsupported COBOL type ", quoted(F.col("ctype.category")), "; ", tail).alias("message"))
    nameless = names.where("program = ''").select("path", F.lit("BE001").alias("code"), F.lit("IRProgram has no name and no named module; falling back to 'GeneratedProgram'.").alias("message"))
    return untyped.unionByName(unmapped).unionByName(nameless).select("path", "code", F.lit("warning").alias("severity"), "message")


def stubs(ir: DataFrame) -> DataFrame:
    """path, stubs: a comment line for each instruction of the first block; later blocks give none."""
    line = F.col("text") if "text" in ir.columns else instruction_text(F.col("opcode"), F.col("result"), F.col("args"))
    return ir.where("block_ord = 0").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("instr_ord", F.concat(F.lit("        // IR: "), line).alias("line")))), lambda s: s["line"]).alias("stubs"))


def sources(names: DataFrame, fields: DataFrame, ir: DataFrame) -> DataFrame:
    """path, source: the class text, with its fixed blank lines."""
    declared = fields.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", java_field(F.col("java_type"), F.col("java_name"), F.col("initial_value")).alias("line")))), lambda s: s["line"]).alias("fields"))
    rows = names.join(declared, "path", "left").join(stubs(ir), "path", "left")
    part = lambda c: F.when(F.size(c) > 0, F.concat(F.array_join(c, "\n"), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("public class "), java_class_name(F.col("program")), F.lit(" {\n\n"), part("fields"), F.lit("    public static void main(String[] args) {\n\n"), part("stubs"), F.lit("    }\n\n}\n"))
    return rows.select("path", text.alias("source"))
