"""Everything that is checked in a codebase, as one table of violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import constraints, joins, rules, script_rules
from factloom.sources import python_facts

COLUMNS = ("file", "line", "mode", "call", "message")


def merged(sources: list[DataFrame]) -> DataFrame:
    """Rows (file, line, mode, call, message, source) of all sources; of equal (file, line, mode, call) that of the first source."""
    ranked = None
    for k, s in enumerate(sources):
        one = s.select(*COLUMNS, F.lit(k).alias("source"))
        ranked = one if ranked is None else ranked.unionByName(one)
    first = Window.partitionBy("file", "line", "mode", "call").orderBy("source", "message")
    return ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def fact_violations(facts: DataFrame) -> DataFrame:
    """Violations of the rules over facts: required arguments that calls leave out, and constraints of models' fields."""
    t = python_facts.tables(facts)
    calls = t["calls"]
    missing = constraints.required_args_missing(calls, t["call_keywords"], t["functions"], t["function_args"]).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("arg")), ", ").alias("args"))
    a = calls.join(missing, "seq").select("file", "line", F.lit("required_arg_missing").alias("mode"), F.col("callee").alias("call"), F.concat(F.lit("left out: "), "args").alias("message"))
    creates = calls.where("is_create and not spread").select(F.col("seq").alias("site"), F.regexp_extract("callee", r"^(\w+)\.objects", 1).alias("model"))
    number = F.col("value").try_cast("long")
    given = t["call_keywords"].select(F.col("seq").alias("site"), F.col("arg").alias("field"), F.when(F.col("value").startswith('"'), F.regexp_replace("value", '^"|"$', "")).alias("text"), number.alias("number"))
    choices = t["choices"].select("model", "field", F.when(F.col("choice").try_cast("long").isNull(), F.col("choice")).alias("text"), F.col("choice").try_cast("long").alias("number"))
    problems = constraints.field_problems(creates, given, t["fields"], choices).groupBy("site").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "field", "problem"))), ", ").alias("message"))
    b = calls.join(problems, F.col("seq") == F.col("site")).select("file", "line", F.lit("model_constraint").alias("mode"), F.col("callee").alias("call"), "message")
    return a.unionByName(b)


def check(files: DataFrame, *, captures: tuple[DataFrame, ...] = (), changed: DataFrame | None = None, python_rules: dict[str, Callable] | None = None) -> DataFrame:
    """Violations (file, line, mode, call, message, source) of files(file, text), those of each place once.

    Sources in order: rules on syntax trees, rules over facts, rules on TypeScript and Go, then captures of external
    scanners. A capture's row whose (file, mode, call) a rule has found at any line is left out. With changed(file)
    only those files' violations stay; facts are those of the whole codebase all the same.
    """
    python = files.where(F.col("file").endswith(".py"))
    own = merged([rules.check(python, python_rules), fact_violations(python_facts.facts(python)), script_rules.check(files.where(~F.col("file").endswith(".py")))])
    fresh = [joins.not_seen_anywhere(c.select(*COLUMNS), own).select(*COLUMNS) for c in captures]
    out = own
    for k, c in enumerate(fresh):
        out = out.unionByName(c.withColumn("source", F.lit(3 + k)))
    first = Window.partitionBy("file", "line", "mode", "call").orderBy("source", "message")
    out = out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return joins.in_files(out, changed) if changed is not None else out
