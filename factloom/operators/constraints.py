"""Constraints that a call must keep: required arguments of functions, and fields of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import joins

#: First parameters that a compiler hands in.
CONTEXTS = ("ctx", "cgctx", "context", "typingctx", "typingcontext")
RELATIONS = ("OneToOneRel", "ManyToOneRel", "ManyToManyRel", "ManyToManyField")


def required_args_missing(calls: DataFrame, keywords: DataFrame, functions: DataFrame, args: DataFrame) -> DataFrame:
    """(seq, callee, arg): required arguments that a call leaves out.

    calls(seq, callee, n_positional, spread, is_create, is_method, in_main, is_local), keywords(seq, arg),
    functions(func_id, name, is_called_otherwise), args(func_id, pos, arg, required, kwonly). Names defined more than
    once are no one's; calls with spreads, of models, under ``__main__`` or of a name that is assigned there, and
    functions that a framework calls are left alone. The first n positional arguments cover the first n required ones
    that aren't by keyword only; a receiver, or a compiler's context, covers one more.
    """
    known = joins.unique_names(functions.select("func_id", "name", "is_called_otherwise")).where("not is_called_otherwise")
    need = args.where("required").join(known.select("func_id", "name"), "func_id")
    order = Window.partitionBy("name").orderBy("kwonly", "pos")
    need = need.withColumn("k", F.row_number().over(order)).withColumn("context", F.max(F.when((F.col("k") == 1) & ~F.col("kwonly") & F.col("arg").isin(*CONTEXTS), 1).otherwise(0)).over(Window.partitionBy("name")))
    asked = calls.where("not spread and not is_create and not in_main and not is_local").select("seq", F.col("callee").alias("name"), "n_positional", "is_method").join(need.select("name", "arg", "kwonly", "k", "context"), "name")
    given = F.col("n_positional") + F.when(F.col("is_method") | (F.col("context") == 1), 1).otherwise(0)
    open_ = asked.where(F.col("kwonly") | (F.col("k") > given))
    return open_.join(keywords.select("seq", "arg").distinct(), ["seq", "arg"], "left_anti").select("seq", F.col("name").alias("callee"), "arg")


def field_problems(creates: DataFrame, provided: DataFrame, fields: DataFrame, choices: DataFrame) -> DataFrame:
    """(site, field, problem): everything that a creation of a model breaks.

    creates(site, model), provided(site, field, text, number): the value if it is written out, as one or the other;
    fields(model, field, required, field_type, max_length, min_value, max_value), choices(model, field, text, number).
    A missing field is a problem if it is required; a text is held against max_length and the texts among the choices,
    a number against the bounds and the numbers among them.
    """
    options = choices.groupBy("model", "field").agg(F.collect_set("text").alias("texts"), F.collect_set("number").alias("numbers"))
    own = fields.where(~F.col("field_type").isin(*RELATIONS)).join(options, ["model", "field"], "left")
    wanted = creates.select("site", "model").join(own, "model").join(provided.withColumn("given", F.lit(True)), ["site", "field"], "left")
    outside = lambda v, of: F.col(v).isNotNull() & (F.size(of) > 0) & ~F.array_contains(of, F.col(v))
    problems = F.array(
        F.when(F.col("given").isNull() & F.col("required"), "missing"),
        F.when(F.length("text") > F.col("max_length"), "too long"),
        F.when(F.col("number") < F.col("min_value"), "too small"),
        F.when(F.col("number") > F.col("max_value"), "too large"),
        F.when(outside("text", "texts") | outside("number", "numbers"), "no choice"),
    )
    return wanted.select("site", "field", F.explode(F.array_compact(problems)).alias("problem"))
