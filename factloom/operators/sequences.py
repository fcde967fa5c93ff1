"""Windows, orderings and set operations over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(series: DataFrame) -> DataFrame:
    """series(path, idx, value): first and last value and (last - first) / max(1, n - 1)."""
    a = series.groupBy("path").agg(F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"), F.count("*").alias("n"))
    return a.withColumn("trend", F.round((F.col("last") - F.col("first")) / F.greatest(F.lit(1), F.col("n") - 1), 6))


def near_flag(rows: DataFrame, *, order: list[str], partition: list[str], flag: str, reach: int = 2) -> DataFrame:
    """rows with ``near``: the flag is set on a row at most ``reach`` before or after."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn("near", F.max(F.col(flag).cast("int")).over(w) == 1)


def rate(dates: DataFrame, key: str, *, days: int = 90) -> DataFrame:
    """dates(key, day): rows, days from first to last, rows a week, and rows within ``days`` of the latest day of all."""
    last = dates.agg(F.max("day").alias("_last"))
    d = dates.crossJoin(F.broadcast(last))
    a = d.groupBy(key).agg(F.count("*").alias("n"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span"), F.count_if(F.datediff("_last", "day") <= days).alias("recent"))
    return a.withColumn("per_week", F.round(F.col("n") / F.greatest(F.lit(1.0), F.col("span") / 7), 6))


def convergence(states: DataFrame, *, k: int = 3, epsilon: float = 0.01) -> DataFrame:
    """states(loop, step, fitness, fixed) with ``converged``, the last k fitnesses within epsilon, and ``stuck``, nothing fixed in the last k."""
    w = Window.partitionBy("loop").orderBy("step").rowsBetween(-(k - 1), 0)
    full = F.count("*").over(w) == k
    return states.withColumn("converged", full & ((F.max("fitness").over(w) - F.min("fitness").over(w)) < epsilon)).withColumn("stuck", full & (F.max("fixed").over(w) == 0) & (F.min("fixed").over(w) == 0))


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rerank(rows: DataFrame, *, order: list) -> DataFrame:
    """rows with ``rank`` from 1 in this total order."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def code_context(lines: DataFrame, points: DataFrame, *, reach: int = 2) -> DataFrame:
    """points(file, line) with ``context``: the lines(file, line, text) up to ``reach`` away; an equi-join on exploded offsets."""
    want = points.select("file", "line").distinct().withColumn("at", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)))
    hit = want.join(lines.select("file", F.col("line").alias("at"), "text"), ["file", "at"])
    return hit.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("context"))


def first_by_source(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in the order of parts; of rows with the same keys the first source's stays, of several there the first by line of all columns."""
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    union = ranked[0]
    for p in ranked[1:]:
        union = union.unionByName(p)
    rest = [c for c in union.columns if c not in keys and c != "source_rank"]
    w = Window.partitionBy(*keys).orderBy("source_rank", *rest)
    return union.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def until_distinct(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Rows in order up to and with the one that reaches the n-th different key; later rows of the same keys are lost too.

    The place of each key's first row is found by aggregation; only the n least of them are ever gathered.
    """
    placed = rows.withColumn("_place", F.struct(*order))
    firsts = placed.groupBy(key).agg(F.min("_place").alias("_p")).orderBy("_p").limit(n)
    limit = firsts.agg(F.max("_p").alias("_last"))
    return placed.crossJoin(F.broadcast(limit)).where(F.col("_place") <= F.col("_last")).drop("_place", "_last")


def topological_levels(steps: DataFrame) -> DataFrame:
    """steps(step, depends_on array) with ``level``: 0 without needs, else one more than the greatest of them; steps on a cycle get null."""
    from factloom.plans.scratch import Scratch

    with Scratch(steps.sparkSession) as s:
        need = s.keep(steps.select("step", F.explode("depends_on").alias("dep")).distinct())
        todo = s.keep(steps.select("step").distinct())
        known = todo.where("false")
        done = None
        level = 0
        while True:
            open_need = need.join(done.select(F.col("step").alias("dep")), "dep", "left_anti") if done is not None else need
            ready = s.keep(todo.join(open_need.select("step"), "step", "left_anti").withColumn("level", F.lit(level)))
            if ready.isEmpty():
                break
            done = ready if done is None else s.keep(done.unionByName(ready))
            todo = s.keep(todo.join(ready.select("step"), "step", "left_anti"))
            level += 1
        rest = todo.withColumn("level", F.lit(None).cast("int"))
        return rest if done is None else done.unionByName(rest)


def common_arguments(observations: DataFrame) -> DataFrame:
    """observations(function, obs, args array): arguments that every observation of a function has."""
    n = observations.groupBy("function").agg(F.count("*").alias("total"))
    a = observations.select("function", "obs", F.explode(F.array_distinct("args")).alias("arg")).groupBy("function", "arg").agg(F.count("*").alias("k"))
    return a.join(n, "function").where("k = total").select("function", "arg")
