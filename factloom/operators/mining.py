"""Repository mining: churn, hotspots, coupling, ownership, entropy, leverage, invariants, module metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.operators import aggregates, joins, sequences
from factloom.plans.scratch import Scratch


def churn(files: DataFrame) -> DataFrame:
    return files.select("sha", "path").distinct().groupBy("path").agg(F.count("*").alias("churn"))


def hotspots(files: DataFrame, series: DataFrame) -> DataFrame:
    """Churn times the latest of series(path, idx, value), where that is positive, with its trend."""
    return churn(files).join(sequences.trend(series).where("last > 0"), "path").select("path", "churn", F.col("last").alias("complexity"), "trend", (F.col("churn") * F.col("last")).alias("score"))


def coupling(files: DataFrame, *, least: int = 3, share: float = 0.30) -> DataFrame:
    """Pairs changed together at least so often and in at least this share of either one's commits."""
    with Scratch(files.sparkSession) as s:
        gathered = joins.commits_gathered(files, s)
        c = s.keep(gathered.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("churn")))
        pairs = s.keep(joins.pairs_of(gathered).where(F.col("n") >= least))
    both = pairs.join(c.select(F.col("path").alias("a"), F.col("churn").alias("ca")), "a").join(c.select(F.col("path").alias("b"), F.col("churn").alias("cb")), "b")
    strength = F.least(F.col("n") / F.col("ca"), F.col("n") / F.col("cb"))
    return both.select("a", "b", "n", F.round(strength, 6).alias("strength")).where(F.col("strength") >= share)


def silos(files: DataFrame, *, least: int = 4, top_share: float = 0.80, minor_share: float = 0.05, minors: int = 3, minors_least: int = 5) -> DataFrame:
    """Files of at least ``least`` commits by one dominant author, or by many minor ones."""
    f = files.select("sha", "path", "author").distinct().groupBy("path", "author").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy("path"))
    a = f.withColumn("t", total).groupBy("path").agg(F.max("t").alias("churn"), F.max(F.col("k") / F.col("t")).alias("top"), F.count_if(F.col("k") / F.col("t") < minor_share).alias("minor"))
    return a.where((F.col("churn") >= least) & ((F.col("top") > top_share) | ((F.col("minor") >= minors) & (F.col("churn") >= minors_least)))).select("path", "churn", F.round("top", 6).alias("top_share"), F.col("minor").alias("minor_authors"))


def change_entropy(files: DataFrame) -> DataFrame:
    """Sum over a file's commits of -p * log2(p), where p is one over the number of files in the commit."""
    f = files.select("sha", "path").distinct()
    p = 1 / F.count("*").over(Window.partitionBy("sha"))
    return f.withColumn("p", p).groupBy("path").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 4).alias("entropy"))


def bug_density(files: DataFrame, blame: DataFrame) -> DataFrame:
    """Different introducing commits of blame(path, intro_sha) over churn."""
    b = blame.groupBy("path").agg(F.countDistinct("intro_sha").alias("bugs"))
    return churn(files).join(b, "path").select("path", "bugs", F.round(F.col("bugs") / F.col("churn"), 6).alias("density"))


def intent_edges(issues: DataFrame, prs: DataFrame, pr_files: DataFrame, records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, rel, strength, co_changes): issues(issue, path), prs(pr, issue), pr_files(pr, path), records(record, path), pairs(a, b, strength, n)."""
    none = F.lit(None).cast("double").alias("strength"), F.lit(None).cast("long").alias("co_changes")

    def edge(df: DataFrame, src: Column, dst: Column, rel: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), *none).distinct()

    tag = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    parts = [edge(records, tag("adr", "record"), tag("file", "path"), "COVERS"), edge(issues, tag("issue", "issue"), tag("file", "path"), "MENTIONS"), edge(pr_files, tag("pr", "pr"), tag("file", "path"), "MODIFIES"), edge(prs, tag("pr", "pr"), tag("issue", "issue"), "REFERENCES")]
    parts.append(pairs.select(tag("file", "a").alias("src"), tag("file", "b").alias("dst"), F.lit("COUPLED_WITH").alias("rel"), "strength", F.col("n").cast("long").alias("co_changes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intent_coverage(files: DataFrame, records: DataFrame, tickets: DataFrame, tests: DataFrame) -> DataFrame:
    """files(path) with ``level``, from the paths that decision records, tickets and tests name."""

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("path").distinct().withColumn(name, F.lit(True))

    f = files.select("path").distinct()
    for df, name in ((records, "r"), (tickets, "t"), (tests, "s")):
        f = f.join(mark(df, name), "path", "left")
    return f.select("path", fn.coverage_level(F.col("r"), F.col("t"), F.col("s")).alias("level"))


def leverage(corpus: DataFrame, imports: DataFrame) -> DataFrame:
    """Repository's violations * ln(1 + stars) * (1 + repositories downstream of its package, which is named like it)."""
    d = aggregates.downstream(imports).withColumnRenamed("pkg", "repo")
    return aggregates.repo_totals(corpus).join(d, "repo", "left").fillna(0, ["downstream"]).select("repo", "violations", "stars", "downstream", F.round(F.col("violations") * F.log1p("stars") * (1 + F.col("downstream")), 4).alias("score"))


def invariants(observations: DataFrame, arguments: DataFrame, *, least: int = 3) -> DataFrame:
    """(function, template, variable, call_count): templates that hold in every clean observation.

    observations(function, obs, result double, raised, size), arguments(function, obs, arg, value double, holds); size is
    the length of a result that has one, holds whether the argument is a collection with the result in it. A null
    result or value fails a comparison. Only arguments that all clean observations have count.
    """
    clean = observations.where("not raised")
    n = clean.groupBy("function").agg(F.count("*").alias("call_count")).where(F.col("call_count") >= least)
    clean = clean.join(n, "function")
    true = lambda c: F.coalesce(c, F.lit(False))
    single = clean.groupBy("function", "call_count").agg(F.bool_and(true(F.col("result") >= 0)).alias("nonneg"), F.bool_and(F.col("result").isNotNull()).alias("notnull"), F.bool_and(true(F.col("size") >= 0)).alias("sized"))
    alone = single.select("function", "call_count", F.explode(F.array(F.struct(F.lit("result >= 0").alias("template"), F.col("nonneg").alias("ok")), F.struct(F.lit("result is not None").alias("template"), F.col("notnull").alias("ok")), F.struct(F.lit("len(result) >= 0").alias("template"), F.col("sized").alias("ok")))).alias("x")).where("x.ok").select("function", "x.template", F.lit("result").alias("variable"), "call_count")
    a = clean.select("function", "obs", "result", "call_count").join(arguments, ["function", "obs"])
    per = a.groupBy("function", "call_count", "arg").agg(F.count("*").alias("k"), F.bool_and(true(F.col("result") == F.col("value"))).alias("eq"), F.bool_and(true(F.col("result") >= F.col("value"))).alias("ge"), F.bool_and(true(F.col("result") <= F.col("value"))).alias("le"), F.bool_and(true(F.col("holds"))).alias("holds")).where("k = call_count")
    kinds = [("eq", "result == arg"), ("ge", "result >= arg"), ("le", "result <= arg"), ("holds", "result in arg")]
    against = per.select("function", "arg", "call_count", F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.col(c).alias("ok")) for c, t in kinds])).alias("x")).where("x.ok").select("function", "x.template", F.col("arg").alias("variable"), "call_count")
    x, y = a.alias("x"), arguments.alias("y")
    two = x.join(y, (F.col("x.function") == F.col("y.function")) & (F.col("x.obs") == F.col("y.obs")) & (F.col("x.arg") < F.col("y.arg")))
    pair = two.groupBy(F.col("x.function").alias("function"), F.col("x.call_count").alias("call_count"), F.col("x.arg").alias("a"), F.col("y.arg").alias("b")).agg(F.count("*").alias("k"), F.bool_and(true(F.col("x.value") <= F.col("y.value"))).alias("le"), F.bool_and(true(F.col("x.value") == F.col("y.value"))).alias("eq"), F.bool_and(true(F.col("y.value") - F.col("x.value") >= 0)).alias("diff")).where("k = call_count")
    kinds = [("le", "a <= b"), ("eq", "a == b"), ("diff", "b - a >= 0")]
    pairs = pair.select("function", "a", "b", "call_count", F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.col(c).alias("ok")) for c, t in kinds])).alias("x")).where("x.ok").select("function", "x.template", F.concat_ws(",", "a", "b").alias("variable"), "call_count")
    return alone.unionByName(against).unionByName(pairs)


def module_metrics(imports: DataFrame, modules: DataFrame, stdlib: DataFrame) -> DataFrame:
    """modules(module, classes, abstract): ca, ce, instability, abstractness, distance from the main sequence, zone."""
    m = aggregates.coupling_counts(imports, modules, stdlib).join(modules, "module")
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    a = F.when(F.col("classes") > 0, F.col("abstract") / F.col("classes")).otherwise(0.0)
    m = m.withColumn("i", i).withColumn("a", a).withColumn("d", F.abs(F.col("i") + F.col("a") - 1))
    return m.select("module", "ca", "ce", F.round("i", 6).alias("instability"), F.round("a", 6).alias("abstractness"), F.round("d", 6).alias("distance"), fn.zone(F.col("i"), F.col("a"), F.col("d")).alias("zone"))


def refactor_scores(attributed: DataFrame, calls: DataFrame, *, top: int | None = None) -> DataFrame:
    """Violations of attributed(func, ...) over different callers in calls(callee, caller, file), the highest first."""
    v = attributed.where("func is not null").groupBy("func").agg(F.count("*").alias("violations"))
    c = calls.groupBy(F.col("callee").alias("func")).agg(F.countDistinct(F.coalesce("caller", F.concat(F.lit("__module__:"), "file"))).alias("callers"))
    out = v.join(c, "func", "left").fillna(0, ["callers"]).withColumn("score", F.round(F.col("violations") / F.greatest(F.lit(1), "callers"), 6)).orderBy(F.desc("score"), "func")
    return out.limit(top) if top else out


def extraction_safe(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions(name, required, kwonly array) is safe if no call of calls(callee, n_positional, kwargs array) gives too few or misses a keyword."""
    j = functions.join(calls, F.col("name") == F.col("callee"), "left")
    bad = F.col("callee").isNotNull() & ((F.col("n_positional") < F.col("required")) | (F.size(F.array_except("kwonly", "kwargs")) > 0))
    return j.groupBy("name").agg((F.count_if(bad) == 0).alias("safe"))


REVERT, READD = r"(?i)\brevert\b", r"(?i)\b(restore|readd|re-add|reimplement|re-introduce|re-implement)\b"
FIX, ENSURE, VERIFY = r"(?i)\b(bug|correct|repair|fix|fixed|fixes)\b", r"(?i)\b(always|enforce|must|ensure|guarantee)\b", r"(?i)\b(assert|check|proof|spec|test|verify)\b"


def history_patterns(commits: DataFrame) -> DataFrame:
    """commits(file, idx, subject) with flags: a revert, a re-add, a fix, and a promise that no check is near (two commits of the file before and after)."""
    flags = {k: fn.words(F.col("subject"), x) for k, x in (("revert", REVERT), ("readd", READD), ("fix", FIX), ("ensure", ENSURE), ("verify", VERIFY))}
    near = sequences.near_flag(commits.select("file", "idx", "subject", *[x.alias(k) for k, x in flags.items()]), order=["idx"], partition=["file"], flag="verify")
    return near.select("file", "idx", "revert", "readd", "fix", (F.col("ensure") & ~F.col("near")).alias("unverified"))


STOP = "a an be if in is it of or to add and are fix for had has its not now the was also been feat from have only that this were when with chore fixed fixes remove update refactor".split()


def repeated_fixes(commits: DataFrame, *, fixes: int = 3, least: int = 2, top: int = 4) -> DataFrame:
    """(file, word, n, rank): of files with ``fixes`` fixes or more in commits(file, idx, subject) the words that recur in them, the most frequent first."""
    f = commits.where(fn.words(F.col("subject"), FIX)).select("file", "idx", "subject")
    f = f.join(f.groupBy("file").agg(F.count("*").alias("k")).where(F.col("k") >= fixes).select("file"), "file", "left_semi")
    bare = F.lower(F.regexp_replace("subject", r"^[a-z]+[(]([^()]+)[)]:", "$1 "))
    words = f.select("file", F.explode(F.split(bare, r"[,.:+/_\s-]+")).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*STOP))
    n = words.groupBy("file", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)


def commit_density(commits: DataFrame, *, much: float = 2.0, many: int = 20, days: int = 90) -> DataFrame:
    """(file, n, span, per_week, recent, density) of commits(file, day): ``high`` from ``much`` a week on, else ``stated`` from ``many`` commits on."""
    r = commits.groupBy("file").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.datediff(F.max("day"), F.min("day"))).alias("span"), F.max("day").alias("last"))
    late = commits.join(r.select("file", "last"), "file").where(F.datediff("last", "day") <= days).groupBy("file").agg(F.count("*").alias("recent"))
    r = r.join(late, "file").withColumn("per_week", F.round(F.col("n") / F.greatest(F.lit(1.0), F.col("span") / 7), 6))
    return r.select("file", "n", "span", "per_week", "recent", F.when(F.col("per_week") >= much, "high").when(F.col("n") >= many, "stated").alias("density"))
