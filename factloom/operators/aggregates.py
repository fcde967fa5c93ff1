"""Aggregations over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def repeated_names(functions: DataFrame, name: str = "name") -> DataFrame:
    return functions.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def missing_by_site(missing: DataFrame) -> DataFrame:
    """missing(site, field): sorted list of fields for each site."""
    return missing.groupBy("site").agg(F.array_sort(F.collect_set("field")).alias("missing"))


def module_documents(violations: DataFrame, invariants: DataFrame) -> DataFrame:
    """(module, violations, invariants): nested lists by module, invariants(module, id, text) once for each id."""
    v = violations.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("line", "mode"))).alias("violations"))
    i = invariants.groupBy("module", "id").agg(F.min("text").alias("text")).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("invariants"))
    return v.join(i, "module", "full")


def repo_totals(corpus: DataFrame) -> DataFrame:
    """corpus(repo, stars, file, seq): rows, last stars and different files by repo."""
    return corpus.groupBy("repo").agg(F.count("*").alias("violations"), F.max_by("stars", "seq").alias("stars"), F.countDistinct("file").alias("files"))


def downstream(imports: DataFrame) -> DataFrame:
    """imports(repo, pkg, owner): different repos that use a package, other than its own."""
    return imports.where("repo <> owner or owner is null").groupBy("pkg").agg(F.countDistinct("repo").alias("downstream"))


def frequency(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """(key, n, pct of all rows), the most frequent first; ties by key."""
    total = df.groupBy().agg(F.count("*").alias("_t"))
    out = df.groupBy(key).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(key, "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("pct"))
    return out.orderBy(F.desc("n"), key).limit(top) if top else out


def repo_queue(corpus: DataFrame) -> DataFrame:
    """corpus(repo, stars, mode): n, the most frequent mode, n * ln(stars + 1) and rank by it; ties by repo."""
    m = corpus.groupBy("repo", "mode").agg(F.count("*").alias("k"), F.max("stars").alias("s"))
    r = m.groupBy("repo").agg(F.sum("k").alias("n"), F.max("s").alias("stars"), F.min(F.struct((-F.col("k")).alias("k"), "mode")).alias("m"))
    r = r.select("repo", "n", F.col("m.mode").alias("top_mode"), F.round(F.col("n") * F.log1p(F.col("stars")), 6).alias("score"))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "repo")))


def coupling_counts(imports: DataFrame, modules: DataFrame, stdlib: DataFrame) -> DataFrame:
    """modules(module) with ca, the other modules that import it (or its package), and ce, the different packages it imports from outside."""
    i = imports.select("module", "target").distinct()
    keys = modules.select("module", F.explode(F.array("module", F.regexp_replace("module", r"\.__init__$", ""))).alias("target")).distinct()
    ca = i.join(keys.withColumnRenamed("module", "used"), "target").where("module <> used").groupBy(F.col("used").alias("module")).agg(F.countDistinct(i["module"]).alias("ca"))
    outer = i.join(keys.select("target").distinct(), "target", "left_anti").withColumn("pkg", F.substring_index("target", ".", 1)).join(stdlib.select("pkg"), "pkg", "left_anti")
    ce = outer.groupBy("module").agg(F.countDistinct("pkg").alias("ce"))
    return modules.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").fillna(0, ["ca", "ce"])


def gap_frequency(gaps: DataFrame) -> DataFrame:
    """gaps(verdict, gap): rows by verdict, and its most frequent gaps, five at most."""
    g = gaps.groupBy("verdict", "gap").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("n"), "gap")))
    return g.where("r <= 5").select("verdict", "gap", "n", F.col("r").cast("long").alias("rank"))


def synthesis_report(entries: DataFrame) -> DataFrame:
    """entries(proved, has_source): totals in one row."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("has_source")).alias("with_source"), F.count_if(F.col("proved")).alias("proved"), F.count_if(F.col("has_source") & ~F.col("proved")).alias("open"))


def most_starred(entries: DataFrame, *, top: int = 10) -> DataFrame:
    """entries(repo, stars, mode): the ``top`` of the report, by stars, then repository and mode."""
    return entries.select("repo", "stars", "mode").distinct().orderBy(F.desc("stars"), "repo", "mode").limit(top)


def incremental_stats(total: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row: files in all, dirty ones, share that is skipped."""
    a, b = total.agg(F.count("*").alias("total")), dirty.agg(F.count("*").alias("dirty"))
    return a.crossJoin(b).withColumn("skip_ratio", F.round(1 - F.col("dirty") / F.greatest("total", F.lit(1)), 3))


def themes(subjects: DataFrame, *, least: int = 2, top: int = 4, shortest: int = 4) -> DataFrame:
    """Words of subjects(text), by how many rows have them."""
    w = subjects.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), 0))).alias("word")).where(F.length("word") >= shortest)
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(top)


def scaled_max(scores: DataFrame, extra: DataFrame) -> DataFrame:
    """scores(file, score) as the file's greatest over the greatest of all, six parts to four with extra(file, share)."""
    m = scores.groupBy("file").agg(F.max("score").alias("m"))
    top = m.agg(F.max("m").alias("t"))
    return m.crossJoin(F.broadcast(top)).join(extra, "file", "left").select("file", F.round(0.6 * F.col("m") / F.when(F.col("t") != 0, F.col("t")) + 0.4 * F.coalesce("share", F.lit(0.0)), 6).alias("score"))


def cover_class(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """functions(name) with the number of tests in edges(src, dst) that reach it, and its class."""
    n = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("tests"))
    return functions.select("name").distinct().join(n, "name", "left").select("name", F.coalesce("tests", F.lit(0)).alias("tests")).withColumn("cover", F.when(F.col("tests") == 0, "none").when(F.col("tests") < 3, "some").otherwise("well"))


def plan_summary(steps: DataFrame) -> DataFrame:
    """steps(status): one row of counts."""
    return steps.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")])
