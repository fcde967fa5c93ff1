"""Joins between facts. All take and return DataFrames; inputs keep the column names given in each docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.plans.iterate import spread
from factloom.plans.scratch import Scratch


def required_fields(creates: DataFrame, requires: DataFrame) -> DataFrame:
    """creates(site, model) with requires(model, field): (site, model, field)."""
    return creates.join(requires.distinct(), "model").select("site", "model", "field")


def not_provided(wanted: DataFrame, provides: DataFrame) -> DataFrame:
    """Rows of wanted(site, field, ...) that no provides(site, field) answers."""
    return wanted.join(provides, ["site", "field"], "left_anti")


def unguarded_results(variables: DataFrame, accesses: DataFrame) -> DataFrame:
    """variables(scope, var) met by accesses(scope, var, attr), each once."""
    return variables.select("scope", "var").join(accesses.select("scope", "var", "attr"), ["scope", "var"]).distinct()


def unique_names(functions: DataFrame, name: str = "name") -> DataFrame:
    """Rows of functions whose name is defined once in the whole codebase; one aggregation, no self-join."""
    return functions.groupBy(name).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in functions.columns if c != name]).where("_n = 1").drop("_n").select(*functions.columns)


def resolve_unique(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(callee, ...) with functions(name, ...) where the callee is defined once."""
    return calls.join(unique_names(functions), calls["callee"] == F.col("name"))


def enclosing(points: DataFrame, functions: DataFrame, *, tie: str = "name") -> DataFrame:
    """points(file, line, ...) with ``func``: of functions(file, line, name) in the file, the last begun at or before the line.

    Union and one running window per file: every row is shuffled once by file, however many functions a
    file has. Functions on one line: the greatest ``tie`` wins. Points before any function get null.
    """
    cols = points.columns
    a = points.withColumns({"_kind": F.lit(1), "_name": F.lit(None).cast("string"), "_tie": F.lit(None).cast(functions.schema[tie].dataType)})
    b = functions.select("file", "line", F.lit(0).alias("_kind"), F.col("name").alias("_name"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy("file").orderBy("line", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("func", F.last("_name", ignorenulls=True).over(upto)).where("_kind = 1").select(*cols, "func")


def function_ranges(functions: DataFrame) -> DataFrame:
    """functions(file, line, name) with ``next_line``, null for the last of a file."""
    return functions.withColumn("next_line", F.lead("line").over(Window.partitionBy("file").orderBy("line", "name")))


def within_functions(functions: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of a function and the points(file, line, ...) from its line to that of the next.

    Each point stands in one function at most, so this is ``enclosing``: one window, and no pair that isn't kept.
    """
    return enclosing(points.select("file", "line"), functions).where("func is not null").select("file", F.col("func").alias("name"), "line")


def attribute_to_callers(points: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """points(file, line) with ``func``: the known caller of the last call(file, line, caller, seq) on that very line, else the enclosing function."""
    on_line = calls.groupBy("file", "line").agg(F.max_by("caller", "seq").alias("caller"))
    known = on_line.join(functions.select(F.col("name").alias("caller")).distinct(), "caller", "left_semi")
    return enclosing(points, functions).join(known, ["file", "line"], "left").withColumn("func", F.coalesce("caller", "func")).drop("caller")


def commits_gathered(files: DataFrame, s: Scratch) -> DataFrame:
    """(paths) of each commit of files(sha, path), each path once and in order, gathered in as many tasks as the counted rows ask for; it lives with ``s``."""
    f = s.save(files.select("sha", "path").where("sha is not null and path is not null"))
    return s.save(spread(f, f.count(), "sha").distinct().groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("paths")).select("paths"))


def pairs_of(gathered: DataFrame) -> DataFrame:
    """(a, b, n) of commits_gathered; a commit's pairs are counted before they leave its task."""
    one = gathered.where(F.size("paths") > 1).select("paths", F.posexplode("paths").alias("i", "a"))
    return one.select("a", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def co_changes(files: DataFrame) -> DataFrame:
    """(a, b, n): commits of files(sha, path) that touch both, a < b."""
    with Scratch(files.sparkSession) as s:
        return s.keep(pairs_of(commits_gathered(files, s)))


def suffix_match(refs: DataFrame, files: DataFrame, *, least: int = 2, most: int = 5) -> DataFrame:
    """refs(ref) with the file(path) sharing the longest path suffix of least to most parts; an equi-join on exploded suffixes.

    Of equally long matches the least path.
    """

    def suffixes(df: DataFrame, col: str) -> DataFrame:
        parts = F.split(F.col(col), "/")
        n = F.least(F.size(parts), F.lit(most))
        every = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, -k, k), "/").alias("s")))
        return df.select(col, F.explode(every).alias("x")).select(col, "x.k", "x.s").where(F.col("k") >= least)

    hit = suffixes(refs.select("ref").distinct(), "ref").join(suffixes(files.select("path").distinct(), "path").drop("k"), "s")
    return hit.groupBy("ref").agg(F.min(F.struct((-F.col("k")).alias("k"), "path")).alias("m")).select("ref", F.col("m.path").alias("path"), (-F.col("m.k")).alias("parts"))


def in_files(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file is among changed(file)."""
    return rows.join(changed.select("file").distinct(), "file", "left_semi").select(*rows.columns)


def confirm(violations: DataFrame, proofs: DataFrame) -> DataFrame:
    """violations(file, line, mode) with ``spec_id`` of proofs(file, line, mode, spec_id) on the same line; proofs of other lines are added."""
    at = proofs.groupBy("file", "line").agg(F.min("spec_id").alias("spec_id"))
    known = violations.join(at, ["file", "line"], "left").select("file", "line", "mode", "spec_id")
    return known.unionByName(proofs.join(violations, ["file", "line"], "left_anti").select("file", "line", "mode", "spec_id"))


def not_seen_anywhere(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of found whose (file, mode, call) isn't seen at any line."""
    return found.join(seen, ["file", "mode", "call"], "left_anti")


def resolve_imports(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): calls(src, file, name) to functions(func_id, file, name): an explicit import(file, name, target) first, then the same file, then all of that name.

    The different (file, name) of calls are resolved once, whatever stands behind the inputs, and joined back.
    """
    with Scratch(calls.sparkSession) as s:
        all_ = s.keep(calls.select("src", "file", "name").distinct())
        f = s.keep(functions.select("func_id", "file", "name"))
        c = s.keep(all_.select("file", "name").distinct())
        at = f.select("file", "name", F.col("func_id").alias("dst"))
        by_import = s.keep(c.join(imports.select("file", "name", "target").distinct(), ["file", "name"]).join(at.withColumnRenamed("file", "target"), ["target", "name"]).select("file", "name", "dst"))
        left = c.join(by_import, ["file", "name"], "left_anti")
        same = s.keep(left.join(at, ["file", "name"]))
        rest = left.join(same, ["file", "name"], "left_anti").join(at.select("name", "dst"), "name").select("file", "name", "dst")
        return all_.join(by_import.unionByName(same).unionByName(rest), ["file", "name"]).select("src", "dst").distinct()


def call_edges(calls: DataFrame, functions: DataFrame, *, root: str = "__root__") -> DataFrame:
    """(src, dst), each once: a callee that is no function's name goes to the one function of that short name, if it is one; else it stays."""
    short = functions.select("name").distinct().withColumn("short", fn.short_name(F.col("name")))
    single = short.groupBy("short").agg(F.count("*").alias("n"), F.first("name").alias("full")).where("n = 1").drop("n")
    known = functions.select(F.col("name").alias("callee"), F.lit(True).alias("known")).distinct()
    c = calls.select(F.coalesce("caller", F.lit(root)).alias("src"), "callee").distinct().join(known, "callee", "left").join(single, F.col("callee") == F.col("short"), "left")
    return c.select("src", F.when(F.col("known"), F.col("callee")).otherwise(F.coalesce("full", "callee")).alias("dst")).distinct()


def _first_short(functions: DataFrame) -> DataFrame:
    """(short, full): of the functions(name, seq) of a short name the first."""
    return functions.groupBy(fn.short_name(F.col("name")).alias("short")).agg(F.min_by("name", F.struct("seq", "name")).alias("full"))


def _resolved(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls with ``dst``: the callee if it is a function, else the first function of its short name, else the callee."""
    known = functions.select(F.col("name").alias("callee"), F.lit(True).alias("_known")).distinct()
    c = calls.join(known, "callee", "left").withColumn("_short", fn.short_name(F.col("callee"))).join(_first_short(functions), F.col("_short") == F.col("short"), "left")
    return c.withColumn("dst", F.when(F.col("_known"), F.col("callee")).otherwise(F.coalesce("full", "callee"))).drop("_known", "_short", "short", "full")


def call_graph(calls: DataFrame, functions: DataFrame, *, root: str = "__root__") -> DataFrame:
    """(src, dst, seq): the edges of calls(seq, caller, callee) with the last call site of each; short names go to the first of functions(name, seq)."""
    return _resolved(calls, functions).groupBy(F.coalesce("caller", F.lit(root)).alias("src"), "dst").agg(F.max("seq").alias("seq"))


def drawn_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst), each once: calls of a known caller, resolved as in ``call_graph``, of which one end at least is a known function."""
    known = functions.select("name").distinct()
    e = _resolved(calls.where("caller is not null"), functions).select(F.col("caller").alias("src"), "dst").distinct()
    a = e.join(known.select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst")
    return a.unionByName(e.join(known.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")).distinct()


def raw_edges(calls: DataFrame) -> DataFrame:
    """(src, dst), each once, by the names as they are written."""
    return calls.where("caller is not null and callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def package_repository(packages: DataFrame, known: DataFrame, repos: DataFrame) -> DataFrame:
    """packages(pkg) with repo: from known(pkg, repo), else the least of repos(repo) whose last part is the same name apart from - _ . and case."""
    norm = repos.select("repo", fn.normal_name(F.element_at(F.split("repo", "/"), -1)).alias("_n")).groupBy("_n").agg(F.min("repo").alias("_r"))
    p = packages.select("pkg").distinct().join(known, "pkg", "left").withColumn("_n", fn.normal_name(F.col("pkg")))
    return p.join(norm, "_n", "left").select("pkg", F.coalesce("repo", "_r").alias("repo"))


def upstream_hits(imports: DataFrame, upstream: DataFrame) -> DataFrame:
    """imports(pkg) with upstream(pkg, repo, leverage): the first hit of each repo, by pkg."""
    hit = imports.select("pkg").distinct().join(upstream, "pkg")
    return hit.groupBy("repo").agg(F.min(F.struct("pkg", "leverage")).alias("m")).select("repo", "m.pkg", "m.leverage")


def tests_of_modules(tests: DataFrame, modules: DataFrame) -> DataFrame:
    """(test, module): tests(test) whose stem without ``test_`` is, or holds, the module's stem.

    An equality join: of each test's stem the stretches of those lengths that modules' stems have are its keys. Stems
    are names of files, so there are a few hundred lengths at most, and a test has no more keys than its stem squared.
    """
    t = tests.select("test", F.regexp_replace(fn.stem(F.col("test")), "^test_", "").alias("_t")).distinct()
    m = modules.select("module", fn.stem(F.col("module")).alias("_m")).distinct()
    lengths = sorted(r[0] for r in m.select(F.length("_m")).distinct().collect())
    if not lengths:
        return t.select("test", F.lit(None).cast("string").alias("module")).limit(0)
    parts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_t")), lambda n: F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda i: F.substring(F.col("_t"), i, n)))
    keys = t.select("test", F.explode(F.array_distinct(F.flatten(parts))).alias("_m"))
    return keys.join(m, "_m").select("test", "module").distinct()


def test_to_production(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst) of edges from a function(name, file) in a test file to one in a production file, by name or short name."""
    marked = functions.select("name", fn.is_test_file(F.col("file")).alias("t")).distinct()
    src = marked.where("t").select(F.col("name").alias("src"))
    prod = marked.where("not t").select(F.explode(F.array("name", fn.short_name(F.col("name")))).alias("dst")).distinct()
    return edges.select("src", "dst").distinct().join(src, "src", "left_semi").join(prod, "dst", "left_semi").select("src", "dst")


def contract_coverage(cut_files: DataFrame, contracts: DataFrame) -> DataFrame:
    """cut_files(file) with ``covered``: its path or its base name is among contracts(file)."""
    c = contracts.select(F.col("file").alias("_c")).distinct()
    f = cut_files.select("file").distinct()
    by_path = f.join(c, F.col("file") == F.col("_c"), "left_semi").select("file")
    by_name = f.join(c, fn.basename(F.col("file")) == F.col("_c"), "left_semi").select("file")
    hit = by_path.union(by_name).distinct().withColumn("covered", F.lit(True))
    return f.join(hit, "file", "left").select("file", F.coalesce("covered", F.lit(False)).alias("covered"))


def locate_in_graph(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """records(rid, file, func) with ``node`` of nodes(node, file, func): same base name and function, else the function if it is the only one of its name."""
    exact = nodes.groupBy(fn.basename(F.col("file")).alias("_b"), "func").agg(F.min("node").alias("_x"))
    single = nodes.groupBy("func").agg(F.count("*").alias("_n"), F.min("node").alias("_s")).where("_n = 1").drop("_n")
    r = records.withColumn("_b", fn.basename(F.col("file"))).join(exact, ["_b", "func"], "left").join(single, "func", "left")
    return r.select("rid", "file", "func", F.coalesce("_x", "_s").alias("node"))


def record_evidence(docs: DataFrame, files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc, path): back-ticked ``.py`` references of docs(doc, text) to files(path), by path or base name; with classes(name, path) also names of two humps or more to where they are defined."""
    ref = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z0-9_/.-]+\.py)`"), 1)).alias("ref")).distinct()
    keys = files.select("path", F.explode(F.array("path", fn.basename(F.col("path")))).alias("ref")).distinct()
    found = ref.join(keys, "ref").select("doc", "path")
    if classes is not None:
        humps = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), 1)).alias("name")).distinct()
        found = found.unionByName(humps.join(classes.select("name", "path").distinct(), "name").select("doc", "path"))
    return found.distinct()
