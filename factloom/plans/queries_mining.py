"""Repository mining: churn, coupling, ownership, leverage, invariants, metrics, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.operators import joins, mining
from factloom.plans.catalog import query
from factloom.plans.facts import Facts, commit_paths
from factloom.plans.queries_relational import _COUPLING

_CHURN = "f AS (SELECT DISTINCT sha, path FROM {commit_files}), churn AS (SELECT path, CAST(count(*) AS BIGINT) AS churn FROM f GROUP BY path)"


@query("m01_churn", f"WITH {_CHURN} SELECT path, churn FROM churn")
def churn(f: Facts) -> DataFrame:
    return mining.churn(f.commit_files)


@query("m02_hotspots", f"""WITH {_CHURN}, t AS (SELECT path, arg_max(value, idx) AS last, round((arg_max(value, idx) - arg_min(value, idx)) / greatest(1, count(*) - 1), 6) AS trend FROM {{series}} GROUP BY path)
SELECT path, churn, last AS complexity, trend, churn * last AS score FROM churn JOIN t USING (path) WHERE last > 0""")
def hotspots(f: Facts) -> DataFrame:
    return mining.hotspots(f.commit_files, f.series)


_PAIRS = "p AS (SELECT x.path AS a, y.path AS b, count(*) AS n FROM f x JOIN f y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2)"
_STRONG = f"{_CHURN}, {_PAIRS}, s AS (SELECT p.a, p.b, CAST(n AS BIGINT) AS n, round(least(n * 1.0 / x.churn, n * 1.0 / y.churn), 6) AS strength FROM p JOIN churn x ON p.a = x.path JOIN churn y ON p.b = y.path WHERE n >= 3)"


@query("m03_coupling", f"WITH {_STRONG} SELECT a, b, n, strength FROM s WHERE strength >= 0.14")
def coupling(f: Facts) -> DataFrame:
    return mining.coupling(commit_paths(f), share=0.14)


@query("m04_silos", """WITH k AS (SELECT path, author, count(DISTINCT sha) AS k FROM {commit_files} GROUP BY 1, 2), t AS (SELECT path, CAST(sum(k) AS BIGINT) AS churn, max(k) * 1.0 / sum(k) AS top FROM k GROUP BY path)
SELECT path, churn, round(top, 6) AS top_share, CAST(0 AS BIGINT) AS minor_authors FROM t WHERE churn >= 4 AND top > 0.21""")
def silos(f: Facts) -> DataFrame:
    return mining.silos(f.commit_files, top_share=0.21)


@query("m04_minor_authors", """WITH cf AS (SELECT DISTINCT l.l_orderkey AS sha, p.p_brand AS path, o.o_custkey AS author FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey),
k AS (SELECT path, author, count(*) AS k FROM cf GROUP BY 1, 2), t AS (SELECT path, sum(k) AS churn, max(k) * 1.0 / sum(k) AS top FROM k GROUP BY path), m AS (SELECT t.path, count_if(k.k * 1.0 / t.churn < 0.05) AS minor FROM k JOIN t ON t.path = k.path GROUP BY 1)
SELECT t.path, CAST(t.churn AS BIGINT) AS churn, round(t.top, 6) AS top_share, CAST(m.minor AS BIGINT) AS minor_authors FROM t JOIN m ON m.path = t.path WHERE t.churn >= 4 AND (t.top > 0.8 OR (m.minor >= 3 AND t.churn >= 5))""")
def minor_authors(f: Facts) -> DataFrame:
    """The rule's other branch: a commit's author is its customer, of whom a file has many."""
    files = f.lineitem.join(f.part, F.col("p_partkey") == F.col("l_partkey")).join(f.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return mining.silos(files.select(F.col("l_orderkey").alias("sha"), F.col("p_brand").alias("path"), F.col("o_custkey").alias("author")))


@query("m05_change_entropy", """WITH f AS (SELECT DISTINCT sha, path FROM {commit_files}), p AS (SELECT path, 1.0 / count(*) OVER (PARTITION BY sha) AS p FROM f) SELECT path, round(sum(-p * log2(p)), 4) AS entropy FROM p GROUP BY path""")
def change_entropy(f: Facts) -> DataFrame:
    return mining.change_entropy(f.commit_files)


@query("m06_bug_density", f"WITH {_CHURN}, b AS (SELECT path, CAST(count(DISTINCT intro_sha) AS BIGINT) AS bugs FROM {{blame}} GROUP BY path) SELECT path, bugs, round(bugs * 1.0 / churn, 6) AS density FROM churn JOIN b USING (path)")
def bug_density(f: Facts) -> DataFrame:
    return mining.bug_density(f.commit_files, f.blame)


@query("m07_intent_edges", f"""WITH {_STRONG}, e AS (
SELECT DISTINCT 'adr:' || CAST(p_size AS STRING) AS src, 'file:' || p_brand AS dst, 'COVERS' AS rel, NULL::DOUBLE AS strength, NULL::BIGINT AS co_changes FROM {{part}}
UNION ALL SELECT DISTINCT 'issue:' || CAST(o_orderkey AS STRING), 'file:' || o_orderpriority, 'MENTIONS', NULL, NULL FROM {{orders}}
UNION ALL SELECT DISTINCT 'pr:' || CAST(l_orderkey AS STRING), 'file:' || l_returnflag, 'MODIFIES', NULL, NULL FROM {{lineitem}}
UNION ALL SELECT DISTINCT 'pr:' || CAST(o_orderkey AS STRING), 'issue:' || CAST(o_custkey AS STRING), 'REFERENCES', NULL, NULL FROM {{orders}}
UNION ALL SELECT 'file:' || a, 'file:' || b, 'COUPLED_WITH', strength, n FROM s WHERE strength >= 0.14) SELECT * FROM e""")
def intent_edges(f: Facts) -> DataFrame:
    issues = f.orders.select(F.col("o_orderkey").alias("issue"), F.col("o_orderpriority").alias("path"))
    prs = f.orders.select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("issue"))
    pr_files = f.lineitem.select(F.col("l_orderkey").alias("pr"), F.col("l_returnflag").alias("path"))
    return mining.intent_edges(issues, prs, pr_files, f.part.select(F.col("p_size").alias("record"), F.col("p_brand").alias("path")), mining.coupling(commit_paths(f), share=0.14))


@query("m08_intent_coverage", """SELECT DISTINCT file AS path, CASE WHEN file IN (SELECT file FROM {functions} WHERE line % 5 = 0) THEN 3.0 WHEN file LIKE 'pkg1%' THEN 2.0 WHEN file LIKE '%test%' THEN 1.5 ELSE 0.0 END AS level FROM {functions}""")
def intent_coverage(f: Facts) -> DataFrame:
    p = f.functions.select(F.col("file").alias("path"), "line")
    return mining.intent_coverage(p, p.where("line % 5 = 0"), p.where("path like 'pkg1%'"), p.where("path like '%test%'"))


@query("m09_leverage", """WITH d AS (SELECT pkg AS repo, count(DISTINCT repo) AS downstream FROM {repo_imports} WHERE repo <> owner GROUP BY pkg), t AS (SELECT repo, count(*) AS violations, arg_max(stars, seq) AS stars FROM {corpus} GROUP BY repo)
SELECT repo, CAST(violations AS BIGINT) AS violations, stars, CAST(coalesce(downstream, 0) AS BIGINT) AS downstream, round(violations * ln(1 + stars) * (1 + coalesce(downstream, 0)), 4) AS score FROM t LEFT JOIN d USING (repo)""")
def leverage(f: Facts) -> DataFrame:
    return mining.leverage(f.corpus, f.repo_imports)


@query("m10_invariants", """WITH o AS (SELECT * FROM {observations} WHERE NOT raised), n AS (SELECT function, count(*) AS call_count FROM o GROUP BY function HAVING count(*) >= 3), c AS (SELECT o.*, n.call_count FROM o JOIN n USING (function)),
s AS (SELECT function, call_count, bool_and(coalesce(result >= 0, false)) AS p1, bool_and(result IS NOT NULL) AS p2, bool_and(coalesce(size >= 0, false)) AS p3 FROM c GROUP BY 1, 2),
a AS (SELECT c.function, c.obs, c.result, c.call_count, a.arg, a.value, a.holds FROM c JOIN {arguments} a ON a.function = c.function AND a.obs = c.obs),
r AS (SELECT function, call_count, arg, bool_and(result = value) AS eq, bool_and(result >= value) AS ge, bool_and(result <= value) AS le, bool_and(coalesce(holds, false)) AS ho FROM a GROUP BY 1, 2, 3 HAVING count(*) = call_count),
t AS (SELECT x.function, x.call_count, x.arg AS a, y.arg AS b, bool_and(x.value <= y.value) AS le, bool_and(x.value = y.value) AS eq, bool_and(y.value - x.value >= 0) AS diff FROM a x JOIN a y ON x.function = y.function AND x.obs = y.obs AND x.arg < y.arg GROUP BY 1, 2, 3, 4 HAVING count(*) = x.call_count)
SELECT function, 'result >= 0' AS template, 'result' AS variable, CAST(call_count AS BIGINT) AS call_count FROM s WHERE p1 UNION ALL SELECT function, 'result is not None', 'result', call_count FROM s WHERE p2 UNION ALL SELECT function, 'len(result) >= 0', 'result', call_count FROM s WHERE p3 UNION ALL SELECT function, 'result in arg', arg, call_count FROM r WHERE ho
UNION ALL SELECT function, 'result == arg', arg, call_count FROM r WHERE eq UNION ALL SELECT function, 'result >= arg', arg, call_count FROM r WHERE ge UNION ALL SELECT function, 'result <= arg', arg, call_count FROM r WHERE le
UNION ALL SELECT function, 'a <= b', a || ',' || b, call_count FROM t WHERE le UNION ALL SELECT function, 'a == b', a || ',' || b, call_count FROM t WHERE eq UNION ALL SELECT function, 'b - a >= 0', a || ',' || b, call_count FROM t WHERE diff""")
def invariants(f: Facts) -> DataFrame:
    return mining.invariants(f.observations, f.arguments)


@query("m11_module_metrics", f"""WITH {_COUPLING}, x AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce * 1.0 / (ca + ce) ELSE 0 END AS i, CASE WHEN classes > 0 THEN abstract * 1.0 / classes ELSE 0 END AS a FROM m), d AS (SELECT *, abs(i + a - 1) AS d FROM x)
SELECT module, ca, ce, round(i, 6) AS instability, round(a, 6) AS abstractness, round(d, 6) AS distance, CASE WHEN d > 0.5 AND i < 0.3 AND a < 0.3 THEN 'pain' WHEN d > 0.5 AND i > 0.7 AND a > 0.7 THEN 'uselessness' ELSE 'main' END AS zone FROM d""")
def module_metrics(f: Facts) -> DataFrame:
    return mining.module_metrics(f.module_imports, f.modules, f.stdlib)


@query("p05_metric_filters", f"""WITH {_COUPLING}, x AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce * 1.0 / (ca + ce) ELSE 0 END AS i, CASE WHEN classes > 0 THEN abstract * 1.0 / classes ELSE 0 END AS a FROM m), d AS (SELECT module, abs(i + a - 1) AS d FROM x WHERE ca + ce > 0)
SELECT module, round(d, 6) AS distance FROM d ORDER BY distance DESC, module LIMIT 20""")
def metric_filters(f: Facts) -> DataFrame:
    return mining.module_metrics(f.module_imports, f.modules, f.stdlib).where("ca + ce > 0").orderBy(F.desc("distance"), "module").limit(20).select("module", "distance")


_REFACTOR = """v AS (SELECT coalesce(caller, callee) AS func, count(*) AS violations FROM {calls} WHERE n_positional = 0 GROUP BY 1), c AS (SELECT callee AS func, count(DISTINCT coalesce(caller, '__module__:' || file)) AS callers FROM {calls} GROUP BY 1),
s AS (SELECT func, CAST(violations AS BIGINT) AS violations, CAST(coalesce(callers, 0) AS BIGINT) AS callers, round(violations * 1.0 / greatest(1, coalesce(callers, 0)), 6) AS score FROM v LEFT JOIN c USING (func))"""


@query("m12_refactor_scores", f"WITH {_REFACTOR} SELECT * FROM s")
def refactor(f: Facts) -> DataFrame:
    return mining.refactor_scores(f.calls.where("n_positional = 0").select(F.coalesce("caller", "callee").alias("func")), f.calls)


@query("t04_refactor_top", f"WITH {_REFACTOR} SELECT * FROM s ORDER BY score DESC, func LIMIT 10")
def refactor_top(f: Facts) -> DataFrame:
    return mining.refactor_scores(f.calls.where("n_positional = 0").select(F.coalesce("caller", "callee").alias("func")), f.calls, top=10)


@query("m13_extraction_safe", """WITH u AS (SELECT name, min(func_id) AS func_id FROM {functions} GROUP BY name HAVING count(*) = 1), rq AS (SELECT u.name, count(a.arg) AS required FROM u LEFT JOIN {function_args} a ON a.func_id = u.func_id AND a.required AND NOT a.kwonly GROUP BY 1),
ko AS (SELECT u.name, a.arg FROM u JOIN {function_args} a ON a.func_id = u.func_id AND a.required AND a.kwonly),
bad AS (SELECT c.callee AS name FROM {calls} c JOIN rq ON rq.name = c.callee WHERE c.n_positional < rq.required UNION SELECT c.callee FROM {calls} c JOIN ko ON ko.name = c.callee WHERE NOT EXISTS (SELECT 1 FROM {call_keywords} w WHERE w.seq = c.seq AND w.arg = ko.arg))
SELECT name, name NOT IN (SELECT name FROM bad) AS safe FROM rq""")
def extraction_safe(f: Facts) -> DataFrame:
    single = joins.unique_names(f.functions.select("func_id", "name")).join(f.function_args, "func_id", "left")
    functions = single.groupBy("name").agg(F.count_if(F.col("required") & ~F.col("kwonly")).alias("required"), F.collect_set(F.when(F.col("required") & F.col("kwonly"), F.col("arg"))).alias("kwonly"))
    given = f.call_keywords.groupBy("seq").agg(F.collect_set("arg").alias("kwargs"))
    calls = f.calls.join(given, "seq", "left").select("callee", "n_positional", F.coalesce("kwargs", F.array().cast("array<string>")).alias("kwargs"))
    return mining.extraction_safe(functions, calls)


def _matches(pattern: str) -> str:
    return f"regexp_matches(subject, '{pattern}')"


@query("m14_history_patterns", f"""WITH f AS (SELECT file, idx, {_matches(mining.REVERT)} AS revert, {_matches(mining.READD)} AS readd, {_matches(mining.FIX)} AS fix, {_matches(mining.ENSURE)} AS ensure, {_matches(mining.VERIFY)} AS verify FROM {{subjects}})
SELECT file, idx, revert, readd, fix, ensure AND max(CASE WHEN verify THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 0 AS unverified FROM f""")
def history(f: Facts) -> DataFrame:
    return mining.history_patterns(f.subjects)


@query("m14_repeated_fixes", f"""WITH x AS (SELECT * FROM {{subjects}} WHERE {_matches(mining.FIX)}), k AS (SELECT file FROM x GROUP BY file HAVING count(*) >= 3),
w AS (SELECT file, unnest(regexp_split_to_array(lower(regexp_replace(subject, '^[a-z]+[(]([^()]+)[)]:', '\\1 ')), '[,.:+/_\\s-]+')) AS word FROM x WHERE file IN (SELECT file FROM k)),
n AS (SELECT file, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{x}'" for x in mining.STOP)}) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT file, word, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, word) AS r FROM n) WHERE r <= 4""")
def repeated_fixes(f: Facts) -> DataFrame:
    return mining.repeated_fixes(f.subjects)


@query("m14_commit_density", """WITH r AS (SELECT path AS file, count(*) AS n, greatest(1, date_diff('day', min(day), max(day))) AS span, max(day) AS last FROM {commit_files} GROUP BY 1),
l AS (SELECT r.file, count(*) AS recent FROM r JOIN {commit_files} c ON c.path = r.file WHERE date_diff('day', c.day, r.last) <= 90 GROUP BY 1)
SELECT r.file, CAST(n AS BIGINT) AS n, CAST(span AS INT) AS span, round(n / greatest(1.0, span / 7.0), 6) AS per_week, CAST(recent AS BIGINT) AS recent, CASE WHEN round(n / greatest(1.0, span / 7.0), 6) >= 2 THEN 'high' WHEN n >= 20 THEN 'stated' END AS density FROM r JOIN l ON l.file = r.file""")
def density(f: Facts) -> DataFrame:
    return mining.commit_density(f.commit_files.select(F.col("path").alias("file"), "day"))


@query("m15_loop_fitness", """SELECT l_returnflag, l_linestatus, round(avg(0.25 * l_discount + 0.20 * l_tax + 0.15 * l_quantity + 0.15 * l_discount + 0.10 * l_tax + 0.10 * l_quantity + 0.05 * l_discount), 6) AS fitness FROM {lineitem} GROUP BY 1, 2""")
def fitness(f: Facts) -> DataFrame:
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return f.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(fn.loop_fitness(d, t, q, d, t, q, d)), 6).alias("fitness"))


@query("m17_coverage_levels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 3.0 WHEN o_totalprice > 300000 THEN 2.0 WHEN o_orderpriority = '5-LOW' THEN 1.5 ELSE 0.0 END AS level FROM {orders}")
def coverage_levels(f: Facts) -> DataFrame:
    return f.orders.select("o_orderkey", fn.coverage_level(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "5-LOW").alias("level"))
