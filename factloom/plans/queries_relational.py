"""Joins, aggregates, windows, orders, sets and projections over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.operators import aggregates, joins, sequences
from factloom.plans.catalog import query
from factloom.plans.facts import Facts, commit_paths

_REQ = "site_req AS (SELECT c.site, c.model, r.field FROM {site_creates} c JOIN {model_req} r ON c.model = r.model)"


# ---- joins

@query("j01_required_fields", f"WITH {_REQ} SELECT site, model, field FROM site_req")
def required(f: Facts) -> DataFrame:
    return joins.required_fields(f.site_creates, f.model_req)


@query("j02_missing_fields", f"""WITH {_REQ} SELECT s.site, s.model, CAST(count(*) AS BIGINT) AS n_missing, CAST(min(s.field) AS BIGINT) AS first_missing FROM site_req s
WHERE NOT EXISTS (SELECT 1 FROM {{site_provides}} p WHERE p.site = s.site AND p.field = s.field) GROUP BY s.site, s.model""")
def missing(f: Facts) -> DataFrame:
    wanted = joins.required_fields(f.site_creates, f.model_req)
    return joins.not_provided(wanted, f.site_provides).groupBy("site", "model").agg(F.count("*").alias("n_missing"), F.min("field").cast("long").alias("first_missing"))


@query("j03_unguarded_results", """SELECT DISTINCT o_custkey AS scope, o_orderpriority AS var, l_returnflag AS attr FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""")
def unguarded(f: Facts) -> DataFrame:
    variables = f.orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("var")).distinct()
    accesses = f.lineitem.join(f.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("var"), F.col("l_returnflag").alias("attr"))
    return joins.unguarded_results(variables, accesses)


@query("j04_resolve_unique", """WITH u AS (SELECT name FROM {functions} GROUP BY name HAVING count(*) = 1)
SELECT c.seq, c.callee, f.func_id FROM {calls} c JOIN u ON c.callee = u.name JOIN {functions} f ON f.name = u.name""")
def resolve_unique(f: Facts) -> DataFrame:
    return joins.resolve_unique(f.calls.select("seq", "callee"), f.functions.select("name", "func_id")).select("seq", "callee", "func_id")


@query("j05_enclosing", """SELECT p.file, p.id, (SELECT max(struct_pack(l := d.line, n := d.name)).n FROM {definitions} d WHERE d.file = p.file AND d.line <= p.line) AS func FROM {points} p""")
def enclosing(f: Facts) -> DataFrame:
    return joins.enclosing(f.points, f.definitions).select("file", "id", "func")


@query("j06_within_functions", """WITH r AS (SELECT file, line, name, lead(line) OVER (PARTITION BY file ORDER BY line, name) AS next_line FROM {definitions})
SELECT r.file, r.name, CAST(count(*) AS BIGINT) AS n FROM r JOIN {points} p ON p.file = r.file AND p.line >= r.line AND (r.next_line IS NULL OR p.line < r.next_line) GROUP BY 1, 2""")
def within(f: Facts) -> DataFrame:
    return joins.within_functions(f.definitions, f.points).groupBy("file", "name").agg(F.count("*").alias("n"))


@query("j07_attribute_to_callers", """WITH c AS (SELECT file, line, max(struct_pack(s := seq, c := coalesce(caller, ''))).c AS caller FROM {calls} WHERE caller IS NOT NULL GROUP BY file, line),
p AS (SELECT DISTINCT file, line + 1 AS line FROM {functions}),
e AS (SELECT p.file, p.line, (SELECT max(struct_pack(l := f.line, n := f.name)).n FROM {functions} f WHERE f.file = p.file AND f.line <= p.line) AS func FROM p)
SELECT e.file, CAST(e.line AS BIGINT) AS line, coalesce(c.caller, e.func) AS func FROM e LEFT JOIN c ON c.file = e.file AND c.line = e.line""")
def attribute(f: Facts) -> DataFrame:
    points = f.functions.select("file", (F.col("line") + 1).alias("line")).distinct()
    return joins.attribute_to_callers(points, f.calls.where("caller is not null"), f.functions)


@query("j08_co_changes", "SELECT a.path AS a, b.path AS b, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT sha, path FROM {commit_files}) a JOIN (SELECT DISTINCT sha, path FROM {commit_files}) b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2")
def co_changes(f: Facts) -> DataFrame:
    return joins.co_changes(commit_paths(f))


@query("j09_suffix_match", """WITH fl AS (SELECT DISTINCT file FROM {functions}), r AS (SELECT 'repo/src/' || file AS ref FROM fl UNION SELECT 'a/deep/' || file FROM fl UNION SELECT string_split(file, '/')[-1] FROM fl),
p AS (SELECT file AS path FROM fl UNION SELECT 'deep/' || file FROM fl UNION SELECT 'z/' || file FROM fl), s AS (SELECT ref, path, string_split(ref, '/') AS a, string_split(path, '/') AS b FROM r CROSS JOIN p),
k AS (SELECT ref, path, max(n.k) AS parts FROM s CROSS JOIN (SELECT unnest(range(2, 6)) AS k) n WHERE n.k <= len(a) AND n.k <= len(b) AND a[len(a) - n.k + 1:] = b[len(b) - n.k + 1:] GROUP BY 1, 2),
x AS (SELECT ref, max(parts) AS parts FROM k GROUP BY 1) SELECT k.ref, min(k.path) AS path, CAST(k.parts AS INT) AS parts FROM k JOIN x ON x.ref = k.ref AND x.parts = k.parts GROUP BY 1, 3""")
def suffix(f: Facts) -> DataFrame:
    """References and files at several depths: ties go to the least path, longer suffixes first, a bare name to none."""
    at = lambda *heads: f.functions.select(F.explode(F.array(*[F.concat(F.lit(h), "file") for h in heads])).alias("x")).distinct()
    names = f.functions.select(F.element_at(F.split("file", "/"), -1).alias("x"))
    return joins.suffix_match(at("repo/src/", "a/deep/").unionByName(names).withColumnRenamed("x", "ref"), at("", "deep/", "z/").withColumnRenamed("x", "path"))


@query("j10_confirm", """WITH p AS (SELECT file, line, min(call) AS spec_id FROM {violations_b} WHERE mode <> 'OTHER' GROUP BY file, line)
SELECT v.file, v.line, v.mode, p.spec_id FROM {violations} v LEFT JOIN p ON v.file = p.file AND v.line = p.line""")
def confirm(f: Facts) -> DataFrame:
    proofs = f.violations_b.where("mode <> 'OTHER'").select("file", "line", "mode", F.col("call").alias("spec_id"))
    return joins.confirm(f.violations.select("file", "line", "mode"), proofs)


@query("j11_not_seen", "SELECT a.* FROM {violations_b} a WHERE NOT EXISTS (SELECT 1 FROM {violations} b WHERE a.file = b.file AND a.mode = b.mode AND a.call = b.call)")
def not_seen(f: Facts) -> DataFrame:
    return joins.not_seen_anywhere(f.violations_b, f.violations).select("file", "line", "mode", "call")


_IMPORTS = "i AS (SELECT DISTINCT c.file, f.name, f.file AS target FROM {calls} c JOIN {functions} f ON c.callee = f.name WHERE c.n_positional = 1)"


@query("j12_resolve_imports", f"""WITH {_IMPORTS}, c AS (SELECT DISTINCT coalesce(caller, '__root__') AS src, file, callee AS name FROM {{calls}}),
a AS (SELECT c.*, f.func_id AS dst FROM c JOIN i ON c.file = i.file AND c.name = i.name JOIN {{functions}} f ON f.file = i.target AND f.name = c.name),
b AS (SELECT c.*, f.func_id AS dst FROM c JOIN {{functions}} f ON f.file = c.file AND f.name = c.name WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = c.src AND a.file = c.file AND a.name = c.name)),
d AS (SELECT c.*, f.func_id AS dst FROM c JOIN {{functions}} f ON f.name = c.name WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = c.src AND a.file = c.file AND a.name = c.name) AND NOT EXISTS (SELECT 1 FROM b WHERE b.src = c.src AND b.file = c.file AND b.name = c.name))
SELECT src, dst FROM a UNION SELECT src, dst FROM b UNION SELECT src, dst FROM d""")
def resolve_imports(f: Facts) -> DataFrame:
    imports = f.calls.where("n_positional = 1").join(f.functions.select(F.col("name").alias("callee"), F.col("file").alias("target")), "callee").select("file", F.col("callee").alias("name"), "target").distinct()
    return joins.resolve_imports(f.calls.select(F.coalesce("caller", F.lit("__root__")).alias("src"), "file", F.col("callee").alias("name")), imports, f.functions)


_CALL_EDGES = """s AS (SELECT short, min(name) AS full_name FROM (SELECT DISTINCT name, list_extract(string_split(name, '.'), -1) AS short FROM {functions}) GROUP BY short HAVING count(*) = 1),
k AS (SELECT DISTINCT name FROM {functions}),
ce AS (SELECT DISTINCT coalesce(c.caller, '__root__') AS src, CASE WHEN k.name IS NOT NULL THEN c.callee ELSE coalesce(s.full_name, c.callee) END AS dst FROM {calls} c LEFT JOIN k ON c.callee = k.name LEFT JOIN s ON c.callee = s.short)"""


@query("j13_call_edges", f"WITH {_CALL_EDGES} SELECT src, dst FROM ce")
def call_edges(f: Facts) -> DataFrame:
    return joins.call_edges(f.calls, f.functions)


@query("j14_package_repository", """WITH r AS (SELECT DISTINCT 'org/' || upper(replace(n_name, '_', '-')) AS repo FROM {nation}),
p AS (SELECT DISTINCT CASE WHEN n_regionkey = 2 THEN 'known' || CAST(n_nationkey AS STRING) ELSE lower(n_name) END AS pkg FROM {nation})
SELECT p.pkg, CASE WHEN p.pkg LIKE 'known%' THEN 'org/known' ELSE (SELECT min(r.repo) FROM r WHERE regexp_replace(lower(split_part(r.repo, '/', 2)), '[-_.]', '', 'g') = regexp_replace(p.pkg, '[-_.]', '', 'g')) END AS repo FROM p""")
def package_repository(f: Facts) -> DataFrame:
    pkg = F.when(F.col("n_regionkey") == 2, F.concat(F.lit("known"), "n_nationkey")).otherwise(F.lower("n_name")).alias("pkg")
    packages = f.nation.select(pkg)
    known = packages.where("pkg like 'known%'").distinct().withColumn("repo", F.lit("org/known"))
    return joins.package_repository(packages, known, f.nation.select(F.concat(F.lit("org/"), F.upper(F.translate("n_name", "_", "-"))).alias("repo")).distinct())


@query("j15_upstream_hits", """WITH u AS (SELECT n_name AS pkg, r_name AS repo, n_nationkey * 1.5 AS leverage FROM {nation} JOIN {region} ON n_regionkey = r_regionkey), i AS (SELECT DISTINCT pkg FROM {repo_imports})
SELECT repo, min(struct_pack(p := u.pkg, l := leverage)).p AS pkg, CAST(min(struct_pack(p := u.pkg, l := leverage)).l AS DOUBLE) AS leverage FROM u JOIN i ON u.pkg = i.pkg GROUP BY repo""")
def upstream_hits(f: Facts) -> DataFrame:
    up = f.nation.join(f.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("pkg"), F.col("r_name").alias("repo"), (F.col("n_nationkey") * F.lit(1.5)).alias("leverage"))
    return joins.upstream_hits(f.repo_imports, up)


@query("j16_tests_of_modules", """WITH s AS (SELECT DISTINCT file, regexp_replace(regexp_replace(file, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM {functions}),
t AS (SELECT file AS test, regexp_replace(stem, '^test_', '') AS k FROM s WHERE stem LIKE 'test\\_%' ESCAPE '\\'), m AS (SELECT file AS module, stem FROM s WHERE stem NOT LIKE 'test\\_%' ESCAPE '\\')
SELECT module, CAST(count(DISTINCT test) AS BIGINT) AS tests FROM t JOIN m ON k = stem OR contains(k, stem) GROUP BY module""")
def tests_of_modules(f: Facts) -> DataFrame:
    files = f.functions.select("file").distinct()
    test = fn.basename(F.col("file")).startswith("test_")
    hit = joins.tests_of_modules(files.where(test).select(F.col("file").alias("test")), files.where(~test).select(F.col("file").alias("module")))
    return hit.groupBy("module").agg(F.count("*").alias("tests"))


@query("j17_test_to_production", f"""WITH {_CALL_EDGES}, m AS (SELECT DISTINCT name, short, file LIKE '%/test\\_%' ESCAPE '\\' AS t FROM {{functions}})
SELECT src, dst FROM ce WHERE src IN (SELECT name FROM m WHERE t) AND dst IN (SELECT name FROM m WHERE NOT t UNION SELECT short FROM m WHERE NOT t)""")
def test_to_production(f: Facts) -> DataFrame:
    return joins.test_to_production(joins.call_edges(f.calls, f.functions), f.functions)


@query("j18_contract_coverage", """WITH c AS (SELECT DISTINCT regexp_replace(file, '^.*/', '') AS k FROM {functions} WHERE file LIKE 'pkg1/%' UNION SELECT DISTINCT file FROM {functions} WHERE file LIKE 'pkg2%')
SELECT DISTINCT f.file, (f.file IN (SELECT k FROM c) OR regexp_replace(f.file, '^.*/', '') IN (SELECT k FROM c)) AS covered FROM {functions} f""")
def contract_coverage(f: Facts) -> DataFrame:
    c = f.functions.where("file like 'pkg1/%'").select(fn.basename(F.col("file")).alias("file")).union(f.functions.where("file like 'pkg2%'").select("file"))
    return joins.contract_coverage(f.functions, c)


@query("j19_locate_in_graph", """WITH g AS (SELECT regexp_replace(file, '^.*/', '') AS b, name, min(func_id) AS x FROM {functions} GROUP BY 1, 2), s AS (SELECT name, min(func_id) AS x FROM {functions} GROUP BY name HAVING count(*) = 1)
SELECT c.seq AS rid, c.file, c.callee AS func, coalesce(g.x, s.x) AS node FROM {calls} c LEFT JOIN g ON g.b = regexp_replace(c.file, '^.*/', '') AND g.name = c.callee LEFT JOIN s ON s.name = c.callee""")
def locate(f: Facts) -> DataFrame:
    return joins.locate_in_graph(f.calls.select(F.col("seq").alias("rid"), "file", F.col("callee").alias("func")), f.functions.select(F.col("func_id").alias("node"), "file", F.col("name").alias("func")))


_FIRST = """sn AS (SELECT string_split(name, '.')[-1] AS short, arg_min(name, func_id) AS "full" FROM {functions} GROUP BY 1), kn AS (SELECT DISTINCT name FROM {functions}),
rs AS (SELECT c.seq, c.caller, CASE WHEN c.callee IN (SELECT name FROM kn) THEN c.callee ELSE coalesce(sn."full", c.callee) END AS dst FROM {calls} c LEFT JOIN sn ON sn.short = string_split(c.callee, '.')[-1])"""


def _functions(f: Facts) -> DataFrame:
    return f.functions.select("name", F.col("func_id").alias("seq"))


@query("g01_call_graph", f"WITH {_FIRST} SELECT coalesce(caller, '__root__') AS src, dst, max(seq) AS seq FROM rs GROUP BY 1, 2")
def call_graph(f: Facts) -> DataFrame:
    return joins.call_graph(f.calls, _functions(f))


@query("g01_drawn_edges", f"WITH {_FIRST} SELECT DISTINCT caller AS src, dst FROM rs WHERE caller IS NOT NULL AND (caller IN (SELECT name FROM kn) OR dst IN (SELECT name FROM kn))")
def drawn_edges(f: Facts) -> DataFrame:
    return joins.drawn_edges(f.calls, _functions(f))


@query("g01_raw_edges", "SELECT DISTINCT caller AS src, callee AS dst FROM {calls} WHERE caller IS NOT NULL AND callee IS NOT NULL")
def raw_edges(f: Facts) -> DataFrame:
    return joins.raw_edges(f.calls)


@query("a11_most_starred", "SELECT DISTINCT repo, stars, mode FROM {corpus} ORDER BY stars DESC, repo, mode LIMIT 10")
def most_starred(f: Facts) -> DataFrame:
    return aggregates.most_starred(f.corpus)


@query("j20_class_evidence", """WITH w AS (SELECT DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS t, 'm' || CAST(p_size AS STRING) || '.py' AS path FROM {part}),
d AS (SELECT n_nationkey AS doc, 'see ' || t || 'Part and `m' || CAST(n_nationkey AS STRING) || '.py` in ' || t AS text, t FROM {nation}, (SELECT DISTINCT t FROM w) x), h AS (SELECT DISTINCT doc || ' ' || t AS doc, w.path FROM d JOIN w USING (t) UNION SELECT DISTINCT doc || ' ' || d.t, w.path FROM d JOIN w ON w.path = 'm' || CAST(doc AS STRING) || '.py')
SELECT doc, path FROM h""")
def class_evidence(f: Facts) -> DataFrame:
    kind = f.part.select(F.initcap(F.lower("p_type")).alias("t"), F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit(".py")).alias("path")).distinct()
    docs = f.nation.select("n_nationkey").join(kind.select("t").distinct()).select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), "t").alias("doc"), F.concat(F.lit("see "), "t", F.lit("Part and `m"), F.col("n_nationkey").cast("string"), F.lit(".py` in "), "t").alias("text"))
    return joins.record_evidence(docs, kind.select("path").distinct(), kind.select(F.concat("t", F.lit("Part")).alias("name"), "path"))


@query("j20_record_evidence", """WITH d AS (SELECT func_id AS doc, 'see `' || regexp_replace(file, '^.*/', '') || '` and `pkg1/m1.py`' AS t FROM {functions}), x AS (SELECT DISTINCT doc, unnest(regexp_extract_all(t, '`([A-Za-z0-9_/.-]+\\.py)`', 1)) AS ref FROM d),
k AS (SELECT DISTINCT file AS path, file AS ref FROM {functions} UNION SELECT file, regexp_replace(file, '^.*/', '') FROM {functions}), h AS (SELECT DISTINCT doc, path FROM x JOIN k ON x.ref = k.ref)
SELECT path, CAST(count(*) AS BIGINT) AS docs FROM h GROUP BY path""")
def record_evidence(f: Facts) -> DataFrame:
    docs = f.functions.select(F.col("func_id").alias("doc"), F.concat(F.lit("see `"), fn.basename(F.col("file")), F.lit("` and `pkg1/m1.py`")).alias("text"))
    return joins.record_evidence(docs, f.functions.select(F.col("file").alias("path"))).groupBy("path").agg(F.count("*").alias("docs"))


# ---- aggregates

@query("a01_count_by_mode", "SELECT mode, CAST(count(*) AS BIGINT) AS n FROM {violations} GROUP BY mode")
def count_by_mode(f: Facts) -> DataFrame:
    return aggregates.count_by(f.violations, "mode")


@query("a02_repeated_names", "SELECT name, CAST(count(*) AS BIGINT) AS n FROM {functions} GROUP BY name HAVING count(*) > 1")
def repeated_names(f: Facts) -> DataFrame:
    return aggregates.repeated_names(f.functions)


@query("a03_missing_by_site", f"""WITH {_REQ} SELECT site, list_sort(list(DISTINCT field)) AS missing FROM site_req s
WHERE NOT EXISTS (SELECT 1 FROM {{site_provides}} p WHERE p.site = s.site AND p.field = s.field) GROUP BY site""")
def missing_by_site(f: Facts) -> DataFrame:
    return aggregates.missing_by_site(joins.not_provided(joins.required_fields(f.site_creates, f.model_req), f.site_provides))


@query("a04_module_documents", """WITH v AS (SELECT file AS module, CAST(count(*) AS BIGINT) AS violations, min(line) AS first_line FROM {violations} GROUP BY file), i AS (SELECT p_size AS module, CAST(count(DISTINCT p_brand) AS BIGINT) AS invariants FROM {part} GROUP BY p_size)
SELECT module, violations, first_line, invariants FROM v FULL JOIN i USING (module)""")
def module_documents(f: Facts) -> DataFrame:
    d = aggregates.module_documents(f.violations.select(F.col("file").alias("module"), "line", "mode"), f.part.select(F.col("p_size").alias("module"), F.col("p_brand").alias("id"), F.col("p_type").alias("text")))
    return d.select("module", F.size("violations").cast("long").alias("violations"), F.col("violations")[0]["line"].alias("first_line"), F.size("invariants").cast("long").alias("invariants"))


@query("a05_repo_totals", "SELECT repo, CAST(count(*) AS BIGINT) AS violations, arg_max(stars, seq) AS stars, CAST(count(DISTINCT file) AS BIGINT) AS files FROM {corpus} GROUP BY repo")
def repo_totals(f: Facts) -> DataFrame:
    return aggregates.repo_totals(f.corpus)


@query("a06_downstream", "SELECT pkg, CAST(count(DISTINCT repo) AS BIGINT) AS downstream FROM {repo_imports} WHERE repo <> owner OR owner IS NULL GROUP BY pkg")
def downstream(f: Facts) -> DataFrame:
    return aggregates.downstream(f.repo_imports)


@query("a07_package_frequency", "SELECT pkg, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {repo_imports}), 4) AS pct FROM {repo_imports} GROUP BY pkg")
def frequency(f: Facts) -> DataFrame:
    return aggregates.frequency(f.repo_imports, "pkg")


@query("a08_repo_queue", """WITH m AS (SELECT repo, mode, count(*) AS k, max(stars) AS s FROM {corpus} GROUP BY 1, 2), r AS (SELECT repo, CAST(sum(k) AS BIGINT) AS n, max(s) AS stars, min(struct_pack(k := -k, mode := mode)).mode AS top_mode FROM m GROUP BY repo),
q AS (SELECT repo, n, top_mode, round(n * ln(stars + 1), 6) AS score FROM r) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, repo) AS INT) AS rank FROM q""")
def repo_queue(f: Facts) -> DataFrame:
    return aggregates.repo_queue(f.corpus)


_COUPLING = """k AS (SELECT module AS used, module AS target FROM {modules}), i AS (SELECT DISTINCT module, target FROM {module_imports}),
ca AS (SELECT k.used AS module, count(DISTINCT i.module) AS ca FROM i JOIN k ON i.target = k.target WHERE i.module <> k.used GROUP BY 1),
ce AS (SELECT module, count(DISTINCT split_part(target, '.', 1)) AS ce FROM i WHERE target NOT IN (SELECT target FROM k) AND split_part(target, '.', 1) NOT IN (SELECT pkg FROM {stdlib}) GROUP BY 1),
m AS (SELECT module, CAST(coalesce(ca, 0) AS BIGINT) AS ca, CAST(coalesce(ce, 0) AS BIGINT) AS ce, classes, abstract FROM {modules} LEFT JOIN ca USING (module) LEFT JOIN ce USING (module))"""


@query("a09_coupling_counts", f"WITH {_COUPLING} SELECT module, ca, ce FROM m")
def coupling_counts(f: Facts) -> DataFrame:
    return aggregates.coupling_counts(f.module_imports, f.modules, f.stdlib)


@query("a10_gap_frequency", """WITH g AS (SELECT o_orderstatus AS verdict, o_orderpriority AS gap, count(*) AS n FROM {orders} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY n DESC, gap) AS rank FROM g)
SELECT verdict, gap, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
def gap_frequency(f: Facts) -> DataFrame:
    return aggregates.gap_frequency(f.orders.select(F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("gap")))


@query("a11_synthesis_report", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS with_source, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS proved, CAST(count_if(o_totalprice > 100000 AND o_orderstatus <> 'F') AS BIGINT) AS open FROM {orders}")
def synthesis_report(f: Facts) -> DataFrame:
    return aggregates.synthesis_report(f.orders.select((F.col("o_totalprice") > 100000).alias("has_source"), (F.col("o_orderstatus") == "F").alias("proved")))


@query("a12_incremental_stats", "SELECT (SELECT count(*) FROM {orders}) AS total, (SELECT count(*) FROM {urgent}) AS dirty, round(1.0 - (SELECT count(*) FROM {urgent}) / greatest((SELECT count(*) FROM {orders}), 1), 3) AS skip_ratio")
def incremental_stats(f: Facts) -> DataFrame:
    return aggregates.incremental_stats(f.orders, f.urgent)


@query("a13_themes", """WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM {conversations})
SELECT word, CAST(count(*) AS BIGINT) AS n FROM w WHERE length(word) >= 4 GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 4""")
def themes(f: Facts) -> DataFrame:
    return aggregates.themes(f.conversations.select("text"))


@query("a14_authors", "SELECT author, CAST(count(*) AS BIGINT) AS n FROM {commit_files} GROUP BY author ORDER BY n DESC, author LIMIT 5")
def authors(f: Facts) -> DataFrame:
    return aggregates.count_by(f.commit_files, "author").orderBy(F.desc("n"), "author").limit(5)


@query("a15_scaled_max", """WITH m AS (SELECT p_size AS file, max(p_retailprice) AS m FROM {part} GROUP BY 1), e AS (SELECT p_size AS file, count_if(p_type = 'PROMO') * 1.0 / count(*) AS share FROM {part} GROUP BY 1)
SELECT file, round(0.6 * m / (SELECT max(m) FROM m) + 0.4 * coalesce(share, 0), 6) AS score FROM m LEFT JOIN e USING (file)""")
def scaled_max(f: Facts) -> DataFrame:
    share = f.part.groupBy(F.col("p_size").alias("file")).agg((F.count_if(F.col("p_type") == "PROMO") / F.count("*")).alias("share"))
    return aggregates.scaled_max(f.part.select(F.col("p_size").alias("file"), F.col("p_retailprice").alias("score")), share)


@query("a16_cover_class", f"""WITH {_CALL_EDGES}, n AS (SELECT dst AS name, count(*) AS tests FROM ce GROUP BY dst), k2 AS (SELECT k.name, coalesce(tests, 0) AS tests FROM k LEFT JOIN n USING (name))
SELECT name, CAST(tests AS BIGINT) AS tests, CASE WHEN tests = 0 THEN 'none' WHEN tests < 3 THEN 'some' ELSE 'well' END AS cover FROM k2""")
def cover_class(f: Facts) -> DataFrame:
    return aggregates.cover_class(joins.call_edges(f.calls, f.functions), f.functions)


@query("a17_plan_summary", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS passed, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS failed, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS skipped FROM {orders}")
def plan_summary(f: Facts) -> DataFrame:
    status = F.create_map(F.lit("F"), F.lit("passed"), F.lit("O"), F.lit("failed"), F.lit("P"), F.lit("skipped"))
    return aggregates.plan_summary(f.orders.select(status[F.col("o_orderstatus")].alias("status")))


@query("a18_communities", "SELECT c_nationkey AS community, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY 1 ORDER BY n DESC, community LIMIT 3")
def communities(f: Facts) -> DataFrame:
    return aggregates.count_by(f.customer.withColumnRenamed("c_nationkey", "community"), "community").orderBy(F.desc("n"), "community").limit(3)


# ---- windows

@query("w01_function_ranges", "SELECT file, name, epoch_us(lead(line) OVER (PARTITION BY file ORDER BY line, name)) AS next_us FROM {definitions}")
def function_ranges(f: Facts) -> DataFrame:
    return joins.function_ranges(f.definitions).select("file", "name", F.unix_micros(F.col("next_line").cast("timestamp")).alias("next_us"))


@query("w02_trend", "SELECT path, arg_min(value, idx) AS first, arg_max(value, idx) AS last, CAST(count(*) AS BIGINT) AS n, round((arg_max(value, idx) - arg_min(value, idx)) / greatest(1, count(*) - 1), 6) AS trend FROM {series} GROUP BY path")
def trend(f: Facts) -> DataFrame:
    return sequences.trend(f.series)


@query("w03_top_author_share", "WITH k AS (SELECT path, author, count(DISTINCT sha) AS k FROM {commit_files} GROUP BY 1, 2) SELECT path, round(max(k) * 1.0 / sum(k), 6) AS share FROM k GROUP BY path")
def top_author(f: Facts) -> DataFrame:
    k = f.commit_files.groupBy("path", "author").agg(F.countDistinct("sha").alias("k"))
    return k.groupBy("path").agg(F.round(F.max("k") / F.sum("k"), 6).alias("share"))


@query("w04_near_flag", "SELECT conv_id, turn, max(CASE WHEN contains(text, '.') AND length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM {conversations}")
def near_flag(f: Facts) -> DataFrame:
    rows = f.conversations.select("conv_id", "turn", (F.col("text").contains(".") & (F.length("text") > 400)).alias("flag"))
    return sequences.near_flag(rows, order=["turn"], partition=["conv_id"], flag="flag").select("conv_id", "turn", "near")


@query("w05_rate", """WITH d AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day FROM {orders}), t AS (SELECT max(day) AS last FROM d)
SELECT key, CAST(count(*) AS BIGINT) AS n, CAST(max(day) - min(day) AS BIGINT) AS span, CAST(count_if(last - day <= 90) AS BIGINT) AS recent, round(count(*) / greatest(1.0, (max(day) - min(day)) / 7), 6) AS per_week FROM d, t GROUP BY key""")
def rate(f: Facts) -> DataFrame:
    return sequences.rate(f.orders.select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day")), "key")


@query("w06_convergence", """WITH w AS (SELECT loop, step, count(*) OVER x AS k, max(fitness) OVER x - min(fitness) OVER x AS r, max(fixed) OVER x AS m FROM {states} WINDOW x AS (PARTITION BY loop ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT loop, step, (k = 3 AND r < 0.01) AS converged, (k = 3 AND m = 0) AS stuck FROM w""")
def convergence(f: Facts) -> DataFrame:
    return sequences.convergence(f.states).select("loop", "step", "converged", "stuck")


@query("w07_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) WHERE r = 1")
def latest(f: Facts) -> DataFrame:
    return sequences.latest_by(f.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w08_rerank", "WITH s AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS total FROM {customer} GROUP BY 1) SELECT k, CAST(row_number() OVER (ORDER BY total DESC, k) AS INT) AS rank FROM s")
def rerank(f: Facts) -> DataFrame:
    s = f.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return sequences.rerank(s, order=[F.desc("total"), F.col("k")]).select("k", "rank")


@query("w09_code_context", """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {documents}), p AS (SELECT DISTINCT file, line FROM l WHERE length(text) > 200)
SELECT p.file, CAST(p.line AS INT) AS line, string_agg(l.text, chr(10) ORDER BY l.line, l.text) AS context FROM p JOIN l ON l.file = p.file AND l.line BETWEEN p.line - 2 AND p.line + 2 GROUP BY 1, 2""")
def code_context(f: Facts) -> DataFrame:
    lines = f.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return sequences.code_context(lines, lines.where(F.length("text") > 200))


# ---- orders and sets

@query("t05_max_coverage", "SELECT file, CAST(count(*) AS BIGINT) AS n FROM {violations} GROUP BY file ORDER BY n DESC, file LIMIT 5")
def max_coverage(f: Facts) -> DataFrame:
    return aggregates.count_by(f.violations, "file").orderBy(F.desc("n"), "file").limit(5)


@query("t06_until_distinct", """WITH o AS (SELECT repo, seq, row_number() OVER (ORDER BY stars DESC, seq) AS k FROM {corpus}), x AS (SELECT max(m) AS last FROM (SELECT min(k) AS m FROM o GROUP BY repo ORDER BY m LIMIT 10))
SELECT repo, seq FROM o, x WHERE k <= last""")
def until_distinct(f: Facts) -> DataFrame:
    return sequences.until_distinct(f.corpus, "repo", [(-F.col("stars")).alias("s"), F.col("seq")], 10).select("repo", "seq")


@query("t07_topological_levels", """WITH d AS (SELECT src AS dep, dst AS step FROM {dag}), lv AS (SELECT o_orderkey AS step, 0 AS level FROM {orders} WHERE o_orderkey NOT IN (SELECT step FROM d) UNION SELECT d.step, lv.level + 1 FROM lv JOIN d ON d.dep = lv.step)
SELECT step, CAST(max(level) AS INT) AS level FROM lv GROUP BY step""")
def topological_levels(f: Facts) -> DataFrame:
    need = f.dag.groupBy(F.col("dst").alias("step")).agg(F.collect_list("src").alias("depends_on"))
    steps = f.orders.select(F.col("o_orderkey").alias("step")).join(need, "step", "left")
    return sequences.topological_levels(steps)


@query("u01_dedup_first_source", """WITH a AS (SELECT *, 0 AS source_rank FROM {violations} UNION ALL SELECT *, 1 FROM {violations_b}), r AS (SELECT *, row_number() OVER (PARTITION BY file, line, mode, call ORDER BY source_rank) AS k FROM a)
SELECT file, line, mode, call, source_rank FROM r WHERE k = 1""")
def dedup(f: Facts) -> DataFrame:
    return sequences.first_by_source([f.violations, f.violations_b], ["file", "line", "mode", "call"])


@query("u03_corpus_dedup", "SELECT DISTINCT repo, mode, file FROM {corpus}")
def corpus_dedup(f: Facts) -> DataFrame:
    return f.corpus.select("repo", "mode", "file").distinct()


@query("u05_common_arguments", "WITH a AS (SELECT DISTINCT o_custkey AS function, o_orderkey AS obs, l_returnflag AS arg FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey), n AS (SELECT function, count(DISTINCT obs) AS total FROM a GROUP BY 1) SELECT a.function, a.arg FROM a JOIN n USING (function) GROUP BY a.function, a.arg, total HAVING count(*) = total")
def common_arguments(f: Facts) -> DataFrame:
    o = f.lineitem.join(f.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("function"), F.col("o_orderkey").alias("obs")).agg(F.collect_list("l_returnflag").alias("args"))
    return sequences.common_arguments(o)


# ---- projections and predicates

@query("p01_to_violation", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN [o_orderpriority] ELSE [o_orderstatus] END AS missing FROM {orders}")
def to_violation(f: Facts) -> DataFrame:
    given = F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return f.orders.select("o_orderkey", fn.missing_or_message(given, F.col("o_orderstatus")).alias("missing"))


@query("p02_changed_only", "SELECT v.* FROM {violations} v WHERE v.file IN (SELECT p_size FROM {part} WHERE p_type = 'PROMO')")
def changed_only(f: Facts) -> DataFrame:
    return joins.in_files(f.violations, f.part.where("p_type = 'PROMO'").select(F.col("p_size").alias("file")))


@query("p03_production_files", "SELECT DISTINCT file FROM {functions} WHERE NOT starts_with(regexp_replace(file, '^.*/', ''), 'test_')")
def production_files(f: Facts) -> DataFrame:
    return f.functions.select("file").distinct().where(fn.is_production(F.col("file")))


@query("p04_test_files", "SELECT DISTINCT file, starts_with(regexp_replace(file, '^.*/', ''), 'test_') AS is_test FROM {functions}")
def test_files(f: Facts) -> DataFrame:
    return f.functions.select("file").distinct().withColumn("is_test", fn.is_test_file(F.col("file")))


@query("p06_corpus_filter", "SELECT repo, seq FROM {corpus} WHERE mode IN ('F1-URGENT', 'O2-HIGH') AND stars >= 100000")
def corpus_filter(f: Facts) -> DataFrame:
    return f.corpus.where(F.col("mode").isin("F1-URGENT", "O2-HIGH") & (F.col("stars") >= 100000)).select("repo", "seq")


@query("p07_project_traces", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM {events} WHERE event_type NOT IN ('view') AND NOT starts_with(event_type, 'sign') GROUP BY 1")
def project_traces(f: Facts) -> DataFrame:
    return f.events.where(fn.is_project_function(F.col("event_type"), stdlib=("view",), prefixes=("sign",))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p08_wont_fix", "SELECT page_id, (lower(regexp_extract(html, 'lang=\"([a-z]+)\"', 1)) IN ('de', 'fr')) AS wont_fix FROM {pages}")
def wont_fix(f: Facts) -> DataFrame:
    label = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    return f.pages.select("page_id", fn.has_label(F.array(F.upper(label)), ("de", "fr")).alias("wont_fix"))


@query("p09_user_named", "SELECT p_partkey, len(list_intersect(string_split(lower(replace(p_name, ' ', '_')), '_'), ['ring', 'widget'])) > 0 AS hit FROM {part}")
def user_named(f: Facts) -> DataFrame:
    return f.part.select("p_partkey", fn.is_user_named(F.translate("p_name", " ", "_"), ("ring", "widget")).alias("hit"))


@query("p10_severity", "SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'medium' END AS severity, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1")
def severity(f: Facts) -> DataFrame:
    return f.orders.groupBy("o_orderpriority", fn.severity(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH")).alias("severity")).agg(F.count("*").alias("n"))


@query("p12_literal_checks", """WITH c AS (SELECT p_partkey, length(p_name) > 10 AS too_long, p_size < 5 AS too_small, p_retailprice > 1000 AS too_large, p_type NOT IN ('PROMO', 'ECONOMY') AS not_a_choice FROM {part})
SELECT * FROM c WHERE too_long OR too_small OR too_large OR not_a_choice""")
def literal_checks(f: Facts) -> DataFrame:
    bad = {"too_long": fn.too_long(F.col("p_name"), 10), "too_small": fn.out_of_range(F.col("p_size"), low=5), "too_large": fn.out_of_range(F.col("p_retailprice"), high=1000), "not_a_choice": fn.not_a_choice(F.col("p_type"), ("PROMO", "ECONOMY"))}
    return f.part.select("p_partkey", *[c.alias(n) for n, c in bad.items()]).where(" or ".join(bad))
