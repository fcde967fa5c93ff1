"""Recursion, reachability, components, reductions and centrality over the facts' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import datalog, graph, joins
from factloom.plans.catalog import query
from factloom.plans.facts import Facts

_TC = "tc AS (SELECT src, dst FROM {edges} UNION SELECT tc.src, e.dst FROM tc JOIN {edges} e ON tc.dst = e.src)"
_BACK = "t AS (SELECT node FROM {urgent} UNION SELECT e.src FROM t JOIN {edges} e ON e.dst = t.node)"
_NODES = "nd AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})"
_SCC = f"{_TC}, {_NODES}, sc AS (SELECT nd.node, least(nd.node, coalesce(min(b.src), nd.node)) AS scc FROM nd LEFT JOIN tc a ON a.src = nd.node LEFT JOIN tc b ON b.src = a.dst AND b.dst = a.src GROUP BY nd.node)"
_CC = f"{_NODES}, un AS (SELECT src, dst FROM {{edges}} UNION SELECT dst, src FROM {{edges}}), rc AS (SELECT node, node AS seen FROM nd UNION SELECT rc.node, un.dst FROM rc JOIN un ON un.src = rc.seen), cc AS (SELECT node, min(seen) AS component FROM rc GROUP BY node)"


@query("r01_guarded_taint", "WITH t AS (SELECT node FROM {urgent} UNION SELECT e.src FROM t JOIN {edges} e ON e.dst = t.node WHERE e.src NOT IN (SELECT node FROM {pending})) SELECT node FROM t")
def guarded_taint(f: Facts) -> DataFrame:
    return datalog.tainted(f.edges, f.urgent, f.pending).select("node")


@query("r02_taint", f"WITH {_BACK} SELECT node FROM t")
def taint(f: Facts) -> DataFrame:
    return datalog.tainted(f.edges, f.urgent).select("node")


@query("r04_public_violations", f"WITH {_BACK} SELECT node, CASE WHEN node IN (SELECT node FROM {{urgent}}) THEN 0 ELSE 1 END AS direct01 FROM t WHERE node IN (SELECT node FROM {{order_functions}} WHERE is_public)")
def public_violations(f: Facts) -> DataFrame:
    return datalog.public_violations(datalog.tainted(f.edges, f.urgent), f.order_functions.withColumn("node", F.col("node"))).select("node", "direct01")


_FILE_EDGES = "fe AS (SELECT DISTINCT b.o_custkey AS src, a.o_custkey AS dst FROM {orders} a JOIN {orders} b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.o_orderstatus = 'F')"


@query("r05_dirty_files", f"WITH {_FILE_EDGES}, d AS (SELECT o_custkey AS file FROM {{orders}} WHERE o_totalprice > 499000 UNION SELECT fe.dst FROM d JOIN fe ON fe.src = d.file) SELECT file FROM d")
def dirty_files(f: Facts) -> DataFrame:
    functions = f.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("name"))
    calls = f.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") - 1).alias("callee"))
    return datalog.dirty_files(f.orders.where("o_totalprice > 499000").select(F.col("o_custkey").alias("file")).distinct(), functions, calls)


@query("r06_flows", """WITH fl AS (SELECT node AS source, node AS place, 0 AS hops FROM {urgent} UNION SELECT fl.source, e.dst, fl.hops + 1 FROM fl JOIN {edges} e ON e.src = fl.place WHERE fl.hops < 5),
m AS (SELECT source, place AS sink, min(hops) AS hops FROM fl GROUP BY 1, 2) SELECT source, sink, hops, round(pow(0.8, hops), 6) AS confidence FROM m WHERE hops > 0 AND sink IN (SELECT node FROM {pending})""")
def flows(f: Facts) -> DataFrame:
    return datalog.flows(f.edges, f.urgent, f.pending)


_GUARDED = "g AS (SELECT o_orderkey AS id FROM {orders} WHERE o_orderstatus = 'P' UNION SELECT e.dst FROM g JOIN {edges} e ON e.src = g.id)"


def _sites(f: Facts) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "BranchGuard").when(F.col("o_orderstatus") == "F", "ErrorSite").otherwise("CallResult")
    return f.orders.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_custkey").alias("file"))


@query("r07_guarded_sites", f"WITH {_GUARDED} SELECT o_orderkey AS id, o_custkey AS file, o_orderkey IN (SELECT id FROM g) AS guarded FROM {{orders}} WHERE o_orderstatus = 'F'")
def guarded_sites(f: Facts) -> DataFrame:
    return datalog.guarded_sites(_sites(f), f.edges)


@query("r08_unguarded_rank", f"WITH {_GUARDED} SELECT o_custkey AS file, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS rank FROM {{orders}} WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT id FROM g) GROUP BY 1")
def unguarded_rank(f: Facts) -> DataFrame:
    return datalog.unguarded_rank(_sites(f), f.edges, f.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source")))


@query("g02_closure", f"WITH {_TC} SELECT src, dst FROM tc")
def all_pairs(f: Facts) -> DataFrame:
    return graph.all_paths(f.edges)


@query("g02_descendants", "WITH t AS (SELECT node FROM {urgent} UNION SELECT e.dst FROM t JOIN {edges} e ON e.src = t.node) SELECT DISTINCT t.node FROM t WHERE t.node NOT IN (SELECT node FROM {urgent})")
def descendants(f: Facts) -> DataFrame:
    return graph.descendants(f.edges, f.urgent)


@query("g03_blast_radius", f"WITH {_TC} SELECT u.node, CAST(count(tc.src) AS BIGINT) AS radius FROM {{urgent}} u LEFT JOIN tc ON tc.dst = u.node AND tc.src <> u.node GROUP BY u.node")
def blast_radius(f: Facts) -> DataFrame:
    return graph.blast_radius(f.edges, f.urgent)


@query("g05_tangles", f"""WITH {_SCC} SELECT scc AS "primary", CAST(count(*) AS BIGINT) AS size, CAST(count(*) - 1 AS BIGINT) AS potential FROM sc GROUP BY scc HAVING count(*) > 1""")
def tangles(f: Facts) -> DataFrame:
    return graph.tangles(f.edges)


@query("g08_components", f"WITH {_CC} SELECT node, component FROM cc")
def components(f: Facts) -> DataFrame:
    return graph.components(f.edges)


@query("g08_betti", f"WITH {_CC}, ue AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {{edges}} WHERE src <> dst) SELECT v, e, b0, e - v + b0 AS b1 FROM (SELECT count(*) AS v, count(DISTINCT component) AS b0 FROM cc), (SELECT count(*) AS e FROM ue)")
def betti(f: Facts) -> DataFrame:
    return graph.betti(f.edges)


@query("g09_passthroughs", "WITH i AS (SELECT dst AS node, count(*) AS n FROM {edges} GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM {edges} GROUP BY 1) SELECT node, CAST(3 AS BIGINT) AS potential FROM i JOIN o USING (node) WHERE i.n = 1 AND o.n = 1 AND node IN (SELECT node FROM {order_functions})")
def passthroughs(f: Facts) -> DataFrame:
    return graph.passthroughs(f.edges, f.order_functions)


@query("g10_hubs", "WITH o AS (SELECT src AS node, count(*) AS n FROM {edges} GROUP BY 1) SELECT node, CAST(n AS BIGINT) AS out, CAST(0 AS BIGINT) AS potential FROM o WHERE n >= 2")
def hubs(f: Facts) -> DataFrame:
    return graph.hubs(f.edges, threshold=2)


@query("g11_candidates", f"""WITH {_SCC}, i AS (SELECT dst AS node, count(*) AS n FROM {{edges}} GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM {{edges}} GROUP BY 1)
SELECT 'tangle' AS kind, scc AS node, CAST(count(*) - 1 AS BIGINT) AS potential FROM sc GROUP BY scc HAVING count(*) > 1
UNION ALL SELECT 'passthrough', node, 3 FROM i JOIN o USING (node) WHERE i.n = 1 AND o.n = 1 AND node IN (SELECT node FROM {{order_functions}}) UNION ALL SELECT 'hub', node, 0 FROM o WHERE n >= 2""")
def candidates(f: Facts) -> DataFrame:
    return graph.candidates(f.edges, f.order_functions, threshold=2)


@query("g12_live_roots", f"WITH {_NODES} SELECT node FROM nd WHERE node NOT IN (SELECT dst FROM {{edges}})")
def live_roots(f: Facts) -> DataFrame:
    return graph.live_roots(f.edges)


@query("g13_contract", f"WITH {_SCC} SELECT DISTINCT a.scc AS src, b.scc AS dst FROM {{edges}} e JOIN sc a ON a.node = e.src JOIN sc b ON b.node = e.dst WHERE a.scc <> b.scc")
def contract(f: Facts) -> DataFrame:
    return graph.contract(f.edges, graph.strong_components(f.edges))


@query("g14_dead", f"WITH {_NODES}, t AS (SELECT node FROM {{urgent}} UNION SELECT e.dst FROM t JOIN {{edges}} e ON e.src = t.node) SELECT node FROM nd WHERE node NOT IN (SELECT node FROM t)")
def dead(f: Facts) -> DataFrame:
    return graph.dead(f.edges, f.urgent)


@query("g15_transitive_reduction", "WITH tc AS (SELECT src, dst FROM {dag} UNION SELECT tc.src, e.dst FROM tc JOIN {dag} e ON tc.dst = e.src) SELECT e.src, e.dst FROM {dag} e WHERE NOT EXISTS (SELECT 1 FROM {dag} m JOIN tc ON tc.src = m.dst WHERE m.src = e.src AND tc.dst = e.dst)")
def transitive_reduction(f: Facts) -> DataFrame:
    return graph.transitive_reduction(f.dag)


@query("g16_full_reduction", f"""WITH {_SCC}, sm AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM {{edges}} e JOIN sc a ON a.node = e.src JOIN sc b ON b.node = e.dst WHERE a.scc <> b.scc),
ro AS (SELECT node FROM nd WHERE node NOT IN (SELECT dst FROM {{edges}})), al AS (SELECT sc.scc AS node FROM ro JOIN sc ON sc.node = ro.node UNION SELECT sm.dst FROM al JOIN sm ON sm.src = al.node),
ke AS (SELECT src, dst FROM sm WHERE src IN (SELECT node FROM al) AND dst IN (SELECT node FROM al)), kc AS (SELECT src, dst FROM ke UNION SELECT kc.src, e.dst FROM kc JOIN ke e ON e.src = kc.dst),
lo AS (SELECT DISTINCT m.src, kc.dst FROM ke m JOIN kc ON kc.src = m.dst)
SELECT (SELECT count(*) FROM nd) AS nodes_before, (SELECT count(*) FROM {{edges}}) AS edges_before, (SELECT count(*) FROM al) AS nodes_after, (SELECT count(*) FROM ke WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.src = ke.src AND lo.dst = ke.dst)) AS edges_after""")
def full_reduction(f: Facts) -> DataFrame:
    return graph.reduce_fully(f.edges)


_CUT = f"""{_CC}, oth AS (SELECT a.node AS v, min(b.node) AS first, count(*) AS n FROM cc a JOIN cc b ON a.component = b.component AND a.node <> b.node GROUP BY 1),
wo AS (SELECT v, first AS node FROM oth UNION SELECT wo.v, un.dst FROM wo JOIN un ON un.src = wo.node WHERE un.dst <> wo.v), cu AS (SELECT oth.v AS node FROM oth JOIN (SELECT v, count(*) AS m FROM wo GROUP BY 1) r ON r.v = oth.v WHERE r.m < oth.n)"""
_BTW = """pa AS (SELECT src AS s, dst AS t, [src, dst] AS p FROM un WHERE src <> dst UNION ALL SELECT pa.s, un.dst, list_append(pa.p, un.dst) FROM pa JOIN un ON un.src = pa.t WHERE NOT list_contains(pa.p, un.dst)),
sp AS (SELECT s, t, p FROM pa QUALIFY len(p) = min(len(p)) OVER (PARTITION BY s, t)), np AS (SELECT s, t, count(*) AS n FROM sp GROUP BY 1, 2), th AS (SELECT s, t, unnest(p[2:len(p) - 1]) AS node FROM sp),
rw AS (SELECT th.node, sum(1.0 / np.n) / 2 AS raw FROM th JOIN np ON np.s = th.s AND np.t = th.t GROUP BY 1), bw AS (SELECT cc.node, round(coalesce(raw, 0) / ((SELECT count(*) FROM cc) - 1) / ((SELECT count(*) FROM cc) - 2) * 2, 12) AS betweenness FROM cc LEFT JOIN rw ON rw.node = cc.node)"""


@query("g06_articulation_points", f"WITH {_CUT} SELECT node FROM cu")
def articulation(f: Facts) -> DataFrame:
    return graph.articulation_points(f.edges)


@query("g07_betweenness", f"WITH {_CC}, {_BTW} SELECT node, round(betweenness * 1e6, 4) AS millionths FROM bw")
def betweenness(f: Facts) -> DataFrame:
    return graph.betweenness(f.edges).select("node", F.round(F.col("betweenness") * 1e6, 4).alias("millionths"))


@query("g04_bridge_nodes", f"WITH {_CUT}, {_BTW} SELECT node, round(betweenness * 1e6, 4) AS millionths, node IN (SELECT node FROM cu) AS is_cut FROM bw WHERE node IN (SELECT node FROM cu) OR betweenness >= 0.1")
def bridges(f: Facts) -> DataFrame:
    return graph.bridge_nodes(f.edges).select("node", F.round(F.col("betweenness") * 1e6, 4).alias("millionths"), "is_cut")


@query("g17_spectral_gaps")
def spectral(f: Facts) -> DataFrame:
    """No SQL: an eigenvalue; tests know those of paths, rings and complete graphs."""
    return graph.spectral_gaps(f.edges)


@query("g18_pagerank", f"""WITH {_NODES}, k AS (SELECT count(*) AS n FROM nd), o AS (SELECT src, count(*) AS c FROM {{edges}} GROUP BY src),
pr0 AS (SELECT node, 1.0 / n AS r FROM nd, k), """ + ", ".join(
    f"l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM pr{i} WHERE node NOT IN (SELECT src FROM o)), pr{i + 1} AS (SELECT nd.node, 0.15 / n + 0.85 * (coalesce(g, 0) + lost / n) AS r FROM nd CROSS JOIN k CROSS JOIN l{i} LEFT JOIN (SELECT e.dst, sum(p.r / o.c) AS g FROM {{edges}} e JOIN o ON o.src = e.src JOIN pr{i} p ON p.node = e.src GROUP BY e.dst) q ON q.dst = nd.node)"
    for i in range(5)) + " SELECT node, round(r * 1000, 6) AS rank FROM pr5")
def pagerank(f: Facts) -> DataFrame:
    """The five rounds of its SQL, which are far from final; g18_pagerank_converged has the final ranks."""
    return graph.pagerank(f.edges, rounds=5).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("g18_pagerank_converged")
def pagerank_converged(f: Facts) -> DataFrame:
    """No SQL: it iterates until the ranks stand; tests compute them by plain power iteration."""
    return graph.pagerank(f.edges).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


_NEAR = """sd AS (SELECT node FROM {urgent} WHERE node IN (SELECT o_orderkey FROM {orders} WHERE o_totalprice > 490000)), u AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
b1 AS (SELECT node FROM sd UNION SELECT u.dst FROM sd JOIN u ON u.src = sd.node), ne AS (SELECT src, dst FROM {edges} WHERE src IN (SELECT node FROM b1) OR dst IN (SELECT node FROM b1))"""


def _seeds(f: Facts) -> DataFrame:
    return f.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 490000").select(F.col("o_orderkey").alias("node"))


@query("g19_neighbourhood", f"WITH {_NEAR} SELECT src, dst FROM ne")
def neighbourhood(f: Facts) -> DataFrame:
    return graph.neighbourhood(f.edges, _seeds(f))


@query("g20_topo_severity", f"""WITH {_NEAR}, nn AS (SELECT src AS node FROM ne UNION SELECT dst FROM ne), nu AS (SELECT src, dst FROM ne UNION SELECT dst, src FROM ne), nr AS (SELECT node, node AS seen FROM nn UNION SELECT nr.node, nu.dst FROM nr JOIN nu ON nu.src = nr.seen),
nc AS (SELECT count(DISTINCT c) AS b0, count(*) AS v FROM (SELECT node, min(seen) AS c FROM nr GROUP BY node)), n2 AS (SELECT count(*) AS e FROM (SELECT DISTINCT src, dst FROM ne WHERE src <> dst)), cl AS (SELECT count(DISTINCT src) AS callers FROM ne WHERE dst IN (SELECT node FROM sd))
SELECT v, e, b0, e - v + b0 AS b1, callers, round((e - v + b0) * callers / CAST(greatest(1, v) AS DOUBLE), 6) AS severity FROM nc, n2, cl""")
def topo_severity(f: Facts) -> DataFrame:
    return graph.topo_severity(f.edges, _seeds(f))


@query("g21_persistent_homology")
def homology(f: Facts) -> DataFrame:
    """No SQL: a matrix reduction; tests hold it against the Betti numbers."""
    weight = f.orders.select(F.col("o_orderkey").alias("src"), F.col("o_totalprice").alias("weight"))
    return graph.persistent_homology(f.edges.join(weight, "src").select("src", "dst", "weight"))


@query("r09_cycle_rank", f"WITH {_CC} SELECT count(*) - (SELECT count(*) FROM cc) + (SELECT count(DISTINCT component) FROM cc) AS rank FROM {{edges}}")
def cycle_rank(f: Facts) -> DataFrame:
    return graph.cycle_rank(f.edges)


@query("r12_structural_risk", f"WITH {_CUT}, {_BTW}, du AS (SELECT l_orderkey AS node, count(*) AS duties FROM {{lineitem}} GROUP BY 1) SELECT bw.node, round(betweenness * 1e6, 4) AS millionths, round(round(betweenness * (1 + coalesce(duties, 0)), 12) * 1e6, 4) AS risk FROM bw LEFT JOIN du ON du.node = bw.node WHERE bw.node IN (SELECT node FROM cu)")
def structural_risk(f: Facts) -> DataFrame:
    duties = f.lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("duties"))
    return graph.structural_risk(f.edges, duties).select("node", F.round(F.col("betweenness") * 1e6, 4).alias("millionths"), F.round(F.col("risk") * 1e6, 4).alias("risk"))


@query("g22_topology_report", f"""WITH {_CUT}, {_BTW}, {_TC}, ss AS (SELECT nd.node, least(nd.node, coalesce(min(b.src), nd.node)) AS scc FROM nd LEFT JOIN tc a ON a.src = nd.node LEFT JOIN tc b ON b.src = a.dst AND b.dst = a.src GROUP BY nd.node),
ce AS (SELECT node, betweenness FROM bw WHERE node NOT IN (SELECT node FROM cu) ORDER BY betweenness DESC, node LIMIT 10)
SELECT 'cut' AS kind, node, round(betweenness * 1e6, 4) AS value FROM bw WHERE node IN (SELECT node FROM cu) UNION ALL SELECT 'central', node, round(betweenness * 1e6, 4) FROM ce UNION ALL SELECT 'tangle', scc, CAST(count(*) AS DOUBLE) FROM ss GROUP BY scc HAVING count(*) > 1""")
def topology(f: Facts) -> DataFrame:
    return graph.topology_report(f.edges).withColumn("value", F.when(F.col("kind") == "tangle", F.col("value")).otherwise(F.round(F.col("value") * 1e6, 4)))


@query("g23_communities", f"WITH {_NODES} SELECT c.c_nationkey AS community, CAST(count(*) AS BIGINT) AS n FROM nd JOIN {{orders}} o ON o.o_orderkey = nd.node JOIN {{customer}} c ON c.c_custkey = o.o_custkey GROUP BY 1")
def communities(f: Facts) -> DataFrame:
    of = f.orders.join(f.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("node"), F.col("c_nationkey").alias("community"))
    return graph.nodes_of(f.edges).join(of, "node").groupBy("community").agg(F.count("*").alias("n"))


@query("m16_structural_coverage", f"WITH {_CUT}, fi AS (SELECT DISTINCT o.o_custkey AS file FROM cu JOIN {{orders}} o ON o.o_orderkey = cu.node) SELECT count(*) AS files, CAST(count(c.c_custkey) AS BIGINT) AS covered, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(c.c_custkey) / CAST(count(*) AS DOUBLE), 6) END AS coverage FROM fi LEFT JOIN {{customer}} c ON c.c_custkey = fi.file AND c.c_acctbal > 0")
def structural_coverage(f: Facts) -> DataFrame:
    files = f.orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").cast("string").alias("file"))
    return graph.structural_coverage(f.edges, files, f.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("file")))


# ---- the same over names: the calls among functions, and the orders' graph with names

_CALLS = """sh AS (SELECT DISTINCT name, string_split(name, '.')[-1] AS short FROM {functions}), si AS (SELECT short, min(name) AS "full" FROM sh GROUP BY short HAVING count(*) = 1),
ed AS (SELECT DISTINCT coalesce(c.caller, '__root__') AS src, CASE WHEN c.callee IN (SELECT name FROM sh) THEN c.callee ELSE coalesce(si."full", c.callee) END AS dst FROM {calls} c LEFT JOIN si ON si.short = c.callee),
un AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), la0 AS (SELECT DISTINCT src AS node, src AS c FROM un), """ + ", ".join(f"la{i + 1} AS (SELECT a.node, least(a.c, min(b.c)) AS c FROM la{i} a JOIN un ON un.src = a.node JOIN la{i} b ON b.node = un.dst GROUP BY a.node, a.c)" for i in range(8))
_NAMED = "ed AS (SELECT 'o.' || CAST(src AS STRING) AS src, 'o.' || CAST(dst AS STRING) AS dst FROM {edges}), nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), un AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), rc AS (SELECT node, node AS seen FROM nd UNION SELECT rc.node, un.dst FROM rc JOIN un ON un.src = rc.seen), cc AS (SELECT node, min(seen) AS component FROM rc GROUP BY node)"


def _named(f: Facts) -> DataFrame:
    name = lambda c: F.concat(F.lit("o."), F.col(c).cast("string")).alias(c)
    return f.edges.select(name("src"), name("dst"))


@query("g08_call_components", f"WITH {_CALLS} SELECT node, c AS component FROM la8")
def call_components(f: Facts) -> DataFrame:
    """Components of the calls; no two functions that are connected are more than eight calls apart there, which its SQL counts on."""
    return graph.components(joins.call_edges(f.calls, f.functions))


@query("g06_named_articulation_points", f"WITH {_CUT.replace(_CC, _NAMED)} SELECT node FROM cu")
def named_articulation(f: Facts) -> DataFrame:
    return graph.articulation_points(_named(f))


@query("g06_cut_files", f"WITH {_CUT} SELECT o.o_custkey AS file, CAST(count(*) AS BIGINT) AS cuts FROM cu JOIN {{orders}} o ON o.o_orderkey = cu.node GROUP BY 1")
def cut_files(f: Facts) -> DataFrame:
    return graph.cut_files(f.edges, f.orders.select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("file")))


@query("g07_named_betweenness", f"WITH {_NAMED}, {_BTW} SELECT node, round(betweenness * 1e6, 4) AS millionths FROM bw")
def named_betweenness(f: Facts) -> DataFrame:
    return graph.betweenness(_named(f)).select("node", F.round(F.col("betweenness") * 1e6, 4).alias("millionths"))


@query("g05_named_tangles", """WITH tc AS (SELECT src, dst FROM {edges} UNION SELECT tc.src, e.dst FROM tc JOIN {edges} e ON tc.dst = e.src), s2 AS (SELECT a.src AS node, min('o.' || CAST(a.dst AS STRING)) AS m FROM tc a JOIN tc b ON b.src = a.dst AND b.dst = a.src GROUP BY 1)
SELECT least(m, 'o.' || CAST(node AS STRING)) AS "primary", CAST(count(*) AS BIGINT) AS size, CAST(count(*) - 1 AS BIGINT) AS potential FROM s2 GROUP BY 1 HAVING count(*) > 1""")
def named_tangles(f: Facts) -> DataFrame:
    return graph.tangles(_named(f))


@query("t01_by_blast_radius", f"""WITH {_TC}, r AS (SELECT dst AS node, count(*) AS n FROM tc WHERE src <> dst GROUP BY 1) SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS func, CAST(coalesce(CASE WHEN o_orderstatus <> 'P' THEN r.n END, 0) AS BIGINT) AS radius
FROM {{orders}} o LEFT JOIN r ON r.node = o.o_orderkey ORDER BY radius DESC, id""")
def by_blast_radius(f: Facts) -> DataFrame:
    return graph.by_blast_radius(f.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("func")), f.edges)


@query("t08_evidence_order", f"""WITH {_CUT}, {_BTW}, fi AS (SELECT o.o_custkey AS file, round(max(bw.betweenness) * 1e6, 4) AS millionths FROM cu JOIN bw ON bw.node = cu.node JOIN {{orders}} o ON o.o_orderkey = cu.node GROUP BY 1)
SELECT CAST(file AS STRING) AS file, file IN (SELECT c_custkey FROM {{customer}} WHERE c_acctbal > 0) AS has_contract, millionths FROM fi ORDER BY has_contract, millionths DESC, file""")
def evidence_order(f: Facts) -> DataFrame:
    measured = graph.measures(f.edges).where("is_cut")
    cut = measured.select("node").join(f.orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").cast("string").alias("file")), "node")
    out = graph.evidence_order(cut, measured.select("node", "betweenness"), f.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("file")))
    return out.select("file", "has_contract", F.round(F.col("betweenness_max") * 1e6, 4).alias("millionths"))


@query("r13_dag_statistics", f"""WITH nd AS (SELECT src AS node FROM {{dag}} UNION SELECT dst FROM {{dag}}), un AS (SELECT src, dst FROM {{dag}} UNION SELECT dst, src FROM {{dag}}), rc AS (SELECT node, node AS seen FROM nd UNION SELECT rc.node, un.dst FROM rc JOIN un ON un.src = rc.seen), cc AS (SELECT node, min(seen) AS component FROM rc GROUP BY node),
{_CUT.replace(_CC + ", ", "")} SELECT (SELECT count(*) FROM cc) AS v, (SELECT count(*) FROM {{dag}}) AS e, (SELECT count(DISTINCT component) FROM cc) AS b0, (SELECT count(*) FROM {{dag}}) - (SELECT count(*) FROM cc) + (SELECT count(DISTINCT component) FROM cc) AS b1, (SELECT count(*) FROM cu) AS cuts""")
def dag_statistics(f: Facts) -> DataFrame:
    return graph.dag_statistics(f.dag)
