"""Kernels and loops against plain searches in memory."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, sequences
from factloom.plans import iterate


def random_edges(seed, n=14, m=20):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def reachable(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = set()
    for s in {x for e in edges for x in e}:
        todo, seen = [s], set()
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        out |= {(s, v) for v in seen}
    return out


def parts(nodes, edges):
    root = {v: v for v in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in nodes}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("one_task", [0, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_loops(spark, seed, one_task):
    edges = random_edges(seed)
    nodes = {x for e in edges for x in e}
    got = {tuple(r) for r in iterate.connected_components(frame(spark, edges), one_task_edges=one_task).collect()}
    assert got == set(parts(nodes, edges).items())
    closed = reachable(edges)
    seeds = spark.createDataFrame([(edges[0][0],)], "node long")
    depth = {r.node: r.depth for r in iterate.reach(frame(spark, edges), seeds, one_task_edges=one_task).collect()}
    assert set(depth) == {b for a, b in closed if a == edges[0][0]} | {edges[0][0]} and depth[edges[0][0]] == 0
    guard = spark.createDataFrame([(edges[0][1],)], "node long")
    kept = {r.node for r in iterate.reach(frame(spark, edges), seeds, guard=guard, one_task_edges=one_task).collect()}
    assert kept == {b for a, b in reachable([e for e in edges if e[1] != edges[0][1]]) if a == edges[0][0]} | {edges[0][0]}


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_strong(spark, seed):
    edges = random_edges(seed)
    closed = reachable(edges)
    assert {tuple(r) for r in iterate.closure(frame(spark, edges)).collect()} == closed
    nodes = {x for e in edges for x in e}
    want = {v: min([v, *(b for a, b in closed if a == v and (b, v) in closed)]) for v in nodes}
    assert {r.node: r.scc for r in graph.strong_components(frame(spark, edges)).collect()} == want
    named = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "src string, dst string")
    assert {r.node: r.scc for r in graph.strong_components(named).collect()} == {f"n{k:02}": f"n{v:02}" for k, v in want.items()}


@pytest.mark.parametrize("seed", range(6))
def test_cut_vertices_and_betweenness(seed):
    edges = [(a, b) for a, b in random_edges(seed, 12, 16) if a != b]
    nodes, near = graph.adjacency(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    ids = nodes.tolist()
    count = lambda keep: len(set(parts(keep, [e for e in edges if set(e) <= keep]).values()))
    every = set(ids)
    cut = {v for v in ids if count(every - {v}) > count(every) - (not any(v in e for e in edges))}
    assert {ids[i] for i in graph.cut_vertices(near)} == cut
    want = np.zeros(len(ids))
    for s, t in itertools.combinations(range(len(ids)), 2):
        paths, level = [], [[s]]
        while level and not paths:
            level = [p + [v] for p in level for v in near[p[-1]] if v not in p]
            paths = [p for p in level if p[-1] == t]
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1 / len(paths)
    assert graph.betweenness_of(near) == pytest.approx(want)


def test_spectra():
    ring = [[(i - 1) % 6, (i + 1) % 6] for i in range(6)]
    assert graph.fiedler(ring) == pytest.approx(1 - np.cos(2 * np.pi / 6))
    assert graph.fiedler([[j for j in range(5) if j != i] for i in range(5)]) == pytest.approx(5 / 4)
    assert graph.fiedler([[1], [0]]) == 1.0


@pytest.mark.parametrize("seed", range(4))
def test_homology(seed):
    """Infinite bars are the Betti numbers of the flag complex."""
    edges = [(a, b, random.Random(seed + a * 99 + b).random()) for a, b in random_edges(seed, 9, 18) if a != b]
    pairs = {(min(a, b), max(a, b)) for a, b, _ in edges}
    nodes = sorted({x for e in pairs for x in e})
    triangles = [t for t in itertools.combinations(nodes, 3) if all(p in pairs for p in itertools.combinations(t, 2))]
    rows = sorted(pairs)
    d2 = np.zeros((len(rows), len(triangles)), int)
    for j, t in enumerate(triangles):
        for p in itertools.combinations(t, 2):
            d2[rows.index(p), j] = 1
    m, rank = d2.copy(), 0
    for c in range(m.shape[1]):
        at = next((i for i in range(rank, len(m)) if m[i, c]), None)
        if at is not None:
            m[[rank, at]] = m[[at, rank]]
            for i in range(len(m)):
                if i != rank and m[i, c]:
                    m[i] ^= m[rank]
            rank += 1
    c = len(set(parts(nodes, pairs).values()))
    bars = graph.persistence(edges)
    assert sum(d == 0 and np.isinf(x) for d, _, x in bars) == c
    assert sum(d == 1 and np.isinf(x) for d, _, x in bars) == len(pairs) - len(nodes) + c - rank


def test_full_reduction(spark):
    edges = [(0, 1), (1, 2), (2, 1), (1, 3), (0, 3), (9, 9), (4, 5), (5, 4)]
    r = graph.reduce_fully(frame(spark, edges), spark.createDataFrame([(0,)], "node long")).first()
    assert (r.nodes_before, r.edges_before, r.nodes_after, r.edges_after) == (7, 8, 3, 2)


def test_small_reports(spark):
    path = frame(spark, [(0, 1), (1, 2), (2, 3)])
    assert {(r.node, round(r.betweenness, 6)) for r in graph.betweenness(path).collect()} == {(0, 0.0), (1, 0.666667), (2, 0.666667), (3, 0.0)}
    assert [r.node for r in graph.bridge_nodes(path).collect()] == [1, 2]
    duties = spark.createDataFrame([(1, 3)], "node long, duties long")
    assert [(r.node, round(r.risk, 6)) for r in graph.structural_risk(path, duties).collect()] == [(1, 2.666667), (2, 0.666667)]
    report = graph.topology_report(path).collect()
    assert {(r.kind, r.node) for r in report} == {("cut", 1), ("cut", 2), ("central", 0), ("central", 3)}
    files = spark.createDataFrame([(1, "a/x.py"), (2, "a/y.py"), (3, "z.py")], "node long, file string")
    assert graph.structural_coverage(path, files, spark.createDataFrame([("x.py",)], "file string")).first().coverage == 0.5
    assert graph.topo_severity(frame(spark, [(0, 1), (1, 2), (2, 0)]), spark.createDataFrame([(0,)], "node long")).first().severity == pytest.approx(1 / 3, abs=1e-6)
    assert {r.gap for r in graph.spectral_gaps(path).collect()} == {0.5}
    assert graph.persistent_homology(spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "src long, dst long, weight double")).count() == 1


def test_levels_with_a_cycle(spark):
    steps = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b", "d"]), ("d", ["c"])], "step string, depends_on array<string>")
    assert {r.step: r.level for r in sequences.topological_levels(steps).collect()} == {"a": 0, "b": 1, "c": None, "d": None}


def final_ranks(edges, rounds=300):
    edges = set(edges)
    nodes = sorted({x for e in edges for x in e})
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(rank[v] for v in nodes if not out[v])
        after = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for v in nodes:
            for b in out[v]:
                after[b] += 0.85 * rank[v] / len(out[v])
        rank = after
    return rank


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_pagerank_converges(spark, one_task):
    """A slow chain into a cycle, with a dangling end: final ranks, in one task and round by round."""
    edges = [*((i, i + 1) for i in range(12)), (12, 10), (3, 20), (3, 20), (0, 20), (12, 12)]
    want = final_ranks(edges)
    got = {r.node: r["rank"] for r in graph.pagerank(frame(spark, edges), one_task_edges=one_task, tolerance=1e-3 if one_task == 0 else 1e-6).collect()}
    assert set(got) == set(want) and sum(abs(got[v] - want[v]) for v in want) < (1e-2 if one_task == 0 else 1e-5)
    five = [{r.node: r["rank"] for r in graph.pagerank(frame(spark, edges), rounds=5, one_task_edges=t).collect()} for t in (0, one_task)]
    assert five[0] == pytest.approx(five[1]) and sum(abs(five[0][v] - want[v]) for v in want) > 1e-2


def test_pagerank_query_is_final(spark):
    from conftest import SMALL

    from factloom.plans import catalog
    from factloom.plans.facts import Facts

    f = Facts(spark, SMALL)
    want = final_ranks([tuple(r) for r in f.edges.select("src", "dst").collect()], 100)
    got = {r.node: r["rank"] / 1000 for r in catalog.callables()["g18_pagerank_converged"](spark, SMALL).collect()}
    assert set(got) == set(want) and sum(abs(got[v] - want[v]) for v in want) < 1e-5


def _random_edges(seed, n, m, acyclic=False):
    r = random.Random(seed)
    out = set()
    for _ in range(m):
        a, b = r.randrange(n), r.randrange(n)
        if acyclic:
            a, b = min(a, b), max(a, b)
        if not acyclic or a != b:
            out.add((a, b))
    return sorted(out)


@pytest.mark.parametrize("bits", [graph.BITS, 3])
@pytest.mark.parametrize("named", [False, True])
def test_radius_and_reduction(spark, bits, named):
    """Bits of one task and rounds over the cluster give what plain searches give, for ids and for names."""
    name = (lambda x: f"n{x:03d}") if named else (lambda x: x)
    kind = "string" if named else "long"
    for acyclic in (False, True):
        edges = [(name(a), name(b)) for a, b in _random_edges(4, 40, 60, acyclic)]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)

        def reached(x):
            seen, todo = set(), [x]
            while todo:
                for v in near.get(todo.pop(), ()):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            return seen

        nodes = sorted({x for e in edges for x in e})
        df = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
        if not acyclic:
            want = {v: sum(v in reached(u) for u in nodes if u != v) for v in nodes}
            want[name(999)] = 0
            got = graph.blast_radius(df, spark.createDataFrame([(x,) for x in want], f"node {kind}"), bits=bits)
            assert {r.node: r.radius for r in got.collect()} == want
            pairs = graph.all_paths(df, bits=bits).collect()
            assert len(pairs) == len(set(pairs)) and {tuple(r) for r in pairs} == {(u, v) for u in nodes for v in reached(u)}
        else:
            want = {(a, b) for a, b in edges if not any(b in reached(c) for c in near[a] if c != b)}
            assert {tuple(r) for r in graph.transitive_reduction(df, bits=bits).collect()} == want


@pytest.mark.parametrize("search", [graph.SEARCH, 50])
def test_betweenness_in_shares(spark, search):
    """Shares of sources, on named nodes and several components, sum to the whole."""
    edges = [(f"n{a:02d}", f"n{b:02d}") for a, b in _random_edges(7, 25, 30)]
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    near = [set() for _ in nodes]
    for a, b in edges:
        if a != b:
            near[place[a]].add(place[b])
            near[place[b]].add(place[a])
    raw = graph.betweenness_of([sorted(x) for x in near])
    pairs = (len(nodes) - 1) * (len(nodes) - 2) / 2
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src string, dst string"), search=search).collect()}
    assert got == {x: pytest.approx(raw[i] / pairs, abs=1e-11) for x, i in place.items()}


def test_components_of_names(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), ("q", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for limit in (2_000_000, 0):
        assert {(r.node, r.component) for r in iterate.connected_components(df, one_task_edges=limit).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}


def test_spectral_gap_of_large_graphs():
    """Lanczos steps on neighbour lists against the whole matrix, and a ring's known value."""
    r = random.Random(1)
    n = 450
    near = [set() for _ in range(n)]
    for i in range(1, n):
        for j in {r.randrange(i), max(0, i - 1)}:
            near[i].add(j)
            near[j].add(i)
    near = [sorted(x) for x in near]
    a = np.zeros((n, n))
    for u, x in enumerate(near):
        a[u, x] = 1
    d = 1 / np.sqrt(a.sum(1))
    assert graph.fiedler(near) == pytest.approx(np.linalg.eigvalsh(np.eye(n) - d[:, None] * a * d[None, :])[1], abs=1e-6)


def test_long_chain(spark):
    """Reachability goes on to the end of a chain, however long."""
    m = 12_000
    chain = spark.range(m).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert iterate.reach(chain, spark.createDataFrame([(0,)], "node long")).count() == m + 1
