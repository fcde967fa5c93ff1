"""Graph operators over edges(src, dst). Loops are in ``plans.iterate``; kernels take one component's edges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.iterate import Labelled, closure, connected_components, labelled, reach, spread
from factloom.plans.ranges import by_ranges
from factloom.plans.scratch import Scratch

ROOTS = ("main", "run", "cli", "app", "setup", "handler", "start", "execute", "serve", "__root__")


def _kind(edges: DataFrame) -> str:
    """The type of nodes as kernels see it."""
    return "string" if edges.schema["src"].dataType.typeName() == "string" else "long"


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return reach(edges, seeds).where("depth > 0").select("node")


def callers(edges: DataFrame, name) -> DataFrame:
    return edges.where(F.col("dst") == F.lit(name)).select("src").distinct()


#: Vertices up to which a component's reachability is held as sets of bits in one task.
BITS = 20_000


def _reach_bits(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[int], list[int], dict[int, int]]:
    """Nodes, each one's strong component (its least node's place), how many nodes each has, and by component a set of bits of the components that it reaches, its own only on a cycle."""
    nodes, scc = strong_of(src, dst)
    of = np.searchsorted(nodes, scc).tolist()
    size = np.bincount(of, minlength=len(nodes)).tolist()
    near: dict[int, set[int]] = {}
    loops = set()
    for a, b in zip(np.searchsorted(nodes, src).tolist(), np.searchsorted(nodes, dst).tolist()):
        near.setdefault(of[a], set()).add(of[b])
        if a == b:
            loops.add(of[a])
    bits: dict[int, int] = {}
    for root in set(of):
        stack = [root]
        while stack:
            u = stack[-1]
            if u in bits:
                stack.pop()
                continue
            todo = [v for v in near.get(u, ()) if v != u and v not in bits]
            if todo:
                stack += todo
                continue
            x = 1 << u if size[u] > 1 or u in loops else 0
            for v in near.get(u, ()):
                if v != u:
                    x |= 1 << v | bits[v]
            bits[u] = x
            stack.pop()
    return nodes, of, size, bits


def _by_component(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def every(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(x) for _, x in pdf.groupby("component", sort=False)], ignore_index=True)

    return every


def _weight(x: int, size: np.ndarray) -> int:
    """Sum of the sizes at the set bits; a few of them one by one, as components held together lie far apart in the bits."""
    if x.bit_count() > 64:
        held = np.unpackbits(np.frombuffer(x.to_bytes(-(-x.bit_length() // 8), "little"), np.uint8), bitorder="little")
        return int(size[: len(held)] @ held[: len(size)])
    n = 0
    while x:
        low = x & -x
        n += int(size[low.bit_length() - 1])
        x ^= low
    return n


def _radii(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each node how many others reach it."""
    nodes, of, size, bits = _reach_bits(pdf["dst"].to_numpy(), pdf["src"].to_numpy())
    held: dict[int, int] = {}
    plain, sizes = all(s <= 1 for s in size), np.array(size)
    for c, x in bits.items():
        n = x.bit_count() if plain else _weight(x, sizes)
        held[c] = n - 1 if x >> c & 1 else n
    return pd.DataFrame({"node": nodes, "radius": [held[c] for c in of]})


def _reduced(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of an acyclic graph that no other path replaces."""
    nodes, of, _, bits = _reach_bits(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    near: dict[int, list[int]] = {}
    for a, b in zip(np.searchsorted(nodes, pdf["src"]).tolist(), np.searchsorted(nodes, pdf["dst"]).tolist()):
        near.setdefault(a, []).append(b)
    out = []
    for a, b in near.items():
        over = 0
        for x in b:
            over |= bits[of[x]]
        out += [(a, x) for x in b if not over >> of[x] & 1]
    return pd.DataFrame({"src": nodes[[a for a, _ in out]], "dst": nodes[[b for _, b in out]]}) if out else pdf.iloc[:0][["src", "dst"]]


def _paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a node and one that it reaches by an edge or more."""
    nodes, of, _, bits = _reach_bits(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    members: dict[int, list[int]] = {}
    for i, c in enumerate(of):
        members.setdefault(c, []).append(i)
    src, dst = [], []
    for c, x in bits.items():
        to = [i for b in members if x >> b & 1 for i in members[b]]
        for u in members[c]:
            src += [u] * len(to)
            dst += to
    return pd.DataFrame({"src": nodes[src], "dst": nodes[dst]}) if src else pdf.iloc[:0][["src", "dst"]]


def all_paths(edges: DataFrame, *, bits: int = BITS // 10) -> DataFrame:
    """All (src, dst) with a path of one edge or more; components of up to ``bits`` vertices in one task each, larger ones by rounds. The result is quadratic in a component."""
    with Scratch(edges.sparkSession) as s:
        a = labelled(edges.select("src", "dst").distinct(), s)
        small, large = _by_size(a, s, bits)
        kind = _kind(edges)
        pairs = _in_partitions(s.keep(small), a.rows, _paths, f"src {kind}, dst {kind}")  # kept are the edges, as the pairs are many more
        return pairs if large is None else pairs.unionByName(closure(large))


def _by_size(a: Labelled, s: Scratch, most: int) -> tuple[DataFrame, DataFrame | None]:
    """edges with their component: those of components of up to ``most`` vertices, and the others, None if there are none."""
    big = s.keep(a.sizes.where(F.col("v") > most).select("component"))  # one of ``most`` vertices at the most
    if big.isEmpty():
        return a.held, None
    return a.held.join(F.broadcast(big), "component", "left_anti"), s.keep(a.held.join(F.broadcast(big), "component", "left_semi").select("src", "dst"))


#: Edges from which on a kernel is run on the components gathered, and of those whose work or memory grows faster than that.
CHUNK, FEW = 20_000, 2_000


def _chunks(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Rows that come in order of ``keys``, cut only where these change, each time ``most`` are held: a task holds one component and so many rows, however large its partition is."""
    held, n, last = [], 0, None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        ends = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
        if last is not None and (k[0] != last).any():
            ends.insert(0, 0)
        at, last = 0, k[-1]
        for end in ends:
            if n + end - at >= most:
                yield pd.concat([*held, b.iloc[at:end]], ignore_index=True)
                held, n, at = [], 0, end
        held.append(b.iloc[at:])
        n += len(b) - at
    if n:
        yield pd.concat(held, ignore_index=True)


def _in_partitions(held: DataFrame, rows: int, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, keys: tuple[str, ...] = ("component",), chunk: int = FEW) -> DataFrame:
    """The kernel's rows for whole components, several at a time, of edges with their component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(kernel, _chunks(batches, list(keys), chunk))

    return spread(held, rows, *keys, each=200_000).sortWithinPartitions(*keys).select(*keys, *[c for c in held.columns if c not in keys]).mapInPandas(run, schema)


def _with(done: DataFrame | None, rest: DataFrame) -> DataFrame:
    """Rows of components that were whole in a range of nodes, and of the gathered ones."""
    return rest if done is None else done.unionByName(rest)


def blast_radius(edges: DataFrame, targets: DataFrame, *, bits: int = BITS) -> DataFrame:
    """targets(node) with ``radius``, how many others can reach it.

    Components of up to ``bits`` vertices are counted in one task each; in larger ones pairs of target and ancestor
    grow by rounds over the cluster. Both give the same numbers.
    """
    with Scratch(edges.sparkSession) as s:
        schema = f"node {_kind(edges)}, radius long"
        done, a = by_ranges(edges.select("src", "dst").distinct(), s, _radii, schema, chunk=FEW, too_large=lambda v, e: v > bits)
        asked = s.save(targets.select("node").distinct())
        small, large = _by_size(a, s, bits)
        counted = _with(done, _in_partitions(small, a.rows, _radii, schema))
        out = asked.join(counted, "node", "left").select("node", F.coalesce("radius", F.lit(0)).cast("long").alias("radius"))
        if large is None:
            return s.keep(out)
        back = s.save(large.select(F.col("dst").alias("at"), F.col("src").alias("up")).where("dst <> src"))
        seen = delta = s.save(asked.join(back.select(F.explode(F.array("at", "up")).alias("node")).distinct(), "node", "left_semi").withColumn("anc", F.col("node")))
        while not delta.isEmpty():
            found = delta.join(back, delta["anc"] == back["at"]).select("node", F.col("up").alias("anc")).distinct()
            delta = s.save(found.join(seen, ["node", "anc"], "left_anti"))
            seen = seen.unionByName(delta)
        more = seen.groupBy("node").agg((F.count("*") - 1).alias("r"))
        return s.keep(out.join(more, "node", "left").select("node", F.coalesce("r", "radius").alias("radius")))


def by_blast_radius(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points(func, ...) with the ``radius`` of their function, 0 for those of none, the widest first."""
    r = blast_radius(edges, points.where("func is not null").select(F.col("func").alias("node"))).withColumnRenamed("node", "func")
    return points.join(r, "func", "left").fillna(0, ["radius"]).orderBy(F.desc("radius"), *[c for c in points.columns])


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def betti(edges: DataFrame, *, directed: bool = False) -> DataFrame:
    """One row: vertices, edges (self-loops apart), components and independent cycles E - V + C."""
    e = edges.where("src <> dst")
    e = e.select("src", "dst").distinct() if directed else e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    c = connected_components(edges).agg(F.countDistinct("component").alias("b0"), F.count("*").alias("v"))
    return e.agg(F.count("*").alias("e")).crossJoin(c).select("v", "e", "b0", (F.col("e") - F.col("v") + F.col("b0")).alias("b1"))


def strong_of(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's strong component, by one depth-first search without recursion."""
    nodes, idx = np.unique(np.concatenate([src, dst]), return_inverse=True)
    near: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(idx[: len(src)].tolist(), idx[len(src) :].tolist()):
        near[a].append(b)
    n = len(nodes)
    order, low, scc, place, clock, held = [-1] * n, [0] * n, [-1] * n, [0] * n, 0, []
    for root in range(n):
        if order[root] >= 0:
            continue
        stack = [(root, -1)]
        while stack:
            u, k = stack.pop()
            if k < 0:
                order[u] = low[u] = clock
                place[u] = len(held)
                clock += 1
                held.append(u)
            for i in range(max(k, 0), len(near[u])):
                v = near[u][i]
                if order[v] < 0:
                    stack += [(u, i), (v, -1)]
                    break
                if scc[v] < 0:
                    low[u] = min(low[u], low[v])
            else:
                if low[u] == order[u]:
                    least = min(held[place[u] :])
                    for v in held[place[u] :]:
                        scc[v] = least
                    del held[place[u] :]
    return nodes, nodes[np.array(scc, np.int64)]


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, scc = strong_of(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    return pd.DataFrame({"node": nodes, "scc": scc})


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): the least node that reaches and is reached, itself at least.

    One search over weakly connected components, each in one task; nodes are integers or names.
    """
    kind = _kind(edges)
    return per_partition(edges, _strong, f"node {kind}, scc {kind}")


def _tangled(pdf: pd.DataFrame) -> pd.DataFrame:
    _, scc = strong_of(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    primary, size = np.unique(scc, return_counts=True)
    return pd.DataFrame({"primary": primary[size > 1], "size": size[size > 1]})


def tangles(edges: DataFrame) -> DataFrame:
    """(primary, size, potential) of strong components of two nodes or more."""
    return per_partition(edges, _tangled, f"primary {_kind(edges)}, size long").withColumn("potential", F.col("size") - 1)


def degrees(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    o = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in"))
    return o.join(i, "node", "full").fillna(0, ["out", "in"]).select("node", "in", "out")


def passthroughs(edges: DataFrame, functions: DataFrame) -> DataFrame:
    return degrees(edges).where("`in` = 1 and out = 1").join(functions.select("node").distinct(), "node", "left_semi").select("node", F.lit(3).cast("long").alias("potential"))


def hubs(edges: DataFrame, *, threshold: int = 8) -> DataFrame:
    """Nodes of at least so many callees; the potential the reference formula gives them is never above 0."""
    return degrees(edges).where(F.col("out") >= threshold).select("node", "out", F.greatest(F.lit(0), F.col("out") - 4 * F.ceil(F.col("out") / 4)).cast("long").alias("potential"))


def candidates(edges: DataFrame, functions: DataFrame, *, threshold: int = 8) -> DataFrame:
    a = tangles(edges).select(F.lit("tangle").alias("kind"), F.col("primary").alias("node"), "potential")
    b = passthroughs(edges, functions).select(F.lit("passthrough").alias("kind"), "node", "potential")
    c = hubs(edges, threshold=threshold).select(F.lit("hub").alias("kind"), "node", "potential")
    return a.unionByName(b).unionByName(c).orderBy(F.desc("potential"), "kind", "node")


def _roots(e: DataFrame, names: tuple[str, ...] = ROOTS) -> DataFrame:
    short = F.element_at(F.split(F.col("node").cast("string"), r"\."), -1)
    n = nodes_of(e)
    return n.join(e.select(F.col("dst").alias("node")), "node", "left_anti").unionByName(n.where(short.isin(*names))).distinct()


def live_roots(edges: DataFrame, *, names: tuple[str, ...] = ROOTS) -> DataFrame:
    """Nodes that none calls or of a root's name; every node if there is none."""
    e = edges.select("src", "dst").distinct()
    roots = _roots(e, names)
    return nodes_of(e) if roots.isEmpty() else roots


def contract(edges: DataFrame, scc: DataFrame) -> DataFrame:
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("s")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    return edges.join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def dead(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes_of(edges).join(reach(edges, roots).select("node"), "node", "left_anti")


def transitive_reduction(edges: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Edges of a DAG that no longer path replaces; components of up to ``bits`` vertices in one task each, larger ones by their closure."""
    with Scratch(edges.sparkSession) as s:
        schema = f"src {_kind(edges)}, dst {_kind(edges)}"
        done, a = by_ranges(edges.where("src <> dst").select("src", "dst").distinct(), s, _reduced, schema, chunk=FEW, too_large=lambda v, e: v > bits)
        small, large = _by_size(a, s, bits)
        kept = s.keep(_with(done, _in_partitions(small, a.rows, _reduced, schema)))
        if large is None:
            return kept
        c = closure(large)
        longer = large.select("src", F.col("dst").alias("mid")).join(c.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        return kept.unionByName(s.keep(large.join(longer, ["src", "dst"], "left_anti")))


def _reduction(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of whole components before and after, and which nodes and edges were left if each node were a root, in components without one."""
    nodes, scc = strong_of(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    a, b = np.searchsorted(nodes, pdf["src"].to_numpy()), np.searchsorted(nodes, pdf["dst"].to_numpy())
    of = np.searchsorted(nodes, scc)
    given = np.zeros(len(nodes), bool)
    given[a[pdf["src_root"].to_numpy(bool)]] = True
    given[b[pdf["dst_root"].to_numpy(bool)]] = True
    small = pd.DataFrame({"src": of[a], "dst": of[b]})
    small = small[small["src"] != small["dst"]].drop_duplicates()
    near: dict[int, list[int]] = {}
    for u, v in zip(small["src"].tolist(), small["dst"].tolist()):
        near.setdefault(u, []).append(v)
    todo = np.unique(of[given]).tolist()
    alive = set(todo)
    while todo:
        for v in near.get(todo.pop(), ()):
            if v not in alive:
                alive.add(v)
                todo.append(v)
    label = np.zeros(len(nodes), np.int64)
    label[a] = label[b] = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
    rooted = np.zeros(label.max() + 1, bool)
    rooted[label[given]] = True
    bare = [c for c in np.unique(of).tolist() if not rooted[label[c]]]
    count = lambda kept: len(_reduced(small[small["src"].isin(kept) & small["dst"].isin(kept)])) if len(small) else 0
    return pd.DataFrame({"nodes_before": [len(nodes)], "edges_before": [len(pdf)], "nodes_after": [len(alive)], "edges_after": [count(alive)], "bare_nodes": [len(bare)], "bare_edges": [count(bare) if bare else 0], "rooted": [bool(given.any())]})


def _reduction_from_roots(pdf: pd.DataFrame, names: tuple[str, ...] = ROOTS) -> pd.DataFrame:
    """The same from edges alone: roots are nodes that none calls or of a root's name."""
    called = set(pdf["dst"])
    is_root = lambda x: x not in called or str(x).rsplit(".", 1)[-1] in names
    return _reduction(pdf.assign(src_root=[is_root(x) for x in pdf["src"]], dst_root=[is_root(x) for x in pdf["dst"]]))


def _reduce_by_rounds(e: DataFrame, start: DataFrame, s: Scratch) -> DataFrame:
    """The same counts of a component too large for bits: strong components in one task, the rest over the cluster."""
    scc = s.keep(strong_components(e))
    small = s.keep(contract(e, scc))
    seeds = start.join(scc, "node").select(F.col("scc").alias("node")).distinct()
    alive = s.keep(reach(small, seeds).select("node"))
    kept = small.join(alive.select(F.col("node").alias("src")), "src", "left_semi").join(alive.select(F.col("node").alias("dst")), "dst", "left_semi")
    final = s.keep(transitive_reduction(kept))
    return nodes_of(e).agg(F.count("*").alias("nodes_before")).crossJoin(e.agg(F.count("*").alias("edges_before"))).crossJoin(alive.agg(F.count("*").alias("nodes_after"))).crossJoin(final.agg(F.count("*").alias("edges_after")))


def reduce_fully(edges: DataFrame, roots: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """One row of counts before and after: contract tangles, drop what is dead, drop replaceable edges.

    All of it is done within a component: those of up to ``bits`` vertices are reduced in one task each. The live roots,
    unless given, are nodes that none calls or of a root's name; every node if there is none in the whole graph.
    """
    names = ["nodes_before", "edges_before", "nodes_after", "edges_after"]
    with Scratch(edges.sparkSession) as s:
        schema, e = ", ".join(f"{x} long" for x in [*names, "bare_nodes", "bare_edges"]) + ", rooted boolean", edges.select("src", "dst").distinct()
        done, a = by_ranges(e, s, _reduction_from_roots, schema, chunk=FEW, too_large=lambda v, e: v > bits) if roots is None else (None, labelled(e, s))
        start = s.save((roots if roots is not None else _roots(a.edges)).select("node").distinct())
        none = roots is None and start.isEmpty() and (done is None or done.where("rooted").isEmpty())
        small, large = _by_size(a, s, bits)
        flag = lambda c: start.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_root"))
        marked = small.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").fillna(False, ["src_root", "dst_root"]).select("component", "src", "dst", "src_root", "dst_root")
        counts = _with(done, _in_partitions(marked, a.rows, _reduction, schema))
        if none:
            counts = counts.withColumn("nodes_after", F.col("bare_nodes")).withColumn("edges_after", F.col("bare_edges"))
        counts = counts.select(names)
        if large is not None:
            counts = counts.unionByName(_reduce_by_rounds(large, nodes_of(large) if none else start, s))
        return s.keep(counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in names]))


def _rank_in_one_task(damping: float, rounds: int | None, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        codes = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).dictionary_encode().combine_chunks()
        n, names = len(codes.dictionary), codes.dictionary
        src, dst = np.split(codes.indices.to_numpy(zero_copy_only=False), [t.num_rows])
        out = np.bincount(src, minlength=n)
        rank, k, change = np.full(n, 1 / n), 0, np.inf
        while k < rounds if rounds is not None else change >= tolerance:
            given = np.bincount(dst, (rank / np.maximum(out, 1))[src], n)
            after = (1 - damping) / n + damping * (given + rank[out == 0].sum() / n)
            rank, k, change = after, k + 1, np.abs(after - rank).sum()
        yield pa.RecordBatch.from_arrays([names, pa.array(rank)], names=["node", "rank"])

    return run


def _terms(damping: float, rounds: int | None, tolerance: float):
    """Of whole components: of each node the first ``rounds`` + 1 powers of the damped step from ones, or else their sum as soon as it stands, and whether the node has no edge out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, idx = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        n, src, dst = len(nodes), idx[: len(pdf)], idx[len(pdf) :]
        out = np.bincount(src, minlength=n)
        share = damping / np.maximum(out, 1)
        x = np.ones(n)
        held = [x]
        while len(held) <= rounds if rounds is not None else x.sum() >= tolerance * n:
            x = np.bincount(dst, (share * x)[src], n)
            held = [*held, x] if rounds is not None else [held[0] + x]
        return pd.DataFrame({"node": nodes, "terms": list(np.stack(held, 1)), "is_end": out == 0})

    return run


def _terms_by_rounds(e: DataFrame, damping: float, rounds: int | None, tolerance: float, s: Scratch) -> DataFrame:
    """The same of components too large for one task, round by round over the cluster."""
    e = s.save(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src"))
    nodes = nodes_of(e).join(e.select(F.col("src").alias("node"), F.lit(False).alias("is_end")).distinct(), "node", "left").fillna(True, ["is_end"])
    last = s.save(nodes.withColumn("terms", F.array(F.lit(1.0))).withColumn("x", F.lit(1.0)))
    n, k, left = last.count(), 0, float("inf")
    while k < rounds if rounds is not None else left >= tolerance * n:
        given = e.join(last, e["src"] == last["node"]).groupBy(F.col("dst").alias("node")).agg((damping * F.sum(F.col("x") / F.col("out"))).alias("g"))
        x = F.coalesce("g", F.lit(0.0))
        terms = F.concat("terms", F.array(x)) if rounds is not None else F.array(F.col("terms")[0] + x)
        last = s.save(last.join(given, "node", "left").select("node", "is_end", terms.alias("terms"), x.alias("x")))
        k += 1
        if rounds is None:
            left = last.agg(F.sum("x")).first()[0]
    return last.select("node", "terms", "is_end")


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, one_task_edges: int = 2_000_000) -> DataFrame:
    """(node, rank) when a round changes the ranks by less than ``tolerance`` in all, or after so many rounds if given.

    What dangling nodes hold is spread over all, so components meet only in one number a round: a node's ranks are sums of the powers
    of the damped step from ones, which a component has by itself. Final ranks are the sum of all powers over its total. Up to
    ``one_task_edges`` counted edges are ranked in one task; of more, components of up to so many vertices are gathered and ranked in one
    task each, larger ones round by round over the cluster. All give the same ranks.
    """
    with Scratch(edges.sparkSession) as s:
        e = s.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        if e.count() <= one_task_edges:
            return s.keep(e.coalesce(1).mapInArrow(_rank_in_one_task(damping, rounds, tolerance), f"node {e.schema['src'].dataType.simpleString()}, rank double"))
        a = labelled(e, s)
        small, large = _by_size(a, s, one_task_edges)
        least = tolerance * (1 - damping)  # the rest of the sum is then below the tolerance
        terms = s.save(_in_partitions(small, a.rows, _terms(damping, rounds, least / 1000), f"node {_kind(edges)}, terms array<double>, is_end boolean", chunk=CHUNK))
        if large is not None:
            terms = s.save(terms.unionByName(_terms_by_rounds(large, damping, rounds, least, s)))
        size = (rounds or 0) + 1
        total = terms.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("terms")[j]), F.lit(0.0)).alias(f"all{j}") for j in range(size)], *[F.coalesce(F.sum(F.when(F.col("is_end"), F.col("terms")[j])), F.lit(0.0)).alias(f"lost{j}") for j in range(size)]).first()
        if rounds is None:
            weights = [1 / total["all0"]]
        else:
            weights, n = [1 / total["n"]], total["n"]  # of the powers in the ranks so far; a round moves all by one and adds what is spread
            for _ in range(rounds):
                lost = sum(w * total[f"lost{j}"] for j, w in enumerate(weights))
                weights = [(1 - damping + damping * lost) / n, *weights]
        rank = F.lit(0.0)
        for j, w in enumerate(weights):
            rank = rank + w * F.col("terms")[j]
        return s.keep(terms.select("node", rank.alias("rank")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, *, hops: int = 2) -> DataFrame:
    """(src, dst) seen within so many hops of the seeds, directions aside."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = reach(both, seeds, max_rounds=hops - 1).select("node")
    e = edges.select("src", "dst").distinct()
    return e.join(near.select(F.col("node").alias("src")), "src", "left_semi").unionByName(e.join(near.select(F.col("node").alias("dst")), "dst", "left_semi")).distinct()


# ---- kernels: one component's edges in one task

def adjacency(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    nodes, idx = np.unique(np.concatenate([src, dst]), return_inverse=True)
    near: list[set[int]] = [set() for _ in nodes]
    for a, b in zip(idx[: len(src)].tolist(), idx[len(src) :].tolist()):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return nodes, [sorted(x) for x in near]


def cut_vertices(near: list[list[int]]) -> set[int]:
    """Vertices whose removal splits their component, by one depth-first search without recursion."""
    n = len(near)
    order, low, parent, cut, clock = [-1] * n, [0] * n, [-1] * n, set(), 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack, children = [(root, iter(near[root]))], 0
        while stack:
            u, it = stack[-1]
            v = next(it, None)
            if v is None:
                stack.pop()
                p = parent[u]
                if p >= 0:
                    low[p] = min(low[p], low[u])
                    if p != root and low[u] >= order[p]:
                        cut.add(p)
            elif order[v] < 0:
                parent[v] = u
                children += u == root
                order[v] = low[v] = clock
                clock += 1
                stack.append((v, iter(near[v])))
            elif v != parent[u]:
                low[u] = min(low[u], order[v])
        if children > 1:
            cut.add(root)
    return cut


def betweenness_of(near: list[list[int]], sources: Iterable[int] | None = None) -> np.ndarray:
    """Shortest-path betweenness, not normalised, each pair counted from both ends and halved."""
    out = [0.0] * len(near)
    for s in range(len(near)) if sources is None else sources:
        dist, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, [s]  # of what is reached, however large the rest
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v], before[v] = dist[u] + 1, 0.0, []
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
                    before[v].append(u)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                out[v] += share[v]
    return np.array(out) / 2


DENSE = 400


def fiedler(near: list[list[int]]) -> float:
    """Second least eigenvalue of the normalised Laplacian of a connected graph; 1 below three vertices.

    Up to DENSE vertices from the whole matrix; beyond it by Lanczos steps on the neighbour lists, in memory of
    300 vectors at most, kept apart from the known first eigenvector, until the value stands.
    """
    n = len(near)
    if n < 3:
        return 1.0
    size = np.array([len(x) for x in near])
    d = 1 / np.sqrt(np.maximum(size, 1))
    if n <= DENSE:
        a = np.zeros((n, n))
        for u, x in enumerate(near):
            a[u, x] = 1
        return float(np.linalg.eigvalsh(np.diag((size > 0).astype(float)) - d[:, None] * a * d[None, :])[1])
    to, of = np.array([v for x in near for v in x]), np.repeat(np.arange(n), size)
    times = lambda x: x + np.bincount(of, (d * x)[to], n) * d  # noqa: E731  # 2 - the Laplacian: its second largest is wanted
    first = np.sqrt(size / size.sum())
    x = np.random.default_rng(3).standard_normal(n)
    x -= first * (first @ x)
    steps = min(n - 1, 300)
    basis = np.zeros((steps + 2, n))
    basis[0], basis[1] = first, x / np.linalg.norm(x)
    alpha, beta, best = [], [], 0.0
    for k in range(steps):
        y = times(basis[k + 1])
        alpha.append(float(basis[k + 1] @ y))
        for _ in range(2):
            y -= basis[: k + 2].T @ (basis[: k + 2] @ y)
        norm = float(np.linalg.norm(y))
        if k % 10 == 9 or norm < 1e-10 or k == steps - 1:
            now = float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))[-1])
            if norm < 1e-10 or abs(now - best) < 1e-9:
                return 2 - now
            best = now
        beta.append(norm)
        basis[k + 2] = y / norm
    return 2 - best


def persistence(edges: list[tuple[int, int, float]]) -> list[tuple[int, float, float]]:
    """(dimension, birth, death) of H0 and H1 over GF(2), of the flag complex with triangles, an edge born at its weight, a vertex at its first edge."""
    weight: dict[tuple[int, int], float] = {}
    for u, v, w in edges:
        if u != v:
            k = (min(u, v), max(u, v))
            weight[k] = min(w, weight.get(k, np.inf))
    vertex: dict[int, float] = {}
    near: dict[int, set[int]] = {}
    for (u, v), w in weight.items():
        for x, y in ((u, v), (v, u)):
            vertex[x] = min(w, vertex.get(x, np.inf))
            near.setdefault(x, set()).add(y)
    cells = [(w, 0, (x,)) for x, w in vertex.items()] + [(w, 1, k) for k, w in weight.items()]
    for (u, v), w in weight.items():
        cells += [(max(w, weight[min(u, x), max(u, x)], weight[min(v, x), max(v, x)]), 2, (u, v, x)) for x in near[u] & near[v] if x > v]
    cells.sort()
    place = {c[2]: i for i, c in enumerate(cells)}
    held: dict[int, set[int]] = {}
    paired: dict[int, int] = {}
    for i, (_, d, c) in enumerate(cells):
        column = {place[c[:k] + c[k + 1 :]] for k in range(len(c))} if d else set()
        while column and (low := max(column)) in held:
            column ^= held[low]
        if column:
            held[max(column)] = column
            paired[max(column)] = i
    out, killers = [], set(paired.values())
    for i, (w, d, _) in enumerate(cells):
        if d < 2 and i not in killers:
            death = cells[paired[i]][0] if i in paired else np.inf
            if death > w or not np.isfinite(death):
                out.append((d, float(w), float(death)))
    return out


def per_component(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The kernel's rows for each connected component; a task holds a few whole components at a time."""
    with Scratch(edges.sparkSession) as s:
        e = s.save(edges)
        held = e.join(connected_components(e.select("src", "dst")).withColumnRenamed("node", "src"), "src")
        return s.keep(_in_partitions(held, e.count(), _by_component(kernel), schema))


def per_partition(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The kernel's rows for whole components at a time, for kernels to which components make no difference."""
    with Scratch(edges.sparkSession) as s:
        done, a = by_ranges(edges.select("src", "dst"), s, kernel, schema, chunk=CHUNK)
        return s.keep(_with(done, _in_partitions(a.held, a.rows, kernel, schema, chunk=CHUNK)))


def _articulation(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, near = adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    return pd.DataFrame({"node": nodes[sorted(cut_vertices(near))]})


def articulation_points(edges: DataFrame, *, co_changes: DataFrame | None = None) -> DataFrame:
    """(node) of the cut vertices of the undirected graph; co_changes(src, dst) are edges besides, as of files that change together."""
    e = edges.select("src", "dst")
    return per_partition(e.unionByName(co_changes.select("src", "dst")) if co_changes is not None else e, _articulation, f"node {_kind(edges)}")


def cut_files(edges: DataFrame, functions: DataFrame, **more: DataFrame) -> DataFrame:
    """(file, cuts): files of functions(name, file) that hold cut vertices, and how many."""
    cut = articulation_points(edges, **more).withColumnRenamed("node", "name")
    return cut.join(functions.select("name", "file").distinct(), "name").groupBy("file").agg(F.countDistinct("name").alias("cuts"))


#: Steps (vertices times edges) that one task takes of a component's shortest paths.
SEARCH = 50_000_000


def _measured(pdf: pd.DataFrame, strong: bool) -> Iterator[pd.DataFrame]:
    pdf["alone"] = pdf["component"].where(pdf["parts"] > 1)  # whole components may be searched together
    for (parts, part, _), x in pdf.groupby(["parts", "part", "alone"], sort=True, dropna=False):
        nodes, near = adjacency(x["src"].to_numpy(), x["dst"].to_numpy())
        is_cut = np.zeros(len(nodes), bool)
        if part == 0:
            is_cut[list(cut_vertices(near))] = True
        size = np.zeros(len(nodes), np.int64)
        if strong and part == 0:
            least, k = np.unique(strong_of(x["src"].to_numpy(), x["dst"].to_numpy())[1], return_counts=True)
            size[np.searchsorted(nodes, least)] = k
        yield pd.DataFrame({"node": nodes, "raw": betweenness_of(near, range(int(part), len(nodes), int(parts))), "is_cut": is_cut, "tangle": size, "parts": parts})


def _central(strong: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: pd.concat(list(_measured(pdf, strong)), ignore_index=True)


def measures(edges: DataFrame, *, search: int = SEARCH, strong: bool = False) -> DataFrame:
    """(node, betweenness, is_cut, tangle), undirected: betweenness over all pairs of other vertices of the whole graph, and whether it is a cut vertex.

    If ``strong``, tangle is the size of the strong component that the node is the least of, else 0.

    A component whose searches take more than ``search`` steps is sent to several tasks, each of which searches
    from its share of the vertices; the sums are the same. Rounded to 12 digits.
    """
    with Scratch(edges.sparkSession) as s:
        schema, kernel = f"node {_kind(edges)}, raw double, is_cut boolean, tangle long, parts int", _central(strong)
        done, a = by_ranges(edges.select("src", "dst").distinct(), s, lambda pdf: kernel(pdf.assign(parts=1, part=0)), schema, chunk=FEW, too_large=lambda v, e: v * 1.0 * e > search)
        wide = a.sizes.where(F.col("v") * F.col("v") * F.col("v") > search)  # v vertices have up to v * (v - 1) edges and v loops
        wide = s.keep(wide)
        parts = (a.held.limit(0) if wide.isEmpty() else a.held).join(F.broadcast(wide), "component").groupBy("component").agg(F.count("*").alias("e"), F.first("v").alias("v"))
        parts = s.keep(parts.select("component", F.least(F.col("v"), F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("e") / search))).cast("int").alias("parts")).where("parts > 1"))
        several = not parts.isEmpty()
        sent = a.held.join(F.broadcast(parts), "component", "left") if several else a.held.withColumn("parts", F.lit(1))
        sent = sent.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if several else F.lit(0))
        raw = s.save(_in_partitions(sent, a.rows, kernel, schema, keys=("component", "part"), chunk=FEW))
        n = raw.agg(F.count_distinct("node") if several else F.count("node")).first()[0] + (done.count() if done is not None else 0)
        if several:
            raw = raw.where("parts = 1").drop("parts").unionByName(raw.where("parts > 1").groupBy("node").agg(F.sum("raw").alias("raw"), F.bool_or("is_cut").alias("is_cut"), F.max("tangle").alias("tangle")))
        else:
            raw = raw.drop("parts")
        raw = _with(done.drop("parts") if done is not None else None, raw)
        pairs = (n - 1) * (n - 2) / 2
        return s.keep(raw.select("node", F.round(F.col("raw") / F.lit(float(pairs)) if pairs > 0 else F.lit(0.0), 12).alias("betweenness"), "is_cut", "tangle"))


def betweenness(edges: DataFrame, *, search: int = SEARCH) -> DataFrame:
    """(node, betweenness) as in ``measures``."""
    return measures(edges, search=search).select("node", "betweenness")


def bridge_nodes(edges: DataFrame, *, threshold: float = 0.1) -> DataFrame:
    """(node, betweenness, is_cut) of cut vertices and central ones, cut vertices first."""
    return measures(edges).drop("tangle").where(F.col("is_cut") | (F.col("betweenness") >= threshold)).orderBy(F.desc("is_cut"), F.desc("betweenness"), "node")


def _gap(pdf: pd.DataFrame) -> pd.DataFrame:
    _, near = adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    return pd.DataFrame({"component": [pdf["component"].iloc[0]], "size": [len(near)], "gap": [round(fiedler(near), 6)]})


def spectral_gaps(edges: DataFrame) -> DataFrame:
    return per_component(edges, _gap, f"component {_kind(edges)}, size long, gap double")


def _bars(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(persistence(list(zip(pdf["src"], pdf["dst"], pdf["weight"]))), columns=["dimension", "birth", "death"])


def persistent_homology(edges: DataFrame) -> DataFrame:
    """(dimension, birth, death) for edges(src, dst, weight)."""
    return per_component(edges, _bars, "dimension int, birth double, death double")


def topo_severity(edges: DataFrame, seeds: DataFrame, *, hops: int = 2) -> DataFrame:
    """One row for the neighbourhood of the seeds: cycles among directed pairs, callers, and cycles * callers / vertices."""
    with Scratch(edges.sparkSession) as s:
        e = s.keep(neighbourhood(edges, seeds, hops=hops))
        c = e.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi").agg(F.countDistinct("src").alias("callers"))
        return betti(e, directed=True).crossJoin(c).withColumn("severity", F.round(F.col("b1") * F.col("callers") / F.greatest(F.lit(1), "v"), 6))


def cycle_rank(edges: DataFrame) -> DataFrame:
    """One row: edges, directions and repeats counted, less vertices plus components; the rank over GF(2) of the cycles of the multigraph."""
    e = edges.where("src is not null and dst is not null")
    c = connected_components(e).agg(F.count("*").alias("v"), F.countDistinct("component").alias("c"))
    return e.agg(F.count("*").alias("e")).crossJoin(c).select((F.col("e") - F.col("v") + F.col("c")).alias("rank"))


def _statistics(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, near = adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    e = len(pdf.loc[pdf["src"] != pdf["dst"], ["src", "dst"]].drop_duplicates())
    return pd.DataFrame({"v": [len(nodes)], "e": [e], "b0": [pdf["component"].nunique()], "cuts": [len(cut_vertices(near))]})


def dag_statistics(edges: DataFrame) -> DataFrame:
    """One row for a graph of terms, directions aside: vertices, edges, components, independent cycles and cut vertices."""
    with Scratch(edges.sparkSession) as s:
        schema = "v long, e long, b0 long, cuts long"
        done, a = by_ranges(edges.select("src", "dst"), s, _statistics, schema, chunk=CHUNK)
        parts = _with(done, _in_partitions(a.held, a.rows, _statistics, schema, chunk=CHUNK))
        whole = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("v", "e", "b0", "cuts")])
        return s.keep(whole.select("v", "e", "b0", (F.col("e") - F.col("v") + F.col("b0")).alias("b1"), "cuts"))


def structural_risk(edges: DataFrame, duties: DataFrame, *, top: int | None = None) -> DataFrame:
    """(node, betweenness, risk) of cut vertices, betweenness * (1 + duties(node, duties) that are not met), the highest first."""
    b = measures(edges).where("is_cut").join(duties, "node", "left")
    out = b.select("node", "betweenness", F.round(F.col("betweenness") * (1 + F.coalesce("duties", F.lit(0))), 12).alias("risk")).orderBy(F.desc("risk"), "node")
    return out.limit(top) if top else out


def topology_report(edges: DataFrame, *, top: int = 10) -> DataFrame:
    """(kind, node, value): every cut vertex and tangle, and the ``top`` most central of the other vertices."""
    b = measures(edges, strong=True)
    rest = b.where("not is_cut").orderBy(F.desc("betweenness"), "node").limit(top)
    return (
        b.where("is_cut").select(F.lit("cut").alias("kind"), "node", F.col("betweenness").alias("value"))
        .unionByName(rest.select(F.lit("central").alias("kind"), "node", F.col("betweenness").alias("value")))
        .unionByName(b.where("tangle > 1").select(F.lit("tangle").alias("kind"), "node", F.col("tangle").cast("double").alias("value")))
    )


def evidence_order(cut: DataFrame, central: DataFrame, contracts: DataFrame) -> DataFrame:
    """cut(file, node) with central(node, betweenness): (file, has_contract, betweenness_max), files without a contract first, then the most central."""
    from factloom.operators import joins

    b = cut.join(central, "node", "left").groupBy("file").agg(F.coalesce(F.max("betweenness"), F.lit(0.0)).alias("betweenness_max"))
    return b.join(joins.contract_coverage(cut, contracts), "file").select("file", F.col("covered").alias("has_contract"), "betweenness_max").orderBy("has_contract", F.desc("betweenness_max"), "file")


def structural_coverage(edges: DataFrame, files: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: files of cut vertices, those with a contract, and their share, 1 if there is none."""
    from factloom.operators import joins

    cut = articulation_points(edges).join(files, "node").select("file").distinct()
    a = joins.contract_coverage(cut, contracts).agg(F.count("*").alias("files"), F.count_if("covered").alias("covered"))
    return a.withColumn("coverage", F.when(F.col("files") == 0, 1.0).otherwise(F.round(F.col("covered") / F.col("files"), 6)))
