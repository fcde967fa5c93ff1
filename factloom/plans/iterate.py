"""Fixpoint loops: semi-naive reachability and connected components.

Each round is one join, one distinct and one anti-join; its result is cut with a reliable
checkpoint so that plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import Scratch
from factloom.plans.stars import stars

_ONE_TASK_EDGES = 2_000_000


def _walk_in_one_task(batches: Iterator[pa.RecordBatch], rounds: int | None) -> Iterator[pa.RecordBatch]:
    parts = [x for x in batches if x.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    codes = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).dictionary_encode().combine_chunks()
    n, names = t.num_rows, codes.dictionary
    src, dst = np.split(codes.indices.to_numpy(zero_copy_only=False), [n])
    kind = t["kind"].to_numpy()
    seed, is_edge, guarded = np.unique(src[kind == 1]), kind == 0, np.zeros(len(names), bool)
    guarded[src[kind == 2]] = True
    ok = is_edge & ~guarded[dst]
    src, dst = src[ok], dst[ok]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(names) + 1))
    depth = np.full(len(names), -1, np.int32)
    depth[seed] = 0
    at, k = seed, 0
    while len(at) and (rounds is None or k < rounds):
        k += 1
        size = first[at + 1] - first[at]
        step = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = np.unique(dst[step])
        at = at[depth[at] < 0]
        depth[at] = k
    seen = np.flatnonzero(depth >= 0)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(seen)), pa.array(depth[seen])], names=["node", "depth"])


def reach(edges: DataFrame, seeds: DataFrame, *, guard: DataFrame | None = None, max_rounds: int | None = None, one_task_edges: int = _ONE_TASK_EDGES) -> DataFrame:
    """Nodes reachable from ``seeds(node)`` along ``edges(src, dst)``, with the round they first appear in.

    ``guard(node)``: nodes that a path may not enter; a seed stays even if guarded. Seeds have depth 0.
    Up to ``one_task_edges`` counted rows are walked in one task, whose memory that bounds; more are
    joined round by round over the cluster. Both give the same rows. Rounds go on until nothing is new, or for
    ``max_rounds`` if that is given.
    """
    kind = edges.schema["src"].dataType
    rows = edges.where("src is not null and dst is not null").select("src", F.col("dst").cast(kind).alias("dst"), F.lit(0).alias("kind"))
    for k, nodes in ((1, seeds), (2, guard)):
        if nodes is not None:
            rows = rows.unionByName(nodes.where("node is not null").select(F.col("node").cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"), F.lit(k).alias("kind")))
    with Scratch(edges.sparkSession) as s:
        rows = s.keep(rows)
        if rows.count() <= one_task_edges:
            return rows.coalesce(1).mapInArrow(lambda b: _walk_in_one_task(b, max_rounds), f"node {kind.simpleString()}, depth int")
        edges, seeds = rows.where("kind = 0").select("src", "dst"), rows.where("kind = 1").select(F.col("src").alias("node"))
        guard = rows.where("kind = 2").select(F.col("src").alias("node")) if guard is not None else None
    with Scratch(edges.sparkSession) as s:
        step = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
        if guard is not None:
            step = step.join(guard.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")
        step = s.keep(step)
        seen = s.keep(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
        delta, depth = seen, 0
        while (max_rounds is None or depth < max_rounds) and not delta.isEmpty():
            depth += 1
            found = delta.join(step, delta["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
            delta = s.keep(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
            seen = seen.unionByName(delta)
            if depth % 8 == 0:
                seen = s.keep(seen)
        return seen


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more; for small graphs, as its size is quadratic."""
    with Scratch(edges.sparkSession) as s:
        step = s.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        seen = delta = step
        while not delta.isEmpty():
            found = delta.alias("d").join(step.alias("e"), F.col("d.dst") == F.col("e.src")).select("d.src", "e.dst").distinct()
            delta = s.save(found.join(seen, ["src", "dst"], "left_anti"))
            seen = seen.unionByName(delta)
        return s.keep(seen)


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each one's component, by hooking and pointer jumping over whole arrays."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        differ = ra != rb
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(ra, rb)[differ], low[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [x for x in batches if x.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
        nodes, idx = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root = union_find(idx[: len(src)], idx[len(src) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _of_names(edges: DataFrame, one_task_edges: int) -> DataFrame:
    """Components of named nodes: names become 64-bit hashes, which no shuffle is needed for, and each component its least name."""
    with Scratch(edges.sparkSession) as s:
        e = s.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        names = s.keep(e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("node", F.xxhash64("name")))
        parts = connected_components(e.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")), one_task_edges=one_task_edges)
        held = s.keep(names.join(parts, "node").select(F.col("name").alias("node"), F.col("component").alias("c")))
        return s.keep(held.join(held.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component"))


#: Rows that one task of a step takes, so that its share stays as it is when the input grows.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *by: str | Column, each: int = TASK_ROWS) -> DataFrame:
    """df hashed by columns into as many partitions as its counted rows ask for."""
    return df.repartition(max(-(-rows // each), min(12, -(-rows // 10_000)), 1), *by)


def _components(e: DataFrame, rows: int, s: Scratch, one_task_edges: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (component, v), how many nodes it has, of saved edges of integer ids."""
    if rows <= one_task_edges:
        of = s.keep(e.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
        return of, of.groupBy("component").agg(F.count("*").alias("v"))
    return stars(e, rows, s)


class Labelled(NamedTuple):
    """Saved edges, how many, the same with the ``component`` of each, and (component, v), how many nodes each component has."""

    edges: DataFrame
    rows: int
    held: DataFrame
    sizes: DataFrame


def labelled(edges: DataFrame, s: Scratch, *, one_task_edges: int = _ONE_TASK_EDGES, rows: int | None = None) -> Labelled:
    """edges(src, dst) with a number for each connected component, over integer ids or names, as tables that live with ``s``.

    The number is the least id; of names, the least 64-bit hash. Rows with a null endpoint are dropped. Edges whose ``rows`` are
    given are saved with ``s`` already, without nulls.
    """
    e = edges if rows is not None else s.save(edges.where("src is not null and dst is not null"))
    rows = e.count() if rows is None else rows
    key = F.xxhash64 if edges.schema["src"].dataType.typeName() == "string" else lambda c: F.col(c).cast("long")
    of, sizes = _components(e.select(key("src").alias("src"), key("dst").alias("dst")), rows, s, one_task_edges)
    keyed, of = spread(e, rows, key("src")), spread(of, rows, "node")
    return Labelled(e, rows, keyed.join(of, key("src") == of["node"]).drop("node"), sizes)


def connected_components(edges: DataFrame, *, one_task_edges: int = _ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for the undirected graph of ``edges(src, dst)`` over integer ids or names.

    ``component`` is the smallest id, or the least name, in it. Up to ``one_task_edges`` counted edges run in one task
    (32 bytes an edge there); larger graphs alternate large-star and small-star rounds, whose work
    is spread over the cluster. Both give the same rows. Null endpoints are dropped, a self-loop
    names its node.
    """
    if edges.schema["src"].dataType.typeName() == "string":
        return _of_names(edges, one_task_edges)
    with Scratch(edges.sparkSession) as s:
        e = s.save(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null"))
        of, _ = _components(e, e.count(), s, one_task_edges)
        return s.keep(of)
