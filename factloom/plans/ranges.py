"""Whole components without rounds, where connected nodes are near each other in the order of their ids or names.

Edges go once to the ranges of nodes that their ends lie in. A component with all its nodes in one range is whole there,
and is worked on in that task; edges of all others are left, to be tried once more with other ranges or labelled by rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.plans.iterate import Labelled, labelled, union_find
from factloom.plans.scratch import Scratch

#: Edges up to which components are found in one task at once, and edges of a range, which are one task. Nodes looked at for each cut between ranges.
ONE_TASK_EDGES, RANGE_ROWS, LOOKED_AT = 2_000_000, 500_000, 512


def _place(cuts: np.ndarray, nodes: pa.Array) -> np.ndarray:
    """The range of each node; by slices, as names are objects here."""
    return np.concatenate([np.searchsorted(cuts, nodes.slice(i, 20_000).to_numpy(zero_copy_only=False), side="right") for i in range(0, max(1, len(nodes)), 20_000)])


def _cuts(e: DataFrame, parts: int, rows: int) -> np.ndarray:
    """Nodes that cut the order of all into ranges of about as many edges; where the cuts lie changes no result, so a share of the nodes, by hash, is looked at."""
    share = max(1, rows // (parts * LOOKED_AT))
    seen = sorted(tuple(r) for r in e.where(F.pmod(F.xxhash64("src"), F.lit(share)) == 0).groupBy("src").count().collect())
    if not seen:
        return np.array([])
    upto = np.cumsum([n for _, n in seen])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
    nodes = np.empty(len(at), object)
    nodes[:] = [seen[i][0] for i in at]
    return nodes if isinstance(seen[0][0], str) else nodes.astype(np.int64)


def _measured(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, apart = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            i, j = _place(cuts, b["src"]), _place(cuts, b["dst"])
            n += np.bincount(i, minlength=len(n)) + np.bincount(j[i != j], minlength=len(n))
            apart += np.bincount(i[i != j], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(apart)], names=["part", "n", "apart"])

    return run


def _sent(cuts: np.ndarray):
    """Edges with the range of each end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = _place(cuts, b["src"]), _place(cuts, b["dst"])
            apart = np.flatnonzero(i != j)
            take = pa.array(np.concatenate([np.arange(b.num_rows), apart]))
            yield pa.RecordBatch.from_arrays([b["src"].take(take), b["dst"].take(take), pa.array(np.concatenate([i, j[apart]]).astype(np.int32))], names=["src", "dst", "part"])

    return run


def _in_range(cuts: np.ndarray, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: pa.Schema, too_large: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, chunk: int):
    """The kernel's rows for the components that lie in the range, several at a time, and at _src and _dst the edges from the range of all others."""
    width = len(schema) - 2

    def rows(pdf: pd.DataFrame) -> pa.RecordBatch:
        got = pa.RecordBatch.from_pandas(pdf, schema=pa.schema(list(schema)[:width]), preserve_index=False)
        return pa.RecordBatch.from_arrays([*got.columns, *[pa.nulls(got.num_rows, f.type) for f in list(schema)[width:]]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        own, kept = t["part"][0].as_py(), t.num_rows
        codes = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).dictionary_encode().combine_chunks()
        del parts, t
        nodes = codes.dictionary
        a, b = np.split(codes.indices.to_numpy(zero_copy_only=False), [kept])
        root = union_find(a, b, len(nodes))
        here = _place(cuts, nodes) == own
        left = np.zeros(len(nodes), bool)  # of roots
        left[root[~here]] = True
        of = root[a]
        if too_large is not None:
            left |= too_large(np.bincount(root, minlength=len(nodes)), np.bincount(of, minlength=len(nodes)))
        rest = np.flatnonzero(left[of] & here[a])
        for lo in range(0, len(rest), 100_000):
            at = rest[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), f.type) for f in list(schema)[:width]], nodes.take(pa.array(a[at])), nodes.take(pa.array(b[at]))], schema=schema)
        order = np.flatnonzero(~left[of])
        order = order[np.argsort(of[order], kind="stable")]
        of = of[order]
        ends, lo = [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)], 0
        for hi in ends:
            if hi - lo >= chunk or hi == len(of) > lo:
                src, dst = (nodes.take(pa.array(x[order[lo:hi]])).to_numpy(zero_copy_only=False) for x in (a, b))
                yield rows(kernel(pd.DataFrame({"component": of[lo:hi], "src": src, "dst": dst})))
                lo = hi

    return run


def by_ranges(edges: DataFrame, s: Scratch, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, chunk: int, too_large: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, one_task_edges: int | None = None, each: int | None = None) -> tuple[DataFrame | None, Labelled]:
    """The kernel's rows for whole components that lie within a range of nodes, None if none was tried, and the edges of all other components, labelled.

    kernel gets component, src and dst, where components are only told apart. too_large(vertices, edges) says of which components
    the edges are left. Up to ``one_task_edges`` edges none is tried, nor where more than a fourth of the edges lie between ranges
    or a range has more than four times ``each`` edges, as many as a task takes.
    """
    least, each, kind = one_task_edges or ONE_TASK_EDGES, each or RANGE_ROWS, edges.schema["src"].dataType
    if kind.typeName() not in ("string", "long") or edges.schema["dst"].dataType != kind:
        return None, labelled(edges, s)
    e = s.save(edges.select("src", "dst").where("src is not null and dst is not null"))
    rows, done = e.count(), None
    while rows > least:
        parts = -(-rows // each)
        cuts = _cuts(e, parts, rows)
        size = e.mapInArrow(_measured(cuts), "part long, n long, apart long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart")).collect()
        if max(r.n for r in size) > 4 * each or sum(r.apart for r in size) > rows / 4:
            break
        fields = f"{schema}, _src {kind.simpleString()}, _dst {kind.simpleString()}"
        sent = e.mapInArrow(_sent(cuts), f"src {kind.simpleString()}, dst {kind.simpleString()}, part int").repartitionById(len(cuts) + 1, "part")
        got = s.save(sent.mapInArrow(_in_range(cuts, kernel, to_arrow_schema(StructType.fromDDL(fields)), too_large, chunk), fields))
        found = got.where("_src is null").drop("_src", "_dst")
        done = found if done is None else done.unionByName(found)
        e = got.where("_src is not null").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        before, rows = rows, e.count()
        if rows > before / 2:
            break
    return done, labelled(e, s, rows=rows)
