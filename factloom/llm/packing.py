"""Packing of related documents into training windows.

1. Nearest-neighbour graph. A text is the set of its word n-grams, sketched by T min-wise tokens; two
   texts are as similar as the share of tokens they agree in. Every text is a query for its K nearest
   of at least FLOOR. Candidates meet in T / 2 buckets of two tokens, so that a pair at the floor meets
   with 1 - (1 - FLOOR**2)**(T / 2), 0.95, and a nearer one more surely, however many share the bucket:
   all pairs of it are compared. A bucket of more than BLOCK texts is cut in blocks and each pair of
   blocks is a task of its own. Texts of equal sets are one vertex and follow one another.
2. Paths. Each connected component of the graph is walked on its own: begin at the unvisited vertex of
   lowest degree, go on to the most similar unvisited neighbour (of equals the one of lower degree,
   then of lesser id) until there is none, begin again. A component of any size keeps all its edges and
   is walked in one task, in arrays of bounded bytes an edge.
3. Windows. Along the paths, component after component, token after token, windows of ``window`` tokens
   are filled without padding; a text that crosses the end of one goes on in the next. Components are
   dealt to packs by their hash, a pack for every PACK_TOKENS tokens, and only the last window of a
   pack may be short.

A component or a set of equal texts that is larger than SEGMENT is dealt in segments, so no pack has more than its part.

Defined cases: rows without an id, and null, empty or blank texts (no tokens), are in no window; texts
without words are vertices without neighbours; repeated rows of one id and text are packed once; several texts
of one id are texts of their own, the one of the most tokens is named by the id in ``path``; a text longer than
a window fills several; no rows, no windows. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.llm import tokens
from factloom.llm.ngram_join import N, T, gram_sets, sketches
from factloom.plans.iterate import connected_components
from factloom.plans.scratch import Scratch

K, FLOOR, BLOCK = 6, 0.3, 4096
WINDOW, PACK_TOKENS, SEGMENT = 2048, 16 << 20, 200_000
SCHEMA = "window long, slot int, doc_id long, token_start long, token_end long, path long"
SURVEY = "doc_id long, key long, n_tokens long, k1 long, k2 long, sketch binary, buckets array<long>"
_U = np.uint64


def _survey(n: int, vocabulary: str):
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = tokens.encode(b.column("text").to_pylist(), vocabulary)
        w = tk.words(b.column("text"))
        h, first = gram_sets(w, n)
        size = np.diff(first)
        has = np.flatnonzero(size)
        sk = np.zeros((b.num_rows, T), np.uint16)
        key = np.zeros((2, b.num_rows), np.uint64)
        if len(has):
            f = np.r_[first[has], len(h)]
            sk[has] = sketches(h, f)
            key[0, has] = np.add.reduceat(tk.mix(h), f[:-1])
            key[1, has] = np.bitwise_xor.reduceat(tk.mix(h ^ _U(0x5851F42D4C957F2D)), f[:-1])
        pair = sk.view(np.uint32)
        bucket = tk.mix(pair.astype(np.uint64) ^ (np.arange(1, T // 2 + 1, dtype=np.uint64) << _U(40)))[has]
        off = np.zeros(b.num_rows + 1, np.int64)
        off[has + 1] = T // 2
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array(np.diff(at)), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * T), b.num_rows, [None, pa.py_buffer(sk.tobytes())]).cast(pa.binary()), tk.list_array(pa.array(bucket.reshape(-1).view(np.int64)), np.cumsum(off))],
            names=["doc_id", "key", "n_tokens", "k1", "k2", "sketch", "buckets"],
        )

    return tk.sliced(one)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens that each sketch of a agrees in with each of b."""
    out, columns = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(b.T)
    for lo in range(0, len(a), 64):
        for j in range(T):
            out[lo : lo + 64] += (a[lo : lo + 64, j, None] == columns[j]).view(np.uint8)
    return out


def best(agree: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, agreeing tokens): up to k best of each row; of equals the first. Overwrites agree."""
    rows = np.arange(len(agree))
    found = []
    for _ in range(min(k, agree.shape[1])):
        top = agree.argmax(1)
        value = agree[rows, top]
        ok = value >= floor * T
        if not ok.any():
            break
        found.append((rows[ok], top[ok], value[ok].astype(np.int64)))
        agree[rows, top] = 0
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def nearest(sketch: np.ndarray, k: int, floor: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, agreeing tokens): up to k nearest of each; with side, of each in the other side only."""
    if side is None:
        agree = agreement(sketch, sketch)
        np.fill_diagonal(agree, 0)
        return best(agree, k, floor)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    agree = agreement(sketch[one], sketch[two])
    back = best(np.ascontiguousarray(agree.T), k, floor)
    there = best(agree, k, floor)
    return np.r_[one[there[0]], two[back[0]]], np.r_[two[there[1]], one[back[1]]], np.r_[there[2], back[2]]


def _neighbours(k: int, floor: float):
    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cell, ids, side = (t[x].to_numpy() for x in ("cell", "doc_id", "side"))
        sk = np.frombuffer(t["sketch"].combine_chunks().cast(pa.large_binary()).buffers()[2], np.uint16).reshape(-1, T)[: len(ids)]
        cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[cuts, len(ids)])
        two = cuts[(size == 2) & (side[cuts] < 0)]
        agree = (sk[two] == sk[two + 1]).sum(1)
        two, agree = two[agree >= floor * T], agree[agree >= floor * T]
        q, p, a = [ids[two], ids[two + 1]], [ids[two + 1], ids[two]], [agree, agree]
        more = (size > 2) | (side[cuts] >= 0)
        for lo, m in zip(cuts[more], size[more]):
            order = lo + np.argsort(ids[lo : lo + m], kind="stable")
            i, j, x = nearest(sk[order], k, floor, None if side[lo] < 0 else side[order])
            q.append(ids[order[i]])
            p.append(ids[order[j]])
            a.append(x)
        q, p, a = np.concatenate(q), np.concatenate(p), np.concatenate(a)
        order = np.lexsort((p, q))
        q, p, a = q[order], p[order], a[order]
        new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1])]) if len(q) else np.zeros(0, np.int64)
        q, p, a = q[new], p[new], a[new]
        order = np.lexsort((p, -a, q))
        q, p, a = q[order], p[order], a[order]
        rank = np.arange(len(q)) - np.repeat(np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), len(q)])) if len(q) else q
        ok = rank < k
        yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(p[ok]), pa.array(a[ok].astype(np.int32))], names=["src", "dst", "agree"])

    return tk.by_runs(one, "cell")


def graph(vertices: DataFrame, s: Scratch, *, k: int = K, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """(src, dst, agree): each vertex's k nearest, from vertices (doc_id, sketch, buckets)."""
    each = s.save(vertices.select("doc_id", F.explode("buckets").alias("bucket")))
    met = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = each.join(met, "bucket").join(vertices.select("doc_id", "sketch"), "doc_id")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    met_in = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met_in.select(
        F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"),
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "doc_id",
        "sketch",
    )
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_neighbours(k, floor), "src long, dst long, agree int")
    nearest_first = Window.partitionBy("src").orderBy(F.desc("agree"), "dst")
    return s.keep(found.distinct().withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k).drop("r"))


def walk(src: np.ndarray, dst: np.ndarray, agree: np.ndarray) -> list[int]:
    """The vertices of one component in the order of its paths."""
    nodes = np.unique(np.r_[np.unique(src), np.unique(dst)])
    m = _U(len(nodes))
    u, v = np.searchsorted(nodes, src).astype(np.int32), np.searchsorted(nodes, dst).astype(np.int32)
    edge = (np.minimum(u, v).astype(np.uint64) * m + np.maximum(u, v).astype(np.uint64)) << _U(7) | agree.astype(np.uint64)
    del u, v
    edge.sort()
    edge = edge[np.r_[True, edge[1:] != edge[:-1]]]  # either direction, once
    near = _U(127) - (edge & _U(127))
    edge >>= _U(7)
    u, v = (edge // m).astype(np.int32), (edge % m).astype(np.int32)
    del edge
    degree = np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes))
    starts = np.lexsort((nodes, degree)).astype(np.int32)
    rank = np.empty(len(nodes), np.uint64)
    rank[starts] = np.arange(len(nodes), dtype=np.uint64)
    adjacent = np.empty(2 * len(u), np.uint64)  # of each vertex the best neighbour first
    adjacent[: len(u)] = (u.astype(np.uint64) << _U(7) | near) * m + rank[v]
    adjacent[len(u) :] = (v.astype(np.uint64) << _U(7) | near) * m + rank[u]
    del u, v, near
    adjacent.sort()
    adjacent %= m
    adjacent, starts, first = memoryview(starts[adjacent]), memoryview(starts), memoryview(np.r_[0, np.cumsum(degree)])
    path, seen = array("i"), bytearray(len(nodes))
    for x in starts:
        while x >= 0 and not seen[x]:
            seen[x] = 1
            path.append(x)
            x = next((y for y in adjacent[first[x] : first[x + 1]] if not seen[y]), -1)
    return nodes[np.frombuffer(path, np.int32)].tolist()


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the components of a partition that is sorted by them; holds one component, as bare arrays."""
    held: list[tuple[np.ndarray, ...]] = []
    nodes, of, steps = [], [], []
    now = None

    def walked() -> None:
        src, dst, agree = (np.concatenate(x) for x in zip(*held))
        held.clear()
        path = walk(src, dst, agree)
        nodes.extend(path)
        of.append((now, len(path)))
        steps.append(np.arange(len(path), dtype=np.int32))

    def made() -> Iterator[pa.RecordBatch]:
        component, step = np.repeat([c for c, _ in of], [n for _, n in of]), np.concatenate(steps)
        for lo in range(0, len(nodes), 1 << 17):
            x = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x], pa.int64()), pa.array(component[x]), pa.array(step[x])], names=["node", "component", "step"])
        nodes.clear()
        of.clear()
        steps.clear()

    for b in batches:
        c, src, dst, agree = (b.column(x).to_numpy() for x in ("component", "src", "dst", "agree"))
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(c)]):
            if held and c[lo] != now:
                walked()
                if len(nodes) >= 1 << 17:
                    yield from made()
            now = int(c[lo])
            held.append((src[lo:hi].copy(), dst[lo:hi].copy(), agree[lo:hi].astype(np.uint8)))
    if held:
        walked()
    if nodes:
        yield from made()


def paths(edges: DataFrame, s: Scratch) -> DataFrame:
    """(node, component, step) of every vertex with a neighbour."""
    parts = s.keep(connected_components(edges.select("src", "dst")))
    held = edges.join(parts.select(F.col("node").alias("src"), "component"), "src")
    return held.select("component", "src", "dst", "agree").repartition("component").sortWithinPartitions("component", "src", "dst").mapInArrow(_walks, "node long, component long, step int")


def fill(n_tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts in a row: text, window, first and last token (excluded) of every piece."""
    end = np.cumsum(n_tokens)
    begin = end - n_tokens
    pieces = np.where(n_tokens > 0, (end - 1) // window - begin // window + 1, 0)
    text = np.repeat(np.arange(len(n_tokens)), pieces)
    w = tk.ranges(begin // window, pieces)
    return text, w, np.maximum(begin[text], w * window) - begin[text], np.minimum(end[text], (w + 1) * window) - begin[text]


def _fill(window: int):
    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        pack, ids, n, path = (t[x].to_numpy() for x in ("pack", "doc_id", "n_tokens", "path"))
        cuts = np.flatnonzero(np.r_[True, pack[1:] != pack[:-1]])
        for lo, hi in zip(cuts, [*cuts[1:], len(pack)]):
            text, w, a, b = fill(n[lo:hi], window)
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else w
            slot = np.arange(len(w)) - np.repeat(new, np.diff(np.r_[new, len(w)]))
            for x in range(0, len(w), 1 << 17):
                y = slice(x, x + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(w[y] + (int(pack[lo]) << 32)), pa.array(slot[y].astype(np.int32)), pa.array(ids[lo:hi][text[y]]), pa.array(a[y]), pa.array(b[y]), pa.array(path[lo:hi][text[y]])], names=["window", "slot", "doc_id", "token_start", "token_end", "path"])

    return tk.by_runs(one, "pack", rows=0)


def pack_related(docs: DataFrame, *, window: int = WINDOW, n: int = N, k: int = K, floor: float = FLOOR, vocabulary: str = tokens.VOCABULARY, pack_tokens: int = PACK_TOKENS, segment: int = SEGMENT) -> DataFrame:
    """Rows of SCHEMA: which tokens of which text stand in which window, in the order of slot; path names the component."""
    if window < 1 or k < 1 or not 0 < floor <= 1:
        raise ValueError("window and k must be positive, floor in (0, 1]")
    with Scratch(docs.sparkSession) as s:
        texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
        made = s.save(texts.mapInArrow(_survey(n, vocabulary), SURVEY).where("n_tokens > 0"))
        ranked = made.select("doc_id", "key", "n_tokens", "k1", "k2").distinct().withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_tokens"), "k1", "k2", "key")))
        one = s.keep(ranked.withColumn("vertex", F.when(F.col("r") == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "key"))).drop("r"))
        worded = (F.col("k1") != 0) | (F.col("k2") != 0)
        alike = one.where(worded).groupBy("k1", "k2").agg(F.min("vertex").alias("node"), F.count("*").alias("copies"))
        rep = s.keep(one.where(worded).join(alike, ["k1", "k2"]).select("doc_id", "key", "n_tokens", "vertex", "node", "copies").unionByName(one.where(~worded).select("doc_id", "key", "n_tokens", "vertex", F.col("vertex").alias("node"), F.lit(1).cast("long").alias("copies"))))
        vertices = made.join(rep.where("vertex = node").select("doc_id", "key", "vertex"), ["doc_id", "key"]).dropDuplicates(["vertex"]).select(F.col("vertex").alias("doc_id"), "sketch", "buckets")
        order = paths(graph(vertices, s, k=k, floor=floor), s)
        total = rep.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        packs = max(1, -(-total // pack_tokens))
        placed = rep.join(order, "node", "left").select("doc_id", "vertex", "n_tokens", "node", "copies", F.coalesce("component", "node").alias("path"), F.coalesce("step", F.lit(0)).alias("step"))
        part = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("copies") / segment))
        dealt = placed.withColumn("pack", F.pmod(F.xxhash64("path", F.floor(F.col("step") / segment), part), F.lit(packs)).cast("long"))
        ready = dealt.repartition("pack").sortWithinPartitions("pack", "path", "step", "node", "vertex").select("pack", "doc_id", "n_tokens", "path")
        return s.keep(ready.mapInArrow(_fill(window), SCHEMA))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_related(spark.read.parquet(f"{sf_dir}/documents.parquet"))
