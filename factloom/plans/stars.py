"""Connected components by rounds of large stars and small stars, over blocks of packed rows.

A round sends each pair to both of its ends and to the larger one, so rows make up nearly all of what is shuffled. They
travel in blocks of a task's rows for one partition: sorted, as differences, their bytes by place, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import Scratch

#: Rows that a task of a round takes, and rows that are sorted and packed at once.
TASK_ROWS, BLOCK_ROWS = 1_000_000, 1_000_000
#: What a row is: left as it was by the last small star, moved, of a finished component, or its least node with how many nodes it has for v.
LEFT, MOVED, DONE, ROOT = range(4)

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(planes: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(n)


def pack(u: np.ndarray, v: np.ndarray, kind: np.ndarray, parts: int) -> pa.RecordBatch:
    """A block for each of ``parts`` that some u fall to, with the rows of these."""
    own = u % parts
    order = np.lexsort((u, own))
    own, u, v, kind = own[order], u[order], v[order], kind[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.array([], np.int64)
    blocks = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
        x = u[lo:hi] // parts
        raw = _planes(np.r_[x[:1], x[1:] - x[:-1]]) + _planes(v[lo:hi]) + kind[lo:hi].tobytes()
        blocks.append(np.int64(hi - lo).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(own[first].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])


def unpack(part: int, block: bytes, parts: int) -> Rows:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    raw = np.frombuffer(pa.decompress(block[8:], decompressed_size=17 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(_whole(raw[: 8 * n], n)) * parts + part, _whole(raw[8 * n : 16 * n], n), raw[16 * n :].view(np.int8)


def _once(u: np.ndarray, v: np.ndarray, kind: np.ndarray) -> tuple[Rows, np.ndarray]:
    """Rows in order of u and v, each pair once with its greatest kind, and where each u begins."""
    order = np.lexsort((v, u))
    u, v, kind = u[order], v[order], kind[order]
    at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    u, v, kind = u[at], v[at], np.maximum.reduceat(kind, at)
    return (u, v, kind), np.flatnonzero(np.r_[True, u[1:] != u[:-1]])


def _join(parts: list[Rows]) -> Rows:
    return tuple(np.concatenate(x) for x in zip(*parts))


def large_star(u: np.ndarray, v: np.ndarray, kind: np.ndarray) -> Rows:
    """Of all neighbours v of the nodes u: the larger ones with the least of all; or, where u is the least and no row had moved, the finished component."""
    (u, v, kind), first = _once(u, v, kind)
    size = np.diff(np.r_[first, len(u)])
    low = np.minimum(u[first], v[first])
    loop = np.bincount(np.repeat(np.arange(len(first)), size)[u == v], minlength=len(first))
    moved = np.maximum.reduceat(np.where(u == v, LEFT, kind), first) > LEFT
    over = (low == u[first]) & ~moved
    every = np.repeat(over, size)
    up = v > u
    return _join([
        (v[up], np.repeat(low, size)[up], np.where(every, DONE, np.where(np.repeat(low, size) < u, MOVED, LEFT)).astype(np.int8)[up]),
        (u[first][over], (size - loop + 1)[over], np.full(over.sum(), ROOT, np.int8)),
    ])


def small_star(u: np.ndarray, v: np.ndarray, kind: np.ndarray) -> Rows:
    """Of the smaller neighbours v of the nodes u: these and u with the least of them; rows of finished components as they are."""
    done = kind >= DONE
    ended = u[done], v[done], kind[done]
    if done.all():
        return ended
    (u, v, kind), first = _once(u[~done], v[~done], kind[~done])
    low = np.repeat(v[first], np.diff(np.r_[first, len(u)]))
    return _join([ended, (np.where(v == low, u, v), low, np.where(v == low, kind, MOVED).astype(np.int8))])


def _sent(rows: Iterator[Rows], parts: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in rows:
        held.append(x)
        n += len(x[0])
        if n >= BLOCK_ROWS:
            yield pack(*_join(held), parts)
            held, n = [], 0
    if n:
        yield pack(*_join(held), parts)


def _to_both_ends(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends() -> Iterator[Rows]:
            for b in batches:
                u, v, kind = (b[c].to_numpy() for c in ("u", "v", "kind"))
                apart = u != v
                yield _join([(u, v, kind), (v[apart], u[apart], kind[apart])])

        yield from _sent(ends(), parts)

    return run


def _step(star: Callable[..., Rows], parts: int, on: Callable[[Iterator[Rows]], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(p, x, parts) for b in batches for p, x in zip(b["part"].to_pylist(), b["block"].to_pylist())]
        if held:
            rows = _join(held)
            held.clear()
            yield from on(iter([star(*rows)]))

    return run


def _as_rows(rows: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
    for x in rows:
        for lo in range(0, len(x[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in x], names=["u", "v", "kind"])


def stars(e: DataFrame, rows: int, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, component), each node once, and (component, v), how many nodes it has, of saved edges(src, dst) of long ids; as tables that live with ``s``.

    What a round of small stars leaves as it was is a star, which the next round takes out; rounds go on until no row is left.
    """
    kept = "part int, block binary"
    pairs, done = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(MOVED).cast("byte").alias("kind")), []
    while rows:
        parts = max(-(-2 * rows // TASK_ROWS), min(12, -(-2 * rows // 10_000))) | 1
        both = pairs.mapInArrow(_to_both_ends(parts), kept).repartitionById(parts, "part")
        large = both.mapInArrow(_step(large_star, parts, lambda x, n=parts: _sent(x, n)), kept).repartitionById(parts, "part")
        after = s.save(large.mapInArrow(_step(small_star, parts, _as_rows), "u long, v long, kind byte"))
        done.append(after.where(F.col("kind") >= DONE))
        pairs = after.where(F.col("kind") < DONE)
        rows = pairs.count()
    if not done:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component")), e.select(F.col("src").alias("component"), F.col("dst").alias("v"))
    ended = done[0]
    for x in done[1:]:
        ended = ended.unionByName(x)
    is_root = F.col("kind") == ROOT
    return ended.select(F.col("u").alias("node"), F.when(is_root, F.col("u")).otherwise(F.col("v")).alias("component")), ended.where(is_root).select(F.col("u").alias("component"), "v")
