"""N-gram Jaccard join by chosen paths.

A text is the set of its word n-grams (one gram of all its words if it has fewer than n; no gram if
it has no words). Wanted are all links: pairs of texts with Jaccard similarity of at least ``threshold``.

1. Each set is sketched by T min-wise tokens (position, value); two sets share a token with a
   probability that is their similarity.
2. Chosen paths: a node of the search tree picks a token of a set with probability
   1 / (threshold * T), by a hash of node and token, so that sets sharing a picked token go on
   together into one child. The first LEVELS splits are written as bucket keys and meet in one
   shuffle; a bucket of more than LEAF sets splits on until its parts are small. A pair at the threshold
   survives L levels with a probability known in advance (``survival``). The number of runs follows from
   LEVELS and the target recall; a bucket that splits on is split again from new tokens until what its
   own depth loses is within INNER, so deep buckets, hence large tables, keep the target.
3. Small buckets compare all sketches with all. What is kept of a bucket is a spanning forest of
   the pairs whose sketches agree, so edges grow with the texts, not with their pairs. A bucket of
   more than HOT sets is cut in blocks and each pair of blocks is a bucket of its own, in any task.
4. Connected components of the forest gather each family of similar sets in one place, where every
   pair's exact similarity is computed from the texts. Large families are cut in blocks and each pair
   of blocks is a task of its own, which gives the links of each text, counted, and a spanning forest
   of them; no pair leaves the task.

The result is one row for each document and set: its class (the least id that links lead to) and the
number of documents it is linked to. Texts of equal sets are compared once, as one set with a count, and
count as links of one another. All counts are of exact similarities; links may be missed with the
target's probability.

Defined cases: rows without an id go; null and empty texts, and texts without words, are a class of their
own with no link; rows of the same id and set are one; several texts of one id are texts of their own, each
with a row; an empty table gives no row; a very long text is one set like any other. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.plans.iterate import connected_components, union_find
from factloom.plans.scratch import ROW_BYTES, Scratch, small_side

N, THRESHOLD, RECALL = 3, 0.6, 0.99
T, LEVELS, LEAF, DEPTH, BLOCK, HOT = 64, 2, 256, 8, 4096, 50_000
#: Share of the pairs of a bucket that its own further splits must keep; with 8 runs, 1 - (1 - 0.4685 * 0.95)**8 = 0.991.
INNER = 0.95
#: Sketches of T tokens agree on a share that errs by sqrt(s * (1 - s) / T); this many errors are allowed for.
ERRORS = 3.0
_U = np.uint64
_A = np.random.default_rng(71).integers(1, 2**63, T, dtype=np.uint64) * _U(2) + _U(1)
_J = tk.mix(np.arange(1, T + 1, dtype=np.uint64))
SCHEMA = "doc_id long, class_id long, n_links long"
FOUND = "node long, other long, links long"


def survival(levels: int) -> float:
    """Chance that a pair at the threshold is together after so many levels of a run."""
    s = 1.0
    for _ in range(levels):
        s = 1 - math.exp(-s)
    return s


def repeats_for(levels: int, depth: int) -> int:
    """How often a bucket at ``levels`` is split down to ``depth`` so that INNER of its pairs at the threshold stay together."""
    s = 1.0
    for _ in range(depth - levels):
        s = 1 - math.exp(-s)
    return 1 if depth <= levels else math.ceil(math.log(1 - INNER) / math.log(1 - s))


def runs_for(recall: float, levels: int = LEVELS) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(levels))))


def gram_sets(w: tk.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text: hashes and n_texts + 1 offsets."""
    count = np.diff(w.first)
    g = w.grams(n)
    full = np.maximum(count - n + 1, 0)
    at = tk.ranges(w.first[:-1], full)
    text, h = np.repeat(np.arange(w.n_texts), full), g[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        text = np.r_[text, few]
        h = np.r_[h, w.span(w.first[few], w.first[few + 1])]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    text, h = text[keep], h[keep]
    return h, np.searchsorted(text, np.arange(w.n_texts + 1))


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """T 16-bit min-wise values of each set; sets must not be empty."""
    out = np.empty((len(first) - 1, T), np.uint16)
    for j in range(T):
        m = h * _A[j]
        m ^= m >> _U(29)
        out[:, j] = (tk.mix(np.minimum.reduceat(m, first[:-1])) & _U(0xFFFF)).astype(np.uint16)
    return out


def _chosen(node: np.ndarray, sketch: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child for each token that a row's node picks."""
    child = tk.mix(tk.mix(node)[:, None] ^ (_J[None, :] * (sketch.astype(np.uint64) + _U(1))))
    row, j = np.nonzero(child < _U(int(share * 2.0**64)))
    return row, tk.mix(child[row, j])


def paths(sketch: np.ndarray, runs: int, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the nodes that each set reaches in so many levels of each run."""
    share = 1 / (threshold * T)
    rows, nodes = [], []
    for r in range(runs):
        row, node = np.arange(len(sketch)), np.full(len(sketch), 977 + r, np.uint64)
        for _ in range(levels):
            i, node = _chosen(node, sketch[row], share)
            row = row[i]
        rows.append(row)
        nodes.append(node)
    row, node = np.concatenate(rows), np.concatenate(nodes)
    order = np.lexsort((node, row))
    return row[order], node[order]


def _sketch_batches(n: int, runs: int, threshold: float):
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = tk.words(b.column("text"))
        h, first = gram_sets(w, n)
        size = np.diff(first)
        has = np.flatnonzero(size)
        hi, lo = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        off, marks, at, node = np.zeros(b.num_rows + 1, np.int64), np.zeros(0, np.uint8), np.zeros(b.num_rows + 1, np.int64), np.zeros(0, np.uint64)
        if len(has):
            first = np.r_[first[has], len(h)]
            s = sketches(h, first)
            row, node = paths(s, runs, LEVELS, threshold)
            hi[has] = np.add.reduceat(tk.mix(h), first[:-1])
            lo[has] = np.bitwise_xor.reduceat(tk.mix(h ^ _U(0x5851F42D4C957F2D)), first[:-1])
            off[has + 1], marks = 2 * T, s.view(np.uint8).reshape(-1)
            at[has + 1] = np.bincount(row, minlength=len(has))
        sketch = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.cumsum(off).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(marks))])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(size > 0), sketch, tk.list_array(pa.array(node.view(np.int64)), np.cumsum(at))],
            names=["doc_id", "key", "set_hi", "set_lo", "worded", "sketch", "buckets"],
        )

    return tk.sliced(one)


def forest(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what pairs of agreeing sketches join, at most one fewer than sketches.

    Each round compares one member of the smallest open component with all outside it, so a bucket
    of alike sketches takes one round, and no pair between components stays unseen.
    """
    k, need = len(sketch), least * T
    comp = np.arange(k)
    src, dst = [], []
    open_ = np.ones(k, bool)
    while True:
        labels, counts = np.unique(comp, return_counts=True)
        if len(labels) == 1:
            break
        largest = labels[np.argmax(counts)]
        todo = np.flatnonzero(open_ & (comp != largest)) if len(labels) < k else np.flatnonzero(open_)[: k - 1]
        if not len(todo):
            break
        p = todo[0]
        open_[p] = False
        near = np.flatnonzero(((sketch == sketch[p]).sum(1) >= need) & (comp != comp[p]))
        if len(near):
            fresh = near[np.unique(comp[near], return_index=True)[1]]
            src += [p] * len(fresh)
            dst += fresh.tolist()
            comp[np.isin(comp, comp[fresh])] = comp[p]
    return np.array(src, np.int64), np.array(dst, np.int64)


def _all_pairs(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    k = len(sketch)
    if k == 2:
        return (np.array([0]), np.array([1])) if (sketch[0] == sketch[1]).sum() >= least * T else (np.zeros(0, np.int64),) * 2
    if k > 24:
        return forest(sketch, least)
    same = (sketch[:, None, :] == sketch[None, :, :]).sum(2) >= least * T
    i, j = np.nonzero(np.triu(same, 1))
    root = union_find(i, j, k)
    member = np.flatnonzero(root != np.arange(k))
    return root[member], member


def _split(bucket: int, sketch: np.ndarray, threshold: float, least: float, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges of one bucket and the depth that was reached: compared at once if small or deep, else split by further tokens."""
    if len(sketch) <= LEAF or depth >= DEPTH:
        return *_all_pairs(sketch, least), depth
    alike = (sketch == sketch[0]).sum(1) >= least * T
    src = [np.zeros(int(alike.sum()) - 1, np.int64)]
    dst = [np.flatnonzero(alike)[1:]]
    reached = depth
    if not alike.all():
        row, child = _chosen(np.full(len(sketch), bucket, np.uint64), sketch, 1 / (threshold * T))
        order = np.argsort(child, kind="stable")
        row, child = row[order], child[order]
        cuts = np.flatnonzero(np.r_[True, child[1:] != child[:-1]]) if len(child) else []
        reached = depth + 1
        for lo, hi in zip(cuts, [*cuts[1:], len(child)]):
            if hi - lo > 1:
                i, j, d = _split(int(child[lo]), sketch[row[lo:hi]], threshold, least, depth + 1)
                src.append(row[lo:hi][i])
                dst.append(row[lo:hi][j])
                reached = max(reached, d)
    return np.concatenate(src), np.concatenate(dst), reached


def split(bucket: int, sketch: np.ndarray, threshold: float, least: float, depth: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one bucket, split as often as the depth that it reaches asks for."""
    src, dst, done, wanted = [], [], 0, 1
    while done < wanted:
        seed = bucket if not done else int(tk.mix(np.array([bucket ^ done], np.uint64))[0])
        i, j, reached = _split(seed, sketch, threshold, least, depth)
        src.append(i)
        dst.append(j)
        done += 1
        wanted = max(wanted, repeats_for(depth, reached))
    return np.concatenate(src), np.concatenate(dst)


def _bucket_edges(threshold: float):
    least = max(0.0, threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / T))

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        bucket, ids = t["bucket"].to_numpy(), t["node"].to_numpy()
        sk = np.frombuffer(t["sketch"].combine_chunks().cast(pa.large_binary()).buffers()[2], np.uint16).reshape(-1, T)[: len(ids)]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[cuts, len(ids)])
        src, dst = [], []
        two = cuts[size == 2]
        ok = two[(sk[two] == sk[two + 1]).sum(1) >= least * T]
        src.append(ids[ok])
        dst.append(ids[ok + 1])
        for lo, k in zip(cuts[size > 2], size[size > 2]):
            order = lo + np.argsort(ids[lo : lo + k], kind="stable")
            i, j = split(int(bucket[lo].view(np.uint64)), sk[order], threshold, least)
            src.append(ids[order[i]])
            dst.append(ids[order[j]])
        a, b = np.concatenate(src), np.concatenate(dst)
        e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["src", "dst"])

    return tk.by_runs(one, "bucket")


def _exact(n: int, threshold: float):
    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cell = t["cell"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(cell)]):
            c = t.slice(lo, hi - lo)
            nodes, side, copies, diagonal = c["node"].to_numpy(), c["side"].to_numpy(), c["copies"].to_numpy(), bool(c["diagonal"][0].as_py())
            parts = [gram_sets(tk.words(x.column("text")), n) for b in c.select(["text"]).combine_chunks().to_batches() for x in tk.slices(b)]
            h = np.concatenate([p[0] for p in parts])
            size = np.concatenate([np.diff(p[1]) for p in parts])
            first = np.cumsum(size) - size
            whole = np.flatnonzero(size)
            made = np.zeros(len(nodes), np.uint64)
            made[whole] = np.add.reduceat(tk.mix(h), first[whole]) if len(whole) else made[whole]
            ok = np.flatnonzero((made.view(np.int64) == nodes) & (size > 0))
            ok = ok[np.unique(nodes[ok], return_index=True)[1]]  # one text for each set
            if len(ok) < 2:
                continue
            h, nodes, side, copies, size = h[tk.ranges(first[ok], size[ok])], nodes[ok], side[ok], copies[ok], size[ok]
            first = np.cumsum(size) - size
            token = np.unique(h, return_inverse=True)[1]
            mark = np.zeros(int(token.max()) + 1, bool)
            links, comp = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            src, dst = [], []
            for x in range(len(nodes)) if diagonal else np.flatnonzero(side == 0):
                mark[token[first[x] : first[x] + size[x]]] = True
                shared = np.add.reduceat(mark[token], first, dtype=np.int64)
                mark[token[first[x] : first[x] + size[x]]] = False
                near = shared >= threshold * (size + size[x] - shared) - 1e-9
                near[x] = False
                if not diagonal:
                    near &= side == 1
                y = np.flatnonzero(near)
                if not len(y):
                    continue
                links[x] += copies[y].sum()
                if not diagonal:
                    links[y] += copies[x]
                fresh = y[comp[y] != comp[x]]
                if len(fresh):
                    fresh = fresh[np.unique(comp[fresh], return_index=True)[1]]
                    src += [x] * len(fresh)
                    dst += fresh.tolist()
                    comp[np.isin(comp, comp[fresh])] = comp[x]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[nodes[some], nodes[src]]), pa.array(np.r_[nodes[some], nodes[dst]]), pa.array(np.r_[links[some], np.zeros(len(src), np.int64)])], names=["node", "other", "links"])

    return tk.by_runs(one, "cell", rows=2000, size=8 << 20)


def _cells(members: DataFrame, group: str, block: int, *kept: str) -> DataFrame:
    """Rows of members (node, group, blocks) once for each pair of blocks that its own is in: cell, side (0 or 1), diagonal."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(
        "node",
        *kept,
        F.when(F.col("blocks") == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("mine") == F.col("other")).alias("diagonal"),
    )


def classes(docs: DataFrame, s: Scratch, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, key, set_hi, set_lo, class_id, n_links) of every text; key is the text's xxhash64."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1], recall in (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    made = s.save(texts.mapInArrow(_sketch_batches(n, runs_for(recall), threshold), "doc_id long, key long, set_hi long, set_lo long, worded boolean, sketch binary, buckets array<long>"))
    members = made.select("doc_id", "key", "set_hi", "set_lo", "worded").distinct()
    sets = s.keep(members.where("worded").select("doc_id", "set_hi", "set_lo").distinct().groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = made.join(sets.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_hi", "set_lo"]).select(F.col("set_hi").alias("node"), "sketch", "buckets")
    each = s.save(reps.select("node", F.explode("buckets").alias("bucket")).distinct())
    met = each.join(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "node", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    met = met.join(reps.select("node", "sketch").dropDuplicates(["node"]), "node")
    cells = _cells(met, "bucket", hot, "sketch").select(F.col("cell").alias("bucket"), "node", "sketch")
    edges = s.keep(cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_edges(threshold), "src long, dst long").distinct())
    family = s.keep(connected_components(edges))
    sizes = family.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = family.join(sizes, "component").join(sets.select(F.col("set_hi").alias("node"), F.col("rep").alias("doc_id"), "copies"), "node")
    cells = s.keep(_cells(placed, "component", block, "doc_id", "copies"))
    fetched = texts.select("doc_id", "text").join(small_side(cells, 3 * ROW_BYTES * cells.count()), "doc_id")
    found = s.keep(fetched.select("cell", "side", "diagonal", "node", "copies", "text").repartition("cell").sortWithinPartitions("cell").mapInArrow(_exact(n, threshold), FOUND))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = s.keep(connected_components(found.where("links = 0").select(F.col("node").alias("src"), F.col("other").alias("dst"))))
    known = sets.join(parts, F.col("set_hi") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set_hi")).drop("node")
    least = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = known.join(least, "component").join(links, F.col("set_hi") == F.col("node"), "left").select("set_hi", "set_lo", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    worded = members.where("worded").drop("worded").join(linked, ["set_hi", "set_lo"]).select("doc_id", "key", "set_hi", "set_lo", "class_id", "n_links")
    return worded.unionByName(members.where("not worded").select("doc_id", "key", "set_hi", "set_lo", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def jaccard_classes(docs: DataFrame, **parameters: float) -> DataFrame:
    """Rows of SCHEMA: class and number of links of every document."""
    with Scratch(docs.sparkSession) as s:
        return s.keep(classes(docs, s, **parameters).select("doc_id", "set_hi", "set_lo", "class_id", "n_links").distinct().select("doc_id", "class_id", "n_links"))


def keep_one(docs: DataFrame, **parameters: float) -> DataFrame:
    """The rows of docs without those of a class that has a row of lesser (id, hash of the text); all columns stay.

    Repeated rows of the one that stays, and rows without an id, stay as well.
    """
    with Scratch(docs.sparkSession) as s:
        held = s.save(classes(docs, s, **parameters).where("n_links > 0 or doc_id <> class_id").select("doc_id", "key", "class_id"))
        kept = held.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("class_id", "x.*")
        gone = s.keep(held.join(kept, ["class_id", "doc_id", "key"], "left_anti").select("doc_id", "key").distinct())
        return tk.drop_texts(docs, gone, 2 * ROW_BYTES * gone.count())


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{tk.WORD_SQL}') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= {N} THEN list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i + {N} - 1], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS gs
      FROM w),
c AS (SELECT doc_id, gs, md5(array_to_string(gs, chr(10))) AS k FROM g WHERE len(gs) > 0),
s AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(gs) AS gs FROM c GROUP BY k),
r AS (SELECT k, copies, len(gs) AS n, unnest(gs) AS gram FROM s),
p AS (SELECT a.k AS a, b.k AS b, any_value(b.copies) AS copies FROM r a JOIN r b ON a.gram = b.gram AND a.k <> b.k
      GROUP BY 1, 2 HAVING count(*) >= {THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
t AS (SELECT k AS a, k AS b FROM s UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
m AS (SELECT t.a AS k, min(s.rep) AS class_id FROM t JOIN s ON t.b = s.k GROUP BY 1),
l AS (SELECT a AS k, sum(copies) AS links FROM p GROUP BY 1)
SELECT c.doc_id, m.class_id, CAST(coalesce(l.links, 0) + s.copies - 1 AS BIGINT) AS n_links FROM c JOIN s ON c.k = s.k JOIN m ON c.k = m.k LEFT JOIN l ON c.k = l.k
UNION ALL SELECT doc_id, doc_id, 0 FROM g WHERE len(gs) = 0
"""
