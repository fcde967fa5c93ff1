"""Findings over larger tables and odd inputs."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.operators import mining

ODD = ("testß", "Prüf-test", "tests", "ätest", "teſt it", "Check", "checK", "checK", "x_test", "verify.", "", "fixé the bugé", "ERTEST ist")


@pytest.mark.parametrize("pattern", [mining.VERIFY, mining.FIX, mining.ENSURE, mining.REVERT, r"\b(test|fixé)\b"])
def test_words_like_sql(spark, duck, pattern):
    """a word ends before a letter that isn't ASCII, as in SQL."""
    want = [duck.execute("SELECT regexp_matches(?, ?)", [x, pattern]).fetchone()[0] for x in ODD]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string").select("i", fn.words(F.col("x"), pattern).alias("y")).orderBy("i")
    assert [r.y for r in rows.collect()] == want


@pytest.mark.parametrize("most", [1, 3, 100])
def test_chunks_hold_whole_components(most):
    """A task's memory is one component and ``most`` rows, not its partition."""
    import numpy as np
    import pandas as pd

    from factloom.operators import graph

    sizes = [1, 2, 9, 1, 1, 4, 2]
    pdf = pd.DataFrame({"component": np.repeat(np.arange(len(sizes)), sizes)})
    pdf["row"] = range(len(pdf))
    for batch in (1, 2, 5, 50):
        got = list(graph._chunks((pdf.iloc[i : i + batch] for i in range(0, len(pdf), batch)), ["component"], most))
        assert pd.concat(got)["row"].tolist() == pdf["row"].tolist()
        assert all(set(a["component"]).isdisjoint(b["component"]) for a, b in zip(got, got[1:]))
        assert all(len(x) - x["component"].value_counts().max() < most for x in got)


def test_ranks_by_component(spark, monkeypatch):
    """components ranked by themselves, large ones over the cluster, have the ranks of one task over all."""
    from factloom.operators import graph
    from factloom.plans import iterate

    edges = [(10 * c + i, 10 * c + (i * i + c) % 7) for c in range(6) for i in range(5)] + [(100 + i, 101 + i) for i in range(9)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for rounds in (None, 5):
        want = {r.node: r["rank"] for r in graph.pagerank(df, rounds=rounds, tolerance=1e-10).collect()}
        monkeypatch.setattr(graph, "labelled", lambda e, s: iterate.labelled(e, s, one_task_edges=0))
        got = {r.node: r["rank"] for r in graph.pagerank(df, rounds=rounds, tolerance=1e-2, one_task_edges=8).collect()}
        assert got == {k: pytest.approx(v, abs=1e-3 if rounds is None else 1e-9) for k, v in want.items()}


def test_reduction_without_roots(spark):
    """counts by component are those over the cluster, also where no node of the whole graph is a root."""
    from factloom.operators import graph

    ring, tail = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (2, 4), (4, 3), (1, 4)], [(9, 8), (8, 7), (9, 7)]
    for edges, want in ((ring, (5, 8, 2, 1)), (ring + tail, (8, 11, 3, 2)), (tail + [(6, 5), (5, 6)], (5, 5, 3, 2))):
        for bits in (graph.BITS, 1):
            assert tuple(graph.reduce_fully(spark.createDataFrame(edges, "src long, dst long"), bits=bits).first()) == want


def test_report_in_shares(spark):
    """cut vertices, tangles and ranks of a component that is searched in several tasks are those of one task."""
    from factloom.operators import graph

    edges = spark.createDataFrame([(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, i + 1) for i in range(22, 30)] + [(50, 51), (51, 50)], "src long, dst long")
    one, several = ({r.node: tuple(r)[1:] for r in graph.measures(edges, search=k, strong=True).collect()} for k in (graph.SEARCH, 40))
    assert several == {k: (pytest.approx(v[0], abs=1e-11), *v[1:]) for k, v in one.items()} and any(v[2] > 1 for v in one.values())


def test_co_changes(spark):
    """repeats, single files and nulls."""
    from factloom.operators import joins

    rows = [(1, "b"), (1, "a"), (1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (None, "a"), (4, None), (4, "a")]
    assert {tuple(r) for r in joins.co_changes(spark.createDataFrame(rows, "sha long, path string")).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_within_ranges(spark, monkeypatch, kind):
    """F3-F5, F11-F15, F19, F20: most components are worked on where their nodes lie, without rounds; rows are those of gathered ones."""
    import random

    from factloom.operators import graph
    from factloom.plans import iterate, ranges

    r = random.Random(5)
    edges = {(10 * c + r.randrange(8), 10 * c + r.randrange(8)) for c in range(40) for _ in range(9)} | {(500 + (i * 7) % 30, 500 + (i * 7 + 7) % 30) for i in range(25)} | {(3, 395), (205, 204), (204, 205)}
    name = (lambda x: f"n.{x:03d}") if kind == "string" else (lambda x: x)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in sorted(edges)] + [(None, name(1))], f"src {kind}, dst {kind}").where("src is not null")
    asked = spark.createDataFrame([(name(x),) for x in (1, 17, 204, 395, 510, 999)], f"node {kind}")
    dag = df.where("src < dst")
    runs = {
        "measures": lambda: graph.measures(df, search=600, strong=True), "tangles": lambda: graph.tangles(df), "cuts": lambda: graph.articulation_points(df), "statistics": lambda: graph.dag_statistics(df),
        "radius": lambda: graph.blast_radius(df, asked, bits=12), "reduced": lambda: graph.reduce_fully(df, bits=12), "rings": lambda: graph.reduce_fully(df.unionByName(df.select(F.col("dst").alias("src"), F.col("src").alias("dst")))), "edges": lambda: graph.transitive_reduction(dag, bits=12),
    }
    rows = lambda: {k: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in run().collect()) for k, run in runs.items()}
    want = rows()
    labelled = []
    monkeypatch.setattr(ranges, "ONE_TASK_EDGES", 60)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranges, "labelled", lambda e, s, rows=None: labelled.append((rows, iterate.labelled(e, s, rows=rows))) or labelled[-1][1])
    assert rows() == want
    assert labelled and all(n is not None and n < df.count() / 2 for n, _ in labelled)


def test_ranges_of_far_nodes(spark, monkeypatch):
    """Where connected nodes are far from each other, or one node has most edges, components go by rounds as before."""
    from factloom.operators import graph
    from factloom.plans import ranges

    far = spark.createDataFrame([(i, 1000 - i) for i in range(200)], "src long, dst long")
    star = spark.createDataFrame([(7, i) for i in range(300)], "src long, dst long")
    monkeypatch.setattr(ranges, "ONE_TASK_EDGES", 60)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    assert graph.articulation_points(far).count() == 0 and [r.node for r in graph.articulation_points(star).collect()] == [7]


def test_weights_of_bits():
    """sizes are summed over set bits only, few or many."""
    import numpy as np

    from factloom.operators import graph

    size = np.arange(300) % 7
    for held in ([], [0], [299], [5, 130, 250], list(range(0, 300, 3)), list(range(300))):
        assert graph._weight(sum(1 << i for i in held), size) == sum(int(size[i]) for i in held)


def test_batches_of_the_pipeline(spark):
    """Pipeline's memory: a stage bounds the bytes of a batch, and language ID the rows that are counted at once; a lower bound of the session stays."""
    import pyarrow as pa

    import corpus_pipeline
    from factloom.llm import language_id
    from factloom.llm import textkernel as tk

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("the words of a text "), F.repeat(F.lit("and more "), 330)).alias("text"), F.lit("en").alias("lang"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    try:
        for held, most in (("64m", 1.3 * tk.BATCH), ("1m", 1.3 * 2**20)):
            spark.conf.set(name, held)
            kept = corpus_pipeline.identify_language(spark, docs, "")
            got = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == kept.count() == 6000 and max(r.size for r in got) < most
    finally:
        spark.conf.set(name, before)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 900)], names=["text"])
    assert [x.num_rows for x in tk.slices(batch, **language_id.BOUNDS)] == [256, 256, 256, 132]


def test_stars_of_blocks():
    """F4, F11-F15, F19: packed rows come back as they were, and rounds over blocks end with each component's least node, once for each node, and its size."""
    import numpy as np

    from factloom.plans import iterate
    from factloom.plans import stars as st

    r, edge = np.random.default_rng(4), 2**62
    for parts in (1, 3, 7):
        u, v, kind = r.integers(-edge, edge, 500), r.integers(-edge, edge, 500), r.integers(0, 4, 500).astype(np.int8)
        u[:2] = -(2**63), 2**63 - 1
        held = st._join([st.unpack(p, x, parts) for p, x in zip(*(c.to_pylist() for c in st.pack(u, v, kind, parts).columns))])
        assert sorted(zip(*(x.tolist() for x in held))) == sorted(zip(u.tolist(), v.tolist(), kind.tolist()))
    ids = r.integers(-edge, edge, 400)
    a, b = ids[r.integers(0, 400, 300)], ids[r.integers(0, 400, 300)]
    a[:9], b[:9] = ids[:9], ids[:9]  # loops, some of lone nodes
    x, y, ended, rounds = a, b, [], 0
    kind = np.full(len(a), st.MOVED, np.int8)
    while len(x):
        ends = st._join([(x, y, kind), (y, x, kind)])
        out = st.small_star(*st.large_star(*ends))
        done = out[2] >= st.DONE
        ended.append(tuple(c[done] for c in out))
        x, y, kind = (c[~done] for c in out)
        rounds += 1
        assert rounds < 20
    u, v, kind = st._join(ended)
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[iterate.union_find(idx[: len(a)], idx[len(a) :], len(nodes))]
    assert sorted(zip(u.tolist(), np.where(kind == st.ROOT, u, v).tolist())) == list(zip(nodes.tolist(), root.tolist()))
    least, size = np.unique(root, return_counts=True)
    assert sorted(zip(u[kind == st.ROOT].tolist(), v[kind == st.ROOT].tolist())) == list(zip(least.tolist(), size.tolist()))


@pytest.mark.parametrize("name", ["src", "names"])
def test_labels_shuffle_little(spark, name):
    """F4, F11-F15, F19: labels of gathered edges are those of one task, with the size of every component."""
    from factloom.plans import iterate
    from factloom.plans.scratch import Scratch

    at = (lambda x: f"n.{x:03d}") if name == "names" else (lambda x: x)
    df = spark.createDataFrame([(at(i), at((i * i * 7 + 3) % 90)) for i in range(90) if i % 3] + [(at(95), at(95)), (at(0), at(0))], f"src {'string' if name == 'names' else 'long'}, dst {'string' if name == 'names' else 'long'}")
    runs = []
    for most in (2_000_000, 0):
        with Scratch(spark) as s:
            a = iterate.labelled(df, s, one_task_edges=most)
            runs.append((sorted(map(tuple, a.held.select("src", "dst", "component").collect())), sorted(map(tuple, a.sizes.select("component", "v").collect()))))
    assert runs[0] == runs[1] and len(runs[0][0]) == df.count()
