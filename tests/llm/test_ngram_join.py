"""The join against all pairs by brute force: exact values, recall, families in blocks."""

import random
import re

import numpy as np
import pytest

from factloom.llm import ngram_join as nj


def grams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows, threshold=nj.THRESHOLD):
    sets = [(d, grams(t)) for d, t in rows]
    return {(a, b): (len(x & y), len(x | y)) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and len(x & y) >= threshold * len(x | y) - 1e-9}


def corpus(seed, families=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.06, 0.1]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


def families(pairs, ids):
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("block,hot", [(nj.BLOCK, nj.HOT), (2, nj.HOT), (nj.BLOCK, 2)])
def test_recall_and_counts(spark, block, hot):
    """Classes and links of brute force; blocks of families and of buckets make no difference."""
    rows = corpus(3)
    want = brute(rows)
    found = nj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block, hot=hot).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in found}
    assert len(got) == len(found) == len(rows)
    family = families(want, [d for d, _ in rows])
    links = {d: sum(d in p for p in want) for d, _ in rows}
    assert sum(links.values()) > 0 and all(got[d][1] <= links[d] for d in got)
    assert sum(n for _, n in got.values()) >= 0.98 * sum(links.values())
    assert sum(got[d] == (family[d], links[d]) for d in got) >= 0.97 * len(got)


def test_hot_family(spark):
    """Copies and near copies in a family far above the blocks: every link is counted, and rows are as many as texts."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(400):
        w = list(base)
        if d % 2:
            w[r.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(w)))
    want = brute(rows)
    got = {x.doc_id: (x.class_id, x.n_links) for x in nj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == {d: (0, sum(d in p for p in want)) for d, _ in rows}


def test_keep_one(spark):
    rows = corpus(5, 15)
    pairs = brute(rows)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    firsts = {find(d) for d, _ in rows}
    assert firsts <= kept and len(kept - firsts) <= 0.1 * len(firsts)


def test_large_bucket_splits():
    """A bucket of several families, larger than a leaf, still joins each family and no two."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 16, (6, nj.T), dtype=np.uint16)
    sketch = np.repeat(base, 200, axis=0)
    noise = r.random(sketch.shape) < 0.08
    sketch[noise] = r.integers(0, 1 << 16, int(noise.sum()), dtype=np.uint16)
    src, dst = nj.split(12345, sketch, nj.THRESHOLD, 0.42)
    assert (src // 200 == dst // 200).all()
    root = nj.union_find(src, dst, len(sketch))
    assert sum(len(np.unique(root[k * 200 : k * 200 + 200])) for k in range(6)) <= 6 + 0.02 * len(sketch)


def test_recall_of_deep_buckets():
    """Pairs at the threshold among many unlike sets that share a bucket: splitting on keeps INNER of them."""
    r = np.random.default_rng(4)
    one = r.integers(0, 1 << 16, (1500, nj.T), dtype=np.uint16)
    one[:, :6] = 7  # what all have in common holds them together for some levels
    two = one.copy()
    for k in range(len(two)):
        j = 6 + r.permutation(nj.T - 6)[: round(nj.T * (1 - nj.THRESHOLD))]
        two[k, j] = r.integers(0, 1 << 16, len(j), dtype=np.uint16)
    src, dst = nj.split(77, np.r_[one, two], nj.THRESHOLD, 0.5)
    met = {(min(a, b), max(a, b)) for a, b in zip(src.tolist(), dst.tolist())}
    assert sum((k, k + 1500) in met for k in range(1500)) >= 0.93 * 1500


def test_runs():
    assert nj.runs_for(0.9) < nj.runs_for(0.99)
    assert nj.repeats_for(2, 2) == 1 < nj.repeats_for(2, 3) < nj.repeats_for(2, 8)
    with pytest.raises(ValueError):
        nj.classes(None, None, threshold=0)


def test_same_id_different_texts(spark):
    """Several texts of one id are texts of their own; only those that have an earlier one in their class go."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, None), (4, ""), (5, "!!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.jaccard_classes(d).collect())) == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1), (4, 4, 0), (5, 5, 0)]
    assert sorted(map(tuple, nj.keep_one(d).collect()), key=str) == sorted([(1, a), (2, b), (4, None), (4, ""), (5, "!!")], key=str)
