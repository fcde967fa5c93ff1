"""Huffman ids by exact round trip; sharding, token counts and packing against plain versions."""

import heapq
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from factloom.llm import huffman, packing, sharding, token_counts, tokens


def test_round_trip(spark):
    rows = huffman.encode(spark.read.parquet(f"{SMALL}/documents.parquet"), block=64).collect()
    book = next(r for r in rows if r.doc_id is None)
    lengths = np.frombuffer(book.payload, np.uint8)
    assert lengths.max() <= huffman.BITS and sum(2.0 ** -int(x) for x in lengths if x) <= 1 + 1e-9
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    encoder = tokens.encoding()[0]
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is not None:
            ids = encoder.encode_ordinary(texts[r.doc_id])
            assert huffman.decode(bytes(r.payload), r.n_tokens, r.checkpoints, lengths, 64).tolist() == ids
            if len(ids) > 64:
                assert huffman.decode(bytes(r.payload), r.n_tokens, r.checkpoints, lengths, 64, only=1).tolist() == ids[64:128]


@pytest.mark.parametrize("seed", range(5))
def test_code_lengths(seed):
    r = random.Random(seed)
    counts = np.array([r.choice([0, 1, 2, 5, 100, 4000]) for _ in range(60)], np.int64)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    free = huffman.code_lengths(counts, 24)
    assert int((counts * free).sum()) == cost
    tight = huffman.code_lengths(counts, 6)
    assert tight.max() <= 6 and sum(2.0 ** -int(x) for x in tight if x) <= 1 and int((counts * tight).sum()) >= cost


def plain_bfd(sizes, capacity):
    room, used = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(room) if x >= s]
        if s > capacity:
            used += 1
        elif fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room) + used


@pytest.mark.parametrize("seed", range(6))
def test_pack_like_one_machine(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 130) for _ in range(r.randint(1, 400))]
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    plan, shards = sharding.pack(list(counts.items()), 100)
    assert shards == plain_bfd(sizes, 100)
    load = {}
    for size, lo, hi, per, first in plan:
        for k in range(hi - lo):
            load[first + k // per] = load.get(first + k // per, 0) + size
    assert sum(load.values()) == sum(sizes) and sorted(load) == list(range(shards))
    assert all(v <= 100 or any(s == v for s in sizes if s > 100) for v in load.values())


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = sharding.shard_documents(docs, capacity=40_000)
    load = out.join(docs, "doc_id").groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.max("oversize").cast("int").alias("o")).collect()
    assert out.count() == docs.count() and all(r.b <= 40_000 or r.o for r in load)
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text, []).append(len(r.text.encode()))
    assert len(load) == plain_bfd([sum(g) for g in groups.values()], 40_000)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.section_tokens(docs, rule=rule).collect()}
    encoder, size = tokens.encoding()
    for d in docs.collect():
        raw = d.text.encode()
        line, owner = 0, []
        for b in raw:
            owner.append(line)
            line += b == 10
        want = [0.0] * (max(owner, default=-1) + 1)
        at = 0
        for i in encoder.encode_ordinary(d.text):
            mine = owner[at : at + size[i]]
            at += int(size[i])
            if rule == "start":
                want[mine[0]] += 1
            elif rule == "majority":
                want[max(sorted(set(mine)), key=mine.count)] += 1
            else:
                for o in mine:
                    want[o] += 1 / len(mine)
        assert [got.pop((d.doc_id, k)) for k in range(len(want))] == pytest.approx(want)
    assert not got


def test_given_sections(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta", [("a", 0, 8), ("b", 8, 16)])], "doc_id long, text string, sections array<struct<name:string,char_start:int,char_end:int>>")
    rows = token_counts.section_tokens(d, rule="share", sections="sections").collect()
    assert sum(r.n_tokens for r in rows) == pytest.approx(len(tokens.encoding()[0].encode_ordinary("alpha beta gamma delta")))
    assert {r.name for r in rows} == {"a", "b", None}


def test_windows_hold_every_token_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack_related(docs, window=512, pack_tokens=20_000).orderBy("window", "slot").collect()
    encoder = tokens.encoding()[0]
    want = {r.doc_id: len(encoder.encode_ordinary(r.text)) for r in docs.collect()}
    spans, load = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        load[r.window] = load.get(r.window, 0) + r.token_end - r.token_start
    for d, n in want.items():
        held = sorted(spans.get(d, []))
        assert sum(b - a for a, b in held) == n and all(x[1] == y[0] for x, y in zip(held, held[1:]))
    packs = {w >> 32 for w in load}
    assert all(v == 512 or w == max(x for x in load if x >> 32 == w >> 32) for w, v in load.items()) and packs


def test_walk():
    """A path graph is walked from its end; a star from a leaf through the hub to the best neighbour."""
    e = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([9, 9, 9])
    assert packing.walk(*e) == [0, 1, 2, 3]
    assert packing.walk(np.array([0, 0, 0]), np.array([1, 2, 3]), np.array([5, 9, 7])) == [1, 0, 2, 3]


def test_neighbours(spark):
    """Recall of the graph's edges against all pairs of sketches."""
    from factloom.llm.ngram_join import T
    from factloom.plans.scratch import Scratch

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = docs.withColumn("key", F.lit(1).cast("long")).mapInArrow(packing._survey(3, tokens.VOCABULARY), packing.SURVEY).dropDuplicates(["k1", "k2"])
    with Scratch(spark) as s:
        made = s.keep(made)
        rows = [(r.doc_id, np.frombuffer(r.sketch, np.uint16)) for r in made.collect() if len(r.buckets)]
        got = {}
        for r in packing.graph(made, s).collect():
            got.setdefault(r.src, {})[r.dst] = r.agree
        want = found = 0
        for d, x in rows:
            near = sorted((-int((x == y).sum()), e) for e, y in rows if e != d)[: packing.K]
            near = {e: -a for a, e in near if -a >= packing.FLOOR * T}
            assert all(dict(rows)[e] is not None and int((x == dict(rows)[e]).sum()) == a for e, a in got.get(d, {}).items()) if d % 20 == 0 else True
            want += len(near)
            least = min(near.values(), default=0)
            found += sum(a >= least for a in got.get(d, {}).values()) if near else 0
        assert found >= 0.9 * want > 0


def family(seed, m, s):
    """Sketches of m texts that come from one template; two of them agree in a share of s."""
    from factloom.llm.ngram_join import T

    r = np.random.default_rng(seed)
    sketch = np.repeat(r.integers(0, 1 << 16, (1, T), dtype=np.uint16), m, axis=0)
    own = r.random(sketch.shape) >= s**0.5
    sketch[own] = r.integers(0, 1 << 16, int(own.sum()), dtype=np.uint16)
    return sketch


@pytest.mark.parametrize("s, block", [(0.4, packing.BLOCK), (0.6, packing.BLOCK), (0.6, 500)])
def test_recall_in_a_hot_family(spark, s, block):
    """Several thousand non-equal texts of one template: recall of the K nearest against brute force."""
    from factloom.llm import textkernel as tk
    from factloom.llm.ngram_join import T
    from factloom.plans.scratch import Scratch

    m, pairs = 3000, T // 2
    sketch = family(5, m, s)
    buckets = tk.mix(sketch.view(np.uint32).astype(np.uint64) ^ (np.arange(1, pairs + 1, dtype=np.uint64) << np.uint64(40))).view(np.int64)
    rows = [(i, sketch[i].tobytes(), buckets[i].tolist()) for i in range(m)]
    with Scratch(spark) as scratch:
        got = {}
        for r in packing.graph(spark.createDataFrame(rows, "doc_id long, sketch binary, buckets array<long>"), scratch, block=block).collect():
            assert r.agree == (sketch[r.src] == sketch[r.dst]).sum()
            got.setdefault(r.src, []).append(r.agree)
    want = found = 0
    for i in range(m):
        agree = (sketch == sketch[i]).sum(1)
        agree[i] = 0
        top = np.sort(agree)[-packing.K :]
        top = top[top >= packing.FLOOR * T]
        want += len(top)
        found += sum(a >= top[0] for a in got.get(i, [])) if len(top) else 0
        assert not len(top) or got.get(i)
    assert found >= 0.95 * want > 0


def test_a_component_of_any_size_is_walked_whole(spark):
    """A chain of over a million texts whose links are weak here and there is one path, end to end."""
    from factloom.plans.scratch import Scratch

    m = 1_000_200
    with Scratch(spark) as s:
        chain = spark.range(m - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.when(F.col("id") % 500_000 == 99, 20).otherwise(40).alias("agree"))
        r = packing.paths(chain, s).agg(F.count("*").alias("n"), F.countDistinct("component").alias("components"), F.sum((F.col("node") == F.col("step")).cast("long")).alias("in_order")).first()
    assert (r.n, r.components, r.in_order) == (m, 1, m)


def test_long_white_space():
    """Runs of white space are cut where the tokenizer's pieces end; runs that break the tokenizer pass."""
    e = tokens.encoding()[0]
    for run in (" " * 12_000, "\n" * 10_001, " \n\t" * 5000, "\u3000" * 10_500):
        for text in (run, "a" + run, run + "a", f"one{run}two {run}!", f"x{run}7{run}"):
            assert tokens.encode([text])[0].tolist() == e.encode_ordinary(text)
    ids, at = tokens.encode([" " * 1_500_000 + "end", None, "x"])
    assert b"".join(e.decode_single_token_bytes(int(i)) for i in ids[: at[1]]).decode() == " " * 1_500_000 + "end" and at[1] == at[2]


def test_codes_beyond_twenty_bits():
    """Decoding takes the longest code of the book, whatever the limit was."""
    counts = np.array([1, 1] + [2**k for k in range(1, 26)], np.int64)
    lengths = huffman.code_lengths(counts, 24)
    assert lengths.max() > huffman.BITS
    ids = np.random.default_rng(0).integers(0, len(counts), 5000)
    payload, _, _, inside = huffman.write_bits(ids, np.array([0, 5000]), lengths, huffman.codes(lengths))
    assert huffman.decode(payload.tobytes(), 5000, inside[::512].tolist(), lengths, 512).tolist() == ids.tolist()


def test_overlapping_sections(spark):
    """A section that begins inside an earlier one is cut; all tokens count once."""
    text = "alpha beta gamma delta epsilon"
    d = spark.createDataFrame([(1, text, [("a", 0, 12), ("b", 6, 20), ("c", 2, 5), None, ("d", 25, 22)]), (2, None, [("a", 0, 5)])], "doc_id long, text string, sections array<struct<name:string,char_start:int,char_end:int>>")
    rows = token_counts.section_tokens(d, rule="share", sections="sections").collect()
    assert {(r.name, r.char_start, r.char_end) for r in rows if r.doc_id == 1 and r.section >= 0} == {("a", 0, 12), ("b", 12, 20), ("c", 20, 20), (None, 20, 20), ("d", 25, 25)}
    assert sum(r.n_tokens for r in rows) == pytest.approx(len(tokens.encoding()[0].encode_ordinary(text)))
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [0]


def test_several_texts_of_one_id_are_packed(spark):
    rows = [(1, "one text of some words here"), (1, "another one of quite other things and more"), (1, "one text of some words here"), (2, "one text of some words here")]
    got = packing.pack_related(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    encoder = tokens.encoding()[0]
    n = [len(encoder.encode_ordinary(t)) for _, t in rows]
    assert sum(r.token_end - r.token_start for r in got) == n[0] + n[1] + n[3]


def test_segments_of_a_hot_component(spark):
    """Copies beyond a segment are dealt to several packs, none lost."""
    rows = [(i, "the same words again and again for all") for i in range(300)] + [(1000 + i, f"the same words again and again for all of {i}") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_related(d, window=64, pack_tokens=400, segment=20).collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows} and len({r.window >> 32 for r in got}) > 3


def test_equal_sizes_and_one_hot_group(spark):
    """Groups of equal size, and one group with a third of all rows, never part."""
    rows = [(i, "x" * 100 + str(i % 7 if i % 3 else 9)) for i in range(300)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4096)
    of = {}
    for r in out.collect():
        of.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(x) == 1 for x in of.values()) and len(of) == 8


def plain_walk(src, dst, agree):
    """Paths as the docstring says them, step by step."""
    near = {}
    for a, b, w in zip(src, dst, agree):
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    left, out = set(near), []
    while left:
        x = min(left, key=lambda v: (len(near[v]), v))
        while x is not None:
            left.remove(x)
            out.append(x)
            x = min((v for v in near[x] if v in left), key=lambda v: (-near[x][v], len(near[v]), v), default=None)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_walk_like_a_plain_one(seed):
    r = random.Random(seed)
    weight = {}
    for _ in range(r.randint(1, 60)):
        a, b = sorted(r.sample(range(0, 90, 3), 2))
        weight[a, b] = r.randint(20, 23)
    rows = [(a, b, w) if r.random() < 0.5 else (b, a, w) for (a, b), w in weight.items()]
    rows += [(b, a, w) for a, b, w in rows if r.random() < 0.3]
    src, dst, agree = (np.array(x) for x in zip(*rows))
    assert packing.walk(src, dst, agree) == plain_walk(src.tolist(), dst.tolist(), agree.tolist())


def test_oversize_groups_are_one_kind(spark):
    """Groups beyond the capacity, of whatever sizes, have a shard each, and keep their size."""
    rows = [(i, "x" * (5000 + 100 * i)) for i in range(12)] + [(100 + i, "y" * 30 + str(i)) for i in range(20)]
    got = {r.doc_id: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4096).collect()}
    big = [got[i] for i in range(12)]
    assert len({r.shard for r in big}) == 12 and all(r.oversize and r.group_size == 5000 + 100 * r.doc_id for r in big)
    assert not {r.shard for r in big} & {got[100 + i].shard for i in range(20)} and len({got[100 + i].shard for i in range(20)}) == 1
