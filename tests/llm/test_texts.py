"""Repeats, decontamination, language ID, line rules and the whole pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, language_id, line_rules, ngram_join, packing, relative_lz, repeats, suffix_array

WORD = r"[0-9A-Za-z\x80-\U0010ffff]+"


def words(text):
    return re.findall(WORD, text.lower())


def brute_spans(rows, window):
    seen, out = set(), set()
    for d, t in sorted(rows):
        w = words(t)
        dup = []
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                dup.append(i)
            seen.add(key)
        held = []
        for i in dup:
            if held and i <= held[-1][1]:
                held[-1][1] = i + window
            else:
                held.append([i, i + window])
        out |= {(d, a, b) for a, b in held}
    return out


def repeating(seed):
    r = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(r.randint(5, 40))] for k in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice("abcde") for _ in range(r.randint(1, 30))]
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [repeats.BUCKET_ENTRIES, 3])
@pytest.mark.parametrize("find", [suffix_array.duplicate_spans, relative_lz.duplicate_spans])
def test_spans(spark, seed, find, bucket):
    """Buckets of a few entries cut hot anchors at their boundaries; the rows stay."""
    rows = repeating(seed)
    got = find(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=4, bucket=bucket).collect()
    assert {tuple(r) for r in got} == brute_spans(rows, 12) and got


@pytest.mark.parametrize("find", [suffix_array.duplicate_spans, relative_lz.duplicate_spans])
def test_hot_passage(spark, find):
    """A passage in half of all texts goes through many buckets."""
    r = random.Random(8)
    passage = " ".join(f"hot{i}" for i in range(30))
    rows = [(d, " ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(r.randint(1, 30))) + " " + (passage if d % 2 else "")) for d in range(600)]
    got = find(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=4, bucket=40).collect()
    assert {tuple(x) for x in got} == brute_spans(rows, 12) and len(got) >= 299


def bucket_of(seed, window):
    r = random.Random(seed)
    rows = [(d, 1, 0, np.array([r.randint(1, 3) for _ in range(r.randint(window, 3 * window))], np.uint32)) for d in range(40)]
    t = pa.table({"lead": [0] * 40, "block": [d % 3 for d in range(40)], "doc_id": [x[0] for x in rows], "d1": [1] * 40, "lo": pa.array([0] * 40, pa.int32()), "words": [x[3].tobytes() for x in rows]})
    return repeats.read_bucket(t, window), [x[3].tolist() for x in rows]


@pytest.mark.parametrize("seed", range(4))
def test_multikey_quicksort(seed):
    """The suffix order and common prefixes of a plain sort, of fixed and of whole lengths."""
    b, texts = bucket_of(seed, 7)
    places = [(e, k) for e, w in enumerate(texts) for k in range(len(w) - 6)]
    assert b.entry.tolist() == [e for e, _ in places]
    for length in (7, b.end - b.begin):
        order, shared = repeats.multikey_quicksort(b, length)
        suffix = [texts[e][k : k + 7] if isinstance(length, int) else texts[e][k:] for e, k in places]
        assert order.tolist() == sorted(range(len(places)), key=lambda i: (suffix[i], i))
        for i in range(1, len(order)):
            x, y = suffix[order[i - 1]], suffix[order[i]]
            assert shared[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("seed", range(4))
def test_longest_earlier_match(seed):
    """Length and place of the longest earlier match of every suffix, and the greedy parse, against a plain search."""
    b, texts = bucket_of(seed, 7)
    places = [(e, k) for e, w in enumerate(texts) for k in range(len(w) - 6)]
    length, source = relative_lz.longest_matches(*repeats.multikey_quicksort(b, b.end - b.begin))
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    for i, (e, k) in enumerate(places):
        best = max((common(texts[e][k:], texts[f][j:]) for f, j in places[:i]), default=0)
        assert length[i] == best
        if best:
            f, j = places[source[i]]
            assert source[i] < i and common(texts[e][k:], texts[f][j:]) == best
    windows = np.maximum(length - 6, 0)
    at, n = relative_lz.greedy(b.first, np.bincount(b.entry, minlength=len(b.first)), windows)
    want, i = [], 0
    for e, w in enumerate(texts):
        end, i = b.first[e] + len(w) - 6, b.first[e]
        while i < end:
            if windows[i]:
                want.append((i, windows[i]))
            i += max(1, windows[i])
    assert list(zip(at, n)) == want


@pytest.mark.parametrize("bucket", [repeats.BUCKET_ENTRIES, 3])
def test_factors_point_at_equal_words(spark, bucket):
    rows = repeating(2)
    texts = {d: words(t) for d, t in rows}
    n = 0
    for r in relative_lz.factors(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=4, bucket=bucket).collect():
        m = r.word_end - r.word_start
        assert texts[r.doc_id][r.word_start : r.word_end] == texts[r.ref_doc][r.ref_start : r.ref_start + m] and (r.ref_doc, r.ref_start) < (r.doc_id, r.word_start)
        n += 1
    assert n


def test_several_texts_of_one_id(spark):
    """Spans of one text leave the other texts of its id as they are."""
    p = " ".join(f"p{i}" for i in range(60))
    other, short = " ".join(f"q{i}" for i in range(120)), "a short one"
    rows = [(1, p), (2, p + " and a tail"), (2, other), (2, short), (3, p)]
    got = sorted(map(tuple, suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(1, p), (2, "and a tail"), (2, other), (2, short)])


def cut(text, spans):
    starts = [m.start() for m in re.finditer(WORD, text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : starts[a]])
        at = len(text) if b >= len(starts) else starts[b]
    return "".join(out) + text[at:]


def test_remove_repeats(spark):
    rows = repeating(0)
    got = {r.doc_id: r.text for r in suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=4).collect()}
    by = {}
    for d, a, b in brute_spans(rows, 12):
        by.setdefault(d, []).append((a, b))
    want = {d: cut(t, by.get(d, [])) for d, t in rows}
    assert got == {d: t for d, t in want.items() if d not in by or words(t)}


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def brute_leaks(rows, items, rate=decontaminate.RATE):
    """Items without an edit must stand as whole words."""
    out = set()
    for d, t in rows:
        for i, x in items:
            x, t = decontaminate.normal(x), decontaminate.normal(t)
            k = int(rate * len(x))
            e = edits(x, t) if k or re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t) else k + 1
            if e <= k:
                out.add((d, i, e))
    return out


def leaking(seed):
    r = random.Random(seed)
    letters = "abcdefgh  "
    items = [(k, "q" + "".join(r.choice(letters) for _ in range(r.randint(10, 70))) + "z") for k in range(6)]
    rows = []
    for d in range(25):
        t = "".join(r.choice(letters) for _ in range(120))
        if d % 2:
            x = list(r.choice(items)[1])
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(x))
                x[k] = r.choice(["", "y", x[k] + "v", x[k].upper()])
            t = t[:50] + r.choice(["", " "]) + "".join(x) + r.choice(["", " "]) + t[50:]
        rows.append((d, t))
    return rows, items


@pytest.mark.parametrize("seed", range(3))
def test_leaks(spark, seed):
    rows, items = leaking(seed)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_leaks(rows, items)
    assert {tuple(r) for r in decontaminate.contaminated(d, b).collect()} == want and want
    assert {tuple(r) for r in decontaminate.contaminated(d, b, item_bytes=100).collect()} == want
    long = {i for i, x in items if len(decontaminate.normal(x)) >= decontaminate.LEAST}
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {d for d, _ in rows} - {d for d, i, _ in want if i in long}


def test_leaks_of_any_script_and_of_whole_words(spark):
    """Items and texts have one lower case; a short item is found as words only and drops no text."""
    items = [(1, "Ο ΔΡΟΜΟΣ ΠΡΟΣ ΤΗΝ ΠΟΛΗ ΕΙΝΑΙ ΜΑΚΡΥΣ ΟΔΟΣ"), (2, "İSTANBUL'DA GÜZEL BİR GÜN DAHA GEÇTİ"), (3, "o"), (4, "ΟΔΟΣ")]
    rows = [(1, "x " + items[0][1] + " y"), (2, items[1][1]), (3, "go on for long"), (4, "sol o luna"), (5, "μια οδοσ εδώ"), (6, None), (7, ""), (8, "z " * 100_000 + items[0][1])]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(d, b).collect()}
    assert {(1, 1, 0), (2, 2, 0), (4, 3, 0), (8, 1, 0)} <= got and not {x for x in got if x[0] in (3, 6, 7)}
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {3, 4, 5, 6, 7}


def test_leak_of_one_text_of_an_id(spark):
    b = spark.createDataFrame([(1, "what is the capital of the country of nowhere")], "item_id long, text string")
    rows = [(1, "so what is the capital of the country of nowhere then"), (1, "quite another text")]
    assert [r.text for r in decontaminate.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()] == ["quite another text"]


def test_myers():
    r = random.Random(4)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (12, 30))
        assert decontaminate.least_distance(decontaminate.masks(p), len(p), t) == edits(p, t)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 60")
    model = language_id.train(even, bound=100)
    rows = language_id.identify(odd, model=model).join(odd.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows) and sum(r.accepted for r in rows) >= 0.97 * len(rows)
    junk = spark.createDataFrame([(1, "#### $$$$ 1234 5678 !!!!"), (2, "qxzj vkqx zzxq jjkv wqxz"), (3, "日本語の文章です")], "doc_id long, text string")
    assert not any(r.accepted for r in language_id.identify(junk, model=model).collect())


def test_line_rules(spark):
    good = "This is a long sentence that says something, and it ends well."
    rows = [(1, good), (2, f"{good}\nHome | About | Contact\nAll rights reserved.\n{good}"), (3, "Home | About | Contact\nshort"), (4, "!!! $$$ ### @@@ %%%")]
    got = {r.doc_id: r.text for r in line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: good, 2: f"{good}\n{good}"}


def test_line_rules_in_linear_time(spark):
    """Lines of megabytes that nearly match a rule again and again."""
    import time

    rows = [(1, "released under the " * 150_000), (2, "a > " * 500_000), (3, "| x" + " " * 1_000_000 + "y"), (4, "!!" * 500_000), (5, "word" * 500_000 + " and " * 3 + "x" * 1_000_000)]
    t = time.time()
    line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.time() - t < 60


def test_every_line_rule(spark):
    bad = ["  ", "Released under the MIT License today, and more words here.", "Copyright 2024 by some people of the world.", "Home > News > Sports", "www.example.org", "again again again again again again again again again again", "a = b + c @ d # e, such a line.", "What a day!! How nice!! So it is.", "Two words", "Alle Rechte vorbehalten, und mehr."]
    kept = ["This line is fine, as it ends well.", "Short one.", "A longer line of words without any end"]
    for line, good in [(x, False) for x in bad] + [(x, True) for x in kept]:
        got = spark.createDataFrame([(line,)], "line string").select(line_rules.prepared(F.col("line")).alias("x")).select(line_rules.fails(F.col("x")).alias("f")).first().f
        assert (got is None) == good, line


def test_pipeline(spark):
    """run() against every stage by brute force; the language model is the operator's own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    accepted = {r.doc_id for r in language_id.identify(docs).where("accepted").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in accepted)

    def grams(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    sets = [(d, grams(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= ngram_join.THRESHOLD * len(x | y) - 1e-9:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    rows = [(d, t) for d, t in rows if find(d) == d]
    by = {}
    for d, a, b in brute_spans(rows, repeats.WINDOW):
        by.setdefault(d, []).append((a, b))
    rows = [(d, cut(t, by[d]) if d in by else t) for d, t in rows]
    rows = [(d, t) for d, t in rows if d not in by or words(t)]
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, t in rows if any(len(x) >= decontaminate.LEAST and decontaminate.least_distance(decontaminate.masks(x), len(x), decontaminate.normal(t)) <= int(decontaminate.RATE * len(x)) for _, x in items)}
    rows = [(d, t) for d, t in rows if d not in leaked]
    want = packing.pack_related(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, want)) and want and leaked and by


def test_stages_have_an_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        now = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
        assert 0 < now[0] <= n, name
        n = now[0]


def test_known_bins_of_every_language():
    """Neither one very long text nor many texts of other languages make a language unknown."""
    r = np.random.default_rng(3)
    share = r.dirichlet(np.full(200, 2.0), 2)
    draw = lambda k, n: np.bincount(r.choice(200, n, p=share[k]) + 1000 * k, minlength=language_id.DIMS).astype(np.float32)
    test = np.stack([draw(1, 300) for _ in range(50)])
    letters = np.full(50, 300)
    for c in ([draw(0, 300) for _ in range(400)] + [draw(1, 300) for _ in range(5)], [draw(0, 10_000_000)] + [draw(0, 300) for _ in range(20)] + [draw(1, 300) for _ in range(20)]):
        few = 5 if len(c) == 405 else 20
        model = language_id.fit(np.stack(c), np.array(["aa"] * (len(c) - few) + ["bb"] * few), {})
        assert model.predict(test, letters)[3].all()


def test_spans_are_what_factors_cover(spark):
    """op10's spans come from the greedy factors; factors that touch are one span."""
    one = np.ones(4, np.int64)
    assert [x.tolist() for x in relative_lz.covered(np.array([1, 1, 1, 2]), one, np.array([0, 60, 200, 120]), np.array([60, 120, 260, 180]))] == [[1, 1, 2], [1, 1, 1], [0, 200, 120], [120, 260, 180]]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    parts = sorted((r.doc_id, 1, r.word_start, r.word_end) for r in relative_lz.factors(docs).collect())
    want = {(d, a, b) for d, _, a, b in zip(*[x.tolist() for x in relative_lz.covered(*map(np.array, zip(*parts)))])}
    assert want and want <= {tuple(r) for r in relative_lz.duplicate_spans(docs).collect()}


def test_language_by_a_plain_version(spark):
    """Features, families and votes of the model, text by text, without arrays."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs, bound=40)
    of = {b: a for a, names in model.languages.items() for b in names}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())[::3]
    got = {r.doc_id: r for r in language_id.identify(docs, model=model).collect()}
    checked = 0
    for d, text in rows:
        raw = re.sub(r"[ \t\n\r\f\v]+", " ", text.lower()).encode()
        plain = lambda c: 97 <= c <= 122 or c >= 128 or c == 32
        count = {}
        for x, y, z in zip(raw, raw[1:], raw[2:]):
            if plain(x) and plain(y) and plain(z):
                k = (((x * 40503) ^ (y * 2654435761) ^ (z * 97787)) * 2246822519 % 2**32) >> 20
                count[k] = count.get(k, 0) + 1
        norm = sum(count.values()) ** 0.5
        score = lambda w: sum(n**0.5 / norm * w[k] for k, n in count.items()) + w[-1]
        by_family = sorted(((score(w), f) for f, w in zip(model.families, model.first)), reverse=True)
        family = by_family[0][1]
        votes = {x: 0.0 for x in model.languages[family]}
        margins = [by_family[0][0] - by_family[1][0]]
        for (a, b), w in model.pairs.items():
            if of[a] == family:
                m = score(w)
                margins.append(abs(m))
                votes[a if m > 0 else b] += 1
                votes[a] += 1e-4 * m
                votes[b] -= 1e-4 * m
        if min(margins) < 1e-3:
            continue
        assert (got[d].family, got[d].language) == (family, max(votes, key=votes.get)) and got[d].margin == pytest.approx(min(margins), abs=1e-3)
        checked += 1
    assert checked > 20
