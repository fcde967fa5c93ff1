"""Awkward rows through every operator: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, huffman, language_id, line_rules, ngram_join, packing, relative_lz, sharding, suffix_array, token_counts

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in green trees near old stone walls".split()


def passage(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((i * seed) % 17) for i in range(n))


LONG = passage(3, 30_000)
ROWS = [
    (1, passage(1, 80), "en", "s", 1), (1, passage(1, 80), "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, passage(1, 80), "en", "s", 1),
    (4, passage(1, 80), "en", None, 1), (5, LONG, None, "s", 1), (6, LONG + " end", "de", "s", 1), (7, " \n\t ", "en", "s", 3), (8, "…!?", "fr", "s", 3), (9, "ok", "en", "s", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("bucket", "node", "component", "sketch", "cell", "lo", "hi", "block", "shard", "size", "g", "item_id", "distance", "word_start", "_gone", "_id", "src", "dst", "ids", "pos", "path", "h", "c", "sections", "margin")

OPERATORS = {
    "op1": ngram_join.jaccard_classes, "op2": huffman.encode, "op3": language_id.identify, "op4": sharding.shard_documents, "op5": token_counts.section_tokens, "op6": packing.pack_related,
    "op7": line_rules.clean, "op8": suffix_array.duplicate_spans, "op10": relative_lz.duplicate_spans,
    "op9": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, passage(1, 20)), (2, None), (None, "x"), (3, ""), (1, passage(2, 20))], "item_id long, text string")),
}


@pytest.fixture(scope="module")
def awkward(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def results(awkward):
    return {n: f(awkward).collect() for n, f in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    rows = OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect()
    assert len(rows) == (1 if name == "op2" else 0)  # op2: the code book


def test_op1(results):
    assert sorted(map(tuple, results["op1"])) == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 1, 1), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0), (9, 9, 0)]


def test_op2(results):
    texts = [r for r in results["op2"] if r.doc_id is not None]
    assert len(texts) == 10 and {r.doc_id: r.n_tokens for r in texts}[2] == 0 and {r.doc_id: r.n_bits for r in texts}[3] == 0


def test_op3(results):
    assert len(results["op3"]) == 10
    by = {r.doc_id: r for r in results["op3"]}
    assert not by[2].accepted and not by[3].accepted and not by[7].accepted and by[2].language is None


def test_op4(results):
    assert len(results["op4"]) == 10
    assert len({r.shard for r in results["op4"] if r.doc_id in (1, 4)}) == 1


def test_op5(results):
    ids = {r.doc_id for r in results["op5"]}
    assert 2 not in ids and 3 not in ids and None not in ids and {1, 4, 5, 6, 7, 8, 9} <= ids


def test_op6(results):
    ids = {r.doc_id for r in results["op6"]}
    assert ids == {1, 4, 5, 6, 7, 8, 9}
    assert sum(r.token_end - r.token_start for r in results["op6"] if r.doc_id == 1) == sum(r.token_end - r.token_start for r in results["op6"] if r.doc_id == 4)


def test_op7(results):
    assert {r.doc_id for r in results["op7"]} <= {1, None, 4, 5, 6, 8, 9}
    assert not {2, 3, 7} & {r.doc_id for r in results["op7"]}


@pytest.mark.parametrize("name", ["op8", "op10"])
def test_repeats(results, name):
    by = {}
    for r in results[name]:
        by.setdefault(r.doc_id, []).append((r.word_start, r.word_end))
    assert by[4] == [(0, 80)] and 1 not in by and min(by[6])[0] == 0 and not {2, 3, 7, 8, 9, None} & set(by)
    assert results["op8"] and sorted(map(tuple, results["op8"])) == sorted(map(tuple, results["op10"]))


def test_op9(results):
    assert {(r.doc_id, r.item_id, r.distance) for r in results["op9"] if r.item_id == 1 and r.distance == 0} >= {(1, 1, 0), (4, 1, 0)}
    assert len(results["op9"]) == len({(r.doc_id, r.item_id) for r in results["op9"]})


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, awkward, k, tmp_path):
    """Each stage takes awkward rows and an empty table; all but the last keep the columns."""
    spark.createDataFrame([(1, passage(9, 20)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (awkward, awkward.where("false")):
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
