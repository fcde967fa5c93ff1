"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in one normal form: lower case by one function, white space runs as one
space. A test item of n characters is leaked by a document of which some stretch is within
k = floor(RATE * n) edits of it. Cut in k + 1 pieces, at least one piece stands unchanged in such a stretch;
one Aho-Corasick pass over a document finds all pieces, and around each hit Myers' bit-parallel algorithm
computes the least distance of any stretch. No leak within the budget can be missed, and every row's distance is exact.

An item too short for an edit (k = 0) must stand verbatim as whole words, not inside of others. All leaks are
reported; ``without_leaks`` drops a text for items of LEAST characters or more only, as a word or two is no leak.

The items go to every worker, up to ITEM_BYTES of text at a time; larger benchmarks are searched in
as many passes over the documents, and no item is left out.

Defined cases: rows without id or text match nothing; items without id, text or a visible character
are skipped; repeated rows, and several texts of one id, give one row per (doc_id, item_id) with the least
distance; items of one id are alternatives, the least distance counts; ``without_leaks`` tells texts of one id
apart; very long texts are searched whole; without documents or items there is no row. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.plans.scratch import ROW_BYTES, Scratch

RATE, ITEM_BYTES, LEAST = 0.05, 8 << 20, 20
FOUND = "doc_id long, key long, item_id long, distance int, n int"


def normal_form(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[ \t\n\r\f\v]{2,}|[\t\n\r\f\v]", " "), " ")


def normal(text: str) -> str:
    return normal_form(pa.array([text], pa.string()))[0].as_py()


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    k = int(rate * len(item))
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def least_distance(peq: dict[str, int], m: int, text: str) -> int:
    """Myers: least edit distance of a pattern of m characters to any stretch of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], rate: float):
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(items):
        for at, piece in pieces(text, rate):
            found.setdefault(piece, []).append((i, at))
    machine = ahocorasick.Automaton()
    for piece, where in found.items():
        machine.add_word(piece, (len(piece), where))
    machine.make_automaton()
    return machine, [masks(t) for _, t in items]


def leaks(text: str, items: tuple[tuple[int, str], ...], rate: float) -> dict[int, int]:
    """Least distance of each item (by its place) that the normal text leaks."""
    machine, peq = _matcher(items, rate)
    near: dict[int, list[int]] = {}
    for end, (size, where) in machine.iter(text):
        for i, at in where:
            near.setdefault(i, []).append(end - size + 1 - at)
    out = {}
    for i, starts in near.items():
        item = items[i][1]
        k = int(rate * len(item))
        if not k:
            if re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text):
                out[i] = 0
            continue
        if item in text:
            out[i] = 0
            continue
        best, lo, hi = k + 1, None, None
        for s in [*sorted(set(starts)), None]:
            if s is not None and hi is not None and s - k <= hi:
                hi = s + len(item) + k
                continue
            if hi is not None:
                best = min(best, least_distance(peq[i], len(item), text[max(0, lo) : hi]))
            if s is not None:
                lo, hi = s - k, s + len(item) + k
        if best <= k:
            out[i] = best
    return out


def _search(items: tuple[tuple[int, str], ...], rate: float):
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = normal_form(b.column("text"))
        rows = [(d, h, items[i][0], k, len(items[i][1])) for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), texts.to_pylist()) if t for i, k in leaks(t, items, rate).items()]
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "key", "item_id", "distance", "n"])

    return tk.sliced(one)


def found_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, key, item_id, distance, n): leaks of each text, with its xxhash64 and the characters of the item."""
    if not 0 <= rate < 0.5:
        raise ValueError("rate must be in [0, 0.5)")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // item_bytes))
    found = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        items = tuple(sorted((r["item_id"], t) for r in part.toLocalIterator() if (t := normal(r["text"]))))
        one = texts.mapInArrow(_search(items, rate), FOUND) if items else spark.createDataFrame([], FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **parameters: float) -> DataFrame:
    """(doc_id, item_id, distance): every leak within the edit budget."""
    return found_leaks(docs, benchmark, **parameters).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, **parameters: float) -> DataFrame:
    """docs without the texts that leak an item of ``least`` characters or more; all columns stay."""
    with Scratch(docs.sparkSession) as s:
        gone = s.keep(found_leaks(docs, benchmark, **parameters).where(F.col("n") >= least).select("doc_id", "key").distinct())
        return tk.drop_texts(docs, gone, 2 * ROW_BYTES * gone.count())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
