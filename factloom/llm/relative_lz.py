"""Repeated passages by relative Lempel-Ziv parsing.

Each text is parsed against all that stands before it in order of (doc_id, digest, word). The reference is
indexed in blocks: a block is the words around the occurrences of some anchors (see ``repeats``), indexed by the
sorted order of its suffixes. Every window of ``window`` words lies around exactly one anchor, so sending each
text's stretches to the blocks of their anchors meets every indexed block that could hold a match, and no other.

In a block the longest match of a suffix with an earlier place is with one of its two neighbours in the sorted
order among those that stand earlier: the nearest such one on either side (of equal lengths the earlier place).
A stretch is matched greedily: from its first word that has a match of ``window`` words on, take the longest;
the next match is sought from the first window that the last one doesn't hold, that is, across its end.

Back in its text, matches whose sources go on alike are one factor; a factor begins where the one before it
ended. The windows across factor boundaries were matched on their own, so a passage is found though two
factors share it. The spans are what the factors cover.

Words are compared as in ``suffix_array``; blocks that a hot anchor makes too large are cut, and what one part
has first is looked up in the others. Defined cases are those of ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import repeats
from factloom.llm import textkernel as tk
from factloom.plans.scratch import Scratch

FACTORS = "doc_id long, d1 long, word_start int, word_end int, ref_doc long, ref_d1 long, ref_start int"


def earlier_neighbour(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted order the nearest row before it of lesser place (or -1), and the least of shared between them.

    shared[i] belongs to rows i - 1 and i. All rows look on at once, from the row that their candidate found so far.
    """
    at, least = np.arange(len(place)) - 1, shared.astype(np.int64).copy()
    live = np.flatnonzero(at >= 0)
    live = live[place[at[live]] > place[live]]
    while len(live):
        by = at[live]
        least[live] = np.minimum(least[live], np.where(at[by] >= 0, least[by], 0))
        at[live] = at[by]
        live = live[at[live] >= 0]
        live = live[place[at[live]] > place[live]]
    least[at < 0] = 0
    return at, least


def longest_matches(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, by place, the length of its longest match at an earlier place and that place (-1: none)."""
    n = len(order)
    before, x = earlier_neighbour(order, shared)
    back, y = earlier_neighbour(order[::-1], np.r_[0, shared[:0:-1]] if n else shared)
    after, y = np.where(back[::-1] >= 0, n - 1 - back[::-1], -1), y[::-1]
    one, two = np.where(before >= 0, order[before], n), np.where(after >= 0, order[after], n)
    left = (x > y) | ((x == y) & (one <= two))
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[order] = np.where(left, x, y)
    source[order] = np.where(left, one, two)
    source[length == 0] = -1
    return length, source


def greedy(first: np.ndarray, n: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the greedy parse: for entries of n windows from ``first`` on, the window and number of windows of each.

    windows: how many windows the longest match from each window on holds, 0 for none.
    """
    total = len(windows)
    upcoming = np.where(windows > 0, np.arange(total), total)
    upcoming = np.minimum.accumulate(upcoming[::-1])[::-1]
    upcoming = np.r_[upcoming, total]
    now, end, at = first.astype(np.int64).copy(), first + n, []
    live = np.arange(len(first))
    while len(live):
        now[live] = upcoming[now[live]]
        live = live[now[live] < end[live]]
        at.append(now[live].copy())
        now[live] += windows[now[live]]
        live = live[now[live] < end[live]]
    at = np.sort(np.concatenate([np.zeros(0, np.int64), *at]))
    return at, windows[at]


def _search(window: int):
    def one(b: repeats.Bucket) -> Iterator[pa.RecordBatch]:
        length, source = longest_matches(*repeats.multikey_quicksort(b, b.end - b.begin))
        windows = np.maximum(length - window + 1, 0)
        at, n = greedy(b.first, np.bincount(b.entry, minlength=len(b.first)), windows)
        yield from repeats.made(b, window, at, n, source[at], windows > 0)

    return one


def _parse(t: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    d, d1, p, n, rd, r1, rp = (t[c].to_numpy() for c in ("doc_id", "d1", "pos", "n", "ref_doc", "ref_d1", "ref_pos"))
    last = p + n - 1
    other = np.r_[True, (d[1:] != d[:-1]) | (d1[1:] != d1[:-1])]
    new = np.flatnonzero(other | np.r_[True, (p[1:] != last[:-1] + 1) | (rd[1:] != rd[:-1]) | (r1[1:] != r1[:-1]) | (rp[1:] - p[1:] != rp[:-1] - p[:-1])])
    end = (last[np.r_[new[1:], len(d)] - 1] + window).astype(np.int64)
    begin = p[new].astype(np.int64)
    text = np.cumsum(other)[new] - 1
    reach = np.maximum.accumulate(end + text * (1 << 34)) - text * (1 << 34)  # how far the factors so far reach in their text
    shift = np.r_[0, np.where(text[1:] == text[:-1], np.maximum(0, reach[:-1] - begin[1:]), 0)]
    start = begin + shift
    ok = start < end
    at = new[ok]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[at], d1[at], start[ok].astype(np.int32), end[ok].astype(np.int32), rd[at], r1[at], (rp[new] + shift)[ok].astype(np.int32))], names=[c.split()[0] for c in FACTORS.split(", ")])


def _cover(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    d, d1, start, end = covered(*(t[c].to_numpy() for c in ("doc_id", "d1", "word_start", "word_end")))
    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(d1), pa.array(start), pa.array(end)], names=["doc_id", "d1", "word_start", "word_end"])


def covered(doc: np.ndarray, d1: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that the factors of a parse cover, which stand in order: factors that touch are one."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (start[1:] > end[:-1])])
    return doc[new], d1[new], start[new], end[np.r_[new[1:], len(doc)] - 1]


def text_factors(docs: DataFrame, s: Scratch, *, window: int = repeats.WINDOW, gram: int = repeats.GRAM, bucket: int = repeats.BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """copies, and the factors of every text that isn't one, in order of the text within their partition."""
    copies, found = repeats.in_buckets(docs, s, _search(window), window=window, gram=gram, bucket=bucket)
    placed = repeats.across(found).repartition("doc_id").sortWithinPartitions("doc_id", "d1", "pos")
    return copies, placed.mapInArrow(tk.by_runs(lambda t: _parse(t, window), "doc_id"), FACTORS)


def factors(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, word_start, word_end, ref_doc, ref_start): the parse of every text that isn't a copy, without its literals."""
    with Scratch(docs.sparkSession) as s:
        return s.keep(text_factors(docs, s, **parameters)[1].select("doc_id", "word_start", "word_end", "ref_doc", "ref_start"))


def duplicate_spans(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, word_start, word_end): what the factors cover."""
    with Scratch(docs.sparkSession) as s:
        copies, parsed = text_factors(docs, s, **parameters)
        return s.keep(parsed.mapInArrow(tk.by_runs(_cover, "doc_id"), repeats.SPANS)).unionByName(copies).select("doc_id", "word_start", "word_end")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
