"""What the two searches for repeated passages share: which windows can repeat, and spans of words.

A passage repeats if ``window`` consecutive words of it stand elsewhere too, before or after, in the
same text or another. The first occurrence in order of (doc_id, digest of the text, word) is the one to
keep; each window that isn't the first of its kind is a duplicate, and a text's duplicate windows, joined
where they overlap or touch, are its duplicate spans, counted in words from 0, end excluded.

Two exact reductions come before either search. Texts of the same words are compared once: all but
the least id are one span from end to end. And a window can only repeat if its anchor (see
``textkernel.anchors``) does, so only windows of repeated anchors are searched. They travel as
*entries*: an occurrence of an anchor with the words of all windows that have it as theirs, so a word is
sent about as often as three times, not once for each of its windows.

Entries are range-partitioned by the leading words of their anchor, then the anchor, then the place of
the occurrence, at splitters that Spark samples; in that order a partition is read as buckets of so many
entries. Equal windows have equal anchors, hence lie in neighbouring buckets: in one, unless a hot anchor goes
on in the next. So a bucket is bounded however often a passage stands in the corpus. A bucket finds, in whichever way, each of its windows that an
earlier one of the bucket equals. Its first and last anchor may go on beyond its ends; of these it also
hands on the first occurrence of every different window, once, and ``across`` compares those of all buckets.

Defined cases: rows without id or text, and texts of fewer than ``window`` words, have no span; rows
of the same id and words are one; several texts of one id are texts of their own, told apart by the digest
of their words; very long texts are searched whole; no rows, no spans. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.plans.scratch import ROW_BYTES, Scratch, small_side

WINDOW, GRAM = 50, 8
#: Entries of a bucket, and about how many make a partition of buckets; an entry has at most 2 * window words.
BUCKET_ENTRIES, PARTITION_ENTRIES = 16_000, 500_000
ENTRIES = "lead long, block long, doc_id long, d1 long, lo int, words binary"
MATCHES = "doc_id long, d1 long, pos int, n int, ref_doc long, ref_d1 long, ref_pos int, m1 long, m2 long"
SPANS = "doc_id long, d1 long, word_start int, word_end int"
_NAMES = [c.split()[0] for c in MATCHES.split(", ")]
_U = np.uint64


def digests(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's sequence of words."""
    lo, hi = w.first[:-1], w.first[1:]
    return w.span(lo, hi), tk.Words(w.n_texts, tk.mix(w.hash ^ _U(0xA5A5A5A55A5A5A5A)), w.start, w.end, w.first).span(lo, hi)


def _survey(window: int, gram: int):
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = tk.words(b.column("text"))
        n = np.diff(w.first)
        has = np.flatnonzero(n >= window)
        if not len(has):
            return None
        x, y = digests(w)
        a = tk.anchors(w, window, gram)
        off = pa.array(np.searchsorted(a.text, np.r_[has, w.n_texts]), pa.int32())
        base = w.first[a.text]
        return pa.RecordBatch.from_arrays(
            [
                b.column("doc_id").take(pa.array(has)), pa.array(x[has].view(np.int64)), pa.array(y[has].view(np.int64)), pa.array(n[has].astype(np.int32)),
                *(pa.ListArray.from_arrays(off, pa.array(v)) for v in (a.hash.view(np.int64), (a.lo - base).astype(np.int32), (a.hi - base).astype(np.int32))),
            ],
            names=["doc_id", "d1", "d2", "n_words", "hash", "lo", "hi"],
        )

    return tk.sliced(one)


def _ranges(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Windows of repeated anchors that follow one another, as ranges, in lists by text."""
    t = t.combine_chunks()
    doc, d1, lo, hi = (t[c].to_numpy() for c in ("doc_id", "d1", "lo", "hi"))
    other = np.r_[True, (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1])]
    new = np.flatnonzero(other | np.r_[True, lo[1:] > hi[:-1] + 1])
    last = np.r_[new[1:], len(doc)] - 1
    text = np.flatnonzero(other[new])
    off = np.r_[text, len(new)]
    yield pa.RecordBatch.from_arrays([pa.array(doc[new][text]), pa.array(d1[new][text]), tk.list_array(pa.array(lo[new]), off), tk.list_array(pa.array(hi[last]), off)], names=["doc_id", "d1", "lo", "hi"])


def survey(docs: DataFrame, s: Scratch, *, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """texts(doc_id, text), copies(doc_id, d1, word_start, word_end), hot(doc_id, d1, lo, hi arrays) and the size of hot in bytes."""
    if not 0 < gram <= window:
        raise ValueError("gram must be in 1..window")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    made = s.save(texts.mapInArrow(_survey(window, gram), "doc_id long, d1 long, d2 long, n_words int, hash array<long>, lo array<int>, hi array<int>"))
    one = made.select("doc_id", "d1", "d2", "n_words").distinct()
    first = one.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    ranked = s.keep(one.join(first, ["d1", "d2"]))
    copies = ranked.where("doc_id <> rep").select("doc_id", "d1", F.lit(0).alias("word_start"), F.col("n_words").alias("word_end"))
    reps = ranked.where("doc_id = rep").select("doc_id", "d1", "d2")
    rows = s.save(made.join(reps, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1"]).select("doc_id", "d1", F.explode(F.arrays_zip("hash", "lo", "hi")).alias("a")).select("doc_id", "d1", "a.*"))
    often = rows.join(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hash", "left_semi").select("doc_id", "d1", "lo", "hi")
    hot = s.keep(often.repartition("doc_id").sortWithinPartitions("doc_id", "d1", "lo").mapInArrow(tk.by_runs(_ranges, "doc_id"), "doc_id long, d1 long, lo array<int>, hi array<int>"))
    held = hot.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("lo")), F.lit(0)).alias("k")).first()
    return texts, copies, hot, 3 * ROW_BYTES * held["n"] + 8 * held["k"]


def hot_rows(b: pa.RecordBatch, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hot range of the batch: its text, first and last window (in the slice's words); texts under another digest are left out."""
    d1 = digests(w)[0].view(np.int64)
    lo, hi = b.column("lo"), b.column("hi")
    n = np.diff(lo.offsets.to_numpy())
    lo, hi = lo.flatten().to_numpy(), hi.flatten().to_numpy()
    text = np.repeat(np.arange(b.num_rows), n)
    ok = (d1 == b.column("d1").to_numpy())[text]
    text = text[ok]
    return text, lo[ok].astype(np.int64) + w.first[text], hi[ok].astype(np.int64) + w.first[text]


def _entries(window: int, gram: int):
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = tk.words(b.column("text"))
        _, first, last = hot_rows(b, w)
        if not len(first):
            return None
        a = tk.anchors(w, window, gram)
        at = np.searchsorted(first, a.lo, "right") - 1
        ok = (at >= 0) & (a.lo <= last[at])
        text, pos, lo, hi, h = a.text[ok], a.pos[ok], a.lo[ok], a.hi[ok], a.hash[ok]
        lead = np.zeros(len(pos), np.uint64)
        for k in range(min(4, gram)):
            lead |= (w.hash[pos + k] >> _U(48)) << _U(48 - 16 * k)
        n = hi - lo + window
        tokens = (w.hash[tk.ranges(lo, n)] >> _U(32)).astype(np.uint32)
        off = np.r_[0, np.cumsum(n * 4)].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(lead.view(np.int64)), pa.array(h.view(np.int64)), b.column("doc_id").take(pa.array(text)), b.column("d1").take(pa.array(text)), pa.array((lo - w.first[text]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(off), pa.py_buffer(tokens)])],
            names=["lead", "block", "doc_id", "d1", "lo", "words"],
        )

    return tk.sliced(one)


@dataclass
class Bucket:
    """Entries of one bucket in order of (doc_id, d1, lo), and their windows, in that order too."""

    doc: np.ndarray
    d1: np.ndarray
    lo: np.ndarray
    open: np.ndarray  # entries whose anchor may go on in another bucket
    raw: np.ndarray  # 32 bits of each word; PAD zeros after each entry
    tokens: np.ndarray  # ranks of the words in this bucket, from 1; 0 is the end
    bits: int  # of a rank
    begin: np.ndarray  # of each window, in tokens
    end: np.ndarray  # of each window's entry
    entry: np.ndarray
    first: np.ndarray  # each entry's first window

    @property
    def pos(self) -> np.ndarray:
        return (self.lo[self.entry] + np.arange(len(self.entry)) - self.first[self.entry]).astype(np.int32)


PAD = 4


def read_bucket(t: pa.Table, window: int) -> Bucket:
    t = t.combine_chunks()
    lead, block, doc, d1, lo = (t[c].to_numpy() for c in ("lead", "block", "doc_id", "d1", "lo"))
    order = np.lexsort((lo, d1, doc))
    ends = np.lexsort((block, lead))[[0, -1]]
    edge = np.zeros(len(doc), bool)
    for e in ends:
        edge |= (lead == lead[e]) & (block == block[e])
    held = t["words"].combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8) // 4
    raw = np.frombuffer(held.buffers()[2], np.uint32)
    size = np.diff(off)[order]
    raw = raw[tk.ranges(off[:-1][order], size)]
    rank = np.unique(raw, return_inverse=True)[1] + 1
    at = np.cumsum(size + PAD) - (size + PAD)
    to = tk.ranges(at, size)
    tokens, padded = np.zeros(int((size + PAD).sum()), np.uint64), np.zeros(int((size + PAD).sum()), np.uint32)
    tokens[to], padded[to] = rank, raw
    n = size - window + 1
    entry = np.repeat(np.arange(len(n)), n)
    return Bucket(doc[order], d1[order], lo[order], edge[order], padded, tokens, int(rank.max()).bit_length(), tk.ranges(at, n), (at + size)[entry], entry, np.cumsum(n) - n)


def multikey_quicksort(b: Bucket, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at b.begin, of so many words each, and how many words each shares with the one before it.

    A key is as many words as 64 bits hold. Every round looks at the next key of those suffixes only that
    equal others in all before, and only sorts within groups in which it differs. Equal suffixes stay in
    order of their places.
    """
    n, per = len(b.begin), min(PAD, 63 // b.bits)
    bits = _U(b.bits)
    packed = np.zeros(len(b.tokens), np.uint64)
    for k in range(per):
        packed[: len(b.tokens) - k] |= b.tokens[k:] << bits * _U(per - 1 - k)
    length = np.broadcast_to(np.asarray(length, np.int64), n)
    order, split = np.arange(n), np.full(n, -1, np.int32)
    group = np.zeros(n, np.int64)
    live = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    step = 0
    while len(live):
        rows, of = order[live], group[live]
        key = packed[b.begin[rows] + step * per]
        over = step * per + per - length[rows]
        if (over > 0).any():
            key = key >> (bits * np.maximum(over, 0).astype(np.uint64)) << (bits * np.maximum(over, 0).astype(np.uint64))
        same = of[1:] == of[:-1]
        uneven = np.zeros(n, bool)
        uneven[of[1:][same & (key[1:] != key[:-1])]] = True
        if uneven.any():
            pick = np.flatnonzero(uneven[of])
            by = np.lexsort((key[pick], of[pick]))
            order[live[pick]] = rows[pick[by]]
            key[pick] = key[pick[by]]
            cut = np.flatnonzero(same & (key[1:] != key[:-1])) + 1
            split[live[cut]] = step
        begins = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])]
        first = np.flatnonzero(begins)
        size = np.diff(np.r_[first, len(live)])
        group[live] = live[np.repeat(first, size)]
        step += 1
        live = live[(np.repeat(size, size) > 1) & (length[order[live]] >= step * per)]
    shared = np.minimum(length[order], np.r_[0, length[order[:-1]]])
    cut = np.flatnonzero(split >= 0)
    x, y, base = b.begin[order[cut]], b.begin[order[cut - 1]], split[cut].astype(np.int64) * per
    alike, run = np.ones(len(cut), bool), np.zeros(len(cut), np.int64)
    for k in range(per):
        alike &= b.tokens[x + base + k] == b.tokens[y + base + k]
        run += alike
    shared[cut] = np.minimum(shared[cut], base + run)
    if n:
        shared[0] = 0
    return order, shared


def runs(b: Bucket, at: np.ndarray, *differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the windows ``at`` (ascending) that follow one another in an entry; differ: further places to part them."""
    if not len(at):
        return at, at
    cut = (at[1:] != at[:-1] + 1) | (b.entry[at[1:]] != b.entry[at[:-1]])
    for d in differ:
        cut |= d
    first = np.flatnonzero(np.r_[True, cut])
    return first, np.diff(np.r_[first, len(at)])


def made(b: Bucket, window: int, at: np.ndarray, n: np.ndarray, source: np.ndarray | None, duplicate: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of MATCHES: n windows from ``at`` on each, and the windows of open anchors that no earlier one equals, for ``across``."""
    pos, doc, d1 = b.pos, b.doc[b.entry], b.d1[b.entry]
    none = lambda k, kind: pa.nulls(k, kind)
    for x in range(0, len(at), 1 << 17):
        w = at[x : x + (1 << 17)]
        ref = [none(len(w), pa.int64()), none(len(w), pa.int64()), none(len(w), pa.int32())]
        if source is not None:
            r = source[x : x + (1 << 17)]
            ref = [pa.array(doc[r]), pa.array(d1[r]), pa.array(pos[r])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(d1[w]), pa.array(pos[w]), pa.array(n[x : x + (1 << 17)].astype(np.int32)), *ref, none(len(w), pa.int64()), none(len(w), pa.int64())], names=_NAMES)
    w = np.flatnonzero(b.open[b.entry] & ~duplicate)
    if len(w):
        begin, marks = b.begin[w], []
        for salt in (_U(1), _U(0x9E3779B97F4A7C15)):
            hashed = tk.Words(1, tk.mix(b.raw.astype(np.uint64) + salt), begin, begin, begin)
            marks.append(pa.array(hashed.span(begin, begin + window).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(d1[w]), pa.array(pos[w]), pa.array(np.ones(len(w), np.int32)), none(len(w), pa.int64()), none(len(w), pa.int64()), none(len(w), pa.int32()), *marks], names=_NAMES)


def in_buckets(docs: DataFrame, s: Scratch, search: Callable[[Bucket], Iterator[pa.RecordBatch]], *, window: int, gram: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """copies, and what ``search`` finds in every bucket, as rows of MATCHES that are written."""
    texts, copies, hot, size = survey(docs, s, window=window, gram=gram)
    entries = s.save(texts.join(small_side(hot, size), "doc_id").mapInArrow(_entries(window, gram), ENTRIES))
    keys = ["lead", "block", "doc_id", "d1", "lo"]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = entries.repartitionByRange(max(least, -(-entries.count() // PARTITION_ENTRIES)), *keys).sortWithinPartitions(*keys)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in batches:
            while x.num_rows:
                held.append(x.slice(0, bucket - n))
                n += held[-1].num_rows
                x = x.slice(held[-1].num_rows)
                if n == bucket:
                    yield from search(read_bucket(pa.Table.from_batches(held), window))
                    held, n = [], 0
        if held:
            yield from search(read_bucket(pa.Table.from_batches(held), window))
        held = []
        tk.give_back()

    return copies, s.save(placed.mapInArrow(one, MATCHES))


def across(found: DataFrame) -> DataFrame:
    """(doc_id, d1, pos, n, ref_doc, ref_d1, ref_pos) of all duplicates: those of the buckets and those between buckets."""
    place = F.struct("doc_id", "d1", "pos")
    ends = found.where("m1 is not null").select("doc_id", "d1", "pos", "m1", "m2")
    firsts = ends.groupBy("m1", "m2").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
    more = ends.join(firsts, ["m1", "m2"]).where(place != F.col("f")).select("doc_id", "d1", "pos", F.lit(1).alias("n"), F.col("f.doc_id").alias("ref_doc"), F.col("f.d1").alias("ref_d1"), F.col("f.pos").alias("ref_pos"))
    return found.where("m1 is null").select("doc_id", "d1", "pos", "n", "ref_doc", "ref_d1", "ref_pos").unionByName(more)


def _merge(window: int):
    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        doc, d1, pos, n = (t[c].to_numpy() for c in ("doc_id", "d1", "pos", "n"))
        end = pos + n - 1 + window
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (pos[1:] > end[:-1])])
        last = np.r_[new[1:], len(doc)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(d1[new]), pa.array(pos[new].astype(np.int32)), pa.array(end[last].astype(np.int32))], names=["doc_id", "d1", "word_start", "word_end"])

    return tk.by_runs(one, "doc_id")


def spans(duplicates: DataFrame, window: int) -> DataFrame:
    """Spans of duplicate windows (doc_id, d1, pos, n), each of which stands in one row only."""
    return duplicates.select("doc_id", "d1", "pos", "n").repartition("doc_id").sortWithinPartitions("doc_id", "d1", "pos").mapInArrow(_merge(window), SPANS)


def _cut(spans: str):
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out, texts = [], b.column("text").cast(pa.string())
        raw, off = tk.bytes_of(texts)
        start, first = tk.word_starts(texts)
        d1 = digests(tk.words(texts))[0].view(np.int64).tolist()
        for i, cut in enumerate(b.column(spans).to_pylist()):
            text = raw[off[i] : off[i + 1]].tobytes()
            at, keep = 0, []
            for x in sorted((x for x in cut or [] if x["d1"] == d1[i]), key=lambda x: x["word_start"]):
                n = first[i + 1] - first[i]
                keep.append(text[at : start[first[i] + x["word_start"]] - off[i]])
                at = len(text) if x["word_end"] >= n else int(start[first[i] + x["word_end"]] - off[i])
            out.append(b"".join([*keep, text[at:]]).decode() if keep else None)
        k = b.schema.get_field_index("text")
        made = pa.array(out, pa.string())
        whole = pa.array([x is None for x in out])
        kept = pc.if_else(whole, texts, made)
        b = b.set_column(k, "text", kept)
        return b.filter(pc.or_(whole, pc.match_substring_regex(pc.fill_null(made, ""), "[0-9A-Za-z\\x{80}-\\x{10FFFF}]")))

    return one


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the spans (doc_id, d1, word_start, word_end) cut out of their texts, each up to the next word.

    Texts without a word left go. All columns stay; n_chars, if there is one, is that of the new text. Rows that no
    span names, by id and words, are as they were; other texts of an id that has spans are among them.
    """
    names = docs.columns
    key, cut = tk.fresh(docs, "_id"), tk.fresh(docs, "_spans")
    with Scratch(docs.sparkSession) as s:
        per = s.keep(found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("d1", "word_start", "word_end")).alias(cut)))
        held = per.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(cut)), F.lit(0)).alias("k")).first()
        hit = docs.join(small_side(per, 2 * ROW_BYTES * held["n"] + 2 * ROW_BYTES * held["k"]), docs["doc_id"] == F.col(key))
        rest = tk.drop_ids(docs, per.select(key), ROW_BYTES * held["n"])
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        made = hit.select(*[docs[c] for c in names], cut).mapInArrow(tk.sliced(_cut(cut)), kept + f", {cut} array<struct<d1:bigint,word_start:int,word_end:int>>").select(*[f"`{c}`" for c in names])
        if "n_chars" in names:
            made = made.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
        return rest.unionByName(made)


SPANS_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{tk.WORD_SQL}') AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(0, len(ws) - {WINDOW} + 1)) AS pos FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + {WINDOW}], ' ')) AS key FROM p),
d AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM k) WHERE r > 1),
b AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {WINDOW} THEN 0 ELSE 1 END AS begins FROM d),
g AS (SELECT doc_id, pos, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM b)
SELECT doc_id, CAST(min(pos) AS INT) AS word_start, CAST(max(pos) + {WINDOW} AS INT) AS word_end FROM g GROUP BY doc_id, span
"""
