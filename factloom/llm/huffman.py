"""Token ids as canonical, length-limited Huffman codes.

Texts are tokenised once and written; the counts of all ids over all texts give code lengths of at most
BITS bits (package-merge, optimal under the limit), and lengths alone give the canonical codes. A text's
ids become one bit stream, most significant bit first, with the bit offset of every BLOCK-th id, so
any block is decoded without those before it. Decoding looks up as many bits as the longest code has at once in a table and
steps all blocks together. What the driver holds is one count and one length for each id.

The result is self-contained: one row without an id holds the code book (a byte of code length for each
id); the others hold a text each.

Defined cases: rows without an id go; a null or empty text has no ids and an empty stream; a lone
id gets a code of one bit; repeated rows are encoded each; ties between counts go by id; without any
text there is a code book without codes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.llm import tokens
from factloom.plans.scratch import Scratch

BITS, BLOCK = 20, 1024
SCHEMA = "doc_id long, n_tokens long, n_bits long, payload binary, checkpoints array<long>"
_U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = BITS) -> np.ndarray:
    """Optimal code length of each id, at most limit; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    kinds, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        kinds.append(by < len(weight))
        merged = both[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, length = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_item in reversed(kinds):
        items = int(is_item[:take].sum())
        length[:items] += 1
        take = 2 * (take - items)
    out[order] = length
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    out = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        out[i] = code
        code += 1
    return out


def table(lengths: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every pattern of the next ``bits`` bits."""
    symbol, size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    n = 1 << (bits - lengths[used].astype(np.int64))
    total = int(n.sum())
    symbol[:total], size[:total] = np.repeat(used, n), np.repeat(lengths[used], n)
    return symbol, size


def write_bits(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each from a byte boundary on; where each begins; its bits; the bit at which each id begins in its text."""
    n = lengths[ids].astype(np.int64)
    end = np.r_[0, np.cumsum(n)]
    bits = end[first[1:]] - end[first[:-1]]
    at = np.r_[0, np.cumsum(-(-bits // 8))]
    text = np.repeat(np.arange(len(bits)), np.diff(first))
    inside = end[:-1] - end[first[:-1]][text]
    pos = inside + 8 * at[:-1][text]
    words = np.zeros(at[-1] // 8 + 2, np.uint64)
    w, room = pos >> 6, 64 - (pos & 63) - n
    c = code[ids]
    high = np.where(room >= 0, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
    if len(w):
        runs = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        words[w[runs]] = np.bitwise_or.reduceat(high, runs)
        over = np.flatnonzero(room < 0)
        words[w[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: at[-1]], at, bits, inside


def read_bits(payload: np.ndarray, start: np.ndarray, count: np.ndarray, lookup: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Ids of blocks that begin at these bits; all blocks advance together."""
    symbol, size = lookup
    raw = np.r_[payload, np.zeros(8, np.uint8)].astype(np.uint64)
    off = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    pos, live = start.astype(np.int64).copy(), np.flatnonzero(count > 0)
    for k in range(int(count.max()) if len(count) else 0):
        live = live[count[live] > k]
        b = pos[live] >> 3
        window = raw[b] << _U(24) | raw[b + 1] << _U(16) | raw[b + 2] << _U(8) | raw[b + 3]
        key = (window >> (32 - bits - (pos[live] & 7)).astype(np.uint64)).astype(np.int64) & ((1 << bits) - 1)
        out[off[live] + k] = symbol[key]
        pos[live] += size[key]
    return out


def decode(payload: bytes, n_tokens: int, checkpoints: list[int], lengths: np.ndarray, block: int = BLOCK, only: int | None = None) -> np.ndarray:
    """Ids of one row, or of its block number ``only``."""
    count = np.minimum(block, n_tokens - block * np.arange(len(checkpoints)))
    pick = slice(None) if only is None else slice(only, only + 1)
    bits = max(1, int(lengths.max(initial=0)))  # the longest code that the book has
    return read_bits(np.frombuffer(payload, np.uint8), np.array(checkpoints, np.int64)[pick], count[pick], table(lengths, bits), bits)


def _ids(path: str):
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = tokens.encode(b.column("text").to_pylist(), path)
        raw = ids.astype(np.uint16) if len(tokens.encoding(path)[1]) <= 1 << 16 else ids
        off = (first * raw.itemsize).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(off), pa.py_buffer(raw)])], names=["doc_id", "ids"])

    return tk.sliced(one)


def _flat(column: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    a = column.cast(pa.large_binary())
    step = 4 if wide else 2
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint32 if wide else np.uint16).astype(np.int64), (off - off[0]) // step


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for x in tk.slices(b, "ids"):
                total += np.bincount(_flat(x.column("ids"), n > 1 << 16)[0], minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    return run


def _write(lengths: np.ndarray, code: np.ndarray, block: int):
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = _flat(b.column("ids"), len(lengths) > 1 << 16)
        payload, at, bits, inside = write_bits(ids, first, lengths, code)
        n = np.diff(first)
        marks = -(-n // block)
        marked = inside[np.repeat(first[:-1], marks) + block * tk.ranges(np.zeros(len(n), np.int64), marks)] if len(ids) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n), pa.array(bits), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(payload))]), tk.list_array(pa.array(marked), np.r_[0, np.cumsum(marks)])],
            names=["doc_id", "n_tokens", "n_bits", "payload", "checkpoints"],
        )

    return tk.sliced(one, "ids")


def encode(docs: DataFrame, *, vocabulary: str = tokens.VOCABULARY, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Rows of SCHEMA: the code book (doc_id null, n_tokens the size of the vocabulary) and one row for each text."""
    if not 1 <= bits <= 24 or block < 1:
        raise ValueError("bits must be in 1..24, block positive")
    spark = docs.sparkSession
    n = len(tokens.encoding(vocabulary)[1])
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = Scratch(spark)
    ids = s.keep(texts.mapInArrow(_ids(vocabulary), "doc_id long, ids binary"))
    counts = np.zeros(n, np.int64)
    for r in ids.select("ids").mapInArrow(_count(n), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, bits)
    book = spark.createDataFrame([(None, n, 8 * n, lengths.tobytes(), [])], SCHEMA)
    return book.unionByName(ids.mapInArrow(_write(lengths, codes(lengths), block), SCHEMA))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
