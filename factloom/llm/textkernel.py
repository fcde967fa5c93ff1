"""Words, word n-grams and sampled anchors of whole Arrow batches of texts, in numpy.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII characters in the
lower-cased text; DuckDB writes it ``regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')``.
Null and empty texts have no words. Work goes in slices of about SLICE bytes, so memory does not
follow the Arrow batch; a longer text is one slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of a slice; bytes of a batch that Spark hands to a worker, which the executor and the worker both hold.
SLICE, ROWS, BATCH = 1 << 20, 1024, 4 << 20
WORD_SQL = r"[0-9a-z\x{80}-\x{10FFFF}]+"

_U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[tuple[int, bool], np.ndarray] = {}


def give_back() -> None:
    """Returns the memory that a task has freed to the machine; Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of a batch to BATCH bytes, where it is higher; Spark's own lets a whole partition of texts be one batch. No result depends on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if size <= 0 or size > BATCH:
        spark.conf.set(name, str(BATCH))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(base: int, inverse: bool, n: int) -> np.ndarray:
    held = _powers.get((base, inverse))
    if held is None or len(held) < n:
        x = np.full(max(n, SLICE + 1024), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        x[0] = 1
        held = np.multiply.accumulate(x)
        if n <= 2 * SLICE:  # those of a very long text aren't kept
            _powers[base, inverse] = held
    return held[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _pow(base, False, len(values)), out=p[1:])
    return p


@dataclass
class Words:
    """Words of consecutive texts: hash, byte range in the slice, and where each text's words begin."""

    n_texts: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_texts + 1

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Fingerprint of the n words from each word on, across texts too; the last n - 1 are absent."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        p = _prefix(self.hash, _B2)
        return mix((p[n:] - p[:-n]) * _pow(_B2, True, len(p) - n))

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Fingerprint of words lo to hi (excluded)."""
        p = _prefix(self.hash, _B2)
        return mix((p[hi] - p[lo]) * _pow(_B2, True, len(p))[lo])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; null as empty."""
    a = texts if isinstance(texts, pa.Array) else texts.combine_chunks()
    a = a.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array) -> Words:
    raw, off = bytes_of(pc.utf8_lower(texts.fill_null("")))
    is_word = np.zeros(len(raw) + 2, bool)
    is_word[1:-1] = _IS_WORD[raw]
    starts_word = is_word[1:] & ~is_word[:-1]
    ends_word = is_word[:-1] & ~is_word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    if len(inner):  # a text's end ends its word
        cut = np.unique(inner[is_word[inner] & is_word[inner + 1]])
        starts_word[cut] = True
        ends_word[cut] = True
    start, end = np.flatnonzero(starts_word), np.flatnonzero(ends_word)
    p = _prefix(_BYTE[raw], _B1)
    h = mix((p[end] - p[start]) * _pow(_B1, True, len(p))[start])
    return Words(len(off) - 1, h, start, end, np.searchsorted(start, off).astype(np.int64))


def word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of the texts as they are, and where each text's words begin among them."""
    raw, off = bytes_of(texts)
    is_word = np.r_[False, _IS_WORD[raw] | ((raw >= 65) & (raw <= 90))]
    begins = is_word[1:] & ~is_word[:-1]
    inner = off[:-1][off[:-1] < len(raw)]
    begins[inner] = is_word[inner + 1]
    start = np.flatnonzero(begins)
    return start, np.searchsorted(start, off)


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``size`` bytes of text, at most ``rows`` of them."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(n) - n) // size
    for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), [*cuts[1:], len(n)]):
        for at in range(lo, hi, rows):
            yield batch.slice(at, min(rows, hi - at))


def sliced(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", **bounds: int) -> Callable:
    """f over slices, as a function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, text, **bounds):
                out = f(x)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return run


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then those from lo[1] on, and so forth."""
    if not len(n):
        return np.zeros(0, np.int64)
    at = np.cumsum(n) - n
    return np.repeat(lo - at, n) + np.arange(int(n.sum()))


@dataclass
class Anchors:
    """Each window of ``window`` words has one anchor: its gram of ``k`` words with the least hash, the first of equals.

    Whatever two equal windows stand in, their anchors lie at the same place in them; so equal windows
    have equal anchors, and a window whose anchor gram occurs once in a corpus occurs once itself.
    Anchor i belongs to the windows that begin at words lo[i] to hi[i], inclusive.
    """

    text: np.ndarray
    pos: np.ndarray
    hash: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def anchors(w: Words, window: int, k: int) -> Anchors:
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return Anchors(none, none, np.zeros(0, np.uint64), none, none)
    g = w.grams(k)
    span = window - k + 1
    low = _U((1 << 26) - 1)
    v = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    base, have = v, 1  # least of `have` consecutive ones
    while have * 2 <= span:
        base = np.minimum(base[:-have], base[have:])
        have *= 2
    if have < span:
        base = np.minimum(base[: len(base) - (span - have)], base[span - have :])
    begin = np.arange(len(base))
    t = w.text
    ok = t[begin] == t[begin + window - 1]
    begin, at = begin[ok], (base[ok] & low).astype(np.int64)
    if not len(begin):
        return Anchors(none, none, np.zeros(0, np.uint64), none, none)
    # the low 26 bits are the place modulo 2**26; a window is far shorter
    at = begin + ((at - begin) % (1 << 26))
    new = np.r_[True, (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)]
    i = np.flatnonzero(new)
    return Anchors(t[begin[i]], at[i], g[at[i]], begin[i], begin[np.r_[i[1:], len(begin)] - 1])


def by_runs(f: Callable[[pa.Table], Iterator[pa.RecordBatch]], key: str, rows: int = 100_000, size: int = 24 << 20) -> Callable:
    """f over tables of whole runs of ``key``, for partitions that are sorted by it; as a function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = nbytes = 0
        for b in batches:
            if not b.num_rows:
                continue
            if count > rows or nbytes > size:
                last = held[-1].column(key)[-1]
                differs = pc.not_equal(b.column(key), last)
                cut = pc.index(differs, True).as_py()
                if cut >= 0:
                    yield from f(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    held, count, nbytes = [], 0, 0
                    b = b.slice(cut)
            held.append(b)
            count += b.num_rows
            nbytes += b.nbytes
        if held:
            yield from f(pa.Table.from_batches(held))
        held = []
        give_back()

    return run


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns by which texts are handled; rows without an id cannot be named in a result and go."""
    return docs.select(*columns).where("doc_id is not null")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of df, in whatever case, is called so."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def drop_ids(docs: DataFrame, gone: DataFrame, size: int) -> DataFrame:
    """docs without the ids of gone's only column; rows without an id stay, as do all columns."""
    from factloom.plans.scratch import small_side

    key = fresh(docs, "_gone")
    return docs.join(small_side(gone.toDF(key), size), docs["doc_id"] == F.col(key), "left_anti")


def drop_texts(docs: DataFrame, gone: DataFrame, size: int) -> DataFrame:
    """docs without the texts that gone (doc_id, xxhash64 of the text) names; rows without an id or text stay, as do all columns."""
    from factloom.plans.scratch import small_side

    a, b = fresh(docs, "_gone"), fresh(docs, "_key")
    return docs.join(small_side(gone.toDF(a, b), size), (docs["doc_id"].cast("long") == F.col(a)) & (F.xxhash64(docs["text"].cast("string")) == F.col(b)), "left_anti")
