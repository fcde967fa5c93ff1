"""Token counts by section from one encoding of the whole text.

A text is encoded once, as it will be trained on; cutting it first would make other tokens at the cuts.
Token i covers the bytes between the ends of tokens i - 1 and i, hence a span of characters. These
spans are joined to the sections' spans by binary search, and a token that crosses a boundary goes by
an explicit rule:

* ``start``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes, the first of equals;
* ``share``: to each section the part of its bytes there; sums are those of the text.

Sections are the text's lines, each with its line break, or the spans of an array column ``sections`` of
struct<name, char_start, char_end>; one that begins before the end of those listed before it is cut to begin
there, so that no token counts twice. Tokens outside of all of them are counted under a null name, section -1.

Defined cases: rows without an id go; a null or empty text has no tokens and no line, and sections of it
count 0; spans beyond the text are cut to it, null and reversed spans are empty; repeated rows give repeated rows;
a very long text is encoded whole; no rows, no counts.
A character that several tokens share belongs to the one with its first byte. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.llm import tokens

RULES = ("start", "majority", "share")
RULE = "majority"
SCHEMA = "doc_id long, section int, name string, char_start int, char_end int, n_tokens double"


def attribute(first: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens for each of the len(cuts) - 1 stretches between cuts; token i covers bytes first[i] to end[i]."""
    n = len(cuts) - 1
    a = np.searchsorted(cuts, first, "right") - 1
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float)
    b = np.searchsorted(cuts, end, "left") - 1
    whole = a == b
    out = np.bincount(a[whole], minlength=n).astype(float)
    for i in np.flatnonzero(~whole):
        part = np.minimum(cuts[a[i] + 1 : b[i] + 2], end[i]) - np.maximum(cuts[a[i] : b[i] + 1], first[i])
        if rule == "majority":
            out[a[i] + int(part.argmax())] += 1
        else:
            out[a[i] : b[i] + 1] += part / (end[i] - first[i])
    return out


def _count(path: str, rule: str, given: bool):
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, at = tokens.encode(b.column("text").to_pylist(), path)
        end = np.cumsum(tokens.encoding(path)[1][ids].astype(np.int64))
        first = np.r_[0, end[:-1]] if len(end) else end
        raw, off = tk.bytes_of(b.column("text"))
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        keys = b.column("doc_id").to_numpy(zero_copy_only=False)
        if not given:  # all lines of all texts at once
            breaks = np.flatnonzero(raw == 10) + 1
            cuts = np.unique(np.r_[off, breaks])
            n = attribute(first, end, cuts, rule)
            text = np.searchsorted(off, cuts[:-1], "right") - 1
            begin = np.searchsorted(text, np.arange(len(keys)))
            base = chars[off[text]]
            columns = [keys[text], (np.arange(len(text)) - begin[text]).astype(np.int32), pa.nulls(len(text), pa.string()), (chars[cuts[:-1]] - base).astype(np.int32), (chars[cuts[1:]] - base).astype(np.int32), n]
        else:
            rows = []
            for i, spans in enumerate(b.column("sections").to_pylist()):
                lo, hi = off[i], off[i + 1]
                where = np.r_[np.flatnonzero((raw[lo:hi] & 0xC0) != 0x80), hi - lo]
                size, last, edges, owner = len(where) - 1, 0, [0], []
                held = []
                for k, s in enumerate(spans or []):
                    x, y = ((s["char_start"], s["char_end"]) if s and s["char_start"] is not None and s["char_end"] is not None else (last, last))
                    x, y = min(max(x, 0), size), min(max(y, 0), size)
                    x = max(x, last)
                    y = max(x, y)
                    held.append((k, s["name"] if s else None, x, y))
                    if y > x:
                        if x > last:
                            edges.append(where[x])
                            owner.append(-1)
                        edges.append(where[y])
                        owner.append(k)
                    last = y
                if last < size:
                    edges.append(where[size])
                    owner.append(-1)
                t = slice(at[i], at[i + 1])
                n = attribute(first[t] - lo, end[t] - lo, np.array(edges), rule) if owner else []
                total: dict[int, float] = {}
                for o, v in zip(owner, n):
                    total[o] = total.get(o, 0.0) + v
                rows += [(keys[i], k, name, x, y, total.get(k, 0.0)) for k, name, x, y in held]
                if total.get(-1):
                    rows.append((keys[i], -1, None, None, None, total[-1]))
            if not rows:
                return None
            columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "section", "name", "char_start", "char_end", "n_tokens"])

    return tk.sliced(one)


def section_tokens(docs: DataFrame, *, rule: str = RULE, vocabulary: str = tokens.VOCABULARY, sections: str | None = None) -> DataFrame:
    """Rows of SCHEMA: the tokens of each section; one pass and no shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<name:string,char_start:int,char_end:int>>").alias("sections"))
    return docs.where("doc_id is not null").select(*columns).mapInArrow(_count(vocabulary, rule, sections is not None), SCHEMA)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
