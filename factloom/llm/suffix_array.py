"""Repeated passages by a distributed suffix array.

The suffixes are those that begin at a word from which ``window`` words may stand elsewhere too; they come as
entries of words (see ``repeats``), so that the words of a suffix are at hand wherever it goes. Sampled splitters
range-partition them by leading tokens: the first words of the suffix's anchor, then what tells anchors and
occurrences apart. The buckets, one after another, are the suffix array, in order of the anchors.

Each bucket sorts its suffixes by multikey quicksort: by as many words as a key holds, and only among suffixes
that equal each other so far by the next words, down to ``window`` words. Neighbours are compared by their words;
one that shares ``window`` words with the suffix before it, which stands earlier in the corpus, is a duplicate.

Across a boundary a suffix may equal one of the bucket before. That needs the same anchor, so each bucket
hands on, of its first and last anchor, one suffix for every different run, and these are compared once more.

Words are compared by 32 bits of their hashes, between suffixes whose anchors agree in 64 bits; across buckets
runs are compared by 128 bits. Defined cases are those of ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import repeats
from factloom.plans.scratch import Scratch


def _search(window: int):
    def one(b: repeats.Bucket) -> Iterator[pa.RecordBatch]:
        order, shared = repeats.multikey_quicksort(b, window)
        duplicate = np.zeros(len(order), bool)
        duplicate[order] = shared >= window
        at = np.flatnonzero(duplicate)
        first, n = repeats.runs(b, at)
        yield from repeats.made(b, window, at[first], n, None, duplicate)

    return one


def text_spans(docs: DataFrame, s: Scratch, *, window: int = repeats.WINDOW, gram: int = repeats.GRAM, bucket: int = repeats.BUCKET_ENTRIES) -> DataFrame:
    """(doc_id, d1, word_start, word_end): every text's words that repeat an earlier passage of ``window`` words."""
    copies, found = repeats.in_buckets(docs, s, _search(window), window=window, gram=gram, bucket=bucket)
    return s.keep(repeats.spans(repeats.across(found), window)).unionByName(copies)


def duplicate_spans(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, word_start, word_end) of all duplicate spans."""
    with Scratch(docs.sparkSession) as s:
        return text_spans(docs, s, **parameters).select("doc_id", "word_start", "word_end")


def remove_repeats(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs with every repeated passage cut but for its first occurrence; see ``repeats.without``."""
    with Scratch(docs.sparkSession) as s:
        return repeats.without(docs, text_spans(docs, s, **parameters))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
