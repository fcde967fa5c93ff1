"""The corpus pipeline: language ID, near-duplicate removal, repeat removal, decontamination, packing.

Every stage but the last returns the columns that it was given, whatever they are called besides doc_id, text and lang,
and works on all rows that the one before it kept. Defined cases, stage by stage:

* language ID: rows without an id are judged by their text as others are; null and empty texts go; without any labelled
  text all rows go; a very long text is judged whole.
* near duplicates: of a class the row of the least (doc_id, hash of the text) stays, with its exact repetitions; rows
  without an id, and texts without words, stay; several texts of one id are told apart.
* repeats: the first place in order of (doc_id, digest, word) stays; texts without a word left go; rows without an id
  or text, and texts shorter than a window, stay as they are; the other columns stay, n_chars follows the text.
* decontamination: a text that leaks an item of LEAST characters or more goes; rows without an id or text stay; an empty
  or absent benchmark text drops nothing.
* packing: rows without an id or tokens are in no window; see ``packing``.

Empty tables go through every stage and give an empty table. A stage lowers the session's bound of an Arrow batch, and leaves it so,
as what it returns is run later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, language_id, ngram_join, packing, suffix_array, textkernel
from factloom.plans.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        textkernel.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no known language go."""
    return language_id.keep_identified(docs)


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every family of similar texts the one with the least id stays."""
    return ngram_join.keep_one(docs)


@_in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut; texts of which nothing is left go."""
    return suffix_array.remove_repeats(docs)


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as windows of related texts."""
    return packing.pack_related(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language models, tokens and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared folder and read again."""
    with Scratch(spark) as s:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES[:-1]:
            docs = s.save(stage(spark, docs, sf_dir))
        return s.keep(STAGES[-1][1](spark, docs, sf_dir))
