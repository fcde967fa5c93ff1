"""Queries of this subpackage and the DuckDB SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, huffman, language_id, line_rules, ngram_join, packing, relative_lz, repeats, sharding, suffix_array, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_huffman_ids": huffman.op2,
    "op3_language_id": language_id.op3,
    "op4_bfd_sharding": sharding.op4,
    "op5_section_tokens": token_counts.op5,
    "op6_related_packing": packing.op6,
    "op7_line_rules": line_rules.op7,
    "op8_suffix_array_dedup": suffix_array.op8,
    "op9_pigeonhole_decontamination": decontaminate.op9,
    "op10_relative_lz_dedup": relative_lz.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op7_line_rules": line_rules.OP7_SQL,
    "op8_suffix_array_dedup": repeats.SPANS_SQL,
    "op10_relative_lz_dedup": repeats.SPANS_SQL,
}
