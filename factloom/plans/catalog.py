"""The registry of queries: name, function of Facts, and the DuckDB SQL of the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.facts import Facts, with_facts


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Facts], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"two queries named {name}")
        CATALOG[name] = Query(name, build, with_facts(sql) if sql else None)
        return build

    return register


def load() -> dict[str, Query]:
    from factloom.plans import queries_graph, queries_mining, queries_relational, queries_source  # noqa: F401

    return CATALOG


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, q=q: q.build(Facts(spark, sf_dir))) for n, q in load().items()}


def oracles() -> dict[str, str]:
    return {n: q.sql for n, q in load().items() if q.sql}
