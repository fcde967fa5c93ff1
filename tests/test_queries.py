"""Every query of the catalogue that has SQL gives DuckDB's rows."""

import pytest

from factloom.plans import catalog

ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same):
    same(catalog.callables()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.callables()) - set(ORACLES)))
def test_runs(name, spark):
    from conftest import SMALL

    assert catalog.callables()[name](spark, SMALL).count() >= (name != "src05_python_calls")


def test_converged_ranks(spark):
    """The ranks of the whole graph against plain power iteration."""
    from conftest import SMALL

    from factloom.plans.facts import Facts

    edges = sorted({(r.src, r.dst) for r in Facts(spark, SMALL).edges.collect()})
    nodes = sorted({x for e in edges for x in e})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(150):
        lost = sum(rank[v] for v in nodes if v not in out)
        after = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for v, to in out.items():
            for b in to:
                after[b] += 0.85 * rank[v] / len(to)
        rank = after
    got = {r.node: r["rank"] for r in catalog.callables()["g18_pagerank_converged"](spark, SMALL).collect()}
    assert got == {v: pytest.approx(1000 * x, abs=2e-5) for v, x in rank.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
