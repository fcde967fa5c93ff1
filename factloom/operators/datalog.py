"""Recursive rules over function facts: taint with and without guards, dirty sets, guard propagation, bounded flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.iterate import reach
from factloom.plans.scratch import Scratch


def tainted(calls: DataFrame, bases: DataFrame, guarded: DataFrame | None = None) -> DataFrame:
    """(node, depth): base nodes and, against the direction of calls(src, dst), all who call them; a guarded caller is not entered, a guarded base stays."""
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, bases, guard=guarded)


def public_violations(taint: DataFrame, functions: DataFrame) -> DataFrame:
    """(node, depth, direct01) of tainted public functions(node, is_public); direct01 is 0 for a base and 1 for any caller."""
    ok = functions.where(F.col("is_public") & (F.col("node").cast("string") != "<module>")).select("node").distinct()
    return taint.join(ok, "node", "left_semi").select("node", "depth", F.least("depth", F.lit(1)).alias("direct01"))


def dirty_files(changed: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Files to check again: changed(file), then all files that call, by name, any of functions(file, name) in a dirty file; calls(file, callee)."""
    edges = functions.select(F.col("file").alias("src"), F.col("name").alias("callee")).join(calls.select(F.col("file").alias("dst"), "callee"), "callee").select("src", "dst").distinct()
    return reach(edges, changed.select(F.col("file").alias("node"))).select(F.col("node").alias("file"))


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, *, hops: int = 5, factor: float = 0.8) -> DataFrame:
    """(source, sink, hops, confidence): definitions reaching uses along edges(src, dst) in at most so many hops, the fewest of each pair."""
    with Scratch(edges.sparkSession) as s:
        e = s.keep(edges.select("src", "dst").distinct())
        seen = s.keep(sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.lit(0).alias("hops")).distinct())
        delta = seen
        for k in range(1, hops + 1):
            found = delta.join(e, delta["at"] == e["src"]).select("source", F.col("dst").alias("at"), F.lit(k).alias("hops")).distinct()
            delta = s.keep(found.join(seen, ["source", "at"], "left_anti"))
            seen = seen.unionByName(delta)
        hit = seen.where("hops > 0").join(sinks.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        return hit.select("source", F.col("at").alias("sink"), "hops", F.round(F.pow(F.lit(factor), F.col("hops")), 6).alias("confidence"))


def guarded_sites(sites: DataFrame, morphisms: DataFrame) -> DataFrame:
    """sites(id, kind, file) of kind ErrorSite with ``guarded``: reachable from a BranchGuard along morphisms(src, dst)."""
    from_guards = reach(morphisms, sites.where("kind = 'BranchGuard'").select(F.col("id").alias("node"))).select(F.col("node").alias("id")).withColumn("guarded", F.lit(True))
    return sites.where("kind = 'ErrorSite'").join(from_guards, "id", "left").select("id", "file", F.coalesce("guarded", F.lit(False)).alias("guarded"))


def unguarded_rank(sites: DataFrame, morphisms: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, rank): different sources(id, source) of unguarded error sites."""
    open_ = guarded_sites(sites, morphisms).where("not guarded")
    return open_.join(sources, "id").groupBy("file").agg(F.countDistinct("source").alias("rank"))
