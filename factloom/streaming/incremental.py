"""Checking again only what a stream of changed files makes dirty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import datalog, rules


def recheck(files: DataFrame, changed: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Violations of files(file, text) in the dirty set of changed(file)."""
    dirty = datalog.dirty_files(changed, functions, calls)
    return rules.check(files.join(dirty, "file", "left_semi"))


def watch(changes: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``recheck`` for each micro-batch of the stream changes(file), over load()'s files, functions and calls; appends JSON lines by batch."""

    def batch(df: DataFrame, k: int) -> None:
        files, functions, calls = load()
        recheck(files, df.select("file").distinct(), functions, calls).write.mode("overwrite").json(f"{path}/batch={k}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_cached(files: DataFrame, cache: str, *, rules_id: str = "1") -> DataFrame:
    """Violations of files(file, text), from the Parquet table ``cache`` for those that it holds under the same digest.

    Only files whose text is new are checked; they are added, with a row of a null mode for a file without a finding.
    ``rules_id`` names the rules: under another one nothing that is held counts. Where there is no table one is begun.
    """
    spark = files.sparkSession
    key = F.sha2(F.concat_ws(":", F.lit(rules_id), "file", F.coalesce("text", F.lit(""))), 256)
    now = files.withColumn("digest", key)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    held = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.parquet(cache).select("digest").distinct() if held else None
    fresh = now.join(known, "digest", "left_anti") if held else now
    found = rules.check(fresh).join(fresh.select("file", "digest"), "file")
    clean = fresh.select("file", "digest").join(found.select("digest").distinct(), "digest", "left_anti")
    columns = ["file", "line", "mode", "call", "message", "digest"]
    found.select(*columns).unionByName(clean, allowMissingColumns=True).select(*columns).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(now.select("digest").distinct(), "digest", "left_semi").where("mode is not null").select("file", "line", "mode", "call", "message").distinct()
