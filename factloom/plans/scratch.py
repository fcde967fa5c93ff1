"""Cutting lineage with tables that every executor can read again.

Executors can be lost at any time, so nothing here keeps the only copy of a result in an
executor: a cut is either a reliable ``checkpoint()`` or a Parquet table, both in the shared
folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: About what a row of an id takes in a broadcast table, and how large one may be.
ROW_BYTES, BROADCAST_BYTES = 24, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    held = sc.getCheckpointDir()
    if held is None:
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(named)
        held = sc.getCheckpointDir()
    return named or held


class Scratch:
    """Parquet tables that live until ``close``; use them only for what the returned plan no longer reads.

    ``keep`` is for what the returned plan still reads: a reliable checkpoint, which Spark's
    context cleaner removes once the plan is unreachable.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self._paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_last(self, n: int = 1) -> None:
        for _ in range(min(n, len(self._paths))):
            self._remove(self._paths.pop())

    def keep(self, df: DataFrame) -> DataFrame:
        shared_dir(self.spark)
        return df.checkpoint(eager=True)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def close(self) -> None:
        self.drop_last(len(self._paths))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def small_side(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured ``size`` in bytes is within ``limit``; beyond it the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if size <= limit else df
