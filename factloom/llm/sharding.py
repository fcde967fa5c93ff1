"""Sharding by best-fit-decreasing bin packing.

Groups of rows that must stay together are taken by falling size; each goes into the open shard whose
remaining capacity is the least that holds it, found through a balanced tree, and opens a new shard if
none does. Best fit decreasing uses at most 11/9 of the optimum and some.

The packing is that of one machine, yet no machine sees the groups. Groups of the same size are alike:
best fit puts as many of them as fit into one shard before it turns to the next, since what remains
there is then still the tightest. So the driver packs the histogram of sizes, and it handles shards of
the same remaining capacity as one range; its work follows the number of different sizes, at most the
capacity in units, not that of rows. Which group of its size a group is comes from a count in salted
parts, and a join by size and range then finds its shard.

A group larger than the capacity cannot be cut, and gets a shard of its own (``oversize``).
Defined cases: rows with a null id go; a null text counts 0 bytes and null keys are a group like any
other; empty groups count one unit; repeated rows count as often as they stand; ties between groups
of a size are broken by the group's hash, then its key; no rows, no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.scratch import ROW_BYTES, Scratch, small_side

CAPACITY, SALTS = 4 << 20, 64
PLAN = "size long, lo long, hi long, per_shard long, shard long"


class BitTree:
    """A set of whole numbers below a bound as a balanced tree with 64 children a node: insert, remove, next."""

    def __init__(self, bound: int):
        self.levels: list[dict[int, int]] = [{}]
        while bound > 64:
            bound = -(-bound // 64)
            self.levels.append({})

    def add(self, x: int) -> None:
        for level in self.levels:
            bits = level.get(x >> 6, 0)
            level[x >> 6] = bits | 1 << (x & 63)
            if bits:
                return
            x >>= 6

    def remove(self, x: int) -> None:
        for level in self.levels:
            bits = level[x >> 6] & ~(1 << (x & 63))
            if bits:
                level[x >> 6] = bits
                return
            del level[x >> 6]
            x >>= 6

    def at_least(self, x: int) -> int | None:
        for k, level in enumerate(self.levels):
            bits = level.get(x >> 6, 0) >> (x & 63)
            if bits:
                x += (bits & -bits).bit_length() - 1
                for below in reversed(self.levels[:k]):
                    bits = below[x]
                    x = x << 6 | (bits & -bits).bit_length() - 1
                return x
            x = (x >> 6) + 1
        return None


def pack(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows of PLAN for (size, count) pairs, and the number of shards.

    Groups lo to hi - 1 of a size, in order, fill shards from ``shard`` on, per_shard to each.
    """
    plan, shards = [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining: ranges (first, number), last one first
    tree = BitTree(capacity + 1)

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            if remaining not in open_:
                open_[remaining] = []
                tree.add(remaining)
            open_[remaining].append((first, number))

    for size, count in sorted(histogram, reverse=True):
        if size > capacity:
            plan.append((size, 0, count, 1, shards))
            shards += count
            continue
        done = 0
        while done < count:
            r = tree.at_least(size)
            if r is None:
                per = capacity // size
                number = -(-(count - done) // per)
                first, r = shards, capacity
                shards += number
            else:
                first, number = open_[r].pop()
                if not open_[r]:
                    del open_[r]
                    tree.remove(r)
                per = r // size
            n = min(count - done, per * number)
            plan.append((size, done, done + n, per, first))
            whole, part = divmod(n, per)
            put(r - per * size, first, whole)
            if part:
                put(r - part * size, first + whole, 1)
            put(r, first + whole + bool(part), number - whole - bool(part)) if r < capacity else None
            done += n
    return plan, shards


def shards(rows: DataFrame, group: list[Column], size: Column, *, capacity: int = CAPACITY, unit: int = 1) -> DataFrame:
    """(doc_id, shard, group_size, oversize) for every row; sizes and capacity count units of ``unit``."""
    if capacity < 1 or unit < 1:
        raise ValueError("capacity and unit must be positive")
    spark = rows.sparkSession
    with Scratch(spark) as s:
        key = F.struct(*[g.cast("string").alias(f"g{i}") for i, g in enumerate(group)])
        each = s.keep(rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.to_json(key, {"ignoreNullFields": "false"})).alias("g"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes")))
        sized = s.keep(each.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / unit)).cast("long").alias("size")).withColumns({"salt": F.pmod(F.xxhash64("g"), F.lit(SALTS)), "real": F.col("size"), "size": F.least(F.col("size"), F.lit(-(-capacity // unit) + 1))}))  # all beyond the capacity are one kind
        parts = s.keep(sized.groupBy("size", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        histogram = [(r["size"], r["n"]) for r in parts.groupBy("size").agg(F.sum("n").alias("n")).toLocalIterator()]
        plan, _ = pack(histogram, -(-capacity // unit))
        placed = s.keep(spark.createDataFrame(plan or [(0, 0, 0, 1, 0)], PLAN))
        ranked = sized.withColumn("k", F.row_number().over(Window.partitionBy("size", "salt").orderBy("g"))).join(small_side(parts.select("size", "salt", "before"), 2 * ROW_BYTES * SALTS * len(histogram)), ["size", "salt"]).select("g", "size", "real", (F.col("before") + F.col("k") - 1).alias("rank"))
        found = ranked.alias("r").join(small_side(placed, 2 * ROW_BYTES * len(plan)).alias("p"), (F.col("r.size") == F.col("p.size")) & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.hi")))
        shard = found.select("g", F.col("r.real").alias("group_size"), (F.col("p.shard") + F.floor((F.col("r.rank") - F.col("p.lo")) / F.col("p.per_shard"))).cast("long").alias("shard"))
        return each.join(shard, "g").select("doc_id", "shard", "group_size", (F.col("group_size") > -(-capacity // unit)).alias("oversize"))


def shard_documents(docs: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Shards of at most ``capacity`` bytes of text; documents of equal text are one group, so that copies never part."""
    return shards(docs, [F.md5(F.col("text").cast("string"))], F.octet_length(F.col("text").cast("string")), capacity=capacity)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
