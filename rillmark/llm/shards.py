"""Shards of nearly equal size by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. Groups are sorted by size and each goes to the
least-loaded shard, taken from a heap. Groups of equal size are interchangeable, so the driver
schedules a table of the different sizes and how many groups have each: d different sizes sum to at least
d * (d + 1) / 2, so there are at most sqrt(2 * bytes) of them, some ten million for 100 TB at the very worst. What it
gives back is, for each size, how many of its groups go to which shard; a group finds its shard by its number
among those of its size.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_hot, partitions, stored

RUN = 4  # so many groups of a size for each shard are placed at once; the outcome is that of one by one


def _place(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n items of one size each shard gets, if each goes to the least-loaded one.

    Item j of shard i is taken at the load loads[i] + j * size; the n lowest of these (ties: the
    lower shard) are taken. The level below which all are taken is found by bisection.
    """

    def taken(level: int) -> list[int]:
        return [(level - x) // size + 1 if x <= level else 0 for x in loads]

    low, high = min(loads) - 1, min(loads) + n * size
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(taken(mid)) <= n else (low, mid)
    out = taken(low)
    rest = n - sum(out)
    for i, x in enumerate(loads):
        if rest and x <= high and (high - x) % size == 0:
            out[i] += 1
            rest -= 1
    return out


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[dict[int, int]]:
    """sizes: (size, number of groups). For each size, from the largest on: shard -> number of its groups."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, n in sorted(sizes, reverse=True):
        got: dict[int, int] = {}
        if n > RUN * shards:
            loads = [x for x, _ in sorted(heap, key=lambda e: e[1])]
            got = {s: k for s, k in enumerate(_place(loads, size, n)) if k}
            heap = [(x + size * got.get(s, 0), s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
        else:
            for _ in range(n):
                load, shard = heap[0]
                got[shard] = got.get(shard, 0) + 1
                heapq.heapreplace(heap, (load + size, shard))
        out.append(got)
    return out


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs.

    A null text counts as the empty one: size 8. A slot numbers a shard's rows from 0 without gaps,
    in no order that matters. Repeated rows are rows of their own, in the same shard. An empty
    table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"))
    # equal hashes of unequal texts would only keep more rows together
    rows = stored(sized, "shards-rows")
    part = F.pmod(F.col("grp"), F.lit(partitions(spark))).cast("int")
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).withColumn("part", part), "shards-groups")
    sizes = sorted(((r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    placed = schedule(sizes, shards)
    plan = spark.createDataFrame(
        pa.table(
            {
                "bytes": pa.array([b for b, _ in sizes], pa.int64()),
                "groups": pa.array([n for _, n in sizes], pa.int64()),
                "to": pa.array([list(p) for p in placed], pa.list_(pa.int32())),
                "ends": pa.array([list(accumulate(p.values())) for p in placed], pa.list_(pa.int64())),
            }
        )
    )
    # a group's number among those of its size: within a part of them first, then with the parts' offsets
    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("n")).select("bytes", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("grp")) - 1
    numbered = groups.withColumn("at", within).join(offsets, ["bytes", "part"]).withColumn("at", F.col("at") + F.col("before"))
    which = F.size(F.filter("ends", lambda e: e <= F.col("at")))
    homes = join_hot(numbered, plan, "bytes", "groups").select("grp", "rows", F.get("to", which).alias("shard"))
    sharded = join_hot(rows, stored(homes, "shards-homes"), "grp", "rows")
    return with_slots(sharded.select("doc_id", "size", "text_crc32", "shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0: within a part of the shard first, then with the parts' offsets.

    A shard's rows are never in one task, nor are those of a repeated row. The parts are as many as partitions.
    """
    n = partitions(rows.sparkSession)
    salt = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())
    parts = cut(rows.withColumn("part", F.pmod(salt, F.lit(n)).cast("int")))
    sizes = parts.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id")) - 1
    return parts.withColumn("at", within).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).alias("slot"))
