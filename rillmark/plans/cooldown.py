"""Alerts with a cooldown over series of any length, by pointers and doubling instead of a fold in time.

In a series (a pipeline's hits of a rule) the first hit fires, and after a hit that fired the next one is the first at least a
cooldown later. So every hit points at the one that would fire after it, found by binary search in its sorted block. Blocks are ranges
of the sorted hits, about `BLOCK` rows each, whatever the series are; a task takes as many smaller ones as make up that size. Within its block each hit follows the pointers to the
last one, by doubling in memory; the time from which the series may fire again is then the hit's *want*. A want is resolved
to the first hit behind it by sorting wants among the hits, in blocks again. Wants point at wants, and which of them the first
hit reaches is found by doubling in as many rounds as the logarithm of the number of blocks. In the end each block walks from
the hits at which it is entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

BLOCK = 1_000_000


def _segments(names: pa.Array) -> list[tuple[int, int]]:
    """Where runs of equal names begin and end."""
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(code)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(code)])) if len(code) else []


def last_of_chain(at: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending times: each one's pointer (itself where it leads out), and the last of its chain."""
    following = np.searchsorted(at, at + wait)
    pointer = np.where(following < len(at), following, np.arange(len(at)))
    last = pointer
    while len(last) and (last[last] != last).any():
        last = last[last]
    return pointer, last


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    some = [b for b in batches if len(b)]
    return pa.Table.from_batches(some).combine_chunks().to_batches()[0] if some else None


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of a size, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while n + len(b) >= size:
            yield _whole(iter([*held, b.slice(0, size - n)]))
            b, held, n = b.slice(size - n), [], 0
        held.append(b)
        n += len(b)
    if n:
        yield _whole(iter(held))


def _chained(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of hits, sorted by series and time: each hit with its block and its want."""
    first = TaskContext.get().partitionId() << 32
    for i, rows in enumerate(_cut(batches, size)):
        at, wait = rows.column("at").to_numpy(), rows.column("wait").to_numpy()
        want = np.empty(len(at), np.int64)
        for a, b in _segments(rows.column("series")):
            _, last = last_of_chain(at[a:b], int(wait[a]))
            want[a:b] = at[a:b][last] + wait[a]
        block = pa.array(np.full(len(at), first + i, np.int64))
        yield pa.RecordBatch.from_arrays([block, *rows.columns, pa.array(want)], names=["block", *rows.schema.names, "want"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of hits and wants, sorted by series, time and kind (wants first): each want with the first hit behind it.

    For the wants at its end the block knows none; it tells what its own first hit of its first series is.
    """
    rows = _whole(batches)
    if rows is None:
        return
    at, block, own_want, is_hit = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("at", "block", "want", "hit"))
    place = TaskContext.get().partitionId()
    picked, entry = [], []
    for n, (a, b) in enumerate(_segments(rows.column("series"))):
        hits = a + np.flatnonzero(is_hit[a:b])
        wants = a + np.flatnonzero(~is_hit[a:b])
        behind = np.searchsorted(hits, wants)
        known = behind < len(hits)
        picked.append(wants)
        entry.append(np.where(known, hits[np.minimum(behind, max(len(hits) - 1, 0))] if len(hits) else -1, -1))
        if n == 0 and len(hits):  # what a block before this one may look for
            picked.append(hits[:1])
            entry.append(hits[:1])
    i, e = np.concatenate(picked), np.concatenate(entry)
    lacks = e < 0
    columns = [rows.column("series").take(pa.array(i)), pa.array(at[i]), pa.array(is_hit[i]), pa.array(np.full(len(i), place, np.int32))]
    columns += [pa.array(x[np.maximum(e, 0)], mask=lacks) for x in (block, at, own_want)]
    yield pa.RecordBatch.from_arrays(columns, names=["series", "at", "hit", "place", "e_block", "e_at", "e_want"])


def _entries(steps: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """block, series, at: the hits at which blocks are entered."""
    heads = steps.groupBy("series").agg(F.min(F.struct("at", "block", "want")).alias("h")).select("series", "h.*")
    if blocks == 1:
        return heads.select("block", "series", "at")
    hits = steps.select("series", "at", "block", "want", F.lit(True).alias("hit"))
    wants = steps.select("series", F.col("want").alias("at")).distinct().select("series", "at", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("want"), F.lit(False).alias("hit"))
    order = "series", "at", "hit"
    sorted_ = hits.unionByName(wants).repartitionByRange(2 * tasks, *order).sortWithinPartitions(*order)
    found = stored(sorted_.mapInArrow(_resolved, "series string, at long, hit boolean, place int, e_block long, e_at long, e_want long"), "wants")
    # what a block did not find is the first hit of a later one: a row or so of each block is looked at
    firsts = found.filter("hit").select("series", "place", F.struct("e_block", "e_at", "e_want").alias("e"))
    open_ = found.filter("not hit and e_at is null").select("series", "place").distinct()
    behind = F.first("e", ignorenulls=True).over(Window.partitionBy("series").orderBy("place").rowsBetween(1, Window.unboundedFollowing))
    both = firsts.join(open_.withColumn("asks", F.lit(True)), ["series", "place"], "full_outer")
    later = both.withColumn("l", behind).filter("asks").select("series", "place", "l")
    asked = found.filter("not hit").join(later, ["series", "place"], "left")
    to = F.when(F.col("e_at").isNotNull(), F.struct("e_block", "e_at", "e_want")).otherwise(F.col("l"))
    edges = stored(asked.select("series", F.col("at").alias("want"), to.alias("e")).filter("e is not null").select("series", "want", "e.*"), "edges")
    jump = edges.select("series", "want", F.col("e_want").alias("to"))
    reached = stored(heads.select("series", "want"), "reached")
    n = reached.count()
    while True:
        further = reached.join(jump, ["series", "want"]).select("series", F.col("to").alias("want"))
        reached = stored(reached.union(further).distinct(), "reached")
        before, n = n, reached.count()
        if n == before:
            break
        twice = jump.select("series", F.col("want").alias("from"), F.col("to").alias("want")).join(jump, ["series", "want"])
        jump = stored(twice.select("series", F.col("from").alias("want"), "to"), "jump")
    entered = reached.join(edges, ["series", "want"]).select(F.col("e_block").alias("block"), "series", F.col("e_at").alias("at"))
    return heads.select("block", "series", "at").union(entered).distinct()


def _walk(hits: pa.Table, entries: pa.Table) -> pa.Table:
    """The hits of a block that fire."""
    if not len(hits) or not len(entries):
        return hits.slice(0, 0).select(["row"] if len(hits) else [])
    hits = hits.sort_by([("series", "ascending"), ("at", "ascending")])
    at, wait = hits["at"].to_numpy(), hits["wait"].to_numpy()
    enter: dict[str, list[int]] = {}
    for name, t in zip(entries["e_series"].to_pylist(), entries["e_at"].to_pylist()):
        enter.setdefault(name, []).append(t)
    fires = []
    names = hits["series"].combine_chunks()
    for a, b in _segments(names):
        if begin := enter.get(names[a].as_py()):
            pointer, _ = last_of_chain(at[a:b], int(wait[a]))
            i = int(np.searchsorted(at[a:b], min(begin)))  # later entries of a block lie on the same chain
            while True:
                fires.append(a + i)
                if pointer[i] == i:
                    break
                i = int(pointer[i])
    return hits.take(pa.array(fires, pa.int64())).select(["row"])


def fired(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of hits (pipeline_name, rule, finished_at, run_id, cooldown in seconds) that fire.

    The cooldown is the rule's; where the hits of one series differ, the longest holds. Without one every hit fires. Of hits at
    the same time the smallest run_id fires. A null name is a name; hits without a time are left out.
    """
    columns = hits.columns
    rows = hits.filter("finished_at is not null").select(
        F.to_json(F.struct("pipeline_name", "rule")).alias("series"),
        F.unix_micros(F.col("finished_at").cast("timestamp")).alias("at"),
        (F.coalesce(F.col("cooldown"), F.lit(0)).cast("long") * 1_000_000).alias("wait"),
        F.struct(*[f"`{c}`" for c in columns]).alias("row"),
    )
    waits = rows.groupBy("series").agg(F.max("wait").alias("wait"))
    timed = rows.drop("wait").join(waits, "series")
    free = timed.filter("wait <= 0").select("row.*")
    nodes = timed.filter("wait > 0").groupBy("series", "at").agg(F.max("wait").alias("wait"), F.min_by("row", "row.run_id").alias("row"))
    nodes = stored(nodes, "hits")
    n = nodes.count()
    if not n:
        return free
    blocks = -(-n // block)
    tasks = min(blocks, max(-(-n // BLOCK), hits.sparkSession.sparkContext.defaultParallelism))
    order = "series", "at"
    kind = nodes.schema["row"].dataType.simpleString()
    steps = nodes.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(partial(_chained, size=block), f"block long, series string, at long, wait long, row {kind}, want long")
    steps = stored(steps, "steps")
    entries = _entries(steps, blocks, tasks).select(F.col("block").alias("e_block"), F.col("series").alias("e_series"), F.col("at").alias("e_at"))
    found = steps.select("block", "series", "at", "wait", "row").groupBy("block").cogroup(entries.groupBy("e_block")).applyInArrow(_walk, f"row {kind}")
    return found.select("row.*").unionByName(free)
