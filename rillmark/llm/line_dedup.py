"""Lines that many documents share, dropped by levelled sorted runs of line hashes.

A run is a table of line hashes, each with the number of documents that it was seen in, bucketed by hash and sorted within buckets. A
batch of documents is counted, merge-anti-joined with the runs (a line that a run already knows to be in enough
documents needs no more counting), and added as a run of level 0. When a level has `FANOUT` runs they are compacted into one of the
next, where the counts of equal hashes add up; so there are as many runs as the logarithm of the number of batches. Runs have the
same buckets, so a batch is shuffled once and the runs are not.

In the end all runs are merged: what was seen in enough documents is dropped from every text. Which lines a text
loses is a join of its line hashes with those; texts without such a line meet nothing.

Hashes are 128-bit XXH3: lines that share one count as equal, which is not to be expected below some 10^18 different lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, new_folder, partitions, remove, stored

FANOUT = 2
BATCHES = 4  # batches that one corpus is taken in
KEY = ["h1", "h2"]
TEXT = ["t1", "t2"]


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line: no white space at its ends, A-Z in lower case. Null is one empty line."""
    return [x.strip().lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def text_key(text: F.Column) -> list[F.Column]:
    """Two 64-bit hashes of a text; rows of equal texts have equal lines."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def line_hashes(docs: DataFrame, least: int = 1) -> DataFrame:
    """t1, t2, h1, h2: each different line of each row of docs that can be dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text"):
                own = {k for k in keys_of(text.as_py()) if long_enough(k, least)}
                sizes.append(len(own))
                found += [xxhash.xxh3_128_digest(k) for k in own]
            h = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
            t1, t2 = (np.repeat(batch.column(c).to_numpy(), sizes) for c in TEXT)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1, t2, h[::2], h[1::2])], names=[*TEXT, *KEY])

    text = F.col("text").cast("string")
    return docs.select(*text_key(text), text.alias("text")).filter(F.length("text") > 0).mapInArrow(run, "t1 long, t2 long, h1 long, h2 long")


class Runs:
    """The levelled runs of a growing corpus. min_docs: in so many documents a line is common."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []  # of each level the runs' names and folders

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_folder(self.spark, "line-run")
        counts.select(*KEY, "n").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged by their sorted hashes, two at a time; the counts of equal hashes add up."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m"), KEY, "full_outer")
            return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(two, runs)

    def add(self, lines: DataFrame) -> None:
        """A batch: a row (h1, h2) for each different line of each document."""
        fresh = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs:
            fresh = fresh.join(run.filter(F.col("n") >= self.min_docs), KEY, "left_anti")
        self._put(0, self._write(fresh))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._merged([self.spark.table(name) for name, _ in full])))
            for old in full:
                self._drop(old)

    def common(self) -> DataFrame:
        """h1, h2 of the lines in min_docs documents or more; stored."""
        none = self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return stored(self._merged(self.runs or [none]).filter(F.col("n") >= self.min_docs).select(*KEY), "common-lines")

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def without(docs: DataFrame, lines: DataFrame, common: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: docs without the common lines; lines are the line hashes of docs.

    A text's lines are looked up once for all rows that have it, and only texts with a common line have a row to join.
    """
    hit = lines.join(if_small(common), KEY).groupBy(*TEXT).agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    hits = stored(hit, "line-hits")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, hashes in zip(texts.to_pylist(), gone):
                text = text or ""
                n_lines.append(text.count("\n") + 1)
                if hashes.is_valid:
                    drop = {(x["h1"] % 2**64 << 64 | x["h2"] % 2**64).to_bytes(16, "big") for x in hashes.as_py()}
                    own = [x for x, k in zip(text.split("\n"), keys_of(text)) if not long_enough(k, least) or xxhash.xxh3_128_digest(k) not in drop]
                    n_dropped.append(n_lines[-1] - len(own))
                    kept.append("\n".join(own))
                else:
                    n_dropped.append(0)
                    kept.append(text)
            yield pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_dropped", "kept"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), *text_key(text)).join(if_small(hits), TEXT, "left")
    cleaned = F.arrow_udf(run, "n_lines long, n_dropped long, kept string")
    return rows.select("doc_id", cleaned("text", "gone").alias("_r")).select("doc_id", "_r.*")


def dedup(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept for each row of docs: lines whose key of `least` code points or more stands in min_docs rows or more go.

    Null and empty texts are one empty line, which stays. A line counts once for each row, so repeated rows are documents of
    their own, whatever their ids. Lines stay as they are and in order, joined by a line feed; if all go, kept is empty.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "lines")
    hashes = line_hashes(docs, least)
    hashes.withColumn("batch", F.spark_partition_id() % batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(hashes.withColumn("batch", F.lit(0)).schema).parquet(path)
    runs = Runs(spark, min_docs, fanout)
    try:
        for b in range(batches):
            runs.add(lines.filter(F.col("batch") == b).select(*KEY))
        common = runs.common()
    finally:
        runs.close()
    return without(docs, lines.select(*TEXT, *KEY), common, least)
