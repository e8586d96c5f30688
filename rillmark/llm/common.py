"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SMALL = 32 << 20
BROADCAST = 8 << 20  # written tables of up to so many bytes are broadcast
TEXTS = 1_000  # texts that a task holds as Python strings, with what is made of them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of under SMALL bytes in fewer files than cores, dealt over the cores: a file may be one row group, which is one task.

    Any other table is left as it is, so nothing is shuffled where that would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent and Spark runs in one process (tests, a laptop) a temporary folder is taken.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if not setting and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(setting or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


MADE: list[str] = []  # the folders that operators made in this process


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Results read from it when they are asked for, so only a caller knows when it can go: see clear."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def clear(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders made after the first `since` ones; for callers that have written what they want."""
    paths, MADE[since:] = MADE[since:], []
    for path in paths:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a written table in the shared folder; its files tell the optimiser its size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def each_text(make: Callable[[], Callable[[list], Sequence]], returns: str) -> Callable[..., Column]:
    """A column function from a text column to a struct `returns`.

    make() runs once in each task; what it gives is called with TEXTS texts at most at a time and
    gives one list or array for each field. No other column of the row leaves the JVM. Arrow's
    spare memory goes back at the end of a task, as its worker goes on to tasks of other stages.
    """
    fields = list(to_arrow_type(StructType.fromDDL(returns)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for texts in batches:
            for at in range(0, len(texts), TEXTS):
                columns = own(texts.slice(at, TEXTS).to_pylist())
                yield pa.StructArray.from_arrays([pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, fields)], fields=fields)
        pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, returns)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that none of their names can clash."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def transposed(rows: list[tuple], width: int) -> list[list]:
    """Rows as columns, of which there are `width` even if there is no row."""
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]


def if_small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files have up to BROADCAST bytes; otherwise a join with it is a shuffle."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST else table


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """rows joined with table (one row for each key, with the number of its rows in column `count`); no hot key meets in one task.

    A key with over 1 / (4 * partitions) of all rows is hot. There are 4 * partitions of them at most, so
    their part of the table is broadcast; all other rows go by a shuffle on the key. total is the number of rows, if it is known.
    """
    n = 4 * partitions(rows.sparkSession)
    total = (table.agg(F.sum(count)).first()[0] or 0) if total is None else total
    is_hot = F.col(count) * n > total
    hot = F.broadcast(table.filter(is_hot))
    once = rows.join(hot, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(~is_hot), key)
    return once.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
