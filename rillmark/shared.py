"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MADE: list[str] = []  # the folders that this process has made


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder where driver and executors both write: under spark.checkpoint.dir. A temporary one is taken only where that is unset and Spark runs in one process."""
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if not setting and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    MADE.append(f"{setting or tempfile.mkdtemp(prefix='rillmark-')}/{kind}-{uuid.uuid4().hex}")
    return MADE[-1]


def clear(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders made after the first `since` ones; for callers that have written what they want of results that read them."""
    paths, MADE[since:] = MADE[since:], []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there whatever executor is lost."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
