"""Scans: files of any Hadoop file system, tables by JDBC, topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import source
from .database import is_sqlite, scan_sqlite


def _path() -> Column:
    """A row's file, as binaryFile writes its path: not encoded, and without the slashes of an empty authority."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^([^/:]+):///", "$1:/")


@source("files", "local", "s3", "gcs", "azure_blob", "sftp", "ftp")
def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, lines: bool = False) -> DataFrame:
    """One row for each file: content, source_path, source_filename. Local, s3a, gs, abfss, ftp and other URIs.

    lines: one for each line instead, its content text; files are split, so they may be of any size.
    """
    if lines:
        df = spark.read.format("text").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
        return df.select(F.col("value").alias("content"), _path().alias("source_path"), F.col("_metadata.file_name").alias("source_filename"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modificationTime"))
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select("content", F.col("path").alias("source_path"), F.col("_metadata.file_name").alias("source_filename"), "length", "modificationTime")


def scan_new_files(spark: SparkSession, path: str, ledger: DataFrame, pipeline: str, source_key: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files that the ledger (pipeline_name, source_key, filepath) does not list."""
    seen = ledger.filter((F.col("pipeline_name") == pipeline) & (F.col("source_key") == source_key)).select(F.col("filepath").alias("source_path"))
    return scan_files(spark, path, pattern, recursive).join(seen, "source_path", "left_anti")


def ledger_rows(files: DataFrame, pipeline: str, source_key: str) -> DataFrame:
    """What is added to the ledger once the files are done."""
    return files.select(F.lit(pipeline).alias("pipeline_name"), F.lit(source_key).alias("source_key"), F.col("source_path").alias("filepath"), F.current_timestamp().alias("processed_at"))


def stream_files(spark: SparkSession, path: str, pattern: str = "*", max_files: int | None = None, after_read: str | None = None, archive_dir: str | None = None, lines: bool = False) -> DataFrame:
    """The same as a stream (with path for source_path); the checkpoint is the ledger. after_read: archive or delete."""
    shape = "value string" if lines else "path string, modificationTime timestamp, length bigint, content binary"
    r = spark.readStream.format("text" if lines else "binaryFile").schema(shape).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if after_read:
        r = r.option("cleanSource", after_read)
        if archive_dir:
            r = r.option("sourceArchiveDir", archive_dir)
    files = r.load(path)
    return files.select(_path().alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), F.col("_metadata.file_size").alias("length"), F.col("value").alias("content")) if lines else files


@source("parquet")
def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@source("sql", "jdbc", "clickhouse")
def scan_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, partitioning: Mapping[str, object] | None = None, fetchsize: int = 5000, **options: str) -> DataFrame:
    """A query or a table; partitioning (column, lower, upper, n) reads a table in parallel. sqlite:///path goes by the driver in Python (see database)."""
    if is_sqlite(url):
        return scan_sqlite(spark, url, query or f"SELECT * FROM {table}", partitioning, fetchsize, **options)
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetchsize).options(**options)
    r = r.option("query", query) if query else r.option("dbtable", table)
    if partitioning:
        r = r.option("partitionColumn", partitioning["column"]).option("lowerBound", partitioning["lower"]).option("upperBound", partitioning["upper"]).option("numPartitions", partitioning["n"])
    return r.load()


def kafka_options(brokers: str, topics: str, starting: str = "latest", group_hint: str | None = None, max_offsets: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": brokers, "subscribe": topics, "startingOffsets": starting}
    if group_hint:
        out["groupIdPrefix"] = group_hint
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


def scan_kafka(spark: SparkSession, brokers: str, topics: str, **options) -> DataFrame:
    """Needs Spark's Kafka package on the class path. Null values are skipped."""
    df = spark.readStream.format("kafka").options(**kafka_options(brokers, topics, **options)).load()
    return df.filter("value is not null").select("value", "topic", "partition", "offset", "key", "timestamp")


def kafka_lag(progress: DataFrame, column: str) -> DataFrame:
    """topic, partition, lag (latest offset less the position) from progress reports in JSON, as a query listener gives them.

    Sources of other kinds and reports without a latest offset give no rows; a partition not read yet counts from 0.
    """
    offsets = "map<string, map<string, bigint>>"
    report = F.from_json(column, "struct<sources: array<struct<endOffset: string, latestOffset: string>>>")
    rows = progress.withColumn("_s", F.explode(report["sources"])).drop(column)
    rows = rows.withColumns({"_at": F.from_json("_s.endOffset", offsets), "_to": F.from_json("_s.latestOffset", offsets)})
    topics = rows.select("*", F.explode("_to").alias("topic", "_p")).select("*", F.explode("_p").alias("partition", "_last"))
    position = F.coalesce(F.col("_at")[F.col("topic")][F.col("partition")], F.lit(0))
    return topics.withColumns({"partition": F.col("partition").cast("int"), "lag": F.col("_last") - position}).drop("_s", "_at", "_to", "_p", "_last")


def extract_response(df: DataFrame, body: str, path: str, kind: str = "string", strict: bool = True) -> DataFrame:
    """Rows from a JSON response: the elements at a dotted path ("data.items", "pages.0"). Missing is an error if strict."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    found = F.try_variant_get(F.try_parse_json(body), f"${steps}", "variant")
    items = F.coalesce(F.try_variant_get(found, "$", f"array<{kind}>"), F.when(found.isNotNull(), F.array(F.try_variant_get(found, "$", kind))))
    if strict:
        items = F.coalesce(items, F.raise_error(F.lit(f"no {path} in the response")).cast(f"array<{kind}>"))
    return df.withColumn("item", F.explode(items)).drop(body)


def cap(df: DataFrame, batch_size: int) -> DataFrame:
    return df.limit(batch_size)
