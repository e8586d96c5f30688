"""Run history: totals, rollups, buckets, pages, alerts, versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cooldown


def _since(runs: DataFrame, since: Column | None) -> DataFrame:
    return runs if since is None else runs.filter(F.col("finished_at") >= since)


def _seconds() -> Column:
    return (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6


def run_totals(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """One row of sums, the number of errors, and the mean duration to two places."""
    return _since(runs, since).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "failed").alias("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records_in", "records_out", "records_skipped", "bytes_in", "bytes_out")],
        F.round(F.avg(_seconds()), 2).alias("avg_duration"),
    )


def run_per_pipeline(runs: DataFrame, pipelines: DataFrame, since: Column | None = None) -> DataFrame:
    """A row for each pipeline, also for those that did not run; busiest first."""
    own = _since(runs, since).groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("errors"), F.sum("records_in").alias("records_in"), F.sum("records_out").alias("records_out"))
    names = ("runs", "errors", "records_in", "records_out")
    return pipelines.join(own, "pipeline_name", "left").select("pipeline_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]).orderBy(F.desc("runs"), "pipeline_name")


def run_sparkline(runs: DataFrame, since: Column, buckets: int, minutes: int) -> DataFrame:
    """records_out and bytes of equal time buckets; empty ones are there with zeros."""
    spark = runs.sparkSession
    width = minutes * 60 * 1_000_000 / buckets
    at = F.floor((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / width).cast("int")
    sums = runs.withColumn("bucket", at).filter(F.col("bucket").between(0, buckets - 1)).groupBy("bucket").agg(F.sum("records_out").alias("records_out"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes"))
    spine = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(sums, "bucket", "left").select("bucket", F.coalesce("records_out", F.lit(0)).alias("records_out"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def run_page(runs: DataFrame, pipeline: str | None = None, status: str | None = None, from_dt: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The newest first."""
    if pipeline:
        runs = runs.filter(F.col("pipeline_name") == pipeline)
    if status:
        runs = runs.filter(F.col("status") == status)
    if from_dt is not None:
        runs = runs.filter(F.col("finished_at") >= from_dt)
    return runs.orderBy(F.desc("finished_at"), "run_id").offset(offset).limit(limit)


def alerts(runs: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """run_id, pipeline_name, rule, finished_at of each run that a rule's condition holds for; error_rate is skipped / in.

    failed and duration_seconds are there for conditions as well."""
    rate = F.coalesce(F.try_divide("records_skipped", "records_in"), F.lit(0.0))
    rows = runs.withColumns({"error_rate": rate, "failed": F.col("status") == "failed"})
    if "started_at" in runs.columns:
        rows = rows.withColumn("duration_seconds", _seconds())
    hits = F.array(*[F.when(F.expr(r["condition"]), F.struct(F.lit(r["name"]).alias("rule"), F.lit(int(r.get("cooldown_seconds", 300))).alias("cooldown"))) for r in rules])
    return rows.withColumn("_r", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select("run_id", "pipeline_name", "finished_at", "_r.rule", "_r.cooldown")


def with_cooldown(hits: DataFrame, block: int = cooldown.BLOCK) -> DataFrame:
    """Hits that are not within a rule's cooldown after its last alert, in blocks of the sorted hits: see cooldown."""
    return cooldown.fired(hits, block)


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest active version of each name."""
    rows = versions.filter("active").groupBy("name").agg(F.max_by(F.struct("version", "body"), "version").alias("_v"))
    return rows.select("name", "_v.*")


def changed_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (name, body) that differ from the latest, with the next version number; unchanged ones give none."""
    old = latest_version(versions).withColumnRenamed("body", "_old")
    return new.join(old, "name", "left").filter(~F.col("body").eqNullSafe(F.col("_old"))).select("name", (F.coalesce("version", F.lit(0)) + 1).alias("version"), "body")


def run_counts(runs: DataFrame, now: Column) -> DataFrame:
    """Runs of today and of the last hour, and by status."""
    return runs.agg(F.count_if(F.to_date("finished_at") == F.to_date(now)).alias("today"), F.count_if((F.col("finished_at") > now - F.expr("interval 1 hour")) & (F.col("finished_at") <= now)).alias("last_hour"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
