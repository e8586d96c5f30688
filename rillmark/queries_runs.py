"""Queries of runs and streams: each row once, ledgers, cooldowns, state that expires, progress."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import history, runner, sinks
from .plans.commits import CommitLog, Ledger
from .registered import query, t
from .registry import OPERATORS, from_record_fn, operator
from .shared import shared_folder
from .sources import scan
from .streaming import streams


def _event_files(spark, sf, folder: str, files: int) -> DataFrame:
    """Events as a folder of files in the order of time, and as a stream over them, a file at a time."""
    e = t(spark, sf, "events")
    e.repartitionByRange(files, "ts", "event_id").write.parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _fails_once(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    calls: list[int] = []

    def write(df: DataFrame) -> None:
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("sink is down")
        sink(df)

    return write


@query("SELECT 'all' AS route, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 2 UNION ALL SELECT 'low', event_type, count(*), sum(event_id)::BIGINT FROM events WHERE value < 50 GROUP BY 2")
def stream_rows_once(spark, sf):
    """The second sink fails in the first batch, so the stream ends and is started again; the first sink's rows are there once."""
    folder = shared_folder(spark, "once")
    source = _event_files(spark, sf, f"{folder}/in", 3)
    low = _fails_once(lambda df: df.write.mode("append").parquet(f"{folder}/low"))
    p = runner.Pipeline("p", [], [runner.Route("all", sinks.folder_sink(f"{folder}/all", "append")), runner.Route("low", low, "value < 50")], on_error="abort")
    for _ in range(2):
        try:
            streams.run_stream(source, p, f"{folder}/log").awaitTermination()
        except Exception as e:
            if "sink is down" not in str(e):
                raise
    parts = [spark.read.parquet(f"{folder}/{r}").select(F.lit(r).alias("route"), "event_type", "event_id") for r in ("all", "low")]
    return parts[0].union(parts[1]).groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT 'all' AS route, event_id FROM events UNION ALL SELECT 'high', event_id FROM events WHERE value >= 50 UNION ALL SELECT 'dead', event_id FROM events WHERE event_id % 10 = 0")
def retry_rows_once(spark, sf):
    """A sink that fails once is tried again; neither the other sink nor the dead letters are written a second time."""
    folder = shared_folder(spark, "retry")
    e = t(spark, sf, "events").select("event_id", "value").union(t(spark, sf, "events").filter("event_id % 10 = 0").select("event_id", F.lit(None).cast("double")))
    high = _fails_once(sinks.folder_sink(f"{folder}/high"))
    routes = [runner.Route("all", sinks.folder_sink(f"{folder}/all")), runner.Route("high", high, "value >= 50")]
    p = runner.Pipeline("p", [("validate", {"rules": {"value": {"required": True}}, "on_invalid": "error"})], routes, dlq=sinks.folder_sink(f"{folder}/dead"), on_error="retry", retries=2)
    runner.run_pipeline(e, p)
    dead = spark.read.parquet(f"{folder}/dead").select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"))
    parts = [spark.read.parquet(f"{folder}/{r}").select(F.lit(r).alias("route"), "event_id") for r in ("all", "high")]
    return parts[0].union(parts[1]).union(dead.select(F.lit("dead"), "event_id"))


@query("SELECT o_orderkey, count(*) OVER () AS rows, (SELECT count(DISTINCT o_orderkey % 7) FROM orders) AS files FROM orders")
def ledger_runs(spark, sf):
    """Files of lines, read by runs with a ledger: one that fails, one over what is there, one over nothing new, one over the rest."""
    folder = shared_folder(spark, "ledger")
    orders = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("file"))

    def arrive(which: str) -> None:
        orders.filter(which).select("file", F.to_json(F.struct("o_orderkey")).alias("value")).repartition(1).write.mode("append").partitionBy("file").text(f"{folder}/in")

    spec = {
        "name": "orders",
        "source": {"type": "files", "path": f"{folder}/in", "pattern": "*.txt", "recursive": True, "skip_processed": True, "ledger": f"{folder}/ledger"},
        "serializer_in": {"type": "ndjson", "schema": "struct<o_orderkey: bigint>"},
        "transforms": [{"type": "drop", "fields": ["_value", "length", "modificationTime", "source_filename"]}],
        "sinks": [{"type": "files", "path": f"{folder}/out", "mode": "append"}],
        "commit_log": f"{folder}/log",
    }
    arrive("file < 4")
    broken = spec | {"on_error": "abort", "transforms": [{"type": "cast", "fields": {"source_path": "int"}}]}
    try:
        runner.run_spec(spark, broken)
    except Exception as e:
        if "cast source_path" not in str(e):
            raise
    for which in (None, None, "file >= 4"):
        if which:
            arrive(which)
        runner.run_spec(spark, spec)
    done = Ledger(spark, f"{folder}/ledger", "orders", f"{folder}/in").processed().count()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("o_orderkey", F.lit(rows.count()).alias("rows"), F.lit(done).cast("long").alias("files"))


_DENSE = "(SELECT event_id::VARCHAR AS run_id, CASE WHEN event_id % 50 = 0 THEN 'rare' ELSE 'all' END AS pipeline_name, ts AS finished_at FROM events)"


@query(f"""WITH RECURSIVE h AS (
  SELECT pipeline_name, finished_at, min(run_id) AS run_id FROM {_DENSE} GROUP BY 1, 2
), fired AS (
  SELECT pipeline_name, min(finished_at) AS at FROM h GROUP BY 1
  UNION ALL
  SELECT f.pipeline_name, (SELECT min(h.finished_at) FROM h WHERE h.pipeline_name = f.pipeline_name AND h.finished_at >= f.at + INTERVAL 6 HOUR) FROM fired f WHERE f.at IS NOT NULL
) SELECT h.run_id, h.pipeline_name FROM fired f JOIN h ON h.pipeline_name = f.pipeline_name AND h.finished_at = f.at""")
def alert_cooldown_dense(spark, sf):
    """A series without a gap of one cooldown, in many blocks."""
    e = t(spark, sf, "events")
    hits = e.select(F.col("event_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 50 == 0, "rare").otherwise("all").alias("pipeline_name"), F.lit("busy").alias("rule"), F.col("ts").cast("timestamp").alias("finished_at"), F.lit(6 * 3600).alias("cooldown"))
    return history.with_cooldown(hits, 1000).select("run_id", "pipeline_name")


@query("SELECT user_id::VARCHAR AS run_id, epoch_us(max(ts)) + 3 * 86400 * 1000000::BIGINT < (SELECT epoch_us(max(ts)) FROM events) - 1000 AS stale FROM events GROUP BY 1")
def stream_stale_runs(spark, sf):
    """Reports of many runs; in the end those are stale that have not reported for three days."""
    folder = shared_folder(spark, "stale")
    stats = _event_files(spark, sf, f"{folder}/in", 4).select(F.lit("p").alias("pipeline_name"), F.col("user_id").cast("string").alias("run_id"), "ts", F.lit(2.0).alias("uptime_seconds"), F.col("event_id").alias("records_in"), F.col("user_id").alias("records_out"))
    out = streams.finished(streams.stream_rates(stats, 86_400))
    return out.groupBy("run_id").agg(F.max_by("stale", F.struct("ts", "stale")).alias("stale"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, 3 AS batches FROM events")
def stream_progress(spark, sf):
    """Counts that a stream takes as rows pass, read from the table of its progress reports."""
    folder, name = shared_folder(spark, "progress"), f"q{uuid.uuid4().hex}"
    reports = streams.ProgressTable(spark, f"{folder}/reports", name)
    spark.streams.addListener(reports)
    try:
        source = streams.watched(_event_files(spark, sf, f"{folder}/in", 3), "seen", clicks=F.count_if(F.col("event_type") == "click"), high=F.count_if(F.col("value") > 50))
        q = source.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(reports)
    counts = streams.observed(reports.table(), "seen", "struct<n: bigint, clicks: bigint, high: bigint>").filter("n > 0")
    return counts.agg(*[F.sum(c).alias(c) for c in ("n", "clicks", "high")], F.count_distinct("batch").cast("int").alias("batches"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS ids, min(n_files) >= 1 AS some FROM (SELECT *, 1 AS n_files FROM orders) GROUP BY 1")
def partitioned_orders(spark, sf):
    """Written by partition value, a value's rows by as many tasks as its share of them asks for."""
    folder = shared_folder(spark, "parts")
    sinks.write_files(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), folder, partition_fields=["o_orderstatus"])
    rows = spark.read.parquet(folder).withColumn("file", F.input_file_name())
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ids"), (F.count_distinct("file") >= 1).alias("some"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def jdbc_round_trip(spark, sf):
    """Written to a database that driver and executors open, and read by a query, in parallel by the numbers of its rows."""
    url, name = f"sqlite:///{shared_folder(spark, 'database')}/orders.db", "ORDERS"
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("K"), F.col("o_totalprice").alias("P"))
    sinks.write_jdbc(orders, url, name, mode="overwrite")
    n = scan.scan_jdbc(spark, url, query=f"SELECT coalesce(max(rowid), 0) AS n FROM {name}", customSchema="n bigint").first()["n"]
    found = scan.scan_jdbc(spark, url, table=f"(SELECT K, P, rowid AS R FROM {name} WHERE P > 1000)", partitioning={"column": "R", "lower": 1, "upper": n + 1, "n": -(-n // 500_000)})
    return found.select(F.col("K").alias("o_orderkey"), F.col("P").alias("o_totalprice"))


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, -value FROM events WHERE event_type = 'click'")
def record_function(spark, sf):
    """An operator of one's own, registered by name, from code for one record that gives none, one or two."""

    def own(record: dict):
        twice = {"event_id": record["event_id"], "twice": record["value"] * 2}
        if record["event_type"] == "view":
            return None
        return [twice, {"event_id": record["event_id"], "twice": -record["value"]}] if record["event_type"] == "click" else twice

    key = f"own_{uuid.uuid4().hex}"
    operator(key)(from_record_fn(own, "event_id long, twice double"))
    try:
        return runner.apply(t(spark, sf, "events").select("event_id", "event_type", "value"), [(key, {})])
    finally:
        del OPERATORS[key]


@query("SELECT least(500, count(*)) AS n, least(500, count(*)) AS ids FROM events")
def batch_size_events(spark, sf):
    """A run that stops after so many records."""
    folder = shared_folder(spark, "capped")
    p = runner.Pipeline("p", [], [runner.Route("all", sinks.folder_sink(f"{folder}/out"))], batch_size=500)
    runner.run_pipeline(t(spark, sf, "events"), p, CommitLog(spark, f"{folder}/log"), "one")
    runner.run_pipeline(t(spark, sf, "events"), p, CommitLog(spark, f"{folder}/log"), "one")  # done already
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_id, event_type, true AS archived FROM events")
def stream_archive(spark, sf):
    """Lines of JSON in files that a stream reads one at a time and moves away once they are done."""
    folder = shared_folder(spark, "archive")
    lines = sinks.encode_json(t(spark, sf, "events").select("event_id", "event_type"))
    lines.repartition(3).write.text(f"{folder}/in")
    spec = {
        "name": "archive",
        "source": {"type": "files", "path": f"{folder}/in", "pattern": "*.txt", "max_files": 1, "after_read": "archive", "archive_dir": f"{folder}/done"},
        "serializer_in": {"type": "ndjson", "schema": "struct<event_id: bigint, event_type: string>"},
        "transforms": [{"type": "project", "fields": {"event_id": "event_id", "event_type": "event_type"}}],
        "sinks": [{"type": "files", "path": f"{folder}/out"}],
    }
    streams.run_stream_spec(spark, spec, f"{folder}/log").awaitTermination()
    moved = scan.scan_files(spark, f"{folder}/done", "*.txt", recursive=True).count() > 0
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type", F.lit(moved).alias("archived"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, max(event_id) FROM events GROUP BY 1, 2")
def stream_dedup_ends(spark, sf):
    """Keys of a stream that expire: the first row of each, none of its repeats, and 2,500 days on, when the watermark has passed its time, one row more."""
    folder = shared_folder(spark, "dedup")
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
    last = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("interval 2500 days")).alias("ts"))
    clock = e.agg(F.lit(-1).cast("long").alias("user_id"), F.lit("clock").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 2100 days")).alias("ts"))
    for rows in (first, first, clock, clock, last):  # a batch ends the keys that the watermark before it has passed
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return streams.finished(streams.stream_dedup(source, ["user_id", "event_type"], "ts", "1000 days").filter("user_id >= 0").select("user_id", "event_type", "event_id"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_period(spark, sf):
    """A stream that looks for new files every second, until it has them all and is stopped."""
    folder = shared_folder(spark, "period")
    source = _event_files(spark, sf, f"{folder}/in", 2)
    p = runner.Pipeline("p", [], [runner.Route("all", sinks.folder_sink(f"{folder}/out"))])
    q = streams.run_stream(source, p, f"{folder}/log", every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
