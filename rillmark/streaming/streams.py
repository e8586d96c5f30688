"""Streams: the batch operators behind a checkpoint, and the stateful ones that only streams need."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..plans.commits import CommitLog, Folder
from ..plans.runner import Pipeline, by_lines, decoded, pipeline_from, run_pipeline
from ..shared import shared_folder
from ..sources import scan

KEPT = 100  # batches whose log entries stay: as many as Spark keeps of its own


def run_stream(source: DataFrame, pipeline: Pipeline, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch goes through the same runner as a batch. Without a period it ends when the input is used up.

    A commit log beside the checkpoint knows which routes a batch has written, so a batch that Spark replays writes only what is missing.
    """
    log = CommitLog(source.sparkSession, f"{checkpoint}/routes")

    def batch(df: DataFrame, number: int) -> None:
        run_pipeline(df, pipeline, log, str(number))
        if number % KEPT == 0:
            log.forget(pipeline.name, lambda b: b.isdigit() and int(b) < number - KEPT)

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_stream_spec(spark: SparkSession, spec: Mapping, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream from plain data, as run_spec for a batch. source: type files (schema of lines decoded by serializer_in, max_files, after_read) or kafka (max_offsets)."""
    own = {k: v for k, v in spec["source"].items() if k != "type"}
    lines = by_lines(spec) if STREAMS[spec["source"]["type"]] is scan.stream_files else {}
    source = STREAMS[spec["source"]["type"]](spark, **own, **lines)
    return run_stream(decoded(source, spec), pipeline_from(spec), checkpoint, every)


STREAMS = {"files": scan.stream_files, "local": scan.stream_files, "kafka": scan.scan_kafka}


def write_batches(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return source.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has put out once its input is used up, read from a folder of its own.

    In complete mode each batch replaces what was there; otherwise the file sink's log counts each batch once.
    """
    folder = shared_folder(stream.sparkSession, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out")
    else:
        query = write_batches(stream, lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/log", mode)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_buckets(df: DataFrame, ts: str, width: str, delay: str, keys: Sequence[str], *sums: Column) -> DataFrame:
    rows = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, width), *keys).agg(*sums)


class _Cooldown(StatefulProcessor):
    """The last alert of a pipeline and rule, for as long as its cooldown may matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, wait long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["finished_at", "run_id"])
        state = self.last.get() if self.last.exists() else None
        last, longest, keep = state and state[0], 0, []
        for at, wait in zip(pdf["finished_at"], pdf["cooldown"]):
            now, wait = at.value // 1000, int(wait) * 1_000_000
            fires = last is None or now - last >= wait
            last, longest = (now, wait) if fires else (last, max(longest, wait))
            keep.append(fires)
        longest = max(longest, int(pdf["cooldown"].max()) * 1_000_000)
        self.last.update((last, longest))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max((last + longest) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pdf[keep][["run_id", "pipeline_name", "rule", "finished_at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()  # no hit that can still come is within the cooldown
        return iter([])


def stream_alerts(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Alerts with their cooldown; the state of a pipeline and rule is the time of its last alert, which goes once the watermark is past its cooldown.

    Needs the RocksDB state store (see stateful).
    """
    stateful(hits.sparkSession)
    rows = hits.withColumn("finished_at", F.col("finished_at").cast("timestamp")).withWatermark("finished_at", delay)
    return rows.groupBy("pipeline_name", "rule").transformWithStateInPandas(_Cooldown(), "run_id string, pipeline_name string, rule string, finished_at timestamp", "Append", "EventTime")


def stateful(spark: SparkSession) -> None:
    """Set the state store that timers need, where none is chosen."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _staleness(interval_seconds: float) -> type[StatefulProcessor]:
    class Reports(StatefulProcessor):
        """The newest report of a run, until three intervals have passed without another."""

        # each call to the state is a message to the JVM: a run has one timer, which looks when it ends whether it ends too early

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.newest = handle, handle.getValueState("newest", "ts long, uptime double, records_in long, records_out long")

        def _row(self, key, ts: int, uptime: float, n_in: int, n_out: int, stale: bool) -> Row:
            rates = (0.0, 0.0) if stale or not uptime > 0 else (n_in / uptime, n_out / uptime)
            return Row(pipeline_name=key[0], run_id=key[1], ts=ts, in_per_second=rates[0], out_per_second=rates[1], stale=stale)

        def _due(self, ts: int) -> int:
            return int(ts // 1000 + 3000 * interval_seconds) + 1

        def handleInputRows(self, key, rows, timerValues):
            r = max(rows, key=lambda r: r["micros"])
            new = (r["micros"], r["uptime_seconds"], r["records_in"], r["records_out"])
            before = self.newest.get()
            if before is None or before[0] <= new[0]:
                self.newest.update(new)
                if before is None:
                    self.handle.registerTimer(max(self._due(new[0]), timerValues.getCurrentWatermarkInMs() + 1))
                yield self._row(key, *new, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self.newest.get()
            if self._due(last[0]) > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(self._due(last[0]))
            else:
                self.newest.clear()
                yield self._row(key, *last, True)

    return Reports


def stream_rates(stats: DataFrame, interval_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Rates of each run with every report, and once with stale = true and zeros when three intervals have passed without one.

    Time is that of the reports (ts): the watermark is the newest less `delay`. A stale run leaves the state; a later report of it begins anew.
    """
    stateful(stats.sparkSession)
    rows = stats.select("pipeline_name", "run_id", F.col("ts").cast("timestamp").alias("ts"), F.col("uptime_seconds").cast("double").alias("uptime_seconds"), F.col("records_in").cast("long").alias("records_in"), F.col("records_out").cast("long").alias("records_out"))
    rows = rows.withColumn("micros", F.unix_micros("ts"))  # times pass as numbers: no time zone of a worker touches them
    shape = "pipeline_name string, run_id string, ts long, in_per_second double, out_per_second double, stale boolean"
    out = rows.withWatermark("ts", delay).groupBy("pipeline_name", "run_id").transformWithState(_staleness(interval_seconds)(), shape, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


class ProgressTable(StreamingQueryListener):
    """Progress reports of streams as rows of a table: a file of JSON for each report, in a folder.

    Reports have what Spark tells (sources with their offsets, rates, durations, state) and the counts that `watched` asks for.
    """

    SCHEMA = "query string, run string, batch long, at timestamp, report string"

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.folder, self.name, self.spark = Folder(spark, path), name, spark

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name in (None, p.name):
            row = {"query": p.name or str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "report": p.json}
            self.folder.write(f"{p.runId}-{p.batchId}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        if not self.folder.names():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.folder.path)


def watched(source: DataFrame, name: str, **counts: Column) -> DataFrame:
    """The stream with counts that Spark takes as rows pass, for its progress reports; n counts the rows."""
    return source.observe(name, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])


def observed(progress: DataFrame, name: str, schema: str) -> DataFrame:
    """query, run, batch and the counts that `watched` took under a name, from the reports of a progress table."""
    counts = F.from_json(F.get_json_object("report", f"$.observedMetrics.{name}"), schema)
    return progress.select("query", "run", "batch", counts.alias("_c")).filter("_c is not null").select("query", "run", "batch", "_c.*")


def live_rates(stats: DataFrame, now: Column, stale_seconds: float) -> DataFrame:
    """Rates of each pipeline: totals over uptime of each run's last report, summed; a stale run counts as zero."""
    last = stats.groupBy("pipeline_name", "run_id").agg(F.max_by(F.struct("uptime_seconds", "records_in", "records_out", "ts"), "ts").alias("s"))
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("s.ts").cast("timestamp")) <= stale_seconds * 1e6

    def rate(c: str) -> Column:
        return F.sum(F.when(fresh & (F.col("s.uptime_seconds") > 0), F.col(f"s.{c}") / F.col("s.uptime_seconds")).otherwise(0.0))

    return last.groupBy("pipeline_name").agg(rate("records_in").alias("in_per_second"), rate("records_out").alias("out_per_second"), F.count(F.lit(1)).alias("runs"))


def drop_stale(stats: DataFrame, interval_seconds: float, now: Column) -> DataFrame:
    """Reports of the last three intervals."""
    return stats.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 3 * interval_seconds * 1e6)
