"""Commit log, ledger, partitioned writes, cooldown in blocks, progress of streams, state that expires."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rillmark.plans import cooldown, history, runner, sinks
from rillmark.plans.commits import Busy, CommitLog, Folder, Ledger, Staged
from rillmark.sources import scan
from rillmark.sources.decode import decode_ndjson
from rillmark.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_is_written_once_whatever_fails(spark, tmp_path):
    df = spark.range(100)
    calls = []

    def down(x):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("sink is down")

    log = CommitLog(spark, f"{tmp_path}/log")
    plain = []
    routes = [runner.Route("files", sinks.folder_sink(f"{tmp_path}/out", partition_fields=["k"])), runner.Route("plain", lambda x: plain.append(x.count())), runner.Route("down", down)]
    p = runner.Pipeline("p", [("add_field", {"fields": {"k": "id % 3"}})], routes, on_error="retry", retries=1)
    with pytest.raises(RuntimeError):
        runner.run_pipeline(df, p, log, "7")  # two attempts
    assert [n for n in os.listdir(f"{tmp_path}/out") if not n.startswith("_staged")] == []  # nothing is published before all sinks have done their part
    c = runner.run_pipeline(df, p, CommitLog(spark, f"{tmp_path}/log"), "7")  # another driver takes the batch up
    assert c.records_out == 100 and c.routes == {"files": 100, "plain": 100, "down": 100}
    assert plain == [100] and len(calls) == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 100
    runner.run_pipeline(df, p, CommitLog(spark, f"{tmp_path}/log"), "8")  # the same log may go on
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200 and plain == [100, 100]
    with pytest.raises(ValueError, match="exists"):
        runner.run_pipeline(df, runner.Pipeline("q", [], [runner.Route("files", sinks.folder_sink(f"{tmp_path}/out"))], on_error="retry", retries=0))
    # the numbers of a batch that was done before come from the log, also in a single pass
    one = runner.Pipeline("one", [("cast", {"fields": {"id": "int"}})], [runner.Route("f", sinks.folder_sink(f"{tmp_path}/one"), "id < 40")])
    for _ in range(2):
        c = runner.run_pipeline(df, one, CommitLog(spark, f"{tmp_path}/log"), "1")
        assert (c.records_in, c.records_out, c.records_skipped, c.routes, c.status) == (100, 40, 60, {"f": 40}, "success")
    assert spark.read.parquet(f"{tmp_path}/one").count() == 40


def test_publishing_is_taken_up_where_it_stopped(spark, tmp_path, monkeypatch):
    """A driver dies between two moves: nothing is lost and nothing is there twice."""
    sink = sinks.folder_sink(f"{tmp_path}/out", "append")
    real, moved = Folder.move, []

    def dies(self, name, target):
        if name.startswith("_staged"):
            moved.append(name)
            if len(moved) == 3:
                raise OSError("the driver died")
        real(self, name, target)

    df = spark.range(0, 50, 1, 5)
    monkeypatch.setattr(Folder, "move", dies)
    with pytest.raises(OSError):
        CommitLog(spark, f"{tmp_path}/log").once("p", "b", "r", 50, sink, df)
    assert 0 < spark.read.schema("id long").parquet(f"{tmp_path}/out").count() < 50
    monkeypatch.setattr(Folder, "move", real)
    assert CommitLog(spark, f"{tmp_path}/log").once("p", "b", "r", 0, sink, spark.range(3)) == 50  # what is staged stands, not what would be written now
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(df)
    # before it was complete, the staging folder counts for nothing
    with pytest.raises(Exception):
        CommitLog(spark, f"{tmp_path}/log").once("p", "c", "r", 1, Staged(f"{tmp_path}/out", lambda x, folder: (x.write.parquet(folder), 1 / 0), "append"), df)
    CommitLog(spark, f"{tmp_path}/log").once("p", "c", "r", 50, sink, df)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100


def test_modes_of_a_folder(spark, tmp_path):
    df = spark.range(5)
    for mode, want in (("errorifexists", 5), ("append", 10), ("overwrite", 5)):
        sinks.folder_sink(f"{tmp_path}/x", mode)(df)
        assert spark.read.parquet(f"{tmp_path}/x").count() == want
    with pytest.raises(ValueError):
        sinks.folder_sink(f"{tmp_path}/x")(df)


def test_dead_letters_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("5",), ("1",), ("zz",)], "x string")
    calls = []

    def down(x):
        calls.append(1)
        raise RuntimeError("sink is down")

    p = runner.Pipeline("p", [("cast", {"fields": {"x": "int"}})], [runner.Route("low", sinks.folder_sink(f"{tmp_path}/low", "append"), "x < 3"), runner.Route("high", down, "x >= 3")], dlq=sinks.folder_sink(f"{tmp_path}/dlq", "append"))
    for _ in range(3):
        c = runner.run_pipeline(df, p, CommitLog(spark, f"{tmp_path}/log"), "b")
        assert (c.dlq_count, c.records_out) == (2, 1)
    assert len(calls) == 1 and spark.read.parquet(f"{tmp_path}/dlq").count() == 2


def test_a_run_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = {n for n in os.listdir(shared) if n.startswith("run-")} if os.path.isdir(shared) else set()
    p = runner.Pipeline("p", [], [runner.Route("a", lambda x: x.count()), runner.Route("b", lambda x: x.count())])
    runner.run_pipeline(spark.range(10).withColumn("none", F.lit(None)), p)
    assert {n for n in os.listdir(shared) if n.startswith("run-")} == before


def test_stream_forgets_old_batches(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    for b in range(5):
        log.put("p", str(b), "r", "done", 1)
    log.forget("p", lambda b: int(b) < 3)
    fresh = CommitLog(spark, f"{tmp_path}/log")
    assert [bool(fresh.entry("p", str(b), "r")) for b in range(5)] == [False, False, False, True, True] and fresh.started("p", "9", "r")


def spec_of(tmp_path, **more):
    return {
        "name": "lines",
        "source": {"type": "files", "path": f"{tmp_path}/in", "pattern": "*.json", "skip_processed": True, "ledger": f"{tmp_path}/ledger", "source_key": "k", "lease_seconds": 3600, "patience_seconds": 1},
        "serializer_in": {"type": "json", "schema": "struct<x: int>"},
        "transforms": [{"type": "project", "fields": {"x": "x"}}],
        "sinks": [{"type": "files", "path": f"{tmp_path}/out", "mode": "append"}],
        "commit_log": f"{tmp_path}/log",
    } | more


def arrive(tmp_path, *numbers):
    os.makedirs(f"{tmp_path}/in", exist_ok=True)
    for n in numbers:
        with open(f"{tmp_path}/in/{n}.json", "w") as f:
            f.write(json.dumps({"x": n}))


def test_ledger_of_a_run(spark, tmp_path):
    arrive(tmp_path, 1, 2)
    ledger = Ledger(spark, f"{tmp_path}/ledger", "lines", "k")
    with pytest.raises(Exception):
        runner.run_spec(spark, spec_of(tmp_path, on_error="abort", transforms=[{"type": "cast", "fields": {"source_path": "int"}}]))
    assert ledger.processed().count() == 0 and ledger.folder.names("claims") == []
    assert runner.run_spec(spark, spec_of(tmp_path)).records_out == 2
    assert runner.run_spec(spark, spec_of(tmp_path)).records_in == 0
    arrive(tmp_path, 3)
    assert runner.run_spec(spark, spec_of(tmp_path)).records_out == 1
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1,), (2,), (3,)]
    assert sorted(r["filepath"][-6:] for r in ledger.processed().collect()) == ["1.json", "2.json", "3.json"] and ledger.folder.names("claims") == []
    ledger.compact()
    assert ledger.processed().count() == 3 and len(ledger.folder.names("processed")) == 1


def test_two_runs_do_not_take_one_file(spark, tmp_path):
    arrive(tmp_path, 1, 2)
    from rillmark.sources import scan

    a, b = (Ledger(spark, f"{tmp_path}/ledger", "p", "k", patience=0.2) for _ in range(2))
    _, first = a.claim(scan.scan_files(spark, f"{tmp_path}/in"), "a")
    arrive(tmp_path, 3)
    _, second = b.claim(scan.scan_files(spark, f"{tmp_path}/in"), "b")
    assert first.count() == 2 and [r["source_filename"] for r in second.collect()] == ["3.json"]
    a.failed("a")
    b.done("b")
    _, again = b.claim(scan.scan_files(spark, f"{tmp_path}/in"), "c")
    assert again.count() == 2
    b.folder.create("lock", "x")
    with pytest.raises(Busy):
        a.claim(scan.scan_files(spark, f"{tmp_path}/in"), "d")
    old = Ledger(spark, f"{tmp_path}/ledger", "p", "k", lease=-1, patience=5)  # a lock and claims of the past
    batch, left = old.claim(scan.scan_files(spark, f"{tmp_path}/in"), "e")
    assert batch == "c" and left.count() == 2


def test_a_run_that_broke_off_is_taken_up(spark, tmp_path):
    """Its first sink has written, so the next run goes on under the same batch and writes the second only."""
    arrive(tmp_path, 1, 2)
    two = [{"type": "files", "path": f"{tmp_path}/out", "mode": "append"}, {"type": "files", "path": f"{tmp_path}/other", "mode": "errorifexists"}]
    os.makedirs(f"{tmp_path}/other/x")
    with pytest.raises(ValueError, match="exists"):
        runner.run_spec(spark, spec_of(tmp_path, sinks=two, on_error="abort"))
    os.rmdir(f"{tmp_path}/other/x")
    arrive(tmp_path, 3)
    assert runner.run_spec(spark, spec_of(tmp_path, sinks=two, on_error="abort")).records_out == 2
    assert runner.run_spec(spark, spec_of(tmp_path, sinks=two, on_error="abort")).records_out == 1
    for name in ("out", "other"):
        assert rows(spark.read.parquet(f"{tmp_path}/{name}")) == [(1,), (2,), (3,)]


def test_a_large_partition_value_is_written_by_all_tasks(spark, tmp_path):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "big").otherwise((F.col("id") % 70).cast("string")).alias("k"))
    sinks.write_files(df, f"{tmp_path}/o", partition_fields=["k"])
    assert len([f for f in os.listdir(f"{tmp_path}/o/k=big") if f.endswith(".parquet")]) == 4  # shuffle partitions
    assert all(len([f for f in os.listdir(f"{tmp_path}/o/{d}") if f.endswith(".parquet")]) == 1 for d in os.listdir(f"{tmp_path}/o") if d.startswith("k=") and d != "k=big")
    assert rows(spark.read.parquet(f"{tmp_path}/o").select("id")) == rows(df.select("id"))
    same = spark.range(4000).select(F.lit(1).alias("x"), F.lit("v").alias("k"))  # equal rows
    sinks.write_files(same, f"{tmp_path}/p", partition_fields=["k"])
    assert len([f for f in os.listdir(f"{tmp_path}/p/k=v") if f.endswith(".parquet")]) == 4
    sinks.write_files(same.limit(0), f"{tmp_path}/q", partition_fields=["k"])
    nested = spark.createDataFrame([(("x",), "own"), ((None,), "two")], "a struct<b: string>, a_b string")
    sinks.write_files(nested, f"{tmp_path}/r", partition_fields=["a.b", "a_b"])
    assert {(r["a_b_2"], r["a_b"]) for r in spark.read.parquet(f"{tmp_path}/r").collect()} == {("x", "own"), ("unknown", "two")}


def plain_parts(sizes, max_records, max_bytes):
    out, part, n, held = [], 1, 0, 0
    for s in sizes:
        if (max_records and n + 1 > max_records) or (max_bytes and held and held + s > max_bytes):
            part, n, held = part + 1, 0, 0
        n, held = n + 1, held + s
        out.append(part)
    return out


@pytest.mark.parametrize("max_records,max_bytes", [(7, None), (None, 50), (5, 60), (1, None), (None, 1)])
def test_file_parts_equal_the_fold(spark, max_records, max_bytes):
    rng = random.Random(3)
    data = [(i, "ab"[rng.random() < 0.3], rng.choice([0, 1, 9, 30, 70])) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sinks.file_parts(spark.createDataFrame(data, "i long, k string, n long").coalesce(1).sortWithinPartitions("i"), F.col("n"), ["k"], max_records, max_bytes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in "ab":
        own = [r for r in got if r["k"] == k]
        assert len(own) == sum(d[1] == k for d in data)
        assert [r["part"] for r in own] == plain_parts([r["n"] for r in own], max_records, max_bytes)


def plain_fired(hits):
    wait, out, last = {}, [], {}
    for r, p, at, rule, w in hits:
        wait[p, rule] = max(wait.get((p, rule), 0), w or 0)
    for r, p, at, rule, w in sorted((h for h in hits if h[2]), key=lambda h: (h[2], h[0])):
        k = (p, rule)
        if k not in last or (at - last[k]).total_seconds() >= wait[k]:
            last[k] = at
            out.append(r)
    return sorted(out)


@pytest.mark.parametrize("block", [10**6, 100, 17, 3, 1])
def test_cooldown_in_blocks_of_any_size(spark, block):
    """Dense and sparse series, ties, a cooldown over several blocks, names that are null, rules without a cooldown."""
    rng, t0 = random.Random(block), dt.datetime(2024, 1, 1)
    hits = []
    for i in range(250):
        series, wait = rng.choice([("a", 300), ("a", 300), ("b", 5000), (None, 40), ("free", 0)])
        hits.append((f"r{i:03d}", series, t0 + dt.timedelta(seconds=rng.randrange(4000)), rng.choice(["x", "y"]), wait))
    hits += [("same2", "a", t0, "x", 300), ("same1", "a", t0, "x", 300), ("late", "b", t0 + dt.timedelta(days=3), "x", 5000), ("no time", "a", None, "x", 300)]
    df = spark.createDataFrame(hits, "run_id string, pipeline_name string, finished_at timestamp, rule string, cooldown int").repartition(3)
    got = history.with_cooldown(df, block)
    assert got.columns == df.columns and sorted(r["run_id"] for r in got.collect()) == plain_fired(hits)
    assert history.with_cooldown(df.limit(0), block).count() == 0


def test_cooldown_of_a_long_series_has_short_chains(spark, monkeypatch):
    """A series of 3,000 hits without a gap, in 60 blocks: no group is larger than a block, and rounds are few."""
    t0, sizes = dt.datetime(2024, 1, 1), []
    real = cooldown.stored
    kinds: list[str] = []
    monkeypatch.setattr(cooldown, "stored", lambda df, kind: kinds.append(kind) or real(df, kind))
    hits = spark.range(3000).select(F.col("id").cast("string").alias("run_id"), F.lit("p").alias("pipeline_name"), (F.lit(t0) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("finished_at"), F.lit("r").alias("rule"), F.lit(7).alias("cooldown"))
    got = sorted(int(r["run_id"]) for r in history.with_cooldown(hits, 50).collect())
    assert got == list(range(0, 3000, 7)) and kinds.count("jump") <= 7 and not sizes


def test_alert_state_goes_after_the_cooldown(spark, tmp_path):
    """Files in the order of time: what fires is what the batch says, and in the end only the last series has state."""
    t0 = dt.datetime(2024, 1, 1)
    data = [(f"r{i:02d}", "early" if i < 6 else "late", t0 + dt.timedelta(seconds=200 * i), "rule", 300) for i in range(60)]
    df = spark.createDataFrame(data, "run_id string, pipeline_name string, finished_at timestamp, rule string, cooldown int")
    for k in range(4):
        df.filter((F.col("run_id").substr(2, 2).cast("int") / 15).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.write_batches(streams.stream_alerts(source, "1 second"), lambda x, n: got.extend(r["run_id"] for r in x.collect()), f"{tmp_path}/cp")
    q.awaitTermination(180)
    assert sorted(got) == sorted(r["run_id"] for r in history.with_cooldown(df).collect())
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 4  # the last alert of one series, and its timer


def test_folders_of_results_can_be_cleared(spark):
    from rillmark import shared

    before = len(shared.MADE)
    hits = spark.createDataFrame([(str(i), "p", dt.datetime(2024, 1, 1, 0, i), "r", 100) for i in range(9)], "run_id string, pipeline_name string, finished_at timestamp, rule string, cooldown int")
    assert history.with_cooldown(hits, 2).count() == 5
    made = shared.MADE[before:]
    assert made and all(os.path.isdir(x.removeprefix("file:")) for x in made)
    shared.clear(spark, before)
    assert len(shared.MADE) == before and not any(os.path.exists(x.removeprefix("file:")) for x in made)


def test_progress_table_feeds_lag(spark, tmp_path):
    reports = streams.ProgressTable(spark, f"{tmp_path}/reports", "rate-test")
    assert reports.table().count() == 0
    spark.streams.addListener(reports)
    try:
        (tmp_path / "in").mkdir()
        for i in range(2):
            (tmp_path / "in" / f"{i}.txt").write_text("a\nb\n")
        stream = streams.watched(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in"), "seen", bs=F.count_if(F.col("value") == "b"))
        q = stream.writeStream.queryName("rate-test").format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(reports)
    seen = streams.observed(reports.table(), "seen", "struct<n: bigint, bs: bigint>").filter("n > 0")
    assert sorted((r["batch"], r["n"], r["bs"]) for r in seen.collect()) == [(0, 2, 1), (1, 2, 1)]


def test_records_of_a_file_do_not_hold_it(spark, tmp_path):
    """A dead letter's record is its own row, whatever the file has beside it."""
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/1.json", "w") as f:
        f.write("\n".join(json.dumps({"x": n if n else "none"}) for n in range(1000)) + "\nno json\n")
    for form, text in (("ndjson", None), ("json", json.dumps([{"x": "none"}, *({"x": n} for n in range(1, 1000)), 7]))):
        if text:
            arrive(tmp_path, 1)
            with open(f"{tmp_path}/in/1.json", "w") as f:
                f.write(text)
        spec = spec_of(tmp_path, serializer_in={"type": form, "schema": "struct<x: string>"}, transforms=[{"type": "cast", "fields": {"x": "int"}}, {"type": "project", "fields": {"x": "x"}}], dlq={"type": "files", "path": f"{tmp_path}/dead-{form}"}, on_error="dlq", commit_log=f"{tmp_path}/log-{form}")
        spec["source"] = {k: spec["source"][k] for k in ("type", "path", "pattern")}
        spec["sinks"] = [{"type": "files", "path": f"{tmp_path}/out-{form}"}]
        c = runner.run_spec(spark, spec)
        assert (c.records_in, c.records_out, c.dlq_count) == (1001, 999, 2)
        dead = spark.read.parquet(f"{tmp_path}/dead-{form}").collect()
        assert all(len(r["record"]) < 600 and "1.json" in r["record"] for r in dead) and sum('"x":"none"' in r["record"] for r in dead) == 1


def test_files_by_lines_are_those_of_whole_files(spark, tmp_path):
    """The same lines and columns of files, read whole or line by line, with names that a URI encodes; a ledger claims files, not lines."""
    os.makedirs(f"{tmp_path}/in/d=1")
    for name, body in (("d=1/a b+c%20ä.txt", b'{"x":1}\r\n{"x":2}\r{"x":3}'), ("e.txt", b'\n\n{"x":4}\n'), ("none.txt", b"")):
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(body)
    whole, lines = (scan.scan_files(spark, f"{tmp_path}/in", "*.txt", True, **more) for more in ({}, {"lines": True}))
    assert lines.count() == 6 and max(len(r["content"]) for r in lines.collect()) == 7
    a, b = (sorted(map(tuple, decode_ndjson(x, "content", "struct<x: int>").collect())) for x in (whole, lines))
    assert a == b and [r[-2] for r in sorted(a, key=lambda r: r[-2])] == [1, 2, 3, 4]
    spec = {"name": "n", "source": {"type": "files", "path": f"{tmp_path}/in", "pattern": "*.txt", "recursive": True, "skip_processed": True, "ledger": f"{tmp_path}/ledger"}, "serializer_in": {"type": "ndjson", "schema": "struct<x: int>"}, "sinks": [{"type": "files", "path": f"{tmp_path}/out", "mode": "append"}]}
    assert [runner.run_spec(spark, spec).records_out for _ in range(2)] == [4, 0]
    assert Ledger(spark, f"{tmp_path}/ledger", "n", f"{tmp_path}/in").processed().count() == 2  # Spark lists no empty files
    stream = streams.run_stream_spec(spark, {**spec, "source": {"type": "files", "path": f"{tmp_path}/in/d=1", "pattern": "*.txt"}, "sinks": [{"type": "files", "path": f"{tmp_path}/streamed"}]}, f"{tmp_path}/checkpoint")
    stream.awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/streamed").collect()) == [1, 2, 3]


def test_cooldown_has_fewer_tasks_than_small_blocks(spark, monkeypatch):
    """A task takes many blocks, so that tasks grow with the rows and not with the smallness of a block."""
    parts: dict[str, int] = {}
    real = cooldown.stored
    monkeypatch.setattr(cooldown, "stored", lambda df, kind: parts.setdefault(kind, df.rdd.getNumPartitions()) and real(df, kind))
    hits = spark.range(1000).select(F.col("id").cast("string").alias("run_id"), F.lit("p").alias("pipeline_name"), F.timestamp_seconds("id").alias("finished_at"), F.lit("r").alias("rule"), F.lit(7).alias("cooldown"))
    assert sorted(int(r["run_id"]) for r in history.with_cooldown(hits, 5).collect()) == list(range(0, 1000, 7))
    assert parts["steps"] <= spark.sparkContext.defaultParallelism and parts["wants"] <= 2 * spark.sparkContext.defaultParallelism


def test_a_report_costs_few_calls_to_the_state():
    """A run has one timer, set with its first report; when it ends too early it is set anew, and otherwise the run is stale."""
    calls: list[str] = []

    class Handle:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, ms):
            calls.append(f"timer {ms}")

    class Times:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    p = streams._staleness(1)()
    p.init(Handle())
    for s in (10, 12, 11):
        got = list(p.handleInputRows(("p", "r"), iter([{"micros": s * 10**6, "uptime_seconds": 2.0, "records_in": 4, "records_out": 2}]), Times(0)))
        assert [(r["ts"], r["in_per_second"], r["stale"]) for r in got] == ([] if s == 11 else [(s * 10**6, 2.0, False)])
    assert calls == ["get", "update", "timer 13001", "get", "update", "get"]
    assert list(p.handleExpiredTimer(("p", "r"), Times(13_500), None)) == [] and calls[-1] == "timer 15001"
    assert [(r["ts"], r["stale"]) for r in p.handleExpiredTimer(("p", "r"), Times(15_001), None)] == [(12 * 10**6, True)] and Handle.value is None
