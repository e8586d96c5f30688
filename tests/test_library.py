"""What the named queries do not show: error channel, sinks, scans, JDBC, streams, and queries against SQL."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rillmark import queries as Q
from rillmark.errors import dlq_envelope, opened, split_dlq
from rillmark.functions import codecs
from rillmark.operators import fields as T
from rillmark.operators import relational as R
from rillmark.operators import shape as S
from rillmark.plans import history, runner, sinks
from rillmark.registry import OPERATORS, from_record_fn, operator
from rillmark.sources import decode as D
from rillmark.sources import scan
from rillmark.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    if name == "flagship":
        a, b = (x.drop(columns="v_avg") for x in (a, b))  # the last digit of a mean depends on the order
    assert a.equals(b)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cast_errors_and_dead_letters(spark):
    df = spark.createDataFrame([("NE1", "12", "yes"), ("NE2", "12.5", "off"), ("NE3", None, "1")], "ne string, n string, b string")
    good, bad = split_dlq(T.cast(opened(df), {"n": "int", "b": "bool", "nope": "int"}))
    assert rows(good) == [("NE1", 12, True)]
    dead = dlq_envelope(bad, "transform", "p", "r").collect()
    assert {r["_error"] for r in dead} == {"cast n to int: 12.5", "cast n to int: null"} and '"ne":"NE2"' in "".join(r["record"] for r in dead)
    with pytest.raises(Exception, match="cast n to int"):
        T.cast(df, {"n": "int"}).collect()


def test_explode_unnest_and_paths(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, []), (3, None)], "id long, tags array<struct<name: string, val: long>>")
    assert rows(S.explode(df, "tags", include_index=True)) == [(1, 0, "a", 1), (1, 1, "b", 2), (3, None, None, None)]
    assert rows(S.explode(spark.createDataFrame([(1, ["x", "y"])], "id long, t array<string>"), "t")) == [(1, "x"), (1, "y")]
    nested = spark.createDataFrame([((1, (2, 3)),)], "o struct<a: long, p: struct<b: long, c: long>>")
    assert S.flatten(nested).columns == ["o_a", "o_p_b", "o_p_c"] and S.flatten(nested, max_depth=1).columns == ["o_a", "o_p"]
    assert S.unnest(nested, "o.p", prefix="x_").select("x_b", "x_c", "o").first() == (2, 3, (1,))
    assert T.rename(nested, {"o.p.b": "q.z"}).select("q.z", "o.p.c").first() == (2, 3)


def test_melt_include_and_exclude(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, ("h",)), (None, ("i",)), ({}, ("j",))], "m map<string, long>, l struct<host: string>")
    out = S.melt(df, "m", ["l"], exclude=["b"])
    assert {(r["metric_name"], r["metric_value"], r["host"]) for r in out.collect()} == {("a", 1, "h"), (None, None, None)}
    assert S.melt(df.limit(1), "m", include_only=["a"], exclude=["a"]).count() == 0


def test_sort_and_aggregate_rules(spark):
    df = spark.createDataFrame([(5,), (None,), (3,)], "age long")
    assert [r[0] for r in R.sort(df, ["age"]).collect()] == [None, 3, 5]
    assert [r[0] for r in R.sort(df, ["age"], reverse=True).collect()] == [5, 3, None]
    assert R.aggregate(df.limit(0), [], {"n": {"op": "count"}}).count() == 0
    assert R.aggregate(df, [], {"n": "count:age", "s": "sum:nope"}).first() == (2, None)


def test_codecs(spark):
    df = spark.createDataFrame([("494e56495445", "deadbeef", "130254214365f7", "c0a80101", "20010db8000000000000000000000001", "a0", "6900")], "t string, raw string, d string, ip string, ip6 string, f string, z string")
    c = df.select(codecs.hex_text(F.col("t")), codecs.hex_text(F.col("raw")), codecs.tbcd_digits(F.col("d")), codecs.packed_ip(F.col("ip")), codecs.packed_ip(F.col("ip6")), codecs.bit_flags(F.col("f"), 8, {0: "x"}, "names"), codecs.packed_ip(F.lit("00"))).first()
    assert tuple(c) == ("INVITE", "deadbeef", "31204512345 67".replace(" ", ""), "192.168.1.1", "2001:db8::1", ["x", "bit_2"], None)
    out = S.hex_decode(df.select("t", F.struct("ip").alias("s")), overrides=[{"path": "s.*", "decode_as": "ip"}])
    assert out.select("t", "s.ip").first() == ("INVITE", "192.168.1.1")


def test_timestamps(spark):
    df = spark.createDataFrame([("1704067200",), ("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00",), ("20240101",), ("no",)], "t string")
    got = [r[0] for r in T.timestamp_normalize(df, ["t"], input_format="%Y%m%d", on_error="keep").collect()]
    assert got == ["2024-01-01T00:00:00.000Z"] * 3 + ["1970-08-23T06:15:01.000Z", "no"]


def test_decoders(spark):
    bad = spark.createDataFrame([("5",), ("{",)], "x string")
    with pytest.raises(Exception, match="no JSON object"):
        D.decode_json(bad, "x", "struct<a: long>").collect()
    one = spark.createDataFrame([("<root xmlns:n='u'><n:row id='1'><v>a</v></n:row><n:row id='2'><v>b</v></n:row></root>",)], "x string")
    assert rows(D.decode_xml(one, "x", "struct<id: string, v: string>", "row")) == [("1", "a"), ("2", "b")]
    lines = spark.createDataFrame([("a\n\nb\r\nc\n",)], "x string")
    assert [tuple(r) for r in D.decode_text(lines, "x", include_line_num=True).collect()] == [("a", 1), ("b", 3), ("c", 4)]
    nd = spark.createDataFrame([('{"a": 1}\n\n[{"a": 2}, {"a": 3}]\n7',)], "x string")
    assert [tuple(r) for r in D.decode_ndjson(nd, "x", "struct<a: long>").collect()] == [(1, None), (2, None), (3, None), (None, "7")]
    raw = spark.createDataFrame([(bytearray(b"\0\0\0\0\x07xy"),), (bytearray(b"zz"),)], "v binary").select(D.strip_registry_framing(F.col("v")).alias("s")).select("s.*")
    assert [(r[0], bytes(r[1])) for r in raw.collect()] == [(7, b"xy"), (None, b"zz")]
    cut = D.split_length_delimited(spark.createDataFrame([(1, bytearray(b"\0\0\0\1a\0\0\0\5b"))], "id long, raw binary"), "raw").collect()
    assert [r["error"] for r in cut] == [None, "truncated frame"]
    s = spark.createDataFrame([("garbage",)], "m string").select(D.parse_syslog(F.col("m")).alias("s")).select("s.*").first()
    assert s["facility"] == "" and s["message"] == "garbage"


def test_files_ledger_and_partitions(spark, tmp_path):
    for n in ("a.json", "b.json", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / n).write_text('{"x": 1}')
    files = scan.scan_files(spark, f"{tmp_path}/in", "*.json")
    assert files.count() == 2
    ledger = scan.ledger_rows(files.limit(1), "p", "k")
    assert scan.scan_new_files(spark, f"{tmp_path}/in", ledger, "p", "k", "*.json").count() == 1
    df = spark.createDataFrame([(1, "SMSC"), (2, None), (3, "")], "id long, nf string")
    sinks.write_files(df, f"{tmp_path}/out", partition_fields=["nf"])
    assert {r["nf"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"SMSC", "unknown"}


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:rill;create=true"
    sinks.write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), url, "T1", mode="overwrite")
    assert rows(scan.scan_jdbc(spark, url, table="T1").filter("id > 1")) == [(2, "b")]


def test_runner_routes_and_dead_letters(spark):
    out = {}
    keep = lambda name: lambda df: out.setdefault(name, []).extend(map(tuple, df.collect()))

    def broken(df):
        raise RuntimeError("sink is down")

    p = runner.Pipeline("p", [("cast", {"fields": {"x": "int"}})], [runner.Route("high", keep("high"), "x > 3", [("add_field", {"fields": {"y": "x + 1"}})]), runner.Route("all", keep("all")), runner.Route("bad", broken, "x = 5")], dlq=keep("dlq"))
    counts = runner.run_pipeline(spark.createDataFrame([("5",), ("1",), ("zz",)], "x string"), p)
    assert sorted(out["high"]) == [(5, 6)] and sorted(out["all"]) == [(1,), (5,)] and counts["dlq_count"] == 2
    assert {d[1] for d in out["dlq"]} == {"transform", "sink"}


def test_runner_modes(spark):
    """Each on_error with a bad row and a failing sink, with and without dead letters."""
    df = spark.createDataFrame([("5",), ("1",), ("zz",)], "x string")
    step = [("cast", {"fields": {"x": "int"}})]

    def run(mode, dlq, fails, **more):
        out, calls = {"low": [], "dlq": []}, []

        def keep(name):
            return lambda rows_: out[name].extend(map(tuple, rows_.collect()))

        def flaky(rows_):
            calls.append(1)
            if len(calls) <= fails:
                raise RuntimeError("sink is down")
            out.setdefault("high", []).extend(map(tuple, rows_.collect()))

        p = runner.Pipeline("p", step, [runner.Route("low", keep("low"), "x < 3"), runner.Route("high", flaky, "x >= 3")], dlq=keep("dlq") if dlq else None, on_error=mode, **more)
        try:
            return runner.run_pipeline(df, p), out, len(calls)
        except Exception as e:
            return e, out, len(calls)

    for dlq in (False, True):
        c, out, _ = run("continue", dlq, 0)
        assert (c.records_in, c.records_out, c.records_skipped, c.dlq_count, c.routes) == (3, 2, 1, dlq, {"low": 1, "high": 1}) and c.bytes_in > c.bytes_out > 0
        assert c.errors == ["cast x to int: zz"] and len(out["dlq"]) == dlq
        c, out, _ = run("continue", dlq, 9)
        assert (c.records_in, c.records_out, c.records_skipped, c.dlq_count) == (3, 1, 2, 2 * dlq) and len(out["dlq"]) == 2 * dlq
        assert c.errors == ["cast x to int: zz", "sink high: sink is down"] and c["routes"] == {"low": 1}
        e, out, calls = run("abort", dlq, 0)
        assert isinstance(e, ValueError) and calls == 0 and out["low"] == [] and len(out["dlq"]) == dlq
        e, _, calls = run("retry", dlq, 9, retries=3)
        assert "sink is down" in str(e) and calls == 4
        c, out, calls = run("retry", dlq, 2, retries=3)
        assert calls == 3 and out["high"] == [(5,)] and c.records_out == 2
    c, out, _ = run("dlq", True, 9)
    assert {d[1] for d in out["dlq"]} == {"transform", "sink"} and {d[5] for d in out["dlq"]} == {'{"x":"zz"}', '{"x":"5"}'}
    with pytest.raises(ValueError):
        runner.Pipeline("p", [], [], on_error="dlq")
    with pytest.raises(ValueError):
        runner.Pipeline("p", [], [], on_error="never")
    c = runner.run_pipeline(df, runner.Pipeline("p", [], [runner.Route("a", lambda rows_: None)], batch_size=2))
    assert (c.records_in, c.records_out) == (2, 2)


def test_spec_of_a_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"x": 1, "s": "a"}, {"x": 7, "s": "b"}]')
    (tmp_path / "in" / "b.json").write_text("not json {{{")
    spec = {
        "name": "demo",
        "source": {"type": "local", "path": f"{tmp_path}/in", "pattern": "*.json"},
        "serializer_in": {"type": "json", "schema": "struct<x: bigint, s: string>"},
        "transforms": [{"type": "add_field", "fields": {"y": "x * 2"}}],
        "sinks": [{"type": "local", "path": f"{tmp_path}/out", "form": "json", "condition": "x > 3", "transforms": [{"type": "project", "fields": {"s": "s", "y": "y"}}]}],
        "dlq": {"type": "files", "path": f"{tmp_path}/dlq", "form": "json"},
        "on_error": "dlq",
    }
    c = runner.run_spec(spark, spec)
    assert rows(spark.read.json(f"{tmp_path}/out").select("s", "y")) == [("b", 14)]
    assert (c.records_in, c.records_out, c.records_skipped, c.dlq_count) == (3, 1, 2, 1)
    import base64

    dead = spark.read.json(f"{tmp_path}/dlq").collect()
    assert [(r["_stage"], base64.b64decode(r["raw"])) for r in dead] == [("parse", b"not json {{{")]
    for broken in ({"type": "nope"}, {"type": "local", "transforms": [{"type": "nope"}]}):
        with pytest.raises(ValueError):
            runner.pipeline_from({"name": "p", "sinks": [broken]})


def test_rolling_files(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", t0 + dt.timedelta(seconds=i)) for i in range(100)], "i long, k string, at timestamp").coalesce(1)
    by_size = sinks.file_parts(df, F.lit(10), ["k"], max_bytes=45).groupBy("k", "part").count().collect()
    assert max(r["count"] for r in by_size) == 4 and sum(r["count"] for r in by_size) == 100
    assert sorted(r["part"] for r in by_size if r["k"] == "b") == list(range(1, 10))
    by_time = sinks.file_parts(df, F.lit(1), max_seconds=25, ts="at").groupBy("part").count().collect()
    assert sorted((r["part"], r["count"]) for r in by_time) == [(1, 25), (2, 25), (3, 25), (4, 25)]
    big = sinks.file_parts(df, F.lit(99), max_bytes=50).groupBy("part").count()
    assert big.count() == 100
    sinks.write_files(df, f"{tmp_path}/o", "json", partition_fields=["k"], max_bytes=300)
    assert spark.read.json(f"{tmp_path}/o").count() == 100 and len(os.listdir(f"{tmp_path}/o/k=a")) > 3
    with pytest.raises(ValueError):
        sinks.file_name("{nope}", F.current_timestamp(), F.lit(1))


def test_longest_prefix_in_both_ways(spark, monkeypatch):
    table = spark.createDataFrame([("1.3", "a"), ("1.3.6", "b"), ("1.3.6.1", "c"), (None, "n")], "prefix string, name string")
    df = spark.createDataFrame([("1.3.6.1.2",), ("1.3.6",), ("1.30.1",), ("1.3.7",), (None,), ("1.3.7",)], "oid string")
    want = [("1.3.6.1.2", "c", ".2"), ("1.3.6", "b", ""), ("1.30.1", "1.30.1", ""), ("1.3.7", "a", ".7"), ("1.3.7", "a", ".7"), (None, None, "")]
    for most in (2000, 1):
        monkeypatch.setattr(R, "PREFIXES", most)
        assert rows(R.longest_prefix(df, table, "oid")) == sorted(want, key=str)


def test_values_of_the_record_operators(spark):
    df = spark.createDataFrame([(2, -1, 1, " yes ", "Yes", 1.0, True), (0, 1, 0, "on", None, 0.0, None)], "a int, b int, c int, d string, e string, f double, g boolean")
    got = T.cast(df, dict.fromkeys("abcdefg", "bool")).collect()
    assert [tuple(r) for r in got] == [(False, False, True, False, True, False, True), (False, True, False, True, False, False, False)]
    big = 2**53 + 1
    wide = spark.createDataFrame([((big, 3),), (None,)], "m struct<x: long, y: int>")
    assert rows(S.melt(wide, "m", include_only=[])) == sorted([("x", big), ("y", 3), (None, None)], key=str)
    assert rows(S.melt(spark.createDataFrame([((1, 0.5),)], "m struct<x: long, y: double>"), "m")) == [("x", 1.0), ("y", 0.5)]
    assert rows(S.melt(spark.createDataFrame([((1, "t"),)], "m struct<x: long, y: string>"), "m")) == [("x", "1"), ("y", "t")]
    assert S.melt(wide, "m", exclude=["x", "y"]).count() == 1
    lines = ["<110>Oct 11 22:14:15 h su[7]: m", "<104>1 2023-01-01T00:00:00Z h a 1 I - m", "<300>Oct 11 22:14:15 h su: m", '<13>1 t h a p i [x y="\\]"][z]', "<34>no"]
    got = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, m string").select("i", D.parse_syslog(F.col("m")).alias("s")).orderBy("i").select("s.facility", "s.severity", "s.app", "s.pid", "s.message").collect()]
    assert got == [("security", "info", "su", "7", "m"), ("security", "emerg", "a", "1", "m"), ("37", "warning", "su", "", "m"), ("user", "notice", "a", "p", ""), ("", "", "", "", "<34>no")]


def test_user_operator(spark):
    @operator("double_x")
    def double_x(df):
        return df.withColumn("x", F.col("x") * 2)

    assert OPERATORS["double_x"] is double_x
    fn = from_record_fn(lambda r: None if r["x"] == 1 else {"x": r["x"] + 1}, "x long")
    assert rows(fn(spark.createDataFrame([(1,), (2,)], "x long"))) == [(3,)]


def test_cooldown_batch_and_stream_agree(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(f"r{i:02d}", "a" if i % 2 else "b", t0 + dt.timedelta(seconds=70 * i), "rule", 300) for i in range(30)]
    hits = spark.createDataFrame(data, "run_id string, pipeline_name string, finished_at timestamp, rule string, cooldown int")
    want, last = set(), {}
    for r, p, at, _, wait in data:
        if p not in last or (at - last[p]).total_seconds() >= wait:
            last[p] = at
            want.add(r)
    assert {r["run_id"] for r in history.with_cooldown(hits).collect()} == want
    hits.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    q = streams.write_batches(streams.stream_alerts(spark.readStream.schema(hits.schema).parquet(f"{tmp_path}/in")), lambda df, n: got.extend(r["run_id"] for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert set(got) == want and len(got) == len(want)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = []
    p = runner.Pipeline("p", [("filter", {"condition": "value > 50"})], [runner.Route("out", lambda df: got.extend(r["event_id"] for r in df.collect()))])
    streams.run_stream(source, p, f"{tmp_path}/cp1").awaitTermination(120)
    assert sorted(got) == sorted(r[0] for r in events.filter("value > 50").select("event_id").collect())
    seen = []
    q = streams.write_batches(streams.stream_dedup(source, ["user_id"], "ts", "1000 days"), lambda df, n: seen.extend(r["user_id"] for r in df.collect()), f"{tmp_path}/cp2")
    q.awaitTermination(120)
    assert len(seen) == len(set(seen)) == events.select("user_id").distinct().count()


def test_stream_from_plain_data(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'[{{"x": {i}}}, {{"x": {i + 10}}}]')
    spec = {
        "name": "s",
        "source": {"type": "files", "path": f"{tmp_path}/in", "pattern": "*.json", "max_files": 1},
        "serializer_in": {"type": "json", "schema": "struct<x: bigint>"},
        "transforms": [{"type": "filter", "condition": "x > 0"}],
        "sinks": [{"type": "files", "path": f"{tmp_path}/out", "form": "json", "mode": "append", "transforms": [{"type": "project", "fields": {"x": "x"}}]}],
    }
    q = streams.run_stream_spec(spark, spec, f"{tmp_path}/log")
    q.awaitTermination(120)
    assert rows(spark.read.json(f"{tmp_path}/out")) == sorted([(1,), (2,), (10,), (11,), (12,)], key=str)
    assert len([p for p in q.recentProgress if p.numInputRows]) == 3


def test_live_rates(spark):
    t0 = dt.datetime(2024, 1, 1)
    stats = spark.createDataFrame([("p", "r1", 5.0, 30, 20, t0), ("p", "r1", 2.0, 3, 2, t0 - dt.timedelta(seconds=3)), ("p", "r2", 5.0, 10, 10, t0 - dt.timedelta(seconds=500))], "pipeline_name string, run_id string, uptime_seconds double, records_in long, records_out long, ts timestamp")
    now = F.lit(t0)
    assert streams.live_rates(stats, now, 30).first() == ("p", 6.0, 4.0, 2)
    assert streams.drop_stale(stats, 10, now).count() == 2


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and entry.entry(spark).count() > 0


PM = '<measData><managedElement localDn="ME=1"/><measInfo measInfoId="a"><granPeriod duration="PT900S" endTime="T"/><measType p="1">users</measType><measValue measObjLdn="x"><r p="1"> 5 </r><r p="2">z</r></measValue><measValue measObjLdn="y"><r p="1">6</r></measValue></measInfo></measData>'


def test_pm_xml_roots_cuts_and_malformed(spark):
    inner = PM.index("</measValue></measInfo>")
    texts = [PM, f'<n:all xmlns:n="u"><h/>{PM}</n:all>', PM[:inner], PM[: inner - 6], "<a><b></a>", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, xml string")
    got = D.decode_pm_xml(df, "xml", numeric_values=True, keep_malformed=True).collect()
    for i in (0, 1, 2):
        a, b = (r for r in got if r["id"] == i)
        assert (a["managedElement"], a["measInfoId"], a["measObjLdn"], a["endTime"], a["duration"]) == ("ME=1", "a", "x", "T", "PT900S")
        assert a["counters"] == {"users": "5", "counter_2": "z"} and a["numbers"] == {"users": 5.0, "counter_2": None} and b["counters"] == {"users": "6"}
    assert [(r["id"], r["counters"]) for r in got if r["id"] > 2] == [(3, None), (4, None)]
    assert D.decode_pm_xml(df, "xml").count() == 6


def test_xml_children_of_any_name(spark):
    df = spark.createDataFrame([("<r><c i='1'>t</c><d><k>v</k><k2><deep>x</deep></k2></d></r>",), ("<r>own</r>",), ("<r><c></r>",), (None,)], "x string")
    out = D.decode_xml(df, "x", "struct<i: int, k: string, _text: string>").collect()
    assert len(out) == 3 and {tuple(r) for r in out} == {(1, None, "t"), (None, "v", None), (None, None, "own")}
