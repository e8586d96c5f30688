"""Decoders: misfits among what fits, quoted line ends, broken documents, binary formats, large contents."""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmark import queries_formats as Q
from rillmark.errors import ERRORS, opened, split_dlq
from rillmark.functions import avro, protobuf
from rillmark.operators import relational as R
from rillmark.plans import sinks
from rillmark.sources import decode as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def dead(df):
    """Errors with their raw content."""
    _, bad = split_dlq(df)
    return sorted((r[ERRORS][0], bytes(r["_raw_content"])) for r in bad.collect())


def test_json_elements_that_do_not_fit(spark):
    texts = ['[1,{"a":2}]', '{"a":3}', "[]", '[[{"a":4}],"x",null,{"a":"no number"},{"b":1}]', ' [ {"a":5} ] ', "7", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    out = D.decode_json(opened(df), "x", "struct<a: long>")
    good, _ = split_dlq(out)
    assert rows(good) == sorted([(0, 2), (1, 3), (3, None), (3, None), (4, 5)], key=str)
    assert [e for e, _ in dead(out)] == ['no JSON object or array: 7', 'no JSON object: "x"', "no JSON object: 1", 'no JSON object: [{"a":4}]', "no JSON object: null"]
    assert dict(dead(out))["no JSON object: 1"] == b"1"
    with pytest.raises(Exception, match="no JSON object: 1"):
        D.decode_json(df.filter("i = 0"), "x", "struct<a: long>").collect()


def test_ndjson_elements_and_strict_lines(spark):
    df = spark.createDataFrame([('{"a": 1}\n[2, {"a": 3}, "t", null]\n"s"\n',)], "x string")
    assert rows(D.decode_ndjson(df, "x", "struct<a: long>")) == sorted([(1, None), (None, "2"), (3, None), (None, "t"), (None, "null"), (None, "s")], key=str)
    out = D.decode_ndjson(opened(df), "x", "struct<a: long>", strict=True)
    assert [e[:14] for e, _ in dead(out)] == ["no JSON object"] * 2 and split_dlq(out)[0].count() == 1


def test_csv_quotes_headers_and_errors(spark):
    texts = ['x,"a\nb"\ny,2\n', "﻿p,q\n1,2,3\n\n4\n", 'it is 5" long,1\nz,2\n', "", None, '"un\nended']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = rows(D.decode_csv(df, "x", ["a", "b"]))
    assert got == sorted([(0, "x", "a\nb"), (0, "y", "2"), (1, "p", "q"), (1, "1", "2"), (1, "4", None), (2, 'it is 5" long', "1"), (2, "z", "2"), (5, "un\nended", None)], key=str)
    assert rows(D.decode_csv(df.filter("i = 1"), "x", ["q", "nope", "p"], has_header=True)) == [(1, "2", None, "1"), (1, None, None, "4")]
    assert rows(D.decode_csv(spark.createDataFrame([("'a;b';c",)], "x string"), "x", ["a", "b"], ";", "'")) == [("a;b", "c")]
    bad = spark.createDataFrame([(bytearray(b"a,\xff\n"),), (bytearray(b"a,b"),)], "x binary")
    out = D.decode_csv(opened(bad), "x", ["a", "b"])
    assert [raw for _, raw in dead(out)] == [b"a,\xff\n"] and rows(split_dlq(out)[0]) == [("a", "b")]


@pytest.mark.parametrize("size", ["20", "64", "300", "1m"])
def test_csv_records_over_splits(spark, tmp_path, size):
    """Every split cuts records somewhere; a field longer than several splits too."""
    import csv
    import io
    import random

    rng = random.Random(5)
    want = {}
    for f in range(3):
        own = [[str(i), rng.choice(["plain", 'a "quoted" word', "line\nends\n\n", "", ",", "x" * 150 + "\n" + "y" * 90, '"'])] for i in range(40)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([["id", "v"], *own])
        (tmp_path / f"f{f}.csv").write_text(text.getvalue())
        want[f] = own
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = D.read_csv_records(spark, f"{tmp_path}/*.csv", ["id", "v"], has_header=True).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for f, own in want.items():
        assert sorted([r["id"], r["v"]] for r in got if r["source_path"].endswith(f"f{f}.csv")) == sorted(own)


def test_malformed_xml_is_a_dead_letter_where_the_channel_is_open(spark):
    df = spark.createDataFrame([("<r><c a='1'/></r>",), ("<r><c></r>",), ("",), (None,)], "x string")
    out = D.decode_xml(opened(df), "x", "struct<a: int>")
    assert dead(out) == [("malformed XML: <r><c></r>", b"<r><c></r>")] and rows(split_dlq(out)[0]) == [(1,)]
    assert rows(D.decode_xml(df, "x", "struct<a: int>")) == [(1,)]
    out = D.decode_pm_xml(opened(df), "x")
    assert [raw for _, raw in dead(out)] == [b"<r><c></r>"]


def test_frames_of_a_large_content_leave_in_portions(spark, monkeypatch):
    """48 MB of frames in one value; no batch holds more than a portion of them."""
    body = struct.pack(">I", 1 << 20) + b"\xc8" * (1 << 20)
    df = spark.createDataFrame([(1, bytearray(body * 48)), (2, None), (3, bytearray(b"\0\0\0\x01a\0\0"))], "id long, raw binary")
    got = D.split_length_delimited(df, "raw").select("id", "seq", F.length("frame").alias("n"), "error").collect()
    assert len(got) == 50 and {r["n"] for r in got if r["id"] == 1} == {1 << 20}
    assert [(r["seq"], r["error"]) for r in got if r["id"] == 3] == [(0, None), (1, "truncated frame")]
    long = bytes([0x04, 0x82, 0x01, 0x00]) + b"\xff" * 256  # lengths and bytes above 127
    values = D.split_ber_records(spark.createDataFrame([(bytearray(long + b"\x30\x80\x02\x01\x85\0\0"),)], "raw binary"), "raw").collect()
    assert [len(r["frame"]) for r in values] == [260, 7]


def test_snmp_text_is_printable_only(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"a b~", b"\n\rABCD", b"a\tb", b"\x7f", b"")], "v binary")
    assert [r[0] for r in df.select(D.snmp_value_to_string(F.col("v"))).collect()] == ["a b~", "0a:0d:41:42:43:44", "0x610962", "0x7f", ""]


# protobuf ----------------------------------------------------------------------------------------


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def decoded(raw):
    return protobuf.messages(Q.event_descriptor(), "t.Event")(raw)[0]


def test_protobuf_wire_format():
    pb = Q._pb
    assert decoded(b"") == {}
    assert decoded(b"\x08" + varint(-5)) == {"eventId": -5} and decoded(b"\x08" + varint(2**63 - 1)) == {"eventId": 2**63 - 1}
    assert decoded(b"\x20\x01" + b"\x22\x02\x02\x03") == {"steps": [-1, 1, -2]}  # apart and packed
    assert decoded(b"\x28\x01") == {"kind": "CLICK"} and decoded(b"\x28\x09") == {"kind": 9}
    assert decoded(pb(6, pb(1, b"\0")) + pb(6, b"")) == {"inner": {"raw": base64.b64encode(b"\0").decode()}}  # merged
    assert decoded(pb(7, b"") + pb(7, pb(1, b"k") + b"\x10" + varint(-1))) == {"tags": {"": 0, "k": -1}}
    assert decoded(b"\x19" + struct.pack("<d", 1.5) + b"\x5b\x08\x01\x5c" + b"\x60\x07") == {"value": 1.5}  # a group and an unknown field
    assert decoded(pb(2, "é".encode()) + pb(2, b"last") + b"\x10\x01") == {"eventType": "last"}  # a wire type that is not the field's
    for bad in (b"\x08", b"\x12\x05ab", b"\x19\0", b"\x5b\x08\x01", b"\x0f", b"\x08" + b"\xff" * 11, pb(2, b"\xff"), b"\0\0", b"\x5c"):
        with pytest.raises(ValueError):
            decoded(bad)
    with pytest.raises(LookupError):
        protobuf.messages(Q.event_descriptor(), "t.Nope")


def test_protobuf_rows_and_dead_letters(spark):
    df = spark.createDataFrame([(bytearray(b"\x08\x05"),), (bytearray(b"\x08"),), (None,), (bytearray(b""),)], "m binary")
    shape = "struct<eventId: bigint, steps: array<int>>"
    out = D.decode_protobuf(opened(df), "m", Q.event_descriptor(), "t.Event", shape)
    assert dead(out) == [("no message: truncated message", b"\x08")] and rows(split_dlq(out)[0]) == [(5, None), (None, None)]
    with pytest.raises(Exception, match="truncated message"):
        D.decode_protobuf(df, "m", Q.event_descriptor(), "t.Event", shape).collect()
    framed = spark.createDataFrame([(bytearray(b"\0\0\0\x02\x08\x05\0\0\0\x01\x08\0\0\0\x09"),)], "m binary")
    out = D.decode_protobuf(opened(framed), "m", Q.event_descriptor(), "t.Event", shape, "length_delimited")
    assert [e for e, _ in dead(out)] == ["no message: truncated message", "truncated frame"] and rows(split_dlq(out)[0]) == [(5, None)]


# avro --------------------------------------------------------------------------------------------

NODE = '{"type": "record", "name": "Node", "namespace": "n", "fields": [{"name": "v", "type": "int"}, {"name": "next", "type": ["null", "Node"]}]}'


def both_ways(schema, value, reader=None):
    own = avro.Schema(schema)
    return avro.reader(reader, schema)(avro.encode(own, own.top, value))[0]


@pytest.mark.parametrize(
    "schema,value",
    [
        ('"null"', None), ('"boolean"', True), ('"int"', -(2**31)), ('"long"', 2**63 - 1), ('"long"', -(2**63)), ('"double"', 0.1), ('"float"', 0.5), ('"string"', "é"), ('"bytes"', "AP8="),
        ('["null", "string"]', None), ('["null", "string", "double"]', 1.5), ('{"type": "array", "items": "long"}', [1, -2, 300]), ('{"type": "map", "values": {"type": "array", "items": "string"}}', {"a": ["x"], "b": []}),
        ('{"type": "enum", "name": "E", "symbols": ["A", "B"]}', "B"), ('{"type": "fixed", "name": "F", "size": 3}', "AAEC"),
        (NODE, {"v": 1, "next": {"v": 2, "next": None}}),
        ('{"type": "long", "logicalType": "timestamp-micros"}', "2024-01-31T10:20:30.000001Z"), ('{"type": "long", "logicalType": "local-timestamp-millis"}', "1969-12-31T23:59:59.500000"), ('{"type": "int", "logicalType": "date"}', "1969-12-31"),
        ('{"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}', "-12345.67"), ('{"type": "fixed", "name": "D", "size": 8, "logicalType": "decimal", "precision": 10, "scale": 3}', "0.001"),
    ],
)
def test_avro_values_both_ways(schema, value):
    assert both_ways(schema, value) == value


def test_avro_resolution():
    writer = '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}, {"name": "old", "type": "string"}, {"name": "gone", "type": {"type": "map", "values": "long"}}, {"name": "u", "type": ["null", "int"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}]}'
    reader = '{"type": "record", "name": "x.R", "fields": [{"name": "more", "type": "string", "default": "d"}, {"name": "new", "aliases": ["old"], "type": ["null", "bytes"]}, {"name": "a", "type": ["string", "double"]}, {"name": "u", "type": "long"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A"], "default": "A"}}]}'
    value = {"a": 3, "old": "x", "gone": {"k": 1}, "u": 7, "e": "B"}
    assert both_ways(writer, value, reader) == {"more": "d", "new": base64.b64encode(b"x").decode(), "a": 3.0, "u": 7, "e": "A"}
    with pytest.raises(ValueError, match="null cannot be read as long"):
        both_ways(writer, value | {"u": None}, reader)
    for r in ('"string"', '{"type": "record", "name": "R", "fields": [{"name": "z", "type": "int"}]}', '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "boolean"}]}'):
        with pytest.raises(ValueError):
            both_ways(writer, value, r)


def test_avro_containers_blocks_and_errors(spark, tmp_path):
    text = '{"type": "record", "name": "R", "fields": [{"name": "i", "type": "long"}]}'
    s = avro.Schema(text)
    for codec in ("null", "deflate"):
        c = avro.container(s, text, [{"i": i} for i in range(2500)], codec)
        parts = [b for _, b, e in avro.blocks(memoryview(c)) if e is None]
        assert len(parts) == 3 and [x["i"] for p in parts for x in avro.reader(None, None)(p)] == list(range(2500)) == [x["i"] for x in avro.reader(None, None)(c)]
        assert [e for *_, e in avro.blocks(c[:-1])][-1] == "truncated value"
    (tmp_path / "a.avro").write_bytes(c)
    (tmp_path / "b.avro").write_bytes(avro.container(s, text, []))
    assert rows(D.read_avro(spark, str(tmp_path), "struct<i: bigint>").agg(F.count("i"), F.sum("i"))) == [(2500, 2500 * 2499 // 2)]
    df = spark.createDataFrame([(bytearray(c),), (bytearray(c[:100]),), (bytearray(b"no"),), (None,)], "v binary")
    out = D.decode_avro(opened(df), "v", "struct<i: bigint>")
    assert [raw for _, raw in dead(out)] == [c[:100], b"no"] and split_dlq(out)[0].count() == 2500
    with pytest.raises(Exception, match="null is no long"):
        sinks.encode_avro(spark.createDataFrame([(None,)], "i long"), text).collect()


# prefixes, event lists ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3000])
def test_longest_prefix_of_tables_of_any_size(spark, monkeypatch, n):
    known = {"1.3": "a", "1.3.6": "b", "1.3.6.1": "c", "9": "z"} | {f"7.{i}.{i}": f"p{i}" for i in range(n)}
    table = spark.createDataFrame([*known.items(), (None, "none"), ("1.3", "A")], "prefix string, name string")
    ids = ["1.3.6.1.2", "1.3.6", "1.30.1", "1.3.7", None, "1.3.7", "7.0.0.5", f"7.{n - 1}.{n - 1}", "9", "8", ""]
    df = spark.createDataFrame([(x,) for x in ids], "oid string")

    def plain(x):
        if x is None:
            return (None, None, "")
        best = max((p for p in known if x == p or x.startswith(p + ".")), key=len, default=None)
        return (x, known[best] if best else x, x[len(best) :] if best else "")

    want = sorted(map(plain, ids), key=str)
    for lengths in (200, 1):
        monkeypatch.setattr(R, "PREFIXES", lengths)
        assert rows(R.longest_prefix(df, table, "oid")) == want
    assert rows(R.longest_prefix(df, table.limit(0), "oid")) == sorted(((x, x, "") for x in ids), key=str)


def test_event_list_header(spark):
    import json

    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string").withColumn("k", F.lit(1))
    body = json.loads(sinks.to_ves_lists(df, "fault", "src", ["k"], ["i"]).first()["value"])
    first, second = (e["event"] for e in body["eventList"])
    h = first["commonEventHeader"]
    assert sorted(h) == sorted("domain eventId eventName lastEpochMicrosec priority reportingEntityName sequence sourceName startEpochMicrosec version vesEventListenerVersion".split())
    assert (h["sequence"], second["commonEventHeader"]["sequence"], h["eventName"], h["reportingEntityName"], first["faultFields"]["s"]) == (0, 1, "fault_src", "src", "a") and h["eventId"] != second["commonEventHeader"]["eventId"]


def test_small_contents_leave_a_task_together(spark):
    """Rows of many small contents come in few batches, with each row's own columns and, if it is broken, its own content."""
    df = spark.range(20_000, numPartitions=1).select("id", F.unhex(F.when(F.col("id") % 3 == 0, "0000000961").otherwise("00000001620000000163")).alias("raw"))
    out = D.split_length_delimited(opened(df), "raw")
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long")
    assert len(sizes.collect()) <= 10
    got = out.select("id", "seq", F.hex("frame"), F.get(ERRORS, F.lit(0)), F.hex("_raw_content")).collect()
    want = [(i, *row) for i in range(20_000) for row in ([(0, None, "truncated frame", "0000000961")] if i % 3 == 0 else [(0, "62", None, None), (1, "63", None, None)])]
    assert sorted(map(tuple, got)) == want


def test_avro_of_a_key_is_held_as_its_file(spark):
    """Rows come to a container in portions, and go to one file for each key, null keys too."""
    rows = spark.range(25_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"))
    files = sinks.encode_avro(rows, keys=["k"])
    assert sorted(r["k"] or "" for r in files.select("k").collect()) == ["", "a"]
    blocks = D.split_avro_blocks(files, "value")
    assert blocks.count() == 26 and blocks.filter("error is not null").count() == 0
    got = D.decode_avro(blocks.select("k", "frame"), "frame", "struct<id: bigint>")
    assert got.filter("(k is null) != (id % 2 = 1)").count() == 0 and sorted(r["id"] for r in got.collect()) == list(range(25_000))
    seen = []
    avro.container(avro.Schema('"long"'), '"long"', (seen.append(1) or i for i in range(2500)))
    assert len(seen) == 2500


def test_small_splits_of_csv_share_tasks(spark, tmp_path):
    """However small the splits are, tasks take many of them."""
    spark.range(3000).selectExpr("concat(id, ',\"a\n', id, '\"') AS value").coalesce(1).write.text(f"{tmp_path}/in")
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        sc.setJobGroup("small splits", "")
        got = D.read_csv_records(spark, f"{tmp_path}/in", ["k", "s"]).select("k", "s").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((int(k), s) for k, s in got) == [(i, f"a\n{i}") for i in range(3000)]
    status = sc.statusTracker()
    tasks = [info.numTasks for j in status.getJobIdsForGroup("small splits") for s in status.getJobInfo(j).stageIds if (info := status.getStageInfo(s))]
    # whole lines stay in their tasks, the others are shuffled, and a union has both
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism + int(spark.conf.get("spark.sql.shuffle.partitions"))
