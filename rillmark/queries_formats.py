"""Queries of formats: what does not fit, quoted line ends, binary formats, event lists."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import dlq_envelope, opened, split_dlq
from .functions import codecs
from .plans import sinks
from .registered import query, t
from .shared import shared_folder, stored
from .sources import decode as D


@query("SELECT o_orderkey, 'row' AS kind, o_custkey::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, 'dead', 'no JSON object: ' || o_orderkey FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'row', 'last' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 'dead', 'no JSON object: null' FROM orders WHERE o_orderkey % 3 = 2")
def json_misfits(spark, sf):
    """Arrays in which numbers and nulls stand among objects: those are dead letters, the objects rows."""
    k = F.col("o_orderkey")
    one = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("v")))
    doc = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat(F.lit("["), k.cast("string"), F.lit(","), one, F.lit(',{"v":"last"}]'))).otherwise(F.concat(F.lit("["), one, F.lit(", "), k.cast("string"), F.lit(",null]")))
    good, bad = split_dlq(D.decode_json(opened(t(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))), "doc", "struct<v: string>"))
    dead = bad.select("o_orderkey", F.lit("dead").alias("kind"), F.element_at("_errors", 1).alias("value"))
    return good.select("o_orderkey", F.lit("row").alias("kind"), F.col("v").alias("value")).union(dead)


@query("SELECT event_id, event_type AS a, NULL::VARCHAR AS _value FROM events UNION ALL SELECT event_id, NULL, event_id::VARCHAR FROM events UNION ALL SELECT event_id, NULL, 'x y' FROM events UNION ALL SELECT event_id, NULL, '[1]' FROM events")
def ndjson_misfits(spark, sf):
    """Lines of an array with an object, a number, a text and a list in it."""
    line = F.concat(F.lit("\n ["), F.to_json(F.struct(F.col("event_type").alias("a"))), F.lit(", "), F.col("event_id").cast("string"), F.lit(', "x y", [1]]\n'))
    return D.decode_ndjson(t(spark, sf, "events").select("event_id", line.alias("doc")), "doc", "struct<a: string>")


def _quoted_doc() -> Column:
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""x"", y"'))
    return F.concat(F.lit("﻿id,name\r\n"), F.col("c_custkey").cast("string"), F.lit(","), name, F.lit("\r\n\r\n"), F.col("c_custkey").cast("string"), F.lit(",plain\r\n"))


@query("""SELECT c_custkey, c_custkey::VARCHAR AS id, c_name || chr(10) || '"x", y' AS name, NULL::VARCHAR AS more FROM customer UNION ALL SELECT c_custkey, c_custkey::VARCHAR, 'plain', NULL FROM customer""")
def csv_quoted(spark, sf):
    """Documents with a header, quoted line ends, delimiters and doubled quotes, and a column that they lack."""
    return D.decode_csv(t(spark, sf, "customer").select("c_custkey", _quoted_doc().alias("doc")), "doc", ["id", "name", "more"], has_header=True)


@query("SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || chr(10) || chr(10) || o_orderstatus || ',' ELSE o_orderstatus END AS s FROM orders")
def csv_records(spark, sf):
    """Files that are split by Spark within records: fields hold line ends."""
    folder = shared_folder(spark, "csv")
    s_ = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"a\n\n'), F.col("o_orderstatus"), F.lit(',"'))).otherwise(F.col("o_orderstatus"))
    t(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(","), s_).alias("value")).coalesce(2).write.text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        return stored(D.read_csv_records(spark, folder, ["k", "s"]).drop("source_path"), "rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'malformed XML: <r><c>' || event_id || '</r>' WHEN 1 THEN 'malformed performance file: <measData><measInfo><measValue><r p=' ELSE 'no CSV: ' END AS _error, CASE event_id % 4 WHEN 0 THEN '<r><c>' || event_id || '</r>' WHEN 1 THEN '<measData><measInfo><measValue><r p=' ELSE 'ff2c' END AS raw FROM events WHERE event_id % 4 < 3")
def malformed_documents(spark, sf):
    """XML, performance files and CSV that do not parse, among the dead letters with their content; what parses gives no dead letter."""
    k = F.col("event_id")
    e = t(spark, sf, "events").select("event_id", F.when(k % 4 == 0, F.concat(F.lit("<r><c>"), k.cast("string"), F.lit("</r>"))).when(k % 4 == 1, "<measData><measInfo><measValue><r p=").when(k % 4 == 2, "ff2c").otherwise("<r><c/></r>").alias("doc"))
    xml = D.decode_xml(opened(e.filter("event_id % 4 in (0, 3)")), "doc", "struct<a: string>")
    pm = D.decode_pm_xml(opened(e.filter("event_id % 4 in (1, 3)")), "doc")
    broken = D.decode_csv(opened(e.filter("event_id % 4 = 2").withColumn("doc", F.unhex("doc"))), "doc", ["a", "b"])
    out = []
    for rows in (xml, pm, broken):
        _, bad = split_dlq(rows)
        dead = dlq_envelope(bad, "parse", "p", "r")
        out.append(dead.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"), F.regexp_replace("_error", "(?s)^(no CSV: ).*", "$1").alias("_error"), F.when(F.col("_error").startswith("no CSV"), F.lower(F.hex(F.unbase64("raw")))).otherwise(F.unbase64("raw").cast("string")).alias("raw")))
    return out[0].union(out[1]).union(out[2])


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0a:0d:41:42:43:44' WHEN 1 THEN '0x4109' WHEN 2 THEN ' ~' ELSE '0x417f' END AS value FROM orders")
def snmp_line_ends(spark, sf):
    """Tabs and line ends are not printable: with them a value is an address or hex."""
    k = F.col("o_orderkey") % 4
    raw = F.unhex(F.when(k == 0, "0a0d41424344").when(k == 1, "4109").when(k == 2, "207e").otherwise("417f"))
    return t(spark, sf, "orders").select("o_orderkey", D.snmp_value_to_string(raw).alias("value"))


def _pb(number: int, body: bytes | int) -> bytes:
    """A field of the wire format, for small descriptors."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(body) if isinstance(body, int) else varint(number << 3 | 2) + varint(len(body)) + body


def _field(name: str, number: int, kind: int, repeated: bool = False, type_name: str = "") -> bytes:
    return _pb(1, name.encode()) + _pb(3, number) + _pb(4, 3 if repeated else 1) + _pb(5, kind) + (_pb(6, type_name.encode()) if type_name else b"")


def event_descriptor() -> bytes:
    """message Event { int64 event_id = 1; string event_type = 2; double value = 3; repeated sint32 steps = 4; Kind kind = 5; Inner inner = 6; map<string, int32> tags = 7; enum Kind { NONE = 0; CLICK = 1; } message Inner { bytes raw = 1; } } in package t."""
    entry = _pb(1, b"TagsEntry") + _pb(2, _field("key", 1, 9)) + _pb(2, _field("value", 2, 5)) + _pb(7, _pb(7, 1))
    inner = _pb(1, b"Inner") + _pb(2, _field("raw", 1, 12))
    kind = _pb(1, b"Kind") + _pb(2, _pb(1, b"NONE") + _pb(2, 0)) + _pb(2, _pb(1, b"CLICK") + _pb(2, 1))
    fields = [_field("event_id", 1, 3), _field("event_type", 2, 9), _field("value", 3, 1), _field("steps", 4, 17, True), _field("kind", 5, 14, False, ".t.Event.Kind"), _field("inner", 6, 11, False, ".t.Event.Inner"), _field("tags", 7, 11, True, ".t.Event.TagsEntry")]
    event = _pb(1, b"Event") + b"".join(_pb(2, f) for f in fields) + _pb(3, inner) + _pb(3, entry) + _pb(4, kind)
    return _pb(1, _pb(1, b"t.proto") + _pb(2, b"t") + _pb(4, event))


def _hex_varint(n: Column, size: int) -> Column:
    """A number in so many bytes of seven bits."""
    parts = [F.lpad(F.hex(F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if i < size - 1 else 0))), 2, "0") for i in range(size)]
    return F.concat(*parts)


def _event_message() -> Column:
    k = F.col("event_id").cast("long")
    text = F.encode("event_type", "UTF-8")
    body = F.concat(
        F.lit("08"), _hex_varint(k, 5),
        F.lit("12"), F.lpad(F.hex(F.octet_length(text)), 2, "0"), F.hex(text),
        F.lit("19" + struct.pack("<d", 0.5).hex()),
        F.lit("220401028003"),  # packed: -1, 1, 192
        F.when(F.col("event_type") == "click", "2801").otherwise(""),
        F.lit("32040a02ff00"), F.lit("3a050a01611007"), F.lit("9a0603616263"),
    )
    return F.unhex(F.when(k % 10 == 0, F.substring(body, 1, F.length(body) - 2)).otherwise(body))


@query("SELECT event_id, event_id AS id, event_type AS kind, 0.5::DOUBLE AS value, 192 AS steps, CASE WHEN event_type = 'click' THEN 'CLICK' END AS click, 'ff00' AS raw, 7 AS a, NULL::VARCHAR AS error FROM events WHERE event_id % 10 > 0 UNION ALL SELECT event_id, -1, NULL, NULL, -1, NULL, NULL, -1, 'no message: truncated message' FROM events WHERE event_id % 10 = 0")
def protobuf_events(spark, sf):
    """Messages with packed numbers, an enum, a message, a map and an unknown field; every tenth is cut off and a dead letter."""
    shape = "struct<eventId: bigint, eventType: string, value: double, steps: array<int>, kind: string, inner: struct<raw: binary>, tags: map<string, int>>"
    e = opened(t(spark, sf, "events").select("event_id", _event_message().alias("m")))
    out = D.decode_protobuf(e, "m", event_descriptor(), "t.Event", shape)
    none = F.lit(-1)
    return out.select("event_id", F.coalesce("eventId", none).alias("id"), F.col("eventType").alias("kind"), "value", F.coalesce(F.aggregate("steps", F.lit(0), lambda a, x: a + x), none).alias("steps"), F.col("kind").alias("click"), F.lower(F.hex("inner.raw")).alias("raw"), F.coalesce(F.col("tags")["a"], none).alias("a"), F.get("_errors", F.lit(0)).alias("error"))


@query("SELECT user_id % 20 AS k, event_id, event_type FROM events")
def protobuf_framed(spark, sf):
    """Many messages behind their lengths in one value, as they lie in a file."""
    message = F.concat(F.lit("08"), _hex_varint(F.col("event_id").cast("long"), 5), F.lit("12"), F.lpad(F.hex(F.octet_length("event_type")), 2, "0"), F.hex(F.encode("event_type", "UTF-8")))
    framed = F.concat(F.lpad(F.hex((F.length(message) / 2).cast("int")), 8, "0"), message)
    files = t(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.unhex(F.array_join(F.collect_list(framed), "")).alias("m"))
    out = D.decode_protobuf(files, "m", event_descriptor(), "t.Event", "struct<eventId: bigint, eventType: string>", "length_delimited")
    return out.select("k", F.col("eventId").alias("event_id"), F.col("eventType").alias("event_type"))


@query("SELECT o_orderkey, o_custkey::DOUBLE AS cust, o_orderstatus AS status, o_orderdate AS at, 'none' AS note, (o_orderkey % 3)::INT AS n FROM orders")
def avro_round_trip(spark, sf):
    """Rows as container files, read block by block by another schema: a wider type, an alias, a field left out, one with a default."""
    xs = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= F.col("o_orderkey") % 3, i))
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("old_status"), "o_orderdate", "o_totalprice", xs.alias("xs"), (F.col("o_orderkey") % 16).alias("file"))
    files = sinks.encode_avro(rows, keys=["file"])
    reader = """{"type": "record", "name": "record", "fields": [
      {"name": "o_orderkey", "type": ["null", "long"]}, {"name": "o_custkey", "type": ["null", "double"]}, {"name": "status", "aliases": ["old_status"], "type": ["null", "string"]},
      {"name": "o_orderdate", "type": ["null", {"type": "long", "logicalType": "local-timestamp-micros"}]}, {"name": "xs", "type": ["null", {"type": "array", "items": ["null", "int"]}]}, {"name": "note", "type": "string", "default": "none"}]}"""
    blocks = D.split_avro_blocks(files, "value").filter("error is null")
    shape = "struct<o_orderkey: bigint, o_custkey: double, status: string, o_orderdate: timestamp_ntz, xs: array<int>, note: string>"
    out = D.decode_avro(blocks.select("frame"), "frame", shape, reader)
    return out.select("o_orderkey", F.col("o_custkey").alias("cust"), "status", F.col("o_orderdate").alias("at"), "note", F.size(F.filter("xs", lambda x: x.isNotNull())).alias("n"))


@query("SELECT event_id, 9::BIGINT AS schema_id, event_id AS id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, NULL::VARCHAR AS error FROM events WHERE event_id % 10 > 0 UNION ALL SELECT event_id, 9, -1, NULL, NULL, 'no Avro: truncated value' FROM events WHERE event_id % 10 = 0")
def avro_framed(spark, sf):
    """Values behind the registry's framing, decoded by their writer's schema; every tenth is cut off and a dead letter."""
    schema = '{"type": "record", "name": "E", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string"}, {"name": "value", "type": ["null", "double"]}, {"name": "end", "type": {"type": "fixed", "name": "F", "size": 2}}]}'
    e = t(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"), F.unhex(F.lit("0102")).alias("end"))
    framed = sinks.encode_avro(e, schema, 9).select("value").withColumn("raw", D.strip_registry_framing(F.col("value")))
    whole = framed.select(F.col("raw.schema_id").alias("schema_id"), F.col("raw.payload").alias("payload"))
    own = D.decode_avro(whole.select("schema_id", F.col("payload").alias("p"), "payload"), "p", "struct<event_id: bigint>", writer=schema)
    cut = own.select("schema_id", "event_id", F.when(F.col("event_id") % 10 == 0, F.substring("payload", F.lit(1), F.octet_length("payload") - 1)).otherwise(F.col("payload")).alias("m"))
    out = D.decode_avro(opened(cut), "m", "struct<id: bigint, event_type: string, value: double>", schema.replace('"event_id"', '"id", "aliases": ["event_id"]').replace(', {"name": "end", "type": {"type": "fixed", "name": "F", "size": 2}}', ""), schema)
    return out.select("event_id", "schema_id", F.coalesce("id", F.lit(-1)).alias("id"), "event_type", "value", F.get("_errors", F.lit(0)).alias("error"))


@query("""SELECT k, '{"eventList":[' || string_agg('{"event":{"commonEventHeader":{"domain":"fault","eventId":"e' || event_id || '","eventName":"fault_s","lastEpochMicrosec":' || us || ',"priority":"Normal","reportingEntityName":"r","sequence":' || seq || ',"sourceName":"s","startEpochMicrosec":' || us || ',"version":"4.1","vesEventListenerVersion":"7.2.1"},"faultFields":{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || k || '}}}', ',' ORDER BY seq) || ']}' AS value
FROM (SELECT event_id // 20 AS k, event_id, event_type, epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS seq FROM events) GROUP BY k""")
def ves_event_lists(spark, sf):
    """Bodies of event lists, twenty events each, with the whole common header."""
    e = t(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 20).alias("k"))
    return sinks.to_ves_lists(e, "fault", "s", ["k"], ["event_id"], F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("2024-01-01 00:00:00").cast("timestamp"), "r")


@query("SELECT o_orderkey, '2001:db8::' || CASE WHEN o_orderkey % 32 = 0 THEN '' ELSE printf('%x', o_orderkey % 32) END AS low, CASE WHEN o_orderkey % 32 = 0 THEN '::' ELSE '0:0:' || printf('%x', o_orderkey % 32) || '::1' END AS mid FROM orders")
def packed_ipv6_zero_groups(spark, sf):
    """Addresses whose runs of zero groups are compressed, those of zeros only among them: the longest run, of equal ones the first, and no single group."""
    k = F.lpad(F.hex(F.col("o_orderkey") % 32), 4, "0")
    low = F.concat(F.lit("20010db8" + "0" * 20), k)
    mid = F.when(F.col("o_orderkey") % 32 == 0, "0" * 32).otherwise(F.concat(F.lit("0" * 8), k, F.lit("0" * 16 + "0001")))
    return t(spark, sf, "orders").select("o_orderkey", codecs.packed_ip(low).alias("low"), codecs.packed_ip(mid).alias("mid"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '.tar.gz' AS source_filename, regexp_extract(url, '([^/]*)$', 1) || '.tar' AS source_stem, '.gz' AS source_suffix FROM pages")
def name_columns_suffix(spark, sf):
    """The last suffix of a name is its suffix, the rest its stem."""
    pages = t(spark, sf, "pages").select("page_id", F.concat(F.lit("s3://b/"), F.regexp_extract("url", "([^/]*)$", 1), F.lit(".tar.gz")).alias("path"))
    return sinks.name_columns(pages, "p", "r", "path").select("page_id", "source_filename", "source_stem", "source_suffix")


@query("SELECT event_id, ['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7'][event_id % 192 // 8 + 1] AS facility, ['emerg','alert','crit','err','warning','notice','info','debug'][event_id % 8 + 1] AS severity, CASE WHEN event_id % 2 = 0 THEN '2024-01-02T03:04:05Z' ELSE 'Jan  2 03:04:05' END AS timestamp, 'h' || user_id AS host, event_type AS app, CASE WHEN event_id % 2 = 0 THEN '-' WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE '' END AS pid, 'took: ' || event_id || ' [ms]' AS message FROM events")
def syslog_messages(spark, sf):
    """Both forms of message with every facility and severity, hosts, applications and processes of their own."""
    k = F.col("event_id")
    pri, host, body = F.concat(F.lit("<"), (k % 192).cast("string"), F.lit(">")), F.concat(F.lit("h"), F.col("user_id").cast("string")), F.concat(F.lit("took: "), k.cast("string"), F.lit(" [ms]"))
    new = F.concat(pri, F.lit("1 2024-01-02T03:04:05Z "), host, F.lit(" "), F.col("event_type"), F.lit(" - ID1 - "), body)
    old = F.concat(pri, F.lit("Jan  2 03:04:05 "), host, F.lit(" "), F.col("event_type"), F.when(k % 3 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(""), F.lit(": "), body)
    s_ = D.parse_syslog(F.when(k % 2 == 0, new).otherwise(old))
    return t(spark, sf, "events").select("event_id", s_.alias("s")).select("event_id", "s.*")
