"""Named queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .errors import dlq_envelope, opened, split_dlq
from .functions import codecs
from .functions import expressions as X
from .operators import fields as T
from .operators import relational as R
from .operators import shape as S
from .plans import history as H
from .plans import runner, sinks
from . import queries_formats, queries_runs  # noqa: F401  (they register themselves)
from .paths import at
from .registered import QUERIES, SQL, query, t  # noqa: F401
from .sources import custom, scan
from .sources import decode as D
from .streaming import streams

@query("SELECT event_type, sum(k)::BIGINT AS k_sum, avg(value) AS v_avg, min(value) AS v_min, max(value) AS v_max, count(*) AS n FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE value > 0) GROUP BY 1")
def flagship(spark, sf):
    df = T.add_field(t(spark, sf, "events").select("event_type", "value", "props"), {"k": "try_variant_get(try_parse_json(props), '$.k', 'bigint')"})
    out = R.aggregate(T.filter_rows(df, "value > 0"), ["event_type"], {"k_sum": "sum:k", "v_avg": "avg:value", "v_min": "min:value", "v_max": "max:value", "n": {"op": "count"}})
    return R.sort(out, ["event_type"])


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def rename_customer(spark, sf):
    return T.rename(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), {"c_name": "name", "c_acctbal": "balance", "missing": "x"})


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice, p_size % 2 = 0 AS flag FROM part")
def cast_part(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no").alias("flag"))
    return T.cast(df, {"p_size": "int", "p_retailprice": "float", "flag": "bool"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def add_field_lineitem(spark, sf):
    df = T.add_field(t(spark, sf, "lineitem"), {"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"})
    return df.select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def drop_conditional_orders(spark, sf):
    return T.drop(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": ["1-URGENT", "5-LOW"]})


@query("SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type IN ('click', 'purchase', 'view')")
def filter_events(spark, sf):
    return T.filter_rows(t(spark, sf, "events").select("event_id", "event_type", "value"), "value > 50 and event_type in ('click', 'purchase', 'view')")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders")
def value_map_status(spark, sf):
    return T.value_map(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "final", "O": "open"}, default="other")


@query("SELECT o_orderkey AS o_key, o_orderstatus AS o_d_status, o_totalprice AS o_d_p_total FROM orders")
def flatten_struct_orders(spark, sf):
    df = t(spark, sf, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("p")).alias("d")).alias("o"))
    return S.flatten(df)


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"


def _nested(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))


@query('SELECT l_orderkey, l_linenumber AS "lines.l_linenumber", l_quantity AS "lines.l_quantity" FROM lineitem')
def json_flatten_orders(spark, sf):
    return S.json_flatten(_nested(spark, sf), explode_paths=["lines"], drop_paths=["lines.l_returnflag"])


@query(_LINES)
def explode_lines(spark, sf):
    return S.explode(_nested(spark, sf), "lines").drop("l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag)::INT - 1 AS pos FROM lineitem")
def explode_index(spark, sf):
    return S.explode(_nested(spark, sf), "lines", include_index=True, index_field="pos").drop("l_returnflag")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k FROM events")
def unnest_props(spark, sf):
    df = t(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return S.unnest(df, "props", prefix="p_")


@query("SELECT l_orderkey, arg_min(l_quantity, (l_linenumber, l_quantity)) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def select_from_list_orders(spark, sf):
    return S.select_from_list(_nested(spark, sf), "lines", [{"match": {"l_returnflag": "R"}, "output": {"returned": "l_quantity"}}]).drop("lines")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS label FROM customer")
def coalesce_customer(spark, sf):
    df = T.coalesce_fields(t(spark, sf, "customer"), {"label": {"sources": ["c_mktsegment", "nope", "c_name"], "empty_values": [None, "", "BUILDING"]}})
    return df.select("c_custkey", "label")


@query("SELECT c_custkey AS id, c_name AS name, 'none' AS extra FROM customer")
def project_customer(spark, sf):
    return T.project(t(spark, sf, "customer"), {"id": "c_custkey", "name": {"source_any": ["title", "c_name"]}, "extra": {"source": "nope", "default": "none"}})


@query("SELECT event_id, 'p1' AS pipeline, 'r1' AS run FROM events")
def inject_meta_events(spark, sf):
    return T.inject_meta(t(spark, sf, "events").select("event_id"), {"pipeline_name": "p1", "run_id": "r1"}, {"pipeline": "pipeline_name", "run": "run_id"})


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n, count(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2")
def aggregate_lineitem(spark, sf):
    return R.aggregate(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"qty": "sum:l_quantity", "lo": "min:l_discount", "hi": "max:l_tax", "n": {"op": "count"}, "shipped": "count:l_shipdate"})


@query("SELECT sum(l_quantity) AS qty, count(*) AS n FROM lineitem HAVING count(*) > 0")
def aggregate_global(spark, sf):
    return R.aggregate(t(spark, sf, "lineitem"), [], {"qty": "sum:l_quantity", "n": {"op": "count"}})


@query("SELECT l_suppkey, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS first_part, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS last_part FROM lineitem GROUP BY 1")
def aggregate_first_last(spark, sf):
    return R.aggregate(t(spark, sf, "lineitem"), ["l_suppkey"], {"first_part": "first:l_partkey", "last_part": "last:l_partkey"}, order_by=["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT s_suppkey, s_nationkey, n_name AS nation_n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def enrich_supplier(spark, sf):
    return R.enrich(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), t(spark, sf, "nation"), "s_nationkey", "n_nationkey", ["n_name"], prefix="nation_")


@query("SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN NULL ELSE n_name END AS s_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON s_nationkey = n_nationkey")
def enrich_miss_null(spark, sf):
    look = t(spark, sf, "nation").filter("n_nationkey < 10")
    return R.enrich(t(spark, sf, "supplier"), look, "s_nationkey", "n_nationkey", {"n_name": "s_name"}, on_miss="null_fields").select("s_suppkey", "s_name")


_DEDUP = "SELECT user_id, event_type, arg_{0}(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"


@query(_DEDUP.format("min"))
def dedup_first(spark, sf):
    return R.deduplicate(t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "first", ["ts", "event_id"]).drop("ts")


@query(_DEDUP.format("max"))
def dedup_last(spark, sf):
    return R.deduplicate(t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "last", ["ts", "event_id"]).drop("ts")


_BRAND = "SELECT p_partkey, nullif(regexp_extract(p_brand, 'Brand#(\\d)(\\d)', 1), '') AS mfgr, nullif(regexp_extract(p_brand, 'Brand#(\\d)(\\d)', 2), '') AS line FROM part"


@query(_BRAND)
def regex_extract_part(spark, sf):
    return T.regex_extract(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", r"Brand#(?P<mfgr>\d)(?P<line>\d)").drop("p_brand")


@query(_BRAND + " WHERE regexp_matches(p_brand, 'Brand#[12](\\d)')".replace("#[12]", "#1"))
def regex_drop(spark, sf):
    return T.regex_extract(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", r"Brand#(?P<mfgr>1)(?P<line>\d)", on_no_match="drop").drop("p_brand")


@query("SELECT o_orderkey, o_orderkey::VARCHAR || ' [' || o_orderstatus || ']' AS label FROM orders")
def template_orders(spark, sf):
    return T.template(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), {"label": "{o_orderkey} [{o_orderstatus}]"}).drop("o_orderstatus")


@query("SELECT c_custkey, '***' AS c_name FROM customer")
def mask_redact(spark, sf):
    return T.mask(t(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def mask_hash(spark, sf):
    return T.mask(t(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"], mode="hash")


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '***' ELSE left(c_name, 2) || '***' || right(c_name, 2) END AS c_name FROM customer")
def mask_partial(spark, sf):
    return T.mask(t(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"], mode="partial")


_RULES = {"o_totalprice": {"required": True, "type": "float", "min": 1000, "max": 300000}, "o_orderstatus": {"allowed": ["F", "O"]}, "o_orderpriority": {"regex": "^[1-3]"}}
_VALID = "o_totalprice >= 1000 AND o_totalprice <= 300000 AND o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[1-3]')"


@query(f"SELECT o_orderkey FROM orders WHERE {_VALID}")
def validate_orders(spark, sf):
    return T.validate(t(spark, sf, "orders"), _RULES).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'o_totalprice: below 1000' WHEN o_totalprice > 300000 THEN 'o_totalprice: above 300000' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: not allowed' WHEN NOT regexp_matches(o_orderpriority, '^[1-3]') THEN 'o_orderpriority: no match' END AS why FROM orders")
def validate_reasons(spark, sf):
    df = t(spark, sf, "orders")
    return df.select("o_orderkey", T.reason(df, _RULES).alias("why"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_limit_topn(spark, sf):
    return R.limit(R.sort(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], True, ["o_orderkey"]), 10)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_paths_props(spark, sf):
    return S.extract_paths(t(spark, sf, "events"), {"k": "$.k"}, "props", {"k": "bigint"})


@query("SELECT l_orderkey, l_linenumber, 'qty' AS metric_name, l_quantity AS metric_value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def melt_lineitem(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax")).alias("m"))
    return S.melt(df, "m", include_only=["qty", "tax", "disc"], exclude=["disc"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS ts FROM events")
def ts_normalize_iso(spark, sf):
    return T.timestamp_normalize(t(spark, sf, "events").select("event_id", "ts"), ["ts"])


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us FROM events")
def ts_epoch_detect(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    df = t(spark, sf, "events").select("event_id", F.floor(us / 1_000_000).cast("string").alias("s"), F.floor(us / 1000).alias("ms"), us.alias("us"))
    return T.timestamp_normalize(df, ["s", "ms", "us"], output_format="epoch_us")


@query("SELECT c_custkey, c_name AS text FROM customer")
def hex_text(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", codecs.hex_text(F.lower(F.hex(F.encode("c_name", "UTF-8")))).alias("text"))


@query("SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') AS digits FROM orders")
def tbcd_digits(spark, sf):
    even = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return t(spark, sf, "orders").select("o_orderkey", codecs.tbcd_digits(F.concat(F.regexp_replace(even, "(.)(.)", "$2$1"), F.lit("ff"))).alias("digits"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def bcd_timestamp(spark, sf):
    return t(spark, sf, "events").select("event_id", codecs.bcd_timestamp(F.date_format("ts", "yyMMddHHmmss")).alias("at"))


@query("SELECT o_orderkey, printf('UTC%s%02d:%02d', CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '+' END, (o_orderkey % 56) * 15 // 60, (o_orderkey % 56) * 15 % 60) || ' DST=1' AS zone FROM orders")
def tbcd_timezone(spark, sf):
    q = F.col("o_orderkey") % 56
    low = (F.floor(q / 10) + F.when(F.col("o_orderkey") % 2 == 1, 8).otherwise(0)).cast("int")
    return t(spark, sf, "orders").select("o_orderkey", codecs.tbcd_timezone(F.concat(F.lower(F.hex(q % 10)), F.lower(F.hex(low)), F.lit("01"))).alias("zone"))


@query("SELECT o_orderkey, concat_ws('.', o_orderkey // 16777216 % 256, o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) AS ip FROM orders")
def packed_ipv4(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", codecs.packed_ip(F.lpad(F.hex("o_orderkey"), 8, "0")).alias("ip"))


@query("SELECT p_partkey, array_to_string(list_filter(range(0, 8), lambda i: (p_partkey % 256 >> (7 - i)::BIGINT) & 1 = 1), ',') AS flags FROM part")
def bit_flags(spark, sf):
    flags = codecs.bit_flags(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(flags.cast("array<string>"), ",").alias("flags"))


_ROUTES = [runner.Route("big", lambda df: None, "value > 80"), runner.Route("clicks", lambda df: None, "event_type = 'click'"), runner.Route("all", lambda df: None)]


@query("SELECT event_id, 'big' AS _route FROM events WHERE value > 80 UNION ALL SELECT event_id, 'clicks' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'all' FROM events")
def route_events(spark, sf):
    return runner.routed(t(spark, sf, "events").select("event_id", "event_type", "value"), _ROUTES).select("event_id", "_route")


@query("SELECT count(*) AS records_in, count(*) FILTER (value > 80 OR event_type = 'click') AS records_out, count(*) FILTER (NOT coalesce(value > 80 OR event_type = 'click', false)) AS records_skipped FROM events")
def run_counters(spark, sf):
    return runner.run_counters(t(spark, sf, "events"), _ROUTES[:2])


@query("SELECT 'cast code to int: x' || event_id AS _error, 'transform' AS _stage, 'p' AS _pipeline, 'r' AS _run_id, '{\"event_id\":' || event_id || ',\"code\":\"x' || event_id || '\"}' AS record, NULL::VARCHAR AS raw, true AS timed FROM events WHERE event_id % 7 = 0")
def dlq_events(spark, sf):
    df = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")).alias("code"))
    _, bad = split_dlq(T.cast(opened(df), {"code": "int"}))
    return dlq_envelope(bad, "transform", "p", "r").select("_error", "_stage", "_pipeline", "_run_id", "record", "raw", F.col("_timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$").alias("timed"))


@query("SELECT coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END, ''), 'unknown') AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_unknown(spark, sf):
    k = F.col("o_orderkey") % 3
    df = t(spark, sf, "orders").select(F.when(k == 0, "").when(k == 1, None).otherwise(F.col("o_orderstatus")).alias("s"))
    folder = streams.shared_folder(spark, "partitions")
    sinks.write_files(df.withColumn("x", F.lit(1)), folder, partition_fields=["s"])
    return spark.read.schema("x int, s string").parquet(folder).groupBy(F.col("s").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_orders(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.upsert(df, df.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def skip_processed_orders(spark, sf):
    done = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.skip_processed(t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT doc_id, count(*) FILTER (trim(x) <> '') AS n_lines, max(i) FILTER (trim(x) <> '') AS last_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1 HAVING count(*) FILTER (trim(x) <> '') > 0")
def text_lines_documents(spark, sf):
    rows = D.decode_text(t(spark, sf, "documents").select("doc_id", "text"), "text", include_line_num=True)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("_line_num").cast("long").alias("last_line"))


@query("SELECT event_id, event_type, value FROM events")
def ndjson_events(spark, sf):
    lines = sinks.encode_json(t(spark, sf, "events").select("event_id", "event_type", "value"))
    return D.decode_ndjson(lines, "value", "struct<event_id: bigint, event_type: string, value: double>").drop("_value")


@query("SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s FROM orders")
def csv_orders(spark, sf):
    return D.decode_csv(sinks.encode_csv(t(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"]), "value", ["k", "s"])


@query("SELECT page_id, strlen(html) AS _size, base64(encode(html)) AS _raw FROM pages")
def bytes_envelope_pages(spark, sf):
    return D.decode_bytes(t(spark, sf, "pages").select("page_id", "html"), "html")


@query("SELECT event_id, event_type AS measObjLdn, user_id::VARCHAR AS users, event_id::VARCHAR AS other FROM events")
def pm_xml_rows(spark, sf):
    body = F.concat(F.lit('<m:measCollecFile xmlns:m="x"><measData><measInfo measInfoId="a"><granPeriod duration="PT900S" endTime="2024-01-01T00:00:00Z"/><measType p="1">users</measType><measValue measObjLdn="'), F.col("event_type"), F.lit('"><r p="1">'), F.col("user_id").cast("string"), F.lit('</r><r p="9">'), F.col("event_id").cast("string"), F.lit("</r>"))
    rows = D.decode_pm_xml(t(spark, sf, "events").select("event_id", body.alias("xml")), "xml")
    return rows.select("event_id", "measObjLdn", F.col("counters")["users"].alias("users"), F.col("counters")["counter_9"].alias("other"))


@query("SELECT event_id, 'auth' AS facility, 'crit' AS severity, 'host' || user_id AS host, 'msg ' || event_type AS message FROM events")
def syslog_parse(spark, sf):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<34>Oct 11 22:14:15 host"), F.col("user_id").cast("string"), F.lit(" su: msg "), F.col("event_type"))).otherwise(F.concat(F.lit("<34>1 2023-01-01T00:00:00Z host"), F.col("user_id").cast("string"), F.lit(" app 1 ID - msg "), F.col("event_type")))
    return t(spark, sf, "events").select("event_id", D.parse_syslog(line).alias("s")).select("event_id", "s.facility", "s.severity", "s.host", "s.message")


@query("SELECT event_type AS label, value AS __value__, event_id AS __timestamp_ms__ FROM events")
def prom_samples(spark, sf):
    series = t(spark, sf, "events").select(F.array(F.struct(F.array(F.struct(F.lit("job").alias("name"), F.col("event_type").alias("value"))).alias("labels"), F.array(F.struct("value", F.col("event_id").alias("timestamp"))).alias("samples"))).alias("s"))
    return D.prometheus_series_to_samples(series, "s").select(F.col("labels")["job"].alias("label"), "__value__", "__timestamp_ms__")


@query("SELECT '/a/' || event_type AS path, value AS val, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS timestamp FROM events")
def gnmi_rows(spark, sf):
    n = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("timestamp"), F.array(F.struct(F.concat(F.lit("/a/"), F.col("event_type")).alias("path"), F.col("value").alias("val"))).alias("update"))
    return D.gnmi_updates(t(spark, sf, "events").select(n.alias("n")), "n")


@query("SELECT l_orderkey, l_linenumber::VARCHAR AS _index, max(l_quantity)::VARCHAR AS qty FROM lineitem GROUP BY 1, 2")
def snmp_rows(spark, sf):
    flat = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("string").alias("q")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("qty."), F.col("l_linenumber").cast("string")), "q"))).alias("b"))
    return D.snmp_group_by_index(flat, ["l_orderkey"], "b").select("l_orderkey", "_index", F.col("columns")["qty"].alias("qty"))


@query("SELECT event_id, user_id AS in_octets, event_id::VARCHAR AS if_index FROM events")
def snmp_classify(spark, sf):
    b = F.array(F.struct(F.lit("ifInOctets.1").alias("name"), F.lit("Counter64").alias("type"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("ifIndex.1").alias("name"), F.lit("Integer32").alias("type"), F.col("event_id").cast("string").alias("value")))
    return t(spark, sf, "events").select("event_id", D.snmp_classify(b).alias("c")).select("event_id", F.col("c._metrics")["ifInOctets"].alias("in_octets"), F.col("c._labels")["ifIndex"].alias("if_index"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 > 4 THEN '1.4.' ELSE '1.3.' END || l_suppkey % 7 || '.' || l_partkey AS oid, coalesce(r_name, CASE WHEN l_suppkey % 7 > 4 THEN 'other' END) AS name, CASE WHEN l_suppkey % 7 > 4 THEN '.' || l_suppkey % 7 ELSE '' END || '.' || l_partkey AS rest FROM lineitem LEFT JOIN region ON r_regionkey = l_suppkey % 7")
def oid_resolve(spark, sf):
    names = t(spark, sf, "region").select(F.concat(F.lit("1.3."), F.col("r_regionkey").cast("string")).alias("prefix"), F.col("r_name").alias("name"))
    names = names.union(spark.range(1).select(F.lit("1.4"), F.lit("other")))
    k = F.col("l_suppkey") % 7
    oid = F.concat(F.when(k > 4, "1.4.").otherwise("1.3."), k.cast("string"), F.lit("."), F.col("l_partkey").cast("string"))
    return R.longest_prefix(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", oid.alias("oid")), names, "oid")


@query("SELECT event_id, 0::BIGINT AS seq, 'a' || event_id AS body FROM events UNION ALL SELECT event_id, 1, 'b' FROM events")
def framed_split(spark, sf):
    a = F.encode(F.concat(F.lit("a"), F.col("event_id").cast("string")), "UTF-8")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(a)), 8, "0")), a, F.unhex(F.lit("0000000162")))
    return D.split_length_delimited(t(spark, sf, "events").select("event_id", framed.alias("raw")), "raw").select("event_id", "seq", F.decode("frame", "UTF-8").alias("body"))


@query("SELECT event_id, 0::BIGINT AS seq, '04' || lower(printf('%02X', strlen(event_type))) || lower(hex(event_type)) AS body FROM events UNION ALL SELECT event_id, 1, '308002020' || lower(printf('%03X', user_id % 4096)) || '0000' FROM events UNION ALL SELECT event_id, 2, '1f810181' || '02abcd' FROM events WHERE event_id % 3 = 0")
def ber_split(spark, sf):
    kind = F.encode("event_type", "UTF-8")
    number = F.concat(F.lit("308002020"), F.lpad(F.hex(F.col("user_id") % 4096), 3, "0"), F.lit("0000"), F.when(F.col("event_id") % 3 == 0, "1f81018102abcd").otherwise(""))
    raw = F.concat(F.unhex(F.lit("04")), F.unhex(F.lpad(F.hex(F.octet_length(kind)), 2, "0")), kind, F.unhex(number))
    return D.split_ber_records(t(spark, sf, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "seq", F.lower(F.hex("frame")).alias("body"))


@query("SELECT 'ev,event_type=' || event_type || ' user_id=' || user_id || 'i ' || epoch_us(ts) // 1000 AS value FROM events")
def line_protocol(spark, sf):
    return sinks.to_line_protocol(t(spark, sf, "events"), "ev", ["event_type"], ["user_id"], "ts", "ms")


@query("""SELECT '{"index":{"_index":"ev","_id":"' || event_id || '"}}' || chr(10) || '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def bulk_ndjson(spark, sf):
    return sinks.to_bulk_ndjson(t(spark, sf, "events").select("event_id", "event_type"), "ev", "event_id")


@query("""SELECT '{"event":{"commonEventHeader":{"domain":"fault","eventId":"e' || event_id || '","sequence":' || event_id || ',"sourceName":"s","priority":"Normal"},"faultFields":{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}}' AS value FROM events""")
def ves_events(spark, sf):
    return sinks.to_ves_events(t(spark, sf, "events").select("event_id", "event_type"), "fault", "s", "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")))


@query("SELECT event_id, '1.3.1' AS oid, 'Integer32' AS type, user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, '1.3.2', 'OctetString', event_type FROM events")
def varbinds(spark, sf):
    return sinks.to_varbinds(t(spark, sf, "events"), ["event_id"], [("1.3.1", "user_id", "Integer32"), ("1.3.2", "event_type", "OctetString")])


_RUNS = "(SELECT event_id::VARCHAR AS run_id, event_type AS pipeline_name, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, ts AS started_at, ts + to_seconds(event_id % 60) AS finished_at, user_id AS records_in, user_id - user_id % 7 AS records_out, user_id % 7 AS records_skipped, user_id * 10 AS bytes_in, user_id * 5 AS bytes_out FROM events)"


def _runs(spark, sf):
    e = t(spark, sf, "events")
    ts, user = F.col("ts").cast("timestamp"), F.col("user_id")
    return e.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("pipeline_name"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("success").alias("status"), ts.alias("started_at"), F.timestamp_micros(F.unix_micros(ts) + F.col("event_id") % 60 * 1_000_000).alias("finished_at"), user.alias("records_in"), (user - user % 7).alias("records_out"), (user % 7).alias("records_skipped"), (user * 10).alias("bytes_in"), (user * 5).alias("bytes_out"))


@query(f"SELECT count(*) AS runs, count(*) FILTER (status = 'failed') AS errors, sum(records_in)::BIGINT AS records_in, sum(records_out)::BIGINT AS records_out, sum(records_skipped)::BIGINT AS records_skipped, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, round(avg(epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 2) AS avg_duration FROM {_RUNS}")
def run_totals(spark, sf):
    return H.run_totals(_runs(spark, sf))


@query(f"SELECT p.pipeline_name, count(run_id) AS runs, count(*) FILTER (status = 'failed') AS errors, coalesce(sum(records_in), 0)::BIGINT AS records_in, coalesce(sum(records_out), 0)::BIGINT AS records_out FROM (SELECT DISTINCT event_type AS pipeline_name FROM events UNION ALL SELECT 'idle') p LEFT JOIN {_RUNS} r USING (pipeline_name) GROUP BY 1")
def run_per_pipeline(spark, sf):
    runs = _runs(spark, sf)
    names = runs.select("pipeline_name").distinct().union(runs.sparkSession.range(1).select(F.lit("idle")))
    return H.run_per_pipeline(runs, names)


@query(f"SELECT finished_at, run_id, pipeline_name FROM {_RUNS} WHERE status = 'failed' ORDER BY finished_at DESC, run_id LIMIT 20 OFFSET 5")
def run_page(spark, sf):
    return H.run_page(_runs(spark, sf), status="failed", limit=20, offset=5).select(F.to_timestamp_ntz(F.col("finished_at").cast("string")).alias("finished_at"), "run_id", "pipeline_name")


_ALERTS = [{"name": "lossy", "condition": "error_rate > 0.1", "cooldown_seconds": 300}, {"name": "failed", "condition": "status = 'failed'"}]


@query(f"SELECT run_id, pipeline_name, 'lossy' AS rule FROM {_RUNS} WHERE records_in > 0 AND records_skipped / records_in > 0.1 UNION ALL SELECT run_id, pipeline_name, 'failed' FROM {_RUNS} WHERE status = 'failed'")
def alert_rules(spark, sf):
    return H.alerts(_runs(spark, sf), _ALERTS).select("run_id", "pipeline_name", "rule")


_HITS = f"(SELECT run_id, pipeline_name, 'lossy' AS rule, finished_at FROM {_RUNS} WHERE records_in > 0 AND records_skipped / records_in > 0.1 UNION ALL SELECT run_id, pipeline_name, 'failed', finished_at FROM {_RUNS} WHERE status = 'failed')"


@query(f"""WITH RECURSIVE h AS (
  SELECT pipeline_name, rule, finished_at, min(run_id) AS run_id FROM {_HITS} GROUP BY 1, 2, 3
), fired AS (
  SELECT pipeline_name, rule, min(finished_at) AS at FROM h GROUP BY 1, 2
  UNION ALL
  SELECT f.pipeline_name, f.rule, (SELECT min(h.finished_at) FROM h WHERE h.pipeline_name = f.pipeline_name AND h.rule = f.rule AND h.finished_at >= f.at + INTERVAL 300 SECOND) FROM fired f WHERE f.at IS NOT NULL
) SELECT h.run_id, h.pipeline_name, h.rule FROM fired f JOIN h ON h.pipeline_name = f.pipeline_name AND h.rule = f.rule AND h.finished_at = f.at""")
def alert_cooldown(spark, sf):
    return H.with_cooldown(H.alerts(_runs(spark, sf), _ALERTS)).select("run_id", "pipeline_name", "rule")


@query("SELECT event_type AS name, max(event_id) AS version, arg_max(props, event_id) AS body FROM events WHERE value > 10 GROUP BY 1")
def latest_version(spark, sf):
    return H.latest_version(t(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("version"), F.col("props").alias("body"), (F.col("value") > 10).alias("active")))


_NOW = "TIMESTAMP '2024-01-08 12:00:00'"


@query(f"SELECT count(*) FILTER (finished_at::DATE = {_NOW}::DATE) AS today, count(*) FILTER (finished_at > {_NOW} - INTERVAL 1 HOUR AND finished_at <= {_NOW}) AS last_hour, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM {_RUNS}")
def run_status_counts(spark, sf):
    return H.run_counts(_runs(spark, sf), F.lit("2024-01-08 12:00:00").cast("timestamp"))


@query("SELECT event_id, round_even(value, 1) AS r, abs(value - 50) AS a, sqrt(value) AS q, least(value, 50.0) AS lo FROM events")
def expressions_events(spark, sf):
    return t(spark, sf, "events").select("event_id", X.round_even("value", 1).alias("r"), F.abs(F.col("value") - 50).alias("a"), F.sqrt("value").alias("q"), X.smallest("value", F.lit(50.0)).alias("lo"))


_START = "TIMESTAMP '2024-01-01 00:00:00'"


@query(f"SELECT b.bucket, coalesce(records_out, 0)::BIGINT AS records_out, coalesce(bytes, 0)::BIGINT AS bytes FROM (SELECT unnest(range(0, 24))::INT AS bucket) b LEFT JOIN (SELECT floor((epoch_us(finished_at) - epoch_us({_START})) / 1800000000)::INT AS bucket, sum(records_out) AS records_out, sum(bytes_in + bytes_out) AS bytes FROM {_RUNS} GROUP BY 1) s USING (bucket)")
def run_sparkline(spark, sf):
    return H.run_sparkline(_runs(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"), 24, 720)


@query("SELECT c_custkey, c_name AS name, hex(encode(c_name)) AS name_hex, c_custkey::VARCHAR AS plain FROM customer")
def hex_decode_customer(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", F.hex(F.encode("c_name", "UTF-8")).alias("name"), F.col("c_custkey").cast("string").alias("plain"))
    return S.hex_decode(df, "none", [{"path": "name", "decode_as": "text"}], preserve_original=True)


@query("SELECT event_id, event_id % 1000 AS schema_id, event_type AS body FROM events")
def registry_framing(spark, sf):
    framed = sinks.registry_framing(F.encode("event_type", "UTF-8"), 7)
    own = F.concat(F.substring(framed, 1, 1), F.unhex(F.lpad(F.hex(F.col("event_id") % 1000), 8, "0")), F.substring(framed, 6, 1 << 30))
    return t(spark, sf, "events").select("event_id", D.strip_registry_framing(own).alias("s")).select("event_id", "s.schema_id", F.decode("s.payload", "UTF-8").alias("body"))


@query("SELECT event_id, unnest([user_id, event_id]) AS item FROM events")
def extract_response_events(spark, sf):
    body = F.to_json(F.struct(F.struct(F.array("user_id", "event_id").alias("items")).alias("data")))
    return scan.extract_response(t(spark, sf, "events").select("event_id", body.alias("body")), "body", "data.items", "bigint")


@query("SELECT event_type AS name, max(event_id) + 1 AS version, 'new' AS body FROM events GROUP BY 1 HAVING event_type <> 'click' UNION ALL SELECT 'fresh', 1, 'new'")
def changed_versions(spark, sf):
    old = t(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "click", "new").otherwise("old").alias("body"), F.lit(True).alias("active"))
    names = old.select("name").distinct().union(spark.range(1).select(F.lit("fresh")))
    return H.changed_versions(old, names.withColumn("body", F.lit("new")))


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS _text FROM events")
def xml_rows(spark, sf):
    body = F.concat(F.lit('<n:all xmlns:n="x"><n:row kind="'), F.col("event_type"), F.lit('">'), F.col("user_id").cast("string"), F.lit("</n:row></n:all>"))
    return D.decode_xml(t(spark, sf, "events").select("event_id", body.alias("xml")), "xml", "struct<kind: string, _text: string>", "row")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '00:1a:2b:3c:4d:' || lower(printf('%02X', o_orderkey % 256)) ELSE '0x00ff' || lower(printf('%02X', o_orderkey % 256)) END AS value FROM orders")
def snmp_values(spark, sf):
    k, low = F.col("o_orderkey") % 3, F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0")
    raw = F.when(k == 0, F.encode("o_orderpriority", "UTF-8")).when(k == 1, F.unhex(F.concat(F.lit("001a2b3c4d"), low))).otherwise(F.unhex(F.concat(F.lit("00ff"), low)))
    return t(spark, sf, "orders").select("o_orderkey", D.snmp_value_to_string(raw).alias("value"))


@query("SELECT page_id, 'p' AS pipeline, 'r' AS run_id, regexp_extract(url, '([^/]*)$', 1) AS source_filename, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS source_stem FROM pages")
def name_columns_pages(spark, sf):
    return sinks.name_columns(t(spark, sf, "pages").select("page_id", "url"), "p", "r", "url").drop("url", "source_suffix")


@query("SELECT event_id, 'cdr' AS topic, (event_id % 4)::INT AS partition, user_id + 5 AS lag FROM events")
def topic_lag(spark, sf):
    def offsets(value):
        return F.concat(F.lit('{"cdr":{"'), (F.col("event_id") % 4).cast("string"), F.lit('":'), value.cast("string"), F.lit("}}"))

    report = F.to_json(F.struct(F.array(F.struct(offsets(F.col("event_id")).alias("endOffset"), offsets(F.col("event_id") + F.col("user_id") + 5).alias("latestOffset"))).alias("sources")))
    return scan.kafka_lag(t(spark, sf, "events").select("event_id", report.alias("report")), "report")


@query("SELECT event_type AS pipeline_name, sum(user_id / (1 << (event_id % 4)::INT)) AS in_per_second, sum(event_id / (1 << (event_id % 4)::INT)) AS out_per_second, count(*) AS runs FROM events GROUP BY 1")
def live_rates(spark, sf):
    stats = t(spark, sf, "events").select(F.col("event_type").alias("pipeline_name"), F.col("event_id").alias("run_id"), F.pow(F.lit(2.0), F.col("event_id") % 4).alias("uptime_seconds"), F.col("user_id").alias("records_in"), F.col("event_id").alias("records_out"), "ts")
    return streams.live_rates(stats, F.lit("2024-01-01 00:00:00").cast("timestamp"), 1e9)


def _event_stream(spark, sf):
    # a pattern, as a stream reads a plain path only where it is a folder
    return spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1, 2")
def stream_events_agg(spark, sf):
    hours = streams.stream_buckets(_event_stream(spark, sf), "ts", "1 hour", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    return streams.finished(hours, "complete").select(F.to_timestamp_ntz(F.col("window.start").cast("string")).alias("hour"), "event_type", "n", "users")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    first = streams.stream_dedup(_event_stream(spark, sf), ["user_id", "event_type"], "ts", "36500 days")
    return streams.finished(first.select("user_id", "event_type"))


@query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 50 AND event_type = 'click'")
def stream_run(spark, sf):
    folder = streams.shared_folder(spark, "run")
    clicks = runner.Route("clicks", lambda df: df.write.mode("append").parquet(f"{folder}/out"), "event_type = 'click'")
    steps = [("filter", {"condition": "value > 50"}), ("add_field", {"fields": {"twice": "value * 2"}})]
    streams.run_stream(_event_stream(spark, sf), runner.Pipeline("p", steps, [clicks]), f"{folder}/log").awaitTermination()
    return spark.read.schema("event_id bigint, twice double").parquet(f"{folder}/out")


@query("SELECT c_custkey, c_custkey % 4 - 1 = 1 AS i, c_custkey % 3 = 0 AS d, c_custkey % 5 IN (0, 1) AS s, c_custkey % 2 = 0 AS b FROM customer")
def cast_bool_customer(spark, sf):
    k = F.col("c_custkey")
    text = F.get(F.array(*map(F.lit, ["YES", "on", " yes ", "2", "-1"])), (k % 5).cast("int"))
    df = t(spark, sf, "customer").select("c_custkey", (k % 4 - 1).alias("i"), F.when(k % 3 == 0, "1").otherwise("1.0").alias("d"), text.alias("s"), F.when(k % 2 == 0, True).when(k % 4 == 1, False).alias("b"))
    return T.cast(df, {"i": "bool", "d": "bool", "s": "bool", "b": "bool"})


@query("SELECT o_orderkey, 'a' AS metric_name, o_orderkey + 9007199254740992 AS metric_value FROM orders UNION ALL SELECT o_orderkey, 'b', (o_custkey % 100)::BIGINT FROM orders")
def melt_longs(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.struct((F.col("o_orderkey") + 2**53).alias("a"), (F.col("o_custkey") % 100).cast("int").alias("b")).alias("m"))
    return S.melt(df, "m", include_only=[])


_FACILITY = "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7']"


@query(f"SELECT event_id, CASE WHEN event_id % 208 // 8 < 24 THEN {_FACILITY}[event_id % 208 // 8 + 1] ELSE (event_id % 208 // 8)::VARCHAR END AS facility, ['emerg','alert','crit','err','warning','notice','info','debug'][event_id % 8 + 1] AS severity, 'h' AS host, 'app' AS app, CASE WHEN event_id % 3 = 1 THEN '12' WHEN event_id % 3 = 0 THEN '7' ELSE '' END AS pid, event_type || ' [x]' AS message FROM events")
def syslog_facilities(spark, sf):
    k = F.col("event_id")
    pri = F.concat(F.lit("<"), (k % 208).cast("string"), F.lit(">"))
    body = F.concat(F.col("event_type"), F.lit(" [x]"))
    new = F.concat(pri, F.lit('1 2023-01-01T00:00:00Z h app 7 ID [a b="c \\] d"][e f="g"] '), body)
    old = F.concat(pri, F.lit("Oct 11 22:14:15 h app"), F.when(k % 3 == 1, "[12]").otherwise(""), F.lit(": "), body, F.lit(" \n"))
    s_ = D.parse_syslog(F.when(k % 3 == 0, new).otherwise(old))
    return t(spark, sf, "events").select("event_id", s_.alias("s")).select("event_id", "s.facility", "s.severity", "s.host", "s.app", "s.pid", "s.message")


@query("SELECT event_id, event_id AS i, user_id / 2 AS f, event_id::VARCHAR AS s, length(event_type)::INT AS n, 2::INT AS items, (event_id + user_id)::DOUBLE AS total, user_id % 2 <> 0 AS t1, true AS t2, event_type = 'click' AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'odd' END AS pick, event_type AS deep, true AS r, true AS clock, CASE WHEN user_id % 5 = 0 THEN -1 ELSE event_id // (user_id % 5) END AS q, CASE WHEN user_id % 5 = 0 THEN -1 ELSE (-event_id) - (user_id % 5) * floor(-event_id / (user_id % 5)) END AS m FROM events")
def expression_functions(spark, sf):
    from pyspark.sql.types import ArrayType, LongType, StringType

    e = t(spark, sf, "events").withColumns({"o": F.struct(F.struct(F.col("event_type").alias("type")).alias("in")), "text": F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")), "xs": F.array(F.col("event_id").cast("double"), F.col("user_id").cast("double"))})
    clock = X.now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & (X.epoch() > 1.7e9) & (F.abs(X.epoch() * 1000 - X.epoch_ms()) < 2)
    return e.select(
        "event_id",
        X.to_int("text").alias("i"),
        X.to_float((F.col("user_id") / 2).cast("string")).alias("f"),
        X.to_str("event_id").alias("s"),
        X.length_of("event_type", StringType()).alias("n"),
        X.length_of("xs", ArrayType(LongType())).alias("items"),
        X.sum_of("xs").alias("total"),
        X.truth(F.col("user_id") % 2, LongType()).alias("t1"),
        X.truth("event_type", StringType()).alias("t2"),
        X.has_key(F.create_map("event_type", F.lit(1)), "click").alias("k"),
        F.expr("if(event_id % 2 = 0, event_type, 'odd')").alias("pick"),
        at("o.in.type").alias("deep"),
        F.rand().between(0.0, 1.0).alias("r"),
        clock.alias("clock"),
        F.coalesce(X.floor_div("event_id", F.col("user_id") % 5), F.lit(-1)).alias("q"),
        F.coalesce(X.modulo(-F.col("event_id"), F.col("user_id") % 5).cast("double"), F.lit(-1.0)).alias("m"),
    )


@query("SELECT o_orderkey, o_orderkey AS a, o_orderstatus AS b FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'x' FROM orders WHERE o_orderkey % 2 = 0")
def json_documents(spark, sf):
    one = F.to_json(F.struct(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b")))
    two = F.to_json(F.struct(F.col("o_custkey").alias("a"), F.lit("x").alias("b")))
    doc = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ["), one, F.lit(","), two, F.lit("]"))).otherwise(one)
    return D.decode_json(t(spark, sf, "orders").select("o_orderkey", doc.alias("doc")), "doc", "struct<a: bigint, b: string>")


_BROKEN = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"k\": ' || event_id WHEN 1 THEN event_id::VARCHAR ELSE props END AS doc FROM events"


@query(f"SELECT 'parse' AS _stage, 'no JSON object or array: ' || doc AS _error, base64(encode(doc)) AS raw FROM ({_BROKEN}) WHERE event_id % 4 < 2")
def parse_errors(spark, sf):
    k = F.col("event_id")
    doc = F.when(k % 4 == 0, F.concat(F.lit('{"k": '), k.cast("string"))).when(k % 4 == 1, k.cast("string")).otherwise(F.col("props"))
    _, bad = split_dlq(D.decode_json(opened(t(spark, sf, "events").select("event_id", doc.alias("doc"))), "doc", "struct<k: bigint>"))
    return dlq_envelope(bad, "parse", "p", "r").select("_stage", "_error", "raw")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'truncated frame' ELSE 'value overruns its content' END AS _error, CASE WHEN event_id % 2 = 0 THEN '0000000961' ELSE '040961' END AS raw FROM events")
def frame_errors(spark, sf):
    e = opened(t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("0000000961"))).otherwise(F.unhex(F.lit("040961"))).alias("raw")))
    _, frames = split_dlq(D.split_length_delimited(e.filter("event_id % 2 = 0"), "raw"))
    _, values = split_dlq(D.split_ber_records(e.filter("event_id % 2 = 1"), "raw"))
    bad = frames.unionByName(values)
    return bad.select("event_id", F.element_at("_errors", 1).alias("_error"), F.lower(F.hex("_raw_content")).alias("raw"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '{\"c_custkey\":' || c_custkey || '}' END AS value FROM customer")
def text_lines_sink(spark, sf):
    return sinks.encode_text(t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("_line")))


@query("SELECT c_custkey, c_name AS a, c_name AS b FROM customer")
def bytes_sink(spark, sf):
    raw = F.encode("c_name", "UTF-8")
    return t(spark, sf, "customer").select("c_custkey", F.decode(sinks.encode_bytes(F.base64(raw)), "UTF-8").alias("a"), F.decode(sinks.encode_bytes(F.hex(raw), "hex"), "UTF-8").alias("b"))


@query("SELECT event_type AS ldn, user_id::VARCHAR AS users, event_id::VARCHAR AS other FROM events")
def pm_xml_sink(spark, sf):
    """Encoded, and read again."""
    xml = sinks.encode_pm_xml(t(spark, sf, "events"), "event_type", ["user_id", "event_id"])
    rows = D.decode_pm_xml(xml.select(F.concat(F.lit("<measData>"), "value", F.lit("</measData>")).alias("x")), "x")
    return rows.select(F.col("measObjLdn").alias("ldn"), F.col("counters")["counter_1"].alias("users"), F.col("counters")["counter_2"].alias("other"))


@query("SELECT '<n><n_nationkey>' || n_nationkey || '</n_nationkey><label>' || n_name || ' &lt;&amp;&gt;</label><none></none></n>' AS value FROM nation")
def xml_sink(spark, sf):
    df = t(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" <&>")).alias("label"), F.lit(None).cast("string").alias("none"))
    return sinks.encode_xml(df, "n")


@query("SELECT n_regionkey, '<all>' || string_agg('<record><n_nationkey>' || n_nationkey || '</n_nationkey></record>', '' ORDER BY n_nationkey) || '</all>' AS value FROM nation GROUP BY 1")
def xml_documents_sink(spark, sf):
    df = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    grouped = sinks.encode_xml(df.withColumn("k", F.col("n_regionkey")).select("n_nationkey", "k"), "record", "all", ["k"], ["n_nationkey"])
    return grouped.select(F.col("k").alias("n_regionkey"), F.regexp_replace("value", "<k>\\d+</k>", "").alias("value"))


@query("SELECT event_id, user_id FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-20 00:00:00') - 600000000000")
def fresh_reports(spark, sf):
    return streams.drop_stale(t(spark, sf, "events"), 200_000, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "user_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 131072 < 65536 THEN '2001:db8::' || printf('%x', o_orderkey % 65536) ELSE '2001:db8::1:' || printf('%x', o_orderkey % 65536) END AS ip FROM orders WHERE o_orderkey % 65536 > 0")
def packed_ipv6(spark, sf):
    k = F.col("o_orderkey") % 131072
    raw = F.concat(F.lit("20010db8"), F.lit("0" * 16), F.lpad(F.hex(k), 8, "0"))
    return t(spark, sf, "orders").filter("o_orderkey % 65536 > 0").select("o_orderkey", codecs.packed_ip(raw).alias("ip"))


@query("SELECT p_partkey, array_to_string(list_transform(f, lambda i: CASE i WHEN 0 THEN 'high' WHEN 3 THEN 'mid' ELSE 'bit_' || i END), ',') AS names, array_to_string(f, ',') || '|' || array_to_string(list_transform(f, lambda i: CASE i WHEN 0 THEN 'high' WHEN 3 THEN 'mid' ELSE 'bit_' || i END), ',') AS two FROM (SELECT p_partkey, list_filter(range(0, 1 + p_partkey % 8), lambda i: (p_partkey % 256 >> (7 - i)::BIGINT) & 1 = 1) AS f FROM part)")
def bit_flag_names(spark, sf):
    raw, n = F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), 1 + F.col("p_partkey") % 8
    names = {0: "high", 3: "mid"}
    two = codecs.bit_flags(raw, n, names, "both")
    both = F.concat(F.array_join(two["indexes"].cast("array<string>"), ","), F.lit("|"), F.array_join(two["names"], ","))
    return t(spark, sf, "part").select("p_partkey", F.array_join(codecs.bit_flags(raw, n, names, "names"), ",").alias("names"), both.alias("two"))


@query("SELECT o_orderkey, 's' AS \"v_type\", o_orderstatus AS v, o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 's', o_orderstatus, o_orderkey + 1, o_custkey + 1 FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 's', o_orderstatus, -1, -1 FROM orders WHERE o_orderkey % 3 = 0")
def json_flatten_zip(spark, sf):
    k = F.col("o_orderkey")

    def several(c):
        return F.when(k % 3 == 1, F.array(c, c + 1)).when(k % 3 == 2, F.array(c)).otherwise(F.array().cast("array<bigint>"))

    df = t(spark, sf, "orders").select("o_orderkey", F.struct(F.lit("s").alias("type"), F.col("o_orderstatus").alias("value")).alias("v"), several(k).alias("a"), several(F.col("o_custkey")).alias("b"))
    return S.json_flatten(df, zip_groups=[["a", "b"]], choice_unwrap={"v": "both"}).fillna(-1, ["a", "b"])


@query("SELECT event_id, event_type, value FROM events")
def files_round_trip(spark, sf):
    """Written as lines of JSON, scanned as whole files and decoded."""
    folder = streams.shared_folder(spark, "files")
    lines = sinks.encode_json(t(spark, sf, "events").select("event_id", "event_type", "value"))
    sinks.write_files(lines, folder, "text", max_records=20_000)
    files = scan.scan_files(spark, folder, "*.txt").select("content").withColumn("content", F.decode("content", "UTF-8"))
    return D.decode_ndjson(files, "content", "struct<event_id: bigint, event_type: string, value: double>").drop("_value")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || epoch_us(o_orderdate) // 1000000 || '_' || epoch_us(o_orderdate) // 1000 || '_' || lpad((o_orderkey % 1000)::VARCHAR, 5, '0') || '_' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'unknown' END || '_p.json' AS name FROM orders")
def file_names(spark, sf):
    df = t(spark, sf, "orders").withColumn("s", F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("code")))
    return df.select("o_orderkey", sinks.file_name("{timestamp}_{epoch}_{epoch_ms}_{part}_{field.s.code}_{pipeline}.json", F.col("o_orderdate"), F.col("o_orderkey") % 1000, pipeline="p").alias("name"))


@query("SELECT o_orderstatus, max(n) <= 50 AS few, max(b) <= 2000 AS small, sum(n)::BIGINT AS n FROM (SELECT o_orderstatus, o_orderkey // 10 AS p, 1 AS n, 1 AS b FROM orders) GROUP BY 1")
def file_parts_orders(spark, sf):
    """Parts of at most 50 rows and 2,000 bytes: no part is larger, and all rows are there."""
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.spark_partition_id().alias("task"))
    parts = sinks.file_parts(df, F.lit(30) + F.col("o_orderkey") % 40, ["o_orderstatus"], 50, 2000)
    sizes = parts.groupBy("task", "o_orderstatus", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(30 + F.col("o_orderkey") % 40).alias("b"))
    return sizes.groupBy("o_orderstatus").agg((F.max("n") <= 50).alias("few"), (F.max("b") <= 2000).alias("small"), F.sum("n").alias("n"))


@query("SELECT count(*) AS records_in, count(*) FILTER (event_id % 10 <> 0 AND value <= 80) AS records_out, count(*) FILTER (event_id % 10 = 0 OR value > 80) AS records_skipped, count(*) FILTER (event_id % 10 = 0 OR value > 80) AS dlq_count, count(*) FILTER (event_id % 10 <> 0 AND value <= 80) AS written, 2::BIGINT AS messages FROM events")
def run_with_failures(spark, sf):
    """Rejected rows and those of a failing sink become dead letters, the others are written and counted."""
    folder = streams.shared_folder(spark, "run")

    def fails(df):
        raise RuntimeError("sink is down")

    k = F.col("event_id")
    df = t(spark, sf, "events").select("event_id", "value", F.when(k % 10 == 0, "x").otherwise(k.cast("string")).alias("code"))
    p = runner.Pipeline("p", [("cast", {"fields": {"code": "int"}})], [runner.Route("low", lambda x: x.write.parquet(f"{folder}/low"), "value <= 80"), runner.Route("high", fails, "value > 80")], dlq=lambda x: x.write.mode("append").parquet(f"{folder}/dlq"))
    c = runner.run_pipeline(df, p)
    dead = spark.read.schema("_stage string").parquet(f"{folder}/dlq").count()
    written = spark.read.schema("event_id bigint").parquet(f"{folder}/low").count()
    return spark.createDataFrame([(c.records_in, c.records_out, c.records_skipped, dead if dead == c.dlq_count else -1, written, len({m.split(":")[0] for m in c.errors}))], "records_in long, records_out long, records_skipped long, dlq_count long, written long, messages long")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def run_spec_orders(spark, sf):
    """A run from plain data: source, operators and sinks by name."""
    folder = streams.shared_folder(spark, "spec")
    runner.run_spec(
        spark,
        {
            "name": "orders",
            "source": {"type": "parquet", "path": f"{sf}/orders.parquet"},
            "transforms": [{"type": "filter", "condition": "o_totalprice > 1000"}, {"type": "add_field", "fields": {"twice": "o_totalprice * 2"}}],
            "sinks": [{"type": "files", "path": f"{folder}/open", "condition": "o_orderstatus = 'O'", "transforms": [{"type": "drop", "fields": ["o_custkey"]}]}],
            "dlq": {"type": "files", "path": f"{folder}/dlq", "mode": "append"},
            "on_error": "dlq",
        },
    )
    return spark.read.parquet(f"{folder}/open").select("o_orderkey", "twice")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def custom_source_and_sink(spark, sf):
    """Rows go out through a sink of one's own and come back through a source, one file a task."""
    folder = streams.shared_folder(spark, "custom")
    own = custom.data_source("json_files", "key long, name string", custom.listed_files, custom.read_json_lines, custom.write_json_lines)
    custom.write_custom(t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), own, path=folder)
    return custom.scan_custom(spark, own, path=folder)
