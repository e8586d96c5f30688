"""Decoders: raw content to rows."""

from __future__ import annotations

import csv
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from ..errors import ERRORS, RAW, fault
from ..functions import avro
from ..functions.protobuf import messages
from ..registry import decoder

# fixed values: the names of syslog facilities and severities, by number
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()


def _syslog(*fields: str) -> str:
    """A pattern of header fields in their order, each behind white space."""
    return r"^<(?<pri>\d+)>" + r"\s+".join(fields)


def _word(name: str = "") -> str:
    return rf"(?<{name}>\S+)" if name else r"\S+"


# RFC 5424: version, time, host, app, process, message id; structured data, which is a dash or elements in brackets, several
# without a blank between them, or whatever else stands there; and, behind white space, a message
_ELEMENT = r"\[(?:[^\]\\]|\\.)*\]"
_DATA = rf"(?:-|(?:{_ELEMENT})+|\S+)"
_NEW_SYSLOG = _syslog(r"\d+", _word("time"), _word("host"), _word("app"), _word("pid"), _word(), _DATA) + r"(?:\s+(?<message>(?s:.*)))?$"
# RFC 3164: a time of month, day and clock, the host, and a tag up to the first colon, in which the process may stand in brackets
_CLOCK = r"(?<time>\w{3}\s+\d+\s+\d+(?::\d+){2})"
_TAG = r"(?<app>[^\[:]+)(?:\[(?<pid>\d+)\])?[^:]*"
_OLD_SYSLOG = _syslog(_CLOCK, _word("host"), _TAG) + r":\s*(?<message>(?s:.*))$"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _strict(df: DataFrame, column: str, bad: Column, what: str) -> DataFrame:
    """Rows whose content does not parse are errors: dead letters with their content in RAW where the channel is open, else the job's end."""
    if ERRORS in df.columns:
        df = df.withColumn(RAW, F.when(bad, F.col(column).cast("binary")))
    return fault(df, bad, F.concat(F.lit(f"{what}: "), F.substring(F.col(column).cast("string"), 1, 200)))


def _objects(text: Column, schema: str) -> Column:
    """Of a JSON object or array: array<struct<row, other>>, where other is the text of an element that is no object and row is null then.

    Elements are looked at one by one only where the array as a whole does not read as rows.
    """
    def entry(row: Column | None, other: Column | None) -> Column:
        return F.struct((F.lit(None).cast(schema) if row is None else row).alias("row"), (F.lit(None).cast("string") if other is None else other).alias("other"))

    def one(x: Column) -> Column:
        is_object = F.try_variant_get(x, "$", "map<string,variant>").isNotNull()
        return F.when(is_object, entry(F.from_json(F.to_json(x), schema), None)).otherwise(entry(None, F.coalesce(F.to_json(x), F.lit("null"))))

    many = F.from_json(text, f"array<{schema}>")
    whole = F.when(many.isNotNull() & ~F.exists(many, lambda x: x.isNull()), F.transform(many, lambda x: entry(x, None)))
    each = F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), one)
    return F.when(text.startswith("{"), F.array(entry(F.from_json(text, schema), None))).otherwise(F.coalesce(whole, each))


def _misfits(df: DataFrame, other: Column, what: str) -> DataFrame:
    """Rows that come of an element which does not fit are errors, with the element in RAW."""
    if ERRORS in df.columns:
        df = df.withColumn(RAW, F.when(other.isNotNull(), other.cast("binary")).otherwise(F.col(RAW)))
    return fault(df, other.isNotNull(), F.concat(F.lit(f"{what}: "), F.substring(other, 1, 200)))


@decoder("json")
def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON document in each row: an object is one row, an array one for each element. Anything else is an error; null gives no row.

    An element that is no object is an error of its own; the others of its array are rows.
    """
    df = df.withColumn(column, F.col(column).cast("string"))
    text = F.trim(column)
    df = _strict(df.filter(F.col(column).isNotNull()), column, F.try_parse_json(text).isNull() | ~text.rlike(r"^[\[{]"), "no JSON object or array")
    rows = _objects(text, schema)
    if ERRORS in df.columns:
        rows = F.when(F.size(ERRORS) > 0, F.array(F.struct(F.lit(None).cast(schema).alias("row"), F.lit(None).cast("string").alias("other")))).otherwise(rows)
    out = _misfits(df.withColumn("_d", F.explode(rows)), F.col("_d.other"), "no JSON object")
    return out.drop(column).select("*", "_d.row.*").drop("_d")


@decoder("ndjson")
def decode_ndjson(df: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """Lines of JSON; blank lines are skipped, arrays opened, a scalar becomes _value, and a line that does not parse is an error.

    So does an element of an array that is no object; strings stand there without their quotes. strict: a line that is no object is an error.
    """
    lines = df.withColumn("_l", F.explode(F.split(column, LINE_ENDS))).filter(F.trim("_l") != "").drop(column)
    text = F.trim("_l")
    kind = (F.lit(False) if not strict else ~text.startswith("{")) | F.try_parse_json("_l").isNull()
    lines = _strict(lines, "_l", kind, "no JSON object" if strict else "no JSON")
    nothing = F.array(F.struct(F.lit(None).cast(schema).alias("row"), F.lit(None).cast("string").alias("other")))
    scalar = F.array(F.struct(F.lit(None).cast(schema).alias("row"), text.alias("other")))
    rows = F.when(text.rlike(r"^[\[{]"), _objects(text, schema)).otherwise(scalar)
    if ERRORS in df.columns:
        rows = F.when(F.size(ERRORS) > 0, nothing).otherwise(rows)
    out = lines.withColumn("_d", F.explode(rows))
    value = F.when(F.col("_d.other").startswith('"'), F.try_variant_get(F.try_parse_json("_d.other"), "$", "string")).otherwise(F.col("_d.other"))
    return out.select("*", "_d.row.*", value.alias("_value")).drop("_l", "_d")


def _csv_rows(raw: bytes, fields: list[str], delimiter: str, quote: str, has_header: bool) -> list[list[str | None]]:
    """Records of one document; a quoted field may hold line ends. Missing fields are null, further ones are left out."""
    rows = (r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""), delimiter=delimiter, quotechar=quote) if r)
    if not has_header:
        return [(r + [None] * len(fields))[: len(fields)] for r in rows]
    header = next(rows, [])
    at = [header.index(f) if f in header else len(header) + 10**9 for f in fields]
    return [[r[i] if i < len(r) else None for i in at] for r in rows]


@decoder("csv")
def decode_csv(df: DataFrame, column: str, fields: list[str], delimiter: str = ",", quote: str = '"', has_header: bool = False) -> DataFrame:
    """CSV documents to text columns: fields by position, or with a header by the names in each document's first record.

    A quoted field may hold line ends, delimiters and doubled quotes; a byte order mark and empty lines count for nothing.
    Null gives no row, and a document that is no UTF-8 or does not read as CSV is an error. Files too large for a cell: read_csv_records.
    """

    @F.arrow_udf("array<struct<row: array<string>, error: string>>")
    def parse(contents: pa.Array) -> pa.Array:
        csv.field_size_limit(2**31 - 1)
        out = []
        for raw in contents.to_pylist():
            try:
                out.append([] if raw is None else [{"row": r, "error": None} for r in _csv_rows(raw, fields, delimiter, quote, has_header)])
            except (csv.Error, UnicodeDecodeError) as e:
                out.append([{"row": None, "error": str(e)}])
        return pa.array(out, pa.list_(pa.struct([("row", pa.list_(pa.string())), ("error", pa.string())])))

    rows = df.withColumn("_d", F.explode(parse(F.col(column).cast("binary"))))
    rows = _broken(rows, column, F.col("_d.error").isNotNull(), F.concat(F.lit("no CSV: "), F.col("_d.error")))
    return rows.drop(column).select("*", *[F.get("_d.row", F.lit(i)).alias(f) for i, f in enumerate(fields)]).drop("_d")


def _broken(df: DataFrame, column: str, bad: Column, message: Column) -> DataFrame:
    """Documents that a parser gave up on are errors, with their content in RAW; without a channel they end the job."""
    if ERRORS in df.columns:
        df = df.withColumn(RAW, F.when(bad, F.col(column).cast("binary")))
    return fault(df, bad, message)


_SPLITS = 64 << 20  # bytes of small splits that a task takes


def read_csv_records(spark: SparkSession, path: str, fields: list[str], delimiter: str = ",", quote: str = '"', has_header: bool = False) -> DataFrame:
    """CSV files of any size, split in parallel, whose quoted fields may hold line ends: source_path and the fields by position.

    A line end is inside a field if the number of quotes before it is odd. A first pass counts the quotes of each split of a file, and the
    sums before it say in which state a split begins. Lines that are whole records, nearly all as a rule, stay where they
    are; the others are brought together by the place where their record begins. A quote counts wherever it stands (RFC 4180).
    Empty lines are left out; with a header the first record of each file is.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    lines = lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, size // _SPLITS))  # a task takes its splits one after the other
    n = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).cast("long")

    @F.arrow_udf("no long, odd boolean, begin long")
    def place(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # lines of a split come in their order; odd: an odd number of quotes stands before the line in its split
        last, no, odd = None, 0, 0
        for files, blocks, quotes in batches:
            numbers, odds = np.empty(len(files), np.int64), np.empty(len(files), bool)
            code, begin, n_quotes = files.dictionary_encode().indices.to_numpy(), blocks.to_numpy(), quotes.to_numpy()
            edges = (np.flatnonzero((np.diff(code) != 0) | (np.diff(begin) != 0)) + 1).tolist() if len(files) else []
            for a, b in zip([0, *edges], [*edges, len(files)]) if len(files) else ():
                own = (files[a].as_py(), int(begin[a]))
                if own != last:
                    last, no, odd = own, 0, 0
                sums = odd + np.cumsum(n_quotes[a:b])
                numbers[a:b] = np.arange(no, no + b - a)
                odds[a], odds[a + 1 : b] = odd, sums[:-1] & 1
                no, odd = no + b - a, int(sums[-1]) & 1
            yield pa.StructArray.from_arrays([pa.array(numbers), pa.array(odds), pa.nulls(len(files), pa.int64())], names=["no", "odd", "begin"])

    # it counts lines, so no filter may go before it
    placed = lines.withColumn("_q", n % 2).withColumn("_p", place.asNondeterministic()("_f", "_b", "_q"))
    # of each split: its parity, and its last line that begins a record if the split begins outside, or inside, a field
    starts = {state: F.max(F.when(F.col("_p.odd") == F.lit(state), F.col("_p.no"))) for state in (False, True)}
    splits = placed.groupBy("_f", "_b").agg((F.sum("_q") % 2).alias("_sum"), starts[False].alias("_out"), starts[True].alias("_in"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_state", F.coalesce(F.sum("_sum").over(before) % 2, F.lit(0)) == 1)
    splits = splits.withColumn("_last", F.struct("_b", F.when(F.col("_state"), F.col("_in")).otherwise(F.col("_out")).alias("no")))
    splits = splits.withColumn("_last", F.last(F.when(F.col("_last.no").isNotNull(), F.col("_last")), ignorenulls=True).over(before))
    rows = placed.join(splits.select("_f", "_b", "_state", "_last"), ["_f", "_b"])
    inside = F.col("_p.odd") != F.col("_state")
    at = F.struct("_b", F.col("_p.no").alias("no"))
    whole = rows.filter(~inside & (F.col("_q") == 0)).select("_f", at.alias("_at"), "value")
    parts = rows.filter(inside | (F.col("_q") == 1)).withColumn("_start", F.when(~inside, at)).select("_f", at.alias("_at"), "_start", "_last", "value", "_b")
    own = Window.partitionBy("_f", "_b").orderBy("_at")  # of a split's lines only those in records of several
    parts = parts.withColumn("_record", F.coalesce(F.last("_start", ignorenulls=True).over(own), "_last"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")
    joined = parts.groupBy("_f", F.col("_record").alias("_at")).agg(body.alias("value"))
    records = whole.unionByName(joined).filter(F.rtrim("value") != "")
    if has_header:
        first = records.groupBy("_f").agg(F.min("_at").alias("_first"))
        records = records.join(first, "_f").filter(F.col("_at") != F.col("_first"))
    return decode_csv(records.select(F.col("_f").alias("source_path"), F.regexp_replace("value", "\r$", "").alias("_csv")), "_csv", fields, delimiter, quote)


@decoder("text")
def decode_text(df: DataFrame, column: str, line_field: str = "_line", skip_empty: bool = True, include_line_num: bool = False) -> DataFrame:
    """A row for each line; numbers count blank lines too, from 1. A final line end opens no line."""
    body = F.regexp_replace(column, f"(?:{LINE_ENDS})$", "")
    rows = df.filter(F.length(column) > 0).select("*", F.posexplode(F.split(body, LINE_ENDS, -1)).alias("_n", line_field)).drop(column)
    rows = rows.filter(F.trim(line_field) != "") if skip_empty else rows
    return rows.withColumn("_line_num", F.col("_n") + 1).drop("_n") if include_line_num else rows.drop("_n")


@decoder("bytes")
def decode_bytes(df: DataFrame, column: str, encoding: str = "base64") -> DataFrame:
    raw = F.col(column).cast("binary")
    df = df.withColumn("_size", F.octet_length(raw).cast("long"))
    if encoding == "base64":
        df = df.withColumn("_raw", F.regexp_replace(F.base64(raw), "\\s", ""))
    elif encoding == "hex":
        df = df.withColumn("_raw", F.lower(F.hex(raw)))
    return df.drop(column)


def _local(name: str) -> str:
    """A name without its namespace."""
    return name.rpartition("}")[2]


def _texts(text: str | None, tag: str | None) -> list[list[tuple[str, str | None]]]:
    root = ET.fromstring(text) if text and text.strip() else None
    if root is None:
        return []
    if not len(root):
        return [[("_text", root.text)]] if tag is None else []
    rows = []
    for child in root:
        if tag in (None, _local(child.tag)):
            row = {_local(k): v for k, v in child.attrib.items()} | {_local(x.tag): x.text for x in child}
            rows.append(list((row | ({} if len(child) or not child.text else {"_text": child.text})).items()))
    return rows


@decoder("xml")
def decode_xml(df: DataFrame, column: str, row_schema: str, row_tag: str | None = None) -> DataFrame:
    """Children of the root as rows: attributes and text of direct children, namespaces taken off.

    row_tag None takes every child. A root without children is a row of its own text; what lies deeper than a child's
    children is dropped. Null and empty documents give no row, nor do malformed ones, which are dead letters where the channel is open.
    """
    strict = ERRORS in df.columns

    @F.arrow_udf("array<map<string, string>>")
    def parse(texts: pa.Array) -> pa.Array:
        found = (_or_none(_texts, x, row_tag) for x in texts.to_pylist())
        return pa.array([[None] if x is None and strict else x for x in found], pa.list_(pa.map_(pa.string(), pa.string())))

    fields = DataType.fromDDL(row_schema).fields
    rows = df.withColumn("_d", F.explode(parse(F.col(column).cast("string"))))
    if strict:
        rows = _broken(rows, column, F.col("_d").isNull(), F.concat(F.lit("malformed XML: "), F.substring(F.col(column).cast("string"), 1, 200)))
    return rows.drop(column).select("*", *[F.try_element_at("_d", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields]).drop("_d")


def _or_none(parse, text: str | None, *more):
    try:
        return parse(text, *more)
    except ET.ParseError:
        return None


_PM_CLOSED = ("measValue", "measInfo", "measData")
_PM_ROW = "struct<managedElement: string, measInfoId: string, measObjLdn: string, endTime: string, duration: string, counters: map<string, string>>"
_PM_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("managedElement", "measInfoId", "measObjLdn", "endTime", "duration")] + [("counters", pa.map_(pa.string(), pa.string()))]))


def _measurements(text: str | None) -> list[dict] | None:
    """The measValues of one file, block by block; only a block is held as a tree."""
    if not text or not text.strip():
        return []
    out, open_, element = [], [], ""
    parser = ET.XMLPullParser(("start", "end"))

    def block(info: ET.Element) -> None:
        parts: dict[str, list[ET.Element]] = {}
        for x in info:
            parts.setdefault(_local(x.tag), []).append(x)
        period = parts.get("granPeriod", [ET.Element("none")])[-1]
        names = {x.get("p"): (x.text or "").strip() for x in parts.get("measType", ()) if x.get("p") and (x.text or "").strip()}
        for value in parts.get("measValue", ()):
            counters = {names.get(r.get("p", ""), f"counter_{r.get('p', '')}"): (r.text or "").strip() for r in value if _local(r.tag) == "r"}
            out.append({"managedElement": element, "measInfoId": info.get("measInfoId", ""), "measObjLdn": value.get("measObjLdn", ""), "endTime": period.get("endTime", ""), "duration": period.get("duration", ""), "counters": list(counters.items())})

    parser.feed(text.rstrip())
    for event, x in parser.read_events():
        tag = _local(x.tag)
        if event == "start":
            open_.append(x)
            if tag == "managedElement" and not element:
                element = x.get("localDn") or x.get("userLabel", "")
        else:
            open_.pop()
            if tag == "measInfo":
                block(x)
                x.clear()
    # a file that was cut off between values ends there; one that was cut off within a value is malformed
    tags = [_local(x.tag) for x in open_]
    if any(t not in (*_PM_CLOSED, tags[0]) for t in tags) or text.rstrip()[-1] != ">":
        raise ET.ParseError("cut off within an element")
    if "measInfo" in tags:
        block(open_[tags.index("measInfo")])
    return out


@decoder("pm_xml")
def decode_pm_xml(df: DataFrame, column: str, numeric_values: bool = False, keep_malformed: bool = False) -> DataFrame:
    """Performance files: a row for each measValue with a map of counter name to value.

    The root is measData or holds it. Counters without a measType of their number are named counter_N. A file that was cut
    off between values counts as far as it goes. With numeric_values a column `numbers` holds the counters as doubles, null
    where a value is none. A malformed file gives no row, or with keep_malformed one row of nulls; where the channel is open it is a dead letter.
    """
    strict = ERRORS in df.columns

    @F.arrow_udf(f"array<{_PM_ROW}>")
    def parse(texts: pa.Array) -> pa.Array:
        found = (_or_none(_measurements, x) for x in texts.to_pylist())
        return pa.array([[None] if x is None and (keep_malformed or strict) else x for x in found], _PM_ARROW)

    # the function stands in the generator itself: as a column of its own it would run again in the filter that Spark infers
    rows = df.withColumn("_v", F.explode(parse(F.col(column).cast("string"))))
    if strict:
        rows = _broken(rows, column, F.col("_v").isNull(), F.concat(F.lit("malformed performance file: "), F.substring(F.col(column).cast("string"), 1, 200)))
    rows = rows.select(*[c for c in rows.columns if c not in (column, "_v")], "_v.*")
    return rows.withColumn("numbers", F.transform_values("counters", lambda _, v: v.try_cast("double"))) if numeric_values else rows


def strip_registry_framing(c: Column) -> Column:
    """schema_id and payload of a value that starts with a zero byte and a four-byte id; other values pass."""
    framed = (F.octet_length(c) >= 5) & (F.hex(F.substring(c, 1, 1)) == "00")
    return F.struct(F.when(framed, F.conv(F.hex(F.substring(c, 2, 4)), 16, 10).cast("long")).alias("schema_id"), F.when(framed, F.substring(c, 6, 1 << 30)).otherwise(c).alias("payload"))


def _frames(raw: memoryview) -> Iterator[tuple[int, memoryview | None, str | None]]:
    """Number, bytes and error of each frame."""
    at, seq = 0, 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 > len(raw) or at + 4 + size > len(raw):
            yield seq, None, "truncated frame"
            return
        yield seq, raw[at + 4 : at + 4 + size], None
        at, seq = at + 4 + size, seq + 1


def _length(raw: memoryview, at: int) -> tuple[int | None, int]:
    """Content length (None: indefinite) and where the content starts."""
    n = raw[at]
    if n < 0x80:
        return n, at + 1
    if n == 0x80:
        return None, at + 1
    k = n & 0x7F
    if at + 1 + k > len(raw):
        raise IndexError
    return int.from_bytes(raw[at + 1 : at + 1 + k], "big"), at + 1 + k


def _ber_end(raw: memoryview, at: int) -> int:
    """Where the value that starts at a place ends."""
    first = raw[at]
    at += 1
    if first & 0x1F == 0x1F:
        while raw[at] & 0x80:
            at += 1
        at += 1
    size, at = _length(raw, at)
    if size is None:
        while raw[at : at + 2] != b"\0\0":
            at = _ber_end(raw, at)
        return at + 2
    if at + size > len(raw):
        raise IndexError
    return at + size


def _ber(raw: memoryview) -> Iterator[tuple[int, memoryview | None, str | None]]:
    at, seq = 0, 0
    while at < len(raw):
        try:
            end = _ber_end(raw, at)
        except IndexError:
            yield seq, None, "value overruns its content"
            return
        yield seq, raw[at:end], None
        at, seq = end, seq + 1


_SENT, _ROWS = 4 << 20, 10_000  # bytes, and rows, that leave a task at a time


def _split(df: DataFrame, column: str, make: Callable[[], Callable[[memoryview], Iterator[tuple]]], kinds: dict[str, str]) -> DataFrame:
    """Rows of each content in place of it: make() gives a function from a content to tuples as kinds has them, a payload and an error last.

    They are sent on as they are found, those of many small contents together, so that a task holds a batch of contents and `_SENT`
    bytes of rows. Where the channel is open, a broken content is a dead letter with the whole of it.
    """
    opened_ = ERRORS in df.columns
    raw = df.withColumn(column, F.col(column).cast("binary"))
    keep = [c for c in df.columns if c != column]
    shape = {f.name: f.dataType.simpleString() for f in raw.schema.fields if f.name != column} | kinds | ({RAW: "binary"} if opened_ else {})
    names = list(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        arrow = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k] for k in kinds.values()]
        for batch in batches:
            contents, others = batch.column(column), batch.select(keep)
            own = others.nbytes // max(1, len(batch)) + 16
            found, rows, raws, size = [], [], [], 0

            def send() -> pa.RecordBatch:
                columns = dict(zip(keep, others.take(pa.array(rows, pa.int64())).columns))
                before = columns.get(RAW)
                columns |= {n: pa.array(x, kind) for n, x, kind in zip(kinds, zip(*found), arrow)}
                if opened_:
                    raw_ = pa.array(raws, pa.binary())
                    columns[RAW] = raw_ if before is None else pc.coalesce(raw_, before)
                return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

            for i in range(len(batch)):
                if not contents[i].is_valid:
                    continue
                view = memoryview(contents[i].as_buffer()).cast("B")
                for row in split(view):
                    broken = opened_ and row[-1] is not None
                    found.append(row)
                    rows.append(i)
                    raws.append(view if broken else None)
                    size += own + len(row[-2] or b"") + (len(view) if broken else 0)
                    if size >= _SENT or len(rows) >= _ROWS:
                        yield send()
                        found, rows, raws, size = [], [], [], 0
            if rows:
                yield send()

    return raw.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in shape.items()))


def _framed(df: DataFrame, column: str, split: Callable[[memoryview], Iterator[tuple[int, object, str | None]]]) -> DataFrame:
    """seq, frame and error for each frame."""
    rows = _split(df, column, lambda: split, {"seq": "bigint", "frame": "binary", "error": "string"})
    return fault(rows, F.col("error").isNotNull(), F.col("error")) if ERRORS in df.columns else rows


@decoder("length_delimited")
def split_length_delimited(df: DataFrame, column: str) -> DataFrame:
    """A row for each frame of a four-byte big-endian length and its bytes; a cut-off frame is an error row."""
    return _framed(df, column, _frames)


@decoder("asn1")
def split_ber_records(df: DataFrame, column: str) -> DataFrame:
    """A row for each top-level BER value, with long tags, long and indefinite lengths."""
    return _framed(df, column, _ber)


def _decoded(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[bytes], list]], what: str) -> DataFrame:
    """Rows of a binary format: make() gives a function from bytes to values that JSON can hold, and raises on what it cannot read."""

    def values() -> Callable[[memoryview], Iterator[tuple[str | None, str | None]]]:
        decode = make()

        def split(raw: memoryview) -> Iterator[tuple[str | None, str | None]]:
            try:
                found = decode(bytes(raw))
            except (ValueError, IndexError, KeyError, OverflowError, struct.error, zlib.error) as e:
                yield None, str(e) or type(e).__name__
            else:
                for value in found:
                    yield json.dumps(value, allow_nan=True), None

        return split

    rows = _split(df, column, values, {"_d_row": "string", "_d_error": "string"})
    rows = fault(rows, F.col("_d_error").isNotNull(), F.concat(F.lit(f"no {what}: "), F.col("_d_error")))
    return rows.withColumn("_d", F.from_json("_d_row", schema)).drop("_d_row", "_d_error").select("*", "_d.*").drop("_d")


@decoder("protobuf")
def decode_protobuf(df: DataFrame, column: str, descriptor: bytes, message: str, schema: str, framing: str = "none") -> DataFrame:
    """Messages by a descriptor set (as protoc writes it), fields by their JSON names. A value that is no such message is an error.

    framing length_delimited: each value holds any number of messages behind four-byte lengths, a row for each.
    schema: the columns to take, with whole numbers as numbers, enums as names, bytes as base64; a field that a message lacks is null.
    """
    if framing == "length_delimited":
        df = split_length_delimited(df, column).withColumnRenamed("frame", column).drop("seq", "error")
    rows = df
    if ERRORS in df.columns and framing == "length_delimited":  # broken frames are errors already
        kept = df.filter(F.size(ERRORS) > 0).drop(column)
        rows = df.filter(F.size(ERRORS) == 0).drop(RAW)
        return _decoded(rows, column, schema, partial(messages, descriptor, message), "message").unionByName(kept, allowMissingColumns=True)
    return _decoded(rows, column, schema, partial(messages, descriptor, message), "message")


@decoder("avro")
def decode_avro(df: DataFrame, column: str, schema: str, reader: str | None = None, writer: str | None = None) -> DataFrame:
    """Avro to rows: container files, or with a writer schema values without a header. reader: the schema to read by.

    Behind the registry's framing take strip_registry_framing first, and one call for each schema id. What cannot be read, or not be
    resolved to the reader's schema, is an error.
    """
    return _decoded(df, column, schema, partial(avro.reader, reader, writer), "Avro")


def parse_syslog(c: Column) -> Column:
    """facility, severity, timestamp, host, app, pid, message; RFC 5424 is tried first. No match: blanks and the text.

    A facility beyond the list is its number. Each pattern runs once: a match turns into its groups with a mark between them.
    """
    text = F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
    groups = "\x01".join(f"${{{name}}}" for name in ("pri", "time", "host", "app", "pid", "message"))
    new, old = F.regexp_replace(text, _NEW_SYSLOG, groups), F.regexp_replace(text, _OLD_SYSLOG, groups)
    parts = F.when(new != text, F.split(new, "\x01", 6)).when(old != text, F.split(old, "\x01", 6)).otherwise(F.array(*[F.lit("")] * 5, text))
    pri = F.nullif(parts[0], F.lit("")).try_cast("int")
    number = F.shiftright(pri, 3)
    facility = F.coalesce(F.get(F.array(*map(F.lit, FACILITIES)), number), number.cast("string"))
    severity = F.get(F.array(*map(F.lit, SEVERITIES)), pri.bitwiseAND(F.lit(7)))
    return F.struct(F.coalesce(facility, F.lit("")).alias("facility"), F.coalesce(severity, F.lit("")).alias("severity"), *[parts[i].alias(n) for i, n in enumerate(("timestamp", "host", "app", "pid", "message"), 1)])


def prometheus_series_to_samples(df: DataFrame, column: str) -> DataFrame:
    """array<struct<labels: array<struct<name, value>>, samples: array<struct<value, timestamp>>>> to a row for each sample."""
    s = df.withColumn("_s", F.explode(column)).withColumn("_x", F.explode("_s.samples")).drop(column)
    labels = F.map_from_entries(F.transform("_s.labels", lambda x: F.struct(x["name"], x["value"])))
    return s.withColumns({"labels": labels, "__value__": F.col("_x.value"), "__timestamp_ms__": F.col("_x.timestamp")}).drop("_s", "_x")


def gnmi_updates(df: DataFrame, column: str) -> DataFrame:
    """struct<timestamp, update: array<struct<path, val>>> to a row for each update; no time is 0."""
    return df.withColumn("_u", F.explode(F.col(column).getField("update"))).withColumns({"path": F.col("_u.path"), "val": F.col("_u.val"), "timestamp": F.coalesce(F.col(column).getField("timestamp"), F.lit(0))}).drop("_u", column)


def snmp_group_by_index(df: DataFrame, keys: list[str], bindings: str, index_depth: int = 0) -> DataFrame:
    """A map of OID to value to table rows: a row for each index, with a map of column to value.

    The index is what follows the first dot, or with a depth the last parts; an OID without one has the index "".
    """
    rows = df.select(*keys, F.explode(bindings).alias("oid", "value"))
    parts = F.split("oid", "[.]")
    if index_depth:
        head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - index_depth, F.lit(1))), ".")
        index = F.array_join(F.slice(parts, F.greatest(F.size(parts) - index_depth, F.lit(1)) + 1, index_depth), ".")
    else:
        head, index = F.regexp_extract("oid", r"^([^.]*)", 1), F.regexp_extract("oid", r"^[^.]*\.?(.*)$", 1)
    rows = rows.withColumns({"_column": head, "_index": index})
    out = rows.groupBy(*keys, "_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_column", "value")))).alias("columns"))
    return out.withColumn("_index_parts", F.split("_index", "[.]"))


_METRICS = ("Counter32", "Counter64", "Gauge32", "Unsigned32", "TimeTicks")  # fixed values


def snmp_classify(bindings: Column) -> Column:
    """array<struct<name, type, value>> to maps of metrics (long) and labels, names without their dot suffix."""

    def is_metric(x: Column) -> Column:
        base = F.regexp_extract(x["name"], r"^([^.]*)", 1)
        return x["type"].isin(*_METRICS) | ((x["type"] == "Integer32") & ~base.rlike("(Id|ID|Index|Port|Vdom)$"))

    def entry(x: Column, value: Column) -> Column:
        return F.struct(F.regexp_extract(x["name"], r"^([^.]*)", 1), value)

    metrics = F.map_from_entries(F.transform(F.filter(bindings, is_metric), lambda x: entry(x, x["value"].try_cast("bigint"))))
    labels = F.map_from_entries(F.transform(F.filter(bindings, lambda x: ~is_metric(x)), lambda x: entry(x, x["value"])))
    return F.struct(metrics.alias("_metrics"), labels.alias("_labels"))


def snmp_value_to_string(raw: Column) -> Column:
    """Printable ASCII as text, six bytes as a hardware address, others as 0x and hex."""
    h = F.lower(F.hex(raw))
    text = h.rlike("^(2[0-9a-f]|[3-6][0-9a-f]|7[0-9a-e])*$")  # 20 to 7e; a tab or a line end is not printable
    return F.when(text, F.decode(raw, "US-ASCII")).when(F.octet_length(raw) == 6, F.regexp_replace(h, "(..)(?!$)", "$1:")).otherwise(F.concat(F.lit("0x"), h))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, quotechar: str = '"') -> DataFrame:
    """All text; without a header the columns are field_0, field_1 and so on."""
    df = spark.read.csv(path, sep=delimiter, header=has_header, quote=quotechar, inferSchema=False)
    return df if has_header else df.toDF(*[f"field_{i}" for i in range(len(df.columns))])


def split_avro_blocks(df: DataFrame, column: str) -> DataFrame:
    """A row for each block of a container file, as a container of its own, so that a large file is decoded in many tasks once it is dealt out."""
    return _framed(df, column, avro.blocks)


def read_avro(spark: SparkSession, path: str, schema: str, reader: str | None = None, pattern: str = "*.avro") -> DataFrame:
    """Container files: split into blocks, dealt over the tasks, decoded to the columns of schema."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    blocks = split_avro_blocks(files.select(F.col("path").alias("source_path"), "content"), "content")
    blocks = blocks.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("no Avro: "), "error", F.lit(" in "), "source_path")).cast("boolean")).otherwise(F.lit(True)))
    return decode_avro(blocks.select("source_path", "frame").repartition(spark.sparkContext.defaultParallelism), "frame", schema, reader)
