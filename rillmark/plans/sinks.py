"""Sinks and encoders."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType
from pyspark.sql.window import Window

from ..functions import avro
from ..paths import at, found
from ..registry import sink
from ..sources.database import is_sqlite, write_sqlite
from .commits import Staged


def partition_value(c: Column) -> Column:
    """A value for a folder's name: null and empty are unknown."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))


def name_columns(df: DataFrame, pipeline: str, run_id: str, path: str = "source_path") -> DataFrame:
    """The parts of a file's name as columns."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return df.withColumns({"pipeline": F.lit(pipeline), "run_id": F.lit(run_id), "source_filename": name, "source_stem": F.regexp_replace(name, r"\.[^.]*$", ""), "source_suffix": F.regexp_extract(name, r"(\.[^.]*)$", 1)})


_TOKEN = re.compile(r"\{([^{}]+)\}")


def file_name(template: str, opened_at: Column, part: Column, digits: int = 5, **values: Column | str) -> Column:
    """A file's name from a template with {timestamp}, {epoch}, {epoch_m}, {epoch_ms}, {part}, {index}, {field.x} and given values.

    The time stands as 20240131T235959, as whole seconds, or as milliseconds; a part has so many digits. A field's null or
    empty value is unknown.
    """
    at_ = opened_at.cast("timestamp")
    number = F.lpad(part.cast("string"), digits, "0")
    millis = F.unix_millis(at_).cast("string")
    known = {"timestamp": F.date_format(at_, "yyyyMMdd'T'HHmmss"), "epoch": F.unix_seconds(at_).cast("string"), "epoch_m": millis, "epoch_ms": millis, "part": number, "index": number}
    known |= {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    out: list[Column] = []
    for i, text in enumerate(_TOKEN.split(template)):
        if i % 2 == 0:
            out.append(F.lit(text))
        elif text.startswith("field."):
            out.append(partition_value(at(text[6:])))
        elif text in known:
            out.append(F.coalesce(known[text], F.lit("")))
        else:
            raise ValueError(f"unknown template token '{text}'")
    return F.concat(*out)


def _greedy(sizes: np.ndarray, rows: int, held: int, max_records: int | None, max_bytes: int | None) -> np.ndarray:
    """Where new files begin among rows of one key and span, behind a file that has so many rows and bytes already."""
    total, starts, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        base = total[at] - sizes[at]
        end = len(sizes)
        if max_records:
            end = min(end, at + max_records - rows)
        if max_bytes:
            full = int(np.searchsorted(total, base + max_bytes - held, side="right"))
            # a single larger row has a file of its own: the first that has bytes at all
            end = min(end, full if held else max(full, int(np.searchsorted(total, base, side="right")) + 1))
        at = max(end, at)
        if at < len(sizes):
            starts.append(at)
        rows = held = 0
    return np.array(starts, np.int64)


def file_parts(df: DataFrame, size: Column, keys: Sequence[str] = (), max_records: int | None = None, max_bytes: int | None = None, max_seconds: int | None = None, ts: str | None = None) -> DataFrame:
    """Column `part`: the number, from 1, of the file that a row falls into, for each task and key.

    A file is full before the row that would take it over max_records or max_bytes (a single larger row has its own), and at
    the end of each span of max_seconds of the time column. Tasks number their own files; the rows do not leave them, and are
    sorted by key and span, as a partitioned write needs anyway, so a task holds the state of one file.
    """
    span = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / max_seconds) if max_seconds and ts else F.lit(0).cast("long")
    key = F.to_json(F.struct(*[f"`{k}`" for k in keys])) if keys else F.lit("")
    rows = df.withColumns({"_file_key": key, "_file_span": F.coalesce(span, F.lit(-(2**62))), "_file_size": size.cast("long")})

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, number, n, held = (None, None), 0, 0, 0
        for sizes, keys_, spans in batches:
            if not len(sizes):
                yield pa.array([], pa.int64())
                continue
            size_, span_, code = sizes.fill_null(0).to_numpy(), spans.to_numpy(), keys_.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(span_) != 0)) + 1
            out = np.empty(len(size_), np.int64)
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size_)]):
                own = (keys_[a].as_py(), int(span_[a]))
                if own != last:
                    number, n, held = (number + 1 if own[0] == last[0] else 1), 0, 0
                starts = _greedy(size_[a:b], n, held, max_records, max_bytes)
                fresh = np.zeros(b - a, np.int64)
                fresh[starts] = 1
                out[a:b] = number + np.cumsum(fresh)
                number = int(out[b - 1])
                tail = a + int(starts[-1]) if len(starts) else a
                n, held = (0 if len(starts) else n) + b - tail, (0 if len(starts) else held) + int(size_[tail:b].sum())
                last = own
            yield pa.array(out)

    numbered = F.arrow_udf(run, "long").asNondeterministic()  # it counts rows, so no filter may go before it
    order = [f"`{k}`" for k in keys] + ["_file_key", "_file_span"]
    return rows.sortWithinPartitions(*order).withColumn("part", numbered("_file_size", "_file_key", "_file_span")).drop("_file_size", "_file_key", "_file_span")


def dealt(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows brought together by partition value; a value gets as many tasks as its share of the rows asks for.

    One count of the rows by value decides. Values with over a task's share are few (as many as there are tasks, at most): each gets
    a range of tasks of its own, its rows in turn; all others go to one task each by their hash.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*[F.col(f"`{n}`").alias(f"_v{i}") for i, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    large = counts.filter(F.col("_n") * tasks > total).orderBy(F.desc("_n"), *[f"_v{i}" for i in range(len(names))]).collect()
    if not large:
        return df.repartition(tasks, *[f"`{n}`" for n in names])
    hash_ = F.pmod(F.xxhash64(*[f"`{n}`" for n in names]), F.lit(tasks))
    turn, begin, place = F.monotonically_increasing_id(), 0, None
    for row in large:
        wide = min(tasks, -(-row["_n"] * tasks // total))
        own = F.lit(True)
        for i, n in enumerate(names):
            own = own & F.col(f"`{n}`").eqNullSafe(F.lit(row[f"_v{i}"]))
        where = F.pmod(F.pmod(turn, F.lit(wide)) + begin, F.lit(tasks))
        place = F.when(own, where) if place is None else place.when(own, where)
        begin += wide
    return df.repartitionById(tasks, place.otherwise(hash_).cast("int"))


def _partition_columns(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns for the folders' names: `a.b` is named a_b, or a_b_2 and so on where the rows have a column of that name that is not the field itself."""
    names: list[str] = []
    taken = set(df.columns)
    for f in fields:
        name = base = f.replace(".", "_")
        i = 1
        while name in names or (name in taken and name != f):
            i += 1
            name = f"{base}_{i}"
        df = df.withColumn(name, partition_value(at(f)) if found(df, f) else F.lit("unknown"))
        names.append(name)
    return df, names


@sink("files", "local", "s3", "gcs", "azure_blob", "sftp", "ftp")
def write_files(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_fields: Sequence[str] = (), max_records: int | None = None, max_bytes: int | None = None, max_seconds: int | None = None, ts: str | None = None, **options: str) -> None:
    """Published by Spark's commit protocol: a failed job leaves no part. Rows of a folder are brought together first.

    max_records alone is Spark's own limit on files; with max_bytes (of a row as JSON) or max_seconds each part is a folder
    part=n of its own.
    """
    df, names = _partition_columns(df, partition_fields)
    if names:
        df = dealt(df, names)
    if max_bytes or (max_seconds and ts):
        df = file_parts(df, F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))), names, max_records, max_bytes, max_seconds, ts)
        names, max_records = [*names, "part"], None
    w = df.write.format(form).mode(mode).options(**options)
    w = w.option("maxRecordsPerFile", max_records) if max_records else w
    (w.partitionBy(*names) if names else w).save(path)


def folder_sink(path: str, mode: str = "errorifexists", **config) -> Staged:
    """write_files as a sink that a commit log can publish once."""
    return Staged(path, lambda df, folder: write_files(df, folder, **config), mode)


def encode_text(df: DataFrame, line_field: str = "_line") -> DataFrame:
    """The line, or the record as JSON where there is none."""
    record = F.to_json(F.struct(*[f"`{c}`" for c in df.columns if c != line_field] or [line_field]))
    return df.select((F.coalesce(F.col(line_field), record) if line_field in df.columns else record).alias("value"))


def encode_bytes(c: Column, encoding: str = "base64") -> Column:
    return F.unbase64(c) if encoding == "base64" else F.unhex(c)


def encode_csv(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.select(F.to_csv(F.struct(*fields)).alias("value"))


def encode_json(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A JSON object for each row, or an array for each key."""
    body = F.struct(*[f"`{c}`" for c in df.columns])
    if not keys:
        return df.select(F.to_json(body).alias("value"))
    return df.groupBy(*keys).agg(F.to_json(F.collect_list(body)).alias("value"))


def _xml_text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def encode_xml(df: DataFrame, record_element: str = "record", root_element: str = "records", keys: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """An element for each row with one for each field, null as an empty one; with keys a document for each key, rows by order_by."""
    fields = [F.concat(F.lit(f"<{c}>"), _xml_text(F.col(f"`{c}`")), F.lit(f"</{c}>")) for c in df.columns]
    record = F.concat(F.lit(f"<{record_element}>"), *fields, F.lit(f"</{record_element}>"))
    if not keys:
        return df.select(record.alias("value"))
    rows = df.select(*keys, F.struct(*order_by, record.alias("_x")).alias("_x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_x"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit(f"<{root_element}>"), body, F.lit(f"</{root_element}>")).alias("value"))


def encode_avro(df: DataFrame, schema: str | None = None, schema_id: int | None = None, keys: Sequence[str] = (), codec: str = "deflate") -> DataFrame:
    """A row as an Avro value, behind the registry's framing if an id is given; or with keys a container file for each key.

    Without a schema it is taken from the rows' types, everything nullable. A row that the schema has no place for ends the job.
    """
    text = schema or json.dumps(avro.schema_of(df.drop(*keys).schema))

    @F.arrow_udf("binary")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = avro.Schema(text)
        for rows in batches:
            yield pa.array([avro.encode(own, own.top, json.loads(r)) for r in rows.to_pylist()], pa.binary())

    def container(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key's rows come in portions; what is held of them is the file itself
        file = avro.container(avro.Schema(text), text, (json.loads(r) for b in batches for r in b.column("_r").to_pylist()), codec)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([file], pa.binary())], names=[*keys, "value"])

    as_json = F.to_json(F.struct(*[f"`{c}`" for c in df.columns if c not in keys]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    if keys:
        shape = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "value binary"])
        return df.select(*[f"`{k}`" for k in keys], as_json.alias("_r")).groupBy(*[f"`{k}`" for k in keys]).applyInArrow(container, shape)
    value = values(as_json)
    return df.select((value if schema_id is None else registry_framing(value, schema_id)).alias("value"))


def registry_framing(payload: Column, schema_id: int) -> Column:
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.lit(schema_id)), 8, "0")), payload)


def encode_pm_xml(df: DataFrame, ldn: str, counters: Sequence[str]) -> DataFrame:
    """One measInfo for each record, with numbered values."""
    r = F.array(*[F.struct(F.lit(str(i)).alias("_p"), at(c).cast("string").alias("_VALUE")) for i, c in enumerate(counters, 1)])
    return df.select(F.to_xml(F.struct(F.struct(at(ldn).alias("_measObjLdn"), r.alias("r")).alias("measValue")), {"rowTag": "measInfo"}).alias("value"))


@sink("sql", "jdbc", "clickhouse")
def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 5000, **options: str) -> None:
    """sqlite:///path goes by the driver in Python (see sources/database)."""
    if is_sqlite(url):
        return write_sqlite(df, url, table, mode, batchsize, **options)
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize).options(**options).mode(mode).save()


def kafka_rows(df: DataFrame, key_field: str | None = None) -> DataFrame:
    value = F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("value")
    return df.select(at(key_field).cast("string").alias("key"), value) if key_field else df.select(value)


@sink("kafka")
def write_kafka(df: DataFrame, brokers: str, topic: str, key_field: str | None = None) -> None:
    """Needs Spark's Kafka package on the class path."""
    kafka_rows(df, key_field).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"([,= ])", r"\\$1")


def to_line_protocol(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], ts: str | None = None, precision: str = "ns") -> DataFrame:
    """A line for each row: measurement, sorted tags, fields, time. Null tags and fields are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(f: str) -> Column:
        k = kinds[f]
        if isinstance(k, BooleanType):
            return F.col(f).cast("string")
        if isinstance(k, IntegralType):
            return F.concat(F.col(f).cast("string"), F.lit("i"))
        if isinstance(k, NumericType):
            return F.col(f).cast("string")
        return F.concat(F.lit('"'), F.regexp_replace(F.col(f).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))

    tag = F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{t}="), _escaped(F.col(t))) for t in sorted(tags)])
    body = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), value(f)) for f in fields])
    micros = F.unix_micros(F.col(ts).cast("timestamp")) if ts else None
    time = [] if micros is None else [{"ns": micros * 1000, "us": micros, "ms": F.floor(micros / 1000), "s": F.floor(micros / 1_000_000)}[precision].cast("string")]
    return df.select(F.concat_ws(" ", tag, body, *time).alias("value"))


def to_bulk_ndjson(df: DataFrame, index: str | Column, id_field: str | None = None, pipeline: str | None = None) -> DataFrame:
    """Action line and document of a bulk request, for each row."""
    parts = [(F.lit(index) if isinstance(index, str) else index).alias("_index")]
    if id_field:
        parts.append(at(id_field).cast("string").alias("_id"))
    if pipeline:
        parts.append(F.lit(pipeline).alias("pipeline"))
    action = F.to_json(F.struct(F.struct(*parts).alias("index")))
    return df.select(F.concat_ws("\n", action, F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))).alias("value"))


def _ves_event(df: DataFrame, domain: str, header: Sequence[Column]) -> Column:
    body = F.struct(*[f"`{c}`" for c in df.columns])
    return F.struct(F.struct(F.struct(*header).alias("commonEventHeader"), body.alias(f"{domain}Fields")).alias("event"))


def to_ves_events(df: DataFrame, domain: str, source: str, sequence: str, event_id: Column) -> DataFrame:
    """Event envelopes with a short header; sequence names a column that numbers the rows."""
    header = F.lit(domain).alias("domain"), event_id.alias("eventId"), F.col(sequence).alias("sequence"), F.lit(source).alias("sourceName"), F.lit("Normal").alias("priority")
    return df.select(F.to_json(_ves_event(df, domain, header)).alias("value"))


def to_ves_lists(df: DataFrame, domain: str, source: str, keys: Sequence[str], order_by: Sequence[str], event_id: Column | None = None, at_: Column | None = None, reporting: str | None = None, priority: str = "Normal", version: str = "4.1", listener: str = "7.2.1") -> DataFrame:
    """One request body `{"eventList": [...]}` for each key, its events with the whole common header, numbered from 0 by order_by.

    event_id is a new UUID and at_ the present time unless given; reporting is the source. The key's rows are one body, so keys
    should be as fine as a request is to be; numbering is by window, and the list is collected from numbered events.
    """
    micros = F.unix_micros((F.current_timestamp() if at_ is None else at_).cast("timestamp"))
    w = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(*order_by)
    rows = df.withColumn("_seq", F.row_number().over(w) - 1)
    header = (
        F.lit(domain).alias("domain"),
        (F.uuid() if event_id is None else event_id).alias("eventId"),
        F.lit(f"{domain}_{source}").alias("eventName"),
        micros.alias("lastEpochMicrosec"),
        F.lit(priority).alias("priority"),
        F.lit(reporting or source).alias("reportingEntityName"),
        F.col("_seq").alias("sequence"),
        F.lit(source).alias("sourceName"),
        micros.alias("startEpochMicrosec"),
        F.lit(version).alias("version"),
        F.lit(listener).alias("vesEventListenerVersion"),
    )
    events = rows.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.struct("_seq", _ves_event(df, domain, header)["event"].alias("event")).alias("_e"))
    body = F.transform(F.array_sort(F.collect_list("_e")), lambda e: F.struct(e["event"].alias("event")))
    out = events.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.to_json(F.struct(body.alias("eventList"))).alias("value"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "value")


def to_varbinds(df: DataFrame, keys: Sequence[str], varbinds: Sequence[tuple[str, str, str]] | None = None, base: str = "1.3.6.1.4.1.0") -> DataFrame:
    """oid, type and value rows; without a list, whole numbers are Integer32 and the rest OctetString."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rules = varbinds or [(f"{base}.{i}", c, "Integer32" if isinstance(kinds[c], IntegralType) else "OctetString") for i, c in enumerate((c for c in df.columns if c not in keys), 1)]
    items = F.array(*[F.struct(F.lit(o).alias("oid"), F.lit(t).alias("type"), F.col(f).cast("string").alias("value")) for o, f, t in rules])
    return df.select(*keys, F.explode(items).alias("_v")).select(*keys, "_v.*").filter("value is not null")
