"""Sources and sinks of one's own, as Spark data sources in Python: read and written in the executors, by partition."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def data_source(name: str, schema: str, partitions: Callable[[dict], list[Any]], read: Callable[[dict, Any], Iterable[tuple]], write: Callable[[dict, Iterator[tuple]], Any] | None = None, finish: Callable[[dict, list[Any]], None] | None = None) -> type[DataSource]:
    """A data source class from functions of the options.

    partitions lists what is read by one task each; read yields the rows of one. write takes the rows of a task and gives a
    message; finish gets all messages once every task is done, and is where output is published.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [InputPartition(p) for p in partitions(self.options)]

        def read(self, partition):
            return iter(read(self.options, partition.value))

    class Message(WriterCommitMessage):
        def __init__(self, value: Any):
            self.value = value

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.options = options

        def write(self, iterator):
            return Message(write(self.options, (tuple(row) for row in iterator)))

        def commit(self, messages):
            if finish:
                finish(self.options, [m.value for m in messages if m is not None])

    class Custom(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

        def writer(self, schema, overwrite):
            if write is None:
                raise ValueError(f"{name} cannot be written")
            return Writer(dict(self.options))

    return Custom


def scan_custom(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def write_custom(df: DataFrame, sink: type[DataSource], **options: str) -> None:
    df.sparkSession.dataSource.register(sink)
    df.write.format(sink.name()).options(**options).mode("append").save()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = path if "://" in path else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def listed_files(options: dict) -> list[str]:
    """The finished files of a folder: those that its list names, or all where there is none."""
    store, root = _store(options["path"])
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json"))


def read_json_lines(options: dict, path: str) -> Iterator[tuple]:
    store, _ = _store(options["path"])
    with store.open_input_stream(path) as f:
        for line in f.read().splitlines():
            yield tuple(json.loads(line))


def write_json_lines(options: dict, rows: Iterator[tuple]) -> str:
    """A file of a task's rows, each as a JSON list; written aside, then moved."""
    store, root = _store(options["path"])
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/.{name}") as f:
        for row in rows:
            f.write(json.dumps(row).encode() + b"\n")
    store.move(f"{root}/.{name}", f"{root}/{name}.json")
    return name
