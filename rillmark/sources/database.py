"""SQLite as a Spark data source: a database file in a shared folder, which the driver and each task open by themselves.

Spark's jars hold no JDBC driver of a database that several processes reach, and Derby belongs to one JVM; for servers there is JDBC.
"""

from __future__ import annotations

import math
import os
import sqlite3
import uuid
from collections.abc import Iterator, Mapping
from contextlib import closing
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TURN = 3600  # seconds that a task waits for its turn to write
DECLARED = {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "TEXT", "binary": "BLOB", "boolean": "BOOLEAN"}
KINDS = {v: k for k, v in DECLARED.items()} | {"INTEGER": "bigint", "REAL": "double"}
MARKS = "_rillmark_tasks"  # a row for each task of a job that has written, added with the task's rows


def is_sqlite(url: str) -> bool:
    return url.startswith("sqlite:")


def database_file(url: str) -> str:
    """The path in sqlite:///path, which may be a file: URI; several processes open it, so it cannot be in memory."""
    path = url.removeprefix("sqlite:///")
    if path.startswith("file:"):
        path = unquote("/" + path.removeprefix("file:").lstrip("/"))
    if not os.path.isabs(path):
        raise ValueError(f"{url}: a database in a shared folder is named by sqlite:/// and an absolute path")
    return path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(url: str) -> sqlite3.Connection:
    return sqlite3.connect(database_file(url), timeout=TURN, isolation_level=None)


def _fields(url: str, select: str) -> list[tuple[str, str]]:
    """Name and declared type of the columns that a SELECT gives; an expression has none."""
    with closing(connect(url)) as db:
        db.execute(f"CREATE TEMP VIEW _shape AS {select}")
        return [(name, kind.upper()) for _, name, kind, *_ in db.execute("PRAGMA table_info(_shape)")]


class _Message(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.floats = options, [f.name for f in schema if f.dataType.typeName() in ("double", "float")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A task's rows in one transaction, with a mark that lets no repeat of the task in."""
        table, size = quoted(self.options["table"]), int(self.options["batchsize"])
        with closing(connect(self.options["url"])) as db:
            db.execute("BEGIN IMMEDIATE")
            new = db.execute(f"INSERT OR IGNORE INTO {MARKS} VALUES (?, ?)", (self.options["job"], TaskContext.get().partitionId())).rowcount
            for whole in iterator if new else ():
                for at in range(0, whole.num_rows, size):
                    batch = whole.slice(at, size)
                    columns = [c.to_pylist() for c in batch.columns]
                    for name in self.floats:  # SQLite would store NULL
                        if any(x is not None and math.isnan(x) for x in columns[batch.schema.get_field_index(name)]):
                            raise ValueError(f"{name}: SQLite has no NaN")
                    db.executemany(f"INSERT INTO {table} ({', '.join(map(quoted, batch.schema.names))}) VALUES ({', '.join('?' * len(columns))})", zip(*columns))
            db.execute("COMMIT")
        return _Message()


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.shape = options, to_arrow_schema(schema)

    def partitions(self):
        """Ranges of the partition column, the first and the last without an outer bound; NULL belongs to the first."""
        o = self.options
        if "column" not in o:
            return [InputPartition("1")]
        column, low, high, n = quoted(o["column"]), int(o["lower"]), int(o["upper"]), max(1, int(o["n"]))
        edges = sorted({low + (high - low) * i // n for i in range(1, n)})
        ranges = zip([None, *edges], [*edges, None])
        return [InputPartition(" AND ".join([f"{column} >= {a}"] * (a is not None) + [f"{column} < {b}"] * (b is not None)) + (f" OR {column} IS NULL" if a is None and b is not None else "") or "1") for a, b in ranges]

    def read(self, partition):
        with closing(connect(self.options["url"])) as db:
            rows = db.execute(f"SELECT * FROM ({self.options['select']}) WHERE {partition.value}")
            while part := rows.fetchmany(int(self.options["fetchsize"])):
                columns = [pa.array(c, pa.int8()).cast(f.type) if f.type == pa.bool_() else pa.array(c, f.type) for c, f in zip(zip(*part), self.shape)]
                yield pa.RecordBatch.from_arrays(columns, schema=self.shape)


class Database(DataSource):
    @classmethod
    def name(cls):
        return "rillmark_sqlite"

    def schema(self):
        return self.options["shape"]

    def reader(self, schema):
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema)


def scan_sqlite(spark: SparkSession, url: str, select: str, partitioning: Mapping[str, object] | None = None, fetchsize: int = 5000, customSchema: str | None = None) -> DataFrame:
    """The rows of a SELECT. customSchema gives the types of columns that the database declares none for ("n bigint")."""
    own = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(customSchema)} if customSchema else {}
    kinds = {name: own.get(name) or KINDS.get(kind) for name, kind in _fields(url, select)}
    if missing := [name for name, kind in kinds.items() if not kind]:
        raise ValueError(f"no type is declared for {', '.join(missing)}: give customSchema")
    shape = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in kinds.items())
    spark.dataSource.register(Database)
    return spark.read.format(Database.name()).options(url=url, select=select, shape=shape, fetchsize=fetchsize, **(partitioning or {})).load()


def write_sqlite(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 5000) -> None:
    """Tasks take turns, each with one transaction, so a task that is repeated leaves its rows once. mode: append, overwrite, ignore or error."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if odd := [f"{name} {kind}" for name, kind in kinds.items() if kind not in DECLARED]:
        raise ValueError(f"SQLite has no type for {', '.join(odd)}: cast them first")
    if mode not in ("append", "overwrite", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    os.makedirs(os.path.dirname(database_file(url)), exist_ok=True)
    with closing(connect(url)) as db:
        there = db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND lower(name) = lower(?)", (table,)).fetchone()[0]
        if there and mode == "ignore":
            return
        if there and mode in ("error", "errorifexists"):
            raise ValueError(f"table {table} exists")
        db.execute("BEGIN IMMEDIATE")
        if there and mode == "overwrite":
            db.execute(f"DROP TABLE {quoted(table)}")
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(n)} {DECLARED[k]}' for n, k in kinds.items())})")
        db.execute(f"CREATE TABLE IF NOT EXISTS {MARKS} (job TEXT, part INT, PRIMARY KEY (job, part))")
        db.execute("COMMIT")
    df.sparkSession.dataSource.register(Database)
    df.write.format(Database.name()).options(url=url, table=table, batchsize=batchsize, job=uuid.uuid4().hex).mode("append").save()
