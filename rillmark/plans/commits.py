"""Each row once: a log of what a batch's routes have done, staged folders that are published once, and the ledger of files.

An entry of the log belongs to a pipeline, a batch and a route. A route whose entry says so is not written again, whether the batch is
replayed by a stream, retried, or taken up after a crash. Files are written to a staging folder beside their target; once it
is complete the entry says `staged`, its files are moved under names of the batch, and the entry says `done`. Moving can
be broken off and taken up anywhere: what is still in the staging folder is moved. A sink that is no folder is marked when it returns.

The ledger works the same way: a run claims the files that it will read, by a folder that lists them; when its routes are done
the list is published as processed, and when it fails the claim goes. Claims are made under a lock, so no two runs
take one file. A run that died leaves its claim, which the next one takes over after `lease` seconds, under the same batch, so routes that
were done stay done.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, sorted; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.has(name) else []

    def files(self, name: str) -> list[str]:
        """Files at any depth that Spark reads, by their paths from here."""
        out, top = [], self._fs.resolvePath(self._at(name)).toUri().getPath()
        found = self._fs.listFiles(self._at(name), True)
        while found.hasNext():
            inner = found.next().getPath().toUri().getPath()[len(top) + 1 :]
            if not any(part.startswith(("_", ".")) and "=" not in part for part in inner.split("/")):
                out.append(inner)
        return sorted(out)

    def age(self, name: str) -> float:
        """Seconds since it was written."""
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def write(self, name: str, text: str) -> None:
        """Written aside and moved, so that nobody reads a part of it."""
        aside = f".{uuid.uuid4().hex}"
        out = self._fs.create(self._at(aside))
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(self._at(aside), self._at(name)):
            raise OSError(f"cannot write {self.path}/{name}")

    def create(self, name: str, text: str) -> bool:
        """Whether the file was not there and is now."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            if self.has(name):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.has(name):
            return None
        src = self._fs.open(self._at(name))
        try:
            return bytes(src.readAllBytes()).decode()
        finally:
            src.close()

    def move(self, name: str, target: str) -> None:
        self._fs.mkdirs(self._at(target).getParent())
        if not self._fs.rename(self._at(name), self._at(target)):
            if not self.has(target):
                raise OSError(f"cannot move {self.path}/{name} to {target}")
            self.remove(name)  # a move that was broken off after its copy

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


LISTS = 200  # lists of a ledger that are read before they become one


@dataclass
class Entry:
    state: str  # staged, done, or failed: its rows are dead letters
    rows: int


class CommitLog:
    """The log in a folder that the driver and a driver after it can reach; without one it lasts as long as this object."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.folder = spark, Folder(spark, path) if path else None
        self.held: dict[str, Entry] = {}

    @staticmethod
    def _name(pipeline: str, batch: str, route: str) -> str:
        return "/".join(quote(x, safe="") or "%" for x in (pipeline, batch, route)) + ".json"

    def entry(self, pipeline: str, batch: str, route: str) -> Entry | None:
        name = self._name(pipeline, batch, route)
        if name not in self.held and self.folder and (text := self.folder.read(name)):
            self.held[name] = Entry(**json.loads(text))
        return self.held.get(name)

    def put(self, pipeline: str, batch: str, route: str, state: str, rows: int) -> None:
        name = self._name(pipeline, batch, route)
        self.held[name] = Entry(state, rows)
        if self.folder:
            self.folder.write(name, json.dumps({"state": state, "rows": rows}))

    def once(self, pipeline: str, batch: str, route: str, rows: int, sink: Callable[[DataFrame], None], df: DataFrame) -> int:
        """Write the rows unless the log says that they have been written; the number of rows that they were."""
        if isinstance(sink, Staged):
            rows = self.stage(pipeline, batch, route, rows, sink, df)
            self.publish(pipeline, batch, route, sink)
            return rows
        before = self.entry(pipeline, batch, route)
        if before:
            return before.rows
        sink(df)
        self.put(pipeline, batch, route, "done", rows)
        return rows

    def stage(self, pipeline: str, batch: str, route: str, rows: int, sink: Staged, df: DataFrame) -> int:
        """Write the rows beside the target, where no reader looks."""
        before = self.entry(pipeline, batch, route)
        if before:
            return before.rows
        target, staging = Folder(self.spark, sink.path), self._staging(pipeline, batch, route)
        sink.check(target, self.started(pipeline, batch, route))
        target.remove(staging)
        sink.write(df, f"{target.path}/{staging}")
        self.put(pipeline, batch, route, "staged", rows)
        return rows

    def publish(self, pipeline: str, batch: str, route: str, sink: Staged) -> None:
        """Move what is staged to its place."""
        entry = self.entry(pipeline, batch, route)
        if entry and entry.state == "staged":
            self._publish(Folder(self.spark, sink.path), self._staging(pipeline, batch, route), quote(f"{batch}-{route}", safe=""))
            self.put(pipeline, batch, route, "done", entry.rows)

    @staticmethod
    def _staging(pipeline: str, batch: str, route: str) -> str:
        return f"_staged-{quote(f'{pipeline}-{batch}-{route}', safe='')}"

    def forget(self, pipeline: str, batches: Callable[[str], bool]) -> None:
        """Entries of batches that cannot come again."""
        own = quote(pipeline, safe="")
        self.held = {k: v for k, v in self.held.items() if not (k.startswith(own + "/") and batches(k.split("/")[1]))}
        for b in self.folder.names(own) if self.folder else ():
            if batches(b):
                self.folder.remove(f"{own}/{b}")

    def started(self, pipeline: str, batch: str, route: str) -> bool:
        """Whether an earlier batch of this log wrote to the route."""
        name = quote(route, safe="") + ".json"
        own = f"{quote(pipeline, safe='')}/"
        if any(n.startswith(own) and n.endswith("/" + name) for n in self.held):
            return True
        return bool(self.folder) and any(self.folder.has(f"{own}{b}/{name}") for b in self.folder.names(own.rstrip("/")))

    @staticmethod
    def _publish(target: Folder, staging: str, mark: str) -> None:
        if not target.has(staging):
            return
        for file in target.files(staging):
            folder, _, name = file.rpartition("/")
            target.move(f"{staging}/{file}", f"{folder}/{mark}-{name}" if folder else f"{mark}-{name}")
        target.remove(staging)


@dataclass
class Staged:
    """A sink that writes a folder: write(rows, folder). mode is that of the target: errorifexists, append, overwrite or ignore."""

    path: str
    write: Callable[[DataFrame, str], None]
    mode: str = "errorifexists"

    def __call__(self, df: DataFrame) -> None:
        CommitLog(df.sparkSession).once("", uuid.uuid4().hex, "", 0, self, df)

    def check(self, target: Folder, started: bool) -> None:
        """What the mode says of a target that is there; what this log put there is never in the way."""
        if started or not (target.has() and any(not n.startswith(("_", ".")) for n in target.names())):
            return
        if self.mode == "overwrite":
            for name in target.names():
                target.remove(name)
        elif self.mode != "append":
            raise ValueError(f"{self.path} exists")


class Busy(RuntimeError):
    """Another run holds the ledger's lock."""


class Ledger:
    """Files that have been processed, by pipeline and source, in a folder: lists of the runs that are done, and of those under way."""

    def __init__(self, spark: SparkSession, path: str, pipeline: str, source_key: str, lease: float = 3600, patience: float = 60):
        self.spark, self.pipeline, self.source_key, self.lease, self.patience = spark, pipeline, source_key, lease, patience
        self.folder = Folder(spark, f"{path.rstrip('/')}/{quote(pipeline, safe='')}/{quote(source_key, safe='')}")

    SCHEMA = "pipeline_name string, source_key string, filepath string, processed_at timestamp"

    def _lists(self, kind: str) -> DataFrame:
        names = [n for n in self.folder.names(kind) if not n.startswith((".", "_"))]
        r = self.spark.read.schema(self.SCHEMA)
        return r.parquet(*[f"{self.folder.path}/{kind}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.SCHEMA)

    def processed(self) -> DataFrame:
        return self._lists("processed")

    @contextmanager
    def _lock(self):
        until, own = time.time() + self.patience, uuid.uuid4().hex
        while not self.folder.create("lock", own):
            if self.folder.has("lock") and self.folder.age("lock") > self.lease:
                self.folder.remove("lock")  # its run died while it made a claim
            elif time.time() > until:
                raise Busy(f"{self.folder.path} is locked")
            else:
                time.sleep(0.05)
        try:
            yield
        finally:
            if self.folder.read("lock") == own:
                self.folder.remove("lock")

    def _write(self, kind: str, batch: str, rows: DataFrame) -> None:
        aside = f".{kind}-{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{aside}")
        self.folder.move(aside, f"{kind}/{batch}")

    def claim(self, files: DataFrame, batch: str, rows: DataFrame | None = None) -> tuple[str, DataFrame]:
        """(batch, files to read): those of files (source_path) that no run has done or is at; or those that a dead run left, under its batch.

        rows: what is read of the files (with their source_path), if that is not a row for each.
        """
        rows = files if rows is None else rows
        with self._lock():
            for old in self.folder.names("claims"):
                if self.folder.has(f"processed/{old}"):  # it died between the two
                    self.folder.remove(f"claims/{old}")
                elif self.folder.has(f"claims/{old}/_open") or self.folder.age(self._mark(old)) > self.lease:
                    self.renew(old)
                    self.folder.remove(f"claims/{old}/_open")
                    return old, rows.join(self._claimed(old), "source_path", "left_semi")
            taken = self.processed().union(self._lists("claims")).select(F.col("filepath").alias("source_path"))
            free = files.join(taken, "source_path", "left_anti")
            self._write("claims", batch, free.select(F.lit(self.pipeline).alias("pipeline_name"), F.lit(self.source_key).alias("source_key"), F.col("source_path").alias("filepath"), F.current_timestamp().alias("processed_at")))
            self.renew(batch)
        return batch, rows.join(self._claimed(batch), "source_path", "left_semi")

    def _mark(self, batch: str) -> str:
        mark = f"claims/{batch}/_lease"
        return mark if self.folder.has(mark) else f"claims/{batch}"

    def renew(self, batch: str) -> None:
        """The claim's age starts anew; for runs that take longer than a lease."""
        self.folder.write(f"claims/{batch}/_lease", "")

    def _claimed(self, batch: str) -> DataFrame:
        return self._lists_of("claims", batch).select(F.col("filepath").alias("source_path"))

    def _lists_of(self, kind: str, batch: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder.path}/{kind}/{batch}")

    def done(self, batch: str) -> None:
        """The claimed files are processed: one move of a folder says so."""
        if not self.folder.has(f"processed/{batch}"):
            self._write("processed", batch, self._lists_of("claims", batch).withColumn("processed_at", F.current_timestamp()))
        self.folder.remove(f"claims/{batch}")
        if len(self.folder.names("processed")) > LISTS:
            self.compact()

    def compact(self) -> None:
        """One list in place of many; until the old ones are gone their files are listed twice, which changes nothing."""
        with self._lock():
            open_ = set(self.folder.names("claims"))
            old = [n for n in self.folder.names("processed") if n not in open_]
            if len(old) > 1:
                rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder.path}/processed/{n}" for n in old])
                self._write("processed", f"all-{uuid.uuid4().hex}", rows.coalesce(1 + len(old) // 1000))
                for n in old:
                    self.folder.remove(f"processed/{n}")

    def open(self, batch: str) -> None:
        """The claim stays for the next run, which takes it up at once."""
        self.folder.write(f"claims/{batch}/_open", "")

    def failed(self, batch: str) -> None:
        """The claimed files are free again."""
        self.folder.remove(f"claims/{batch}")
