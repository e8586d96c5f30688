"""A pipeline as data: operators, routes with conditions, dead letters and counters, in batch or stream."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import CHANNEL, ERRORS, RAW, dlq_envelope, opened, recorded
from ..operators import fields, relational, shape  # noqa: F401  (they register themselves)
from ..registry import DECODERS, OPERATORS, SINKS, SOURCES
from ..sources import decode, scan  # noqa: F401
from . import sinks as _sinks
from .commits import CommitLog, Folder, Ledger, Staged

MESSAGES = 20  # different messages that a run's result lists

Sink = Callable[[DataFrame], None]


@dataclass
class Route:
    name: str
    sink: Sink
    condition: str | Column | None = None
    steps: Sequence[tuple[str, Mapping]] = ()


@dataclass
class Pipeline:
    """on_error says what becomes of rows that an operator rejects and of routes whose sink fails.

    continue: they are counted and noted. dlq: the same, and a dead-letter sink must be there. abort: the run fails, before
    anything is written if a row is at fault. retry: as continue for rows, but a failing sink fails the attempt, and what is not
    yet written is tried again, up to `retries` times more. Where there is a dead-letter sink, it takes rejected rows in each
    mode, and in the first two those of failed sinks too. A commit log sees to it that no route writes a batch twice.
    """

    name: str
    steps: Sequence[tuple[str, Mapping]]
    routes: Sequence[Route]
    dlq: Sink | None = None
    on_error: str = "continue"
    retries: int = 3
    retry_delay: float = 0.0
    batch_size: int | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if self.on_error not in ("continue", "abort", "retry", "dlq"):
            raise ValueError(f"no such on_error: {self.on_error}")
        if self.on_error == "dlq" and self.dlq is None:
            raise ValueError("on_error dlq needs a dead-letter sink")


@dataclass
class Counts:
    """records_out: rows that at least one route wrote. records_skipped: all others, rejected, unrouted, or of failed sinks only.

    dlq_count: dead letters written. errors: different messages, MESSAGES at most. routes: rows written by each.
    """

    run_id: str
    records_in: int = 0
    records_out: int = 0
    records_skipped: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    dlq_count: int = 0
    errors: list[str] = field(default_factory=list)
    routes: dict[str, int] = field(default_factory=dict)
    status: str = "success"

    def __getitem__(self, name: str):
        return getattr(self, name)


def apply(df: DataFrame, steps: Sequence[tuple[str, Mapping]]) -> DataFrame:
    for key, config in steps:
        df = OPERATORS[key](df, **config)
    return df


def _holds(r: Route) -> Column:
    """Whether a row takes the route; null is false."""
    c = F.lit(True) if r.condition is None else F.expr(r.condition) if isinstance(r.condition, str) else r.condition
    return F.coalesce(c, F.lit(False))


def routed(df: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Each row once for each route whose condition holds, named in `_route`; no condition takes all. Null is false."""
    names = F.array(*[F.when(_holds(r), F.lit(r.name)) for r in routes])
    return df.withColumn("_route", F.explode(F.filter(names, lambda x: x.isNotNull())))


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, computed once: stored in the shared folder where one is set, else in Spark's cache; gone at the end."""
    spark = df.sparkSession
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    shared = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        cached = df.persist()
        try:
            yield cached
        finally:
            cached.unpersist()
        return
    folder = Folder(spark, f"{shared}/run-{uuid.uuid4().hex}")
    rows = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    try:
        rows.write.option("compression", "zstd").parquet(folder.path)
        yield spark.read.schema(rows.schema).parquet(folder.path)
    finally:
        folder.remove()


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON, without the error channel."""
    return F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in df.columns if c not in CHANNEL] or [F.lit(1)])))


def _counted(shaped: DataFrame, good: Column, hits: Sequence[Column]) -> dict[str, Column]:
    some = _any(hits)
    size = _bytes(shaped)
    out = {"records_in": F.count(F.lit(1)), "rejected": F.count_if(~good), "records_out": F.count_if(some), "bytes_in": F.coalesce(F.sum(size), F.lit(0)), "bytes_out": F.coalesce(F.sum(F.when(some, size)), F.lit(0))}
    return out | {f"route_{i}": F.count_if(h) for i, h in enumerate(hits)}


def _any(hits: Sequence[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def _messages(bad: DataFrame) -> list[str]:
    return [r[0] for r in bad.select(F.element_at(ERRORS, 1)).distinct().limit(MESSAGES).collect()]


def _in_one_pass(p: Pipeline) -> bool:
    """Whether a run needs its shaped rows once only: one folder to write, and nobody who asks for rejected rows before or after."""
    return len(p.routes) == 1 and isinstance(p.routes[0].sink, Staged) and p.dlq is None and p.on_error != "abort"


def _observed(df: DataFrame, p: Pipeline, log: CommitLog, batch: str) -> Counts:
    """Shape and write in one pass, which Spark counts as it goes."""
    out, route = Counts(p.run_id), p.routes[0]
    shaped = apply(opened(df), p.steps)
    good = F.size(ERRORS) == 0
    hit = good & _holds(route)
    seen = Observation()
    before = log.entry(p.name, batch, route.name)
    watched = shaped.observe(seen, *[c.alias(n) for n, c in _counted(shaped, good, [hit]).items()])
    try:
        log.once(p.name, batch, route.name, 0, route.sink, apply(watched.filter(hit).drop(*CHANNEL), route.steps))
    except Exception as e:
        if p.on_error == "retry":
            raise
        one = shaped.agg(*[c.alias(n) for n, c in _counted(shaped, good, [F.lit(False)]).items()]).first().asDict()
        out.errors.append(f"sink {route.name}: {e}"[:500])
        out.status = "failed"
    else:
        one = shaped.agg(*[c.alias(n) for n, c in _counted(shaped, good, [hit]).items()]).first().asDict() if before else seen.get
        if one["route_0"]:
            out.routes[route.name] = one["route_0"]
    out.records_in, out.records_out, out.bytes_in, out.bytes_out = one["records_in"], one["records_out"], one["bytes_in"], one["bytes_out"]
    out.records_skipped = out.records_in - out.records_out
    if one["rejected"]:
        out.errors = _messages(shaped.filter(~good)) + out.errors
    return out


def run_once(shaped: DataFrame, p: Pipeline, log: CommitLog, batch: str) -> Counts:
    """Count, route and write rows that are shaped and kept. One pass over them gives all counts."""
    out = Counts(p.run_id)
    good = F.size(ERRORS) == 0
    hits = [good & _holds(r) for r in p.routes]
    size = _bytes(shaped)
    one = shaped.agg(*[c.alias(n) for n, c in _counted(shaped, good, hits).items()]).first()
    out.records_in, rejected, out.records_out, out.bytes_in, out.bytes_out, *takers = one
    if rejected:
        bad = shaped.filter(~good)
        out.errors += _messages(bad)
        if p.dlq:
            out.dlq_count += log.once(p.name, batch, "_rejected", rejected, p.dlq, dlq_envelope(bad, "parse" if RAW in bad.columns else "transform", p.name, p.run_id))
        if p.on_error == "abort":
            raise ValueError(out.errors[0])
    failed: list[int] = []
    for i, (r, n) in enumerate(zip(p.routes, takers)):
        if not n:
            continue
        own = shaped.filter(hits[i])
        before = log.entry(p.name, batch, r.name)
        if before and before.state == "failed":  # its rows are dead letters already
            failed.append(i)
            out.dlq_count += before.rows
            continue
        whole = p.on_error in ("abort", "retry") and isinstance(r.sink, Staged)
        try:
            # where a failing sink fails the run, folders are published together once all sinks have done their part
            out.routes[r.name] = (log.stage if whole else log.once)(p.name, batch, r.name, n, r.sink, apply(own.drop(*CHANNEL), r.steps))
        except Exception as e:
            if p.on_error in ("abort", "retry"):
                raise
            failed.append(i)
            message = f"sink {r.name}: {e}"[:500]
            out.errors.append(message)
            if p.dlq:
                out.dlq_count += log.once(p.name, batch, f"_failed-{r.name}", n, p.dlq, dlq_envelope(own.withColumn(ERRORS, F.array(F.lit(message))), "sink", p.name, p.run_id))
                log.put(p.name, batch, r.name, "failed", n)
    for r in p.routes if p.on_error in ("abort", "retry") else ():
        if r.name in out.routes and isinstance(r.sink, Staged):
            log.publish(p.name, batch, r.name, r.sink)
    if failed:
        wrote = _any([h for i, h in enumerate(hits) if i not in failed])
        out.records_out, out.bytes_out = shaped.agg(F.count_if(wrote), F.coalesce(F.sum(F.when(wrote, size)), F.lit(0))).first()
    out.records_skipped = out.records_in - out.records_out
    out.status = "failed" if failed and not out.routes else "success"
    return out


def run_pipeline(df: DataFrame, p: Pipeline, log: CommitLog | None = None, batch: str | None = None) -> Counts:
    """The counts of a run. A run that on_error ends raises; with retry the last attempt's error is raised.

    The log says which routes the batch has written, so that neither another attempt nor, where the log is a folder, another
    run of the same batch writes them again. The batch is the run unless it has a name.
    """
    log, batch = log or CommitLog(df.sparkSession), batch or p.run_id
    df = df.limit(p.batch_size) if p.batch_size else df
    left = p.retries if p.on_error == "retry" else 0

    def attempts(run: Callable[[], Counts]) -> Counts:
        nonlocal left
        while True:
            try:
                return run()
            except Exception:
                if not left:
                    raise
                left -= 1
                time.sleep(p.retry_delay)

    if _in_one_pass(p):
        return attempts(lambda: _observed(df, p, log, batch))

    def whole() -> Counts:
        with _kept(apply(opened(df), p.steps)) as shaped:
            return attempts(lambda: run_once(shaped, p, log, batch))

    return attempts(whole)


def _step(spec: Mapping) -> tuple[str, Mapping]:
    config = {k: v for k, v in spec.items() if k != "type"}
    if spec["type"] not in OPERATORS:
        raise ValueError(f"no such operator: {spec['type']}")
    return spec["type"], config


def _sink(spec: Mapping) -> Sink:
    config = {k: v for k, v in spec.items() if k not in ("type", "name", "condition", "transforms")}
    if spec["type"] not in SINKS:
        raise ValueError(f"no such sink: {spec['type']}")
    own = SINKS[spec["type"]]
    return _sinks.folder_sink(**config) if own is _sinks.write_files else partial(own, **config)


def pipeline_from(spec: Mapping) -> Pipeline:
    """A pipeline from plain data, as it is read from JSON or YAML.

    name; transforms: [{type: operator, ...}]; sinks (or sink): [{type: sink, name, condition, transforms, ...}]; dlq: a sink;
    on_error, retry_count, retry_delay_seconds, batch_size. Types are keys of the registry.
    """
    given = list(spec.get("sinks") or ([spec["sink"]] if spec.get("sink") else []))
    steps = [[_step(t) for t in s.get("transforms", ())] for s in given]
    routes = [Route(s.get("name", f"{s['type']}-{i}"), _sink(s), s.get("condition"), own) for i, (s, own) in enumerate(zip(given, steps))]
    return Pipeline(
        spec["name"],
        [_step(t) for t in spec.get("transforms", ())],
        routes,
        _sink(spec["dlq"]) if spec.get("dlq") else None,
        spec.get("on_error", "continue"),
        spec.get("retry_count", 3),
        spec.get("retry_delay_seconds", 10),
        spec.get("batch_size"),
        **({"run_id": spec["run_id"]} if spec.get("run_id") else {}),
    )


def source_from(spark: SparkSession, spec: Mapping) -> DataFrame:
    """The rows that a spec's source and serializer_in describe, with the error channel open before anything is decoded."""
    config = {k: v for k, v in spec["source"].items() if k != "type"}
    return decoded(SOURCES[spec["source"]["type"]](spark, **config, **by_lines(spec)), spec)


def by_lines(spec: Mapping) -> dict[str, bool]:
    """What a source is asked for where lines are decoded one by one: files by lines, which Spark splits, so that no task holds a file."""
    decoding = spec.get("serializer_in") or {}
    whole = SOURCES.get(spec["source"]["type"]) is not scan.scan_files or decoding.get("type") != "ndjson" or decoding.get("column", "content") != "content"
    return {} if whole else {"lines": True}


def decoded(df: DataFrame, spec: Mapping) -> DataFrame:
    """A content may give any number of rows, so none of them has it in its record: that is the row as it was decoded, and of what does not decode the rest of its source."""
    decoding = spec.get("serializer_in")
    if not decoding:
        return opened(df)
    config, column = {k: v for k, v in decoding.items() if k not in ("type", "column")}, decoding.get("column", "content")
    return recorded(DECODERS[decoding["type"]](opened(df, column), column, **config))


def run_spec(spark: SparkSession, spec: Mapping) -> Counts:
    """A run from plain data. commit_log: a folder; batch: a name under which the run can be taken up.

    source with skip_processed and ledger (a folder; also source_key, lease_seconds): only files that no run has processed or is at
    are read, and they count as processed once the run has succeeded. Where a run died on its way, its files are taken
    up under its batch, so give a commit_log too.
    """
    p = pipeline_from(spec)
    log = CommitLog(spark, spec.get("commit_log"))
    source = dict(spec["source"])
    if not source.pop("skip_processed", False):
        return run_pipeline(source_from(spark, spec), p, log, spec.get("batch"))
    own = {k: source.pop(k) for k in ("ledger", "source_key", "lease_seconds", "patience_seconds") if k in source}
    ledger = Ledger(spark, own["ledger"], p.name, own.get("source_key") or source.get("path", ""), own.get("lease_seconds", 3600), own.get("patience_seconds", 60))
    config = {k: v for k, v in source.items() if k != "type"}
    files, lines = SOURCES[source["type"]](spark, **config), by_lines(spec)
    batch, files = ledger.claim(files, spec.get("batch") or p.run_id, SOURCES[source["type"]](spark, **config, **lines) if lines else None)
    try:
        out = run_pipeline(decoded(files, spec), p, log, batch)
    except Exception:
        # what has been written once stays so: the next run takes these files up under the same batch
        (ledger.open if any(log.entry(p.name, batch, r.name) for r in p.routes) else ledger.failed)(batch)
        raise
    (ledger.done if out.status == "success" else ledger.failed)(batch)
    return out


def run_counters(df: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """records_in, records_out (rows with a route), records_skipped, as one row and one pass: a run's counts if no sink fails."""
    hits = [_holds(r) for r in routes]
    some = F.lit(False)
    for h in hits:
        some = some | h
    return df.agg(F.count(F.lit(1)).alias("records_in"), F.count_if(some).alias("records_out"), F.count_if(~some).alias("records_skipped"))
