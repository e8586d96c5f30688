"""Operators, sources, decoders and sinks by key, so that a spec can name them; user code joins in by the same decorators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OPERATORS: dict[str, Callable[..., DataFrame]] = {}  # (df, **config) -> df
SOURCES: dict[str, Callable[..., DataFrame]] = {}  # (spark, **config) -> df
DECODERS: dict[str, Callable[..., DataFrame]] = {}  # (df, column, **config) -> df
SINKS: dict[str, Callable[..., None]] = {}  # (df, **config)


def _adder(table: dict[str, Callable], what: str):
    def decorator(*keys: str):
        def add(f: Callable) -> Callable:
            for key in keys:
                if table.get(key, f) is not f:
                    raise ValueError(f"{what} {key} exists")
                table[key] = f
            return f

        return add

    return decorator


operator, source, decoder, sink = _adder(OPERATORS, "operator"), _adder(SOURCES, "source"), _adder(DECODERS, "decoder"), _adder(SINKS, "sink")


def from_record_fn(fn: Callable[[dict], dict | list[dict] | None], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame operator from Python code for one record: it returns a record, several, or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for record in pdf.to_dict("records"):
                got = fn(record)
                out += got if isinstance(got, list) else [] if got is None else [got]
            yield pd.DataFrame(out)

    return lambda df: df.mapInPandas(run, schema)
