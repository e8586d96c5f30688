"""Functions of the expression language as columns; arguments are columns or names.

Half-way values round to even, integers are truncated, and a division by zero is null, which strict
operators report. min and max of several arguments skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_even(x, n: int = 0) -> Column:
    return F.bround(_c(x), n)


def to_int(x) -> Column:
    return _c(x).try_cast("bigint")


def to_float(x) -> Column:
    return _c(x).try_cast("double")


def to_str(x) -> Column:
    return _c(x).cast("string")


def length_of(x, kind: DataType) -> Column:
    return F.size(_c(x)) if isinstance(kind, (ArrayType, MapType)) else F.length(_c(x))


def smallest(*xs) -> Column:
    return F.array_min(_c(xs[0])) if len(xs) == 1 else F.least(*map(_c, xs))


def largest(*xs) -> Column:
    return F.array_max(_c(xs[0])) if len(xs) == 1 else F.greatest(*map(_c, xs))


def sum_of(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, b: a + b)


def truth(x, kind: DataType) -> Column:
    """Python's truth of a value; null is false."""
    c = _c(x)
    if isinstance(kind, BooleanType):
        out = c
    elif isinstance(kind, NumericType):
        out = c != 0
    else:
        out = length_of(c, kind) > 0
    return F.coalesce(out, F.lit(False))


def log_of(x, base: float | None = None) -> Column:
    return F.ln(_c(x)) if base is None else F.log(float(base), _c(x))


def now(pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.date_format(F.current_timestamp(), pattern)


def epoch() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6


def epoch_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def floor_div(a, b) -> Column:
    return F.floor(F.try_divide(_c(a), _c(b))).cast("long")


def modulo(a, b) -> Column:
    """The sign follows the divisor."""
    x, y = _c(a), _c(b)
    return F.when(y != 0, x - y * F.floor(x / y))


def has_key(m, key: str) -> Column:
    return F.map_contains_key(_c(m), key)
