"""Dotted paths over a DataFrame's schema. A path that the schema lacks is "not found"; null is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def kind_of(df: DataFrame, path: str) -> DataType | None:
    """The type at a path, or None where the schema has no such path."""
    kind: DataType = df.schema
    for key in path.split("."):
        if not isinstance(kind, StructType) or key not in kind.names:
            return None
        kind = kind[key].dataType
    return kind


def found(df: DataFrame, path: str) -> bool:
    return kind_of(df, path) is not None


def at(path: str) -> Column:
    head, *rest = path.split(".")
    out = F.col(f"`{head}`")
    for key in rest:
        out = out.getField(key)
    return out


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a path; missing structs on the way are made, a value of another kind there is an error."""
    head, *rest = path.split(".")
    if not rest:
        return df.withColumn(head, value)
    for i in range(1, len(rest) + 1):
        kind = kind_of(df, ".".join([head, *rest[: i - 1]]))
        if kind is None:
            made = value
            for key in reversed(rest[i - 1 :]):
                made = F.struct(made.alias(key))
            return put(df, ".".join([head, *rest[: i - 1]]), made)
        if not isinstance(kind, StructType):
            raise ValueError(f"{path}: {'.'.join([head, *rest[: i - 1]])} is not a struct")
    return df.withColumn(head, F.col(f"`{head}`").withField(".".join(rest), value))


def remove(df: DataFrame, path: str) -> DataFrame:
    head, *rest = path.split(".")
    if not found(df, path):
        return df
    if not rest:
        return df.drop(head)
    parent = kind_of(df, path.rpartition(".")[0])
    if len(parent.names) == 1:  # a struct cannot lose its last field
        return remove(df, path.rpartition(".")[0])
    return df.withColumn(head, F.col(f"`{head}`").dropFields(".".join(rest)))
