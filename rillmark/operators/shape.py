"""Operators that change a record's shape: flatten, explode, unnest, melt and the like."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegralType, LongType, MapType, NumericType, StringType, StructType

from ..errors import CHANNEL, ERRORS, fault
from ..functions import codecs
from ..paths import at, found, kind_of, put, remove
from ..registry import operator


def _leaves(kind: DataType, column: Column, name: str, separator: str, depth: int) -> list[tuple[str, Column, DataType]]:
    if isinstance(kind, StructType) and kind.fields and depth != 0:
        return [x for f in kind.fields for x in _leaves(f.dataType, column.getField(f.name), f"{name}{separator}{f.name}" if name else f.name, separator, depth - 1)]
    return [(name, column, kind)]


@operator("flatten")
def flatten(df: DataFrame, separator: str = "_", max_depth: int = 0, prefix: str = "") -> DataFrame:
    """Structs become columns, lists stay. max_depth 0 goes all the way. Of equal names the last wins."""
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        if f.name in CHANNEL:
            out[f.name] = F.col(f.name)
            continue
        for name, c, _ in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name, separator, max_depth or -1):
            out[prefix + name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


@operator("explode")
def explode(df: DataFrame, field: str, include_index: bool = False, index_field: str = "index", drop_source: bool = True) -> DataFrame:
    """A row for each element; null and other kinds pass unchanged, an empty list gives no row.

    The fields of a struct element are merged at the top, over fields of the same name; a scalar
    element takes the field's place. The index counts from 0.
    """
    kind = kind_of(df, field)
    if not isinstance(kind, ArrayType):
        return df
    one = F.array(F.lit(None).cast(kind.elementType))
    rows = df.select("*", F.posexplode(F.coalesce(at(field), one)).alias("_i", "_e"))
    whole = at(field).isNull()
    if include_index:
        rows = rows.withColumn(index_field, F.when(~whole, F.col("_i")))
    if isinstance(kind.elementType, StructType):
        for f in kind.elementType.fields:
            value = F.col("_e").getField(f.name)
            if f.name in df.columns and f.name != field:
                value = F.when(whole, F.col(f"`{f.name}`")).otherwise(value)
            if f.name == field:
                rows = rows.withColumn("_own", value)
            else:
                rows = rows.withColumn(f.name, value)
        if field in kind.elementType.names:
            rows = rows.drop(field).withColumnRenamed("_own", field)
        elif drop_source:
            rows = remove(rows, field)
        return rows.drop("_i", "_e")
    return put(rows, field, F.col("_e")).drop("_i", "_e")


@operator("unnest")
def unnest(df: DataFrame, field: str, prefix: str = "", drop_source: bool = True, on_non_dict: str = "keep") -> DataFrame:
    """The struct's fields as columns, over columns of the same name."""
    kind = kind_of(df, field)
    if kind is None:
        return df
    if not isinstance(kind, StructType):
        return df if on_non_dict == "keep" else df.filter(F.lit(False)) if on_non_dict == "drop" else fault(df, F.lit(True), f"unnest: {field} is no struct")
    if on_non_dict == "drop":
        df = df.filter(at(field).isNotNull())
    elif on_non_dict == "raise":
        df = fault(df, at(field).isNull(), f"unnest: {field} is null")
    held = df.withColumn("_s", at(field))
    if drop_source:
        held = remove(held, field)
    return held.withColumns({prefix + f.name: F.col("_s").getField(f.name) for f in kind.fields}).drop("_s")


def _equals(keys: Sequence[str], value: object):
    def same(x: Column) -> Column:
        for k in keys:
            x = x.getField(k)
        return x == value

    return same


@operator("select_from_list")
def select_from_list(df: DataFrame, field: str, select: Sequence[Mapping], on_no_match: str = "null_fields") -> DataFrame:
    """Fields of the first element that matches (or of the first), lifted to the top."""
    for rule in select:
        items = at(field)
        for path, value in (rule.get("match") or {}).items():
            items = F.filter(items, _equals(path.split("."), value))
        first = F.get(items, 0)
        if on_no_match == "raise":
            df = fault(df, first.isNull(), f"{field}: no element matches")
        for out, path in rule["output"].items():
            c = first
            for k in path.split("."):
                c = c.getField(k)
            df = df.withColumn(out, c)
    return df


@operator("json_flatten")
def json_flatten(df: DataFrame, explode_paths: Sequence[str] = (), zip_groups: Sequence[Sequence[str]] = (), choice_unwrap: Mapping[str, str] | None = None, separator: str = ".", keep_empty_rows: bool = True, preserve_lists: bool = True, max_depth: int = 0, drop_paths: Sequence[str] = (), strict_zip: bool = True) -> DataFrame:
    """Explodes, then zips, unwrapped choices, flattening, and dropped paths, in this order.

    A choice is a struct of type and value: "value" keeps the value, "both" adds the type beside it.
    """
    for path in explode_paths:
        if found(df, path):
            kind = kind_of(df, path)
            if not isinstance(kind, ArrayType):
                df = fault(df, at(path).isNotNull(), f"{path} is no list")
                continue
            df = df.withColumn("_e", (F.explode_outer if keep_empty_rows else F.explode)(at(path)))
            df = put(df, path, F.col("_e")).drop("_e")
    for group in zip_groups:
        present = [p for p in group if found(df, p)]
        if not present:
            continue
        sizes = [F.size(F.coalesce(at(p), F.array())) for p in present]
        if strict_zip and len(present) > 1:
            df = fault(df, F.least(*sizes) != F.greatest(*sizes), "zipped lists differ in length: " + ", ".join(present))
        names = [f"_z{i}" for i in range(len(present))]
        df = df.withColumns(dict(zip(names, map(at, present)))).withColumn("_e", (F.explode_outer if keep_empty_rows else F.explode)(F.arrays_zip(*names)))
        for n, p in zip(names, present):
            df = put(df, p, F.col("_e").getField(n))
        df = df.drop("_e", *names)
    for path, mode in (choice_unwrap or {}).items():
        kind = kind_of(df, path)
        if isinstance(kind, StructType) and {"type", "value"} <= set(kind.names) and mode != "keep":
            if mode == "both":
                df = put(df, path + "_type", at(path).getField("type"))
            df = put(df, path, at(path).getField("value"))
    df = flatten(df, separator, max_depth)
    if not preserve_lists:
        for f in df.schema.fields:
            if isinstance(f.dataType, ArrayType) and f.name != ERRORS:
                df = fault(df, F.col(f"`{f.name}`").isNotNull(), f"{f.name} is a list")
    gone = [c for c in df.columns if any(_fits(c, p, separator) for p in drop_paths)]
    return df.drop(*[F.col(f"`{c}`") for c in gone])


def _fits(name: str, pattern: str, separator: str) -> bool:
    """Exact, below an exact path, or with * for one segment."""
    a, b = name.split(separator), pattern.split(".")
    return len(a) >= len(b) and all(y == "*" or x == y for x, y in zip(a, b)) and (len(a) == len(b) or "*" not in b)


@operator("melt")
def melt(df: DataFrame, value_field: str, label_fields: Sequence[str] = (), metric_name_col: str = "metric_name", metric_value_col: str = "metric_value", drop_source: bool = True, include_only: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """A row for each entry of a map or struct; exclude wins over include, no include takes all. Null maps pass as one row.

    The values of a struct take the widest of their types: whole numbers stay whole, with fractions they are doubles, and
    with anything else text. Fields of label structs become columns; a row that passes keeps its labels as they are.
    """
    kind = kind_of(df, value_field)
    if not isinstance(kind, (MapType, StructType)):
        return df
    m = at(value_field)
    if isinstance(kind, StructType):
        names = [n for n in kind.names if (not include_only or n in include_only) and n not in exclude]
        value = _widest([f.dataType for f in kind.fields])
        entries = F.array(*[F.struct(F.lit(n).alias("k"), m.getField(n).cast(value).alias("v")) for n in names]) if names else None
    else:
        value = kind.valueType
        entries = F.map_entries(m)
        if include_only:
            entries = F.filter(entries, lambda e: e["key"].isin(*include_only))
        if exclude:
            entries = F.filter(entries, lambda e: ~e["key"].isin(*exclude))
        entries = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast(value).alias("v")))
    df = df.withColumn("_null", m.isNull())
    if entries is None:
        df, entries = df.filter("_null"), none
    # of a struct each row has entries, so the outer form does the same and no filter on the list is inferred
    inline = F.inline_outer if isinstance(kind, StructType) else F.inline
    df = df.withColumn("_m", F.when(m.isNull(), none).otherwise(entries))
    rows = df.select("*", inline("_m").alias(metric_name_col, metric_value_col)).drop("_m")
    for label in label_fields:
        own = kind_of(rows, label)
        if isinstance(own, StructType):
            rows = rows.withColumns({n: F.when(~F.col("_null"), at(label).getField(n)) for n in own.names})
            if drop_source:
                rows = put(rows, label, F.when(F.col("_null"), at(label)))
    rows = rows.drop("_null")
    return remove(rows, value_field) if drop_source else rows


def _widest(kinds: Sequence[DataType]) -> DataType:
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, IntegralType) for k in kinds):
        return LongType()
    return DoubleType() if all(isinstance(k, NumericType) for k in kinds) else StringType()


@operator("extract_paths")
def extract_paths(df: DataFrame, fields: Mapping[str, str], column: str, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """The record is replaced by paths ($.a.b, $.a[0]) of a JSON text column; kinds gives their types (string)."""
    v = F.try_parse_json(column)
    return df.select(*[F.try_variant_get(v, path, (kinds or {}).get(name, "string")).alias(name) for name, path in fields.items()])


_DECODERS = {
    "text": lambda c, o: codecs.hex_text(c, "utf8"),
    "latin1": lambda c, o: codecs.hex_text(c, "latin1"),
    "tbcd": lambda c, o: codecs.tbcd_digits(c),
    "bcd_timestamp": lambda c, o: codecs.bcd_timestamp(c),
    "timezone": lambda c, o: codecs.tbcd_timezone(c),
    "ip": lambda c, o: codecs.packed_ip(c),
    "flags": lambda c, o: codecs.bit_flags(c, o.get("bit_length"), o.get("mapping"), o.get("output", "indexes")),
    "hex": lambda c, o: c,
}


@operator("hex_decode")
def hex_decode(df: DataFrame, mode: str = "text", overrides: Sequence[Mapping] = (), preserve_original: bool = False, original_suffix: str = "_hex") -> DataFrame:
    """Every text leaf by the mode ("text", or "none" for overrides only); an exact override beats a pattern."""
    leaves = [x for f in df.schema.fields if f.name not in CHANNEL for x in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name, ".", -1)]
    for name, c, kind in leaves:
        rule = next((o for o in overrides if o["path"] == name), None) or next((o for o in overrides if "*" in o["path"] and len(o["path"].split(".")) == len(name.split(".")) and fnmatchcase(name, o["path"])), None)
        how = rule["decode_as"] if rule else mode
        if how == "none":
            continue
        text = isinstance(kind, StringType)
        if not text and not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)):
            continue
        new = _DECODERS[how](c, rule or {}) if text else F.transform(c, lambda x: _DECODERS[how](x, rule or {}))
        if preserve_original:
            df = put(df, name + original_suffix, c)
        df = put(df, name, new)
    return df


def java_pattern(python: str) -> str:
    return re.sub(r"\(\?P<", "(?<", python)
