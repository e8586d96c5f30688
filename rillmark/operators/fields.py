"""Operators on the fields of each record. All are DataFrame -> DataFrame and stay in the JVM."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, NumericType, StringType

from ..errors import CHANNEL, fault
from ..paths import at, found, kind_of, put, remove
from ..registry import operator


def _text(c: Column, python_none: bool) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None")) if python_none else c.cast("string")


@operator("rename")
def rename(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One after another; a missing source is skipped, a present target is overwritten."""
    for a in fields:
        if any(b.startswith(a + ".") for b in fields):
            raise ValueError(f"{a} and a path below it are both renamed")
    for old, new in fields.items():
        if old != new and found(df, old):
            if "." not in old and "." not in new:
                df = df.drop(new).withColumnRenamed(old, new)
            else:
                df = remove(put(df, new, at(old)), old)
    return df


_TRUE = ("true", "1", "yes", "on")


@operator("cast")
def cast(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """str, int, float, bool, datetime. Missing paths are skipped; what cannot be cast is a row error."""
    for path, to in fields.items():
        kind = kind_of(df, path)
        if kind is None:
            continue
        c = at(path)
        if to == "bool":
            # by the text form, so of the numbers only a whole 1 is true; blanks are not trimmed, null is false
            new = F.coalesce(c if isinstance(kind, BooleanType) else F.lower(c.cast("string")).isin(*_TRUE), F.lit(False))
        elif to == "str":
            new = c.cast("string")
        elif to == "int":
            new = c.try_cast("bigint") if not isinstance(kind, StringType) else F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
        elif to == "float":
            new = c.try_cast("double")
        elif to == "datetime":
            new = c.try_cast("timestamp")
        else:
            raise ValueError(f"no such type: {to}")
        if to in ("int", "float", "datetime"):
            df = fault(df, new.isNull(), F.concat(F.lit(f"cast {path} to {to}: "), F.coalesce(c.cast("string"), F.lit("null"))))
        df = put(df, path, new)
    return df


@operator("add_field")
def add_field(df: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """Computed in order, each seeing the ones before it."""
    for name, expression in fields.items():
        df = df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)
    return df


@operator("drop")
def drop(df: DataFrame, fields: Sequence[str] | Mapping[str, Sequence]) -> DataFrame:
    """Without condition, or set to null where the value is one of a list."""
    if isinstance(fields, Mapping):
        for path, values in fields.items():
            if found(df, path):
                df = put(df, path, F.when(at(path).isin(*values), None).otherwise(at(path)))
        return df
    for path in fields:
        df = remove(df, path)
    return df


@operator("filter")
def filter_rows(df: DataFrame, condition: str | Column, strict: bool = False) -> DataFrame:
    """Null is false; strict reports it as a row error instead."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    if not strict:
        return df.filter(c)
    df = fault(df, c.isNull(), F.lit(f"filter is null: {condition}"))
    return df.filter(F.coalesce(c, F.lit(True)))


@operator("value_map")
def value_map(df: DataFrame, field: str, mapping: Mapping[str, object], default: object = None, python_none: bool = False) -> DataFrame:
    """Looked up as text; without a match the default, or if there is none the value itself, as text."""
    if not found(df, field):
        return df
    c = _text(at(field), python_none)
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), str(v))])
    return put(df, field, F.coalesce(F.try_element_at(table, c), F.lit(str(default)) if default is not None else c))


@operator("coalesce_fields")
def coalesce_fields(df: DataFrame, fields: Mapping[str, Mapping]) -> DataFrame:
    """The first source that is found and not an empty value; later rules see earlier outputs."""
    for out, rule in fields.items():
        empty = [v for v in rule.get("empty_values", (None, "")) if v is not None]
        picks = []
        for source in rule["sources"]:
            if found(df, source):
                c = at(source)
                own = [v for v in empty if isinstance(v, str) == isinstance(kind_of(df, source), StringType)]
                picks.append(F.when(~c.isin(*own), c) if own else c)
        default = rule.get("default")
        df = put(df, out, F.coalesce(*picks, *([F.lit(default)] if default is not None or not picks else [])))
    return df


@operator("project")
def project(df: DataFrame, fields: Mapping[str, str | Mapping]) -> DataFrame:
    """Only these fields. A found null wins over the default; a required field without a value is a row error."""
    out, needed = [], []
    for name, rule in fields.items():
        rule = {"source": rule} if isinstance(rule, str) else rule
        sources = rule.get("source_any") or [rule["source"]]
        source = next((s for s in sources if found(df, s)), None)
        out.append((at(source) if source else F.lit(rule.get("default"))).alias(name))
        if rule.get("required") and source is None and "default" not in rule:
            needed.append(name)
    for name in needed:
        df = fault(df, F.lit(True), f"project: {name} is required")
    return df.select(*out, *[c for c in CHANNEL if c in df.columns])


@operator("inject_meta")
def inject_meta(df: DataFrame, meta: Mapping[str, object], fields: Mapping[str, str] | None = None, include_all: bool = False, prefix: str = "", on_missing: str = "skip") -> DataFrame:
    """Run metadata as columns: values, or columns such as _metadata.file_name."""
    wanted = {prefix + k: k for k in meta} if include_all else {}
    wanted |= {name: key for name, key in (fields or {}).items()}
    for name, key in wanted.items():
        if key in meta:
            v = meta[key]
            df = df.withColumn(name, v if isinstance(v, Column) else F.lit(v))
        elif on_missing == "null":
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@operator("regex_extract")
def regex_extract(df: DataFrame, field: str, pattern: str, destination: str | None = None, on_no_match: str = "keep") -> DataFrame:
    """Named groups of the first match as columns, or as fields of a struct. An empty optional group is null."""
    names = list(re.compile(pattern).groupindex.items())
    java = pattern.replace("(?P<", "(?<")
    c = F.coalesce(at(field).cast("string"), F.lit("")) if found(df, field) else F.lit("")
    hit = c.rlike(java)
    groups = {n: F.when(hit, F.nullif(F.regexp_extract(c, java, i), F.lit(""))) for n, i in names}
    if on_no_match == "drop":
        df = df.filter(hit)
    if destination:
        value = F.when(hit, F.struct(*[g.alias(n) for n, g in groups.items()]))
        return df.withColumn(destination, value)
    for n, g in groups.items():
        old = F.col(n).cast("string") if on_no_match == "keep" and n in df.columns else F.lit(None).cast("string")
        df = df.withColumn(n, F.when(hit, g).otherwise(old))
    return df


@operator("template")
def template(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Format strings filled from the record as it came in. Specs: .Nf, 0Nd, Nd, >N, <N."""
    made = {}
    for name, text in fields.items():
        parts = []
        for literal, path, spec, _ in string.Formatter().parse(text):
            if literal:
                parts.append(F.lit(literal))
            if path is None:
                continue
            if not found(df, path):
                raise ValueError(f"template: no field {path}")
            c = at(path)
            if not spec:
                parts.append(F.coalesce(c.cast("string"), F.lit("None")))
            elif m := re.fullmatch(r"([<>])(\d+)", spec):
                parts.append(F.format_string(f"%{'-' if m[1] == '<' else ''}{m[2]}s", c.cast("string")))
            elif re.fullmatch(r"0?\d*\.\d+f", spec):
                parts.append(F.format_string(f"%{spec}", c.cast("double")))
            elif re.fullmatch(r"0?\d*d", spec):
                parts.append(F.format_string(f"%{spec}", c.cast("long")))
            else:
                raise ValueError(f"template: spec {spec} is not known")
        made[name] = F.concat(*parts) if parts else F.lit("")
    return df.withColumns(made)


@operator("mask")
def mask(df: DataFrame, fields: Sequence[str], mode: str = "redact", placeholder: str = "***", visible_start: int = 2, visible_end: int = 2, python_none: bool = False) -> DataFrame:
    for path in fields:
        if not found(df, path):
            continue
        c = _text(at(path), python_none)
        if mode == "redact":
            new = F.when(c.isNotNull(), F.lit(placeholder))
        elif mode == "hash":
            new = F.sha2(c.cast("binary"), 256)
        elif mode == "partial":
            new = F.when(F.length(c) <= visible_start + visible_end, F.lit(placeholder)).otherwise(F.concat(F.substring(c, 1, visible_start), F.lit(placeholder), F.right(c, F.lit(visible_end))))
            new = F.when(c.isNotNull(), new)
        else:
            raise ValueError(f"no such mode: {mode}")
        df = put(df, path, new)
    return df


_TYPES = {"str": (StringType,), "int": (IntegralType, BooleanType), "float": (DoubleType, FloatType, IntegralType), "bool": (BooleanType,)}


def reason(df: DataFrame, rules: Mapping[str, Mapping]) -> Column:
    """The first rule that a row breaks, as text; null for a valid row."""
    cases: list[tuple[Column, str]] = []
    for path, rule in rules.items():
        kind = kind_of(df, path)
        if kind is None:
            if rule.get("required"):
                cases.append((F.lit(True), f"{path}: required"))
            continue
        c = at(path)
        if rule.get("required"):
            cases.append((c.isNull(), f"{path}: required"))
        if "type" in rule and not isinstance(kind, _TYPES[rule["type"]]):
            cases.append((c.isNotNull(), f"{path}: not {rule['type']}"))
        if "min" in rule:
            cases.append((c < rule["min"], f"{path}: below {rule['min']}"))
        if "max" in rule:
            cases.append((c > rule["max"], f"{path}: above {rule['max']}"))
        if "regex" in rule:
            cases.append((~c.rlike(rule["regex"]) if isinstance(kind, StringType) else c.isNotNull(), f"{path}: no match"))
        if "allowed" in rule:
            cases.append((~c.isin(*rule["allowed"]), f"{path}: not allowed"))
    out = F.lit(None).cast("string")
    for when, text in reversed(cases):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(text)).otherwise(out)
    return out


@operator("validate")
def validate(df: DataFrame, rules: Mapping[str, Mapping], on_invalid: str = "drop") -> DataFrame:
    why = reason(df, rules)
    return df.filter(why.isNull()) if on_invalid == "drop" else fault(df, why.isNotNull(), why)


# fixed values: strftime directives and the patterns that stand for them
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%z": "xx", "%p": "a", "%I": "hh", "%a": "EEE", "%A": "EEEE", "%%": "%"}


def strftime_pattern(text: str) -> str:
    out = ""
    for m in re.finditer(r"%.|[A-Za-z]+|.", text):
        out += _STRFTIME[m[0]] if m[0][0] == "%" and len(m[0]) > 1 else f"'{m[0]}'" if m[0][0].isalpha() else m[0]
    return out


def epoch_timestamp(number: Column) -> Column:
    """Seconds up to 9,999,999,999 in magnitude, then milli-, micro- and nanoseconds."""
    n = F.abs(number)
    scale = F.when(n <= 9_999_999_999, 1e6).when(n <= 9_999_999_999_999, 1e3).when(n <= 9_999_999_999_999_999, 1.0).otherwise(1e-3)
    exact = F.when(n <= 9_999_999_999, F.round(number.cast("decimal(38,9)") * 1_000_000)).when(n <= 9_999_999_999_999, F.round(number.cast("decimal(38,9)") * 1_000)).when(n <= 9_999_999_999_999_999, number.cast("decimal(38,9)")).otherwise(F.floor(number.cast("decimal(38,9)") / 1000))
    del scale
    return F.timestamp_micros(exact.try_cast("bigint"))


_ISO = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


@operator("timestamp_normalize")
def timestamp_normalize(df: DataFrame, fields: Sequence[str], input_format: str | None = None, output_format: str = "iso", on_error: str = "raise") -> DataFrame:
    """Numbers and numeric text are epochs, other text is read by the format, then as ISO; naive times are UTC."""
    for path in fields:
        kind = kind_of(df, path)
        if kind is None:
            continue
        c = at(path)
        if isinstance(kind, NumericType):
            ts = epoch_timestamp(c)
        elif isinstance(kind, StringType):
            text = F.trim(c)
            formats = [strftime_pattern(input_format)] if input_format else []
            ts = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), epoch_timestamp(text.try_cast("decimal(38,9)"))).otherwise(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in _ISO]))
        else:
            ts = c.cast("timestamp")
        micros = F.unix_micros(ts)
        if output_format == "iso":
            new: Column = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif output_format == "datetime":
            new = ts
        elif output_format == "epoch_s":
            new = micros / 1e6
        elif output_format in ("epoch_ms", "epoch_us", "epoch_ns"):
            new = {"epoch_ms": F.unix_millis(ts), "epoch_us": micros, "epoch_ns": micros * 1000}[output_format]
        else:
            new = F.date_format(ts, strftime_pattern(output_format))
        if on_error == "raise":
            df = fault(df, ts.isNull() & c.isNotNull(), F.concat(F.lit(f"{path}: no time: "), c.cast("string")))
        elif on_error == "keep":
            new = F.coalesce(new.cast("string"), c.cast("string"))
        df = put(df, path, new)
    return df
