"""Grouping, joining, ordering and merging of whole tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window

from ..paths import at, found, kind_of
from ..registry import operator

BROADCAST_BYTES = 32 << 20
PREFIXES = 200  # different lengths of prefixes that are listed


@operator("aggregate")
def aggregate(df: DataFrame, group_by: Sequence[str], operations: Mapping[str, str | Mapping], order_by: Sequence[str] = ()) -> DataFrame:
    """sum, avg, min, max, count, first, last as "op:field" or {op, field}.

    Numbers only count for the first four; count is of non-null values; first and last follow
    order_by and take nulls too. No input row gives no output row, also without groups. Null is a group.
    """
    order = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    out: list[Column] = []
    for name, spec in operations.items():
        op, field = spec.split(":", 1) if isinstance(spec, str) else (spec["op"], spec.get("field", ""))
        kind = kind_of(df, field) if field else None
        c = at(field) if kind is not None else F.lit(None).cast("double")
        if op == "count":
            out.append((F.count(c) if field else F.count(F.lit(1))).alias(name))
        elif op in ("first", "last"):
            pick = (F.min_by if op == "first" else F.max_by)(F.struct(c.alias("v")), "_order")
            out.append(pick.getField("v").alias(name))
        elif op in ("sum", "avg", "min", "max"):
            if isinstance(kind, BooleanType):
                c = c.cast("int")
            elif not isinstance(kind, NumericType):
                c = F.lit(None).cast("double")
            out.append({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](c).alias(name))
        else:
            raise ValueError(f"no such operation: {op}")
    rows = df.withColumn("_order", order) if any("_order" in str(c) for c in out) else df
    if group_by:
        return rows.groupBy(*[at(g).alias(g.split(".")[-1]) for g in group_by]).agg(*out)
    return rows.agg(F.count(F.lit(1)).alias("_n"), *out).filter("_n > 0").drop("_n")


def small(df: DataFrame) -> bool:
    """Whether the optimiser's size estimate allows a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= BROADCAST_BYTES


@operator("enrich")
def enrich(df: DataFrame, lookup: DataFrame, join_key: str, lookup_key: str | None = None, add_fields: Sequence[str] | Mapping[str, str] | None = None, prefix: str = "", on_miss: str = "keep", order_by: Sequence[str] = ()) -> DataFrame:
    """Left join on the key as text; of equal lookup keys the last counts, a null key matches nothing.

    Copied fields overwrite columns of their names for matching rows; for others they stay, or with
    on_miss="null_fields" become null. The lookup is broadcast if its estimated size is small.
    """
    key = lookup_key or join_key
    names = dict(add_fields) if isinstance(add_fields, Mapping) else {f: prefix + f for f in (add_fields or [c for c in lookup.columns if c != key])}
    order = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    last = lookup.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k"), F.struct(*names).alias("_v"), order.alias("_o")).groupBy("_k").agg(F.max_by("_v", "_o").alias("_v"))
    right = F.broadcast(last) if small(lookup) else last
    joined = df.withColumn("_j", at(join_key).cast("string")).join(right, F.col("_j") == F.col("_k"), "left")
    for field, name in names.items():
        value = F.col("_v").getField(field)
        if on_miss == "keep" and name in df.columns:
            value = F.when(F.col("_k").isNotNull(), value).otherwise(F.col(name))
        joined = joined.withColumn(name, value)
    return joined.drop("_j", "_k", "_v")


@operator("deduplicate")
def deduplicate(df: DataFrame, fields: Sequence[str], keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the first or the last by order_by. Null is a key.

    Sorting happens as an aggregation of structs, with map-side combination, so a hot key is no burden.
    """
    order = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    keys = [at(f) if found(df, f) else F.lit(None).cast("string") for f in fields]
    pick = F.min_by if keep == "first" else F.max_by
    rows = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[f"`{c}`" for c in df.columns]).alias("_r"), order.alias("_o"))
    return rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(pick("_r", "_o").alias("_r")).select("_r.*")


@operator("sort")
def sort(df: DataFrame, fields: Sequence[str], reverse: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """Nulls come first, or with reverse last; order_by breaks ties."""
    return df.orderBy(*[at(f).desc_nulls_last() if reverse else at(f).asc_nulls_first() for f in fields], *order_by)


@operator("limit")
def limit(df: DataFrame, count: int) -> DataFrame:
    if count <= 0:
        raise ValueError("count must be positive")
    return df.limit(count)


def first_per(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


@operator("upsert")
def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Rows of target that new does not replace, and the last new row of each key."""
    last = deduplicate(new, keys, "last", order_by)
    return target.join(last.select(*keys), list(keys), "left_anti").select(target.columns).unionByName(last, allowMissingColumns=True)


@operator("skip_processed")
def skip_processed(df: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ledger.select(*keys), list(keys), "left_anti")


@operator("longest_prefix")
def longest_prefix(df: DataFrame, table: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """name and rest for a dotted identifier: the longest prefix in table (prefix, name), and what follows it.

    Unknown ones keep their own text. Of equal prefixes the last name counts. The table is an index by the number of a prefix's parts: each different
    identifier is cut to the lengths that the table has, no others, the cuts are joined with the prefixes by equality, and the longest
    hit is joined back. Both joins broadcast only what the optimiser knows to be small.
    """
    pattern = "[.]" if separator == "." else java_quote(separator)
    text = F.col(column)

    def parts(c: Column) -> Column:
        return F.split(c, pattern)

    known = table.filter("prefix is not null").groupBy(F.col("prefix").cast("string").alias("_p")).agg(F.max(F.col("name").cast("string")).alias("_name"))
    known = known.withColumn("_n", F.size(parts(F.col("_p"))))
    lengths = sorted(r["_n"] for r in known.select("_n").distinct().limit(PREFIXES + 1).collect())
    ids = df.select(text.alias("_id")).filter("_id is not null").distinct()
    own = parts(F.col("_id"))
    # a table of prefixes of very many lengths would be no index: then every cut is one
    wanted = F.array(*map(F.lit, lengths)).cast("array<int>") if len(lengths) <= PREFIXES else F.sequence(F.lit(1), F.size(own))
    cuts = ids.withColumn("_n", F.explode(F.filter(wanted, lambda n: n <= F.size(own))))
    cuts = cuts.select("_id", "_n", F.array_join(F.slice(own, F.lit(1), F.col("_n")), separator).alias("_p"))
    right = F.broadcast(known) if small(table) else known
    best = cuts.join(right, ["_p", "_n"]).groupBy("_id").agg(F.max_by(F.struct("_p", "_name"), "_n").alias("_b")).select("_id", "_b.*")
    out = df.join(best, text == F.col("_id"), "left").drop("_id")
    rest = F.when(F.col("_p").isNotNull(), F.substring(text, F.length("_p") + 1, F.length(text))).otherwise(F.lit(""))
    return out.withColumns({"name": F.coalesce("_name", text), "rest": rest}).drop("_p", "_name")


def java_quote(text: str) -> str:
    """A pattern that matches the text as it is."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)
