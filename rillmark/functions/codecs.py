"""Hexadecimal telecom codecs as column functions. Text that is no even-length hex gives null."""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_HEX = "^([0-9A-Fa-f]{2})+$"


def is_hex(c: Column) -> Column:
    return c.rlike(_HEX)


def hex_text(c: Column, encoding: str = "utf8") -> Column:
    """Printable text, or the value as it is."""
    raw = F.when(is_hex(c), F.unhex(c))
    text = F.try_validate_utf8(raw.cast("string")) if encoding == "utf8" else F.decode(raw, "ISO-8859-1")
    return F.when(text.rlike(r"^[^\p{Cc}\p{Cs}\p{Co}\p{Cn}]+$"), text).otherwise(c)


def tbcd_digits(c: Column) -> Column:
    """Nibbles swapped pair by pair; what is no decimal digit is filler."""
    return F.when(is_hex(c), F.regexp_replace(F.regexp_replace(c, "(.)(.)", "$2$1"), "[^0-9]", ""))


def _pair(c: Column, i: int) -> Column:
    """Pair i as decimal text: nibbles above 9 print with two digits."""

    def nibble(at: int) -> Column:
        return F.conv(F.substring(c, at, 1), 16, 10)

    return F.concat(nibble(2 * i + 1), nibble(2 * i + 2))


def bcd_timestamp(c: Column) -> Column:
    """20YY-MM-DD hh:mm:ss from six bytes or more, else the pairs joined by blanks."""
    p = [_pair(c, i) for i in range(6)]
    full = F.concat(F.lit("20"), p[0], F.lit("-"), p[1], F.lit("-"), p[2], F.lit(" "), p[3], F.lit(":"), p[4], F.lit(":"), p[5])
    pairs = F.transform(F.sequence(F.lit(0), (F.length(c) / 2 - 1).cast("int")), lambda i: F.concat(F.conv(F.substring(c, (2 * i + 1).cast("int"), F.lit(1)), 16, 10), F.conv(F.substring(c, (2 * i + 2).cast("int"), F.lit(1)), 16, 10)))
    return F.when(is_hex(c), F.when(F.length(c) >= 12, full).otherwise(F.array_join(pairs, " ")))


def tbcd_timezone(c: Column) -> Column:
    """UTC+hh:mm of a signed number of quarter hours, with DST=n from the second byte if there is one."""
    first = F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    low = first.bitwiseAND(F.lit(15))
    high = F.shiftright(first, 4)
    quarters = low.bitwiseAND(F.lit(7)) * 10 + high
    minutes = quarters * 15
    sign = F.when(low.bitwiseAND(F.lit(8)) != 0, "-").otherwise("+")
    text = F.format_string("UTC%s%02d:%02d", sign, F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    dst = F.conv(F.substring(c, 3, 2), 16, 10).cast("int").bitwiseAND(F.lit(3)).cast("string")
    return F.when(is_hex(c), F.when(F.length(c) >= 4, F.concat(text, F.lit(" DST="), dst)).otherwise(text))


@F.pandas_udf(StringType())
def _ipv6(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else str(ipaddress.IPv6Address(bytes.fromhex(x))))


def packed_ipv4(c: Column) -> Column:
    parts = [F.conv(F.substring(c, 2 * i + 1, 2), 16, 10) for i in range(4)]
    return F.when(is_hex(c) & (F.length(c) == 8), F.concat_ws(".", *parts))


def packed_ip(c: Column) -> Column:
    """Four bytes as dotted IPv4, sixteen as compressed IPv6, else null."""
    return F.coalesce(packed_ipv4(c), _ipv6(F.when(is_hex(c) & (F.length(c) == 32), c)))


def bit_flags(c: Column, bit_length: Column | int | None = None, mapping: Mapping[int, str] | None = None, output: str = "indexes") -> Column:
    """The set bits, counted from the most significant: their numbers, names, or both. A length beyond the bytes is null."""
    nibbles = F.transform(F.split(F.upper(c), ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0"))
    bits = F.array_join(F.filter(nibbles, lambda x: x.isNotNull()), "")
    n = F.length(c) * 4 if bit_length is None else F.lit(bit_length) if isinstance(bit_length, int) else bit_length
    every = F.when(is_hex(c) & (n <= F.length(c) * 4) & (n > 0), F.sequence(F.lit(0), (n - 1).cast("int")))
    found = F.filter(every, lambda i: F.substring(bits, i + 1, F.lit(1)) == "1")
    names = F.create_map(*[F.lit(x) for k, v in sorted((mapping or {}).items()) for x in (k, v)]) if mapping else None
    named = F.transform(found, lambda i: F.coalesce(F.try_element_at(names, i) if names is not None else F.lit(None).cast("string"), F.concat(F.lit("bit_"), i.cast("string"))))
    return found if output == "indexes" else named if output == "names" else F.struct(found.alias("indexes"), named.alias("names"))
