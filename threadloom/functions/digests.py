"""Digests of values in one canonical form, and enums that stay open without leaking."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import TIMESTAMP_RANGE


def canonical(value) -> str:
    """ASCII JSON with sorted keys and no blanks."""
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode("ascii")).hexdigest()


@F.pandas_udf(T.StringType())
def digest_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Digest of the value that each JSON text stands for; null for null. For values with floats, nulls or characters above ASCII."""
    for part in texts:
        yield part.map(lambda t: None if t is None else digest(json.loads(t)))


def quoted(c: Column) -> Column:
    """A string as a JSON string; for text of printable ASCII, which all names and digests of ours are."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def digest_list(*parts: Column | str | int) -> Column:
    """Digest of a list of printable ASCII strings and integers, in the JVM."""
    items: list[Column] = []
    for k, p in enumerate(parts):
        items += [F.lit(",")] * bool(k)
        items.append(F.lit(json.dumps(p)) if isinstance(p, (str, int)) else p)
    return F.sha2(F.concat(F.lit("["), *items, F.lit("]")), 256)


def enum_value(value, allowed: Iterable[str]) -> str:
    if value is None:
        return "missing"
    return value if isinstance(value, str) and value in allowed else f"unknown:{digest(value)}"


def open_enum(c: Column, allowed: Iterable[str]) -> Column:
    """A known value, ``missing``, or the digest of an unknown one (printable ASCII)."""
    known = F.when(c.isNull(), "missing").when(c.isin(*sorted(allowed)), c)
    return known.otherwise(F.concat(F.lit("unknown:"), F.sha2(quoted(c), 256)))


def checked_timestamp(c: Column) -> Column:
    """Seconds within years 1 to 9999; null passes, all else stops the query with a fixed code."""
    value = c.cast("double")
    low, high = TIMESTAMP_RANGE
    return F.when(c.isNull(), F.lit(None).cast("double")).when(value.between(low, high), value).otherwise(F.raise_error(F.lit("TIMESTAMP_FORMAT")).cast("double"))


def iso_utc(c: Column) -> Column:
    """Unix seconds as ISO 8601 in UTC, in any session time zone; microseconds only where there are any."""
    micros = F.round((c - F.floor(c)) * 1_000_000).cast("long")
    seconds = F.floor(c).cast("long") + F.when(micros == 1_000_000, 1).otherwise(0)
    day = F.floor(seconds / 86_400).cast("int")
    at = seconds - day.cast("long") * 86_400
    clock = F.format_string("T%02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)
    return F.concat(F.date_from_unix_date(day).cast("string"), clock, F.when(micros.between(1, 999_999), F.format_string(".%06d", micros)).otherwise(""), F.lit("+00:00"))
