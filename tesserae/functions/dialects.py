"""Functions of the PostgreSQL, T-SQL and ClickHouse dialects that Spark names otherwise or lacks, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_part(c: Column, sep: str, n: int) -> Column:
    return F.split_part(c, F.lit(sep), F.lit(n))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """replaceRegexpOne: the first match only."""
    return F.regexp_replace(c, f"(?s)^(.*?){pattern}", f"$1{by}")


def quote_literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def stuff(c: Column, start: int, length: int, by: str) -> Column:
    """T-SQL STUFF: delete from start, put in."""
    return F.overlay(c, F.lit(by), F.lit(start), F.lit(length))


def charindex(sub: str, c: Column) -> Column:
    return F.locate(sub, c)


def start_of(unit: str, c: Column) -> Column:
    """toStartOfHour and its kind."""
    return F.date_trunc(unit, c)


def start_of_interval(c: Column, seconds: int) -> Column:
    """toStartOfInterval for a number of seconds."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(c.cast("timestamp")) / seconds) * seconds)


def age_days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def datediff(unit: str, a: Column, b: Column) -> Column:
    """T-SQL DATEDIFF: boundaries crossed between a and b."""
    if unit == "day":
        return F.datediff(b, a)
    if unit == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "year":
        return F.year(b) - F.year(a)
    seconds = {"hour": 3600, "minute": 60, "second": 1}[unit]
    whole = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    return whole(b) - whole(a)


def multi_if(*args) -> Column:
    """multiIf(c1, v1, c2, v2, ..., else)."""
    out = args[-1] if isinstance(args[-1], Column) else F.lit(args[-1])
    for i in range(len(args) - 3, -1, -2):
        out = F.when(args[i], args[i + 1]).otherwise(out)
    return out


def array_cumsum(c: Column) -> Column:
    """arrayCumSum."""
    return F.transform(c, lambda _, i: F.aggregate(F.slice(c, 1, i + 1), F.lit(0).cast("double"), lambda a, x: a + x))


def array_enumerate(c: Column) -> Column:
    return F.sequence(F.lit(1), F.size(c))


def normalize_utf8(form: str):
    """normalizeUTF8NFC and its kind: an Arrow-batched UDF, there being no built-in."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 64-bit numbers need 92 at most."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b"))))
    return pair["a"]


def truncate(c: Column) -> Column:
    """trunc of a number: towards zero."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def num_nulls(*columns: Column) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.isnull(c).cast("int")
    return out


def array_positions(c: Column, x) -> Column:
    """All places of x, from 1."""
    return F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.element_at(c, i).eqNullSafe(F.lit(x)))


def array_replace(c: Column, old, new) -> Column:
    return F.transform(c, lambda x: F.when(x.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(x))


def array_resize(c: Column, n: int, fill) -> Column:
    return F.concat(F.slice(c, 1, n), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(n) - F.size(c))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
