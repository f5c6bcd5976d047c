"""Sorting and limits with ties, per key, by share, and with filled gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_with_ties(df: DataFrame, n: int, key: str, descending: bool = False) -> DataFrame:
    """ORDER BY key FETCH FIRST n ROWS WITH TIES, nulls last. Only the n-th key reaches the driver, from a top-n that every task has cut down; the rest is a filter, so no window sees all rows."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    last = df.select(key).orderBy(order).limit(n).agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"), (F.min if descending else F.max)(key).alias("edge")).first()
    if last["n"] < n or last["known"] < last["n"]:
        return df
    return df.where(F.col(key) >= F.lit(last["edge"]) if descending else F.col(key) <= F.lit(last["edge"]))


def limit_by(df: DataFrame, n: int, keys: Sequence[str], *order: Column, offset: int = 0) -> DataFrame:
    """LIMIT offset, n BY keys. Spark keeps only the first rows of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= offset + n)).drop("_n")


def top_percent(df: DataFrame, percent: float, *order: Column) -> DataFrame:
    """TOP percent PERCENT: that share of the rows, rounded up."""
    import math

    return df.orderBy(*order).limit(math.ceil(df.count() * percent / 100))


def carried(df: DataFrame, key: str, columns: Sequence[str], slice_of: int = 4096) -> DataFrame:
    """Nulls of columns replaced by the last value before in the order of key (a number). Each slice of keys is a task of its own; what it begins with comes from the slices' last values, one row a slice."""
    rows = df.withColumn("_slice", F.floor(F.col(key) / slice_of))
    ends = rows.groupBy("_slice").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_end_{c}") for c in columns])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_slice", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_start_{c}") for c in columns])
    inside = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, "_slice")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_start_{c}")) for c in columns}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def with_fill(df: DataFrame, key: str, low: int, high: int, step: int, interpolate: Sequence[str] = ()) -> DataFrame:
    """ORDER BY key WITH FILL FROM low TO high STEP step, with columns carried over the gaps on request."""
    every = df.sparkSession.range(low, high, step).select(F.col("id").cast(df.schema[key].dataType).alias(key))
    out = every.join(df, key, "full").select(*df.columns)
    return carried(out, key, interpolate) if interpolate else out
