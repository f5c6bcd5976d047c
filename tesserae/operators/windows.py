"""Window frames and filters that Spark SQL lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, name: str, value: Column, keep: Column) -> DataFrame:
    """QUALIFY: filter on a window value after it is computed; name is dropped again."""
    return df.withColumn(name, value).where(keep).drop(name)


def filtered(agg, value: Column, condition: Column) -> Column:
    """agg(value) FILTER (WHERE condition) for use in a window."""
    return agg(F.when(condition, value))


def groups_frame(df: DataFrame, agg: Column, name: str, partition: Sequence[str], order: Column, low: int, high: int) -> DataFrame:
    """GROUPS BETWEEN low AND high: peers are numbered by dense_rank, over which the frame is a RANGE."""
    peers = Window.partitionBy(*partition).orderBy(order)
    frame = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(low, high)
    return df.withColumn("_peer", F.dense_rank().over(peers)).withColumn(name, agg.over(frame)).drop("_peer")


def exclude(df: DataFrame, value: str, name: str, partition: Sequence[str], order: Sequence[Column], what: str) -> DataFrame:
    """sum(value) over the whole partition's frame EXCLUDE CURRENT ROW, GROUP or TIES. Sums and counts can be taken back, so no frame is materialised."""
    whole = Window.partitionBy(*partition)
    total = F.sum(value).over(whole)
    if what == "current row":
        out = total - F.coalesce(F.col(value), F.lit(0))
    else:
        df = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
        group = F.sum(value).over(Window.partitionBy(*partition, "_peer"))
        out = total - F.coalesce(group, F.lit(0)) + (F.coalesce(F.col(value), F.lit(0)) if what == "ties" else F.lit(0))
    return df.withColumn(name, out).drop("_peer")
