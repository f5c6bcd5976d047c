"""Aggregations beyond GROUP BY."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: Iterable[Sequence[str]], keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One aggregation for all sets; grouping_id tells them apart. keys: all columns that occur, in order."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(*aggs, F.grouping_id().cast("bigint").alias("grouping_id"))


def with_totals(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """GROUP BY keys WITH TOTALS: the groups, and one row over all with is_total true."""
    out = df.groupingSets([[F.col(c) for c in keys], []], *[F.col(c) for c in keys]).agg(*aggs, F.grouping_id().alias("_g"))
    return out.withColumn("is_total", F.col("_g") != 0).drop("_g")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order, by an aggregation with partial minima where the order allows, here by a window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordered_list(value: str, *order: str) -> Column:
    """array_agg(value ORDER BY order): the sort happens in the group's own array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"])


def hypothetical_rank(value: Column, candidate) -> Column:
    """rank(candidate) WITHIN GROUP (ORDER BY value): one more than the smaller values."""
    return F.count(F.when(value < candidate, 1)) + 1


def sum_map(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Maps added up key by key."""
    rows = df.select(*keys, F.explode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(out))


def geometric_mean():
    """A user aggregate: state, step and final function as a grouped Pandas UDF."""

    @F.pandas_udf("double")
    def geomean(v: pd.Series) -> float:
        import numpy as np

        v = v[v > 0]
        return float(np.exp(np.log(v).mean())) if len(v) else None

    return geomean
