"""Joins that Spark SQL has no syntax for, as compositions of joins, windows and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.topk import limit_by
from tesserae.session import saved


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, how: str = "left", direction: str = "backward", strict: bool = False, slice_of: int | None = None) -> DataFrame:
    """To each row of left the last row of right with the same `by` and right.at <= left.at.

    direction "forward" takes the first one at or after; strict leaves equal times out. Rows of right that share key and time are told apart by their other columns, the greatest counting. how "inner" drops rows without a match. Columns of right other than by come back with the prefix ``right_``.

    One shuffle on the key, no pairing of rows. slice_of (seconds, for time columns, or units) also cuts a key into slices of time, each starting from what the slices before it end with, so that one hot key spreads over many tasks.
    """
    forward = direction == "forward"
    others = [c for c in right.columns if c not in by]
    names = [c for c in left.columns if c not in by and c != at]
    none = F.lit(None)
    here = F.struct(*[F.col(c) for c in names])
    there = F.struct(F.col(at), *[F.col(c) for c in others if c != at])
    l = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), here.alias("_l"), none.cast(right.select(there.alias("s")).schema["s"].dataType).alias("_r"))
    r = right.select(*by, F.col(at).alias("_t"), F.lit(0).alias("_side"), none.cast(left.select(here.alias("s")).schema["s"].dataType).alias("_l"), there.alias("_r"))
    both = l.unionByName(r)
    # among equal times: right rows come first unless they are to be left out
    side = F.col("_side") if not strict else -F.col("_side")
    order = [F.col("_t").desc() if forward else F.col("_t").asc(), side, F.col("_r").asc_nulls_first()]
    if slice_of is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    else:
        t = F.col("_t").cast("timestamp").cast("double") if dict(left.dtypes)[at].startswith("timestamp") or dict(left.dtypes)[at] == "date" else F.col("_t").cast("double")
        both = both.withColumn("_slice", F.floor(t / slice_of))
        w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        edge = F.min_by if forward else F.max_by
        ends = both.where("_side = 0").groupBy(*by, "_slice").agg(edge("_r", F.struct("_t", "_r")).alias("_end"))
        slices = both.select(*by, "_slice").distinct().join(ends, [*by, "_slice"], "left")
        before = Window.partitionBy(*by).orderBy(F.col("_slice").desc() if forward else F.col("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        both = both.withColumn("_own", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").join(carried, [*by, "_slice"]).withColumn("_hit", F.coalesce("_own", "_carried"))
    out = both.where("_side = 1")
    if how == "inner":
        out = out.where("_hit is not null")
    return out.select(*by, F.col("_t").alias(at), *[F.col(f"_l.{c}").alias(c) for c in names], *[F.col(f"_hit.{c}").alias(f"right_{c}") for c in others])


def any_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], how: str = "left") -> DataFrame:
    """At most one row of right for each row of left: the first in this order."""
    w = Window.partitionBy(*on).orderBy(*order)
    one = right.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return left.join(one, list(on), how)


def lateral_limit(left: DataFrame, right: DataFrame, on: dict[str, str], n: int, *order: Column, how: str = "inner") -> DataFrame:
    """left, LATERAL (SELECT * FROM right WHERE its keys = left's ORDER BY order LIMIT n); on names right's key of each of left's, how "left" keeps rows of left without any.

    Spark's own plan for this numbers a key's rows as they come out of a shuffle after the sort, in any order on a cluster. Here the window has the order itself, and tasks cut a key to n rows before the shuffle (Spark does so for n up to 1,000).
    """
    first = limit_by(right, n, list(on.values()), *order).alias("_right")
    return left.alias("_left").join(first, [F.col(f"_left.`{a}`") == F.col(f"_right.`{b}`") for a, b in on.items()], how)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with the position of each row in this total order, from 1.

    Rows are sorted over all partitions, written, and numbered by the partitions' row counts, one number each on the driver; no single task sees all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: (r["n"], r["low"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).collect()}
    start, total = [], 0
    for p in sorted(counts):
        start.append((p, total - counts[p][1]))
        total += counts[p][0]
    offsets = spark.createDataFrame(start, "_part int, _off bigint")
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_off") + 1).drop("_part", "_at", "_off")


def paste_join(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """The two tables side by side, first row with first row; as many rows as the shorter has."""
    return numbered(left, left_order, "_row").join(numbered(right, right_order, "_row"), "_row").drop("_row")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high, through cells of this width, so that it is an equi-join and not a product. width: about the length of a usual range; a longer one stands in several cells."""
    cell = lambda c: F.floor(F.col(c).cast("double") / width)
    p = points.withColumn("_cell", cell(value))
    r = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return p.join(r, "_cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """(s1, e1) OVERLAPS (s2, e2): ends in either order, half open, and a point counts as an instant."""
    a1, b1, a2, b2 = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return ((a1 < b2) & (a2 < b1)) | (a1 == a2)
