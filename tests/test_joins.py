"""Joins on small frames where the answer is plain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators.joins import lateral_limit


def test_lateral_limit(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, name string")
    right = spark.createDataFrame([(1, 5.0, 10), (1, 7.0, 12), (1, 7.0, 11), (1, None, 13), (2, None, 20), (None, 9.0, 30), (4, 1.0, 40)], "of int, price double, id int")
    order = F.col("price").desc_nulls_last(), F.col("id").asc_nulls_last()
    got = lambda n, how="inner": sorted(((r.name, r.id) for r in lateral_limit(left, right, {"k": "of"}, n, *order, how=how).select("name", "id").collect()), key=repr)
    assert got(2) == [("a", 11), ("a", 12), ("b", 11), ("b", 12), ("c", 20)]
    assert got(4) == [(x, i) for x in "ab" for i in (10, 11, 12, 13)] + [("c", 20)]
    assert got(0) == []
    assert got(1, "left") == [("a", 11), ("b", 11), ("c", 20), ("d", None), ("e", None)]


def test_lateral_limit_of_a_table_with_itself(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "k int, id int")
    out = lateral_limit(rows, rows, {"k": "k"}, 1, F.col("id").desc())
    assert sorted(out.select("_left.id", F.col("_right.id").alias("top")).collect()) == [(10, 11), (11, 11), (20, 20)]
