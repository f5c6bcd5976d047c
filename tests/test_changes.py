from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.catalog import dialects, rules
from tesserae.operators import dml
from tesserae.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_keeps_rows_without_a_key(spark):
    target, source = frame(spark, [(1, 10), (None, 20)], "k int, v int"), frame(spark, [(1, 11), (None, 5)], "k int, v int")
    out = dml.merge(target, source, "k", matched=[(F.lit(True), "update", {"v": F.col("s_v")})], not_matched=[(F.lit(True), {"k": F.col("s_k"), "v": F.col("s_v")})])
    assert rows_of(out) == rows_of(frame(spark, [(1, 11, "update"), (None, 20, None), (None, 5, "insert")], "k int, v int, action string"))


def test_merge_refuses_to_change_a_row_twice(spark):
    target, source = frame(spark, [(1, 10), (2, 20)], "k int, v int"), frame(spark, [(1, 11), (1, 12), (3, 1), (3, 2)], "k int, v int")
    change = {"matched": [(F.lit(True), "update", {"v": F.col("s_v")})], "not_matched": [(F.lit(True), {"k": F.col("s_k"), "v": F.col("s_v")})]}
    with pytest.raises(Exception, match="changed twice"):
        dml.merge(target, source, "k", **change).collect()
    assert len(dml.merge(target, source.where("k = 3"), "k", **change).collect()) == 4


def test_upsert_and_repeated_keys(spark):
    target, new = frame(spark, [(1, 10)], "k int, v int"), frame(spark, [(2, 7), (2, 6), (None, 1), (None, 1), (1, 3)], "k int, v int")
    assert rows_of(dml.upsert(target, new, ["k"], "nothing")) == rows_of(frame(spark, [(1, 10), (2, 6), (None, 1), (None, 1)], "k int, v int"))
    with pytest.raises(Exception, match="stands twice"):
        dml.upsert(target, new, ["k"]).collect()
    assert rows_of(dml.upsert(target, new.where("k is null or k = 1"), ["k"])) == rows_of(frame(spark, [(1, 3), (None, 1), (None, 1)], "k int, v int"))


def test_changes_tell_nulls_apart(spark):
    old, new = frame(spark, [(1, None, 7), (None, 1, 1), (3, 1, 1)], "k int, a int, b int"), frame(spark, [(1, 7, None), (None, 1, 1), (4, 1, 1)], "k int, a int, b int")
    assert rows_of(dml.changes_between(old, new, ["k"])) == [(1, "U"), (3, "D"), (4, "I")]


def test_range_dictionary_keeps_repeated_rows(spark):
    table = frame(spark, [(1, 0, 9, "a"), (1, 5, 9, "b")], "k int, lo int, hi int, v string")
    rows = frame(spark, [(1, 6), (1, 6), (1, 2), (1, 50), (None, 6)], "k int, at int")
    assert rows_of(readers.range_dictionary(rows, table, "k", "at", "lo", "hi", "v")) == rows_of(frame(spark, [(1, 6, "b"), (1, 6, "b"), (1, 2, "a"), (1, 50, None), (None, 6, None)], "k int, at int, v string"))


def test_open_xml_keeps_places_of_missing_children(spark):
    doc = frame(spark, [("<d><r><a>1</a><b>p</b></r><r><b>q</b></r><r><a>3</a><b>r</b></r></d>",)], "doc string")
    assert rows_of(readers.open_xml(doc, "doc", "d/r", {"a": "a", "b": "b"})) == rows_of(frame(spark, [("1", "p"), (None, "q"), ("3", "r")], "a string, b string"))


def test_rules_refuse_deeper_trees(spark):
    objects = [("a", None), ("b", "a"), ("c", "b"), ("d", "c")]
    schema = "id string, parent string, name string, qname string, kind string"
    tree = lambda rows: frame(spark, [(i, p, i, i, "TABLE") for i, p in rows], schema)
    assert all(r["shown"] for r in rules.shown(tree(objects), True, []).collect())
    with pytest.raises(Exception, match="deeper"):
        rules.shown(tree([*objects, ("e", "d")]), True, []).collect()


@pytest.mark.parametrize("dialect, sql, left", [
    ("ms", "SELECT a FROM t WITH (NOLOCK)", "SELECT a FROM t"),
    ("ms", "SELECT a FROM t AS x WITH (INDEX(i), UPDLOCK) WHERE a = 1", "SELECT a FROM t AS x WHERE a = 1"),
    ("pg", "SELECT a FROM t FOR UPDATE", "SELECT a FROM t"),
    ("pg", "SELECT a FROM t WHERE b = 'FOR UPDATE' FOR KEY SHARE OF t, u NOWAIT", "SELECT a FROM t WHERE b = 'FOR UPDATE'"),
])
def test_locks_and_hints_go(dialect, sql, left):
    assert dialects.to_spark(sql, dialect) == left
