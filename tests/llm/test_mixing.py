from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def test_targets_by_resharing():
    goal = mixing.targets({"a": 100, "b": 1000, "c": 400, None: 50}, (3, 1, 2), 1.5, 2.0)
    total = 1.5 * 1550
    assert goal["a"] == 200 and goal[None] == 100
    assert math.isclose(goal["b"] + goal["c"], total - 300)
    assert math.isclose(goal["c"], min(800, 2 * goal["b"])) and goal["b"] <= 2000


def corpus(n: int = 700):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é", None])
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)) + rng.choice(["", " \n"]), source, "x", 1))
    return rows


def test_words_come_to_their_targets_and_reruns_agree(spark):
    rows = corpus()
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA).repartition(3), part=32).collect()
    sizes: dict = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    goal = mixing.targets(sizes, (3, 1, 2), 1.5, 2.0)
    source_of, taken = {r[0]: r[2] for r in rows}, dict.fromkeys(goal, 0)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split())
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], goal[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal)
    again = mixing.mixed(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), part=32).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_rates_solve_the_dual(spark):
    rows = [(i, None, "a" if i % 2 else "b", s) for i, s in enumerate([3, 5, 8, 13, 21, 34, 55, 89] * 5)]
    docs = spark.createDataFrame([(s, z, 1) for _, _, s, z in rows], "source string, size bigint, c bigint")
    for factor in (0.3, 1.0, 1.7):
        goals = {s: factor * sum(z for _, _, x, z in rows if x == s) for s in "ab"}
        duals = mixing.balanced(docs, goals, {"a": 28.0, "b": 28.0})
        for s in "ab":
            z = np.array([z for _, _, x, z in rows if x == s], float)
            w = np.minimum(2, np.exp(np.minimum(30, duals[s] * z / 28.0)))
            assert abs(w @ z - goals[s]) <= 2e-5 * goals[s]


def test_nulls_empty_repeated_and_empty_table(spark):
    rows = [(1, None, None, None, None), (2, "", "a", None, None), (None, "x y z", "a", None, None), (3, "x", "a", None, None), (3, "x", "a", None, None), (4, "w " * 60000, None, None, None)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.copies_of(spark.createDataFrame(rows, SCHEMA)).columns == ["doc_id", "text", "source", "size", "target"]
    only_blank = mixing.mixed(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert [r["taken"] for r in only_blank] == [0, 0]


def test_equal_rows_share_their_copies(spark):
    """30 equal rows of three words, 90 in all, to 135: 45 copies, in the mix as in the table of copies."""
    rows = [(7, "x y z", "a", "s", 1)] * 30 + [(8, "w", None, "s", 1), (None, "w", None, "s", 1), (9, None, "w", "s", 1), (9, "w", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mixed(docs, budget=1.5).where("doc_id = 7").collect()
    total = sum(r["taken"] for r in got)
    assert len(got) == 30 and {r["copies"] for r in got} <= {1, 2} and abs(total - got[0]["target"]) <= 3
    taken = mixing.copies_of(docs, budget=1.5).where("doc_id = 7").count()
    assert 3 * taken == total
    assert mixing.copies_of(docs).count() == sum(r["copies"] for r in mixing.mixed(docs).collect())


def rounded(rows, rate, salts):
    """Systematic sampling by a loop: (rid, copies) for rows (rid, size, start of its part), each with its rate."""
    out = {}
    for salt in salts:
        upto = 0.0
        for rid, start in sorted(((r, s) for r, _, s, x in rows if x == salt), key=lambda t: (-next(z for r, z, _, _ in rows if r == t[0]), t[0])):
            before, upto = upto, round(upto + rate[rid], 9)
            out[rid] = math.floor(upto + start) - math.floor(before + start)
    return out


def test_rounding_as_by_a_loop(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, i * 7919, "s", rng.randint(1, 50), 1, rng.choice([0.1, 0.5, 1.0, 1.7, 2.0]), 4) for i in range(300)], "doc_id bigint, rid bigint, source string, size bigint, c bigint, w double, salts bigint")
    salt, start = F.pmod(F.xxhash64("rid", F.lit(7)), F.col("salts")), F.pmod(F.xxhash64("source", "salt"), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.withColumn("salt", salt).withColumn("start", start).collect()
    want = rounded([(r["rid"], r["size"], r["start"], r["salt"]) for r in rows], {r["rid"]: r["w"] for r in rows}, range(4))
    got = {r["rid"]: r["copies"] for r in mixing.copied(docs).collect()}
    assert got == want
    assert all(abs(sum(got[r["rid"]] for r in rows if r["salt"] == s) - sum(r["w"] for r in rows if r["salt"] == s)) < 1 for s in range(4))


def test_sources_joined_by_sorting_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(200), SCHEMA)
    want = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == want


def test_a_source_that_is_not_balanced_in_time_is_an_error(spark):
    docs = spark.createDataFrame([("a", z, 1) for z in (1, 7, 50)], "source string, size bigint, c bigint")
    with pytest.raises(ArithmeticError):
        mixing.balanced(docs, {"a": 3.3}, {"a": 1.0}, iterations=1)
