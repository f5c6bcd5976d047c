from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import ngram_join

SCHEMA = "doc_id bigint, text string, node string, component int, leaf string"
rng = random.Random(5)


def brute(rows: list[tuple], width: int = 4, hundredths: int = 85) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= hundredths * (len(sets[x]) + len(sets[y]) - both):
                    a, b = group[x], group[y]
                    group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in ids}


def words(n: int) -> list[str]:
    return ["".join(rng.choice("abcdeéF") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)
    return got


def test_near_copies_of_all_sizes_as_by_brute_force(spark):
    rows = []
    for i in range(420):
        if i % 3 == 0 or not rows:
            w = words(rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 80, 200, 500]))
        else:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "new"
        rows.append((i * 3 + 1, " ".join(w), "x", 1, None))
    got = check(spark, rows)
    assert len({c for _, c in got.values()}) < 0.8 * len(rows)


def test_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    base, passage = words(150), words(60)
    rows = []
    for i in range(300):
        w = list(base) if i % 2 else words(60) + passage + words(60)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((1000 - i, "\t".join(w), None, None, None))
    check(spark, rows)


def test_nulls_blank_repeated_long_and_empty_table(spark):
    long = " ".join(words(30000))
    rows = [(4, None, "", 1, ""), (5, "", "", 1, ""), (6, " \n", "", 1, ""), (7, "One two", "", 1, ""), (9, "one\ttwo", "", 1, ""), (9, "one\ttwo", "", 1, ""), (None, "one two", "", 1, ""), (2, long, "", 1, ""), (3, long + " more", "", 1, "")]
    got = sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    n = brute([(2, long)])[2][0]
    assert got == sorted([(4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (9, 1, 7), (9, 1, 7), (None, 1, None), (2, n, 2), (3, n + 1, 2)], key=repr)
    assert ngram_join.linked(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cells_split_into_many_blocks_and_routed_again(spark, monkeypatch):
    """Blocks of four, routes of over 40 nodes: a near-copy group, and short documents of few words that meet by chance."""
    for name, value in {"BLOCK": 4, "LEAF": 4, "MANY_BLOCKS": 3, "REROUTES": 2, "HELD": 40}.items():
        monkeypatch.setattr(ngram_join, name, value)
    base, rows = words(120), []
    for i in range(150):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w), None, None, None))
    rows += [(200 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(5, 9))), None, None, None) for i in range(400)]
    check(spark, rows)


def test_unrelated_short_documents_in_one_cell(spark, monkeypatch):
    """One cell of documents that have nothing in common is routed apart before all of its blocks are compared."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "MANY_BLOCKS", 2)
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}" if i % 2 else f"a{i - 1} b{i - 1} c{i - 1} d{i - 1} e{i - 1} f{i - 1}", None, None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    described = ngram_join.described(docs, 4)
    nodes = described.groupBy("node").agg(F.min("doc_id").alias("of"), F.first("point").alias("point")).withColumnRenamed("node", "k")
    cells = nodes.select(F.lit(1).cast("bigint").alias("cell"), F.col("k").alias("node"))
    apart = ngram_join.rerouted(docs, cells, nodes, 4, 85, 1)
    assert apart.groupBy("cell").count().agg(F.max("count")).first()[0] in (None, 2, 3)
    check(spark, rows)


def test_two_sets_that_share_forty_bits_are_told_apart():
    """Sets are compared by whole hashes."""
    a = np.arange(1, 101, dtype=np.uint64) << np.uint64(24)
    found = ngram_join.joined([0], [1], [a, a + np.uint64(1)], [1, 2], 85)
    assert found == [] and ngram_join.joined([0], [1], [a, a.copy()], [1, 2], 85) == [(0, 1)]
