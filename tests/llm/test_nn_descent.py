from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import nn_descent

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, copies int"


def brute(ids: list[int], x: np.ndarray) -> dict[int, tuple[int, int]]:
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    group = list(ids)
    todo = True
    while todo:
        new = [min([group[i], *(group[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(ids))]
        todo = new != group
        group = new
    return {i: (int(hit[k].sum()), group[k]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [256, 16])
def test_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    x[100:220] = x[0] + 0.12 * rng.standard_normal((120, 24))
    for i in range(300, 420):
        x[i] = x[i + 120] + 0.2 * rng.standard_normal(24)
    x[700:760] = x[700]
    ids = [int(i) for i in rng.permutation(5000)[:900]]
    rows = [(i, [float(v) for v in x[k]], 1, "", 0) for k, i in enumerate(ids)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = brute(ids, x)
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _ in want.values())
    assert 0.99 * there <= found <= there
    same = [got[i][:2] == want[i] for i in ids]
    assert np.mean(same) > 0.99
    assert all(got[i][2] == (got[i][1] == i) for i in ids)


def test_unusable_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.0], 0, "", 0), (3, [2.0, 4.0], 1, "", 0), (4, None, 0, "", 0), (5, [0.0, 0.0], 0, "", 0), (6, [nan, 1.0], 0, "", 0), (7, [inf, 1.0], 0, "", 0), (8, [None, 1.0], 0, "", 0), (9, [], 0, "", 0), (10, [1.0, 2.0, 0.0], 0, "", 0), (None, [1.0, 2.0], 0, "", 0), (5, [0.0, 0.0], 0, "", 0)]
    got = sorted((tuple(r)[:4] for r in nn_descent.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (4, 5, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, False), *alone], key=repr)
    assert nn_descent.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_between_dense_groups(spark):
    """Two groups of near copies, 0.90 to 0.95 apart, are one component, and each vector counts the other group's."""
    rng = np.random.default_rng(5)
    n, dim = 500, 64
    a, noise = rng.standard_normal(dim), rng.standard_normal(dim)
    a /= np.linalg.norm(a)
    b = noise - (noise @ a) * a
    b = 0.938 * a + np.sqrt(1 - 0.938**2) * b / np.linalg.norm(b)
    x = np.concatenate([np.repeat(a[None], n, 0), np.repeat(b[None], n, 0)]) + 0.0125 * rng.standard_normal((2 * n, dim))
    ids = [int(i) for i in rng.permutation(2 * n)]
    rows = [(i, [float(v) for v in x[k]], 1, "", 0) for k, i in enumerate(ids)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(ids, x)


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1000, 24))
    x[:400] = x[0] + 0.05 * rng.standard_normal((400, 24))
    for i in range(400, 1000, 2):
        x[i + 1] = x[i] + 0.05 * rng.standard_normal(24)
    nodes = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "node bigint, vec array<float>")
    large = spark.createDataFrame([(i, 0) for i in range(400)], "node bigint, component bigint")
    assert nn_descent.recall(nodes, large, 0.9) < 0.8


def test_all_are_compared_where_the_audit_is_not_met(spark, monkeypatch):
    for name, value in {"TREES": 1, "LEAF": 2, "ROUNDS": 0, "EXTRA": 0, "WHOLE_BLOCK": 64, "RECALL": 1.1}.items():
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 24))
    for i in range(0, 300, 3):
        x[i + 1 : i + 3] = x[i] + 0.1 * rng.standard_normal((2, 24))
    rows = [(i, [float(v) for v in y], 1, "", 0) for i, y in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(list(range(300)), x)


@pytest.mark.parametrize("block", [64, 512])
def test_cluster_of_thousands_with_a_core_and_outliers(spark, monkeypatch, block):
    """Most members are so near the centre that they are only counted; some copies repeat, and outliers are linked to a part of the rest."""
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(48)
    centre /= np.linalg.norm(centre)
    x = centre + 0.02 * rng.standard_normal((2500, 48))
    x[2000:2300] = centre + 0.06 * rng.standard_normal((300, 48))
    x[2300:2400] = x[5]
    nodes = [(i, [float(v) for v in y], 1, "", 0) for i, y in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.deduplicated(spark.createDataFrame(nodes, SCHEMA).repartition(3)).collect()}
    assert got == brute(list(range(2500)), x)


def test_core_members_are_not_compared(spark, monkeypatch):
    """A cluster of 20,000 near copies makes no pairs of blocks: as many rows as it has members."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal(16) + 0.01 * rng.standard_normal((20_000, 16))
    nodes = spark.createDataFrame([(i, [float(v) for v in y], 1) for i, y in enumerate(x)], "node bigint, vec array<float>, copies bigint")
    of = nodes.select("node", F.lit(0).cast("bigint").alias("component"))
    rows = nn_descent.cores(nodes.join(of, "node").select("node", "component", "copies", "vec"), 0.9)
    assert rows.where("core").count() == rows.count() == 20_000
    got = {r["n"] for r in nn_descent.counted(nodes, of, 0.9).collect()}
    assert got == {19_999}


def test_similarity_at_the_threshold_is_a_link(spark):
    """3-4-5 triangles: a cosine of 0.96 in exact binary steps, asked for at just that."""
    rows = [(1, [1.0, 0.0], 0, "", 0), (2, [0.96, 0.28], 0, "", 0), (3, [0.8, 0.6], 0, "", 0)]
    vectors = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    at = float(np.dot(*[np.array(v) / np.sqrt((np.array(v) ** 2).sum()) for v in ([1.0, 0.0], [0.96, 0.28])]))
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.deduplicated(vectors, at - 1e-15).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
