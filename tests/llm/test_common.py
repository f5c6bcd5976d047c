from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import common


def met(pairs) -> set[tuple[int, int]]:
    """Pairs of nodes that a task is to compare."""
    out = set()
    for r in pairs.groupBy("pair").agg(F.collect_list(F.struct("node", "side")).alias("x")).collect():
        left, right = [s["node"] for s in r["x"] if not s["side"]], [s["node"] for s in r["x"] if s["side"]]
        out |= {(min(a, b), max(a, b)) for a in left for b in (right or left) if a != b}
    return out


@pytest.mark.parametrize("known", [lambda i: i, lambda i: 0, lambda i: i % 2, lambda i: int(i == 37)])
def test_blocks_meet_but_for_those_of_one_group(spark, known):
    """Between them the first pairs and the others miss only pairs of nodes that are one group."""
    cells = spark.createDataFrame([(c, i, known(i)) for c, n in ((1, 40), (2, 5), (3, 1)) for i in range(n)], "cell bigint, node bigint, known bigint")
    first, others = common.first_pairs(cells, 4), common.other_pairs(cells, 4)
    assert first.count() <= 2 * 46 + 30
    for cell, n in ((1, 40), (2, 5)):
        one = cells.where(F.col("cell") == cell)
        seen = met(common.first_pairs(one, 4)) | met(common.other_pairs(one, 4))
        assert {(i, j) for j in range(n) for i in range(j) if known(i) != known(j)} <= seen
    if known(0) == known(1) == known(37):
        assert others.count() == 0


def test_components_by_union(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (30, 3), *[(100, 100 + i) for i in range(50)]]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(50)}}


def union(edges) -> dict[int, int]:
    """Smallest node that each node of edges reaches."""
    low = {n: n for e in edges if e[0] != e[1] for n in e}
    todo = True
    while todo:
        todo = False
        for a, b in edges:
            if a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                todo = True
    return low


@pytest.mark.parametrize("shape", ["chain", "mixed"])
def test_components_of_long_chains_and_random_links(spark, shape):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 300)
    edges = list(zip(ids, ids[1:], strict=False)) if shape == "chain" else [tuple(rng.choices(ids, k=2)) for _ in range(200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == union(edges)
    assert common.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect() == []


def test_groups_grow_by_links_of_known_groups(spark):
    """Links name components known by then, or nodes new to them; without links the groups stay."""
    links = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    first, then = [(9, 4), (4, 7), (1, 2), (20, 21)], [(4, 1), (20, 30), (40, 41)]
    groups = common.grouped(None, links(first))
    more = common.grouped(groups, links(then))
    as_dict = lambda df: {r["node"]: r["component"] for r in df.collect()}
    assert as_dict(groups) == union(first)
    assert as_dict(more) == union(first + then)
    assert more.count() == 10
    assert as_dict(common.grouped(more, links([]))) == as_dict(more)


def test_runs_are_cut_between_values(spark):
    import pyarrow as pa

    for sizes in ([3, 3, 1], [1] * 9, [9], [2, 5, 2]):
        keys = [1, 1, 2, 3, 3, 3, 3, 4, 4]
        at, batches = 0, []
        for n in sizes:
            batches.append(pa.record_batch({"k": pa.array(keys[at : at + n], pa.int64())}))
            at += n
        tables = [t.column(0).to_pylist() for t in common.runs_of(iter([*batches, batches[0].slice(0, 0)]))]
        assert sum(tables, []) == keys[:at]
        assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[:i])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
