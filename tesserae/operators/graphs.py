"""Graph operators over edge tables (src, dst): closure, paths, levels, connected sets, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import saved


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(seed, node, depth): what each of seeds (node) reaches, itself at depth 0, by the shortest way. A frontier join a level, against what has been visited; levels are written, so the plan stays short."""
    e = edges.select(F.col("dst" if reverse else "src").alias("_from"), F.col("src" if reverse else "dst").alias("_to")).distinct()
    frontier = saved(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    seen, level = frontier, 0
    while (depth is None or level < depth) and frontier.limit(1).count():
        level += 1
        new = frontier.join(e, frontier["node"] == e["_from"]).select("seed", F.col("_to").alias("node"), F.lit(level).alias("depth")).distinct()
        frontier = saved(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def connected(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that depend on a seed or that a seed depends on."""
    return reachable(edges, seeds).unionByName(reachable(edges, seeds, reverse=True)).select("seed", "node").distinct()


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Every path from a seed of at most depth steps as (path, cyclic): a node that a path has already is its last. Paths can be as many as the graph allows, so depth is asked for."""
    e = edges.select("src", "dst").distinct()
    now = seeds.select(F.array(F.col("node").cast("string")).alias("path"), F.lit(False).alias("cyclic"))
    out = now
    for _ in range(depth):
        step = now.where(~F.col("cyclic")).join(e, F.element_at("path", -1) == F.col("src").cast("string"))
        now = saved(step.select(F.concat("path", F.array(F.col("dst").cast("string"))).alias("path"), F.array_contains("path", F.col("dst").cast("string")).alias("cyclic")))
        out = out.unionByName(now)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one more than the highest that it depends on; nodes on or behind a cycle get null. edges: src depends on dst."""
    e = saved(edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    open_edges, done, level = e, None, 0
    left = saved(nodes)
    while left.limit(1).count():
        ready = left.join(open_edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        ready = saved(ready.withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            left = left.withColumn("level", F.lit(None).cast("int"))
            return left if done is None else done.unionByName(left)
        done = ready if done is None else done.unionByName(ready)
        left = saved(left.join(ready.select("node"), "node", "left_anti"))
        open_edges = saved(open_edges.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    seeds = edges.select(F.col("src").alias("node")).distinct()
    far = reachable(edges, seeds)
    back = far.join(edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct(), far["node"] == F.col("_s")).where("_d = seed")
    return back.select(F.col("seed").alias("node")).distinct()


def reduced(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between containers: endpoints replaced by their parent (child, parent) where they have one, loops dropped."""
    p = parent.select("child", "parent")
    out = edges.join(p.withColumnsRenamed({"child": "_c1", "parent": "_p1"}), F.col("src") == F.col("_c1"), "left").join(p.withColumnsRenamed({"child": "_c2", "parent": "_p2"}), F.col("dst") == F.col("_c2"), "left")
    return out.select(F.coalesce("_p1", "src").alias("src"), F.coalesce("_p2", "dst").alias("dst")).where("src <> dst").distinct()


def shortest_path(edges: DataFrame, start, end, most: int = 32) -> DataFrame:
    """(path): shortest paths from start to end, none if there is none within most steps."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    frontier = spark.createDataFrame([(start,)], "node string").select(F.col("node").cast(kind).alias("node")).select("node", F.array("node").alias("path"))
    seen = frontier.select("node")
    for _ in range(most):
        hit = frontier.where(F.col("node") == F.lit(end).cast(kind))
        if hit.limit(1).count():
            return hit.select("path")
        new = frontier.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = saved(new.join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier.select("node")).distinct()
    return frontier.where(F.lit(False)).select("path")
