"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Long texts: let no more than so many rows meet in one Arrow batch of this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (a single machine, as in tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: a folder that driver and executors share is needed")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and losing an executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/tesserae-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a saved() table that a later one has replaced."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage after many small jobs: their broadcasts and shuffles are cleaned everywhere only when their handles are collected, and the heap gives memory back."""
    gc.collect()
    spark._jvm.System.gc()


def are_stars(links: DataFrame) -> bool:
    """Whether links (v, m), m below v, are stars: every v has one m, and none is the m of another."""
    ends = links.select(F.col("v").alias("k"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(links.select(F.col("m").alias("k"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    one = ends.groupBy("k").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not one.agg(F.max((F.col("low") > 1) | ((F.col("low") == 1) & (F.col("high") == 1)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of bigint ids: (node, component), component being the smallest id reachable. Nodes without a link are not returned.

    Alternates large and small stars until all links are stars; each round is two aggregations with partial sums and two joins that adaptive execution may split, so a hub with a third of all links stays spread out. The rounds grow with the logarithm of the nodes.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        # of each link one row at most goes on; equal ones are told apart after the second join only
        large = both.join(low, both["v"] == low["u"]).where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        low = large.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "u")
        small = large.join(low, large["v"] == low["u"]).select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        after = saved(small.where("v <> m").distinct(), "edges")
        dropped(now)
        now = after
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(now.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("component")))


def in_blocks(cells: DataFrame, size: int) -> DataFrame:
    """cells (cell, node, ...) with block, a cell's nodes being dealt into blocks of about so many, and blocks, how many the cell has."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")).withColumnRenamed("cell", "of")
    rows = cells.join(sizes, F.col("cell") == F.col("of")).drop("of")
    return rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def first_pairs(cells: DataFrame, size: int) -> DataFrame:
    """(pair, node, side, known): of each cell (cell, node, known) the first block of nodes to be compared in itself (pair is then one of side false alone), and all others with it. That connects nearly all of a group of near copies, at two rows a node and none a pair."""
    rows = in_blocks(cells, size)
    with_all = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = rows.withColumn("to", F.explode(with_all))
    return rows.select(F.xxhash64("cell", F.lit(0), "to").alias("pair"), "node", (F.col("block") > 0).alias("side"), "known")


def other_pairs(cells: DataFrame, size: int) -> DataFrame:
    """As first_pairs(), the blocks and pairs of blocks that it leaves out, where their nodes are not of one known group by now. cells must be the same table; a cell that is one group but for a few nodes costs the blocks of these times all blocks."""
    rows = in_blocks(cells, size).where("block > 0")
    boxes = rows.groupBy("cell", "block").agg(F.min("known").alias("lo"), F.max("known").alias("hi"))
    mixed, whole = boxes.where("lo <> hi").select("cell", F.col("block").alias("a")), boxes.where("lo = hi").select("cell", "block", "lo")
    other = boxes.select(F.col("cell").alias("c"), F.col("block").alias("b"), (F.col("lo") != F.col("hi")).alias("m"))
    pairs = mixed.join(other, (F.col("cell") == F.col("c")) & ((F.col("a") <= F.col("b")) | ~F.col("m")))
    pairs = pairs.select("cell", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # blocks of one group each need comparing only in cells where such groups differ
    several = whole.groupBy("cell").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x <> y").select(F.col("cell").alias("c"))
    whole = whole.join(several, F.col("cell") == F.col("c"), "left_semi")
    twin = whole.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("lo").alias("hi"))
    differ = whole.join(twin, (F.col("cell") == F.col("c")) & (F.col("block") < F.col("b")) & (F.col("lo") != F.col("hi"))).select("cell", F.col("block").alias("a"), "b")
    pairs = pairs.unionByName(differ)
    left, right = (F.struct(F.col(c).alias("at"), F.lit(side).alias("side")) for c, side in (("a", False), ("b", True)))
    sides = pairs.select(F.col("cell").alias("c"), F.xxhash64("cell", "a", "b").alias("pair"), F.explode(F.when(F.col("a") == F.col("b"), F.array(left)).otherwise(F.array(left, right))).alias("s"))
    sides = sides.select("c", "pair", "s.at", "s.side")
    return rows.join(sides, (F.col("cell") == F.col("c")) & (F.col("block") == F.col("at"))).select("pair", "node", "side", "known")


def grouped(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component), saved, of those found before and links (a, b). With groups given, a and b are components of theirs, or nodes that they lack, so only what is new is looked through."""
    found = components(links)
    if groups is None:
        out = saved(found, "groups")
    elif found.isEmpty():
        out = groups
    else:
        of = found.select(F.col("node").alias("was"), F.col("component").alias("now"))
        old = groups.join(of, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
        new = found.join(groups.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti")
        out = saved(old.unionByName(new), "groups")
    swept(links.sparkSession)
    return out


def known_now(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """cells (cell, node) with known, each node's component in groups, itself without any."""
    now = groups.withColumnRenamed("node", "of")
    return cells.select("cell", "node").join(now, F.col("node") == F.col("of"), "left").select("cell", "node", F.coalesce("component", "node").alias("known"))


def undecided(cells: DataFrame) -> DataFrame:
    """Those cells (cell, node, known) whose nodes are not one group."""
    mixed = cells.groupBy("cell").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select(F.col("cell").alias("of"))
    return cells.join(mixed, F.col("cell") == F.col("of"), "left_semi")


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, cut so that no value of it is in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() == key[-1]:  # one value from the first held row to here
            held.append(batch)
            continue
        last = int((key != key[-1]).nonzero()[0][-1]) + 1 if key[0] != key[-1] else 0
        done = [*held, batch.slice(0, last)] if last else held
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
