"""Streaming forms of the event reports: each takes a streaming DataFrame and returns one; run() drives files through to completion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tesserae.session import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    schema = table.schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()[:1]):  # one file: its folder is the source
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives until its input is read, as a table in the shared folder. In complete mode the last batch is the result. A batch that comes again after a failure replaces what it wrote."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/_k={k}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return batches_of(spark, out, stream.schema) if mode != "complete" else spark.read.schema(stream.schema).parquet(out)


def batches_of(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What batches have written below a folder, each under its number."""
    return spark.read.schema(StructType([*schema.fields, StructField("_k", LongType())])).parquet(folder).drop("_k")


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    s = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str], within: str = "60 days") -> DataFrame:
    """Rows deduplicated while the watermark remembers their key."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """Custom state: count and sum by user, as of the last batch that touched the user."""
    out = "user_id bigint, n bigint, total double"

    def step(key: tuple, parts, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, out, "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def materialized(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A materialised view: of each batch its partial result is kept, under the batch's number, and reading merges them. What has come before is not read again."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"
    kept = partial(spark.createDataFrame([], stream.schema))

    def put(batch: DataFrame, k: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/out/_k={k}")

    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return merged(batches_of(spark, f"{folder}/out", kept.schema))


def refreshable(stream: DataFrame, view: Callable[[DataFrame], DataFrame], after: int = 1) -> DataFrame:
    """A refreshable view: with every so many batches the view is computed anew over all rows so far and put in the old one's place, under a number of its own; readers see the last whole one."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    versions: list[int] = []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/_k={k}")
        if (k + 1) % after == 0:
            view(batches_of(spark, f"{folder}/rows", stream.schema)).write.mode("overwrite").parquet(f"{folder}/view/{k}")
            versions.append(k)

    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    schema = view(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(schema).parquet(f"{folder}/view/{versions[-1]}") if versions else spark.createDataFrame([], schema)


def notify(messages: DataFrame, channel: str) -> None:
    """NOTIFY: rows become messages of a channel, a folder that all can reach."""
    messages.write.mode("append").json(channel)


def receive(spark: SparkSession, channel: str, schema: str) -> DataFrame:
    """RECEIVE: a channel's messages as a stream; each consumer has each message once, by its checkpoint."""
    return spark.readStream.schema(schema).json(channel)


def row_trigger(stream: DataFrame, when: Column, into: list[Column]) -> DataFrame:
    """A row-level AFTER INSERT trigger: each new row for which the condition holds gives one row of the other table's columns, from expressions over the row."""
    return run(stream.where(when).select(*into))


def lapsed(rows: DataFrame, age: Column, delete_after: str, group_after: str, keys: list[str], **sums: str) -> DataFrame:
    """TTL with DELETE and GROUP BY: rows older than delete_after (an interval) go, those older than group_after are added up by keys; the others stay. age: how old a row is, as an interval."""
    old = F.expr(f"INTERVAL {group_after}")
    live = rows.where(age <= F.expr(f"INTERVAL {delete_after}"))
    added = live.where(age > old).groupBy(*keys).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in sums.items()])
    return live.where(age <= old).select(*keys, *sums).unionByName(added)


def expired(events: DataFrame, before: str) -> DataFrame:
    """TTL: rows older than this go."""
    return events.where(F.col("ts") >= F.lit(before).cast("timestamp"))
