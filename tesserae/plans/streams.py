"""Streams over events, run to the end of their input and held against the same question asked of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import Registry
from tesserae.streaming import events as ev

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


def _plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")) if "start" in df.columns else df


@_r.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    """Complete mode: windows are final once the input is read."""
    return _plain(ev.run(ev.tumbling(ev.source(t.spark, t.sf_dir)), "complete"))


@_r.query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start")
def stream_sliding(t):
    return _plain(ev.run(ev.sliding(ev.source(t.spark, t.sf_dir)), "complete"))


@_r.query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(t):
    return _plain(ev.run(ev.sessions(ev.source(t.spark, t.sf_dir)), "complete"))


@_r.query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedup(t):
    """dropDuplicatesWithinWatermark."""
    return ev.run(ev.first_of_each(ev.source(t.spark, t.sf_dir), ["user_id", "event_type"])).agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_custom_state(t):
    rows = ev.run(ev.running_totals(ev.source(t.spark, t.sf_dir)), "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@_r.query("SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def stream_materialized_view(t):
    """Partial states of each batch, merged when read."""
    return ev.materialized(
        ev.source(t.spark, t.sf_dir), lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), lambda p: p.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    )


@_r.query("SELECT user_id, median(value) AS mid FROM events GROUP BY user_id")
def stream_refreshable_view(t):
    """A view that has no partial states is computed anew after each batch."""
    return ev.refreshable(ev.source(t.spark, t.sf_dir), lambda e: e.groupBy("user_id").agg(F.median("value").alias("mid")))


@_r.query("SELECT event_id, user_id, 'large ' || event_type AS note FROM events WHERE value > 90")
def stream_row_trigger(t):
    note = F.concat(F.lit("large "), "event_type").alias("note")
    return ev.row_trigger(ev.source(t.spark, t.sf_dir), F.col("value") > 90, [F.col("event_id"), F.col("user_id"), note])


@_r.query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, lower(n_name) FROM nation")
def stream_notify_receive(t):
    """Two senders, one receiver."""
    import uuid

    from tesserae.session import shared_dir

    channel = f"{shared_dir(t.spark)}/channel-{uuid.uuid4().hex}"
    ev.notify(t.nation.select("n_nationkey", "n_name"), channel)
    ev.notify(t.nation.select("n_nationkey", F.lower("n_name").alias("n_name")), channel)
    return ev.run(ev.receive(t.spark, channel, "n_nationkey int, n_name string"))


@_r.query("SELECT user_id, event_type, n, value FROM (SELECT user_id, event_type, 1 AS n, round(value, 4) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-21') UNION ALL SELECT user_id, event_type, count(*), round(sum(value), 4) FROM events WHERE ts < TIMESTAMP '2024-01-21' AND ts >= TIMESTAMP '2024-01-11' GROUP BY ALL")
def stream_ttl_group_by(t):
    """TTL: after ten days rows are added up, after twenty they go."""
    age = F.lit("2024-01-31").cast("timestamp_ntz") - F.col("ts").cast("timestamp_ntz")
    rows = t.events.select("user_id", "event_type", F.lit(1).cast("bigint").alias("n"), "value", "ts")
    return ev.lapsed(rows, age, "'20' DAY", "'10' DAY", ["user_id", "event_type"], n="sum", value="sum").withColumn("value", F.round("value", 4))


@_r.query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def stream_ttl(t):
    return ev.run(ev.expired(ev.source(t.spark, t.sf_dir), "2024-01-20")).select("event_id")


@_r.query("SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE event_type = 'purchase'")
def stream_static_join(t):
    stream = ev.source(t.spark, t.sf_dir).where("event_type = 'purchase'")
    return ev.run(stream.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"))
