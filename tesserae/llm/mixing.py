"""Mixing sources to target weights by entropy balancing.

Each document gets a rate w that stays as close as it can to 1 in relative entropy, subject to 0 <= w <= 2 and to its source's words adding up to the source's target. The solution is an exponential tilt, w = min(2, exp(lambda * size / scale)), with one dual variable per source. The dual is convex; its gradient and curvature are sums over documents, so a Newton step is one aggregation with partial sums, and only one row per source ever reaches the driver. Rates are then rounded into copies, the large documents first; after each round the rest are balanced anew to what is left, so that rounding errors of large documents are made up by small ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, saved, swept

CAP = 2.0
#: Documents of over a 64th of their source's target are rounded first, then those of over a 4096th, then the rest.
ROUNDS = (64, 4096, None)
#: Sources whose rows (some 100 bytes each) are sent to all executors.
SENT_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float], budget: float, cap: float) -> dict[str | None, float]:
    """Share budget times all words over the sources, in code-point order with null last, by the repeating weights; a target stops at cap times its source's words and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, free = budget * sum(sizes.values()), {}, list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def per_source(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, target double, scale double, dual double, limit double, salts bigint")


def rate() -> Column:
    """The tilted rate; dual +inf takes everything at the cap, -inf nothing."""
    tilt = F.least(F.lit(30.0), F.greatest(F.lit(-700.0), F.col("dual") * F.col("size") / F.col("scale")))
    return F.when(F.col("dual") == math.inf, F.lit(CAP)).when(F.col("dual") == -math.inf, F.lit(0.0)).otherwise(F.least(F.lit(CAP), F.exp(tilt)))


def exact_sum(c: Column) -> Column:
    """A sum that no order of the rows changes: in decimals."""
    return F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double")


def balanced(docs: DataFrame, goals: dict, scales: dict, iterations: int = 200, close: float = 1e-5) -> dict:
    """The dual variable of each source of docs (source, size, and c, how many documents the row stands for), by Newton steps kept within a bracket (a step outside it is replaced by bisection).

    docs must hold only documents with size over 0. close: relative error of the words at which a source is done; one that isn't after so many iterations is an error.
    """
    total = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("t")).collect()}
    out, state = {}, {}
    for s, t in total.items():
        goal = goals[s]
        if goal >= CAP * t * (1 - close):
            out[s] = math.inf
        elif goal <= 0:
            out[s] = -math.inf
        else:
            state[s] = [0.0, -math.inf, math.inf]
    for _ in range(iterations):
        if not state:
            return out
        rows = [(s, goals[s], scales[s], x[0], 0.0, 1) for s, x in state.items()]
        at = attached(docs, rows).withColumn("w", rate())
        words, slope = F.col("w") * F.col("size"), F.when(F.col("w") < CAP, F.col("w") * F.col("size") * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = at.groupBy("source").agg(exact_sum(words * F.col("c")).alias("words"), exact_sum(slope * F.col("c")).alias("slope")).collect()
        for r in sums:
            x, goal = state[r["source"]], goals[r["source"]]
            error = r["words"] - goal
            # sums are exact to four decimals
            if abs(error) <= max(close * goal, 1e-3):
                out[r["source"]] = x[0]
                continue
            x[1 if error < 0 else 2] = x[0]
            step = x[0] - error / r["slope"] if r["slope"] > 0 else math.nan
            if not (x[1] < step < x[2]):
                step = (x[1] + x[2]) / 2 if math.isfinite(x[1] + x[2]) else 2 * x[0] + (1 if error < 0 else -1)
            x[0] = step
        state = {s: x for s, x in state.items() if s not in out}
    if state:
        raise ArithmeticError(f"after {iterations} steps {len(state)} sources are not balanced")
    return out


def attached(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """docs with the columns of its source's row. One row per source, as many as the driver holds anyway; they are broadcast if they are no more than SENT_SOURCES, else joined by sorting."""
    at = per_source(docs.sparkSession, rows).withColumnRenamed("source", "of")
    at = F.broadcast(at) if len(rows) <= SENT_SOURCES else at.hint("merge")
    return docs.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def copied(docs: DataFrame) -> DataFrame:
    """Round the rates of docs (rid, source, size, c, w, salts) into copies of each row's c documents that add up to the rates, off by under one in each salted part of a source.

    A part is ordered by size and takes a copy wherever the running sum of rates passes a whole number, from a start that depends on the part alone: reruns agree, and documents of like size make up for one another. Parts have some hundred rows, so no source meets in one task.
    """
    part = Window.partitionBy("source", "salt").orderBy(F.col("size").desc(), "rid", "doc_id")
    start = F.pmod(F.xxhash64("source", "salt"), F.lit(1 << 20)) / float(1 << 20)
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("salts")))
    upto = F.round(F.sum(F.col("w") * F.col("c")).over(part.rowsBetween(Window.unboundedPreceding, 0)), 9)
    docs = docs.withColumn("upto", upto).withColumn("before", F.coalesce(F.lag("upto").over(part), F.lit(0.0)))
    return docs.withColumn("copies", (F.floor(F.col("upto") + start) - F.floor(F.col("before") + start)).cast("bigint")).drop("upto", "before", "salt")


def name_of(docs: DataFrame) -> Column:
    """A hash of a row's number, source and text, told apart from nulls in each other's place."""
    return F.xxhash64(*[x for c in ("doc_id", "source", "text") for x in (docs[c].isNull(), docs[c])])


def share(k: Column, copies: Column, c: Column) -> Column:
    """Of so many copies of c equal documents those of the k-th one, counted from 1."""
    return (F.floor(k * copies / c) - F.floor((k - 1) * copies / c)).cast("bigint")


def shared_out(docs: DataFrame, weights: Sequence[float], budget: float, part: int) -> DataFrame:
    """A row for each doc_id, source, size and rid of docs: c (rows of docs that it stands for), rate, copies and taken of them all, source_size and target.

    Rows that agree in all of these are rounded as one, so their number is no burden to any task, and then share their copies.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), name_of(docs).alias("rid"))
    rows = saved(rows.groupBy("doc_id", "source", "size", "rid").agg(F.count(F.lit(1)).alias("c")), "sizes")
    stats = {r["source"]: r for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("size"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    goal = targets({s: r["size"] for s, r in stats.items()}, weights, budget, CAP) if stats else {}
    left, todo, done = dict(goal), rows.where("size > 0"), []
    salts = {s: max(1, r["rows"] // part) for s, r in stats.items()}
    scales = {s: max(1.0, r["size"] / max(1, r["n"])) for s, r in stats.items()}
    for k in ROUNDS:
        limit = {s: goal[s] / k if k else 0.0 for s in goal}
        duals = balanced(todo, left, scales)
        state = [(s, left[s], scales[s], duals.get(s, 0.0), limit[s], salts[s]) for s in goal]
        now = attached(todo, state).where("size > `limit`").withColumn("w", rate())
        now = saved(copied(now).select("doc_id", "source", "size", "rid", "c", "w", "copies"), "copies")
        done.append(now)
        for r in now.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect():
            left[r["source"]] -= r["t"]
        swept(docs.sparkSession)
        if k:
            todo = attached(todo, state).where("size <= `limit`").select("doc_id", "source", "size", "rid", "c")
    every = rows.where("size = 0").select("doc_id", "source", "size", "rid", "c", F.lit(1.0).alias("w"), F.col("c").alias("copies"))
    for now in done:
        every = every.unionByName(now)
    info = [(s, goal[s], float(stats[s]["size"]), 0.0, 0.0, 1) for s in goal]
    return attached(every, info).select("doc_id", "source", "size", "rid", "c", F.col("scale").cast("bigint").alias("source_size"), "target", F.col("w").alias("rate"), "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, part: int = 512) -> DataFrame:
    """Copies of each document so that sources come to their targets.

    docs: doc_id, text, source; other columns are ignored. Returns one row per row of docs: doc_id, size, source_size, target (its source's words), rate, copies (0, 1 or 2) and taken = copies * size. A null or blank text has size 0 and no copies count; its rate is the tilt's value at 0, 1, and it is kept once. A null source is a source of its own, last in order. Rows that agree in doc_id, source and text share their copies as evenly as can be. An empty table gives an empty result. The driver holds a row for each source.
    """
    out = shared_out(docs, weights, budget, part).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "c")))
    out = out.withColumn("copies", share(F.col("k"), F.col("copies"), F.col("c")))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies_of(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, part: int = 512) -> DataFrame:
    """docs with each row as often as the mix takes it; of rows that agree in doc_id, source and text, which is taken how often is arbitrary, but all together as often as mixed() says."""
    taken = shared_out(docs, weights, budget, part).where("copies > 0").select(F.col("rid").alias("tess_of"), F.col("copies").alias("tess_n"), F.col("c").alias("tess_c"))
    rows = docs.withColumn("tess_rid", name_of(docs))
    rows = rows.withColumn("tess_k", F.row_number().over(Window.partitionBy("tess_rid").orderBy("tess_rid"))).join(taken, F.col("tess_rid") == F.col("tess_of"))
    rows = rows.withColumn("tess_n", share(F.col("tess_k"), F.col("tess_n"), F.col("tess_c"))).where("tess_n > 0")
    return rows.withColumn("tess_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "tess_n"))).select(*docs.columns)
