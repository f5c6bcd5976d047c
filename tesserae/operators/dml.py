"""Changes to tables as queries: each returns the table's next state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def told_once(rows: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """rows; reading them fails where a key without nulls stands twice."""
    twice = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = twice.select(*[F.col(k).alias(f"_{k}") for k in key], F.lit(True).alias("_twice"))
    marked = rows.join(twice, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key]), "left")
    first = rows.columns[0]
    fail = F.when(F.col("_twice"), F.raise_error(F.lit(f"{what}: a key stands twice")).cast(rows.schema[first].dataType)).otherwise(F.col(first))
    return marked.withColumn(first, fail).select(*rows.columns)


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], on_conflict: str = "update") -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE, or DO NOTHING.

    Keys with a null conflict with nothing. Of rows with one key DO NOTHING inserts one (the least by the other columns), DO UPDATE is an error.
    """
    if on_conflict == "nothing":
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        others = [c for c in rows.columns if c not in key]
        one = rows.where(whole).groupBy(*key).agg(F.min(F.struct(*others)).alias("_r")).select(*key, "_r.*") if others else rows.where(whole).distinct()
        rows = one.select(*rows.columns).unionByName(rows.where(~whole))
        return target.unionByName(rows.join(target.select(*key), list(key), "left_anti").select(*rows.columns))
    return target.join(rows.select(*key), list(key), "left_anti").select(*target.columns).unionByName(told_once(rows, key, "ON CONFLICT DO UPDATE"))


def update_from(target: DataFrame, source: DataFrame, key: Sequence[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE target SET ... FROM source WHERE keys are equal; source has each key once. Its columns are seen as ``s_name``."""
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("_hit"))
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(k) == F.col(f"s_{k}"))
    out = target.join(s, cond, "left")
    return out.select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """DELETE FROM target USING source."""
    return target.join(source, list(key), "left_anti")


def merge(target: DataFrame, source: DataFrame, key: str, matched: Sequence[tuple[Column, str, dict[str, Column]]] = (), not_matched: Sequence[tuple[Column, dict[str, Column]]] = (), by_source: Sequence[tuple[Column, str, dict[str, Column]]] = ()) -> DataFrame:
    """MERGE with ordered clauses, by one full outer join. In clauses target's columns are ``t_name``, source's ``s_name``.

    matched and by_source: (condition, "update" or "delete", changes); not_matched: (condition, values). The first clause that fits acts. Returns the changed table and a column action: insert, update, delete (the deleted row, as it was) or null. A null key matches nothing; a row of target that several rows of source would change is an error.
    """
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("_t"))
    twice = source.groupBy(F.col(key).alias("_key")).agg((F.count(F.lit(1)) > 1).alias("_twice"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("_s")).join(twice, F.col(f"s_{key}") == F.col("_key"), "left")
    rows = t.join(s, F.col(f"t_{key}") == F.col(f"s_{key}"), "full")
    both, only_s, only_t = F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.col("_t").isNull(), F.col("_s").isNull()
    cases: list[tuple[Column, str, dict[str, Column]]] = [(both & c, a, v) for c, a, v in matched]
    cases += [(only_s & c, "insert", v) for c, v in not_matched]
    cases += [(only_t & c, a, v) for c, a, v in by_source]
    action: Column = F.lit(None).cast("string")
    for cond, act, _ in reversed(cases):
        action = F.when(F.coalesce(cond, F.lit(False)), F.lit(act)).otherwise(action)
    which: Column = F.lit(-1)
    for i, (cond, _, _) in reversed(list(enumerate(cases))):
        which = F.when(F.coalesce(cond, F.lit(False)), F.lit(i)).otherwise(which)
    clash = both & F.col("_twice") & (which >= 0)
    rows = rows.withColumn("_which", F.when(clash, F.raise_error(F.lit("MERGE: a row would be changed twice")).cast("int")).otherwise(which)).withColumn("action", action).where(~(only_s & (F.col("_which") == -1)))
    columns = []
    for c in target.columns:
        value = F.col(f"t_{c}")
        for i, (_, _, changes) in enumerate(cases):
            if c in changes:
                value = F.when(F.col("_which") == i, changes[c]).otherwise(value)
        columns.append(value.cast(target.schema[c].dataType).alias(c))
    return rows.select(*columns, "action")


def replaced(df: DataFrame, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """FINAL of a replacing table: of each key the row with the highest version."""
    w = Window.partitionBy(*key).orderBy(*version)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changes_between(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that differ between two versions of a table: operation I, U or D and the key, by one full outer join on the key (nulls being equal) and a hash of the rest, which tells a null from its neighbour's."""
    others = [c for c in old.columns if c not in key]
    rest = F.xxhash64(*[x for c in others for x in (F.col(c).isNull(), F.col(c))]) if others else F.lit(0).cast("bigint")
    a = old.select(*key, rest.alias("_a"))
    b = new.select(*[F.col(k).alias(f"_{k}") for k in key], rest.alias("_b"))
    op = F.when(F.col("_a").isNull(), "I").when(F.col("_b").isNull(), "D").otherwise("U")
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*[F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in key], op.alias("operation"))


def script(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Several changes in order, as one plan."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run
