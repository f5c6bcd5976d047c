"""From differences to an ordered migration script.

Changes are few next to the catalogs that they come from, so ordering them is a loop on the driver; the differences and closures that feed it are distributed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Change:
    """A wanted change of one object: side LEFT (drop), RIGHT (create), or BOTH with the state that altering it leads to: ALTER, RECREATE or NOTHING."""

    object: str
    side: str
    state: str = "ALTER"


@dataclass
class Plan:
    """Ordered (action, object) pairs."""

    steps: list[tuple[str, str]] = field(default_factory=list)

    def add(self, action: str, name: str) -> bool:
        if (action, name) in self.steps:
            return False
        self.steps.append((action, name))
        return True


def resolve(changes: Iterable[Change], old_deps: Iterable[tuple[str, str]], new_deps: Iterable[tuple[str, str]], new_objects: set[str]) -> list[tuple[str, str]]:
    """The order of DROP, ALTER and CREATE. deps: (object, what it depends on).

    Before an object is dropped or recreated, all that depend on it in the old catalog are dropped; those that still exist in the new one are created again. Before an object is created, what it depends on is. An ALTER that a CREATE replaces is left out. Repeats until nothing new comes up; a cycle is entered once.
    """
    wanted = list(changes)
    users: dict[str, list[str]] = {}
    for a, b in old_deps:
        users.setdefault(b, []).append(a)
    needs: dict[str, list[str]] = {}
    for a, b in new_deps:
        needs.setdefault(a, []).append(b)
    drops, creates, alters = Plan(), Plan(), Plan()
    dropped: set[str] = set()

    def drop(name: str) -> None:
        if name in dropped:
            return
        dropped.add(name)
        for user in users.get(name, []):
            drop(user)
        drops.add("DROP", name)

    for c in wanted:
        if c.side == "LEFT" or c.side == "BOTH" and c.state == "RECREATE":
            drop(c.object)
    created_before: set[str] = set()
    again = {n for n in dropped if n in new_objects} | {c.object for c in wanted if c.side == "RIGHT"}

    def create(name: str) -> None:
        if name in created_before or name not in again:
            return
        created_before.add(name)
        for need in needs.get(name, []):
            create(need)
        creates.add("CREATE", name)

    for name in [*[c.object for c in wanted if c.object in again], *sorted(again)]:
        create(name)
    for c in wanted:
        if c.side == "BOTH" and c.state == "ALTER" and c.object not in again:
            alters.add("ALTER", c.object)
    return drops.steps + alters.steps + creates.steps


#: Phases of a script in order.
PHASES = ("PRE", "BEGIN", "MID", "END", "POST")


def script(statements: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row, script, from statements (phase, seq, sql): by phase and place, of equal ones the first."""
    order = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    first = statements.groupBy("sql").agg(F.min(F.struct(order.alias("p"), "seq")).alias("at"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sql"))), lambda s: s["sql"]), separator).alias("script"))


def joined_alters(alters: DataFrame) -> DataFrame:
    """Runs of neighbouring ALTERs of one table become one statement. alters: seq (without gaps), relation, clause."""
    by_table = Window.partitionBy("relation").orderBy("seq")
    runs = alters.withColumn("run", F.col("seq") - F.row_number().over(by_table))
    out = runs.groupBy("relation", "run").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "clause"))).alias("c"))
    return out.select("seq", F.concat(F.lit("ALTER TABLE "), "relation", F.lit(" "), F.array_join(F.transform("c", lambda s: s["clause"]), ", "), F.lit(";")).alias("sql"))


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of a recreated table: the columns that both have are carried over, new ones are null."""
    common = [c for c in new.columns if c in old.columns]
    return new.unionByName(old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in common]), allowMissingColumns=True)


def forbidden(statements: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """One row, dangers: kinds of danger in statements (dangers array) that are not allowed."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("dangers"))))
    return statements.agg(F.array_except(found, F.array(*[F.lit(a) for a in allowed]).cast("array<string>")).alias("dangers"))
