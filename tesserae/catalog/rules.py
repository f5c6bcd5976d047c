"""Show and hide rules, and declared dependencies: two small languages, and their application to catalog rows as joins.

A rule file begins with SHOW ALL or HIDE ALL; rules of the other word follow, one a line: flags (NONE, or of CONTENT, REGEX, QUALIFIED), a name, and optionally db= with a pattern and type= with kinds. # begins a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = re.compile(r"\s*(db=|type=|,|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_]\w*|#.*|\S)")
#: What a rule does, weakest first; of the rules that fit the strongest counts.
SHOW, HIDE, SHOW_BELOW, HIDE_BELOW = range(4)


@dataclass(frozen=True)
class Rule:
    name: str
    show: bool
    regex: bool = False
    content: bool = False
    qualified: bool = False
    db: str | None = None
    kinds: frozenset[str] = frozenset()

    @property
    def effect(self) -> int:
        if self.show:
            return SHOW_BELOW if self.content else SHOW
        return HIDE_BELOW if self.content else HIDE


def unquoted(part: str) -> str:
    return part[1:-1].replace(part[0] * 2, part[0]) if part[:1] in "'\"" else part


def parse_rules(text: str) -> tuple[bool, list[Rule]]:
    """(show all, rules). Rules that match alike are merged: the one with CONTENT replaces one without; of equally wide ones hiding wins."""
    show_all: bool | None = None
    rules: list[Rule] = []
    for number, line in enumerate(text.splitlines(), 1):
        parts = [p for p in _PART.findall(line) if not p.startswith("#")]
        if not parts:
            continue
        if show_all is None:
            if len(parts) != 2 or parts[0] not in ("SHOW", "HIDE") or parts[1] != "ALL":
                raise ValueError(f"line {number}: SHOW ALL or HIDE ALL expected")
            show_all = parts[0] == "SHOW"
            continue
        if parts[0] != ("HIDE" if show_all else "SHOW"):
            raise ValueError(f"line {number}: {'HIDE' if show_all else 'SHOW'} expected")
        flags, i = set(), 1
        while i < len(parts) and parts[i] in ("CONTENT", "REGEX", "NONE", "QUALIFIED"):
            flags.add(parts[i])
            i += 1
            if i < len(parts) and parts[i] == ",":
                i += 1
            else:
                break
        if not flags or i >= len(parts):
            raise ValueError(f"line {number}: flags and a name expected")
        name, i, db, kinds = unquoted(parts[i]), i + 1, None, set()
        if parts[i : i + 1] == ["db="]:
            db, i = unquoted(parts[i + 1]), i + 2
        if parts[i : i + 1] == ["type="]:
            i += 1
            while i < len(parts):
                kinds.add(parts[i].replace("_", " ").upper())
                i += 2 if parts[i + 1 : i + 2] == [","] else 1
        if i < len(parts):
            raise ValueError(f"line {number}: unexpected {parts[i]}")
        rules = added(rules, Rule(name, not show_all, "REGEX" in flags, "CONTENT" in flags, "QUALIFIED" in flags, db, frozenset(kinds)))
    return True if show_all is None else show_all, rules


def added(rules: list[Rule], rule: Rule) -> list[Rule]:
    for i, old in enumerate(rules):
        if replace(old, show=True, content=True) == replace(rule, show=True, content=True):
            if old.content == rule.content:
                new = replace(old, show=old.show and rule.show)
            else:
                new = rule if rule.content else old
            return [*rules[:i], new, *rules[i + 1 :]]
    return [*rules, rule]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.regex, r.qualified, r.db, sorted(r.kinds), r.effect) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "idx int, rule string, regex boolean, qualified boolean, db string, kinds array<string>, effect int")


def matches(db: str) -> Column:
    """Whether a rule fits an object: by name or pattern found in it, kind and database."""
    name = F.when(F.col("qualified"), F.col("qname")).otherwise(F.col("name"))
    by_name = F.when(F.col("regex"), F.regexp_like(name, F.col("rule"))).otherwise(name == F.col("rule"))
    return by_name & ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))) & (F.col("db").isNull() | F.regexp_like(F.lit(db), F.col("db")))


def shown(objects: DataFrame, show_all: bool, rules: list[Rule], db: str = "") -> DataFrame:
    """objects with shown: whether the rules let each through.

    objects: id, parent (id or null), name, qname, kind. The strongest rule that fits an object decides; where only SHOW ALL or nothing does, an ancestor shown with CONTENT lets it in, and an ancestor hidden with CONTENT hides all below. Rules are few and broadcast; containers nest at most three deep, so ancestors are three joins; deeper ones are an error.
    """
    spark = objects.sparkSession
    fits = objects.crossJoin(F.broadcast(rules_frame(spark, rules))).where(matches(db)).groupBy("id").agg(F.max("effect").alias("effect"))
    rows = objects.join(fits, "id", "left")
    up = rows.select(F.col("id").alias("p_id"), F.col("parent").alias("p_parent"), F.col("effect").alias("p_effect"))
    now = rows.withColumn("above", F.col("parent")).withColumn("open", F.lit(False)).withColumn("shut", F.lit(False))
    for _ in range(3):
        now = now.join(up, F.col("above") == F.col("p_id"), "left").withColumn("open", F.col("open") | F.coalesce(F.col("p_effect") == SHOW_BELOW, F.lit(False))).withColumn("shut", F.col("shut") | F.coalesce(F.col("p_effect") == HIDE_BELOW, F.lit(False))).withColumn("above", F.col("p_parent")).drop("p_id", "p_parent", "p_effect")
    deep = F.when(F.col("above").isNotNull(), F.raise_error(F.lit("objects nest deeper than three containers")).cast("boolean")).otherwise(F.lit(True))
    own = F.when(F.col("effect").isNull(), F.lit(show_all) | F.col("open")).otherwise(F.col("effect").isin(SHOW, SHOW_BELOW))
    return now.withColumn("shown", own & ~F.col("shut") & deep).drop("effect", "above", "open", "shut")


_DEF = r"([A-Za-z_]\w*(?:[ \t]+[A-Za-z_]\w*){0,2})[ \t]+([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*(\([^;>]*?\))?"


def parse_dependencies(text: str) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """((kind, name), (kind, name)) of each ``kind name -> kind name;``. Kinds are case-insensitive; a function's name carries its argument types."""
    out = []
    for part in text.split(";"):
        if not part.strip():
            continue
        m = re.fullmatch(rf"\s*{_DEF}\s*->\s*{_DEF}\s*", part, re.S)
        if not m:
            raise ValueError(f"not a dependency: {part.strip()[:80]}")
        out.append(tuple((" ".join(m[i].upper().split()), re.sub(r"\s+", "", m[i + 1]) + (re.sub(r"\s*,\s*", ", ", m[i + 2].strip()) if m[i + 2] else "")) for i in (1, 4)))
    return out
