"""Listings and decisions over catalog rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.catalog.sql_text import tokens
from tesserae.operators.graphs import paths
from tesserae.operators.joins import numbered


def dependency_lines(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seq, line): each seed with what it depends on below it, a tab a level; a node that is its own ancestor is marked and not followed."""
    rows = paths(edges, seeds, depth)
    line = F.concat(F.repeat(F.lit("\t"), F.size("path") - 1), F.element_at("path", -1), F.when(F.col("cyclic"), F.lit(" - cyclic dependency")).otherwise(F.lit("")))
    return numbered(rows.select("path", line.alias("line")), [F.col("path")], "seq").select(F.col("seq").cast("int").alias("seq"), "line")


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call, chosen) of calls (call, name, args) among functions (ord, name, params): as many parameters, each equal or any; of several the one with the most equal, then the first. A call that none fits has chosen null."""
    f = functions.select(F.col("name").alias("_n"), "params", "ord")
    rows = calls.join(f, (F.col("name") == F.col("_n")) & (F.size("args") == F.size("params")), "left")
    pairs = F.zip_with("args", "params", lambda a, p: F.when(a == p, 1).when(p == "any", 0))
    rows = rows.withColumn("_p", pairs).withColumn("_fits", F.col("_p").isNotNull() & F.forall("_p", lambda x: x.isNotNull()))
    exact = F.aggregate("_p", F.lit(0), lambda a, x: a + x)
    text = F.concat("name", F.lit("("), F.array_join("params", ", "), F.lit(")"))
    return rows.groupBy("call").agg(F.max_by(F.when(F.col("_fits"), text), F.when(F.col("_fits"), F.struct(exact.alias("e"), (-F.col("ord")).alias("o")))).alias("chosen"))


def object_states(old: DataFrame, new: DataFrame, rebuild: Sequence[str]) -> DataFrame:
    """(object, state) from properties (object, property, value): CREATE, DROP, NOTHING, ALTER, or RECREATE where a property of rebuild changed."""
    a, b = old.withColumnRenamed("value", "_a"), new.withColumnRenamed("value", "_b")
    rows = a.join(b, ["object", "property"], "full")
    changed = ~F.col("_a").eqNullSafe(F.col("_b"))
    per = rows.groupBy("object").agg(F.count("_a").alias("old"), F.count("_b").alias("new"), F.max(changed).alias("changed"), F.max(changed & F.col("property").isin(list(rebuild))).alias("rebuild"))
    state = F.when(F.col("old") == 0, "CREATE").when(F.col("new") == 0, "DROP").when(F.col("rebuild"), "RECREATE").when(F.col("changed"), "ALTER").otherwise("NOTHING")
    return per.select("object", state.alias("state"))


def drop_decisions(rows: DataFrame) -> DataFrame:
    """Whether an object needs a DROP of its own: not if it cannot be dropped, has an unchanged twin, or goes with its container as a column or an owned sequence."""
    goes_along: Column = F.col("container_dropped") & F.col("kind").isin("COLUMN", "SEQUENCE")
    return rows.select("object", (~(F.col("fixed") | F.col("unchanged_twin") | goes_along)).alias("drops"))


def formatted(sql: str) -> str:
    """A query with its clauses on lines of their own, keywords in capitals; strings and quoted names as they are."""
    words = {"select", "from", "where", "and", "or", "group", "order", "by", "having", "limit", "join", "on", "left", "right", "inner", "full", "outer", "as", "union", "all", "with", "in", "not", "is", "null"}
    out, depth, last = "", 0, ""
    for t in tokens(sql):
        text = t.text.upper() if t.kind == "word" and t.text.lower() in words else t.text
        depth += (text == "(") - (text == ")")
        if text in ("FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION") and not depth and out:
            out += "\n" + text
        elif text in ("AND", "OR") and not depth:
            out += "\n  " + text
        elif last == "," and not depth:
            out += "\n       " + text
        elif not out or text in (",", ")", ".", "::") or last in ("(", ".", "::"):
            out += text
        else:
            out += " " + text
        last = text
    return out


def shout():
    @F.pandas_udf("string")
    def loud(s: pd.Series) -> pd.Series:
        return s.str.upper() + "!"

    return loud
