"""Comparing catalogs. Objects are rows (schema, object, kind, parent, ddl); a difference is a full outer join on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An object's key: its container's key and its own name and kind.
KEY = ("schema", "object", "kind")


def content_hash(columns: Sequence[str], unordered: Sequence[str] = ()) -> Column:
    """Equal for equal contents; the arrays named unordered count as sets with repeats."""
    return F.xxhash64(*[F.array_sort(F.col(c)) if c in unordered else F.col(c) for c in columns])


def tree_diff(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY, parent: str | None = None, compare: Sequence[str] = ("ddl",), unordered: Sequence[str] = ()) -> DataFrame:
    """Objects on one side only (LEFT, RIGHT) or changed (BOTH), and the containers of such (BOTH, contents alone).

    parent: a column with the key string of the container, the keys' parts joined by dots. changed tells whether the object's own content differs. Three levels of containers are marked.
    """
    path = F.concat_ws(".", *key)
    keep = [*key, *([parent] if parent else [])]
    a = old.select(path.alias("_id"), *[F.col(c).alias(f"_a_{c}") for c in keep], content_hash(compare, unordered).alias("_ha"))
    b = new.select(path.alias("_id"), *[F.col(c).alias(f"_b_{c}") for c in keep], content_hash(compare, unordered).alias("_hb"))
    rows = a.join(b, "_id", "full")
    side = F.when(F.col("_hb").isNull(), "LEFT").when(F.col("_ha").isNull(), "RIGHT").otherwise("BOTH")
    rows = rows.select("_id", *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in keep], side.alias("side"), (~F.col("_ha").eqNullSafe(F.col("_hb"))).alias("changed"))
    if not parent:
        return rows.where("changed").drop("_id")
    touched = rows.where("changed").select(F.col(parent).alias("_t"))
    every = touched
    for _ in range(2):
        up = rows.join(touched.distinct(), F.col("_id") == F.col("_t"), "left_semi").select(F.col(parent).alias("_t"))
        every, touched = every.union(up), up
    every = every.where("_t is not null").distinct()
    return rows.join(every, F.col("_id") == F.col("_t"), "left").where(F.col("changed") | F.col("_t").isNotNull()).drop("_id", "_t")


def reverted(diff: DataFrame) -> DataFrame:
    """The difference seen from the other side."""
    return diff.withColumn("side", F.when(F.col("side") == "LEFT", "RIGHT").when(F.col("side") == "RIGHT", "LEFT").otherwise(F.col("side")))


def column_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns (schema, relation, name, type, nullable, default) that one side lacks or that differ, of relations on both sides."""
    same = old.select("schema", "relation").distinct().join(new.select("schema", "relation").distinct(), ["schema", "relation"], "left_semi")
    key = ("schema", "relation", "name")
    out = tree_diff(old.join(same, ["schema", "relation"], "left_semi"), new.join(same, ["schema", "relation"], "left_semi"), key, None, ("type", "nullable", "default"))
    return out.select(*key, "side")


def merged_libraries(objects: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Objects of several libraries (lib_ord): the first definition of each, and the later ones that differ from it as overrides."""
    w = Window.partitionBy(*key).orderBy("lib_ord")
    rows = objects.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("ddl").over(w))
    return rows.where("_n = 1").drop("_n", "_first"), rows.where("_n > 1 AND ddl <> _first").drop("_n", "_first")


def overridden(objects: DataFrame, overrides: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Owner and privileges replaced where an override gives them."""
    o = overrides.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = objects.join(o, list(key), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in objects.columns])


def change_order(diff: DataFrame, kind_order: Column) -> DataFrame:
    """Drops first, from the last kind to the first; then creations before changes, in order of kind."""
    left = F.col("side") == "LEFT"
    rank = F.when(left, -kind_order).otherwise(kind_order)
    seq = F.struct(F.when(left, 0).otherwise(1), rank, F.when(F.col("side") == "RIGHT", 0).otherwise(1), *[F.col(c) for c in KEY])
    return diff.withColumn("_s", seq).orderBy("_s").drop("_s")


def grants(acls: DataFrame) -> DataFrame:
    """(object, grantee, privilege, grantable) of ACL strings such as ``{bob=r*w/owner,=X/owner}``; an empty grantee is PUBLIC."""
    #: Letters of PostgreSQL's ACLs.
    names = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "D": "TRUNCATE", "x": "REFERENCES", "t": "TRIGGER", "X": "EXECUTE", "U": "USAGE", "C": "CREATE", "c": "CONNECT", "T": "TEMPORARY", "m": "MAINTAIN", "s": "SET", "A": "ALTER SYSTEM"}
    one = acls.select("object", F.explode(F.split(F.regexp_replace("acl", r"^\{|\}$", ""), ",")).alias("a"))
    parts = one.select("object", F.regexp_extract("a", "^([^=]*)=", 1).alias("g"), F.explode(F.regexp_extract_all(F.regexp_extract("a", "=([^/]*)", 1), F.lit("([A-Za-z]\\*?)"), F.lit(1))).alias("p"))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return parts.select("object", F.when(F.col("g") == "", "PUBLIC").otherwise(F.col("g")).alias("grantee"), table[F.substring("p", 1, 1)].alias("privilege"), F.col("p").endswith("*").alias("grantable"))
