"""Changes to tables, user functions and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tesserae.operators import dml
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


@_r.query("SELECT p_partkey, p_size FROM part UNION ALL SELECT 1000000 + n_nationkey, 7 FROM nation WHERE n_regionkey = 1")
def dml_insert_select(t):
    """INSERT ... SELECT with a column list, into a table."""
    name = t.create(t.part.select("p_partkey", "p_size"))
    t.nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 1000000).cast("bigint").alias("p_partkey"), F.lit(7).alias("p_size")).write.insertInto(name)
    return t.spark.table(name)


_SOURCE = "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 1000000 END AS p_partkey, p_size + 1 AS p_size FROM part WHERE p_partkey % 5 = 0"


def _target(t):
    return t.part.where("p_partkey % 3 <> 1").select("p_partkey", "p_size")


def _source(t):
    return t.part.where("p_partkey % 5 = 0").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1000000).alias("p_partkey"), (F.col("p_size") + 1).alias("p_size"))


_T = "SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 1"


@_r.query(f"WITH t AS ({_T}), s AS ({_SOURCE}) SELECT coalesce(s.p_partkey, t.p_partkey) AS p_partkey, coalesce(s.p_size, t.p_size) AS p_size FROM t FULL JOIN s ON t.p_partkey = s.p_partkey")
def dml_upsert(t):
    return dml.upsert(_target(t), _source(t), ["p_partkey"])


@_r.query(f"WITH t AS ({_T}), s AS ({_SOURCE}) SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, coalesce(t.p_size, s.p_size) AS p_size FROM t FULL JOIN s ON t.p_partkey = s.p_partkey")
def dml_insert_do_nothing(t):
    return dml.upsert(_target(t), _source(t), ["p_partkey"], "nothing")


@_r.query("SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def dml_update_from(t):
    n = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return dml.update_from(t.customer.select("c_custkey", "c_acctbal"), n, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("s_n")})


@_r.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def dml_delete_using(t):
    return dml.delete_using(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_MERGED = f"""WITH t AS ({_T}), s AS ({_SOURCE}),
m AS (SELECT t.p_partkey AS tk, s.p_partkey AS sk, t.p_size AS ts, s.p_size AS ss FROM t FULL JOIN s ON t.p_partkey = s.p_partkey),
a AS (SELECT *, CASE WHEN tk IS NOT NULL AND sk IS NOT NULL AND ss > 45 THEN 'delete' WHEN tk IS NOT NULL AND sk IS NOT NULL THEN 'update' WHEN tk IS NULL AND ss > 10 THEN 'insert' WHEN tk IS NULL THEN 'skip' WHEN ts = 1 THEN 'delete' END AS action FROM m)"""


def _merge(t):
    return dml.merge(
        _target(t), _source(t), "p_partkey",
        matched=[(F.col("s_p_size") > 45, "delete", {}), (F.lit(True), "update", {"p_size": F.col("s_p_size")})],
        not_matched=[(F.col("s_p_size") > 10, {"p_partkey": F.col("s_p_partkey"), "p_size": F.col("s_p_size")})],
        by_source=[(F.col("t_p_size") == 1, "delete", {})],
    )


@_r.query(_MERGED + " SELECT coalesce(tk, sk) AS p_partkey, CASE action WHEN 'update' THEN ss WHEN 'insert' THEN ss ELSE ts END AS p_size FROM a WHERE action IS NULL OR action IN ('update', 'insert')")
def dml_merge(t):
    """MERGE with two matched clauses, one not matched, one by source."""
    return _merge(t).where("action IS NULL OR action <> 'delete'").drop("action")


@_r.query(_MERGED + " SELECT action, count(*) AS n FROM a WHERE action <> 'skip' GROUP BY action")
def dml_merge_output(t):
    """OUTPUT $action of the merge."""
    return _merge(t).where("action IS NOT NULL").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_NULLED = "SELECT nullif(p_partkey % 500, 7) AS k, p_partkey AS v FROM part WHERE p_partkey % 3 = 0"
_ONCE = "SELECT CASE WHEN p_partkey = 400 THEN NULL ELSE p_partkey END AS k, -p_partkey AS v FROM part WHERE p_partkey <= 450 AND p_partkey % 2 = 0"


@_r.query(f"WITH t AS ({_NULLED}), s AS ({_ONCE}) SELECT t.k, coalesce(s.v, t.v) AS v FROM t LEFT JOIN s ON t.k = s.k UNION ALL SELECT s.k, s.v FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)")
def dml_merge_null_keys(t):
    """Null keys on both sides match nothing and stay; repeated keys of the target are all changed."""
    target = t.part.where("p_partkey % 3 = 0").select(F.nullif(F.col("p_partkey") % 500, F.lit(7)).alias("k"), F.col("p_partkey").alias("v"))
    source = t.part.where("p_partkey <= 450 AND p_partkey % 2 = 0").select(F.nullif("p_partkey", F.lit(400)).alias("k"), (-F.col("p_partkey")).alias("v"))
    return dml.merge(target, source, "k", matched=[(F.lit(True), "update", {"v": F.col("s_v")})], not_matched=[(F.lit(True), {"k": F.col("s_k"), "v": F.col("s_v")})]).drop("action")


@_r.query(f"WITH t AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 = 0), s AS (SELECT nullif(p_partkey % 300, 5) AS k, min(p_size) AS v FROM part WHERE p_partkey % 300 <> 5 GROUP BY 1 UNION ALL SELECT NULL, p_size FROM part WHERE p_partkey % 300 = 5) SELECT * FROM t UNION ALL SELECT * FROM s WHERE s.k IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)")
def dml_insert_repeated_keys(t):
    """DO NOTHING with keys that stand several times in the rows: one is inserted; null keys all are."""
    rows = t.part.select(F.nullif(F.col("p_partkey") % 300, F.lit(5)).alias("k"), F.col("p_size").alias("v"))
    return dml.upsert(t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), rows, ["k"], "nothing")


@_r.query("WITH o AS (SELECT nullif(c_custkey, 9) AS k, nullif(c_nationkey, 3) AS a, nullif(c_nationkey, 4) AS b FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT nullif(c_custkey, 9) AS k, nullif(c_nationkey, 4) AS a, nullif(c_nationkey, 3) AS b FROM customer WHERE c_custkey % 5 <> 0) SELECT CASE WHEN o.hit THEN o.k ELSE n.k END AS k, CASE WHEN o.hit IS NULL THEN 'I' WHEN n.hit IS NULL THEN 'D' ELSE 'U' END AS operation FROM (SELECT *, true AS hit FROM o) o FULL JOIN (SELECT *, true AS hit FROM n) n ON o.k IS NOT DISTINCT FROM n.k WHERE o.hit IS NULL OR n.hit IS NULL OR o.a IS DISTINCT FROM n.a OR o.b IS DISTINCT FROM n.b")
def dml_changes_with_nulls(t):
    """A null that moves to the next column is a change; a null key that stays is none."""
    version = lambda keep, a, b: t.customer.where(keep).select(F.nullif("c_custkey", F.lit(9)).alias("k"), F.nullif("c_nationkey", F.lit(a)).alias("a"), F.nullif("c_nationkey", F.lit(b)).alias("b"))
    return dml.changes_between(version("c_custkey % 7 <> 0", 3, 4), version("c_custkey % 5 <> 0", 4, 3), ["k"])


@_r.query("SELECT p_partkey, p_size AS old_size, p_size * 2 AS new_size FROM part WHERE p_brand = 'Brand#11'")
def dml_returning_old_new(t):
    return t.part.where("p_brand = 'Brand#11'").select("p_partkey", F.col("p_size").alias("old_size"), (F.col("p_size") * 2).alias("new_size"))


@_r.query("SELECT 0::BIGINT AS n")
def dml_truncate(t):
    name = f"tesserae_{uuid.uuid4().hex}"
    t.region.write.saveAsTable(name)  # Spark truncates managed tables only
    t.spark.sql(f"TRUNCATE TABLE {name}")
    return t.spark.table(name).agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT l_orderkey, l_linenumber, count(*) > 0 AS there FROM lineitem GROUP BY ALL")
def dml_deduplicate_by(t):
    """OPTIMIZE ... DEDUPLICATE BY columns."""
    return t.lineitem.dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.lit(True).alias("there"))


@_r.query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def dml_mutations(t):
    """ALTER TABLE ... UPDATE and DELETE in order, as one plan."""
    change = dml.script(lambda d: d.where("o_orderstatus <> 'P'"), lambda d: d.withColumn("o_orderstatus", F.when(F.col("o_totalprice") < 50000, "S").otherwise(F.col("o_orderstatus"))))
    return change(t.orders).select("o_orderkey", "o_orderstatus")


@_r.query("WITH moved AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM moved) AS archived, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS kept")
def dml_data_modifying_cte(t):
    """WITH moved AS (DELETE ... RETURNING *) INSERT: two results of one state."""
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("archived"), F.count_if(F.col("o_orderstatus") != "F").alias("kept"))


@_r.query("SELECT true AS pruned, true AS pushed")
def dml_explain(t):
    """EXPLAIN: the scan reads two columns and gets the filter."""
    plan = t.orders.where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    return t.spark.createDataFrame([("o_orderdate" not in plan, "GreaterThan(o_totalprice,1000.0)" in plan)], "pruned boolean, pushed boolean")


@_r.query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3 OFFSET 1")
def dml_cursor(t):
    """FETCH and MOVE over an ordered result, partition by partition."""
    rows = t.region.orderBy("r_regionkey").toLocalIterator()
    next(rows)
    return t.spark.createDataFrame([next(rows) for _ in range(3)], t.region.schema)


# User functions
@_r.query("SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders")
def udf_sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tess_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.19D")
    return t.sql("SELECT o_orderkey, round(tess_gross(o_totalprice), 4) AS gross FROM orders")


@_r.query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_totalprice > 100000")
def udf_table_function(t):
    """RETURNS TABLE, called with LATERAL."""
    t.orders.createOrReplaceTempView("orders")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tess_orders_of(c BIGINT, low DOUBLE) RETURNS TABLE (o_orderkey BIGINT) RETURN SELECT o_orderkey FROM orders WHERE o_custkey = c AND o_totalprice > low")
    return t.sql("SELECT c_custkey, f.o_orderkey FROM customer, LATERAL tess_orders_of(c_custkey, 100000) f WHERE c_nationkey = 3")


@_r.query("SELECT n_nationkey, unnest(range(n_nationkey % 4))::BIGINT AS i FROM nation")
def udf_set_returning(t):
    """A set-returning function in FROM, as a table function in Python."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="i bigint")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    t.spark.udtf.register("tess_upto", Upto)
    return t.sql("SELECT n_nationkey, f.i FROM nation, LATERAL tess_upto(n_nationkey % 4) f")


@_r.query("SELECT p_partkey, p_size * p_size + 1 AS y FROM part")
def udf_lambda_function(t):
    """CREATE FUNCTION f AS (x) -> x * x + 1."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tess_f(x INT) RETURNS INT RETURN x * x + 1")
    return t.sql("SELECT p_partkey, tess_f(p_size) AS y FROM part")


@_r.query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'fair' ELSE 'rich' END AS grade FROM supplier")
def udf_procedural_body(t):
    """A procedural body (IF and loops) as an Arrow-batched function."""

    @F.pandas_udf("string")
    def grade(v: pd.Series) -> pd.Series:
        return pd.Series(["debt" if x < 0 else "fair" if x < 5000 else "rich" for x in v])

    return t.supplier.select("s_suppkey", grade("s_acctbal").alias("grade"))


@_r.query("SELECT event_type, round(sum(value * event_id) / sum(event_id), 6) AS w FROM events GROUP BY event_type")
def udf_user_aggregate(t):
    @F.pandas_udf("double")
    def weighted(v: pd.Series, w: pd.Series) -> float:
        return float((v * w).sum() / w.sum())

    return t.events.groupBy("event_type").agg(F.round(weighted("value", F.col("event_id").cast("double")), 6).alias("w"))


@_r.query("SELECT n_nationkey, n_nationkey <> 7 AND n_regionkey > 1 AS ok FROM nation")
def udf_user_operator(t):
    """A user operator is a named function."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tess_op(a INT, b INT) RETURNS BOOLEAN RETURN a <> 7 AND b > 1")
    return t.sql("SELECT n_nationkey, tess_op(n_nationkey, n_regionkey) AS ok FROM nation")


@_r.query("SELECT 1 + 2 + 3 + 4 AS total")
def udf_procedure_script(t):
    """A procedure with variables and a loop, as a SQL script."""
    return t.spark.sql("BEGIN DECLARE i INT = 1; DECLARE total INT = 0; WHILE i <= 4 DO SET total = total + i; SET i = i + 1; END WHILE; SELECT total AS total; END")
