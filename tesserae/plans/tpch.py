"""Star-schema reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@_r.query("""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
def tpch_q6(t):
    """Scan, pushed-down filter and one global sum."""
    li = t.lineitem.where((F.col("l_shipdate") >= _day("1996-01-01")) & (F.col("l_shipdate") < _day("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@_r.query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY l_returnflag, l_linestatus
""")
def tpch_q1(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.where(F.col("l_shipdate") <= _day("2001-08-01")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


@_r.query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10
""")
def tpch_q3(t):
    """Join of three tables, top 10."""
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.orders.where(F.col("o_orderdate") < _day("1998-03-15")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = t.lineitem.where(F.col("l_shipdate") > _day("1998-03-15"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return rows.orderBy(F.col("revenue").desc(), "l_orderkey").limit(10)


@_r.query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name
""")
def tpch_q5(t):
    """Six tables; the small dimensions are broadcast where their size allows."""
    n = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t.orders.where((F.col("o_orderdate") >= _day("1996-01-01")) & (F.col("o_orderdate") < _day("1997-01-01")))
    o = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_r.query("""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'
""")
def tpch_q14(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t.lineitem.where((F.col("l_shipdate") >= _day("1996-09-01")) & (F.col("l_shipdate") < _day("1996-10-01"))).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.agg(F.round(100.0 * F.sum(F.when(F.col("p_type").like("PROMO%"), price).otherwise(0)) / F.sum(price), 6).alias("promo_revenue"))


@_r.query("""
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)
""")
def tpch_q15(t):
    """A view, its maximum as a scalar subquery, and a join."""
    t.lineitem.where((F.col("l_shipdate") >= _day("1996-01-01")) & (F.col("l_shipdate") < _day("1996-04-01"))).groupBy(F.col("l_suppkey").alias("supplier_no")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total_revenue")).createOrReplaceTempView("revenue0")
    return t.sql("SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue0 ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue0)")
