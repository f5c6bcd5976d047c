"""Projection, filter, predicates and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL
_r.both("expr_select_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, upper(o_orderstatus) AS st FROM orders")
_r.both("expr_star", "SELECT r.*, n.n_name FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey")
_r.both("expr_star_except", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "SELECT * EXCEPT (c_name, c_acctbal) FROM customer")
_r.both("expr_arithmetic", "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 7 AS b, o_orderkey * 3 AS c, o_totalprice / 4 AS d, o_orderkey % 7 AS e, -o_orderkey AS f, round(power(o_orderkey % 9, 3), 4) AS g FROM orders")
_r.both("expr_bit_ops", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, xor(o_orderkey, 9) AS c, ~o_orderkey AS d FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, o_orderkey ^ 9 AS c, ~o_orderkey AS d FROM orders")
_r.both("expr_compare", "SELECT p_partkey, p_size < 10 AS lt, p_size >= 10 AS ge, p_size <> 5 AS ne, p_brand = 'Brand#11' AS eq FROM part")
_r.both("expr_distinct_from", "SELECT p_partkey, nullif(p_size, 7) IS DISTINCT FROM 7 AS a, nullif(p_size, 7) IS NOT DISTINCT FROM NULL AS b FROM part")
_r.both("expr_is_null_true", "SELECT p_partkey, nullif(p_size, 3) IS NULL AS a, (nullif(p_size, 3) > 20) IS TRUE AS b, (nullif(p_size, 3) > 20) IS FALSE AS c, (nullif(p_size, 3) > 20) IS NULL AS d FROM part", "SELECT p_partkey, nullif(p_size, 3) IS NULL AS a, (nullif(p_size, 3) > 20) IS TRUE AS b, (nullif(p_size, 3) > 20) IS FALSE AS c, (nullif(p_size, 3) > 20) IS UNKNOWN AS d FROM part")
_r.both("expr_logic", "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 0 AND c_mktsegment = 'BUILDING') OR NOT (c_nationkey < 20)")
_r.both("expr_between_symmetric", "SELECT s_suppkey FROM supplier WHERE s_acctbal BETWEEN least(5000, 100) AND greatest(5000, 100)")
_r.both("expr_in_list_subquery", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_r.both("expr_row_in", "SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT c_nationkey, c_nationkey % 5 FROM customer)")
_r.both("expr_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
_r.both("expr_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")


@_r.query("SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_type = 'SMALL') UNION ALL SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 1)")
def expr_any_all(t):
    """Quantified comparisons through the extremes of the subquery: one aggregation each, an empty one making ALL true and ANY false."""
    edge = t.part.agg(F.max(F.when(F.col("p_type") == "SMALL", F.col("p_size"))).alias("hi"), F.max(F.when(F.col("p_size") == 1, F.col("p_retailprice"))).alias("any_hi"))
    rows = t.part.crossJoin(F.broadcast(edge))  # one row
    return rows.where("hi IS NULL OR p_size >= hi").select("p_partkey").union(rows.where("p_retailprice < any_hi").select("p_partkey"))


_r.both("expr_any_array", "SELECT p_partkey, list_contains([1, 5, 9], p_size) AS any_eq, p_size > 50 AND p_size > 10 AS all_gt FROM part", "SELECT p_partkey, exists(array(1, 5, 9), x -> p_size = x) AS any_eq, forall(array(50, 10), x -> p_size > x) AS all_gt FROM part")
_r.both("expr_like", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name ILIKE '%A%' AS b, p_name NOT LIKE 'p\\_%' ESCAPE '\\' AS c FROM part", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name ILIKE '%A%' AS b, p_name NOT LIKE 'p/_%' ESCAPE '/' AS c FROM part")
_r.both("expr_similar_to", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '(PROMO|SMALL).*')", "SELECT p_partkey FROM part WHERE p_type RLIKE '^(?:(PROMO|SMALL).*)$'")
_r.both("expr_regex", "SELECT c_custkey, regexp_matches(c_name, '[13579]$') AS odd, regexp_matches(c_name, '(?i)CUSTOMER') AS any_case FROM customer", "SELECT c_custkey, c_name RLIKE '[13579]$' AS odd, c_name RLIKE '(?i)CUSTOMER' AS any_case FROM customer")
_r.both("expr_scalar_subquery", "SELECT o_orderkey, o_totalprice - (SELECT round(avg(o_totalprice), 4) FROM orders) AS diff, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS most FROM orders")
_r.both("expr_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, if(o_orderkey % 2 = 0, 'even', 'odd') AS parity FROM orders")
_r.both("expr_cast", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS s, o_orderdate::DATE AS d, TRY_CAST(o_orderstatus AS INTEGER) AS bad FROM orders", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS s, o_orderdate::DATE AS d, TRY_CAST(o_orderstatus AS INT) AS bad FROM orders")
_r.both("expr_typed_literals", "SELECT r_regionkey, DATE '2024-02-29' + INTERVAL 1 DAY = DATE '2024-03-01' AS leap, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 90 MINUTE AS t, 1.5e0 AS d FROM region", "SELECT r_regionkey, DATE '2024-02-29' + INTERVAL 1 DAY = DATE '2024-03-01' AS leap, TIMESTAMP_NTZ '2024-01-01 10:00:00' + INTERVAL 90 MINUTE AS t, 1.5e0 AS d FROM region")
_r.both("expr_collate", "SELECT n_nationkey, lower(n_name) = lower('BRAZIL') AS same FROM nation", "SELECT n_nationkey, n_name COLLATE UTF8_LCASE = 'brazil' AS same FROM nation")
_r.both("expr_at_time_zone", "SELECT event_id, ts + INTERVAL 2 HOUR AS there FROM events", "SELECT event_id, convert_timezone('UTC', '+02:00', ts) AS there FROM events")


@_r.query("SELECT event_id, ts < TIMESTAMP '2024-01-15 06:00:00' AND TIMESTAMP '2024-01-10' < ts + INTERVAL 2 HOUR AS here, ts < TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-18' < ts + INTERVAL 2 HOUR AS turned, ts < TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05' < ts + INTERVAL 2 HOUR OR ts = TIMESTAMP '2024-01-05' AS instant FROM events")
def expr_overlaps(t):
    """(ts, ts + 2 h) OVERLAPS a period, one with its ends turned, and an instant."""
    from tesserae.operators.joins import overlapping

    at = lambda text: F.lit(text).cast("timestamp_ntz")
    span = (F.col("ts").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 2 HOUR"))
    periods = {"here": ("2024-01-10 00:00:00", "2024-01-15 06:00:00"), "turned": ("2024-01-20 00:00:00", "2024-01-18 00:00:00"), "instant": ("2024-01-05 00:00:00",) * 2}
    return t.events.select("event_id", *[overlapping(*span, at(a), at(b)).alias(name) for name, (a, b) in periods.items()])


_r.both("expr_subscript_slice", "SELECT vec_id, embedding[1] AS first_one, embedding[64] AS last_one, len(embedding[3:10]) AS n FROM embeddings", "SELECT vec_id, element_at(embedding, 1) AS first_one, embedding[63] AS last_one, size(slice(embedding, 3, 8)) AS n FROM embeddings")
_r.both("expr_array_row", "SELECT n_nationkey, len([n_regionkey, n_nationkey]) AS size_of, ([n_regionkey, n_nationkey])[2] AS second, {'a': n_name, 'b': 1}.a AS field FROM nation", "SELECT n_nationkey, size(array(n_regionkey, n_nationkey)) AS size_of, element_at(array(n_regionkey, n_nationkey), 2) AS second, named_struct('a', n_name, 'b', 1).a AS field FROM nation")
_r.both("expr_array_subquery", "SELECT r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region", "SELECT r_name, (SELECT array_join(sort_array(collect_list(n_name)), ',') FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
_r.both("expr_lambda", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)), 4) AS l1, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings", "SELECT vec_id, round(aggregate(transform(embedding, x -> double(abs(x))), 0D, (a, x) -> a + x), 4) AS l1, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings")
_r.both("expr_json_literal", "SELECT r_regionkey, json_extract_string('{\"a\": {\"b\": 5}}', '$.a.b')::INTEGER AS b FROM region", "SELECT r_regionkey, variant_get(parse_json('{\"a\": {\"b\": 5}}'), '$.a.b', 'int') AS b FROM region")


@_r.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def expr_query_parameter(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 250000, "status": "F"})


_r.both("expr_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per (cust, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT cust, n FROM per WHERE n > 1")
_r.both("expr_recursive_cte", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
_r.both("expr_recursive_cycle", "WITH RECURSIVE walk(node, path) AS (SELECT 0, [0] UNION ALL SELECT (node * 3 + 1) % 7, list_append(path, (node * 3 + 1) % 7) FROM walk WHERE len(list_distinct(path)) = len(path)) SELECT node, len(path) AS steps, len(list_distinct(path)) < len(path) AS cyclic FROM walk", "WITH RECURSIVE walk(node, path) AS (SELECT 0, array(0) UNION ALL SELECT (node * 3 + 1) % 7, array_append(path, (node * 3 + 1) % 7) FROM walk WHERE size(array_distinct(path)) = size(path)) SELECT node, size(path) AS steps, size(array_distinct(path)) < size(path) AS cyclic FROM walk")
_r.both("expr_scalar_cte", "WITH top AS (SELECT max(o_totalprice) AS m FROM orders) SELECT o_orderkey, o_totalprice = m AS is_top FROM orders CROSS JOIN top")
_r.both("expr_values", "SELECT * FROM (VALUES (1, 'a', 1.5e0), (2, 'b', 2.5e0), (3, NULL, NULL)) AS v(id, s, d)")
_r.both("expr_table", "TABLE region")


@_r.query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def expr_select_into(t):
    """SELECT INTO: the result becomes a table, which is then read."""
    rows = t.customer.where("c_acctbal > 5000").select("c_custkey", "c_name", "c_acctbal")
    return t.spark.table(t.create(rows))


@_r.query("SELECT count(*) BETWEEN 0 AND (SELECT count(*) FROM orders) AS within_bounds FROM orders")
def expr_tablesample(t):
    """SAMPLE by a hash of the key: reruns and other plans pick the same rows."""
    picked = t.orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) < 10).agg(F.count(F.lit(1)).alias("n"))
    all_rows = t.orders.agg(F.count(F.lit(1)).alias("total"))
    return picked.crossJoin(all_rows).select(((F.col("n") >= 0) & (F.col("n") <= F.col("total"))).alias("within_bounds"))


@_r.query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def expr_qualify(t):
    from pyspark.sql import Window

    from tesserae.operators.windows import qualify

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return qualify(t.orders, "n", F.row_number().over(w), F.col("n") == 1).select("o_custkey", "o_orderkey", "o_totalprice")


@_r.query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def expr_final(t):
    """FINAL of a replacing table: the newest row of each key."""
    from tesserae.operators.dml import replaced

    return replaced(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


_r.both("expr_prewhere", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09")
_r.both("expr_name_search", "SELECT n_name FROM nation WHERE regexp_full_match(n_name, '(?i)(united.*|.*ia)')", "SELECT n_name FROM nation WHERE n_name RLIKE '(?i)^(?:united.*|.*ia)$'")


@_r.query("SELECT c_custkey, c_acctbal FROM customer")
def expr_columns_regex(t):
    """COLUMNS('re'): the columns whose name matches, with APPLY left out."""
    import re

    return t.customer.select(*[c for c in t.customer.columns if re.search("^c_(cust|acct)", c)])


_r.both("expr_is_json", "SELECT event_id, json_valid(props) AS ok, json_valid(event_type) AS no FROM events", "SELECT event_id, try_parse_json(props) IS NOT NULL AS ok, try_parse_json(event_type) IS NOT NULL AS no FROM events")
