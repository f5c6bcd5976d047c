"""More scalar functions: those of the three dialects that Spark has under other names or composes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import dialects as d
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


@_r.query("SELECT o_orderkey, gcd(o_orderkey, 84) AS g, trunc(o_totalprice - 150000)::BIGINT AS t, round_even(o_orderkey / 2.0, 0)::BIGINT AS b, o_orderkey // 7 AS q, round(1 / (1 + exp(-(o_orderkey % 5))), 8) AS s, (o_orderkey >> 2) & 1 AS bit FROM orders")
def fn_math_more(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", d.gcd(k, F.lit(84)).alias("g"), d.truncate(F.col("o_totalprice") - 150000).cast("bigint").alias("t"), F.bround(k / 2.0, 0).cast("bigint").alias("b"), F.expr("o_orderkey div 7").alias("q"), F.round(1 / (1 + F.exp(-(k % 5))), 8).alias("s"), F.getbit(k, F.lit(2)).cast("bigint").alias("bit"))


_r.both("fn_math_hyperbolic", "SELECT n_nationkey, round(tan(n_nationkey), 6) AS a, round(asin(n_nationkey / 30.0), 8) AS b, round(acos(n_nationkey / 30.0), 8) AS c, round(atan(n_nationkey), 8) AS d, round(sinh(n_nationkey / 10.0), 8) AS e, round(tanh(n_nationkey), 8) AS f, round(radians(n_nationkey), 8) AS g FROM nation", "SELECT n_nationkey, round(tan(n_nationkey), 6) AS a, round(asin(n_nationkey / 30.0D), 8) AS b, round(acos(n_nationkey / 30.0D), 8) AS c, round(atan(n_nationkey), 8) AS d, round(sinh(n_nationkey / 10.0D), 8) AS e, round(tanh(n_nationkey), 8) AS f, round(radians(n_nationkey), 8) AS g FROM nation")


@_r.query("SELECT p_partkey, (nullif(p_size, 3) IS NULL)::INTEGER + (nullif(p_size, 4) IS NULL)::INTEGER AS nulls, coalesce(nullif(p_size, 3), 0) AS filled, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS chosen, coalesce(nullif(p_size, 3), -1) AS ifnull FROM part")
def fn_conditional_more(t):
    x, y = F.nullif(F.col("p_size"), F.lit(3)), F.nullif(F.col("p_size"), F.lit(4))
    return t.part.select("p_partkey", d.num_nulls(x, y).alias("nulls"), F.coalesce(x, F.lit(0)).alias("filled"), F.elt(F.col("p_size") % 3 + 1, F.lit("a"), F.lit("b"), F.lit("c")).alias("chosen"), F.ifnull(x, F.lit(-1)).alias("ifnull"))


_r.both("fn_date_parts_more", "SELECT event_id, (strftime(ts, '%Y%m'))::INTEGER AS ym, hour(ts) AS h, minute(ts) AS mi, ts::DATE + 10 AS plus10, (ts - INTERVAL 1 YEAR)::DATE AS last_year, dayofmonth(ts) AS dom, (extract(isodow FROM ts))::INTEGER AS dow FROM events", "SELECT event_id, int(date_format(ts, 'yyyyMM')) AS ym, hour(ts) AS h, minute(ts) AS mi, date_add(ts, 10) AS plus10, date(add_months(ts, -12)) AS last_year, dayofmonth(ts) AS dom, weekday(ts) + 1 AS dow FROM events")
_r.both("fn_interval", "SELECT event_id, (ts + INTERVAL 2 MONTH + INTERVAL 3 DAY)::DATE AS a, ts - TIMESTAMP '2024-01-01' > INTERVAL 5 DAY AS b FROM events", "SELECT event_id, date(ts + INTERVAL 2 MONTH + INTERVAL 3 DAY) AS a, ts - TIMESTAMP_NTZ '2024-01-01' > INTERVAL 5 DAY AS b FROM events")


@_r.query("SELECT n_nationkey, array_to_string(list_filter([1, 2, 3, 4], lambda i: [n_regionkey, 1, n_regionkey, 2][i] = 1), ',') AS pos, array_to_string(list_transform([n_regionkey, 1, 9], lambda x: if(x = 1, 7, x)), ',') AS rep, array_to_string([n_regionkey, 5, 5], ',') AS resized, array_to_string([8] || [n_regionkey], ',') AS pre, len(list_distinct([n_regionkey, 1, 1])) AS uniq, array_to_string([2, n_regionkey], ',') AS popped FROM nation")
def fn_array_more(t):
    r = F.col("n_regionkey")
    join = lambda c: F.array_join(c, ",")
    return t.nation.select("n_nationkey", join(d.array_positions(F.array(r, F.lit(1), r, F.lit(2)), 1)).alias("pos"), join(d.array_replace(F.array(r, F.lit(1), F.lit(9)), 1, 7)).alias("rep"), join(d.array_resize(F.array(r), 3, 5)).alias("resized"), join(F.array_prepend(F.array(r), F.lit(8))).alias("pre"), F.size(F.array_distinct(F.array(r, F.lit(1), F.lit(1)))).alias("uniq"), join(F.slice(F.array(F.lit(1), F.lit(2), r), 2, 2)).alias("popped"))


@_r.query("SELECT vec_id, round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS l2, round(list_cosine_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cos FROM embeddings")
def fn_array_distance(t):
    a = F.col("embedding").cast("array<double>")
    b = F.reverse(a)
    return t.embeddings.select("vec_id", F.round(d.l2_distance(a, b), 6).alias("l2"), F.round(d.cosine_distance(a, b), 6).alias("cos"))


@_r.query("SELECT n_nationkey, u.i::BIGINT AS i, u.x AS x FROM (SELECT n_nationkey, unnest(list_transform([n_regionkey, 10], lambda x, i: {'i': i, 'x': x})) AS u FROM nation)")
def fn_generate_subscripts(t):
    return t.nation.select("n_nationkey", F.posexplode(F.array("n_regionkey", F.lit(10))).alias("i", "x")).select("n_nationkey", (F.col("i") + 1).cast("bigint").alias("i"), "x")


_r.both("fn_generate_series", "SELECT n_nationkey, unnest(generate_series(n_regionkey, n_regionkey + 6, 3))::BIGINT AS s FROM nation", "SELECT n_nationkey, explode(sequence(bigint(n_regionkey), n_regionkey + 6L, 3L)) AS s FROM nation")
_r.both("fn_map_more", "SELECT n_nationkey, map_contains(map(['a', 'b'], [n_regionkey, 1]), 'a') AS has_a, map(['a', 'b'], [n_regionkey * 2, 2])['a'] AS doubled FROM nation", "SELECT n_nationkey, map_contains_key(map('a', n_regionkey, 'b', 1), 'a') AS has_a, transform_values(map('a', n_regionkey, 'b', 1), (k, v) -> v * 2)['a'] AS doubled FROM nation")
_r.both("fn_json_more", """SELECT event_id, json_array_length('[1, 2, 3]')::INTEGER AS n, (json_extract_string(props, '$.k'))::INTEGER + 1 AS k1, array_to_string(json_keys('{"a": 1, "b": 2}'), ',') AS keys FROM events""", """SELECT event_id, json_array_length('[1, 2, 3]') AS n, variant_get(parse_json(props), '$.k', 'int') + 1 AS k1, array_join(json_object_keys('{"a": 1, "b": 2}'), ',') AS keys FROM events""")


@_r.query("SELECT event_id, u.key AS k, u.value AS v FROM (SELECT event_id, unnest([{'key': 'k', 'value': (props::JSON->>'$.k')}]) AS u FROM events)")
def fn_json_each(t):
    """jsonb_each: the members of an object as rows."""
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@_r.query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_type AS missing FROM (SELECT event_id, props, NULL::VARCHAR AS event_type FROM events)")
def fn_json_to_record(t):
    """jsonb_populate_record: declared columns, absent ones null."""
    return t.events.select("event_id", F.from_json("props", "k bigint, missing string").alias("r")).select("event_id", "r.k", "r.missing")


_r.both("fn_row_to_json", """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS j FROM region""", "SELECT r_regionkey, to_json(struct(*)) AS j FROM region")
_r.both("fn_tuple", "SELECT n_nationkey, (n_regionkey, n_name) = (1, 'BRAZIL') AS same, {'a': n_regionkey, 'b': n_name}.b AS b FROM nation", "SELECT n_nationkey, struct(n_regionkey, n_name) = struct(1, 'BRAZIL') AS same, named_struct('a', n_regionkey, 'b', n_name).b AS b FROM nation")


@_r.query("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS x FROM nation GROUP BY n_regionkey")
def fn_xmlagg(t):
    return t.sql("SELECT n_regionkey, listagg('<n>' || n_name || '</n>', '') WITHIN GROUP (ORDER BY n_name) AS x FROM nation GROUP BY n_regionkey")


# Projections of the dialects
_r.query("SELECT * REPLACE (upper(c_name) AS c_name) FROM customer", "expr_star_replace")(lambda t: t.customer.withColumn("c_name", F.upper("c_name")))
_r.query("SELECT s_suppkey, round(s_acctbal, 0) AS s_acctbal FROM supplier", "expr_columns_apply")(lambda t: t.supplier.select("s_suppkey", *[F.round(c, 0).alias(c) for c, k in t.supplier.dtypes if k == "double"]))
_r.both("expr_is_of", "SELECT o_orderkey, typeof(o_totalprice) IN ('DOUBLE', 'FLOAT') AS num, typeof(o_orderstatus) IN ('INTEGER') AS i FROM orders", "SELECT o_orderkey, typeof(o_totalprice) IN ('double', 'float') AS num, typeof(o_orderstatus) IN ('int') AS i FROM orders")
_r.both("expr_default_names", 'SELECT count(*) AS "count", max(r_name) AS "max" FROM region', "SELECT count(*) AS count, max(r_name) AS max FROM region")
_r.both("agg_array_combinator", "SELECT label, round(sum(s), 4) AS s FROM (SELECT label, list_sum(embedding::DOUBLE[]) AS s FROM embeddings) GROUP BY label", "SELECT label, round(sum(aggregate(transform(embedding, x -> double(x)), 0D, (a, x) -> a + x)), 4) AS s FROM embeddings GROUP BY label")
