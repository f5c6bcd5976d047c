"""Joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import aggregates, joins, topk, windows
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL

# Joins
_r.both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_r.both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
_r.both("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
_r.both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
_r.both("join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
_r.both("join_full", "SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k")
_r.both("join_using", "SELECT k, a.x, b.y FROM (SELECT c_nationkey AS k, c_custkey AS x FROM customer) a JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier) b USING (k)")
_r.both("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b")
_r.both("join_natural_full", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 15) a NATURAL FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 9 GROUP BY 1) b")
_r.both("join_lateral_left", "SELECT c_custkey, x.n FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) x ON true")


@_r.query("SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
def join_lateral(t):
    return joins.lateral_limit(t.customer, t.orders, {"c_custkey": "o_custkey"}, 2, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()).select("c_custkey", "o_orderkey")


@_r.query("SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) x")
def join_cross_apply(t):
    c, o = t.customer.alias("c"), t.orders.alias("o")
    return c.lateralJoin(o.where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_totalprice") > 200000)).select("o_orderkey"), how="inner").select("c_custkey", "o_orderkey")


@_r.query("SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) x ON true")
def join_outer_apply(t):
    c, o = t.customer.alias("c"), t.orders.alias("o")
    return c.lateralJoin(o.where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_totalprice") > 250000)).select("o_orderkey"), how="left").select("c_custkey", "o_orderkey")


_ASOF = "FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF {kind} JOIN (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts {op} b.ts"


def _asof(t, **more):
    left = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    return joins.asof_join(left, right, ["user_id"], "ts", **more).select("event_id", F.col("right_event_id").alias("click_id"), F.col("right_value").alias("click_value"))


@_r.query("SELECT a.event_id, b.event_id AS click_id, b.value AS click_value " + _ASOF.format(kind="LEFT", op=">="))
def join_asof_left(t):
    return _asof(t)


@_r.query("SELECT a.event_id, b.event_id AS click_id, b.value AS click_value " + _ASOF.format(kind="", op=">="))
def join_asof_inner(t):
    return _asof(t, how="inner")


@_r.query("SELECT a.event_id, b.event_id AS click_id, b.value AS click_value " + _ASOF.format(kind="LEFT", op="<"))
def join_asof_forward_strict(t):
    return _asof(t, direction="forward", strict=True)


@_r.query("SELECT a.event_id, b.event_id AS click_id, b.value AS click_value " + _ASOF.format(kind="LEFT", op=">="))
def join_asof_sliced(t):
    """The same with a hot key spread over slices of a day."""
    return _asof(t, slice_of=86400)


@_r.query("SELECT a.event_id, b.event_id AS click_id, b.value AS click_value " + _ASOF.format(kind="LEFT", op="<="))
def join_asof_forward_sliced(t):
    return _asof(t, direction="forward", slice_of=86400)


_r.both("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey")
_r.both("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey")


@_r.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_right_semi(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@_r.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_any(t):
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.any_join(t.customer.select("c_custkey"), right, ["c_custkey"], [F.col("o_orderkey")])


_r.both("join_all", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")


@_r.query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) AS n FROM supplier) b USING (n)")
def join_paste(t):
    return joins.paste_join(t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_name"), [F.col("c_acctbal"), F.col("c_custkey")], [F.col("s_name")]).select("c_custkey", "s_suppkey")


@_r.query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_global_hint(t):
    """GLOBAL becomes a broadcast of a table of fixed size."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")


@_r.query("SELECT doc_id, u.i::BIGINT AS pos, u.w AS word FROM (SELECT doc_id, unnest(list_transform(string_split(text, ' '), lambda w, i: {'i': i, 'w': w})) AS u FROM documents)")
def join_array(t):
    """ARRAY JOIN with the position."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "word")


@_r.query("SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [p_size, p_size + 1] ELSE [NULL] END) AS x FROM part")
def join_left_array(t):
    return t.part.select("p_partkey", F.explode_outer(F.when(F.col("p_size") > 25, F.array("p_size", F.col("p_size") + 1))).alias("x"))


for _hint in ("broadcast", "merge", "shuffle_hash"):
    _r.query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", f"join_hint_{_hint}")(lambda t, h=_hint: t.supplier.join(t.nation.hint(h), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"))


@_r.query("SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey")
def join_pivot(t):
    out = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return out.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@_r.query("UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME what VALUE v")
def join_unpivot(t):
    return t.labels.unpivot("doc_id", ["quality", "toxic"], "what", "v").where("v IS NOT NULL")


@_r.query("SELECT n_nationkey, u.i::BIGINT AS ordinality, u.a AS a, u.b AS b FROM (SELECT n_nationkey, unnest(list_transform(range(n_nationkey % 4), lambda x, i: {'i': i, 'a': x, 'b': x * 10})) AS u FROM nation)")
def join_rows_from_ordinality(t):
    a = F.expr("IF(n_nationkey % 4 = 0, array(), sequence(0L, n_nationkey % 4 - 1))")
    zipped = F.posexplode(F.arrays_zip(a.alias("a"), F.transform(a, lambda x: x * 10).alias("b"))).alias("i", "u")
    return t.nation.select("n_nationkey", zipped).select("n_nationkey", (F.col("i") + 1).cast("bigint").alias("ordinality"), F.col("u").getField("a").alias("a"), F.col("u").getField("b").alias("b"))


@_r.query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def join_graph_match(t):
    """MATCH (region)-(nation)-(customer): a chain of edge joins."""
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer.where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_custkey")


@_r.query("WITH RECURSIVE w(node, depth) AS (SELECT 0, 0 UNION SELECT CASE k WHEN 0 THEN (node * 2 + 1) % 23 ELSE (node + 7) % 23 END, depth + 1 FROM w, (VALUES (0), (1)) v(k) WHERE depth < 12) SELECT min(depth)::BIGINT AS steps FROM w WHERE node = 22")
def join_shortest_path(t):
    from tesserae.operators.graphs import shortest_path

    n = t.spark.range(23).select(F.col("id").alias("src"))
    edges = n.select("src", ((F.col("src") * 2 + 1) % 23).alias("dst")).union(n.select("src", ((F.col("src") + 7) % 23).alias("dst")))
    return shortest_path(edges, 0, 22).select((F.size("path") - 1).cast("bigint").alias("steps")).distinct()


_r.both("join_parenthesised", "SELECT x.c_custkey, n_name FROM (SELECT c_custkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 280000) x JOIN nation ON n_nationkey = x.c_nationkey")


@_r.query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice / 100 >= p_retailprice AND o_totalprice / 100 < p_retailprice + 2")
def join_range(t):
    """Range join through cells of the ranges' width."""
    p = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("v"))
    r = t.part.select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 2).alias("hi"))
    return joins.range_join(p, r, "v", "lo", "hi", 2.0).select("o_orderkey", "p_partkey")


# Aggregation
_r.both("agg_group_by", "SELECT c_mktsegment, c_nationkey % 3 AS g, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment, c_nationkey % 3")
_r.both("agg_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
_r.both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, int(grouping(l_returnflag)) AS g1, int(grouping(l_linestatus)) AS g2 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_r.both("agg_mixed_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber, ROLLUP (l_returnflag, l_linestatus)")


@_r.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@_r.query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def agg_rollup(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT n_regionkey, n_nationkey, count(*) AS n, grouping_id(n_regionkey, n_nationkey)::BIGINT AS grouping_id FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey, n_nationkey), ())")
def agg_grouping_id(t):
    return aggregates.grouping_sets(t.nation, [["n_regionkey"], ["n_regionkey", "n_nationkey"], []], ["n_regionkey", "n_nationkey"], F.count(F.lit(1)).alias("n"))


@_r.query("SELECT o_orderstatus, count(*) AS n, grouping(o_orderstatus) = 1 AS is_total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def agg_with_totals(t):
    return aggregates.with_totals(t.orders, ["o_orderstatus"], F.count(F.lit(1)).alias("n"))


_r.both("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
_r.both("agg_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


@_r.query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def agg_distinct_on(t):
    return aggregates.distinct_on(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_r.both("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber)::BIGINT AS x FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber) AS x FROM lineitem GROUP BY l_returnflag")


@_r.query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@_r.query("SELECT o_custkey, array_to_string(array_agg(o_orderkey ORDER BY o_orderdate, o_orderkey), ' ') AS orders_by_date FROM orders GROUP BY o_custkey")
def agg_ordered_array(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(aggregates.ordered_list("o_orderkey", "o_orderdate", "o_orderkey"), " ").alias("orders_by_date"))


_r.both("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS returned FROM lineitem GROUP BY l_linestatus")
_r.both("agg_within_group", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1 FROM lineitem GROUP BY l_returnflag")


@_r.query("SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 1000) + 1 AS rank_of_1000 FROM customer GROUP BY c_mktsegment")
def agg_hypothetical_rank(t):
    return t.customer.groupBy("c_mktsegment").agg(aggregates.hypothetical_rank(F.col("c_acctbal"), 1000).alias("rank_of_1000"))


@_r.query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_percentile(t):
    """The approximate median lies between the exact 48th and 52nd percentile."""
    a = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("a"), F.percentile("l_extendedprice", 0.48).alias("lo"), F.percentile("l_extendedprice", 0.52).alias("hi"))
    return a.select("l_returnflag", F.col("a").between(F.col("lo"), F.col("hi")).alias("near"))


@_r.query("SELECT true AS near")
def agg_approx_distinct(t):
    return t.lineitem.agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.count_distinct("l_partkey") - 1) < 0.08).alias("near"))


@_r.query("""SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY n_regionkey""")
def agg_json_array(t):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))


@_r.query("""SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS by_name FROM nation GROUP BY n_regionkey""")
def agg_json_object(t):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("by_name"))


@_r.query("SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90, sum(l_quantity) FILTER (WHERE l_tax > 0.04) AS sum_if, count(*) FILTER (WHERE l_tax > 0.04) AS count_if FROM lineitem GROUP BY l_returnflag")
def agg_combinators(t):
    """quantile(0.9)(x), sumIf and countIf."""
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.9).alias("p90"), F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))).alias("sum_if"), F.count_if(F.col("l_tax") > 0.04).alias("count_if"))


@_r.query("SELECT count(DISTINCT user_id) BETWEEN 0 AND 100000 AS ok FROM events")
def agg_state_merge(t):
    """-State and -Merge: sketches by day, merged."""
    by_day = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.hll_sketch_agg("user_id").alias("s"))
    merged = by_day.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n"))
    exact = t.events.agg(F.count_distinct("user_id").alias("e"))
    return merged.crossJoin(exact).select((F.abs(F.col("n") - F.col("e")) <= 0.1 * F.col("e") + 1).alias("ok"))


@_r.query("SELECT c_mktsegment, round(exp(avg(ln(c_acctbal)) FILTER (WHERE c_acctbal > 0)), 4) AS geomean FROM customer GROUP BY c_mktsegment")
def agg_user_aggregate(t):
    g = aggregates.geometric_mean()
    return t.customer.groupBy("c_mktsegment").agg(F.round(g("c_acctbal"), 4).alias("geomean"))


@_r.query("SELECT event_type, k, sum(v)::BIGINT AS v FROM (SELECT event_type, unnest(['a', 'b']) AS k, unnest([event_id, 1]) AS v FROM events) GROUP BY ALL")
def agg_sum_map(t):
    rows = t.events.select("event_type", F.create_map(F.lit("a"), F.col("event_id"), F.lit("b"), F.lit(1).cast("bigint")).alias("m"))
    return aggregates.sum_map(rows, ["event_type"], "m", "m").select("event_type", F.explode("m").alias("k", "v"))


_r.both("agg_statistics", "SELECT round(stddev_pop(s_acctbal), 4) AS a, round(stddev_samp(s_acctbal), 4) AS b, round(var_pop(s_acctbal), 2) AS c, round(corr(s_acctbal, s_nationkey), 6) AS d, round(covar_pop(s_acctbal, s_nationkey), 4) AS e, round(covar_samp(s_acctbal, s_nationkey), 4) AS f, regr_count(s_acctbal, s_nationkey)::BIGINT AS g, round(regr_sxx(s_acctbal, s_nationkey), 4) AS h FROM supplier")
_r.both("agg_bool_bit", "SELECT n_regionkey, bool_and(n_nationkey > 2) AS a, bool_or(n_nationkey > 20) AS b, bit_and(n_nationkey) AS c, bit_or(n_nationkey) AS d, bit_xor(n_nationkey) AS e FROM nation GROUP BY n_regionkey")
_r.both("agg_arg_max", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS top, min_by(o_orderkey, o_totalprice) AS low FROM orders GROUP BY o_custkey")
_r.both("agg_mode_any", "SELECT count(*) AS n, count(x) AS known FROM (SELECT nullif(p_size, 5) AS x FROM part)")

# Windows
_r.both("win_over", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
_r.both("win_named", "SELECT o_orderkey, rank() OVER w AS r, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
_r.both("win_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS b FROM events", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM events")
_r.both("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
_r.both("win_interval_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")


@_r.query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM part")
def win_groups_frame(t):
    return windows.groups_frame(t.part, F.sum("p_size"), "s", ["p_brand"], F.col("p_size"), -1, 1).select("p_partkey", "s")


_FRAME = "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {})::BIGINT AS s FROM part"
for _what in ("current row", "group", "ties"):

    @_r.query(f"SELECT p_partkey, coalesce(s, 0) AS s FROM ({_FRAME.format(_what.upper())})", f"win_exclude_{_what.replace(' ', '_')}")
    def _excluded(t, what=_what):
        return windows.exclude(t.part, "p_size", "s", ["p_brand"], [F.col("p_type")], what).select("p_partkey", "s")


_r.both("win_ranking", "SELECT p_partkey, row_number() OVER w AS a, rank() OVER w AS b, dense_rank() OVER w AS c, round(percent_rank() OVER w, 8) AS d, round(cume_dist() OVER w, 8) AS e, ntile(4) OVER w AS f FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
_r.both("win_analytic", "SELECT event_id, lag(event_id, 2) OVER w AS a, lead(event_id, 1, -1) OVER w AS b, first_value(event_id) OVER w AS c, last_value(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d, nth_value(event_id, 2) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)", "SELECT event_id, lag(event_id, 2) OVER w AS a, lead(event_id, 1, -1) OVER w AS b, first_value(event_id) OVER w AS c, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d, nth_value(event_id, 2) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
_r.both("win_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM events")


@_r.query("SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events")
def win_filter(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", windows.filtered(F.count, F.lit(1), F.col("event_type") == "click").over(w).alias("n"))


@_r.query("SELECT c_custkey, round(quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment), 4) AS med FROM customer")
def win_percentile(t):
    """percentile_cont OVER a partition: aggregated and joined back, so that no partition is held whole."""
    med = t.customer.groupBy("c_mktsegment").agg(F.round(F.percentile("c_acctbal", 0.5), 4).alias("med"))
    return t.customer.join(med, "c_mktsegment").select("c_custkey", "med")


@_r.query("SELECT s_suppkey, 1000 + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier")
def win_next_value(t):
    """NEXT VALUE FOR ... OVER (ORDER BY), numbered without one task seeing all rows."""
    return joins.numbered(t.supplier.select("s_suppkey"), [F.col("s_suppkey")], "n").select("s_suppkey", (F.col("n") + 1000).alias("id"))


# Sort, limit, top-k
_r.both("sort_order_by", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey LIMIT 50")
_r.both("sort_nulls_first", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 70")
_r.both("sort_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15")


@_r.query("SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 25")
def sort_with_ties(t):
    return topk.limit_with_ties(t.part, 25, "p_size", descending=True).select("p_partkey", "p_size")


@_r.query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n, count(*) OVER () AS c FROM supplier) WHERE n <= ceil(c * 7 / 100.0)")
def sort_top_percent(t):
    return topk.top_percent(t.supplier, 7, F.col("s_acctbal").desc(), F.col("s_suppkey")).select("s_suppkey")


@_r.query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) BETWEEN 2 AND 4")
def sort_limit_by(t):
    return topk.limit_by(t.orders, 3, ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey"), offset=1).select("o_custkey", "o_orderkey")


@_r.query("SELECT g.k::BIGINT AS k, x.v, last_value(x.v IGNORE NULLS) OVER (ORDER BY g.k) AS filled FROM range(0, (SELECT max(o_custkey) + 1 FROM orders)) g(k) LEFT JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) x ON x.k = g.k")
def sort_with_fill(t):
    """Customers without orders fill the gaps; the upper bound comes from the data."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v")).withColumn("filled", F.col("v"))
    most = t.orders.agg(F.max("o_custkey")).first()[0]
    return topk.with_fill(rows, "k", 0, -1 if most is None else most + 1, 1, ["filled"])


# Set operations
_r.both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_r.both("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_r.both("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
_r.both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_r.both("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_r.both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_r.both("set_precedence", "SELECT 1 AS k UNION ALL SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
_r.both("set_widened", "SELECT k::DOUBLE AS k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier)")


@_r.query("SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation)) = 0 AS equal")
def set_collection_compare(t):
    """Two collections hold the same if neither has anything over the other."""
    a, b = t.nation.select(F.col("n_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")).distinct()
    over = a.exceptAll(b).limit(1).union(b.exceptAll(a).limit(1))
    return over.agg((F.count(F.lit(1)) == 0).alias("equal"))


@_r.query("SELECT text, min(conv_id * 1000 + turn) AS first_at FROM conversations GROUP BY text")
def set_dedup_keep_first(t):
    """Statement dedup: of equal texts the first place stays."""
    return t.conversations.groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"))
