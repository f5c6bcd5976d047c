"""Scalar functions by category, several to a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import dialects as d
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL
_r.both("fn_string_basic", "SELECT p_partkey, length(p_name) AS a, lower(p_type) AS b, upper(p_name) AS c, substr(p_name, 2, 4) AS d, concat(p_brand, '-', p_type) AS e, concat_ws('/', p_brand, p_type) AS f, replace(p_name, 'a', 'A') AS g, reverse(p_type) AS h, repeat(p_type, 2) AS i FROM part")
_r.both("fn_string_trim_pad", "SELECT p_partkey, trim('  x ') || '|' AS a, ltrim('  x ') || '|' AS b, rtrim('  x ') || '|' AS c, lpad(p_type, 10, '*') AS d, rpad(p_type, 10, '.') AS e, left(p_name, 3) AS f, right(p_name, 3) AS g FROM part")
_r.both("fn_string_position", "SELECT p_partkey, position('o' IN p_name) AS a, strpos(p_name, 'a') AS b, ascii(p_type) AS c, chr(65 + p_size % 26) AS d, translate(p_type, 'AEO', '123') AS e FROM part", "SELECT p_partkey, position('o' IN p_name) AS a, instr(p_name, 'a') AS b, ascii(p_type) AS c, chr(65 + p_size % 26) AS d, translate(p_type, 'AEO', '123') AS e FROM part")
_r.both("fn_string_hash_encode", "SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, to_base64(c_name::BLOB) AS c, lower(hex(c_name::BLOB)) AS e FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha2(c_name, 256) AS b, base64(binary(c_name)) AS c, lower(hex(c_name)) AS e FROM customer")
_r.both("fn_string_regex", "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS a, regexp_extract(url, '://([^/]+)/', 1) AS b, len(regexp_extract_all(url, '[a-z]+')) AS c, len(string_split(url, '/')) AS d, array_to_string(string_split(url, '/'), '|') AS e FROM pages", "SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS a, regexp_extract(url, '://([^/]+)/', 1) AS b, size(regexp_extract_all(url, '[a-z]+', 0)) AS c, size(split(url, '/')) AS d, array_join(split(url, '/'), '|') AS e FROM pages")


@_r.query("SELECT page_id, split_part(url, '/', 3) AS host, regexp_replace(url, '[0-9]+', '#') AS one, '''' || replace(url, '''', '''''') || '''' AS quoted, 'XY' || substr(url, 4) AS stuffed, strpos(url, '://') AS at FROM pages")
def fn_string_dialects(t):
    return t.pages.select("page_id", d.split_part(F.col("url"), "/", 3).alias("host"), d.replace_first(F.col("url"), "[0-9]+", "#").alias("one"), d.quote_literal(F.col("url")).alias("quoted"), d.stuff(F.col("url"), 1, 3, "XY").alias("stuffed"), d.charindex("://", F.col("url")).alias("at"))


@_r.query("SELECT doc_id, nfc_normalize(text) AS n FROM documents")
def fn_string_normalize(t):
    return t.documents.select("doc_id", d.normalize_utf8("NFC")(F.col("text")).alias("n"))


_r.both("fn_string_format", "SELECT c_custkey, format('{} has {}', c_name, c_nationkey) AS a, printf('%05d', c_custkey) AS b, initcap FROM (SELECT *, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS initcap FROM customer)", "SELECT c_custkey, format_string('%s has %s', c_name, c_nationkey) AS a, format_string('%05d', c_custkey) AS b, initcap(c_mktsegment) AS initcap FROM customer")
_r.both("fn_trim_chars", "SELECT n_nationkey, trim(n_name, 'A') AS b, ltrim(n_name, 'A') AS c FROM nation", "SELECT n_nationkey, trim(BOTH 'A' FROM n_name) AS b, trim(LEADING 'A' FROM n_name) AS c FROM nation")
_r.both("fn_overlay", "SELECT n_nationkey, left(n_name, 1) || 'ZZ' || substr(n_name, 4) AS a FROM nation", "SELECT n_nationkey, overlay(n_name PLACING 'ZZ' FROM 2 FOR 2) AS a FROM nation")
_r.both("fn_date_extract", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, extract(dow FROM o_orderdate) AS dow, extract(doy FROM o_orderdate) AS doy, extract(week FROM o_orderdate) AS w FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofweek(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w FROM orders")
_r.both("fn_date_trunc_format", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts)::DATE AS d, date_trunc('month', ts)::DATE AS m, strftime(ts, '%Y-%m-%d %H:%M') AS s FROM events", "SELECT event_id, cast(date_trunc('hour', ts) AS timestamp_ntz) AS h, date(date_trunc('day', ts)) AS d, date(date_trunc('month', ts)) AS m, date_format(ts, 'yyyy-MM-dd HH:mm') AS s FROM events")
_r.both("fn_date_arithmetic", "SELECT o_orderkey, (o_orderdate + INTERVAL 3 MONTH)::DATE AS a, o_orderdate::DATE - DATE '1995-01-01' AS b, last_day(o_orderdate::DATE) AS c, datediff('month', DATE '1995-01-01', o_orderdate::DATE) AS e FROM orders", "SELECT o_orderkey, date(o_orderdate + INTERVAL 3 MONTH) AS a, datediff(date(o_orderdate), DATE '1995-01-01') AS b, last_day(o_orderdate) AS c, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS e FROM orders")


@_r.query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS q, datediff('hour', TIMESTAMP '2024-01-01', ts) AS hours, datediff('day', DATE '2024-01-01', ts::DATE) AS days, floor(epoch(ts))::BIGINT AS unix FROM events")
def fn_date_dialects(t):
    zero = F.lit("2024-01-01").cast("timestamp_ntz")
    return t.events.select("event_id", d.start_of_interval(F.col("ts"), 900).cast("timestamp_ntz").alias("q"), d.datediff("hour", zero, F.col("ts")).alias("hours"), d.datediff("day", zero, F.col("ts")).alias("days"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix"))


_r.both("fn_date_make", "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS d, strptime('2024-03-0' || (1 + n_regionkey), '%Y-%m-%d')::DATE AS p FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS d, to_date('2024-03-0' || (1 + n_regionkey), 'yyyy-MM-dd') AS p FROM nation")
_r.both("fn_conditional", "SELECT p_partkey, coalesce(nullif(p_size, 1), 100) AS a, greatest(p_size, 10, 20) AS b, least(p_size, 25) AS c, if(p_size > 25, 'big', 'small') AS e FROM part")


@_r.query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS tier FROM part")
def fn_multi_if(t):
    return t.part.select("p_partkey", d.multi_if(F.col("p_size") < 10, F.lit("s"), F.col("p_size") < 30, F.lit("m"), F.lit("l")).alias("tier"))


_r.both("fn_math", "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS b, floor(s_acctbal)::BIGINT AS c, round(sqrt(abs(s_acctbal)), 6) AS d, round(ln(abs(s_acctbal) + 1), 6) AS e, round(exp(s_nationkey / 10.0), 6) AS f, sign(s_acctbal)::DOUBLE AS g, mod(s_suppkey, 7) AS h, round(cbrt(s_suppkey), 6) AS i, round(degrees(s_nationkey), 4) AS j FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, bigint(ceil(s_acctbal)) AS b, bigint(floor(s_acctbal)) AS c, round(sqrt(abs(s_acctbal)), 6) AS d, round(ln(abs(s_acctbal) + 1), 6) AS e, round(exp(s_nationkey / 10.0D), 6) AS f, double(sign(s_acctbal)) AS g, mod(s_suppkey, 7) AS h, round(cbrt(s_suppkey), 6) AS i, round(degrees(s_nationkey), 4) AS j FROM supplier")
_r.both("fn_trigonometry", "SELECT n_nationkey, round(sin(n_nationkey), 8) AS a, round(cos(n_nationkey), 8) AS b, round(atan2(n_nationkey, 3), 8) AS c, round(power(n_nationkey, 1.5), 6) AS d, round(log10(n_nationkey + 1), 8) AS e, round(log2(n_nationkey + 1), 8) AS f, round(pi(), 8) AS g FROM nation")
_r.both("fn_width_bucket", "SELECT c_custkey, least(greatest(floor((c_acctbal - -1000) / 1100) + 1, 0), 11)::BIGINT AS b FROM customer", "SELECT c_custkey, width_bucket(c_acctbal, -1000, 10000, 10) AS b FROM customer")
_r.both("fn_array", "SELECT n_nationkey, list_contains([1, n_regionkey], n_nationkey) AS a, len(list_distinct([1, 1, n_regionkey])) AS b, list_position([4, 3, 2, 1, 0], n_regionkey) AS c, array_to_string(list_sort([n_nationkey, 7, n_regionkey]), ',') AS d, list_max([n_nationkey, 7]) AS e, array_to_string(flatten([[1, 2], [n_regionkey]]), ',') AS f, array_to_string(list_reverse([1, 2, n_regionkey]), ',') AS g FROM nation", "SELECT n_nationkey, array_contains(array(1, n_regionkey), n_nationkey) AS a, size(array_distinct(array(1, 1, n_regionkey))) AS b, array_position(array(4, 3, 2, 1, 0), n_regionkey) AS c, array_join(array_sort(array(n_nationkey, 7, n_regionkey)), ',') AS d, array_max(array(n_nationkey, 7)) AS e, array_join(flatten(array(array(1, 2), array(n_regionkey))), ',') AS f, array_join(reverse(array(1, 2, n_regionkey)), ',') AS g FROM nation")
_r.both("fn_array_sets", "SELECT n_nationkey, array_to_string(list_sort(list_intersect([1, 2, 3], [n_regionkey, 3])), ',') AS a, array_to_string(list_sort(list_filter([1, 2, 3], lambda x: x <> n_regionkey)), ',') AS b, list_has_any([1, 2], [n_regionkey]) AS c, array_to_string(list_concat([n_regionkey], [9]), ',') AS d FROM nation", "SELECT n_nationkey, array_join(array_sort(array_intersect(array(1, 2, 3), array(n_regionkey, 3))), ',') AS a, array_join(array_except(array(1, 2, 3), array(n_regionkey)), ',') AS b, arrays_overlap(array(1, 2), array(n_regionkey)) AS c, array_join(concat(array(n_regionkey), array(9)), ',') AS d FROM nation")


@_r.query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS last_sum, len(embedding) AS n, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS dot FROM embeddings")
def fn_array_numeric(t):
    whole = F.col("embedding").cast("array<double>")
    dot = F.aggregate(F.zip_with(whole, F.reverse(whole), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.round(F.element_at(d.array_cumsum(whole), -1), 6).alias("last_sum"), F.size(d.array_enumerate(F.col("embedding"))).alias("n"), F.round(dot, 6).alias("dot"))


_r.both("fn_map", "SELECT n_nationkey, map([1, 2], [n_name, 'x'])[1] AS a, cardinality(map([1, 2], [n_name, 'x']))::INTEGER AS b, array_to_string(list_sort(map_keys(map([3, n_regionkey + 4], [1, 2]))), ',') AS c FROM nation", "SELECT n_nationkey, map(1, n_name, 2, 'x')[1] AS a, cardinality(map(1, n_name, 2, 'x')) AS b, array_join(array_sort(map_keys(map(3, 1, n_regionkey + 4, 2))), ',') AS c FROM nation")
_r.both("fn_json_value", "SELECT event_id, (props::JSON->>'$.k')::INTEGER AS k, json_extract_string(props, '$.missing') AS m, json_exists(props, '$.k') AS has_k FROM events", "SELECT event_id, int(get_json_object(props, '$.k')) AS k, get_json_object(props, '$.missing') AS m, get_json_object(props, '$.k') IS NOT NULL AS has_k FROM events")
_r.both("fn_json_build", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS o, '[' || n_nationkey || ',' || n_regionkey || ']' AS a FROM nation""", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation")


@_r.query("""SELECT r_regionkey, x.id::BIGINT AS id, x.tag AS tag FROM region, (VALUES (1, 'a'), (2, 'b'), (2, 'c')) x(id, tag)""")
def fn_json_table(t):
    """JSON_TABLE with a nested path: columns declared, arrays exploded."""
    doc = '{"items": [{"id": 1, "tags": ["a"]}, {"id": 2, "tags": ["b", "c"]}]}'
    rows = t.region.select("r_regionkey", F.from_json(F.lit(doc), "items array<struct<id: bigint, tags: array<string>>>").alias("j"))
    return rows.select("r_regionkey", F.explode("j.items").alias("i")).select("r_regionkey", F.col("i.id").alias("id"), F.explode("i.tags").alias("tag"))


@_r.query("SELECT n_nationkey, n_name AS name, n_regionkey AS region, '<nation><name>' || n_name || '</name></nation>' AS element FROM nation")
def fn_xml(t):
    """XMLELEMENT, and XMLTABLE by XPath."""
    doc = F.concat(F.lit("<nation><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey"), F.lit("</region></nation>"))
    element = F.concat(F.lit("<nation><name>"), F.col("n_name"), F.lit("</name></nation>"))
    return t.nation.select("n_nationkey", F.xpath_string(doc, F.lit("nation/name")).alias("name"), F.xpath_int(doc, F.lit("nation/region")).alias("region"), element.alias("element"))


_r.both("fn_type_conversion", "SELECT o_orderkey, typeof(o_orderkey) = 'BIGINT' AS a, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS c, TRY_CAST('x' AS DOUBLE) IS NULL AS d FROM orders", "SELECT o_orderkey, typeof(o_orderkey) = 'bigint' AS a, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS b, double(CAST(o_totalprice AS DECIMAL(18, 2))) AS c, TRY_CAST('x' AS DOUBLE) IS NULL AS d FROM orders")
_r.both("fn_session", "SELECT current_date IS NOT NULL AS a, current_timestamp IS NOT NULL AS b, current_user IS NOT NULL AS c", "SELECT current_date() IS NOT NULL AS a, current_timestamp() IS NOT NULL AS b, current_user() IS NOT NULL AS c")


@_r.query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier")
def fn_identity(t):
    from tesserae.operators.joins import numbered

    return numbered(t.supplier.select("s_suppkey"), [F.col("s_suppkey")], "id").select("s_suppkey", "id")


@_r.query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS path FROM pages")
def fn_url(t):
    part = lambda p: F.coalesce(F.parse_url("url", F.lit(p)), F.lit(""))
    return t.pages.select("page_id", part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), part("PATH").alias("path"))


_r.both("fn_bit_count", "SELECT o_orderkey, bit_count(o_orderkey)::INTEGER AS a, o_orderkey << 2 AS b, o_orderkey >> 1 AS c, bin(o_orderkey) AS d FROM orders", "SELECT o_orderkey, bit_count(o_orderkey) AS a, shiftleft(o_orderkey, 2) AS b, shiftright(o_orderkey, 1) AS c, bin(o_orderkey) AS d FROM orders")
