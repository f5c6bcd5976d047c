"""Sources and sinks as queries: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.plans.catalogs import NEW_SCRIPT, OLD_SCRIPT, values
from tesserae.plans.registry import Registry
from tesserae.session import shared_dir
from tesserae.sources import readers, writers
from tesserae.sources.embedded import DRIVER, embedded

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


def _put(t, path: str, text: str, name: str) -> None:
    """A text file in a store that Spark reaches."""
    jvm = t.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


@_r.query("SELECT * FROM " + values([("s", "SCHEMA"), ("a", "TABLE"), ("b", "TABLE"), ("v", "VIEW"), ("f()", "FUNCTION"), ("g()", "FUNCTION"), ("b", "INDEX")], "object, kind"))
def src_sql_dump(t):
    f = _folder(t)
    _put(t, f, OLD_SCRIPT, "dump.sql")
    _put(t, f, "DROP TABLE x;", "notes.txt")
    return readers.load_dump(t.spark, f).select("object", "kind")


@_r.query("SELECT * FROM " + values([("s", "a"), ("s", "v")], "schema, object"))
def src_project_by_schema(t):
    """Folders of other schemas are not read."""
    f = _folder(t)
    _put(t, f, "CREATE TABLE s.a (x int);", "SCHEMA/s/TABLE/a.sql")
    _put(t, f, "CREATE VIEW s.v AS SELECT 1;", "SCHEMA/s/VIEW/v.sql")
    _put(t, f, "CREATE TABLE q.a (x int);", "SCHEMA/q/TABLE/a.sql")
    return readers.load_project(t.spark, f, ["s"]).select("schema", "object")


@_r.query("SELECT 'q' AS schema, 'a' AS object")
def src_flat_project(t):
    f = _folder(t)
    _put(t, f, "CREATE TABLE s.a (x int);", "s.a.sql")
    _put(t, f, "CREATE TABLE q.a (x int);", "q.a.sql")
    return readers.load_flat_project(t.spark, f, ["q"]).select("schema", "object")


@_r.query("SELECT * FROM " + values([("a.sql", "local"), ("jdbc:postgresql://h/d", "jdbc"), ("https://h/x.zip", "url")], "source, kind"))
def src_library_kind(t):
    return t.spark.createDataFrame([(s, readers.library_kind(s)) for s in ("a.sql", "jdbc:postgresql://h/d", "https://h/x.zip")], "source string, kind string")


@_r.query("SELECT * FROM " + values([("w", 1), ("g()", 0)], "object, lib_ord"))
def src_libraries(t):
    """Two libraries, one named twice; objects that only one has."""
    f = _folder(t)
    _put(t, f, OLD_SCRIPT, "a.sql")
    _put(t, f, NEW_SCRIPT, "b.sql")
    rows = readers.load_libraries(t.spark, [f"{f}/a.sql", f"{f}/b.sql", f"{f}/a.sql"])
    return rows.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.min("lib_ord").alias("lib_ord")).where("n = 1 AND object IN ('w', 'g()')").select("object", "lib_ord")


@_r.query("SELECT * FROM " + values([("a.sql", None, True, False), ("b.sql", "bob", False, True)], "path, owner, nested, ignore_privileges"))
def src_library_list(t):
    f = _folder(t)
    _put(t, f, '<libraries><library path="a.sql" nested="true"/><library path="b.sql" owner="bob" ignorePrivileges="true"/></libraries>', "libs.xml")
    return readers.library_list(t.spark, f)


@_r.query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def src_jdbc(t):
    """Catalog queries over JDBC, here an embedded database, one connection each."""
    url = embedded(t.spark, {"nation": t.nation})
    return readers.read_jdbc(t.spark, url, {"nation": 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_regionkey" = 1'}, DRIVER)["nation"]


@_r.query("SELECT n_regionkey AS schema, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def src_restricted(t):
    return readers.restricted(t.nation.select(F.col("n_regionkey").alias("schema"), "n_name"), [1, 3])


@_r.query("SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS k FROM customer WHERE c_custkey % 2 = 0")
def src_copy(t):
    """COPY TO and FROM with a separator, a null text and WHERE on load."""
    f = _folder(t)
    readers.copy_to(t.customer.select("c_custkey", "c_name", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k")), f, sep="|", header=True, null="\\N")
    return readers.copy_from(t.spark, f, "c_custkey bigint, c_name string, k int", sep="|", header=True, null="\\N", where="c_custkey % 2 = 0")


@_r.query("SELECT r_regionkey, r_name FROM region")
def src_external_table(t):
    f = _folder(t)
    t.region.write.options(sep=";", header=True).csv(f)
    return readers.declared(t.spark, "tesserae_ext", [("r_regionkey", "int"), ("r_name", "string")], f, "csv", sep=";", header="true")


@_r.query("SELECT n_nationkey, n_regionkey AS a, n_name AS b FROM nation")
def src_openjson(t):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b"))).alias("rows")))
    return readers.open_json(t.nation.select("n_nationkey", doc.alias("doc")), "doc", "a: int, b: string")


@_r.query("SELECT n_nationkey, n_name AS b, 'x' AS c FROM nation UNION ALL SELECT n_nationkey, 'z', 'y' FROM nation")
def src_openxml(t):
    doc = F.concat(F.lit("<d><r><b>"), F.col("n_name"), F.lit("</b><c>x</c></r><r><b>z</b><c>y</c></r></d>"))
    return readers.open_xml(t.nation.select("n_nationkey", doc.alias("doc")), "doc", "d/r", {"b": "b", "c": "c"})


@_r.query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_mktsegment AS seg, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS nation FROM customer UNION ALL SELECT c_custkey, 'second', NULL, NULL FROM customer")
def src_openxml_missing(t):
    """Elements that lack a child or an attribute: its column is null, and the others stay where they belong."""
    name = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("<name>"), "c_name", F.lit("</name>"))).otherwise("")
    nation = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" nation='"), F.col("c_nationkey"), F.lit("'"))).otherwise("")
    doc = F.concat(F.lit("<d><rows><r"), nation, F.lit(">"), name, F.lit("<in><seg>"), "c_mktsegment", F.lit("</seg></in></r><r><name>second</name></r></rows></d>"))
    return readers.open_xml(t.customer.select("c_custkey", doc.alias("doc")), "doc", "d/rows/r", {"name": "name", "seg": "in/seg", "nation": "@nation"})


@_r.query("SELECT range AS number FROM range(5, 1005)")
def src_numbers(t):
    return readers.numbers(t.spark, 1000, 5)


@_r.query("SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def src_dictionary(t):
    d = t.nation.where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return readers.dictionary(t.customer.select("c_custkey", "c_nationkey"), d, "c_nationkey", {"n_name": "none"}).select("c_custkey", "n_name")


@_r.query("SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN 'h1' ELSE 'h2' END AS half FROM orders WHERE year(o_orderdate) = 1997")
def src_range_dictionary(t):
    table = t.spark.createDataFrame([(1, "1997-01-01", "1997-06-30", "h1"), (1, "1997-07-01", "1997-12-31", "h2")], "k int, lo string, hi string, half string").selectExpr("k", "date(lo) lo", "date(hi) hi", "half")
    rows = t.orders.where(F.year("o_orderdate") == 1997).select("o_orderkey", F.lit(1).alias("k"), F.to_date("o_orderdate").alias("d"))
    return readers.range_dictionary(rows, table, "k", "d", "lo", "hi", "half").select("o_orderkey", "half")


@_r.query("WITH r AS (SELECT n_regionkey AS k, DATE '1995-01-01' + (100 * n_nationkey)::INTEGER AS lo, DATE '1995-01-01' + (100 * n_nationkey + 700)::INTEGER AS hi, n_name AS v FROM nation), q AS (SELECT o_custkey % 5 AS k, o_orderdate::DATE AS d FROM orders) SELECT q.k, q.d, (SELECT arg_max(r.v, r.lo) FROM r WHERE r.k = q.k AND q.d BETWEEN r.lo AND r.hi) AS v FROM q")
def src_range_dictionary_repeats(t):
    """Overlapping ranges, rows that repeat, and rows that no range holds."""
    day = F.lit("1995-01-01").cast("date")
    table = t.nation.select(F.col("n_regionkey").alias("k"), F.date_add(day, 100 * F.col("n_nationkey")).alias("lo"), F.date_add(day, 100 * F.col("n_nationkey") + 700).alias("hi"), F.col("n_name").alias("v"))
    rows = t.orders.select((F.col("o_custkey") % 5).alias("k"), F.to_date("o_orderdate").alias("d"))
    return readers.range_dictionary(rows, table, "k", "d", "lo", "hi", "v")


@_r.query("SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def src_table_layout(t):
    """Two tables bucketed alike join without moving either."""
    o = t.spark.table(t.create(t.orders.select("o_orderkey", "o_custkey"), buckets=(4, "o_custkey"), order=["o_custkey"]))
    c = t.spark.table(t.create(t.customer.select("c_custkey"), buckets=(4, "c_custkey"), order=["c_custkey"]))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_returnflag")
def src_partition_pruning(t):
    f = t.spark.table(t.create(t.lineitem.select("l_orderkey", "l_returnflag"), partition=["l_returnflag"]))
    return f.where("l_returnflag = 'R'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT event_type, sum(event_id)::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def src_summing_engine(t):
    """A summing table: parts are added up when they are read."""
    parts = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("event_id").alias("total"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("event_type").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@_r.query("SELECT * FROM " + values([(1, "r_regionkey int, r_name string")], "line, text"))
def src_result_display(t):
    return t.spark.createDataFrame([(1, writers.display(t.region)[0])], "line int, text string")


@_r.query("SELECT 10::BIGINT AS total")
def src_script_run(t):
    text = "CREATE OR REPLACE TEMP VIEW tess_r AS SELECT id FROM range(5)\nGO\nSELECT 1; SELECT sum(id) AS total FROM tess_r\nGO\n"
    return writers.run_script(t.spark, text, "GO")


@_r.query("SELECT * FROM " + values([("a", "TABLE", "CREATE TABLE a"), ("a", "VIEW", "CREATE VIEW v2"), ("b", "TABLE", "CREATE TABLE b")], "schema, kind, value"))
def src_export(t):
    """Export by schema and kind, then a partial one that rewrites changed containers only, all or nothing."""
    f = f"{_folder(t)}/out"
    rows = lambda v: t.spark.createDataFrame([("a", "TABLE", "a", "CREATE TABLE a"), ("a", "VIEW", "v", v), ("b", "TABLE", "b", "CREATE TABLE b")], "schema string, kind string, object string, ddl string")
    writers.replace_folder(t.spark, f, lambda path: writers.export_catalog(rows("CREATE VIEW v"), path))
    writers.export_changed(rows("CREATE VIEW v2"), t.spark.createDataFrame([("a", "VIEW")], "schema string, kind string"), f)
    return t.spark.read.text(f).select("schema", "kind", "value")


@_r.query("SELECT 'kept' AS value")
def src_failed_update(t):
    """An update that fails leaves the folder as it was."""
    f = f"{_folder(t)}/out"
    one = t.spark.createDataFrame([("kept",)], "value string")
    writers.replace_folder(t.spark, f, lambda path: one.write.text(path))

    def broken(path):
        one.write.text(path)
        raise ValueError("broken")

    try:
        writers.replace_folder(t.spark, f, broken)
    except ValueError:
        pass
    return t.spark.read.text(f).select("value")


@_r.query("SELECT * FROM " + values([("numeric(10,2)", "decimal(10,2)"), ("timestamp with time zone", "timestamp"), ("Array(Nullable(Int64))", "array<bigint>"), ("integer[]", "array<int>"), ("Map(String, UInt64)", "map<string,decimal(20,0)>"), ("LowCardinality(String)", "string"), ("bytea", "binary"), ("character varying(20)", "string")], "source, type"))
def src_types(t):
    """Types of the three dialects."""
    names = ["numeric(10,2)", "timestamp with time zone", "Array(Nullable(Int64))", "integer[]", "Map(String, UInt64)", "LowCardinality(String)", "bytea", "character varying(20)"]
    return t.spark.createDataFrame([(n, readers.spark_type(n).simpleString()) for n in names], "source string, type string")


for _fmt in ("orc", "json", "parquet"):

    @_r.query("SELECT s_suppkey, s_name, s_nationkey FROM supplier", f"src_format_{_fmt}")
    def _format(t, fmt=_fmt):
        f = _folder(t)
        rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
        rows.write.format(fmt).save(f)
        return t.spark.read.schema(rows.schema).format(fmt).load(f)
