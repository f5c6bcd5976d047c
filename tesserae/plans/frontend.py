"""SQL of the dialects run on Spark, and the remaining catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.catalog import dialects, listing
from tesserae.plans.catalogs import _CYCLE, values
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


def _dialect(name: str, dialect: str, sql: str, oracle: str | None = None) -> None:
    _r.query(oracle or sql, name)(lambda t: t.sql(dialects.to_spark(sql, dialect)))


_dialect("sql_qualify", "ch", "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
_dialect("sql_distinct_on", "pg", 'SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS "first" FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey', 'SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS "first" FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey')
_dialect("sql_top", "ms", "SELECT TOP (5) [c_custkey], ISNULL(c_name, N'none') AS [name] FROM [customer] ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
_dialect("sql_top_with_ties", "ms", "SELECT TOP 7 WITH TIES p_partkey, LEN(p_name) AS n FROM part ORDER BY p_size DESC", "SELECT p_partkey, length(p_name) AS n FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 7")
_dialect("sql_fetch_with_ties", "pg", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 9 ROWS WITH TIES", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 9")
_dialect("sql_limit_by", "ch", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1, 2 BY c_nationkey", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) BETWEEN 2 AND 3")
_dialect("sql_table_hints", "ms", "SELECT o.o_orderkey, c.c_name FROM orders o WITH (NOLOCK, INDEX(1)) JOIN customer AS c WITH (HOLDLOCK) ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
_dialect("sql_for_update", "pg", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 FOR NO KEY UPDATE OF customer SKIP LOCKED", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
_dialect("sql_functions_pg", "pg", "SELECT n_nationkey, strpos(n_name, 'A') AS a, array_to_string(string_to_array(n_name, 'A'), '-') AS b, $$it's$$ AS c FROM nation", "SELECT n_nationkey, strpos(n_name, 'A') AS a, array_to_string(string_split(n_name, 'A'), '-') AS b, 'it''s' AS c FROM nation")
_dialect("sql_functions_ch", "ch", "SELECT argMax(o_orderkey, o_totalprice) AS top, countIf(o_totalprice > 100000) AS n, toYear(max(o_orderdate)) AS y FROM orders", "SELECT arg_max(o_orderkey, o_totalprice) AS top, count(*) FILTER (WHERE o_totalprice > 100000) AS n, year(max(o_orderdate)) AS y FROM orders")


@_r.query("SELECT * FROM " + values([(1, "w"), (2, "\tf"), (3, "\t\ta"), (4, "\t\tg"), (5, "\t\t\tf - cyclic dependency"), (6, "\tv"), (7, "\t\ta"), (8, "\t\tb"), (9, "\t\t\ta")], "seq, line"))
def graph_listing(t):
    """The dependency listing: indented, a node that comes back marked and cut."""
    e = t.spark.createDataFrame(_CYCLE, "src string, dst string")
    return listing.dependency_lines(e, t.spark.createDataFrame([("w",)], "node string"), 5)


@_r.query("SELECT * FROM " + values([(1, "f(int, text)"), (2, "f(int, any)"), (3, None)], "call, chosen"))
def cat_overload(t):
    """Overload resolution: an exact match, else the candidate with the most exact arguments."""
    calls = t.spark.createDataFrame([(1, "f", ["int", "text"]), (2, "f", ["int", "date"]), (3, "f", ["text"])], "call int, name string, args array<string>")
    known = t.spark.createDataFrame([(0, "f", ["any", "any"]), (1, "f", ["int", "text"]), (2, "f", ["int", "any"]), (3, "g", ["text"])], "ord int, name string, params array<string>")
    return listing.resolved_calls(calls, known)


@_r.query("SELECT * FROM " + values([("a", "ALTER"), ("b", "RECREATE"), ("c", "NOTHING"), ("d", "CREATE"), ("e", "DROP")], "object, state"))
def cat_object_state(t):
    """What a difference asks for, by the properties that changed."""
    old = t.spark.createDataFrame([("a", "owner", "x"), ("a", "comment", "1"), ("b", "engine", "log"), ("c", "owner", "x"), ("e", "owner", "x")], "object string, property string, value string")
    new = t.spark.createDataFrame([("a", "owner", "y"), ("a", "comment", "1"), ("b", "engine", "tree"), ("c", "owner", "x"), ("d", "owner", "x")], "object string, property string, value string")
    return listing.object_states(old, new, rebuild=["engine"])


@_r.query("SELECT * FROM " + values([("s.a.x", False), ("s.b", True), ("s.seq", False), ("s.same", False)], "object, drops"))
def cat_drop_decision(t):
    """A column of a dropped table and an owned sequence go with it; what has an unchanged twin stays."""
    rows = t.spark.createDataFrame([("s.a.x", "COLUMN", True, False, False), ("s.b", "TABLE", False, False, False), ("s.seq", "SEQUENCE", True, False, False), ("s.same", "VIEW", False, False, True)], "object string, kind string, container_dropped boolean, fixed boolean, unchanged_twin boolean")
    return listing.drop_decisions(rows)


@_r.query("SELECT * FROM " + values([("v", "VIEW", "RIGHT")], "object, kind, side"))
def cat_selection_filter(t):
    """Only selected, only these kinds, only real edits."""
    rows = t.spark.createDataFrame([("t", "TABLE", "BOTH", False, True), ("v", "VIEW", "RIGHT", True, True), ("w", "VIEW", "BOTH", False, True), ("x", "VIEW", "LEFT", True, False)], "object string, kind string, side string, changed boolean, selected boolean")
    return rows.where("changed AND selected").where(F.col("kind").isin("VIEW")).select("object", "kind", "side")


@_r.query("SELECT 'fk' AS fk, 'uq' AS target")
def join_fk_to_unique(t):
    """A foreign key meets the key or unique index on the same set of columns."""
    fk = t.spark.createDataFrame([("fk", "s.a", ["y", "x"])], "fk string, ref string, cols array<string>")
    keys = t.spark.createDataFrame([("pk", "s.a", ["id"]), ("uq", "s.a", ["x", "y"]), ("other", "s.b", ["x", "y"])], "target string, rel string, cols array<string>")
    same = (F.col("ref") == F.col("rel")) & (F.array_sort(fk["cols"]) == F.array_sort(keys["cols"]))
    return fk.join(keys, same).select("fk", "target")


@_r.query("SELECT * FROM " + values([("customer", 5), ("nation", 3), ("region", 2)], "relation, n"))
def cat_catalog_aggregates(t):
    """Columns by table, from Spark's own schemas."""
    rows = [(n, c, i) for n in ("customer", "nation", "region") for i, c in enumerate(getattr(t, n).columns)]
    return t.spark.createDataFrame(rows, "relation string, name string, ordinal int").groupBy("relation").agg(F.count(F.lit(1)).cast("int").alias("n"))


@_r.query("SELECT * FROM " + values([("customer", "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment")], "relation, cols"))
def sort_column_layout(t):
    rows = t.spark.createDataFrame([("customer", c, i) for i, c in reversed(list(enumerate(t.customer.columns)))], "relation string, name string, ordinal int")
    return rows.groupBy("relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]), ",").alias("cols"))


@_r.query("SELECT unnest(['abs', 'concat', 'sum']) AS name")
def src_system_objects(t):
    """The built-in functions as a snapshot that is written and read again."""
    from tesserae.session import saved

    rows = saved(t.spark.createDataFrame([(f.name,) for f in t.spark.catalog.listFunctions()], "name string"))
    return rows.where(F.col("name").isin("abs", "concat", "sum")).distinct()


@_r.query("SELECT 'SELECT a,' || chr(10) || '       b' || chr(10) || 'FROM t' || chr(10) || 'WHERE x = ''  y''' || chr(10) || '  AND z' AS sql")
def cat_formatter(t):
    return t.spark.createDataFrame([(listing.formatted("select   a,b from t where x='  y' and z"),)], "sql string")


@_r.query("SELECT n_nationkey, upper(n_name) || '!' AS loud FROM nation")
def udf_from_module(t):
    """A function that lives in a module, as a CLR function lives in an assembly."""
    return t.nation.select("n_nationkey", listing.shout()("n_name").alias("loud"))


@_r.query("SELECT * FROM " + values([("s.seq",), ("public.t",)], "ref"))
def expr_regclass(t):
    """A name given as text and cast to regclass is a dependency."""
    from tesserae.catalog import sql_text

    rows = sql_text.parsed_scripts(t.spark.createDataFrame([("x", "SELECT nextval('s.seq'::regclass), 'no' FROM t")], "file string, sql string"))
    return rows.select(F.explode("refs").alias("r")).select(F.concat_ws(".", "r.schema", "r.object").alias("ref"))


@_r.query("SELECT 1::BIGINT AS with_bodies, 0::BIGINT AS without")
def udf_body_switch(t):
    """Dependencies of function bodies, on and off."""
    from tesserae.catalog import sql_text

    text = "CREATE FUNCTION f() RETURNS int LANGUAGE sql AS $$ SELECT 1 FROM q.r $$"
    return t.spark.createDataFrame([(len(sql_text.parse(text).references), len(sql_text.parse(text, bodies=False).references))], "with_bodies bigint, without bigint")


@_r.query("SELECT * FROM " + values([("f", "g"), ("g", "f"), ("f", "t"), ("v", "t.c")], "src, dst"))
def graph_cycle_removal(t):
    """Functions on a cycle let go of columns, and of the tables whose columns they name."""
    from tesserae.operators.graphs import on_cycle

    e = t.spark.createDataFrame([("f", "g"), ("g", "f"), ("f", "t"), ("g", "t.c"), ("g", "t"), ("v", "t.c")], "src string, dst string")
    kinds = t.spark.createDataFrame([("f", "FUNCTION", None), ("g", "FUNCTION", None), ("t", "TABLE", None), ("t.c", "COLUMN", "t"), ("v", "VIEW", None)], "node string, kind string, parent string")
    cyclic = on_cycle(e).join(kinds.where("kind = 'FUNCTION'"), "node", "left_semi")
    columns = kinds.where("kind = 'COLUMN'").select(F.col("node").alias("dst"), "parent")
    hit = e.join(cyclic.withColumnRenamed("node", "src"), "src", "left_semi").join(columns, "dst")
    gone = hit.select("src", "dst").union(hit.select("src", F.col("parent").alias("dst")))
    return e.join(gone, ["src", "dst"], "left_anti")


@_r.query("SELECT * FROM " + values([("a", "bob", None), ("c", None, "{x=r/y}")], "object, owner, acl"))
def src_overrides_export(t):
    """Only what overrides change is written: owner and privileges."""
    import uuid

    from tesserae.session import shared_dir

    f = f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"
    rows = t.spark.createDataFrame([("a", "bob", None, "CREATE"), ("b", None, None, "CREATE"), ("c", None, "{x=r/y}", "CREATE")], "object string, owner string, acl string, ddl string")
    rows.where("owner IS NOT NULL OR acl IS NOT NULL").select("object", "owner", "acl").write.json(f)
    return t.spark.read.schema("object string, owner string, acl string").json(f)


@_r.query("SELECT n_nationkey FROM nation WHERE n_nationkey > 20")
def src_foreign_table(t):
    """A foreign table: a table of another database under a name here."""
    import uuid

    from tesserae.sources.embedded import DRIVER, embedded

    url, name = embedded(t.spark, {"far": t.nation.select("n_nationkey")}), f"tesserae_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE TABLE {name} USING jdbc OPTIONS (url '{url}', dbtable 'far', driver '{DRIVER}')")
    return t.spark.table(name).where("n_nationkey > 20").select("n_nationkey")


@_r.query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_trigger(t):
    """A statement trigger with a transition table: each batch is audited as it comes."""
    import uuid

    from tesserae.session import shared_dir
    from tesserae.streaming import events as ev

    f = f"{shared_dir(t.spark)}/audit-{uuid.uuid4().hex}"

    def trigger(rows, batch: int) -> None:
        rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).write.mode("overwrite").parquet(f"{f}/out/batch={batch}")

    ev.source(t.spark, t.sf_dir).writeStream.option("checkpointLocation", f"{f}/state").trigger(availableNow=True).foreachBatch(trigger).start().awaitTermination()
    return t.spark.read.parquet(f"{f}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
