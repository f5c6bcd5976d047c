"""Catalogs as data: diff, rules, graphs, scripts. The catalogs are small frames written out here, and the same rows for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.catalog import actions, diff, rules, sql_text
from tesserae.operators import graphs
from tesserae.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.QUERIES, _r.ORACLE_SQL


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB subquery."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns}))"


def _frame(t, rows, schema):
    return t.spark.createDataFrame(rows, schema)


OLD_SCRIPT = """
CREATE SCHEMA s;
CREATE TABLE s.a (id integer NOT NULL, name text DEFAULT 'x', gone date);
CREATE TABLE s.b (id integer NOT NULL, a_id integer REFERENCES s.a (id));
CREATE VIEW s.v AS SELECT a.id, b.id AS b_id FROM s.a a JOIN s.b b ON b.a_id = a.id;
CREATE FUNCTION s.f() RETURNS void LANGUAGE sql AS $$ SELECT s.g(); SELECT count(*) FROM s.a $$;
CREATE FUNCTION s.g() RETURNS void LANGUAGE sql AS $$ SELECT s.f() $$;
CREATE INDEX i ON s.b (a_id);
"""
NEW_SCRIPT = """
CREATE SCHEMA s;
CREATE TABLE s.a (id bigint NOT NULL, name text DEFAULT 'y', added date);
CREATE TABLE s.b (id integer NOT NULL, a_id integer REFERENCES s.a (id));
CREATE VIEW s.v AS SELECT a.id, b.id AS b_id FROM s.a a JOIN s.b b ON b.a_id = a.id;
CREATE VIEW s.w AS SELECT count(*) AS n FROM s.v;
CREATE FUNCTION s.f() RETURNS void LANGUAGE sql AS $$ SELECT s.g(); SELECT count(*) FROM s.a $$;
"""


def _loaded(t, script: str):
    """A script's objects with key, container and text."""
    rows = sql_text.parsed_scripts(_frame(t, [("dump.sql", script)], "file string, sql string"))
    name = F.coalesce("sub", "object")
    parent = F.when(F.col("kind") == "SCHEMA", F.lit(None)).when(F.col("sub").isNotNull(), F.concat_ws(".", "schema", "object", F.lit("TABLE"))).otherwise(F.concat_ws(".", "schema", "schema", F.lit("SCHEMA")))
    return rows.where("action = 'CREATE'").select("schema", name.alias("object"), "kind", "kind_ord", parent.alias("parent"), "columns", "refs", "ddl")


@_r.query("SELECT * FROM " + values([("s", "s", "SCHEMA", "BOTH", False), ("s", "a", "TABLE", "BOTH", True), ("s", "w", "VIEW", "RIGHT", True), ("s", "g()", "FUNCTION", "LEFT", True), ("s", "i", "INDEX", "LEFT", True), ("s", "b", "TABLE", "BOTH", False)], "schema, object, kind, side, changed"))
def cat_tree_diff(t):
    """Two dumps compared; containers of changes are marked."""
    return diff.tree_diff(_loaded(t, OLD_SCRIPT), _loaded(t, NEW_SCRIPT), parent="parent").select("schema", "object", "kind", "side", "changed")


@_r.query("SELECT 0::BIGINT AS n")
def cat_self_diff_is_empty(t):
    return diff.tree_diff(_loaded(t, OLD_SCRIPT), _loaded(t, OLD_SCRIPT), parent="parent").agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT true AS same")
def cat_reverted(t):
    """diff(a, b) is diff(b, a) with the sides swapped."""
    a, b = _loaded(t, OLD_SCRIPT), _loaded(t, NEW_SCRIPT)
    x, y = diff.reverted(diff.tree_diff(a, b, parent="parent")), diff.tree_diff(b, a, parent="parent")
    over = x.exceptAll(y).limit(1).union(y.exceptAll(x).limit(1))
    return over.agg((F.count(F.lit(1)) == 0).alias("same"))


def _columns(t, script):
    return _loaded(t, script).select("schema", F.col("object").alias("relation"), F.explode("columns").alias("c")).select("schema", "relation", "c.*")


@_r.query("SELECT * FROM " + values([("s", "a", "id", "BOTH"), ("s", "a", "name", "BOTH"), ("s", "a", "gone", "LEFT"), ("s", "a", "added", "RIGHT")], "schema, relation, name, side"))
def cat_column_diff(t):
    return diff.column_diff(_columns(t, OLD_SCRIPT), _columns(t, NEW_SCRIPT))


@_r.query("SELECT 's' AS schema, 'a' AS relation")
def cat_tables_with_changed_columns(t):
    return diff.column_diff(_columns(t, OLD_SCRIPT), _columns(t, NEW_SCRIPT)).select("schema", "relation").distinct()


@_r.query("SELECT true AS ordered_differs, true AS unordered_same")
def cat_content_hash(t):
    rows = _frame(t, [(1, ["a", "b"]), (2, ["b", "a"])], "id int, cols array<string>")
    h = rows.select(diff.content_hash(["cols"]).alias("o"), diff.content_hash(["cols"], ["cols"]).alias("u"))
    return h.agg((F.count_distinct("o") == 2).alias("ordered_differs"), (F.count_distinct("u") == 1).alias("unordered_same"))


@_r.query("SELECT CASE WHEN o.p_partkey IS NULL THEN 'I' WHEN n.p_partkey IS NULL THEN 'D' ELSE 'U' END AS operation, coalesce(o.p_partkey, n.p_partkey) AS p_partkey FROM (SELECT * FROM part WHERE p_partkey % 10 <> 3) o FULL JOIN (SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size) FROM part WHERE p_partkey % 10 <> 4) n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_size <> n.p_size")
def cat_changetable(t):
    """Changed rows between two versions of a table."""
    from tesserae.operators.dml import changes_between

    old = t.part.where("p_partkey % 10 <> 3")
    new = t.part.where("p_partkey % 10 <> 4").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changes_between(old, new, ["p_partkey"])


_OBJECTS = [("s", None, "s", "s", "SCHEMA"), ("s.a", "s", "a", "s.a", "TABLE"), ("s.b", "s", "b", "s.b", "TABLE"), ("s.v", "s", "v", "s.v", "VIEW"), ("s.a.i", "s.a", "i", "s.i", "INDEX"), ("q", None, "q", "q", "SCHEMA"), ("q.tmp_x", "q", "tmp_x", "q.tmp_x", "TABLE"), ("q.y", "q", "y", "q.y", "FUNCTION")]
_OBJECT_SCHEMA = "id string, parent string, name string, qname string, kind string"


def _ruled(t, text, db=""):
    show_all, found = rules.parse_rules(text)
    return rules.shown(_frame(t, _OBJECTS, _OBJECT_SCHEMA), show_all, found, db).where("shown").select("id")


@_r.query("SELECT unnest(['s', 's.b', 's.v', 'q', 'q.y']) AS id")
def cat_rules_show_all(t):
    """Hidden with contents, by pattern, and by a kind."""
    return _ruled(t, "SHOW ALL\nHIDE CONTENT a type=TABLE # with its indexes\nHIDE REGEX '^tmp_'\nHIDE NONE v type=TABLE\n")


@_r.query("SELECT unnest(['s', 's.a', 's.b', 's.a.i', 's.v', 'q.y']) AS id")
def cat_rules_hide_all(t):
    """Shown with contents but for what a stronger rule skips; a rule for another database does not count."""
    return _ruled(t, "HIDE ALL\nSHOW CONTENT s type=SCHEMA\nSHOW QUALIFIED, REGEX \"^q[.]y$\"\nSHOW NONE tmp_x db='^other'\n", "main")


@_r.query("SELECT * FROM " + values([("a", True, True)], "name, content, hides"))
def cat_rule_merge(t):
    """Rules that match alike: the wider one stays."""
    _, found = rules.parse_rules("SHOW ALL\nHIDE NONE a\nHIDE CONTENT a\n")
    return _frame(t, [(r.name, r.content, not r.show) for r in found], "name string, content boolean, hides boolean")


@_r.query("SELECT * FROM " + values([("s", "SHOW"), ("tmp", "HIDE"), ("q", "HIDE")], "schema, status"))
def cat_schema_rules(t):
    """Of a list of schema rules the first that fits counts."""
    found = _frame(t, [(0, "^s$", "SHOW"), (1, "^tmp", "HIDE"), (2, "^t", "SHOW"), (3, ".", "HIDE")], "idx int, rule string, status string")
    schemas = _frame(t, [("s",), ("tmp",), ("q",)], "schema string")
    return schemas.crossJoin(F.broadcast(found)).where("regexp_like(schema, rule)").groupBy("schema").agg(F.min_by("status", "idx").alias("status"))


@_r.query("SELECT * FROM " + values([("VIEW", "public.emp_view", "TABLE", "public.emp"), ("FUNCTION", "a.f(int, text)", "SEQUENCE", "a.s")], "src_kind, src, dst_kind, dst"))
def cat_dependency_list(t):
    found = rules.parse_dependencies("view public.emp_view->table public.emp;\nFUNCTION a.f(int,text) -> Sequence a.s;")
    return _frame(t, [(*a, *b) for a, b in found], "src_kind string, src string, dst_kind string, dst string")


# Graphs over the driver tables: customers and their nation, nations and their region
_FK = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def _edges(t):
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return c.union(n).union(s)


@_r.query(f"WITH RECURSIVE e AS ({_FK}), w(seed, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT seed, dst, depth + 1 FROM w JOIN e ON node = src) SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL")
def graph_closure(t):
    e = _edges(t)
    return graphs.reachable(e, e.select(F.col("src").alias("node")).distinct())


@_r.query(f"WITH RECURSIVE e AS ({_FK}), w(seed, node, depth) AS (SELECT 'r1', 'r1', 0 UNION SELECT seed, src, depth + 1 FROM w JOIN e ON node = dst) SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL")
def graph_closure_reverse(t):
    return graphs.reachable(_edges(t), _frame(t, [("r1",)], "node string"), reverse=True)


@_r.query(f"WITH RECURSIVE e AS ({_FK}), w(node) AS (SELECT 'n3' UNION SELECT dst FROM w JOIN e ON node = src), u(node) AS (SELECT 'n3' UNION SELECT src FROM u JOIN e ON node = dst) SELECT 'n3' AS seed, node FROM (SELECT node FROM w UNION SELECT node FROM u)")
def graph_connected_set(t):
    return graphs.connected(_edges(t), _frame(t, [("n3",)], "node string"))


_CYCLE = [("f", "g"), ("g", "f"), ("f", "a"), ("v", "a"), ("v", "b"), ("b", "a"), ("w", "v"), ("w", "f")]


@_r.query("WITH RECURSIVE e(src, dst) AS " + values(_CYCLE, "src, dst") + ", w(path, cyclic) AS (SELECT ['w'], false UNION ALL SELECT list_append(path, dst), list_contains(path, dst) FROM w JOIN e ON path[-1] = src WHERE NOT cyclic AND len(path) <= 6) SELECT array_to_string(path, '>') AS path, cyclic FROM w")
def graph_paths(t):
    """All dependency paths of one object; one that comes back is marked and cut."""
    return graphs.paths(_frame(t, _CYCLE, "src string, dst string"), _frame(t, [("w",)], "node string"), 6).select(F.array_join("path", ">").alias("path"), "cyclic")


@_r.query("SELECT * FROM " + values([("a", 0), ("b", 1), ("v", 2), ("f", None), ("g", None), ("w", None)], "node, level"))
def graph_levels(t):
    return graphs.levels(_frame(t, _CYCLE, "src string, dst string"))


@_r.query("SELECT unnest(['f', 'g']) AS node")
def graph_cycles(t):
    return graphs.on_cycle(_frame(t, _CYCLE, "src string, dst string"))


@_r.query("SELECT * FROM " + values([("v", "a"), ("b", "a")], "src, dst"))
def graph_reduction(t):
    """Column endpoints collapse into their tables."""
    e = _frame(t, [("v", "a.x"), ("v", "a.y"), ("b.k", "a.x"), ("a.x", "a")], "src string, dst string")
    return graphs.reduced(e, _frame(t, [("a.x", "a"), ("a.y", "a"), ("b.k", "b")], "child string, parent string"))


@_r.query("SELECT * FROM " + values([("s.v", "s.a"), ("s.v", "s.b"), ("s.b", "s.a"), ("s.f()", "s.a"), ("s.f()", "s.g()"), ("s.g()", "s.f()"), ("s.i", "s.b")], "src, dst"))
def graph_build(t):
    """Edges of a script: references that resolve, and children to their parents."""
    rows = _loaded(t, OLD_SCRIPT)
    name = F.concat_ws(".", "schema", "object")
    refs = rows.select(name.alias("src"), F.explode("refs").alias("r")).select("src", F.concat_ws(".", "r.schema", "r.object").alias("dst"))
    index = rows.where("kind = 'INDEX'").select(name.alias("src"), F.regexp_extract("parent", r"^(.*)\.TABLE$", 1).alias("dst"))
    known = rows.select(name.alias("dst")).distinct()
    return refs.union(index).where("src <> dst").distinct().join(known, "dst", "left_semi").select("src", "dst")


@_r.query("SELECT * FROM " + values([(0, "DROP", "w"), (1, "DROP", "v"), (2, "DROP", "a"), (3, "ALTER", "c"), (4, "CREATE", "a"), (5, "CREATE", "v")], "seq, action, object"))
def cat_action_resolver(t):
    """A recreated table takes its view along; a view that is gone stays so."""
    steps = actions.resolve([actions.Change("a", "BOTH", "RECREATE"), actions.Change("c", "BOTH"), actions.Change("v", "BOTH"), actions.Change("w", "LEFT")], [("v", "a"), ("w", "v")], [("v", "a")], {"a", "c", "v"})
    return _frame(t, [(i, *s) for i, s in enumerate(steps)], "seq int, action string, object string")


@_r.query("SELECT 'SET x;' || chr(10) || chr(10) || 'DROP VIEW v;' || chr(10) || chr(10) || 'CREATE VIEW v;' AS script")
def cat_script(t):
    return actions.script(_frame(t, [("MID", 2, "CREATE VIEW v;"), ("MID", 1, "DROP VIEW v;"), ("PRE", 9, "SET x;"), ("POST", 1, "SET x;")], "phase string, seq int, sql string"))


@_r.query("SELECT * FROM " + values([(1, "ALTER TABLE a ADD COLUMN x int, DROP COLUMN y;"), (3, "ALTER TABLE b ADD COLUMN z int;"), (4, "ALTER TABLE a ADD COLUMN w int;")], "seq, sql"))
def cat_joined_alters(t):
    return actions.joined_alters(_frame(t, [(1, "a", "ADD COLUMN x int"), (2, "a", "DROP COLUMN y"), (3, "b", "ADD COLUMN z int"), (4, "a", "ADD COLUMN w int")], "seq int, relation string, clause string"))


@_r.query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, NULL::VARCHAR AS p_note FROM part")
def cat_data_movement(t):
    """Rows of a recreated table with a wider type, a column less and a column more."""
    new = t.spark.createDataFrame([], "p_partkey bigint, p_name string, p_size bigint, p_note string")
    return actions.moved(t.part, new)


@_r.query("SELECT 'DROP COLUMN,DROP TABLE' AS dangers")
def cat_danger_set(t):
    """What a script does that was not allowed."""
    text = "DROP TABLE a; ALTER TABLE b DROP COLUMN c, ALTER COLUMN d TYPE text; UPDATE e SET f = 'DROP TABLE'; ALTER SEQUENCE s RESTART WITH 5;"
    rows = sql_text.parsed_scripts(_frame(t, [("x.sql", text)], "file string, sql string"))
    return actions.forbidden(rows, ["UPDATE", "RESTART WITH", "ALTER COLUMN"]).select(F.array_join("dangers", ",").alias("dangers"))


@_r.query("SELECT * FROM " + values([("t", "bob", "SELECT", True), ("t", "bob", "UPDATE", False), ("t", "PUBLIC", "EXECUTE", False)], "object, grantee, privilege, grantable"))
def cat_privileges(t):
    return diff.grants(_frame(t, [("t", "{bob=r*w/owner,=X/owner}")], "object string, acl string"))


@_r.query("SELECT * FROM " + values([("x.sql", 2, "s.a"), ("x.sql", 2, "s.b"), ("x.sql", 4, "public.c")], "file, line, ref"))
def cat_reference_listing(t):
    """References by place, strings and comments left alone."""
    text = "-- from z\nSELECT * FROM s.a, s.b WHERE x = 'FROM y';\n\nINSERT INTO c VALUES (1);"
    rows = sql_text.parsed_scripts(_frame(t, [("x.sql", text)], "file string, sql string"))
    return rows.select("file", "line", F.explode("refs").alias("r")).select("file", "line", F.concat_ws(".", "r.schema", "r.object").alias("ref"))


@_r.query("SELECT * FROM " + values([(0, "SELECT ';' AS a"), (1, "CREATE FUNCTION f() AS $x$ a; b $x$"), (2, "SELECT 2")], "seq, ddl"))
def cat_statement_split(t):
    text = "SELECT ';' AS a; /* ; */ CREATE FUNCTION f() AS $x$ a; b $x$;\n-- ;\nSELECT 2"
    return sql_text.parsed_scripts(_frame(t, [("x.sql", text)], "file string, sql string")).select("seq", "ddl")


@_r.query("SELECT * FROM " + values([(0, "SELECT 1; SELECT 2"), (1, "SELECT 3")], "seq, ddl"))
def cat_statement_batches(t):
    """T-SQL batches between GO lines."""
    return sql_text.parsed_scripts(_frame(t, [("x.sql", "SELECT 1; SELECT 2\nGO\nSELECT 3\ngo\n")], "file string, sql string"), "GO").select("seq", "ddl")


@_r.query("SELECT * FROM " + values([("s", "a", "v1"), ("s", "b", "v1")], "schema, object, ddl"))
def cat_library_merge(t):
    """The first library that defines an object wins."""
    rows = _frame(t, [(0, "s", "a", "TABLE", "v1"), (1, "s", "a", "TABLE", "v2"), (1, "s", "b", "TABLE", "v1"), (2, "s", "b", "TABLE", "v1")], "lib_ord int, schema string, object string, kind string, ddl string")
    return diff.merged_libraries(rows)[0].select("schema", "object", "ddl")


@_r.query("SELECT 's' AS schema, 'a' AS object, 'v2' AS ddl")
def cat_library_overrides(t):
    rows = _frame(t, [(0, "s", "a", "TABLE", "v1"), (1, "s", "a", "TABLE", "v2"), (1, "s", "b", "TABLE", "v1"), (2, "s", "b", "TABLE", "v1")], "lib_ord int, schema string, object string, kind string, ddl string")
    return diff.merged_libraries(rows)[1].select("schema", "object", "ddl")


@_r.query("SELECT * FROM " + values([("a", "bob", "r"), ("b", "eve", "w")], "object, owner, acl"))
def cat_override_load(t):
    base = _frame(t, [("a", "amy", "r"), ("b", "amy", "w")], "object string, owner string, acl string")
    return diff.overridden(base, _frame(t, [("a", "bob", None), ("b", "eve", None)], "object string, owner string, acl string"), ["object"], ["owner", "acl"])


@_r.query("SELECT * FROM " + values([(0, "i"), (1, "g()"), (2, "s"), (3, "a"), (4, "b"), (5, "w")], "x, object"))
def cat_change_order(t):
    """Drops in reverse order of kind, then the rest in order of kind."""
    d = diff.tree_diff(_loaded(t, OLD_SCRIPT), _loaded(t, NEW_SCRIPT), parent="parent")
    kinds = F.array(*[F.lit(k) for k in sql_text.KINDS])
    rows = diff.change_order(d, F.array_position(kinds, F.col("kind"))).select("object").collect()
    return _frame(t, [(i, r["object"]) for i, r in enumerate(rows)], "x int, object string")


@_r.query("SELECT n_regionkey AS parent, count(*) AS n FROM nation GROUP BY n_regionkey")
def cat_descendant_counts(t):
    return t.nation.groupBy(F.col("n_regionkey").alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@_r.query("SELECT * FROM " + values([("v", "b"), ("w", "v")], "object, needs"))
def cat_selection_extender(t):
    """What a selection needs besides itself, if it really changed."""
    e = _frame(t, [("w", "v"), ("v", "b"), ("v", "a")], "src string, dst string")
    changed = _frame(t, [("v",), ("b",)], "node string")
    closure = graphs.reachable(e, _frame(t, [("w",)], "node string")).join(changed, "node", "left_semi").where("depth > 0").select("node")
    return e.join(closure, F.col("dst") == F.col("node")).select(F.col("src").alias("object"), F.col("dst").alias("needs"))


@_r.query("SELECT * FROM " + values([("n_nationkey", "int"), ("n_name", "string"), ("region", "string")], "name, type"))
def cat_view_typing(t):
    """Columns of a view over a view, typed on demand."""
    t.nation.createOrReplaceTempView("nation")
    t.region.createOrReplaceTempView("region")
    t.spark.sql("CREATE OR REPLACE TEMP VIEW tess_v1 AS SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    t.spark.sql("CREATE OR REPLACE TEMP VIEW tess_v2 AS SELECT n_nationkey, n_name, upper(r_name) AS region FROM tess_v1")
    return _frame(t, t.spark.table("tess_v2").dtypes, "name string, type string")


@_r.query("SELECT unnest(['customer', 'nation']) AS relation")
def cat_lineage(t):
    """Tables that a query reads, from its analysed plan."""
    t.customer.createOrReplaceTempView("customer")
    t.nation.createOrReplaceTempView("nation")
    plan = t.spark.sql("SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")._jdf.queryExecution().analyzed().toString()
    import re

    found = sorted({m.lower() for m in re.findall(r"SubqueryAlias (\w+)", plan)})
    return _frame(t, [(x,) for x in found], "relation string")
