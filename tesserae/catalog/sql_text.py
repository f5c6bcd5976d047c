"""SQL text as data: tokens, statements, definitions, columns, references and dangers, in plain Python for one script at a time and as rows over many files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<string>[NnEeBbXx]?'(?:[^']|'')*')"""
    r"""|(?P<quoted>"(?:[^"]|"")*"|\[[^\]\n]*\]|`[^`\n]*`)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op>::|<>|!=|<=|>=|->>?|\|\||.)""",
    re.S,
)
#: Object kinds in the order in which they are deployed.
KINDS = (
    "DATABASE", "CAST", "USER", "ROLE", "ASSEMBLY", "SCHEMA", "EXTENSION", "EVENT TRIGGER", "FOREIGN DATA WRAPPER", "SERVER", "USER MAPPING", "COLLATION", "TYPE", "DOMAIN",
    "SEQUENCE", "OPERATOR", "TEXT SEARCH PARSER", "TEXT SEARCH TEMPLATE", "TEXT SEARCH DICTIONARY", "TEXT SEARCH CONFIGURATION", "TABLE", "DICTIONARY", "COLUMN", "FUNCTION",
    "PROCEDURE", "AGGREGATE", "INDEX", "CONSTRAINT", "VIEW", "STATISTICS", "TRIGGER", "RULE", "POLICY",
)
KIND_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Words after which a table or view is named.
_FROM = {"FROM", "JOIN", "INTO", "UPDATE", "USING", "TABLE", "ONLY", "REFERENCES"}
_STOP = {"SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "ON", "SET", "VALUES", "LATERAL", "IF", "NOT", "EXISTS", "WITH", "AS", "BY", "CASCADE"}
#: Statements that lose data or block a table.
DANGERS = ("ALTER COLUMN", "DROP COLUMN", "DROP TABLE", "RESTART WITH", "UPDATE")


@dataclass
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        """An identifier without its quotes; unquoted ones in lower case."""
        if self.kind == "quoted":
            return self.text[1:-1].replace(self.text[-1] * 2, self.text[-1])
        return self.text.lower()


def tokens(sql: str) -> list[Token]:
    """All tokens but white space and comments."""
    return [Token(m.lastgroup if m.lastgroup != "tag" else "dollar", m.group(), m.start()) for m in TOKEN.finditer(sql) if m.lastgroup not in ("space", "comment")]


def statements(sql: str, delimiter: str | None = None) -> list[tuple[int, str]]:
    """(offset, statement) of a script. Statements end at semicolons outside strings, dollar quotes, comments and BEGIN ATOMIC bodies; with a delimiter (as GO) they are batches between lines that hold nothing else."""
    if delimiter:
        out, at = [], 0
        for m in [*re.finditer(rf"(?im)^[ \t]*{re.escape(delimiter)}[ \t]*$", sql), None]:
            end = m.start() if m else len(sql)
            if (part := sql[at:end]).strip():
                out.append((at + len(part) - len(part.lstrip()), part.strip()))
            at = m.end() if m else end
        return out
    out, start, depth, last = [], None, 0, None
    for t in tokens(sql):
        if start is None:
            start = t.at
        if t.upper == "ATOMIC" and last == "BEGIN":
            depth += 1
        elif depth and t.upper == "CASE":
            depth += 1
        elif depth and t.upper == "END":
            depth -= 1
        if t.text == ";" and t.kind == "op" and not depth:
            if part := sql[start : t.at].strip():
                out.append((start, part))
            start = None
        last = t.upper
    if start is not None and (part := sql[start:].strip()):
        out.append((start, part))
    return out


def qualified(ts: list[Token], i: int) -> tuple[list[str], int]:
    """The dotted name at i and where it ends."""
    parts = []
    while i < len(ts) and ts[i].kind in ("word", "quoted"):
        parts.append(ts[i].name)
        if i + 1 < len(ts) and ts[i + 1].text == "." and i + 2 < len(ts) and ts[i + 2].kind in ("word", "quoted"):
            i += 2
        else:
            return parts, i + 1
    return parts, i


def closing(ts: list[Token], i: int) -> int:
    """The parenthesis that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j].text == "(") - (ts[j].text == ")")
        if not depth:
            return j
    return len(ts) - 1


@dataclass
class Parsed:
    """What one statement says."""

    action: str
    kind: str
    schema: str | None = None
    name: str | None = None
    sub: str | None = None
    columns: list[tuple[str, str, bool, str | None]] = field(default_factory=list)
    references: list[tuple[str, str, int]] = field(default_factory=list)
    dangers: list[str] = field(default_factory=list)


def columns_of(ts: list[Token], sql: str, open_at: int) -> list[tuple[str, str, bool, str | None]]:
    """(name, type, nullable, default) of a table's definition list."""
    end, out, at = closing(ts, open_at), [], open_at + 1
    while at < end:
        stop, depth = at, 0
        while stop < end and not (ts[stop].text == "," and not depth):
            depth += (ts[stop].text in "([") - (ts[stop].text in ")]") if ts[stop].kind == "op" else 0
            stop += 1
        part = ts[at:stop]
        if len(part) > 1 and part[0].upper not in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE", "INDEX", "LIKE", "PROJECTION"):
            upper = [t.upper for t in part]
            ends = [k for k, u in enumerate(upper) if k and u in ("NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "COLLATE", "CONSTRAINT", "GENERATED", "IDENTITY", "CODEC", "COMMENT", "TTL", "MATERIALIZED", "ALIAS", "EPHEMERAL")]
            stop_type = ends[0] if ends else len(part)
            kind = " ".join(sql[part[1].at : part[stop_type - 1].at + len(part[stop_type - 1].text)].lower().split()) if stop_type > 1 else ""
            nullable = not any(a == "NOT" and b == "NULL" for a, b in zip(upper, upper[1:])) and "PRIMARY" not in upper
            default = None
            if "DEFAULT" in upper:
                d = upper.index("DEFAULT") + 1
                after = [k for k in ends if k > d] or [len(part)]
                default = sql[part[d].at : part[after[0] - 1].at + len(part[after[0] - 1].text)] if d < len(part) else None
            out.append((part[0].name, kind, nullable, default))
        at = stop + 1
    return out


def relations(ts: list[Token]) -> list[tuple[str, str, int]]:
    """(schema, name, offset) of the tables and views that a statement names, CTEs and functions left out."""
    ctes = {ts[i - 1].name for i in range(1, len(ts) - 1) if ts[i].upper == "AS" and ts[i + 1].text == "(" and ts[i - 1].kind in ("word", "quoted") and (ts[i - 2].upper in ("WITH", "RECURSIVE") or ts[i - 2].text == "," or ts[i - 1].text == ")")} if any(t.upper == "WITH" for t in ts) else set()
    out = []
    for i, t in enumerate(ts):
        if t.kind == "string" and [x.upper for x in ts[i + 1 : i + 3]] in (["::", "REGCLASS"], ["::", "REGTYPE"], ["::", "REGPROC"]):  # a name given as text
            names, _ = qualified(tokens(t.text.strip("'")), 0)
            if names:
                out.append((names[-2] if len(names) > 1 else "public", names[-1], t.at))
        listed = t.text == "," and t.kind == "op" and out and _in_from_list(ts, i)
        if t.upper in _FROM and t.kind == "word" or listed:
            j = i + 1
            while j < len(ts) and ts[j].upper in ("ONLY", "LATERAL", "IF", "NOT", "EXISTS", "TABLE"):
                j += 1
            names, end = qualified(ts, j)
            if not names or ts[j].kind == "word" and ts[j].upper in _STOP:
                continue
            if end < len(ts) and ts[end].text == "(" and t.upper in ("FROM", "JOIN", "USING"):
                continue
            if len(names) == 1 and names[0] in ctes:
                continue
            out.append((names[-2] if len(names) > 1 else "public", names[-1], ts[j].at))
    return out


def _in_from_list(ts: list[Token], i: int) -> bool:
    """Whether the comma at i separates tables of a FROM clause."""
    depth = 0
    for j in range(i - 1, -1, -1):
        u = ts[j].upper
        depth += (ts[j].text == ")") - (ts[j].text == "(") if ts[j].kind == "op" else 0
        if depth < 0:
            return False
        if not depth and ts[j].kind == "word":
            if u == "FROM":
                return True
            if u in ("SELECT", "WHERE", "GROUP", "ORDER", "SET", "BY", "VALUES", "INTO", "TABLE"):
                return False
    return False


def dangers_of(ts: list[Token]) -> list[str]:
    """Which dangers a statement holds, of DANGERS."""
    up = [t.upper for t in ts if t.kind == "word"]
    found = set()
    if up[:2] == ["DROP", "TABLE"] or up[:3] == ["DROP", "FOREIGN", "TABLE"]:
        found.add("DROP TABLE")
    if up[:2] == ["ALTER", "TABLE"] or up[:3] == ["ALTER", "FOREIGN", "TABLE"]:
        pairs = set(zip(up, up[1:]))
        if ("DROP", "COLUMN") in pairs:
            found.add("DROP COLUMN")
        if ("ALTER", "COLUMN") in pairs and "TYPE" in up:
            found.add("ALTER COLUMN")
    if up[:2] == ["ALTER", "SEQUENCE"] and ("RESTART", "WITH") in set(zip(up, up[1:])):
        found.add("RESTART WITH")
    if up[:1] == ["UPDATE"]:
        found.add("UPDATE")
    return sorted(found)


def parse(sql: str, bodies: bool = True) -> Parsed:
    """One statement. bodies: whether what a function's or procedure's body names counts as its references."""
    ts = tokens(sql)
    up = [t.upper for t in ts]
    action = up[0] if up else ""
    if action in ("CREATE", "ALTER", "DROP", "COMMENT", "TRUNCATE"):
        i = 1
        while i < len(ts) and up[i] in ("OR", "REPLACE", "UNIQUE", "TEMP", "TEMPORARY", "UNLOGGED", "MATERIALIZED", "EXTERNAL", "FOREIGN", "RECURSIVE", "CLUSTERED", "NONCLUSTERED", "ON", "CONCURRENTLY"):
            if up[i] == "FOREIGN" and up[i + 1 : i + 2] == ["DATA"]:
                break
            i += 1
        kind = next((k for k in sorted(KINDS, key=len, reverse=True) if up[i : i + len(k.split())] == k.split()), up[i] if i < len(up) else "")
        i += len(kind.split())
        while i < len(ts) and up[i] in ("IF", "NOT", "EXISTS", "ONLY", "CONCURRENTLY"):
            i += 1
        names, end = qualified(ts, i)
        out = Parsed(action, kind, dangers=dangers_of(ts))
        if kind == "SCHEMA":
            out.schema = out.name = names[-1] if names else None
        elif names:
            out.schema, out.name = (names[-2] if len(names) > 1 else "public"), names[-1]
        if kind in ("INDEX", "TRIGGER", "RULE", "POLICY") and "ON" in up[end:]:
            on, _ = qualified(ts, end + up[end:].index("ON") + 1)
            if on:
                out.sub, out.schema, out.name = out.name, (on[-2] if len(on) > 1 else "public"), on[-1]
        if action == "CREATE" and kind == "TABLE" and end < len(ts) and ts[end].text == "(":
            out.columns = columns_of(ts, sql, end)
        if kind == "FUNCTION" and end < len(ts) and ts[end].text == "(":
            out.name += sql[ts[end].at : ts[closing(ts, end)].at + 1].lower()
        own = (out.schema, out.name)
        out.references = [r for r in relations(ts) if r[:2] != own]
        if kind in ("FUNCTION", "PROCEDURE") and bodies:
            for t in ts:
                if t.kind in ("dollar", "string"):
                    body = t.text.split("$", 2)[-1].rsplit("$", 2)[0] if t.kind == "dollar" else t.text.strip("'")
                    out.references += [(s, n, t.at) for s, n, _ in relations(tokens(body))]
                    out.references += [(s, n, t.at) for s, n in calls(tokens(body))]
        return out
    return Parsed(action, "QUERY" if action in ("SELECT", "WITH", "VALUES", "TABLE") else action, references=relations(ts), dangers=dangers_of(ts))


def calls(ts: list[Token]) -> list[tuple[str, str]]:
    """Qualified functions that are called, as schema and name with empty brackets."""
    return [(ts[i].name, f"{ts[i + 2].name}()") for i in range(len(ts) - 3) if ts[i].kind in ("word", "quoted") and ts[i + 1].text == "." and ts[i + 2].kind in ("word", "quoted") and ts[i + 3].text == "("]


OBJECTS = "file string, seq int, at bigint, line int, action string, kind string, kind_ord int, schema string, object string, sub string, columns array<struct<name: string, type: string, nullable: boolean, default: string>>, refs array<struct<schema: string, object: string, at: bigint>>, dangers array<string>, ddl string"


def parsed_scripts(scripts: DataFrame, delimiter: str | None = None) -> DataFrame:
    """A row for each statement of each script. scripts: file, sql; a null script has no statements."""
    schema = to_arrow_schema(_parse_datatype_string(OBJECTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, sql in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seq, (at, text) in enumerate(statements(sql or "", delimiter)):
                    p = parse(text)
                    rows.append({"file": file, "seq": seq, "at": at, "line": (sql or "").count("\n", 0, at) + 1, "action": p.action, "kind": p.kind, "kind_ord": KIND_ORDER.get(p.kind), "schema": p.schema, "object": p.name, "sub": p.sub, "columns": [dict(zip(("name", "type", "nullable", "default"), c, strict=True)) for c in p.columns], "refs": [{"schema": s, "object": n, "at": at + o} for s, n, o in p.references], "dangers": p.dangers, "ddl": text})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scripts.select("file", "sql").mapInArrow(run, OBJECTS)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """file and sql of each .sql file under a path, folders included; Spark reads, so any store will do."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql", recursiveFileLookup=True)
    return rows.selectExpr("_metadata.file_path AS file", "value AS sql")
