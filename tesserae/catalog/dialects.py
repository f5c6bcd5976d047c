"""Queries of the three dialects as Spark SQL: quoting, literals, function names, and the clauses that Spark lacks as subqueries over windows.

Works on tokens. Clauses are rewritten in the statement's outermost SELECT; inside subqueries only quoting, literals and names change.
"""

from __future__ import annotations

import re

from tesserae.catalog.sql_text import Token, closing, tokens

#: Functions that Spark has under another name, by dialect.
NAMES = {
    "pg": {"array_to_string": "array_join", "string_to_array": "split", "strpos": "instr", "btrim": "trim", "to_hex": "hex", "regexp_split_to_array": "split", "clock_timestamp": "current_timestamp", "string_agg": "listagg", "unnest": "explode"},
    "ms": {"isnull": "coalesce", "getdate": "current_timestamp", "sysdatetime": "current_timestamp", "len": "length", "datalength": "octet_length", "charindex": "locate", "replicate": "repeat", "newid": "uuid", "stdev": "stddev", "var": "variance", "string_agg": "listagg", "iif": "if"},
    "ch": {"tostring": "string", "todate": "to_date", "todatetime": "to_timestamp", "grouparray": "collect_list", "groupuniqarray": "collect_set", "argmax": "max_by", "argmin": "min_by", "any": "any_value", "countif": "count_if", "arrayjoin": "explode", "has": "array_contains", "toyear": "year", "tomonth": "month"},
}
_CLAUSES = ("WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "EXCEPT", "INTERSECT")


def spelled(t: Token, dialect: str, call: bool) -> str:
    """One token in Spark's spelling."""
    if t.kind == "quoted":
        return "`" + t.name.replace("`", "``") + "`"
    if t.kind == "string":
        m = re.match(r"([NnEeBbXx]?)'", t.text)
        if m[1].upper() == "N":
            return t.text[1:]
        if m[1].upper() == "E":
            return t.text[1:].replace("''", "\\'")
        return t.text
    if t.kind == "dollar":
        body = t.text.split("$", 2)[-1].rsplit("$", 2)[0]
        return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if t.kind == "word" and call:
        return NAMES[dialect].get(t.text.lower(), t.text)
    return t.text


def joined(ts: list[Token], dialect: str) -> str:
    """Tokens as text again, spaced as SQL needs."""
    out = []
    for i, t in enumerate(ts):
        call = i + 1 < len(ts) and ts[i + 1].text == "(" and not (i and ts[i - 1].text == ".")
        part = spelled(t, dialect, call)
        tight = not out or part in (",", ")", ".", "]", "::") or ts[i - 1].text in ("(", ".", "[", "::") or (part == "(" and ts[i - 1].kind == "word" and ts[i - 1].upper not in _KEYWORDS) or part == "["
        out.append(part if tight else " " + part)
    return "".join(out)


_KEYWORDS = {"IN", "AND", "OR", "NOT", "AS", "ON", "USING", "VALUES", "FROM", "WHERE", "SELECT", "OVER", "BY", "EXISTS", "WHEN", "THEN", "ELSE", "UNION", "ALL", "EXCEPT", "INTERSECT", "JOIN", "FILTER", "HAVING", "QUALIFY", "ANY", "SOME", "DISTINCT", "GROUP", "LATERAL"}


def clauses(ts: list[Token]) -> dict[str, list[Token]]:
    """The outermost SELECT's clauses: SELECT (with its list), FROM and those after it, each without its first word."""
    out: dict[str, list[Token]] = {}
    name, depth, at, i = "SELECT", 0, [], 1
    while i < len(ts):
        t = ts[i]
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" and len(t.text) == 1 else 0
        if not depth and t.kind == "word" and (t.upper in _CLAUSES or t.upper == "FROM" and name == "SELECT"):
            out[name], name, at = at, t.upper, []
        else:
            at.append(t)
        i += 1
    out[name] = at
    return out


def outputs(select: list[Token]) -> list[list[Token]]:
    """The expressions of a select list."""
    out, depth, at = [], 0, []
    for t in select:
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" and len(t.text) == 1 else 0
        if t.text == "," and not depth:
            out.append(at)
            at = []
        else:
            at.append(t)
    return [*out, at] if at else out


def names_of(select: list[Token], dialect: str) -> list[str]:
    """What a select list's columns are called; * stays."""
    out = []
    for e in outputs(select):
        if len(e) == 1 and e[0].text == "*":
            return ["*"]
        if not e or e[-1].kind not in ("word", "quoted"):
            raise ValueError("an expression without a name needs one")
        out.append(spelled(e[-1], dialect, False))
    return out


#: Hints of a table, and what a row lock may ask for.
TABLE_HINTS = "NOLOCK READUNCOMMITTED READCOMMITTED READCOMMITTEDLOCK REPEATABLEREAD SERIALIZABLE HOLDLOCK READPAST ROWLOCK PAGLOCK TABLOCK TABLOCKX UPDLOCK XLOCK NOWAIT NOEXPAND FORCESEEK FORCESCAN INDEX SNAPSHOT KEEPIDENTITY KEEPDEFAULTS".split()
LOCKS = ("UPDATE", "SHARE", "NO", "KEY")


def without_locks(ts: list[Token], dialect: str) -> list[Token]:
    """Tokens without what only asks for locks or access paths: WITH (hint, ...) after a table (ms), and FOR UPDATE and the like with OF, NOWAIT and SKIP LOCKED (pg). A result does not depend on either."""
    out, i = [], 0
    while i < len(ts):
        up = [t.upper if t.kind == "word" else t.text for t in ts[i : i + 3]]
        if dialect == "ms" and up[:2] == ["WITH", "("] and len(up) == 3 and up[2] in TABLE_HINTS:
            i = closing(ts, i + 1) + 1
        elif dialect == "pg" and up[:1] == ["FOR"] and len(up) > 1 and up[1] in LOCKS:
            i += 1
            while i < len(ts) and ts[i].kind == "word" and ts[i].upper in (*LOCKS, "OF", "NOWAIT", "SKIP", "LOCKED"):
                i += 1
                if ts[i - 1].upper == "OF":
                    i += 1
                    while i + 1 < len(ts) and ts[i].text in (",", "."):
                        i += 2
        else:
            out.append(ts[i])
            i += 1
    return out


def to_spark(sql: str, dialect: str = "pg") -> str:
    """A SELECT of a dialect (pg, ms, ch) as Spark SQL. QUALIFY, DISTINCT ON, TOP n, LIMIT n BY and FETCH ... WITH TIES become filters on windows."""
    ts = without_locks(tokens(sql.strip().rstrip(";")), dialect)
    if not ts or ts[0].upper != "SELECT" or {"UNION", "EXCEPT", "INTERSECT"} & set(clauses(ts)):
        return joined(ts, dialect)
    c = clauses(ts)
    select, text = c["SELECT"], lambda part: joined(part, dialect)
    order = c.get("ORDER", [])[1:]
    limit = text(c["LIMIT"]) if "LIMIT" in c else None
    window, keep = None, None
    distinct = ""
    up = [t.upper for t in select]
    if up[:1] == ["TOP"]:
        bracket = select[1].text == "("
        end = closing(select, 1) + 1 if bracket else 2
        limit, select = text(select[2 : end - 1] if bracket else select[1:2]), select[end:]
        if [t.upper for t in select[:2]] == ["WITH", "TIES"]:
            select, window, keep, limit = select[2:], f"rank() OVER (ORDER BY {text(order)})", f"<= {limit}", None
    elif up[:2] == ["DISTINCT", "ON"]:
        end = closing(select, 2)
        window, keep, select = f"row_number() OVER (PARTITION BY {text(select[3:end])} ORDER BY {text(order) or text(select[3:end])})", "= 1", select[end + 1 :]
    elif up[:1] == ["DISTINCT"]:
        distinct, select = "DISTINCT ", select[1:]
    if "FETCH" in c:
        words = [t.upper for t in c["FETCH"]]
        n = next((t.text for t in c["FETCH"] if t.kind == "number"), "1")
        if words[-2:] == ["WITH", "TIES"]:
            window, keep = f"rank() OVER (ORDER BY {text(order)})", f"<= {n}"
        else:
            limit = n
    if "LIMIT" in c and "BY" in [t.upper for t in c["LIMIT"]]:
        at = [t.upper for t in c["LIMIT"]].index("BY")
        n = [text([t]) for t in c["LIMIT"][:at] if t.kind == "number"]
        keys, limit = text(c["LIMIT"][at + 1 :]), None
        low, most = (int(n[0]), int(n[1])) if len(n) > 1 else (0, int(n[0]))
        window, keep = f"row_number() OVER (PARTITION BY {keys} ORDER BY {text(order) or keys})", f"BETWEEN {low + 1} AND {low + most}"
    qualify = text(c["QUALIFY"]) if "QUALIFY" in c else None
    body = f"SELECT {distinct}{text(select)}"
    extra = f", {window} AS _w" if window else f", {qualify} AS _w" if qualify else ""
    rest = ""
    for name, words in (("FROM", "FROM"), ("WHERE", "WHERE"), ("GROUP", "GROUP"), ("HAVING", "HAVING"), ("WINDOW", "WINDOW")):
        if name in c:
            rest += f" {words} {text(c[name])}"
    if extra:
        cols = names_of(select, dialect)
        listed = "* EXCEPT (_w)" if cols == ["*"] else ", ".join(cols)
        out = f"SELECT {listed} FROM ({body}{extra}{rest}) WHERE _w{' ' + keep if keep else ''}"
    else:
        out = body + rest
        out += f" ORDER BY {text(order)}" if order else ""
    if limit:
        out += f" LIMIT {limit}"
    if "OFFSET" in c:
        out += f" OFFSET {next(t.text for t in c['OFFSET'] if t.kind == 'number')}"
    return out
