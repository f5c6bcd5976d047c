from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.catalog import actions, rules, sql_text
from tesserae.sources import readers


def test_rule_files():
    assert rules.parse_rules("") == (True, [])
    show_all, found = rules.parse_rules('HIDE ALL\n\nSHOW REGEX, QUALIFIED "a""b" db=\'x\' type=TABLE, VIEW # why\nSHOW NONE c\n')
    assert not show_all
    assert found[0] == rules.Rule('a"b', True, True, False, True, "x", frozenset({"TABLE", "VIEW"}))
    assert found[1] == rules.Rule("c", True)
    for bad in ("SHOW NONE a", "SHOW ALL\nSHOW NONE a", "SHOW ALL\nHIDE a", "SHOW ALL\nHIDE NONE a b"):
        with pytest.raises(ValueError):
            rules.parse_rules(bad)


def test_rules_that_match_alike_are_merged():
    hide, wide = rules.Rule("a", False), rules.Rule("a", True, content=True)
    assert rules.added([rules.Rule("a", True)], hide) == [hide]
    assert rules.added([hide], rules.Rule("a", True)) == [hide]
    assert rules.added([hide], wide) == [wide]
    assert rules.added([wide], hide) == [wide]
    assert rules.added([hide], rules.Rule("a", False, db="x")) == [hide, rules.Rule("a", False, db="x")]


def test_dependency_files():
    with pytest.raises(ValueError):
        rules.parse_dependencies("view a.b -> ;")
    assert rules.parse_dependencies("") == []
    assert rules.parse_dependencies("materialized view a . b -> foreign data wrapper w;") == [(("MATERIALIZED VIEW", "a.b"), ("FOREIGN DATA WRAPPER", "w"))]


WORD = st.sampled_from(["SELECT", "a", "';'", "$$;$$", "-- ;\n", "/*;*/", '"x;"', "1", ",", "(", ")", "[c;]", "`d;`"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORD, min_size=1, max_size=6), min_size=1, max_size=5))
def test_statements_split_at_real_semicolons_only(parts):
    texts = [" ".join(["q", *p]) for p in parts]
    found = sql_text.statements(" ;\n".join(texts) + ";")
    assert len(found) == len(texts)
    joined = " ;\n".join(texts) + ";"
    for (at, text), want in zip(found, texts, strict=True):
        assert joined[at:].startswith(text) and want.startswith(text[: len(want)].rstrip()[:1])


def test_atomic_bodies_are_one_statement():
    text = "CREATE FUNCTION f() BEGIN ATOMIC SELECT CASE WHEN a THEN 1 END; SELECT 2; END; SELECT 3"
    assert [s for _, s in sql_text.statements(text)] == [text[: text.index("; SELECT 3")], "SELECT 3"]


def test_columns_and_keys():
    p = sql_text.parse("CREATE TABLE IF NOT EXISTS \"S\".t (a int PRIMARY KEY, b numeric(10, 2) NOT NULL DEFAULT (1 + 2), c text COLLATE \"C\" DEFAULT 'x, y', UNIQUE (a, b), FOREIGN KEY (a) REFERENCES q.r (z))")
    assert (p.schema, p.name) == ("S", "t")
    assert p.columns == [("a", "int", False, None), ("b", "numeric(10, 2)", False, "(1 + 2)"), ("c", "text", True, "'x, y'")]
    assert [r[:2] for r in p.references] == [("q", "r")]


def test_dangers():
    assert sql_text.parse("ALTER TABLE a ALTER COLUMN b TYPE int, DROP COLUMN c").dangers == ["ALTER COLUMN", "DROP COLUMN"]
    assert sql_text.parse("ALTER TABLE a ALTER COLUMN b SET DEFAULT 1").dangers == []
    assert sql_text.parse("INSERT INTO a VALUES ('UPDATE x')").dangers == []


def test_actions_with_a_cycle_end():
    steps = actions.resolve([actions.Change("f", "BOTH", "RECREATE")], [("f", "g"), ("g", "f")], [("f", "g"), ("g", "f")], {"f", "g"})
    assert sorted(steps) == [("CREATE", "f"), ("CREATE", "g"), ("DROP", "f"), ("DROP", "g")]
    assert [a for a, _ in steps] == ["DROP", "DROP", "CREATE", "CREATE"]


def test_library_sources():
    assert readers.library_kind("C:/x.sql") == "local" and readers.library_kind("file:///x") == "url"
