from __future__ import annotations

import random
import re
import time

from tesserae.llm import url_cascade as uc

SCHEMA = "page_id bigint, url string, html string, host int, rule string"


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h + p), len(h)) > (len(best[0] + best[1]), len(best[0])):
                best = (h, p, v)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_many_rules_as_by_brute_force(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "bb", "ccc", "net", "org"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["x", "yy", "en"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(150))}.values())
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + host().upper() + path() + rng.choice(["", "?q=/en", "#f", "/tail"]) for _ in range(1500)]
    rows = [(i, u, "", 0, "") for i, u in enumerate(urls)]
    got = {r["page_id"]: tuple(r)[1:] for r in uc.judge(spark.createDataFrame(rows, SCHEMA).repartition(3), rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 200


def test_cascade_has_several_levels_and_is_exact(spark):
    listed = spark.range(300).selectExpr("concat('k', id) key")
    universe = spark.range(60000).selectExpr("concat('k', id) key")
    cascade = uc.build(listed, universe)
    assert len(cascade.levels) > 1
    assert sum(64 * len(x.words) for x in cascade.levels) < 60 * 300
    from pyspark.sql import functions as F

    assert {r["key"] for r in universe.where(cascade.has(F.col("key"))).collect()} == {f"k{i}" for i in range(300)}


def test_nulls_repeats_and_empty_tables(spark):
    rules = [("net", "/", "block")]
    rows = [(1, None, None, None, None), (2, "no scheme", None, None, None), (3, "http://a.NET/", None, None, None), (3, "http://a.NET/", None, None, None), (None, "http://net/x", None, None, None), (4, "http://net", None, None, None), (5, "://" + "n" * 50000 + ".net/", None, None, None)]
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in uc.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()), key=repr)
    assert got == sorted([(1, None, "allow"), (2, None, "allow"), (3, "net/", "block"), (3, "net/", "block"), (None, "net/", "block"), (4, None, "allow"), (5, "net/", "block")], key=repr)
    assert uc.judge(spark.createDataFrame([], SCHEMA), rules).collect() == []
    assert {r["verdict"] for r in uc.judge(spark.createDataFrame(rows, SCHEMA), []).collect()} == {"allow"}


def test_hosts_of_many_labels(spark):
    """A megabyte of labels costs no more than its length."""
    rules = [("net", "/", "block"), ("b.a.net", "/x/", "allow")]
    rows = [(1, "http://" + "a." * 500_000 + "net/", None, None, None), (2, "http://" + "b." * 500_000 + "a.net/x/y", None, None, None), (3, "http://" + "." * 500_000, None, None, None)]
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uc.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got == {1: ("net/", "block"), 2: ("b.a.net/x/", "allow"), 3: (None, "allow")}
    assert time.time() - began < 30
