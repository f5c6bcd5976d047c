"""URL rules by a cascade of Bloom filters.

Level 0 holds the listed keys; level 1 those keys of the corpus that pass level 0 without being listed; level 2 the listed keys that pass level 1; and so on until nothing passes wrongly. Over the keys of the corpus it was built for, membership is then exact and needs no join: the judging pass is a projection over the pages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ascii_lower, dropped, saved

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Level:
    """One filter: 64-bit words, and the number of probes."""

    words: tuple[int, ...]
    probes: int

    def passes(self, key: Column, salt: int) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        bits = [bit(key, salt, i, 64 * len(self.words)) for i in range(self.probes)]
        hit = lambda b: F.element_at(words, (F.floor(b / 64) + 1).cast("int")).bitwiseAND(one(b)) != 0
        out = hit(bits[0])
        for b in bits[1:]:
            out = out & hit(b)
        return out


def bit(key: Column, salt: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(probe)), F.lit(bits).cast("bigint"))


def one(b: Column) -> Column:
    """The mask of a bit within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)).cast("int"))


def filled(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter of n keys, column key, with about this rate of false positives; only its words come to the driver, and they depend on n alone."""
    probes = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * probes / math.log(2) / 64))
    at = F.explode(F.array(*[bit(F.col("key"), salt, i, 64 * words) for i in range(probes)]))
    got = keys.select(at.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(one(F.col("b"))).alias("x")).collect()
    out = [0] * words
    for row in got:
        out[row["w"]] = row["x"]
    return Level(tuple(out), probes)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    salt: int = 0

    def has(self, key: Column) -> Column:
        """Whether a key of the corpus is listed. One that fails an even level isn't, one that fails an odd level is."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key, self.salt + i), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build(listed: DataFrame, universe: DataFrame, salt: int = 0) -> Cascade:
    """listed: distinct keys in column key; universe: all keys of the corpus, repeats allowed. It is read once a level at most.

    Level 0 lets so few through that level 1 is no larger than the list; all filters together take a number of bits near the list's length times the logarithm of universe over list, which a broadcast can carry. The false positives themselves stay distributed.
    """
    n = listed.count()
    if not n:
        return Cascade((), salt)
    total = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels = [filled(listed, n, min(0.5, 0.7 * n / total), salt)]
    wrong = saved(universe.where(levels[0].passes(F.col("key"), salt)).distinct().join(listed, "key", "left_anti"), "cascade")
    sides, first = [wrong, listed], wrong  # of each, what has passed all levels so far
    while (n := sides[0].count()) > 0:
        i = len(levels)
        levels.append(filled(sides[0], n, 0.5 if i > 1 else 0.25, salt + i))
        sides = [sides[1].where(levels[-1].passes(F.col("key"), salt + i)), sides[0]]
    dropped(first)
    return Cascade(tuple(levels), salt)


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty for a null or a text without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every key that a rule fitting this URL can have: the last labels of the host, as many as some rule's host has, with the path cut to each length that a rule's path has; longest first, and of equal ones that with more host. The keys of a URL are no more than the rules have lengths, however long it is."""
    hosts = F.array(*[F.substring_index(host, ".", -n) for n in labels])
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    every = F.flatten(F.transform(hosts, lambda h: F.transform(cuts, lambda n: F.struct(F.length(h) + n, F.length(h), F.concat(h, F.substr(path, F.lit(1), n))))))
    return F.transform(F.reverse(F.array_sort(F.array_distinct(every))), lambda s: s.getField("col3"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Judge pages (page_id, url) by rules (host, path, verdict).

    A rule fits its host and all subdomains where the URL's path starts with the rule's; the longest fitting rule wins. Returns page_id, host, path, rule, verdict, one row for each row of pages: a null page_id is carried through, repeated rows stay, other columns are ignored, and a URL that no rule fits (null and malformed ones too) has rule null and the default verdict. Of rules given twice the first counts. A URL costs time in proportion to its length.
    """
    spark = pages.sparkSession
    known: dict[str, str] = {}
    for h, p, verdict in rules:
        known.setdefault(h + p, verdict)
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}) or [1]
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = saved(rows.select(F.explode("keys").alias("key")).distinct(), "keys")
    verdicts = sorted(set(known.values()))
    lists = {v: spark.createDataFrame([(k,) for k, x in known.items() if x == v], "key string") for v in verdicts}
    cascades = {v: build(lists[v], universe, 1000 * i) for i, v in enumerate(verdicts)}
    dropped(universe)

    def verdict_of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v in verdicts:
            out = F.when(cascades[v].has(key), F.lit(v)).otherwise(out)
        return out

    found = F.get(F.filter(F.transform(F.col("keys"), lambda k: F.struct(k.alias("rule"), verdict_of(k).alias("verdict"))), lambda s: s["verdict"].isNotNull()), F.lit(0))
    return rows.withColumn("hit", found).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
