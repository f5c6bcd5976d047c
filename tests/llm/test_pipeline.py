from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
from tesserae.llm import mixing, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(8)


def corpus() -> tuple[list[tuple], list[tuple]]:
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(240):
        lines = [" ".join(word() for _ in range(rng.randint(8, 14))) + "." for _ in range(rng.randint(1, 7))]
        bad = i % 6 == 0
        if bad:
            lines = [f"{x} {rng.choice(['zzrot', 'zzvile', 'zzmuck'])} {word()}" for x in lines]
        if i % 10 == 1 and i > 20:
            lines = docs[i - 20][1].split("\n")[:3] + lines
        text = "\n".join(lines)
        if i % 15 == 2 and i > 30:
            text = docs[i - 30][1]
        if i % 15 == 4:
            text = " ".join(word() for _ in range(60))
        if i % 15 == 5 and i > 5:
            text = docs[i - 1][1] + " tail"
        docs.append((i, text, "en", f"s{i % 3}" if i % 9 else None, len(text)))
        labels.append((i, 1, int("zz" in text)))
    docs += [(1010, "one line that repeats as a whole row", "en", "s1", 36)] * 3 + [(None, "a line without any number", "en", "s2", 25)] * 2
    docs += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, "", "en", "s0", 0)]
    return docs, labels


def by_windows(docs: list[tuple]) -> dict[int, str]:
    seen: dict[tuple, tuple] = {}
    places = []
    for i, text, *_ in sorted(docs):
        at = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((text or "").split("\n"))]
        at = [(k, x) for k, x in at if x]
        for p in range(len(at) - 2):
            win = tuple(x for _, x in at[p : p + 3])
            places.append((i, [k for k, _ in at[p : p + 3]], seen.setdefault(win, (i, p)) != (i, p)))
    gone: dict[int, set] = {}
    for i, ks, later in places:
        if later:
            gone.setdefault(i, set()).update(ks)
    out = {}
    for i, text, *_ in docs:
        lines = (text or "").split("\n")
        if i in gone:
            left = [x for k, x in enumerate(lines) if k not in gone[i]]
            if not any(x.strip() for x in left):
                continue
            out[i] = "\n".join(left)
        else:
            out[i] = text
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
        results.append(now.collect())
    assert [Counter(r["doc_id"] for r in results[k])[None] for k in range(3)] == [2, 2, 2]
    assert [Counter(r["doc_id"] for r in results[k])[1010] for k in range(3)] == [3, 3, 1]
    nameless = [r for r in results[2] if r["doc_id"] is None]
    results = [*[[r for r in x if r["doc_id"] is not None] for x in results[:3]], *results[3:]]
    docs = [d for d in docs if d[0] is not None]
    clean = {r["doc_id"]: r["text"] for r in results[0]}
    bad = {i for i, t, *_ in docs if "zz" in (t or "")}
    assert set(clean) == {d[0] for d in docs} - bad
    cut = {r["doc_id"]: r["text"] for r in results[1]}
    assert cut == by_windows(list(clean.items()))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in results[1])
    sets = {}
    for i, t in cut.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    group = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = group[x], group[y]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {r["doc_id"] for r in results[2]}
    assert kept == {i for i in sets if group[i] == i} and len(kept) < len(sets)
    size, taken = Counter(), Counter()
    for r in [*results[2], *nameless]:
        size[r["source"]] += len((r["text"] or "").split())
    for r in results[3]:
        taken[r["source"]] += len((r["text"] or "").split())
    goal = mixing.targets(dict(size), (3, 1, 2), 1.5, 2.0)
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in goal)
    copies = Counter(r["doc_id"] for r in results[3])
    assert max(n for i, n in copies.items() if i is not None) <= 2 and copies[None] <= 4
    assert Counter(r["doc_id"] for r in results[4]) == Counter(r["doc_id"] for r in results[3])
    again = cp.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, results[4]), key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    assert toxicity.fitted(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).words == {}


def test_last_stage_yields_tokens_and_texts(spark):
    docs = [(1, "one two  three\nfour", "en", "s", 19), (1, "one", "en", "s", 3), (2, "", "en", "s", 0), (3, None, None, None, None)]
    got = cp.tokens(spark, spark.createDataFrame(docs, DOCS), "").collect()
    assert len(got) == len(docs)
    for r in got:
        assert len(r["token_ids"]) == r["n_tokens"]
        assert hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert max(r["n_tokens"] for r in got) > 1


def test_columns_with_names_that_operators_use(spark):
    """Stages keep other columns of their input, whatever they are called."""
    names = ["node", "cell", "size", "copies", "rid", "hash", "kind", "row"]
    docs = spark.createDataFrame([(i, f"text {i % 3} of some words that are common to all", "en", "s", 40, *names) for i in range(12)], DOCS + "".join(f", {n} string" for n in names))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    now = toxicity.clean(docs, toxicity.fitted(docs, labels))
    for stage in (cp.repeated_lines, cp.near_copies, cp.mix):
        now = stage(spark, now, "")
        assert now.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(names) for r in now.collect())
