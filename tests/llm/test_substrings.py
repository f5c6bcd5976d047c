from __future__ import annotations

import random

from tesserae.llm import substrings

SCHEMA = "doc_id bigint, text string, hash string, band int"
rng = random.Random(3)


def sentence() -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 11))).capitalize() + "."


def prose(n: int) -> str:
    return " ".join(sentence() for _ in range(n))


def test_pasted_passages_are_found_and_clean_documents_left(spark):
    rows, pasted = [], []
    passages = [prose(8) for _ in range(12)]
    for i in range(120):
        text = prose(20)
        if i < 48:
            words = text.split()
            at = rng.randint(0, len(words))
            text = " ".join([*words[:at], passages[i % 12], *words[at:]])
            pasted.append(i)
        rows.append((i, text, "x", 1))
    got = substrings.repeated(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    texts = {r[0]: r[1].split() for r in rows}
    assert {r["doc_id"] for r in got} == {i for i in pasted if i >= 12}
    for r in got:
        assert r["of_doc_id"] < r["doc_id"] and r["of_doc_id"] % 12 == r["doc_id"] % 12
        cut, passage = texts[r["doc_id"]][r["start"] : r["stop"]], set(passages[r["doc_id"] % 12].split())
        assert sum(w in passage for w in cut) >= 0.8 * len(cut) and r["n_words"] == r["stop"] - r["start"]
    assert sum(r["n_words"] for r in got) > 0.6 * sum(len(passages[i % 12].split()) for i in pasted if i >= 12)


def test_near_copies_of_a_paragraph_are_linked_as_brute_force_says(spark):
    base = [prose(3) for _ in range(15)]
    rows = []
    for i in range(90):
        words = base[i % 15].split()
        for _ in range(i // 30):
            words[rng.randint(0, len(words) - 1)] = "changed"
        rows.append((i, " ".join(words), None, None))
    got = {(r["doc_id"], r["of_doc_id"]) for r in substrings.repeated(spark.createDataFrame(rows, SCHEMA), recall=0.9999).collect()}
    doc, start, stop, text_hash, shingles, a, z = substrings.paragraphs([r[1] for r in rows])
    sets = [set(shingles[x:y].tolist()) for x, y in zip(a, z, strict=True)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = set()
    for g in set(group):
        places = sorted((int(doc[k]), int(start[k]), int(stop[k])) for k in range(len(sets)) if group[k] == g)
        want |= {(d, places[0][0]) for d, s, _ in places if d != places[0][0] or s >= places[0][2]}
    assert got == want and len(got) >= 15


def test_nulls_empty_long_repeated_and_empty_table(spark):
    long = prose(3000)
    rows = [(1, None, "h", 1), (2, "", "h", 1), (3, "few words", "h", 1), (4, "few words", "h", 1), (None, long, "h", 1), (5, long, "h", 1), (5, long, "h", 1), (6, long, None, None)]
    got = substrings.repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in got} == {(6, 5)}
    assert sum(r["n_words"] for r in got) > 0.99 * len(long.split())
    assert substrings.repeated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tuning():
    assert substrings.tuned(0.8, 0.95) == (3, 2)
    bands, rows = substrings.tuned(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_texts_without_punctuation(spark):
    """Any run of as many words as two cuts and a paragraph take is found, wherever it stands."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    n = substrings.LEAST_WORDS + 3 * substrings.CUT_WORDS
    rows, pasted = [], {}
    for i in range(80):
        words = [word() for _ in range(200)]
        if i >= 40:
            a, b = rng.randrange(200 - n), rng.randrange(200 - n)
            words[b : b + n] = rows[i - 40][1].split()[a : a + n]
            pasted[i] = i - 40
        rows.append((i, " ".join(words), None, None))
    got = substrings.repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["of_doc_id"] for r in got} == pasted


def changed(text: str, n: int) -> str:
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = "changed"
    return " ".join(words)


def held(spark, rows):
    """Documents and their originals, as exact similarities of all paragraphs say."""
    got = {(r["doc_id"], r["of_doc_id"]) for r in substrings.repeated(spark.createDataFrame(rows, SCHEMA), recall=0.99999).collect()}
    doc, start, stop, _, shingles, a, z = substrings.paragraphs([r[1] for r in rows])
    sets = [set(shingles[x:y].tolist()) for x, y in zip(a, z, strict=True)]
    group = list(range(len(sets)))
    places = [(rows[doc[k]][0], int(start[k]), int(stop[k])) for k in range(len(sets))]
    first = {}
    for k in range(len(sets)):
        first[frozenset(sets[k])] = min(first.get(frozenset(sets[k]), places[k]), places[k])
    for i in range(len(sets)):
        for j in range(i):
            (d, x, y), (e, u, v) = first[frozenset(sets[i])], first[frozenset(sets[j])]
            if sets[i] != sets[j] and d == e and x < v and u < y:
                continue
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = set()
    for g in set(group):
        places = sorted((rows[doc[k]][0], int(start[k]), int(stop[k])) for k in range(len(sets)) if group[k] == g)
        want |= {(d, places[0][0]) for d, s, _ in places if d != places[0][0] or s >= places[0][2]}
    assert got == want
    return got


def test_rivals_that_share_a_first_document(spark):
    """X and Y stand in one document, W is like Y alone, and X stands elsewhere again: its later place is found through all of them."""
    rows = []
    for i in range(25):
        y = prose(4)
        x, w = changed(y, 1), changed(y, 2)
        rows += [(10 * i + 1, w, None, None), (10 * i + 3, f"{prose(3)} {y} {prose(3)} {x}", None, None), (10 * i + 5, f"{prose(2)} {x}", None, None)]
    assert len(held(spark, rows)) >= 25


def test_near_copies_within_a_document(spark):
    rows = [(i, f"{(p := prose(6))} {prose(5)} {changed(p, 1)}", None, None) for i in range(25)]
    assert len({(i, i) for i in range(25)} & held(spark, rows)) >= 15


def test_buckets_of_many_blocks(spark, monkeypatch):
    """Blocks of four: a group of near copies, and texts that share a phrase and little else."""
    monkeypatch.setattr(substrings, "BLOCK", 4)
    monkeypatch.setattr(substrings, "MANY_BLOCKS", 3)
    base, phrase = prose(4), "one phrase that every text has and that brings them together in many of the bands"
    rows = [(i, changed(base, i % 4), None, None) for i in range(60)]
    rows += [(100 + i, f"{phrase} {' '.join(prose(1).split()[:9])} {phrase}", None, None) for i in range(60)]
    held(spark, rows)


def test_small_and_large_pairs_count_alike():
    import numpy as np

    gen = np.random.default_rng(0)
    sets = [np.unique(gen.integers(0, 40, gen.integers(1, 20)).astype(np.uint64)) for _ in range(60)]
    cell = np.repeat(np.arange(6), 10)
    want = {(i, j): n for i in range(60) for j in range(i + 1, 60) if cell[i] == cell[j] and (n := len(np.intersect1d(sets[i], sets[j])))}
    assert {(int(i), int(j)): int(n) for i, j, n in zip(*substrings.pairs_in(cell, sets))} == want
    large = {(10 * c + i, 10 * c + j): int(n) for c in range(6) for i, common in substrings.pairs_of(sets[10 * c : 10 * c + 10]) for j, n in enumerate(common) if j > i and n}
    assert large == want
