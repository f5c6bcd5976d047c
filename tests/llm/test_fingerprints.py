from __future__ import annotations

import hashlib

import numpy as np

from tesserae.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, halo string, key int"


def test_every_document_meets_its_next_one(spark):
    texts = ["alpha beta gamma delta " * (i % 5 + 1) + "x" * i for i in range(60)]
    rows = [(i * 7 - 100, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fp.fingerprinted(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert len(got) == 60
    for k, (i, text, *_) in enumerate(rows):
        after = texts[(k + 1) % 60]
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = fp.sketches([text, changed, after])
        assert r["fingerprint"] == a.astype(">u2").tobytes().hex()
        assert np.isclose(r["near_edited"], fp.likeness(a[None], b[None])[0])
        assert np.isclose(r["near_next"], fp.likeness(a[None], c[None])[0])


def test_nulls_empty_ties_and_empty_table(spark):
    rows = [(1, None, "h", 1), (1, "", "h", 1), (2, "same text here", "h", 1), (3, "same text here", None, None), (None, "z" * 50000, "h", 2), (None, None, None, None)]
    got = fp.fingerprinted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6
    two, three = (next(r for r in got if r["doc_id"] == k) for k in (2, 3))
    assert two["fingerprint"] == three["fingerprint"] and two["near_next"] == 1.0
    assert sum(r["n_chars"] == 0 for r in got) == 3
    assert fp.fingerprinted(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.fingerprinted(spark.createDataFrame(rows[2:3], SCHEMA)).first()
    assert one["near_next"] == 1.0


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(1)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    passage = " ".join(word() for _ in range(400))
    a, b = " ".join(word() for _ in range(37)) + passage, passage + " ".join(word() for _ in range(11))
    other = " ".join(word() for _ in range(400))
    s = fp.sketches([a, b, other])
    assert fp.likeness(s[:1], s[1:2])[0] > 0.8
    assert fp.likeness(s[:1], s[2:])[0] < 0.1


M = 2**64


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def sketch(text):
    """The fingerprint of one text, by loops over plain integers."""
    step, least = 0x9E3779B97F4A7C15, {}
    names, level = [mixed((ord(c) + 1) * step % M) for c in text], 0
    while names and (level == 0 or len(names) > 1):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mixed((x + n * step) % M) if n > 1 else x for x, n in runs]
        labels = names
        for mark in (0, 128, 16):
            out = []
            for i, x in enumerate(labels):
                differs = x ^ (labels[i - 1] if i else mark)
                low = (differs & -differs).bit_length() - 1 if differs else (64 if labels is names else 8)
                out.append(2 * low + (x >> low & 1))
            labels = out
        begins = [i for i in range(len(names)) if i == 0 or 1 < i < len(names) - 1 and labels[i - 1] < labels[i] > labels[i + 1]]
        phrases = [names[a:z] for a, z in zip(begins, [*begins[1:], len(names)])]
        names = [mixed((sum(mixed((x + (k + 1) * step) % M) for k, x in enumerate(p)) + step) % M) for p in phrases]
        level += 1
        if level >= 2 or len(names) == 1:
            for x in names:
                v = mixed((x + level) % M)
                least[v % 64] = min(least.get(v % 64, M), v >> 6)
    return "".join(f"{mixed(least[b]) % 65535 + 1:04x}" if b in least else "0000" for b in range(64))


def alike(a, b):
    a, b = ([x[4 * i : 4 * i + 4] for i in range(64)] for x in (a, b))
    used, same = (sum(f(x, y) for x, y in zip(a, b)) for f in (lambda x, y: x > "0000" or y > "0000", lambda x, y: x == y > "0000"))
    return 2 * same / (used + same) if used else 1.0


def test_whole_result_as_by_loops(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 105, rng.integers(1, 7))))
    texts = [" ".join(word() for _ in range(rng.integers(0, 120))) for _ in range(40)] + ["", "a", "aa", "ab", "aaaaaaaaaa", "abab" * 30, "é中🙂" * 20, "x" * 5000 + "y"]
    rows = [(i * 3, t, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fp.fingerprinted(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        changed = fp.edited(text, after)
        own, other, following = sketch(text), sketch(changed), sketch(after)
        r = got[3 * k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other), text
        assert abs(r["near_edited"] - alike(own, other)) < 1e-12 and abs(r["near_next"] - alike(own, following)) < 1e-12


def test_fingerprint_does_not_depend_on_its_neighbours():
    short, long = "one two", "many more words than that " * 400
    assert (fp.sketches([short, long])[0] == fp.sketches([short])[0]).all()


def test_rows_without_id_and_of_one_id_are_spread(spark):
    """A third without an id, a third of one id: every range has its share, and null ids come last even beside the largest id."""
    rows = [(None, f"{i:05d} null words here", "", 0) for i in range(600)] + [(5, f"{i:05d} five words here", "", 0) for i in range(600)] + [(i * 11, f"{i:05d} text words here", "", 0) for i in range(598)] + [(2**63 - 1, f"{i:05d} top words here", "", 0) for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    parts = [[r["doc_id"] for r in p] for p in fp.dealt(docs).where("not halo").rdd.glom().collect()]
    assert sum(map(len, parts)) == 1800 and max(map(len, parts)) <= 900 and len([p for p in parts if p]) >= 3
    ids = [i for p in parts for i in p]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    got = fp.fingerprinted(docs).collect()
    assert len(got) == 1800
    assert len({r["edited_sha256"] for r in got}) == 1800
