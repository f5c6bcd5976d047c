from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import lm_scoring as lm

DOCS, LABELS = "doc_id bigint, text string, quality int, difference double", "doc_id bigint, quality int, toxic int, text int"


def corpus():
    rng = random.Random(6)
    good, plain = [f"g{i}" for i in range(30)], [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(150):
        kind = i % 3 == 0
        docs.append((i, " ".join(rng.choice(good + plain[:20] if kind else plain) for _ in range(rng.randint(1, 80))).title(), 1, 0.0))
        if i % 2 == 0:
            labels.append((i, int(kind), 0, 0))
    return docs, labels


def brute(docs, good):
    """Losses by dictionaries."""
    words = [w for _, w in sorted((-n, w) for w, n in Counter(w for _, t, *_ in docs for w in (t or "").lower().split()).items())]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t, *_ in docs:
        k, ws = int(i in good), ["<s>", *(t or "").lower().split()]
        uni[k].update(ws)
        bi[k].update(zip(ws, ws[1:]))
    totals = [sum(n for w, n in u.items() if w != "<s>") for u in uni]
    scale = [min(totals) / t for t in totals]
    out = {}
    for i, t, *_ in docs:
        ws = ["<s>", *(t or "").lower().split()]
        loss = [0.0, 0.0]
        for k in (0, 1):
            n, size = totals[k] * scale[k], len(words) + 1
            for a, b in zip(ws, ws[1:]):
                p1 = (uni[k][b] * scale[k] + lm.ADD) / (n + lm.ADD * size)
                loss[k] -= math.log((bi[k][a, b] * scale[k] + lm.PRIOR * p1) / (uni[k][a] * scale[k] + lm.PRIOR))
        out[i] = (len(ws) - 1, loss[1] / max(1, len(ws) - 1), loss[0] / max(1, len(ws) - 1))
    return out


def held(got, want):
    for i, (n, target, background) in want.items():
        assert got[i]["n_tokens"] == n
        assert np.abs(np.array([got[i]["loss_target"], got[i]["loss_background"], got[i]["difference"]]) - [target, background, target - background]).max() < 1e-9


@pytest.mark.parametrize("chars", [300, 4_000_000])
def test_as_by_dictionaries(spark, monkeypatch, chars):
    monkeypatch.setattr(lm, "PART_CHARS", chars)
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in lm.scored(d, spark.createDataFrame(labels, LABELS)).collect()}
    held(got, brute(docs, {i for i, q, *_ in labels if q}))
    score = lambda k: np.mean([got[i]["difference"] for i in got if (i % 3 == 0) == k])
    assert score(True) < score(False) - 0.2


def test_labels_joined_by_sorting_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT_LABELS", 0)
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held(got, brute(docs, {i for i, q, *_ in labels if q}))


def test_other_documents_are_scored_and_not_counted(spark):
    docs, labels = corpus()
    d, of = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    own = {r["doc_id"]: r for r in lm.scored(d, of).collect()}
    others = [(1000 + i, t, *rest) for i, t, *rest in docs[:20]] + [(2000, "never seen", 0, 0.0)]
    got = {r["doc_id"]: r for r in lm.scored(d, of, spark.createDataFrame(others, DOCS)).collect()}
    assert set(got) == {i for i, *_ in others}
    assert all(abs(got[1000 + i]["difference"] - own[i]["difference"]) < 1e-9 for i in range(20))
    assert got[2000]["n_tokens"] == 2


def test_nulls_empty_repeated_long_and_empty_tables(spark):
    docs, labels = corpus()
    docs += [(None, "w1 w2", None, None), (500, None, None, None), (501, "", None, None), (501, "", None, None), (502, "w1 " * 100000, None, None)]
    labels += [(None, 1, 0, 0), (0, 0, 0, 0), (500, None, None, None)]
    got = lm.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    assert all((r["difference"] is None) == (r["n_tokens"] == 0) for r in got)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (500, 501)) == [0, 0, 0]
    none, unlabelled = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert lm.scored(none, unlabelled).collect() == []
    assert len(lm.scored(spark.createDataFrame(docs, DOCS), unlabelled).collect()) == len(docs)


def test_every_word_and_bigram_has_its_own_count(spark):
    """Over 65,536 words, some equally frequent, and over 2^18 bigrams."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(90_000)}" for _ in range(1000)), 1, 0.0) for i in range(300)]
    docs.append((300, " ".join(f"x{k}" for k in range(70_000)), 1, 0.0))
    labels = [(i, int(i % 3 == 0), 0, 0) for i in range(300)]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in lm.scored(d, spark.createDataFrame(labels, LABELS)).collect()}
    held(got, brute(docs, {i for i, q, *_ in labels if q}))


def test_numbers_come_back_from_their_planes():
    for x in ([], [0], [255, 256, 0], [2**64 - 1, 1], list(range(1000))):
        x = np.array(x, np.uint64)
        assert (lm.unsqueezed(lm.squeezed(x), len(x)) == x).all()
