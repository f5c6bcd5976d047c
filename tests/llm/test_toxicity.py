from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np

from tesserae.llm import toxicity as tx

DOCS, LABELS = "doc_id bigint, text string, toxic string, score int", "doc_id bigint, quality int, toxic int, text int"


def test_inference_equals_enumeration():
    rng = np.random.default_rng(0)
    chain = tx.Chain(rng.normal(size=4 + len(tx.CLASSES)))
    n = len(tx.CLASSES)
    bias, w, t = chain.params[0], chain.params[1 : 1 + n], chain.params[1 + n :]
    trans = {(0, 0): 0.0, (0, 1): t[0], (1, 0): t[1], (1, 1): t[2]}
    docs = [([0, 2, 3], [1, 4, 0], 6), ([], [], 4), ([5], [2], 7), ([1, 4], [3, 3], 5)]
    counts, gaps, kinds, order = tx.padded([d[:2] for d in docs], [d[2] for d in docs])
    p, log_z = chain.run(counts, gaps, kinds)
    score = chain.score(counts, gaps, kinds, np.ones(4, bool))
    for row, k in enumerate(order):
        at, kind, length = docs[k]
        marks, z, sums = dict(zip(at, kind, strict=True)), 0.0, np.zeros(len(at))
        weight = {}
        for states in itertools.product((0, 1), repeat=length):
            x = sum(trans[a, b] for a, b in zip((0, *states), states))
            x += sum(bias + (w[marks[i]] if i in marks else 0) for i, s in enumerate(states) if s)
            weight[states] = x
            z += math.exp(x)
            sums += [math.exp(x) * states[i] for i in at]
        assert np.isclose(log_z[row], math.log(z))
        assert np.allclose(p[row, : len(at)], sums / z)
        assert np.isclose(score[row], weight[tuple(int(i in marks) for i in range(length))])


def corpus(n: int = 600):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, 8) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["Vilewort,", "muckle!", "trashé"]))
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, int(bad), 0))
    return docs, labels


def test_held_out_documents_spans_and_inputs(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = tx.fitted(d, y)
    got = {r["doc_id"]: r for r in tx.scored(d, model, spans=True).collect()}
    truth = {i: t for i, _, t, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert all(got[i]["predicted"] == truth[i] for i in held) and sum(truth[i] for i in held) > 10
    for i, text, *_ in docs:
        for s in got[i]["spans"]:
            assert {x.strip(",!").lower() for x in text[s["start"] : s["stop"]].split()} <= {"vilewort", "muckle", "trashé"}
    flipped = [(i, q, 1 - t if i in set(held) else t, x) for i, q, t, x in labels]  # held-out labels are no input
    again = tx.fitted(d, spark.createDataFrame(flipped, LABELS))
    assert again.words == model.words and np.allclose(again.weights, model.weights)


def test_nulls_empty_repeated_and_empty_tables(spark):
    docs, labels = corpus(200)
    docs += [(None, None, None, None), (900, "", None, None), (901, None, None, None), (901, None, None, None), (902, "muckle " * 40000, None, None)]
    labels += [(900, None, None, None), (None, 1, 1, 1), (3, 1, 1, 0), (3, 1, 0, 0)]
    model = tx.fitted(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    got = tx.scored(spark.createDataFrame(docs, DOCS), model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 902)["predicted"] == 1
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1
    none = tx.fitted(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert all(r["predicted"] == 0 for r in tx.scored(spark.createDataFrame(docs, DOCS), none).collect())
    assert tx.scored(spark.createDataFrame([], DOCS), model).collect() == []


def dense(model, text):
    """A document's score by forward and backward steps over every token, without closed forms."""
    tokens = tx.TOKEN.findall(tx.in_lower(text or ""))
    n = len(tx.CLASSES)
    bias, w, t = model.chain.params[0], model.chain.params[1 : 1 + n], model.chain.params[1 + n :]
    step = np.exp(np.array([[0.0, t[0]], [t[1], t[2]]]))
    emit = [np.array([1.0, math.exp(bias + (w[model.words[x]] if x in model.words else 0.0))]) for x in tokens]
    ahead, now = [], np.array([1.0, 0.0])
    for e in emit:
        now = (now @ step) * e
        now = now / now.sum()
        ahead.append(now)
    p, back = [], np.ones(2)
    for i in reversed(range(len(tokens))):
        both = ahead[i] * back
        if tokens[i] in model.words:
            p.append(both[1] / both.sum())
        back = step @ (emit[i] * back)
        back = back / back.sum()
    x = tx.features(np.array([sum(p)]), np.array([max(p, default=0.0)]), np.array([float(len(tokens))]))
    return float((1 / (1 + np.exp(-x @ model.weights)))[0])


def test_whole_result_as_by_brute_force(spark):
    """Word choice by counting, the fit by its optimality, and every score by a dense chain."""
    docs, labels = corpus()
    docs += [(900, None, "x", 1), (901, "muckle " * 700 + "plain words", "x", 1)]
    labels += [(901, 1, 1, 0)]
    model = tx.fitted(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    truth, text = {i: t for i, _, t, _ in labels}, {i: t for i, t, *_ in docs}
    learnt = [i for i in truth if zlib.crc32(str(i).encode()) % 5]
    n = [sum(truth[i] == k for i in learnt) for k in (0, 1)]
    seen = {k: {} for k in (0, 1)}
    for i in learnt:
        for word in set(tx.TOKEN.findall(text[i].lower())):
            seen[truth[i]][word] = seen[truth[i]].get(word, 0) + 1
    odds = {x: math.log((a + 0.5) / (n[1] + 1)) - math.log((seen[0].get(x, 0) + 0.5) / (n[0] + 1)) for x, a in seen[1].items() if a >= tx.LEAST_DOCS}
    assert model.words == {x: sum(o >= c for c in tx.CLASSES) - 1 for x, o in odds.items() if o >= tx.CLASSES[0]}
    # the chain: no small change makes the labels likelier
    rows = [(truth[i] == 1, *seq) for i in learnt for seq in tx.sequences(*model.marks(text[i]), tx.CHAIN_MARKS)]
    assert any(len(r[1]) == tx.CHAIN_MARKS for r in rows) == (901 in learnt)
    counts, gaps, kinds, order = tx.padded([(r[1], r[2]) for r in rows], [r[3] for r in rows])
    gold = np.array([r[0] for r in rows])[order]

    def loss(x):
        c = tx.Chain(x)
        return float((c.partition(counts, gaps, kinds) - c.score(counts, gaps, kinds, gold)).sum()) / len(rows) + 1e-3 * float(x @ x)

    at, rng = model.chain.params, np.random.default_rng(0)
    assert all(loss(at + 0.05 * rng.standard_normal(len(at))) > loss(at) for _ in range(30))
    # the weights: the slope of the penalised likelihood is zero
    x = np.concatenate([model.features([text[i]]) for i in learnt])
    y = np.array([float(truth[i]) for i in learnt])
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ model.weights))) - model.weights).max() < 1e-6
    got = {r["doc_id"]: r["score"] for r in tx.scored(spark.createDataFrame(docs, DOCS), model).collect()}
    assert all(abs(got[i] - dense(model, text[i])) < 1e-6 for i in got)


def test_sequences_keep_every_mark_and_token():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 60)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        cut = tx.sequences(at, [i % 5 for i in at], n, 7)
        assert sum(c[2] for c in cut) == n and sum(len(c[0]) for c in cut) == len(at)
        starts = [sum(c[2] for c in cut[:k]) for k in range(len(cut))]
        assert [a + s for c, s in zip(cut, starts) for a in c[0]] == at
