"""Toxic spans by a linear-chain conditional random field.

Tokens get their training labels from the documents' labels: a token is toxic where its document is and where it belongs to the words that set toxic documents apart. The chain has two states; a token's features are the strength class of its word, and all words without one share a neutral class. A run of k neutral tokens is the k-th power of one 2x2 matrix, taken in closed form, so exact forward-backward inference costs a step for each marked word, not for each token. Marginals of the marked words add up to a document's score and give the offending offsets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import saved, small_batches

TOKEN = re.compile(r"\w+")
TOKEN_JAVA = r"[\p{L}\p{M}\p{N}_]+"
#: Bounds of the sample that the model is fitted on: labelled documents of each class, words kept.
SAMPLE_PER_CLASS, WORDS_KEPT = 10_000, 5_000
#: The chain's own parameters are fitted on so many sequences of these documents; a document with more marked words than that is cut into several.
CHAIN_SAMPLE, CHAIN_MARKS = 4_000, 256
#: A word is marked from this log odds on; classes begin at these.
CLASSES = (2.0, 3.0, 4.0, 5.0, 6.0)
LEAST_DOCS = 4


def in_lower(text: str) -> str:
    """Lower case with offsets kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def held_out(doc_id: Column) -> Column:
    """True for every fifth document, by the CRC-32 of its number as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Chain:
    """params: weight of the toxic state, its weight for each class, and three transitions (clean to toxic, toxic to clean, toxic to toxic)."""

    params: np.ndarray

    def parts(self):
        n = len(CLASSES)
        bias, w, t = self.params[0], self.params[1 : 1 + n], self.params[1 + n :]
        step = np.exp(np.array([[0.0, t[0]], [t[1], t[2]]]))
        neutral = step * np.array([1.0, math.exp(bias)])
        tr, det = np.trace(neutral), np.linalg.det(neutral)
        root = math.sqrt(max(tr * tr / 4 - det, 1e-300))
        top, low = tr / 2 + root, tr / 2 - root
        first = (neutral - low * np.eye(2)) / (top - low)
        return step, np.exp(bias + w), top, low / top, first, np.eye(2) - first

    def partition(self, counts: np.ndarray, gaps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The log partition function of each document, by the forward pass alone."""
        return self.run(counts, gaps, kinds, backward=False)[1]

    def run(self, counts: np.ndarray, gaps: np.ndarray, kinds: np.ndarray, backward: bool = True):
        """Marginals of the marked tokens and the log partition function of each document.

        counts: marked tokens of each document, descending; gaps: neutral tokens before each marked one and, in the last column that a document uses, after it; kinds: classes.
        """
        step, marked, top, ratio, first, second = self.parts()
        docs, width = kinds.shape
        ones = np.ones((docs, 2))
        alphas, log_z = [], np.zeros(docs)

        def power(k: np.ndarray) -> np.ndarray:
            return first[None] + np.power(ratio, k)[:, None, None] * second[None]

        now = np.tile([1.0, 0.0], (docs, 1))
        live = [int(np.searchsorted(-counts, -j, side="left")) for j in range(width + 1)]  # documents with more than j
        for j in range(width):
            n = live[j]
            a = np.einsum("di,dij->dj", now[:n], power(gaps[:n, j])) @ step
            a[:, 1] *= marked[kinds[:n, j]]
            s = a.sum(1)
            now[:n] = a / s[:, None]
            log_z[:n] += np.log(s) + gaps[:n, j] * math.log(top)
            alphas.append(now[:n].copy())
        last = gaps[np.arange(docs), counts]
        tail = np.einsum("di,dij,dj->d", now, power(last), ones)
        log_z += np.log(tail) + last * math.log(top)
        out = np.zeros((docs, width))
        if not backward:
            return out, log_z
        beta = np.einsum("dij,dj->di", power(last), ones)
        for j in reversed(range(width)):
            n = live[j]
            both = alphas[j] * beta[:n]
            out[:n, j] = both[:, 1] / both.sum(1)
            emitted = beta[:n].copy()
            emitted[:, 1] *= marked[kinds[:n, j]]
            b = np.einsum("dij,dj->di", power(gaps[:n, j]), emitted @ step.T)
            beta[:n] = b / b.sum(1, keepdims=True)
        return out, log_z

    def score(self, counts, gaps, kinds, toxic) -> np.ndarray:
        """Unnormalised log weight of the training labels: marked tokens of toxic documents toxic, all else clean."""
        n = len(CLASSES)
        bias, w, t = self.params[0], self.params[1 : 1 + n], self.params[1 + n :]
        out = np.zeros(len(counts))
        here = toxic & (counts > 0)
        used = (np.arange(kinds.shape[1])[None] < counts[:, None]) & here[:, None]
        out += (used * (bias + w[kinds])).sum(1)
        joined = used[:, 1:] & (gaps[:, 1 : kinds.shape[1]] == 0)
        runs = used.sum(1) - joined.sum(1)
        ended = runs - (here & (gaps[np.arange(len(counts)), counts] == 0))
        return out + joined.sum(1) * t[2] + runs * t[0] + ended * t[1]


def padded(hits: list[tuple[list[int], list[int]]], lengths: list[int]):
    """Documents' marked positions and classes as arrays, most marks first; the order used comes last."""
    order = sorted(range(len(hits)), key=lambda i: -len(hits[i][0]))
    counts = np.array([len(hits[i][0]) for i in order], int)
    width = int(counts.max(initial=0))
    gaps, kinds = np.zeros((len(hits), width + 1)), np.zeros((len(hits), max(width, 0)), int)
    for row, i in enumerate(order):
        at, kind = hits[i]
        gaps[row, : len(at) + 1] = np.diff([-1, *at, lengths[i]]) - 1
        kinds[row, : len(at)] = kind
    return counts, gaps, kinds, order


def sequences(at: list[int], kinds: list[int], length: int, most: int) -> list[tuple[list[int], list[int], int]]:
    """A document's marked positions and classes, cut after every so many marks; positions count from where each sequence begins."""
    out, start = [], 0
    for k in range(0, max(1, len(at)), most):
        some = at[k : k + most]
        stop = length if k + most >= len(at) else some[-1] + 1
        out.append(([i - start for i in some], kinds[k : k + most], stop - start))
        start = stop
    return out


def minimised(f, x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """BFGS with gradients by central differences, for a dozen parameters."""

    def slope(x):
        return np.array([(f(x + h) - f(x - h)) / 2e-4 for h in np.eye(len(x)) * 1e-4])

    inv, fx, g = np.eye(len(x)), f(x), slope(x)
    for _ in range(rounds):
        d = -inv @ g
        if g @ d > 0:
            inv, d = np.eye(len(x)), -g
        step = 1.0
        while step > 1e-8 and not (f(x + step * d) < fx + 1e-4 * step * (g @ d)):
            step /= 2
        if step <= 1e-8:
            break
        s = step * d
        new = slope(x + s)
        y = new - g
        x, g, before, fx = x + s, new, fx, f(x + s)
        if before - fx < 1e-7 * (1 + abs(fx)):
            break
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inv = left @ inv @ left.T + np.outer(s, s) / sy
    return x


def features(sums: np.ndarray, most: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document's score sees of its marginals: their sum, the largest one, and the sum by length."""
    return np.stack([np.ones(len(sums)), np.log1p(sums), most, np.minimum(1.0, 20 * sums / np.maximum(lengths, 1))], 1)


@dataclass
class Model:
    words: dict[str, int]
    chain: Chain
    weights: np.ndarray

    def marks(self, text: str) -> tuple[list[int], list[int], int]:
        """Positions and classes of a text's marked tokens, and its number of tokens."""
        tokens = TOKEN.findall(in_lower(text))
        words = self.words
        at = [i for i, t in enumerate(tokens) if t in words]
        return at, [words[tokens[i]] for i in at], len(tokens)

    def marginals(self, hits, lengths) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(hits)
        by_size: dict[int, list[int]] = {}
        for i, h in enumerate(hits):
            if h[0]:
                by_size.setdefault(len(h[0]).bit_length(), []).append(i)
        for group in by_size.values():
            counts, gaps, kinds, order = padded([hits[i] for i in group], [lengths[i] for i in group])
            p, _ = self.chain.run(counts, gaps, kinds)
            for row, k in enumerate(order):
                out[group[k]] = p[row, : counts[row]]
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        rows = [self.marks(t) for t in texts]
        p = self.marginals([r[:2] for r in rows], [r[2] for r in rows])
        return features(np.array([m.sum() for m in p]), np.array([m.max(initial=0.0) for m in p]), np.array([r[2] for r in rows], float))

    def scores(self, marginals: list[np.ndarray], lengths: list[int]) -> np.ndarray:
        x = features(np.array([m.sum() for m in marginals]), np.array([m.max(initial=0.0) for m in marginals]), np.array(lengths, float))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents outside the held-out fifth.

    The sample: up to SAMPLE_PER_CLASS documents of each class, those lowest by a hash of their number. Their ids are few enough to broadcast; their texts stay on the executors. To the driver come the words that mark toxic documents (WORDS_KEPT at most), the places of these words in CHAIN_SAMPLE sequences of CHAIN_MARKS marks at most (those lowest by a hash of document and place), and four features of each sampled document, however long it is. Labels of 0 and 1 count, contradicting or null ones don't.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    picked = []
    for kind in (0, 1):
        picked += usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS).select("doc_id", "toxic").collect()
    n = [sum(r["toxic"] == k for r in picked) for k in (0, 1)]
    if not all(n):
        return Model({}, Chain(np.zeros(4 + len(CLASSES))), np.array([10.0 * (n[1] > n[0]) - 10.0 * (n[1] <= n[0]), 0, 0, 0]))
    sample = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "of bigint, toxic int")
    texts = docs.select("doc_id", F.col("text").alias("text")).where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("doc_id", "toxic", "text")
    texts = saved(texts, "sample")
    words = texts.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_JAVA), F.lit(0)))).alias("word"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    table = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= CLASSES[0])
    kept = table.orderBy(F.col("odds").desc(), F.col("a").desc(), "word").limit(WORDS_KEPT).collect()
    model = Model({r["word"]: int(np.searchsorted(CLASSES, r["odds"], side="right")) - 1 for r in kept}, Chain(np.zeros(4 + len(CLASSES))), np.zeros(4))
    words_of = model.words

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(words_of, Chain(np.zeros(4 + len(CLASSES))), np.zeros(4))
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, toxic, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                for k, row in enumerate(sequences(*m.marks(text.as_py()), CHAIN_MARKS)):
                    for col, v in zip(cols, (doc.as_py(), k, toxic.as_py(), *row), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()), strict=True)], ["doc_id", "k", "toxic", "at", "kind", "n"])

    every = texts.mapInArrow(marked, "doc_id bigint, k int, toxic int, at array<int>, kind array<int>, n int")
    some = every.orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "at", "n").limit(CHAIN_SAMPLE)
    got = sorted(map(tuple, some.select("toxic", "at", "kind", "n").collect()), key=repr)
    toxic = np.array([r[0] == 1 for r in got], bool)
    hits, lengths = [(list(r[1]), list(r[2])) for r in got], [r[3] for r in got]
    fit = list(range(len(got)))
    groups = []
    for size in sorted({len(hits[i][0]).bit_length() for i in fit}):
        some = [i for i in fit if len(hits[i][0]).bit_length() == size]
        *arrays, order = padded([hits[i] for i in some], [lengths[i] for i in some])
        groups.append((*arrays, toxic[some][order]))

    def loss(x: np.ndarray) -> float:
        chain, out = Chain(x), 0.0
        for counts, gaps, kinds, gold in groups:
            out += float((chain.partition(counts, gaps, kinds) - chain.score(counts, gaps, kinds, gold)).sum())
        return out / len(fit) + 1e-3 * float(x @ x)

    start = np.array([0.0, *np.linspace(1, 4, len(CLASSES)), -4.0, 0.0, -2.0])
    model.chain = Chain(minimised(loss, start) if any(g[0].any() for g in groups) else start)
    sent = spark.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = m.features([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T[1:]]], ["toxic", "total", "most", "dense"])

    got = np.array(sorted(map(tuple, texts.select("toxic", "text").mapInArrow(seen, "toxic int, total double, most double, dense double").collect())))
    model.weights = logistic(np.column_stack([np.ones(len(got)), got[:, 1:]]), got[:, 0]) if len(got) else np.zeros(4)
    return model


def scored(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), n_marked, and on request spans: starts, ends and marginals of tokens that are likelier toxic than not, neighbours joined.

    docs: doc_id and text; other columns are ignored. One row for each row, repeated ones and null ids too; a null or empty text has no tokens and gets the score of a text without any marked word.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WORDS_KEPT words at most
    schema = "doc_id bigint, score double, n_marked int, spans array<struct<start: int, stop: int, p: double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = [m.marks(t.as_py() or "") for t in batch.column(1)]
            lengths = [r[2] for r in rows]
            p = m.marginals([r[:2] for r in rows], lengths)
            found = [[] for _ in rows]
            if spans:
                for i, (r, q) in enumerate(zip(rows, p, strict=True)):
                    bad = {k: x for k, x in zip(r[0], q.tolist(), strict=True) if x > 0.5}
                    if bad:
                        places = [(k, x.start(), x.end()) for k, x in enumerate(TOKEN.finditer(in_lower(batch.column(1)[i].as_py()))) if k in bad]
                        for k, a, b in places:
                            if found[i] and k - 1 in bad:
                                found[i][-1] = {"start": found[i][-1]["start"], "stop": b, "p": max(found[i][-1]["p"], bad[k])}
                            else:
                                found[i].append({"start": a, "stop": b, "p": bad[k]})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(p, lengths) if rows else [], pa.float64()), pa.array([len(r[0]) for r in rows], pa.int32()), pa.array(found, kind)], ["doc_id", "score", "n_marked", "spans"])

    out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_marked", "spans")
    return out if spans else out.drop("spans")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; null and empty texts are scored as such. docs: text at least."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if batch.num_rows:
                rows = [m.marks(t.as_py() or "") for t in batch.column(at)]
                lengths = [r[2] for r in rows]
                yield batch.filter(pa.array(m.scores(m.marginals([r[:2] for r in rows], lengths), lengths) < 0.5))

    return docs.mapInArrow(run, docs.schema)
