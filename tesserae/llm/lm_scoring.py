"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target texts and one of background texts, share one vocabulary, one smoothing and one total of words: the counts of either are scaled to that of the smaller. A document's score is its mean loss per token under the target model less that under the background model; low scores read like the target. Every word and every bigram of the corpus is counted exactly, however many there are.

What is gathered grows with the corpus, so it is kept small. Documents are cut into parts of a bounded number of characters. A part is one row: its distinct words, and each token's place among them. From it follow the part's distinct words and bigrams, named by hashes, in sorted order. Each part sends them, packed as differences, with its own counts to ranges of hashes; a range adds them up and sends the corpus's counts back in the same order, without the names. The part then holds the counts of all that stands in it, and scores its documents. No table of the whole vocabulary meets anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import saved, small_batches
from tesserae.llm.fingerprints import mix
from tesserae.llm.words import words_of

#: Weight of the unigram model behind a bigram, and the unigram model's add-on.
PRIOR, ADD = 64.0, 0.5
#: Bits of a bigram's name; words have 64.
BIGRAM_BITS = 56
#: Characters of a part and of those whose words are hashed at once, names of a range of hashes on average, and labelled documents that are sent to all executors (8 bytes each; more are joined by sorting).
PART_CHARS, HASHED_CHARS, RANGE_NAMES, SENT_LABELS = 4_000_000, 1_000_000, 1_000_000, 500_000
#: The name of the symbol before a text's first word.
START = np.uint64(0x5EED_0F_7E87)
#: Kinds of documents: of the background, of the target, and those that are scored only.
BACKGROUND, TARGET, OTHER = 0, 1, 2
BIGRAMS, WORDS = 0, 1
PART = "part bigint, ids array<bigint>, kinds binary, sizes binary, words binary, n_words int, tokens binary, n0 bigint, n1 bigint"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 on by planes of bytes, as many as the largest one needs, compressed."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    out, width = np.zeros((n, 8), np.uint8), raw[0]
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[1:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def differences(x: np.ndarray) -> np.ndarray:
    """Of sorted numbers the first one, and what each is over the one before."""
    return np.diff(x, prepend=x.dtype.type(0))


def tallied(place: np.ndarray, kind: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each of n places stands in background and in target texts."""
    return [np.bincount(place[kind == k], minlength=n) for k in (BACKGROUND, TARGET)]


class Part:
    """The documents of a part: names (sorted, the start symbol among them), each token's place in them, and each document's words and kind."""

    def __init__(self, names: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, kinds: np.ndarray):
        self.names, self.tokens, self.sizes, self.kinds = names, tokens.astype(np.int64), sizes.astype(np.int64), kinds
        self.start = int(np.searchsorted(names, START))
        self.kind = np.repeat(kinds, self.sizes)
        self.first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]

    @staticmethod
    def of_texts(texts: list[str], kinds: list[int]) -> Part:
        hashes, sizes, some, chars = [], [], [], 0
        for k, text in enumerate(texts):
            some.append(text.lower())
            chars += len(text)
            if chars >= HASHED_CHARS or k == len(texts) - 1:
                words = words_of(some)
                hashes.append(words.hashes)
                sizes.append(np.diff(words.first))
                some, chars = [], 0
        names, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        every = np.union1d(names, START)
        return Part(every, np.searchsorted(every, names)[tokens], np.concatenate(sizes), np.array(kinds, np.uint8))

    def word_counts(self) -> list[np.ndarray]:
        """Of each name; the start symbol counts once a document with words."""
        out = tallied(self.tokens, self.kind, len(self.names))
        for k, n in zip((BACKGROUND, TARGET), out, strict=True):
            n[self.start] = int(((self.kinds == k) & (self.sizes > 0)).sum())
        return out

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of the distinct bigrams, sorted; the places of both words of each; and the place of each token's bigram among them."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = self.start
        pair, at = np.unique(before * len(self.names) + self.tokens, return_inverse=True)
        a, b = pair // len(self.names), pair % len(self.names)
        names = mix(mix(self.names[a] + np.uint64(1)) * np.uint64(3) + self.names[b]) >> np.uint64(64 - BIGRAM_BITS)
        order = np.argsort(names, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return names[order], a[order], b[order], rank[at]


def part_of(row: dict) -> Part:
    sizes = np.frombuffer(row["sizes"], "<u4")
    names = np.cumsum(unsqueezed(row["words"], row["n_words"]), dtype=np.uint64)
    return Part(names, unsqueezed(row["tokens"], int(sizes.sum(dtype=np.int64))), sizes, np.frombuffer(row["kinds"], np.uint8))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and kind: target where the labels say good quality and nothing else."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("bigint").alias("of"))
    good = saved(good, "good")
    good = F.broadcast(good) if good.count() <= SENT_LABELS else good.hint("merge")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.join(good, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.when(F.col("of").isNotNull(), TARGET).otherwise(BACKGROUND).alias("kind"))


def in_parts(rows: DataFrame) -> DataFrame:
    """The parts of rows (doc_id, text, kind), as PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids, texts, kinds, chars = [], [], [], 0

        def out() -> pa.RecordBatch:
            p = Part.of_texts(texts, kinds)
            n0, n1 = (int(p.sizes[p.kinds == k].sum()) for k in (BACKGROUND, TARGET))
            row = {"part": at, "ids": ids, "kinds": p.kinds.tobytes(), "sizes": p.sizes.astype("<u4").tobytes(), "words": squeezed(differences(p.names)), "n_words": len(p.names), "tokens": squeezed(p.tokens), "n0": n0, "n1": n1}
            kind = {"part": pa.int64(), "ids": pa.list_(pa.int64()), "n_words": pa.int32(), "n0": pa.int64(), "n1": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], kind.get(c, pa.binary())) for c, v in row.items()], list(row))

        for batch in batches:
            for i, text, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text.as_py() or "")
                kinds.append(kind)
                chars += len(texts[-1])
                if chars >= PART_CHARS:
                    yield out()
                    at, ids, texts, kinds, chars = at + 1, [], [], [], 0
        if ids:
            yield out()

    return rows.select("doc_id", "text", "kind").mapInArrow(run, PART)


def totals(parts: DataFrame, what: int, bits: int) -> DataFrame:
    """For each part and range of hashes (2 ** bits of them), of names of this kind: s0 and s1, the corpus's counts of the part's names in their order; and distinct, in one row of a range the number of its names that the models know."""
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = "range int, part bigint, n int, names binary, n0 binary, n1 binary"
    shift = np.uint64((64 if what == WORDS else BIGRAM_BITS) - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in sent.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                p, cols = part_of(row), [[] for _ in types]
                if what == WORDS:
                    keys, counts = p.names, p.word_counts()
                else:
                    keys, _, _, at = p.bigrams()
                    counts = tallied(at, p.kind, len(keys))
                ranges = (keys >> shift).astype(np.int64)
                begin = np.flatnonzero(np.diff(ranges, prepend=-1))
                for a, z in zip(begin.tolist(), np.append(begin[1:], len(keys)).tolist(), strict=True):
                    for col, v in zip(cols, (int(ranges[a]), row["part"], z - a, squeezed(differences(keys[a:z])), squeezed(counts[0][a:z]), squeezed(counts[1][a:z])), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([np.cumsum(unsqueezed(r["names"], r["n"]), dtype=np.uint64) for r in held]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([unsqueezed(r[c], r["n"]) for r in held]).astype(np.float64), len(keys)).astype(np.uint64) for c in ("n0", "n1")]
            ends = np.cumsum([r["n"] for r in held])
            back = [np.split(s[at], ends[:-1]) for s in sums]
            known = int((sums[0] + sums[1] > 0).sum())
            return pa.RecordBatch.from_arrays([pa.array([r["part"] for r in held], pa.int64()), pa.array([what] * len(held), pa.int32()), pa.array([now] * len(held), pa.int32()), pa.array([r["n"] for r in held], pa.int32()), pa.array([squeezed(s) for s in back[0]], pa.binary()), pa.array([squeezed(s) for s in back[1]], pa.binary()), pa.array([known] + [0] * (len(held) - 1), pa.int64())], ["part", "what", "range", "n", "s0", "s1", "distinct"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != now:
                    if held:
                        yield out()
                    now, held = row["range"], []
                held.append(row)
        if held:
            yield out()

    rows = parts.mapInArrow(send, sent).repartition(partitions, "range").sortWithinPartitions("range", "part")
    return rows.mapInArrow(add, "part bigint, what int, range int, n int, s0 binary, s1 binary, distinct bigint")


def scored(docs: DataFrame, labels: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (nats per token) and difference, the former less the latter: of docs, or of others, by models of docs.

    The target model is of the documents labelled as of good quality (labels: doc_id, quality; contradicting and null labels count as none), the background model of all other ones. docs and others: doc_id and text; other columns are ignored. Every document is counted once a row. One row for each row, null ids and repeated rows too; words are runs of other than ASCII white space in lower case, and without any n_tokens is 0 and the losses are null. Words and bigrams of others that docs lack count as unseen. An empty table of docs gives models that hold all words alike. A text is looked at whole by one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = labelled(docs, labels)
    if others is not None:
        rows = rows.unionByName(others.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(OTHER).alias("kind")))
    parts = saved(in_parts(rows), "parts")
    t = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n0", "n1")], F.coalesce(F.sum("n_words"), F.lit(0))).first()
    tokens = [t[0], t[1]]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a part has about as many bigrams as tokens; some ranges a task, so that tasks are of like size
    bits = min(31, max(8 * partitions, (sum(tokens) + t[2]) // RANGE_NAMES).bit_length())
    words = saved(totals(parts, WORDS, bits), "words")
    distinct = words.agg(F.sum("distinct")).first()[0] or 0
    scale = [min(tokens) / max(n, 1) for n in tokens] if min(tokens) else [1.0, 1.0]
    size = max(1, distinct)  # the words, and in the start symbol's place one for all unknown ones
    wanted = (BACKGROUND, TARGET) if others is None else (OTHER,)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = ["doc_id", "n_tokens", "loss_target", "loss_background"]
        out = []
        for row in left.to_pylist():
            p = part_of(row)
            got = sorted(right.to_pylist(), key=lambda r: (r["what"], r["range"]))
            sums = {k: [np.concatenate([unsqueezed(r[c], r["n"]) for r in got if r["what"] == k] or [np.zeros(0, np.uint64)]).astype(np.float64) for c in ("s0", "s1")] for k in (BIGRAMS, WORDS)}
            _, a, b, at = p.bigrams()
            ends = np.cumsum(p.sizes)
            losses = []
            for k in (TARGET, BACKGROUND):
                joint, word = sums[BIGRAMS][k] * scale[k], sums[WORDS][k] * scale[k]
                single = (word[b] + ADD) / (tokens[k] * scale[k] + ADD * size)
                upto = np.append(0.0, np.cumsum(-np.log((joint + PRIOR * single) / (word[a] + PRIOR))[at]))
                total = upto[ends] - upto[ends - p.sizes]
                losses.append(np.where(p.sizes > 0, total / np.maximum(p.sizes, 1), np.nan))
            keep = np.isin(p.kinds, wanted)
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(p.sizes), *[pa.array(x, mask=p.sizes == 0) for x in losses]], columns).filter(pa.array(keep)))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], columns)

    back = words.unionByName(totals(parts, BIGRAMS, bits)).select("part", "what", "range", "n", "s0", "s1")
    out = parts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(score, "doc_id bigint, n_tokens bigint, loss_target double, loss_background double")
    return out.withColumn("difference", F.col("loss_target") - F.col("loss_background"))
