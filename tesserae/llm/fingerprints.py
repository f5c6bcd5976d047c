"""Document fingerprints by locally consistent parsing.

A text is a sequence of names. At each level runs of one name become one name; deterministic coin tossing then reduces the names to a handful of labels, each fixed by a few neighbours to the left, and a phrase begins at each local maximum of the labels. A phrase's name is a hash of the names in it. So equal substrings are cut into the same phrases apart from those near their ends, wherever they stand. Levels follow one another until the document is one phrase. The names from level 2 on, some ten characters long there and the whole text at the top, are its signatures; the fingerprint keeps the least of them in each of 64 bins.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FIRST_LEVEL = 64, 2
#: Characters that are parsed together.
PART_CHARS = 400_000
_MUL1, _MUL2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x ^= x >> np.uint64(27)
    x *= _MUL2
    return x ^ (x >> np.uint64(31))


def tossed(now: np.ndarray, first: np.ndarray, mark: int) -> np.ndarray:
    """Twice the lowest bit in which a label differs from the one before, plus that bit. At the start of a document the one before counts as mark, which no label equals."""
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[first] = mark
    x = now ^ before
    low = np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))
    return (low << np.uint8(1)) | ((now >> low.astype(now.dtype)) & now.dtype.type(1)).astype(np.uint8)


def parsed(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of phrases, and where each document's begin. first: where documents begin, each with a name at least."""
    new = np.empty(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    if not new.all():
        at = np.flatnonzero(new)
        lens = np.diff(at, append=len(names))
        first = np.searchsorted(at, first)
        names = names[at]
        long = lens > 1
        names[long] = mix(names[long] + lens[long].astype(np.uint64) * _STEP)
    labels = tossed(names, first, 0)
    labels = tossed(labels, first, 128)
    labels = tossed(labels, first, 16)
    peak = np.zeros(len(names), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], len(names)) - 1
    peak[last] = False
    second = first + 1
    peak[second[second < len(names)]] = False
    peak[first] = True
    at = np.flatnonzero(peak)
    lens = np.diff(at, append=len(names))
    place = np.arange(1, len(names) + 1, dtype=np.uint64) - np.repeat(at, lens).astype(np.uint64)
    return mix(np.add.reduceat(mix(names + place * _STEP), at) + _STEP), np.searchsorted(at, first)


def sketches(texts: list[str]) -> np.ndarray:
    """The fingerprints as rows of BINS 16-bit numbers, 0 for an empty bin; an empty text has only those."""
    out = np.zeros((len(texts), BINS), np.uint16)
    rows = np.array([i for i, t in enumerate(texts) if t], int)
    if not len(rows):
        return out
    lens = np.array([len(texts[i]) for i in rows])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, first = mix((codes.astype(np.uint64) + np.uint64(1)) * _STEP), np.cumsum(lens) - lens
    least = np.full(len(rows) * BINS, np.uint64(2**64 - 1))
    live, level = np.arange(len(rows)), 0  # documents that are more than one phrase
    while len(live):
        names, first = parsed(names, first)
        level += 1
        count = np.diff(first, append=len(names))
        # a document's last name counts on whatever level it comes
        used = np.repeat((count == 1) | (level >= FIRST_LEVEL), count)
        doc, value = np.repeat(live, count)[used], mix(names[used] + np.uint64(level))
        np.minimum.at(least, doc * BINS + (value & np.uint64(BINS - 1)).astype(np.int64), value >> np.uint64(6))
        more = count > 1
        names, live, count = names[np.repeat(more, count)], live[more], count[more]
        first = np.cumsum(count) - count
    kept = (mix(least) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    out[rows] = np.where(least < np.uint64(2**58), kept, 0).astype(np.uint16).reshape(len(rows), BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of signatures that two documents have in common (twice the common over the sum): 1 for equal fingerprints, also for two empty ones."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.where(used == 0, 1.0, 2 * same / np.maximum(used + same, 1))


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the next document's first."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of doc_id, one to a partition and in order, each followed by the first document of the next range (halo true); after the last comes the first of all.

    The range borders are approximate quantiles, so ranges are of like size whatever the ids; only borders and each range's least place, two numbers a partition, reach the driver. Null ids stand after all others; rows of one id, or without one, are ordered by a hash of the text, and where they are many also dealt into ranges by it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(2**63 - 1)))
    # a place in an id: negative with an id, not negative without one
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), half).otherwise(-1 - half))
    quantiles = [min(int(x), 2**63 - 1) for x in rows.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    borders = []
    for key, n in Counter(quantiles).items():  # an id that fills several ranges is cut by place
        step = 2**63 // n
        borders += [(key, -(2**63) + k * step) for k in range(n)] if key < 2**63 - 1 else [(key, -(2**63)), *((key, k * step) for k in range(n))]
    borders = sorted(set(borders))

    def found(border: list[tuple[int, int]], key, place):
        """How many borders are at most (key, place), by bisection."""
        if not border:
            return F.lit(0)
        steps = [2**i for i in reversed(range(len(border).bit_length()))]
        keys, places = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*border, strict=True))
        upto = lambda i: (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(places, i) <= place))
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(border)) & upto(at + s - 1), at + s).otherwise(at))

    key, place = F.col("key"), F.col("place")
    least = sorted((r["x"]["key"], r["x"]["place"]) for r in rows.groupBy(found(borders, key, place).alias("range")).agg(F.min(F.struct("key", "place")).alias("x")).collect())
    n = max(1, len(least))
    rows = rows.withColumn("range", F.greatest(F.lit(0), found(least, key, place) - 1))
    keys, places = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*(least or [(0, 0)]), strict=True))
    leads = (F.get(keys, F.col("range")) == key) & (F.get(places, F.col("range")) == place)
    halo = F.when(leads, F.array(F.col("range"), F.lit(-1) - F.pmod(F.col("range") - 1, F.lit(n)))).otherwise(F.array("range"))
    rows = rows.withColumn("to", F.explode(halo))
    rows = rows.select("doc_id", "text", "key", "place", (F.col("to") < 0).alias("halo"), F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).cast("int").alias("to"))
    return rows.repartitionById(n, F.col("to")).sortWithinPartitions("halo", "key", "place").select("doc_id", "halo", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id and text; other columns are ignored. One row for each row; a null text counts as empty and has the empty fingerprint, which is like itself (1) and nothing else (0). Documents that repeat a doc_id follow one another in an order fixed by their texts; null ids come last. A single document is its own next one.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def part(ids: list, texts: list[str], held: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        """texts: one more than ids, the last being the next document; held: the first text's fingerprint, if known."""
        own = sketches(texts if held is None else texts[1:])
        if held is not None:
            own = np.concatenate([held, own])
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        other = sketches(changed)
        code = lambda m: [r.tobytes().hex() for r in m.astype(">u2")]
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(code(own[:-1])), pa.array(code(other)), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))]
        return pa.RecordBatch.from_arrays(columns, names), own[-1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, chars, ended = None, 0, False
        for batch in batches:
            for i, halo, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if ended:
                    break
                ended = halo.as_py()
                text = text.as_py()
                texts.append(text)
                chars += len(text)
                if ended or chars >= PART_CHARS and len(ids):
                    if ids:
                        out, held = part(ids, texts, held)
                        yield out
                    ids, texts, chars = [], texts[-1:], len(text)
                if not ended:
                    ids.append(i)

    return dealt(docs).mapInArrow(run, schema)
