"""Substring dedup by MinHash banding of overlapping paragraphs.

Texts are cut by their content: a word is a cut where its hash is the least of some sixteen consecutive words. A paragraph runs from a cut to the first cut that is at least 20 words on, so a passage that repeats is cut alike wherever it is pasted in, with or without punctuation. Paragraphs that collide in a band of their MinHash signatures over five-word shingles are candidates; equal ones need no check, of the others the exact Jaccard similarity is computed. Links join paragraphs into components; of each component the first place stays, and what the others cover is merged and reported for removal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import first_pairs, grouped, in_blocks, known_now, other_pairs, runs_of, saved, undecided
from tesserae.llm.fingerprints import mix
from tesserae.llm.words import parts_of, shingles_of, words_of

#: Words of a paragraph at least, of a shingle, and of the runs each of which has a cut; a passage of LEAST_WORDS + 3 * CUT_WORDS words that two texts share always holds a whole paragraph of both, and most shorter ones do.
LEAST_WORDS, SHINGLE, CUT_WORDS, SIMILARITY = 20, 5, 16, 0.8
#: Distinct texts of a band's bucket that one task compares; larger buckets are compared block by block, or if of more blocks than that and not one group, dealt by shingles first.
BLOCK, MANY_BLOCKS = 1024, 16
#: Texts of a pair of blocks that counts as small, and texts of small ones that are looked through at a time.
SMALL, TOGETHER = 16, 20_000


def tuned(similarity: float = SIMILARITY, recall: float = 0.95, most: int = 3) -> tuple[int, int]:
    """Bands and rows that find pairs of this similarity with this probability: the most rows, and so the fewest chance collisions, that so many bands allow; more bands if it takes them."""
    for bands in range(most, 1000):
        for rows in range(8, 0, -1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return next(b for b in range(1, bands + 1) if 1 - (1 - similarity**rows) ** b >= recall), rows
    raise ValueError("no banding reaches this recall")


def cuts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of words whose hash is the least of CUT_WORDS consecutive ones of their text (the last of equal ones); and where each text begins and ends."""
    n, k = len(hashes), CUT_WORDS
    bounds = np.unique(first)
    if n < k:
        return bounds
    values = mix(hashes + np.uint64(7)) & ~np.uint64(0xFFFF)
    # of equal hashes the last counts: the place from behind, within a run, breaks the tie
    least = np.lib.stride_tricks.sliding_window_view(values, k)[:, ::-1].argmin(1)
    at = np.arange(n - k + 1)
    text = np.searchsorted(first, at, side="right")
    whole = text == np.searchsorted(first, at + k - 1, side="right")
    return np.unique(np.concatenate([bounds, (at + k - 1 - least)[whole]]))


def paragraphs(texts: list[str]):
    """Of the texts' paragraphs: document index, first word, word after the last (counted in the document), hash; and the shingle hashes with each paragraph's span in them."""
    words = words_of(texts)
    begin, lens, n = words.first[:-1], np.diff(words.first), len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < SHINGLE:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    shingles = shingles_of(words.hashes, SHINGLE)
    ends = cuts(words.hashes, words.first)
    starts = ends[:-1]
    doc = np.searchsorted(begin + lens, starts, side="right")
    at = np.searchsorted(ends, starts + LEAST_WORDS)
    ok = at < len(ends)
    starts, doc, stops = starts[ok], doc[ok], ends[at[ok]]
    ok = stops <= (begin + lens)[doc]
    starts, doc, stops = starts[ok], doc[ok], stops[ok]
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(1)))])
    last = stops - SHINGLE + 1
    text_hash = mix((total[last] - total[starts]) ^ (stops - starts).astype(np.uint64))
    return doc, starts - begin[doc], stops - begin[doc], text_hash, shingles, starts, last


#: at: where a paragraph starts, its words and its flags in one number. Flags: 2 for a place known to repeat, 4 for a row of the first band.
KEYS = "band bigint, hash bigint, doc_id bigint, at bigint"
FOUND = "band bigint, hash bigint, doc_id bigint, start int, stop int, rival boolean"
LONE, FIRST = 2, 4


def placed(start: np.ndarray, stop: np.ndarray, flags: int) -> np.ndarray:
    return start.astype(np.int64) << 32 | (stop - start).astype(np.int64) << 8 | flags


def place_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = at >> 32
    return start, start + (at >> 8 & 0xFFFFFF)


def keyed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row for each paragraph and band: the band's key, the paragraph's hash and place.

    Where documents that are read together share a paragraph, it is known to repeat: its places go on as known, dealt at random, and one of them stands for all in the band. So what a frequent passage sends to its band is a row for each part of the input, not for each place.
    """

    names = [x.split(" ")[0] for x in KEYS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in parts_of(batch, 1):
                doc, start, stop, text_hash, shingles, a, z = paragraphs(texts)
                if not len(doc):
                    continue
                order = np.argsort(text_hash, kind="stable")
                same = np.flatnonzero(np.r_[True, text_hash[order][1:] != text_hash[order][:-1]])
                apart = np.minimum.reduceat(doc[order], same) != np.maximum.reduceat(doc[order], same)
                several = np.zeros(len(doc), bool)
                several[order] = np.repeat(apart, np.diff(same, append=len(doc)))
                stands = ~several
                stands[order[same]] = True
                spans = np.stack([a, z], 1).ravel()
                padded = np.append(shingles, np.uint64(2**64 - 1))
                text_hash = text_hash.view(np.int64)
                for b in range(bands):
                    key = np.full(len(doc), b, np.uint64)
                    for r in range(rows):
                        seed = mix(np.array([b * rows + r + 1], np.uint64))[0]
                        key = mix(key ^ np.minimum.reduceat(mix(padded ^ seed), spans)[::2]) + np.uint64(b)
                    out = [key.view(np.int64)[stands], text_hash[stands], ids[at + doc][stands], placed(start, stop, FIRST * (b == 0))[stands]]
                    if b == 0:
                        own = mix(key[several] ^ mix(doc[several].astype(np.uint64) + text_hash[several].view(np.uint64))).view(np.int64)
                        lone = [own, text_hash[several], ids[at + doc][several], placed(start, stop, LONE)[several]]
                        out = [np.concatenate(x) for x in zip(out, lone, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return docs.select("doc_id", "text").mapInArrow(run, KEYS)


def shared(keys: DataFrame) -> DataFrame:
    """What the bands show: places of paragraphs that repeat word for word (rival false; from the first band, where equal ones meet, and those known before), and of each band with different texts one place of each (rival true).

    Texts whose first places all overlap in one document are no rivals: neighbours are alike of themselves.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        band, text, doc, at = (table.column(i).to_numpy() for i in range(4))
        start, stop = place_of(at)
        begin = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (text[1:] != text[:-1])])
        size = np.diff(begin, append=len(band))
        place = ((at & FIRST) > 0) & np.repeat(size > 1, size) | ((at & LONE) > 0)

        def out(rows: np.ndarray, rival: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(x[rows]) for x in (band, text, doc)], pa.array(start[rows].astype(np.int32)), pa.array(stop[rows].astype(np.int32)), pa.array(np.full(len(band[rows]), rival))], ["band", "hash", "doc_id", "start", "stop", "rival"])

        if place.any():
            yield out(place, False)
        # the first place of each text, band by band
        bucket = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        of = np.searchsorted(bucket, begin, side="right") - 1
        texts_at = np.searchsorted(begin, bucket)
        apart = np.minimum.reduceat(doc[begin], texts_at) != np.maximum.reduceat(doc[begin], texts_at)
        apart |= np.maximum.reduceat(start[begin], texts_at) >= np.minimum.reduceat(stop[begin], texts_at)
        texts = np.bincount(of, minlength=len(bucket))
        rivals = begin[(apart & (texts > 1))[of]]
        if len(rivals):
            yield out(rivals, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            band = table.column(0).to_numpy()
            last = int(np.flatnonzero(np.r_[True, band[1:] != band[:-1]])[-1])
            if last:
                yield from emit(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from emit(held)

    return keys.repartition(parts, "band").sortWithinPartitions("band", "hash", "doc_id", "at").mapInArrow(run, FOUND)


def verified(texts: DataFrame, rivals: DataFrame, similarity: float) -> DataFrame:
    """Components (node, component) of different paragraph texts that share a band and have this Jaccard similarity or more, and whose first places do not overlap in one document.

    texts: hash, set (shingle hashes, sorted) and the first place (doc_id, start, stop); rivals: band and hash, distinct. A bucket's blocks are compared with the first one, then those that are not one group by now with one another. A larger bucket of many groups is dealt anew by shingles: texts within the similarity share one of the few that come first in an order common to all.
    """
    cells = rivals.select(F.col("band").alias("cell"), F.col("hash").alias("node"))
    alone = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cell").alias("of"))
    cells = cells.join(alone, F.col("cell") == F.col("of"), "left_semi").withColumn("known", F.col("node"))
    groups = grouped(None, compared(texts, first_pairs(cells, BLOCK), similarity))
    large = in_blocks(cells, BLOCK).where("blocks > 1")
    if large.isEmpty():
        return groups
    rest = in_blocks(saved(undecided(known_now(large, groups)), "undecided"), BLOCK)
    few, many = (rest.where(w).select("cell", "node", "known") for w in (F.col("blocks") <= MANY_BLOCKS, F.col("blocks") > MANY_BLOCKS))
    if not few.isEmpty():
        groups = grouped(groups, compared(texts, other_pairs(few, BLOCK), similarity))
    if many.isEmpty():
        return groups
    dealt = saved(by_shingles(texts, known_now(many, groups), similarity), "dealt")
    groups = grouped(groups, compared(texts, first_pairs(dealt, BLOCK), similarity))
    rest = saved(undecided(known_now(dealt, groups)), "undecided")
    return groups if rest.isEmpty() else grouped(groups, compared(texts, other_pairs(rest, BLOCK), similarity))


def by_shingles(texts: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """cells (cell, node, known), cut by each of a text's first shingles in the order of their hashes: of n so many that a set without any of them shares too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(3)):
                s = np.frombuffer(raw.as_py(), np.uint64)
                first = s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                keys = mix(first ^ mix(batch.column(0).slice(i, 1).to_numpy().view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.full(len(keys), batch.column(c)[i].as_py(), np.int64)) for c in (1, 2)]], ["cell", "node", "known"])

    rows = cells.join(texts, F.col("node") == F.col("hash")).select("cell", "node", "known", "set")
    return rows.mapInArrow(run, "cell bigint, node bigint, known bigint")


def pairs_in(cell: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of one cell whose sets share elements, and how many; cells are small."""
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    key = np.concatenate(sets) ^ mix(cell.view(np.uint64))[of]
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    codes, d = [], 1
    while d < len(key) and (same := key[:-d] == key[d:]).any():
        codes.append(of[:-d][same] * len(sets) + of[d:][same])
        d += 1
    pair, common = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pair // len(sets), pair % len(sets), common


def pairs_of(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a large cell how many elements its set shares with every later one's, by an index of the elements."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.lexsort((of, flat))
    flat, of = flat[order], of[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(flat)))
    back, bounds, at = np.argsort(of, kind="stable"), np.append(first, len(flat)), 0
    for i in range(n):
        common = np.zeros(n, np.int64)
        for k in back[at : at + sizes[i]]:
            common[of[k + 1 : bounds[run[k] + 1]]] += 1
        at += sizes[i]
        yield i, common


def compared(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Known groups (a, b) that links join in each pair of blocks (pair, node, side, known). Small pairs are looked through many at a time."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(texts, F.col("node") == F.col("hash")).select(F.col("pair").alias("cell"), "hash", "side", "known", "doc_id", "start", "stop", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def alike(cols: list[np.ndarray], sizes: np.ndarray, i, j, common, own):
            side, doc, start, stop = cols
            ok = (own | (side[i] != side[j])) & (common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9)
            return ok & ~((doc[i] == doc[j]) & (start[i] < stop[j]) & (start[j] < stop[i]))

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, _, side, known, doc, start, stop = (table.column(c).to_numpy() for c in range(7))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column(7)]
            sizes = np.array([len(s) for s in sets])
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            count = np.diff(begin, append=len(cell))
            own = ~np.logical_or.reduceat(side, begin)
            a, b = [], []
            small = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL), count))
            if len(small):
                i, j, common = pairs_in(cell[small], [sets[k] for k in small])
                i, j = small[i], small[j]
                ok = alike([side, doc, start, stop], sizes, i, j, common, np.repeat(own, count)[i])
                ok &= known[i] != known[j]
                a, b = known[i[ok]].tolist(), known[j[ok]].tolist()
            for k in np.flatnonzero(count > SMALL):
                rows = slice(begin[k], begin[k] + count[k])
                cols, some, first = [x[rows] for x in (side, doc, start, stop)], sizes[rows], {}
                group = [first.setdefault(g, i) for i, g in enumerate(known[rows].tolist())]

                def find(i: int) -> int:
                    while group[i] != i:
                        group[i] = group[group[i]]
                        i = group[i]
                    return i

                for i, common in pairs_of(sets[rows]):
                    near = np.flatnonzero(common >= similarity / (1 + similarity) * (some + some[i]) - 1e-9)
                    for j in near[alike(cols, some, i, near, common[near], own[k])].tolist():
                        if (x := find(i)) != (y := find(j)):
                            group[x] = y
                            a.append(int(known[rows][i]))
                            b.append(int(known[rows][j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for table in runs_of(batches):
            held.append(table)
            if sum(t.num_rows for t in held) >= TOGETHER:
                yield from links(pa.concat_tables(held).combine_chunks())
                held = []
        if held:
            yield from links(pa.concat_tables(held).combine_chunks())

    return rows.repartition(parts, "cell").sortWithinPartitions("cell", "hash").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash and set of each paragraph wanted (hash, doc_id, start, stop)."""
    spans = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "start", "stop")).alias("spans")).withColumnRenamed("doc_id", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(1)
            for at, texts in parts_of(batch, 0):
                _, _, _, text_hash, shingles, a, z = paragraphs(texts)
                want = {s["hash"] for i in range(len(texts)) for s in spans_of[at + i].as_py()}
                rows = {int(h): k for k, h in enumerate(text_hash.view(np.int64).tolist()) if h in want}
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([np.unique(shingles[a[k] : z[k]]).tobytes() for k in rows.values()], pa.binary())], ["hash", "set"])

    found = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("of")).select("text", "spans").mapInArrow(run, "hash bigint, set binary")
    return found.groupBy("hash").agg(F.min("set").alias("set"))


def repeated(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.95) -> DataFrame:
    """Passages that repeat: doc_id, start and stop (words between white space, counted from 0), of_doc_id (where the first of them stands) and n_words.

    docs: doc_id and text; other columns are ignored. A document's passages that overlap and repeat passages of one document are merged. Null texts, and texts with under 20 words, have no paragraphs; rows with a null id are left out, since a passage is told by its document; rows repeated in full are one document. First means lowest doc_id, then lowest position. A place is removed only if the first one is in another document or ends before it. Paragraphs whose first places overlap in one document do not link.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    bands, rows = tuned(similarity, recall)
    found = saved(shared(keyed(docs, bands, rows)), "bands")
    rivals = found.where("rival")
    one = rivals.groupBy("hash").agg(F.min(F.struct("doc_id", "start", "stop")).alias("p")).select("hash", "p.*")
    sets = shingle_sets(docs, one).withColumnRenamed("hash", "of").join(one, F.col("of") == F.col("hash")).select("hash", "set", "doc_id", "start", "stop")
    of = verified(saved(sets, "sets"), rivals.select("band", "hash"), similarity).withColumnRenamed("node", "of")
    places = found.where("not rival").select("hash", "doc_id", "start", "stop")
    linked = one.join(of, F.col("hash") == F.col("of"), "left_semi")
    places = places.unionByName(linked)
    place: Column = F.struct("doc_id", "start", "stop")
    texts = places.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    texts = texts.join(of, F.col("hash") == F.col("of"), "left").select("hash", "a", "z", F.coalesce("component", "hash").alias("component"))
    texts = saved(texts, "texts")
    first = texts.groupBy("component").agg(F.min("a").alias("first"), F.max("z").alias("last")).where("first <> last").select(F.col("component").alias("c"), "first")
    firsts = texts.join(first, F.col("component") == F.col("c")).select(F.col("hash").alias("of"), F.col("first.doc_id").alias("of_doc_id"), F.col("first.stop").alias("of_stop"))
    later = places.join(firsts, F.col("hash") == F.col("of")).where("doc_id <> of_doc_id or start >= of_stop")
    spans = later.groupBy("doc_id", "of_doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start: int, stop: int>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(out, F.array(s))),
    )
    return spans.select("doc_id", "of_doc_id", F.explode(merged).alias("s")).select("doc_id", "s.start", "s.stop", "of_doc_id", (F.col("s.stop") - F.col("s.start")).alias("n_words"))
