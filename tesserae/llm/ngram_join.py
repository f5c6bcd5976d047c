"""N-gram Jaccard join with an R-tree over count vectors.

A document is the set of its distinct word shingles. Shingles are hashed into groups, and a document is the point of its groups' counts; two sets share at most the sum of their points' coordinate minima, so a subtree of an R-tree can be passed over when that sum with its box's upper corner is too low. Pairs that survive are verified exactly.

To spread this over a cluster without loss, documents are first routed by the contents of fine groups: sets within the similarity differ in at most r shingles, so of r + 1 groups at least one holds the same shingles in both. Documents that agree in a group share a cell; in each cell an R-tree finds the pairs whose bound reaches the similarity, and such pairs make clusters. Chance agreements, a common line alone in its group, fall to the bound; a cell that many unrelated documents share is routed again by other groups, until its parts are small. A cell's documents are compared with its first block of them before any others, and what is one group by then is not compared again. Each cluster, which by then holds little but real copies, is cut into leaves of bounded size, and pairs of leaves are joined through R-trees and verified. Only links that join two components leave a task, and leaves that are one component already are not compared again, so a group of thousands of near copies costs about its length, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import first_pairs, grouped, in_blocks, known_now, other_pairs, saved, undecided
from tesserae.llm.fingerprints import mix
from tesserae.llm.words import parts_of, shingles_of, words_of

#: Words in a shingle; similarity in hundredths; shingles that a coordinate counts on average, at most; children of a tree node; documents of a leaf; documents of a cell that one task compares.
SHINGLE, HUNDREDTHS, DENSITY, FANOUT, LEAF, BLOCK = 4, 85, 8, 16, 256, 512
#: Blocks up to which a cell that is not one group is compared block by block; a larger one is routed again, this often at most.
MANY_BLOCKS, REROUTES = 16, 3
#: Nodes of a route that a task holds; a longer route is one cell under its own name.
HELD = 100_000
BAND = 1.5


def sets_in(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are runs of other than ASCII white space, with A-Z lowered; fewer than width of them are one shingle."""
    words = words_of(texts)
    every = shingles_of(words.hashes, width) if len(words.hashes) >= width else np.zeros(0, np.uint64)
    out = []
    for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        s = every[a : z - width + 1] if z - a >= width else shingles_of(words.hashes[a:z], z - a) if z > a else words.hashes[:0]
        s = np.sort(s)
        if len(s) > 1:
            new = s[1:] != s[:-1]
            if not new.all():
                s = s[np.r_[True, new]]
        out.append(s)
    return out


def name_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s)), np.bitwise_xor.reduce(s * np.uint64(3))], np.uint64)).sum().view(np.int64)) if len(s) else 0


@lru_cache(4096)
def band_of(k: int, hundredths: int) -> tuple[int, int, int, int]:
    """Of size band k: its least size, the next band's, the groups that its sets are dealt into, and how many of them may be empty before the empty ones count as well."""
    low, high = math.ceil(BAND**k), math.ceil(BAND ** (k + 1))
    if high <= low:
        high = low + 1
    differ = 2 * (100 - hundredths) * (high - 1) // (100 + hundredths)
    if not differ:
        return low, high, 1, 0
    least = max(1.0, hundredths / 100 * low)
    best = (2.0, 0)
    for empty in range(3 + int(0.3 * (differ + 1))):
        m = differ + 1 + empty
        mean = m * math.exp(-least / m)
        tail = 1 - sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(empty + 1))
        best = min(best, (max(tail, 1e-5), empty))
        if tail < 1e-5:
            break
    return low, high, differ + 1 + best[1], best[1]


def band_index(n: int) -> int:
    k = max(0, int(math.log(n) / math.log(BAND)) - 2)
    while math.ceil(BAND ** (k + 1)) <= n:
        k += 1
    return k


def routes(s: np.ndarray, hundredths: int) -> np.ndarray:
    """Keys under which a set meets every set within the similarity: the contents of its groups, in its own size band and in the next where a partner may lie."""
    n, out = len(s), []
    if not n:
        return s
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s))])
    k = band_index(n)
    while True:
        low, _, m, empty = band_of(k, hundredths)
        if low > n and 100 * n < hundredths * low:
            break
        group = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        bounds = np.searchsorted(group, np.arange(m + 1, dtype=np.uint64))
        full = bounds[1:] > bounds[:-1]
        which = np.arange(m, dtype=np.uint64) + np.uint64(k << 32)
        keys = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(which + np.uint64(1)))
        out.append(keys if m - full.sum() > empty else keys[full])
        k += 1
    return np.concatenate(out)


class Tree:
    """A packed R-tree over count vectors. Points are sorted so that like ones share a node; a node keeps its box's upper corner, the least size below it, and the group of its points if they have but one."""

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], points.sum(1))) if len(points) else np.zeros(0, int)
        top = points[self.order]
        self.levels = [top]
        self.sizes = [top.sum(1)]
        while len(top) > 1:
            cuts = np.arange(0, len(top), FANOUT)
            self.sizes.append(np.minimum.reduceat(self.sizes[-1], cuts))
            top = np.maximum.reduceat(top, cuts)
            self.levels.append(top)


def survivors(a: Tree, b: Tree, hundredths: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each point of a the points of b whose summed coordinate minima reach the overlap that both sizes call for."""
    need = hundredths / (100 + hundredths)
    for i, point, n in zip(a.order, a.levels[0], a.sizes[0], strict=True):
        at = np.zeros(1, int)
        for depth in range(len(b.levels) - 1, -1, -1):
            if depth < len(b.levels) - 1:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(b.levels[depth])]
            bound = np.minimum(b.levels[depth][at], point).sum(1)
            at = at[bound >= need * (n + b.sizes[depth][at]) - 1e-9]
            if not len(at):
                break
        if len(at):
            yield int(i), b.order[at]


def point_of(s: np.ndarray) -> np.ndarray:
    """The counts of a set's groups: a power of two of them, so many that a coordinate counts DENSITY shingles on average and none over 255. The hashes' upper bits name the group, so halving the groups adds neighbours up."""
    bits = max(4, (len(s) // DENSITY).bit_length())
    while True:
        counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if len(s) <= 255 or counts.max() <= 255:
            return counts.astype(np.uint8)
        bits += 1


def points(raw: list[np.ndarray]) -> np.ndarray:
    """Points of one dimension, the least among them."""
    dim = min(len(p) for p in raw)
    return np.array([p.reshape(dim, -1).sum(1) for p in raw], np.int64)


class Groups:
    """Union-find over the rows of a task, begun with what is known."""

    def __init__(self, known: list):
        first: dict = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(known)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def joined(left: list[int], right: list[int], sets: list[np.ndarray], known: list, hundredths: int) -> list[tuple[int, int]]:
    """Links between rows left and right (or among left where right is empty) that join two groups."""
    every = points([point_of(s) for s in sets])
    groups, out = Groups(known), []
    other = right or left
    a, b = Tree(every[left]), Tree(every[other])
    for i, js in survivors(a, b, hundredths):
        i = left[i]
        for j in js:
            j = other[j]
            if (right or j > i) and groups.find(i) != groups.find(j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= hundredths * (len(sets[i]) + len(sets[j]) - common):
                    groups.join(i, j)
                    out.append((i, j))
    return out


def near_groups(left: list[int], right: list[int], raw: list[np.ndarray], known: list[int], hundredths: int) -> list[tuple[int, int]]:
    """Pairs of rows, as joined(), whose bound reaches the similarity; of those that join the same two groups one."""
    every, label, out = points(raw), np.unique(known, return_inverse=True)[1], []
    other = np.array(right or left)
    for i, js in survivors(Tree(every[left]), Tree(every[other]), hundredths):
        i, js = left[i], other[js]
        for j in js[np.unique(label[js], return_index=True)[1]]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, int(j)))
    return out


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (name of the shingle set) and point of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts_of(batch, 1):
                sets = sets_in(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([point_of(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], ["doc_id", "n_shingles", "node", "point"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, point binary")


def meetings(docs: DataFrame, width: int, hundredths: int) -> DataFrame:
    """(cell, node): nodes that share a route. A cell is named by its members, so those of several routes that hold the same nodes are one. A task sends each distinct set once, so a group of equal copies sends a row for each task, not for each copy."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, texts in parts_of(batch, 0):
                keys, nodes = [], []
                for s in sets_in(texts, width):
                    node = name_of(s)
                    if len(s) and node not in seen:
                        seen.add(node)
                        keys.append(routes(s, hundredths))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["route", "node"])

    return met(docs.select("text").mapInArrow(send, "route bigint, node bigint"))


def met(sent: DataFrame) -> DataFrame:
    """(cell, node) of (route, node): see meetings()."""
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cells(route: np.ndarray, node: np.ndarray, seen: set) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (route[1:] != route[:-1]) | (node[1:] != node[:-1])]
        route, node = route[new], node[new]
        begin = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
        size = np.diff(begin, append=len(route))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), begin) + size.astype(np.uint64)).view(np.int64)
        many = np.flatnonzero(size > 1)
        many = many[[not (c in seen or seen.add(c)) for c in name[many].tolist()]]
        if len(many):
            keep = np.zeros(len(size), bool)
            keep[many] = True
            rows = np.repeat(keep, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows]), pa.array(node[rows])], ["cell", "node"])
        if len(seen) > 1_000_000:
            seen.clear()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        long, seen = None, set()  # long: a route of which more than HELD nodes have come

        def under_own_name(node: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), mix(np.array([long], np.int64).view(np.uint64)).view(np.int64)[0])), pa.array(node)], ["cell", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            route, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if long is not None:
                n = int(np.searchsorted(route, long, side="right"))
                if n:
                    yield under_own_name(np.unique(node[:n]))
                route, node = route[n:], node[n:]
                if not len(route):
                    continue
                long = None
            last = int(np.searchsorted(route, route[-1], side="left"))
            if last or held and held[-1][0][-1] != route[0]:
                if last:
                    held.append((route[:last], node[:last]))
                if held:
                    yield from cells(np.concatenate([r for r, _ in held]), np.concatenate([n for _, n in held]), seen)
                held, route, node = [], route[last:], node[last:]
            held.append((route, node))
            if sum(len(r) for r, _ in held) > HELD:
                long = int(route[-1])
                yield under_own_name(np.unique(np.concatenate([n for _, n in held])))
                held = []
        if held:
            yield from cells(np.concatenate([r for r, _ in held]), np.concatenate([n for _, n in held]), seen)

    return sent.repartition(parts, "route").sortWithinPartitions("route", "node").mapInArrow(meet, "cell bigint, node bigint").distinct()


def rerouted(docs: DataFrame, cells: DataFrame, nodes: DataFrame, width: int, hundredths: int, seed: int) -> DataFrame:
    """(cell, node): nodes that share one of cells (cell, node) and a route by other groups as well. Sets within the similarity share a route whatever the groups, so no pair is lost; unrelated ones that met by chance part."""
    wanted = cells.select(F.col("node").alias("n")).distinct().join(nodes.select("k", "of"), F.col("n") == F.col("k")).select("of", "n")
    turn = mix(np.array([seed], np.uint64))[0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for at, texts in parts_of(batch, 0):
                for k, s in enumerate(sets_in(texts, width)):
                    if len(s) and name_of(s) == names[at + k]:
                        keys = routes(np.sort(mix(s ^ turn)), hundredths).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), names[at + k], np.int64))], ["by", "n"])

    sent = docs.join(wanted, F.col("doc_id") == F.col("of")).select("text", "n").mapInArrow(send, "by bigint, n bigint")
    return met(cells.join(sent, F.col("node") == F.col("n")).select(F.xxhash64("cell", "by").alias("route"), "node"))


def clustered(docs: DataFrame, cells: DataFrame, nodes: DataFrame, width: int, hundredths: int) -> DataFrame:
    """Components (node, component) of nodes that share a cell and whose bound reaches the similarity. cells: cell, node; nodes: k, of, point.

    First each node's most frequented cell is looked through: that connects most of a large group. Of the other cells only those whose nodes are not one group by then have anything to add.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("cell", "of")
    best = cells.join(sizes, F.col("cell") == F.col("of")).groupBy("node").agg(F.max(F.struct("n", "cell")).alias("best")).select(F.col("best.cell").alias("of")).distinct()
    chosen = cells.join(best, F.col("cell") == F.col("of"), "left_semi").withColumn("known", F.col("node"))
    groups = grouped(None, near_pairs(first_pairs(chosen, BLOCK), nodes, hundredths))
    for turn in range(REROUTES + 1):
        rest = saved(undecided(known_now(cells, groups)), "undecided")
        groups = grouped(groups, near_pairs(first_pairs(rest, BLOCK), nodes, hundredths))
        large = in_blocks(rest, BLOCK).where("blocks > 1")
        if large.isEmpty():
            break
        rest = saved(undecided(known_now(large, groups)), "undecided")
        limit = MANY_BLOCKS if turn < REROUTES else 2**31 - 1
        sized = in_blocks(rest, BLOCK)
        few, many = (sized.where(w).select("cell", "node", "known") for w in (F.col("blocks") <= limit, F.col("blocks") > limit))
        if not few.isEmpty():
            groups = grouped(groups, near_pairs(other_pairs(few, BLOCK), nodes, hundredths))
        if many.isEmpty():
            break
        cells = saved(rerouted(docs, many.select("cell", "node"), nodes, width, hundredths, turn + 1), "cells")
    return groups


def near_pairs(pairs: DataFrame, nodes: DataFrame, hundredths: int) -> DataFrame:
    """Of each pair of blocks (pair, node, side, known) the known groups (a, b) that nodes join whose bound reaches the similarity."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(nodes.select("k", "point"), F.col("node") == F.col("k")).select(F.col("pair").alias("cell"), "node", "side", "point", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, sent = None, [], set()

        def done():
            if len(rows) > 1:
                left, right = [i for i, r in enumerate(rows) if not r[1]], [i for i, r in enumerate(rows) if r[1]]
                found = {(rows[i][3], rows[j][3]) for i, j in near_groups(left, right, [np.frombuffer(r[2], np.uint8) for r in rows], [r[3] for r in rows], hundredths)} - sent if left else set()
                sent.update(found)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for c, *row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if c != cell:
                    yield from done()
                    cell, rows = c, []
                    if len(sent) > 1_000_000:
                        sent = set()
                rows.append(row)
        yield from done()

    return rows.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """k and set of the wanted nodes (of: doc_id, node): one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts_of(batch, 0):
                sets = sets_in(texts, width)
                # a document may repeat its id with other texts: only the wanted one's set counts
                same = pa.array([name_of(s) == n for s, n in zip(sets, batch.column(1).slice(at, len(texts)).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "set"]).filter(same)

    found = docs.join(wanted, F.col("doc_id") == F.col("of")).select("text", "node").mapInArrow(run, "k bigint, set binary")
    return found.groupBy("k").agg(F.first("set").alias("set"))


def compared(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Components so far (a, b) that links join in each pair of leaves (pair, node, side, known: component so far). sets: k, set."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = pairs.join(sets, F.col("node") == F.col("k")).select(F.col("pair").alias("cell"), "node", "side", "known", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done():
            if len(rows) > 1:
                sets = [np.frombuffer(r[3], np.uint64) for r in rows]
                left = [i for i, r in enumerate(rows) if not r[1]]
                right = [i for i, r in enumerate(rows) if r[1]]
                links = joined(left, right, sets, [r[2] for r in rows], hundredths)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i, _ in links], pa.int64()), pa.array([rows[j][2] for _, j in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for c, *row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if c != cell:
                    yield from done()
                    cell, rows = c, []
                rows.append(row)
        yield from done()

    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a bigint, b bigint")


def linked(docs: DataFrame, width: int = SHINGLE, hundredths: int = HUNDREDTHS) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links of this Jaccard similarity or more.

    docs: doc_id and text; other columns are ignored. One row for each row. A text with fewer words than a shingle is one shingle; a null, empty or blank one has none and links with nothing, not even with its like. Equal sets link. Rows with a null id link with nothing and have component_id null. Rows that repeat an id are compared each for itself.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = saved(described(docs, width), "nodes")
    docs = docs.where("doc_id is not null")
    one = rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("of"), F.first("point").alias("point")).withColumnRenamed("node", "k")
    cells = saved(meetings(docs, width, hundredths), "cells")
    clusters = clustered(docs, cells, one, width, hundredths)
    clusters = clusters.select(F.col("component").alias("cell"), "node")
    sets = saved(sets_of(docs, one.join(clusters, F.col("k") == F.col("node")).select("of", "node"), width), "sets")
    groups = grouped(None, compared(first_pairs(clusters.withColumn("known", F.col("node")), LEAF), sets, hundredths))
    # other leaves, and pairs of them, that are not one component by now
    large = in_blocks(clusters, LEAF).where("blocks > 1")
    if not large.isEmpty():
        rest = saved(undecided(known_now(large, groups)), "undecided")
        if not rest.isEmpty():
            groups = grouped(groups, compared(other_pairs(rest, LEAF), sets, hundredths))
    found = groups.withColumnRenamed("node", "k")
    named = one.drop("point").join(found.withColumnRenamed("k", "n"), F.col("k") == F.col("n"), "left").select("k", "of", F.coalesce("component", "k").alias("component"))
    named = saved(named, "named")
    least = named.groupBy("component").agg(F.min("of").alias("component_id")).withColumnRenamed("component", "c")
    ids = named.join(least, F.col("component") == F.col("c")).select("k", "component_id")
    out = rows.join(ids, F.col("node") == F.col("k"), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def representatives(docs: DataFrame, width: int = SHINGLE, hundredths: int = HUNDREDTHS) -> DataFrame:
    """docs without the documents that a lower doc_id is linked to, directly or through others. Rows with a null id, and texts without words, stay; of an id that repeats with different texts all rows go if one does, and of rows that agree in id and text one stays."""
    gone = linked(docs, width, hundredths).where("component_id <> doc_id").select(F.col("doc_id").alias("tess_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("tess_gone"), "left_anti").withColumn("tess_text", F.xxhash64("text"))
    # rows without an id are dealt by their text, and are not counted
    order = Window.partitionBy(F.coalesce("doc_id", "tess_text"), "tess_text").orderBy("tess_text")
    blank = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "", F.lit(True))
    return left.withColumn("tess_n", F.row_number().over(order)).where(F.col("doc_id").isNull() | blank | (F.col("tess_n") == 1)).drop("tess_n", "tess_text")
