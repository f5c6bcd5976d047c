"""Embedding near-dedup by NN-descent.

A graph of each vector's nearest neighbours begins with random-projection leaves and is refined by joining neighbours of neighbours until few lists change. Links over the threshold make components. Lists then hold the nearest vectors of the own component and, apart from them, the nearest of other components, so however dense a group is, it never keeps a link to another one out; components are merged until no link between two is found. The number of links of a vector is then exact for its component without any pair being written: in a component of more than a block, the members so near its centre that any two of them are linked are only counted; the similarities of all others are computed block by block. An audit holds a sample of vectors against all others; while it finds too few of a vector's links in common components, more leaves are added and the graph is refined again, and if that does not help, all vectors are compared block by block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import components, saved

#: Neighbours of a list, of the own component and of others each; reversed ones; trees at first; vectors of a leaf and of a block; sampled vectors and the recall that the audit asks for.
NEIGHBOURS, WIDE, TREES, LEAF, BLOCK, AUDITED, RECALL = 8, 32, 10, 128, 512, 256, 0.99
#: Members that stand for a component in a tree of representatives (others in each tree), and such trees a pass.
MEMBERS, MEMBER_TREES = 8, 4
ROUNDS, EXTRA = 4, 3
#: Vectors of a block where all are compared.
WHOLE_BLOCK = 2048


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, in double precision."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best(edges: DataFrame) -> DataFrame:
    """Edges by rank in their lists, a list being of a node's own component or of others. edges: u, v, sim, fresh, own; of equal ones the older stays."""
    one = edges.groupBy("u", "v", "own").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u", "own").orderBy(F.col("sim").desc(), "v"))
    return one.withColumn("rank", rank)


def leaves(nodes: DataFrame, first: int, trees: int) -> DataFrame:
    """Edges from random-projection leaves: for each tree vectors are sorted by the signs of random projections and cut into runs of LEAF; in a run each vector gets its most similar ones of its component (nodes: node, component, vec) and of others."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = nodes.schema["vec"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                node, comp, vec = (batch.column(i).take(pa.array(at)) for i in range(3))
                x = units(vec)
                for t in range(first, first + trees):
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([t, int(dim)]).standard_normal((int(dim), 32))
                    bits = x @ planes[t, dim] > 0
                    codes = (bits * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(codes), node, comp, vec], ["tree", "dim", "code", "node", "component", "vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def join(part: pa.Table) -> pa.RecordBatch:
            node, comp, x = part.column(3).to_numpy(), part.column(4).to_numpy(), units(part.column(5).combine_chunks())
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            k = min(NEIGHBOURS, len(node) - 1)
            alike = comp[:, None] == comp[None, :]
            us, vs, ss, os = [], [], [], []
            for own in (False, True):
                of = np.where(alike == own, sim, -2)
                top = np.argpartition(-of, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(of, top, 1)
                i, j = np.nonzero(best > -2)
                us.append(node[i])
                vs.append(node[top[i, j]])
                ss.append(best[i, j])
                os.append(np.full(len(i), own))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ss, os)], ["u", "v", "sim", "own"])

        def cut(table: pa.Table, whole: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            key = table.column(0).to_numpy().astype(np.int64) << 32 | table.column(1).to_numpy()
            begins = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key))
            out, at = [], 0
            for a, z in zip(begins[:-1], begins[1:], strict=True):
                last = z == len(key) and not whole
                for at in range(a, z, LEAF):
                    if last and z - at < 2 * LEAF:
                        return out, table.slice(at)
                    if (n := min(LEAF, z - at)) > 1:
                        out.append(join(table.slice(at, n)))
            return out, table.slice(len(key))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4 * LEAF:
                    out, rest = cut(pa.Table.from_batches(held), False)
                    held = rest.to_batches()
                    yield from out
        if held:
            yield from cut(pa.Table.from_batches(held), True)[0]

    coded = nodes.select("node", "component", "vec").mapInArrow(code, f"tree int, dim int, code bigint, node bigint, component bigint, vec {kind}")
    dealt = coded.repartitionByRange(parts, "tree", "dim", "code", "node").sortWithinPartitions("tree", "dim", "code", "node")
    return dealt.mapInArrow(near, "u bigint, v bigint, sim double, own boolean").withColumn("fresh", F.lit(True))


def kept(edges: DataFrame) -> DataFrame:
    return best(edges).where(F.col("rank") <= NEIGHBOURS)


def neighbours_of_neighbours(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between members of one list or reversed list, at least one of them new to it, that would enter a list."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = Window.partitionBy("v").orderBy(F.col("sim").desc(), "u")
    reverse = graph.withColumn("back", F.row_number().over(back)).where(F.col("back") <= WIDE).select(F.col("v").alias("at"), F.col("u").alias("member"), "fresh")
    members = graph.select(F.col("u").alias("at"), F.col("v").alias("member"), "fresh").unionByName(reverse).groupBy("at", "member").agg(F.max("fresh").alias("fresh"))
    live = members.where("fresh").select(F.col("at").alias("live")).distinct()
    # the least similarity of each of the two lists, where the list is full
    least = lambda own: F.when(F.count(F.when(own, 1)) >= NEIGHBOURS, F.min(F.when(own, F.col("sim")))).otherwise(F.lit(-2.0))
    worst = graph.groupBy("u").agg(least(F.col("own")).alias("w_own"), least(~F.col("own")).alias("w_other"))
    state = nodes.join(worst, F.col("node") == F.col("u"), "left").select("node", "component", "vec", F.coalesce("w_own", F.lit(-2.0)).alias("w_own"), F.coalesce("w_other", F.lit(-2.0)).alias("w_other"))
    rows = members.join(live, F.col("at") == F.col("live"), "left_semi").join(state, F.col("member") == F.col("node")).select("at", "node", "fresh", "w_own", "vec", "component", "w_other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            fresh, w_own = table.column(2).to_numpy(), table.column(3).to_numpy()
            comp, w_other = table.column(5).to_numpy(), table.column(6).to_numpy()
            x = units(table.column(4).combine_chunks()) if len(set(np.diff(table.column(4).combine_chunks().offsets.to_numpy()))) == 1 else None
            begins = np.append(np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at))
            us, vs, ss, os = [], [], [], []
            for a, z in zip(begins[:-1], begins[1:], strict=True):
                if z - a < 2:
                    continue
                y = x[a:z] if x is not None else units(table.column(4).slice(a, z - a).combine_chunks())
                sim = y @ y.T
                own = comp[a:z, None] == comp[None, a:z]
                ok = (fresh[a:z, None] | fresh[None, a:z]) & (sim > np.where(own, w_own[a:z, None], w_other[a:z, None]))
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                us.append(node[a + i])
                vs.append(node[a + j])
                ss.append(sim[i, j])
                os.append(own[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ss, os)], ["u", "v", "sim", "own"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            at = table.column(0).to_numpy()
            last = int(np.searchsorted(at, at[-1], side="left"))
            if last:
                yield from pairs(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from pairs(held)

    dealt = rows.repartition(parts, "at").sortWithinPartitions("at")
    return dealt.mapInArrow(run, "u bigint, v bigint, sim double, own boolean").withColumn("fresh", F.lit(True))


def refined(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Refine until under one list in fifty changes."""
    n = nodes.count()
    graph = saved(kept(edges), "graph")
    for _ in range(rounds):
        new = neighbours_of_neighbours(graph, nodes)
        graph = saved(kept(graph.select("u", "v", "sim", F.lit(False).alias("fresh"), "own").unionByName(new)), "graph")
        if graph.where("fresh").agg(F.count_distinct("u")).first()[0] <= n / 50:
            break
    return graph


def placed(nodes: DataFrame, of: DataFrame | None) -> DataFrame:
    """nodes with their component; one without a link is its own. of: node, component."""
    if of is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(of.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").drop("k").withColumn("component", F.coalesce("component", "node"))


def representatives(nodes: DataFrame, tree: int) -> DataFrame:
    """MEMBERS of each component, by a hash that differs from tree to tree. Their count is a partial minimum, so a large component stays spread out."""
    slot = F.pmod(F.xxhash64("node", F.lit(tree)), F.lit(MEMBERS))
    chosen = nodes.groupBy("component", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(tree), F.lit(1)).alias("h"), F.col("node").alias("k"))).alias("x"))
    return nodes.join(chosen.select(F.col("x.k").alias("k")), F.col("node") == F.col("k"), "left_semi")


def merged(of: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) of those already found and of links (u, v)."""
    pairs = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if of is not None:
        pairs = pairs.unionByName(of.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return saved(components(pairs), "components")


def linked(nodes: DataFrame, of: DataFrame | None, edges: DataFrame | None, first: int, trees: int, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """Components, the graph's edges (u, v, sim) and the next tree: leaves of so many trees are refined, and as long as that links components, the lists are dealt anew by component and refined again, with trees of representatives."""
    while True:
        now = saved(placed(nodes, of), "placed")
        new = leaves(now, first, trees) if trees else None
        first += trees
        if of is not None:
            for _ in range(MEMBER_TREES):
                some = leaves(representatives(now, first), first, 1)
                new = some if new is None else new.unionByName(some)
                first += 1
        if edges is not None:
            comp = now.select(F.col("node").alias("n"), "component")
            old = edges.join(comp.select(F.col("n").alias("u"), F.col("component").alias("cu")), "u").join(comp.select(F.col("n").alias("v"), F.col("component").alias("cv")), "v")
            new = new.unionByName(old.select("u", "v", "sim", F.lit(False).alias("fresh"), (F.col("cu") == F.col("cv")).alias("own")))
        graph = refined(new, now)
        edges = graph.select("u", "v", "sim")
        links = graph.where((F.col("sim") >= threshold) & ~F.col("own"))
        if of is not None and links.isEmpty():
            return of, edges, first
        # the first pass knows no components: the next one gives the lists of others a whole set of leaves
        trees = trees if of is None else 0
        of = merged(of, links)


def recall(nodes: DataFrame, of: DataFrame, threshold: float, queries: int = AUDITED) -> float:
    """Share of a vector's links that lie within its component, the mean of sampled vectors with links (the lowest by a hash), so that a large group counts no more than its vectors. of: node, component. The sample is compared with all vectors in blocks, and only counts are passed on."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(queries).select("node", "vec").collect()
    rows = nodes.select("node", "vec").join(of.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("component"), "vec")
    wanted = [r["node"] for r in sample]
    component = {r["node"]: r["component"] for r in rows.where(F.col("node").isin(wanted)).select("node", "component").collect()}
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vec"]), []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, same = Counter(), Counter()
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for dim, some in by_dim.items():
                at = np.flatnonzero(dims == dim)
                if not len(at):
                    continue
                q, of = units(pa.array([r["vec"] for r in some], pa.list_(pa.float64()))), [r["node"] for r in some]
                node, comp = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
                hit = (q @ units(batch.column(2).take(pa.array(at))).T >= threshold) & (np.array(of)[:, None] != node)
                inside = hit & (np.array([component[n] for n in of])[:, None] == comp)
                total.update(dict(zip(of, hit.sum(1).tolist(), strict=True)))
                same.update(dict(zip(of, inside.sum(1).tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64()), pa.array([same[n] for n in total], pa.int64())], ["node", "total", "same"])

    one = rows.mapInArrow(run, "node bigint, total bigint, same bigint").groupBy("node").agg(F.sum("total").alias("total"), F.sum("same").alias("same"))
    got = one.where("total > 0").agg(F.avg(F.col("same") / F.col("total"))).first()[0]
    return 1.0 if got is None else got


def compared(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between components, u and v being the components, from all vectors by products of blocks. Of each product only as many links are passed on as join its components; nodes: node, component, vec."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.withColumn("dim", F.size("vec"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / WHOLE_BLOCK).cast("int").alias("blocks")).withColumnRenamed("dim", "d")
    rows = rows.join(F.broadcast(sizes), F.col("dim") == F.col("d"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("dim", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") > F.col("other")).alias("side"), (F.col("block") == F.col("other")).alias("own"), "component", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells, side, own, comp = (table.column(i).to_numpy() for i in range(4))
            begins = np.append(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), len(cells))
            for a, z in zip(begins[:-1], begins[1:], strict=True):
                x, c = units(table.column(4).slice(a, z - a).combine_chunks()), comp[a:z]
                left = np.ones(z - a, bool) if own[a] else ~side[a:z]
                right = left if own[a] else side[a:z]
                i, j = np.nonzero((x[left] @ x[right].T >= threshold) & (c[left][:, None] != c[right]))
                up: dict[int, int] = {}

                def root(k: int) -> int:
                    while up.setdefault(k, k) != k:
                        up[k] = k = up[up[k]]
                    return k

                us, vs = [], []
                for u, v in np.unique(np.stack([c[left][i], c[right][j]], 1), axis=0).tolist():
                    if root(u) != root(v):
                        up[root(u)] = root(v)
                        us.append(u)
                        vs.append(v)
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            cells = table.column(0).to_numpy()
            last = int(np.searchsorted(cells, cells[-1], side="left"))
            if last:
                yield from links(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from links(held)

    dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def centres(rows: DataFrame) -> DataFrame:
    """of (a component) and centre (the sum of its unit vectors). rows: component, vec. Each task adds up what it has, so a large component sends a vector from each task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch_of(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["of", "centre"])

    def add(batches: Iterator[pa.RecordBatch], unit: bool) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                comp, vec = batch.column(0).take(at).to_numpy(), batch.column(1).take(at)
                x = units(vec) if unit else vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = np.argsort(comp, kind="stable")
                begin = np.flatnonzero(np.diff(comp[order], prepend=comp[order[0]] - 1))
                for c, some in zip(comp[order][begin].tolist(), np.add.reduceat(x[order], begin), strict=True):
                    sums[c] = sums[c] + some if c in sums else some
            if unit and len(sums) > 1000:
                yield batch_of(sums)
                sums = {}
        if sums:
            yield batch_of(sums)

    partial = rows.select("component", "vec").mapInArrow(lambda b: add(b, True), "of bigint, centre array<double>")
    return partial.repartition(parts, "of").mapInArrow(lambda b: add(b, False), "of bigint, centre array<double>")


def cores(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (node, component, copies, vec) with core: whether a vector is within half the threshold's angle of its component's centre, so that any two such members are linked."""
    near = np.sqrt((1 + threshold) / 2) + 1e-9
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(3).offsets.to_numpy())
            for dim in np.unique(dims):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                c = some.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                length = np.sqrt((c * c).sum(1))
                core = (units(some.column(3)) * c).sum(1) >= near * length
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(core & (length > 0))], ["node", "component", "copies", "vec", "core"])

    joined = rows.join(centres(rows), F.col("component") == F.col("of")).select("node", "component", "copies", "vec", "centre")
    return joined.mapInArrow(run, f"node bigint, component bigint, copies bigint, vec {kind}, core boolean")


def counted(nodes: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """node and n: links of each node in its component, copies of the others counted. The members of a large component's core are linked to one another; for the rest it is cut into blocks, and every pair of blocks but those of the core is one product of matrices. Only counts leave a task."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = of.groupBy("component").agg((F.count(F.lit(1)) > BLOCK).alias("many")).withColumnRenamed("component", "c")
    rows = of.select(F.col("node").alias("k"), "component").join(many, F.col("component") == F.col("c")).join(nodes, F.col("k") == F.col("node"))
    rows = rows.select("node", "component", F.col("copies").cast("bigint").alias("copies"), "vec", "many")
    large = saved(cores(rows.where("many").drop("many"), threshold), "cores")
    rows = rows.where("not many").drop("many").withColumn("core", F.lit(False)).unionByName(large)
    sizes = rows.groupBy("component").agg(*[F.ceil(F.count(F.when(F.col("core") == core, 1)) / BLOCK).cast("int").alias(name) for name, core in (("inner", True), ("outer", False))]).withColumnRenamed("component", "c")
    rows = rows.join(sizes, F.col("component") == F.col("c"))
    # blocks of the core come after the others, and meet only those
    block = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.col("outer"))).cast("int")
    meets = F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    rows = rows.withColumn("block", block).withColumn("meets", meets).where("meets > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.xxhash64("component", low, high).alias("cell"), (F.col("block") > F.col("other")).alias("side"), (F.col("block") == F.col("other")).alias("own"), "node", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells, side = table.column(0).to_numpy(), table.column(1).to_numpy()
            own, node, copies = table.column(2).to_numpy(), table.column(3).to_numpy(), table.column(4).to_numpy()
            begins = np.append(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), len(cells))
            for a, z in zip(begins[:-1], begins[1:], strict=True):
                x = units(table.column(5).slice(a, z - a).combine_chunks())
                if own[a]:
                    hit = x @ x.T >= threshold
                    np.fill_diagonal(hit, False)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:z]), pa.array(hit @ copies[a:z])], ["node", "n"])
                else:
                    s = side[a:z]
                    hit = x[~s] @ x[s].T >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a:z][~s], node[a:z][s]])), pa.array(np.concatenate([hit @ copies[a:z][s], hit.T @ copies[a:z][~s]]))], ["node", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            cells = table.column(0).to_numpy()
            last = int(np.searchsorted(cells, cells[-1], side="left"))
            if last:
                yield from count(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from count(held)

    dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(run, "node bigint, n bigint")
    inside = large.where("core").groupBy("component").agg(F.sum("copies").alias("all")).withColumnRenamed("component", "c")
    inside = large.where("core").join(inside, F.col("component") == F.col("c")).select("node", (F.col("all") - F.col("copies")).alias("n"))
    return found.unionByName(inside).groupBy("node").agg(F.sum("n").alias("n"))


def deduplicated(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id = component_id) and audited_recall (the recall that the audit found, in every row; 1 where all vectors were compared).

    vectors: vec_id and embedding (array of float or double); other columns, label too, are ignored. One row for each row. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different dimensions; they are their own component. Equal vectors are one node of the graph and count as links of one another. Rows with a null id take no part: no links, no component, not kept. Rows that repeat an id are vectors of their own.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("node", F.when(usable(F.col("vec")) & F.col("vec_id").isNotNull(), F.xxhash64("vec")))
    nodes = saved(rows.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "vectors")
    of, edges, first = linked(nodes, None, None, 0, TREES, threshold)
    for extra in range(EXTRA):
        if (reached := recall(nodes, of, threshold)) >= RECALL:
            break
        of, edges, first = linked(nodes, of, edges, first, TREES * 2 ** (extra + 1), threshold)
    else:
        if (reached := recall(nodes, of, threshold)) < RECALL:
            of, reached = merged(of, compared(saved(placed(nodes, of), "placed"), threshold)), 1.0
    links = counted(nodes, of, threshold).withColumnRenamed("node", "l")
    named = nodes.select("node", "least", "copies").join(of.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").select("node", "least", "copies", F.coalesce("component", "node").alias("component"))
    named = saved(named.join(links, F.col("node") == F.col("l"), "left").select("node", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    named = named.join(smallest, F.col("component") == F.col("c")).select(F.col("node").alias("k"), "n_links", "component_id")
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("k"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("audited_recall", F.lit(float(reached)))
