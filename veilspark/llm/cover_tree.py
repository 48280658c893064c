"""Exact cosine near-duplicates of embeddings by dual traversal of cover trees.

On unit vectors cosine >= c is chord distance <= sqrt(2 - 2c) =: e.  The upper levels of the tree are a net
over a bounded sample (farthest-first, so every prefix of it is a level and their radii fall); each vector goes to its
nearest node, and a node's covering radius is the largest distance in it, taken over all vectors.  Nodes of more than ``capacity``
vectors are dealt in parts, *cells*.  A vector visits a later cell only if something in it can be within e: its distance to that
node's centre is at most the covering radius plus e, and its distance to the hyperplane between both centres at most e
(all of the other node lies beyond it).  In a cell the lower levels (radii halve, or the fan-out limit is reached) are built and
both trees, of residents and of a batch of visitors, are walked together.  A pair of nodes is dropped, counted whole when even its
farthest points link, or opened; leaves are compared by matrix products in double precision.

So vectors in groups that are further apart than their radii and e visit few cells, however many there are.  Vectors without such
groups (independent ones in many dimensions are all about sqrt(2) apart) visit most later cells: no bound on distances can tell
them apart, and the work is that of all pairs.

Bitwise equal vectors are one class with a count.  A task returns, for each vector, its number of links and
the smallest vector of its local component, never the pairs themselves; it holds a cell and a batch of visitors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, bounded_batches
from .shingles import mix

_SLACK = 1e-9


def farthest_first(x: np.ndarray, count: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of up to ``count`` centres, each the point farthest from those before, until all are within ``radius``; and each point's nearest centre."""
    chosen = [0]
    best = np.linalg.norm(x - x[0], axis=1)
    owner = np.zeros(len(x), dtype=np.int64)
    while len(chosen) < count:
        i = int(np.argmax(best))
        if best[i] <= radius:
            break
        d = np.linalg.norm(x - x[i], axis=1)
        nearer = d < best
        best[nearer], owner[nearer] = d[nearer], len(chosen)
        owner[i] = len(chosen)
        chosen.append(i)
    return np.array(chosen), owner


class CoverTree:
    """Nested nodes over unit vectors: a centre, a covering radius, and a range of ``order`` or children."""

    def __init__(self, x: np.ndarray, leaf: int = 128, fan: int = 16):
        self.x, self.centres, self.radii, self.children, self.ranges = x, [], [], [], []
        self.order = np.arange(len(x))
        todo = [self._node(0, len(x), x[0])] if len(x) else []
        while todo:
            k = todo.pop()
            a, b = self.ranges[k]
            if b - a <= leaf or self.radii[k] <= _SLACK:
                continue
            part = self.order[a:b]
            chosen, owner = farthest_first(x[part], fan, self.radii[k] / 2)
            if len(chosen) == 1:
                continue
            at = np.argsort(owner, kind="stable")
            self.order[a:b] = part[at]
            edges = np.searchsorted(owner[at], np.arange(len(chosen) + 1)) + a
            self.children[k] = [self._node(int(edges[i]), int(edges[i + 1]), x[part[c]]) for i, c in enumerate(chosen)]
            todo.extend(self.children[k])
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)
        self.is_leaf = np.array([not c for c in self.children], dtype=bool)

    def _node(self, a: int, b: int, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.radii.append(float(np.linalg.norm(self.x[self.order[a:b]] - centre, axis=1).max()))
        self.children.append([])
        self.ranges.append((a, b))
        return len(self.ranges) - 1

    def points(self, k: int) -> np.ndarray:
        a, b = self.ranges[k]
        return self.order[a:b]


def dual_traversal(s: CoverTree, t: CoverTree, radius: float):
    """Yields ("all", node, node) and ("leaves", node of s, [nodes of t]) such that every pair within ``radius`` is in one of them."""
    a, b = np.array([0]), np.array([0])
    leaves: dict[int, list[int]] = {}
    while len(a):
        d = np.linalg.norm(s.centre[a] - t.centre[b], axis=1)
        reach = s.radius[a] + t.radius[b]
        near = d <= reach + radius + _SLACK
        whole = near & (d + reach <= radius - _SLACK)
        for i in np.flatnonzero(whole):
            yield "all", int(a[i]), int(b[i])
        a, b = a[near & ~whole], b[near & ~whole]
        done = s.is_leaf[a] & t.is_leaf[b]
        for i, j in zip(a[done], b[done], strict=True):
            leaves.setdefault(int(i), []).append(int(j))
        a, b = a[~done], b[~done]
        first = ~s.is_leaf[a] & (t.is_leaf[b] | (s.radius[a] >= t.radius[b]))
        pairs = [(c, int(j)) for i, j in zip(a[first], b[first], strict=True) for c in s.children[i]]
        pairs += [(int(i), c) for i, j in zip(a[~first], b[~first], strict=True) for c in t.children[j]]
        a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    for i, js in leaves.items():
        yield "leaves", i, js


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        root = self.parent[i]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[i] = root
                return root
            root = up

    def join(self, i: np.ndarray) -> None:
        roots = np.unique(self.find(i))
        self.parent[roots[1:]] = roots[0]


def link(s: CoverTree, m: np.ndarray, t: CoverTree | None, w: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within s (t None) or between s and t: for the points of s, then of t, the linked multiplicity and the local component's root index."""
    own = t is None
    t = s if own else t
    n = len(s.x)
    weight = m if own else w
    links, union, shift = np.zeros(n + (0 if own else len(t.x)), dtype=np.int64), _Union(n + (0 if own else len(t.x))), 0 if own else n
    for kind, i, j in dual_traversal(s, t, float(np.sqrt(2 - 2 * least))) if n and len(t.x) else ():
        p = s.points(i)
        q = t.points(j) if kind == "all" else np.concatenate([t.points(k) for k in j])
        if kind == "all":
            links[p] += weight[q].sum()
            if own:
                both = np.intersect1d(p, q)
                links[both] -= m[both]
            else:
                links[q + shift] += m[p].sum()
            union.join(np.concatenate((p, q + shift)))
            continue
        hit = s.x[p] @ t.x[q].T >= least
        if own:
            hit &= p[:, None] != q[None, :]
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        hit = hit[rows]
        links[p[rows]] += hit @ weight[q]
        if not own:
            links[q + shift] += m[p[rows]] @ hit
        for r, row in zip(p[rows], hit, strict=True):
            union.join(np.r_[r, q[row] + shift])
    return links, union.find(np.arange(len(links)))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Upper:
    """The upper levels for vectors of one length: centres, covering radii, and the cells of each node (first cell, how many)."""

    def __init__(self, centres: np.ndarray, reach: float):
        self.centres, self.reach = centres, reach
        self.between = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))  # at most most_nodes squared

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.argmax(u @ self.centres.T, axis=1)
        return node, np.linalg.norm(u - self.centres[node], axis=1)

    def cells(self, counts: np.ndarray, radii: np.ndarray, capacity: int, first: int) -> int:
        self.radii, self.parts = radii, np.maximum(1, -(-counts // capacity))
        self.first = first + np.cumsum(self.parts) - self.parts
        return first + int(self.parts.sum())

    def visits(self, u: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which nodes each vector may link into, its own among them; only those after its own are asked."""
        product = u @ self.centres.T
        away = np.sqrt(np.maximum(0, 2 - 2 * product))
        margin = np.take_along_axis(product, node[:, None], axis=1) - product
        near = (away <= self.radii[None, :] + self.reach + _SLACK) & (margin <= self.reach * self.between[node] + _SLACK)
        return near & (np.arange(len(self.centres))[None, :] >= node[:, None])


def embedding_near_duplicates(spark: SparkSession, rows: DataFrame, least: float = 0.95, sample: int = 4096, capacity: int = 8192, most_nodes: int = 1024, lengths: int = 64) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``rows(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
    components; so do vectors of different lengths with each other.  Repeated rows are copies that link; further columns play no
    part; an empty table gives an empty result.
    ``sample``, ``most_nodes``: bounds of what the driver holds; ``capacity``: vectors of a cell; ``lengths``: lengths of vectors that
    are treated in one job, the others in further jobs.
    """
    scratch = Scratch(spark)
    bounded_batches(spark)
    finite = F.expr("coalesce(embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0), false)")
    # one pass: whether it counts, and its class (equal bits); the class keeps one copy of the vector
    marked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    marked = marked.withColumn("key", F.when(finite, F.xxhash64(F.col("embedding").cast("array<double>"))))
    classes = marked.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("dims", F.size("embedding")), "classes")
    kinds = [(r.dims, r["count"]) for r in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").collect()]
    found: DataFrame | None = None
    for k in range(0, len(kinds), lengths):
        part = _links(spark, scratch, classes.select("key", "m", "embedding", "dims"), dict(kinds[k : k + lengths]), least, sample, capacity, most_nodes)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "key long, links long, root long")
    components = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch, classes.count())
    named = classes.select("key", "rep", "m").join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = scratch.save(named.join(counts, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    out = marked.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _by_length(batch: pa.RecordBatch, at: int, upper: dict):
    """(row numbers, unit vectors, upper levels) of the rows of each length in a batch."""
    dims = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield rows, _unit(batch.column(at).take(pa.array(rows))), upper[int(d)]


def cells_of(spark: SparkSession, scratch: Scratch, classes: DataFrame, kinds: dict[int, int], least: float, sample: int, capacity: int, most_nodes: int) -> DataFrame:
    """(cell, chunk, visitor, key, m, embedding): the residents of each cell and the vectors that visit it."""
    reach, upper = float(np.sqrt(2 - 2 * least)), {}
    classes = classes.where(F.col("dims").isin(list(kinds)))
    for dims, n in kinds.items():
        x = _unit(classes.where(F.col("dims") == dims).orderBy("key").limit(sample).select("embedding").toArrow()["embedding"])  # keys are hashes: a fair sample
        upper[dims] = Upper(x[farthest_first(x, min(most_nodes, -(-n // capacity)))[0]], reach)
    shared = spark.sparkContext.broadcast(upper)  # most_nodes centres of each length at most
    kind = classes.schema["embedding"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            node, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for rows, u, levels in _by_length(batch, 2, shared.value):
                node[rows], away[rows] = levels.place(u)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(node), pa.array(away)], names=["key", "m", "embedding", "node", "away"])

    placed = scratch.save(classes.select("key", "m", "embedding").mapInArrow(assign, f"key long, m long, embedding {kind}, node int, away double"), "placed")
    of = placed.groupBy(F.size("embedding").alias("dims"), "node").agg(F.max("away").alias("r"), F.count("*").alias("c")).toArrow()  # a row for each node
    dims, node, r, c = (of[k].to_numpy() for k in ("dims", "node", "r", "c"))
    first = 0
    for d, levels in upper.items():
        count, radii, mine = np.zeros(len(levels.centres), dtype=np.int64), np.zeros(len(levels.centres)), dims == d
        count[node[mine]], radii[node[mine]] = c[mine], r[mine]
        first = levels.cells(count, radii, capacity, first)
    measured = spark.sparkContext.broadcast(upper)

    def count_visits(batches):
        total = {d: np.zeros(len(levels.centres), dtype=np.int64) for d, levels in measured.value.items()}
        for batch in batches:
            for rows, u, levels in _by_length(batch, 0, measured.value):
                total[u.shape[1]] += levels.visits(u, batch.column(1).to_numpy()[rows]).sum(axis=0)
        for d, n in total.items():
            yield pa.record_batch([pa.array(np.full(len(n), d, dtype=np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["dims", "node", "n"])

    visits = placed.select("embedding", "node").mapInArrow(count_visits, "dims int, node int, n long").groupBy("dims", "node").agg(F.sum("n").alias("n")).orderBy("dims", "node").toArrow()
    counted = dict(zip(zip(visits["dims"].to_pylist(), visits["node"].to_pylist(), strict=True), visits["n"].to_pylist(), strict=True))
    # a cell's visitors are dealt in chunks of about 16 cells' worth
    chunks = np.array([max(1, -(-counted[d, k] // (16 * capacity))) for d, levels in upper.items() for k in range(len(levels.centres)) for _ in range(levels.parts[k])], dtype=np.int64)
    ready = spark.sparkContext.broadcast((upper, chunks))

    def deal(batches):
        upper, chunks = ready.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            salt = mix(key.view(np.uint64), 801)
            for rows, u, levels in _by_length(batch, 2, upper):
                node = batch.column(3).to_numpy()[rows]
                part = (salt[rows] % levels.parts[node].astype(np.uint64)).astype(np.int64)
                home = levels.first[node] + part
                near = levels.visits(u, node)
                who, other = np.nonzero(near)
                reps = levels.parts[other]
                who, cell = np.repeat(who, reps), np.repeat(levels.first[other], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
                later = cell > home[who]
                who, cell = who[later], cell[later]
                chunk = (salt[rows][who] >> np.uint64(32)).astype(np.int64) % chunks[cell]
                stay = np.repeat(np.arange(len(rows)), chunks[home])
                own = np.arange(len(stay)) - np.repeat(np.cumsum(chunks[home]) - chunks[home], chunks[home])
                take, visitor = np.r_[stay, who], np.r_[np.zeros(len(stay), dtype=bool), np.ones(len(who), dtype=bool)]
                cells, parts = np.r_[home[stay], cell], np.r_[own, chunk]
                for i in range(0, len(take), 8192):
                    of = slice(i, i + 8192)
                    at = pa.array(rows[take[of]])
                    yield pa.record_batch([pa.array(cells[of].astype(np.int32)), pa.array(parts[of].astype(np.int32)), pa.array(visitor[of]), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)], names=["cell", "chunk", "visitor", "key", "m", "embedding"])

    return placed.mapInArrow(deal, f"cell int, chunk int, visitor boolean, key long, m long, embedding {kind}")


def _links(spark: SparkSession, scratch: Scratch, classes: DataFrame, kinds: dict[int, int], least: float, sample: int, capacity: int, most_nodes: int) -> DataFrame:
    """(key, links, root): for each vector with links in a task, how many and the smallest key of its component there."""
    dealt = cells_of(spark, scratch, classes, kinds, least, sample, capacity, most_nodes)

    def told(key, links, root):
        low = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(low, root, key)
        keep = links > 0
        return pa.record_batch([pa.array(key[keep]), pa.array(links[keep]), pa.array(low[root][keep])], names=["key", "links", "root"])

    def compare(batches):
        now, home, tree = None, [], None
        for batch in batches:
            cell, chunk, visitor, key, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (visitor[1:] != visitor[:-1])]) if len(cell) else []
            for a, b in zip(starts, [*starts[1:], len(cell)]):
                if now != (cell[a], chunk[a]):
                    if home and tree is None and now[1] == 0:
                        yield own(home)
                    now, home, tree = (cell[a], chunk[a]), [], None
                rows = (key[a:b], m[a:b], _unit(batch.column(5).slice(a, b - a)))
                if not visitor[a]:
                    home.append(rows)
                elif home:
                    if tree is None:
                        if now[1] == 0:
                            yield own(home)
                        names, counts, x = (np.concatenate(c) for c in zip(*home, strict=True))
                        tree = CoverTree(x)
                    links, root = link(tree, counts, CoverTree(rows[2]), rows[1], least)
                    yield told(np.r_[names, rows[0]], links, root)
        if home and tree is None and now[1] == 0:
            yield own(home)

    def own(home):
        names, counts, x = (np.concatenate(c) for c in zip(*home, strict=True))
        return told(names, *link(CoverTree(x), counts, None, None, least))

    ordered = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "visitor")
    return scratch.save(ordered.mapInArrow(compare, "key long, links long, root long"), "links")
