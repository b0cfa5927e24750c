"""Embedding near-dedup: hierarchical navigable small-world graphs per shard; every shard is queried.

Vectors are compared only if their labels are equal and not null, by cosine in double precision; those that are null, empty, zero or hold null or
non-finite components link with nothing. Equal vectors are one point of the graphs, with a count. Points of a label (and length) are dealt by hash to
shards of about SHARD_ROWS, and of SHARD_NUMBERS components at most, so that what a task holds is bounded whatever the length. Each shard's graph is
built by one task and kept as a table. Then each shard of a label is searched for all of the label's points, in blocks.

A search keeps a beam. Audits widen it: of AUDIT queries of the block those that brute force finds links for are searched, and then as many
of those that the search found links for are held against brute force; where the mean of the queries' own recalls is under RECALL, the beam is doubled
for all, until it holds the whole shard. A query whose beam holds hits only has more of them than the beam: it is compared with the whole
shard, in products of bounded size. Hits are verified in double precision, counted and united as each batch of queries ends: neither a task
nor what leaves it holds the pairs of a group.

Rows that repeat a vec_id are scored alike: links are counted between rows' vectors; null ids are before all others. Columns other than the three
named are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, table
from .components import components

THRESHOLD = 0.93
SHARD_ROWS, SHARD_NUMBERS = 1 << 16, 1 << 22
LINKS, BEAM, BATCH, EXPAND = 12, 48, 256, 4
AUDIT, RECALL = 256, 0.995
#: Similarities that a product with a whole shard holds at once.
PRODUCT = 1 << 22
#: Links held before they are united.
HELD = 1 << 20
NULL_ID = -(2**63)


class Graph:
    """Points ``x`` (unit length) and, for each layer, neighbours of each point (-1: none). Point 0 is the entry, on all layers."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 11):
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")
        self.x, level = np.ascontiguousarray(x[self.order], np.float32), level[self.order]
        self.size = [int((level >= k).sum()) for k in range(level[0] + 1 if n else 0)]  # the points of a layer come first
        self.adj = [np.full((m, 2 * links), -1, np.int32) for m in self.size]
        self.links = links
        done, batch = 1, 1
        while done < n:
            to = min(n, done + batch)
            self._insert(done, to, level, beam)
            done, batch = to, min(BATCH, 2 * batch)
        self._reach()

    def parts(self) -> dict:
        """All but the points."""
        return {k: v for k, v in self.__dict__.items() if k != "x"}

    @classmethod
    def of(cls, parts: dict, x: np.ndarray) -> Graph:
        """The graph of these parts over the points that it was made from."""
        graph = cls.__new__(cls)
        graph.__dict__.update(parts, x=np.ascontiguousarray(x[parts["order"]], np.float32))
        return graph

    def _reach(self) -> None:
        """Points that no walk from the entry comes to get a link from their nearest neighbour that one does."""
        n = len(self.x)
        while n:
            adj = self.adj[0]
            seen = np.zeros(n, bool)
            front = np.zeros(1, np.int64)
            while len(front):
                seen[front] = True
                nb = adj[front]
                front = np.unique(nb[nb >= 0])
                front = front[~seen[front]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            nb = adj[lost]
            sim = np.where((nb >= 0) & seen[np.maximum(nb, 0)], np.einsum("ijk,ik->ij", self.x[np.maximum(nb, 0)], self.x[lost]), -2)
            best = nb[np.arange(len(lost)), sim.argmax(1)]
            linked = sim.max(1) > -2
            if not linked.any():  # an island: tie its first point to the entry
                lost, best, linked = lost[:1], np.zeros(1, np.int64), np.ones(1, bool)
            source, target = best[linked].astype(np.int64), lost[linked]
            order = np.argsort(source, kind="stable")
            source, target = source[order], target[order]
            place = np.arange(len(source)) - np.searchsorted(source, source)
            used = (adj >= 0).sum(1)[source]
            width = int((used + place).max()) + 1
            packed = np.take_along_axis(adj, np.argsort(adj < 0, 1, kind="stable"), 1)
            if width > packed.shape[1]:
                packed = np.concatenate([packed, np.full((n, width - packed.shape[1]), -1, np.int32)], 1)
            packed[source, used + place] = target
            self.adj[0] = packed

    def _insert(self, a: int, b: int, level: np.ndarray, beam: int) -> None:
        """Points a to b - 1, whose neighbours are sought among those before them and among each other."""
        q = self.x[a:b]
        near = np.zeros((len(q), 1), np.int64)
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        for k in range(len(self.adj) - 1, -1, -1):
            here = np.flatnonzero(level[a:b] >= k)
            upto = min(a, self.size[k])
            if not len(here):
                near = self.search(q, near, 1, k, upto)[0]
                continue
            near, sim = self.search(q, near, beam, k, upto)
            near, sim = near[here], sim[here]
            m = min(self.links, len(here))
            mine = inner[np.ix_(here, here)]
            other = np.argpartition(-mine, m - 1, 1)[:, :m] if len(here) > 1 else np.zeros((len(here), 0), int)
            cand = np.concatenate([near, a + here[other]], 1)
            sims = np.concatenate([sim, np.take_along_axis(mine, other, 1)], 1)
            picked = self._diverse(cand, sims)
            self.adj[k][a + here, : self.links] = picked
            self._back(k, np.repeat(a + here, self.links), picked.reshape(-1))
            every = np.zeros((len(q), near.shape[1]), np.int64)
            every[here] = np.where(near >= 0, near, 0)
            near = every

    def _diverse(self, cand: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the point than to any already picked; then the nearest of the rest."""
        order = np.argsort(-sim, 1)
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        v = self.x[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        rows, width = cand.shape
        worst = np.full((rows, width), -2.0, np.float32)  # similarity to the nearest picked
        picked = np.zeros((rows, width), bool)
        for j in range(width):
            ok = (cand[:, j] >= 0) & (sim[:, j] > -1.5) & (sim[:, j] > worst[:, j]) & (picked.sum(1) < self.links)
            picked[:, j] = ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, :, j]), worst)
        rank = np.where(picked, 0, np.where((cand >= 0) & (sim > -1.5), 1, 2))
        first = np.argsort(rank, 1, kind="stable")[:, : self.links]
        out = np.full((rows, self.links), -1, np.int64)
        got = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(cand, first, 1), -1)
        out[:, : got.shape[1]] = got
        return out

    def _back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        """Links from targets back to sources; a point with too many keeps diverse ones."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[source], self.x[target]), target))
        source, target = source[order], target[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 4 * self.links)
        new = np.full((len(points), width), -1, np.int64)
        for j in range(width):
            has = count > j
            new[has, j] = source[first[has] + j]
        old = self.adj[k][points].astype(np.int64)
        every = np.concatenate([old, new], 1)
        every = np.sort(every, 1)[:, ::-1]
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        full = (every >= 0).sum(1) > 2 * self.links
        compact = np.take_along_axis(every, np.argsort(every < 0, 1, kind="stable"), 1)[:, : 2 * self.links]
        if full.any():
            c = every[full]
            sim = np.einsum("ijk,ik->ij", self.x[np.maximum(c, 0)], self.x[points[full]])
            keep = self._diverse(c, np.where(c >= 0, sim, -2).astype(np.float32))
            compact[full] = -1
            compact[full, : self.links] = keep
        self.adj[k][points] = compact

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, layer: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (points, similarities) of all queries on a layer, among the points before ``upto``, from each one's ``start``."""
        rows = np.arange(len(q))[:, None]
        start = np.where((start >= 0) & (start < upto), start, 0)
        seen = np.zeros((len(q), upto), bool)
        seen[rows, start] = True
        ids = np.full((len(q), beam), -1, np.int64)
        sim = np.full((len(q), beam), -2.0, np.float32)
        uniq = np.sort(start, 1)
        again = np.zeros(uniq.shape, bool)
        again[:, 1:] = uniq[:, 1:] == uniq[:, :-1]
        s = np.einsum("ijk,ik->ij", self.x[uniq], q)
        s[again] = -2
        w = min(beam, uniq.shape[1])
        top = np.argsort(-s, 1)[:, :w]
        ids[:, :w], sim[:, :w] = np.take_along_axis(uniq, top, 1), np.take_along_axis(s, top, 1)
        ids[sim < -1.5] = -1
        open_ = ids >= 0
        active = np.arange(len(q))
        e = min(EXPAND, beam)
        while len(active):
            o = np.where(open_[active], sim[active], -3)
            pick = np.argpartition(-o, e - 1, 1)[:, :e]
            ok = np.take_along_axis(o, pick, 1) > -2.5
            more = ok.any(1)
            active, pick, ok = active[more], pick[more], ok[more]
            if not len(active):
                break
            open_[active[:, None], pick] = False
            point = np.where(ok, ids[active[:, None], pick], -1)
            nb = self.adj[layer][np.maximum(point, 0)]
            nb = np.where(point[:, :, None] >= 0, nb, -1).reshape(len(active), -1).astype(np.int64)
            nb = np.where((nb >= 0) & (nb < upto), nb, -1)
            nb = np.sort(nb, 1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[active[:, None], np.maximum(nb, 0)]] = -1
            r, c = np.nonzero(nb >= 0)
            seen[active[r], nb[r, c]] = True
            s = np.full(nb.shape, -2.0, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[nb[r, c]], q[active[r]])
            every_s = np.concatenate([sim[active], s], 1)
            top = np.argpartition(-every_s, beam - 1, 1)[:, :beam]
            sim[active] = np.take_along_axis(every_s, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], nb], 1), top, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], nb >= 0], 1), top, 1)
            open_[active] &= sim[active] > -1.5
        return ids, sim

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point) of all points found with similarity ``least`` or more, for a batch of queries, and the queries whose beam holds such points only."""
        at, width = np.zeros((len(q), 1), np.int64), min(beam, len(self.x))
        for k in range(len(self.adj) - 1, 0, -1):
            at = self.search(q, at, 1, k, self.size[k])[0]
        ids, sim = self.search(q, at, width, 0, len(self.x))
        hit = sim >= least
        full = hit.all(1) & (width < len(self.x))
        a, c = np.nonzero(hit & ~full[:, None])
        return a, ids[a, c], np.flatnonzero(full)


def _unit(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    v = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Roots:
    """Union of what is linked; a root is the least id."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids, np.arange(len(ids))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Least labels spread along the links until none changes."""
        while True:
            m = self.up.copy()
            np.minimum.at(m, a, self.up[b])
            np.minimum.at(m, b, self.up[a])
            m = np.minimum(m, m[m])
            if (m == self.up).all():
                return
            self.up = m


class Links:
    """Counts of each query's links and, if ``roots`` are given, the union of what is linked. ``q`` and ``p``: places of queries and points among the roots."""

    def __init__(self, q_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray, roots: Roots | None = None):
        self.q_ids, self.ids, self.counts, self.roots = q_ids, ids, counts, roots
        self.n = np.zeros(len(q_ids), np.int64)
        self.own = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)  # ``ids`` are in order
        self.mine = ids[self.own] == q_ids
        if roots is not None:
            self.q, self.p = np.searchsorted(roots.ids, q_ids), np.searchsorted(roots.ids, ids)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def pairs(self, a: np.ndarray, p: np.ndarray) -> None:
        other = self.q_ids[a] != self.ids[p]
        a, p = a[other], p[other]
        self.n += np.bincount(a, self.counts[p], len(self.n)).astype(np.int64)
        self._unite(a, p)

    def matrix(self, rows: np.ndarray, hit: np.ndarray) -> None:
        """Rows' hits among all points."""
        k = np.flatnonzero(self.mine[rows])
        hit[k, self.own[rows[k]]] = False
        self.n[rows] += (hit.astype(np.float64) @ self.counts.astype(np.float64)).astype(np.int64)
        if self.roots is not None:  # only what isn't united yet
            self.done()
            up = self.roots.up
            a, p = np.nonzero(hit & (up[self.p][None, :] != up[self.q[rows]][:, None]))
            self._unite(rows[a], p)
            self.done()

    def _unite(self, a: np.ndarray, p: np.ndarray) -> None:
        if self.roots is not None and len(a):
            self.held.append((self.q[a], self.p[p]))
            self.size += len(a)
            if self.size > HELD:
                self.done()

    def done(self) -> None:
        if self.held:
            self.roots.unite(*map(np.concatenate, zip(*self.held)))
            self.held, self.size = [], 0


class Search:
    """Searches of one shard. ``points`` are unit vectors in double precision, in the order of their ``ids``."""

    def __init__(self, graph: Graph, points: np.ndarray, ids: np.ndarray, counts: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM):
        self.graph, self.points, self.ids, self.counts, self.threshold, self.beam = graph, points, ids, counts, threshold, beam
        self.single = points.astype(np.float32)

    def every(self, q: np.ndarray, rows: np.ndarray, to: Links) -> None:
        """Hits of these queries by brute force, in pieces: in single precision, and in double where that can't tell."""
        step = max(1, PRODUCT // max(1, len(self.points)))
        for i in range(0, len(rows), step):
            mine = rows[i : i + step]
            sim = q[mine].astype(np.float32) @ self.single.T
            hit = sim >= self.threshold
            a, p = np.nonzero(np.abs(sim - np.float32(self.threshold)) < 1e-4)
            for j in range(0, len(a), 1 << 16):
                x, y = a[j : j + (1 << 16)], p[j : j + (1 << 16)]
                hit[x, y] = np.einsum("ij,ij->i", q[mine[x]], self.points[y]) >= self.threshold
            to.matrix(mine, hit)

    def hits(self, q: np.ndarray, to: Links) -> None:
        """All verified hits of all queries, in pieces of bounded size."""
        if self.beam >= len(self.points):
            self.every(q, np.arange(len(q)), to)
            return
        for i in range(0, len(q), BATCH):
            mine = q[i : i + BATCH]
            a, p, many = self.graph.near(mine.astype(np.float32), self.threshold - 1e-3, self.beam)
            p = self.graph.order[p]
            ok = np.einsum("ij,ij->i", mine[a], self.points[p]) >= self.threshold
            to.pairs(a[ok] + i, p[ok])
            self.every(q, many + i, to)

    def widen(self, q: np.ndarray, q_ids: np.ndarray) -> None:
        """Double the beam until the queries' own recalls are RECALL or more in the mean; queries without links don't count."""
        true = Links(q_ids, self.ids, self.counts)
        self.every(q, np.arange(len(q)), true)
        some = np.flatnonzero(true.n)
        while self.beam < len(self.points) and len(some):
            found = Links(q_ids[some], self.ids, self.counts)
            self.hits(q[some], found)
            if (found.n / true.n[some]).mean() >= RECALL:
                break
            self.beam *= 2


def search_shard(graph: Graph, points: np.ndarray, ids: np.ndarray, counts: np.ndarray, q: np.ndarray, q_ids: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM):
    """Links of each query within the shard, and (id, root) of all that is linked. ``ids`` are in order, ``points`` and ``q`` unit vectors in double precision."""
    s = Search(graph, points, ids, counts, threshold, beam)
    few = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    s.widen(q[few], q_ids[few])
    roots = Roots(np.unique(np.concatenate([q_ids, ids])))
    while True:
        was, found = s.beam, Links(q_ids, ids, counts, roots)
        s.hits(q, found)
        found.done()
        linked = np.flatnonzero(found.n)
        if len(linked) > AUDIT:
            linked = linked[np.linspace(0, len(linked) - 1, AUDIT).astype(int)]
        s.widen(q[linked], q_ids[linked])
        if s.beam == was:
            break
    some = np.flatnonzero(np.bincount(roots.up, minlength=len(roots.up))[roots.up] > 1)  # of a component of two or more
    return found.n, roots.ids[some], roots.ids[roots.up[some]]


def embedding_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    e = F.col("_e")
    src = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(vector_col).cast("array<double>").alias("_e"), F.col(label_col).cast("string").alias("_l"))
    good = F.col("_l").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    good &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    src = table(src.withColumn("_ok", F.coalesce(good, F.lit(False))), "vectors")
    valid = src.where("_ok").withColumn("_dim", F.size("_e"))
    points = valid.groupBy("_l", "_dim", "_e").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))
    points = first = table(points, "points")
    rows = F.greatest(F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_NUMBERS) / F.col("_dim"))), F.lit(1))
    dealt = points.groupBy("_l", "_dim").agg(F.ceil(F.count("*") / F.first(rows)).cast("int").alias("shards"))
    points = table(points.join(dealt, ["_l", "_dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")), "points")

    def build(key, t):
        x = _unit(t["_e"], key[1].as_py())
        order = np.argsort(t["rep"].to_numpy(), kind="stable")
        x, ids, n = x[order], t["rep"].to_numpy()[order], t["n"].to_numpy()[order]
        return pa.table({"_l": [key[0].as_py()], "_dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()), "graph": pa.array([pickle.dumps((Graph(x).parts(), x, ids, n))], pa.binary())})

    graphs = table(points.groupBy("_l", "_dim", "shard").applyInArrow(build, "_l string, _dim int, shard int, graph binary"), "graphs")
    #: Blocks of queries are dealt like shards: each block of a label meets each of its shards.
    queries = points.withColumnRenamed("shard", "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = graphs.join(dealt, ["_l", "_dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("_l", "_dim", "shard", "block", "graph")

    def ask(key, t, g):
        if not t.num_rows or not g.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        kept, x, ids, n = pickle.loads(g["graph"][0].as_py())
        graph = Graph.of(kept, x)
        q_ids = t["rep"].to_numpy()
        links, every, root = search_shard(graph, x, ids, n, _unit(t["_e"], key[1].as_py()), q_ids, threshold)
        return pa.table({"id": np.concatenate([q_ids, every]), "links": np.concatenate([links, np.zeros(len(every), np.int64)]), "root": np.concatenate([q_ids, root])})

    keys = ["_l", "_dim", "shard", "block"]
    found = table(queries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(ask, "id bigint, links bigint, root bigint"), "found")
    labels = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_point = points.select("_l", "_e", "rep", "n").join(found.groupBy("id").agg(F.sum("links").alias("links")), F.col("rep") == F.col("id"), "left").drop("id")
    by_point = by_point.join(labels, F.col("rep") == F.col("id"), "left").select("_l", "_e", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    #: Written, so that what it was made from can go.
    by_point = table(by_point, "by_point")
    drop(first, points, graphs, found)
    ok = src.where("_ok").join(by_point, ["_l", "_e"]).select("_id", "n_links", "component_id")
    rest = src.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return ok.unionByName(rest).select(F.col("_id").alias("vec_id"), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
