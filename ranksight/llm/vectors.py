"""Most similar vectors for every vector: hierarchical k-means trees searched best bin first.

The upper level of a tree is fitted on a bounded sample and cuts the collection into *shards*; the lower
levels are built inside each shard from all of its vectors. A query opens bins in the order of a priority queue
and widens its visits until the recall measured on calibration queries reaches the target, once among shards
(a similarity margin) and once among the leaves of a shard (a number of leaves).

The more shards there are, the more of them lie within a margin of a query. So several trees are fitted, and of them
as many searched, each with the margin that is then needed, as open the fewest shards in all.

Best-first order without a heap per query: a queue keyed by centroid similarity pops leaf A before leaf B exactly
if the weakest similarity on A's path is higher than on B's. ``KMeansTree.priorities`` computes that key for a whole
batch; ``KMeansTree.pop_order`` is the literal heap, and tests hold the two together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksight.runtime import materialize, spread


@dataclass(frozen=True)
class NeighborConfig:
    """The upper levels are fitted on ``sample`` rows, or on ``shard_sample`` for each shard where that is more;
    ``calibration`` bounds the queries recall is calibrated on, ``trees`` the trees that may be searched."""

    k: int = 5
    dim: int = 64
    sample: int = 20_000
    shard_sample: int = 48
    calibration: int = 400
    trees: int = 4
    recall: float = 0.99
    shard_rows: int = 12_000
    shard_cap: int = 48_000
    leaf_rows: int = 64
    branch: int = 16
    max_shards: int = 4_096
    seed: int = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Spherical Lloyd iterations: unit centroids and the assignment; empty clusters are dropped."""
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmax(x @ centers.T, axis=1)
        order = np.argsort(label, kind="stable")
        kept, start = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), x[order][start]).astype(np.float32)
        label = np.searchsorted(kept, label)
    return centers, np.argmax(x @ centers.T, axis=1)


@dataclass
class KMeansTree:
    """Nodes in breadth order. ``parent`` of a top node is -1; ``leaf[i]`` is the leaf number of node i or -1."""

    centers: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    label: np.ndarray | None = field(repr=False)  # leaf number of each fitted row

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branch: int, seed: int, max_leaves: int = 1 << 30) -> KMeansTree:
        """Split by k-means until a node has at most ``leaf_rows`` fitted rows or cannot be split."""
        rng = np.random.default_rng(seed)
        centers: list[np.ndarray] = []
        parent: list[int] = []
        leaf: list[int] = []
        label = np.zeros(len(x), np.int64)
        todo = [(-1, np.arange(len(x)))]
        leaves = 0
        while todo:
            above, rows = todo.pop(0)
            ways = min(branch, max(2, math.ceil(len(rows) / leaf_rows)))
            mid, mine = kmeans(x[rows], ways, rng)
            for j in range(len(mid)):
                part = rows[mine == j]
                if not len(part):
                    continue
                at = len(centers)
                centers.append(mid[j])
                parent.append(above)
                if len(part) <= leaf_rows or len(part) == len(rows) or leaves + len(todo) >= max_leaves:
                    leaf.append(leaves)
                    label[part] = leaves
                    leaves += 1
                else:
                    leaf.append(-1)
                    todo.append((at, part))
        return cls(np.asarray(centers, np.float32).reshape(len(centers), -1), np.asarray(parent), np.asarray(leaf), label)

    def flat(self, x: np.ndarray, rounds: int = 2) -> KMeansTree:
        """One level of this tree's leaves, moved by Lloyd iterations over x: no leaf is shut off by a cut above it."""
        centers = self.centers[self.leaf >= 0]
        for _ in range(rounds):
            label = np.concatenate([np.argmax(x[a : a + BLOCK] @ centers.T, axis=1) for a in range(0, len(x), BLOCK)])
            order = np.argsort(label, kind="stable")
            kept, start = np.unique(label[order], return_index=True)
            sums = np.add.reduceat(x[order], start, axis=0)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers[kept]).astype(np.float32)
        return KMeansTree(centers, np.full(len(centers), -1), np.arange(len(centers)), None)

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1 if len(self.leaf) else 0

    def priorities(self, q: np.ndarray) -> np.ndarray:
        """[query, leaf]: the key under which a best-first queue pops the leaf (higher is earlier)."""
        key = q @ self.centers.T
        if self.parent.max() < 0:  # one level; its leaves stand in order
            return key
        for i, p in enumerate(self.parent):  # breadth order: a parent is final before its children
            if p >= 0:
                np.minimum(key[:, i], key[:, p], out=key[:, i])
        at = np.flatnonzero(self.leaf >= 0)
        return key[:, at[np.argsort(self.leaf[at])]]

    def pop_order(self, q: np.ndarray) -> list[int]:
        """Leaves in the order one query's priority queue pops them (ties: the smaller leaf number last fitted)."""
        sim = self.centers @ q
        children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent):
            children.setdefault(int(p), []).append(i)
        queue = [(-float(sim[i]), i) for i in children.get(-1, [])]
        heapq.heapify(queue)
        out = []
        while queue:
            _, i = heapq.heappop(queue)
            if self.leaf[i] >= 0:
                out.append(int(self.leaf[i]))
            for c in children.get(i, []):
                heapq.heappush(queue, (-float(sim[c]), c))
        return out


def exact_top(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k most similar rows of x for each q, without the row ``own`` of each (brute force)."""
    out = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[np.arange(len(s)), own[a : a + 256]] = -9
        out.append(np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


#: Rows that are held against all shards at a time.
BLOCK = 2_048

#: More than float32 can be off in the difference of two cosines.
SLACK = np.float32(2e-5)


def usable_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors, as stored, of the usable rows: ``dim`` finite numbers, not all zero, id not null."""
    ids, emb = batch.column(0), batch.column(1)
    if not len(emb):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    size = np.diff(emb.offsets.to_numpy())
    ok = (size == dim) & ~np.asarray(emb.is_null()) & ~np.asarray(ids.is_null())
    first = emb.offsets.to_numpy()[:-1][ok]
    flat = emb.values.to_numpy(zero_copy_only=False)
    x = flat[first[:, None] + np.arange(dim)].astype(np.float32).reshape(-1, dim)
    norm = _norms(x)
    good = np.isfinite(norm) & (norm > 0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[ok][good].astype(np.int64), x[good]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x.astype(np.float64), axis=1)


def units(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) / _norms(x)[:, None]).astype(np.float32) + np.float32(0)


def unit_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit float32 vectors of the usable rows."""
    ids, x = usable_rows(batch, dim)
    return ids, units(x)


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of a and j of b, stored vectors, to 13 digits: what float64 can't tell apart is equal."""
    out = np.empty(len(i))
    for k in range(0, len(i), 100_000):
        x, y = a[i[k : k + 100_000]].astype(np.float64), b[j[k : k + 100_000]].astype(np.float64)
        out[k : k + 100_000] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return np.round(out, 13)


def row_keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each vector's bits; equal vectors have equal keys."""
    rng = np.random.default_rng(5)
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    weight = rng.integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (words * np.uint64(0x9E3779B97F4A7C15)) ^ (words << np.uint64(31))
    h = (mixed * weight).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _bytes_column(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, cfg: NeighborConfig, floor: float = -9.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, cosine) of the best ``k`` rows of a shard for each query, best bin first; x and q as stored.

    Rows of a shard that are less similar than ``floor`` stand in for neighbours in other shards; leaves aren't widened for them.
    """
    k, stored, asked = cfg.k, x, q
    x, q = units(x), units(q)
    tree = KMeansTree.fit(x, cfg.leaf_rows, cfg.branch, cfg.seed)
    order = np.argsort(tree.label, kind="stable")
    x, stored, ids, label = x[order], stored[order], ids[order], tree.label[order]
    bounds = np.searchsorted(label, np.arange(tree.n_leaves + 1))
    # widen the visits on calibration queries until the target share of true neighbours lies in opened leaves, or fewer, if
    # they hold all but a quarter of the misses allowed among those that can be neighbours at all
    rng = np.random.default_rng(cfg.seed)
    probe = rng.choice(len(x), min(len(x), 384), replace=False)
    visits = tree.n_leaves
    if len(x) > k + 1 and visits > 2:
        true = exact_top(x, x[probe], probe, k)
        key = tree.priorities(x[probe])
        place = np.argsort(np.argsort(-key, axis=1, kind="stable"), axis=1)
        need = np.take_along_axis(place, label[true], axis=1) + 1
        near = np.einsum("ij,ikj->ik", x[probe], x[true]) >= floor
        visits = min(visits, int(np.quantile(need, cfg.recall, method="higher")))
        if near.any():
            visits = min(visits, int(np.quantile(need[near], 1 - (1 - cfg.recall) / 4, method="higher")))
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0))]
    for a in range(0, len(q), 8192):  # bounds what is held of the opened leaves
        found.append(_scan_leaves(ids, x, stored, bounds, tree, visits, qids[a : a + 8192], q[a : a + 8192], asked[a : a + 8192], k))
    return tuple(np.concatenate(c) for c in zip(*found))


def _scan_leaves(ids: np.ndarray, x: np.ndarray, stored: np.ndarray, bounds: np.ndarray, tree: KMeansTree, visits: int, qids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` rows of each query in its first ``visits`` leaves; leaf i holds the rows between bounds i and i + 1.

    All rows that float32 can't tell from the last of the best are compared exactly, so ties go to the smaller id however many.
    """
    key = tree.priorities(q)
    opened = np.argpartition(-key, visits - 1, axis=1)[:, :visits] if visits < key.shape[1] else np.tile(np.arange(key.shape[1]), (len(q), 1))
    flat = opened.ravel()
    by_leaf = np.argsort(flat, kind="stable")
    who = by_leaf // opened.shape[1]
    cut = np.searchsorted(flat[by_leaf], np.arange(tree.n_leaves + 1))
    none = np.zeros(0, np.int64)
    got_q, got_n, got_s = [none], [none], [np.zeros(0, np.float32)]
    for leaf in range(tree.n_leaves):
        mine = who[cut[leaf] : cut[leaf + 1]]
        lo, hi = bounds[leaf], bounds[leaf + 1]
        if not len(mine) or lo == hi:
            continue
        step = max(1, 2_000_000 // int(hi - lo))  # bounds the ties held at a time
        for part in (mine[i : i + step] for i in range(0, len(mine), step)):
            s = q[part] @ x[lo:hi].T
            if hi - lo > k + 1:
                row, col = np.nonzero(s >= np.partition(s, -(k + 1), axis=1)[:, -(k + 1), None] - SLACK)
            else:
                row, col = (i.ravel() for i in np.indices(s.shape))
            gq, gn, gs = part[row], col + lo, s[row, col]
            if len(gq) > 4 * (k + 1) * len(part):  # many ties
                gq, gn, _ = _best(gq, ids[gn], cosines(asked, gq, stored, gn), gn, k + 1)
                gs = np.einsum("ij,ij->i", q[gq], x[gn])
            got_q.append(gq)
            got_n.append(gn)
            got_s.append(gs)
    gq, gn, gs = np.concatenate(got_q), np.concatenate(got_n), np.concatenate(got_s)
    other = qids[gq] != ids[gn]
    gq, gn, gs = gq[other], gn[other], gs[other]
    o = np.lexsort((-gs, gq))
    gq, gn, gs = gq[o], gn[o], gs[o]
    start, end = np.searchsorted(gq, gq, side="left"), np.searchsorted(gq, gq, side="right")
    near = gs >= gs[np.minimum(start + k, end) - 1] - SLACK
    gq, gn = gq[near], gn[near]
    exact = cosines(asked, gq, stored, gn)
    gq, gn, exact = _best(gq, ids[gn], exact, gn, k)
    return qids[gq], ids[gn], exact


def _best(gq: np.ndarray, tie: np.ndarray, s: np.ndarray, gn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query by (similarity, smaller id), each neighbour once."""
    o = np.lexsort((tie, -s, gq))
    gq, tie, s, gn = gq[o], tie[o], s[o], gn[o]
    if len(gq):
        again = np.r_[False, (gq[1:] == gq[:-1]) & (tie[1:] == tie[:-1])]
        gq, s, gn = gq[~again], s[~again], gn[~again]
    start = np.searchsorted(gq, gq, side="left")
    keep = np.arange(len(gq)) - start < k
    return gq[keep], gn[keep], s[keep]


def nearest_vectors(vectors: DataFrame, cfg: NeighborConfig = NeighborConfig(), id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """For every usable vector the ``k`` most similar others: (id, neighbor_id, similarity, rank).

    Usable: exactly ``dim`` finite numbers, not all zero, id not null; other rows take no part. Rows delivered twice
    count once. Ties in cosine go to the smaller id. Copies of one vector are collapsed before the search and expanded
    after it, so a group of copies of any size costs one search; its members' neighbours are its smallest ids.
    An empty table gives no rows; fewer than k + 1 vectors give as many neighbours as there are. Other columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    source = spread(source)
    dim = cfg.dim

    total = source.count()
    upper = _fit_upper(source, total, cfg)
    if upper is None:
        return spark.createDataFrame([], "id long, neighbor_id long, similarity double, rank int")
    trees, probes, held = upper
    shared = spark.sparkContext.broadcast((trees, probes))  # cfg.trees times max_shards centroids and cfg.calibration vectors

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, key, -1, 0) of each usable row; of the whole task (shard, rows, -2 - tree, 0), and of the best for each
        calibration query (id, shard, tree * queries + query, cosine)."""
        tops, asked = shared.value
        points = [np.zeros(top.n_leaves, np.int64) for top in tops]
        best = [np.full((len(asked), 0), v) for v in (np.float32(0), np.int64(0), *[np.int64(0)] * len(tops))]  # cosine, id, shard in each tree
        each = np.arange(len(asked))[:, None]
        out = lambda i, k, q, s: pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(np.asarray(q, np.int32)), pa.array(np.asarray(s, np.float32))], names=["id", "key", "query", "sim"])
        for b in batches:
            ids, x = unit_rows(b, dim)
            if not len(x):
                continue
            shards = [np.concatenate([top.priorities(x[a : a + BLOCK]).argmax(axis=1) for a in range(0, len(x), BLOCK)]) for top in tops]
            for n, shard in zip(points, shards):
                n += np.bincount(shard, minlength=len(n))
            s = asked @ x.T
            near = np.argpartition(-s, min(cfg.k + 1, len(x)) - 1, axis=1)[:, : cfg.k + 1] if len(x) > 1 else np.zeros((len(asked), 1), np.int64)
            best = [np.concatenate([old, new], axis=1) for old, new in zip(best, (s[each, near], ids[near], *(shard[near] for shard in shards)))]
            if best[0].shape[1] > 4 * (cfg.k + 1):  # rows delivered twice take two places
                keep = np.argsort(-best[0], axis=1, kind="stable")[:, : 2 * (cfg.k + 1)]
                best = [x[each, keep] for x in best]
            yield out(ids, row_keys(x), np.full(len(ids), -1), np.zeros(len(ids)))
        for j, n in enumerate(points):
            yield out(np.arange(len(n)), n, np.full(len(n), -2 - j), np.zeros(len(n)))
            yield out(best[1].ravel(), best[2 + j].ravel(), np.repeat(j * len(asked) + np.arange(len(asked)), best[0].shape[1]), best[0].ravel())

    seen = materialize(source.mapInArrow(first_pass, "id long, key long, query int, sim float"), "vector_keys")
    members = materialize(seen.where("query = -1").select("id", "key").distinct(), "vector_members")
    copied = materialize(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1"), "vector_copies")
    n_trees, margin, floor = _visits(seen.where("query >= 0"), trees, probes, held, cfg)
    points = [np.zeros(tree.n_leaves, np.int64) for tree in trees]
    for r in seen.where("query < -1").groupBy("query", "id").agg(F.sum("key").alias("n")).collect():  # one row per shard
        points[-2 - r["query"]][r["id"]] = r["n"]
    has_copies = not copied.isEmpty()
    if has_copies:  # keep one row of each group of copies in the search
        spare = members.join(copied, "key").where("id != rep").select("id")
        searched = source.join(spare, "id", "left_anti")
    else:
        searched = source
    parts = [_search(searched, tree, margin, floor, n, held, cfg) for tree, n in zip(trees[:n_trees], points)]
    nn = parts[0] if n_trees == 1 else _merge_trees(parts)
    if has_copies:
        nn = _expand_copies(nn, members, copied, cfg.k)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor_id"))
    return nn.withColumn("rank", rank).where(F.col("rank") <= cfg.k)


def _fit_upper(source: DataFrame, total: int, cfg: NeighborConfig) -> tuple[list[KMeansTree], np.ndarray, np.ndarray] | None:
    """The upper trees, the calibration queries and the rows that tell how many shards a row opens; None without usable rows.

    Where the sample is large enough the latter two are kept out of the fit: a row is nearer to a centroid it has drawn to itself.
    """
    if not total:
        return None
    shards = min(cfg.max_shards, max(1, math.ceil(total / cfg.shard_rows)))
    sample = max(cfg.sample, cfg.shard_sample * shards if shards > 1 else 0)
    share = min(1.0, sample / total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_rows(b, cfg.dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _bytes_column(x)], names=["id", "x"])

    def fetch(rows: DataFrame) -> np.ndarray:
        got = rows.mapInArrow(pack, "id long, x binary").toArrow()
        x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, cfg.dim)
        x = x[np.argsort(got.column("id").to_numpy(), kind="stable")]
        return x[np.sort(np.unique(row_keys(x), return_index=True)[1])] if len(x) else x

    picked = source if share >= 1 else source.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    x = fetch(picked.limit(int(sample * 1.25)))
    if not len(x):
        x = fetch(source.where(F.size("v") == cfg.dim).where(F.exists("v", lambda e: e != 0)).limit(cfg.sample))
    if not len(x):
        return None
    rng = np.random.default_rng(cfg.seed)
    x = x[rng.permutation(len(x))]
    held = 5 * cfg.calibration if len(x) >= 20 * cfg.calibration else 0
    fitted, held = x[held:], x[:held] if held else x
    if shards == 1:
        trees = [KMeansTree(np.zeros((1, cfg.dim), np.float32), np.array([-1]), np.array([0]), None)]
    else:
        trees = [KMeansTree.fit(fitted, max(2, math.ceil(len(fitted) / shards)), cfg.branch, cfg.seed + j).flat(fitted) for j in range(cfg.trees)]
    return trees, held[: cfg.calibration], held


def _visits(found: DataFrame, trees: list[KMeansTree], probes: np.ndarray, held: np.ndarray, cfg: NeighborConfig) -> tuple[int, float, float]:
    """How many trees to search, and the similarity margin within which other shards must be opened in each, to reach the
    recall on the calibration queries, whose true neighbours are taken from all rows; of all such choices the one that opens
    the fewest shards. And the similarity that all but a tenth of the misses allowed among the true neighbours reach."""
    if len(trees) == 1 and trees[0].n_leaves == 1:
        return 1, 0.0, -9.0
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    rows = found.distinct().withColumn("place", best).where(f"place > 1 and place <= {cfg.k + 1}").select("query", "place", "key", "sim").toArrow()  # k * calibration rows for each tree
    if not rows.num_rows:
        return 1, 9.0, -9.0
    query, place, shard = (rows.column(c).to_numpy() for c in ("query", "place", "key"))
    order = np.lexsort((place, query))  # the trees' neighbours are the same, in the same order
    query, shard = (c[order].reshape(len(trees), -1) for c in (query % len(probes), shard))
    gap = []
    for tree, q, there in zip(trees, query, shard):
        key = tree.priorities(probes)
        gap.append(key.max(axis=1)[q] - key[q, there])
    margins = [float(np.quantile(np.min(gap[: n + 1], axis=0), cfg.recall, method="higher")) for n in range(len(trees))]
    opened = np.zeros(len(trees))
    for j, tree in enumerate(trees):
        key = tree.priorities(held)
        for n in range(j, len(trees)):
            opened[n] += (key >= key.max(axis=1, keepdims=True) - margins[n]).sum() / len(held)
    n = int(opened.argmin())
    floor = float(np.quantile(rows.column("sim").to_numpy(), (1 - cfg.recall) / 10, method="lower")) - float(SLACK)
    return n + 1, margins[n], floor


#: Removes the shuffle files of a query as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _merge_trees(parts: list[DataFrame]) -> DataFrame:
    """The neighbours found in several trees, each once. Trees are searched one after the other, and the shuffle files of
    one go before the next, so that only one has its rows on the disks."""
    conf = parts[0].sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        nn = reduce(DataFrame.unionByName, [materialize(part, "vector_tree") for part in parts])
    finally:
        conf.set(CLEANUP, before)
    return nn.repartition("id").groupBy("id", "neighbor_id").agg(F.max("similarity").alias("similarity"))


def _search(source: DataFrame, tree: KMeansTree, margin: float, floor: float, points: np.ndarray, held: np.ndarray, cfg: NeighborConfig) -> DataFrame:
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast((tree, margin))  # at most max_shards centroids

    def bins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home shard of each row and the (row, shard) visits to others."""
        top, delta = shared.value
        none = np.zeros(0, np.int64)
        homes, rows, shards = [none], [none], [none]
        for a in range(0, len(x), BLOCK):
            key = top.priorities(x[a : a + BLOCK])
            home = key.argmax(axis=1)
            near = key >= key.max(axis=1, keepdims=True) - delta
            near[np.arange(len(home)), home] = False
            row, shard = np.nonzero(near)
            homes.append(home)
            rows.append(row + a)
            shards.append(shard)
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(shards)

    tree_leaves, dim, cap = tree.n_leaves, cfg.dim, cfg.shard_cap
    # a hot shard is cut into parts of about shard_cap points, which were counted over all rows, and of 2 * shard_cap visits,
    # of which a sample tells how many there are for a point; so no task holds an unbounded group
    near = tree.priorities(held)
    near = near >= near.max(axis=1, keepdims=True) - margin
    visits = near.sum(axis=0) * (points.sum() / len(held))
    p_parts = np.maximum(1, np.ceil(points / cap)).astype(np.int64)
    q_parts = np.maximum(1, np.ceil(np.maximum(visits, points) / (2 * cap))).astype(np.int64)
    base = np.r_[0, np.cumsum(p_parts * q_parts)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, stored = usable_rows(b, dim)
            x = units(stored)
            home, row, shard = bins(x)
            # the row as a point: once for each query part of its home; as a query: once for each point part of all shards it opens
            salt = row_keys(x) if len(x) else np.zeros(0, np.int64)
            rows, cells, roles = [], [], []
            for j in range(int(q_parts.max())):
                m = np.flatnonzero(q_parts[home] > j)
                h = home[m]
                rows.append(m)
                cells.append(base[h] + (np.abs(salt[m] // 7) % p_parts[h]) * q_parts[h] + j)
                roles.append(np.zeros(len(m), np.int8))
            qrow, qshard = np.r_[np.arange(len(x)), row], np.r_[home, shard]
            for i in range(int(p_parts.max())):
                m = np.flatnonzero(p_parts[qshard] > i)
                h, r = qshard[m], qrow[m]
                rows.append(r)
                cells.append(base[h] + i * q_parts[h] + np.abs(salt[r] // 11) % q_parts[h])
                roles.append(np.ones(len(m), np.int8))
            r, c, role = np.concatenate(rows), np.concatenate(cells), np.concatenate(roles)
            # one row may stand for both roles in a cell
            o = np.lexsort((role, c, r))
            r, c, role = r[o], c[o], role[o]
            both = np.r_[(r[1:] == r[:-1]) & (c[1:] == c[:-1]), False] if len(r) else np.zeros(0, bool)
            drop = np.r_[False, both[:-1]] if len(r) else both
            role = np.where(both, 2, role)[~drop]
            r, c = r[~drop], c[~drop]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ids[r]), pa.array(role.astype(np.int32)), _bytes_column(stored[r])], names=["cell", "id", "role", "x"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds one cell, which is bounded."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, role = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
        x = np.frombuffer(b"".join(v for b in held for v in b.column(3).to_pylist()), np.float32).reshape(-1, dim)
        p = np.flatnonzero(role != 1)
        p = p[np.unique(ids[p], return_index=True)[1]]
        q = np.flatnonzero(role != 0)
        q = q[np.unique(ids[q], return_index=True)[1]]
        if len(p) and len(q):
            a, n, s = search_shard(ids[p], x[p], ids[q], x[q], cfg, floor)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(s)], names=["id", "neighbor_id", "similarity"])

    routed = source.mapInArrow(route, "cell long, id long, role int, x binary")
    return routed.repartitionById(int(base[-1]), F.col("cell").cast("int")).mapInArrow(search, "id long, neighbor_id long, similarity double")


def _expand_copies(nn: DataFrame, members: DataFrame, copied: DataFrame, k: int) -> DataFrame:
    """Give copies of a neighbour, and members of a group of copies, the rows the collapsed search left out."""
    order = Window.partitionBy("key").orderBy("id")
    group = members.join(copied.select("key", "rep"), "key")
    first = group.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("rep", F.col("id").alias("copy"))
    wide = nn.join(first.withColumnRenamed("rep", "neighbor_id"), "neighbor_id", "left").select("id", F.coalesce("copy", "neighbor_id").alias("neighbor_id"), "similarity")
    own = first.select(F.col("rep").alias("id"), F.col("copy").alias("neighbor_id"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor_id")
    ranked = wide.unionByName(own).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    # each member takes over the list of its representative, without itself; members of a large group are dealt out in
    # slices, each with a copy of that list of k + 1 rows, so that no task gets the whole group
    sizes = copied.select("rep", F.ceil(F.col("n") / COPY_SLICE).cast("int").alias("slices"))
    lists = ranked.join(sizes.withColumnRenamed("rep", "id"), "id", "left")
    alone = lists.where("slices is null").select("id", "neighbor_id", "similarity")
    dealt = lists.where("slices is not null").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumnRenamed("id", "rep").drop("slices")
    of_member = group.join(sizes, "rep").select("rep", F.col("id").alias("member"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    taken = of_member.join(dealt, ["rep", "slice"]).select(F.col("member").alias("id"), "neighbor_id", "similarity")
    return alone.unionByName(taken).where("id != neighbor_id")


#: Members of a group of copies that one task gives their neighbours.
COPY_SLICE = 4_096


def neighbor_pairs(vectors: DataFrame, cfg: NeighborConfig = NeighborConfig()) -> DataFrame:
    """(chunk_id_a, chunk_id_b), smaller first, each once: one is among the other's k most similar."""
    nn = nearest_vectors(vectors, cfg)
    return nn.select(F.least("id", "neighbor_id").alias("chunk_id_a"), F.greatest("id", "neighbor_id").alias("chunk_id_b")).distinct()
