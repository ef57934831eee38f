"""Near duplicates among embeddings by hierarchical navigable small-world graphs.

Equal vectors form one class. Classes are dealt over shards of at most SHARD_ROWS; each shard gets a graph of its own,
and every class queries every shard of its dimension. A beam is widened while its last hit still links, and all beams of
a task until the recall of an audit against brute force, the mean over audited queries that have a partner, reaches
AUDIT_RECALL; a task in which no beam reaches it compares all pairs. Hits are verified by their cosine in double
precision, and the components of the links are joined up. A vector's links are those that its own search finds; a
component follows the links found from either end.

A task returns counts of links and, of the links themselves, a spanning forest: as many rows as vectors, however large
a group of near copies is.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different dimension don't link. Equal vectors under different (or equal) ids link. A null id never names a component and
is kept only if its component has no id at all. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

COSINE = 0.9
SHARD_ROWS = 65_536
#: A shard has fewer rows where its vectors would take more bytes.
SHARD_BYTES = 1 << 28
MIN_SHARDS = 8
QUERY_BLOCK = 262_144
#: Links of a node (twice as many on the ground layer), beam while building, first beam of a query.
LINKS, BUILD_BEAM, BEAM = 12, 48, 48
#: An audit takes queries in steps of so many, until so many of them have a partner or so many steps are done; recall to reach.
AUDIT_QUERIES, AUDIT_LINKED, AUDIT_STEPS, AUDIT_RECALL = 256, 64, 16, 0.99
_WIDTH = 4  # nodes that a beam expands at a time
_LOCKSTEP = 256  # queries that move together
#: Links that a task holds before it folds them into a forest.
HELD_LINKS = 1 << 20


class Graph:
    """A layered graph over unit vectors. Queries move in lockstep, so that each move is a few array operations."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 3):
        n, d = vectors.shape
        self.n = n
        self.x = np.zeros((n + 1, d), np.float32)  # a zero row stands for "no node"
        self.x[:n] = vectors
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(links)), 8).astype(int)
        order = np.argsort(-level, kind="stable")
        self.level, self.entry = level, int(order[0]) if n else 0
        top = int(level.max()) if n else 0
        self.near = [np.full((n + 1, links * (2 if k == 0 else 1)), n, np.int32) for k in range(top + 1)]
        at = 0
        while at < n:
            step = min(_LOCKSTEP, max(32, at // 4))
            self._insert(order[at : at + step], order[:at], links, beam)
            at += step

    def _insert(self, new: np.ndarray, old: np.ndarray, links: int, beam: int) -> None:
        entry = np.full(len(new), self.entry)
        for k in range(len(self.near) - 1, -1, -1):
            here = self.level[new] >= k
            present = old[self.level[old] >= k]
            if not len(present) and not here.any():
                continue
            if len(present) > 2 * beam:
                ids, _ = self.search(self.x[new], beam if here.any() else 1, k, entry)
            elif len(present):
                sims = self.x[new] @ self.x[present].T
                ids = present[np.argsort(-sims, axis=1)]
            else:
                ids = np.full((len(new), 1), self.n)
            entry = np.where(ids[:, 0] < self.n, ids[:, 0], entry)
            mates = new[here]
            if not len(mates):
                continue
            among = self.x[mates] @ self.x[mates].T
            np.fill_diagonal(among, -2)
            some = min(links, len(mates) - 1)
            near = mates[np.argsort(-among, axis=1)[:, :some]] if some else np.zeros((len(mates), 0), int)
            chosen = self._diverse(mates, np.concatenate((ids[here], near), axis=1), links)
            self.near[k][mates, : chosen.shape[1]] = chosen
            self._link_back(mates, chosen, k)

    def _link_back(self, mates: np.ndarray, chosen: np.ndarray, k: int) -> None:
        near = self.near[k]
        src = np.repeat(mates, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst < self.n], dst[dst < self.n]
        if not len(dst):
            return
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), self.n, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate((near[nodes], extra), axis=1)
        for a in range(0, len(nodes), 1024):
            kept = self._diverse(nodes[a : a + 1024], both[a : a + 1024], near.shape[1])
            near[nodes[a : a + 1024]] = self.n
            near[nodes[a : a + 1024], : kept.shape[1]] = kept

    def _diverse(self, nodes: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of the found nodes: those nearer to the node than to any chosen before, then the nearest left."""
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = self.n
        found[found == nodes[:, None]] = self.n
        sims = np.einsum("bkd,bd->bk", self.x[found], self.x[nodes])
        sims[found == self.n] = -3
        o = np.argsort(-sims, axis=1)[:, : 4 * most]
        found, sims = np.take_along_axis(found, o, 1), np.take_along_axis(sims, o, 1)
        v = self.x[found]
        between = v @ v.transpose(0, 2, 1)
        b, c = found.shape
        taken = np.zeros((b, c), bool)
        closest = np.full((b, c), -3.0, np.float32)  # to anything chosen
        for j in range(c):
            ok = (sims[:, j] > closest[:, j]) & (found[:, j] < self.n) & (taken.sum(1) < most)
            taken[:, j] = ok
            closest[ok] = np.maximum(closest[ok], between[ok, :, j])
        rank = np.argsort(np.where(taken, 0, 1) * 4 - sims, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(found, rank, 1)

    def search(self, q: np.ndarray, beam: int, layer: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest nodes found for each query, nearest first; n where there are fewer."""
        n, near = self.n, self.near[layer]
        b = len(q)
        rows = np.arange(b)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        seen[rows, entry] = True
        ids, sims, fresh = np.full((b, beam), n), np.full((b, beam), -3.0, np.float32), np.zeros((b, beam), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = entry, np.einsum("bd,bd->b", self.x[entry], q), True
        width = min(_WIDTH, beam)
        act = rows
        while True:
            s = np.where(fresh[act], sims[act], -4)
            top = np.argpartition(-s, width - 1, axis=1)[:, :width] if beam > width else np.tile(np.arange(beam), (len(act), 1))
            ok = np.take_along_axis(s, top, 1) > -4
            live = ok.any(1)
            act, top, ok = act[live], top[live], ok[live]
            if not len(act):
                break
            src = ids[act[:, None], top]
            fresh[act[:, None], top] = False
            nb = near[src]
            nb[~ok] = n
            nb = nb.reshape(len(act), -1)
            nb[seen[act[:, None], nb]] = n
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
            seen[act[:, None], nb] = True
            sn = np.einsum("akd,ad->ak", self.x[nb], q[act])
            sn[nb == n] = -3
            all_ids, all_sims = np.concatenate((ids[act], nb), 1), np.concatenate((sims[act], sn), 1)
            all_fresh = np.concatenate((fresh[act], nb < n), 1)
            o = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[act], sims[act], fresh[act] = np.take_along_axis(all_ids, o, 1), np.take_along_axis(all_sims, o, 1), np.take_along_axis(all_fresh, o, 1)
        o = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.entry)
        for k in range(len(self.near) - 1, 0, -1):
            entry = self.search(q, 1, k, entry)[0][:, 0]
        return self.search(q, min(beam, max(self.n, 1)), 0, entry)

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the hits with at least that cosine, some queries at a time; a beam full of hits is widened
        until it isn't."""
        for a in range(0, len(q), _LOCKSTEP):
            todo, wide = np.arange(a, min(len(q), a + _LOCKSTEP)), beam
            while len(todo):
                step = max(1, _LOCKSTEP * 4096 // max(4096, min(wide, self.n)))  # wide beams: fewer queries together
                again = []
                for x in range(0, len(todo), step):
                    some = todo[x : x + step]
                    ids, sims = self.query(q[some], wide)
                    full = (sims[:, -1] >= least) & (wide < self.n)
                    r, c = np.nonzero((sims >= least) & ~full[:, None])
                    yield some[r], ids[r, c]
                    again.append(some[full])
                todo, wide = np.concatenate(again), wide * 4


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def brute(queries: np.ndarray, nodes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all pairs with at least that cosine, some queries at a time."""
    nodes = nodes.astype(np.float32)
    for a in range(0, len(queries), _LOCKSTEP):
        r, c = np.nonzero(queries[a : a + _LOCKSTEP].astype(np.float32) @ nodes.T >= least)
        yield r + a, c


def audit_sample(queries: np.ndarray, nodes: np.ndarray, own: np.ndarray, least: float) -> list[tuple[int, np.ndarray]]:
    """(query, its true partners) of evenly spread queries that have a partner besides themselves: as many steps of
    AUDIT_QUERIES, up to AUDIT_STEPS, as it takes to find AUDIT_LINKED of them."""
    out: list[tuple[int, np.ndarray]] = []
    spread = np.random.default_rng(5).permutation(len(queries))
    for step in range(AUDIT_STEPS):
        some = spread[step * AUDIT_QUERIES : (step + 1) * AUDIT_QUERIES]
        if not len(some) or len(out) >= AUDIT_LINKED:
            break
        for r, c in brute(queries[some], nodes, least):
            other = c != own[some[r]]
            r, c = r[other], c[other]
            at = np.flatnonzero(np.diff(r, prepend=-1))
            out += [(int(some[r[i]]), part) for i, part in zip(at, np.split(c, at[1:]), strict=True)] if len(r) else []
    return out


def find_links(graph: Graph, nodes: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], float]:
    """((query, node) of all links, some queries at a time; the recall of the last audit, the mean over audited queries).

    nodes and queries: double unit vectors; own: each query's own node, or -1. Beams are widened until the audit passes;
    where no beam does, every query is compared with every node.
    """
    least = cosine - 1e-5
    truth = audit_sample(queries, nodes, own, least)
    q = queries.astype(np.float32)
    recall = 1.0
    if truth:
        asked = np.array([i for i, _ in truth])
        sizes = np.array([len(c) for _, c in truth])
        wanted = np.repeat(np.arange(len(truth)), sizes) * graph.n + np.concatenate([c for _, c in truth])
        while True:
            hits = [a * graph.n + b for a, b in graph.within(q[asked], least, beam)]
            held = np.isin(wanted, np.concatenate(hits)) if hits else np.zeros(len(wanted), bool)
            recall = float((np.add.reduceat(held, np.cumsum(sizes) - sizes) / sizes).mean())
            if recall >= AUDIT_RECALL or beam >= graph.n:
                break
            beam *= 2

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in graph.within(q, least, beam) if recall >= AUDIT_RECALL else brute(queries, nodes, least):
            for x in range(0, len(a), 1 << 18):
                i, j = a[x : x + (1 << 18)], b[x : x + (1 << 18)]
                true = (np.einsum("ij,ij->i", queries[i], nodes[j]) >= cosine) & (j != own[i])
                yield i[true], j[true]

    return links(), recall


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (name, least name of its component) that connect what the links (a, b) connect."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(names))
    return names[keep], names[root[keep]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, cid (the name of equal valid vectors; null for others), dim, unit (the direction, as bytes of doubles)."""
    C.ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            col = b.column(1)
            sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(col), 0), np.int64)
            flat = col.flatten()
            bad = np.zeros(n, bool)
            values = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
            owner = np.repeat(np.arange(n), sizes)
            np.logical_or.at(bad, owner[~np.isfinite(values)], True)
            values = np.where(np.isfinite(values), values, 0)
            at = np.cumsum(sizes) - sizes
            cid, dim, unit = [], [], []
            for i in range(n):
                v = values[at[i] : at[i] + sizes[i]]
                big = np.abs(v).max() if len(v) else 0.0
                if bad[i] or big == 0:
                    cid.append(None)
                    dim.append(int(sizes[i]))
                    unit.append(None)
                    continue
                v = v + 0.0  # -0.0 counts as 0.0
                h = C.mix64((v.view(np.uint64) ^ np.arange(len(v), dtype=np.uint64)) * np.uint64(0xD1342543DE82EF95) + np.arange(1, len(v) + 1, dtype=np.uint64))
                cid.append(int(C.mix64(h.sum(dtype=np.uint64, keepdims=True) + np.array([len(v)], np.uint64)).view(np.int64)[0]))
                dim.append(len(v))
                v = v / big  # no overflow in the norm
                unit.append((v / np.sqrt((v * v).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], names=["vec_id", "cid", "dim", "unit"])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, cid long, dim int, unit binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, beam: int = BEAM) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id."""
    rows = C.cut(classes(vectors, id_col, vec_col))
    one = C.cut(rows.where("cid is not null").groupBy("cid").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.count("*").alias("m"), F.min("vec_id").alias("least")))
    size = one.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    total = size.n
    shards = max(MIN_SHARDS, -(-total // max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (size.dim or 1))))))
    blocks = max(1, -(-total // QUERY_BLOCK))
    nodes = one.select("cid", "dim", "unit", "m", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))
    asked = one.select("cid", "dim", "unit", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def build(t: pa.Table) -> pa.Table:
        x = _matrix(t["unit"])
        g = Graph(x.astype(np.float32))
        layers = [a.astype(np.int32).tobytes() for a in g.near]
        return pa.table({"dim": pa.array([t["dim"][0].as_py()], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "cids": pa.array([t["cid"].to_pylist()], pa.list_(pa.int64())), "ms": pa.array([t["m"].to_pylist()], pa.list_(pa.int64())), "units": pa.array([x.tobytes()], pa.binary()), "entry": pa.array([g.entry], pa.int32()), "layers": pa.array([layers], pa.list_(pa.binary()))})

    graphs = C.cut(nodes.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, cids array<long>, ms array<long>, units binary, entry int, layers array<binary>"))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "linked": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        dim = left["dim"][0].as_py()
        cids = np.array(left["cids"][0].as_py(), np.int64)
        ms = np.array(left["ms"][0].as_py(), np.int64)
        x = np.frombuffer(left["units"][0].as_py(), np.float64).reshape(len(cids), dim)
        g = Graph.__new__(Graph)
        g.n, g.entry = len(cids), left["entry"][0].as_py()
        g.x = np.zeros((g.n + 1, dim), np.float32)
        g.x[: g.n] = x
        g.near = [np.frombuffer(a, np.int32).reshape(g.n + 1, -1).copy() for a in left["layers"][0].as_py()]
        names = np.asarray(right["cid"].to_numpy(), np.int64)
        order = np.argsort(cids)
        place = np.minimum(np.searchsorted(cids[order], names), len(cids) - 1)
        own = np.where(cids[order[place]] == names, order[place], -1)
        links, _ = find_links(g, x, _matrix(right["unit"]), own, cosine, beam)
        # of the links only their counts and a spanning forest are held
        counts = np.zeros(len(names), np.int64)
        fa, fb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in links:
            counts += np.bincount(i, ms[j], len(names)).astype(np.int64)
            held.append((names[i], cids[j]))
            if sum(len(x) for x, _ in held) > HELD_LINKS:
                fa, fb = _forest(np.concatenate([fa, *[x for x, _ in held]]), np.concatenate([fb, *[y for _, y in held]]))
                held = []
        fa, fb = _forest(np.concatenate([fa, *[x for x, _ in held]]), np.concatenate([fb, *[y for _, y in held]]))
        has = np.flatnonzero(counts)
        blank = pa.nulls(len(fa), pa.int64())
        return pa.table({"a": pa.array(np.concatenate((fa, names[has]))), "b": pa.concat_arrays([pa.array(fb, pa.int64()), pa.nulls(len(has), pa.int64())]), "linked": pa.concat_arrays([blank, pa.array(counts[has], pa.int64())])})

    found = C.cut(dealt.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(ask, "a long, b long, linked long"))
    counted = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    labels = components(found.where("b is not null"))
    named = one.select("cid", "m", "least").join(counted, "cid", "left").join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    each = named.join(least, "comp").select("cid", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id").where("n_links > 0")
    out = C.join_small(rows.select("vec_id", "cid"), C.cut(each), "cid")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(C.table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
