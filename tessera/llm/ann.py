"""Nearest neighbours by one navigable small-world hierarchy per shard, kept as flat neighbour arrays (operator 4).

Nodes enter a shard's graph by search: those already in it are searched for the newcomer's neighbours, layer by layer, newcomers in
batches no larger than what is there, so that a search of all of a batch is a few numpy steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

LINKS, EF_BUILD, EF_SEARCH, SHARD_ROWS, QUERY_BLOCK, SALTS = 12, 40, 256, 8_192, 4_096, 64
FIRST, BATCH, MAX_TASKS = 48, 1_024, 20_000
INDEX = "shard int, dim int, n int, vectors binary, id_start binary, ids binary, node_start binary, nodes binary, width binary, links binary"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids: no more of equal vectors can be among the nearest.

    Ids are cut down within salts first, so that a vector which a third of the rows share is not gathered in one task.
    """
    few = lambda ids: F.slice(F.sort_array(F.array_distinct(ids)), 1, keep)
    part = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).groupBy("vec", "salt").agg(few(F.collect_list("vec_id")).alias("ids"))
    return part.groupBy("vec").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))


def heights(seeds: np.ndarray, links: int = LINKS) -> np.ndarray:
    """A node's top layer, drawn from its hash: each layer holds about 1 in ``links`` of the nodes below it."""
    u = (seeds.astype(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(links)).astype(int)


def chosen(x: np.ndarray, q: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of each row's candidates (``near``, nearest first, -1 where none): one is linked if it is nearer to the node than
    to all links before it, spare places go to the nearest others."""
    v = x[np.maximum(near, 0)]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    there, kept = near >= 0, np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        kept[:, j] = there[:, j] & ~(kept[:, :j] & (between[:, j, :j] < dist[:, j, None])).any(1) & (kept.sum(1) < most)
    order = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1)


def link_back(x: np.ndarray, flat: np.ndarray, new: np.ndarray, links: np.ndarray) -> None:
    """Make the newcomers' links run both ways: a node with more neighbours than places keeps those that ``chosen`` takes."""
    src, dst = np.repeat(new, links.shape[1]), links.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    hubs, first, count = np.unique(dst, return_index=True, return_counts=True)
    wide = flat.shape[1]
    room = np.full((len(hubs), int(count.max())), -1, np.int64)
    room[np.repeat(np.arange(len(hubs)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    both = np.concatenate([flat[hubs].astype(np.int64), room], 1)
    for s in range(0, len(hubs), 512):
        c, h = both[s : s + 512], hubs[s : s + 512]
        d = ((x[np.maximum(c, 0)] - x[h][:, None, :]) ** 2).sum(2)
        d[c < 0] = np.inf
        rank = np.argsort(d, axis=1, kind="stable")[:, : 2 * wide]
        c, d = np.take_along_axis(c, rank, 1), np.take_along_axis(d, rank, 1)
        full = (c >= 0).sum(1) > wide
        out = c[:, :wide]
        if full.any():
            out[full] = chosen(x, x[h[full]], c[full], d[full], wide)
        flat[h, : out.shape[1]] = out


def build(x: np.ndarray, seeds: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, batch: int = BATCH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers from the bottom up: the nodes of each, and their neighbours as a flat array of places in that layer.

    Nodes enter in the order of ``x``; each batch finds its candidates by a search of the graph so far, down the layers, and among itself.
    """
    n, x = len(x), x.astype(np.float32)
    top = heights(seeds, links)
    nodes = [np.flatnonzero(top >= k) for k in range(int(top.max(initial=0)) + 1)]
    flat = [np.full((len(m), 2 * links), -1, np.int32) for m in nodes]
    done = 0
    while done < n:
        upto = min(n, max(FIRST, min(2 * done, done + batch)))
        entry = None
        for k in range(len(nodes) - 1, -1, -1):
            m, xs = nodes[k], x[nodes[k]]
            old, end = int(np.searchsorted(m, done)), int(np.searchsorted(m, upto))
            q = x[done:upto]
            if old:
                # Above their own top layer newcomers only pass through.
                if entry is None:
                    entry = np.tile(np.arange(min(old, ef)), (len(q), 1))
                ids, dist = beam(xs[:old], flat[k][:old], q, entry, ef if k == 0 or old < 4 * ef else max(16, ef // 2))
            else:
                ids, dist = np.full((len(q), 1), -1, np.int64), np.full((len(q), 1), np.inf, np.float32)
            if end > old:
                mine = m[old:end] - done
                own = ((xs[old:end][:, None, :] - xs[None, old:end]) ** 2).sum(2) if end - old < 64 else _squares(xs[old:end])
                own[np.arange(end - old), np.arange(end - old)] = np.inf
                near = np.argsort(own, axis=1, kind="stable")[:, :ef]
                c = np.concatenate([ids[mine], np.where(np.isfinite(np.take_along_axis(own, near, 1)), near + old, -1)], 1)
                d = np.concatenate([dist[mine], np.take_along_axis(own, near, 1)], 1).astype(np.float32)
                rank = np.argsort(d, axis=1, kind="stable")[:, :ef]
                c, d = np.take_along_axis(c, rank, 1), np.take_along_axis(d, rank, 1)
                c[~np.isfinite(d)] = -1
                got = chosen(xs, xs[old:end], c, d, links)
                flat[k][old:end, : got.shape[1]] = got
                link_back(xs, flat[k], np.arange(old, end), got)
            if k:
                place = np.searchsorted(nodes[k - 1], m)
                entry = np.where(ids >= 0, place[np.maximum(ids, 0)], -1) if old else None
        done = upto
    return nodes, flat


def _squares(a: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)
    return np.maximum(sq[:, None] + sq[None, :] - 2 * (a @ a.T), 0)


def beam(x: np.ndarray, neighbours: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries at once: the ``ef`` nearest found, nearest first (-1 where none)."""
    m, n = len(q), len(x)
    ids = np.full((m, ef), -1, np.int64)
    dist, done, seen = np.full((m, ef), np.inf, np.float32), np.zeros((m, ef), bool), np.zeros((m, n + 1), bool)

    def merge(rows: np.ndarray, new: np.ndarray) -> None:
        fresh = (new >= 0) & ~seen[rows[:, None], new]
        # The same node reached twice in one step counts once.
        order = np.argsort(np.where(fresh, new, n), axis=1, kind="stable")
        new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
        fresh[:, 1:] &= ~((new[:, 1:] == new[:, :-1]) & fresh[:, :-1])
        at = np.flatnonzero(fresh.ravel())
        gap = x[new.ravel()[at]]
        gap -= q[rows[at // new.shape[1]]]
        d = np.full(new.shape, np.inf, np.float32)
        d.ravel()[at] = np.einsum("ij,ij->i", gap, gap)
        seen[rows[:, None], np.where(fresh, new, n)] = True
        all_d, all_i = np.concatenate([dist[rows], d], 1), np.concatenate([ids[rows], np.where(fresh, new, -1)], 1)
        all_done = np.concatenate([done[rows], ~fresh], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[rows], ids[rows], done[rows] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_i, best, 1), np.take_along_axis(all_done, best, 1)

    merge(np.arange(m), entry)
    while True:
        open_ = ~done & (ids >= 0)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return ids, dist
        first = np.argsort(~open_[rows], axis=1, kind="stable")[:, :wide]
        usable_ = np.take_along_axis(open_[rows], first, 1)
        pick = np.where(usable_, np.take_along_axis(ids[rows], first, 1), -1)
        done[rows[:, None], first] = True
        found = neighbours[np.maximum(pick, 0)]
        found = np.where(pick[:, :, None] >= 0, found, -1).reshape(len(rows), -1).astype(np.int64)
        merge(rows, found)


def search(x: np.ndarray, nodes: list[np.ndarray], neighbours: list[np.ndarray], q: np.ndarray, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Down the layers: the whole top layer is the entry, what a layer finds is the entry of the one below."""
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    entry = np.tile(np.arange(min(len(nodes[-1]), ef)), (len(q), 1))
    for level in range(len(nodes) - 1, -1, -1):
        ids, dist = beam(x32[nodes[level]], neighbours[level], q32, entry, ef if not level else max(16, ef // 2))
        if level:
            place = np.searchsorted(nodes[level - 1], nodes[level])
            entry = np.where(ids >= 0, place[np.maximum(ids, 0)], -1)
    return ids, dist


def build_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard with its distinct vectors, their ids and the layers (``INDEX``), written to the shared folder.

    ``rows``: vec_id and vec, usable ones only. Shards are dealt by a hash of the vector and hold about ``shard_rows`` of them.
    """
    flat = stage(distinct_vectors(rows, keep), "vectors")
    shards = max(1, -(-flat.count() // shard_rows))
    flat = flat.withColumn("seed", F.xxhash64("vec")).withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)).cast("int"))
    kind = "<f8" if "double" in rows.schema["vec"].dataType.simpleString() else "<f4"

    def run(key, t):
        t = t.sort_by([("seed", "ascending")])
        x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(t), -1)
        ids = t["ids"].combine_chunks()
        nodes, near = build(x, t["seed"].to_numpy().view(np.uint64))
        blob = lambda a, k: np.concatenate([np.asarray(y).ravel() for y in a] or [[]]).astype(k).tobytes()
        starts = np.cumsum([0, *ids.value_lengths().to_numpy()])
        row = {"shard": key[0].as_py(), "dim": key[1].as_py(), "n": len(t), "vectors": x.tobytes(), "id_start": starts.astype("<i8").tobytes(), "ids": ids.flatten().to_numpy().astype("<i8").tobytes()}
        row |= {"node_start": np.cumsum([0, *map(len, nodes)]).astype("<i8").tobytes(), "nodes": blob(nodes, "<i4"), "width": np.array([y.shape[1] for y in near], "<i8").tobytes(), "links": blob(near, "<i4")}
        return pa.table({k: pa.array([v], {"shard": pa.int32(), "dim": pa.int32(), "n": pa.int32()}.get(k, pa.binary())) for k, v in row.items()})

    index = stage(flat.groupBy("shard", "dim").applyInArrow(run, INDEX), "index")
    index.vector_kind = kind
    return index


def shard_blocks(index: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> tuple[DataFrame, int]:
    """Every shard's row next to every block of about ``block`` queries (``qid``, ``qvec``), a pair of them a task; and how many tasks.

    A shard's row comes right before its block. The pair's own number, not a hash, is the task, so no two pairs meet by chance.
    """
    blocks = max(1, -(-queries.count() // block))
    shards = index.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vec"))
    q = q.groupBy("block", "dim").agg(F.collect_list("vec_id").alias("qid"), F.flatten(F.collect_list("vec")).alias("qvec"))
    parts, names = min(MAX_TASKS, shards * blocks), ["shard", "block", "dim", "qid", "qvec", *(c.split()[0] for c in INDEX.split(", ")[2:])]
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    at = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = at.unionByName(q, allowMissingColumns=True).withColumn("part", F.pmod(F.col("shard") * blocks + F.col("block"), F.lit(parts)).cast("int"))
    return both.repartitionById(parts, "part").sortWithinPartitions("shard", "block", "dim", F.col("qid").isNotNull()).select(*names), parts


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of each query in every shard, merged: query_id, rank, vec_id, score. ``queries``: vec_id and vec."""
    kind, pairs = index.vector_kind, shard_blocks(index, queries, block)[0]

    def run(batches):
        shard: dict = {}
        for b in batches:
            for r in b.to_pylist():
                if r["qid"] is None:
                    shard = r
                    continue
                if (shard.get("shard"), shard.get("block"), shard.get("dim")) != (r["shard"], r["block"], r["dim"]):
                    continue  # no vector of this length in the shard
                r = shard | {"qid": r["qid"], "qvec": r["qvec"]}
                x = np.frombuffer(r["vectors"], kind).reshape(r["n"], r["dim"])
                at, width, nodes, flat = (np.frombuffer(r[c], t) for c, t in (("node_start", "<i8"), ("width", "<i8"), ("nodes", "<i4"), ("links", "<i4")))
                layers = [nodes[s:e] for s, e in zip(at, at[1:], strict=False)]
                ends = np.cumsum([0, *(len(y) * w for y, w in zip(layers, width, strict=True))])
                near = [flat[s:e].reshape(-1, w) for s, e, w in zip(ends, ends[1:], width, strict=False)]
                start, ids = np.frombuffer(r["id_start"], "<i8"), np.frombuffer(r["ids"], "<i8")
                qid, qvec = np.array(r["qid"]), np.array(r["qvec"], float).reshape(-1, r["dim"])
                found, _ = search(x, layers, near, qvec, max(ef, k + 1))
                out: list[tuple] = []
                for i, hits in enumerate(found):
                    hits = hits[hits >= 0][: 2 * k + 8]
                    sq = (x[hits].astype(float) - qvec[i]) ** 2
                    d = np.sqrt(np.add.accumulate(sq, axis=1)[:, -1]) if len(hits) else np.zeros(0)  # summed from the first component on
                    mine = [(float(s), int(v)) for s, h in zip(d, hits, strict=True) for v in ids[start[h] : start[h + 1]] if v != qid[i]]
                    out += [(int(qid[i]), v, s) for s, v in sorted(mine)[:k]]
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = EF_SEARCH) -> DataFrame:
    """The ``k`` nearest of every row whose id is a multiple of ``every`` among all other rows, by Euclidean distance.

    Null ids, and vectors that are null, empty, zero or not finite, take no part; vectors of different lengths never meet. Equal
    distances go to the smaller id; with fewer candidates than ``k`` all are returned; an empty table gives an empty table.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    index = build_index(rows, k + 1)
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return search_index(index, queries, k, ef)
