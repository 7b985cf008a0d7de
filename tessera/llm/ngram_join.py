"""N-gram Jaccard join with signature trees (operator 1).

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.8. Equal sets are one node. Prefix
filtering splits the nodes before the search: under one global order of shingles, rarest first, two linked sets share ``SHARED`` among
their first n - ceil(0.8 n) + ``SHARED``. Groups that share such a shingle go into blocks, small groups many to a block; each block is a
signature tree (or two), and the dual traversal finds the pairs worth an exact comparison, whatever groups they come from. Pairs already
connected are not compared again, as only components are asked for.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_staged, release, sliced, stage
from tessera.llm.components import components

SHINGLE = 5
NUM, DEN = 4, 5  # the similarity, 0.8
SKETCH_BITS, SLICES, FOLD, NEAR = 24, 64, 64, 16
#: The bit filter has 16 to 32 bits a node between these sizes; a fuller one lets more sets through, which costs a shuffle of them.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 20, 29
BLOCK, FANOUT = 96, 8
#: Shingles that two linked sets share within their prefixes at least, and how many nodes may share one to be paired off singly.
SHARED, FEW = 4, 8
#: A shingle whose bucket has a rank below this is in at most FEW - 1 documents.
COMMON_RANK = 12
#: Shingles are looked up in so many slices of their hashes, one after the other, so that only a slice of all postings is on disk at once.
TOKEN_SLICES = 4
#: Size bands (5 to a factor of 0.8 each way) and shares of rare shingles by which a large group is cut into classes.
BAND, SHARES = 1.05, 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space; all words as one where
    there are fewer than five; nothing for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (w[i : len(w) - k + 1 + i] * _MIX[i])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def node_of(h: np.ndarray) -> int:
    """A set's node: 63 bits of a digest of all its hashes."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little") >> 1


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return (NUM * n + DEN - 1) // DEN


def prefix_size(n: int) -> int:
    """Two sets that share k shingles share j of them among the first n - k + j of each, under one order of all shingles."""
    k = least_overlap(n)
    return n - k + min(SHARED, k)


def _slices(whole: np.ndarray) -> list[dict]:
    z = zstandard.ZstdCompressor(level=1)
    return [{"slice": i, "data": z.compress(np.ascontiguousarray(x).tobytes())} for i, x in enumerate(np.split(whole, SLICES)) if x.any()]


def fold(slices: DataFrame, kind: str, size: int, op, finish=None) -> np.ndarray:
    """Combine the tasks' parts (slice, data) of one array of ``size`` elements: in two steps on the cluster, then at the driver,
    which holds just that one array of bytes (``finish`` makes them). Its size is a parameter and does not grow with the data. The first
    step joins the parts of ``NEAR`` tasks or more, so that little is left for the second."""
    unzip = lambda b: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)

    def merged(key, t, last):
        out = None
        for b in t["data"].to_pylist():
            out = unzip(b) if out is None else op(out, unzip(b))
        out = last(out) if last else out
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zstandard.ZstdCompressor(level=1).compress(out.tobytes())], pa.binary())})

    parts = slices.withColumn("part", F.pmod(F.floor(F.spark_partition_id() / NEAR), F.lit(FOLD))).groupBy("slice", "part").applyInArrow(lambda key, t: merged(key, t, None), "slice int, data binary")
    whole = np.zeros(size, np.uint8)
    step = size // SLICES
    for r in parts.groupBy("slice").applyInArrow(lambda key, t: merged(key, t, finish), "slice int, data binary").toLocalIterator():
        whole[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["data"])), np.uint8)
    return whole


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, by quarter powers of two."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def survey(docs: DataFrame) -> DataFrame:
    """Of every document its set's size and node; of every task its part of a sketch that counts all shingles by hash bucket."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        empty = pa.array([], pa.int64())
        for b in sliced(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            if any(map(len, sets)):
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "n_shingles", "node", "slice", "data"],
            )
        parts = _slices(counts)
        none = [None] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64())] * 3 + [pa.array([p["slice"] for p in parts], pa.int32()), pa.array([p["data"] for p in parts], pa.binary())], names=["doc_id", "n_shingles", "node", "slice", "data"]) if parts else pa.RecordBatch.from_arrays([empty, empty, empty, pa.array([], pa.int32()), pa.array([], pa.binary())], names=["doc_id", "n_shingles", "node", "slice", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, slice int, data binary")


def prefixes(docs: DataFrame, rank: np.ndarray, reps: DataFrame) -> DataFrame:
    """Of each node (once, but for a few copies): its set's size, how many of its shingles may be common, and its first ones in the global
    order (rarer bucket, then hash)."""
    shared = docs.sparkSession.sparkContext.broadcast((rank, filter_of(reps, reps.count())))

    def run(batches):
        r, have = shared.value
        for b in sliced(batches):
            nodes, sizes, common, tokens = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = shingles(t)
                if len(h) and _has(have, np.array([node := node_of(h)]), np.array([d]))[0]:
                    p = prefix_size(len(h))
                    rare = r[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = (rare.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                    first = np.argpartition(order, p - 1)[:p] if p < len(h) else np.arange(len(h))
                    nodes.append(node)
                    sizes.append(len(h))
                    common.append(int((rare >= COMMON_RANK).sum()))
                    tokens.append(h[first].view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "n", "c", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, n long, c long, tokens array<long>")


def _filter_slots(node: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    x = (node.astype(np.uint64) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(wanted: DataFrame, rows: int) -> np.ndarray:
    """A bit array over (node, rep) of ``rows`` wanted ones: what it lacks is not wanted, so its set need not be shuffled."""
    bits = max(LEAST_FILTER_BITS, min(MOST_FILTER_BITS, (16 * rows).bit_length()))

    def run(batches):
        got = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            slot = _filter_slots(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)
            np.bitwise_or.at(got, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        parts = _slices(got)
        yield pa.RecordBatch.from_arrays([pa.array([p["slice"] for p in parts], pa.int32()), pa.array([p["data"] for p in parts], pa.binary())], names=["slice", "data"])

    return fold(wanted.select("node", "rep").mapInArrow(run, "slice int, data binary"), "u1", (1 << bits) // 8, np.bitwise_or)


def _has(array: np.ndarray, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    slot = _filter_slots(node, doc, len(array).bit_length() + 2)
    return (array[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, rep) and the node's set for each wanted (node, rep), in place: no shuffle.

    A few others pass the filter too, and repeated rows repeat; whoever joins on (node, rep) drops the former, the latter do no harm.
    """
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, wanted.count()))

    def run(batches):
        have = bits.value
        for b in sliced(batches):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = shingles(t)
                if len(h) and d is not None and _has(have, np.array([node := node_of(h)]), np.array([d]))[0]:
                    rows.append((node, d, h.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["node", "rep", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, rep long, shingles binary")


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of at least NUM / DEN, exactly: DEN * intersection >= NUM * union."""
    x = np.concatenate([a, b])
    x.sort()
    both = int((x[1:] == x[:-1]).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


class SignatureTree:
    """Levels of nodes over a list of sets, leaves first. A node holds the OR of its leaves' token bitmaps, the range of their sizes,
    and by how much a leaf's size exceeds the bits it sets at most."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = len(sets)
        maps = np.zeros((n, bits), np.float32)
        for i, s in enumerate(sets):
            maps[i, (s % np.uint64(bits)).astype(np.int64)] = 1
        size = np.array([len(s) for s in sets], np.int64)
        over = size - maps.sum(1).astype(np.int64)
        self.levels = [(maps, size, size, over)]
        while len(self.levels[-1][0]) > FANOUT:
            maps, low, high, over = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.maximum.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))

    def pairs(self, other: SignatureTree) -> np.ndarray:
        """Dual traversal: pairs of leaves (one of each tree) that may link, the most promising first.

        No pair below two nodes can share more shingles than their bitmaps share bits plus the smaller excess; a link needs
        4/9 of both sizes together, and sizes within a ratio of 4/5. Node pairs that cannot reach that are dropped with all below.
        """
        depth = min(len(self.levels), len(other.levels)) - 1
        a, b = (np.arange(len(x.levels[depth][0])) for x in (self, other))
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        while True:
            (ma, la, ha, oa), (mb, lb, hb, ob) = self.levels[depth], other.levels[depth]
            ua, ub = np.unique(i), np.unique(j)
            common = ma[ua] @ mb[ub].T
            most = common[np.searchsorted(ua, i), np.searchsorted(ub, j)].astype(np.int64) + np.minimum(oa[i], ob[j])
            most = np.minimum(most, np.minimum(ha[i], hb[j]))
            ok = ((NUM + DEN) * most >= NUM * (la[i] + lb[j])) & (DEN * ha[i] >= NUM * lb[j]) & (DEN * hb[j] >= NUM * la[i])
            i, j, most = i[ok], j[ok], most[ok]
            if not depth:
                order = np.argsort(-most, kind="stable")
                return np.stack([i[order], j[order]], 1)
            depth -= 1
            na, nb = len(self.levels[depth][0]), len(other.levels[depth][0])
            i = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            j = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            ok = (i < na) & (j < nb)
            i, j = i[ok], j[ok]


def join_group(nodes: list[int], sets: list[np.ndarray], known: list[int], split: int) -> list[tuple[int, int]]:
    """Links that connect what ``known`` (component labels) does not: of all pairs if ``split`` is 0, else of pairs between the first
    ``split`` members and all others."""
    n, parent = len(nodes), {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    # Leaves of like size stand together, and of those the ones with one least hash, as copies mostly have.
    by = lambda i: (round(math.log(len(sets[i])) / math.log(BAND)), int(sets[i][0]), nodes[i])
    order = sorted(range(split), key=by), sorted(range(split, n), key=by)
    bits = 1 << max(8, min(13, int(2 * max(map(len, sets))).bit_length()))
    right = SignatureTree([sets[i] for i in order[1]], bits) if order[1] else None
    left = SignatureTree([sets[i] for i in order[0]], bits) if split else right
    if right is None or left is None:
        return []
    out, first = [], order[0] if split else order[1]
    for i, j in left.pairs(right).tolist():
        a, b = first[i], order[1][j]
        if nodes[a] == nodes[b] or (not split and i > j):
            continue
        ra, rb = find(known[a]), find(known[b])
        if ra != rb and linked(sets[a], sets[b]):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((nodes[a], nodes[b]))
    return out


def join_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) of every block. ``rows``: the keys, node, label, side and shingles; a block's rows are few (``BLOCK``, or twice that).

    Blocks with rows of side 0 compare those with side 1; others compare all rows.
    """

    def run(batches):
        key, held = None, []

        def finish():
            held.sort(key=lambda r: (r[2], r[0]))
            split = sum(not r[2] for r in held)
            return join_group([r[0] for r in held], [unpack(r[3]) for r in held], [r[1] for r in held], split if split < len(held) else 0) if len(held) > 1 else []

        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in [*keys, "node", "label", "side", "shingles"]), strict=True):
                if r[: len(keys)] != key:
                    out += finish()
                    key, held = r[: len(keys)], []
                held.append(r[len(keys) :])
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])
        out = finish()
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])

    cols = [*keys, "node", "label", "side", "shingles"]
    return rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def bundled(rows: DataFrame, small: Column, key: Column) -> DataFrame:
    """Give each row its block: ``key`` of its group, or, of a small group, one of so many that about ``BLOCK`` rows share it.

    Groups in one block are compared with each other too, which costs a walk of their tree and loses nothing.
    """
    rows = rows.withColumn("small", small)
    n = rows.where("small").count()
    return rows.withColumn("block", F.when(F.col("small"), -1 - F.pmod(key, F.lit(max(1, n // BLOCK)))).otherwise(F.abs(key))).drop("small")


def class_pairs(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (one, two) of classes of a group that may hold a link of which no rare shingle tells, with the rows of each.

    ``every``: hub, node, n, c, label, main. A class has one size band and one share of rare shingles. Two sets that share no rare shingle
    share at most the fewer of their common ones, and a link needs 4/9 of both sizes together: classes that can't reach that are not
    paired, so a passage that many share, each with words of its own, makes no pairs at all.
    """
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)) * (SHARES + 1) + F.floor((F.col("n") - F.col("c")) * SHARES / F.col("n"))
    classed = every.withColumn("kind", kind.cast("long"))
    stats = classed.groupBy("hub", "kind").agg(F.count("*").alias("rows"), F.count_if(F.col("label") != F.col("main")).alias("odd"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("c").alias("c"))
    one = stats.where("odd > 0").select("hub", *(F.col(x).alias(f"{x}1") for x in ("kind", "odd", "low", "high", "c")))
    two = stats.select("hub", *(F.col(x).alias(f"{x}2") for x in ("kind", "rows", "low", "high", "c")))
    able = ((NUM + DEN) * F.least("c1", "c2") >= NUM * (F.col("low1") + F.col("low2"))) & (DEN * F.col("high1") >= NUM * F.col("low2")) & (DEN * F.col("high2") >= NUM * F.col("low1"))
    return classed, one.join(two, "hub").where(able).select("hub", "kind1", "kind2", F.ceil(F.col("odd1") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("rows2") / BLOCK).cast("int").alias("blocks"))


def cross_blocks(every: DataFrame) -> DataFrame:
    """What large groups still have to compare: nodes outside the hub's component (side 0) with all of the group (side 1), by pairs of
    classes, in blocks. Of any two nodes of a group that are not connected yet, one is outside."""
    classed, pairs = class_pairs(every)
    pairs = stage(pairs, "classes")
    key = F.xxhash64("hub", "kind1", "kind2", "part", "salt")
    left = classed.where("label <> main").join(pairs, (classed["hub"] == pairs["hub"]) & (F.col("kind") == F.col("kind1"))).drop(pairs["hub"])
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int")).withColumn("side", F.lit(0))
    right = classed.join(pairs, (classed["hub"] == pairs["hub"]) & (F.col("kind") == F.col("kind2"))).drop(pairs["hub"])
    right = right.withColumn("salt", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    both = left.unionByName(right)
    return both.select("node", "label", "side", ((F.col("parts") == 1) & (F.col("blocks") == 1)).alias("lone"), key.alias("key"))


def together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.staged_path for t in tables))


def named_roots(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and root (a node of its component) of every row of ``docs``, staged; the last two are null without words,
    or without an id.

    Rows with equal texts are one node. No table of pairs within a group is made: a group of m nodes is split into blocks, and what it
    sends on is a forest. All staged tables but the result are deleted.
    """
    spark, kept = docs.sparkSession, []

    def hold(df: DataFrame, name: str) -> DataFrame:
        kept.append(stage(df, name))
        return kept[-1]

    surveyed = stage(survey(docs), "survey")
    rank = fold(surveyed.where("slice is not null").select("slice", "data"), "<u4", 1 << SKETCH_BITS, np.add, rank_of)
    rows = hold(surveyed.where("slice is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "rows")
    drop_staged(surveyed)
    reps = hold(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    release(spark)
    first = stage(prefixes(docs.where("doc_id is not null"), rank, reps), "prefixes")
    found = []
    for k in range(TOKEN_SLICES):
        postings = first.select("node", "n", "c", F.explode("tokens").alias("token")).where(F.pmod("token", F.lit(TOKEN_SLICES)) == k)
        hubs = postings.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("df")).where("hub <> last")
        hubs = stage(hubs.select("token", "hub", "df"), "hubs")
        release(spark)  # the postings are shuffled again, so the first shuffle of them goes before that
        found.append(stage(postings.join(hubs, "token").distinct(), "common"))
        drop_staged(hubs)
        release(spark)
    drop_staged(first)
    common = together(found)
    # Shingles of many nodes make groups: a hub, the least node of a shingle, and all nodes that have one of its shingles.
    many = common.where(F.col("df") > FEW)
    size_of = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("c").alias("c"))
    whole = hold(size_of(many, "hub", "node"), "members")
    member = whole.where("node <> hub")
    # Shingles of few nodes make pairs, at most FEW / 2 a posting. A link shares SHARED prefix shingles, those of many nodes included.
    more = many.groupBy("node").agg(F.count("*").alias("many"))
    few = common.where(F.col("df") <= FEW).join(more, "node", "left").select("token", "node", "n", F.coalesce("many", F.lit(0)).alias("many"))
    few = stage(few, "few")
    right = few.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "many")))
    pair = few.join(right, "token").where("node < node2").groupBy("node", "node2", "n", "n2", "many", "many2").agg(F.count("*").alias("shared"))
    alike = (DEN * F.least("n", "n2") >= NUM * F.greatest("n", "n2")) & (F.col("shared") + F.least("many", "many2") >= F.least(F.lit(SHARED), F.ceil(F.least("n", "n2") * NUM / DEN)))
    pair = hold(pair.where(alike).select(F.col("node").alias("hub"), F.col("node2").alias("node"), "shared"), "pairs")
    for df in (few, *found):
        drop_staged(df)
    able = member.select("hub", "node", "shared").unionByName(pair)
    reps = hold(able.select("node").union(able.select("hub")).distinct().join(reps, "node"), "wanted")

    # First each node meets the hub with which it shares most, and what that hub's other nodes are in its block.
    nearest = able.groupBy("node").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub")).select("hub", "node")
    nearest = hold(nearest, "nearest")
    size = hold(nearest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    at = nearest.join(size, "hub").select("hub", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("salt"))
    at = at.unionByName(size.select("hub", F.col("hub").alias("node"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt")))
    at = bundled(at, F.col("blocks") == 1, F.xxhash64("hub", "salt")).groupBy("node").agg(F.collect_set("block").alias("at"))
    at = hold(at, "places")
    release(spark)
    # Shingled again where they lie: to keep all sets from the first pass would take more disk than the input. Each set is written with
    # its blocks, so that the shuffle by node is gone before that by block.
    sets = hold(sets_of(docs, reps).select("node", "shingles").join(at, "node", "left"), "sets")
    release(spark)
    wanted = sets.select("node", "shingles")
    links = hold(join_blocks(sets.select(F.explode("at").alias("block"), "node", F.col("node").alias("label"), F.lit(1).alias("side"), "shingles"), ["block"]), "links")
    release(spark)
    root = components(links)
    kept.append(root)

    # Then pairs that are not connected yet; and in each group, nodes outside the hub's component meet what they may link with in it.
    # Groups whose pairs were all compared in one block are done.
    label = lambda df, node, out: df.join(root.select(F.col("node").alias(node), F.col("root").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))
    open_pairs = label(label(pair.join(nearest, ["hub", "node"], "left_anti"), "node", "label"), "hub", "main").where("label <> main")
    open_pairs = hold(open_pairs.select("hub", "main", "node", "label"), "open")
    open_pairs = open_pairs.join(open_pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "hub").withColumn("salt", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tail = [(F.col("blocks") == 1).alias("lone"), F.xxhash64("hub", "salt").alias("key")]
    heads = open_pairs.select(F.col("hub").alias("node"), F.col("main").alias("label"), F.lit(0).alias("side"), *tail).distinct()
    cross = heads.unionByName(open_pairs.select("node", "label", F.lit(1).alias("side"), *tail))
    every = hold(whole.join(root, "node", "left").select("hub", "node", "n", "c", F.coalesce("root", "node").alias("label")), "labels")
    main = hold(every.where("hub = node").select("hub", F.col("label").alias("main")), "main")
    # Nodes that only pair with a hub met it in the same block, but are not of its group.
    done = nearest.join(member.select("hub", "node"), ["hub", "node"], "left_semi").groupBy("hub").agg(F.count("*").alias("compared")).join(size.where("blocks = 1"), "hub").select("hub", "compared")
    groups = every.join(main, "hub").groupBy("hub").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("main")).alias("odd")).where("odd > 0")
    groups = hold(groups.join(done, "hub", "left").where("compared is null or compared < n - 1").select("hub"), "groups")
    cross = hold(cross.unionByName(cross_blocks(hold(every.join(groups, "hub").join(main, "hub"), "rest"))), "cross")
    if copies := cross.count():
        cross = hold(bundled(cross, F.col("lone"), F.col("key")).select("block", "side", "node", "label").distinct(), "blocks")
        # A set goes into many blocks here, so the blocks are joined in as many turns as keep a turn's sets to about one for each node.
        turns, found = math.ceil(copies / max(1, sets.count())), [links]
        for k in range(turns):
            release(spark)
            turn = cross.where(F.pmod(F.xxhash64("block"), F.lit(turns)) == k)
            needed = turn.select("node").distinct()
            found.append(hold(join_blocks(turn.join(wanted.join(needed, "node", "left_semi"), "node"), ["block"]), "links"))
        release(spark)
        root = components(together(found))
        kept.append(root)
    out = stage(rows.join(root, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root")), "named")
    for df in kept:
        drop_staged(df)
    return out


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns play no part).

    Documents without words link with nothing and are their own component; a null id links with nothing and has a null component.
    """
    named = named_roots(docs)
    least = stage(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component")), "least")
    out = named.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


@F.arrow_udf(T.LongType())
def node_of_text(text: pa.Array) -> pa.Array:
    sets = map(shingles, text.to_pylist())
    return pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each component only, all columns kept; rows with a null id stay.

    An id may stand for several texts: each is a document of its own, and of rows equal in id and shingles one stays.
    """
    named = named_roots(docs).where("doc_id is not null")
    first = named.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.*")
    kept = stage(first.unionByName(named.where("root is null").select("doc_id", "node").distinct()), "kept")
    node = F.coalesce("node", F.lit(-1))
    several = stage(named.groupBy("doc_id").agg(F.min(node).alias("low"), F.max(node).alias("high")).where("low <> high").select("doc_id"), "several")
    once = lambda df, *keys: df.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy("text"))).where("_copy = 1").select(*docs.columns)
    rows = docs.join(kept.join(several, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    rows = once(rows, "doc_id")
    if several.limit(1).count():
        mixed = docs.join(several, "doc_id", "left_semi").withColumn("_node", F.coalesce(node_of_text("text"), F.lit(-1)))
        mixed = mixed.join(kept.select("doc_id", node.alias("_node")), ["doc_id", "_node"], "left_semi")
        rows = rows.unionByName(once(mixed, "doc_id", "_node"))
    return rows.unionByName(docs.where("doc_id is null"))
