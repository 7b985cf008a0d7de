"""Hierarchical weighted hash tree for shards (operator 2), in native DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS, PER_RACK = 2, 4
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A node of the tree: ``shard`` at a leaf, else children. ``name`` is its path and seeds its draw."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    weight: float = 1.0

    @property
    def load(self) -> float:
        return sum(c.load for c in self.children) if self.children else self.weight


def topology(n_shards: int, base: int = 16, racks: int = RACKS, per_rack: int = PER_RACK) -> Node:
    """Regions of ``racks`` x ``per_rack`` shards for the first ``base`` shards; each later shard is a region of its own.

    A new region changes no weight inside the old ones, so growth moves rows into the new shard only, whatever its number.
    """
    regions, size = [], racks * per_rack
    for r in range(0, min(base, n_shards), size):
        mine = range(r, min(r + size, base, n_shards))
        cut = [list(mine)[k : k + per_rack] for k in range(0, len(mine), per_rack)]
        rack = lambda i, ids, r=r: Node(f"r{r // size}/k{i}", tuple(Node(f"r{r // size}/k{i}/s{s}", shard=s) for s in ids))
        regions.append(Node(f"r{r // size}", tuple(rack(i, ids) for i, ids in enumerate(cut))))
    for s in range(base, n_shards):
        name = f"r+{s}"
        regions.append(Node(name, (Node(f"{name}/k0", (Node(f"{name}/k0/s{s}", shard=s),)),)))
    return Node("", tuple(regions))


def children(tree: Node) -> Column:
    """The tree as a literal: a map from each inner node's name to its children's names and loads."""
    entries, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.children:
            kids = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.load)).alias("load")) for c in node.children))
            entries += [F.lit(node.name), kids]
            todo += node.children
    return F.create_map(*entries)


def leaves(tree: Node) -> dict[str, int]:
    return {tree.name: tree.shard} if tree.shard is not None else {k: v for c in tree.children for k, v in leaves(c).items()}


def depth(tree: Node) -> int:
    return 1 + max(map(depth, tree.children)) if tree.children else 0


def draw(key: Column, name: Column, load: Column) -> Column:
    """Weighted draw of a node for a key: -ln(u) / load with u in (0, 1) from the key and the node's name.

    The child with the least draw wins, so each wins in proportion to its load, and a change of one load moves keys only to or
    from that child.
    """
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / load


def assign(docs: DataFrame, tree: Node, out: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """Add the shard of each row: at each level the child with the least draw, down to a leaf (ties to the smaller name).

    Only the id and the tree decide; a null id counts as the text 'null'.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    known, rows = children(tree), docs.withColumn("_at", F.lit(tree.name))
    for _ in range(depth(tree)):
        best = F.array_min(F.transform(known[F.col("_at")], lambda c: F.struct(draw(key, c["name"], c["load"]).alias("d"), c["name"].alias("name"))))
        rows = rows.withColumn("_at", F.coalesce(best["name"], F.col("_at")))
    shard = F.create_map(*(F.lit(x) for kv in leaves(tree).items() for x in kv))
    return rows.withColumn(out, shard[F.col("_at")]).drop("_at")


def with_slots(rows: DataFrame, shard: str = "shard", by: tuple[str, ...] = ("doc_id", "text_crc32", "size"), buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 within each shard, counted in hash buckets and then offset by bucket.

    No task sees more than a bucket of a shard's rows (raise ``buckets`` with the table) or the ``buckets`` counts of a shard.
    """
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))
    rows = rows.withColumn("_bucket", F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % buckets)
    sums = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    w = Window.partitionBy(shard, "_bucket").orderBy(*by)
    rows = rows.withColumn("_row", F.row_number().over(w) - 1).join(sums, [shard, "_bucket"])
    return rows.withColumn("slot", (F.col("_row") + F.col("_first")).cast("long")).drop("_bucket", "_row", "_first")


def shard_report(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more shard, under the law ``key``.

    Size is the text's UTF-8 bytes plus 1; a null text has none, and the checksum of no bytes. Repeated rows go to the
    same shard and get slots of their own; an empty table gives an empty table; other columns play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, topology(n_shards)), topology(n_shards + 1), "grown_shard")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
