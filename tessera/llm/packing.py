"""Best-fit packing of token sequences by exact complements (operator 7)."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import sliced, stage

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
RANK_ROWS = 20_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Encode each text, append ``end_id`` and cut what is longer than ``capacity``: doc_id, piece, start, length, ids_crc32.

    Only the first piece may be shorter than the capacity. Null texts are empty: one piece that holds the end id.
    ``keep_ids`` adds the ids themselves as little-endian unsigned 32-bit ``ids``.
    """

    def run(batches):
        enc, tail = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for k, ids in zip(b.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                ids += tail
                n = len(ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                at = 0
                for i, e in enumerate(ends):
                    out.append((k, i, at, e - at, zlib.crc32(ids[4 * at : 4 * e]), ids[4 * at : 4 * e] if keep_ids else None))
                    at = e
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 5 + keep_ids], kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class SumIndex:
    """Stock of lengths with an index from each sum to the pairs and triples of lengths that make it.

    A sum's entry is made when it is first asked for, from the lengths in stock then: the larger part of each pair, and of each triple
    the largest part, in descending order. Counts only fall, so what could not be taken once never can be again, and a cursor per entry
    moves on past it for good: over a whole plan each entry is walked once.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, k in counts.items():
            self.n[length] += k
        self.pairs: dict[int, list] = {}
        self.triples: dict[int, list] = {}

    def _pair_entry(self, total: int) -> list:
        if (e := self.pairs.get(total)) is None:
            a = np.arange(min(total - 1, len(self.n) - 1), (total + 1) // 2 - 1, -1)
            e = self.pairs[total] = [0, a[(self.n[a] > 0) & (self.n[total - a] > 0)].tolist() if len(a) else []]
        return e

    def _can_pair(self, a: int, b: int) -> bool:
        return bool(self.n[a] > (a == b) and self.n[b] > 0)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths in stock with this sum, the larger one as large as can be."""
        e = self._pair_entry(total)
        while e[0] < len(e[1]):
            a = e[1][e[0]]
            if self._can_pair(a, total - a):
                return a, total - a
            e[0] += 1
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths in stock with this sum, the largest one as large as can be, then the second."""
        if (t := self.triples.get(total)) is None:
            a = np.arange(min(total - 2, len(self.n) - 1), (total + 2) // 3 - 1, -1)
            t = self.triples[total] = [0, a[self.n[a] > 0].tolist() if len(a) else [], 0]
        while t[0] < len(t[1]):
            a = t[1][t[0]]
            rest = self._pair_entry(total - a)[1]
            if self.n[a] > 0:
                for k in range(t[2], len(rest)):
                    b, t[2] = rest[k], k
                    c = total - a - b
                    if b <= a and self.n[a] > (a == b) + (a == c) and self._can_pair(b, c):
                        return a, b, c
            t[0], t[2] = t[0] + 1, 0
        return None

    def complement(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths in stock that fill the gap exactly; () if there are none."""
        return (gap,) if self.n[gap] > 0 else self.pair(gap) or self.triple(gap) or ()

    def largest(self, gap: int) -> int:
        there = np.flatnonzero(self.n[1 : gap + 1])
        return int(there[-1]) + 1 if len(there) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fill patterns and how often each is used, from the histogram of lengths alone (at most ``capacity`` numbers).

    Longest first; the gap is filled exactly where one to three lengths in stock add up to it, else by the largest
    that fits, again and again. Each pattern is used as often as the stock allows, so a step uses up a length.
    """
    stock, out = SumIndex(counts, capacity), []
    for length in range(capacity, 0, -1):
        while stock.n[length]:
            items, gap = [length], capacity - length
            stock.n[length] -= 1
            while gap:
                fill = stock.complement(gap) or ((big,) if (big := stock.largest(gap)) else ())
                if not fill:
                    break
                items += fill
                for x in fill:
                    stock.n[x] -= 1
                gap -= sum(fill)
            need = Counter(items)
            more = min(int(stock.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                stock.n[x] -= more * k
            out.append((items, 1 + more))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """length -> first ranks, sequence ids and offsets of the runs of places for pieces of that length, by rank."""
    found, used, base = {}, Counter(), 0
    for items, times in patterns:
        offset = 0
        for x in items:
            found.setdefault(x, []).append((used[x], base, offset))
            used[x] += times
            offset += x
        base += times
    return {x: [np.array(c) for c in zip(*rows, strict=True)] for x, rows in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces`` (``cut`` is read twice: stage it first).

    The driver sees the histogram of lengths only. A piece's rank among those of its length is counted in two steps (within
    a salt, plus the counts of smaller salts), so a length that a third of all rows share is spread over many tasks;
    the rank then finds its place by binary search in the runs of places. An empty table gives an empty table.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(32, sum(counts.values()) // RANK_ROWS)
    places = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    names = cut.columns
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(w) - 1).join(sums, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_row") + F.col("_first")).alias("_rank"))

    def place(batches):
        at = places.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, base, offset = at[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                seq[mine], off[mine] = base[k] + rank[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack all documents: one row per piece with its sequence and its place there.

    Null texts are empty; repeated rows are packed as often as they occur; columns other than doc_id and text play no part.
    """
    return pack(stage(pieces(docs, capacity, vocabulary, end_id), "pieces"), capacity)
