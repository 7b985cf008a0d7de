"""Block codecs for doubles, and the report that compares and verifies them.

A block is a fixed number of consecutive values of a series and is coded by itself, so Spark partitions by (series, block). Each codec is
a short numpy function in each direction; all give back every bit pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import decode_window, encode_window, pack_bits, unpack_bits

BLOCK = 1_000
BLOCKS = "series_id string, block_id long, codec string, cnt int, bits long, payload binary"
LOOK_BACK, LOW_BITS = 128, 14
#: The classes to which leading zeros are rounded down, a 3-bit code each.
LEADS = np.array([0, 8, 12, 16, 18, 20, 22, 24])


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 64-bit integers."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def _pack_fields(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of different widths one after the other, most significant bit first."""
    total = int(widths.sum())
    owner = np.repeat(np.arange(len(widths)), widths)
    place = np.repeat(np.cumsum(widths), widths) - np.arange(total) - 1
    return np.packbits(((values[owner] >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def _unpack_fields(data: bytes, widths: np.ndarray, skip: int) -> np.ndarray:
    total = int(widths.sum())
    if len(data) < skip + (total + 7) // 8:
        raise ValueError("a block's payload is cut short")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, skip))[:total].astype(np.uint64)
    place = np.repeat(np.cumsum(widths), widths) - np.arange(total) - 1
    out = np.zeros(len(widths), np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(widths)), widths), bits << place.astype(np.uint64))
    return out


def _xor_streams(x: np.ndarray) -> tuple[bytes, int]:
    """Differences as streams: flag (0 same, 1 with trailing zeros, 2 lead as before, 3 new lead), leads, lengths, centres."""
    length = _bit_length(x)
    lead = np.searchsorted(LEADS, 64 - length, "right") - 1
    low = x & (~x + np.uint64(1))
    tail = np.where(x == 0, 64, _bit_length(low) - 1)
    before = np.concatenate([[-1], lead[:-1]])
    flag = np.where(x == 0, 0, np.where(tail > 6, 1, np.where(lead == before, 2, 3)))
    width = np.where(flag == 0, 0, 64 - LEADS[lead] - np.where(flag == 1, tail, 0))
    centre = np.where(flag == 1, x >> np.minimum(tail, 63).astype(np.uint64), x)
    parts = [pack_bits(flag, 2), pack_bits(lead[(flag == 1) | (flag == 3)], 3), pack_bits(width[flag == 1] - 1, 6), _pack_fields(centre[flag > 0], width[flag > 0])]
    bits = 2 * len(x) + 3 * int(((flag == 1) | (flag == 3)).sum()) + 6 * int((flag == 1).sum()) + int(width.sum())
    return b"".join(parts), bits


def _from_streams(data: bytes, n: int, at: int = 0) -> np.ndarray:
    flag = unpack_bits(data, 2, n, at).astype(np.int64)
    at += (2 * n + 7) // 8
    named = (flag == 1) | (flag == 3)
    lead = np.full(n, -1, np.int64)
    lead[named] = unpack_bits(data, 3, int(named.sum()), at).astype(np.int64)
    at += (3 * int(named.sum()) + 7) // 8
    lead[flag == 0] = len(LEADS) - 1  # a zero difference has the most leading zeros
    known = np.maximum.accumulate(np.where(lead >= 0, np.arange(n), 0))
    lead = lead[known]
    some = flag == 1
    width = np.where(flag == 0, 0, 64 - LEADS[lead])
    width[some] = unpack_bits(data, 6, int(some.sum()), at).astype(np.int64) + 1
    at += (6 * int(some.sum()) + 7) // 8
    out = np.zeros(n, np.uint64)
    out[flag > 0] = _unpack_fields(data, width[flag > 0], at)
    if len(data) != at + (int(width.sum()) + 7) // 8:
        raise ValueError("a block's payload does not have the length its flags ask for")
    tail = np.where(some, 64 - LEADS[lead] - width, 0)
    return out << tail.astype(np.uint64)


def xor_encode(v: np.ndarray) -> tuple[bytes, int]:
    """Each bit pattern against the one before."""
    b = v.view(np.uint64)
    return _xor_streams(b ^ np.concatenate([[np.uint64(0)], b[:-1]]))


def xor_decode(data: bytes, n: int) -> np.ndarray:
    return np.bitwise_xor.accumulate(_from_streams(data, n)).view(np.float64)


def look_back_encode(v: np.ndarray) -> tuple[bytes, int]:
    """Each bit pattern against the latest of the 128 before that has the same low bits, else the one before; 7 bits name it."""
    b, latest = v.view(np.uint64), {}
    back = np.ones(len(b), np.int64)
    for i, low in enumerate((b & np.uint64((1 << LOW_BITS) - 1)).tolist()):
        j = latest.get(low)
        if j is not None and i - j <= LOOK_BACK:
            back[i] = i - j
        latest[low] = i
    ref = np.where(np.arange(len(b)) >= back, b[np.arange(len(b)) - back], np.uint64(0))
    data, bits = _xor_streams(b ^ ref)
    return pack_bits(back - 1, 7) + data, bits + 7 * len(b)


def look_back_decode(data: bytes, n: int) -> np.ndarray:
    back = unpack_bits(data, 7, n).astype(np.int64) + 1
    x = _from_streams(data, n, (7 * n + 7) // 8).tolist()
    out = []
    for i, (d, k) in enumerate(zip(x, back.tolist(), strict=True)):
        out.append(d ^ (out[i - k] if i >= k else 0))
    return np.array(out, np.uint64).view(np.float64)


def _places(v: np.ndarray) -> np.ndarray:
    """Fewest decimal places that give each double back, 16 where 15 are too few."""
    out = np.full(len(v), 16, np.int64)
    with np.errstate(all="ignore"):
        for u in range(15, -1, -1):
            out[(np.rint(v * 10.0**u) / 10.0**u).view(np.int64) == v.view(np.int64)] = u
    return out


def erased_encode(v: np.ndarray) -> tuple[bytes, int]:
    """Mantissa bits that the decimal places make redundant are cleared before the difference to the value before: the places
    (4 bits, 15 for a value left as it is) say how to round it back, and each value is rounded back here first to be sure."""
    places = _places(v)
    with np.errstate(all="ignore"):
        e = np.frexp(np.abs(v))[1] - 1
        keep = np.clip(np.where(np.isfinite(v), e + np.ceil(places * 3.3219280948873626), 52), 0, 52).astype(np.int64)
        short = (v.view(np.uint64) >> (52 - keep).astype(np.uint64)) << (52 - keep).astype(np.uint64)
        back = _restore(short.view(np.float64), places)
    ok = (places < 15) & (back.view(np.int64) == v.view(np.int64))
    data, bits = xor_encode(np.where(ok, short, v.view(np.uint64)).view(np.float64))
    return pack_bits(np.where(ok, places, 15), 4) + data, bits + 4 * len(v)


def _restore(short: np.ndarray, places: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        scale = 10.0 ** np.minimum(places, 22)
        near, up = np.rint(short * scale), np.sign(short) * np.ceil(np.abs(short) * scale)
        return np.where(near / scale == short, short, up / scale)


def erased_decode(data: bytes, n: int) -> np.ndarray:
    places = unpack_bits(data, 4, n).astype(np.int64)
    short = xor_decode(data[(4 * n + 7) // 8 :], n)
    return np.where(places == 15, short, _restore(short, places))


def decimal_encode(v: np.ndarray) -> tuple[bytes, int]:
    """Integers on one decimal scale of the block as offsets from their least, in as many bits as the largest needs; values that a
    scale cannot give back stand apart, with their places. The scale with the fewest bits in all is taken."""
    best = None
    places = _places(v)
    for scale in sorted(set(places.tolist())):
        ok = places <= min(scale, 15)
        with np.errstate(all="ignore"):
            s = np.rint(v * 10.0 ** min(scale, 15))
            ok &= np.abs(s) < 2.0**53
        s = np.where(ok, s, 0.0).astype(np.int64)
        ok &= (s / 10.0 ** min(scale, 15)).view(np.int64) == v.view(np.int64)
        base = int(s[ok].min()) if ok.any() else 0
        width = int(s[ok].max() - base).bit_length() if ok.any() else 0
        bits = 8 + 8 + 64 + len(v) + width * int(ok.sum()) + 64 * int((~ok).sum())
        if best is None or bits < best[0]:
            best = bits, min(scale, 15), base, width, s, ok
    bits, scale, base, width, s, ok = best
    head = bytes([scale, width]) + base.to_bytes(8, "big", signed=True)
    return head + pack_bits(ok.astype(np.uint64), 1) + pack_bits((s[ok] - base).view(np.uint64), width) + v[~ok].astype(">f8").tobytes(), bits


def decimal_decode(data: bytes, n: int) -> np.ndarray:
    scale, width, base = data[0], data[1], int.from_bytes(data[2:10], "big", signed=True)
    ok = unpack_bits(data, 1, n, 10).astype(bool)
    at = 10 + (n + 7) // 8
    k = int(ok.sum())
    s = unpack_bits(data, width, k, at).view(np.int64)
    at += (k * width + 7) // 8
    if len(data) != at + 8 * (n - k):
        raise ValueError("a block's payload does not have the length its marks ask for")
    out = np.zeros(n)
    out[ok] = (base + s) / 10.0**scale
    out[~ok] = np.frombuffer(data, ">f8", n - k, at)
    return out


def window_encode(v: np.ndarray) -> tuple[bytes, int]:
    """The window codec of the window table, with its scale, width and base in front."""
    w = encode_window(v)
    return bytes([w["scale"], w["width"]]) + w["base"].to_bytes(8, "big", signed=True) + w["payload"], 80 + w["bit_len"]


def window_decode(data: bytes, n: int) -> np.ndarray:
    return decode_window(n, data[0], data[1], int.from_bytes(data[2:10], "big", signed=True), data[10:])


@dataclass(frozen=True)
class Codec:
    name: str
    encode: Callable[[np.ndarray], tuple[bytes, int]]
    decode: Callable[[bytes, int], np.ndarray]


CODECS = {
    c.name: c
    for c in (
        Codec("xor", xor_encode, xor_decode),
        Codec("look_back", look_back_encode, look_back_decode),
        Codec("erased", erased_encode, erased_decode),
        Codec("decimal", decimal_encode, decimal_decode),
        Codec("window", window_encode, window_decode),
    )
}


def codec(name: str) -> Codec:
    """A codec by name, in any case."""
    found = CODECS.get(name.lower())
    if found is None:
        raise ValueError(f"no codec {name}; there are {', '.join(CODECS)}")
    return found


def encode_blocks(series: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """(series_id, pos, value) to a row per block and codec (``BLOCKS``); one shuffle for all codecs."""
    picked = [codec(n) for n in names]
    rows = series.withColumn("block_id", F.floor(F.col("pos") / block).cast("long"))
    groups = rows.groupBy("series_id", "block_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias("values"))

    def run(batches):
        for b in batches:
            out = []
            for sid, bid, values in zip(*(b.column(c).to_pylist() for c in ("series_id", "block_id", "values")), strict=True):
                v = np.array(values, np.float64)
                for c in picked:
                    data, bits = c.encode(v)
                    out.append((sid, bid, c.name, len(v), bits, data))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    return groups.mapInArrow(run, BLOCKS)


def decode_blocks(blocks: DataFrame, block: int = BLOCK, errors: bool = False) -> DataFrame:
    """Blocks back to series_id, codec, pos, value. A block that can't be decoded ends the job or, with ``errors``, gives one row
    without a value, at the block's first position, and what was wrong in a further column ``error``."""
    names = ["series_id", "codec", "pos", "value", *(["error"] if errors else [])]

    def run(batches):
        for b in batches:
            for sid, bid, name, n, data in zip(*(b.column(c).to_pylist() for c in ("series_id", "block_id", "codec", "cnt", "payload")), strict=True):
                wrong = None
                try:
                    v = pa.array(CODECS[name].decode(data, n))
                except Exception as e:
                    if not errors:
                        raise
                    v, wrong = pa.nulls(1, pa.float64()), f"block {bid}: {e or type(e).__name__}"
                k = len(v)
                cols = [pa.array([sid] * k, pa.string()), pa.array([name] * k, pa.string()), pa.array(bid * block + np.arange(k)), v, pa.array([wrong] * k, pa.string())]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    return blocks.mapInArrow(run, "series_id string, codec string, pos long, value double" + (", error string" if errors else ""))


def size_report(blocks: DataFrame) -> DataFrame:
    """Of each series and codec, a row per block and one for all (block_id null): values, bytes, bits per value, the ratio to raw
    doubles of all values together, and the mean of the blocks' ratios, which is another number."""
    b = blocks.withColumn("bytes", F.length("payload")).withColumn("ratio", F.col("bytes") / (8 * F.col("cnt")))
    sets = b.rollup("series_id", "codec", "block_id").agg(F.sum("cnt").alias("values"), F.sum("bytes").alias("bytes"), F.sum("bits").alias("bits"), F.avg("ratio").alias("mean_block_ratio"), F.count("*").alias("blocks"))
    sets = sets.where("codec is not null")
    return sets.select("series_id", "codec", "block_id", "blocks", "values", "bytes", (F.col("bits") / F.col("values")).alias("bits_per_value"), (F.col("bytes") / (8 * F.col("values"))).alias("weighted_ratio"), "mean_block_ratio")


def verify(series: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Decoded values held against the source by position: counts, mismatches, signed-zero differences, the first mismatch and a status.

    ERROR: a block could not be decoded (the first error is given). PASS_RAW_BITS: all patterns equal. PASS_ZERO_EQ: only zeros differ in
    sign. FAIL_ROUNDTRIP: else, lost or surplus records included.
    """
    from tessera.functions.numeric import f64_bits

    source = series.select("series_id", "pos", f64_bits(F.col("value")).alias("want"), F.col("value").alias("v"))
    names = blocks.select("codec").distinct()
    source = source.join(F.broadcast(names))  # a row per codec: a handful
    got = decode_blocks(blocks, block, errors=True).select("series_id", "codec", "pos", f64_bits(F.col("value")).alias("got"), F.col("value").alias("w"), "error")
    j = source.join(got, ["series_id", "codec", "pos"], "full")
    zero = (F.col("v") == 0) & (F.col("w") == 0) & (F.col("want") != F.col("got"))
    bad = ~F.col("want").eqNullSafe(F.col("got")) & ~F.coalesce(zero, F.lit(False))
    out = j.groupBy("series_id", "codec").agg(F.count("want").alias("records"), F.count("got").alias("decoded_records"), F.count_if(bad).alias("mismatches"), F.count_if(zero).alias("zero_sign_differences"), F.min(F.when(bad, F.col("pos"))).alias("first_mismatch"), F.min("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("mismatches") > 0, "FAIL_ROUNDTRIP").when(F.col("zero_sign_differences") > 0, "PASS_ZERO_EQ").otherwise("PASS_RAW_BITS")
    return out.withColumn("status", status)


def compression_summary(blocks: DataFrame, most_bits: float = 100.0) -> DataFrame:
    """Mean, least and largest bits per value of the blocks by codec; blocks above ``most_bits`` do not count for the largest."""
    b = blocks.withColumn("bpv", F.col("bits") / F.col("cnt"))
    return b.groupBy("series_id", "codec").agg(F.sum("cnt").alias("values"), F.avg("bpv").alias("mean_bits"), F.min("bpv").alias("min_bits"), F.max(F.when(F.col("bpv") <= most_bits, F.col("bpv"))).alias("max_bits"))


def neighbour_zeros(series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Histogram of leading and trailing zeros of neighbours' differences, in Column expressions: side, zeros, n."""
    from pyspark.sql import Window

    from tessera.functions.numeric import f64_bits, leading_zeros, trailing_zeros

    w = Window.partitionBy("series_id", F.floor(F.col("pos") / block)).orderBy("pos")
    rows = series.withColumn("b", f64_bits(F.col("value")))
    rows = rows.withColumn("x", F.col("b").bitwiseXOR(F.lag("b").over(w))).where(F.col("x").isNotNull() & (F.col("x") != 0))
    sides = F.array(F.struct(F.lit("lead").alias("side"), leading_zeros(F.col("x")).alias("zeros")), F.struct(F.lit("trail").alias("side"), trailing_zeros(F.col("x")).alias("zeros")))
    return rows.select("series_id", F.explode(sides).alias("s")).groupBy("series_id", "s.side", "s.zeros").agg(F.count("*").alias("n"))


def bucket_plan(histogram: list[int], most: int) -> list[int]:
    """Left edges (0 first) of at most ``most`` buckets, a power of two, over a histogram of zero counts, for the fewest bits: each value
    pays the buckets' code and its distance from its bucket's edge. Dynamic programming over at most 65 slots."""
    n, best = len(histogram), None
    h = np.array(histogram, np.int64)
    loss = np.full((n + 1, n + 1), 0, np.int64)
    for s in range(n):
        loss[s, s + 1 :] = np.cumsum(h[s:] * np.arange(n - s))
    cost = loss[0].copy()  # one bucket over the first i slots
    cut = [[0] * (n + 1)]
    for k in range(1, most + 1):
        edges = 1 << max(0, (k - 1).bit_length())
        total = int(cost[n]) + int(h.sum()) * (edges.bit_length() - 1)
        if best is None or total < best[0]:
            at, edge = n, []
            for level in range(k - 1, -1, -1):
                at = cut[level][at]
                edge.append(at)
            best = total, sorted(set(edge))
        step = cost[:, None] + loss
        step[np.tril_indices(n + 1, -1)] = 1 << 60
        cut.append(step.argmin(0).tolist())
        cost = step.min(0)
    return best[1]


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a Huffman code; one symbol alone takes one bit. Ties go to the smaller symbol."""
    import heapq

    heap = [(n, s, (s,)) for s, n in sorted(counts.items()) if n > 0]
    length = {s: int(len(heap) == 1) for _, s, _ in heap}
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return length
