"""The window codec and its table: 128-record windows, each decodable by itself.

A window holds the finest decimal scale worth its bits, the first value on that scale, and three streams: a 2-bit code per record
(1 raw, 2 step, 3 same as the first), fixed-width zigzag steps on that scale, and raw 64-bit patterns. Streams of fixed width let
numpy decode a window without a loop over its records. Every bit pattern comes back exactly: what the scale
cannot give back is raw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 128
MAX_RECORDS, MAX_BITS, MAX_SCALE = 511, 16_383, 15
RAW, STEP, SAME = 1, 2, 3
FIELDS = "cnt int, bit_len int, scale int, width int, base long, payload binary, first_value double, w_sum double, w_min double, w_max double, n_raw int, n_zero int, n_esc int"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned values as ``width`` bits each, most significant first, padded to whole bytes with zeros."""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, width: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` values of ``width`` bits after ``skip`` bytes; too few bits are an error."""
    size = (n * width + 7) // 8
    if len(data) < skip + size:
        raise ValueError("a window's payload is cut short")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, skip))[: n * width].reshape(n, width).astype(np.uint64)
    return bits @ (np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)) if width else np.zeros(n, np.uint64)


def _scaled(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers on a scale, and which of them give their double back bit for bit."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.rint(x * 10.0**scale)
        s = np.where(np.abs(s) < 2.0**53, s, 0.0).astype(np.int64)
        return s, (s / 10.0**scale).view(np.int64) == x.view(np.int64)


def encode_window(x: np.ndarray) -> dict:
    """One window's row (``FIELDS``) from its doubles; an empty window has no payload."""
    n = len(x)
    if not n:
        return dict(zip((f.split()[0] for f in FIELDS.split(", ")), (0, 0, 0, 0, 0, b"", None, 0.0, None, None, 0, 0, 0), strict=True))
    same = x.view(np.int64) == x.view(np.int64)[0]
    same[0] = False
    best, least = None, 1 << 62
    for scale in range(MAX_SCALE + 1):
        s, ok = _scaled(x, scale)
        base = int(s[0]) if ok[0] else 0
        steps = s - base
        zig = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
        ok &= ~same
        width = int(zig[ok].max()).bit_length() if ok.any() else 0
        bits = int(ok.sum()) * width + int((~ok & ~same).sum()) * 64
        if bits < least:
            best, least = (scale, width, base, zig, ok), bits
        if (ok | same).all():
            break
    scale, width, base, zig, ok = best
    code = np.where(same, SAME, np.where(ok, STEP, RAW))
    raw = x[code == RAW]
    payload = pack_bits(code, 2) + pack_bits(zig[ok], width) + raw.astype(">f8").tobytes()
    total = 0.0
    for v in x.tolist():  # the sum's order is part of the result
        total += v
    return {"cnt": n, "bit_len": 2 * n + least, "scale": scale, "width": width, "base": base, "payload": payload, "first_value": float(x[0]), "w_sum": total, "w_min": float(x.min()), "w_max": float(x.max()), "n_raw": len(raw), "n_zero": int(same.sum()), "n_esc": int(ok.sum())}


def decode_window(cnt: int, scale: int, width: int, base: int, payload: bytes) -> np.ndarray:
    """The doubles of a window; lengths that do not fit its counts are an error."""
    if not cnt:
        return np.zeros(0)
    code = unpack_bits(payload, 2, cnt)
    if (code == 0).any():
        raise ValueError("a window holds an unknown code")
    at = (2 * cnt + 7) // 8
    n_step, n_raw = int((code == STEP).sum()), int((code == RAW).sum())
    zig = unpack_bits(payload, width, n_step, at)
    at += (n_step * width + 7) // 8
    if len(payload) != at + 8 * n_raw:
        raise ValueError("a window's payload does not have the length its codes ask for")
    out = np.zeros(cnt)
    steps = (zig >> np.uint64(1)).view(np.int64) ^ -(zig & np.uint64(1)).view(np.int64)
    out[code == STEP] = (base + steps) / 10.0**scale
    out[code == RAW] = np.frombuffer(payload, ">f8", n_raw, at)
    out[code == SAME] = out[0]
    return out


def encode(groups: DataFrame) -> DataFrame:
    """Rows with a ``values`` array (in order) to window rows: the other columns, then ``FIELDS``."""
    keep = [c for c in groups.columns if c != "values"]
    names = [f.split() for f in FIELDS.split(", ")]

    def run(batches):
        for b in batches:
            values = b.column("values")
            flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum([0, *(len(v) if v.is_valid else 0 for v in values)])
            rows = [encode_window(np.ascontiguousarray(flat[s:e])) for s, e in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r[k] for r in rows], _TYPES[t]) for k, t in names)], names=[*keep, *(k for k, _ in names)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name in keep)
    return groups.select(*keep, "values").mapInArrow(run, f"{kinds}, {FIELDS}")


def build(series: DataFrame, window: int = WINDOW) -> DataFrame:
    """(series_id, pos, value) with dense positions to the window table: series_id, window_id, ``FIELDS``, start_pos, end_pos.

    One shuffle, on the window: a window is independent of all others, so a long series spreads over all tasks.
    """
    rows = series.withColumn("window_id", F.floor(F.col("pos") / window).cast("long"))
    groups = rows.groupBy("series_id", "window_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias("values"))
    out = encode(groups)
    return out.withColumn("start_pos", F.col("window_id") * window).withColumn("end_pos", F.col("start_pos") + F.col("cnt"))


def decode(windows: DataFrame) -> DataFrame:
    """Window rows to records: series_id, window_id, pos, value."""

    def run(batches):
        for b in batches:
            got = [decode_window(*r) for r in zip(*(b.column(c).to_pylist() for c in ("cnt", "scale", "width", "base", "payload")), strict=True)]
            n = np.array([len(x) for x in got], np.int64)
            if not n.sum():
                continue
            take = pa.array(np.repeat(np.arange(len(n)), n))
            start = np.repeat(b.column("start_pos").to_numpy(), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("series_id").take(take), b.column("window_id").take(take), pa.array(start + inside), pa.array(np.concatenate(got))], names=["series_id", "window_id", "pos", "value"])

    cols = ["series_id", "window_id", "start_pos", "cnt", "scale", "width", "base", "payload"]
    return windows.select(*cols).mapInArrow(run, "series_id string, window_id long, pos long, value double")
