"""Point, range, scan and aggregate queries by logical position over a window table.

``start_pos`` and ``end_pos`` are stored, so a request becomes two comparisons that reach the Parquet scan; only
windows that meet it are decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators.windows import decode, decode_window

GROUP = 12
#: Digits enough for the exact sum of any doubles.
EXACT = Context(prec=2_400)


def total_records(windows: DataFrame, series_id: str) -> int:
    """Records of a series, from the counts alone."""
    return windows.where(F.col("series_id") == series_id).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]


def window_payload(windows: DataFrame, series_id: str, window_id: int) -> DataFrame:
    """One window's bits."""
    return windows.where((F.col("series_id") == series_id) & (F.col("window_id") == window_id)).select("series_id", "window_id", "bit_len", "payload")


def locate(windows: DataFrame, series_id: str, pos: int) -> DataFrame:
    """(window_id, offset) of a position."""
    hit = windows.where((F.col("series_id") == series_id) & (F.col("start_pos") <= pos) & (F.col("end_pos") > pos))
    return hit.select("window_id", (F.lit(pos) - F.col("start_pos")).alias("offset"))


def prefix_sums(windows: DataFrame) -> DataFrame:
    """Records and bits before each window, by series."""
    from tessera.functions.offsets import running_total

    rows = windows.select("series_id", "window_id", "cnt", "bit_len")
    rows = running_total(rows, ["series_id"], "window_id", "cnt", "records_before")
    return running_total(rows, ["series_id"], "window_id", "bit_len", "bits_before")


def touching(windows: DataFrame, series_id: str, start: int, length: int) -> DataFrame:
    """Windows that meet [start, start + length); empty windows never do."""
    return windows.where((F.col("series_id") == series_id) & (F.col("start_pos") < start + length) & (F.col("end_pos") > start) & (F.col("cnt") > 0))


def check_bounds(windows: DataFrame, series_id: str, start: int, length: int, least: int = 0, n: int | None = None) -> None:
    """``n``: the series' records where they are known, else counted in ``windows``."""
    n = total_records(windows, series_id) if n is None else n
    if length < least or start < 0 or start > n - length:
        raise ValueError(f"positions {start} to {start + length} are not within 0 to {n}")


def points(windows: DataFrame, series_id: str, wanted: list[int]) -> DataFrame:
    """(pos, value) at some positions: only their windows are decoded."""
    hit = F.lit(False)
    for p in wanted:
        hit |= (F.col("start_pos") <= p) & (F.col("end_pos") > p)
    rows = decode(windows.where((F.col("series_id") == series_id) & hit))
    return rows.where(F.col("pos").isin([int(p) for p in wanted])).select("pos", "value")


def point(windows: DataFrame, series_id: str, pos: int) -> float:
    check_bounds(windows, series_id, pos, 1)
    return points(windows, series_id, [pos]).first()["value"]


def range_values(windows: DataFrame, series_id: str, start: int, length: int, n: int | None = None) -> DataFrame:
    """(pos, value) of a range, in no order; bounds are checked against the counts first."""
    check_bounds(windows, series_id, start, length, n=n)
    rows = decode(touching(windows, series_id, start, length))
    return rows.where((F.col("pos") >= start) & (F.col("pos") < start + length)).select("pos", "value")


def range_decimals(windows: DataFrame, series_id: str, start: int, length: int, n: int | None = None) -> DataFrame:
    """(pos, value) of a range as decimal text: the shortest decimal that gives the double back, without an exponent."""

    @F.arrow_udf("string")
    def plain(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else format(Decimal(repr(x)), "f") for x in a.to_pylist()], pa.string())

    return range_values(windows, series_id, start, length, n).select("pos", plain(F.col("value")).alias("value"))


def exact_sum(decimals: DataFrame) -> DataFrame:
    """One row: n and the exact sum of decimal texts, as text. Whole numbers on the finest scale of each batch, then of all batches."""

    def run(batches):
        total, n = Decimal(0), 0
        for b in batches:
            values = [Decimal(v) for v in b.column(0).to_pylist() if v is not None]
            total, n = EXACT.add(total, reduce(EXACT.add, values, Decimal(0))), n + len(values)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([str(total)], pa.string())], names=["n", "sum"])

    parts = decimals.select("value").mapInArrow(run, "n long, sum string").agg(F.sum("n").alias("n"), F.collect_list("sum").alias("sums"))  # one a partition

    @F.arrow_udf("string")
    def whole(a: pa.Array) -> pa.Array:
        return pa.array([format(EXACT.normalize(reduce(EXACT.add, map(Decimal, x), Decimal(0))), "f") for x in a.to_pylist()], pa.string())

    return parts.select(F.coalesce("n", F.lit(0)).alias("n"), whole(F.col("sums")).alias("sum"))


def scan(windows: DataFrame, series_id: str, start: int, length: int, consumer: Callable[[float], None]) -> None:
    """Feed a range to ``consumer`` in order, a partition at a time."""
    rows: Iterator[Row] = range_values(windows, series_id, start, length).orderBy("pos").toLocalIterator(prefetchPartitions=True)
    for r in rows:
        consumer(r["value"])


PARTIAL = "series_id string, window_id long, decoded int, selected int, s double, lo double, hi double"


def window_partials(windows: DataFrame, start: int, length: int) -> DataFrame:
    """Aggregate while decoding: of each window the records decoded and selected, and their sum (left to right), minimum and maximum."""

    def run(batches):
        for b in batches:
            out = []
            for sid, wid, first, *rest in zip(*(b.column(c).to_pylist() for c in ("series_id", "window_id", "start_pos", "cnt", "scale", "width", "base", "payload")), strict=True):
                x = decode_window(*rest)
                part = x[max(0, start - first) : max(0, start + length - first)]
                total = 0.0
                for v in part.tolist():
                    total += v
                out.append((sid, wid, len(x), len(part), total, float(np.min(part)) if len(part) else None, float(np.max(part)) if len(part) else None))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PARTIAL.split(", ")])

    cols = ["series_id", "window_id", "start_pos", "cnt", "scale", "width", "base", "payload"]
    return windows.select(*cols).mapInArrow(run, PARTIAL)


def ordered_sum(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of ``s`` in window order, whatever the plan: within groups of 2**12 windows first, then of those groups, so that no list
    is longer than that for up to 2**24 windows of a series."""
    in_order = lambda by: F.aggregate(F.sort_array(F.collect_list(F.struct(by, "s"))), F.lit(0.0), lambda a, r: a + r["s"])
    merged = [F.sum("decoded").alias("decoded"), F.sum("selected").alias("selected"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    groups = partials.withColumn("grp", F.shiftright("window_id", GROUP)).groupBy(*keys, "grp").agg(in_order("window_id").alias("s"), *merged)
    return groups.groupBy(*keys).agg(in_order("grp").alias("s"), *merged)


def range_aggregate(windows: DataFrame, series_id: str, start: int, length: int, use_stats: bool = False, n: int | None = None) -> DataFrame:
    """One row: n, sum, avg, min and max of a range of at least one record.

    With ``use_stats``, windows wholly inside the range give their stored sum, minimum and maximum (the same
    left-to-right sum), and only the windows at its ends are decoded.
    """
    check_bounds(windows, series_id, start, length, 1, n)
    hit = touching(windows, series_id, start, length)
    if use_stats:
        inside = (F.col("start_pos") >= start) & (F.col("end_pos") <= start + length)
        stored = hit.where(inside).select("series_id", "window_id", F.lit(0).alias("decoded"), F.col("cnt").alias("selected"), F.col("w_sum").alias("s"), F.col("w_min").alias("lo"), F.col("w_max").alias("hi"))
        parts = stored.unionByName(window_partials(hit.where(~inside), start, length))
    else:
        parts = window_partials(hit, start, length)
    total = ordered_sum(parts, ["series_id"])
    return total.select(F.col("selected").cast("long").alias("n"), F.col("s").alias("sum"), (F.col("s") / F.col("selected")).alias("avg"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("decoded").cast("long").alias("decoded"))
