"""Structural transitions of a series (sign, step in decimal places, step in exponent) and their statistics.

Extraction makes a symbol per value; all statistics are plain aggregates, joins and windows over counts of distinct keys, which
are few whatever the length of the series.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import LOG2_10, ceil_log2, exponent_cost, places_cost
from tessera.sources.scratch import shared_folder

#: Digits enough for the exact difference of any two doubles.
EXACT = Context(prec=2_200, rounding=ROUND_HALF_UP)
KEY = ["sign", "delta_u", "delta_e"]
SYMBOLS = "series_id string, block_id long, pos long, is_zero boolean, sign int, delta_u int, delta_e int"
#: The numbers of keys for which coverage is reported, and the bits of a codebook and of each of its entries.
TOP_K = (1, 2, 4, 8, 16, 32, 64, 128, 256)
BOOK_BITS, ENTRY_BITS = 21, 17


@dataclass(frozen=True)
class State:
    """What the search for the cheapest reference carries on, the oldest first: the last values that were not repeats, and places and
    exponent of the difference that led to each. Equal histories give equal texts, whatever came before them."""

    values: tuple[Decimal, ...]
    shapes: tuple[tuple[int, int], ...]

    def text(self) -> str:
        return ";".join([*map(str, self.values), *(f"{u},{e}" for u, e in self.shapes)])

    @staticmethod
    def of(text: str) -> State:
        parts = text.split(";")
        n = len(parts) // 2
        return State(tuple(map(Decimal, parts[:n])), tuple((int(u), int(e)) for u, e in (p.split(",") for p in parts[n:])))


def start(references: int = 4) -> State:
    return State((Decimal("0.1"),) * references, (_shape(1, 1),) * references)


def _shape(d: int, places: int) -> tuple[int, int]:
    """Decimal places and exponent of the number d / 10**places, d not 0."""
    try:
        e = math.frexp(abs(d) / 10**places)[1] - 1
    except OverflowError:
        e = 1024
    while places and d % 10 == 0:
        d //= 10
        places -= 1
    return places, max(e, -1023)


def _plain(whole: int, scale: int) -> Decimal:
    return EXACT.normalize(EXACT.scaleb(Decimal(whole), -scale))


def search(values: list[float], state: State) -> tuple[list[tuple], State]:
    """(is_zero, sign, delta_u, delta_e) of each value, and the state after them.

    Of the references the cheapest is taken: bits of the steps in places and exponent plus mantissa bits of the difference, the oldest of
    equals. A difference of zero ends the search and changes nothing; any other puts the value in the place of the oldest reference.
    All differences are exact: whole numbers on the finest decimal scale in sight.
    """
    exact = [Decimal(repr(v)) for v in values]
    scale = max([0, *(-d.as_tuple().exponent for d in (*exact, *state.values))])
    whole = lambda d: int(EXACT.scaleb(d, scale))
    refs, shapes, out = [*map(whole, state.values)], [*state.shapes], []
    for v in map(whole, exact):
        best = None
        for ref, (u0, e0) in zip(refs, shapes, strict=True):
            d = v - ref
            if not d:
                best = None
                break
            u, e = _shape(d, scale)
            cost = (7 if abs(u - u0) > 3 else 3) + (14 if abs(e - e0) > 3 else 3) + _bits(e, u)
            if best is None or cost < best[0]:
                best = cost, (u, e), (int(d < 0), u - u0, e - e0)
        if best is None:
            out.append((True, None, None, None))
        else:
            refs, shapes = [*refs[1:], v], [*shapes[1:], best[1]]
            out.append((False, *best[2]))
    return out, State(tuple(_plain(r, scale) for r in refs), tuple(shapes))


def _bits(e: int, u: int) -> int:
    keep = e - math.floor(-u * LOG2_10) if e < 0 else e + math.ceil(u * LOG2_10)
    return max(0, min(52, keep))


#: Runs are searched side by side while all is whole numbers below this on a scale of at most so many places: doubles are then the
#: nearest to decimals of 15 digits, which are what they print as, and all differences are exact.
WHOLE, FINEST = 10**15, 15


def _scale_of(x: np.ndarray, values: tuple[Decimal, ...]) -> int | None:
    """The least scale on which these doubles and decimals are whole numbers below ``WHOLE``; None: there is none."""
    least = max([0, *(-d.as_tuple().exponent for d in values)])
    for scale in range(least, FINEST + 1):
        s = np.rint(x * 10.0**scale)
        if (np.abs(s) >= WHOLE).any() or any(abs(d.scaleb(scale)) >= WHOLE for d in values):
            return None
        if (s / 10.0**scale == x).all():
            return scale
    return None


def _side_by_side(wholes: np.ndarray, refs: np.ndarray, places: np.ndarray, powers: np.ndarray, scale: int) -> tuple[np.ndarray, ...]:
    """``search`` on many runs at once: ``wholes`` has a column a run, the other arrays a row a reference, the oldest first. Gives what the
    references are after it, then is_zero, sign, delta_u, delta_e of all values."""
    n, unit = len(wholes), 10.0**scale
    ceiling = np.array([math.ceil(u * LOG2_10) for u in range(scale + 1)])
    zero, sign, du, de = np.empty(wholes.shape, bool), *(np.zeros(wholes.shape, np.int32) for _ in range(3))
    runs = np.arange(wholes.shape[1])
    for t in range(n):
        v = wholes[t]
        d = v - refs
        same = (d == 0).any(0)
        zero[t] = same
        if same.all():
            continue
        u = np.full(d.shape, scale)
        for k in range(1, scale + 1):
            ends = d % 10**k == 0
            if not ends.any():
                break
            u -= ends
        e = np.frexp(np.abs(d) / unit)[1].astype(np.int64) - 1
        step_u, step_e = u - places, e - powers
        cost = np.where(np.abs(step_u) > 3, 7, 3) + np.where(np.abs(step_e) > 3, 14, 3) + np.clip(e + ceiling[u], 0, 52)
        best = cost.argmin(0), runs
        sign[t], du[t], de[t] = d[best] < 0, step_u[best], step_e[best]
        move = ~same
        for held, new in ((refs, v), (places, u[best]), (powers, e[best])):
            held[:, move] = np.concatenate([held[1:, move], new[None, move]])
    return refs, places, powers, zero, sign, du, de


def search_runs(values: list[np.ndarray], states: list[State]) -> list[tuple]:
    """``search`` on many runs: (state after, is_zero, sign, delta_u, delta_e as arrays) of each; what has no common small decimal scale goes
    through ``search`` itself."""
    out: list = [None] * len(values)
    scales: dict[int, list[int]] = {}
    for i, (x, s) in enumerate(zip(values, states, strict=True)):
        scale = _scale_of(x, s.values)
        if scale is not None:
            scales.setdefault(scale, []).append(i)
            continue
        got, after = search(x.tolist(), s)
        cols = list(zip(*got, strict=True)) or [()] * 4
        out[i] = after, np.array(cols[0], bool), *(np.array([v or 0 for v in c], np.int32) for c in cols[1:])
    for scale, which in scales.items():
        longest = max(len(values[i]) for i in which)
        wholes = np.empty((longest, len(which)), np.int64)
        refs = np.array([[int(d.scaleb(scale)) for d in states[i].values] for i in which], np.int64).T.copy()
        places, powers = (np.array([[s[k] for s in states[i].shapes] for i in which], np.int64).T.copy() for k in (0, 1))
        for c, i in enumerate(which):
            x = values[i]
            wholes[: len(x), c] = np.rint(x * 10.0**scale)
            # Filled up with the newest reference, which is a repeat and changes nothing.
            wholes[len(x) :, c] = wholes[len(x) - 1, c] if len(x) else refs[-1, c]
        refs, places, powers, *cols = _side_by_side(wholes, refs, places, powers, scale)
        for c, i in enumerate(which):
            after = State(tuple(_plain(int(r), scale) for r in refs[:, c]), tuple((int(u), int(e)) for u, e in zip(places[:, c], powers[:, c], strict=True)))
            out[i] = after, *(a[: len(values[i]), c] for a in cols)
    return out


#: Values of a run, values before it from which its first state is guessed, and runs searched side by side.
RUN, WARM, ABREAST = 1_024, 64, 1_024
_FOUND = "series_id string, run long, before string, after string, few array<double>, pos array<long>, value array<double>, is_zero array<boolean>, sign array<int>, delta_u array<int>, delta_e array<int>"


def _searched(batches, size: int, guess: str | None = None):
    """Runs of ``size`` positions with their symbols (``_FOUND``) from series_id, run, pos, value and, if there is no guess, before."""
    for whole in batches:
        for b in (whole.slice(k, ABREAST) for k in range(0, whole.num_rows, ABREAST)):
            pos, value = ([np.asarray(x) for x in b.column(c).to_numpy(zero_copy_only=False)] for c in ("pos", "value"))
            if guess is None:
                before = [State.of(t) for t in b.column("before").to_pylist()]
            else:
                own = [int(np.searchsorted(p, r * size)) for p, r in zip(pos, b.column("run").to_pylist(), strict=True)]
                before = [r[0] for r in search_runs([v[:k] for v, k in zip(value, own, strict=True)], [State.of(guess)] * len(own))]
                pos, value = ([x[k:] for x, k in zip(xs, own, strict=True)] for xs in (pos, value))
            after, zero, *steps = zip(*search_runs(value, before), strict=True)
            ends = pa.array(np.cumsum([0, *map(len, pos)]), pa.int32())
            flat = lambda xs, kind, mask=None: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(xs), kind, mask=mask))
            repeats = np.concatenate(zero)
            distinct = [np.unique(v) for v in value]
            few = [v.tolist() if len(v) <= len(s.values) else None for v, s in zip(distinct, before, strict=True)]
            cols = [b.column("series_id"), b.column("run"), pa.array([s.text() for s in before], pa.string()), pa.array([s.text() for s in after], pa.string()), pa.array(few, pa.list_(pa.float64()))]
            cols += [flat(pos, pa.int64()), flat(value, pa.float64()), flat(zero, pa.bool_()), *(flat(x, pa.int32(), repeats) for x in steps)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _FOUND.split(", ")])


def _misfits(batches, first: str):
    """Runs that did not begin in the state that the run before them leaves, and that state, from series_id, run, before, after, few in order."""
    last = state = None
    for b in batches:
        out = []
        for sid, run, before, after, few in zip(*(b.column(c).to_pylist() for c in ("series_id", "run", "before", "after", "few")), strict=True):
            if sid != last:
                last, state = sid, first
            if before != state:
                out.append((sid, run, state))
                # Only repeats of what the state holds: it goes through unchanged.
                if few is not None and {Decimal(repr(v)) for v in few} <= set(State.of(state).values):
                    continue
            state = after
        yield pa.RecordBatch.from_pylist([dict(zip(("series_id", "run", "before"), r, strict=True)) for r in out], pa.schema([("series_id", pa.string()), ("run", pa.int64()), ("before", pa.string())]))


def symbols(series: DataFrame, block: int = 30_000, references: int = 4) -> DataFrame:
    """A symbol per value (``SYMBOLS``), against the cheapest of the last ``references`` values that were not repeats.

    The search runs on from block to block of a series, so what a block sees depends on all before it. Yet it is done in parallel, and
    exactly: series are cut into runs; the state in which a run begins is first guessed from the ``WARM`` values before it, and runs are
    searched again wherever the state that the run before them ended in is not that one, until all fit. References are forgotten after a
    few values, so nearly all guesses hold; runs that only repeat what the state has let it through, so they need not wait for each other.
    Symbols are stored as they are found. Values that are not finite are left out.
    """
    rows = series.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    size, first = RUN, start(references).text()
    run = F.floor(F.col("pos") / size).cast("long")
    # The last values of a run also go before the next one.
    rows = rows.withColumn("run", F.explode(F.when(F.col("pos") % size >= size - WARM, F.array(run, run + 1)).otherwise(F.array(run))))
    runs = rows.groupBy("series_id", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v")).where(F.element_at("v", -1)["pos"] >= F.col("run") * size)
    runs = runs.select("series_id", "run", F.col("v.pos").alias("pos"), F.col("v.value").alias("value"))
    found = _staged(runs.mapInArrow(lambda batches: _searched(batches, size, first), _FOUND), "symbols")
    while True:
        ordered = found.select("series_id", "run", "before", "after", "few").repartition("series_id").sortWithinPartitions("series_id", "run")
        wrong = _staged(ordered.mapInArrow(lambda batches: _misfits(batches, first), "series_id string, run long, before string"), "due")
        if not wrong.limit(1).count():
            break
        again = found.select("series_id", "run", "pos", "value").join(wrong, ["series_id", "run"])
        again = _staged(again.mapInArrow(lambda batches: _searched(batches, size), _FOUND), "symbols")
        found = found.join(wrong, ["series_id", "run"], "left_anti").unionByName(again)
    each = found.select("series_id", F.inline(F.arrays_zip("pos", "is_zero", *KEY)))
    return each.select("series_id", F.floor(F.col("pos") / block).cast("long").alias("block_id"), "pos", "is_zero", *KEY)


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Symbols of each key by ``by`` (e.g. series, or series and block, or nothing for all)."""
    return rows.where(~F.col("is_zero")).groupBy(*by, *KEY).agg(F.count("*").alias("count"))


def block_counts(rows: DataFrame) -> DataFrame:
    """Values, zero differences and distinct keys of each block, the short last one included."""
    return rows.groupBy("series_id", "block_id").agg(F.count("*").alias("values"), F.count_if("is_zero").alias("zeros"), F.count_distinct(F.when(~F.col("is_zero"), F.struct(*KEY))).alias("distinct_keys"))


def pooled(counts: DataFrame) -> DataFrame:
    """Counts by series and over all series (scope 'dataset' or 'global')."""
    both = counts.rollup("series_id", *KEY).agg(F.sum("count").alias("count"), F.grouping("delta_e").alias("_partial"))
    one = both.where("_partial = 0").drop("_partial").withColumn("scope", F.lit("dataset"))
    return one.unionByName(counts.groupBy(*KEY).agg(F.sum("count").alias("count")).withColumn("series_id", F.lit("ALL")).withColumn("scope", F.lit("global")))


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rank of each key: by count, then sign, step in places, step in exponent."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), *KEY)))


def distribution(counts: DataFrame, by: list[str]) -> DataFrame:
    """rank, key, count, probability and cumulative coverage."""
    total = F.sum("count").over(Window.partitionBy(*by))
    upto = F.sum("count").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked(counts, by).select(*by, "rank", *KEY, "count", (F.col("count") / total).alias("probability"), (upto / total).alias("cumulative_coverage"))


def top_keys(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent keys; Spark keeps k rows per partition before it shuffles."""
    return ranked(counts, by).where(F.col("rank") <= k)


def _key_bits() -> Column:
    return 1 + places_cost(F.col("delta_u")) + exponent_cost(F.col("delta_e"))


def coverage(counts: DataFrame, by: list[str], ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """For each k: covered symbols, coverage, code bits and what a codebook of the top k keys would save, net."""
    rows = ranked(counts, by).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.col("rank") <= F.col("k")
    sums = rows.groupBy(*by, "k").agg(F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("covered"), F.sum("count").alias("total"), F.count_if(hit).alias("entries"), F.sum(F.when(hit, F.col("count") * _key_bits()).otherwise(0)).alias("saved"))
    code = ceil_log2(F.col("k") + 2)
    net = F.col("saved") - F.col("total") * code - BOOK_BITS - ENTRY_BITS * F.col("entries")
    return sums.select(*by, "k", "covered", "total", (F.col("covered") / F.col("total")).alias("coverage"), code.alias("code_bits"), net.alias("net_savings_bits"), (net / F.col("total")).alias("savings_bits_per_symbol"))


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys, Shannon entropy in bits, effective keys 2**H and entropy over its maximum."""
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    h = counts.withColumn("p", p).groupBy(*by).agg(F.count("*").alias("distinct_keys"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    norm = F.when(F.col("distinct_keys") > 1, F.col("entropy") / F.log2(F.col("distinct_keys").cast("double"))).otherwise(F.lit(0.0))
    return h.select(*by, "distinct_keys", "entropy", F.pow(F.lit(2.0), F.col("entropy")).alias("effective_keys"), norm.alias("normalized_entropy"))


SUMMARY_K = (1, 4, 8, 16, 32, 64)


def dataset_summary(rows: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """One row per series: values, symbols, zeros, zero rate, invalid rows (of ``invalid``: series_id, invalid_rows; else 0), distinct keys,
    entropy figures, coverage of the top 1, 4, 8, 16, 32 and 64, blocks."""
    counts = key_counts(rows, ["series_id"])
    base = rows.groupBy("series_id").agg(F.count("*").alias("values"), F.count_if("is_zero").alias("zeros"), F.count_distinct("block_id").alias("blocks"))
    base = base.withColumn("symbols", F.col("values") - F.col("zeros")).withColumn("zero_rate", F.col("zeros") / F.col("values"))
    base = base.join(invalid.select("series_id", "invalid_rows"), "series_id", "left") if invalid is not None else base.withColumn("invalid_rows", F.lit(0))
    base = base.withColumn("invalid_rows", F.coalesce("invalid_rows", F.lit(0)).cast("long"))
    tops = coverage(counts, ["series_id"], SUMMARY_K).groupBy("series_id").pivot("k", list(SUMMARY_K)).agg(F.first("coverage"))
    tops = tops.select("series_id", *(F.col(str(k)).alias(f"top{k}_coverage") for k in SUMMARY_K))
    return base.join(entropy(counts, ["series_id"]), "series_id", "left").join(tops, "series_id", "left")


def centred_region(counts: DataFrame, by: list[str], targets: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """The smallest region |step in places| <= U, |step in exponent| <= E that covers each target share of the symbols.

    For each U among the keys, E is the least radius that covers enough; fewest cells win, then most covered, then the smaller U.
    """
    c = counts.groupBy(*by, F.abs("delta_u").alias("au"), F.abs("delta_e").alias("ae")).agg(F.sum("count").alias("n"))
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    radii = c.select(*by, F.col("au").alias("u")).distinct()
    within = radii.join(c, by) if by else radii.crossJoin(c)  # a few hundred distinct steps at most
    within = within.where("au <= u").groupBy(*by, "u", "ae").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "u").orderBy("ae").rowsBetween(Window.unboundedPreceding, 0))
    within = within.withColumn("covered", upto)
    within = (within.join(total, by) if by else within.crossJoin(total)).withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    ok = within.where(F.col("covered") >= F.ceil(F.col("target") * F.col("total")))
    first = Window.partitionBy(*by, "target", "u").orderBy("ae")
    ok = ok.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    cells = 2 * (2 * F.col("u").cast("long") + 1) * (2 * F.col("ae").cast("long") + 1)
    best = Window.partitionBy(*by, "target").orderBy("cells", F.desc("covered"), "u")
    ok = ok.withColumn("cells", cells).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return ok.select(*by, "target", F.col("u").alias("ulp_radius"), F.col("ae").alias("exponent_radius"), "cells", "covered", "total", (F.col("covered") / F.col("total")).alias("actual_coverage"))


def block_stability(rows: DataFrame, ks: tuple[int, ...] = (16, 32)) -> DataFrame:
    """Each block against the top k keys of the block before, for each k: hit rate, Jaccard of both top k sets, net savings per symbol.

    Null for the first block of a series.
    """
    by = ["series_id", "block_id"]
    r = ranked(key_counts(rows, by), by).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    prev = r.where(F.col("rank") <= F.col("k")).select("series_id", (F.col("block_id") + 1).alias("block_id"), "k", *KEY, F.lit(1).alias("in_prev"))
    size = prev.groupBy(*by, "k").agg(F.count("*").alias("prev_size"))
    j = r.join(prev, [*by, "k", *KEY], "left")
    hit, top = F.col("in_prev").isNotNull(), F.col("rank") <= F.col("k")
    sums = j.groupBy(*by, "k").agg(F.sum("count").alias("symbols"), F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("hits"), F.count_if(hit & top).alias("shared"), F.count_if(top).alias("top"), F.sum(F.when(hit, F.col("count") * _key_bits()).otherwise(0)).alias("saved"))
    net = F.col("saved") - F.col("symbols") * ceil_log2(F.col("k") + 2) - BOOK_BITS - ENTRY_BITS * F.col("prev_size")
    known = F.col("prev_size").isNotNull()
    out = sums.join(size, [*by, "k"], "left")
    return out.select(*by, "k", "symbols", F.when(known, F.col("hits") / F.col("symbols")).alias("previous_hit_rate"), F.when(known, F.col("shared") / (F.col("top") + F.col("prev_size") - F.col("shared"))).alias("jaccard"), F.when(known, net / F.col("symbols")).alias("net_savings_bits_per_symbol"))


def choose_codebook(counts: DataFrame, by: list[str]) -> DataFrame:
    """The code width 1 to 15 (2**bits - 2 keys) that saves most, the smaller of equals; width 0 where none saves anything."""
    rows = ranked(counts, by).withColumn("bits", F.explode(F.sequence(F.lit(2), F.lit(15))))
    capacity = F.expr("shiftleft(1, bits)") - 2
    hit = F.col("rank") <= capacity
    sums = rows.groupBy(*by, "bits").agg(F.sum("count").alias("total"), F.count_if(hit).alias("entries"), F.sum(F.when(hit, F.col("count") * _key_bits()).otherwise(0)).alias("saved"))
    net = F.col("saved") - F.col("total") * F.col("bits") - BOOK_BITS - ENTRY_BITS * F.col("entries")
    best = sums.withColumn("net", net).groupBy(*by).agg(F.max_by(F.struct("bits", "entries", "net"), F.struct("net", -F.col("bits"))).alias("b"))
    pays = F.col("b.net") > 0
    return best.select(*by, F.when(pays, F.col("b.bits")).otherwise(0).alias("code_bits"), F.when(pays, F.col("b.entries")).otherwise(0).alias("entries"), F.when(pays, F.col("b.net")).otherwise(0).alias("net_savings_bits"))


def global_summary(rows: DataFrame) -> DataFrame:
    """metric, value pairs over all series."""
    counts = key_counts(rows, []).withColumn("all", F.lit(0))
    e = entropy(counts, ["all"])
    known = F.when(F.col("previous_hit_rate").isNotNull(), F.col("symbols"))
    pool = lambda c: F.sum(F.col(c) * F.col("symbols")) / F.sum(known)
    stab = block_stability(rows, (16, 32)).groupBy("k").agg(pool("previous_hit_rate").alias("rate"), pool("net_savings_bits_per_symbol").alias("net"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    stab = stab.agg(pick(16, "rate").alias("pooled_hit_rate"), pick(32, "rate").alias("pooled_hit_rate_32"), pick(16, "net").alias("pooled_net_savings"), pick(32, "net").alias("pooled_net_savings_32"))
    base = rows.agg(F.count("*").cast("double").alias("values"), F.count_if("is_zero").cast("double").alias("zeros"), F.count_distinct("series_id").cast("double").alias("datasets"))
    one = base.crossJoin(e.drop("all")).crossJoin(stab)  # three one-row tables
    names = ["datasets", "values", "zeros", "distinct_keys", "entropy", "effective_keys", "normalized_entropy", "pooled_hit_rate", "pooled_hit_rate_32", "pooled_net_savings", "pooled_net_savings_32"]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.metric", "m.value")


def heat_map(counts: DataFrame, radius_u: int = 3, radius_e: int = 3) -> DataFrame:
    """Counts over both signs as a matrix: a row per step in places, a column per step in exponent."""
    c = counts.where((F.abs("delta_u") <= radius_u) & (F.abs("delta_e") <= radius_e))
    return c.groupBy("delta_u").pivot("delta_e", list(range(-radius_e, radius_e + 1))).agg(F.sum("count")).na.fill(0)
