import math
import random
from collections import Counter
from decimal import Context, Decimal

import numpy as np

from tessera.operators import transitions as tr


def frame(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, pos long, value double")


def plain_symbols(values):
    """One value after the other, in exact decimals."""
    refs, deltas, at, out = [Decimal("0.1")] * 4, [Decimal("0.1")] * 4, 0, []
    ctx = Context(prec=2_000)
    places = lambda d: max(0, -ctx.normalize(d).as_tuple().exponent)
    power = lambda d: 1024 if math.isinf(float(d)) else max(-1023, math.frexp(abs(float(d)))[1] - 1)
    for v in values:
        v, best = Decimal(repr(v)), None
        for k in [*range(at, 4), *range(at)]:
            d = ctx.subtract(v, refs[k])
            if d == 0:
                best = None
                break
            u, e = places(d), power(d)
            du, de = u - places(deltas[k]), e - power(deltas[k])
            keep = e - math.floor(-u * math.log(10) / math.log(2)) if e < 0 else e + math.ceil(u * math.log(10) / math.log(2))
            cost = (3 if abs(du) <= 3 else 7) + (3 if abs(de) <= 3 else 14) + min(52, max(0, keep))
            if best is None or cost < best[0]:
                best = cost, d, (int(d < 0), du, de)
        out.append((best is None, *(best[2] if best else (None,) * 3)))
        if best:
            refs[at], deltas[at], at = v, best[1], (at + 1) % 4
    return out


def test_symbols_of_any_decimals_over_many_runs(spark, monkeypatch):
    rng = random.Random(5)
    values = [round(rng.gauss(0, 50), rng.randrange(10)) if rng.random() < 0.7 else rng.choice([1.25, 1.25, 0.5]) for _ in range(1500)] + [1e-300, 1e300, -0.0, 0.0, 5e-324, 1.7976931348623157e308, -1.7e308]
    monkeypatch.setattr(tr, "RUN", 64)
    rows = tr.symbols(frame(spark, [*values, float("nan"), float("inf")]), 100).orderBy("pos").collect()
    assert [(r["is_zero"], r["sign"], r["delta_u"], r["delta_e"]) for r in rows] == plain_symbols(values)
    assert all(r["block_id"] == r["pos"] // 100 for r in rows)


def test_a_state_that_never_forgets_is_carried_through_all_runs(spark, monkeypatch):
    # Repeats only: no run changes the state, so each must wait for the one before it.
    monkeypatch.setattr(tr, "RUN", 8)
    values = [3.75, 4.5, 9.0, 2.25] + [9.0] * 40 + [4.75]
    got = [(r["is_zero"], r["sign"], r["delta_u"], r["delta_e"]) for r in tr.symbols(frame(spark, values), 100).orderBy("pos").collect()]
    assert got == plain_symbols(values)


def test_region_and_coverage_against_loops(spark):
    counts = {(0, 0, 0): 50, (1, 0, 1): 20, (0, 2, -1): 15, (1, -1, 3): 10, (0, 5, 9): 5}
    df = spark.createDataFrame([("s", *k, n) for k, n in counts.items()], "series_id string, sign int, delta_u int, delta_e int, count long")
    for r in tr.centred_region(df, ["series_id"]).collect():
        best = None
        need = math.ceil(r["target"] * 100)
        for u in sorted({abs(k[1]) for k in counts}):
            for e in sorted({abs(k[2]) for k in counts}):
                got = sum(n for k, n in counts.items() if abs(k[1]) <= u and abs(k[2]) <= e)
                cells = 2 * (2 * u + 1) * (2 * e + 1)
                if got >= need and (best is None or (cells, -got) < best[0]):
                    best = (cells, -got), u, e
        assert (r["ulp_radius"], r["exponent_radius"]) == best[1:]
    got = {r["k"]: r["covered"] for r in tr.coverage(df, ["series_id"]).collect()}
    assert [got[k] for k in (1, 2, 4, 256)] == [50, 70, 95, 100]
    h = tr.entropy(df, ["series_id"]).first()
    assert abs(h["entropy"] + sum(n / 100 * math.log2(n / 100) for n in counts.values())) < 1e-12


def test_first_block_has_no_predecessor(spark):
    rows = tr.symbols(frame(spark, [((i * 7) % 13) / 4 for i in range(300)]), 100)
    got = tr.block_stability(rows, (16,)).orderBy("block_id").collect()
    assert got[0]["previous_hit_rate"] is None and 0 <= got[1]["previous_hit_rate"] <= 1
    c = Counter((r["block_id"], r["is_zero"]) for r in rows.collect())
    assert {(r["block_id"], r["zeros"]) for r in tr.block_counts(rows).collect()} == {(b, c[b, True]) for b in range(3)}


def test_codebook_without_use_is_empty(spark):
    df = spark.createDataFrame([("s", 0, 0, 0, 1)], "series_id string, sign int, delta_u int, delta_e int, count long")
    assert tuple(tr.choose_codebook(df, ["series_id"]).first()) == ("s", 0, 0, 0)


def rounds(monkeypatch, spark, values):
    """Symbols of the values in runs of 64, and how often the states of the runs were compared."""
    names, staged = [], tr._staged
    monkeypatch.setattr(tr, "_staged", lambda df, name: names.append(name) or staged(df, name))
    monkeypatch.setattr(tr, "RUN", 64)
    got = [(r["is_zero"], r["sign"], r["delta_u"], r["delta_e"]) for r in tr.symbols(frame(spark, values), 100).orderBy("pos").collect()]
    return got, names.count("due")


def test_runs_do_not_wait_for_each_other(spark, monkeypatch):
    rng = random.Random(8)
    values = [round(rng.gauss(0, 50), 2) for _ in range(64 * 12)]
    got, n = rounds(monkeypatch, spark, values)
    assert got == plain_symbols(values) and n <= 2


def test_runs_of_few_values_do_not_wait_for_each_other(spark, monkeypatch):
    # Nothing but repeats after the first four: what a run begins in is what the first run left, in its order.
    rng = random.Random(9)
    values = [3.5, 1.25, 2.0, 0.75] + [rng.choice([2.0, 0.75, 1.25, 3.5]) for _ in range(64 * 12)] + [4.75, 8.5, 9.25]
    got, n = rounds(monkeypatch, spark, values)
    assert got == plain_symbols(values) and n <= 3


def test_runs_side_by_side_as_one_by_one():
    rng, states = random.Random(10), [tr.start()]
    for k in range(60):
        wide = 10 ** rng.randrange(10)
        values = [np.array([round(rng.gauss(0, wide), rng.randrange(k % 8 + 1)) if rng.random() < 0.7 else rng.choice([1.25, 0.0, -0.0, rng.random() if k % 10 == 0 else 0.5]) for _ in range(n)]) for n in (0, 1, 70)]
        before = [rng.choice(states) for _ in values]
        for x, s, (after, zero, *steps) in zip(values, before, tr.search_runs(values, before), strict=True):
            want, end = tr.search(x.tolist(), s)
            assert [(z, *((None,) * 3 if z else (a, b, c))) for z, a, b, c in zip(zero, *steps, strict=True)] == want and after == end and after.text() == end.text()
            states.append(after)
