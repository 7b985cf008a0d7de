import numpy as np
import pytest

from tessera.operators import position_query as pq
from tessera.operators import windows
from tessera.operators.mutate import EDITS, WindowStore
from tests.fixtures import cases, same_bits


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(x)) for i, x in enumerate(values)], "series_id string, pos long, value double")


def values(df):
    return np.array([r["value"] for r in df.orderBy("pos").collect()], np.float64)


@pytest.fixture(scope="module")
def table(spark):
    v = np.round(np.random.default_rng(3).normal(50, 9, 1000), 2)
    v[128] = 0.0
    v[256] = 0.1234567890123456
    return v, windows.build(series(spark, v)).cache()


def test_round_trip(spark):
    for name in ("specials", "mixed", "random bits", "infinite", "one"):
        v = cases()[name]
        assert same_bits(values(windows.decode(windows.build(series(spark, v)))), v)


@pytest.mark.parametrize(("start", "length"), [(0, 1), (127, 1), (128, 127), (128, 128), (127, 129), (999, 1), (0, 1000), (300, 555)])
def test_ranges(table, start, length):
    v, t = table
    part = v[start : start + length]
    assert same_bits(values(pq.range_values(t, "s", start, length)), part)
    total = 0.0
    for w in range(start // 128, (start + length - 1) // 128 + 1):
        inner = 0.0
        for x in v[max(start, w * 128) : min(start + length, w * 128 + 128)]:
            inner += x
        total += inner
    for stats in (False, True):
        r = pq.range_aggregate(t, "s", start, length, use_stats=stats).first()
        assert (r["n"], r["sum"], r["min"], r["max"]) == (length, total, part.min(), part.max())
        assert r["avg"] == total / length


def test_only_needed_windows_are_decoded(table):
    _, t = table
    assert pq.touching(t, "s", 130, 200).count() == 2
    r = pq.range_aggregate(t, "s", 100, 700, use_stats=True).first()
    assert r["decoded"] == 256  # the two windows at the ends
    plan = pq.touching(t, "s", 130, 200)._jdf.queryExecution().toString()
    assert "start_pos" in plan


@pytest.mark.parametrize(("start", "length"), [(-1, 2), (1000, 1), (0, 1001), (5, -1)])
def test_bounds(table, start, length):
    with pytest.raises(ValueError):
        pq.range_values(table[1], "s", start, length)


def test_empty_and_point_and_scan(table):
    v, t = table
    assert pq.range_values(t, "s", 1000, 0).count() == 0
    with pytest.raises(ValueError):
        pq.range_aggregate(t, "s", 0, 0)
    assert pq.point(t, "s", 257) == v[257]
    seen = []
    pq.scan(t, "s", 120, 20, seen.append)
    assert seen == v[120:140].tolist()
    assert pq.total_records(t, "s") == 1000 and pq.total_records(t, "none") == 0
    assert tuple(pq.locate(t, "s", 300).first()) == (2, 44)


def test_filters_reach_the_scan(spark, table, tmp_path):
    table[1].write.parquet(f"{tmp_path}/w")
    scan = pq.touching(spark.read.parquet(f"{tmp_path}/w"), "s", 130, 200)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in scan.splitlines() if "PushedFilters" in x)
    assert "GreaterThan(end_pos,130)" in pushed and "LessThan(start_pos,330)" in pushed


def test_edits_follow_a_list(spark, tmp_path):
    rng, model = np.random.default_rng(11), np.round(np.random.default_rng(2).normal(size=300), 2).tolist()
    store = WindowStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.create(series(spark, model)) == 1
    first = list(model)
    for step, (op, pos) in enumerate([("update", 128), ("insert", 128), ("insert", 301), ("delete", 0), ("delete", 127), ("update", 299)]):
        x = float(np.round(rng.normal(), 2))
        if op == "update":
            store.update("s", pos, x)
            model[pos] = x
        elif op == "insert":
            store.insert("s", pos, x)
            model.insert(pos, x)
        else:
            store.delete("s", pos)
            del model[pos]
        assert store.version() == step + 2
    assert values(windows.decode(store.windows())).tolist() == model
    assert values(windows.decode(store.windows(1))).tolist() == first
    hit = store.range_windows("s", 126, 5)
    assert values(pq.range_values(hit, "s", 126, 3)).tolist() == model[126:129] or hit.count() >= 1


def test_a_window_may_become_empty_and_be_refilled(spark, tmp_path):
    model = [float(i) for i in range(260)]
    store = WindowStore(spark, f"file://{tmp_path}/store")
    store.create(series(spark, model))
    store.apply(spark.createDataFrame([("s", "delete", p, 0, None) for p in range(128, 260)], EDITS))
    assert store.windows().where("cnt = 0").count() == 2
    assert values(windows.decode(store.windows())).tolist() == model[:128]
    store.insert("s", 128, 0.5)
    assert values(windows.decode(store.windows())).tolist() == [*model[:128], 0.5]
    assert pq.range_aggregate(store.windows(), "s", 0, 129).first()["n"] == 129


def test_bad_edits_leave_the_version(spark, tmp_path):
    store = WindowStore(spark, f"file://{tmp_path}/store")
    store.create(series(spark, [1.0] * 10))
    for edit in (("s", "update", 10, 0, 1.0), ("s", "insert", 11, 0, 1.0), ("s", "delete", -1, 0, None), ("t", "update", 0, 0, 1.0), ("s", "merge", 0, 0, 1.0)):
        with pytest.raises(ValueError):
            store.apply(spark.createDataFrame([edit], EDITS))
    with pytest.raises(ValueError):
        store.apply(spark.createDataFrame([("s", "insert", 0, k, 1.0) for k in range(600)], EDITS))
    assert store.version() == 1 and store.apply(spark.createDataFrame([], EDITS)) == 1
    with pytest.raises(ValueError):
        store.create(series(spark, [1.0]))


def test_prefix_sums_over_many_blocks(spark):
    from tessera.functions.offsets import running_total

    rows = spark.createDataFrame([("a", i * 3, i % 7) for i in range(200)], "series_id string, k long, n long")
    got = {r["k"]: r["t"] for r in running_total(rows, ["series_id"], "k", "n", "t", shift=4).collect()}
    assert got == {i * 3: sum(j % 7 for j in range(i)) for i in range(200)}


def test_positions_over_many_partitions(spark):
    from tessera.functions.offsets import positions

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200_000).selectExpr("id * 7919 % 200003 as k", "cast(id as double) as value").repartition(5)
        got = positions(rows, ["k"]).select("k", "pos").orderBy("k").toPandas()
        assert (got["pos"] == range(200_000)).all()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
