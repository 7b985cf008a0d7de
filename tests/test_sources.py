import struct

import pytest
from pyspark.errors import PySparkException

from tessera.sources import reports, series
from tessera.operators import codecs, transitions, windows
from tessera.plans import catalog


def write(path, name, text):
    (path / name).parent.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_csv_policies(spark, tmp_path):
    write(tmp_path, "a.csv", '﻿"1.5",x\n,y\nnan,z\n"2,5",q\n-3e2,"k,k"\n')
    write(tmp_path, "B.CSV", "value\n1\n2\n")
    write(tmp_path, "sub/c.csv", "9\n")
    write(tmp_path, "d.txt", "7\n")
    rows = series.csv_values(spark, str(tmp_path)).orderBy("series_id", "line").collect()
    assert [(r["series_id"], r["line"], r["value"]) for r in rows] == [("B", 1, 1.0), ("B", 2, 2.0), ("a", 0, 1.5), ("a", 4, -300.0)]
    deep = series.csv_values(spark, str(tmp_path), recursive=True).where("series_id = 'c'").collect()
    assert [r["value"] for r in deep] == [9.0]
    counts = {r["series_id"]: (r["rows"], r["invalid_rows"]) for r in series.invalid_rows(series.csv_values(spark, str(tmp_path), missing="null")).collect()}
    assert counts == {"a": (5, 3), "B": (2, 0)}
    assert {r["x"] for r in series.csv_values(spark, f"{tmp_path}/a.csv", column=1, missing="null").selectExpr("value as x").collect()} == {None}
    with pytest.raises(PySparkException):
        series.csv_values(spark, f"{tmp_path}/a.csv", missing="error").collect()
    assert series.csv_values(spark, f"{tmp_path}/B.CSV", header=True, missing="error").count() == 2


def test_complete_cases(spark, tmp_path):
    write(tmp_path, "t.csv", "t,v,w\n1,2,3\n4,,6\n7,NaN,9\n10,11,12\n")
    assert [tuple(r) for r in series.csv_table(spark, f"{tmp_path}/t.csv").collect()] == [("1", "2", "3"), ("10", "11", "12")]


def test_big_endian_doubles_and_fingerprints(spark, tmp_path):
    (tmp_path / "x.f64").write_bytes(struct.pack(">3d", 1.25, -0.0, 2.87))
    rows = series.doubles_file(spark, f"{tmp_path}/x.f64").orderBy("pos").collect()
    assert [str(r["value"]) for r in rows] == ["1.25", "-0.0", "2.87"]
    before = series.fingerprints(spark, str(tmp_path)).collect()
    assert before[0]["bytes"] == 24 and before == series.fingerprints(spark, str(tmp_path)).collect()
    (tmp_path / "x.f64").write_bytes(b"123")
    with pytest.raises(PySparkException):
        series.doubles_file(spark, f"{tmp_path}/x.f64").collect()


def test_nothing_is_written_over(spark, tmp_path):
    df = spark.range(3)
    series.write_new(df, f"{tmp_path}/o")
    with pytest.raises(PySparkException):
        series.write_new(df, f"{tmp_path}/o")


def test_shuffle_moves_every_value(spark):
    rows = spark.createDataFrame([("s", i, float(i)) for i in range(500)] + [("one", 0, 5.0)], "series_id string, pos long, value double")
    got = {(r["series_id"], r["pos"]): r["value"] for r in series.shuffled(rows, 9).collect()}
    assert all(got["s", i] != float(i) for i in range(500)) and sorted(v for (s, _), v in got.items() if s == "s") == [float(i) for i in range(500)]
    assert got["one", 0] == 5.0 and got == {(r["series_id"], r["pos"]): r["value"] for r in series.shuffled(rows, 9).collect()}


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", i, ((i * (k + 3)) % 17) / 4) for k in range(2) for i in range(400)], "series_id string, pos long, value double")
    reports.distribution_reports(transitions.symbols(rows, 100), f"{tmp_path}/d")
    assert spark.read.csv(f"{tmp_path}/d/dataset_summary", header=True).count() == 2
    assert {r["scope"] for r in spark.read.csv(f"{tmp_path}/d/key_distribution", header=True).collect()} == {"dataset", "global"}
    reports.checked_reports(rows, ["xor", "window"], f"{tmp_path}/c", 100)
    assert {r["status"] for r in spark.read.csv(f"{tmp_path}/c/summary", header=True).collect()} == {"PASS_RAW_BITS"}


def test_lines_of_split_files_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 3000)):
        write(tmp_path, f"{name}.csv", "\ufeffvalue\n" + "".join(f"{i}.5\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert series.csv_lines(spark, str(tmp_path))[0].rdd.getNumPartitions() > 8
        got = series.csv_values(spark, str(tmp_path)).collect()
        strict = series.csv_strict(spark, str(tmp_path), 0, None, 1024).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["series_id"], r["line"], r["value"]) for r in got) == [(k, i + 1, i + 0.5) for k, n in (("a", 5000), ("b", 1), ("c", 3000)) for i in range(n)]
    assert sorted((r["series_id"], r["pos"], r["block_id"], r["value"]) for r in strict) == [(k, i, i // 1024, i + 0.5) for k, n in (("a", 5000), ("b", 1), ("c", 3000)) for i in range(n)]


@pytest.mark.parametrize(
    ("text", "column", "header", "why"),
    [
        ("1\n\n2\n", 0, False, "missing value"),
        ("1,2\n3\n", 1, False, "missing column"),
        ("v,w\n1,x\n", 1, True, "invalid value"),
        ("a,b\n1,2\n", 0, False, "invalid value"),
        (",\n1,2\n", 0, None, "missing value"),
        ("v,w\n", 1, True, "without values"),
        ("", 0, None, "without values"),
    ],
)
def test_strict_csv_rejects(spark, tmp_path, text, column, header, why):
    write(tmp_path, "t.csv", text)
    with pytest.raises((PySparkException, ValueError), match=why):
        series.csv_strict(spark, str(tmp_path), column, header).collect()


def test_strict_csv_keeps_the_short_tail(spark, tmp_path):
    write(tmp_path, "t.csv", "x\n1\nNaN\n-0.0\n4\n5")
    rows = series.csv_strict(spark, str(tmp_path), 0, True, 2).orderBy("pos").collect()
    assert [(r["pos"], r["block_id"], str(r["value"])) for r in rows] == [(0, 0, "1.0"), (1, 0, "nan"), (2, 1, "-0.0"), (3, 1, "4.0"), (4, 2, "5.0")]
    assert {r["block_id"] for r in series.csv_strict(spark, str(tmp_path), 0, True).collect()} == {0}


def test_changed_sources(spark, tmp_path):
    for k in "abc":
        write(tmp_path, f"s/{k}.csv", k)
    series.fingerprints(spark, f"{tmp_path}/s").write.parquet(f"{tmp_path}/before")
    before = spark.read.parquet(f"{tmp_path}/before")
    assert series.changed_sources(spark, f"{tmp_path}/s", before).count() == 0
    write(tmp_path, "s/b.csv", "B")
    write(tmp_path, "s/d.csv", "d")
    (tmp_path / "s/a.csv").unlink()
    assert {(r["path"][-5:], r["change"]) for r in series.changed_sources(spark, f"{tmp_path}/s", before).collect()} == {("a.csv", "removed"), ("b.csv", "changed"), ("d.csv", "added")}


def test_shuffle_is_one_cycle_over_many_blocks(spark):
    rows = spark.createDataFrame([(s, i, float(i)) for s, n in (("s", 2000), ("t", 3), ("u", 1)) for i in range(n)], "series_id string, pos long, value double")
    got = {(r["series_id"], r["pos"]): int(r["value"]) for r in series.shuffled(rows, 5, block=64).collect()}
    for s, n in (("s", 2000), ("t", 3), ("u", 1)):
        at, seen = 0, 0
        while not seen or at:
            at, seen = got[s, at], seen + 1
        assert seen == n


def test_big_endian_blocks(spark):
    values = [1.5, -0.0, float("nan"), 1e-320, -2.75, float("inf"), 7.0]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, pos long, value double")
    got = series.big_endian_blocks(rows, 3).orderBy("block_id").collect()
    assert [len(r["payload"]) for r in got] == [24, 24, 8]
    assert b"".join(bytes(r["payload"]) for r in got) == struct.pack(">7d", *values)


def test_decoded_values_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", i, i / 4) for k in range(2) for i in range(500)], "series_id string, pos long, value double")
    reports.write_decoded(windows.build(rows), f"{tmp_path}/d")
    back = spark.read.csv(f"{tmp_path}/d", header=True, schema="pos long, value double, series_id string")
    assert sorted((r["series_id"], r["pos"], r["value"]) for r in back.collect()) == [(f"s{k}", i, i / 4) for k in range(2) for i in range(500)]


def test_a_block_that_cannot_be_decoded_is_an_error(spark):
    rows = spark.createDataFrame([("s", i, i / 8) for i in range(250)], "series_id string, pos long, value double")
    blocks = codecs.encode_blocks(rows, ["window", "xor"], 100)
    broken = blocks.withColumn("payload", blocks["payload"].substr(1, 1)).where("codec = 'window' and block_id = 1").unionByName(blocks.where("codec <> 'window' or block_id <> 1"))
    got = {r["codec"]: r for r in codecs.verify(rows, broken, 100).collect()}
    assert (got["xor"]["status"], got["xor"]["error"]) == ("PASS_RAW_BITS", None)
    assert got["window"]["status"] == "ERROR" and got["window"]["error"].startswith("block 1") and got["window"]["decoded_records"] == 150
    with pytest.raises(PySparkException):
        codecs.decode_blocks(broken, 100).collect()


def test_strict_csv_of_a_table_whose_first_task_has_no_rows(spark, small, tmp_path):
    # One group of rows in many splits: only the task that has its middle gets rows, and a first task without rows wrote a file of only a header.
    import shutil

    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted(tuple(r) for r in catalog.strict_csv(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((r["event_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "events.parquet")).collect())


def test_strict_csv_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.strict_csv(spark, str(tmp_path)).count() == 0
