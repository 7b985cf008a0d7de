import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric
from tests.fixtures import SPECIAL_BITS


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def out(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr.alias("y")).collect()]


def test_bits_both_ways(spark):
    want = [int(b) for b in SPECIAL_BITS.view(np.int64)]
    df = column(spark, want, "long").withColumn("x", numeric.f64_from_bits(F.col("x")))
    assert out(df, numeric.f64_bits(F.col("x"))) == want
    assert out(column(spark, [None, 1.0]), numeric.f64_bits(F.col("x"))) == [None, 0x3FF0000000000000]


def test_zeros_of_longs(spark):
    xs = [0, 1, -1, 2, 1 << 62, -(1 << 63), 0x00FF00, 12345678912345]
    df = column(spark, xs, "long")
    u = [x & (1 << 64) - 1 for x in xs]
    assert out(df, numeric.leading_zeros(F.col("x"))) == [64 - x.bit_length() for x in u]
    assert out(df, numeric.trailing_zeros(F.col("x"))) == [(x & -x).bit_length() - 1 if x else 64 for x in u]
    assert out(df, numeric.centre_bits(F.col("x"))) == [x.bit_length() - ((x & -x).bit_length() - 1) if x else 0 for x in u]


def test_exponent_next_to_powers_of_two(spark):
    xs = [float(y) for k in (-1000, -30, -4, -1, 0, 1, 3, 52, 1000) for y in (np.nextafter(2.0**k, 0), 2.0**k, np.nextafter(2.0**k, np.inf))] + [0.1, -8.0, 1e308]
    assert out(column(spark, xs), numeric.exponent(F.col("x"))) == [math.frexp(x)[1] - 1 for x in xs]
    assert out(column(spark, [0.0, 5e-324, float("inf"), float("nan")]), numeric.exponent(F.col("x"))) == [-1023, -1023, 1024, 1024]


def test_decimal_places(spark):
    xs = [0.0, 5.0, 0.1, 1.25, -3.125, 1e-15, 0.1234567890123456, 1e300]
    assert out(column(spark, xs), numeric.decimal_places(F.col("x"))) == [0, 0, 1, 2, 3, 15, 16, 0]
    assert out(column(spark, [1.25, 10.0]), numeric.printed_places(F.col("x"))) == [2, 1]


@pytest.mark.parametrize("bits", [3, 4, 11])
def test_sign_magnitude(spark, bits):
    top = 1 << (bits - 1)
    xs = list(range(-top - 1, top + 2))
    df = column(spark, xs, "int").withColumn("b", numeric.sign_magnitude(F.col("x"), bits))
    assert out(df, numeric.from_sign_magnitude(F.col("b"), bits)) == [x if abs(x) < top else None for x in xs]


def test_costs_and_logs(spark):
    df = column(spark, [-4, -3, 0, 3, 4], "int")
    assert out(df, numeric.exponent_cost(F.col("x"))) == [14, 3, 3, 3, 14]
    assert out(df, numeric.places_cost(F.col("x"))) == [7, 3, 3, 3, 7]
    assert out(column(spark, [1, 2, 3, 4, 5, 258, 65538], "long"), numeric.ceil_log2(F.col("x"))) == [1, 1, 2, 2, 3, 9, 17]


def test_rounding_and_text(spark):
    df = column(spark, [1.231, -1.231, 1.23])
    assert out(df, numeric.quantize_up(F.col("x"), F.lit(2))) == [1.24, -1.24, 1.23]
    names = column(spark, ["a.csv", "b", ".hidden", "x.y.csv"], "string")
    assert out(names, numeric.strip_extension(F.col("x"))) == ["a", "b", ".hidden", "x.y"]
    lines = column(spark, ["m{a:1,b:2}", "m", "k{a:3}"], "string")
    assert out(lines, numeric.parse_config(F.col("x"), "m")) == [{"a": "1", "b": "2"}, {}, {}]
    assert out(column(spark, [5], "int"), numeric.fixed_binary(F.col("x"), 8)) == ["00000101"]


def test_mantissa_rule(spark):
    df = spark.createDataFrame([(-4, 1), (0, 2), (6, 3), (-1, 0), (300, 2)], "e int, u int")
    got = [r[0] for r in df.select(numeric.mantissa_bits(F.col("e"), F.col("u"))).collect()]
    want = [e - math.floor(-u * math.log2(10)) if e < 0 else e + math.ceil(u * math.log2(10)) for e, u in ((-4, 1), (0, 2), (6, 3), (-1, 0), (300, 2))]
    assert got == [max(0, min(52, w)) for w in want]


def test_fields_of_doubles_and_back(spark):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=60) * 10.0 ** rng.integers(-200, 200, 60), [0.0, -0.0, 1.0, -1.5, 5e-324, 1.7976931348623157e308]])
    rows = spark.createDataFrame([(i, float(x), int(i % 53)) for i, x in enumerate(v)], "i long, x double, n int")
    sign, e = (numeric.f64_bits(F.col("x")) < 0).cast("int"), F.when(F.abs("x") < 2.2250738585072014e-308, F.lit(-1023)).otherwise(numeric.exponent(F.col("x")))
    got = rows.select("i", "n", numeric.mantissa_top(F.col("x"), F.col("n")).alias("top"), numeric.from_fields(sign, e, numeric.mantissa_top(F.col("x"), 52), F.lit(52)).alias("back"), numeric.mantissa_text(F.col("x"), 52).alias("text"))
    bits = v.view(np.int64)
    for r in got.collect():
        mantissa = int(bits[r["i"]]) & ((1 << 52) - 1)
        assert r["top"] == mantissa >> (52 - r["n"]) and r["text"] == format(mantissa, "052b")
        assert np.float64(r["back"]).view(np.int64) == bits[r["i"]]


def test_numbers_alike_bit_for_bit_and_exact_differences(spark):
    nan = np.array([0x7FF8000000001234], np.uint64).view(np.float64)[0]
    rows = spark.createDataFrame([(0, 0.0, -0.0), (1, float("nan"), float("nan")), (2, 1.0, 1.0), (3, 1.0, 1.5), (4, None, None), (5, None, 0.0), (6, 0.3, 0.1), (7, 1e300, 1e-300)], "i long, a double, b double")
    got = {r["i"]: (r["same"], r["d"]) for r in rows.select("i", numeric.same_number(F.col("a"), F.col("b")).alias("same"), numeric.decimal_difference(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [got[i][0] for i in range(6)] == [True, True, True, False, True, False]
    assert got[6][1] == 0.2 and got[7][1] == 1e300 and got[5][1] is None
    odd = spark.createDataFrame([(float(nan), float("nan"))], "a double, b double")
    assert odd.select(numeric.same_number(F.col("a"), F.col("a"))).first()[0]
