"""Scalar functions on doubles, decimals and bit patterns, as Column expressions unless noted."""

from __future__ import annotations

import math
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PLACES = 15
#: Digits enough for the exact difference of any two doubles.
EXACT = Context(prec=2_200)
#: ln 10 / ln 2 as a quotient of doubles: the value the mantissa rule is defined with.
LOG2_10 = math.log(10) / math.log(2)


def f64_bits(x: Column) -> Column:
    """Raw 64-bit pattern of a double as a long; NaN payloads and signed zeros are kept. An Arrow view, no arithmetic."""

    @F.arrow_udf("long")
    def view(a: pa.Array) -> pa.Array:
        return a.view(pa.int64())

    return view(x)


def f64_from_bits(b: Column) -> Column:
    """The double with this raw bit pattern."""

    @F.arrow_udf("double")
    def view(a: pa.Array) -> pa.Array:
        return a.view(pa.float64())

    return view(b)


def leading_zeros(b: Column) -> Column:
    """Leading zero bits of a long (64 for 0): smear the highest bit down, then count what is left."""
    for k in (1, 2, 4, 8, 16, 32):
        b = b.bitwiseOR(F.shiftrightunsigned(b, k))
    return F.lit(64) - F.bit_count(b)


def trailing_zeros(b: Column) -> Column:
    """Trailing zero bits of a long (64 for 0)."""
    return F.when(b == 0, F.lit(64)).otherwise(F.bit_count(F.bitwise_not(b).bitwiseAND(F.when(b == -(1 << 63), F.lit((1 << 63) - 1)).otherwise(b - 1))))


def centre_bits(b: Column) -> Column:
    """Bits between the leading and the trailing zeros of a long."""
    return F.when(b == 0, F.lit(0)).otherwise(F.lit(64) - leading_zeros(b) - trailing_zeros(b))


def exponent(x: Column) -> Column:
    """IEEE exponent of a finite double; -1023 for zero and subnormals, 1024 for NaN and infinities. log2 is corrected by exact powers."""
    a = F.abs(x)
    e = F.floor(F.log2(a)).cast("int")
    power = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    fixed = F.when(power(e) > a, e - 1).when(power(e + 1) <= a, e + 1).otherwise(e)
    return F.when(F.isnan(x) | (a == float("inf")), F.lit(1024)).when(a < 2.2250738585072014e-308, F.lit(-1023)).otherwise(fixed)


def decimal_places(x: Column, most: int = MAX_PLACES) -> Column:
    """Fewest decimal places that give the double back exactly; ``most`` + 1 if more are needed, 0 for integers."""
    out = F.when(x == F.rint(x), F.lit(0))
    for u in range(1, most + 1):
        out = out.when(F.rint(x * 10.0**u) / 10.0**u == x, F.lit(u))
    return out.otherwise(F.lit(most + 1))


def printed_places(x: Column) -> Column:
    """Characters after the point in a double's printed form."""
    return F.length(F.substring_index(x.cast("string"), ".", -1))


def mantissa_bits(e: Column, places: Column) -> Column:
    """Mantissa bits that keep a value of exponent ``e`` exact to ``places`` decimals, within 0 and 52."""
    below = e - F.floor(-places * LOG2_10)
    above = e + F.ceil(places * LOG2_10)
    return F.greatest(F.lit(0), F.least(F.lit(52), F.when(e < 0, below).otherwise(above))).cast("int")


def sign_magnitude(v: Column, bits: int) -> Column:
    """``v`` as sign bit and magnitude; what does not fit becomes the pattern of minus zero, the overflow mark."""
    top = 1 << (bits - 1)
    return F.when(F.abs(v) >= top, F.lit(top)).when(v < 0, F.lit(top) - v).otherwise(v).cast("long")


def from_sign_magnitude(b: Column, bits: int) -> Column:
    """The value of a sign-magnitude pattern; null for the overflow mark."""
    top = 1 << (bits - 1)
    return F.when(b == top, F.lit(None)).when(b >= top, F.lit(top) - b).otherwise(b).cast("long")


def quantize_up(x: Column, places: Column) -> Column:
    """Round away from zero to ``places`` decimals; exact doubles of that many places stay."""
    scale = F.pow(F.lit(10.0), places.cast("double"))
    near = F.rint(x * scale) / scale
    return F.when(near == x, x).otherwise(F.signum(x) * F.ceil(F.abs(x) * scale) / scale)


def decimal_difference(a: Column, b: Column) -> Column:
    """a - b as the decimals that the doubles print as, exact at the larger number of places, as the nearest double."""

    @F.arrow_udf("double")
    def minus(x: pa.Array, y: pa.Array) -> pa.Array:
        one = lambda u, v: None if u is None or v is None else float(EXACT.subtract(Decimal(repr(u)), Decimal(repr(v)))) if math.isfinite(u) and math.isfinite(v) else u - v
        return pa.array(map(one, x.to_pylist(), y.to_pylist()), pa.float64())

    return minus(a, b)


def mantissa_top(x: Column, bits: Column | int) -> Column:
    """The top ``bits`` (0 to 52, clamped) of a double's mantissa, as a long."""
    n = F.greatest(F.lit(0), F.least(F.lit(52), F.lit(bits) if isinstance(bits, int) else bits))
    shift = (F.lit(52) - n).cast("int")
    return F.call_function("shiftrightunsigned", f64_bits(x).bitwiseAND(F.lit((1 << 52) - 1)), shift)


def from_fields(sign: Column, e: Column, mantissa: Column, bits: Column) -> Column:
    """The double with this sign bit, exponent and top ``bits`` of the mantissa; exponents beyond those of finite doubles are clamped."""
    n = F.greatest(F.lit(0), F.least(F.lit(52), bits))
    biased = F.greatest(F.lit(0), F.least(F.lit(2046), e + 1023)).cast("long")
    low = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", mantissa.cast("long"), (F.lit(52) - n).cast("int")).bitwiseAND(F.lit((1 << 52) - 1)))
    high = F.when(sign == 1, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    return f64_from_bits(high.bitwiseOR(F.shiftleft(biased, 52)).bitwiseOR(low))


def exponent_cost(delta: Column) -> Column:
    """Bits of an exponent step: 3, and 11 more where it goes beyond -3..3."""
    return F.when(F.abs(delta) > 3, F.lit(14)).otherwise(F.lit(3))


def places_cost(delta: Column) -> Column:
    """Bits of a step in decimal places: 3, and 4 more where it goes beyond -3..3."""
    return F.when(F.abs(delta) > 3, F.lit(7)).otherwise(F.lit(3))


def ceil_log2(n: Column) -> Column:
    """ceil(log2(n)), 1 at least; exact, by the length of n - 1 in binary."""
    return F.greatest(F.lit(1), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(1)))


def same_number(a: Column, b: Column) -> Column:
    """Equal bit patterns, NaN payloads included, with both zeros alike; null equals null only."""
    return f64_bits(a).eqNullSafe(f64_bits(b)) | F.coalesce((a == 0) & (b == 0), F.lit(False))


def strip_extension(name: Column) -> Column:
    """A file name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def parse_config(line: Column, name: str) -> Column:
    """The ``{k:v,...}`` part of ``name{k:v,...}`` as a map; an empty map where the line has none."""
    inner = F.regexp_extract(line, rf"{name}\{{([^}}]*)\}}", 1)
    return F.when(inner != "", F.str_to_map(inner, F.lit(","), F.lit(":"))).otherwise(F.create_map().cast("map<string,string>"))


def fixed_binary(v: Column, bits: int) -> Column:
    """A non-negative integer as text of ``bits`` binary digits."""
    return F.lpad(F.bin(v), bits, "0")


def mantissa_text(x: Column, bits: int) -> Column:
    """The top ``bits`` of a double's mantissa as text of binary digits."""
    return fixed_binary(mantissa_top(x, bits), bits) if bits else F.lit("")
