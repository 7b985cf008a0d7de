import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import codecs
from tessera.operators.windows import decode_window, encode_window
from tests.fixtures import cases, same_bits


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("codec", list(codecs.CODECS))
def test_every_codec_gives_back_every_bit(name, codec):
    v = np.ascontiguousarray(cases()[name])
    for part in (v, v[:1], v[: len(v) // 2 + 1]):
        data, bits = codecs.CODECS[codec].encode(part)
        assert same_bits(codecs.CODECS[codec].decode(data, len(part)), part)
        assert bits <= 8 * len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=64), min_size=1, max_size=300))
def test_codecs_on_any_doubles(values):
    v = np.array(values)
    for c in codecs.CODECS.values():
        assert same_bits(c.decode(c.encode(v)[0], len(v)), v)


@pytest.mark.parametrize("codec", ["xor", "erased", "decimal", "window", "look_back"])
def test_a_block_cut_short_is_rejected(codec):
    v = cases()["short decimals"]
    data, _ = codecs.CODECS[codec].encode(v)
    for n in range(len(data)):
        with pytest.raises((ValueError, IndexError)):
            codecs.CODECS[codec].decode(data[:n], len(v))


def test_windows_count_what_they_hold():
    w = encode_window(np.array([0.1, 0.2, 0.1, np.nan, -0.0]))
    assert (w["cnt"], w["n_zero"], w["n_raw"], w["n_esc"]) == (5, 1, 2, 2)
    assert w["bit_len"] == 2 * 5 + 2 * 64 + 2 * w["width"]
    assert encode_window(np.zeros(0))["cnt"] == 0
    with pytest.raises(ValueError):
        decode_window(5, w["scale"], w["width"], w["base"], w["payload"] + b"x")


def test_codec_names_in_any_case():
    assert codecs.codec("XoR").name == "xor"
    with pytest.raises(ValueError):
        codecs.codec("none")


def test_huffman_lengths_meet_kraft_and_beat_fixed_codes():
    n = {s: c for s, c in enumerate([50, 20, 10, 9, 5, 3, 2, 1])}
    length = codecs.huffman_lengths(n)
    assert sum(2.0**-k for k in length.values()) == 1.0
    assert sum(n[s] * length[s] for s in n) < 3 * sum(n.values())
    assert codecs.huffman_lengths({4: 9}) == {4: 1}


def test_bucket_plan_is_the_cheapest_of_all():
    from itertools import combinations

    h = [3, 0, 7, 1, 0, 9, 2, 4]

    def cost(edges):
        bits = max(0, (len(edges) - 1).bit_length())
        return sum(n * (bits + i - max(e for e in edges if e <= i)) for i, n in enumerate(h))

    best = min(cost([0, *c]) for k in range(4) for c in combinations(range(1, 8), k))
    assert cost(codecs.bucket_plan(h, 4)) == best


def test_reports(spark):
    v = cases()
    rows = [(k, i, float(x)) for k in ("triangle", "specials", "runs") for i, x in enumerate(v[k])]
    series = spark.createDataFrame(rows, "series_id string, pos long, value double")
    blocks = codecs.encode_blocks(series, ["xor", "decimal"], 100).cache()
    for r in codecs.verify(series, blocks, 100).collect():
        assert (r["status"], r["records"], r["mismatches"]) == ("PASS_RAW_BITS", len(v[r["series_id"]]), 0)
    report = codecs.size_report(blocks).where("block_id is null and series_id = 'runs'").collect()
    per = codecs.size_report(blocks).where("block_id is not null and series_id = 'runs'").collect()
    for r in report:
        mine = [p for p in per if p["codec"] == r["codec"]]
        assert r["blocks"] == len(mine) == -(-len(v["runs"]) // 100) and r["bytes"] == sum(p["bytes"] for p in mine)
        assert r["mean_block_ratio"] == pytest.approx(sum(p["weighted_ratio"] for p in mine) / len(mine))
    lost = codecs.verify(series, blocks.where("not (series_id = 'triangle' and block_id = 3)"), 100).where("series_id = 'triangle'").collect()
    assert all(r["status"] == "FAIL_ROUNDTRIP" and r["first_mismatch"] == 300 for r in lost)
