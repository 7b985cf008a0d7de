"""Value series that the tests share: specials, repeats, many digits, fuzz."""

import numpy as np

SPECIAL_BITS = np.array(
    [0x0, 0x8000000000000000, 0x7FF0000000000000, 0xFFF0000000000000, 0x7FF8000000000000, 0x7FF8000000001234, 0x7FF0000000000001, 0x1, 0x8000000000000001, 0x10000000000000, 0x10000000000001, 0x7FEFFFFFFFFFFFFF, 0xFFEFFFFFFFFFFFFF, 0x3FB999999999999A],
    np.uint64,
)


def cases() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(20_311)
    i = np.arange(3000)
    return {
        "basic": np.array([3.5, 3.5, -0.75, 0.062, 47.9, 47.9, 0.0, -12.25, 1e6, 0.3]),
        "many digits": np.concatenate([rng.random(9), 1e-17 * rng.random(3), 1 + np.arange(4) * 2.0**-52]),
        "specials": SPECIAL_BITS.view(np.float64),
        "short decimals": np.array([0.07, 19.99, -19.99, 4.35, 1.005, 8.875, 2.3e-7, 512.03]),
        "triangle": np.abs((i % 146) - 73) / 20,
        "mixed": np.where(i % 61 == 7, 3e-18, (i * 37 % 811) / 50),
        "infinite": np.full(500, -np.inf),
        "runs": np.repeat(rng.integers(-900, 900, 60) / 8, rng.integers(1, 90, 60)),
        "random bits": rng.integers(0, 2**64, 2500, dtype=np.uint64).view(np.float64),
        "decimals": rng.integers(-(10**7), 10**7, 2500) * 10.0 ** -rng.integers(0, 16, 2500),
        "powers": np.ldexp(1.0, np.arange(-1074, 1024)),
        "one": np.array([-6.5]),
        "walk": np.cumsum(rng.normal(size=1500)),
    }


def same_bits(a: np.ndarray, b: np.ndarray) -> bool:
    return len(a) == len(b) and bool((np.ascontiguousarray(a).view(np.int64) == np.ascontiguousarray(b).view(np.int64)).all())
