"""Near hashes of any width: the bands cover the bits that are used, and no pair is missed."""

from math import comb

import numpy as np
import pytest

from tandem.operators import dupes


@pytest.mark.parametrize("width", (1, 12, 40, 63, 64))
def test_bands_cover_the_used_bits(width):
    cuts, r = dupes.bands(width, 8)
    assert [s for s, _ in cuts] == [sum(n for _, n in cuts[:i]) for i in range(len(cuts))] and sum(n for _, n in cuts) == width
    assert (r + 1) * len(cuts) > 8
    if width >= 40:
        # a band without used bits would bring all pairs together
        assert sum(sum(comb(n, k) for k in range(r + 1)) / 2**n for _, n in cuts) < 0.05


@pytest.mark.parametrize("width", (12, 40, 64))
@pytest.mark.parametrize("room", (1, 1 << 22))
def test_near_equals_brute_force(width, room):
    rng = np.random.default_rng(width)
    p = rng.integers(0, 1 << width, 300, np.uint64, False) if width < 64 else rng.integers(0, 2**64 - 1, 300, np.uint64, True)
    flips = np.array([sum(1 << int(b) for b in rng.choice(width, rng.integers(0, 12), False)) for _ in p], np.uint64)
    q = np.concatenate([p ^ flips, p[:50]])
    want = sorted(zip(*map(list, np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= 8))))
    assert sorted((x, y) for a, b in dupes._near(p, q, width, 8, room) for x, y in zip(a, b)) == want and want


def test_short_hashes_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 1 << 40, 2500, np.uint64, False)
    v[1:2500:5] = v[0:2500:5] ^ np.uint64(0b10110001)
    df = spark.createDataFrame([(i + 1, f"{int(x):010x}") for i, x in enumerate(v)], "id long, dhash string")
    got = sorted(tuple(r) for r in dupes.hamming_pairs(dupes.hash_classes(df)[0], 8, block=700).collect())
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    assert got == sorted((int(a) + 1, int(b) + 1, int(d[a, b])) for a, b in zip(*np.nonzero(np.triu(d <= 8, 1)))) and len(got) >= 500
