"""The dense matcher's work: all shifts of all patches together, points in blocks, and the same correlations as shift by shift."""

from __future__ import annotations

import sys
import tracemalloc

import numpy as np

from tessera.functions import descriptors as D
from tessera.functions import kernels as K


def texture(seed, h, w):
    return K.gaussian(np.random.default_rng(seed).normal(size=(h, w)), 1.5) * 100 + 300


def by_shift(a, b, p, q, half=8, reach=6):
    """(best shift's row and column, correlation) of each point, shift by shift, by K.bilinear and numpy's correlation."""
    d, wide = np.arange(-half, half + 1), np.arange(-half - reach, half + reach + 1)
    out = []
    for (px, py), (qx, qy) in zip(p, q, strict=True):
        own = K.bilinear(a, py + d[:, None] + 0 * d, px + d + 0 * d[:, None], 0.0)
        around = K.bilinear(b, qy + wide[:, None] + 0 * wide, qx + wide + 0 * wide[:, None], 0.0)
        score = np.zeros((2 * reach + 1,) * 2)
        for i in range(2 * reach + 1):
            for j in range(2 * reach + 1):
                u, v = own - own.mean(), around[i : i + len(d), j : j + len(d)]
                v = v - v.mean()
                score[i, j] = (u * v).sum() / ((np.linalg.norm(u) + 1e-12) * (np.linalg.norm(v) + 1e-12))
        i, j = np.unravel_index(score.argmax(), score.shape)
        out.append((i, j, score[i, j] if 0 < i < 2 * reach and 0 < j < 2 * reach else -1.0))
    return np.array(out)


def test_refined_is_the_best_of_all_shifts():
    """Also over borders, and where part of the search is flat or nearly so beside something bright."""
    whole = texture(1, 90, 110)
    a, b = whole[:80, :100], whole[3:83, 4:104].copy()
    b[50:, 60:] = 0.0
    b[:30, :30] = 1e-7 * whole[:30, :30] + 5000.0
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.integers(0, 100, 150), rng.integers(0, 80, 150)]) + rng.choice([0.0, 0.5], (150, 2))
    p = np.minimum(p, [99, 79])
    q = np.clip(p - [4, 3] + rng.integers(-3, 4, (150, 2)), 0, [99, 79])
    want = by_shift(a, b, p, q)
    got, correlation = D.refined(a, b, p, q)
    sure = want[:, 2] > 0.6
    assert sure.sum() > 60
    np.testing.assert_allclose(correlation[sure], want[sure, 2], atol=1e-9)
    assert (np.abs(got[sure] - q[sure] - (want[sure, 1::-1] - 6)) <= 0.5).all()
    assert (correlation[~sure] < 0.6 + 1e-9).all()


def test_work_of_a_pair():
    """Shift by shift, ring place by ring place and map by map, a pair took over 11,000 calls."""
    a = texture(3, 104, 104)
    pair = a[:96, :96], a[3:99, 5:101]
    D.dense_matcher(*pair)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        p, q, _ = D.dense_matcher(*pair)
    finally:
        sys.setprofile(None)
    assert len(p) > 60 and np.abs(np.median(p - q, 0) - [5, 3]).max() < 0.1
    assert calls < 4000


def test_memory_of_many_points():
    image = texture(4, 300, 300)
    y, x = (g.ravel() + 3.5 for g in np.meshgrid(np.arange(0, 290, 4), np.arange(0, 290, 4)))
    at = np.column_stack([x, y])
    tracemalloc.start()
    got, _ = D.refined(image, image, at, at)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(at) > 5000 and np.median(np.abs(got - at)) < 0.1
    assert most < 32 << 20
