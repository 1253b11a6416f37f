"""The dense matcher on planted rotations and scales."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import descriptors as D
from tessera.functions import kernels as K


def turned(seed: int, n: int, degrees: float, scale: float, shift=(3.0, -2.0)):
    """(image, image, map): a texture and itself turned and scaled around its middle."""
    rng = np.random.default_rng(seed)
    a = sum(K.gaussian(rng.normal(size=(n, n)), s) * s for s in (1.5, 3, 6)) * 100 + 500
    t, c = np.deg2rad(degrees), (n - 1) / 2
    m = scale * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    yy, xx = np.mgrid[0:n, 0:n].astype(float)
    at = np.stack([xx - c - shift[0], yy - c - shift[1]], -1) @ np.linalg.inv(m).T + c
    return a, K.sample(a, at[..., 1], at[..., 0], 3), lambda p: (p - c) @ m.T + c + shift


@pytest.mark.parametrize("degrees,scale", [(3, 1.05), (-5, 0.95), (0, 1.0)])
def test_rotation_and_scale(degrees, scale):
    a, b, where = turned(1, 200, degrees, scale)
    p, q, c = D.dense_matcher(a, b)
    error = np.hypot(*(where(p) - q).T)
    assert len(p) > 150 and np.median(error) < 0.5 and (error < 1).mean() > 0.8 and ((c >= 0.05) & (c <= 1)).all()
    model, ok = K.ransac(p, q, 1.0)
    assert ok.mean() > 0.8 and abs(np.hypot(model[0, 0], model[1, 0]) - scale) < 0.005


def test_sizes():
    assert D.working_size(768, 768) == (768, 768) and D.working_size(1600, 800) == (768, 384) and D.working_size(101, 20) == (104, 16)
    a = np.arange(35.0).reshape(5, 7)
    assert np.allclose(D.area_resized(a, 5, 7), a) and np.allclose(D.area_resized(a, 1, 1), a.mean())
    big = K.gaussian(np.random.default_rng(0).normal(size=(120, 120)), 4)
    p, q, _ = D.dense_matcher(big, big, largest=64)  # places are of the given pixels
    assert len(p) and np.abs(p - q).max() < 1 and p.max() > 64


def test_odd_images():
    for a, b in ((np.zeros((15, 40)), np.zeros((40, 40))), (np.zeros((40, 40)), np.zeros((40, 40))), (np.full((40, 40), np.nan), np.eye(40))):
        assert [len(x) for x in D.dense_matcher(a, b)] == [0, 0, 0]


def test_mutual_in_blocks():
    rng = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 8)), rng.normal(size=(70, 8))))
    s = a @ b.T
    e = np.exp(s / 0.1)
    p = e / e.sum(1, keepdims=True) * e / e.sum(0)
    want = {(i, int(s[i].argmax())): p[i, s[i].argmax()] for i in range(50) if s[:, s[i].argmax()].argmax() == i}
    i, j, c = D.mutual(a, b, 0.1, block=7)
    assert dict(zip(zip(i.tolist(), j.tolist()), c)) == pytest.approx(want)
