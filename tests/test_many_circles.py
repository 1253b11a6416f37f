from __future__ import annotations

import numpy as np

from tessera.functions import kernels as K


def scene(side, centres, r):
    y, x = np.mgrid[:side, :side]
    return 200.0 * np.any([np.hypot(x - a, y - b) <= r for a, b in centres], 0)


def test_more_than_eight_equal_circles():
    centres = [(60 + 110 * i, 60 + 110 * j) for i in range(4) for j in range(3)]
    got = K.circles(scene(460, centres, 20), smallest=20, largest=20)
    assert len(got) == 12 and all(np.hypot(*(got[:, :2] - c).T).min() < 3 for c in centres)


def test_circle_over_sixty_pixels():
    got = K.circles(scene(360, [(180, 180)], 121))
    assert np.hypot(*(got[0, :2] - 180)) < 3 and abs(got[0, 2] - 121) < 5
