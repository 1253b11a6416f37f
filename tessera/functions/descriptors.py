"""A dense matcher without trained weights: grid descriptors, dual-softmax confidence over mutual nearest neighbours, refinement by
correlation. It meets the matcher's contract, (image, image) to (points, points, confidence), for rotations of some degrees and
changes of scale of some per cent, which correlation of whole patches misses."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tessera.functions.kernels import _folded, gaussian

#: Pixels of a cell of the grid, to multiples of which images are resized, and the least and largest side of what is matched.
CELL, SMALLEST, LARGEST = 8, 16, 768
ORIENTATIONS = 8
#: Rings of places around a grid point whose histograms it has, as (radius, places, deviation of the smoothing).
RINGS = ((0.0, 1, 2.5), (5.0, 8, 2.5), (11.0, 8, 4.0))
#: How sharp the softmax over similarities is.
TEMPERATURE = 0.02

Matches = tuple[np.ndarray, np.ndarray, np.ndarray]


def area_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Averages over the area that each new pixel covers."""

    def weights(n: int, m: int) -> np.ndarray:
        ends = np.arange(m + 1) * n / m
        k = np.arange(n)
        return np.clip(np.minimum(ends[1:, None], k + 1) - np.maximum(ends[:-1, None], k), 0, None) * m / n

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def working_size(h: int, w: int, largest: int = LARGEST) -> tuple[int, int]:
    """Sides of at most largest, multiples of CELL, not under SMALLEST."""
    scale = min(1.0, largest / max(h, w))
    return tuple(max(SMALLEST, round(n * scale / CELL) * CELL) for n in (h, w))


def _blur(n: int, sigma: float) -> np.ndarray:
    """The matrix of Gaussian smoothing along a side of n, borders mirrored."""
    x = np.arange(-int(np.ceil(4 * sigma)), int(np.ceil(4 * sigma)) + 1)
    k = np.exp(-(x**2) / (2 * sigma * sigma))
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(x)), _folded((np.arange(n)[:, None] + x).ravel(), n)), np.tile(k / k.sum(), n))
    return out


@lru_cache(maxsize=8)
def _smoothed_at(n: int, step: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(places, matrices, pairs): the places of a grid along a side of n; matrices that give, of values along that side, the smoothed
    ones at the places and a ring's offset from them; and for each place of RINGS its matrices across and along."""
    places = np.arange(step / 2 - 0.5, n, step)
    known, matrices, pairs = {}, [], []

    def matrix(offset: float, sigma: float) -> int:
        key = round(offset, 9), sigma  # sines of places opposite each other differ in their last digit
        if key not in known:
            at = np.clip(places + offset, 0, n - 1)
            low = np.minimum(at.astype(int), max(0, n - 2))
            part, smooth = (at - low)[:, None], _blur(n, sigma)
            known[key] = len(matrices)
            matrices.append(smooth[low] * (1 - part) + smooth[np.minimum(low + 1, n - 1)] * part)
        return known[key]

    for radius, count, sigma in RINGS:
        for k in range(count):
            turn = 2 * np.pi * k / count
            pairs.append((matrix(radius * np.sin(turn), sigma), matrix(radius * np.cos(turn), sigma)))
    return places, np.stack(matrices), pairs


def descriptors(image: np.ndarray, step: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """(places (n, 2), rows of length 1) on a grid: histograms of gradient directions, smoothed, at rings of places around each point. Flat
    points have none."""
    gy, gx = np.gradient(gaussian(image, 1.0))
    size = np.hypot(gx, gy)
    h, w = image.shape
    turn = 2 * np.pi * np.arange(ORIENTATIONS)[:, None] / ORIENTATIONS
    # Rows, orientations, columns: the cosine to each orientation, cubed, times the gradient.
    along = np.maximum(gx[:, None] * np.cos(turn) + gy[:, None] * np.sin(turn), 0)
    maps = (along * along * along / np.where(size > 0, size * size, 1.0)[:, None]).reshape(h, -1)
    (y, down, pairs), (x, across, _) = _smoothed_at(h, step), _smoothed_at(w, step)
    parts = np.empty((len(y), len(x), len(pairs), ORIENTATIONS))
    for own in {i for i, _ in pairs}:
        rows = (down[own] @ maps).reshape(-1, w)
        for k, (i, j) in enumerate(pairs):
            if i == own:
                parts[:, :, k] = (rows @ across[j].T).reshape(len(y), ORIENTATIONS, len(x)).swapaxes(1, 2)
    parts /= np.sqrt(np.einsum("yxko,yxko->yxk", parts, parts))[..., None] + 1e-3 * size.max() + 1e-12
    rows = parts.reshape(len(y) * len(x), -1)
    rows -= rows.mean(1, keepdims=True)
    norm = np.sqrt(np.einsum("nk,nk->n", rows, rows))
    ok = norm > 1e-6
    rows /= np.where(ok, norm, 1.0)[:, None]
    places = np.stack([np.tile(x, len(y)), np.repeat(y, len(x))], 1)
    return (places, rows.astype(np.float32)) if ok.all() else (places[ok], rows[ok].astype(np.float32))


def mutual(a: np.ndarray, b: np.ndarray, temperature: float = TEMPERATURE, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, confidence) of rows that are each other's nearest; confidence is the product of the softmax over both sides. Similarities
    are made in blocks of rows, twice, and never held whole."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    best, high = np.zeros(len(a), int), np.zeros(len(a))
    row_sum, column_sum, column_high, column_best = np.zeros(len(a)), np.zeros(len(b)), np.full(len(b), -np.inf), np.zeros(len(b), int)
    for k in range(0, len(a), block):
        s = a[k : k + block] @ b.T
        best[k : k + block], high[k : k + block] = s.argmax(1), s.max(1)
        e = np.exp((s - 1.0) / temperature, dtype=np.float64)
        row_sum[k : k + block] = e.sum(1)
        column_sum += e.sum(0)
        top, at = s.max(0), s.argmax(0) + k
        column_best = np.where(top > column_high, at, column_best)
        column_high = np.maximum(column_high, top)
    i = np.flatnonzero(column_best[best] == np.arange(len(a)))
    p = np.exp((high[i] - 1.0) / temperature)
    return i, best[i], np.minimum(p * p / np.maximum(row_sum[i] * column_sum[best[i]], 1e-300), 1.0)


def _patches(image: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
    """Patches of 2 wide + 1 around places, between pixels bilinear, 0 outside the image."""
    h, w = image.shape
    low, d = np.floor(at).astype(int), np.arange(-wide, wide + 2)
    fx, fy = (at - low)[:, 0, None, None], (at - low)[:, 1, None, None]
    v = image.ravel().take(np.clip(low[:, 1, None, None] + d[:, None], 0, h - 1) * w + np.clip(low[:, 0, None, None] + d, 0, w - 1))
    v = v[:, :, :-1] * (1 - fx) + v[:, :, 1:] * fx
    v = v[:, :-1] * (1 - fy) + v[:, 1:] * fy
    x, y = at[:, 0, None] + d[:-1], at[:, 1, None] + d[:-1]
    v *= ((y >= 0) & (y <= h - 1))[:, :, None]
    v *= ((x >= 0) & (x <= w - 1))[:, None, :]
    return v


def _centred(v: np.ndarray) -> np.ndarray:
    v = v.reshape(len(v), -1) - v.mean((1, 2))[:, None]
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
    return v


def _correlations(own: np.ndarray, around: np.ndarray, width: int) -> np.ndarray:
    """Correlations of patches of width, centred, with all patches of around: by transforms and sums of boxes, or, where some patch of
    around is so flat that those lose digits, patch by patch."""
    n, wide = len(own), around.shape[1]
    side, size = wide - width + 1, 1 << (wide - 1).bit_length()
    c = around - around.mean((1, 2), keepdims=True)
    both = np.fft.rfft2(c, (size, size)) * np.fft.rfft2(own.reshape(n, width, width), (size, size)).conj()
    after = np.arange(wide) - np.arange(side)[:, None]
    band = ((after >= 0) & (after < width)).astype(float)
    boxes = lambda v: band @ (v.reshape(-1, wide) @ band.T).reshape(n, wide, side)
    square = c * c
    least = 1e-9 * square.sum((1, 2))[:, None, None]
    square = boxes(square) - boxes(c) ** 2 / width**2
    sure = (square > least).all((1, 2))
    score = np.fft.irfft2(both, (size, size))[:, :side, :side] / np.sqrt(np.where(sure[:, None, None], square, 1.0))
    if not sure.all():
        for i in range(side):
            for j in range(side):
                score[~sure, i, j] = (own[~sure] * _centred(around[~sure, i : i + width, j : j + width])).sum(1)
    return score


def refined(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, half: int = 8, reach: int = 6, block: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(q, correlation): q moved to where b's patch correlates best with a's patch at p, by up to reach on both axes, with the parabola
    of the best place's neighbours. A best place at the rim of the search has a correlation of -1. Points are looked at in blocks."""
    if len(p) > block:
        parts = [refined(a, b, p[k : k + block], q[k : k + block], half, reach, block) for k in range(0, len(p), block)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    own, around, side, width = _centred(_patches(a, p, half)), _patches(b, q, half + reach), 2 * reach + 1, 2 * half + 1
    best = _correlations(own, around, width).reshape(len(p), -1).argmax(1)
    i, j, n = best // side, best % side, np.arange(len(p))
    inside = (i > 0) & (i < side - 1) & (j > 0) & (j < side - 1)
    i, j = np.clip(i, 1, side - 2), np.clip(j, 1, side - 2)
    near = np.lib.stride_tricks.sliding_window_view(around, (width + 2, width + 2), (1, 2))[n, i - 1, j - 1]
    score = lambda di, dj: (own * _centred(near[:, 1 + di : 1 + di + width, 1 + dj : 1 + dj + width])).sum(1)

    def vertex(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = low - 2 * mid + high
        return np.clip(np.where(bend < 0, 0.5 * (low - high) / np.where(bend < 0, bend, -1.0), 0.0), -0.5, 0.5)

    top = score(0, 0)
    x = j - reach + vertex(score(0, -1), top, score(0, 1))
    y = i - reach + vertex(score(-1, 0), top, score(1, 0))
    return q + np.stack([x, y], 1), np.where(inside, top, -1.0)


def dense_matcher(image0: np.ndarray, image1: np.ndarray, largest: int = LARGEST, threshold: float = 0.05, least: float = 0.6) -> Matches:
    """Coarse matches of grid descriptors with a confidence of threshold and more, refined to fractions of a pixel where the patches
    correlate by least and more; places in the given images' pixels. Images under 16 pixels match nowhere."""
    none = np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)
    if min(*image0.shape, *image1.shape) < SMALLEST:
        return none
    small, scale = [], []
    for image in (image0, image1):
        h, w = working_size(*image.shape, largest)
        a = np.nan_to_num(image.astype(float))
        small.append(a if (h, w) == image.shape else area_resized(a, h, w))
        scale.append(np.array([image.shape[1] / w, image.shape[0] / h]))
    (p, a), (q, b) = descriptors(small[0]), descriptors(small[1], CELL // 2)
    i, j, confidence = mutual(a, b)
    some = confidence >= threshold
    if not some.any():
        return none
    p, confidence = p[i[some]], confidence[some]
    q, correlation = refined(*small, p, q[j[some]])
    ok = correlation >= least
    back = lambda x, s: (x[ok] + 0.5) * s - 0.5
    return back(p, scale[0]), back(q, scale[1]), confidence[ok]
