"""Numeric kernels on small arrays: what SQL can't say. Pure numpy, each bounded by one patch, tile or set of tie points."""

from __future__ import annotations

import numpy as np

# ---------------------------------------------------------------- Fourier


def phase_correlation(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response): how far b's content lies from a's. Hann-windowed, whitened cross spectrum; the peak's 5 x 5
    neighbourhood gives the place by its centre of mass and the response by its share of the whole."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    window = np.outer(np.hanning(h), np.hanning(w))
    fa, fb = (np.fft.fft2((x[:h, :w] - x[:h, :w].mean()) * window) for x in (a.astype(float), b.astype(float)))
    cross = fb * np.conj(fa)
    size = np.abs(cross)
    if not size.max() > 0:
        return 0.0, 0.0, 0.0
    surface = np.fft.ifft2(cross / np.maximum(size, 1e-12 * size.max())).real
    py, px = np.unravel_index(np.argmax(surface), surface.shape)
    near = np.arange(-2, 3)
    box = np.maximum(surface[np.ix_((py + near) % h, (px + near) % w)], 0)
    total = box.sum()
    dy, dx = py + (box.sum(1) @ near) / total, px + (box.sum(0) @ near) / total
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(np.clip(total, 0, 1))


def phase_congruency(image: np.ndarray, scales: int = 4, shortest: float = 6.0, factor: float = 2.1, spread: float = 0.55, noise: float = 2.0) -> np.ndarray:
    """Coherence of isotropic log-Gabor responses over scales, above a noise floor, between 0 and 1."""
    h, w = image.shape
    radius = np.hypot(*np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij"))
    radius[0, 0] = 1.0
    spectrum = np.fft.fft2(image.astype(float))
    total, energy, floor = np.zeros((h, w)), np.zeros((h, w)), 0.0
    for s in range(scales):
        gain = np.exp(-np.log(radius * shortest * factor**s) ** 2 / (2 * np.log(spread) ** 2))
        gain[0, 0] = 0.0
        response = np.fft.ifft2(spectrum * gain).real
        energy += response
        total += np.abs(response)
        floor += np.median(np.abs(response)) / scales
    return np.clip(np.maximum(np.abs(energy) - noise * floor, 0) / (total + 1e-9), 0, 1)


# ---------------------------------------------------------------- local contrast


def _folded(i: np.ndarray, n: int) -> np.ndarray:
    """Indices mirrored at the borders without repeating them."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def _convolved(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    n, half = image.shape[axis], len(kernel) // 2
    wide = np.moveaxis(np.take(image, _folded(np.arange(n + len(kernel) - 1) - half, n), axis), axis, 0)
    out = kernel[0] * wide[:n]
    for d, k in enumerate(kernel[1:], 1):
        out += k * wide[d : d + n]
    return np.moveaxis(out, 0, axis)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    x = np.arange(-int(np.ceil(4 * sigma)), int(np.ceil(4 * sigma)) + 1)
    k = np.exp(-(x**2) / (2 * sigma * sigma))
    return _convolved(_convolved(image.astype(float), k / k.sum(), 0), k / k.sum(), 1)


def unsharp(image: np.ndarray, sigma: float = 1.2, amount: float = 0.4) -> np.ndarray:
    return np.clip((1 + amount) * image - amount * gaussian(image, sigma), 0, 255).astype(np.uint8)


def gradient(image: np.ndarray) -> np.ndarray:
    """Sobel magnitude over its maximum, borders mirrored."""
    x = image.astype(float)
    gx = _convolved(_convolved(x, np.array([-1.0, 0, 1]), 1), np.array([1.0, 2, 1]), 0)
    gy = _convolved(_convolved(x, np.array([-1.0, 0, 1]), 0), np.array([1.0, 2, 1]), 1)
    m = np.hypot(gx, gy)
    return m / m.max() if m.max() > 0 else m


def clahe(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of bytes: an equalising table for each of grid x grid tiles, with what
    exceeds the clip limit spread over all levels, and tables blended between tile middles."""
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = image[np.ix_(_folded(np.arange(th * grid), h), _folded(np.arange(tw * grid), w))]
    tiles = padded.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, -1)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(float)
    limit = max(1.0, clip * th * tw / 256)
    over = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    tables = np.clip(np.cumsum(np.minimum(counts, limit) + over / 256, axis=1) * 255 / (th * tw), 0, 255).reshape(grid, grid, 256)

    def places(n: int, size: int):
        at = (np.arange(n) + 0.5) / size - 0.5
        lo = np.floor(at).astype(int)
        return np.clip(lo, 0, grid - 1), np.clip(lo + 1, 0, grid - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = places(h, th), places(w, tw)
    look = lambda ys, xs: tables[ys[:, None], xs[None, :], image]
    top = look(y0, x0) * (1 - fx) + look(y0, x1) * fx
    low = look(y1, x0) * (1 - fx) + look(y1, x1) * fx
    return np.rint(top * (1 - fy[:, None]) + low * fy[:, None]).astype(np.uint8)


def stretched(image: np.ndarray, low: float = 2, high: float = 98, least: int = 100) -> np.ndarray:
    ok = image[np.isfinite(image) & (image > 0)]
    if len(ok) < least:
        return np.clip(np.nan_to_num(image), 0, 255).astype(np.uint8)
    a, b = np.percentile(ok, [low, high])
    return (np.clip((image - a) / (b - a + 1e-6), 0, 1) * 255).astype(np.uint8)


def shadow_free(image: np.ndarray, share: float = 5.0, radius: int = 3) -> np.ndarray:
    """Pixels that are neither without data nor within a disc of dark ones."""
    ok = image > 0
    if ok.sum() < 100:
        return np.ones(image.shape, bool)
    dark = image <= np.percentile(image[ok], share)
    grown = np.zeros_like(dark)
    h, w = image.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                grown[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= dark[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return ok & ~grown


def structural(image: np.ndarray, method: str = "phase_congruency", equalise: bool = True) -> np.ndarray:
    """A map of structure that light and gain hardly change, 0 in shadows."""
    if method not in ("phase_congruency", "gradient", "hybrid"):
        raise ValueError(f"unknown structural method {method}")
    if (image > 0).sum() < 100:
        return np.zeros(image.shape)
    u8 = stretched(image.astype(float))
    u8 = clahe(u8, 3.0) if equalise else u8
    pc = phase_congruency(u8) if method != "gradient" else 0.0
    g = gradient(u8) if method != "phase_congruency" else 0.0
    out = pc if method == "phase_congruency" else g if method == "gradient" else 0.6 * pc + 0.4 * g
    return out * shadow_free(image)


# ---------------------------------------------------------------- alignment of patches


def bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float = np.nan) -> np.ndarray:
    h, w = image.shape
    ok = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    yc, xc = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(yc.astype(int), max(0, h - 2)), np.minimum(xc.astype(int), max(0, w - 2))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = yc - y0, xc - x0
    v = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.where(ok, v, outside)


def ecc_translation(template: np.ndarray, image: np.ndarray, rounds: int = 20, eps: float = 1e-3) -> tuple[float, float, float]:
    """(dx, dy, rho): the shift at which image(x + dx, y + dy) correlates best with template; forward-additive maximisation of
    the enhanced correlation coefficient (Evangelidis and Psarakis, 2008). rho is -1 where there is nothing to correlate."""
    t, im = template.astype(float), image.astype(float)
    h, w = t.shape
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    gy, gx = np.gradient(im)
    p, rho = np.zeros(2), -1.0
    for _ in range(rounds):
        warped = bilinear(im, yy + p[1], xx + p[0])
        ok = np.isfinite(warped)
        if ok.sum() < 64:
            return 0.0, 0.0, -1.0
        iw, tz = warped[ok] - warped[ok].mean(), t[ok] - t[ok].mean()
        ni, nt = np.linalg.norm(iw), np.linalg.norm(tz)
        if ni < 1e-9 or nt < 1e-9:
            return 0.0, 0.0, -1.0
        new = float(iw @ tz / (ni * nt))
        j = np.stack([np.nan_to_num(bilinear(g, yy + p[1], xx + p[0]))[ok] for g in (gx, gy)], 1)
        j = j - j.mean(0)
        hess = j.T @ j
        if abs(np.linalg.det(hess)) < 1e-12:
            return float(p[0]), float(p[1]), new
        pi, pt = np.linalg.solve(hess, j.T @ iw), np.linalg.solve(hess, j.T @ tz)
        num, den = ni * ni - (j.T @ iw) @ pi, tz @ iw - (j.T @ tz) @ pi
        if den > 0:
            lam = num / den
        else:
            lam = max(np.sqrt(max(num, 0) / max(tz @ tz - (j.T @ tz) @ pt, 1e-12)), ((j.T @ tz) @ pi - tz @ iw) / max((j.T @ tz) @ pt, 1e-12))
        p = p + np.linalg.solve(hess, j.T @ (lam * tz - iw))
        if abs(new - rho) < eps * 1e-3:
            rho = new
            break
        rho = new
    return float(p[0]), float(p[1]), rho


def refine(source: np.ndarray, reference: np.ndarray, threshold: float) -> tuple[float, float, float] | None:
    """Sub-pixel offset of two patches: by ECC, or by phase correlation if that finds none; None for flat patches."""
    flat = 0.01 if source.max() <= 2 else 1.0
    if source.std() < flat or reference.std() < flat:
        return None
    dx, dy, rho = ecc_translation(source, reference)
    if rho >= threshold:
        return dx, dy, rho
    dx, dy, response = phase_correlation(source, reference)
    return (dx, dy, response) if np.hypot(dx, dy) <= 3 and response >= threshold else None


def grid_matcher(a: np.ndarray, b: np.ndarray, patch: int = 64, step: int = 48, least: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points in a, points in b, confidence): the dense matcher's contract, met by phase correlation of patches around the
    images' common shift. Images under 16 px match nowhere."""
    none = np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)
    if min(*a.shape, *b.shape) < 16:
        return none
    gx, gy, _ = phase_correlation(a, b)
    gx, gy, out = round(gx), round(gy), []
    for y in range(0, a.shape[0] - patch + 1, step):
        for x in range(0, a.shape[1] - patch + 1, step):
            if 0 <= y + gy <= b.shape[0] - patch and 0 <= x + gx <= b.shape[1] - patch:
                p, q = a[y : y + patch, x : x + patch], b[y + gy : y + gy + patch, x + gx : x + gx + patch]
                if p.std() > 0 and q.std() > 0:
                    dx, dy, c = phase_correlation(p, q)
                    if c >= least and np.hypot(dx, dy) <= patch / 4:
                        out.append((x + patch / 2, y + patch / 2, x + gx + dx + patch / 2, y + gy + dy + patch / 2, c))
    if not out:
        return none
    m = np.array(out)
    return m[:, :2], m[:, 2:4], m[:, 4]


def circles(image: np.ndarray, smallest: int = 15, largest: int = 200, least_votes: int = 25, step: int = 2) -> np.ndarray:
    """(cx, cy, r) rows: circles by gradient voting. Edge pixels vote for centres along their gradient, for each radius; of the
    accumulator's local maxima those with votes enough stay, strongest first, apart by twice the smallest radius."""
    x = image.astype(float)
    gy, gx = np.gradient(gaussian(x, 1.2))
    m = np.hypot(gx, gy)
    if not m.max() > 0:
        return np.zeros((0, 3))
    ys, xs = np.nonzero(m > 0.3 * m.max())
    ux, uy = gx[ys, xs] / m[ys, xs], gy[ys, xs] / m[ys, xs]
    h, w = image.shape
    found = []
    for r in range(smallest, largest + 1, step):
        acc = np.zeros((h, w))
        for sign in (-1, 1):
            cx, cy = np.rint(xs + sign * r * ux).astype(int), np.rint(ys + sign * r * uy).astype(int)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            acc += np.bincount(cy[ok] * w + cx[ok], minlength=h * w).reshape(h, w)
        acc = gaussian(acc, 1.0) * 2 * np.pi
        while True:
            k = int(np.argmax(acc))
            cy, cx = divmod(k, w)
            if acc[cy, cx] < max(least_votes, 1):  # without a vote there is no centre
                break
            found.append((acc[cy, cx] / r, cx, cy, r))
            acc[max(0, cy - r) : cy + r + 1, max(0, cx - r) : cx + r + 1] = 0
    kept: list[tuple] = []
    for _, cx, cy, r in sorted(found, reverse=True):
        if all(np.hypot(cx - a, cy - b) >= 2 * smallest for a, b, _ in kept):
            kept.append((cx, cy, r))
    return np.array(kept, float).reshape(-1, 3)


# ---------------------------------------------------------------- point sets


def hull_ring(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners in order (monotone chain); of under three points, the points."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def hull_area(points: np.ndarray) -> float:
    ring = hull_ring(points)
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def hull_share(points: np.ndarray, area: float) -> float:
    return float(np.clip(hull_area(points) / area, 0, 1)) if area > 0 and len(points) >= 3 else 0.0


def fit_affine(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The 2 x 3 least-squares affine."""
    return np.linalg.lstsq(np.column_stack([s, np.ones(len(s))]), r, rcond=None)[0].T


def fit_similarity(s: np.ndarray, r: np.ndarray, scaled: bool = True) -> np.ndarray:
    """The 2 x 3 least-squares similarity, or rigid motion if not scaled."""
    ms, mr = s.mean(0), r.mean(0)
    a, b = (s - ms) @ np.array([1, 1j]), (r - mr) @ np.array([1, 1j])
    n = (np.conj(a) @ a).real
    z = np.conj(a) @ b / n if n > 0 else 1.0
    z = z if scaled else z / abs(z) if abs(z) > 0 else 1.0
    m = np.array([[z.real, -z.imag], [z.imag, z.real]])
    return np.column_stack([m, mr - m @ ms])


def applied(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:, :2].T + m[:, 2]


def ransac(s: np.ndarray, r: np.ndarray, threshold: float, affine: bool = True, rounds: int = 2000, confidence: float = 0.999, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """(model, inlier mask): seeded hypotheses from minimal samples, scored all against all points in blocks; the best one is
    fitted again to its inliers."""
    n, k = len(s), 3 if affine else 2
    if n < k:
        return None, np.zeros(n, bool)
    rng, best, need, done = np.random.default_rng(seed), np.zeros(n, bool), rounds, 0
    fit = fit_affine if affine else fit_similarity
    while done < need:
        pick = rng.choice(n, k, replace=False)
        done += 1
        if affine and abs(np.linalg.det(np.column_stack([s[pick], np.ones(3)]))) < 1e-9:
            continue
        ok = np.hypot(*(applied(fit(s[pick], r[pick]), s) - r).T) <= threshold
        if ok.sum() > best.sum():
            best = ok
            share = np.clip(ok.mean() ** k, 1e-9, 1 - 1e-9)
            need = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(1 - share))))
    if best.sum() < k:
        return None, best
    model = fit(s[best], r[best])
    for _ in range(3):
        ok = np.hypot(*(applied(model, s) - r).T) <= threshold
        if ok.sum() < k or (ok == best).all():
            break
        best, model = ok, fit(s[ok], r[ok])
    return model, best


class ThinPlate:
    """A smoothing thin-plate spline of two values over the plane; places are centred and scaled first."""

    def __init__(self, points: np.ndarray, values: np.ndarray, smoothing: float = 0.0):
        self.centre, self.scale = points.mean(0), max(1.0, float(points.std(0).max()))
        self.nodes = (points - self.centre) / self.scale
        n, p = len(points), np.column_stack([np.ones(len(points)), self.nodes])
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = self._kernel(self.nodes) + smoothing * np.eye(n)
        system[:n, n:], system[n:, :n] = p, p.T
        self.weights = np.linalg.lstsq(system, np.vstack([values, np.zeros((3, values.shape[1]))]), rcond=None)[0]

    def _kernel(self, q: np.ndarray) -> np.ndarray:
        d2 = ((q[:, None, :] - self.nodes[None, :, :]) ** 2).sum(2)
        return 0.5 * d2 * np.log(np.maximum(d2, 1e-300))

    def __call__(self, points: np.ndarray) -> np.ndarray:
        q = (points - self.centre) / self.scale
        out = np.empty((len(q), self.weights.shape[1]))
        for k in range(0, len(q), 4096):
            b = q[k : k + 4096]
            out[k : k + 4096] = self._kernel(b) @ self.weights[:-3] + np.column_stack([np.ones(len(b)), b]) @ self.weights[-3:]
        return out


def tps_smoothing(smoothing: float, n: int) -> float:
    """Less for more points."""
    return float(np.clip(min(smoothing, 0.01) * 50.0 / max(30.0, n), 0.002, 0.05))


def folds(n: int, seed: int = 42) -> np.ndarray:
    """Each point's fold: five of a seeded permutation over 40 points, else one for each point."""
    k = min(5, n) if n > 40 else n
    out = np.zeros(n, int)
    for f, part in enumerate(np.array_split(np.random.RandomState(seed).permutation(n), k)):
        out[part] = f
    return out


# ---------------------------------------------------------------- splines


def spline_coefficients(image: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients by the recursive filter, mirrored borders."""
    z, c = np.sqrt(3.0) - 2.0, image.astype(float)
    for axis in (0, 1):
        c = np.moveaxis(c, axis, 0).copy()
        n = len(c)
        if n > 1:
            c *= 6.0
            reach = min(n, 40)
            powers = z ** np.arange(reach)
            c[0] = np.tensordot(powers, c[:reach], 1) if reach < n else (np.tensordot(powers, c, 1) + np.tensordot(z ** (2 * n - 2 - np.arange(1, n - 1)), c[1:-1], 1)) / (1 - z ** (2 * n - 2))
            for k in range(1, n):
                c[k] += z * c[k - 1]
            c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
            for k in range(n - 2, -1, -1):
                c[k] = z * (c[k + 1] - c[k])
        c = np.moveaxis(c, 0, axis)
    return c


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, order: int = 3, outside: float = 0.0) -> np.ndarray:
    """Values at places between pixels: nearest (0), bilinear (1) or cubic spline (3 and more); outside the image a constant."""
    h, w = image.shape
    ok = (y >= -0.5) & (y <= h - 0.5) & (x >= -0.5) & (x <= w - 0.5)
    if order == 0:
        v = image[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)].astype(float)
    elif order <= 2:
        v = bilinear(image.astype(float), np.clip(y, 0, h - 1), np.clip(x, 0, w - 1))
    else:
        c = spline_coefficients(image)
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)

        def basis(t: np.ndarray) -> list[np.ndarray]:
            return [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]

        by, bx = basis(y - y0), basis(x - x0)
        v = sum(by[i] * bx[j] * c[_folded(y0 - 1 + i, h), _folded(x0 - 1 + j, w)] for i in range(4) for j in range(4))
    return np.where(ok, v, outside)


def lanczos(image: np.ndarray, y: np.ndarray, x: np.ndarray, stretch: float = 1.0, lobes: int = 3, outside: float = 0.0) -> np.ndarray:
    """Values at places between pixels by the windowed sinc of lobes lobes, as wide as stretch pixels each, borders mirrored; weights add up
    to 1. A stretch of the ratio of pixel sizes keeps what a coarser grid can't hold out of it."""
    h, w = image.shape
    ok = (y >= -0.5) & (y <= h - 0.5) & (x >= -0.5) & (x <= w - 0.5)
    reach = int(np.ceil(lobes * stretch))

    def weights(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.floor(at).astype(int)
        d = np.stack([first + k - at for k in range(1 - reach, reach + 1)]) / stretch
        v = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
        return first, v / v.sum(0)

    (y0, wy), (x0, wx) = weights(y), weights(x)
    a, v = image.astype(float), np.zeros(y.shape)
    for i in range(2 * reach):
        rows = _folded(y0 + i + 1 - reach, h)
        v += wy[i] * sum(wx[j] * a[rows, _folded(x0 + j + 1 - reach, w)] for j in range(2 * reach))
    return np.where(ok, v, outside)


def cast_pixels(v: np.ndarray, dtype: str) -> np.ndarray:
    """Bytes are rounded and clipped, other whole numbers truncated."""
    kind = np.dtype(dtype)
    if kind == np.uint8:
        return np.clip(np.rint(v), 0, 255).astype(kind)
    return v.astype(kind)


def subgrid(n: int, step: int = 8) -> np.ndarray:
    """Places 0, step, 2 step, ..., with the last one."""
    return np.unique(np.append(np.arange(0, n, step), n - 1))


def on_subgrid(f, rows: np.ndarray, cols: np.ndarray, step: int = 8) -> np.ndarray:
    """f(points (x, y)) on every place of a block, found on a coarse grid and interpolated between."""
    gy, gx = subgrid(len(rows), step), subgrid(len(cols), step)
    yy, xx = np.meshgrid(rows[gy], cols[gx], indexing="ij")
    coarse = f(np.column_stack([xx.ravel(), yy.ravel()])).reshape(len(gy), len(gx), -1)
    fy, fx = np.interp(np.arange(len(rows)), gy, np.arange(len(gy))), np.interp(np.arange(len(cols)), gx, np.arange(len(gx)))
    at = np.meshgrid(fy, fx, indexing="ij")
    return np.stack([bilinear(coarse[:, :, k], *at) for k in range(coarse.shape[2])], -1)
