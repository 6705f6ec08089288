"""Raster kernels on numpy arrays: the part of page analysis that isn't relational. Images are H x W x 3 (BGR) or H x W, bytes."""

from __future__ import annotations

import numpy as np

from vellumetry.operators.model import SPLIT, Split


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(np.float64)
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r)


def _padded(a: np.ndarray, k: int, axis: int, mode: str = "edge", **kw) -> np.ndarray:
    pad = [(0, 0)] * a.ndim
    pad[axis] = (k // 2, k - 1 - k // 2)
    return np.pad(a, pad, mode=mode, **kw)


def _sliding(a: np.ndarray, k: int, axis: int, reduce, mode: str = "edge", **kw) -> np.ndarray:
    if k <= 1:
        return a
    return reduce(np.lib.stride_tricks.sliding_window_view(_padded(a, k, axis, mode, **kw), k, axis=axis), axis=-1)


def erode(a: np.ndarray, kw: int, kh: int) -> np.ndarray:
    high = a.max(initial=0)
    return _sliding(_sliding(a, kw, 1, np.min, "constant", constant_values=high), kh, 0, np.min, "constant", constant_values=high)


def dilate(a: np.ndarray, kw: int, kh: int) -> np.ndarray:
    return _sliding(_sliding(a, kw, 1, np.max, "constant", constant_values=0), kh, 0, np.max, "constant", constant_values=0)


def blur(a: np.ndarray, block: int) -> np.ndarray:
    """Gaussian, separable, with the deviation that goes with the block's size."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    x = np.arange(block) - (block - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        p = _padded(a, block, axis, "reflect" if n > block else "edge")
        a = sum(w * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, w in enumerate(k))
    return a


def box_mean(a: np.ndarray, k: int) -> np.ndarray:
    """The mean of the k x k pixels around each, by running sums."""
    for axis in (0, 1):
        c = np.cumsum(np.insert(_padded(a, k, axis), 0, 0, axis=axis), axis=axis)
        a = (c[k:] - c[:-k] if axis == 0 else c[:, k:] - c[:, :-k]) / k
    return a


def smooth(profile: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(profile, np.ones(k) / k, mode="same")


def column_brightness(image: np.ndarray) -> np.ndarray:
    return grey(image).mean(axis=0)


def spine(profile: np.ndarray, p: Split = SPLIT) -> tuple[int, str]:
    """(place, detected or centre) of the spine in a brightness profile; the same as operators.split.spines."""
    n = len(profile)
    if not n:
        raise ValueError("an image without columns")
    s = smooth(profile.astype(float), p.smoothing)[:n]
    lo, hi = int(n * p.band[0]), int(n * p.band[1])
    deep = hi > lo and (s.mean() - s[lo:hi].min()) / (s.mean() + 1e-6) >= p.contrast
    at = lo + int(np.round(s[lo:hi], 9).argmin()) if deep else n // 2
    return max(int(n * p.clamp[0]), min(int(n * p.clamp[1]), at)), "detected" if deep else "centre"


def border_box(g: np.ndarray, bright: int = 50, kernel: int = 15, grow: int = 4) -> tuple[int, int, int, int]:
    """(x, y, w, h) of the page inside a dark border; the whole image if nothing is bright."""
    inner = erode((g > bright).astype(np.uint8), kernel, kernel)
    ys, xs = np.flatnonzero(inner.any(axis=1)), np.flatnonzero(inner.any(axis=0))
    height, width = g.shape
    if not len(ys):
        return 0, 0, width, height
    x1, y1 = max(0, xs[0] - grow), max(0, ys[0] - grow)
    return int(x1), int(y1), int(min(width, xs[-1] + 1 + grow) - x1), int(min(height, ys[-1] + 1 + grow) - y1)


def binding_trim(g: np.ndarray) -> tuple[int, int]:
    """Columns to take off at the left and right: a dark binding in the outer fifth that the page recovers from. The right is measured on what the left has left."""

    def side(p: np.ndarray) -> int:
        n = len(p)
        middle = p[n // 4 : n * 3 // 4].mean() if n >= 4 else p.mean()
        dark = np.flatnonzero(p[: n // 5] < 0.75 * middle)
        if not len(dark):
            return 0
        after = np.flatnonzero(p[dark[0] : n // 5] >= 0.90 * middle)
        return int(dark[0] + after[0]) if len(after) else 0

    profile = g.mean(axis=0)
    left = side(profile)
    return left, side(profile[left:][::-1])


def denoise(g: np.ndarray, h: float = 10, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every shift within the search window, weighted by how alike the surroundings are."""
    r = search // 2
    padded = np.pad(g, r, mode="reflect" if min(g.shape) > r else "edge")
    total, weights = np.zeros_like(g), np.zeros_like(g)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            shifted = padded[r + dy : r + dy + g.shape[0], r + dx : r + dx + g.shape[1]]
            w = np.exp(-np.maximum(box_mean((g - shifted) ** 2, template) - 2 * 1.0, 0) / (h * h))
            total += w * shifted
            weights += w
    return total / weights


def ink(g: np.ndarray, block: int = 35, c: float = 10) -> np.ndarray:
    """1 where a pixel is darker than its surroundings by more than c."""
    block = min(block, (min(g.shape) - 1) | 1)
    return (g <= blur(g, block) - c).astype(np.uint8) if block >= 3 else np.zeros(g.shape, np.uint8)


def without_frame(a: np.ndarray, width: int = 5) -> np.ndarray:
    out = np.zeros_like(a)
    out[width:-width, width:-width] = a[width:-width, width:-width]
    return out


def joining_kernels(binary: np.ndarray) -> tuple[int, int]:
    """Sideways and downward reach by which ink is joined to regions, from the width of the emptiest gutter."""
    height, width = binary.shape
    profile = smooth(binary.sum(axis=0).astype(float), 5)
    lo, hi = int(0.2 * width), int(0.8 * width)
    at = lo + int(profile[lo:hi].argmin()) if hi > lo else width // 2
    low = 0.30 * profile.mean()
    left = right = at
    # the gutter reaches to the first columns that aren't empty
    while left > 0 and profile[left] < low:
        left -= 1
    while right < width - 1 and profile[right] < low:
        right += 1
    return max(7, min(55, (max(right - left, 1) // 2) | 1)), max(8, int(0.018 * height) | 1)


def _runs(mask: np.ndarray, reach: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(row, start, end) of all runs, and the root of each one's component; reach 1 joins runs that meet at corners too."""
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0])))).tolist()
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(parent)
            parent.append(k)
            runs.append((y, a, b))
            for i in above:
                if runs[i][1] < b + reach and runs[i][2] > a - reach:
                    low, high = sorted((find(i), find(k)))
                    parent[high] = low
            here.append(k)
        above = here
    return runs, [find(k) for k in range(len(parent))]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of each outermost 8-connected component, in order of y and x. What lies in a hole of another one is left out."""
    ink_ = np.pad(mask.astype(bool), 1)
    paper, paper_roots = _runs(~ink_, 0)
    outside = np.zeros(ink_.shape, bool)
    for (y, a, b), root in zip(paper, paper_roots, strict=True):
        outside[y, a:b] = root == paper_roots[0]  # of the first run, at the upper left
    touching = np.zeros(ink_.shape, bool)
    touching[1:], touching[:-1] = outside[:-1], touching[:-1] | outside[1:]
    touching[:, 1:] |= outside[:, :-1]
    touching[:, :-1] |= outside[:, 1:]
    boxes: dict[int, list[int]] = {}
    outer: set[int] = set()
    for (y, a, b), root in zip(*_runs(ink_, 1), strict=True):
        p = boxes.setdefault(root, [a, y, b, y + 1])
        boxes[root] = [min(p[0], a), min(p[1], y), max(p[2], b), max(p[3], y + 1)]
        if touching[y, a:b].any():
            outer.add(root)
    return sorted(((x1 - 1, y1 - 1, x2 - x1, y2 - y1) for root, (x1, y1, x2, y2) in boxes.items() if root in outer), key=lambda b: (b[1], b[0]))


def sharpness(g: np.ndarray) -> float:
    """Variance of the Laplacian."""
    p = np.pad(g.astype(float), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def candidates(image: np.ndarray, denoised: bool = True) -> list[dict]:
    """Candidate boxes of a page image: pixels in the crop, the crop's place, sharpness and ink density."""
    g = grey(image)
    height, width = g.shape
    px, py, pw, ph = border_box(g)
    page = g[py : py + ph, px : px + pw]
    left, right = binding_trim(page)
    page = page[:, left : page.shape[1] - right]
    px += left
    if min(page.shape) < 12:
        return []
    binary = without_frame(ink(denoise(page) if denoised else page))
    kw, kv = joining_kernels(binary)
    joined = dilate(dilate(binary, kw, 2), 3, kv)
    profile = binary.sum(axis=0).astype(float)
    out = []
    for x, y, w, h in components(joined):
        part, dark = page[y : y + h, x : x + w], binary[y : y + h, x : x + w]
        out.append({"bx": x, "by": y, "bw": w, "bh": h, "px": px, "py": py, "page_w": width, "page_h": height, "crop_w": page.shape[1], "crop_h": page.shape[0], "sharp": sharpness(part), "td": float(dark.mean())})
    gutter = two_columns(profile, binary)
    return [{**b, "gutter": None if gutter is None else (px + gutter) / width} for b in out]


def two_columns(profile: np.ndarray, binary: np.ndarray) -> int | None:
    """The gutter between two columns: the emptiest place of the middle, empty on enough rows that have ink."""
    width = len(profile)
    smoothed = smooth(profile, max(1, width // 60))
    lo, hi = int(0.2 * width), int(0.8 * width)
    if hi <= lo:
        return None
    at = lo + int(smoothed[lo:hi].argmin())
    if not smoothed[lo:hi].any() or smoothed[at] > 0.65 * smoothed[lo:hi].mean():
        return None
    half = max(2, int(0.02 * width))
    rows = binary.sum(axis=1).astype(float)
    gap = binary[:, max(0, at - half) : at + half].sum(axis=1).astype(float)
    return at if (gap < 0.10 * rows).sum() >= 0.40 * binary.shape[0] else None


def evened(crop: np.ndarray) -> np.ndarray:
    """A crop with its background made even, before recognition."""
    g = grey(crop)
    k = max(min(51, (g.shape[0] // 2) * 2 - 1), 5)
    return np.clip(g / (blur(g, k) + 1e-6) * 200, 0, 255)


def enlarged(g: np.ndarray, scale: float) -> np.ndarray:
    """Cubic (Catmull-Rom like) resampling to scale times the size."""

    def axis(a: np.ndarray, n: int) -> np.ndarray:
        x = (np.arange(n) + 0.5) / scale - 0.5
        i, t = np.floor(x).astype(int), x - np.floor(x)
        c = -0.75
        w = np.stack([c * (t + 1) ** 3 - 5 * c * (t + 1) ** 2 + 8 * c * (t + 1) - 4 * c, (c + 2) * t**3 - (c + 3) * t**2 + 1, (c + 2) * (1 - t) ** 3 - (c + 3) * (1 - t) ** 2 + 1])
        w = np.vstack([w, 1 - w.sum(axis=0)])
        return sum(w[k][:, None] * a[np.clip(i + k - 1, 0, len(a) - 1)] for k in range(4))

    g = axis(g.astype(float), round(g.shape[0] * scale))
    return np.clip(axis(g.T, round(g.shape[1] * scale)).T, 0, 255)


def binarised(g: np.ndarray) -> np.ndarray:
    """255 for paper, 0 for ink."""
    block = max(min(31, (g.shape[0] // 4) * 2 + 1), 11)
    return np.where(g > blur(g, block) - 12, 255, 0).astype(np.uint8)


def prepared(crop: np.ndarray, scale: float, denoised: bool = True) -> np.ndarray:
    """A crop as the recogniser gets it."""
    g = enlarged(evened(crop), scale)
    return binarised(denoise(g) if denoised else g)
