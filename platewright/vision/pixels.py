"""Pixel operators in numpy: greyscale, thresholds, components, lines.

Results of smoothing, local contrast, edges and lines follow the published
algorithms and are not bit for bit those of any image library.
"""

from __future__ import annotations

import numpy as np

from platewright.functions import patterns as P

Box = tuple[int, int, int, int]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded; a grey image as it is."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    b, g, r = (image[..., k].astype(float) for k in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def blur(image: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with a 5 x 5 binomial kernel, edges reflected."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16.0
    padded = np.pad(image.astype(float), 2, mode="reflect" if min(image.shape) > 2 else "edge")
    rows = sum(k * padded[:, i : i + image.shape[1]] for i, k in enumerate(kernel))
    return np.rint(sum(k * rows[i : i + image.shape[0]] for i, k in enumerate(kernel))).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold that separates dark from light best."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    weight = counts.cumsum()
    mass = (counts * np.arange(256)).cumsum()
    other = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mass[-1] * weight / weight[-1] - mass) ** 2 / (weight * other)
    return int(np.nan_to_num(spread, nan=-1.0, posinf=-1.0).argmax())


def binarise(image: np.ndarray) -> np.ndarray:
    """255 above the threshold of :func:`otsu`, else 0."""
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def _spread(mask: np.ndarray, size: int, fill: bool, f) -> np.ndarray:
    r = size // 2
    padded = np.pad(mask, r, constant_values=fill)
    rows = f.reduce([padded[:, i : i + mask.shape[1]] for i in range(size)])
    return f.reduce([rows[i : i + mask.shape[0]] for i in range(size)])


def close(mask: np.ndarray, size: int = 9, times: int = 2) -> np.ndarray:
    """Morphological closing with a square: gaps narrower than it are filled."""
    m = mask > 0
    for _ in range(times):
        m = _spread(m, size, False, np.logical_or)
    for _ in range(times):
        m = _spread(m, size, True, np.logical_and)
    return np.where(m, 255, 0).astype(np.uint8)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of the 8-connected parts, in order of their first pixel."""
    return [p[:5] for p in parts(mask)]


def parts(mask: np.ndarray) -> list[tuple[int, int, int, int, int, float, float]]:
    """(x, y, w, h, pixels, cx, cy) of the 8-connected parts, in order of their first pixel; cx and cy are the mean of their pixels.

    Runs of each row are joined with those that they touch in the row above.
    """
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[tuple[int, int, int, int]] = []
    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.diff(np.concatenate([[0], (mask[y] > 0).astype(np.int8), [0]]))
        here = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            me = len(parent)
            parent.append(me)
            for pa, pb, other in above:
                if pa <= b and pb >= a:
                    x, z = root(me), root(other)
                    parent[max(x, z)] = min(x, z)
            runs.append((int(a), int(b), y, me))
            here.append((int(a), int(b), me))
        above = here
    found: dict[int, list[int]] = {}
    for a, b, y, me in runs:
        s = found.setdefault(root(me), [a, y, b, y + 1, 0, 0.0, 0.0])
        n = b - a
        s[0], s[2], s[3], s[4], s[5], s[6] = min(s[0], a), max(s[2], b), y + 1, s[4] + n, s[5] + n * (a + b - 1) / 2, s[6] + n * y
    return [(x0, y0, x1 - x0, y1 - y0, n, sx / n, sy / n) for _, (x0, y0, x1, y1, n, sx, sy) in sorted(found.items())]


def figure_regions(image: np.ndarray, least: int = P.REGION_AREA) -> list[tuple[Box, float, str]]:
    """(box, score, kind) of the figures of a page, by row and column; the page itself where there is none."""
    h, w = image.shape[:2]
    low, high = P.REGION_ASPECT
    found = [((x, y, bw, bh), min(0.99, n / (h * w)), "figure") for x, y, bw, bh, n in components(close(255 - binarise(blur(grey(image))))) if least <= n <= h * w * P.REGION_SHARE and low <= bw / max(1, bh) <= high]
    found.sort(key=lambda r: (r[0][1], r[0][0]))
    return found or [((0, 0, w, h), P.SCORE_WHOLE_PAGE, "page")]


def _bright_parts(image: np.ndarray) -> np.ndarray:
    """An image in black and white, what there is less of in white."""
    binary = binarise(blur(grey(image)))
    return 255 - binary if binary.mean() > 127 else binary


def panels(image: np.ndarray) -> list[tuple[Box, float]]:
    """(box, score) of the panels of a figure, in reading order; size and score are by a part's pixels, not its box."""
    total = image.shape[0] * image.shape[1]
    found = [((x, y, w, h), min(1.0, n / total)) for x, y, w, h, n in components(_bright_parts(image)) if P.PANEL_AREA <= n <= total * P.PANEL_SHARE]
    return sorted(found, key=lambda p: (p[0][1], p[0][0]))


def grid_points(width: int, height: int, n: int = 6) -> list[tuple[float, float]]:
    """The inner crossings of a grid that divides an image into n + 1 rows and columns, row by row."""
    return [(width * i / (n + 1), height * j / (n + 1)) for j in range(1, n + 1) for i in range(1, n + 1)]


def prompts(image: np.ndarray, n: int = 6) -> tuple[list[tuple[float, float]], list[Box]]:
    """Points and boxes to ask a segmentation model for: centres of mass and boxes of the
    image's parts, and a grid. Points near a kept one and boxes in the same cells as one
    are left out, then as many are taken as the model does."""
    h, w = image.shape[:2]
    large = [p for p in parts(_bright_parts(image)) if 0.5 * P.PANEL_AREA <= p[4] <= h * w * P.PANEL_SHARE]
    kept: list[tuple[float, float]] = []
    for p in [(cx, cy) for *_, cx, cy in large] + grid_points(w, h, max(2, n)):
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 > P.POINT_GAP**2 for q in kept):
            kept.append(p)
    boxes: dict[tuple[int, ...], Box] = {}
    for x, y, bw, bh, *_ in large:
        boxes.setdefault(tuple(v // P.GRID_CELL for v in (x, y, x + bw, y + bh)), (x, y, bw, bh))
    return kept[: P.PROMPT_POINTS], list(boxes.values())[: P.PROMPT_BOXES]


def mask_boxes(masks: list[np.ndarray], scores: list[float], least_score: float = 0.8) -> list[tuple[Box, float]]:
    """Boxes of masks that are sure and large enough; width and height are those between the outermost pixels."""
    out = []
    for mask, score in zip(masks, scores):
        ys, xs = np.nonzero(mask)
        if score >= least_score and len(xs):
            x, y, w, h = int(xs.min()), int(ys.min()), int(xs.max() - xs.min()), int(ys.max() - ys.min())
            if w * h >= P.PANEL_AREA:
                out.append(((x, y, w, h), float(score)))
    return out


def local_contrast(image: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation tile by tile, clipped at ``limit`` times the mean, blended between tiles."""
    g = grey(image)
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for j in range(tiles):
        for i in range(tiles):
            part = g[ys[j] : ys[j + 1], xs[i] : xs[i + 1]]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, limit * part.size / 256)
            extra = np.maximum(counts - most, 0).sum()
            counts = np.minimum(counts, most) + extra / 256
            maps[j, i] = 255 * counts.cumsum() / max(1.0, counts.sum())
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    top = maps[y0[:, None], x0[None, :], g] * (1 - ax) + maps[y0[:, None], x1[None, :], g] * ax
    bottom = maps[y1[:, None], x0[None, :], g] * (1 - ax) + maps[y1[:, None], x1[None, :], g] * ax
    return np.rint(top * (1 - ay) + bottom * ay).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every pixel the mean of those around it, weighted by how alike their patches are."""
    g = grey(image).astype(float)
    r, p = search // 2, patch // 2
    padded = np.pad(g, r + p, mode="edge")
    h, w = g.shape
    total, weights = np.zeros_like(g), np.zeros_like(g)
    centre = padded[r : r + h + 2 * p, r : r + w + 2 * p]

    def box_sum(a: np.ndarray) -> np.ndarray:
        c = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return c[patch:, patch:] - c[:-patch, patch:] - c[patch:, :-patch] + c[:-patch, :-patch]

    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = padded[r + dy : r + dy + h + 2 * p, r + dx : r + dx + w + 2 * p]
            k = np.exp(-box_sum((centre - other) ** 2) / (patch * patch * strength * strength))
            total += k * other[p : p + h, p : p + w]
            weights += k
    return np.rint(total / weights).astype(np.uint8)


def resized(width: int, height: int, most: int) -> tuple[int, int]:
    """An image's size with its longer side at ``most``, the ratio kept."""
    scale = most / max(width, height)
    return int(width * scale), int(height * scale)


def for_recognition(image: np.ndarray) -> np.ndarray:
    """An image as text recognisers like it: grey, even, clean, black and white."""
    return binarise(denoise(local_contrast(image)))


def scale_bar_length(image: np.ndarray, least: int = 30, slope: int = 6) -> float | None:
    """Pixels of the longest nearly horizontal straight dark or light bar; None without one."""
    g = grey(image).astype(int)
    edges = np.zeros(g.shape, dtype=bool)
    edges[1:] = np.abs(np.diff(g, axis=0)) >= 80
    longest = 0.0
    for x, y, w, h, n in components(np.where(edges, 255, 0)):
        if w >= least and h - 1 <= slope and n >= 0.8 * w:
            longest = max(longest, float(np.hypot(w - 1, h - 1)))
    return longest or None


def crop(image: np.ndarray, box: Box) -> np.ndarray:
    """The part of an image in a box, cut at the edges."""
    x, y, w, h = box
    return image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
