"""Page images: finding the documents on a page. Works on gray levels as arrays; a decoder is the caller's choice."""

from __future__ import annotations

import numpy as np

#: Narrowest gap and margins it must keep, as shares of the width; ink both sides need; bounds of the recursion and of ink.
GAP, MARGIN, INK, DEPTH, REGIONS, MOST_INK = 0.015, 0.12, 0.15, 3, 8, 0.40


def otsu(gray: np.ndarray) -> int:
    """The level that separates two classes of gray best: the one with the greatest variance between them."""
    n = np.bincount(gray.ravel().astype(np.uint8), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean_below, mean = np.cumsum(n * np.arange(256)), (n * np.arange(256)).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * below / total - mean_below) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def widest_gap(columns: np.ndarray) -> tuple[int, int] | None:
    """(start, end) of the widest run of inkless columns that is wide enough and keeps off the edges."""
    width = len(columns)
    empty = np.r_[False, columns == 0, False].astype(np.int8)
    edges = np.flatnonzero(np.diff(empty))
    runs = [(s, e) for s, e in edges.reshape(-1, 2).tolist() if e - s >= GAP * width and s >= MARGIN * width and e <= (1 - MARGIN) * width]
    return max(runs, key=lambda r: r[1] - r[0], default=None)


def split_page(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Regions (x, y, w, h) of single documents, in reading order; the whole page where it can't be told."""
    height, width = gray.shape
    ink = gray <= otsu(gray)
    whole = [(0, 0, width, height)]
    if not ink.any() or ink.mean() > MOST_INK:
        return whole
    out: list[tuple[int, int, int, int]] = []

    def cut(x: int, w: int, depth: int) -> None:
        columns = ink[:, x : x + w].sum(0)
        gap = widest_gap(columns) if depth < DEPTH else None
        if gap is None or min(columns[: gap[0]].sum(), columns[gap[1] :].sum()) < INK * columns.sum():
            out.append((x, 0, w, height))
            return
        middle = (gap[0] + gap[1]) // 2
        cut(x, middle, depth + 1)
        cut(x + middle, w - middle, depth + 1)

    cut(0, width, 0)
    return reading_order(out) if len(out) <= REGIONS else whole


def reading_order(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes by bands of height, then from left to right: a band opens with its topmost box and holds what starts less than
    half that box's height below, so the order is transitive."""
    out, band = [], []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if band and b[1] - band[0][1] >= max(b[3], band[0][3]) / 2:
            out += sorted(band)
            band = []
        band.append(b)
    return out + sorted(band)


def median_angle(angles: list[float]) -> float | None:
    """The upper median of three or more line angles; fewer tell nothing."""
    return sorted(angles)[len(angles) // 2] if len(angles) >= 3 else None
