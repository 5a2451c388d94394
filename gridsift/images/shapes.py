"""Silhouettes, poses, components and bands of one image."""

from __future__ import annotations

import math

import numpy as np

# Angular bins of the silhouette histogram, candidate symmetry orders, and the limits of a usable pose.
ANGULAR_BINS = 360
ORDERS = tuple(range(2, 13))
AREA_RANGE, MIN_HARMONIC = (0.2, 0.8), 0.03
OBJECT_AREA_RANGE, MIN_POLARITY = (0.005, 0.95), 0.10

EIGHT = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def _moved(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """The neighbour at (dy, dx) of every pixel, ``fill`` beyond the border."""
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = a[max(0, dy):h - max(0, -dy), max(0, dx):w - max(0, -dx)]
    return out


def components(mask: np.ndarray, around=EIGHT) -> np.ndarray:
    """Labels 1.. of connected regions in the order of their first pixel, 0 outside.

    Every pixel takes the smallest index of its neighbourhood, then jumps to the index of that index, until nothing changes.
    """
    outside = mask.size
    label = np.where(mask, np.arange(outside).reshape(mask.shape), outside)
    while True:
        lowest = label.copy()
        for dy, dx in around:
            np.minimum(lowest, _moved(label, dy, dx, outside), out=lowest)
        lowest[~mask] = outside
        lowest = np.append(lowest.ravel(), outside)
        lowest = lowest[lowest][:-1].reshape(mask.shape)
        if (lowest == label).all():
            break
        label = lowest
    firsts = np.unique(label[mask])
    return np.where(mask, np.searchsorted(firsts, label) + 1, 0).astype(np.int32)


def largest(labels: np.ndarray) -> np.ndarray:
    """The largest region, the earlier one on ties."""
    areas = np.bincount(labels.ravel())
    areas[0] = 0
    return labels == int(areas.argmax()) if areas.any() else np.zeros(labels.shape, dtype=bool)


def filled(mask: np.ndarray) -> np.ndarray:
    """Everything the border background cannot reach through 4-neighbours."""
    background = components(~mask, FOUR)
    border = np.concatenate([background[0], background[-1], background[:, 0], background[:, -1]])
    return ~np.isin(background, np.unique(border[border > 0]))


def otsu(gray: np.ndarray) -> int:
    """First level with the largest between-class variance; the classes are <= level and > level."""
    counts = np.bincount(gray.ravel().astype(np.int64), minlength=256).astype(np.float64)
    levels = np.arange(256)
    weight, total = counts.cumsum(), float((counts * levels).sum())
    below = (counts * levels).cumsum()
    spread = weight * (gray.size - weight)
    score = (total * weight - below * gray.size) ** 2 / np.where(spread > 0, spread, 1.0)
    return int(np.argmax(np.where(spread > 0, score, 0.0)))


def silhouette(gray: np.ndarray, dark: bool = False) -> tuple[np.ndarray, int]:
    """(filled largest region, threshold) of the class above, or at and below, the threshold."""
    threshold = otsu(gray)
    return filled(largest(components(gray <= threshold if dark else gray > threshold))), threshold


def touches_border(mask: np.ndarray) -> bool:
    return bool(mask[0].any() or mask[-1].any() or mask[:, 0].any() or mask[:, -1].any())


def fourfold_pose(gray: np.ndarray, scale: float = 4.0) -> dict:
    """Centre, angle modulo 90 and strength of the fourth angular harmonic of a bright object, with failure reasons."""
    mask, _ = silhouette(gray)
    area = float(mask.mean())
    middle = (gray.shape[0] * scale - 1) / 2
    pose = {"status": "FAILURE", "reason": "AREA_OR_BORDER", "cx": middle, "cy": middle, "angle": 0.0, "area": area,
            "strength": 0.0, "radius": 0.0}
    if not AREA_RANGE[0] <= area <= AREA_RANGE[1] or touches_border(mask):
        return pose
    ys, xs = np.nonzero(mask)
    cx, cy = xs.mean(), ys.mean()
    z = (xs - cx) + 1j * (ys - cy)
    length = np.abs(z)
    unit4 = np.where(length > 0, (z / np.where(length > 0, length, 1)) ** 4, 1.0).mean()
    strength = abs(unit4)
    weak = strength < MIN_HARMONIC
    pose.update(status="FAILURE" if weak else "SUCCESS", reason="WEAK_FOURFOLD_HARMONIC" if weak else "OK",
                cx=(cx + .5) * scale - .5, cy=(cy + .5) * scale - .5, angle=math.degrees(math.atan2(unit4.imag, unit4.real)) / 4,
                strength=float(strength), radius=math.sqrt(len(xs) / math.pi) * scale)
    return pose


def axis_pose(mask: np.ndarray, strategy: str, min_anisotropy: float = 0.10, scale: float = 4.0) -> dict:
    """Centre, principal axis, anisotropy and end-mass polarity of a silhouette under one strategy.

    Second moments come from integer sums, so equal masks give equal poses in any order of summation.
    """
    h, w = mask.shape
    ys, xs = (a.astype(np.int64) for a in np.nonzero(mask))
    n = len(xs)
    sx, sy = int(xs.sum()), int(ys.sum())
    cx, cy = (sx / n, sy / n) if n else ((w - 1) / 2, (h - 1) / 2)
    xx, yy, xy = ((int((a * b).sum()) * n - sa * sb) / n if n else 0.0
                  for a, b, sa, sb in ((xs, xs, sx, sx), (ys, ys, sy, sy), (xs, ys, sx, sy)))
    anisotropy = math.hypot(xx - yy, 2 * xy) / (xx + yy) if xx + yy > 0 else 0.0
    axis = math.degrees(0.5 * math.atan2(2 * xy, xx - yy))
    along = (xs - cx) * math.cos(math.radians(axis)) + (ys - cy) * math.sin(math.radians(axis))
    polarity = 0.0
    if n:
        quarter = 0.25 * (along.max() - along.min())
        minus, plus = int((along <= along.min() + quarter).sum()), int((along >= along.max() - quarter).sum())
        polarity = (plus - minus) / (plus + minus)
    border, area = touches_border(mask), n / mask.size
    valid = n > 0 and OBJECT_AREA_RANGE[0] <= area <= OBJECT_AREA_RANGE[1] and not border
    state = "OK" if valid else "SEGMENTATION_FAILURE"
    if valid and strategy != "CENTER_ONLY":
        if anisotropy < min_anisotropy:
            state = "WEAK_AXIS"
        elif strategy == "AXIS_WITH_POLARITY" and abs(polarity) < MIN_POLARITY:
            state = "WEAK_POLARITY"
    angle = {"CENTER_ONLY": 0.0, "AXIS": axis, "AXIS_WITH_POLARITY": axis + 180 if polarity < 0 else axis}[strategy]
    return {"strategy": strategy, "state": state, "cx": (cx + .5) * scale - .5, "cy": (cy + .5) * scale - .5, "angle": angle,
            "axis": axis, "area": area, "anisotropy": anisotropy, "polarity": polarity, "border": border}


def angular_orders(mask: np.ndarray) -> tuple[int, np.ndarray]:
    """(dominant symmetry order, amplitudes of orders 2..12) of the angle histogram about the centroid."""
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return 0, np.zeros(len(ORDERS))
    # Rounding keeps angles on a bin edge (multiples of 45 degrees) out of the last-bit noise.
    degrees = np.round(np.degrees(np.arctan2(ys.mean() - ys, xs - xs.mean())), 9)
    bins = np.floor(degrees * (ANGULAR_BINS / 360)).astype(np.int64) % ANGULAR_BINS
    spectrum = np.abs(np.fft.fft(np.bincount(bins, minlength=ANGULAR_BINS)))[list(ORDERS)]
    # Equal amplitudes differ in the last bits; the lower order wins.
    return ORDERS[int(np.argmax(np.round(spectrum, 9)))], spectrum


def ring(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels outside the mask with a mask pixel within the square of the given radius (prefix sums)."""
    h, w = mask.shape
    prefix = np.zeros((h + 1, w + 1), dtype=np.int64)
    prefix[1:, 1:] = mask.cumsum(axis=0).cumsum(axis=1)
    y, x = np.arange(h), np.arange(w)
    top, bottom = np.maximum(0, y - radius)[:, None], np.minimum(h, y + radius + 1)[:, None]
    left, right = np.maximum(0, x - radius)[None], np.minimum(w, x + radius + 1)[None]
    inside = prefix[bottom, right] - prefix[top, right] - prefix[bottom, left] + prefix[top, left]
    return ~mask & (inside > 0)


def bands(mask: np.ndarray, steps: int) -> np.ndarray:
    """1 inside the eroded object, 2 in the band around its edge, 0 outside the dilated object (4-neighbour steps)."""
    grown, shrunk = mask.copy(), mask.copy()
    for _ in range(steps):
        larger, smaller = grown.copy(), shrunk.copy()
        for dy, dx in FOUR:
            larger |= _moved(grown, dy, dx, False)
            smaller &= _moved(shrunk, dy, dx, False)
        grown, shrunk = larger, smaller
    return np.where(shrunk, 1, np.where(grown, 2, 0)).astype(np.int32)


def region_statistics(values: np.ndarray, selection: np.ndarray, radius: int, grid: int = 14) -> dict:
    """Mean, median, contrast to the ring, gradient energy, minor width and occupied grid cells of a selection."""
    h, w = values.shape
    ys, xs = np.nonzero(selection)
    inner = [(selection[:, 1:] & selection[:, :-1], np.diff(values, axis=1)), (selection[1:] & selection[:-1], np.diff(values, axis=0))]
    edges = int(sum(s.sum() for s, _ in inner))
    energy = float(sum((d[s] ** 2).sum() for s, d in inner)) / edges if edges else None
    cells = len(set(zip((ys * grid // h).tolist(), (xs * grid // w).tolist())))
    out = {"selected": len(xs), "cells": cells, "edges": edges, "gradient_energy": energy, "mean": None, "median": None,
           "contrast": None, "minor_width": None}
    if not len(xs):
        return out
    near = values[ring(selection, radius)]
    n = len(xs)
    cov = np.cov(np.stack([xs, ys]), bias=True) if n > 1 else np.zeros((2, 2))
    minor = (cov[0, 0] + cov[1, 1] - math.hypot(cov[0, 0] - cov[1, 1], 2 * cov[0, 1])) / 2
    out.update(mean=float(values[selection].mean()), median=float(np.median(values[selection])),
               contrast=float(values[selection].mean() - near.mean()) if near.size else None, minor_width=math.sqrt(12 * max(0.0, minor)))
    return out


def occupancy(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Share of object pixels per grid cell, cell edges rounded to whole pixels."""
    h, w = mask.shape
    ye, xe = (np.round(np.arange(n + 1) * size / n).astype(int) for n, size in ((rows, h), (cols, w)))
    return np.array([mask[ye[r]:ye[r + 1], xe[c]:xe[c + 1]].mean() for r in range(rows) for c in range(cols)])
