"""Resampling kernels on one image: pixel centres at integers, edges replicated."""

from __future__ import annotations

import math

import numpy as np

# Channel means and deviations of the tensor normalisation (RGB).
MEAN = np.array([0.485, 0.456, 0.406])
STD = np.array([0.229, 0.224, 0.225])


def rigid(degrees: float, cx: float, cy: float, to_x: float, to_y: float) -> tuple[float, float, float, float]:
    """(cos, sin, tx, ty) of the turn that removes ``degrees`` and carries (cx, cy) to (to_x, to_y); quarter turns are exact."""
    if degrees % 90 == 0:
        c, s = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[int(-degrees // 90) % 4]
    else:
        c, s = math.cos(math.radians(-degrees)), math.sin(math.radians(-degrees))
    return c, s, to_x - c * cx + s * cy, to_y - s * cx - c * cy


def to_source(t: tuple[float, float, float, float], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, s, tx, ty = t
    return c * (x - tx) + s * (y - ty), -s * (x - tx) + c * (y - ty)


def keys_cubic(distance: np.ndarray) -> np.ndarray:
    """Cubic convolution weight with a = -1/2."""
    t = np.abs(distance)
    near = (1.5 * t - 2.5) * t * t + 1
    far = ((-0.5 * t + 2.5) * t - 4) * t + 2
    return np.where(t <= 1, near, np.where(t < 2, far, 0.0))


def _tap(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    height, width = image.shape[:2]
    return image[np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)]


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, kernel: str = "bilinear") -> np.ndarray:
    """Values of (H, W, C) at real coordinates; the kernel centre is not clamped, its taps are."""
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    if kernel == "bilinear":
        taps, weight = (0, 1), lambda f, k: (1 - f) if k == 0 else f
    else:
        taps, weight = (-1, 0, 1, 2), lambda f, k: keys_cubic(f - k)
    total, norm = 0.0, 0.0
    for j in taps:
        wy = weight(y - y0, j)
        for i in taps:
            w = wy * weight(x - x0, i)
            total = total + w[..., None] * _tap(image, y0 + j, x0 + i)
            norm = norm + w
    return total / norm[..., None]


def interpolated(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of (H, W, C) at coordinates inside the frame: along rows first, then between them."""
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = _tap(image, y0, x0) * (1 - fx) + _tap(image, y0, x0 + 1) * fx
    bottom = _tap(image, y0 + 1, x0) * (1 - fx) + _tap(image, y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + bottom * fy


def tent_sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, cos: float, sin: float, scale: float) -> np.ndarray:
    """Tent filter widened to ``scale`` source pixels along the turned output axes."""
    radius = scale * (abs(cos) + abs(sin))
    low_x, low_y = np.ceil(x - radius).astype(np.int64), np.ceil(y - radius).astype(np.int64)
    reach = int(math.floor(2 * radius)) + 1
    total, norm = 0.0, 0.0
    for j in range(reach + 1):
        for i in range(reach + 1):
            px, py = low_x + i, low_y + j
            dx, dy = px - x, py - y
            inside = (dx <= radius) & (dy <= radius)
            u, v = (cos * dx - sin * dy) / scale, (sin * dx + cos * dy) / scale
            w = np.where(inside, np.maximum(0, 1 - np.abs(u)) * np.maximum(0, 1 - np.abs(v)), 0.0)
            total = total + w[..., None] * _tap(image, py, px)
            norm = norm + w
    return total / norm[..., None]


def canonical_samples(image: np.ndarray, transform: tuple[float, float, float, float], out: int, kernel: str) -> np.ndarray:
    """(out, out, C) samples of a square image seen through the inverse of a rigid transform, clipped to 0..255."""
    scale = image.shape[0] / out
    q = scale * (np.arange(out) + 0.5) - 0.5
    qx, qy = np.meshgrid(q, q)
    x, y = to_source(transform, qx, qy)
    if kernel == "tent":
        values = tent_sampled(image, y, x, transform[0], transform[1], scale)
    else:
        values = sampled(image, y, x, kernel)
    if not np.isfinite(values).all():
        raise ValueError("sample is not finite")
    return np.clip(values, 0.0, 255.0)


def normalised(rgb: np.ndarray) -> np.ndarray:
    """(3, H, W) float32 tensor of 0..255 RGB values."""
    return np.ascontiguousarray(np.moveaxis((rgb / 255.0 - MEAN) / STD, -1, 0)).astype(np.float32)


def resized(image: np.ndarray, out_height: int, out_width: int, kernel: str = "bicubic") -> np.ndarray:
    """Separable resize with half-pixel centres, byte valued."""
    height, width = image.shape[:2]
    y = (np.arange(out_height) + 0.5) * height / out_height - 0.5
    x = (np.arange(out_width) + 0.5) * width / out_width - 0.5
    xx, yy = np.meshgrid(x, y)
    return np.floor(np.clip(sampled(image, yy, xx, kernel), 0, 255) + 0.5)


def moved(image: np.ndarray, family: str, level: float) -> np.ndarray:
    """Geometric change of a byte image: content shifted, turned clockwise or scaled about the middle; edges replicated."""
    height, width = image.shape[:2]
    x, y = np.meshgrid(np.arange(width, dtype=np.float64), np.arange(height, dtype=np.float64))
    mx, my = (width - 1) / 2, (height - 1) / 2
    if family == "TRANSLATION_X":
        x = x - level
    elif family == "TRANSLATION_Y":
        y = y - level
    elif family == "ROTATION":
        c, s = math.cos(math.radians(level)), math.sin(math.radians(level))
        x, y = c * (x - mx) + s * (y - my) + mx, -s * (x - mx) + c * (y - my) + my
    elif family == "SCALE":
        x, y = (x - mx) / level + mx, (y - my) / level + my
    else:
        raise ValueError(f"not a geometric family: {family}")
    return np.floor(interpolated(image, np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)) + 0.5)


def warped(image: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Byte image under a forward 3x3 matrix on pixel centres."""
    height, width = image.shape[:2]
    inverse = np.linalg.inv(forward)
    x, y = np.meshgrid(np.arange(width, dtype=np.float64), np.arange(height, dtype=np.float64))
    sx = inverse[0, 0] * x + inverse[0, 1] * y + inverse[0, 2]
    sy = inverse[1, 0] * x + inverse[1, 1] * y + inverse[1, 2]
    return np.floor(np.clip(sampled(image, sy, sx), 0, 255) + 0.5)


def backprojected(canonical: np.ndarray, forward: tuple[float, float, float, float, float, float]) -> np.ndarray:
    """A square canonical map seen from source pixels through six forward coefficients, clamped to its frame."""
    size = canonical.shape[0]
    a, b, c, d, e, f = forward
    x, y = np.meshgrid(np.arange(size, dtype=np.float64), np.arange(size, dtype=np.float64))
    sx = np.clip(a * x + b * y + c, 0, size - 1)
    sy = np.clip(d * x + e * y + f, 0, size - 1)
    return interpolated(canonical[..., None], sy, sx)[..., 0]


def pulled(mask: np.ndarray, transform: tuple[float, float, float, float], out: int) -> np.ndarray:
    """A square mask seen on a frame of ``out`` pixels through the inverse of a rigid transform, nearest pixel, empty outside."""
    size = mask.shape[0]
    q = (np.arange(out) + 0.5) * size / out - 0.5
    u, v = np.meshgrid(q, q)
    x, y = (np.floor(a + 0.5).astype(np.int64) for a in to_source(transform, u, v))
    inside = (x >= 0) & (x < size) & (y >= 0) & (y < size)
    return inside & mask[np.clip(y, 0, size - 1), np.clip(x, 0, size - 1)]
