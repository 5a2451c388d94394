"""Photometric changes and simple pixel statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

# The levels each family is studied at; geometric levels in pixels, degrees or scale.
LEVELS = {
    "TRANSLATION_X": (-8.0, -4.0, -2.0, 0.0, 2.0, 4.0, 8.0),
    "TRANSLATION_Y": (-8.0, -4.0, -2.0, 0.0, 2.0, 4.0, 8.0),
    "ROTATION": (-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0),
    "SCALE": (0.90, 0.95, 1.0, 1.05, 1.10),
    "BRIGHTNESS": (0.80, 0.90, 1.0, 1.10, 1.20),
    "CONTRAST": (0.80, 0.90, 1.0, 1.10, 1.20),
    "GAMMA": (0.80, 0.90, 1.0, 1.10, 1.20),
}
PHOTOMETRIC = ("BRIGHTNESS", "CONTRAST", "GAMMA")
IDENTITY = {"TRANSLATION_X": 0.0, "TRANSLATION_Y": 0.0, "ROTATION": 0.0, "SCALE": 1.0, "BRIGHTNESS": 1.0,
            "CONTRAST": 1.0, "GAMMA": 1.0}

CHANGED = StructType([StructField("pixels", ArrayType(IntegerType())), StructField("clipped", LongType())])


def change(values: np.ndarray, family: str, level: float) -> np.ndarray:
    """Unclipped channel values after a photometric change."""
    if family == "BRIGHTNESS":
        return values * level
    if family == "CONTRAST":
        return 127.5 + (values - 127.5) * level
    if family == "GAMMA":
        return 255.0 * (values / 255.0) ** level
    return values


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Clamp to 0..255 and round half up."""
    return np.floor(np.clip(values, 0.0, 255.0) + 0.5).astype(np.int32)


#: Images changed at once; it bounds memory and changes no result.
AT_ONCE = 1 << 10


def _changed(pixels: pa.Array, family: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = pixels.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(pixels.offsets.to_numpy())
    names, amount = np.repeat(family, size), np.repeat(level, size)
    changed = values.copy()
    for number, name in enumerate(PHOTOMETRIC):
        own = names == number
        changed[own] = change(values[own], name, amount[own])
    owner = np.repeat(np.arange(len(pixels)), size)
    clipped = np.bincount(owner, weights=(changed < 0) | (changed > 255), minlength=len(pixels)).astype(np.int64)
    return to_bytes(changed), clipped


@arrow_udf(CHANGED)
def photometric(pixels: pa.Array, family: pa.Array, level: pa.Array) -> pa.Array:
    """Changed channel values of every image and how many of them were clipped."""
    numbers = np.array([PHOTOMETRIC.index(name) if name in PHOTOMETRIC else -1 for name in family.to_pylist()], dtype=np.int8)
    levels = level.to_numpy(zero_copy_only=False)
    parts = [_changed(pixels.slice(low, AT_ONCE), numbers[low:low + AT_ONCE], levels[low:low + AT_ONCE]) for low in range(0, max(len(pixels), 1), AT_ONCE)]
    values, clipped = (np.concatenate(p) for p in zip(*parts))
    offsets = pa.array((pixels.offsets.to_numpy() - pixels.offsets[0].as_py()).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(clipped)], ["pixels", "clipped"])


def luminance_of(rgb: np.ndarray) -> np.ndarray:
    """Integer luminance of (..., 3) sRGB bytes in 16-bit fixed point (fixed weights)."""
    rgb = rgb.astype(np.int64)
    return (19595 * rgb[..., 0] + 38470 * rgb[..., 1] + 7471 * rgb[..., 2] + 32768) >> 16


def mean_square_gradient(tensor: np.ndarray) -> float:
    """Mean squared difference of right and down neighbours over (C, H, W)."""
    dx, dy = np.diff(tensor, axis=2), np.diff(tensor, axis=1)
    return float(((dx * dx).sum() + (dy * dy).sum()) / (dx.size + dy.size))


def gradient_energy(height: int, width: int, channels: int = 1):
    """Arrow UDF: mean squared gradient of a flat (C, H, W) tensor."""

    @arrow_udf(DoubleType())
    def energy(pixels: pa.Array) -> pa.Array:
        return pa.array([mean_square_gradient(np.asarray(v, dtype=np.float64).reshape(channels, height, width))
                         for v in pixels.to_numpy(zero_copy_only=False)], pa.float64())

    return energy
