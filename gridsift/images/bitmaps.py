"""Annotation bitmaps: base64 text, plain or zlib-wrapped PNG, placed on the image's canvas."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_pixels(data: bytes) -> tuple[np.ndarray, bytes | None, bytes | None]:
    """(H, W, C) samples of a non-interlaced 1-, 2-, 4- or 8-bit PNG, its transparency chunk and its palette."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG bitmap")
    at, packed, transparency, palette, header = 8, [], None, None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tRNS":
            transparency = body
        elif kind == b"PLTE":
            palette = body
    width, height, depth, colour, _, _, interlace = header
    if depth > 8 or interlace:
        raise ValueError("unsupported PNG bitmap")
    channels = CHANNELS[colour]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, stride + 1)
    rows = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int64)
    for y in range(height):
        rows[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, step)
        above = rows[y].astype(np.int64)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    return rows.reshape(height, width, channels), transparency, palette


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    out = line.copy()
    for i in range(len(line)):
        left = out[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            corner = above[i - step] if i >= step else 0
            p = left + above[i] - corner
            near = (abs(p - left), abs(p - above[i]), abs(p - corner))
            guess = (left, above[i], corner)[near.index(min(near))]
        out[i] = (out[i] + guess) & 255
    return out


def foreground(data: bytes) -> np.ndarray:
    """Opaque pixels of a bitmap with alpha; non-black pixels of one without."""
    if data[:8] != SIGNATURE:
        data = zlib.decompress(data)
    pixels, transparency, palette = png_pixels(data)
    channels = pixels.shape[2]
    if channels in (2, 4):
        return pixels[..., -1] > 0
    if channels == 1 and transparency:
        alpha = np.full(256, 255, dtype=np.uint8)
        alpha[:len(transparency)] = np.frombuffer(transparency, dtype=np.uint8)
        return alpha[pixels[..., 0]] > 0
    if palette:
        pixels = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)[pixels[..., 0]]
    return (pixels > 0).any(axis=2)


def placed(bitmaps, height: int, width: int) -> np.ndarray:
    """Union of (bytes, x, y) bitmaps on a canvas; one that leaves the canvas is an error."""
    mask = np.zeros((height, width), dtype=bool)
    for data, x, y in bitmaps:
        shape = foreground(data)
        if x < 0 or y < 0 or y + shape.shape[0] > height or x + shape.shape[1] > width:
            raise ValueError("bitmap lies outside the image")
        mask[y:y + shape.shape[0], x:x + shape.shape[1]] |= shape
    return mask
