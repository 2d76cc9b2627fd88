"""Bit-packed masks: pixels in row order, the lowest bit of a byte first.

Bit tests, packing and edges are column expressions; resampling and contour walks are numpy and Python,
called on Arrow batches by operators.segmentation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbours clockwise from the right.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))

#: Targets that are resampled at once.
BLOCK = 1 << 14


def pack(bits: Column) -> Column:
    """An array of booleans as an array of bytes (0..255)."""
    count = F.ceil(F.size(bits) / 8).cast("int")
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, k: a + F.when(F.get(bits, b * 8 + k), F.pow(F.lit(2), k).cast("int")).otherwise(0))
    return F.when(F.size(bits) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), byte))


def bit(packed: Column, at: Column) -> Column:
    """Whether pixel at is set in an array of bytes; false outside."""
    byte = F.when(at >= 0, F.get(packed, F.floor(at / 8).cast("int")))
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))


def edge(packed: Column, at: Column, width: int, height: int) -> Column:
    """Whether pixel at is set and on the border, or has an unset pixel beside, above or below."""
    x, y = at % width, F.floor(at / width)
    rim = (x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)
    return bit(packed, at) & (rim | ~bit(packed, at - 1) | ~bit(packed, at + 1) | ~bit(packed, at - width) | ~bit(packed, at + width))


# ---------------------------------------------------------------- numpy


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(mask: bytes, width: int, height: int) -> np.ndarray:
    """Booleans by row; pixels beyond the bytes are unset."""
    bits = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")[: width * height]
    return np.pad(bits, (0, width * height - len(bits))).reshape(height, width).astype(bool)


def _taps(n: int, size: int, scale: float, first: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source cells and weight for n targets from first on. The weight is not clamped before the first cell."""
    at = (first + np.arange(n) + 0.5) * scale - 0.5
    low = np.clip(np.floor(at), 0, size - 1).astype(int)
    return low, np.minimum(low + 1, size - 1), at - low


def _above(cells: np.ndarray, xs: tuple, ys: tuple, least: float) -> np.ndarray:
    """Which targets are above least: resampled along the rows of cells first, then down the columns, a few rows at a time."""
    x0, x1, wx = xs
    y0, _, wy = ys
    across = cells[:, x0] + (cells[:, x1] - cells[:, x0]) * wx
    down = np.vstack([across[1:], across[-1:]]) - across
    out, some = np.empty((len(y0), len(x0)), bool), max(1, BLOCK // max(1, len(x0)))
    for at in range(0, len(y0), some):
        rows = y0[at : at + some]
        np.greater(across[rows] + down[rows] * wy[at : at + some, None], least, out=out[at : at + some])
    return out


def from_prototypes(proto: np.ndarray, weights: np.ndarray, crop: tuple[float, ...], width: int, height: int, least: float) -> bytes:
    """The mask of a box of width x height: prototypes (channels, rows, columns) by weights, above least.

    Without any weight the mask is empty of pixels, even below one half.
    """
    if width <= 0 or height <= 0 or not proto.size:
        return b""
    _, rows, cols = proto.shape
    left, top = int(np.clip(np.trunc(crop[0]), 0, cols - 1)), int(np.clip(np.trunc(crop[1]), 0, rows - 1))
    right, bottom = int(max(left + 1, min(np.trunc(crop[2]), cols))), int(max(top + 1, min(np.trunc(crop[3]), rows)))
    used = np.flatnonzero(weights[: len(proto)])
    if not len(used):
        return packed(np.zeros(width * height, bool))
    part = proto[used, top:bottom, left:right].astype(np.float64)
    cells = (1 / (1 + np.exp(-np.tensordot(weights[used].astype(np.float64), part, 1)))).astype(np.float32)
    if cells.shape == (height, width):
        return packed(cells > least)
    h, w = cells.shape
    x0, x1, wx = _taps(width, w, w / width)
    return packed(_above(cells.astype(np.float64), (x0, x1, wx.astype(np.float32).astype(np.float64)), _taps(height, h, h / height), least))


def from_logits(mask: np.ndarray, box: tuple[float, ...], source: tuple[int, int], model: tuple[int, int], mode: str) -> bytes:
    """The mask of a box out of one map of logits for the whole input: above 0 after cutting the padding off."""
    width, height = int(box[2] - box[0]), int(box[3] - box[1])
    if width <= 0 or height <= 0 or not mask.size:
        return b""
    rows, cols = mask.shape
    left, top, right, bottom = 0, 0, cols, rows
    if mode != "stretch":
        scale = min(model[0] / source[0], model[1] / source[1])
        w, h = int(source[0] * scale), int(source[1] * scale)
        pad_x, pad_y = (model[0] - w) / 2, (model[1] - h) / 2
        near = lambda v, lo, hi: int(min(max(np.floor(v + 0.5), lo), hi))
        left, top = near(pad_x * cols / model[0], 0, cols - 1), near(pad_y * rows / model[1], 0, rows - 1)
        right, bottom = near((pad_x + w) * cols / model[0], left + 1, cols), near((pad_y + h) * rows / model[1], top + 1, rows)
    cells = mask[top:bottom, left:right].astype(np.float64)
    h, w = cells.shape
    return packed(_above(cells, _taps(width, w, w / source[0], box[0]), _taps(height, h, h / source[1], box[1]), 0))


def edge_pixels(bits: np.ndarray) -> np.ndarray:
    """Row-major numbers of the edge pixels. Beside the left and right border neighbours do not matter."""
    framed = np.pad(bits, 1)
    inner = framed[1:-1, :-2] & framed[1:-1, 2:] & framed[:-2, 1:-1] & framed[2:, 1:-1]
    return np.flatnonzero(bits & ~inner)


def contour(edges: np.ndarray, width: int, left: float = 0, top: float = 0) -> list[tuple[float, float]]:
    """All edge pixels, each once, as walks: from the uppermost left pixel on, at each step to the first free
    neighbour clockwise from two directions before the last step's; where none is free, the next walk starts."""
    free = dict.fromkeys(sorted(int(e) for e in edges))
    out = []
    while free:
        at, turn = next(iter(free)), 0
        while True:
            del free[at]
            y, x = divmod(at, width)
            out.append((left + x, top + y))
            for k in range(turn - 2, turn + 6):
                dx, dy = AROUND[k % 8]
                to = at + dy * width + dx
                if 0 <= x + dx < width and to in free:
                    at, turn = to, k % 8
                    break
            else:
                break
    return out
