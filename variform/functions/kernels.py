"""Vectorised distance kernels used inside Arrow tasks.

A block of items is a float matrix with NaN where a feature value is missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# WGS-84 ellipsoid (fixed values)
EARTH_RADIUS_KM = 6378.137
EARTH_FLATTENING = 1 / 298.257223563


def matrix(column) -> np.ndarray:
    """Arrow list column to a 2-D float matrix; null elements become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if rows == 0:
        return np.empty((0, 0))
    width, rest = divmod(len(flat), rows)
    if rest or column.null_count:
        raise ValueError("every item needs a vector of the same length")
    return flat.reshape(rows, width)


def euclidean_block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Missing-aware Euclidean distances of two blocks.

    Squares over shared positions are scaled by (positions / shared positions); a pair that
    shares nothing is at distance 0.
    """
    width = left.shape[1]
    lmask, rmask = ~np.isnan(left), ~np.isnan(right)
    complete = lmask.all() and rmask.all()
    x, y = (left, right) if complete else (np.where(lmask, left, 0.0), np.where(rmask, right, 0.0))
    if complete:
        norms = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    else:
        lm, rm = lmask.astype(float), rmask.astype(float)
        norms = (x * x) @ rm.T + lm @ (y * y).T
    squares = norms - 2.0 * (x @ y.T)
    # the expanded square loses digits when two items nearly coincide: redo those directly
    close = np.argwhere(squares < 1e-5 * norms)
    for start in range(0, len(close), 65536):
        i, j = close[start : start + 65536].T
        diff = left[i] - right[j]
        squares[i, j] = np.nansum(diff * diff, axis=1)
    np.maximum(squares, 0.0, out=squares)
    if not complete:
        shared = lm @ rm.T
        squares = np.divide(squares * width, shared, out=np.zeros_like(squares), where=shared > 0)
    return np.sqrt(squares)


def euclidean_point(items: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Missing-aware Euclidean distance of every item to one point, by direct differences."""
    diff = items - point
    squares = diff * diff
    missing = np.isnan(squares)
    if not missing.any():
        return np.sqrt(squares.sum(axis=1))
    shared = squares.shape[1] - missing.sum(axis=1)
    total = np.where(missing, 0.0, squares).sum(axis=1) * squares.shape[1]
    return np.sqrt(np.divide(total, shared, out=np.zeros_like(total), where=shared > 0))


def geodesic_block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Kilometres between (latitude, longitude) rows; 0 where a coordinate is missing."""
    f = EARTH_FLATTENING
    lat1, lon1 = np.radians(left[:, 0])[:, None], np.radians(left[:, 1])[:, None]
    lat2, lon2 = np.radians(right[:, 0])[None, :], np.radians(right[:, 1])[None, :]
    b1, b2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    h = np.sin((b2 - b1) / 2) ** 2 + np.cos(b1) * np.cos(b2) * np.sin((lon2 - lon1) / 2) ** 2
    h = np.clip(h, 0.0, 1.0)
    s = 2 * np.arcsin(np.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (s - np.sin(s)) * np.sin(p) ** 2 * np.cos(q) ** 2 / np.cos(s / 2) ** 2
        y = (s + np.sin(s)) * np.cos(p) ** 2 * np.sin(q) ** 2 / np.sin(s / 2) ** 2
        km = EARTH_RADIUS_KM * (s - f / 2 * (x + y))
    km = np.where(h > 1 - 1e-6, EARTH_RADIUS_KM * s, km)
    return np.nan_to_num(np.where(h == 0, 0.0, km), nan=0.0)


def geodesic_point(items: np.ndarray, point: np.ndarray) -> np.ndarray:
    return geodesic_block(items, point[None, :])[:, 0]


BLOCK_METRICS = {"euclidean": euclidean_block, "geodesic": geodesic_block}
POINT_METRICS = {"euclidean": euclidean_point, "geodesic": geodesic_point}


#: Pair weights are split in parts of so many bits, so that sums over a tile stay whole numbers in floating point.
WEIGHT_BITS = 20


def weight_parts(left: np.ndarray, right: np.ndarray, diagonal: bool) -> list[tuple[int, np.ndarray]]:
    """Item pairs behind each cell of two blocks of whole weights, as ``(shift, part)`` that add up to them exactly.

    On the diagonal each unordered pair counts once, pairs of copies included.
    """
    low = (1 << 30) - 1

    def products(a: np.ndarray, b: np.ndarray):
        a, b = a.astype(np.int64), b.astype(np.int64)
        yield 0, (a & low) * (b & low)
        if max(a.max(initial=0), b.max(initial=0)) > low:
            yield 30, (a >> 30) * (b & low)
            yield 30, (a & low) * (b >> 30)
            yield 60, (a >> 30) * (b >> 30)

    found = [(shift, np.triu(part, 1) if diagonal else part) for shift, part in products(left[:, None], right[None, :])]
    if diagonal:
        even = left.astype(np.int64) % 2 == 0
        copies = products(np.where(even, left // 2, left), np.where(even, left - 1, (left - 1) // 2))
        found += [(shift, np.diag(part)) for shift, part in copies]
    parts: dict[int, np.ndarray] = {}
    for shift, part in found:
        while part.any():
            bits = part & ((1 << WEIGHT_BITS) - 1)
            # parts of one shift are few, so their sum stays small
            parts[shift] = parts.get(shift, 0) + bits
            part, shift = part >> WEIGHT_BITS, shift + WEIGHT_BITS
    return [(shift, part.astype(float)) for shift, part in parts.items()]


def overlap_counts(left: np.ndarray, right: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> list[tuple[str, int, int, int]]:
    """``(mode, shared, equal, pairs)``: the running value overlap of two blocks, for every way of averaging it.

    Walks the features in their declared order keeping, per pair, the running count of equal values and of shared
    positions. Ratios are not added up: those over the same number of shared positions add their numerators, which
    are whole numbers, so neither the order of pairs nor that of blocks changes a result.
    """
    width = left.shape[1]
    shape = (left.shape[0], right.shape[0])
    same, total = np.zeros(shape), np.zeros(shape, dtype=np.int64)
    # per part: numerators and weights by (both present here, shared so far)
    sums = np.zeros((len(parts), 2, 2 * (width + 1)), dtype=np.int64)
    for position in range(width):
        a, b = left[:, position][:, None], right[:, position][None, :]
        both = ~(np.isnan(a) | np.isnan(b))
        same += a == b
        total += both
        cell = (total + both * (width + 1)).ravel()
        for k, (_, part) in enumerate(parts):
            sums[k, 0] += np.bincount(cell, (part * same).ravel(), 2 * (width + 1)).astype(np.int64)
            sums[k, 1] += np.bincount(cell, part.ravel(), 2 * (width + 1)).astype(np.int64)
    modes = {"every_position": sums[:, :, : width + 1] + sums[:, :, width + 1 :], "shared_positions": sums[:, :, width + 1 :]}
    last = np.zeros((len(parts), 2, width + 1), dtype=np.int64)
    for k, (_, part) in enumerate(parts):
        last[k, 0] = np.bincount(total.ravel(), (part * same).ravel(), width + 1).astype(np.int64)
        last[k, 1] = np.bincount(total.ravel(), part.ravel(), width + 1).astype(np.int64)
    modes["pair_mean"] = last
    found = []
    for mode, by in modes.items():
        for shared in range(1, width + 1):
            equal, pairs = (sum(int(by[k, c, shared]) << shift for k, (shift, _) in enumerate(parts)) for c in (0, 1))
            if pairs:
                found.append((mode, shared, equal, pairs))
    return found
