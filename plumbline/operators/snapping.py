"""The nearest of many segments to each of many points, one tile of the map at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Rows and columns of a tile's grid while points may lie anywhere within reach, and once near ones are known.
COARSE, FINE = 32, 128
#: One segment in so many is looked at first, for a bound of each point's distance.
FIRST = 64
PAIRS = 500_000
#: What a distance in the plane may be off from the sphere's and its rounding: a share of it, and degrees.
SHARE, SLACK = 1e-3, 2e-8


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of each range, all in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Tile:
    """Points (y, x) and segments in a square of ``side`` degrees at (south, west); ``best`` is the least distance in the plane found for each point."""

    def __init__(self, y: np.ndarray, x: np.ndarray, wide: np.ndarray, south: float, west: float, side: float, up: float) -> None:
        self.y, self.x, self.south, self.west, self.side, self.up = y, x, south, west, side, up
        self.shrink = np.cos(np.radians(y))
        self.stretch = wide / up
        self.best = np.full(len(y), 1.1 * up)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(self, some: np.ndarray, segments: np.ndarray, ids: np.ndarray, reach: float, grid: int) -> None:
        """Meets the points ``some`` with the segments (y1, x1, y2, x2) that come within ``reach`` degrees; each point lies in all cells of its box."""
        if not len(some) or not len(segments):
            return
        step = self.side / grid
        at = lambda v, low: np.clip(np.floor((v - low) / step), -1, grid).astype(np.int64)
        pad = reach * 1.001
        rows = [np.clip(at(self.y[some] + s * pad, self.south), 0, grid - 1) for s in (-1, 1)]
        columns = [np.clip(at(self.x[some] + s * pad * self.stretch[some], self.west), 0, grid - 1) for s in (-1, 1)]
        high, across = rows[1] - rows[0] + 1, columns[1] - columns[0] + 1
        owner = np.repeat(np.arange(len(some)), high)
        row = _ranges(rows[0], high)
        cells = _ranges(row * grid + columns[0][owner], across[owner])
        owner = np.repeat(owner, across[owner])
        order = np.argsort(cells, kind="stable")
        held = some[owner[order]]
        starts = np.searchsorted(cells[order], np.arange(grid * grid + 1))
        lines = self.south + step * np.arange(grid)
        for i in range(0, len(segments), 262_144 // grid):
            y1, x1, y2, x2 = (v[:, None] for v in segments[i : i + 262_144 // grid].T)
            low, top = np.minimum(y1, y2), np.maximum(y1, y2)
            a, b = np.maximum(low, lines), np.minimum(top, lines + step)
            flat = y1 == y2
            slope = np.where(flat, 0.0, (x2 - x1) / np.where(flat, 1.0, y2 - y1))
            xa, xb = np.where(flat, x1, x1 + slope * (a - y1)), np.where(flat, x2, x1 + slope * (b - y1))
            # A hair wider, so that rounding leaves out no cell.
            ca, cb = at(np.minimum(xa, xb) - step * 1e-6, self.west), at(np.maximum(xa, xb) + step * 1e-6, self.west)
            of, line = np.nonzero((a <= b + step * 1e-6) & (cb >= 0) & (ca < grid))
            first = starts[line * grid + np.maximum(ca[of, line], 0)]
            sizes = starts[line * grid + np.minimum(cb[of, line], grid - 1) + 1] - first
            of, first, sizes = of[sizes > 0] + i, first[sizes > 0], sizes[sizes > 0]
            if not len(sizes):
                continue
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()), PAIRS))
            for j, k in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                self._met(held[_ranges(first[j:k], sizes[j:k])], np.repeat(of[j:k], sizes[j:k]), segments, ids)

    def _met(self, p: np.ndarray, e: np.ndarray, segments: np.ndarray, ids: np.ndarray) -> None:
        y1, x1, y2, x2 = segments[e].T
        shrink = self.shrink[p]
        ax, ay, dx, dy = (x1 - self.x[p]) * shrink, y1 - self.y[p], (x2 - x1) * shrink, y2 - y1
        square = dx * dx + dy * dy
        t = np.clip(-(ax * dx + ay * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
        d = np.hypot(ax + t * dx, ay + t * dy)
        near = np.flatnonzero(d <= self.best[p] * (1 + SHARE) + SLACK)
        np.minimum.at(self.best, p[near], d[near])
        near = near[d[near] <= self.best[p[near]] * (1 + SHARE) + SLACK]
        self.found.append((p[near], ids[e[near]], d[near]))

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """(point, segment) of all that may be the nearest."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, e, d = (np.concatenate(v) for v in zip(*self.found, strict=True))
        near = d <= self.best[p] * (1 + SHARE) + SLACK
        pairs = np.unique(np.stack([p[near], e[near]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def candidates(points: pd.DataFrame, segments: pd.DataFrame, side: float, up: float) -> pd.DataFrame:
    """(lat, lng, edge_id, y1, x1, y2, x2) of the segments of a tile that may be nearest to a point (lat, lng, wide), within ``up`` degrees."""
    if not len(points) or not len(segments):
        return pd.DataFrame({c: [] for c in ("lat", "lng", "edge_id", "y1", "x1", "y2", "x2")})
    ty, tx = int(points["ty"].iloc[0]), int(points["tx"].iloc[0])
    tile = Tile(points["lat"].to_numpy(), (points["lng"] - 360.0 * points["turn"]).to_numpy(), points["wide"].to_numpy(), ty * side, tx * side, side, up)
    by = 360.0 * segments["turn"].to_numpy()
    ends = np.stack([segments["y1"], segments["x1"] - by, segments["y2"], segments["x2"] - by], axis=1)
    ids, every = np.arange(len(ends)), np.arange(len(points))
    ahead = ids % FIRST == 0
    tile.visit(every, ends[ahead], ids[ahead], up, COARSE)
    close = tile.best <= up * COARSE / FINE
    if close.any():
        tile.visit(every[close], ends[~ahead], ids[~ahead], float(tile.best[close].max()) * (1 + 2 * SHARE) + 2 * SLACK, FINE)
    tile.visit(every[~close], ends[~ahead], ids[~ahead], up, COARSE)
    p, e = tile.nearest()
    own = segments[["edge_id", "y1", "x1", "y2", "x2"]].iloc[e].reset_index(drop=True)
    return pd.concat([points[["lat", "lng"]].iloc[p].reset_index(drop=True), own], axis=1)
