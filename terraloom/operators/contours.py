"""Outlines of pixel regions: ordered outer boundary, polygon approximation, hull and smallest enclosing box.

Regions of every size are traced pixel by pixel, by one rule. Only pixels that lack one of their four neighbours can be on an outline, so only those go to the task that traces a region: of a filled
region of n pixels some 4 * sqrt(n). The task holds some 150 bytes for each, in arrays. A caller that needs a bound on thin regions of many million pixels can ask for larger cells (``exact_px``).
Coordinates are pixel centres, (col, row).
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.regions import COMP
from terraloom.runtime import salted_join, shuffle_partitions

#: Steps to the eight neighbours, clockwise on the screen from east, as (row, col).
_STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
#: A vertex closer to the chord than this share of the perimeter is left out of the approximation.
APPROX = 0.02


def outer_contour(pixels: set[tuple[int, int]], start: tuple[int, int]) -> list[tuple[int, int]]:
    """Boundary pixels (row, col) in clockwise order from ``start``, the first pixel in raster order.

    A pixel passed twice, as on a line, is listed twice. Following keeps the outside on the left hand: after a step the search goes on two directions back.
    """
    points = sorted(pixels)
    row, col = np.array(points, np.int64).T
    return [points[i] for i in contour_positions(row, col, points.index(start))]


def contour_positions(row: np.ndarray, col: np.ndarray, start: int = 0) -> np.ndarray:
    """``outer_contour`` of different pixels that come in raster order, as positions in them. Pixels with all four neighbours may be left out: the search never gets to them."""
    n, wide = len(row), int(col.max() - col.min()) + 3
    key = (row - row[0]) * wide + (col - col.min() + 1)
    beside = np.empty((n, 8), np.int32)  # the position of each neighbour, or -1
    for d, (r, c) in enumerate(_STEPS):
        to = key + (r * wide + c)
        at = np.minimum(np.searchsorted(key, to), n - 1)
        beside[:, d] = np.where(key[at] == to, at, -1)
    beside = memoryview(beside.reshape(-1))
    out, at, look, first = array("i", [start]), start, 5, None
    while True:
        for k in range(8):
            d = (look + k) % 8
            to = beside[8 * at + d]
            if to >= 0:
                break
        else:
            return np.array(out)  # a single pixel
        if at == start and d == first:
            return np.array(out)[:-1]
        first = d if first is None else first
        out.append(to)
        at, look = to, (d + 6) % 8


def polygon_measures(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(area, perimeter, centroid x, centroid y) of a closed polygon; the centroid of a flat one is the mean of its vertices."""
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    area = cross.sum() / 2
    perimeter = np.hypot(nx - x, ny - y).sum()
    if abs(area) < 1e-9:
        return 0.0, float(perimeter), float(x.mean()), float(y.mean())
    return abs(float(area)), float(perimeter), float(((x + nx) * cross).sum() / (6 * area)), float(((y + ny) * cross).sum() / (6 * area))


def approximated(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Positions of the vertices that Douglas-Peucker keeps of a closed polygon.

    The ring is opened at two points far from each other, found by going to the farthest point three times. Of equally far points the first counts.
    """
    n, a, b = len(x), 0, 0
    for _ in range(3):
        a, b = b, int(np.argmax((x - x[b]) ** 2 + (y - y[b]) ** 2))
    if math.hypot(x[a] - x[b], y[a] - y[b]) <= tolerance:
        return [a]
    kept, stack = {a, b}, [(min(a, b), max(a, b)), (max(a, b), min(a, b) + n)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        mid = np.arange(i + 1, j) % n
        ax, ay = x[i % n], y[i % n]
        dx, dy = x[j % n] - ax, y[j % n] - ay
        # distance from the chord times its length, or from the point where the ring meets itself
        far = np.abs((x[mid] - ax) * dy - (y[mid] - ay) * dx) if dx or dy else (x[mid] - ax) ** 2 + (y[mid] - ay) ** 2
        k = int(np.argmax(far))
        if far[k] > (tolerance * math.hypot(dx, dy) if dx or dy else tolerance * tolerance):
            kept.add(int(mid[k]))
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(kept)


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hull vertices (n, 2) in counter-clockwise order, without points on edges."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    turn = x[1:] != x[:-1]
    ends = np.concatenate([[True], turn]) | np.concatenate([turn, [True]])  # of points above each other, the first and the last
    points = sorted(set(zip(x[ends].tolist(), y[ends].tolist())))
    if len(points) < 3:
        return np.array(points, float)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]), float)


def smallest_box(hull: np.ndarray) -> tuple[float, float, float, float, float]:
    """(length, width, angle in degrees from 0 to 90, centre x, centre y) of the smallest enclosing rectangle.

    Rotating calipers: one side lies on a hull edge, and the points that touch the other three sides only move on as the edge turns. Of equal areas the smaller angle counts.
    """
    n = len(hull)
    if n == 1:
        return 0.0, 0.0, 0.0, float(hull[0, 0]), float(hull[0, 1])
    px, py = hull[:, 0].tolist(), hull[:, 1].tolist()
    best = None
    right = top = left = 0
    for i in range(n):
        j = (i + 1) % n
        ex, ey = px[j] - px[i], py[j] - py[i]
        size = math.hypot(ex, ey)
        ux, uy = ex / size, ey / size
        along = lambda k: px[k % n] * ux + py[k % n] * uy
        above = lambda k: py[k % n] * ux - px[k % n] * uy
        right = max(right, j if j > i else i + 1)
        while along(right + 1) > along(right):
            right += 1
        top = max(top, right)
        while above(top + 1) > above(top):
            top += 1
        left = max(left, top)
        while along(left + 1) < along(left):
            left += 1
        u0, u1, v0, v1 = along(left), along(right), above(i), above(top)
        w, h = u1 - u0, v1 - v0
        turn = math.degrees(math.atan2(uy, ux)) % 90.0
        key = (round(w * h, 9), round(turn, 9))
        if best is None or key < best[0]:
            cu, cv = (u0 + u1) / 2, (v0 + v1) / 2
            best = (key, max(w, h), min(w, h), round(turn, 9) % 90.0, cu * ux - cv * uy, cu * uy + cv * ux)
    return best[1:]


_OUTLINE = "n_px long, n_steps long, n_vertices int, area_px double, perimeter_px double, centre_row double, centre_col double, length_px double, width_px double, angle_degrees double"
_NAMES = [c.split()[0] for c in _OUTLINE.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in _OUTLINE.split(", ")]


def _on_border(cells: DataFrame) -> DataFrame:
    """The cells (COMP, r, c, ...) of regions that lack one of their four neighbours; rows are distinct."""
    lacks = lambda same, at: F.coalesce((F.lag(at).over(w(same, at)) != F.col(at) - 1) | (F.lead(at).over(w(same, at)) != F.col(at) + 1), F.lit(True))
    w = lambda same, at: Window.partitionBy(*COMP, same).orderBy(at)
    marked = cells.withColumn("_h", lacks("r", "c")).withColumn("_v", lacks("c", "r"))
    return marked.where("_h OR _v").drop("_h", "_v")


def outlines(region_px: DataFrame, min_px: int = 1, approx: float = APPROX, exact_px: int | None = None) -> DataFrame:
    """One row per region (8-connected, keyed by COMP) of at least ``min_px`` pixels: boundary polygon, vertices of its approximation, smallest box.

    With ``exact_px``, a region of n pixels is traced on square cells of ceil(n / exact_px) pixels instead, which moves its outline by a cell.
    """
    sizes = region_px.groupBy(*COMP).agg(F.count(F.lit(1)).alias("n_px")).where(F.col("n_px") >= min_px)
    sized = salted_join(region_px.select(*COMP, "pix_row", "pix_col"), sizes, COMP, "pix_row")
    cell = F.lit(1) if exact_px is None else F.ceil(F.col("n_px") / exact_px).cast("int")
    cells = _on_border(sized.select(*COMP, "n_px", cell.alias("cell"), F.floor(F.col("pix_row") / cell).alias("r"), F.floor(F.col("pix_col") / cell).alias("c")).distinct())

    def measure(px):
        side = float(px["cell"][0].as_py())
        middle = (side - 1) / 2
        row, col = px["r"].to_numpy(), px["c"].to_numpy()
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        ring = contour_positions(row, col)
        x, y = col[ring] * side + middle, row[ring] * side + middle
        area, perimeter, cx, cy = polygon_measures(x, y)
        vertices = len(approximated(x, y, approx * perimeter))
        length, width, angle, _, _ = smallest_box(convex_hull(x, y))
        found = [px["n_px"][0].as_py(), len(ring), vertices, area, perimeter, cy, cx, length, width, angle]
        return pa.table([px[c][:1] for c in COMP] + [pa.array([v], t) for v, t in zip(found, _TYPES)], [*COMP, *_NAMES])

    keys = ", ".join(f"{c} {region_px.schema[c].dataType.simpleString()}" for c in COMP)
    # few bytes, much work: a number of partitions that follows the sizes would trace all regions in one task
    dealt = cells.repartition(shuffle_partitions(region_px.sparkSession), *COMP)
    return dealt.groupBy(*COMP).applyInArrow(measure, f"{keys}, {_OUTLINE}")


def rectangles(region_px: DataFrame, min_area_px: float, max_area_px: float) -> DataFrame:
    """Regions whose outline is a quadrilateral of an area in range, which rules out lines. The true centre is the polygon's centroid."""
    # the part of a boundary that encloses min_area_px is no shorter than a circle, a step no longer than a diagonal, and a pixel is passed twice at most
    least = math.ceil(math.sqrt(math.pi * min_area_px) / math.sqrt(2))
    found = outlines(region_px, least)
    return found.where((F.col("n_vertices") == 4) & F.col("area_px").between(min_area_px, max_area_px))
