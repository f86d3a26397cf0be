"""Neighbourhood operators on pixel tables keyed by scene_id, pix_row, pix_col.

Scenes are cut into square tiles with a margin as wide as everything a chain of passes can reach (``tiled``), and the pixels are exchanged once, by tile. All passes then run as
windows along one axis at a time, partitioned by (scene, tile, line): the exchange by tile already holds each line together, so a pass only sorts. A pixel is copied to four tiles at
most, a tile has a fixed number of pixels, and a scene that holds most of the data spreads over the cluster. Pixels of the margin are dropped at the end (``untiled``).

Each operator cuts its input itself; a chain of operators shares one exchange if its input is cut before, with the margins of all operators added up. ``tile=None`` runs an operator
on whole image lines, one exchange per change of axis. Frames are ranges over the coordinate, so missing pixels never shift a neighbourhood.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIX = ["scene_id", "pix_row", "pix_col"]
_AXES = {"row": ("pix_col", "pix_row"), "col": ("pix_row", "pix_col")}

#: Pixels along the side of a tile, without its margin.
TILE = 256
_TILE, _OWN = ["_tile_row", "_tile_col"], "_own"


# --- tiles
def is_tiled(df: DataFrame) -> bool:
    return _OWN in df.columns


def tiled(pixels: DataFrame, margin: int, tile: int = TILE) -> DataFrame:
    """Every pixel in its tile and, within ``margin`` of a border, in the tiles across it; exchanged by tile.

    A tile is at least twice as wide as the margin, so along an axis a pixel is in two tiles at most.
    """
    side = max(tile, 2 * margin)
    wide, home = pixels, []
    for axis, name in zip(("pix_row", "pix_col"), _TILE):
        at, inside = F.floor(F.col(axis) / side), F.pmod(F.col(axis), F.lit(side))
        tiles = F.array(at, F.when(inside < margin, at - 1), F.when(inside >= side - margin, at + 1))
        wide = wide.withColumn(name, F.explode(F.array_compact(tiles)))
        home.append(F.col(name) == at)
    return wide.withColumn(_OWN, home[0] & home[1]).repartition("scene_id", *_TILE)


def untiled(df: DataFrame) -> DataFrame:
    """The pixels of the tiles themselves, each once."""
    return df.where(_OWN).drop(*_TILE, _OWN)


def in_tiles(df: DataFrame, margin: int, tile: int | None, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on tiles with this margin; on the frame as it is when it is cut already or ``tile`` is None."""
    return work(df) if tile is None or is_tiled(df) else untiled(work(tiled(df, margin, tile)))


def _line(df: DataFrame, axis: str):
    fixed, moving = _AXES[axis]
    return Window.partitionBy("scene_id", *(_TILE if is_tiled(df) else []), fixed).orderBy(moving)


def _filled(c: dict[int, Column], half: int, border: str, blank: Column) -> list[Column]:
    """The entries at -half..half, missing ones by the border rule."""
    out = []
    for d in range(-half, half + 1):
        if d == 0 or border == "null":
            out.append(c[d] if d == 0 else F.coalesce(c[d], blank))
        elif border == "zero":
            out.append(F.coalesce(c[d], blank))
        elif border == "edge":
            sign = 1 if d > 0 else -1
            out.append(F.coalesce(*[c[sign * k] for k in range(abs(d), -1, -1)]))
        else:
            sign, reach = (1 if d > 0 else -1), abs(d)
            mirror = c[0]
            # with k pixels left before the edge, offset d reflects to 2k - d
            for k in range(reach - 1, -1, -1):
                mirror = F.when(c[sign * (k + 1)].isNull(), c[sign * (2 * k - reach)]).otherwise(mirror)
            out.append(F.coalesce(c[d], mirror, c[0]))
    return out


def _along(df: DataFrame, values: dict[str, str], axis: str, half: int, border: str, blank: Column) -> DataFrame:
    """Adds, for every output name, the array of its value at offsets -half..half along one axis; all in one pass."""
    line = _line(df, axis)
    names = {out: {d: f"_{out}_{d + half}" for d in range(-half, half + 1)} for out in values}
    at = lambda value, d: F.first(value).over(line.rangeBetween(d, d)) if d else F.col(value)
    wide = df.select("*", *[at(value, d).alias(names[out][d]) for out, value in values.items() for d in names[out]])
    packed = {out: F.array(*_filled({d: F.col(n) for d, n in names[out].items()}, half, border, blank)) for out in values}
    return wide.withColumns(packed).drop(*[n for out in values for n in names[out].values()])


def line_values(df: DataFrame, value: str, axis: str, half: int, border: str, out: str, tile: int | None = TILE) -> DataFrame:
    """Array of the values at offsets -half..half along one axis.

    ``border`` fills missing offsets: ``mirror`` reflects about the edge pixel, ``edge`` repeats it,
    ``zero`` uses 0 and ``null`` leaves NULL.
    """
    blank = F.lit(0.0 if border == "zero" else None).cast("double")
    return in_tiles(df, half, tile, lambda t: _along(t, {out: value}, axis, half, border, blank))


def neighbourhoods(df: DataFrame, values: dict[str, str], half: int = 1, border: str = "mirror", tile: int | None = TILE) -> DataFrame:
    """Row-major arrays of the (2*half+1)^2 values around each pixel, for several columns in the same passes."""
    size = 2 * half + 1
    blank = F.lit(0.0 if border == "zero" else None).cast("double")

    def work(t: DataFrame) -> DataFrame:
        rows = _along(t, {f"_rows_{out}": value for out, value in values.items()}, "row", half, border, blank)
        # second pass over arrays: same fills, applied to whole columns
        cols = _along(rows, {f"_cols_{out}": f"_rows_{out}" for out in values}, "col", half, border, F.array(*[blank] * size))
        flat = {out: F.array(*[F.col(f"_cols_{out}")[j][i] for i in range(size) for j in range(size)]) for out in values}
        return cols.withColumns(flat).drop(*[f"_{axis}_{out}" for out in values for axis in ("rows", "cols")])

    return in_tiles(df, half, tile, work)


def neighbourhood(df: DataFrame, value: str, half: int = 1, border: str = "mirror", out: str = "near", tile: int | None = TILE) -> DataFrame:
    """Row-major array of the (2*half+1)^2 values around each pixel."""
    return neighbourhoods(df, {out: value}, half, border, tile)


# --- kernels (fixed values)
SMOOTH_5 = [0.0625, 0.25, 0.375, 0.25, 0.0625]
SOBEL_SMOOTH, SOBEL_DIFF = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
SCHARR_SMOOTH = [3.0, 10.0, 3.0]
LAPLACE = [0.0, 1.0, 0.0, 1.0, -4.0, 1.0, 0.0, 1.0, 0.0]


def gaussian_weights(sigma: float, half: int) -> list[float]:
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def _dot(values: Column, weights: list[float]) -> Column:
    terms = [values[i] * w for i, w in enumerate(weights) if w]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def separable(df: DataFrame, value: str, row_weights, col_weights, out: str, border: str = "mirror", tile: int | None = TILE) -> DataFrame:
    """Convolve with an outer-product kernel: one window pass per axis."""
    half = len(row_weights) // 2

    def work(t: DataFrame) -> DataFrame:
        first = line_values(t, value, "row", half, border, "_r", None).withColumn("_rv", _dot(F.col("_r"), row_weights)).drop("_r")
        second = line_values(first, "_rv", "col", half, border, "_c", None)
        return second.withColumn(out, _dot(F.col("_c"), col_weights)).drop("_c", "_rv")

    return in_tiles(df, half, tile, work)


def convolve(df: DataFrame, value: str, kernel: list[float], out: str, border: str = "mirror", tile: int | None = TILE) -> DataFrame:
    """Convolve with a square row-major kernel."""
    half = int(math.isqrt(len(kernel))) // 2
    return neighbourhood(df, value, half, border, "_n", tile).withColumn(out, _dot(F.col("_n"), kernel)).drop("_n")


def gradient(df: DataFrame, value: str, method: str = "sobel", border: str = "mirror", tile: int | None = TILE) -> DataFrame:
    """Adds gx, gy and gradient magnitude; one shared neighbourhood for both directions."""
    smooth = SOBEL_SMOOTH if method == "sobel" else SCHARR_SMOOTH
    gx = [s * d for s in smooth for d in SOBEL_DIFF]
    gy = [d * s for d in SOBEL_DIFF for s in smooth]
    n = neighbourhood(df, value, 1, border, "_n", tile)
    n = n.withColumn("gx", _dot(F.col("_n"), gx)).withColumn("gy", _dot(F.col("_n"), gy)).drop("_n")
    return n.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def edges(df: DataFrame, value: str, method: str = "sobel") -> DataFrame:
    """Edge strength by method name: sobel, scharr or laplacian."""
    if method in ("sobel", "scharr"):
        return gradient(df, value, method).withColumnRenamed("magnitude", "edge").drop("gx", "gy")
    if method == "laplacian":
        return convolve(df, value, LAPLACE, "edge")
    raise ValueError(f"unknown edge method {method}")


def unsharp(df: DataFrame, value: str, strength: float = 1.0, sigma: float = 2.0, out: str = "sharp") -> DataFrame:
    half = int(round(sigma * 4))
    w = gaussian_weights(sigma, half)
    blurred = separable(df, value, w, w, "_blur")
    return blurred.withColumn(out, F.col(value) * (1 + strength) - F.col("_blur") * strength).drop("_blur")


def median3(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """3x3 median with zeros outside the image."""
    return neighbourhood(df, value, 1, "zero", "_n").withColumn(out, F.sort_array("_n")[4]).drop("_n")


def bilateral(df: DataFrame, value: str, diameter: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0, out: str = "bilateral"):
    """Edge-preserving smoothing over a disc: weights fall with distance and with value difference."""
    half = diameter // 2
    n = neighbourhood(df, value, half, "mirror", "_n")
    disc = [
        (i, math.exp(-((dr * dr + dc * dc) / (2 * sigma_space * sigma_space))))
        for i, (dr, dc) in enumerate((r, c) for r in range(-half, half + 1) for c in range(-half, half + 1))
        if dr * dr + dc * dc <= half * half
    ]
    picked = F.array(*[F.struct(F.col("_n")[i].alias("v"), F.lit(w).alias("w")) for i, w in disc])
    centre = F.col(value)
    weighed = F.transform(
        picked,
        lambda p: F.struct(
            p["v"].alias("v"),
            (p["w"] * F.exp(-((p["v"] - centre) * (p["v"] - centre)) / (2 * sigma_color * sigma_color))).alias("w"),
        ),
    )
    n = n.withColumn("_w", weighed).drop("_n")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate(
        "_w", zero, lambda a, p: F.struct((a["s"] + p["v"] * p["w"]).alias("s"), (a["w"] + p["w"]).alias("w")),
        lambda a: a["s"] / a["w"],
    )
    return n.withColumn(out, total).drop("_w")


def denoise(df: DataFrame, value: str, method: str = "bilateral", out: str = "clean") -> DataFrame:
    """Noise removal by method name: bilateral, median, gaussian or morphological."""
    if method == "bilateral":
        return bilateral(df, value, out=out)
    if method == "median":
        return median3(df, value, out)
    if method == "gaussian":
        return separable(df, value, SMOOTH_5, SMOOTH_5, out)
    if method == "morphological":
        return morphology(df, value, [("open", 3), ("close", 3)], out)
    raise ValueError(f"unknown noise method {method}")


# --- morphology
def _steps(size: int, grow: bool) -> tuple[int, int]:
    """Offsets of a size-wide element: erosion looks at [-a, b], dilation at the reflection [-b, a]."""
    a = size // 2
    b = size - 1 - a
    return (-b, a) if grow else (-a, b)


def _passes(ops: list[tuple[str, int]]) -> list[tuple[bool, int]]:
    flat: list[tuple[bool, int]] = []
    for op, size in ops:
        flat += {"erode": [(False, size)], "dilate": [(True, size)], "open": [(False, size), (True, size)], "close": [(True, size), (False, size)]}[op]
    return flat


def reach(ops: list[tuple[str, int]]) -> int:
    """How far a chain looks: the margin a tile needs for it."""
    return sum(size // 2 for _, size in _passes(ops))


def morphologies(df: DataFrame, values: dict[str, str], ops: list[tuple[str, int]], tile: int | None = TILE) -> DataFrame:
    """A chain of erode, dilate, open and close steps with square elements, for several columns (output: input) in the same passes.

    The two axes of a step commute, so the axis order alternates: neighbouring passes then run along
    the same axis and share one sort. Pixels outside the image are ignored.
    """

    def work(t: DataFrame) -> DataFrame:
        cur, axes = t.withColumns({out: F.col(value) for out, value in values.items()}), ("row", "col")
        for grow, size in _passes(ops):
            for axis in axes:
                frame = _line(cur, axis).rangeBetween(*_steps(size, grow))
                cur = cur.withColumns({out: (F.max(out) if grow else F.min(out)).over(frame) for out in values})
            axes = axes[::-1]
        return cur

    return in_tiles(df, reach(ops), tile, work)


def morphology(df: DataFrame, value: str, ops: list[tuple[str, int]], out: str = "morph", tile: int | None = TILE) -> DataFrame:
    """``morphologies`` of one column."""
    return morphologies(df, {out: value}, ops, tile)


# --- irregular 3x3 elements (fixed values), row-major
IRREGULAR = ([1, 1, 0, 1, 1, 1, 0, 1, 1], [0, 1, 1, 1, 1, 0, 1, 1, 1], [1, 0, 1, 1, 1, 1, 0, 1, 0])


def irregular_open(df: DataFrame, mask: str, choice: Column, out: str = "opened", tile: int | None = TILE) -> DataFrame:
    """Opening with one of three irregular elements, chosen per row by ``choice`` (0, 1 or 2).

    Rows are the true pixels of one region per ``scene_id`` value, with the image's last row and column
    in ``row_end`` and ``col_end``. A missing neighbour inside the image is false; outside the image it
    is ignored.
    """
    offsets = [(i // 3 - 1, i % 3 - 1) for i in range(9)]

    def outside(dr, dc):
        r, c = F.col("pix_row") + dr, F.col("pix_col") + dc
        return (r < 0) | (c < 0) | (r > F.col("row_end")) | (c > F.col("col_end"))

    def step(frame, value, grow):
        n = neighbourhood(frame, value, 1, "null", "_n", None)
        picked = None
        for k, element in enumerate(IRREGULAR):
            cells = element[::-1] if grow else element
            vals = []
            for i, on in enumerate(cells):
                if on:
                    missing = F.lit(0.0) if grow else F.when(outside(*offsets[i]), 1.0).otherwise(0.0)
                    vals.append(F.coalesce(F.col("_n")[i], missing))
            agg = F.greatest(*vals) if grow else F.least(*vals)
            picked = F.when(choice == k, agg) if picked is None else picked.when(choice == k, agg)
        return n.withColumn(value, picked).drop("_n")

    def work(t: DataFrame) -> DataFrame:
        cur = t.withColumn("_m", F.col(mask).cast("double"))
        cur = step(cur, "_m", False)
        cur = step(cur, "_m", True)
        return cur.withColumn(out, F.col("_m") > 0).drop("_m")

    return in_tiles(df, 2, tile, work)


def fill_gaps(df: DataFrame, values: dict[str, str], gap: int = 5, tile: int | None = TILE) -> DataFrame:
    """Missing pixels in gaps smaller than gap x gap get the 3x3 mean of valid neighbours; all columns (output: input) share one exchange."""

    def work(t: DataFrame) -> DataFrame:
        holes = t.withColumns({f"_hole_{out}": F.col(value).isNull().cast("int") for out, value in values.items()})
        large = morphologies(holes, {f"_large_{out}": f"_hole_{out}" for out in values}, [("open", gap)], None)
        n = neighbourhoods(large, {f"_n_{out}": value for out, value in values.items()}, 1, "null", None)
        new = {}
        for out, value in values.items():
            valid = F.filter(f"_n_{out}", lambda x: x.isNotNull())
            mean = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.size(valid)
            small = (F.col(f"_hole_{out}") == 1) & (F.col(f"_large_{out}") == 0) & (F.size(valid) > 0)
            new[out] = F.when(small, mean).otherwise(F.col(value))
        return n.withColumns(new).drop(*[f"{x}_{out}" for out in values for x in ("_hole", "_large", "_n")])

    return in_tiles(df, reach([("open", gap)]) + 1, tile, work)


def fill_small_gaps(df: DataFrame, value: str, gap: int = 5, out: str = "filled", tile: int | None = TILE) -> DataFrame:
    """``fill_gaps`` of one column."""
    return fill_gaps(df, {out: value}, gap, tile)
