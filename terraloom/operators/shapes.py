"""Edges, straight segments, circles, oriented boxes and gridded terrain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.density import leaders
from terraloom.operators.radiometry import to_8bit
from terraloom.operators.regions import COMP, label_regions
from terraloom.operators.spatial import near_pairs
from terraloom.operators.stencil import PIX, TILE, gaussian_weights, gradient, neighbourhood, separable, tiled, untiled
from terraloom.runtime import cut_lineage, shuffle_partitions


def canny(
    pixels: DataFrame, level: str, low: float | str, high: float | str, blur: float | None = None, keep: list[str] = (), direction: float | None = None, tile: int | None = TILE
) -> DataFrame:
    """Edge pixels: gradient, thinning along the gradient, and hysteresis.

    Hysteresis keeps every 8-connected region of weak-or-better pixels that holds a strong one. The thresholds are numbers or names of columns. With ``blur`` the
    level is first smoothed by a 3x3 Gaussian and rounded. ``keep`` names columns to return with the pixels, gx and gy among them. With ``direction``, the sigma of a wider Gaussian, the pixels
    also get ux and uy, the unit gradient of the level smoothed by it, whose direction is far more exact than that of a 3x3 kernel. The pixels are exchanged once for all passes.
    """
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    wide = 0 if direction is None else round(2 * direction)
    margin = (blur is not None) + max(2, wide + 1 if wide else 0)  # gradient, thinning and the blur look one pixel far each
    made = ["gx", "gy"] + (["ux", "uy"] if wide else [])
    keep = [*keep, *made[2:]]
    carried = [c for c in keep if c not in made] + [c for c in dict.fromkeys((low, high)) if isinstance(c, str) and c not in keep]
    t = pixels.select(*PIX, *carried, F.col(level).cast("double").alias("_v"))
    t = t if tile is None else tiled(t, margin, tile)
    if blur is not None:
        w = gaussian_weights(blur, 1)
        t = separable(t, "_v", w, w, "_v2", tile=None).withColumn("_v", F.floor(F.col("_v2") + 0.5).cast("double")).drop("_v2")
    if wide:
        w = gaussian_weights(direction, wide)
        d = gradient(separable(t, "_v", w, w, "_w", tile=None), "_w", "sobel", border="edge", tile=None)
        unit = lambda c: F.round(F.try_divide(F.col(c), F.col("magnitude")), 9)
        t = d.withColumns({"ux": unit("gx"), "uy": unit("gy")}).drop("_w", "gx", "gy", "magnitude")
    g = gradient(t, "_v", "sobel", border="edge", tile=None).withColumn("mag", F.abs("gx") + F.abs("gy")).drop("_v", "magnitude")
    n = neighbourhood(g, "mag", 1, "zero", "_n", tile=None)
    n = n if tile is None else untiled(n)
    at = lambda r, c: F.col("_n")[(r + 1) * 3 + (c + 1)]
    ax, ay, m = F.abs("gx"), F.abs("gy"), F.col("mag")
    t = math.tan(math.pi / 8)
    flat, steep = ay < ax * t, ay > ax * (t + 2)
    down = (F.col("gx") * F.col("gy")) >= 0
    peak = (
        F.when(flat, (m > at(0, -1)) & (m >= at(0, 1)))
        .when(steep, (m > at(-1, 0)) & (m >= at(1, 0)))
        .when(down, (m > at(-1, -1)) & (m > at(1, 1)))
        .otherwise((m > at(-1, 1)) & (m > at(1, -1)))
    )
    weak = n.where(peak & (m > value(low))).select(*PIX, *keep, (m > value(high)).alias("strong"))
    labelled = label_regions(weak, 8)
    firm = labelled.groupBy(*COMP).agg(F.bool_or("strong").alias("_s")).where("_s").select(*COMP)
    return labelled.join(firm, COMP, "left_semi").select(*PIX, *keep)


def _snap(x):
    """Nearest integer, stable against rounding noise at halves."""
    return F.floor(x + (0.5 + 1e-9)).cast("int")


def straight_segments(edge_px: DataFrame, votes: int = 140, min_length: float = 6.0, max_gap: float = 2.0) -> DataFrame:
    """Segments on lines that enough edge pixels agree on (1 pixel, 1 degree bins).

    Each pixel goes once to each of the lines it may lie on, and a line's pixels come together in order: they are counted, and those of accepted lines cut where
    consecutive pixels are further apart than the gap. A line holds at most one image diagonal. No side of a join is there to be broadcast.
    """
    # few pixels of a scene are edges, and each becomes 180 rows, which their size does not show
    edge_px = cut_lineage(edge_px).repartition(shuffle_partitions(edge_px.sparkSession), *PIX)
    angles = edge_px.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(179))))
    rad = F.radians(F.col("theta").cast("double"))
    rho = _snap(F.col("pix_col") * F.cos(rad) + F.col("pix_row") * F.sin(rad))
    line = ["scene_id", "rho", "theta"]
    voted = angles.withColumn("rho", rho).where("scene_id IS NOT NULL AND rho IS NOT NULL").repartition(shuffle_partitions(edge_px.sparkSession), *line)
    along = F.round(F.col("pix_row") * F.cos(rad) - F.col("pix_col") * F.sin(rad), 6)
    w = Window.partitionBy(*line).orderBy("pos", "pix_row", "pix_col")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    on = voted.withColumn("pos", along).withColumns({"votes": F.count(F.lit(1)).over(whole), "_last": F.lag("pos").over(w)}).where(F.col("votes") >= votes)
    cut = F.coalesce(F.col("pos") - F.col("_last") > max_gap, F.lit(True)).cast("int")
    parts = on.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda f: f(F.struct("pos", "pix_row", "pix_col"))
    seg = parts.groupBy("scene_id", "rho", "theta", "votes", "segment").agg(
        at(F.min).alias("a"), at(F.max).alias("b"), F.count(F.lit(1)).alias("n_px")
    )
    dx, dy = F.col("b.pix_col") - F.col("a.pix_col"), F.col("b.pix_row") - F.col("a.pix_row")
    out = seg.withColumn("length_px", F.sqrt((dx * dx + dy * dy).cast("double"))).where(F.col("length_px") >= min_length)
    angle = F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))
    return out.select(
        "scene_id", "rho", "theta", "votes", "segment", "n_px", F.col("a.pix_col").alias("x1"), F.col("a.pix_row").alias("y1"),
        F.col("b.pix_col").alias("x2"), F.col("b.pix_row").alias("y2"), "length_px", angle.alias("angle_degrees"),
    )


def circle_votes(edge_px: DataFrame, radii: range, min_votes: int, step_deg: int = 10) -> DataFrame:
    """Accumulator over centre and radius: each edge pixel votes for the centres it could lie around."""
    spread = edge_px.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii]))).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step_deg)))
    )
    rad = F.radians(F.col("_a").cast("double"))
    cx = _snap(F.col("pix_col") - F.col("radius") * F.cos(rad))
    cy = _snap(F.col("pix_row") - F.col("radius") * F.sin(rad))
    votes = spread.groupBy("scene_id", cx.alias("cx"), cy.alias("cy"), "radius").agg(F.count(F.lit(1)).alias("votes"))
    return votes.where(F.col("votes") >= min_votes)


def circles(edge_px: DataFrame, radii: range, min_votes: int, min_distance: float) -> DataFrame:
    """Best-voted circles whose centres are at least ``min_distance`` apart, per scene."""
    v = cut_lineage(circle_votes(edge_px, radii, min_votes)).withColumn(
        "key", F.struct((-F.col("votes")).alias("v"), "radius", "cx", "cy", "scene_id")
    )
    pts = v.select("scene_id", "key", F.col("cx").cast("double").alias("lon"), F.col("cy").cast("double").alias("lat"))
    lead = leaders(pts, "key", min_distance, 1, by=["scene_id"]).where("leader = key")
    return v.join(lead.select("key"), "key", "left_semi").drop("key")


def oriented_boxes(region_px: DataFrame) -> DataFrame:
    """Smallest enclosing box per region over one-degree rotations, and how much of it is filled."""
    turned = region_px.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(89))))
    rad = F.radians(F.col("theta").cast("double"))
    u = F.col("pix_col") * F.cos(rad) + F.col("pix_row") * F.sin(rad)
    v = F.col("pix_row") * F.cos(rad) - F.col("pix_col") * F.sin(rad)
    pad = F.cos(rad) + F.sin(rad)  # a pixel is a unit square, not a point
    ext = turned.groupBy(*COMP, "theta").agg(
        (F.max(u) - F.min(u) + F.first(pad)).alias("w"), (F.max(v) - F.min(v) + F.first(pad)).alias("h"),
        F.count(F.lit(1)).alias("n_px"),
    )
    key = F.struct(F.round(F.col("w") * F.col("h"), 6).alias("area"), "theta", "w", "h", "n_px")
    best = ext.groupBy(*COMP).agg(F.min(key).alias("k"))
    w, h = F.col("k.w"), F.col("k.h")
    return best.select(
        *COMP, F.col("k.n_px").alias("n_px"), F.col("k.theta").alias("angle_degrees"), F.greatest(w, h).alias("length_px"),
        F.least(w, h).alias("width_px"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"),
        (F.col("k.n_px") / F.col("k.area")).alias("rectangularity"),
    )


def rectangles(region_px: DataFrame, min_fill: float = 0.8) -> DataFrame:
    return oriented_boxes(region_px).where(F.col("rectangularity") >= min_fill)


def terrain_grid(shots: DataFrame, size: int = 50, sigma: float = 1.0, cell: float = 0.02) -> DataFrame:
    """Regular elevation grid per zone from scattered shots, smoothed.

    Each node is the inverse-distance mean of the shots within two grid steps, found with a distance
    join; nodes without shots take the zone mean.
    """
    valid = shots.where(F.col("elevation_ground").isNotNull()).select("shot_number", "zone_id", "lon", "lat", "elevation_ground")
    ext = valid.groupBy("zone_id").agg(
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        F.avg("elevation_ground").alias("zone_mean"),
    )
    step = lambda a, b: (F.col(b) - F.col(a)) / (size - 1)
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    nodes = (
        ext.withColumn("pix_row", F.explode(axis)).withColumn("pix_col", F.explode(axis))
        .select(
            "zone_id", "pix_row", "pix_col", "zone_mean", (F.col("x0") + F.col("pix_col") * step("x0", "x1")).alias("lon"),
            (F.col("y0") + F.col("pix_row") * step("y0", "y1")).alias("lat"),
            (2 * F.greatest(step("x0", "x1"), step("y0", "y1"))).alias("reach"),
        )
    )
    pairs = near_pairs(valid, nodes, F.col("reach"), "shot_number", "planar", cell=cell).where("a.zone_id = b.zone_id")
    wt = 1 / (F.col("distance") * F.col("distance") + 1e-12)
    near = pairs.groupBy(
        F.col("b.zone_id").alias("zone_id"), F.col("b.pix_row").alias("pix_row"), F.col("b.pix_col").alias("pix_col")
    ).agg((F.sum(F.col("a.elevation_ground") * wt) / F.sum(wt)).alias("z"))
    grid = nodes.join(near, ["zone_id", "pix_row", "pix_col"], "left").select(
        F.col("zone_id").alias("scene_id"), "pix_row", "pix_col", "lon", "lat", F.coalesce("z", "zone_mean").alias("raw")
    )
    w = gaussian_weights(sigma, int(4 * sigma + 0.5))
    return separable(grid, "raw", w, w, "elevation").withColumnRenamed("scene_id", "zone_id")


def detection_level(pixels: DataFrame, band: str = "nir") -> DataFrame:
    """8-bit image the geometric detectors work on: nir when present, else red."""
    use = band if band in pixels.columns else "red"
    return to_8bit(pixels.select(*PIX, use), use).select(*PIX, "level")
