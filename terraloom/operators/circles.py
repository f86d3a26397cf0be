"""Circles from edge pixels: votes along the gradient, radius by support, statistical validation of the ring.

An edge pixel of a circle has its gradient along the radius, so it votes only for centres on that line, one per radius and direction, over the radii that its scene allows. The direction is that of
the smoothed level (``DIRECTION``), as that of a 3x3 kernel is off by degrees. Centres are cells of ``CELL`` pixels;
the cells with enough votes that are local maxima are candidates, a small table, and edge pixels are counted by their distance from candidates only. Settings come as one row per scene, so that scenes of
different zones run together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import scores as S
from terraloom.operators.density import leaders
from terraloom.operators.shapes import canny
from terraloom.operators.stencil import PIX
from terraloom.runtime import cut_lineage, salted_join

#: Pixels along the side of a cell of the accumulator, and the least votes and support (fixed values).
CELL, VOTES = 1.2, 45
#: Sigma of the smoothing that directions are taken from.
DIRECTION = 2.0
#: Side of the squares by which edge pixels and candidates meet.
MEET = 64
#: Edge thresholds, by zone type and otherwise; sizes of features in metres where a zone gives none (fixed values).
EDGE_VISIBLE, EDGE_OTHER = (30.0, 100.0), (40.0, 120.0)
MIN_FEATURE_M, MAX_FEATURE_M = 60.0, 1000.0
PIXEL_M = 10.0
MAX_AREA_M2, MIN_SIGNIFICANCE = 500_000.0, 0.7
_AT = ["scene_id", "cell_row", "cell_col"]


def scene_settings(pixels: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """One row per scene: extent, edge thresholds and radius range in pixels.

    ``zones`` has (scene_id, zone_type, min_feature_m, max_feature_m); scenes without a row take the defaults. The largest radius is at most half the scene's rows.
    """
    extent = pixels.groupBy("scene_id").agg(F.max("pix_row").alias("row_end"), F.max("pix_col").alias("col_end"))
    if zones is None:
        extent = extent.select("*", F.lit(None).cast("string").alias("zone_type"), F.lit(None).cast("double").alias("min_feature_m"), F.lit(None).cast("double").alias("max_feature_m"))
    else:
        extent = extent.join(zones.select("scene_id", "zone_type", "min_feature_m", "max_feature_m"), "scene_id", "left")
    visible = F.coalesce(F.col("zone_type") == "deforested_visible_earthworks", F.lit(False))
    size = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default))
    low = F.greatest(F.lit(3), F.floor(size("min_feature_m", MIN_FEATURE_M) / (2 * PIXEL_M)).cast("int"))
    high = F.least(F.floor((F.col("row_end") + 1) / 2).cast("int"), F.floor(size("max_feature_m", MAX_FEATURE_M) / (2 * PIXEL_M)).cast("int"))
    return extent.select(
        "scene_id", "row_end", "col_end", F.when(visible, EDGE_VISIBLE[0]).otherwise(EDGE_OTHER[0]).alias("edge_low"),
        F.when(visible, EDGE_VISIBLE[1]).otherwise(EDGE_OTHER[1]).alias("edge_high"), low.alias("radius_min"), high.alias("radius_max"),
        size("min_feature_m", MIN_FEATURE_M).alias("min_size_m"),
    )


def circle_edges(levels: DataFrame, settings: DataFrame) -> DataFrame:
    """Edge pixels (PIX, ux, uy) of the 8-bit level, with the thresholds of each scene."""
    limits = settings.select("scene_id", "edge_low", "edge_high")
    # settings are one row per scene; of pixels, Spark only knows the size of the files they come from, and might broadcast them instead
    return canny(levels.join(F.broadcast(limits), "scene_id"), "level", "edge_low", "edge_high", blur=0.8, direction=DIRECTION)


def gradient_votes(edge_px: DataFrame, settings: DataFrame) -> DataFrame:
    """(scene_id, cell_row, cell_col, radius), a row per vote. ``edge_px`` has PIX and the unit gradient ux, uy."""
    px = edge_px.join(F.broadcast(settings), "scene_id").where("radius_min <= radius_max AND ux IS NOT NULL AND uy IS NOT NULL")
    px = px.select(*PIX, "row_end", "col_end", "radius_min", "radius_max", "ux", "uy")
    spread = px.withColumn("radius", F.explode(F.sequence("radius_min", "radius_max"))).withColumn("_s", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    x = F.col("pix_col") + F.col("_s") * F.col("radius") * F.col("ux")
    y = F.col("pix_row") + F.col("_s") * F.col("radius") * F.col("uy")
    spread = spread.select("scene_id", "radius", x.alias("x"), y.alias("y"), "row_end", "col_end")
    inside = F.col("x").between(0, F.col("col_end")) & F.col("y").between(0, F.col("row_end"))
    return spread.where(inside).select(
        "scene_id", F.floor(F.col("y") / CELL).cast("int").alias("cell_row"), F.floor(F.col("x") / CELL).cast("int").alias("cell_col"), "radius"
    )


def centre_candidates(votes: DataFrame, least: int = VOTES) -> DataFrame:
    """(cell, votes) of the cells with at least ``least`` votes that no neighbour beats; of equal neighbours the first in raster order counts."""
    strong = cut_lineage(votes.groupBy(*_AT).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least))
    sent = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    beside = strong.withColumn("_d", F.explode(sent)).select(
        "scene_id", (F.col("cell_row") + F.col("_d.r")).alias("cell_row"), (F.col("cell_col") + F.col("_d.c")).alias("cell_col"),
        # a neighbour that comes earlier in raster order wins ties
        (F.col("votes") * 2 + F.when(F.col("_d.r") + F.col("_d.c") > 0, 1).otherwise(0)).alias("rival"),
    )
    rival = beside.groupBy(*_AT).agg(F.max("rival").alias("rival"))
    return strong.join(rival.hint("merge"), _AT, "left").where(F.col("votes") * 2 >= F.coalesce("rival", F.lit(0))).drop("rival")


def distance_counts(centres: DataFrame, edge_px: DataFrame, settings: DataFrame) -> DataFrame:
    """(cell, votes, radius_min, radius_max, radius, n): edge pixels at each rounded distance, up to one beyond the scene's radii, from a candidate's centre."""
    own = centres.join(settings.select("scene_id", "radius_min", "radius_max"), "scene_id")
    own = own.withColumns({"_y": (F.col("cell_row") + 0.5) * CELL, "_x": (F.col("cell_col") + 0.5) * CELL})
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("radius_max") - 2) / MEET), F.floor((F.col(c) + F.col("radius_max") + 2) / MEET)))
    squares = own.withColumn("_sr", span("_y")).withColumn("_sc", span("_x"))
    edge = edge_px.select(*PIX, F.floor(F.col("pix_row") / MEET).alias("_sr"), F.floor(F.col("pix_col") / MEET).alias("_sc"))
    met = salted_join(edge, squares, ["scene_id", "_sr", "_sc"], "pix_row", dealt=True)
    dx, dy = F.col("pix_col") - F.col("_x"), F.col("pix_row") - F.col("_y")
    met = met.withColumn("radius", F.floor(F.sqrt(dx * dx + dy * dy) + 0.5).cast("int"))
    met = met.where(F.col("radius").between(F.col("radius_min") - 1, F.col("radius_max") + 1))
    return met.groupBy(*_AT, "votes", "radius_min", "radius_max", "radius").agg(F.count(F.lit(1)).alias("n"))


def gradient_circles(edge_px: DataFrame, settings: DataFrame, least: int = VOTES) -> DataFrame:
    """(scene_id, centre_row, centre_col, radius, votes, support) of the circles.

    The support of a radius counts the edge pixels within one pixel of it; the radius is the one with most of them for its length, those on it counted twice, and needs a support of
    ``least``. Of circles closer than twice the scene's least radius the one with most votes stays.
    """
    centres = cut_lineage(centre_candidates(gradient_votes(edge_px, settings), least))
    counted = distance_counts(centres, edge_px, settings)
    part = lambda step, on: F.struct((F.col("radius") + step).alias("r"), F.col("n").alias("n"), (F.col("n") * on).alias("w"))
    near = counted.withColumn("_p", F.explode(F.array(part(-1, 1), part(0, 2), part(1, 1))))
    support = near.groupBy(*_AT, "votes", "radius_min", "radius_max", F.col("_p.r").alias("radius")).agg(F.sum("_p.n").alias("support"), F.sum("_p.w").alias("weight"))
    support = support.where(F.col("radius").between(F.col("radius_min"), F.col("radius_max")))
    best = support.groupBy(*_AT, "votes", "radius_min").agg(F.min(F.struct((-F.col("weight") / F.col("radius")).alias("s"), "radius", "support")).alias("b"))
    found = best.where(F.col("b.support") >= least).select(
        "scene_id", "cell_row", "cell_col", "votes", "radius_min", F.col("b.radius").alias("radius"), F.col("b.support").alias("support"),
        F.struct((-F.col("votes")).alias("v"), "cell_row", "cell_col", "scene_id").alias("key"),
    )
    found = cut_lineage(found)
    apart = F.lit(CELL) / (2 * F.col("radius_min"))  # in units of the least distance
    points = found.select("scene_id", "key", (F.col("cell_col") * apart).alias("lon"), (F.col("cell_row") * apart).alias("lat"))
    first = leaders(points, "key", 1.0, 1, by=["scene_id"]).where("leader = key").select("key")
    middle = lambda c: F.floor((F.col(c) + 0.5) * CELL + 0.5).cast("int")
    return found.join(first, "key", "left_semi").select("scene_id", middle("cell_row").alias("centre_row"), middle("cell_col").alias("centre_col"), "radius", "votes", "support")


def ring_circularity(radius: Column) -> Column:
    """4 pi A / P**2 of the outline of a drawn ring, whose outer radius is one pixel more.

    The outline runs along the ends of the disc's rows; from one row to the next it takes a diagonal step and as many level ones as the ends are further apart. A follows by Pick's theorem.
    """
    end = radius + 1
    ends = F.transform(F.sequence(-end, end), lambda y: F.floor(F.sqrt((end * end - y * y).cast("double"))))
    moves = F.transform(F.sequence(F.lit(0), 2 * end - 1), lambda i: F.abs(ends[i + 1] - ends[i]))
    total = lambda a, f, zero: F.aggregate(a, F.lit(zero), lambda t, x: t + f(x))
    pixels = total(ends, lambda w: 2.0 * w + 1, 0.0)
    steps = 2 * total(moves, lambda m: F.greatest(m, F.lit(1)).cast("double"), 0.0)
    length = 2 * total(moves, lambda m: F.when(m == 0, 1.0).otherwise(F.sqrt(F.lit(2.0)) + m - 1), 0.0)
    return 4 * F.pi() * (pixels - steps / 2 - 1) / (length * length)


def validated_circles(circles: DataFrame, edge_px: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds edge_strength, size_coherence, circularity and significance.

    The edge strength is the share of edge pixels among the pixels within one pixel of the circle and inside the scene. They are listed row by row, some 13 per pixel of radius, and met with the edge pixels by an equi-join.
    """
    r, y = F.col("radius"), F.col("_y")
    outer = F.floor(F.sqrt(((r + 1) * (r + 1) - y * y).cast("double"))).cast("int")
    inner = F.when(F.abs(y) < r - 1, F.ceil(F.sqrt(((r - 1) * (r - 1) - y * y).cast("double"))).cast("int")).otherwise(0)
    ring = circles.join(settings.select("scene_id", "row_end", "col_end"), "scene_id").withColumn("_y", F.explode(F.sequence(-(r + 1), r + 1)))
    columns = F.when(inner > 0, F.concat(F.sequence(-outer, -inner), F.sequence(inner, outer))).otherwise(F.sequence(-outer, outer))
    ring = ring.withColumn("_x", F.explode(columns)).select(
        *circles.columns, "row_end", "col_end", (F.col("centre_row") + F.col("_y")).alias("pix_row"), (F.col("centre_col") + F.col("_x")).alias("pix_col")
    )
    ring = ring.where(F.col("pix_row").between(0, F.col("row_end")) & F.col("pix_col").between(0, F.col("col_end"))).drop("row_end", "col_end")
    hits = ring.join(edge_px.select(*PIX, F.lit(1).alias("_e")).hint("merge"), PIX, "left")
    strength = hits.groupBy(*circles.columns).agg((F.count("_e") / F.count(F.lit(1))).alias("edge_strength"))
    metres = r * PIXEL_M
    out = strength.withColumn("size_coherence", F.when(metres >= 60, F.least(F.lit(1.0), metres / 100)).otherwise(0.5)).withColumn("circularity", ring_circularity(r))
    return out.withColumn("significance", S.circle_confidence(F.col("edge_strength"), metres, F.col("circularity")))


def circle_features(edge_px: DataFrame, settings: DataFrame, least: int = VOTES, significance: float = MIN_SIGNIFICANCE) -> DataFrame:
    """Validated circles that are significant and of at most 50 hectares."""
    found = validated_circles(gradient_circles(edge_px, settings, least), edge_px, settings)
    metres = F.col("radius") * PIXEL_M
    return found.where((F.col("significance") >= significance) & (F.pi() * metres * metres <= MAX_AREA_M2))
