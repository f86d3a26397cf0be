"""Outlines, smallest boxes, rectangles and circles on drawn shapes and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import circles as ci
from terraloom.operators import contours as co
from terraloom.operators import regions as rg
from terraloom.plans import analyses as an

PX = "scene_id long, pix_row int, pix_col int"


def components(pixels):
    left, out = set(pixels), []
    while left:
        stack = [left.pop()]
        own = set(stack)
        while stack:
            r, c = stack.pop()
            for q in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    own.add(q)
                    stack.append(q)
        out.append(own)
    return out


def test_contour_is_the_outer_boundary():
    r = random.Random(2)
    for _ in range(200):
        for own in components((i, j) for i in range(12) for j in range(12) if r.random() < 0.5):
            ring = co.outer_contour(own, min(own))
            outside, stack = {(-1, -1)}, [(-1, -1)]
            while stack:
                a = stack.pop()
                for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                    q = (a[0] + d[0], a[1] + d[1])
                    if -1 <= q[0] <= 12 and -1 <= q[1] <= 12 and q not in own and q not in outside:
                        outside.add(q)
                        stack.append(q)
            assert set(ring) == {q for q in own if any((q[0] + i, q[1] + j) in outside for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
            steps = zip(ring, ring[1:] + ring[:1])
            assert len(own) == 1 or all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in steps)


def test_smallest_box_equals_brute_force():
    r = random.Random(1)
    for _ in range(2000):
        pts = [(r.randint(0, 12), r.randint(0, 12)) for _ in range(r.randint(2, 25))]
        hull = co.convex_hull(*np.array(pts, float).T)
        if len(hull) < 2:
            continue
        areas = []
        for i in range(len(hull)):
            d = hull[(i + 1) % len(hull)] - hull[i]
            d = d / np.hypot(*d)
            u, v = np.array(pts, float) @ d, np.array(pts, float) @ np.array([-d[1], d[0]])
            areas.append((u.max() - u.min()) * (v.max() - v.min()))
        length, width, angle, _, _ = co.smallest_box(hull)
        assert abs(min(areas) - length * width) < 1e-7 and 0 <= angle < 90


def drawn(width, height, degrees, at=(80, 80)):
    a, out = math.radians(degrees), set()
    for t in np.linspace(0, 1, 600):
        for u, v in ((-width + 2 * width * t, -height), (-width + 2 * width * t, height), (-width, -height + 2 * height * t), (width, -height + 2 * height * t)):
            out.add((round(at[0] + u * math.sin(a) + v * math.cos(a)), round(at[1] + u * math.cos(a) - v * math.sin(a))))
    return out


def labelled(spark, shapes):
    rows = [(k, r, c) for k, px in enumerate(shapes) for r, c in px]
    return rg.label_regions(spark.createDataFrame(rows, PX), 8)


def test_rectangles_are_outlines_of_four_corners(spark):
    square = {(r, c) for r in range(5, 17) for c in range(3, 15) if r in (5, 16) or c in (3, 14)}
    line = {(5, c) for c in range(60)} | {(6, c) for c in range(20, 30)}
    ring = {(round(50 + 20 * math.sin(t)), round(50 + 20 * math.cos(t))) for t in np.linspace(0, 2 * math.pi, 1000)}
    small = {(r, c) for r in range(4) for c in range(4)}
    lab = labelled(spark, [square, line, ring, drawn(30, 17, 25), small, {(0, 0)}])
    got = {r.scene_id: r for r in co.rectangles(lab, 36.0, 5000.0).collect()}
    assert set(got) == {0, 3}
    one = got[0]
    assert (one.area_px, one.centre_row, one.centre_col, one.length_px, one.width_px, one.angle_degrees) == (121.0, 10.5, 8.5, 11.0, 11.0, 0.0)
    two = got[3]
    assert abs(two.centre_row - 80) < 0.5 and abs(two.centre_col - 80) < 0.5 and abs(two.length_px - 60) < 2.5 and abs(two.width_px - 34) < 2.5
    assert min(abs(two.angle_degrees - a) for a in (25, 65)) < 2.5


@pytest.mark.parametrize("exact", [40, 200])
def test_large_regions_are_traced_on_cells(spark, exact):
    lab = labelled(spark, [drawn(60, 37, 20, (100, 100))])
    fine, coarse = co.outlines(lab).first(), co.outlines(lab, exact_px=exact).first()
    cell = math.ceil(fine.n_px / exact)
    assert coarse.n_px == fine.n_px and coarse.n_steps < fine.n_steps
    for name in ("centre_row", "centre_col", "length_px", "width_px"):
        assert abs(coarse[name] - fine[name]) <= 2.5 * cell, name


def disc(spark, radius, size, scene=0, level=200.0):
    """A filled disc, whose edge is a circle with the gradient along its radius."""
    y, x = np.mgrid[:size, :size]
    inside = (y - size // 2) ** 2 + (x - size // 2) ** 2 <= radius**2
    return [(scene, int(r), int(c), level if inside[r, c] else 10.0) for r in range(size) for c in range(size)]


LEVEL = "scene_id long, pix_row int, pix_col int, level double"


@pytest.mark.parametrize("radius,size", [(12, 40), (30, 90), (80, 200)])
def test_disc_is_one_circle(spark, radius, size):
    px = spark.createDataFrame(disc(spark, radius, size), LEVEL)
    settings = ci.scene_settings(px, spark.createDataFrame([(0, "other", 60.0, 2000.0)], "scene_id long, zone_type string, min_feature_m double, max_feature_m double"))
    edge = ci.circle_edges(px, settings)
    got = ci.validated_circles(ci.gradient_circles(edge, settings), edge, settings).collect()
    best = max(got, key=lambda r: r.votes)
    assert abs(best.centre_row - size // 2) <= 1 and abs(best.centre_col - size // 2) <= 1 and abs(best.radius - radius) <= 1
    assert best.significance >= 0.7 and 0.85 < best.circularity < 0.95 and best.size_coherence == 1.0
    if radius == 12:  # above 50 hectares a circle is no feature
        kept = ci.circle_features(edge, settings).collect()
        assert [(r.centre_row, r.centre_col, r.radius) for r in kept] == [(best.centre_row, best.centre_col, best.radius)]


def test_radii_come_from_the_zone(spark):
    px = spark.createDataFrame(disc(spark, 30, 90) + disc(spark, 30, 90, 1), LEVEL)
    zones = spark.createDataFrame([(0, "deforested_visible_earthworks", 60, 400), (1, None, 200, 900)], "scene_id long, zone_type string, min_feature_m int, max_feature_m int")
    got = {r.scene_id: r for r in ci.scene_settings(px, zones).collect()}
    assert (got[0].edge_low, got[0].edge_high, got[0].radius_min, got[0].radius_max) == (30.0, 100.0, 3, 20)
    assert (got[1].edge_low, got[1].edge_high, got[1].radius_min, got[1].radius_max) == (40.0, 120.0, 10, 45)
    settings = ci.scene_settings(px, zones)
    assert {r.scene_id for r in ci.gradient_circles(ci.circle_edges(px, settings), settings).collect() if abs(r.radius - 30) <= 1} == {1}


def test_ring_circularity_is_that_of_its_outline(spark):
    got = {r.r: r.c for r in spark.range(3, 40).select(F.col("id").cast("int").alias("r")).withColumn("c", ci.ring_circularity(F.col("r"))).collect()}
    for r, c in got.items():
        end = r + 1
        pixels = {(y, x) for y in range(-end, end + 1) for x in range(-end, end + 1) if x * x + y * y <= end * end}
        ring = np.array(co.outer_contour(pixels, min(pixels)), float)
        area, perimeter, _, _ = co.polygon_measures(ring[:, 1], ring[:, 0])
        assert abs(c - 4 * math.pi * area / perimeter**2) < 1e-9


def test_ring_pixels_are_counted_inside_the_scene(spark):
    circle = spark.createDataFrame([(0, 5, 5, 8, 50, 50)], "scene_id long, centre_row int, centre_col int, radius int, votes long, support long")
    settings = ci.scene_settings(spark.createDataFrame([(0, r, c) for r in (0, 19) for c in (0, 14)], PX))
    edge = {(r, c) for r in range(20) for c in range(15) if (r * 7 + c) % 3 == 0}
    got = ci.validated_circles(circle, spark.createDataFrame([(0, r, c) for r, c in edge], PX), settings).first()
    ring = [(r, c) for r in range(20) for c in range(15) if 49 <= (r - 5) ** 2 + (c - 5) ** 2 <= 81]
    assert got.edge_strength == sum(q in edge for q in ring) / len(ring)


def test_scene_families(spark):
    """A scene with a disc, a turned rectangle and a turned line; all flags are columns."""
    size = 140
    band = np.full((size, size), 0.2)
    y, x = np.mgrid[:size, :size]
    band[(y - 45) ** 2 + (x - 45) ** 2 <= 20**2] = 0.6
    for r, c in drawn(18, 11, 25, (100, 95)):
        band[r, c] = 0.9
    rows = [(0, int(r), int(c), *[0.1] * 3, 0.12, 0.2, float(band[r, c]), 0.25, 0.12) for r in range(size) for c in range(size)]
    px = spark.createDataFrame(rows, "scene_id long, pix_row int, pix_col int, blue double, green double, red double, red_edge_1 double, red_edge_3 double, nir double, swir1 double, swir2 double")
    zones = spark.createDataFrame([(0, "other", 60, 1000, 1)], "scene_id long, zone_type string, min_feature_m int, max_feature_m int, quota long")
    grid = spark.createDataFrame([(0, -60.0, -3.0, 0.0001)], "scene_id long, west double, north double, step_deg double")
    got = an.scene_families(px, zones, grid).collect()
    kinds = {r.det_type for r in got}
    assert "circle" in kinds and all(r.located for r in got)
    disc_found = [r for r in got if r.det_type == "circle" and abs(r.centre_row - 45) <= 1 and abs(r.centre_col - 45) <= 1]
    assert disc_found and abs(disc_found[0].radius_m - 200) <= 15 and abs(disc_found[0].lon - (-60.0 + 45.5 * 0.0001)) < 2e-4
    geometric = [r for r in got if r.det_type in ("circle", "line", "rectangle")]
    assert sum(not r.over_quota for r in geometric) == 1 and sum(r.over_quota for r in geometric) == len(geometric) - 1


def test_large_regions_are_traced_like_small_ones(spark):
    """No size changes the rule, and the inside of a region does not come to the task that traces it."""
    width, height = 320, 200  # more pixels than the former limit of 50 000
    filled = [(0, r, c, 0, 0) for r in range(height) for c in range(width) if not (r < 3 and c > 200)]
    px = spark.createDataFrame(filled, "scene_id long, pix_row int, pix_col int, comp_row int, comp_col int")
    got = co.outlines(px).first()
    ring = np.array(co.outer_contour({(r, c) for _, r, c, _, _ in filled}, (0, 0)), float)
    area, perimeter, cx, cy = co.polygon_measures(ring[:, 1], ring[:, 0])
    assert (got.n_px, got.n_steps) == (len(filled), len(ring))
    assert (got.area_px, got.perimeter_px, got.centre_col, got.centre_row) == pytest.approx((area, perimeter, cx, cy))
    assert (got.length_px, got.width_px, got.angle_degrees) == (width - 1, height - 1, 0.0)
    kept = co._on_border(px.select(*rg.COMP, F.col("pix_row").alias("r"), F.col("pix_col").alias("c")))
    assert kept.count() == len({tuple(p) for p in ring.tolist()}) < 1100


def test_contour_needs_only_the_border():
    r = random.Random(5)
    for _ in range(200):
        for own in components((i, j) for i in range(14) for j in range(14) if r.random() < 0.75):
            border = {(a, b) for a, b in own if not {(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)} <= own}
            assert co.outer_contour(own, min(own)) == co.outer_contour(border, min(own))
