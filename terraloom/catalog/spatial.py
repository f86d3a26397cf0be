"""Queries over joins: E1-E15, the filters that sample pixels (D21-D23), and pair rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.coordinates import MOVED, hav
from terraloom.catalog.registry import query
from terraloom.operators import coordinates as co
from terraloom.operators import reference_areas as ra
from terraloom.operators import shape_filters as sf
from terraloom.operators import spatial as sp

PAIRS = f"""pr AS (SELECT s.det_id AS id1, g.det_id AS id2, {hav('s.lon', 's.lat', 'g.lon', 'g.lat')} AS d,
  (coalesce(s.confidence, 0) + coalesce(g.confidence, 0)) / 2 AS comb
  FROM detections s JOIN detections g ON s.provider = 'sentinel2' AND g.provider = 'gedi' AND abs(s.lat - g.lat) < 0.02E0 AND abs(s.lon - g.lon) < 0.02E0),
  e1 AS (SELECT id1, id2, d, 1 - d / 1500 AS strength, comb FROM pr WHERE d <= 1500)"""


@query(
    "e01_cross_provider_pairs",
    f"{PAIRS} SELECT id1, id2, round(d, 5) AS distance_m, round(strength, 8) AS strength, round(comb, 9) AS combined_confidence FROM e1",
)
def _(v):
    return sp.provider_pairs(v.detections).select(
        F.col("a.det_id").alias("id1"), F.col("b.det_id").alias("id2"), F.round("distance_m", 5).alias("distance_m"),
        F.round("strength", 8).alias("strength"), F.round("combined_confidence", 9).alias("combined_confidence"),
    )


@query(
    "e01_convergence_per_detection",
    f"""{PAIRS}, b AS (SELECT det_id, max(strength) AS s FROM (SELECT id1 AS det_id, strength FROM e1 UNION ALL SELECT id2, strength FROM e1) u GROUP BY det_id)
    SELECT d.det_id, round(coalesce(s, 0), 8) AS convergence_score, provider = 'gedi' OR s IS NOT NULL AS lidar_support, provider = 'sentinel2' OR s IS NOT NULL AS spectral_support
    FROM detections d LEFT JOIN b ON b.det_id = d.det_id""",
)
def _(v):
    out = sp.convergence_per_detection(v.detections)
    return out.select("det_id", F.round("convergence_score", 8).alias("convergence_score"), "lidar_support", "spectral_support")


SIG = "({a}.det_type LIKE '%terra\\_preta%' ESCAPE '\\' OR {a}.det_type LIKE '%geometric%' OR {a}.det_type LIKE '%crop\\_mark%' ESCAPE '\\')"
S1, S2 = SIG.format(a="s"), SIG.format(a="g")
PAIR_SCORE = f"""CASE WHEN dd <= 0.0005E0 THEN 3 WHEN dd <= 0.001E0 THEN 2.5E0 WHEN dd <= 0.002E0 THEN 2 WHEN dd <= 0.005E0 THEN 1 ELSE 0.5E0 END
  + CASE WHEN m >= 0.9E0 AND gap <= 0.1E0 THEN 3 WHEN m >= 0.8E0 AND gap <= 0.2E0 THEN 2.5E0 WHEN m >= 0.7E0 AND gap <= 0.3E0 THEN 2 WHEN m >= 0.6E0 THEN 1 ELSE 0.5E0 END
  + 3 + sig + CASE WHEN area >= 50000 THEN 0.5E0 WHEN area >= 10000 THEN 0.3E0 ELSE 0 END
  + CASE WHEN g1 = 'high' AND g2 = 'high' THEN 3 WHEN g1 = 'high' OR g2 = 'high' THEN 2.5E0 WHEN g1 = 'medium' AND g2 = 'medium' THEN 2 WHEN g1 = 'medium' OR g2 = 'medium' THEN 1.5E0 ELSE 1 END"""
SCORED = f"""pp AS (SELECT s.det_id AS id1, g.det_id AS id2, s.zone_id, sqrt((s.lon - g.lon) * (s.lon - g.lon) + (s.lat - g.lat) * (s.lat - g.lat)) AS dd,
    (coalesce(s.confidence, 0) + coalesce(g.confidence, 0)) / 2 AS m, abs(coalesce(s.confidence, 0) - coalesce(g.confidence, 0)) AS gap,
    CASE WHEN {S1} AND {S2} THEN 3 WHEN {S1} OR {S2} THEN 2 ELSE 1 END AS sig, greatest(s.area_m2, g.area_m2) AS area, s.grade AS g1, g.grade AS g2,
    s.det_type || '+' || g.det_type AS det_type, (s.lon + g.lon) / 2 AS lon, (s.lat + g.lat) / 2 AS lat
  FROM detections s JOIN detections g ON s.provider = 'sentinel2' AND g.provider = 'gedi' AND abs(s.lat - g.lat) < 0.006E0 AND abs(s.lon - g.lon) < 0.006E0),
  e2 AS (SELECT *, {PAIR_SCORE} AS score FROM pp WHERE dd <= 0.005E0)"""
SUPPORT = """bs AS (SELECT det_id, max(score) AS score FROM (SELECT id1 AS det_id, score FROM e2 UNION ALL SELECT id2, score FROM e2) u GROUP BY det_id),
  bd AS (SELECT bs.det_id, min(e2.dd) AS dd FROM bs JOIN e2 ON (e2.id1 = bs.det_id OR e2.id2 = bs.det_id) AND e2.score = bs.score GROUP BY bs.det_id),
  bm AS (SELECT bs.det_id, any_value(bs.score) AS score, any_value(bd.dd) AS dd, max(e2.m) AS m FROM bs JOIN bd ON bd.det_id = bs.det_id
    JOIN e2 ON (e2.id1 = bs.det_id OR e2.id2 = bs.det_id) AND e2.score = bs.score AND e2.dd = bd.dd GROUP BY bs.det_id),
  su AS (SELECT d.*, coalesce(bm.score, 0) AS convergent_score, bm.dd * 111000 AS convergence_distance_m, bm.m AS combined_confidence,
    bm.det_id IS NOT NULL AND provider <> 'gedi' AS lidar_support, bm.det_id IS NOT NULL AND provider <> 'sentinel2' AS spectral_support
    FROM detections d LEFT JOIN bm ON bm.det_id = d.det_id)"""


@query(
    "e02_scored_pairs",
    f"{SCORED} SELECT id1, id2, round(dd, 9) AS distance_deg, round(score, 6) AS score FROM e2",
)
def _(v):
    return sp.scored_pairs(v.detections).select(
        F.col("a.det_id").alias("id1"), F.col("b.det_id").alias("id2"), F.round("distance", 9).alias("distance_deg"), F.round("score", 6).alias("score")
    )


# The pair score has its own entry in the inventory; the query checks its parts on every pair.
query("j12_pair_score", f"{SCORED} SELECT id1, id2, round(score, 6) AS score FROM e2")(
    lambda v: sp.scored_pairs(v.detections).select(
        F.col("a.det_id").alias("id1"), F.col("b.det_id").alias("id2"), F.round("score", 6).alias("score")
    )
)


@query(
    "e02_pair_support",
    f"""{SCORED}, {SUPPORT} SELECT det_id, round(convergent_score, 6) AS convergent_score, round(convergence_distance_m, 4) AS convergence_distance_m,
    round(combined_confidence, 9) AS combined_confidence, lidar_support, spectral_support FROM su""",
)
def _(v):
    out = sp.with_pair_support(v.detections, sp.scored_pairs(v.detections))
    return out.select(
        "det_id", F.round("convergent_score", 6).alias("convergent_score"), F.round("convergence_distance_m", 4).alias("convergence_distance_m"),
        F.round("combined_confidence", 9).alias("combined_confidence"), "lidar_support", "spectral_support",
    )


@query(
    "e02_midpoint_rows",
    f"""{SCORED} SELECT id1 AS source_a, id2 AS source_b, det_type, round(lon, 9) AS lon, round(lat, 9) AS lat, round(m, 9) AS confidence, area AS area_m2,
    round(score, 6) AS convergent_score FROM e2 WHERE score >= 8""",
)
def _(v):
    return sp.midpoint_rows(sp.scored_pairs(v.detections)).select(
        "source_a", "source_b", "det_type", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"),
        F.round("confidence", 9).alias("confidence"), "area_m2", F.round("convergent_score", 6).alias("convergent_score"),
    )


FIRST = """m AS (SELECT s.det_id, g.det_id AS lidar_id, sqrt((s.lon - g.lon) * (s.lon - g.lon) + (s.lat - g.lat) * (s.lat - g.lat)) * 111000 AS metres,
    coalesce(s.confidence, 0.5E0) AS sc, least(0.9E0, g.n_points / 20.0E0) AS lc FROM detections s JOIN detections g
    ON s.provider = 'sentinel2' AND g.provider = 'gedi' AND abs(s.lat - g.lat) < 0.02E0 AND abs(s.lon - g.lon) < 0.02E0),
  k AS (SELECT * FROM m WHERE metres <= 1500),
  f1 AS (SELECT det_id, min(lidar_id) AS lidar_id FROM k WHERE sc >= 0.6E0 AND lc >= 0.15E0 GROUP BY det_id ORDER BY det_id LIMIT 5),
  f2 AS (SELECT det_id, min(lidar_id) AS lidar_id FROM k WHERE sc >= 0.7E0 AND lc >= 0.2E0 AND det_id > (SELECT CASE WHEN count(*) = 5 THEN max(det_id) END FROM f1) GROUP BY det_id ORDER BY det_id LIMIT 15),
  f3 AS (SELECT det_id, min(lidar_id) AS lidar_id FROM k WHERE sc >= 0.8E0 AND lc >= 0.3E0 AND det_id > (SELECT CASE WHEN count(*) = 15 THEN max(det_id) END FROM f2) GROUP BY det_id),
  h AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),
  e3 AS (SELECT h.det_id, h.lidar_id, k.metres AS d, (k.sc + k.lc) / 2 AS c, 'multi_sensor' AS convergence_type FROM h JOIN k ON k.det_id = h.det_id AND k.lidar_id = h.lidar_id
    UNION ALL SELECT det_id, NULL, NULL, NULL, 'sentinel2_only' FROM detections WHERE provider = 'sentinel2' AND coalesce(confidence, 0) >= 0.5E0 AND det_id NOT IN (SELECT det_id FROM h)
    UNION ALL SELECT det_id, NULL, NULL, NULL, 'gedi_only' FROM detections WHERE provider = 'gedi' AND coalesce(confidence, 0) >= 0.5E0 AND det_id NOT IN (SELECT lidar_id FROM h))"""


@query(
    "e03_first_match_adaptive",
    f"{FIRST} SELECT det_id, lidar_id, round(d, 4) AS convergence_distance_m, round(c, 9) AS combined_confidence, convergence_type FROM e3",
)
def _(v):
    return sp.first_match(v.detections).select(
        "det_id", "lidar_id", F.round("convergence_distance_m", 4).alias("convergence_distance_m"),
        F.round("combined_confidence", 9).alias("combined_confidence"), "convergence_type",
    )


@query(
    "e03_match_tiers",
    f"""{FIRST}, t3 AS (SELECT det_id, min(lidar_id) AS l FROM k WHERE sc >= 0.8E0 AND lc >= 0.3E0 GROUP BY det_id), t2 AS (SELECT det_id, min(lidar_id) AS l FROM k WHERE sc >= 0.7E0 AND lc >= 0.2E0 GROUP BY det_id),
    t1 AS (SELECT det_id, min(lidar_id) AS l FROM k WHERE sc >= 0.6E0 AND lc >= 0.15E0 GROUP BY det_id)
    SELECT d.det_id, CASE WHEN t3.l IS NOT NULL THEN 3 WHEN t2.l IS NOT NULL THEN 2 WHEN t1.l IS NOT NULL THEN 1 ELSE 0 END AS tier, coalesce(t3.l, t2.l, t1.l) AS lidar_id
    FROM detections d LEFT JOIN t1 ON t1.det_id = d.det_id LEFT JOIN t2 ON t2.det_id = d.det_id LEFT JOIN t3 ON t3.det_id = d.det_id WHERE provider = 'sentinel2'""",
)
def _(v):
    return sp.match_tiers(v.detections)


AREA_VALUES = ", ".join(
    f"('{n}', {lat}E0, {lon}E0, {r}E0, '{t}', {c}E0, {str(k).lower()})" for n, lat, lon, r, t, c, k in ra.REFERENCE_AREAS
)
AREAS = f"ar AS (SELECT * FROM (VALUES {AREA_VALUES}) t(name, alat, alon, radius_km, area_type, ac, is_control))"


@query(
    "e04_point_in_circle",
    f"""{AREAS}, m AS ({MOVED} detections), j AS (SELECT det_id, name, is_control, {hav('lon', 'lat', 'alon', 'alat')} / 1000 AS km, radius_km FROM m, ar)
    SELECT det_id, name, is_control, round(km, 8) AS distance_km FROM j WHERE km <= radius_km""",
)
def _(v):
    hits = ra.within(v.sql(MOVED + "{detections}"), ra.areas(v.spark))
    return hits.select("det_id", "name", "is_control", F.round("distance_km", 8).alias("distance_km"))


@query(
    "e05_nearest_zone",
    f"""j AS (SELECT d.det_id, z.zone_id, {hav('d.lon', 'd.lat', '(z.west + z.east) / 2', '(z.south + z.north) / 2')} AS m FROM detections d, zones z),
    r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY m, zone_id) AS rn FROM j WHERE m < 50000)
    SELECT d.det_id, r.zone_id AS nearest_zone, round(r.m / 1000, 8) AS distance_km FROM detections d LEFT JOIN r ON r.det_id = d.det_id AND r.rn = 1""",
)
def _(v):
    out = sp.nearest_zone(v.detections, co.zone_centres(v.zones), "det_id")
    return out.select("det_id", "nearest_zone", F.round("distance_km", 8).alias("distance_km"))


@query(
    "e06_radius_statistics",
    """c AS (SELECT det_id, lon, lat, CASE WHEN det_type = 'line' THEN 0.002E0 ELSE greatest(sqrt(area_m2) / 111320 * 2, 0.001E0) END AS r FROM detections),
    j AS (SELECT c.det_id, s.elevation_ground AS e FROM c JOIN shots s ON abs(s.lon - c.lon) <= 0.01E0 AND abs(s.lat - c.lat) <= 0.01E0 AND s.elevation_ground IS NOT NULL
      AND sqrt((s.lon - c.lon) * (s.lon - c.lon) + (s.lat - c.lat) * (s.lat - c.lat)) <= r)
    SELECT det_id, count(*) AS n_shots, round(avg(e), 6) AS mean_elevation, round(stddev_pop(e), 6) AS std_elevation, round(var_pop(e), 4) AS local_variance FROM j GROUP BY det_id""",
)
def _(v):
    r = F.when(F.col("det_type") == "line", 0.002).otherwise(F.greatest(F.sqrt("area_m2") / 111320 * 2, F.lit(0.001)))
    out = sp.radius_statistics(v.detections.select("det_id", "lon", "lat", "det_type", "area_m2"), v.shots, "det_id", r)
    return out.select(
        "det_id", "n_shots", F.round("mean_elevation", 6).alias("mean_elevation"), F.round("std_elevation", 6).alias("std_elevation"),
        F.round("local_variance", 4).alias("local_variance"),
    )


@query(
    "e07_neighbour_counts",
    """SELECT a.det_id, count(*) AS n_neighbours FROM detections a JOIN detections b ON abs(a.lon - b.lon) <= 0.002E0 AND abs(a.lat - b.lat) <= 0.002E0
    AND sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= 0.002E0 GROUP BY a.det_id""",
)
def _(v):
    p = v.detections.select("det_id", "lon", "lat")
    pairs = sp.near_pairs(p, p, 0.002, "det_id", metric="planar")
    return pairs.groupBy(F.col("b.det_id").alias("det_id")).agg(F.count(F.lit(1)).alias("n_neighbours"))


FEAT = "SELECT *, det_id % 6 AS scene_id, CAST((det_id * 7) % 50 AS INT) AS pix_row, CAST((det_id * 11) % 50 AS INT) AS pix_col FROM "
WINDOW = """w AS (SELECT f.det_id, avg(p.nir) AS mean_nir, avg(p.swir1) AS mean_swir1, avg(p.swir2) AS mean_swir2, max(CASE WHEN p.pix_row = f.pix_row AND p.pix_col = f.pix_col THEN p.red END) AS at_red
  FROM f JOIN pixels p ON p.scene_id = f.scene_id AND abs(p.pix_row - f.pix_row) <= 1 AND abs(p.pix_col - f.pix_col) <= 1 GROUP BY f.det_id)"""


def features(v):
    return v.sql(FEAT + "{detections}")


@query(
    "e08_pixel_sampling",
    f"""f AS ({FEAT} detections), {WINDOW} SELECT det_id, round(mean_nir, 9) AS mean_nir, round(mean_swir1, 9) AS mean_swir1, round(mean_swir2, 9) AS mean_swir2, round(at_red, 9) AS at_red FROM w""",
)
def _(v):
    s = sp.sample_pixels(features(v), v.pixels, "det_id", ["nir", "swir1", "swir2", "red"], half=1)
    return s.select("det_id", *[F.round(c, 9).alias(c) for c in ("mean_nir", "mean_swir1", "mean_swir2", "at_red")])


# The synthetic scenes are dim; brightened copies make every branch of the filters fire.
BRIGHT = "SELECT scene_id, pix_row, pix_col, red * 4 AS red, nir * (0.4E0 + 0.1E0 * (pix_row % 12)) AS nir, swir1 * (0.5E0 + 0.2E0 * (pix_col % 10)) AS swir1, swir2 * (1 + pix_row % 5) AS swir2 FROM "


@query(
    "d21_false_positive_filter",
    f"""f AS ({FEAT} detections), px AS ({BRIGHT} pixels), {WINDOW.replace('pixels p', 'px p')},
    n AS (SELECT f.*, mean_swir1, mean_swir2, (mean_nir - at_red) / (mean_nir + at_red + 1E-8) AS ndvi FROM f LEFT JOIN w ON w.det_id = f.det_id)
    SELECT det_id FROM n WHERE NOT coalesce(ndvi < 0.1E0 AND mean_swir1 > 0.4E0, false) AND NOT coalesce(ndvi > 0.3E0 AND ndvi < 0.6E0 AND mean_swir2 > 0.5E0, false)
      AND NOT (det_type = 'circle' AND sqrt(area_m2 / pi()) < 25) AND NOT (det_type = 'line' AND length_m > 2000)""",
)
def _(v):
    f = features(v).withColumn("radius_m", F.sqrt(F.col("area_m2") / F.pi()))
    return sf.without_false_positives(f, v.sql(BRIGHT + "{pixels}"), "det_id").select("det_id")


@query(
    "d22_shape_artifact_filter",
    """s AS (SELECT *, 1 + (det_id % 30) / 20.0E0 AS aspect, (det_id % 100) / 100.0E0 AS edge FROM detections)
    SELECT det_id FROM s WHERE NOT (CASE det_type WHEN 'line' THEN length_m > 5000 OR length_m < 30 OR abs(((angle_degrees % 90) + 90) % 90) < 1
      WHEN 'rectangle' THEN abs(aspect - 1) < 0.1E0 OR abs(((angle_degrees % 45) + 45) % 45) < 2 WHEN 'circle' THEN edge > 0.95E0 ELSE false END)
      AND NOT coalesce(confidence > 0.98E0, false)""",
)
def _(v):
    i = F.col("det_id")
    s = v.detections.withColumn("aspect_ratio", 1 + (i % 30) / 20.0).withColumn("edge_strength", (i % 100) / 100.0)
    return sf.without_shape_artifacts(s).select("det_id")


@query(
    "d23_environmental_filter",
    f"""f AS ({FEAT} detections), px AS (SELECT scene_id, pix_row, pix_col, red * 0.3E0 AS red, nir, swir1 * (0.3E0 + 0.1E0 * (pix_col % 10)) AS swir1, swir2 * (1 + pix_row % 5) AS swir2, red * 1.5E0 * (pix_row % 3) AS red2 FROM pixels),
    n AS (SELECT f.det_id, p.swir1, p.swir2, (p.nir - (p.red + p.red2)) / (p.nir + (p.red + p.red2) + 1E-8) AS ndvi FROM f LEFT JOIN px p ON p.scene_id = f.scene_id AND p.pix_row = f.pix_row AND p.pix_col = f.pix_col)
    SELECT det_id FROM n WHERE NOT coalesce((ndvi > 0.6E0 AND swir1 < 0.2E0) OR (ndvi > 0.3E0 AND ndvi < 0.6E0 AND swir2 > 0.4E0) OR (ndvi > 0.8E0 AND swir1 < 0.15E0), false)""",
)
def _(v):
    px = v.pixels.select(
        "scene_id", "pix_row", "pix_col", (F.col("red") * 0.3 + F.col("red") * 1.5 * (F.col("pix_row") % 3)).alias("red"), "nir",
        (F.col("swir1") * (0.3 + 0.1 * (F.col("pix_col") % 10))).alias("swir1"), (F.col("swir2") * (1 + F.col("pix_row") % 5)).alias("swir2"),
    )
    return sf.without_unsuitable_ground(features(v), px, "det_id").select("det_id")


@query(
    "d26_ingest_filter",
    """SELECT det_id FROM detections WHERE CASE WHEN det_type = 'terra_preta' THEN coalesce(confidence, 0) >= CASE WHEN zone_id % 5 = 0 THEN 0.45E0 ELSE 0.40E0 END
      AND area_m2 <= CASE WHEN zone_id % 5 = 0 THEN 100000 ELSE 1000000 END
      WHEN det_type IN ('circle', 'line', 'rectangle') THEN coalesce(confidence, 0) >= 0.45E0 AND area_m2 <= 1000000
      WHEN det_type LIKE 'crop%' THEN coalesce(confidence, 0) >= 0.45E0 AND area_m2 <= 100000 ELSE true END""",
)
def _(v):
    return v.detections.where(sf.ingest_allowed(F.col("zone_id") % 5 == 0)).select("det_id")


@query(
    "d30_geometric_size_gate",
    """s AS (SELECT *, 1 + (det_id % 30) / 20.0E0 AS aspect, CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 50 ELSE 10 END AS min_size FROM detections JOIN zones USING (zone_id))
    SELECT det_id FROM s WHERE CASE det_type WHEN 'circle' THEN area_m2 <= 500000 AND coalesce(confidence, 0) >= 0.5E0
      WHEN 'line' THEN length_m >= min_size AND coalesce(confidence, 0) >= 0.7E0 AND NOT (angle_degrees % 90 < 2 OR angle_degrees % 90 > 88)
      WHEN 'rectangle' THEN area_m2 >= min_size * min_size AND area_m2 <= 500000 AND coalesce(confidence, 0) >= 0.7E0 AND NOT (angle_degrees % 90 < 2 OR angle_degrees % 90 > 88) ELSE false END""",
)
def _(v):
    from terraloom.operators.masks import zone_type_threshold

    s = v.detections.join(v.zones.select("zone_id", "zone_type"), "zone_id")
    return s.where(sf.geometric_size_ok(zone_type_threshold(F.col("zone_type"), 2))).select("det_id")


@query(
    "e09_bbox_overlap",
    """SELECT s.scene_id, z.zone_id, round((least(s.east, z.east) - greatest(s.west, z.west)) * (least(s.north, z.north) - greatest(s.south, z.south)) / ((z.east - z.west) * (z.north - z.south)), 9) AS overlap
    FROM scenes s JOIN zones z ON greatest(s.west, z.west) < least(s.east, z.east) AND greatest(s.south, z.south) < least(s.north, z.north)""",
)
def _(v):
    pairs = sp.box_pairs(v.scenes.select("scene_id", *sp.BOX), v.zones.select("zone_id", *sp.BOX))
    return pairs.select(F.col("a.scene_id").alias("scene_id"), F.col("b.zone_id").alias("zone_id"), F.round("overlap", 9).alias("overlap"))


QUALITY = """CASE WHEN cloud_cover <= 5 THEN 30 WHEN cloud_cover <= 10 THEN 25 WHEN cloud_cover <= 15 THEN 15 WHEN cloud_cover <= 20 THEN 8 ELSE 0 END
  + CASE WHEN ov >= 95 THEN 40 WHEN ov >= 85 THEN 32 WHEN ov >= 75 THEN 24 WHEN ov >= 65 THEN 16 ELSE 0 END
  + CASE WHEN km <= 10 THEN 20 WHEN km <= 25 THEN 15 WHEN km <= 50 THEN 10 ELSE 0 END + CASE WHEN acq_month BETWEEN 6 AND 9 THEN 10 ELSE 0 END"""
SCENE_SCORE = f"""so AS (SELECT s.scene_id, z.zone_id, s.cloud_cover, s.acq_month,
    (least(s.east, z.east) - greatest(s.west, z.west)) * (least(s.north, z.north) - greatest(s.south, z.south)) / ((z.east - z.west) * (z.north - z.south)) * 100 AS ov,
    sqrt(pow((s.west + s.east) / 2 - (z.west + z.east) / 2, 2) + pow((s.south + s.north) / 2 - (z.south + z.north) / 2, 2)) * 111.32E0 AS km
  FROM scenes s JOIN zones z ON greatest(s.west, z.west) < least(s.east, z.east) AND greatest(s.south, z.south) < least(s.north, z.north)),
  sq AS (SELECT *, CAST({QUALITY} AS INT) AS quality FROM so)"""


@query(
    "e10_scene_scoring",
    f"{SCENE_SCORE} SELECT scene_id, zone_id, round(ov, 6) AS overlap_pct, round(km, 6) AS centre_km, quality FROM sq",
)
def _(v):
    from terraloom.sources.catalogues import scored_scenes

    return scored_scenes(v.scenes, v.zones).select(
        "scene_id", "zone_id", F.round("overlap_pct", 6).alias("overlap_pct"), F.round("centre_km", 6).alias("centre_km"), "quality"
    )


query("j13_scene_quality", f"{SCENE_SCORE} SELECT scene_id, zone_id, quality FROM sq")(
    lambda v: __import__("terraloom.sources.catalogues", fromlist=["x"]).scored_scenes(v.scenes, v.zones).select("scene_id", "zone_id", "quality")
)

LAYERS = """SELECT 'gedi_only' AS layer, lon, lat, provider, CAST(NULL AS INT) AS rank, false AS lidar_support, 0.0E0 AS convergent_score, CAST(NULL AS DOUBLE) AS convergence_distance_m FROM {d} WHERE provider = 'gedi'
  UNION ALL SELECT 'sentinel2_only', lon, lat, provider, NULL, false, 0.0E0, NULL FROM {d} WHERE provider = 'sentinel2'
  UNION ALL SELECT 'combined', lon, lat, provider, NULL, det_id % 2 = 0, (det_id % 30) / 2.0E0, length_m FROM {d} WHERE det_id % 4 = 0
  UNION ALL SELECT 'top_candidates', lon, lat, provider, CAST(det_id AS INT), true, 9.0E0, 100.0E0 FROM {d} WHERE det_id <= 20"""


@query(
    "e11_coordinate_merge",
    f"""ly AS ({LAYERS.format(d='detections')}), g AS (SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, max(rank) AS rank, coalesce(bool_or(lidar_support), false) AS lidar_support,
      max(coalesce(convergent_score, 0)) AS convergent_score, max(layer LIKE '%gedi%' OR provider = 'gedi') AS l, max(layer LIKE '%sentinel2%' OR provider = 'sentinel2') AS s,
      string_agg(DISTINCT layer, ',' ORDER BY layer) AS sources FROM ly GROUP BY 1, 2)
    SELECT g.lon, g.lat, rank, lidar_support, convergent_score, (SELECT min(y.convergence_distance_m) FROM ly y WHERE round(y.lon, 6) = g.lon AND round(y.lat, 6) = g.lat AND coalesce(y.convergent_score, 0) = g.convergent_score) AS convergence_distance_m,
      CASE WHEN l THEN 'gedi' WHEN s THEN 'sentinel2' ELSE 'unknown' END AS provider, sources FROM g""",
)
def _(v):
    return sp.merged_by_coordinate(v.sql(LAYERS.format(d="{detections}")))


@query(
    "e12_membership_flag",
    """SELECT d.det_id, m.x IS NOT NULL AS is_convergent FROM detections d LEFT JOIN (SELECT DISTINCT round(lon, 6) AS x, round(lat, 6) AS y FROM detections WHERE confidence > 0.7E0) m
    ON m.x = round(d.lon, 6) AND m.y = round(d.lat, 6)""",
)
def _(v):
    return sp.flag_membership(v.detections, v.detections.where("confidence > 0.7"), "det_id").select("det_id", "is_convergent")


NN = """nn AS (SELECT a.det_id, min(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat))) AS d FROM detections a JOIN detections b ON a.det_id <> b.det_id GROUP BY a.det_id)"""


@query("e13_nearest_neighbour", f"{NN} SELECT det_id, round(d * 111000, 4) AS nearest_m FROM nn")
def _(v):
    return sp.nearest_distance(v.detections.select("det_id", "lon", "lat"), "det_id").select(
        "det_id", F.round(F.col("nn_deg") * 111000, 4).alias("nearest_m")
    )


@query(
    "e14_duplicate_location",
    """SELECT a.det_id FROM detections a WHERE EXISTS (SELECT 1 FROM detections b WHERE b.det_id <> a.det_id AND abs(a.lon - b.lon) < 0.001E0 AND abs(a.lat - b.lat) < 0.001E0
    AND sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) < 100 / 111000.0E0)""",
)
def _(v):
    from terraloom.operators.density import with_core_flag

    flagged = with_core_flag(v.detections.select("det_id", "lon", "lat"), "det_id", 100 / 111000.0, 2, closed=False)
    return flagged.where("is_core").select("det_id")


@query(
    "e15_best_discovery",
    f"""{SCORED}, {SUPPORT}, t AS (SELECT *, CASE WHEN convergent_score > 0 AND det_type LIKE '%terra%' THEN 4 WHEN convergent_score > 0 THEN 3 WHEN det_type LIKE '%terra%' THEN 2 ELSE 1 END AS tier FROM su),
    r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY tier DESC, CASE WHEN convergent_score > 0 THEN coalesce(confidence, 0) ELSE area_m2 END DESC, det_id) AS rn,
      count(*) FILTER (convergent_score > 0) OVER (PARTITION BY zone_id) AS n_convergent FROM t)
    SELECT zone_id, det_id AS best_det_id, CAST(tier AS INT) AS tier, n_convergent FROM r WHERE rn = 1""",
)
def _(v):
    return sp.best_discovery(sp.with_pair_support(v.detections, sp.scored_pairs(v.detections)))
