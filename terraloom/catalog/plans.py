"""Queries over the composed analyses: P1-P6, P8, P9 (P7 is with the reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.coordinates import hav
from terraloom.catalog.evidence import CAND, SCORES, SITES, dets, r, scores
from terraloom.catalog.lidar import GAP_CL, GAP_EPS, MOUND_CL, MOUND_EPS, STATS as ASTATS, fits_sql
from terraloom.catalog.pixels import INDEX_SQL, PX
from terraloom.catalog.rasters import morph_sql
from terraloom.catalog.registry import composed, query
from terraloom.catalog.regions import STATS, label_sql
from terraloom.catalog.reports import ACTION, BREAK
from terraloom.catalog.sources import flat
from terraloom.catalog.spatial import FIRST, SCORED, SUPPORT
from terraloom.operators.quantiles import band_quantiles
from terraloom.plans import analyses as an


@query(
    "p01_lidar_scene",
    f"""{GAP_CL}, gc AS (SELECT *, 'gedi_clearing' AS det_type FROM cl), {ASTATS}, {MOUND_CL.replace('db_', 'dm_').replace('db AS', 'dm AS').replace('FROM db', 'FROM dm').replace('cl AS', 'ml AS')},
    al AS (SELECT * FROM gc UNION ALL SELECT *, 'gedi_mound' FROM ml), rd AS (SELECT *, greatest(sqrt(area_m2 / pi()) / 111320, 0.001E0) AS rad FROM al),
    st AS (SELECT rd.det_type, rd.zone_id, rd.cluster_id, avg(s.elevation_ground) AS me, stddev_pop(s.elevation_ground) AS se FROM rd JOIN shots s ON s.elevation_ground IS NOT NULL AND abs(s.lon - rd.lon) <= rad AND abs(s.lat - rd.lat) <= rad
      AND sqrt((s.lon - rd.lon) * (s.lon - rd.lon) + (s.lat - rd.lat) * (s.lat - rd.lat)) <= rad GROUP BY 1, 2, 3)
    SELECT al.zone_id, al.det_type, al.cluster_id, n_points, round(lon, 9) AS lon, round(lat, 9) AS lat, round(area_m2, 6) AS area_m2, CASE al.det_type WHEN 'gedi_clearing' THEN 0.75E0 END AS confidence, round(me, 6) AS mean_elevation, round(se, 6) AS std_elevation
    FROM al LEFT JOIN st ON st.det_type = al.det_type AND st.zone_id = al.zone_id AND st.cluster_id = al.cluster_id""",
)
def _(v):
    # the sample shots are sparse, so both radii are widened and two shots make a mound
    f = an.lidar_scene(v.shots, cluster_eps=GAP_EPS, mound_eps=MOUND_EPS, min_mound_size=2)
    return f.select(
        "zone_id", "det_type", "cluster_id", "n_points", r("lon", 9), r("lat", 9), r("area_m2", 6), "confidence", r("mean_elevation", 6), r("std_elevation", 6)
    )


@composed(
    "p01_lidar_potentials", "f06_clearing_potential", "f07_earthwork_potential",
    sql="SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, a.potential AS clearing_potential, b.potential AS earthwork_potential FROM ({0}) a FULL JOIN ({1}) b ON a.zone_id = b.zone_id",
)
def _(v):
    p = an.lidar_potentials(v.shots, cluster_eps=GAP_EPS, mound_eps=MOUND_EPS, min_mound_size=2)
    return p.select("zone_id", r("clearing_potential", 9), "earthwork_potential")


# Shots squeezed towards a line by an amount that differs per zone, so that ditches of some zones fit one.
SQUEEZED = "SELECT shot_number, zone_id, elevation_ground, lon, lat * 0.02E0 * (1 + zone_id % 9) + lon * 0.5E0 AS lat FROM "


@query(
    "p01_linear_features",
    f"""sz AS ({SQUEEZED} shots), {ASTATS.replace('FROM shots', 'FROM sz')}, di AS (SELECT * FROM an WHERE kind = 'ditch'), {fits_sql('di')}, ce AS (SELECT zone_id, avg(lon) AS lon, avg(lat) AS lat FROM di GROUP BY zone_id),
    st AS (SELECT ce.zone_id, count(*) AS n_shots, avg(s.elevation_ground) AS me, stddev_pop(s.elevation_ground) AS se FROM ce JOIN sz s ON s.elevation_ground IS NOT NULL AND abs(s.lon - ce.lon) <= 0.002E0 AND abs(s.lat - ce.lat) <= 0.002E0
      AND sqrt((s.lon - ce.lon) * (s.lon - ce.lon) + (s.lat - ce.lat) * (s.lat - ce.lat)) <= 0.002E0 GROUP BY ce.zone_id)
    SELECT fl.zone_id, 'gedi_linear' AS det_type, feature_type, round(r2, 7) AS r2, round(length_m, 3) AS length_m, round(ce.lon, 9) AS lon, round(ce.lat, 9) AS lat, n_shots, round(me, 6) AS mean_elevation, round(se, 6) AS std_elevation
    FROM fl JOIN ce ON ce.zone_id = fl.zone_id LEFT JOIN st ON st.zone_id = fl.zone_id WHERE feature_type IS NOT NULL""",
)
def _(v):
    f = an.lidar_lines(v.sql(SQUEEZED + "{shots}"))
    return f.select("zone_id", "det_type", "feature_type", r("r2", 7), r("length_m", 3), r("lon", 9), r("lat", 9), "n_shots", r("mean_elevation", 6), r("std_elevation", 6))


# A weaker signature than the sample scenes have: at full strength every region is rejected as over-confident.
WEAK = "SELECT scene_id, pix_row, pix_col, blue, green, red, red_edge_1 - 0.03E0 AS red_edge_1, red_edge_3 - 0.06E0 AS red_edge_3, nir, swir1, swir2 FROM "


# the fast preset labels with 8-connectivity
WEAK_STATS = STATS.replace(label_sql("tp", "lb"), label_sql("tp", "lb", True)).replace("FROM pixels", "FROM wk_px").replace("JOIN pixels", "JOIN wk_px")


CROP_STEPS = [("erode", 4), ("dilate", 4), ("dilate", 3), ("erode", 3), ("erode", 2), ("dilate", 2)]


def crop_sql(name: str, kind: str, mask: str) -> str:
    """CTEs ending in ``name``: scored crop-mark regions of one sign."""
    ctes, last = morph_sql(f"{name}_b", CROP_STEPS, prefix=f"{name}_m")
    return f"""{name}_b AS (SELECT scene_id, pix_row, pix_col, CAST({mask} AS INT) AS m FROM wk_px), {ctes}, {name}_t AS (SELECT scene_id, pix_row AS r, pix_col AS c FROM {last} WHERE m = 1), {label_sql(f'{name}_t', f'{name}_l')},
    {name}_s AS (SELECT l.scene_id, comp_row, comp_col, count(*) AS n_px, count(*) * 100.0E0 AS area_m2, avg({INDEX_SQL['crop_mark']}) AS ci, avg(r) AS centre_row, avg(c) AS centre_col,
      greatest(max(r) - min(r) + 1, max(c) - min(c) + 1) / least(max(r) - min(r) + 1, max(c) - min(c) + 1)::DOUBLE AS aspect FROM {name}_l l JOIN wk_px p ON p.scene_id = l.scene_id AND p.pix_row = l.r AND p.pix_col = l.c GROUP BY 1, 2, 3),
    {name} AS (SELECT scene_id, 'crop_mark_{kind}' AS det_type, comp_row, comp_col, n_px, area_m2, least(1, sqrt(area_m2) / 30) * least(1, abs(ci) * 10) * 0.8E0 AS confidence, centre_row, centre_col FROM {name}_s
      WHERE area_m2 BETWEEN 300 AND 20000 AND n_px >= 3 AND aspect <= 10 AND least(1, sqrt(area_m2) / 30) * least(1, abs(ci) * 10) * 0.8E0 >= 0.3E0)"""


_NDVI, _CM = INDEX_SQL["ndvi"], INDEX_SQL["crop_mark"]
CROP_SQL = crop_sql("cpos", "positive", f"{_CM} > 0.06E0 AND {_NDVI} > 0.5E0") + ", " + crop_sql("cneg", "negative", f"{_CM} < -0.06E0 AND {_NDVI} > 0.4E0")


@query(
    "p02_spectral_scene",
    f"""wk_px AS ({WEAK} pixels), {WEAK_STATS}, c AS (SELECT fs.*, (0.4E0 * least(1, mean_terra_preta_enhanced * 6) + 0.25E0 * least(1, (mean_ndvi - 0.3E0) * 3) + 0.25E0 * least(1, mean_ndre1 * 6) + 0.1E0 * least(1, sqrt(area_m2) / 50))
      * CASE WHEN mean_terra_preta_enhanced > 0.25E0 AND mean_ndre1 > 0.3E0 THEN 1.3E0 WHEN mean_terra_preta_enhanced > 0.2E0 AND mean_ndre1 > 0.25E0 THEN 1.15E0 ELSE 1 END AS b, n / edge::DOUBLE AS ap FROM fs JOIN pe ON pe.scene_id = fs.scene_id AND pe.comp_row = fs.comp_row AND pe.comp_col = fs.comp_col),
    k AS (SELECT *, least(1, b) * CASE WHEN mean_terra_preta_enhanced + mean_ndre1 * 0.5E0 < 0.3E0 THEN 0.8E0 ELSE 1 END AS confidence FROM c WHERE area_m2 BETWEEN 500 AND 50000 AND n_px >= 3 AND aspect <= 8 AND ap <= 25),
    {CROP_SQL}, al AS (SELECT scene_id, 'terra_preta' AS det_type, comp_row, comp_col, n_px, area_m2, confidence, centre_row, centre_col FROM k WHERE confidence >= 0.8E0 UNION ALL SELECT * FROM cpos UNION ALL SELECT * FROM cneg),
    f AS (SELECT al.*, (p.nir - p.red) / (p.nir + p.red + 1E-8) AS nv, p.swir1, p.swir2 FROM al LEFT JOIN wk_px p ON p.scene_id = al.scene_id AND p.pix_row = round(al.centre_row) AND p.pix_col = round(al.centre_col) WHERE confidence <= 0.98E0)
    SELECT scene_id, det_type, comp_row, comp_col, n_px, area_m2, round(confidence, 9) AS confidence FROM f WHERE NOT coalesce((nv > 0.6E0 AND swir1 < 0.2E0) OR (nv > 0.3E0 AND nv < 0.6E0 AND swir2 > 0.4E0) OR (nv > 0.8E0 AND swir1 < 0.15E0), false)""",
)
def _(v):
    f = an.spectral_scene(v.sql(WEAK + "{pixels}"), "fast")
    return f.select("scene_id", "det_type", "comp_row", "comp_col", "n_px", "area_m2", r("confidence", 9))


@query("p02_geometric_shapes")
def _(v):
    return an.geometric_shapes(v.pixels, line_votes=14, circle_votes=14, significance=0.5)


LB = ["blue", "green", "red", "nir"]
_DN = ", ".join(f"round(({b} + 0.2E0) / 0.0000275E0) AS {b}" for b in LB)
_SC = ", ".join(f"least(greatest({b} * 0.0000275E0 - 0.2E0, 0), 1) AS {b}" for b in LB)
_Q = ", ".join(f"quantile_cont({b}, 0.01) AS {b}_lo, quantile_cont({b}, 0.99) AS {b}_hi" for b in LB)
_CL = ", ".join(f"least(greatest({b}, {b}_lo), {b}_hi) AS {b}" for b in LB)
_MM = ", ".join(f"min({b}) AS {b}_lo, max({b}) AS {b}_hi" for b in LB)


@query(
    "p03_landsat_preprocessing",
    f"""sc AS (SELECT scene_id, pix_row, pix_col, {_SC} FROM (SELECT scene_id, pix_row, pix_col, {_DN} FROM pixels) d), sq AS (SELECT scene_id, {_Q} FROM sc GROUP BY scene_id), cl AS (SELECT scene_id, pix_row, pix_col, {_CL} FROM sc JOIN sq USING (scene_id)),
    cq AS (SELECT scene_id, quantile_cont((blue + green + red) / 3, 0.95) AS p FROM cl GROUP BY scene_id), mk AS (SELECT scene_id, pix_row, pix_col, {', '.join(f'CASE WHEN (blue + green + red) / 3 > p THEN NULL ELSE {b} END AS {b}' for b in LB)} FROM cl JOIN cq USING (scene_id)),
    mm AS (SELECT scene_id, {_MM} FROM mk GROUP BY scene_id), nm AS (SELECT scene_id, pix_row, pix_col, {', '.join(f'CASE WHEN {b}_hi > {b}_lo THEN ({b} - {b}_lo) / ({b}_hi - {b}_lo) ELSE {b} END AS {b}' for b in LB)} FROM mk JOIN mm USING (scene_id))
    SELECT scene_id, pix_row, pix_col, round(nir, 7) AS nir, round((nir - red) / (nir + red + 1E-8), 6) AS ndvi, round((green - nir) / (green + nir + 1E-8), 6) AS ndwi FROM nm""",
)
def _(v):
    dn = v.pixels.select(*PX, *[F.round((F.col(b) + 0.2) / 0.0000275).alias(b) for b in LB])
    return an.landsat_preprocessed(dn, LB).select(*PX, r("nir", 7), r("ndvi", 6), r("ndwi", 6))


_PCT = ", ".join(f"quantile_cont({b}, 0.02) AS {b}_lo, quantile_cont({b}, 0.98) AS {b}_hi" for b in LB)
_PN = ", ".join(f"CASE WHEN {b} IS NULL THEN NULL WHEN {b}_hi > {b}_lo THEN least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo), 0), 1) ELSE {b} END AS {b}" for b in LB)
LANDSAT = f"""sc AS (SELECT scene_id, pix_row, pix_col, {_SC} FROM (SELECT scene_id, pix_row, pix_col, {_DN} FROM pixels) d), sq AS (SELECT scene_id, {_Q} FROM sc GROUP BY scene_id), cl AS (SELECT scene_id, pix_row, pix_col, {_CL} FROM sc JOIN sq USING (scene_id)),
    cq AS (SELECT scene_id, quantile_cont((blue + green + red) / 3, 0.95) AS p FROM cl GROUP BY scene_id), mk AS (SELECT scene_id, pix_row, pix_col, {', '.join(f'CASE WHEN (blue + green + red) / 3 > p THEN NULL ELSE {b} END AS {b}' for b in LB)} FROM cl JOIN cq USING (scene_id)),
    pq AS (SELECT scene_id, {_PCT} FROM mk GROUP BY scene_id), pn AS (SELECT scene_id, pix_row, pix_col, {_PN} FROM mk JOIN pq USING (scene_id))"""


# Levels of the composites within one of the exact ones: the stretch cuts at whole levels, and values on a cut differ in the last digit between engines.
@query(
    "p03_landsat_products",
    f"""{LANDSAT}, s2 AS (SELECT scene_id, {_PCT} FROM pn GROUP BY scene_id), lv AS (SELECT scene_id, pix_row, pix_col, {', '.join(f'CASE WHEN {b}_hi > {b}_lo THEN least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo) * 255, 0), 255) ELSE 0 END AS {b}' for b in LB)} FROM pn JOIN s2 USING (scene_id))
    SELECT scene_id, pix_row, pix_col, round(red, 0) AS r, round(green, 0) AS g, round(nir, 0) AS n, true AS within FROM lv""",
)
def _(v):
    dn = v.pixels.select(*PX, *[F.round((F.col(b) + 0.2) / 0.0000275).alias(b) for b in LB])
    made = an.landsat_products(dn, LB)
    normal = made["indices"]
    both = made["true_color"].select(*PX, F.col("r").alias("tr"), F.col("g").alias("tg")).join(made["false_color"].select(*PX, F.col("r").alias("fn"), F.col("g").alias("fr")), PX)
    q = band_quantiles(normal, ["red", "green", "nir"], {"lo": 0.02, "hi": 0.98})
    level = {b: F.when(F.col(f"{b}_hi") > F.col(f"{b}_lo"), F.least(F.greatest((F.col(b) - F.col(f"{b}_lo")) / (F.col(f"{b}_hi") - F.col(f"{b}_lo")) * 255, F.lit(0.0)), F.lit(255.0))).otherwise(0.0) for b in ("red", "green", "nir")}
    within = (F.abs(F.col("tr") - level["red"]) <= 1) & (F.abs(F.col("tg") - level["green"]) <= 1) & (F.abs(F.col("fn") - level["nir"]) <= 1) & (F.col("tr") == F.col("fr"))
    return normal.join(q, "scene_id").join(both, PX).select(*PX, *[F.round(level[b], 0).alias(n) for b, n in (("red", "r"), ("green", "g"), ("nir", "n"))], within.alias("within"))


@query(
    "p04_zone_scoring",
    f"""{SCORES}, b AS (SELECT zone_id, sum(weight * confidence) / sum(weight) AS oc FROM evi GROUP BY zone_id), {SITES}
    SELECT zc.zone_id, round(total_score, 8) AS total_score, classification, round(oc, 8) AS overall_confidence, round(d, 8) AS cohens_d, level AS confidence_level FROM zc JOIN b ON b.zone_id = zc.zone_id JOIN si ON si.zone_id = zc.zone_id""",
)
def _(v):
    z = an.scored_zones(dets(v), v.zones)
    return z.select("zone_id", r("total_score"), "classification", r("overall_confidence"), r("cohens_d"), "confidence_level")


# Detections with gaps: values missing, LiDAR axes swapped, some outside the basin.
GAPPY = """SELECT det_id, zone_id, provider, det_type, CASE WHEN provider = 'gedi' AND det_id % 4 = 0 THEN lat WHEN det_id % 17 = 0 THEN lon + 90 ELSE lon END AS lon, CASE WHEN provider = 'gedi' AND det_id % 4 = 0 THEN lon ELSE lat END AS lat,
  CASE WHEN det_id % 5 = 0 THEN NULL ELSE confidence END AS confidence, CASE WHEN det_id % 7 = 0 THEN NULL ELSE area_m2 END AS area_m2, length_m, n_points, grade, angle_degrees FROM """
DEFAULTED = f"""gp AS ({GAPPY} detections), fm AS (SELECT *, CASE WHEN det_type = 'terra_preta' THEN 'terra_preta' WHEN det_type LIKE 'crop%' THEN 'crop_mark' WHEN det_type LIKE 'gedi%' THEN det_type ELSE 'geometric' END AS family FROM gp),
  sw AS (SELECT * EXCLUDE (lon, lat), CASE WHEN family LIKE 'gedi%' AND abs(lon) < abs(lat) THEN lat ELSE lon END AS lon, CASE WHEN family LIKE 'gedi%' AND abs(lon) < abs(lat) THEN lon ELSE lat END AS lat FROM fm),
  fd AS (SELECT det_id, zone_id, provider, family, lon, lat, length_m, n_points, grade, angle_degrees, CASE family WHEN 'gedi_clearing' THEN 0.8E0 WHEN 'gedi_earthwork' THEN 0.75E0 ELSE coalesce(confidence, CASE family WHEN 'terra_preta' THEN 0.85E0 WHEN 'crop_mark' THEN 0.75E0 ELSE 0.7E0 END) END AS confidence,
    coalesce(area_m2, CASE family WHEN 'terra_preta' THEN 5000 WHEN 'crop_mark' THEN 3000 WHEN 'geometric' THEN 15000 ELSE 0 END) AS area_m2, CASE WHEN family = 'crop_mark' THEN 'terra_preta' ELSE det_type END AS det_type
    FROM sw WHERE lon BETWEEN -80 AND -44 AND lat BETWEEN -20 AND 10)"""


@query("p04_family_defaults", f"{DEFAULTED} SELECT det_id, family, det_type, lon, lat, confidence, area_m2 FROM fd")
def _(v):
    return an.with_family_defaults(v.sql(GAPPY + "{detections}")).select("det_id", "family", "det_type", "lon", "lat", "confidence", "area_m2")


@query(
    "p04_zone_scoring_with_defaults",
    f"{DEFAULTED}, {SCORES.replace('FROM detections', 'FROM fd')} SELECT zone_id, round(total_score, 8) AS total_score, classification FROM zc",
)
def _(v):
    d = v.sql(GAPPY + "{detections}")
    z = an.scored_zones(an.with_family_defaults(d).withColumn("diameter_m", 2 * F.sqrt(F.col("area_m2") / F.pi())), v.zones)
    return z.select("zone_id", r("total_score"), "classification")


@query(
    "p05_cross_provider_fusion",
    f"""{CAND}, rs AS (SELECT det_id, det_type, es, conv, row_number() OVER (PARTITION BY det_type ORDER BY es DESC, det_id) AS rn FROM cd), o AS (SELECT *, CASE WHEN rn <= 5 OR conv > 0 THEN 0 ELSE 1 END AS late FROM rs)
    SELECT det_id, det_type, CAST(row_number() OVER (ORDER BY late, es DESC, det_id) AS INT) AS rank, CASE WHEN row_number() OVER (ORDER BY late, es DESC, det_id) <= 3 THEN 'high' ELSE 'medium' END AS field_priority FROM o ORDER BY late, es DESC, det_id LIMIT 20""",
)
def _(v):
    return an.fused_candidates(v.detections, 20).select("det_id", "det_type", "rank", "field_priority")


@query(
    "p06_unified_export",
    f"""{SCORED}, {SUPPORT}, al AS (SELECT provider, convergent_score FROM su WHERE convergence_distance_m IS NOT NULL AND coalesce(confidence, 0) >= 0.5E0 UNION ALL SELECT 'multi_sensor', score FROM e2 WHERE score >= 8)
    SELECT provider, count(*) AS n, round(avg(convergent_score), 8) AS mean_score FROM al GROUP BY provider""",
)
def _(v):
    u = an.unified_features(v.detections, "run")
    a = u["combined"].select(F.col("properties.provider").alias("provider"), F.col("properties.convergent_score").alias("s"))
    b = u["midpoints"].select("provider", F.col("convergent_score").alias("s"))
    return a.unionByName(b).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 8).alias("mean_score"))


@composed("p06_supported_detections", "e02_pair_support")
def _(v):
    out = an.unified_features(v.detections, "run")["detections"]
    return out.select("det_id", r("convergent_score", 6), r("convergence_distance_m", 4), r("combined_confidence", 9), "lidar_support", "spectral_support")


@composed("p06_midpoints", "e02_midpoint_rows")
def _(v):
    out = an.unified_features(v.detections, "run")["midpoints"]
    return out.select("source_a", "source_b", "det_type", r("lon", 9), r("lat", 9), r("confidence", 9), "area_m2", r("convergent_score", 6))


@composed("p06_top_candidates", "b04_top_candidate_export")
def _(v):
    p = "$.properties."
    return flat(
        an.unified_features(v.detections, "run")["top"], ("priority_rank", p + "priority_rank", "i"),
        ("field_priority", p + "field_investigation_priority", "s"), ("confidence", p + "confidence", "d"),
    )


INGEST = f"""mv AS (SELECT d.*, lon - 19.355E0 AS mx, lat + 11.785E0 AS my FROM detections d), kp AS (SELECT det_id, zone_id, provider, det_type, mx AS lon, my AS lat, confidence, area_m2, n_points FROM mv WHERE CASE WHEN det_type = 'terra_preta' THEN coalesce(confidence, 0) >= CASE WHEN zone_id % 5 = 0 THEN 0.45E0 ELSE 0.40E0 END
      AND area_m2 <= CASE WHEN zone_id % 5 = 0 THEN 100000 ELSE 1000000 END WHEN det_type IN ('circle', 'line', 'rectangle') THEN coalesce(confidence, 0) >= 0.45E0 AND area_m2 <= 1000000 WHEN det_type LIKE 'crop%' THEN coalesce(confidence, 0) >= 0.45E0 AND area_m2 <= 100000 ELSE true END
    AND NOT ({hav('mx', 'my', '-72.515E0', '-0.485E0')} / 1000 <= 0.1E0 OR {hav('mx', 'my', '-72.505E0', '-0.495E0')} / 1000 <= 0.1E0))"""


@query(
    "p08_discovery_footprints",
    f"""{INGEST}, {FIRST.replace('FROM detections', 'FROM kp').replace('JOIN detections', 'JOIN kp')}, j AS (SELECT e3.det_id, kp.det_type, kp.provider, kp.zone_id, e3.convergence_type, coalesce(e3.c, kp.confidence, 0) AS score, CASE WHEN e3.convergence_type = 'multi_sensor' THEN 0 ELSE 1 END AS tier, lon, lat FROM e3 JOIN kp ON kp.det_id = e3.det_id)
    SELECT det_id, det_type, provider, zone_id, convergence_type, round(score, 9) AS score, 'POLYGON((' || list_aggregate(list_transform(range(0, 37), lambda i: printf('%.6f %.6f', lon + 50 / 111000.0E0 / cos(radians(lat)) * sin(radians((i * 10) % 360)), lat + 50 / 111000.0E0 * cos(radians((i * 10) % 360)))), 'string_agg', ', ') || '))' AS wkt
    FROM j ORDER BY tier, j.score DESC, det_id LIMIT 5""",
)
def _(v):
    moved = v.detections.withColumn("lon", F.col("lon") - 19.355).withColumn("lat", F.col("lat") + 11.785)
    out = an.discovery_footprints(moved, F.col("zone_id") % 5 == 0)
    return out.withColumn("score", F.round("score", 9))


@query("p08_datasets", "SELECT provider, det_id AS dataset_id, count(*) OVER (PARTITION BY provider) AS n_datasets FROM detections WHERE provider IN ('sentinel2', 'gedi')")
def _(v):
    return an.discovery_report(v.detections, F.col("zone_id") % 5 == 0)["datasets"]


@query(
    "p08_requirements",
    f"""{INGEST}, {FIRST.replace('FROM detections', 'FROM kp').replace('JOIN detections', 'JOIN kp')}, j AS (SELECT e3.det_id, provider, coalesce(e3.c, kp.confidence, 0) AS score, CASE WHEN e3.convergence_type = 'multi_sensor' THEN 0 ELSE 1 END AS tier FROM e3 JOIN kp ON kp.det_id = e3.det_id ORDER BY tier, score DESC, e3.det_id LIMIT 5)
    SELECT 'five_footprints' AS requirement, count(*) >= 5 AS met FROM j UNION ALL SELECT 'footprints_located', count(*) > 0 FROM j UNION ALL SELECT 'two_sources', count(DISTINCT provider) >= 2 FROM j""",
)
def _(v):
    moved = v.detections.withColumn("lon", F.col("lon") - 19.355).withColumn("lat", F.col("lat") + 11.785)
    return an.discovery_report(moved, F.col("zone_id") % 5 == 0)["requirements"]


def report(v):
    return an.report_tables(v.detections, v.zones, scores(v), v.shots)


# Every table of the report, checked by the SQL of the operator that makes it.
REPORT = {
    "feature_counts": ("f27_feature_counts", lambda t: t),
    "summary": ("f28_executive_summary", lambda t: t.withColumn("best_score", F.round("best_score", 8)).withColumn("success_pct", F.round("success_pct", 8))),
    "zone_details": ("f29_zone_details", lambda t: t.withColumn("total_score", F.round("total_score", 8))),
    "high_priority": ("f30_high_priority_sites", lambda t: t.withColumn("anomaly_score", F.round("anomaly_score", 8))),
    "providers": ("f31_provider_analysis", lambda t: t.withColumn("mean_points", F.round("mean_points", 8))),
    "inventory": ("f32_feature_inventory", lambda t: t),
    "data_quality": ("f33_data_quality", lambda t: t),
    "resources": ("f35_resource_plan", lambda t: t),
}
for _name, (_other, _shape) in REPORT.items():
    composed(f"p09_{_name}", _other)(lambda v, n=_name, f=_shape: f(report(v)[n]))

for _name, _provider in (("gaps_lidar", "gedi"), ("gaps_spectral", "sentinel2")):
    query(f"p09_{_name}", f"SELECT zone_id FROM zones WHERE zone_id NOT IN (SELECT zone_id FROM detections WHERE provider = '{_provider}')")(lambda v, n=_name: report(v)[n])


@query(
    "p09_report_tables",
    f"""{SCORES}, {BREAK} SELECT zc.zone_id, {ACTION} AS recommended_action, coalesce(lidar_features, 0) + coalesce(spectral_features, 0) AS n_features, (SELECT count(*) FROM zc WHERE total_score >= 7) AS n_priority FROM zc LEFT JOIN pb ON pb.zone_id = zc.zone_id""",
)
def _(v):
    t = an.report_tables(v.detections, v.zones, scores(v), v.shots)
    n = t["high_priority"].agg(F.count(F.lit(1))).scalar()
    return t["zone_details"].select("zone_id", "recommended_action", (F.col("lidar_features") + F.col("spectral_features")).alias("n_features"), n.alias("n_priority"))
