"""Queries over validation and report tables: F23-F41, P7, P9."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.coordinates import MOVED, hav
from terraloom.catalog.evidence import SCORES, r, scores, supported
from terraloom.catalog.registry import query
from terraloom.catalog.spatial import AREAS, FIRST, LAYERS, NN, SCORED, SUPPORT
from terraloom.functions import labels as L
from terraloom.operators import coordinates as co
from terraloom.operators import quality as qa
from terraloom.operators import reporting as rp
from terraloom.operators import spatial as sp


def q(s):
    return "'" + s.replace("'", "''") + "'"


def coverage_sql(source: str) -> str:
    near = hav("g.lon", "g.lat", "(z.west + z.east) / 2", "(z.south + z.north) / 2")
    return f"""g AS (SELECT zone_id, count(*) AS n, avg(lon) AS lon, avg(lat) AS lat, max(lat) - min(lat) AS h, max(lon) - min(lon) AS w FROM {source} GROUP BY zone_id),
    ac AS (SELECT g.*, CASE WHEN n < 2 THEN 1 WHEN (SELECT min({near}) FROM zones z) < 50000 THEN 3.14159E0 * 49 ELSE greatest(1, h * 111 * (w * 111 * cos(radians(lat)))) END AS km2 FROM g),
    ad AS (SELECT *, n / (km2 + 1E-6) AS dens FROM ac)"""


@query("f23_density_and_area", f"{coverage_sql('detections')} SELECT zone_id, n, round(km2, 6) AS area_km2, round(dens, 9) AS density_km2 FROM ad")
def _(v):
    return qa.area_coverage(v.detections, ["zone_id"], co.zone_centres(v.zones)).select("zone_id", "n", r("area_km2", 6), r("density_km2", 9))


METRICS = f"""{AREAS}, m AS ({MOVED} detections), {coverage_sql('m')}, hit AS (SELECT m.zone_id, is_control FROM m, ar WHERE {hav('lon', 'lat', 'alon', 'alat')} / 1000 <= radius_km),
  hc AS (SELECT zone_id, count(*) FILTER (NOT is_control) AS tp, count(*) FILTER (is_control) AS fp FROM hit GROUP BY zone_id)"""


@query(
    "f24_validation_metrics",
    f"""{METRICS} SELECT ad.zone_id, n, round(km2, 6) AS area_km2, round(dens, 9) AS density_km2, coalesce(tp, 0) AS true_positives, coalesce(fp, 0) AS false_positives,
    round(coalesce(tp, 0) / n::DOUBLE, 9) AS true_positive_rate, round(coalesce(fp, 0) / n::DOUBLE, 9) AS false_positive_rate FROM ad LEFT JOIN hc ON hc.zone_id = ad.zone_id""",
)
def _(v):
    m = qa.validation_metrics(v.sql(MOVED + "{detections}"), ["zone_id"], co.zone_centres(v.zones))
    return m.select(
        "zone_id", "n", r("area_km2", 6), r("density_km2", 9), "true_positives", "false_positives", r("true_positive_rate", 9), r("false_positive_rate", 9)
    )


FLAGS = f"""fl AS (SELECT det_id, printf('Very large feature (%.1f hectares)', area_m2 / 10000) AS flag_reason, 'medium' AS severity FROM m WHERE area_m2 > 100000
    UNION ALL SELECT det_id, 'Perfect cardinal alignment suggests processing artifact', 'medium' FROM m WHERE det_type IN ('line', 'rectangle') AND ((angle_degrees % 90) + 90) % 90 < 2
    UNION ALL SELECT det_id, 'Unrealistically high confidence (>98%)', 'medium' FROM m WHERE coalesce(confidence, 0) > 0.98E0
    UNION ALL SELECT det_id, 'Below minimum archaeological confidence threshold (50%)', 'high' FROM m WHERE coalesce(confidence, 0) < 0.5E0
    UNION ALL SELECT det_id, printf('Low archaeological confidence (%.0f%% < 60%%)', confidence * 100), 'medium' FROM m WHERE confidence >= 0.5E0 AND confidence < 0.6E0
    UNION ALL SELECT det_id, 'High confidence detection in ' || area_type, 'high' FROM m, ar WHERE is_control AND confidence > 0.8E0 AND {hav('lon', 'lat', 'alon', 'alat')} / 1000 <= radius_km)"""


@query("p07_detection_flags", f"{AREAS}, m AS ({MOVED} detections), {FLAGS} SELECT * FROM fl")
def _(v):
    return qa.detection_flags(v.sql(MOVED + "{detections}")).select("det_id", "flag_reason", "severity")


@query(
    "p07_density_flags",
    f"""{coverage_sql('detections')}, x AS (SELECT zone_id, 'density_per_100km2_above_expected' AS flag_reason, 'high' AS severity FROM ad WHERE dens * 100 > 5 UNION ALL SELECT zone_id, 'density_per_100km2_below_expected', 'medium' FROM ad WHERE dens * 100 < 0.01E0
    UNION ALL SELECT zone_id, 'density_per_km2_above_floodplain', 'high' FROM ad WHERE dens > 50 UNION ALL SELECT zone_id, 'density_per_km2_above_expected', 'medium' FROM ad WHERE dens > 5 AND dens <= 50) SELECT * FROM x""",
)
def _(v):
    return qa.density_flags(qa.area_coverage(v.detections, ["zone_id"], co.zone_centres(v.zones)), ["zone_id"])


@query(
    "p07_recommendations",
    f"""{METRICS}, {FLAGS}, fz AS (SELECT m.zone_id, count(*) AS k FROM fl JOIN m ON m.det_id = fl.det_id GROUP BY m.zone_id)
    SELECT ad.zone_id, concat_ws('; ', CASE WHEN coalesce(fp, 0) > coalesce(tp, 0) THEN 'High false positive rate detected - increase confidence thresholds' END, CASE WHEN dens > 5 THEN 'Detection density appears high - verify algorithms are not over-detecting' END,
      CASE WHEN coalesce(k, 0) > n * 0.2E0 THEN 'More than 20% of detections flagged - review detection parameters' END) AS recommendations FROM ad LEFT JOIN hc ON hc.zone_id = ad.zone_id LEFT JOIN fz ON fz.zone_id = ad.zone_id""",
)
def _(v):
    m = v.sql(MOVED + "{detections}")
    flags = qa.detection_flags(m).join(m.select("det_id", "zone_id"), "det_id").groupBy("zone_id").agg(F.count(F.lit(1)).alias("k"))
    metrics = qa.validation_metrics(m, ["zone_id"], co.zone_centres(v.zones)).join(flags, "zone_id", "left")
    return qa.recommendations(metrics, F.coalesce("k", F.lit(0))).select("zone_id", "recommendations")


@query(
    "f25_convergence_validation",
    f"""{SCORED}, {SUPPORT}, g AS (SELECT count(*) AS n, count(*) FILTER (provider = 'sentinel2') AS n_spectral, count(*) FILTER (provider = 'gedi') AS n_lidar, count(convergence_distance_m) AS n_convergent, count(convergence_distance_m) / count(*)::DOUBLE AS rate,
      coalesce(avg(convergence_distance_m), 0) AS mean FROM su) SELECT n, n_spectral, n_lidar, n_convergent, round(rate, 9) AS rate, round(mean, 5) AS mean_distance_m,
      CASE WHEN rate > 0.8E0 THEN 'excellent' WHEN rate > 0.6E0 THEN 'good' WHEN rate > 0.4E0 THEN 'moderate' ELSE 'poor' END AS quality, rate < 0.5E0 AS low_convergence_rate, mean > 300 AS large_convergence_distance, rate > 0.3E0 AS requirement_met FROM g""",
)
def _(v):
    return qa.convergence_quality(supported(v)).withColumn("rate", F.round("rate", 9)).withColumn("mean_distance_m", F.round("mean_distance_m", 5))


AREA5 = "SELECT det_id, lon, lat, CAST(CAST(floor(area_m2 / 600) AS BIGINT) AS DOUBLE) * 600 AS area_m2 FROM "


@query("f26_identical_areas", f"a AS ({AREA5} detections) SELECT area_m2, count(*) AS n FROM a GROUP BY area_m2 HAVING count(*) > 5")
def _(v):
    return qa.identical_areas(v.sql(AREA5 + "{detections}"))


@query(
    "f26_crowded_features",
    f"{NN} SELECT d.det_id, round(sqrt(area_m2), 6) AS size_m, round(nn.d * 111000, 4) AS nearest_m FROM detections d JOIN nn ON nn.det_id = d.det_id WHERE sqrt(area_m2) > nn.d * 111000 * 0.8E0",
)
def _(v):
    return qa.crowded_features(v.detections, "det_id").select("det_id", r("size_m", 6), r("nearest_m", 4))


@query(
    "f27_feature_counts",
    """SELECT count(*) FILTER (det_type = 'gedi_clearing') AS lidar_clearings, count(*) FILTER (det_type = 'gedi_earthwork') AS lidar_earthworks, count(*) FILTER (det_type = 'terra_preta') AS terra_preta_sites,
    count(*) FILTER (det_type IN ('circle', 'line', 'rectangle')) AS geometric_patterns, count(*) FILTER (det_type LIKE 'crop%') AS crop_marks, count(*) FILTER (provider = 'sentinel2') AS total_spectral, count(*) FILTER (provider = 'gedi') AS total_lidar FROM detections""",
)
def _(v):
    return rp.feature_counts(v.detections)


@query(
    "f28_executive_summary",
    f"""{SCORES} SELECT count(*) AS zones, count(*) FILTER (total_score >= 10) AS high_confidence_sites, count(*) FILTER (total_score >= 7) AS probable_features, (SELECT count(*) FROM detections) AS total_features,
    arg_max(zone_name, struct_pack(s := total_score, i := -zone_id)) AS best_zone, round(max(total_score), 8) AS best_score, arg_max(classification, struct_pack(s := total_score, i := -zone_id)) AS best_class,
    round(avg(CASE WHEN total_score >= 7 THEN 1E0 ELSE 0E0 END) * 100, 8) AS success_pct FROM zc""",
)
def _(v):
    s = rp.executive_summary(scores(v), v.detections)
    return s.withColumn("best_score", F.round("best_score", 8)).withColumn("success_pct", F.round("success_pct", 8))


BREAK = "pb AS (SELECT zone_id, count(*) FILTER (provider = 'gedi') AS lidar_features, count(*) FILTER (provider = 'sentinel2') AS spectral_features, count(DISTINCT CASE WHEN provider = 'gedi' THEN det_type END) AS lidar_types, count(DISTINCT CASE WHEN provider = 'sentinel2' THEN det_type END) AS spectral_types FROM detections GROUP BY zone_id)"
ACTION = f"CASE WHEN total_score >= 10 THEN {q(L.ZONE_ACTION[0])} WHEN total_score >= 7 THEN {q(L.ZONE_ACTION[1])} WHEN total_score >= 4 THEN {q(L.ZONE_ACTION[2])} ELSE {q(L.ZONE_ACTION[3])} END"


@query(
    "f29_zone_details",
    f"""{SCORES}, {BREAK} SELECT zc.zone_id, zc.zone_name, zc.priority, round(total_score, 8) AS total_score, classification, coalesce(lidar_features, 0) AS lidar_features, coalesce(spectral_features, 0) AS spectral_features,
    coalesce(lidar_types, 0) AS lidar_types, coalesce(spectral_types, 0) AS spectral_types, {ACTION} AS recommended_action FROM zc LEFT JOIN pb ON pb.zone_id = zc.zone_id""",
)
def _(v):
    return rp.zone_details(v.zones, scores(v), v.detections).withColumn("total_score", F.round("total_score", 8))


@query(
    "f30_high_priority_sites",
    f"""{SCORES}, c AS (SELECT *, 30000 + CASE WHEN total_score >= 10 THEN 20000 ELSE 0 END + CASE WHEN contains(zone_name, 'Upper') THEN 15000 ELSE 0 END AS cost FROM zc WHERE total_score >= 7)
    SELECT zone_id, zone_name, round(total_score, 8) AS anomaly_score, classification, CAST(CASE WHEN total_score >= 10 THEN 1 ELSE 2 END AS INT) AS priority_ranking, CASE WHEN contains(zone_name, 'Upper') THEN {q(L.ACCESS_DIFFICULTY[0])}
    WHEN contains(zone_name, 'Confluence') THEN {q(L.ACCESS_DIFFICULTY[1])} ELSE {q(L.ACCESS_DIFFICULTY[2])} END AS access_difficulty, CAST(cost AS INT) AS cost_from_usd, CAST(cost + 10000 AS INT) AS cost_to_usd FROM c""",
)
def _(v):
    return rp.high_priority_sites(scores(v)).withColumn("anomaly_score", F.round("anomaly_score", 8))


@query("f31_provider_analysis", "SELECT provider, count(DISTINCT zone_id) AS zones_covered, count(*) AS total_features, round(avg(CASE WHEN n_points > 0 THEN n_points END), 8) AS mean_points FROM detections GROUP BY provider")
def _(v):
    return rp.provider_analysis(v.detections).withColumn("mean_points", F.round("mean_points", 8))


BAND = "CASE WHEN det_type = 'gedi_clearing' THEN CASE WHEN n_points >= 5 THEN 'high' ELSE 'medium' END WHEN det_type = 'gedi_earthwork' THEN CASE WHEN n_points >= 4 THEN 'high' ELSE 'medium' END WHEN coalesce(confidence, 0) > 0.8E0 THEN 'high' WHEN confidence > 0.6E0 THEN 'medium' ELSE 'low' END"


@query("f32_feature_inventory", f"b AS (SELECT det_type, zone_id, {BAND} AS band FROM detections) SELECT det_type, zone_id, band, count(*) AS n FROM b GROUP BY GROUPING SETS ((det_type), (zone_id), (band), ())")
def _(v):
    return rp.feature_inventory(v.detections)


QUAL = "qz AS (SELECT zone_id, count(*) AS n, CAST(CASE WHEN count(*) > 1000 THEN 30 WHEN count(*) > 500 THEN 20 WHEN count(*) > 100 THEN 10 ELSE 0 END + CASE WHEN count(rh100) > 0 THEN 35 ELSE 0 END + CASE WHEN count(elevation_ground) > 0 THEN 35 ELSE 0 END AS INT) AS quality_score FROM shots GROUP BY zone_id)"


@query("f33_data_quality", f"{QUAL} SELECT *, CASE WHEN quality_score >= 80 THEN 'Excellent' WHEN quality_score >= 60 THEN 'Good' WHEN quality_score >= 40 THEN 'Fair' ELSE 'Poor' END AS quality_level FROM qz")
def _(v):
    return rp.data_quality(v.shots)


@query(
    "f33_overall_quality",
    f"""{QUAL}, s AS (SELECT count(DISTINCT scene_id) AS k FROM pixels), o AS (SELECT avg(quality_score) AS lm, (sum(quality_score) + any_value(k) * 75) / (count(*) + any_value(k)) AS om FROM qz, s)
    SELECT round(lm, 8) AS lidar_mean, round(om, 8) AS overall_mean, CASE WHEN om >= 80 THEN 'Excellent' WHEN om >= 60 THEN 'Good' WHEN om >= 40 THEN 'Fair' ELSE 'Poor' END AS overall_level FROM o""",
)
def _(v):
    n = v.pixels.agg(F.count_distinct("scene_id")).scalar()
    o = rp.overall_quality(rp.data_quality(v.shots), n)
    return o.select(r("lidar_mean"), r("overall_mean"), "overall_level")


@query("f34_technical_summary", "SELECT count(*) AS scenes, count(*) FILTER (cloud_cover < 50) AS successful, round(avg(CASE WHEN cloud_cover < 50 THEN 1E0 ELSE 0E0 END) * 100, 8) AS success_pct, (SELECT count(*) FROM shots) AS lidar_points FROM scenes")
def _(v):
    return rp.technical_summary(v.scenes, F.col("cloud_cover") < 50, v.shots).withColumn("success_pct", F.round("success_pct", 8))


@query(
    "f35_resource_plan",
    f"""{SCORES}, c AS (SELECT count(*) FILTER (total_score >= 10) AS high, count(*) FILTER (total_score >= 7 AND total_score < 10) AS probable, count(*) FILTER (total_score < 4) AS reanalyse FROM zc)
    SELECT *, greatest(1, CAST(floor((high + probable) / 2) AS BIGINT)) AS teams, greatest(3, (high + probable) * 4) AS min_days, (high + probable) * 6 AS max_days, high * 60000 + probable * 35000 AS budget_usd FROM c""",
)
def _(v):
    return rp.resource_plan(scores(v))


@query(
    "f36_source_statistics",
    """g AS (SELECT provider, count(*) AS n, avg(confidence) AS mean, min(confidence) AS min, max(confidence) AS max, quantile_cont(confidence, 0.5) AS median FROM detections GROUP BY provider)
    SELECT provider, n, round(mean, 8) AS mean, min, max, round(median, 9) AS median, (SELECT max(n) > min(n) * 10 FROM g) AS unbalanced FROM g""",
)
def _(v):
    s = rp.source_statistics(v.detections)
    return s.select("provider", "n", r("mean"), "min", "max", r("median", 9), "unbalanced")


@query(
    "f37_map_bounds",
    """g AS (SELECT max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west, count(*) AS n FROM detections)
    SELECT north, south, east, west, round((north + south) / 2, 9) AS centre_lat, round((east + west) / 2, 9) AS centre_lon, CAST(CASE WHEN greatest(north - south, east - west) > 5 THEN 14 WHEN greatest(north - south, east - west) > 2 THEN 16
    WHEN greatest(north - south, east - west) > 1 THEN 17 WHEN greatest(north - south, east - west) > 0.5E0 THEN 18 ELSE 19 END AS INT) AS zoom, round((north - south) * (east - west) * 111.32E0 * 111.32E0, 6) AS area_km2,
    round(n / ((north - south) * (east - west) * 111.32E0 * 111.32E0), 9) AS features_per_km2, 1.0E0 AS quality_score FROM g""",
)
def _(v):
    m = rp.map_bounds(v.detections)
    return m.select("north", "south", "east", "west", r("centre_lat", 9), r("centre_lon", 9), "zoom", r("area_km2", 6), r("features_per_km2", 9), "quality_score")


@query(
    "f38_lidar_coverage",
    """SELECT zone_id, min(elevation_ground) AS min_elevation, max(elevation_ground) AS max_elevation, round(max(elevation_ground) - min(elevation_ground), 8) AS elevation_range, round(avg(elevation_ground), 8) AS mean_elevation,
    round((max(lat) - min(lat)) * (max(lon) - min(lon)) * 111.32E0 * 111.32E0, 6) AS area_km2 FROM shots GROUP BY zone_id""",
)
def _(v):
    c = rp.lidar_coverage(v.shots, ["zone_id"])
    return c.select("zone_id", "min_elevation", "max_elevation", r("elevation_range"), r("mean_elevation"), r("area_km2", 6))


@query(
    "f39_convergence_summary",
    f"""{FIRST} SELECT count(*) FILTER (convergence_type = 'multi_sensor') AS cross_validated, count(*) FILTER (convergence_type = 'sentinel2_only') AS spectral_only, count(*) FILTER (convergence_type = 'gedi_only') AS lidar_only,
    count(*) AS total, round(avg(CASE WHEN convergence_type = 'multi_sensor' THEN 1E0 ELSE 0E0 END), 9) AS cross_validation_rate FROM e3""",
)
def _(v):
    return rp.convergence_summary(sp.first_match(v.detections)).withColumn("cross_validation_rate", F.round("cross_validation_rate", 9))


@query("f40_layer_counts", f"ly AS ({LAYERS.format(d='detections')}) SELECT layer, count(*) AS n FROM ly GROUP BY layer")
def _(v):
    return rp.layer_counts(v.sql(LAYERS.format(d="{detections}")))


RULES = [
    dict(name="multiple_sources", type="min_count", column="provider", distinct=True, n=2),
    dict(name="five_anomalies", type="min_count", n=3),
    dict(name="dataset_ids_logged", type="not_empty", column="det_id"),
    dict(name="very_confident", type="min_value", column="confidence", n=0.9995),
    dict(name="has_both_families", type="contains", column="det_type", items=["terra_preta", "gedi_clearing"]),
    dict(name="has_unknown_family", type="contains", column="det_type", items=["terra_preta", "raised_field"]),
    dict(name="exists", type="exists", column="confidence"),
]


@query(
    "f41_requirement_checks",
    """SELECT 'multiple_sources' AS requirement, count(DISTINCT provider) >= 2 AS met FROM detections UNION ALL SELECT 'five_anomalies', count(*) >= 3 FROM detections UNION ALL SELECT 'dataset_ids_logged', count(det_id) > 0 FROM detections
    UNION ALL SELECT 'very_confident', max(confidence) >= 0.9995E0 FROM detections UNION ALL SELECT 'has_both_families', bool_or(det_type = 'terra_preta') AND bool_or(det_type = 'gedi_clearing') FROM detections
    UNION ALL SELECT 'has_unknown_family', bool_or(det_type = 'terra_preta') AND bool_or(det_type = 'raised_field') FROM detections UNION ALL SELECT 'exists', count(confidence) > 0 FROM detections""",
)
def _(v):
    return qa.check_requirements(v.detections, RULES)
