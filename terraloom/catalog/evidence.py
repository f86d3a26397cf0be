"""Queries over zone evidence, rankings and set operations: F9-F19, G5, G6, H1, H2, H5, I1-I5, A13."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.registry import query
from terraloom.catalog.scalars import PVAL
from terraloom.catalog.spatial import PAIRS, SCORED, SUPPORT
from terraloom.functions import labels as L
from terraloom.operators import evidence as ev
from terraloom.operators import ranking as rk
from terraloom.operators import spatial as sp

AGG = """dz AS (SELECT d.*, 2 * sqrt(area_m2 / pi()) AS diameter_m, zone_type, zone_name, priority, coalesce(confidence, 0.5E0) AS ch, coalesce(confidence, 0) AS cz FROM detections d JOIN zones USING (zone_id)),
  shp AS (SELECT zone_id, det_type, zone_type, count(*) AS n, avg(ch) AS conf, count(*) FILTER (diameter_m > 150) AS bigc, count(*) FILTER (length_m > CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 50 ELSE 500 END) AS bigl,
    count(*) FILTER (area_m2 > 10000) AS bigr, arg_min(lon, det_id) AS lon, arg_min(lat, det_id) AS lat FROM dz WHERE det_type IN ('circle', 'line', 'rectangle') GROUP BY 1, 2, 3),
  ge AS (SELECT zone_id, 'geometric_' || det_type AS type, 3 * conf * CASE det_type WHEN 'circle' THEN CASE WHEN bigc > 0 THEN 1 ELSE 0.7E0 END WHEN 'line' THEN CASE WHEN bigl = 0 THEN 0
      WHEN zone_type = 'deforested_visible_earthworks' AND bigl > 100 THEN 1.2E0 WHEN bigl > 20 THEN 1 ELSE 0.8E0 END ELSE CASE WHEN bigr > 0 THEN 0.9E0 ELSE 0 END END AS weight, conf AS confidence, lon, lat FROM shp),
  pt AS (SELECT zone_id, count(*) AS n, sum(area_m2) AS area, avg(cz) AS conf, arg_min(lon, det_id) AS lon, arg_min(lat, det_id) AS lat FROM dz WHERE det_type = 'terra_preta' AND cz > 0.3E0 AND area_m2 > 900 GROUP BY zone_id),
  te AS (SELECT zone_id, 'terra_preta_signature' AS type, least(3, 2 + CASE WHEN area > 10000 THEN 0.5E0 ELSE 0 END + (conf - 0.3E0) * 0.5E0) AS weight, conf AS confidence, lon, lat FROM pt),
  evi AS (SELECT * FROM ge WHERE weight > 0 UNION ALL SELECT * FROM te UNION ALL SELECT zone_id, 'environmental_suitability', 1, 0.8E0, (west + east) / 2, (south + north) / 2 FROM zones
    UNION ALL SELECT zone_id, 'priority_bonus', 1, 1.0E0, (west + east) / 2, (south + north) / 2 FROM zones WHERE priority = 1)"""
BONUS = f"""{AGG}, st AS (SELECT zone_id, coalesce(sum(weight) FILTER (type LIKE 'geometric%') * avg(confidence) FILTER (type LIKE 'geometric%'), 0) AS g, coalesce(sum(weight) FILTER (type LIKE 'terra%') * avg(confidence) FILTER (type LIKE 'terra%'), 0) AS s,
    coalesce(sum(weight) FILTER (type LIKE 'env%' OR type LIKE 'pri%') * avg(confidence) FILTER (type LIKE 'env%' OR type LIKE 'pri%'), 0) AS c, count(*) AS n, count(DISTINCT type) AS k FROM evi GROUP BY zone_id),
  ib AS (SELECT zone_id, n AS evidence_count, CASE WHEN n < 2 THEN 0 ELSE least(3, CASE WHEN g > 0 AND s > 0 THEN (g + s) / 2 * 1.5E0 WHEN g > 1 OR s > 1 THEN greatest(g, s) * 0.8E0 ELSE 0 END + CASE WHEN c > 0 THEN c * 0.5E0 ELSE 0 END + k * 0.3E0) END AS bonus FROM st)"""
ENV = "1 + CASE WHEN lower(zone_name) LIKE '%confluence%' OR lower(zone_name) LIKE '%junction%' THEN 0.3E0 ELSE 0 END + CASE WHEN (south + north) / 2 > -5 AND (south + north) / 2 < 0 AND (west + east) / 2 > -65 AND (west + east) / 2 < -55 THEN 0.2E0 ELSE 0 END"
SCORES = f"""{BONUS}, sc AS (SELECT z.zone_id, z.zone_name, z.priority, coalesce((SELECT least(6, coalesce(sum(weight), 0)) FROM ge WHERE ge.zone_id = z.zone_id), 0) AS geometric, coalesce((SELECT weight FROM te WHERE te.zone_id = z.zone_id), 0) AS terra_preta,
    {ENV} AS environment, CASE WHEN priority = 1 THEN 1 ELSE 0 END AS priority_bonus, ib.bonus AS integration_bonus, ib.evidence_count FROM zones z JOIN ib ON ib.zone_id = z.zone_id),
  zs AS (SELECT *, least(13, geometric + terra_preta + environment + priority_bonus + integration_bonus) AS total_score FROM sc),
  zc AS (SELECT *, CASE WHEN total_score >= 10 THEN 'HIGH CONFIDENCE ARCHAEOLOGICAL SITE' WHEN total_score >= 7 THEN 'PROBABLE ARCHAEOLOGICAL FEATURE' WHEN total_score >= 4 THEN 'POSSIBLE ANOMALY - INVESTIGATE' ELSE 'NATURAL VARIATION' END AS classification FROM zs)"""


def dets(v):
    return v.detections.withColumn("diameter_m", 2 * F.sqrt(F.col("area_m2") / F.pi()))


def aggs(v):
    return ev.zone_aggregates(dets(v), v.zones)


def scores(v):
    return ev.zone_scores(dets(v), v.zones)


def r(c, n=8):
    return F.round(c, n).alias(c)


@query("f09_geometric_evidence", f"{AGG} SELECT z.zone_id, round(coalesce((SELECT least(6, coalesce(sum(weight), 0)) FROM ge WHERE ge.zone_id = z.zone_id), 0), 8) AS geometric FROM zones z")
def _(v):
    return aggs(v).select("zone_id", F.round(ev.geometric_score(), 8).alias("geometric"))


@query("f10_terra_preta_evidence", f"{AGG} SELECT z.zone_id, round(coalesce(te.weight, 0), 8) AS terra_preta FROM zones z LEFT JOIN te ON te.zone_id = z.zone_id")
def _(v):
    return aggs(v).select("zone_id", F.round(ev.terra_preta_score(), 8).alias("terra_preta"))


@query(
    "f11_environment_and_priority",
    f"SELECT det_id, round({ENV}, 8) AS environment, CASE WHEN priority = 1 THEN 1.0E0 ELSE 0.0E0 END AS priority_bonus FROM detections JOIN zones USING (zone_id)",
)
def _(v):
    z = v.zones.withColumn("centre_lat", (F.col("south") + F.col("north")) / 2).withColumn("centre_lon", (F.col("west") + F.col("east")) / 2)
    z = z.select("zone_id", F.round(ev.environment_score(), 8).alias("environment"), ev.priority_bonus().alias("priority_bonus"))
    return v.detections.select("det_id", "zone_id").join(z, "zone_id").drop("zone_id")


@query("f12_integration_bonus", f"{BONUS} SELECT zone_id, round(bonus, 8) AS integration_bonus, evidence_count FROM ib")
def _(v):
    return ev.integration_bonus(ev.evidence_rows(aggs(v))).select("zone_id", r("integration_bonus"), "evidence_count")


PARTS = ("geometric", "terra_preta", "environment", "integration_bonus", "total_score")


@query("f13_zone_score", f"{SCORES} SELECT zone_id, {', '.join(f'round({p}, 8) AS {p}' for p in PARTS)}, classification FROM zc")
def _(v):
    return scores(v).select("zone_id", *[r(p) for p in PARTS], "classification")


@query(
    "f14_confidence_metrics",
    f"""{AGG}, b AS (SELECT zone_id, sum(weight * confidence) / sum(weight) AS oc, least(1, count(DISTINCT type) / 5.0E0) AS es FROM evi GROUP BY zone_id),
    pd AS (SELECT a.zone_id, avg(sqrt((a.lon - c.lon) * (a.lon - c.lon) + (a.lat - c.lat) * (a.lat - c.lat))) AS d FROM evi a JOIN evi c ON c.zone_id = a.zone_id AND a.type < c.type GROUP BY a.zone_id),
    m AS (SELECT b.*, CASE WHEN d IS NULL THEN 0.5E0 ELSE greatest(0, 1 - d * 10) END AS co FROM b LEFT JOIN pd ON pd.zone_id = b.zone_id)
    SELECT zone_id, round(oc, 8) AS overall_confidence, round(es, 8) AS evidence_strength, round(co, 8) AS spatial_coherence, round((oc + es + co) / 3, 8) AS composite_confidence FROM m""",
)
def _(v):
    m = ev.confidence_metrics(ev.evidence_rows(aggs(v)))
    return m.select("zone_id", *[r(c) for c in ("overall_confidence", "evidence_strength", "spatial_coherence", "composite_confidence")])


@query(
    "f15_feature_details",
    """d AS (SELECT *, 2 * sqrt(area_m2 / pi()) AS diameter_m FROM detections WHERE det_type IN ('terra_preta', 'circle', 'line', 'rectangle'))
    SELECT zone_id, det_type, count(*) AS n, round(avg(coalesce(confidence, 0)), 8) AS mean_confidence, round(avg(CASE WHEN det_type = 'circle' THEN diameter_m END), 6) AS mean_diameter_m, round(min(CASE WHEN det_type = 'circle' THEN diameter_m END), 6) AS min_diameter_m,
    round(max(CASE WHEN det_type = 'circle' THEN diameter_m END), 6) AS max_diameter_m, round(avg(CASE WHEN det_type = 'line' THEN length_m END), 6) AS mean_length_m, round(sum(CASE WHEN det_type = 'line' THEN length_m END) / 1000, 6) AS total_length_km,
    round(sum(CASE WHEN det_type IN ('terra_preta', 'rectangle') THEN area_m2 END) / 10000, 6) AS total_area_ha FROM d GROUP BY 1, 2""",
)
def _(v):
    f = ev.feature_details(dets(v))
    names = [c for c in f.columns if c.endswith(("_m", "_km", "_ha"))]
    return f.select("zone_id", "det_type", "n", r("mean_confidence"), *[r(c, 6) for c in names])


@query(
    "f16_scoring_summary",
    f"""{SCORES} SELECT count(*) AS zones, round(avg(total_score), 8) AS mean_score, round(quantile_cont(total_score, 0.5), 8) AS median_score, round(max(total_score), 8) AS max_score, round(min(total_score), 8) AS min_score, round(stddev_pop(total_score), 8) AS std_score,
    count(*) FILTER (classification LIKE 'HIGH%') AS high_confidence, count(*) FILTER (classification LIKE 'PROB%') AS probable, count(*) FILTER (classification LIKE 'POSS%') AS possible, count(*) FILTER (classification LIKE 'NAT%') AS natural,
    round(avg(CASE WHEN total_score >= 7 THEN 1E0 ELSE 0E0 END) * 100, 8) AS success_pct FROM zc""",
)
def _(v):
    s = ev.scoring_summary(scores(v))
    return s.select("zones", *[r(f"{c}_score") for c in ("mean", "median", "max", "min", "std")], "high_confidence", "probable", "possible", "natural", r("success_pct"))


@query("h05_top_zones", f"{SCORES} SELECT zone_id, round(total_score, 8) AS total_score FROM zc ORDER BY zc.total_score DESC, zone_id LIMIT 3")
def _(v):
    return ev.top_zones(scores(v)).select("zone_id", r("total_score"))


@query(
    "f17_lidar_evidence",
    """g AS (SELECT zone_id, count(*) FILTER (det_type = 'gedi_clearing') AS a, count(*) FILTER (det_type = 'gedi_earthwork') AS b FROM detections GROUP BY zone_id)
    SELECT zone_id, round(least(1, a / 10.0E0), 8) AS gap_confidence, round(least(1, b / 5.0E0), 8) AS elevation_confidence, round(3 * least(1, a / 10.0E0) + 4 * least(1, b / 5.0E0), 8) AS lidar_score FROM g""",
)
def _(v):
    return ev.lidar_evidence(aggs(v)).select("zone_id", r("gap_confidence"), r("elevation_confidence"), r("lidar_score"))


SENS = """se AS (SELECT z.zone_id, coalesce(avg(CASE WHEN provider = 'gedi' THEN coalesce(confidence, 0.5E0) END), 0) AS lidar, coalesce(avg(CASE WHEN det_type = 'terra_preta' THEN coalesce(confidence, 0.5E0) END), 0) AS spectral
  FROM zones z LEFT JOIN detections d ON d.zone_id = z.zone_id GROUP BY z.zone_id), sn AS (SELECT *, CASE WHEN lidar > 0 AND spectral > 0 THEN 0.7E0 ELSE 0.3E0 END AS temporal FROM se)"""


@query("f18_sensor_confidence", f"{SENS} SELECT zone_id, round(lidar, 8) AS lidar, round(spectral, 8) AS spectral, temporal FROM sn")
def _(v):
    return ev.sensor_confidence(aggs(v)).select("zone_id", r("lidar"), r("spectral"), "temporal")


SITES = f"""{SENS}, cs AS (SELECT *, least(1, lidar * 0.35E0 + spectral * 0.35E0 + temporal * 0.2E0 + CASE WHEN lidar > 0.4E0 AND spectral > 0.4E0 THEN 0.1E0 ELSE 0 END) AS score FROM sn),
  ce AS (SELECT *, (score - 0.12E0) / 0.18E0 AS d, least(abs((score - 0.12E0) / 0.18E0) / sqrt(2), 6) AS x FROM cs), cp AS (SELECT *, {PVAL} AS p FROM ce),
  si AS (SELECT *, d >= 0.5E0 AND p < 0.01E0 AS ok, CASE WHEN d >= 0.8E0 AND p < 0.001E0 THEN 'EXCEPTIONAL' WHEN d >= 0.5E0 AND p < 0.01E0 THEN 'HIGH' WHEN d >= 0.3E0 AND p < 0.05E0 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM cp)"""


@query(
    "f19_publication_statistics",
    f"""{SITES}, ps AS (SELECT count(*) AS sites, count(*) FILTER (ok) AS meeting_standards, round(avg(d), 8) AS mean_effect, round(quantile_cont(p, 0.5), 9) AS median_p, count(*) FILTER (level = 'EXCEPTIONAL') AS exceptional, count(*) FILTER (level = 'HIGH') AS high,
    count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'LOW') AS low, round(avg(CASE WHEN d >= 0.8E0 AND p < 0.01E0 THEN 1E0 ELSE 0E0 END), 8) AS statistical_power FROM si)
    SELECT *, CASE WHEN exceptional >= 2 THEN '{'; '.join(L.JOURNALS['exceptional'])}' WHEN meeting_standards >= 1 THEN '{'; '.join(L.JOURNALS['standard'])}' ELSE '{'; '.join(L.JOURNALS['other'])}' END AS journals FROM ps""",
)
def _(v):
    p = ev.publication_statistics(ev.site_confidence(ev.sensor_confidence(aggs(v))))
    j = p.withColumn("journals", ev.recommended_journals(p).select("journals").scalar())
    return j.select(
        "sites", "meeting_standards", r("mean_effect"), r("median_p", 9), "exceptional", "high", "medium", "low", r("statistical_power"), "journals"
    )


def supported(v):
    return sp.with_pair_support(v.detections, sp.scored_pairs(v.detections))


PRIO = f"""{SCORED}, {SUPPORT}, pr AS (SELECT *, coalesce(confidence, 0) + CASE WHEN lidar_support OR spectral_support THEN 10 ELSE 0 END + CASE WHEN convergent_score > 0 THEN convergent_score * 1.5E0 ELSE 0 END
    + CASE WHEN area_m2 > 50000 THEN 1 WHEN area_m2 > 10000 THEN 0.5E0 ELSE 0 END + CASE WHEN det_type LIKE '%terra_preta%' THEN 0.5E0 ELSE 0 END + CASE WHEN det_type LIKE '%gedi_clearing%' THEN 0.3E0 ELSE 0 END AS ps FROM su),
  pk AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY round(ps, 9) DESC, det_id) AS rk FROM pr)"""


def top_candidates(v):
    d = supported(v)
    return rk.prioritised(d)


@query("h01_top_priority", f"{PRIO} SELECT zone_id, det_id, round(ps, 7) AS priority_score FROM pk WHERE rk <= 5")
def _(v):
    return top_candidates(v).select("zone_id", "det_id", r("priority_score", 7))


@query("g06_priority_rank", f"{PRIO} SELECT zone_id, det_id, CAST(rk AS INT) AS priority_rank, CASE WHEN rk <= 3 THEN 'high' ELSE 'medium' END AS field_priority FROM pk WHERE rk <= 5")
def _(v):
    return top_candidates(v).select("zone_id", "det_id", "priority_rank", "field_priority")


CAND = f"""{PAIRS}, b AS (SELECT det_id, max(strength) AS s FROM (SELECT id1 AS det_id, strength FROM e1 UNION ALL SELECT id2, strength FROM e1) u GROUP BY det_id),
  cv AS (SELECT d.*, coalesce(s, 0) AS conv, provider = 'gedi' OR s IS NOT NULL AS l, provider = 'sentinel2' OR s IS NOT NULL AS t FROM detections d LEFT JOIN b ON b.det_id = d.det_id),
  cd AS (SELECT *, coalesce(confidence, 0) * 0.4E0 + conv * 0.4E0 + CASE WHEN l THEN 0.1E0 ELSE 0 END + CASE WHEN t THEN 0.1E0 ELSE 0 END + CASE WHEN det_type LIKE '%gedi_clearing%' THEN 0.3E0 WHEN det_type LIKE '%crop_mark%' THEN 0.2E0
    WHEN det_type LIKE '%earthwork%' THEN 0.25E0 WHEN det_type LIKE '%geometric%' THEN 0.15E0 ELSE 0 END + CASE WHEN conv > 0 THEN 0.5E0 ELSE 0 END + CASE WHEN l AND t THEN 0.4E0 WHEN provider = 'gedi' THEN 0.2E0 ELSE 0 END AS es FROM cv)"""


def candidates(v):
    d = sp.convergence_per_detection(v.detections)
    return rk.with_candidate_score(d).withColumn("enhanced_score", F.round("enhanced_score", 9))


@query("h02_candidate_ranking", f"{CAND} SELECT det_id, round(es, 9) AS enhanced_score FROM cd")
def _(v):
    return candidates(v).select("det_id", "enhanced_score").orderBy(F.desc("enhanced_score"), "det_id")


# Convergence is near-universal in the sample, so the diversity rule is exercised with a narrower radius.
DIV = CAND.replace("WHERE d <= 1500", "WHERE d <= 60").replace("1 - d / 1500", "1 - d / 60")


@query(
    "g05_diverse_top",
    f"""{DIV}, rs AS (SELECT det_id, det_type, round(es, 9) AS es, conv, row_number() OVER (PARTITION BY det_type ORDER BY round(es, 9) DESC, det_id) AS rn FROM cd),
    o AS (SELECT *, CASE WHEN rn <= 7 OR conv > 0 THEN 0 ELSE 1 END AS late FROM rs) SELECT det_id, det_type, CAST(row_number() OVER (ORDER BY late, es DESC, det_id) AS INT) AS rank FROM o ORDER BY late, es DESC, det_id LIMIT 30""",
)
def _(v):
    d = sp.convergence_per_detection(v.detections, 60.0)
    c = rk.with_candidate_score(d).withColumn("enhanced_score", F.round("enhanced_score", 9))
    return rk.diverse_top(c, 30).select("det_id", "det_type", "rank")


@query(
    "i01_union_of_providers",
    """SELECT det_id, provider, lon, lat, CASE WHEN provider = 'gedi' THEN n_points END AS n_points, CASE WHEN provider = 'sentinel2' THEN area_m2 END AS area_m2 FROM detections""",
)
def _(v):
    a = v.detections.where("provider = 'gedi'").select("det_id", "provider", "lon", "lat", "n_points")
    b = v.detections.where("provider = 'sentinel2'").select("det_id", "provider", "lon", "lat", "area_m2")
    return a.unionByName(b, allowMissingColumns=True)


RESULTS = "SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN NULL ELSE 'scene_' || CAST(scene_id % 400 AS VARCHAR(20)) END AS path_key, 'zone_' || CAST(zone_id AS VARCHAR(20)) AS zone_key FROM "


@query("i02_unique_results", f"rs AS ({RESULTS} scenes) SELECT coalesce(path_key, zone_key) AS result_key, min(scene_id) AS scene_id FROM rs GROUP BY 1")
def _(v):
    src = v.sql(RESULTS.replace("VARCHAR(20)", "STRING") + "{scenes}")
    return rk.unique_first(src, ["path_key", "zone_key"], "scene_id").select("result_key", "scene_id")


@query(
    "i03_coverage_gaps",
    """d AS (SELECT * FROM detections WHERE confidence > 0.985E0) SELECT zone_id, 'gedi' AS missing FROM zones WHERE zone_id NOT IN (SELECT zone_id FROM d WHERE provider = 'gedi')
    UNION ALL SELECT zone_id, 'sentinel2' FROM zones WHERE zone_id NOT IN (SELECT zone_id FROM d WHERE provider = 'sentinel2')""",
)
def _(v):
    d = v.detections.where("confidence > 0.985")
    out = [rk.coverage_gaps(v.zones, d, p).withColumn("missing", F.lit(p)) for p in ("gedi", "sentinel2")]
    return out[0].unionByName(out[1])


@query("i04_distinct_ids", "SELECT DISTINCT zone_id, provider FROM detections")
def _(v):
    return v.detections.select("zone_id", "provider").distinct()
