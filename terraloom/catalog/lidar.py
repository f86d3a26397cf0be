"""Queries over shots and point clusters: D15-D17, F1, F3-F8, G1, G2, M1-M8."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.coordinates import hav
from terraloom.catalog.registry import query
from terraloom.catalog.scalars import beta_sql
from terraloom.catalog.spatial import SCORED
from terraloom.operators import density as de
from terraloom.operators import display as di
from terraloom.operators import lidar as li
from terraloom.operators import spatial as sp

MOUND_EPS, GAP_EPS = 0.02, 0.008  # wide enough for the spacing of the sample shots
LOCAL = """lm AS (SELECT *, max(rh95) OVER w AS localmax_rh95, max(rh100) OVER w AS localmax_rh100 FROM shots WINDOW w AS (PARTITION BY zone_id, beam ORDER BY shot_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
GAPS = f"{LOCAL}, gp AS (SELECT * FROM lm WHERE rh95 < 0.5E0 * localmax_rh95 OR rh100 < 0.5E0 * localmax_rh100)"
STATS = """es AS (SELECT zone_id, count(elevation_ground) AS n_valid, avg(elevation_ground) AS mu, stddev_pop(elevation_ground) AS sd FROM shots GROUP BY zone_id),
  an AS (SELECT s.*, mu, sd, CASE WHEN elevation_ground > mu + 2.5E0 * sd THEN 'mound' WHEN elevation_ground < mu - 2.5E0 * sd THEN 'ditch' END AS kind FROM shots s JOIN es ON es.zone_id = s.zone_id AND n_valid >= 10)"""


@query("g01_local_max", f"{LOCAL} SELECT shot_number, localmax_rh95, localmax_rh100 FROM lm")
def _(v):
    return li.with_local_max(v.shots).select("shot_number", "localmax_rh95", "localmax_rh100")


@query("d15_relative_gap", f"{GAPS} SELECT shot_number, zone_id FROM gp")
def _(v):
    return li.with_local_max(v.shots).where(li.relative_gap()).select("shot_number", "zone_id")


@query("d16_absolute_gap", "SELECT shot_number, zone_id FROM shots WHERE rh95 < 15 OR rh100 < 15")
def _(v):
    return v.shots.where(li.absolute_gap()).select("shot_number", "zone_id")


@query("f03_elevation_statistics", "SELECT zone_id, count(elevation_ground) AS n_valid, round(avg(elevation_ground), 8) AS mean_elevation, round(stddev_pop(elevation_ground), 8) AS std_elevation FROM shots GROUP BY zone_id")
def _(v):
    return li.elevation_stats(v.shots, ["zone_id"]).select(
        "zone_id", "n_valid", F.round("mean_elevation", 8).alias("mean_elevation"), F.round("std_elevation", 8).alias("std_elevation")
    )


@query("d17_elevation_anomaly", f"{STATS} SELECT shot_number, zone_id, kind FROM an WHERE kind IS NOT NULL")
def _(v):
    return li.elevation_anomalies(v.shots, ["zone_id"]).select("shot_number", "zone_id", "kind")


SIGNIF = f"""{STATS}, sg AS (SELECT zone_id, count(*) AS n, avg(elevation_ground) AS m, stddev_samp(elevation_ground) AS sds, stddev_pop(elevation_ground) AS sp, max(mu) AS base FROM an WHERE kind = 'mound' GROUP BY zone_id),
  tt AS (SELECT *, (m - base) / (sds / sqrt(n)) AS t, n - 1.0E0 AS df FROM sg), {beta_sql('tt', 'df / 2', '0.5E0', 'df / (df + t * t)')},
  sv AS (SELECT zone_id, n, t, CASE WHEN n < 3 THEN 1 ELSE tail END AS p, CASE WHEN n < 3 THEN 0 ELSE (m - base) / sp END AS d FROM bq),
  sl AS (SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN p < 0.01E0 AND abs(d) >= 0.5E0 THEN 'HIGH' WHEN p < 0.05E0 AND abs(d) >= 0.3E0 THEN 'MEDIUM' ELSE 'LOW' END AS significance FROM sv)"""


@query(
    "f04_anomaly_significance",
    f"{SIGNIF} SELECT zone_id, n, round(CASE WHEN n >= 3 THEN t END, 6) AS t_stat, round(p, 8) AS p_value, round(d, 8) AS cohens_d, significance FROM sl",
)
def _(v):
    s = li.anomaly_significance(li.elevation_anomalies(v.shots, ["zone_id"]), ["zone_id"])
    return s.select("zone_id", "n", F.round("t_stat", 6).alias("t_stat"), F.round("p_value", 8).alias("p_value"), F.round("cohens_d", 8).alias("cohens_d"), "significance")


SEG = f"(SELECT *, {hav('plon', 'plat', 'lon', 'lat')} AS segment_m FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM {{src}} WINDOW w AS (PARTITION BY {{keys}} ORDER BY shot_number)) q)"


@query("g02_segment_lengths", f"SELECT shot_number, round(segment_m, 4) AS segment_m FROM {SEG.format(src='shots', keys='zone_id, beam')} s")
def _(v):
    return li.segment_lengths(v.shots, ["zone_id", "beam"], "shot_number").select("shot_number", F.round("segment_m", 4).alias("segment_m"))


def fits_sql(source: str) -> str:
    return f"""lf AS (SELECT zone_id, count(*) AS n, regr_r2(lat, lon) AS r2, regr_slope(lat, lon) AS slope, regr_syy(lat, lon) AS syy, coalesce(sum(segment_m), 0) AS length_m FROM {SEG.format(src=source, keys='zone_id')} s GROUP BY zone_id HAVING count(*) >= 4),
  ft AS (SELECT *, r2 * (n - 2) / (1 - r2) AS f, n - 2.0E0 AS d2 FROM lf), {beta_sql('ft', 'd2 / 2', '0.5E0', 'd2 / (d2 + f)')},
  fl AS (SELECT * EXCLUDE (p), tail AS pv, sqrt(greatest(syy * (1 - r2) / n, 0)) AS rmse, CASE WHEN r2 >= 0.75E0 AND tail < 0.05E0 THEN 'linear_causeway' WHEN r2 >= 0.70E0 AND tail < 0.05E0 THEN 'field_boundary' END AS feature_type FROM bq)"""


FIT_OUT = "SELECT zone_id, n, round(r2, 7) AS r2, round(slope, 6) AS slope, round(f, 5) AS f_stat, round(pv, 7) AS p_value, round(rmse, 8) AS rmse, round(length_m, 3) AS length_m, feature_type FROM fl"


def fit_out(df):
    r = {"r2": 7, "slope": 6, "f_stat": 5, "p_value": 7, "rmse": 8, "length_m": 3}
    return df.select("zone_id", "n", *[F.round(c, k).alias(c) for c, k in r.items()], "feature_type")


@query("f05_ditch_line_fit", f"{STATS}, di AS (SELECT * FROM an WHERE kind = 'ditch'), {fits_sql('di')} {FIT_OUT}")
def _(v):
    ditches = li.elevation_anomalies(v.shots, ["zone_id"]).where("kind = 'ditch'").select("shot_number", "zone_id", "lon", "lat")
    return fit_out(li.line_fits(ditches, ["zone_id"], "shot_number"))


# All valid shots, squeezed towards a line by an amount that differs per zone, so every class occurs.
LINED = "SELECT shot_number, zone_id, lon, lat * 0.02E0 * (1 + zone_id % 9) + lon * 0.5E0 AS lat FROM "


@query("f05_line_fit_classes", f"ln AS ({LINED} shots), {fits_sql('ln')} {FIT_OUT}")
def _(v):
    return fit_out(li.line_fits(v.sql(LINED + "{shots}"), ["zone_id"], "shot_number"))


def dist(a, b):
    return f"sqrt(({a}.lon - {b}.lon) * ({a}.lon - {b}.lon) + ({a}.lat - {b}.lat) * ({a}.lat - {b}.lat))"


def dbscan_sql(source: str, key: str, eps: float, min_points: int, p: str = "db", by: str | None = None, op: str = "<=") -> str:
    """CTEs ending in ``{p}`` (key, cluster_id, is_core)."""
    same = f"AND a.{by} = b.{by} " if by else ""
    near = f"{same}AND abs(a.lon - b.lon) <= {eps}E0 AND abs(a.lat - b.lat) <= {eps}E0 AND {dist('a', 'b')} {op} {eps}E0"
    return f"""{p}_nb AS (SELECT a.{key} AS a, b.{key} AS b FROM {source} a JOIN {source} b ON true {near}),
    {p}_co AS (SELECT a AS id FROM {p}_nb GROUP BY a HAVING count(*) >= {min_points}),
    {p}_ce AS (SELECT n.a, n.b FROM {p}_nb n JOIN {p}_co x ON x.id = n.a JOIN {p}_co y ON y.id = n.b),
    {p}_rc AS (SELECT id AS a, id AS b FROM {p}_co UNION SELECT r.a, e.b FROM {p}_rc r JOIN {p}_ce e ON e.a = r.b),
    {p}_cm AS (SELECT b AS id, min(a) AS cluster_id FROM {p}_rc GROUP BY b),
    {p}_bd AS (SELECT n.a AS id, min(c.cluster_id) AS cluster_id FROM {p}_nb n JOIN {p}_cm c ON c.id = n.b GROUP BY n.a),
    {p} AS (SELECT s.*, coalesce(c.cluster_id, b.cluster_id, -1) AS cluster_id, c.id IS NOT NULL AS is_core FROM {source} s LEFT JOIN {p}_cm c ON c.id = s.{key} LEFT JOIN {p}_bd b ON b.id = s.{key})"""


def det_points(v):
    return v.detections.select("det_id", "zone_id", "lon", "lat", "confidence")


@query("m01_dbscan", f"{dbscan_sql('detections', 'det_id', 0.003, 3)} SELECT det_id, cluster_id, is_core FROM db")
def _(v):
    return de.dbscan(det_points(v), "det_id", 0.003, 3).select("det_id", "cluster_id", "is_core")


@query("m01_dbscan_mounds", f"{STATS}, mo AS (SELECT * FROM an WHERE kind = 'mound'), {dbscan_sql('mo', 'shot_number', MOUND_EPS, 2, by='zone_id')} SELECT shot_number, cluster_id, is_core FROM db")
def _(v):
    return de.dbscan(mounds(v), "shot_number", MOUND_EPS, 2, by=["zone_id"]).select("shot_number", "cluster_id", "is_core")


def mounds(v):
    return li.elevation_anomalies(v.shots, ["zone_id"]).where("kind = 'mound'").select("shot_number", "zone_id", "lon", "lat")


def gaps(v):
    return li.with_local_max(v.shots).where(li.relative_gap()).select("shot_number", "zone_id", "lon", "lat")


def mound_clusters(v):
    return de.cluster_summary(de.dbscan(mounds(v), "shot_number", MOUND_EPS, 2, by=["zone_id"]), ["zone_id"], 10.0)


def gap_clusters(v):
    return de.cluster_summary(de.dbscan(gaps(v), "shot_number", GAP_EPS, 3, by=["zone_id"]), ["zone_id"], 10.0)


SUMMARY = "{c} AS (SELECT zone_id, cluster_id, count(*) AS n_points, avg(lon) AS lon, avg(lat) AS lat, count(*) * (pi() * 12.5E0 * 12.5E0) AS area_m2 FROM db WHERE cluster_id <> -1 GROUP BY 1, 2 HAVING count(*) * (pi() * 12.5E0 * 12.5E0) / 1E6 <= 10)"
GAP_CL = f"{GAPS}, {dbscan_sql('gp', 'shot_number', GAP_EPS, 3, by='zone_id')}, {SUMMARY.format(c='cl')}"
MOUND_CL = f"mo AS (SELECT * FROM an WHERE kind = 'mound'), {dbscan_sql('mo', 'shot_number', MOUND_EPS, 2, by='zone_id')}, {SUMMARY.format(c='cl')}"


@query("f01_cluster_summary", f"{GAP_CL} SELECT zone_id, cluster_id, n_points, round(lon, 9) AS lon, round(lat, 9) AS lat, round(area_m2, 6) AS area_m2 FROM cl")
def _(v):
    c = gap_clusters(v)
    return c.select("zone_id", "cluster_id", "n_points", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("area_m2", 6).alias("area_m2"))


@query(
    "f06_clearing_potential",
    f"""{GAP_CL} SELECT zone_id, round(avg(CASE WHEN n_points >= 10 THEN 5 WHEN n_points >= 5 THEN 3 WHEN n_points >= 3 THEN 2 ELSE 0 END + CASE WHEN area_m2 BETWEEN 100 AND 5000 THEN 2 ELSE 0 END), 9) AS potential,
    count(*) AS clearings, max(n_points) AS largest FROM cl WHERE area_m2 BETWEEN 10 AND 10000 GROUP BY zone_id""",
)
def _(v):
    return li.clearing_potential(gap_clusters(v), ["zone_id"]).withColumn("potential", F.round("potential", 9))


@query(
    "f07_earthwork_potential",
    f"""{SIGNIF}, {MOUND_CL}, di AS (SELECT * FROM an WHERE kind = 'ditch'), {fits_sql('di').replace('bi AS', 'fbi AS').replace('FROM bi)', 'FROM fbi)').replace('bf AS', 'fbf AS').replace('FROM bf)', 'FROM fbf)').replace('bs AS', 'fbs AS').replace('FROM bs)', 'FROM fbs)').replace('bt AS', 'fbt AS').replace('FROM bt)', 'FROM fbt)').replace('bq AS', 'fbq AS').replace('FROM bq)', 'FROM fbq)')},
    pt AS (SELECT zone_id, CASE WHEN area_m2 >= 200 AND n_points >= 5 THEN 4 WHEN area_m2 >= 50 AND n_points >= 3 THEN 2 WHEN n_points >= 2 THEN 1 ELSE 0 END AS pts FROM cl
      UNION ALL SELECT zone_id, CASE WHEN r2 > 0.9E0 THEN 3 ELSE 2 END FROM fl WHERE feature_type IS NOT NULL), t AS (SELECT zone_id, CAST(sum(pts) AS BIGINT) AS points FROM pt GROUP BY zone_id)
    SELECT t.zone_id, points, CAST(trunc(points * CASE significance WHEN 'HIGH' THEN 1.2E0 WHEN 'LOW' THEN 0.7E0 ELSE 1.0E0 END) AS INT) AS potential FROM t LEFT JOIN sl ON sl.zone_id = t.zone_id""",
)
def _(v):
    a = li.elevation_anomalies(v.shots, ["zone_id"])
    lines = li.line_fits(a.where("kind = 'ditch'").select("shot_number", "zone_id", "lon", "lat"), ["zone_id"], "shot_number")
    return li.earthwork_potential(mound_clusters(v), lines, li.anomaly_significance(a, ["zone_id"]), ["zone_id"])


@query(
    "f08_fast_potential",
    f"{GAP_CL} SELECT zone_id, CAST(sum(CASE WHEN n_points >= 5 THEN 3 WHEN n_points >= 3 THEN 2 ELSE 1 END) AS BIGINT) AS clearing, CAST(sum(CASE WHEN n_points >= 4 THEN 4 ELSE 2 END) AS BIGINT) AS earthwork FROM cl GROUP BY zone_id",
)
def _(v):
    c = gap_clusters(v)
    one = li.fast_potential(c, ["zone_id"]).withColumnRenamed("potential", "clearing")
    return one.join(li.fast_potential(c, ["zone_id"], "mound").withColumnRenamed("potential", "earthwork"), "zone_id")


@query(
    "m02_threshold_graph",
    f"{dbscan_sql('detections', 'det_id', 0.002, 1, op='<')}, k AS (SELECT cluster_id, count(*) AS k FROM db GROUP BY cluster_id) SELECT det_id, CASE WHEN k.k < 3 THEN -1 ELSE db.cluster_id END AS cluster_id FROM db JOIN k ON k.cluster_id = db.cluster_id",
)
def _(v):
    return de.threshold_graph(det_points(v), "det_id", 0.002, 3).select("det_id", "cluster_id")


@query(
    "m03_connected_components",
    f"""{SCORED}, ed AS (SELECT id1 AS a, id2 AS b FROM e2 UNION SELECT id2, id1 FROM e2), rc AS (SELECT a AS s, a AS node FROM ed UNION SELECT rc.s, ed.b FROM rc JOIN ed ON ed.a = rc.node)
    SELECT node, min(s) AS component FROM rc GROUP BY node""",
)
def _(v):
    return sp.pair_components(v.detections)


def ordered_leaders_sql(source: str, name: str, radius: float, by: str) -> tuple[str, str]:
    """(CTEs, SELECT of the leaders) of a scan in order of ``k`` over ``source`` (by, k, x, y): a point leads unless an earlier leader is closer than the radius."""
    ctes = f"""{name}_o AS (SELECT {by}, k, x, y, row_number() OVER (PARTITION BY {by} ORDER BY k) AS i FROM {source}),
    {name}_s AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[]) AS lead FROM {source}
      UNION ALL SELECT s.{by}, o.i, CASE WHEN len(list_filter(s.lead, lambda l: sqrt((l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y)) < {radius!r}::DOUBLE)) > 0 THEN s.lead ELSE list_append(s.lead, struct_pack(k := o.k, x := o.x, y := o.y)) END
      FROM {name}_s s JOIN {name}_o o ON o.{by} = s.{by} AND o.i = s.i + 1)"""
    return ctes, f"SELECT {by}, l.k AS k, l.x AS x, l.y AS y FROM (SELECT {by}, unnest(arg_max(lead, i)) AS l FROM {name}_s GROUP BY {by}) z"


def leader_of_sql(points: str, core: str, name: str, radius: float) -> str:
    """CTEs ending in ``name`` (k, leader): each point of ``points`` (k, x, y) with the first leader near it; leaders come from ``core``."""
    ctes, lead = ordered_leaders_sql(f"{name}_c", name, radius, "z")
    return f"""{name}_c AS (SELECT 1 AS z, k, x, y FROM {core}), {ctes}, {name}_l AS ({lead}),
    {name}_n AS (SELECT p.k, min(l.k) AS leader FROM {points} p JOIN {name}_l l ON abs(l.x - p.x) <= {radius!r}::DOUBLE AND abs(l.y - p.y) <= {radius!r}::DOUBLE AND sqrt((l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y)) < {radius!r}::DOUBLE GROUP BY p.k),
    {name} AS (SELECT p.k, leader FROM {points} p LEFT JOIN {name}_n n ON n.k = p.k)"""


POINTS = "lp AS (SELECT det_id AS k, lon AS x, lat AS y, confidence, area_m2 FROM detections)"
DEDUPE = 50.0 / 111320.0
MERGED = """SELECT arg_min(p.k, struct_pack(c := -coalesce(confidence, 0), i := p.k)) AS det_id, count(*) AS n_merged FROM {points} p JOIN ld ON ld.k = p.k GROUP BY leader"""


@query(
    "m04_greedy_leader_clusters",
    f"""{POINTS}, co AS (SELECT a.k, a.x, a.y FROM lp a JOIN lp b ON abs(a.x - b.x) <= 0.003E0 AND abs(a.y - b.y) <= 0.003E0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.003E0 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    {leader_of_sql('lp', 'co', 'ld', 0.003)} SELECT k AS det_id, leader FROM ld""",
)
def _(v):
    return de.leaders(det_points(v), "det_id", 0.003, 3)


@query(
    "m05_greedy_dedupe",
    f"{POINTS}, {leader_of_sql('lp', 'lp', 'ld', DEDUPE)}, mg AS ({MERGED.format(points='lp')}) SELECT mg.det_id, confidence, n_merged FROM mg JOIN lp ON lp.k = mg.det_id",
)
def _(v):
    return di.deduplicated(v.detections, "det_id", 50.0).select("det_id", "confidence", "n_merged")


EPS100 = 100 / 111320
REP = """SELECT {k} AS det_id, confidence, round(lon, 9) AS lon, round(lat, 9) AS lat, clustered_count, round(cluster_confidence, 9) AS cluster_confidence, cluster_id FROM (
  SELECT cluster_id, arg_min(det_id, struct_pack(c := -coalesce(confidence, 0), i := det_id)) AS det_id, max(coalesce(confidence, 0)) AS confidence, avg(lon) AS lon, avg(lat) AS lat, count(*) AS clustered_count, avg(coalesce(confidence, 0)) AS cluster_confidence FROM db WHERE cluster_id <> -1 GROUP BY cluster_id
  UNION ALL SELECT -1, det_id, coalesce(confidence, 0), lon, lat, 1, coalesce(confidence, 0) FROM db WHERE cluster_id = -1) r""".format(k="det_id")


def rep_out(df):
    return df.select(
        "det_id", "confidence", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "clustered_count",
        F.round("cluster_confidence", 9).alias("cluster_confidence"), "cluster_id",
    )


@query("m06_cluster_representatives", f"{dbscan_sql('detections', 'det_id', 0.003, 3)} {REP}")
def _(v):
    return rep_out(de.representatives(det_points(v), "det_id", 0.003, 3))


VIEW = dict(west=-53.2, south=-12.3, east=-52.2, north=-11.3)
VIS = """vi AS (SELECT det_id, lon, lat, confidence FROM detections WHERE lat BETWEEN -12.3E0 - (-11.3E0 - -12.3E0) * (1.2E0 - 1) / 2 AND -11.3E0 + (-11.3E0 - -12.3E0) * (1.2E0 - 1) / 2
  AND lon BETWEEN -53.2E0 - (-52.2E0 - -53.2E0) * (1.2E0 - 1) / 2 AND -52.2E0 + (-52.2E0 - -53.2E0) * (1.2E0 - 1) / 2 AND coalesce(confidence, 0) >= 0.4E0)"""


@query("m07_viewport_view", f"{VIS}, {dbscan_sql('vi', 'det_id', EPS100, 3)} {REP}")
def _(v):
    return rep_out(di.viewport_view(det_points(v), "det_id", VIEW))


@query(
    "m08_display_view",
    f"""{POINTS}, dv AS (SELECT * FROM lp WHERE coalesce(confidence, 0) >= 0.4E0), {leader_of_sql('dv', 'dv', 'ld', DEDUPE)}, mg AS ({MERGED.format(points='dv')})
    SELECT mg.det_id, confidence, round(coalesce(confidence, 0.5E0) * log10(greatest(coalesce(area_m2, 1000), 1)), 9) AS priority FROM mg JOIN dv ON dv.k = mg.det_id""",
)
def _(v):
    return di.display_view(v.detections, "det_id").select("det_id", "confidence", F.round("priority", 9).alias("priority"))


@query(
    "g03_best_per_cluster",
    f"{dbscan_sql('detections', 'det_id', 0.003, 1)} SELECT cluster_id, arg_min(det_id, struct_pack(c := -coalesce(confidence, 0), i := det_id)) AS det_id FROM db GROUP BY cluster_id",
)
def _(v):
    c = de.dbscan(det_points(v), "det_id", 0.003, 1)
    return di.best_per_group(c, ["cluster_id"], "det_id").select("cluster_id", "det_id")


DENS = f"""zb AS (SELECT *, (north - south) * (east - west) * 111 * 111 * abs(cos(radians((north + south) / 2))) AS km2 FROM zones),
  zl AS (SELECT zone_id, greatest(5, CAST(trunc(km2 * CASE WHEN zone_id % 5 = 0 THEN 0.05E0 ELSE 0.2E0 END / 5) AS BIGINT)) AS quota FROM zb),
  {dbscan_sql('detections', 'det_id', 0.005, 1, by='zone_id')}, n AS (SELECT zone_id, count(*) AS n FROM detections GROUP BY zone_id),
  b AS (SELECT *, row_number() OVER (PARTITION BY zone_id, cluster_id ORDER BY coalesce(confidence, 0) DESC, det_id) AS rn FROM db),
  t AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY coalesce(confidence, 0) DESC, det_id) AS tn FROM b WHERE rn = 1)
  SELECT det_id, d.zone_id FROM detections d JOIN n USING (zone_id) JOIN zl USING (zone_id) WHERE n <= quota UNION ALL SELECT det_id, zone_id FROM t JOIN n USING (zone_id) JOIN zl USING (zone_id) WHERE n > quota AND tn <= quota"""


@query("g07_adaptive_density_limit", DENS)
def _(v):
    zones = di.zone_quota(v.zones, F.col("zone_id") % 5 == 0, scale=0.2)
    return di.density_limited(det_points(v), zones, "det_id").select("det_id", "zone_id")


@query("h03_top_per_provider", "SELECT det_id, provider, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY coalesce(confidence, 0) DESC, det_id) AS rn FROM detections) d WHERE rn <= 5")
def _(v):
    return di.top_per_group(v.detections, ["provider"], F.coalesce("confidence", F.lit(0.0)), "det_id", 5).select("det_id", "provider", "rank")
