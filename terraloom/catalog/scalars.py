"""Queries over scalar scores and texts: J9-J29."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.registry import query
from terraloom.catalog.pixels import INDEX_SQL
from terraloom.functions import labels as L
from terraloom.functions import scores as S
from terraloom.functions import stats as ST
from terraloom.functions import texts as T
from terraloom.functions.indices import index

# Pixel blocks that stand in for regions.
BLOCKS = f"""SELECT scene_id, CAST(floor(pix_row / 9.0E0) AS INT) AS br, CAST(floor(pix_col / 11.0E0) AS INT) AS bc, count(*) AS n_px,
  avg({INDEX_SQL['terra_preta_enhanced']}) AS tp, avg({INDEX_SQL['terra_preta']}) AS tps, avg({INDEX_SQL['ndvi']}) AS ndvi,
  avg({INDEX_SQL['ndre1']}) AS ndre1, avg({INDEX_SQL['crop_mark']}) AS crop FROM pixels GROUP BY 1, 2, 3"""


def blocks(v):
    px = v.pixels.select(
        "scene_id", F.floor(F.col("pix_row") / 9.0).cast("int").alias("br"), F.floor(F.col("pix_col") / 11.0).cast("int").alias("bc"),
        index("terra_preta_enhanced").alias("tp"), index("terra_preta").alias("tps"), index("ndvi").alias("ndvi"),
        index("ndre1").alias("ndre1"), index("crop_mark").alias("crop"),
    )
    means = [F.avg(c).alias(c) for c in ("tp", "tps", "ndvi", "ndre1", "crop")]
    return px.groupBy("scene_id", "br", "bc").agg(F.count(F.lit(1)).alias("n_px"), *means)


@query(
    "j09_region_confidence_enhanced",
    f"""b AS ({BLOCKS}) SELECT scene_id, br, bc, round(least(1, (0.4E0 * least(1, tp * 6) + 0.25E0 * least(1, (ndvi - 0.3E0) * 3) + 0.25E0 * least(1, ndre1 * 6)
      + 0.1E0 * least(1, sqrt(n_px * 100) / 50)) * CASE WHEN tp > 0.25E0 AND ndre1 > 0.3E0 THEN 1.3E0 WHEN tp > 0.2E0 AND ndre1 > 0.25E0 THEN 1.15E0 ELSE 1 END)
      * CASE WHEN tp + ndre1 * 0.5E0 < 0.3E0 THEN 0.8E0 ELSE 1 END, 9) AS confidence FROM b""",
)
def _(v):
    c = S.region_confidence_enhanced(F.col("tp"), F.col("ndvi"), F.col("ndre1"), F.col("n_px") * 100)
    return blocks(v).select("scene_id", "br", "bc", F.round(c, 9).alias("confidence"))


@query(
    "j09b_region_confidence_standard",
    f"""b AS ({BLOCKS}), r AS (SELECT *, least(1, 0.5E0 * least(1, tps * 10) + 0.3E0 * least(1, (ndvi - 0.35E0) * 4) + 0.2E0 * least(1, n_px / 100.0E0)) AS raw FROM b)
    SELECT scene_id, br, bc, round(CASE WHEN tps > 0.12E0 THEN greatest(raw, 0.6E0) ELSE raw END, 9) AS confidence FROM r""",
)
def _(v):
    c = S.region_confidence_standard(F.col("tps"), F.col("ndvi"), F.col("n_px"))
    return blocks(v).select("scene_id", "br", "bc", F.round(c, 9).alias("confidence"))


@query(
    "j09c_crop_and_fast_confidence",
    f"""b AS ({BLOCKS}) SELECT scene_id, br, bc, round(least(1, sqrt(n_px * 100) / 30) * least(1, abs(crop) * 10) * 0.8E0, 9) AS crop_confidence,
    least(1, sqrt(n_px * 100) / 30) * least(1, abs(crop) * 10) * 0.8E0 >= 0.3E0 AS crop_kept,
    round(least(1, n_px / 200.0E0), 9) AS fast_enhanced, round(least(1, n_px / 500.0E0), 9) AS fast_standard FROM b""",
)
def _(v):
    c = S.crop_confidence(F.col("n_px") * 100, F.col("crop"))
    return blocks(v).select(
        "scene_id", "br", "bc", F.round(c, 9).alias("crop_confidence"), (c >= 0.3).alias("crop_kept"),
        F.round(S.cap1(F.col("n_px") / 200), 9).alias("fast_enhanced"), F.round(S.cap1(F.col("n_px") / 500), 9).alias("fast_standard"),
    )


SCORE = "coalesce(confidence, 0) * 13"
CLASS = f"""CASE WHEN {SCORE} >= 10 THEN 'HIGH CONFIDENCE ARCHAEOLOGICAL SITE' WHEN {SCORE} >= 7 THEN 'PROBABLE ARCHAEOLOGICAL FEATURE'
  WHEN {SCORE} >= 4 THEN 'POSSIBLE ANOMALY - INVESTIGATE' ELSE 'NATURAL VARIATION' END"""


def score_col():
    return F.coalesce("confidence", F.lit(0.0)) * 13


@query("j10_score_class", f"SELECT det_id, {CLASS} AS classification FROM detections")
def _(v):
    return v.detections.select("det_id", S.score_class(score_col()).alias("classification"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "j11_recommendation",
    "SELECT det_id, "
    + ", ".join(
        f"CASE WHEN {SCORE} >= 10 THEN {q(L.RECOMMENDATIONS['high'][i])} WHEN {SCORE} >= 7 THEN {q(L.RECOMMENDATIONS['probable'][i])} "
        f"WHEN {SCORE} >= 4 THEN {q(L.RECOMMENDATIONS['possible'][i])} ELSE {q(L.RECOMMENDATIONS['natural'][i])} END AS {f}"
        for i, f in enumerate(L.RECOMMENDATION_FIELDS)
    )
    + " FROM detections",
)
def _(v):
    return v.detections.select("det_id", S.recommendation(score_col()).alias("r")).select("det_id", "r.*")


# Sensor means per detection, derived from confidence and area.
SENSORS = """SELECT det_id, coalesce(confidence, 0) AS lidar, area_m2 / 120000 AS spectral, CASE WHEN det_id % 2 = 0 THEN 0.7E0 ELSE 0.3E0 END AS temporal FROM """
COMBINED = """SELECT *, least(1, lidar * 0.35E0 + spectral * 0.35E0 + temporal * 0.2E0 + CASE WHEN lidar > 0.4E0 AND spectral > 0.4E0 THEN 0.1E0 ELSE 0 END) AS score FROM s"""
# erf(x) for x >= 0 as a list sum over the series with double factorials written through lgamma.
ERF = "CASE WHEN {x} = 0 THEN 0 ELSE least(1, 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum([exp(n * ln(2E0) + (2 * n + 1) * ln({x}) - (lgamma(2 * n + 3.0E0) - (n + 1) * ln(2E0) - lgamma(n + 2.0E0))) for n in range(0, 141)])) END"
PVAL = f"1 - ({ERF.format(x='x')})"


@query(
    "j14_site_fusion",
    f"""s AS ({SENSORS} detections), c AS ({COMBINED}), d AS (SELECT *, (score - 0.12E0) / 0.18E0 AS d, least(abs((score - 0.12E0) / 0.18E0) / sqrt(2), 6) AS x FROM c),
    p AS (SELECT *, {PVAL} AS p FROM d), l AS (SELECT *, CASE WHEN d >= 0.8E0 AND p < 0.001E0 THEN 'EXCEPTIONAL' WHEN d >= 0.5E0 AND p < 0.01E0 THEN 'HIGH'
      WHEN d >= 0.3E0 AND p < 0.05E0 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p)
    SELECT det_id, round(score, 9) AS combined_score, round(d, 9) AS cohens_d, round(p, 9) AS p_value, level AS confidence_level,
      CASE level WHEN 'EXCEPTIONAL' THEN 0.95E0 WHEN 'HIGH' THEN 0.85E0 WHEN 'MEDIUM' THEN 0.65E0 ELSE 0.25E0 END AS probability,
      d >= 0.5E0 AND p < 0.01E0 AS meets_standards FROM l""",
)
def _(v):
    s = v.sql(SENSORS + "{detections}").withColumn("score", ST.combined_site_score(F.col("lidar"), F.col("spectral"), F.col("temporal")))
    s = s.withColumn("d", ST.effect_size(F.col("score"))).withColumn("p", ST.two_sided_z_p(F.col("d")))
    s = s.withColumn("level", ST.confidence_level(F.col("d"), F.col("p")))
    return s.select(
        "det_id", F.round("score", 9).alias("combined_score"), F.round("d", 9).alias("cohens_d"), F.round("p", 9).alias("p_value"),
        F.col("level").alias("confidence_level"), ST.site_probability(F.col("level")).alias("probability"),
        ((F.col("d") >= 0.5) & (F.col("p") < 0.01)).alias("meets_standards"),
    )


@query(
    "j15_quality_metrics",
    f"""s AS ({SENSORS} detections), c AS ({COMBINED}), m AS (SELECT *, (lidar + spectral + temporal) / 3 AS mu FROM c),
    a AS (SELECT *, CASE WHEN mu > 0 THEN 1 - sqrt((pow(lidar - mu, 2) + pow(spectral - mu, 2) + pow(temporal - mu, 2)) / 3) / mu ELSE 0 END AS ag,
      (CASE WHEN lidar > 0.4E0 THEN 1 ELSE 0 END + CASE WHEN spectral > 0.4E0 THEN 1 ELSE 0 END + CASE WHEN temporal > 0.4E0 THEN 1 ELSE 0 END) / 3.0E0 AS rel FROM m)
    SELECT det_id, round(ag, 9) AS sensor_agreement, round(rel, 9) AS detection_reliability, round(score / 0.18E0, 9) AS signal_to_noise,
      round((ag + rel + least(score / 0.18E0 / 5, 1)) / 3, 9) AS overall_quality FROM a""",
)
def _(v):
    s = v.sql(SENSORS + "{detections}")
    score = ST.combined_site_score(F.col("lidar"), F.col("spectral"), F.col("temporal"))
    s = s.select("det_id", ST.quality_metrics(F.col("lidar"), F.col("spectral"), F.col("temporal"), score).alias("q"))
    return s.select("det_id", *[F.round(f"q.{c}", 9).alias(c) for c in ("sensor_agreement", "detection_reliability", "signal_to_noise", "overall_quality")])


@query(
    "j16_academic_evidence",
    f"""d AS (SELECT det_id, coalesce(confidence, 0) AS c, (coalesce(confidence, 0) - 0.12E0) / 0.18E0 AS d, least(abs((coalesce(confidence, 0) - 0.12E0) / 0.18E0) / sqrt(2), 6) AS x FROM detections),
    p AS (SELECT *, {PVAL} AS p FROM d), l AS (SELECT *, CASE WHEN d >= 0.8E0 AND p < 0.001E0 THEN 'EXCEPTIONAL' WHEN d >= 0.5E0 AND p < 0.01E0 THEN 'HIGH'
      WHEN d >= 0.3E0 AND p < 0.05E0 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p)
    SELECT det_id, round(d, 9) AS effect_size, round(p, 9) AS p_value, d >= 0.5E0 AND p < 0.01E0 AS meets_standards,
      CASE level {' '.join(f"WHEN '{k}' THEN {q(t)}" for k, t in L.ACADEMIC_ACTION.items())} END AS recommended_action FROM l""",
)
def _(v):
    s = v.detections.select("det_id", ST.effect_size(F.coalesce("confidence", F.lit(0.0))).alias("d"))
    s = s.withColumn("p", ST.two_sided_z_p(F.col("d")))
    level = ST.confidence_level(F.col("d"), F.col("p"))
    return s.select(
        "det_id", F.round("d", 9).alias("effect_size"), F.round("p", 9).alias("p_value"),
        ((F.col("d") >= 0.5) & (F.col("p") < 0.01)).alias("meets_standards"),
        T.lookup(level, {"": L.ACADEMIC_ACTION["LOW"], **L.ACADEMIC_ACTION}).alias("recommended_action"),
    )


@query(
    "j17_normal_cdf",
    f"""d AS (SELECT shot_number, rh100 - 5 AS z, least(abs(rh100 - 5) / sqrt(2), 6) AS x FROM shots), e AS (SELECT *, {ERF.format(x='x')} AS erf FROM d)
    SELECT shot_number, round((1 + CASE WHEN z < 0 THEN -erf ELSE erf END) / 2, 9) AS cdf FROM e""",
)
def _(v):
    return v.shots.select("shot_number", F.round(ST.normal_cdf(F.col("rh100") - 5), 9).alias("cdf"))


# Regularised incomplete beta through its hypergeometric series, on the smaller side.
IBETA = """CASE WHEN y <= 0 THEN 0 ELSE exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(y) + q * ln(1 - y)) / p
  * list_sum([exp(lgamma(p + q + n) - lgamma(p + q) - lgamma(p + 1 + n) + lgamma(p + 1) + n * ln(y)) for n in range(0, 1500)]) END"""


def beta_sql(source: str, a: str, b: str, x: str) -> str:
    """CTEs computing ``tail`` = I_x(a, b) for the rows of ``source``."""
    return f"""bi AS (SELECT *, {a} AS ba, {b} AS bb, {x} AS bx FROM {source}),
    bf AS (SELECT *, bx > (ba + 1) / (ba + bb + 2) AS flip FROM bi),
    bs AS (SELECT *, CASE WHEN flip THEN bb ELSE ba END AS p, CASE WHEN flip THEN ba ELSE bb END AS q, CASE WHEN flip THEN 1 - bx ELSE bx END AS y FROM bf),
    bt AS (SELECT *, {IBETA} AS half FROM bs), bq AS (SELECT *, CASE WHEN flip THEN 1 - half ELSE half END AS tail FROM bt)"""


STUDENT = "SELECT det_id, (coalesce(confidence, 0) - 0.5E0) * 8 AS t, n_points + 2.0E0 AS df FROM "


@query(
    "j18_student_t_p",
    f"s AS ({STUDENT} detections), {beta_sql('s', 'df / 2', '0.5E0', 'df / (df + t * t)')} SELECT det_id, round(tail, 8) AS p_value FROM bq",
)
def _(v):
    s = v.sql(STUDENT + "{detections}")
    return s.select("det_id", F.round(ST.t_two_sided_p(F.col("t"), F.col("df")), 8).alias("p_value"))


@query(
    "j18_f_p",
    f"""s AS (SELECT det_id, area_m2 / 20000 AS f, n_points + 3.0E0 AS d2 FROM detections), {beta_sql('s', 'd2 / 2', '0.5E0', 'd2 / (d2 + f)')}
    SELECT det_id, round(tail, 8) AS p_value FROM bq""",
)
def _(v):
    return v.detections.select(
        "det_id", F.round(ST.f_one_predictor_p(F.col("area_m2") / 20000, F.col("n_points") + 3.0), 8).alias("p_value")
    )


def ladder_sql(x, steps, op=">"):
    return "CASE " + " ".join(f"WHEN {x} {op} {lim} THEN {q(t)}" for lim, t in steps[:-1]) + f" ELSE {q(steps[-1][1])} END"


LT, SP = L.LIDAR_TEXT, L.SPECTRAL_TEXT


@query(
    "j19_interpretation",
    f"""SELECT det_id, CASE WHEN provider = 'gedi' THEN CASE WHEN contains(det_type, 'clearing') THEN {ladder_sql('area_m2', LT['clearing'])}
      WHEN contains(det_type, 'mound') THEN {ladder_sql('area_m2', LT['mound'])} ELSE {q(LT['other'])} END
    ELSE CASE WHEN contains(det_type, 'terra_preta') THEN {ladder_sql('area_m2', SP['terra_preta'])}
      WHEN contains(t, 'geometric') THEN CASE WHEN contains(t, 'circle') THEN {q(SP['geometric']['circle'])} WHEN contains(t, 'rectangle') THEN {q(SP['geometric']['rectangle'])}
        WHEN contains(t, 'line') THEN {q(SP['geometric']['line'])} ELSE {q(SP['geometric'][''])} END
      WHEN contains(det_type, 'crop_mark') THEN {q(SP['crop_mark'])} ELSE {ladder_sql('coalesce(confidence, 0)', SP['other'], '>=')} END END AS interpretation
    FROM (SELECT *, CASE WHEN det_id % 4 = 0 THEN det_type ELSE 'geometric_' || det_type END AS t FROM detections) d""",
)
def _(v):
    t = F.when(F.col("det_id") % 4 == 0, F.col("det_type")).otherwise(F.concat(F.lit("geometric_"), F.col("det_type")))
    spectral = F.when(F.col("det_type").isin("terra_preta"), F.col("det_type")).otherwise(t)
    d = v.detections.withColumn("t", spectral)
    return d.select(
        "det_id",
        F.when(F.col("provider") == "gedi", T.lidar_interpretation(F.col("det_type"), F.col("area_m2")))
        .otherwise(T.spectral_interpretation(F.col("t"), F.col("area_m2"), F.col("confidence")))
        .alias("interpretation"),
    )


POINTS = """(CASE WHEN coalesce(confidence, 0) >= 0.8E0 THEN 40 WHEN confidence >= 0.6E0 THEN 30 WHEN confidence >= 0.4E0 THEN 20 ELSE 0 END
  + CASE WHEN area_m2 >= 50000 THEN 30 WHEN area_m2 >= 10000 THEN 20 WHEN area_m2 >= 1000 THEN 10 ELSE 0 END
  + CASE WHEN n_points >= 100 THEN 30 WHEN n_points >= 50 THEN 20 WHEN n_points >= 10 THEN 10 ELSE 0 END)"""


@query(
    "j20_investigation_priority",
    f"SELECT det_id, CAST({POINTS} AS INT) AS points, {ladder_sql(POINTS, L.PRIORITY_TEXT, '>=')} AS priority FROM detections",
)
def _(v):
    a = (F.col("confidence"), F.col("area_m2"), F.col("n_points"))
    return v.detections.select("det_id", S.investigation_points(*a).alias("points"), T.investigation_priority(*a).alias("priority"))


# Convergence attributes derived per detection.
CONV = """SELECT *, CASE WHEN det_id % 3 = 1 THEN length_m / 10 + 0.25E0 END AS dist, det_id % 3 = 1 AND det_id % 2 = 0 AS lidar,
  CASE WHEN det_id % 5 < 2 THEN coalesce(confidence, 0) + 0.0504E0 END AS comb FROM """
REASON = """concat_ws('; ', CASE WHEN coalesce(confidence, 0) >= 0.5E0 THEN printf('High confidence (%.1f%%)', confidence * 100) END,
  CASE WHEN dist IS NOT NULL THEN printf('Multi-sensor convergence at %.0fm', dist) END, CASE WHEN lidar THEN 'GEDI LiDAR support' END,
  CASE WHEN comb > coalesce(confidence, 0) THEN printf('Enhanced combined confidence (%.1f%%)', comb * 100) END,
  CASE WHEN contains(det_type, 'terra_preta') THEN 'Terra preta archaeological significance' WHEN contains(det_type, 'geometric') THEN 'Geometric pattern archaeological relevance'
    WHEN contains(det_type, 'crop_mark') THEN 'Subsurface archaeological indicators' END)"""


@query(
    "j21_selection_reason",
    f"""c AS ({CONV} detections), r AS (SELECT *, {REASON} AS reason FROM c)
    SELECT det_id, CASE WHEN reason = '' THEN 'Standard archaeological criteria met' ELSE reason END AS selection_reason,
      CASE WHEN coalesce(confidence, 0) >= 0.8E0 THEN 'high' WHEN confidence >= 0.5E0 THEN 'moderate' ELSE 'low' END AS confidence_level,
      dist IS NOT NULL AS multi_sensor, CASE WHEN area_m2 > 10000 THEN 'large' WHEN area_m2 > 1000 THEN 'medium' ELSE 'small' END AS area_significance,
      CASE WHEN dist IS NULL THEN 'none' WHEN dist < 200 THEN 'strong' WHEN dist < 500 THEN 'moderate' ELSE 'weak' END AS convergence_strength FROM r""",
)
def _(v):
    c = v.sql(CONV + "{detections}")
    reason = T.selection_reason(F.col("confidence"), F.col("dist"), F.col("lidar"), F.col("comb"), F.col("det_type"))
    qi = T.quality_indicators(F.col("confidence"), F.col("dist"), F.col("lidar"), F.col("area_m2"))
    return c.select("det_id", reason.alias("selection_reason"), qi.alias("q")).select(
        "det_id", "selection_reason", "q.confidence_level", "q.multi_sensor", "q.area_significance", "q.convergence_strength"
    )


PLAN = """SELECT det_id, area_m2, confidence, CASE WHEN det_type IN ('circle', 'line', 'rectangle') THEN 'geometric_' || det_type ELSE det_type END AS t,
  CASE zone_id % 4 WHEN 0 THEN 'upano_valley_confirmed' WHEN 1 THEN 'trombetas' WHEN 2 THEN 'upper_napo_micro' ELSE 'elsewhere' END AS zone FROM """


def lookup_sql(table):
    return "CASE zone " + " ".join(f"WHEN '{k}' THEN {q(t)}" for k, t in table.items() if k) + f" ELSE {q(table[''])} END"


def list_sql(common, table):
    return "CASE zone " + " ".join(f"WHEN '{k}' THEN {q(' | '.join(common + t))}" for k, t in table.items()) + f" ELSE {q(' | '.join(common))} END"


DAYS = """(3 + CASE WHEN area_m2 > 100000 THEN 7 WHEN area_m2 > 50000 THEN 5 WHEN area_m2 > 10000 THEN 3 ELSE 0 END
  + CASE WHEN confidence > 0.8E0 THEN 2 ELSE 0 END + CASE WHEN contains(t, 'geometric') THEN 2 ELSE 0 END)"""


@query(
    "j22_field_plan",
    f"""p AS ({PLAN} detections) SELECT det_id, {lookup_sql(L.SEASONS)} AS season, {lookup_sql(L.ACCESS)} AS access,
    {lookup_sql(L.LOGISTICS)} || CASE WHEN area_m2 > 100000 THEN ' + Extended campaign logistics' ELSE '' END AS logistics,
    {list_sql(L.SAFETY_COMMON, L.SAFETY)} AS safety, {list_sql(L.PERMITS_COMMON, L.PERMITS)} AS permits,
    {DAYS} || ' days (' || CASE WHEN {DAYS} <= 5 THEN 'preliminary survey' WHEN {DAYS} <= 10 THEN 'comprehensive survey' ELSE 'extensive excavation campaign' END || ')' AS duration,
    {q(' | '.join(L.EQUIPMENT_COMMON))} || CASE WHEN contains(t, 'terra_preta') THEN {q(' | ' + ' | '.join(L.EQUIPMENT_SOIL))} ELSE '' END
      || CASE WHEN contains(t, 'geometric') THEN {q(' | ' + ' | '.join(L.EQUIPMENT_GEOMETRIC))} ELSE '' END
      || CASE WHEN area_m2 > 50000 THEN {q(' | ' + ' | '.join(L.EQUIPMENT_LARGE))} ELSE '' END AS equipment FROM p""",
)
def _(v):
    p = v.sql(PLAN + "{detections}")
    t, a, c, z = F.col("t"), F.col("area_m2"), F.col("confidence"), F.col("zone")
    return p.select(
        "det_id", T.lookup(z, L.SEASONS).alias("season"), T.lookup(z, L.ACCESS).alias("access"), T.logistics(z, a).alias("logistics"),
        F.array_join(T.zone_list(z, L.SAFETY_COMMON, L.SAFETY), " | ").alias("safety"),
        F.array_join(T.zone_list(z, L.PERMITS_COMMON, L.PERMITS), " | ").alias("permits"),
        T.field_duration(T.field_days(t, a, c)).alias("duration"), F.array_join(T.equipment(t, a), " | ").alias("equipment"),
    )


@query(
    "j23_publication",
    f"""p AS (SELECT *, CASE WHEN det_id % 4 < 3 THEN n_points / 120.0E0 END AS power, CASE WHEN det_id % 5 < 4 THEN (det_id % 7) / 100.0E0 END AS p,
      CASE WHEN det_id % 3 = 0 THEN 0.5E0 END AS ndvi, CASE WHEN det_id % 2 = 0 THEN 100E0 END AS elev, coalesce(confidence, 0) AS c FROM ({PLAN} detections) a JOIN (SELECT det_id, n_points FROM detections) n USING (det_id)),
    s AS (SELECT *, CASE WHEN contains(t, 'geometric') AND area_m2 > 50000 AND c > 0.8E0 THEN {q(L.SIGNIFICANCE[0])} WHEN area_m2 > 100000 AND c > 0.7E0 THEN {q(L.SIGNIFICANCE[1])}
      WHEN c > 0.8E0 THEN {q(L.SIGNIFICANCE[2])} WHEN area_m2 > 10000 THEN {q(L.SIGNIFICANCE[3])} ELSE {q(L.SIGNIFICANCE[4])} END AS sig,
      (CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN area_m2 > 0 THEN 1 ELSE 0 END + CASE WHEN ndvi IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN elev IS NOT NULL THEN 1 ELSE 0 END) AS k FROM p)
    SELECT det_id, CASE WHEN c > 0.8E0 AND coalesce(power, 0) > 0.8E0 AND coalesce(p, 1) < 0.01E0 THEN {q(L.READINESS[0])}
      WHEN c > 0.7E0 AND coalesce(power, 0) > 0.7E0 AND coalesce(p, 1) < 0.05E0 THEN {q(L.READINESS[1])} WHEN c > 0.5E0 THEN {q(L.READINESS[2])} ELSE {q(L.READINESS[3])} END AS readiness,
      sig AS significance, CASE WHEN contains(sig, 'Very High') THEN {q(L.CITATIONS[0])} WHEN contains(sig, 'High') THEN {q(L.CITATIONS[1])}
      WHEN contains(sig, 'Medium') THEN {q(L.CITATIONS[2])} ELSE {q(L.CITATIONS[3])} END AS citation,
      CASE WHEN k >= 3 THEN {q(L.COMPLETENESS[0])} WHEN k >= 2 THEN {q(L.COMPLETENESS[1])} ELSE {q(L.COMPLETENESS[2])} END AS completeness FROM s""",
)
def _(v):
    i = F.col("det_id")
    p = v.sql(PLAN + "{detections}").join(v.detections.select("det_id", "n_points"), "det_id")
    p = p.withColumn("power", F.when(i % 4 < 3, F.col("n_points") / 120.0)).withColumn("p", F.when(i % 5 < 4, (i % 7) / 100.0))
    p = p.withColumn("ndvi", F.when(i % 3 == 0, 0.5)).withColumn("elev", F.when(i % 2 == 0, 100.0))
    sig = T.academic_significance(F.col("t"), F.col("area_m2"), F.col("confidence"))
    return p.select(
        "det_id", T.publication_readiness(F.col("confidence"), F.col("power"), F.col("p")).alias("readiness"),
        sig.alias("significance"), T.citation_potential(sig).alias("citation"),
        T.dataset_completeness(F.col("p"), F.col("area_m2"), F.col("ndvi"), F.col("elev")).alias("completeness"),
    )


FCLASS = """CASE WHEN provider = 'gedi' THEN CASE WHEN contains(t, 'clearing') OR contains(t, 'settlement') THEN 'gedi_clearing' WHEN contains(t, 'mound') OR contains(t, 'earthwork') THEN 'gedi_mound'
  WHEN contains(t, 'linear') OR contains(t, 'causeway') THEN 'gedi_linear' ELSE 'gedi_clearing' END
  ELSE CASE WHEN contains(t, 'terra_preta') OR contains(t, 'soil') THEN 'terra_preta' WHEN contains(t, 'crop') THEN 'crop_mark' WHEN contains(t, 'circle') THEN 'geometric_circle'
  WHEN contains(t, 'rectangle') OR contains(t, 'square') THEN 'geometric_rectangle' WHEN contains(t, 'line') THEN 'geometric_line' ELSE 'terra_preta' END END"""


@query("j24_feature_class", f"SELECT det_id, {FCLASS} AS feature_class FROM (SELECT *, lower(det_type) AS t FROM detections) d")
def _(v):
    return v.detections.select("det_id", T.feature_class(F.col("provider"), F.col("det_type")).alias("feature_class"))


@query(
    "j25_display_category",
    f"""c AS ({CONV} detections) SELECT det_id, CASE WHEN det_id <= 5 THEN 'priority' WHEN lidar AND det_id % 4 < 2 AND confidence > 0 AND dist IS NOT NULL THEN 'cross_validated'
    WHEN provider = 'gedi' THEN 'gedi' ELSE 'sentinel2' END AS category FROM c""",
)
def _(v):
    c = v.sql(CONV + "{detections}")
    cat = T.display_category(F.col("det_id"), F.col("lidar"), F.col("det_id") % 4 < 2, F.col("confidence"), F.col("dist"), F.col("provider"))
    return c.select("det_id", cat.alias("category"))


@query(
    "j26_shape_confidence",
    """SELECT det_id, round(0.4E0 * coalesce(confidence, 0) + 0.3E0 * CASE WHEN r >= 60 THEN least(1, r / 100) ELSE 0.5E0 END + 0.3E0 * (n_points / 120.0E0), 9) AS circle,
    round(0.6E0 * least(1, length_m / 150) + 0.4E0, 9) AS line, round(0.7E0 * least(1, area_m2 / 1000) + 0.3E0 * least(1, 2 / (1 + angle_degrees / 45 + 1E-6)), 9) AS rect
    FROM (SELECT *, sqrt(area_m2 / pi()) AS r FROM detections) d""",
)
def _(v):
    r = F.sqrt(F.col("area_m2") / F.pi())
    return v.detections.select(
        "det_id", F.round(S.circle_confidence(F.coalesce("confidence", F.lit(0.0)), r, F.col("n_points") / 120.0), 9).alias("circle"),
        F.round(S.line_confidence(F.col("length_m")), 9).alias("line"),
        F.round(S.rectangle_confidence(F.col("area_m2"), 1 + F.col("angle_degrees") / 45), 9).alias("rect"),
    )


@query(
    "j27_pair_style",
    """SELECT det_id, CASE WHEN confidence >= 0.7E0 THEN '#DC143C' WHEN confidence >= 0.4E0 THEN '#FF8C00' ELSE '#FFD700' END AS color,
    CAST(CASE WHEN confidence >= 0.7E0 THEN 3 WHEN confidence >= 0.4E0 THEN 2 ELSE 1 END AS INT) AS weight,
    CASE WHEN confidence >= 0.7E0 THEN 0.8E0 WHEN confidence >= 0.4E0 THEN 0.6E0 ELSE 0.4E0 END AS opacity FROM detections""",
)
def _(v):
    return v.detections.select("det_id", T.pair_style(F.col("confidence")).alias("s")).select("det_id", "s.*")


@query(
    "j28_surface_marker",
    "SELECT det_id, CASE WHEN confidence * 10 >= 8 THEN 'high_confidence' WHEN confidence * 10 >= 6 THEN 'medium_confidence' ELSE 'low_confidence' END AS marker FROM detections",
)
def _(v):
    return v.detections.select("det_id", T.surface_marker(F.col("confidence") * 10).alias("marker"))


@query(
    "j29_zoom_levels",
    """e AS (SELECT det_type, greatest(max(lat) - min(lat), max(lon) - min(lon)) * (1 + count(*) % 20) AS r FROM detections GROUP BY det_type)
    SELECT det_type, CAST(CASE WHEN r > 10 THEN 4 WHEN r > 5 THEN 6 WHEN r > 2 THEN 8 WHEN r > 1 THEN 10 WHEN r > 0.5E0 THEN 12 ELSE 14 END AS INT) AS map_zoom,
      CAST(CASE WHEN r > 5 THEN 14 WHEN r > 2 THEN 16 WHEN r > 1 THEN 17 WHEN r > 0.5E0 THEN 18 ELSE 19 END AS INT) AS detail_zoom FROM e""",
)
def _(v):
    e = v.detections.groupBy("det_type").agg(
        (F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")) * (1 + F.count(F.lit(1)) % 20)).alias("r")
    )
    return e.select("det_type", S.zoom_level(F.col("r")).alias("map_zoom"), S.zoom_level(F.col("r"), "detail").alias("detail_zoom"))


@query(
    "h04_map_priority",
    """SELECT det_id, round(coalesce(confidence, 0.5E0) * log10(greatest(area_m2, 1)), 9) AS priority FROM detections""",
)
def _(v):
    return (
        v.detections.select("det_id", F.round(S.map_priority(F.col("confidence"), F.col("area_m2")), 9).alias("priority"))
        .orderBy(F.desc("priority"), "det_id")
    )
