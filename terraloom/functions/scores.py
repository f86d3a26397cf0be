"""Confidence, ranking and class scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.constants import CLASS_HIGH, CLASS_LABELS, CLASS_POSSIBLE, CLASS_PROBABLE
from terraloom.functions import labels as L


def cap1(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def ladder(value: Column, steps, otherwise, op: str = ">=") -> Column:
    """First matching rung of a threshold ladder, e.g. ((0.8, 40), (0.6, 30))."""
    tests = {">=": value.__ge__, ">": value.__gt__, "<=": value.__le__, "<": value.__lt__}
    expr = None
    for limit, result in steps:
        cond, res = tests[op](F.lit(limit)), F.lit(result)
        expr = F.when(cond, res) if expr is None else expr.when(cond, res)
    return expr.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def text_ladder(value: Column, steps, op: str = ">") -> Column:
    return ladder(value, steps[:-1], steps[-1][1], op)


# --- region confidences
def region_confidence_enhanced(tp: Column, ndvi: Column, ndre1: Column, area_m2: Column) -> Column:
    base = 0.4 * cap1(tp * 6) + 0.25 * cap1((ndvi - 0.3) * 3) + 0.25 * cap1(ndre1 * 6) + 0.1 * cap1(F.sqrt(area_m2) / 50)
    boost = F.when((tp > 0.25) & (ndre1 > 0.3), 1.3).when((tp > 0.2) & (ndre1 > 0.25), 1.15).otherwise(1.0)
    weak = F.when(tp + ndre1 * 0.5 < 0.3, 0.8).otherwise(1.0)
    return cap1(base * boost) * weak


def region_confidence_standard(tp: Column, ndvi: Column, n_px: Column) -> Column:
    raw = cap1(0.5 * cap1(tp * 10) + 0.3 * cap1((ndvi - 0.35) * 4) + 0.2 * cap1(n_px / 100))
    return F.when(tp > 0.12, F.greatest(raw, F.lit(0.6))).otherwise(raw)


def crop_confidence(area_m2: Column, mean_index: Column) -> Column:
    return cap1(F.sqrt(area_m2) / 30) * cap1(F.abs(mean_index) * 10) * 0.8


def circle_confidence(edge: Column, radius_m: Column, circularity: Column) -> Column:
    size = F.when(radius_m >= 60, cap1(radius_m / 100)).otherwise(0.5)
    return 0.4 * edge + 0.3 * size + 0.3 * circularity


def line_confidence(length_m: Column) -> Column:
    return 0.6 * cap1(length_m / 150) + 0.4


def rectangle_confidence(area_m2: Column, aspect: Column) -> Column:
    return 0.7 * cap1(area_m2 / 1000) + 0.3 * cap1(2 / (aspect + 1e-6))


# --- classes
def score_class(score: Column) -> Column:
    return (
        F.when(score >= CLASS_HIGH, CLASS_LABELS[0])
        .when(score >= CLASS_PROBABLE, CLASS_LABELS[1])
        .when(score >= CLASS_POSSIBLE, CLASS_LABELS[2])
        .otherwise(CLASS_LABELS[3])
    )


def recommendation(score: Column) -> Column:
    """struct of the five recommendation texts for a score."""

    def texts(key):
        return F.struct(*[F.lit(t).alias(f) for f, t in zip(L.RECOMMENDATION_FIELDS, L.RECOMMENDATIONS[key])])

    return (
        F.when(score >= CLASS_HIGH, texts("high"))
        .when(score >= CLASS_PROBABLE, texts("probable"))
        .when(score >= CLASS_POSSIBLE, texts("possible"))
        .otherwise(texts("natural"))
    )


# --- pair convergence, 0..15
SIGNIFICANT_TYPES = ("terra_preta", "geometric", "crop_mark")


def _significant(det_type: Column) -> Column:
    t = F.lower(det_type)
    return F.greatest(*[t.contains(s) for s in SIGNIFICANT_TYPES])


def pair_parts(side: str = "") -> Column:
    """What ``pair_score`` needs of one detection, as a struct of numbers and flags: texts are read once per detection, not once per pair. ``side`` is a struct column, or empty for columns of their own."""

    def f(name):
        return F.col(f"{side}.{name}" if side else name)

    p, g = F.lower(f("provider")), F.lower(f("grade"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        F.coalesce(f("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(f("area_m2"), F.lit(0.0)).alias("area"), flag(_significant(f("det_type"))).alias("kind"),
        F.when(g == "high", 2).when(g == "medium", 1).otherwise(0).alias("grade"), p.alias("provider"),
        flag(p.contains("gedi")).alias("lidar"), flag(p.contains("sentinel")).alias("spectral"), flag(p == "multi_sensor").alias("multi"),
    )


def pair_score(a: str, b: str, distance_deg: Column, density: Column | None = None, parts: tuple[str, str] | None = None) -> Column:
    """Five-factor convergence score of two detections given as struct column names. ``parts`` names their ``pair_parts`` where these are columns already."""
    x, y = [F.col(c) for c in parts] if parts else (pair_parts(a), pair_parts(b))
    near = ladder(distance_deg, ((0.0005, 3.0), (0.001, 2.5), (0.002, 2.0), (0.005, 1.0)), 0.5, "<=")
    c1, c2 = x["confidence"], y["confidence"]
    mean, gap = (c1 + c2) / 2, F.abs(c1 - c2)
    agree = (
        F.when((mean >= 0.9) & (gap <= 0.1), 3.0)
        .when((mean >= 0.8) & (gap <= 0.2), 2.5)
        .when((mean >= 0.7) & (gap <= 0.3), 2.0)
        .when(mean >= 0.6, 1.0)
        .otherwise(0.5)
    )
    mixed = (x["lidar"] & y["spectral"]) | (x["spectral"] & y["lidar"])
    sensors = F.when(x["provider"] == y["provider"], 1.0).when(mixed, 3.0).when(x["multi"] | y["multi"], 2.5).otherwise(2.0)
    kind = F.when(x["kind"] & y["kind"], 3.0).when(x["kind"] | y["kind"], 2.0).otherwise(1.0)
    size = ladder(F.greatest(x["area"], y["area"]), ((50000, 0.5), (10000, 0.3)), 0.0)
    high, low = F.greatest(x["grade"], y["grade"]), F.least(x["grade"], y["grade"])
    grade = F.when(low == 2, 3.0).when(high == 2, 2.5).when(low == 1, 2.0).when(high == 1, 1.5).otherwise(1.0)
    context = F.when(density > 0.5, 0.5).otherwise(0.0) if density is not None else F.lit(0.0)
    return F.least(F.lit(15.0), near + agree + sensors + kind + size + grade + context)


def scene_quality(cloud: Column, overlap_pct: Column, centre_km: Column, month: Column) -> Column:
    """0..100 quality of a scene for a zone."""
    return (
        ladder(cloud, ((5, 30), (10, 25), (15, 15), (20, 8)), 0, "<=")
        + ladder(overlap_pct, ((95, 40), (85, 32), (75, 24), (65, 16)), 0)
        + ladder(centre_km, ((10, 20), (25, 15), (50, 10)), 0, "<=")
        + F.when(month.between(6, 9), 10).otherwise(0)
    )


# --- rankings
def priority_score(conf: Column, supported: Column, convergent: Column, area: Column, det_type: Column, provider: Column):
    """Top-candidate priority used for the per-zone export."""
    conv, a = F.coalesce(convergent, F.lit(0.0)), F.coalesce(area, F.lit(0.0))
    return (
        F.coalesce(conf, F.lit(0.0))
        + F.when(supported, 10.0).otherwise(0.0)
        + F.when(conv > 0, conv * 1.5).otherwise(0.0)
        + ladder(a, ((50000, 1.0), (10000, 0.5)), 0.0, ">")
        + F.when(F.lower(det_type).contains("terra_preta"), 0.5).otherwise(0.0)
        + F.when(F.lower(det_type).contains("gedi_clearing"), 0.3).otherwise(0.0)
        + F.when(provider.contains("multi_sensor"), 2.0).otherwise(0.0)
    )


def candidate_score(conf: Column, conv: Column, lidar: Column, spectral: Column, det_type: Column, provider: Column):
    """Cross-provider candidate score with type, convergence and provider bonuses."""
    t = F.lower(det_type)
    one = lambda flag: F.when(flag, 0.1).otherwise(0.0)
    base = F.coalesce(conf, F.lit(0.0)) * 0.4 + conv * 0.4 + one(lidar) + one(spectral)
    kind = (
        F.when(t.contains("gedi_clearing"), 0.3)
        .when(t.contains("crop_mark"), 0.2)
        .when(t.contains("earthwork"), 0.25)
        .when(t.contains("geometric"), 0.15)
        .otherwise(0.0)
    )
    conv_bonus = F.when(conv > 0, 0.5).otherwise(0.0)
    both = F.when(lidar & spectral, 0.4).when(provider == "gedi", 0.2).otherwise(0.0)
    return base + kind + conv_bonus + both


def map_priority(conf: Column, area: Column) -> Column:
    return F.coalesce(conf, F.lit(0.5)) * F.log10(F.greatest(F.coalesce(area, F.lit(1000.0)), F.lit(1.0)))


def investigation_points(conf: Column, area: Column, count: Column) -> Column:
    return (
        ladder(F.coalesce(conf, F.lit(0.0)), ((0.8, 40), (0.6, 30), (0.4, 20)), 0)
        + ladder(area, ((50000, 30), (10000, 20), (1000, 10)), 0)
        + ladder(count, ((100, 30), (50, 20), (10, 10)), 0)
    )


def zoom_level(max_range: Column, table: str = "map") -> Column:
    if table == "map":
        return ladder(max_range, ((10, 4), (5, 6), (2, 8), (1, 10), (0.5, 12)), 14, ">")
    return ladder(max_range, ((5.0, 14), (2.0, 16), (1.0, 17), (0.5, 18)), 19, ">")
