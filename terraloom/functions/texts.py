"""Interpretation, planning and publication texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions import labels as L
from terraloom.functions.scores import investigation_points, ladder, text_ladder


def _conf(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def lookup(key: Column, table: dict) -> Column:
    """Value for a key of a small fixed table; the empty key is the default."""
    expr = F.lit(table[""])
    for name, text in table.items():
        if name:
            expr = F.when(key == name, F.lit(text)).otherwise(expr)
    return expr


def lidar_interpretation(det_type: Column, area: Column) -> Column:
    return (
        F.when(det_type.contains("clearing"), text_ladder(area, L.LIDAR_TEXT["clearing"]))
        .when(det_type.contains("mound"), text_ladder(area, L.LIDAR_TEXT["mound"]))
        .otherwise(L.LIDAR_TEXT["other"])
    )


def spectral_interpretation(det_type: Column, area: Column, conf: Column) -> Column:
    g = L.SPECTRAL_TEXT["geometric"]
    shape = F.lit(g[""])
    for name in ("line", "rectangle", "circle"):
        shape = F.when(det_type.contains(name), g[name]).otherwise(shape)
    return (
        F.when(det_type.contains("terra_preta"), text_ladder(area, L.SPECTRAL_TEXT["terra_preta"]))
        .when(det_type.contains("geometric"), shape)
        .when(det_type.contains("crop_mark"), L.SPECTRAL_TEXT["crop_mark"])
        .otherwise(text_ladder(_conf(conf), L.SPECTRAL_TEXT["other"], ">="))
    )


def investigation_priority(conf: Column, area: Column, count: Column) -> Column:
    return text_ladder(investigation_points(conf, area, count), L.PRIORITY_TEXT, ">=")


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, ties rounded to even."""
    return F.call_function("format_number", x, F.lit("0" if digits == 0 else "0." + "0" * digits))


def percent(x: Column) -> Column:
    """Percentage with one decimal, as text."""
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def selection_reason(conf: Column, distance_m: Column, lidar: Column, combined: Column, det_type: Column) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(_conf(conf) >= 0.5, F.concat(F.lit("High confidence ("), percent(conf), F.lit(")"))),
        F.when(
            distance_m.isNotNull(),
            F.concat(F.lit("Multi-sensor convergence at "), fixed(distance_m, 0), F.lit("m")),
        ),
        F.when(lidar, "GEDI LiDAR support"),
        F.when(combined > _conf(conf), F.concat(F.lit("Enhanced combined confidence ("), percent(combined), F.lit(")"))),
        F.when(det_type.contains("terra_preta"), "Terra preta archaeological significance")
        .when(det_type.contains("geometric"), "Geometric pattern archaeological relevance")
        .when(det_type.contains("crop_mark"), "Subsurface archaeological indicators"),
    )
    return F.when(parts == "", "Standard archaeological criteria met").otherwise(parts)


def convergence_strength(distance_m: Column) -> Column:
    return (
        F.when(distance_m.isNull(), "none").when(distance_m < 200, "strong").when(distance_m < 500, "moderate").otherwise("weak")
    )


def quality_indicators(conf: Column, distance_m: Column, lidar: Column, area: Column) -> Column:
    return F.struct(
        ladder(_conf(conf), ((0.8, "high"), (0.5, "moderate")), "low").alias("confidence_level"),
        distance_m.isNotNull().alias("multi_sensor"),
        lidar.alias("lidar_correlation"),
        ladder(F.coalesce(area, F.lit(0.0)), ((10000, "large"), (1000, "medium")), "small", ">").alias("area_significance"),
        convergence_strength(distance_m).alias("convergence_strength"),
    )


def equipment(det_type: Column, area: Column) -> Column:
    none = F.array().cast("array<string>")

    def items(values):
        return F.array(*[F.lit(v) for v in values])

    return F.concat(
        items(L.EQUIPMENT_COMMON),
        F.when(det_type.contains("terra_preta"), items(L.EQUIPMENT_SOIL)).otherwise(none),
        F.when(det_type.contains("geometric"), items(L.EQUIPMENT_GEOMETRIC)).otherwise(none),
        F.when(area > 50000, items(L.EQUIPMENT_LARGE)).otherwise(none),
    )


def zone_list(zone: Column, common: list[str], table: dict) -> Column:
    expr = F.array(*[F.lit(c) for c in common])
    extra = F.array().cast("array<string>")
    for name, values in table.items():
        extra = F.when(zone == name, F.array(*[F.lit(x) for x in values])).otherwise(extra)
    return F.concat(expr, extra)


def field_days(det_type: Column, area: Column, conf: Column) -> Column:
    return (
        F.lit(3)
        + ladder(area, ((100000, 7), (50000, 5), (10000, 3)), 0, ">")
        + F.when(_conf(conf) > 0.8, 2).otherwise(0)
        + F.when(det_type.contains("geometric"), 2).otherwise(0)
    )


def field_duration(days: Column) -> Column:
    kind = ladder(days, ((5, "preliminary survey"), (10, "comprehensive survey")), "extensive excavation campaign", "<=")
    return F.concat(days.cast("string"), F.lit(" days ("), kind, F.lit(")"))


def logistics(zone: Column, area: Column) -> Column:
    base = lookup(zone, L.LOGISTICS)
    return F.when(area > 100000, F.concat(base, F.lit(" + Extended campaign logistics"))).otherwise(base)


def publication_readiness(conf: Column, power: Column, p: Column) -> Column:
    c, w, q = _conf(conf), F.coalesce(power, F.lit(0.0)), F.coalesce(p, F.lit(1.0))
    return (
        F.when((c > 0.8) & (w > 0.8) & (q < 0.01), L.READINESS[0])
        .when((c > 0.7) & (w > 0.7) & (q < 0.05), L.READINESS[1])
        .when(c > 0.5, L.READINESS[2])
        .otherwise(L.READINESS[3])
    )


def academic_significance(det_type: Column, area: Column, conf: Column) -> Column:
    c = _conf(conf)
    return (
        F.when(det_type.contains("geometric") & (area > 50000) & (c > 0.8), L.SIGNIFICANCE[0])
        .when((area > 100000) & (c > 0.7), L.SIGNIFICANCE[1])
        .when(c > 0.8, L.SIGNIFICANCE[2])
        .when(area > 10000, L.SIGNIFICANCE[3])
        .otherwise(L.SIGNIFICANCE[4])
    )


def citation_potential(significance: Column) -> Column:
    return (
        F.when(significance.contains("Very High"), L.CITATIONS[0])
        .when(significance.contains("High"), L.CITATIONS[1])
        .when(significance.contains("Medium"), L.CITATIONS[2])
        .otherwise(L.CITATIONS[3])
    )


def dataset_completeness(p: Column, area: Column, ndvi: Column, elevation: Column) -> Column:
    n = (
        p.isNotNull().cast("int") + F.coalesce(area > 0, F.lit(False)).cast("int")
        + ndvi.isNotNull().cast("int") + elevation.isNotNull().cast("int")
    )
    return ladder(n, ((3, L.COMPLETENESS[0]), (2, L.COMPLETENESS[1])), L.COMPLETENESS[2])


def lidar_class(det_type: Column) -> Column:
    t = F.lower(F.coalesce(det_type, F.lit("")))
    return (
        F.when(t.contains("clearing") | t.contains("settlement"), "gedi_clearing")
        .when(t.contains("mound") | t.contains("earthwork"), "gedi_mound")
        .when(t.contains("linear") | t.contains("causeway"), "gedi_linear")
        .otherwise("gedi_clearing")
    )


def spectral_class(det_type: Column) -> Column:
    t = F.lower(F.coalesce(det_type, F.lit("")))
    return (
        F.when(t.contains("terra_preta") | t.contains("soil"), "terra_preta")
        .when(t.contains("crop"), "crop_mark")
        .when(t.contains("circle"), "geometric_circle")
        .when(t.contains("rectangle") | t.contains("square"), "geometric_rectangle")
        .when(t.contains("line"), "geometric_line")
        .otherwise("terra_preta")
    )


def feature_class(provider: Column, det_type: Column) -> Column:
    return F.when(provider == "gedi", lidar_class(det_type)).otherwise(spectral_class(det_type))


def display_category(rank: Column, lidar: Column, spectral: Column, score: Column, distance_m: Column, provider: Column):
    crossed = lidar & spectral & (score > 0) & distance_m.isNotNull()
    return (
        F.when(F.coalesce(rank <= 5, F.lit(False)), "priority")
        .when(F.coalesce(crossed, F.lit(False)), "cross_validated")
        .when(provider == "gedi", "gedi")
        .otherwise("sentinel2")
    )


def pair_style(strength: Column) -> Column:
    """struct(color, weight, opacity) of a pair line."""

    def style(color, weight, opacity):
        return F.struct(F.lit(color).alias("color"), F.lit(weight).alias("weight"), F.lit(opacity).alias("opacity"))

    return (
        F.when(strength >= 0.7, style("#DC143C", 3, 0.8))
        .when(strength >= 0.4, style("#FF8C00", 2, 0.6))
        .otherwise(style("#FFD700", 1, 0.4))
    )


def surface_marker(score: Column) -> Column:
    return ladder(score, ((8, "high_confidence"), (6, "medium_confidence")), "low_confidence")
