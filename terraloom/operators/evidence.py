"""Zone evidence, scores and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.quantiles import quantiles
from terraloom.constants import (
    MAX_GEOMETRIC, MAX_TOTAL, WEIGHT_ENVIRONMENT, WEIGHT_GEOMETRIC, WEIGHT_PRIORITY, WEIGHT_TERRA_PRETA,
)
from terraloom.functions import geo
from terraloom.functions import scores as S
from terraloom.functions import stats as ST

SHAPES = ("circle", "line", "rectangle")


def _is(kind: str) -> Column:
    return F.col("det_type") == kind


def zone_aggregates(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Everything the zone scores need from the detections, in one conditional aggregate per zone.

    Every zone appears, also without detections. Circles use ``diameter_m``, lines ``length_m``.
    """
    z = zones.select(
        "zone_id", "zone_name", "zone_type", "priority", ((F.col("west") + F.col("east")) / 2).alias("centre_lon"),
        ((F.col("south") + F.col("north")) / 2).alias("centre_lat"),
    )
    min_length = F.when(F.col("zone_type") == "deforested_visible_earthworks", 50).otherwise(500)
    d = detections.join(z.select("zone_id", "zone_type"), "zone_id")
    conf_half, conf_zero = F.coalesce("confidence", F.lit(0.5)), F.coalesce("confidence", F.lit(0.0))
    patch = _is("terra_preta") & (conf_zero > 0.3) & (F.col("area_m2") > 900)
    first = lambda cond: F.min(F.when(cond, F.struct("det_id", "lon", "lat")))
    aggs = []
    for s in SHAPES:
        aggs += [
            F.count_if(_is(s)).alias(f"n_{s}"), F.avg(F.when(_is(s), conf_half)).alias(f"conf_{s}"), first(_is(s)).alias(f"at_{s}")
        ]
    aggs += [
        F.count_if(_is("circle") & (F.col("diameter_m") > 150)).alias("big_circle"),
        F.count_if(_is("line") & (F.col("length_m") > min_length)).alias("big_line"),
        F.count_if(_is("rectangle") & (F.col("area_m2") > 10000)).alias("big_rectangle"),
        F.count_if(patch).alias("n_patch"), F.sum(F.when(patch, F.col("area_m2"))).alias("patch_area"),
        F.avg(F.when(patch, conf_zero)).alias("patch_conf"), first(patch).alias("at_patch"),
        F.avg(F.when(F.col("provider") == "gedi", conf_half)).alias("lidar_mean"),
        F.avg(F.when(_is("terra_preta"), conf_half)).alias("spectral_mean"),
        F.count_if(_is("gedi_clearing")).alias("n_gap"), F.count_if(_is("gedi_earthwork")).alias("n_mound"),
    ]
    agg = d.groupBy("zone_id").agg(*aggs)
    counts = [f"n_{s}" for s in SHAPES] + [f"big_{s}" for s in SHAPES] + ["n_patch", "n_gap", "n_mound"]
    return z.join(agg, "zone_id", "left").fillna(0, subset=counts)


def shape_scores() -> dict[str, Column]:
    """Weighted score per geometric family; NULL when the family gives no evidence."""
    visible = F.col("zone_type") == "deforested_visible_earthworks"
    circle = F.when(F.col("big_circle") > 0, 1.0).when(F.col("n_circle") > 0, 0.7)
    line = F.when(
        F.col("big_line") > 0,
        F.when(visible & (F.col("big_line") > 100), 1.2).when(F.col("big_line") > 20, 1.0).otherwise(0.8),
    )
    rect = F.when(F.col("big_rectangle") > 0, 0.9)
    return {s: f * WEIGHT_GEOMETRIC * F.col(f"conf_{s}") for s, f in zip(SHAPES, (circle, line, rect))}


def geometric_score() -> Column:
    return F.least(F.lit(MAX_GEOMETRIC), sum(F.coalesce(e, F.lit(0.0)) for e in shape_scores().values()))


def terra_preta_score() -> Column:
    bonus = F.when(F.col("patch_area") > 10000, 0.5).otherwise(0.0) + (F.col("patch_conf") - 0.3) * 0.5
    raw = F.least(F.lit(WEIGHT_TERRA_PRETA * 1.5), WEIGHT_TERRA_PRETA + bonus)
    return F.when(F.col("n_patch") > 0, raw).otherwise(0.0)


def environment_score() -> Column:
    name = F.lower("zone_name")
    lat, lon = F.col("centre_lat"), F.col("centre_lon")
    central = (lat > -5) & (lat < 0) & (lon > -65) & (lon < -55)
    river = name.contains("confluence") | name.contains("junction")
    return WEIGHT_ENVIRONMENT + F.when(river, 0.3).otherwise(0.0) + F.when(central, 0.2).otherwise(0.0)


def priority_bonus() -> Column:
    return F.when(F.col("priority") == 1, WEIGHT_PRIORITY).otherwise(0.0)


def evidence_rows(agg: DataFrame) -> DataFrame:
    """At most six evidence rows per zone: type, weight, confidence and location."""
    shapes = shape_scores()

    def item(kind, present, weight, conf, lon, lat):
        return F.when(
            present,
            F.struct(F.lit(kind).alias("type"), weight.alias("weight"), conf.alias("confidence"), lon.alias("lon"), lat.alias("lat")),
        )

    centre = (F.col("centre_lon"), F.col("centre_lat"))
    items = [
        item(f"geometric_{s}", e > 0, e, F.col(f"conf_{s}"), F.col(f"at_{s}.lon"), F.col(f"at_{s}.lat")) for s, e in shapes.items()
    ]
    items.append(
        item("terra_preta_signature", F.col("n_patch") > 0, terra_preta_score(), F.col("patch_conf"), F.col("at_patch.lon"), F.col("at_patch.lat"))
    )
    items.append(item("environmental_suitability", F.lit(True), F.lit(WEIGHT_ENVIRONMENT), F.lit(0.8), *centre))
    items.append(item("priority_bonus", F.col("priority") == 1, F.lit(WEIGHT_PRIORITY), F.lit(1.0), *centre))
    packed = agg.select("zone_id", F.array_compact(F.array(*items)).alias("items"))
    return packed.select("zone_id", F.explode("items").alias("e")).select("zone_id", "e.*")


def integration_bonus(evidence: DataFrame) -> DataFrame:
    """Bonus for complementary evidence per zone."""

    def strength(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("weight"))) * F.avg(F.when(cond, F.col("confidence"))), F.lit(0.0))

    t = F.col("type")
    g = evidence.groupBy("zone_id").agg(
        strength(t.contains("geometric") | t.contains("gedi")).alias("_g"),
        strength(t.contains("terra_preta") | t.contains("spectral")).alias("_s"),
        strength(t.isin("environmental_suitability", "priority_bonus")).alias("_c"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct("type").alias("_k"),
    )
    a, b = F.col("_g"), F.col("_s")
    sensors = F.when((a > 0) & (b > 0), (a + b) / 2 * 1.5).when((a > 1) | (b > 1), F.greatest(a, b) * 0.8).otherwise(0.0)
    context = F.when(F.col("_c") > 0, F.col("_c") * 0.5).otherwise(0.0)
    bonus = F.when(F.col("_n") < 2, 0.0).otherwise(F.least(F.lit(3.0), sensors + context + F.col("_k") * 0.3))
    return g.select("zone_id", bonus.alias("integration_bonus"), F.col("_n").alias("evidence_count"))


def zone_scores(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Score parts, capped total and class per zone."""
    agg = zone_aggregates(detections, zones)
    parts = agg.select(
        "zone_id", "zone_name", "zone_type", "priority", "centre_lon", "centre_lat",
        geometric_score().alias("geometric"), terra_preta_score().alias("terra_preta"),
        environment_score().alias("environment"), priority_bonus().alias("priority_bonus"),
        F.coalesce("lidar_mean", F.lit(0.0)).alias("lidar_mean"), F.coalesce("spectral_mean", F.lit(0.0)).alias("spectral_mean"),
    )
    s = parts.join(integration_bonus(evidence_rows(agg)), "zone_id")
    total = F.least(
        F.lit(MAX_TOTAL),
        F.col("geometric") + F.col("terra_preta") + F.col("environment") + F.col("priority_bonus") + F.col("integration_bonus"),
    )
    return s.withColumn("total_score", total).withColumn("classification", S.score_class(F.col("total_score")))


def confidence_metrics(evidence: DataFrame) -> DataFrame:
    """Weighted confidence, evidence diversity and spatial coherence per zone.

    A zone has at most six evidence rows, so pairing them with themselves stays tiny.
    """
    base = evidence.groupBy("zone_id").agg(
        (F.sum(F.col("weight") * F.col("confidence")) / F.sum("weight")).alias("overall_confidence"),
        F.least(F.lit(1.0), F.count_distinct("type") / 5.0).alias("evidence_strength"),
    )
    located = evidence.where(F.col("lon").isNotNull())
    a = located.select("zone_id", F.col("type").alias("ta"), F.col("lon").alias("xa"), F.col("lat").alias("ya"))
    b = located.select("zone_id", F.col("type").alias("tb"), F.col("lon").alias("xb"), F.col("lat").alias("yb"))
    d = geo.planar_deg(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    mean = a.join(b, "zone_id").where(F.col("ta") < F.col("tb")).groupBy("zone_id").agg(F.avg(d).alias("_d"))
    coherence = F.when(F.col("_d").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_d") * 10))
    out = base.join(mean, "zone_id", "left").withColumn("spatial_coherence", coherence).drop("_d")
    return out.withColumn(
        "composite_confidence", (F.col("overall_confidence") + F.col("evidence_strength") + F.col("spatial_coherence")) / 3
    )


def feature_details(detections: DataFrame) -> DataFrame:
    """Counts, areas, diameters and lengths per zone and type."""
    return detections.where(F.col("det_type").isin("terra_preta", *SHAPES)).groupBy("zone_id", "det_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_confidence"),
        F.avg(F.when(_is("circle"), F.col("diameter_m"))).alias("mean_diameter_m"),
        F.min(F.when(_is("circle"), F.col("diameter_m"))).alias("min_diameter_m"),
        F.max(F.when(_is("circle"), F.col("diameter_m"))).alias("max_diameter_m"),
        F.avg(F.when(_is("line"), F.col("length_m"))).alias("mean_length_m"),
        (F.sum(F.when(_is("line"), F.col("length_m"))) / 1000).alias("total_length_km"),
        (F.sum(F.when(_is("terra_preta") | _is("rectangle"), F.col("area_m2"))) / 10000).alias("total_area_ha"),
    )


def scoring_summary(scores: DataFrame) -> DataFrame:
    """One row of statistics over the zone scores."""
    t, c = F.col("total_score"), F.col("classification")
    median = quantiles(scores, [], t, {"median": 0.5}).scalar()
    return scores.agg(
        F.count(F.lit(1)).alias("zones"), F.avg(t).alias("mean_score"), F.first(median).alias("median_score"),
        F.max(t).alias("max_score"), F.min(t).alias("min_score"), F.stddev_pop(t).alias("std_score"),
        F.count_if(c.contains("HIGH CONFIDENCE")).alias("high_confidence"), F.count_if(c.contains("PROBABLE")).alias("probable"),
        F.count_if(c.contains("POSSIBLE")).alias("possible"), F.count_if(c.contains("NATURAL")).alias("natural"),
        (F.avg((t >= 7).cast("int")) * 100).alias("success_pct"),
    )


def top_zones(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.orderBy(F.desc("total_score"), "zone_id").limit(n)


def lidar_evidence(agg: DataFrame) -> DataFrame:
    """LiDAR evidence score per zone from the numbers of gap clusters and elevation anomalies."""
    gap, mound = F.least(F.lit(1.0), F.col("n_gap") / 10), F.least(F.lit(1.0), F.col("n_mound") / 5)
    return agg.select(
        "zone_id", gap.alias("gap_confidence"), mound.alias("elevation_confidence"), (3 * gap + 4 * mound).alias("lidar_score")
    )


def sensor_confidence(agg: DataFrame) -> DataFrame:
    """Mean confidence by sensor family and the temporal score per zone."""
    l, s = F.coalesce("lidar_mean", F.lit(0.0)), F.coalesce("spectral_mean", F.lit(0.0))
    return agg.select(
        "zone_id", l.alias("lidar"), s.alias("spectral"), F.when((l > 0) & (s > 0), 0.7).otherwise(0.3).alias("temporal")
    )


def site_confidence(sensors: DataFrame) -> DataFrame:
    """Fused site confidence per zone."""
    score = ST.combined_site_score(F.col("lidar"), F.col("spectral"), F.col("temporal"))
    s = sensors.withColumn("combined_score", score).withColumn("cohens_d", ST.effect_size(F.col("combined_score")))
    s = s.withColumn("p_value", ST.two_sided_z_p(F.col("cohens_d")))
    level = ST.confidence_level(F.col("cohens_d"), F.col("p_value"))
    return s.withColumn("confidence_level", level).withColumn(
        "meets_standards", (F.col("cohens_d") >= 0.5) & (F.col("p_value") < 0.01)
    )


def publication_statistics(sites: DataFrame) -> DataFrame:
    lv = F.col("confidence_level")
    median = quantiles(sites, [], "p_value", {"median": 0.5}).scalar()
    return sites.agg(
        F.count(F.lit(1)).alias("sites"), F.count_if("meets_standards").alias("meeting_standards"),
        F.avg("cohens_d").alias("mean_effect"), F.first(median).alias("median_p"),
        *[F.count_if(lv == k).alias(k.lower()) for k in ("EXCEPTIONAL", "HIGH", "MEDIUM", "LOW")],
        F.avg(((F.col("cohens_d") >= 0.8) & (F.col("p_value") < 0.01)).cast("int")).alias("statistical_power"),
    )


def recommended_journals(statistics: DataFrame) -> DataFrame:
    """Target journals for a set of sites, by how strong its statistics are."""
    from terraloom.functions.labels import JOURNALS

    pick = (
        F.when(F.col("exceptional") >= 2, F.lit("; ".join(JOURNALS["exceptional"])))
        .when(F.col("meeting_standards") >= 1, F.lit("; ".join(JOURNALS["standard"])))
        .otherwise(F.lit("; ".join(JOURNALS["other"])))
    )
    return statistics.select(pick.alias("journals"))
