"""Validation of detections against reference areas, density expectations and data rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import PRESETS
from terraloom.functions.texts import fixed
from terraloom.operators import reference_areas as ra
from terraloom.operators.spatial import nearest_distance, nearest_zone

ZONE_RADIUS_KM, ZONE_REACH_KM = 7.0, 50.0  # fixed values


def area_coverage(points: DataFrame, keys: list[str], centres: DataFrame) -> DataFrame:
    """Area in km2 per batch: the search circle of a zone within 50 km of the batch mean, else the box.

    Batches of fewer than two points count as 1 km2.
    """
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_w"),
    )
    batch = g.withColumn("_batch", F.struct(*keys))
    zone = nearest_zone(batch, centres, "_batch", ZONE_REACH_KM).select("_batch", "nearest_zone")
    box = F.col("_h") * 111 * (F.col("_w") * 111 * F.cos(F.radians("lat")))
    area = (
        F.when(F.col("n") < 2, 1.0)
        .when(F.col("nearest_zone").isNotNull(), 3.14159 * ZONE_RADIUS_KM**2)
        .otherwise(F.greatest(F.lit(1.0), box))
    )
    out = batch.join(zone, "_batch", "left").withColumn("area_km2", area)
    return out.withColumn("density_km2", F.col("n") / (F.col("area_km2") + 1e-6)).select(*keys, "n", "area_km2", "density_km2")


def validation_metrics(points: DataFrame, keys: list[str], centres: DataFrame) -> DataFrame:
    """Hits in known sites and control areas, rates and density per batch."""
    hits = ra.within(points, ra.areas(points.sparkSession))
    counts = hits.groupBy(*keys).agg(
        F.count_if(~F.col("is_control")).alias("_tp"), F.count_if("is_control").alias("_fp")
    )
    out = area_coverage(points, keys, centres).join(counts, keys, "left").fillna(0, subset=["_tp", "_fp"])
    return out.select(
        *keys, "n", "area_km2", "density_km2", F.col("_tp").alias("true_positives"), F.col("_fp").alias("false_positives"),
        (F.col("_tp") / F.col("n")).alias("true_positive_rate"), (F.col("_fp") / F.col("n")).alias("false_positive_rate"),
    )


def _flag(cond: Column, reason: Column, severity: str) -> Column:
    return F.when(cond, F.struct(reason.alias("flag_reason"), F.lit(severity).alias("severity")))


def detection_flags(points: DataFrame, preset: str = "archaeological") -> DataFrame:
    """One row per detection and broken rule, with reason and severity."""
    p = PRESETS[preset]
    conf, area = F.coalesce("confidence", F.lit(0.0)), F.coalesce("area_m2", F.lit(0.0))
    low, mid = p["eventual_confidence"], p["probable_confidence"]
    rules = [
        _flag(area > 100000, F.concat(F.lit("Very large feature ("), fixed(area / 10000, 1), F.lit(" hectares)")), "medium"),
        _flag(
            F.col("det_type").isin("line", "rectangle") & (F.pmod(F.col("angle_degrees"), F.lit(90.0)) < 2),
            F.lit("Perfect cardinal alignment suggests processing artifact"), "medium",
        ),
        _flag(conf > 0.98, F.lit("Unrealistically high confidence (>98%)"), "medium"),
        _flag(conf < low, F.lit(f"Below minimum archaeological confidence threshold ({low * 100:.0f}%)"), "high"),
        _flag(
            (conf >= low) & (conf < mid),
            F.concat(F.lit("Low archaeological confidence ("), fixed(conf * 100, 0), F.lit(f"% < {mid * 100:.0f}%)")), "medium",
        ),
    ]
    own = points.select("det_id", "det_type", "lon", "lat", "confidence", "area_m2", F.explode(F.array_compact(F.array(*rules))).alias("f"))
    control = ra.areas(points.sparkSession).where("is_control")
    risky = ra.within(points.where(conf > 0.8), control).select(
        "det_id", "det_type", "lon", "lat", "confidence", "area_m2",
        F.struct(F.concat(F.lit("High confidence detection in "), F.col("area_type")).alias("flag_reason"), F.lit("high").alias("severity")).alias("f"),
    )
    return own.unionByName(risky).select("det_id", "det_type", "lon", "lat", "confidence", "area_m2", "f.*")


def density_flags(coverage: DataFrame, keys: list[str], preset: str = "archaeological") -> DataFrame:
    """Area-wide flags per batch; both density units of the rule set are kept, with the unit in the name."""
    p = PRESETS[preset]
    d = F.col("density_km2")
    hi, lo, wet = p["max_density_terra_firme"], p["min_density"], p["max_density_varzea"]
    rules = [
        _flag(d * 100 > hi, F.lit("density_per_100km2_above_expected"), "high"),
        _flag(d * 100 < lo, F.lit("density_per_100km2_below_expected"), "medium"),
        _flag(d > wet, F.lit("density_per_km2_above_floodplain"), "high"),
        _flag((d > hi) & (d <= wet), F.lit("density_per_km2_above_expected"), "medium"),
    ]
    return coverage.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("f")).select(*keys, "f.*")


def recommendations(metrics: DataFrame, n_flags: Column) -> DataFrame:
    """Advice per batch from rates, density and share of flagged detections."""
    tips = F.concat_ws(
        "; ",
        F.when(F.col("false_positives") > F.col("true_positives"), "High false positive rate detected - increase confidence thresholds"),
        F.when(F.col("density_km2") > 5, "Detection density appears high - verify algorithms are not over-detecting"),
        F.when(n_flags > F.col("n") * 0.2, "More than 20% of detections flagged - review detection parameters"),
    )
    return metrics.withColumn("recommendations", tips)


def convergence_quality(detections: DataFrame) -> DataFrame:
    """One row on how many detections other sensors support and how far away the support lies."""
    hit = F.col("convergence_distance_m").isNotNull()
    rate, mean = F.avg(hit.cast("int")), F.coalesce(F.avg(F.col("convergence_distance_m")), F.lit(0.0))
    g = detections.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("provider") == "sentinel2").alias("n_spectral"),
        F.count_if(F.col("provider") == "gedi").alias("n_lidar"), F.count_if(hit).alias("n_convergent"),
        rate.alias("rate"), mean.alias("mean_distance_m"),
    )
    band = F.when(F.col("rate") > 0.8, "excellent").when(F.col("rate") > 0.6, "good").when(F.col("rate") > 0.4, "moderate").otherwise("poor")
    return g.select(
        "*", band.alias("quality"), (F.col("rate") < 0.5).alias("low_convergence_rate"),
        (F.col("mean_distance_m") > 300).alias("large_convergence_distance"), (F.col("rate") > 0.3).alias("requirement_met"),
    )


def identical_areas(detections: DataFrame, more_than: int = 5) -> DataFrame:
    """Areas shared by suspiciously many detections."""
    return detections.groupBy("area_m2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def crowded_features(detections: DataFrame, key: str) -> DataFrame:
    """Detections whose side is longer than 80 % of the distance to their nearest neighbour."""
    near = nearest_distance(detections.select(key, "lon", "lat"), key).select(key, (F.col("nn_deg") * 111000).alias("nearest_m"))
    j = detections.select(key, "area_m2").join(near, key).withColumn("size_m", F.sqrt("area_m2"))
    return j.where(F.col("size_m") > F.col("nearest_m") * 0.8)


def check_requirements(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Evaluate exists / not_empty / min_count / min_value / contains rules in one aggregate, one row each."""
    aggs = []
    for i, rule in enumerate(rules):
        kind, col = rule.get("type", "exists"), rule.get("column")
        present = F.count(F.lit(1) if col is None else F.col(col))
        if kind in ("exists", "not_empty"):
            ok = present > 0
        elif kind == "min_count":
            ok = (F.count_distinct(col) if rule.get("distinct") else present) >= rule["n"]
        elif kind == "min_value":
            ok = F.coalesce(F.max(col) >= rule["n"], F.lit(False))
        elif kind == "contains":
            ok = F.lit(True)
            for item in rule["items"]:
                ok = ok & F.coalesce(F.bool_or(F.col(col) == item), F.lit(False))
        else:
            raise ValueError(f"unknown rule type {kind}")
        aggs.append(ok.alias(f"r{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(r["name"]).alias("requirement"), F.col(f"r{i}").alias("met")) for i, r in enumerate(rules)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
