"""Report tables: counts, summaries, inventories, quality and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import labels as L
from terraloom.functions import scores as S
from terraloom.operators.quantiles import quantiles

LEVELS = ((80, "Excellent"), (60, "Good"), (40, "Fair"))  # fixed values


def feature_counts(detections: DataFrame) -> DataFrame:
    """One row with the number of detections per family and provider."""
    t, p = F.col("det_type"), F.col("provider")
    return detections.agg(
        F.count_if(t == "gedi_clearing").alias("lidar_clearings"), F.count_if(t == "gedi_earthwork").alias("lidar_earthworks"),
        F.count_if(t == "terra_preta").alias("terra_preta_sites"), F.count_if(t.isin("circle", "line", "rectangle")).alias("geometric_patterns"),
        F.count_if(t.startswith("crop_mark")).alias("crop_marks"), F.count_if(p == "sentinel2").alias("total_spectral"),
        F.count_if(p == "gedi").alias("total_lidar"),
    )


def executive_summary(scores: DataFrame, detections: DataFrame) -> DataFrame:
    t = F.col("total_score")
    best = F.max(F.struct(t.alias("s"), (-F.col("zone_id")).alias("i"), "zone_name", "classification"))
    g = scores.agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(t >= 10).alias("high_confidence_sites"), F.count_if(t >= 7).alias("probable_features"),
        best.alias("_b"), (F.avg((t >= 7).cast("int")) * 100).alias("success_pct"),
    )
    n = detections.agg(F.count(F.lit(1))).scalar()
    return g.select(
        "zones", "high_confidence_sites", "probable_features", n.alias("total_features"), F.col("_b.zone_name").alias("best_zone"),
        F.col("_b.s").alias("best_score"), F.col("_b.classification").alias("best_class"), "success_pct",
    )


def provider_breakdown(detections: DataFrame) -> DataFrame:
    """Detections and types per zone and sensor family, as columns."""
    l, s = F.col("provider") == "gedi", F.col("provider") == "sentinel2"
    return detections.groupBy("zone_id").agg(
        F.count_if(l).alias("lidar_features"), F.count_if(s).alias("spectral_features"),
        F.count_distinct(F.when(l, F.col("det_type"))).alias("lidar_types"),
        F.count_distinct(F.when(s, F.col("det_type"))).alias("spectral_types"),
    )


def zone_action(score: Column) -> Column:
    return S.ladder(score, ((10, L.ZONE_ACTION[0]), (7, L.ZONE_ACTION[1]), (4, L.ZONE_ACTION[2])), L.ZONE_ACTION[3])


def zone_details(zones: DataFrame, scores: DataFrame, detections: DataFrame) -> DataFrame:
    """Score, class, action and provider breakdown of every zone."""
    out = zones.select("zone_id", "zone_name", "priority").join(
        scores.select("zone_id", "total_score", "classification"), "zone_id", "left"
    ).join(provider_breakdown(detections), "zone_id", "left")
    counts = ["lidar_features", "spectral_features", "lidar_types", "spectral_types"]
    out = out.fillna(0, subset=counts).fillna({"total_score": 0.0, "classification": "No analysis"})
    return out.withColumn("recommended_action", zone_action(F.col("total_score")))


def access_difficulty(name: Column) -> Column:
    return (
        F.when(name.contains("Upper"), L.ACCESS_DIFFICULTY[0])
        .when(name.contains("Confluence"), L.ACCESS_DIFFICULTY[1])
        .otherwise(L.ACCESS_DIFFICULTY[2])
    )


def high_priority_sites(scores: DataFrame, threshold: float = 7.0) -> DataFrame:
    """Zones to visit, with rank, access and cost range, best first."""
    t, name = F.col("total_score"), F.col("zone_name")
    cost = F.lit(30000) + F.when(t >= 10, 20000).otherwise(0) + F.when(name.contains("Upper"), 15000).otherwise(0)
    return (
        scores.where(t >= threshold)
        .select(
            "zone_id", "zone_name", t.alias("anomaly_score"), "classification", F.when(t >= 10, 1).otherwise(2).alias("priority_ranking"),
            access_difficulty(name).alias("access_difficulty"), cost.alias("cost_from_usd"), (cost + 10000).alias("cost_to_usd"),
        )
        .orderBy(F.desc("anomaly_score"), "zone_id")
    )


def survey_methods(has_clearing: Column, has_earthwork: Column, has_soil: Column, n_features: Column) -> Column:
    """Survey methods to bring, by the evidence of a zone."""
    lists = [
        (F.lit(True), ["GPS mapping", "Photographic documentation", "Artifact surface collection"]),
        (has_clearing, ["Vegetation pattern analysis", "Soil sampling for anthrosol detection"]),
        (has_earthwork, ["Topographic survey", "Ground-penetrating radar"]),
        (has_soil, ["Soil chemistry analysis", "Ceramic fragment collection"]),
        (n_features >= 3, ["Drone aerial photography", "Systematic test excavation"]),
    ]
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(c, F.array(*[F.lit(x) for x in xs])).otherwise(none) for c, xs in lists])


def provider_analysis(detections: DataFrame) -> DataFrame:
    return detections.groupBy("provider").agg(
        F.count_distinct("zone_id").alias("zones_covered"), F.count(F.lit(1)).alias("total_features"),
        F.avg(F.when(F.col("n_points") > 0, F.col("n_points"))).alias("mean_points"),
    )


def confidence_band() -> Column:
    t, n, c = F.col("det_type"), F.col("n_points"), F.coalesce("confidence", F.lit(0.0))
    return (
        F.when(t == "gedi_clearing", F.when(n >= 5, "high").otherwise("medium"))
        .when(t == "gedi_earthwork", F.when(n >= 4, "high").otherwise("medium"))
        .otherwise(F.when(c > 0.8, "high").when(c > 0.6, "medium").otherwise("low"))
    )


def feature_inventory(detections: DataFrame) -> DataFrame:
    """Counts by type, by zone, by confidence band and overall, as one grouping-sets aggregate."""
    d = detections.select("det_type", "zone_id", confidence_band().alias("band"))
    t, z, b = F.col("det_type"), F.col("zone_id"), F.col("band")
    return d.groupingSets([[t], [z], [b], []], t, z, b).agg(F.count(F.lit(1)).alias("n"))


def data_quality(shots: DataFrame) -> DataFrame:
    """LiDAR quality points and level per zone from volume, canopy and elevation availability."""
    g = shots.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("rh100").alias("_c"), F.count("elevation_ground").alias("_e")
    )
    score = (
        S.ladder(F.col("n"), ((1000, 30), (500, 20), (100, 10)), 0, ">")
        + F.when(F.col("_c") > 0, 35).otherwise(0) + F.when(F.col("_e") > 0, 35).otherwise(0)
    )
    g = g.withColumn("quality_score", score)
    return g.select("zone_id", "n", "quality_score", S.ladder(F.col("quality_score"), LEVELS, "Poor").alias("quality_level"))


def overall_quality(lidar: DataFrame, n_spectral: Column, spectral_score: float = 75.0) -> DataFrame:
    """Mean quality over LiDAR zones and spectral scenes, with its level."""
    g = lidar.agg(F.avg("quality_score").alias("lidar_mean"), F.sum("quality_score").alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = (F.col("_s") + n_spectral * spectral_score) / (F.col("_n") + n_spectral)
    return g.select("lidar_mean", mean.alias("overall_mean")).withColumn("overall_level", S.ladder(F.col("overall_mean"), LEVELS, "Poor"))


def technical_summary(scenes: DataFrame, ok: Column, shots: DataFrame) -> DataFrame:
    g = scenes.agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(ok).alias("successful"), (F.avg(ok.cast("int")) * 100).alias("success_pct")
    )
    return g.withColumn("lidar_points", shots.agg(F.count(F.lit(1))).scalar())


def resource_plan(scores: DataFrame) -> DataFrame:
    """Teams, duration and budget from the numbers of high and probable zones."""
    t = F.col("total_score")
    g = scores.agg(F.count_if(t >= 10).alias("high"), F.count_if((t >= 7) & (t < 10)).alias("probable"), F.count_if(t < 4).alias("reanalyse"))
    n = F.col("high") + F.col("probable")
    return g.select(
        "high", "probable", "reanalyse", F.greatest(F.lit(1), F.floor(n / 2)).cast("long").alias("teams"),
        F.greatest(F.lit(3), n * 4).cast("long").alias("min_days"), (n * 6).alias("max_days"),
        (F.col("high") * 60000 + F.col("probable") * 35000).alias("budget_usd"),
    )


def source_statistics(detections: DataFrame) -> DataFrame:
    """Count, mean, median and range of confidence per provider, and whether sources are unbalanced."""
    g = detections.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max")
    )
    med = quantiles(detections, ["provider"], "confidence", {"median": 0.5})
    ends = g.agg(F.struct(F.max("n").alias("hi"), F.min("n").alias("lo")).alias("x"))
    unbalanced = ends.select(F.col("x.hi") > F.col("x.lo") * 10).scalar()
    return g.join(med, "provider", "left").withColumn("unbalanced", unbalanced)


def map_bounds(detections: DataFrame) -> DataFrame:
    """Bounds, centre, zoom, density and geometry quality of a layer set."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    g = detections.agg(
        F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.min("lon").alias("west"),
        F.count(F.lit(1)).alias("n"), F.avg(ok.cast("int")).alias("_valid"),
    )
    h, w = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    area = F.abs(h * w) * 111.32 * 111.32
    return g.select(
        "north", "south", "east", "west", ((F.col("north") + F.col("south")) / 2).alias("centre_lat"),
        ((F.col("east") + F.col("west")) / 2).alias("centre_lon"), S.zoom_level(F.greatest(h, w), "detail").alias("zoom"),
        area.alias("area_km2"), F.when(area > 0, F.col("n") / area).otherwise(0.0).alias("features_per_km2"),
        ((F.col("_valid") + 1) / 2).alias("quality_score"),
    )


def lidar_coverage(shots: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("elevation_ground")
    h, w = F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")
    return shots.groupBy(*keys).agg(
        F.min(e).alias("min_elevation"), F.max(e).alias("max_elevation"), (F.max(e) - F.min(e)).alias("elevation_range"),
        F.avg(e).alias("mean_elevation"), (F.abs(h * w) * 111.32 * 111.32).alias("area_km2"),
    )


def convergence_summary(fused: DataFrame) -> DataFrame:
    """Numbers per convergence type and the cross-validation rate."""
    t = F.col("convergence_type")
    return fused.agg(
        F.count_if(t == "multi_sensor").alias("cross_validated"), F.count_if(t == "sentinel2_only").alias("spectral_only"),
        F.count_if(t == "gedi_only").alias("lidar_only"), F.count(F.lit(1)).alias("total"),
        F.avg((t == "multi_sensor").cast("int")).alias("cross_validation_rate"),
    )


def dataset_ids(records: DataFrame) -> DataFrame:
    """Distinct data set ids of each provider, a row each, with how many the provider has. Rows without an id or of an unknown provider are not listed."""
    ids = records.where(F.col("dataset_id").isNotNull() & F.col("provider").isin("sentinel2", "gedi")).select("provider", "dataset_id").distinct()
    return ids.join(ids.groupBy("provider").agg(F.count(F.lit(1)).alias("n_datasets")), "provider")


def layer_counts(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
