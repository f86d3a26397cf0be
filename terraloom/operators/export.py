"""Export tables: nested GeoJSON rows, pair lines, manifests, flag lists, staged outputs and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import EXPORT_MIN_COMBINED, EXPORT_MIN_LIDAR, EXPORT_MIN_SPECTRAL
from terraloom.functions import geo
from terraloom.functions import labels as L
from terraloom.functions import texts as T


def _conf() -> Column:
    return F.coalesce("confidence", F.lit(0.0))


def point_geometry() -> Column:
    """GeoJSON point of lon/lat after axis repair."""
    at = geo.axis_repaired(F.col("lon"), F.col("lat"))
    return F.struct(F.lit("Point").alias("type"), F.array(at["lon"], at["lat"]).alias("coordinates"))


def _field(zone: Column) -> Column:
    t, a, c = F.col("det_type"), F.col("area_m2"), F.col("confidence")
    return F.struct(
        T.lookup(zone, L.SEASONS).alias("optimal_visit_season"), T.equipment(t, a).alias("recommended_equipment"),
        T.field_duration(T.field_days(t, a, c)).alias("estimated_investigation_days"),
        T.logistics(zone, a).alias("logistics_complexity"),
        T.zone_list(zone, L.SAFETY_COMMON, L.SAFETY).alias("safety_considerations"),
        T.zone_list(zone, L.PERMITS_COMMON, L.PERMITS).alias("permits_required"),
    )


def _research() -> Column:
    t, a, c = F.col("det_type"), F.col("area_m2"), F.col("confidence")
    none = F.lit(None).cast("double")
    sig = T.academic_significance(t, a, c)
    return F.struct(
        T.publication_readiness(c, none, none).alias("publication_readiness"), sig.alias("academic_significance"),
        T.citation_potential(sig).alias("citation_potential"),
        T.dataset_completeness(none, a, none, none).alias("dataset_completeness"),
    )


def lidar_features(detections: DataFrame, run_id: str, zone: str = "zone_name") -> DataFrame:
    """LiDAR detections of confidence 0.40 and more as nested feature rows."""
    z, t, a, c = F.col(zone), F.col("det_type"), F.col("area_m2"), F.col("confidence")
    props = F.struct(
        t.alias("type"), c.alias("confidence"), (a / 1e6).alias("area_km2"), a.alias("area_m2"), F.col("n_points").alias("count"),
        F.struct(
            F.lit("NASA GEDI").alias("mission"), F.lit(25).alias("footprint_diameter_m"), F.col("n_points").alias("pulse_density")
        ).alias("sensor_details"),
        F.struct(
            T.lidar_interpretation(t, a).alias("interpretation"),
            T.investigation_priority(c, a, F.col("n_points")).alias("investigation_priority"),
        ).alias("archaeological_assessment"),
        F.struct(T.lookup(z, L.ACCESS).alias("accessibility")).alias("spatial_context"),
        _field(z).alias("field_investigation"), _research().alias("research_metadata"),
        F.struct(z.alias("zone"), F.col("provider"), F.lit(run_id).alias("run_id")).alias("data_provenance"),
    )
    kept = detections.where((F.col("provider") == "gedi") & (_conf() >= EXPORT_MIN_LIDAR))
    return kept.select("det_id", F.lit("Feature").alias("type"), point_geometry().alias("geometry"), props.alias("properties"))


def spectral_features(detections: DataFrame, run_id: str, zone: str = "zone_name") -> DataFrame:
    """Spectral detections of confidence 0.50 and more as nested feature rows; missing confidence counts as 0."""
    z, t, a = F.col(zone), F.col("det_type"), F.col("area_m2")
    props = F.struct(
        t.alias("type"), _conf().alias("confidence"), a.alias("area_m2"), (F.coalesce(a, F.lit(0.0)) / 1e6).alias("area_km2"),
        F.struct(
            F.lit("ESA Sentinel-2").alias("mission"), F.lit(10).alias("spatial_resolution_m"), F.lit("L2A").alias("processing_level")
        ).alias("sensor_details"),
        F.struct(T.spectral_interpretation(t, a, F.col("confidence")).alias("interpretation")).alias("archaeological_assessment"),
        _field(z).alias("field_investigation"), _research().alias("research_metadata"),
        F.struct(z.alias("zone"), F.col("provider"), F.lit(run_id).alias("run_id")).alias("data_provenance"),
    )
    kept = detections.where((F.col("provider") == "sentinel2") & (_conf() >= EXPORT_MIN_SPECTRAL))
    return kept.select("det_id", F.lit("Feature").alias("type"), point_geometry().alias("geometry"), props.alias("properties"))


def _convergence() -> list[Column]:
    return [
        F.col("convergent_score"), F.col("convergence_distance_m"), F.col("combined_confidence"), F.col("lidar_support"), F.col("convergence_type"),
    ]


def _rationale() -> list[Column]:
    args = (F.col("confidence"), F.col("convergence_distance_m"), F.col("lidar_support"))
    return [
        T.selection_reason(*args, F.col("combined_confidence"), F.col("det_type")).alias("selection_reason"),
        T.quality_indicators(*args, F.col("area_m2")).alias("quality_indicators"),
    ]


def combined_features(detections: DataFrame, run_id: str) -> DataFrame:
    """Detections of confidence 0.50 and more with convergence metadata and rationale."""
    props = F.struct(
        F.col("det_type").alias("type"), F.col("confidence"), F.col("area_m2"), F.col("zone_id").alias("zone"), F.col("provider"),
        F.lit(run_id).alias("run_id"), *_convergence(), *_rationale(), F.lit("high").alias("archaeological_grade"),
    )
    kept = detections.where(_conf() >= EXPORT_MIN_COMBINED)
    return kept.select("det_id", F.lit("Feature").alias("type"), point_geometry().alias("geometry"), props.alias("properties"))


def top_candidate_features(ranked: DataFrame, run_id: str) -> DataFrame:
    """Ranked candidates (priority_rank, field_priority) as feature rows."""
    props = F.struct(
        F.col("priority_rank"), F.col("det_type").alias("type"), F.col("confidence"), F.col("area_m2"), F.col("zone_id").alias("zone"),
        F.col("provider"), F.lit(run_id).alias("run_id"), F.col("field_priority").alias("field_investigation_priority"), *_convergence(),
    )
    return ranked.select("det_id", F.lit("Feature").alias("type"), point_geometry().alias("geometry"), props.alias("properties"))


def export_decision(detections: DataFrame) -> DataFrame:
    """Would each detection be exported, and why."""
    c, p = _conf(), F.col("provider")
    passes = F.when(p == "gedi", c >= EXPORT_MIN_LIDAR).otherwise(c >= EXPORT_MIN_COMBINED)
    reason = (
        F.when((p == "sentinel2") & (c >= 0.50), "Meets Sentinel-2 50% confidence threshold")
        .when((p == "gedi") & (c >= 0.40), "Meets GEDI 40% confidence threshold")
        .when(c >= 0.50, "Meets combined 50% confidence threshold")
        .otherwise(F.concat(F.lit("Below confidence threshold ("), T.percent(c), F.lit(" < 50% for Sentinel-2 or 40% for GEDI)")))
    )
    return detections.withColumn("exported", passes).withColumn("export_reason", reason).withColumn(
        "marker_style", F.when(F.col("exported"), "exported").otherwise("filtered")
    ).withColumn("archaeological_grade", F.when(F.col("exported"), "high").otherwise("unverified"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Convergent pairs (structs a, b) as line features."""
    line = F.array(F.array("a.lon", "a.lat"), F.array("b.lon", "b.lat"))
    props = F.struct(
        F.col("distance_m"), F.col("strength"), F.col("combined_confidence"), F.array("a.provider", "b.provider").alias("providers"),
        F.col("a.det_type").alias("feature1_type"), F.col("b.det_type").alias("feature2_type"),
    )
    return pairs.select(
        F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), props.alias("properties")
    )


def to_geojson_lines(features: DataFrame) -> DataFrame:
    """One JSON text per feature (newline-delimited GeoJSON)."""
    return features.select(F.to_json(F.struct("type", "geometry", "properties")).alias("value"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Write features from all tasks in parallel, one feature per line."""
    to_geojson_lines(features).write.mode("overwrite").text(path)


def manifest(files: DataFrame) -> DataFrame:
    """Number of files and their names per provider, from rows of (provider, file)."""
    return files.groupBy("provider").agg(
        F.count_distinct("file").alias("n_files"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files")
    )


def written_files(spark, path: str) -> DataFrame:
    """Files of a partitioned output with the provider of each, read from the paths."""
    f = spark.read.text(path).select(F.col("provider"), F.input_file_name().alias("file"))
    return f.distinct()


def flag_table(flags: DataFrame) -> DataFrame:
    """Flag list as text columns with N/A for missing values."""

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    return flags.select(
        F.coalesce("det_type", F.lit("unknown")).alias("Detection_Type"), text("lat").alias("Coordinates_Lat"), text("lon").alias("Coordinates_Lon"),
        text("confidence").alias("Confidence"), text("area_m2").alias("Area_m2"), F.coalesce("flag_reason", F.lit("N/A")).alias("Flag_Reason"),
        F.coalesce("severity", F.lit("unknown")).alias("Severity"),
    )


def write_flag_csv(flags: DataFrame, path: str) -> None:
    flag_table(flags).write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, run_id: str) -> None:
    """Stage output partitioned by run and provider; a stage can be reloaded on its own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "provider").parquet(path)


def read_stage(spark, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def unprocessed(scenes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scenes without a complete ledger entry: a summary, and outputs whenever features were expected."""
    done = ledger.where(F.col("has_summary") & ((F.col("expected_features") == 0) | F.col("has_outputs")))
    return scenes.join(done.select("scene_id"), "scene_id", "left_anti")


def located_features(features: DataFrame, origin_x: Column, origin_y: Column, zone: Column) -> DataFrame:
    """Features at pixel positions as geographic points."""
    g = geo.pixel_to_projected(F.col("pix_row"), F.col("pix_col"), origin_x, origin_y)
    f = features.withColumn("_g", g)
    f = f.withColumn("_p", geo.from_utm(F.col("_g.easting"), F.col("_g.northing"), zone))
    return f.withColumn("lon", F.col("_p.lon")).withColumn("lat", F.col("_p.lat")).drop("_g", "_p")
