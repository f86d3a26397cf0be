"""Detection filters: spectral false positives, shape artifacts, unsuitable ground, ingest and size gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import EPS
from terraloom.operators.spatial import sample_pixels


def _no(flag: Column) -> Column:
    """True unless the flag is known to be true."""
    return ~F.coalesce(flag, F.lit(False))


def without_false_positives(features: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Drop infrastructure, bright-sand vegetation, tiny circles and very long lines.

    Spectra are 3x3 means around the feature's pixel; features outside the scene are kept.
    """
    s = sample_pixels(features, pixels, key, ["nir", "swir1", "swir2", "red"], half=1)
    ndvi = (F.col("mean_nir") - F.col("at_red")) / (F.col("mean_nir") + F.col("at_red") + EPS)
    infrastructure = (ndvi < 0.1) & (F.col("mean_swir1") > 0.4)
    white_sand = (ndvi > 0.3) & (ndvi < 0.6) & (F.col("mean_swir2") > 0.5)
    kind = F.col("det_type")
    noise = (kind == "circle") & (F.col("radius_m") < 25)
    road = (kind == "line") & (F.col("length_m") > 2000)
    joined = features.join(s, key, "left")
    return joined.where(_no(infrastructure) & _no(white_sand) & _no(noise) & _no(road)).select(*features.columns)


def near_axis(angle: Column, period: float, tolerance: float) -> Column:
    """Angle modulo the period (always non-negative) below the tolerance."""
    return F.abs(F.pmod(angle, F.lit(period))) < tolerance


def without_shape_artifacts(features: DataFrame) -> DataFrame:
    kind, angle = F.col("det_type"), F.col("angle_degrees")
    line = (F.col("length_m") > 5000) | (F.col("length_m") < 30) | near_axis(angle, 90.0, 1.0)
    rect = (F.abs(F.col("aspect_ratio") - 1) < 0.1) | near_axis(angle, 45.0, 2.0)
    circle = F.col("edge_strength") > 0.95
    artifact = F.when(kind == "line", line).when(kind == "rectangle", rect).when(kind == "circle", circle)
    return features.where(_no(artifact) & _no(F.col("confidence") > 0.98))


def without_unsuitable_ground(features: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Drop wetland, white-sand forest and pristine forest by the spectrum of the feature's own pixel."""
    s = sample_pixels(features, pixels, key, ["nir", "swir1", "swir2", "red"])
    ndvi = (F.col("at_nir") - F.col("at_red")) / (F.col("at_nir") + F.col("at_red") + EPS)
    wet = (ndvi > 0.6) & (F.col("at_swir1") < 0.2)
    sand = (ndvi > 0.3) & (ndvi < 0.6) & (F.col("at_swir2") > 0.4)
    pristine = (ndvi > 0.8) & (F.col("at_swir1") < 0.15)
    return features.join(s, key, "left").where(_no(wet | sand | pristine)).select(*features.columns)


def ingest_allowed(micro_zone: Column) -> Column:
    """Confidence and area limits by detection type."""
    c, a, t = F.coalesce("confidence", F.lit(0.0)), F.col("area_m2"), F.col("det_type")
    soil = F.when(micro_zone, (c >= 0.45) & (a <= 1e5)).otherwise((c >= 0.40) & (a <= 1e6))
    return (
        F.when(t == "terra_preta", soil)
        .when(t.isin("circle", "line", "rectangle"), (c >= 0.45) & (a <= 1e6))
        .when(t.startswith("crop"), (c >= 0.45) & (a <= 1e5))
        .otherwise(True)
    )


def geometric_size_ok(min_size: Column) -> Column:
    """Size, confidence and axis gate of the geometric detectors."""
    c, a, t = F.coalesce("confidence", F.lit(0.0)), F.col("area_m2"), F.col("det_type")
    turn = F.pmod(F.col("angle_degrees"), F.lit(90.0))
    off_axis = ~((turn < 2) | (turn > 88))
    return (
        F.when(t == "circle", (a <= 500000) & (c >= 0.5))
        .when(t == "line", (F.col("length_m") >= min_size) & (c >= 0.7) & off_axis)
        .when(t == "rectangle", (a >= min_size * min_size) & (a <= 500000) & (c >= 0.7) & off_axis)
        .otherwise(False)
    )
