"""Joins against the fixed table of known sites and control areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.constants import REFERENCE_AREAS
from terraloom.functions import geo
from terraloom.operators.spatial import near_pairs

SCHEMA = "name string, area_lat double, area_lon double, radius_km double, area_type string, area_confidence double, is_control boolean"


def areas(spark: SparkSession) -> DataFrame:
    """The ten fixed reference areas. The table is a constant, so broadcasting it is always safe."""
    return spark.createDataFrame(REFERENCE_AREAS, SCHEMA)


def _distance():
    return geo.haversine_km(F.col("lon"), F.col("lat"), F.col("area_lon"), F.col("area_lat"))


def _pairs(points: DataFrame, ref: DataFrame) -> DataFrame:
    """(a, b): points and areas that contain them, by grid cells, so that neither side has to be small."""
    spots = ref.withColumn("lon", F.col("area_lon")).withColumn("lat", F.col("area_lat"))
    spread = points.withColumn("_spot", F.struct("lon", "lat"))
    reach = F.col("radius_km") * 1000.0 * (1 + 1e-9)
    return near_pairs(spread, spots, reach, "_spot", cell=0.1)


def within(points: DataFrame, ref: DataFrame) -> DataFrame:
    """Every (point, area) with the point inside the circle, plus the distance in km."""
    own, area = [F.col(f"a.{c}").alias(c) for c in points.columns], [F.col(f"b.{c}").alias(c) for c in ref.columns]
    joined = _pairs(points, ref).select(*own, *area)
    return joined.withColumn("distance_km", _distance()).where(F.col("distance_km") <= F.col("radius_km"))


def outside(points: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Points that lie in none of the circles."""
    inside = within(points.select(key, "lon", "lat"), ref).select(key).distinct()
    return points.join(inside, key, "left_anti")
