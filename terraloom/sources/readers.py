"""JSON sources: LiDAR granules as parallel arrays, detections and vectors as GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geo

ARRAYS = ["longitude", "latitude", "elevation_ground", "elevation_canopy_top", "canopy_height", "rh95", "rh100", "shot_number", "beam"]
GRANULE_SCHEMA = (
    "longitude array<double>, latitude array<double>, elevation_ground array<double>, elevation_canopy_top array<double>, "
    "canopy_height array<double>, rh95 array<double>, rh100 array<double>, shot_number array<bigint>, beam array<string>"
)
# Coordinates nest to a different depth per geometry type, so they are read as text and parsed by type.
FEATURE_SCHEMA = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
COLLECTION_SCHEMA = f"type string, features array<{FEATURE_SCHEMA}>"


def clean(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(c), c)


def explode_granules(granules: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per shot from rows of parallel arrays, in array order (``position``)."""
    have = [c for c in ARRAYS if c in granules.columns]
    kinds = dict(granules.dtypes)
    # an array a granule lacks counts as one NULL per shot; zipping with a NULL array would drop the granule
    blank = {c: F.array_repeat(F.lit(None).cast(kinds[c][6:-1]), F.size("longitude")) for c in have}
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), blank[c]).alias(c) for c in have])
    rows = granules.select(*keep, F.posexplode(zipped).alias("position", "s")).select(*keep, "position", "s.*")
    for c in ARRAYS:
        if c not in have:
            rows = rows.withColumn(c, F.lit(None).cast("string" if c == "beam" else "bigint" if c == "shot_number" else "double"))
    numeric = [c for c in ARRAYS if c not in ("shot_number", "beam")]
    return rows.select(*keep, "position", "shot_number", "beam", *[clean(F.col(c)).alias(c) for c in numeric])


def with_canopy_heights(shots: DataFrame) -> DataFrame:
    """rh95 and rh100: canopy height when given, else the percentiles, else top minus ground, not below zero."""
    proxy = F.greatest(F.lit(0.0), F.col("elevation_canopy_top") - F.col("elevation_ground"))
    proxy = F.when((F.col("elevation_canopy_top") - F.col("elevation_ground")).isNotNull(), proxy)
    both = F.col("rh95").isNotNull() & F.col("rh100").isNotNull()

    def pick(c):
        return F.coalesce("canopy_height", F.when(both, F.col(c)), proxy).alias(c)

    rest = [c for c in shots.columns if c not in ("rh95", "rh100")]
    return shots.select(*rest, pick("rh95"), pick("rh100"))


def power_beam(beam: Column) -> Column:
    """1 for power beams, 0 for coverage beams."""
    return beam.isin("BEAM0000", "BEAM0001", "BEAM0010", "BEAM0011", "0000", "0001", "0010", "0011").cast("int")


def read_granules(spark: SparkSession, path: str) -> DataFrame:
    """All granule files under a path, one object per file, as shots with their source file."""
    raw = spark.read.schema(GRANULE_SCHEMA).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())
    return with_canopy_heights(explode_granules(raw, ["source_file"]))


_RING = "array<array<double>>"


def _ring(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: geo.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def parse_polygons(kind: Column, coordinates: Column) -> Column:
    """Array of polygons, each an array of rings of points, of a Polygon or MultiPolygon; NULL for other types."""
    one = F.transform(F.from_json(coordinates, f"array<{_RING}>"), _ring)
    many = F.transform(F.from_json(coordinates, f"array<array<{_RING}>>"), lambda p: F.transform(p, _ring))
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def parse_geometry(kind: Column, coordinates: Column) -> Column:
    """Vertices of any geometry type; of a polygon those of its first ring, of several polygons those of their first rings."""
    single = F.from_json(coordinates, "array<double>")
    outer = F.transform(parse_polygons(kind, coordinates), lambda p: F.coalesce(F.get(p, F.lit(0)), F.array().cast("array<struct<lon: double, lat: double>>")))
    return (
        F.when(kind == "Point", F.array(geo.point(F.get(single, F.lit(0)), F.get(single, F.lit(1)))))
        .when(kind.isin("LineString", "MultiPoint"), _ring(F.from_json(coordinates, _RING)))
        .when(kind == "MultiLineString", F.flatten(F.transform(F.from_json(coordinates, f"array<{_RING}>"), _ring)))
        .when(kind.isin("Polygon", "MultiPolygon"), F.flatten(outer))
    )


def with_measures(features: DataFrame) -> DataFrame:
    """Adds points (vertices) and spot, struct(lon, lat, area_m2): polygons by area without their holes, other types by the mean of their vertices and without area."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    # an exploded column is computed once, whatever is selected from it or filtered by it later
    parsed = F.explode(F.array(F.struct(parse_geometry(kind, text).alias("points"), parse_polygons(kind, text).alias("polygons"))))
    f = features.withColumn("_parsed", parsed).select(*features.columns, "_parsed.points", "_parsed.polygons")
    middle = geo.vertex_mean(F.col("points"))
    plain = F.when(F.size("points") >= 1, F.struct(middle["lon"].alias("lon"), middle["lat"].alias("lat"), F.lit(0.0).alias("area_m2")))
    spot = F.when(F.col("polygons").isNotNull(), geo.polygons_measure(F.col("polygons"))).otherwise(plain)
    return f.withColumn("spot", F.explode(F.array(spot))).drop("polygons")


def feature_rows(features: DataFrame) -> DataFrame:
    """Detections from (type, geometry, properties) rows.

    Location: the coordinates property, else the point, else a stored centre for polygons, else the
    vertex mean, and for several polygons the centroid of their area. Only locations inside the basin are kept. Missing area is 0, missing confidence 0.6.
    """
    p = F.col("properties")
    stored = F.split(F.regexp_replace(p["geo_center_calculated"], "[()]", ""), ", ")
    given = F.from_json(p["coordinates"], "array<double>")
    f = with_measures(features).withColumn(
        "at",
        F.when(given.isNotNull(), geo.point(F.get(given, F.lit(0)), F.get(given, F.lit(1))))
        .when(
            (F.col("geometry.type") == "Polygon") & p["geo_center_calculated"].isNotNull(),
            geo.point(F.get(stored, F.lit(0)).try_cast("double"), F.get(stored, F.lit(1)).try_cast("double")),
        )
        .when(F.col("geometry.type") == "MultiPolygon", geo.point(F.col("spot.lon"), F.col("spot.lat")))
        .when(F.size("points") >= 1, geo.vertex_mean(F.col("points"))),
    )
    out = f.select(
        p["id"].alias("id"), F.coalesce(p["type"], F.lit("unknown")).alias("det_type"),
        F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"),
        F.coalesce(p["confidence"].try_cast("double"), F.lit(0.6)).alias("confidence"),
        F.coalesce(p["area_m2"].try_cast("double"), F.lit(0.0)).alias("area_m2"), p.alias("props"),
    )
    return out.where(geo.in_amazon(F.col("lon"), F.col("lat")))


def provider_rows(features: DataFrame, provider: str, order: str) -> DataFrame:
    """Detections of one provider: default id from the position, area from the polygons, confidence 0."""
    p = F.col("properties")
    return with_measures(features).select(
        F.coalesce(p["id"], F.concat(F.lit(provider + "_"), F.col(order).cast("string"))).alias("id"),
        F.lit(provider).alias("provider"), F.coalesce(p["type"], F.lit("unknown")).alias("det_type"),
        F.col("spot.lon").alias("lon"), F.col("spot.lat").alias("lat"),
        F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce("spot.area_m2", F.lit(0.0)).alias("area_m2"),
    )


def vector_summary(features: DataFrame, key: str) -> DataFrame:
    """Geometry type, centroid and area per feature; points and lines have no area."""
    f = with_measures(features.select(key, "geometry"))
    return f.select(
        key, F.col("geometry.type").alias("geometry_type"), F.col("spot.lon").alias("lon"), F.col("spot.lat").alias("lat"),
        F.coalesce("spot.area_m2", F.lit(0.0)).alias("area_m2"),
    )


def explode_collections(collections: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Feature rows from rows holding a ``features`` array."""
    return collections.select(*keep, F.posexplode("features").alias("position", "f")).select(
        *keep, "position", F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties")
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All GeoJSON files under a path as detections."""
    raw = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())
    return feature_rows(explode_collections(raw, ["source_file"]))
