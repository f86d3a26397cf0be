"""Coordinate validation, repair and zone membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import FALLBACK_LAT, FALLBACK_LON
from terraloom.functions import geo
from terraloom.operators.spatial import box_cover, cover_index
from terraloom.runtime import salted_join

ZONE_BOX = ["zone_id", "west", "south", "east", "north"]


def with_validity(points: DataFrame, zones: DataFrame | None = None, out: str = "valid") -> DataFrame:
    """Flag usable coordinates: zone bounds when the zone is known, basin bounds otherwise."""
    lon, lat = F.col("lon"), F.col("lat")
    if zones is None:
        return points.withColumn(out, geo.valid_coordinates(lon, lat))
    z = zones.select("zone_id", *[F.col(c).alias(f"_{c}") for c in ZONE_BOX[1:]])
    inside = F.when(F.col("_west").isNull(), geo.in_amazon(lon, lat)).otherwise(
        geo.in_box(lon, lat, F.col("_west"), F.col("_south"), F.col("_east"), F.col("_north"))
    )
    return (
        points.join(z, "zone_id", "left")
        .withColumn(out, F.coalesce(geo.is_geographic(lon, lat) & inside, F.lit(False)))
        .drop(*[f"_{c}" for c in ZONE_BOX[1:]])
    )


def zone_centres(zones: DataFrame) -> DataFrame:
    return zones.select(
        "zone_id",
        ((F.col("west") + F.col("east")) / 2).alias("centre_lon"),
        ((F.col("south") + F.col("north")) / 2).alias("centre_lat"),
    )


def with_fallback(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Replace unusable coordinates with the zone centre, or the default centre for unknown zones."""
    ok = geo.valid_coordinates(F.col("lon"), F.col("lat"))
    joined = points.join(zone_centres(zones), "zone_id", "left").withColumn("coordinate_fixed", ~ok)
    return (
        joined.withColumn("_ok", ok)
        .withColumn("lon", F.when(F.col("_ok"), F.col("lon")).otherwise(F.coalesce("centre_lon", F.lit(FALLBACK_LON))))
        .withColumn("lat", F.when(F.col("_ok"), F.col("lat")).otherwise(F.coalesce("centre_lat", F.lit(FALLBACK_LAT))))
        .drop("_ok", "centre_lon", "centre_lat")
    )


def coordinate_system(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch: projected if any value exceeds 1000, geographic if all are in degree range."""
    far_x, far_y = F.max(F.abs("lon")), F.max(F.abs("lat"))
    system = (
        F.when(F.greatest(far_x, far_y) > 1000, "utm")
        .when((far_x <= 180) & (far_y <= 90), "geographic")
        .otherwise("unknown")
    )
    return points.groupBy(*keys).agg(system.alias("coordinate_system"))


def first_location(names: list[str]) -> tuple[Column, Column]:
    """First non-null of several location structs, as (lon, lat)."""
    loc = F.coalesce(*names)
    return loc["lon"], loc["lat"]


def standardised(points: DataFrame, zones: DataFrame, names: list[str]) -> DataFrame:
    """One location per row from the candidate columns; rows without any are dropped, bad ones repaired."""
    lon, lat = first_location(names)
    located = points.where(F.coalesce(*names).isNotNull()).withColumn("lon", lon).withColumn("lat", lat).drop(*names)
    return with_fallback(located, zones)


def in_zones(points: DataFrame, zones: DataFrame, cell_deg: float = 0.1) -> DataFrame:
    """Points joined to every zone whose box contains them.

    Each box covers four cells at most, at the level of its own size; a point looks into its one cell at each level that a zone uses. This is an equi-join whatever the number and size of zones, neither
    side has to fit in memory, and cells that hold many points are cut into slices.
    """
    renamed = zones.select(*[F.col(c).alias(f"z_{c}") for c in zones.columns])
    box = [F.col(f"z_{c}") for c in ZONE_BOX[1:]]
    cells = box_cover(renamed.where((box[0] <= box[2]) & (box[1] <= box[3])), *box, cell_deg).drop("_own")
    used = cells.agg(F.sort_array(F.collect_set("_lv"))).scalar()  # sixteen levels at most
    keyed = points.withColumn("_lv", F.explode(used))
    keyed = keyed.withColumn("_cx", cover_index(F.col("lon"), F.col("_lv"), cell_deg)).withColumn("_cy", cover_index(F.col("lat"), F.col("_lv"), cell_deg))
    keyed = keyed.withColumn("_spot", F.struct("lon", "lat"))
    inside = geo.in_box(F.col("lon"), F.col("lat"), *box)
    return salted_join(keyed, cells, ["_lv", "_cx", "_cy"], "_spot").where(inside).drop("_lv", "_cx", "_cy", "_spot")


EXPANSION_STEPS = [0.025, 0.05, 0.075, 0.1, 0.15, 0.2]  # fixed values, degrees


def adaptive_zones(points: DataFrame, zones: DataFrame, min_points: int = 50) -> DataFrame:
    """Smallest expansion of each zone box that holds ``min_points``; the original box if none does.

    Each point is joined once, to the widest box, and tagged with the first box that contains it.
    Counts per tag are then accumulated over at most seven tags per zone.
    """
    size = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    base = zones.withColumn("_half", size / 2).withColumn("_clat", (F.col("north") + F.col("south")) / 2).withColumn(
        "_clon", (F.col("east") + F.col("west")) / 2
    )
    widest = EXPANSION_STEPS[-1]
    wide = base.select(
        "zone_id", "_half", "_clat", "_clon", *[F.col(c).alias(f"own_{c}") for c in ZONE_BOX[1:]],
        F.least("west", F.col("_clon") - (F.col("_half") + widest)).alias("west"),
        F.least("south", F.col("_clat") - (F.col("_half") + widest)).alias("south"),
        F.greatest("east", F.col("_clon") + (F.col("_half") + widest)).alias("east"),
        F.greatest("north", F.col("_clat") + (F.col("_half") + widest)).alias("north"),
    )
    hits = in_zones(points.select("lon", "lat"), wide)  # the zone's own measures come along, so hits are joined once
    lon, lat = F.col("lon"), F.col("lat")
    around = lambda e: geo.in_box(
        lon, lat, F.col("z__clon") - (F.col("z__half") + e), F.col("z__clat") - (F.col("z__half") + e),
        F.col("z__clon") + (F.col("z__half") + e), F.col("z__clat") + (F.col("z__half") + e),
    )
    inside = geo.in_box(lon, lat, *[F.col(f"z_own_{c}") for c in ZONE_BOX[1:]])
    per_step = [F.count_if(around(e)).alias(f"_n{i}") for i, e in enumerate(EXPANSION_STEPS)]
    counts = hits.groupBy(F.col("z_zone_id").alias("zone_id")).agg(F.count_if(inside).alias("_n"), *per_step)
    filled = base.join(counts, "zone_id", "left").fillna(0, subset=["_n"] + [f"_n{i}" for i in range(len(per_step))])
    step, n = F.lit(None).cast("double"), F.col("_n")
    for i, e in reversed(list(enumerate(EXPANSION_STEPS))):
        step = F.when(F.col(f"_n{i}") >= min_points, F.lit(e)).otherwise(step)
        n = F.when(F.col(f"_n{i}") >= min_points, F.col(f"_n{i}")).otherwise(n)
    enough = F.col("_n") >= min_points
    return filled.select(
        "zone_id",
        F.col("_n").alias("original_count"),
        F.when(enough, F.lit(None).cast("double")).otherwise(step).alias("expansion_deg"),
        F.when(enough, F.col("_n")).otherwise(n).alias("shot_count"),
    ).withColumn("expanded", F.col("expansion_deg").isNotNull())
