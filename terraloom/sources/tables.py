"""Dimensions and pixel-table preparation: zones, presets, band naming, resampling, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.constants import BAND_NAMES, BAND_ORDER, DEFAULT_ZONE_TYPE, PRESETS, SURVEY_ZONES, ZONE_TYPE_CONFIG
from terraloom.operators.stencil import PIX

# Spellings of zone names and the id each one stands for (fixed values).
ZONE_ALIASES = {
    "upper_naporegion": "upper_napo",
    "uppernaporegion": "upper_napo",
    "upper_napo_region": "upper_napo",
    "negro_madeira_confluence": "negro_madeira",
    "trombetas_river": "trombetas",
    "trombetas_river_junction": "trombetas",
    "upper_xingu_region": "upper_xingu",
    "maranon_river": "maranon",
    "maranon_river_system": "maranon",
}


def survey_zones(spark: SparkSession) -> DataFrame:
    """The twelve survey zones (a constant table)."""
    cols = (
        "id string, name string, centre_lat double, centre_lon double, south double, west double, north double, "
        "east double, priority int, search_radius_km double, min_feature_m int, max_feature_m int, zone_type string"
    )
    return spark.createDataFrame(SURVEY_ZONES, cols)


#: What a zone that is not in the dimension gets (fixed values).
DEFAULT_ZONE = dict(
    centre_lat=0.0, centre_lon=0.0, south=-1.0, west=-73.0, north=0.0, east=-72.0, priority=3, search_radius_km=7.0, min_feature_m=50, max_feature_m=500, zone_type=DEFAULT_ZONE_TYPE
)


def with_zone(rows: DataFrame, zones: DataFrame, name: str = "zone") -> DataFrame:
    """Rows with the settings of the zone that ``name`` spells; unknown zones take the default zone's, and known tells them apart.

    The dimension has one row per zone, and only the columns of DEFAULT_ZONE and the id are used.
    """
    z = zones.select(F.col("id").alias("zone_key"), *DEFAULT_ZONE)
    j = rows.withColumn("zone_key", normalised_zone(F.col(name))).join(z.withColumn("known", F.lit(True)), "zone_key", "left")
    title = F.initcap(F.translate(F.col(name), "_", " "))
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULT_ZONE.items()} | {"known": F.coalesce("known", F.lit(False)), "zone_title": title})


def presets(spark: SparkSession) -> DataFrame:
    """Threshold presets, one row each (a constant table)."""
    names = list(PRESETS["original"])
    rows = [(k, *[float(p[n]) for n in names]) for k, p in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"{n} double" for n in names))


def zone_settings(zone_type: Column) -> Column:
    """struct of the zone-type settings; unknown types use the default type's."""
    fields = ("crop_mark_threshold", "terra_preta_threshold", "geometric_min_size", "density_factor")

    def row(values):
        return F.struct(*[F.lit(float(x)).alias(f) for f, x in zip(fields, values)])

    expr = row(ZONE_TYPE_CONFIG[DEFAULT_ZONE_TYPE])
    for name, values in ZONE_TYPE_CONFIG.items():
        expr = F.when(zone_type == name, row(values)).otherwise(expr)
    return expr


def normalised_zone(name: Column) -> Column:
    """Lower case, spaces and hyphens to underscores, then the alias table."""
    key = F.translate(F.lower(name), " -", "__")
    expr = key
    for alias, target in ZONE_ALIASES.items():
        expr = F.when(key == alias, F.lit(target)).otherwise(expr)
    return expr


def named_bands(long: DataFrame, codes: Column = None) -> DataFrame:
    """Wide pixel table from (scene_id, pix_row, pix_col, band, value) rows with band codes."""
    code = codes if codes is not None else F.col("band")
    name = F.lit(None).cast("string")
    for c, n in BAND_NAMES.items():
        name = F.when(code == c, F.lit(n)).otherwise(name)
    named = long.withColumn("_name", name).where(F.col("_name").isNotNull())
    return named.groupBy(*PIX).pivot("_name", list(BAND_NAMES.values())).agg(F.first("value", ignorenulls=True))


def positional_code(description: Column, position: Column, n_known: Column) -> Column:
    """Band code of a stack layer: its description when four or more are known codes, else its position."""
    by_place = F.element_at(F.array(*[F.lit(b) for b in BAND_ORDER]), position)
    return F.when(n_known >= 4, description).when(position <= len(BAND_ORDER), by_place)


def resample_nearest(coarse: DataFrame, grid: DataFrame, value: str, factor: int = 2) -> DataFrame:
    """Values of a coarse grid on a finer one: each fine pixel takes the coarse pixel it lies in."""
    r, c = F.floor(F.col("pix_row") / factor).cast("int"), F.floor(F.col("pix_col") / factor).cast("int")
    keyed = grid.withColumn("_r", r).withColumn("_c", c)
    src = coarse.select("scene_id", F.col("pix_row").alias("_r"), F.col("pix_col").alias("_c"), value)
    return keyed.join(src, ["scene_id", "_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(coarse: DataFrame, grid: DataFrame, value: str, factor: int = 2) -> DataFrame:
    """Bilinear values of a coarse grid on a finer one.

    Each coarse pixel is sent to the fine pixels it has weight on, clamped at the edge by
    renormalising, so the fine grid is joined once and aggregated.
    """
    centre = lambda c: (F.col(c) + 0.5) / factor - 0.5
    near = grid.select(*PIX, centre("pix_row").alias("_y"), centre("pix_col").alias("_x"))
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = near.withColumn("_k", corners)
    y0, x0 = F.floor("_y"), F.floor("_x")
    fy, fx = F.col("_y") - y0, F.col("_x") - x0
    w = F.when(F.col("_k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.b") == 1, fx).otherwise(1 - fx)
    spread = spread.withColumn("_w", w).withColumn("_r", (y0 + F.col("_k.a")).cast("int")).withColumn("_c", (x0 + F.col("_k.b")).cast("int"))
    src = coarse.select("scene_id", F.col("pix_row").alias("_r"), F.col("pix_col").alias("_c"), value)
    j = spread.where("_w > 0").join(src, ["scene_id", "_r", "_c"])
    return j.groupBy(*PIX).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def with_zone_clip(pixels: DataFrame, zones: DataFrame, buffer_deg: float = 0.01) -> DataFrame:
    """Pixels (with lon, lat, zone_id) inside their zone's box widened by the buffer, with in_zone: whether they lie inside the box itself, and how many rows and columns of the scene do.

    scene_rows and scene_cols let a caller choose the widened box for scenes of which too little would remain; no pixel depends on it here.
    """
    box = zones.select("zone_id", "west", "south", "east", "north")
    j = pixels.join(box, "zone_id")
    b = buffer_deg
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    wide = F.col("lon").between(F.col("west") - b, F.col("east") + b) & F.col("lat").between(F.col("south") - b, F.col("north") + b)
    j = j.where(wide).select(*pixels.columns, inside.alias("in_zone"))
    side = lambda c: F.coalesce(F.max(F.when(F.col("in_zone"), F.col(c))) - F.min(F.when(F.col("in_zone"), F.col(c))) + 1, F.lit(0))
    return j.join(j.groupBy("scene_id").agg(side("pix_row").alias("scene_rows"), side("pix_col").alias("scene_cols")), "scene_id")


def clip_to_zone(pixels: DataFrame, zones: DataFrame, min_side: int = 10, buffer_deg: float = 0.01) -> DataFrame:
    """The selection from ``with_zone_clip`` that keeps the box, and the widened one of scenes that would keep less than min_side rows or columns."""
    clipped = with_zone_clip(pixels, zones, buffer_deg)
    small = (F.col("scene_rows") < min_side) | (F.col("scene_cols") < min_side)
    return clipped.where(F.col("in_zone") | small).select(*pixels.columns)
