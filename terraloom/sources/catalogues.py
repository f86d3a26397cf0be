"""Scene and granule catalogue searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.constants import BAND_ORDER, ESSENTIAL_BANDS
from terraloom.functions.scores import scene_quality
from terraloom.operators.spatial import BOX, box_pairs

CLOUD_LIMITS = [10, 20, 30, 40, 50, 60, 70, 80]  # fixed values, tried in order


def scored_scenes(scenes: DataFrame, zones: DataFrame) -> DataFrame:
    """Overlap, centre distance and quality of every scene-zone pair that overlaps."""
    pairs = box_pairs(
        scenes.select("scene_id", "cloud_cover", "acq_month", *BOX), zones.select("zone_id", *BOX)
    )
    mid = lambda s, lo, hi: (F.col(f"{s}.{lo}") + F.col(f"{s}.{hi}")) / 2
    dx, dy = mid("a", "west", "east") - mid("b", "west", "east"), mid("a", "south", "north") - mid("b", "south", "north")
    base = pairs.select(
        F.col("a.scene_id").alias("scene_id"), F.col("b.zone_id").alias("zone_id"), F.col("a.cloud_cover").alias("cloud_cover"),
        F.col("a.acq_month").alias("acq_month"), (F.col("overlap") * 100).alias("overlap_pct"),
        (F.sqrt(dx * dx + dy * dy) * 111.32).alias("centre_km"),
    )
    quality = scene_quality(F.col("cloud_cover"), F.col("overlap_pct"), F.col("centre_km"), F.col("acq_month"))
    return base.withColumn("quality", quality)


def scene_tiers(scored: DataFrame, min_overlap: float = 50.0, max_km: float = 75.0) -> DataFrame:
    """Usable scenes of every zone with cloud_tier, the first limit a scene's cloud cover is below; every scene by itself, whatever others there are."""
    limit = F.lit(None).cast("int")
    for c in reversed(CLOUD_LIMITS):
        limit = F.when(F.col("cloud_cover") < c, F.lit(c)).otherwise(limit)
    ok = scored.where((F.col("overlap_pct") >= min_overlap) & (F.col("centre_km") <= max_km)).withColumn("cloud_tier", limit)
    return ok.where(F.col("cloud_tier").isNotNull())


def cascade_search(scored: DataFrame, max_results: int = 5, min_overlap: float = 50.0, max_km: float = 75.0) -> DataFrame:
    """Best scenes per zone at the strictest cloud limit that yields any: a top-k report over ``scene_tiers``.

    The retry loop over limits becomes one pass: a zone keeps the scenes of its own smallest tier.
    """
    ok = scene_tiers(scored, min_overlap, max_km)
    strict = ok.groupBy("zone_id").agg(F.min("cloud_tier").alias("threshold_used"))
    kept = ok.join(strict, "zone_id").where(F.col("cloud_tier") <= F.col("threshold_used")).drop("cloud_tier")
    order = Window.partitionBy("zone_id").orderBy(F.desc("quality"), "scene_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results)


def granule_relevance(granules: DataFrame, zones: DataFrame, as_of: Column) -> DataFrame:
    """Recency points plus 30 per fully covered zone box, for each granule-zone pair that overlaps."""
    age = F.datediff(as_of, F.col("a.acquired"))
    recency = F.when(age < 365, 20).when(age < 730, 15).when(age < 1095, 10).otherwise(0)
    pairs = box_pairs(granules.select("granule_id", "acquired", *BOX), zones.select("zone_id", *BOX))
    return pairs.groupBy(F.col("b.zone_id").alias("zone_id"), F.col("a.granule_id").alias("granule_id")).agg(
        (F.max(recency) + F.sum(F.col("overlap") * 30)).alias("relevance")
    )


def pick_download(links: Column) -> Column:
    """Data links ending in .h5, https first, from an array of struct(rel, href)."""
    data = F.filter(links, lambda l: l["rel"].contains("data#") & l["href"].endswith(".h5"))
    keyed = F.transform(data, lambda l: F.struct((~l["href"].startswith("https://")).alias("late"), l["href"].alias("href")))
    return F.transform(F.array_sort(keyed), lambda k: k["href"])


def has_required_bands(bands: Column) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(b) for b in ESSENTIAL_BANDS]), bands)) == 0


def has_composite_bands(bands: Column) -> Column:
    return F.size(F.array_intersect(F.array(*[F.lit(b) for b in ESSENTIAL_BANDS]), bands)) >= 3


def missing_bands(bands: Column) -> Column:
    return F.array_except(F.array(*[F.lit(b) for b in BAND_ORDER]), bands)


def default_zones(zones: DataFrame) -> DataFrame:
    """Zones used when none are named: priority one."""
    return zones.where("priority = 1")
