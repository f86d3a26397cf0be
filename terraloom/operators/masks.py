"""Pixel predicates: terra-preta, crop-mark and moisture masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import DEFAULT_ZONE_TYPE, PRESETS, ZONE_TYPE_CONFIG
from terraloom.functions.indices import index


def dry_signature() -> Column:
    return index("moisture") < 0.2


def enhanced_mask(preset: str = "archaeological") -> Column:
    """Mask used where no vegetation-depression signal exists."""
    p = PRESETS[preset]
    ndvi = index("ndvi")
    return (
        (index("terra_preta_enhanced") > p["tp_enhanced"])
        & (ndvi > p["ndvi_min"])
        & (ndvi < 0.7)
        & (index("ndre1") > p["ndre1_min"])
        & dry_signature()
    )


def enhanced_mask_with_depression(depression: Column, preset: str = "archaeological") -> Column:
    p = PRESETS[preset]
    ndvi = index("ndvi")
    return (
        (index("terra_preta_enhanced") > p["tp_base"])
        & (ndvi > p["ndvi_min"])
        & (ndvi < 0.7)
        & (index("ndre1") > p["ndre1_min"])
        & (depression > p["depression_min"])
        & dry_signature()
    )


def with_enhanced_mask(pixels: DataFrame, preset: str = "archaeological", out: str = "mask") -> DataFrame:
    """Pick the mask branch per scene: depression-aware iff any pixel's depression passes the threshold.

    ``pixels`` has ``scene_id`` and ``depression``. The per-scene flag is a small aggregate joined
    back, not a window, so one large scene is not gathered in one task.
    """
    limit = PRESETS[preset]["depression_min"]
    flag = pixels.groupBy("scene_id").agg((F.max("depression") > limit).alias("_branch"))
    return (
        pixels.join(flag, "scene_id")
        .withColumn(
            out,
            F.when(F.col("_branch"), enhanced_mask_with_depression(F.col("depression"), preset)).otherwise(
                enhanced_mask(preset)
            ),
        )
        .drop("_branch")
    )


def standard_mask() -> Column:
    ndvi = index("ndvi")
    return (index("terra_preta") > 0.12) & (ndvi > 0.4) & (ndvi < 0.7)


def fast_mask_with_red_edge() -> Column:
    ndvi = index("ndvi")
    return (index("terra_preta_enhanced") > 0.12) & (ndvi > 0.3) & (ndvi < 0.8) & (index("ndre1") > 0.1)


def fast_mask_standard() -> Column:
    ndvi = index("ndvi")
    return (index("terra_preta") > 0.1) & (ndvi > 0.3) & (ndvi < 0.8)


def zone_type_threshold(zone_type: Column, position: int) -> Column:
    """Look up a zone-type setting; unknown types use the default type."""
    expr = F.lit(ZONE_TYPE_CONFIG[DEFAULT_ZONE_TYPE][position])
    for name, row in ZONE_TYPE_CONFIG.items():
        expr = F.when(zone_type == name, F.lit(row[position])).otherwise(expr)
    return expr


def crop_positive(threshold: Column) -> Column:
    return (index("crop_mark") > threshold) & (index("ndvi") > 0.5)


def crop_negative(threshold: Column) -> Column:
    return (index("crop_mark") < -threshold) & (index("ndvi") > 0.4)


def mask_coverage(pixels: DataFrame, mask: str, keys: list[str], means: list[str] = ()) -> DataFrame:
    """Mask pixels and percentage per group, with the mean of any further columns, in one aggregate."""
    hit = F.col(mask).cast("int")
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.sum(hit.cast("long")).alias("mask_pixels"),
        (F.avg(hit) * 100).alias("coverage_pct"),
        *[F.avg(m).alias(f"mean_{m}") for m in means],
    )
