"""Per-scene value transforms: normalisation, stretches, clouds, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.quantiles import band_quantiles, quantiles

# Scene statistics are one row per scene. They are joined back with plain equi-joins: adaptive
# execution broadcasts them while they are small and splits a dominant scene when they are not.

COMPOSITES = {  # fixed values
    "true_color": ["red", "green", "blue"],
    "false_color": ["nir", "red", "green"],
    "archaeology": ["swir1", "nir", "red"],
    "urban": ["swir2", "swir1", "red"],
}


def clip(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))  # least and greatest alone would turn a missing pixel into a limit


def normalised(pixels: DataFrame, bands: list[str], method: str = "minmax") -> DataFrame:
    """Bands rescaled per scene by minmax, zscore or percentile; constant bands fall back."""
    if method == "percentile":
        stats = band_quantiles(pixels, bands, {"lo": 0.02, "hi": 0.98})
    else:
        pair = (F.min, F.max) if method == "minmax" else (F.avg, F.stddev_pop)
        stats = pixels.groupBy("scene_id").agg(
            *[f(b).alias(f"{b}_{n}") for b in bands for f, n in zip(pair, ("lo", "hi"))]
        )
    joined = pixels.join(stats, "scene_id")
    exprs = []
    for b in bands:
        v, lo, hi = F.col(b), F.col(f"{b}_lo"), F.col(f"{b}_hi")
        if method == "zscore":
            e = F.when(hi > 0, (v - lo) / hi).otherwise(v - lo)
        else:
            e = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(v)
            if method == "percentile":
                e = F.when(hi > lo, clip((v - lo) / (hi - lo), 0.0, 1.0)).otherwise(v)
        exprs.append(e.alias(b))
    rest = [c for c in pixels.columns if c not in bands]
    return joined.select(*rest, *exprs)


def outlier_clipped(pixels: DataFrame, bands: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    joined = pixels.join(band_quantiles(pixels, bands, {"lo": lo, "hi": hi}), "scene_id")
    rest = [c for c in pixels.columns if c not in bands]
    return joined.select(*rest, *[clip(F.col(b), F.col(f"{b}_lo"), F.col(f"{b}_hi")).alias(b) for b in bands])


def composite(pixels: DataFrame, kind: str = "true_color") -> DataFrame:
    """8-bit composite with a 2-98 percentile stretch per scene and band: columns r, g, b."""
    bands = COMPOSITES[kind]
    joined = pixels.join(band_quantiles(pixels, bands, {"lo": 0.02, "hi": 0.98}), "scene_id")

    def channel(b):
        lo, hi = F.col(f"{b}_lo"), F.col(f"{b}_hi")
        return F.coalesce(F.when(hi > lo, F.floor(clip((F.col(b) - lo) / (hi - lo) * 255, 0.0, 255.0))), F.lit(0)).cast("int")

    return joined.select("scene_id", "pix_row", "pix_col", *[channel(b).alias(n) for b, n in zip(bands, "rgb")])


def preview(pixels: DataFrame, bands=("red", "green", "blue"), gamma: float = 0.9) -> DataFrame:
    """8-bit preview: crop to the data box plus 5 %, 1-99 percentile stretch, gamma."""
    has_data = F.greatest(*bands) > 0
    extent = pixels.groupBy("scene_id").agg(
        F.min(F.when(has_data, F.col("pix_row"))).alias("_t"), (F.max(F.when(has_data, F.col("pix_row"))) + 1).alias("_b"),
        F.min(F.when(has_data, F.col("pix_col"))).alias("_l"), (F.max(F.when(has_data, F.col("pix_col"))) + 1).alias("_r"),
        *[F.max(F.when(has_data, F.col(b))).alias(f"_max_{b}") for b in bands],
    )
    q = band_quantiles(pixels.where(has_data), list(bands), {"lo": 0.01, "hi": 0.99})
    joined = pixels.join(extent.join(q, "scene_id"), "scene_id")
    pad_r = F.greatest(F.lit(1), F.floor((F.col("_b") - F.col("_t")) * 0.05))
    pad_c = F.greatest(F.lit(1), F.floor((F.col("_r") - F.col("_l")) * 0.05))
    inside = (
        (F.col("pix_row") >= F.col("_t") - pad_r) & (F.col("pix_row") < F.col("_b") + pad_r)
        & (F.col("pix_col") >= F.col("_l") - pad_c) & (F.col("pix_col") < F.col("_r") + pad_c)
    )

    def channel(b):
        top = F.col(f"_max_{b}")
        scale = F.when(top <= 1.0, F.lit(10000.0)).when(top <= 10000, F.lit(1.0)).otherwise(10000.0 / top)
        lo, hi = F.col(f"{b}_lo") * scale, F.col(f"{b}_hi") * scale
        unit = clip((F.col(b) * scale - lo) / F.when(hi > lo, hi - lo).otherwise(10000.0), 0.0, 1.0)
        return F.when(has_data, F.coalesce(F.floor(F.pow(unit, F.lit(gamma)) * 255), F.lit(0))).otherwise(0).cast("int")

    return joined.where(inside).select("scene_id", "pix_row", "pix_col", *[channel(b).alias(f"{b}_8bit") for b in bands])


def gamma_corrected(level: Column, gamma: float = 1.2) -> Column:
    """8-bit gamma lookup."""
    return F.floor(F.pow(level / 255.0, F.lit(1 / gamma)) * 255).cast("int")


def equalised(pixels: DataFrame, level: str, out: str = "equalised") -> DataFrame:
    """Histogram equalisation of an 8-bit level per scene, from at most 256 counts per scene."""
    hist = pixels.groupBy("scene_id", level).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy("scene_id").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy("scene_id").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lut = hist.select(
        "scene_id", level, F.sum("_n").over(up).alias("_cum"), F.first("_n").over(allw).alias("_first"), F.sum("_n").over(allw).alias("_all")
    )
    scaled = F.when(
        F.col("_all") > F.col("_first"), F.round((F.col("_cum") - F.col("_first")) / (F.col("_all") - F.col("_first")) * 255)
    ).otherwise(F.col(level))
    return pixels.join(lut.select("scene_id", level, scaled.cast("int").alias(out)), ["scene_id", level])


def cloud_masked(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """NULL all bands where mean visible brightness exceeds the scene's 95th percentile."""
    bright = (F.col("blue") + F.col("green") + F.col("red")) / 3
    q = quantiles(pixels, ["scene_id"], bright, {"_p95": 0.95})
    joined = pixels.join(q, "scene_id").withColumn("cloud", bright > F.col("_p95"))
    rest = [c for c in pixels.columns if c not in bands]
    return joined.select(*rest, *[F.when(~F.col("cloud"), F.col(b)).alias(b) for b in bands], "cloud")


def anomalies(pixels: DataFrame, value: str, method: str = "statistical", out: str = "anomaly") -> DataFrame:
    """Flag outliers per scene: 2.5 sigma, the 5-95 percentile range, or 1.5 interquartile ranges."""
    v = F.col(value)
    if method == "statistical":
        s = pixels.groupBy("scene_id").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        lo, hi = F.col("_m") - 2.5 * F.col("_s"), F.col("_m") + 2.5 * F.col("_s")
    elif method == "percentile":
        s = quantiles(pixels, ["scene_id"], value, {"_m": 0.05, "_s": 0.95})
        lo, hi = F.col("_m"), F.col("_s")
    elif method == "iqr":
        s = quantiles(pixels, ["scene_id"], value, {"_m": 0.25, "_s": 0.75})
        iqr = F.col("_s") - F.col("_m")
        lo, hi = F.col("_m") - 1.5 * iqr, F.col("_s") + 1.5 * iqr
    else:
        raise ValueError(f"unknown anomaly method {method}")
    return pixels.join(s, "scene_id").withColumn(out, (v > hi) | (v < lo)).drop("_m", "_s")


def to_8bit(pixels: DataFrame, value: str, out: str = "level") -> DataFrame:
    """Min-max rescale per scene to 0..255."""
    s = pixels.groupBy("scene_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    e = F.when(span > 0, F.floor((F.col(value) - F.col("_lo")) / span * 255)).otherwise(0).cast("int")
    return pixels.join(s, "scene_id").withColumn(out, e).drop("_lo", "_hi")


def quartile_class(pixels: DataFrame, value: str, out: str = "likelihood") -> DataFrame:
    """1 above the scene's third quartile, 0.5 above the median, else 0."""
    q = quantiles(pixels, ["scene_id"], value, {"_q2": 0.5, "_q3": 0.75})
    v = F.col(value)
    e = F.when(v > F.col("_q3"), 1.0).when(v > F.col("_q2"), 0.5).otherwise(0.0)
    return pixels.join(q, "scene_id").withColumn(out, e).drop("_q2", "_q3")
