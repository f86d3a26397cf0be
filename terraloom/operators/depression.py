"""Vegetation depression below a local baseline, and significance of index layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import stats as ST
from terraloom.operators.stencil import morphology

LOW, PEAK, HIGH = 0.03, 0.07, 0.15  # fixed values


def with_depression(pixels: DataFrame, ndvi: str = "ndvi", baseline: str = "close", out: str = "depression", untested: int = 0) -> DataFrame:
    """Depression strength 0..1 per pixel.

    The drop below a 5x5 morphological baseline is tested per scene against the validated drop of
    0.07. Scenes that pass get a ramp rising from 0.03 to 0.07 and falling to 0.15, all others get zero. A caller
    who does not trust the test on small scenes names with ``untested`` the number of pixels up to which scenes are thresholded instead.
    """
    base = morphology(pixels, ndvi, [(baseline, 5)], "_base").withColumn("_drop", F.col("_base") - F.col(ndvi))
    s = base.groupBy("scene_id").agg(
        F.count("_drop").alias("_n"), F.avg("_drop").alias("_mean"), F.stddev_samp("_drop").alias("_sd"), F.stddev_pop("_drop").alias("_sp")
    )
    t = (F.col("_mean") - PEAK) / (F.col("_sd") / F.sqrt("_n"))
    effect = (F.col("_mean") - PEAK) / (F.col("_sp") + 1e-8)
    p = F.when(F.col("_sd") > 0, ST.t_two_sided_p(t, (F.col("_n") - 1).cast("double"))).otherwise(0.0)
    verdict = s.select("scene_id", "_n", ((p < 0.05) & (F.abs(effect) >= 0.3)).alias("_ok"))
    drop = F.col("_drop")
    ramp = (
        F.when((drop < LOW) | (drop > HIGH), 0.0)
        .when(drop <= PEAK, (drop - LOW) / (PEAK - LOW))
        .otherwise(F.greatest(F.lit(0.0), 1 - (drop - PEAK) / (HIGH - PEAK)))
    )
    few = F.when((drop >= PEAK) & (drop <= HIGH), F.least(F.lit(1.0), drop / PEAK)).otherwise(0.0)
    strength = F.when(F.col("_n") <= untested, few).when(F.col("_ok"), ramp).otherwise(0.0)
    return base.join(verdict, "scene_id").withColumn(out, strength).drop("_base", "_drop", "_n", "_ok")


def index_significance(pixels: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Test of the layer mean against zero with |mean|/sigma as effect size, per group."""
    s = pixels.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sp")
    )
    p = ST.t_two_sided_p(F.col("mean") / (F.nullif("sd", F.lit(0.0)) / F.sqrt("n")), (F.col("n") - 1).cast("double"))
    p = F.when(F.col("sd") == 0, F.when(F.col("mean") == 0, 1.0).otherwise(0.0)).otherwise(p)  # a constant layer
    effect = F.abs("mean") / (F.col("sp") + 1e-8)
    s = s.withColumn("p_value", F.when(F.col("n") < 50, 1.0).otherwise(p))
    s = s.withColumn("effect_size", F.when(F.col("n") < 50, 0.0).otherwise(effect))
    level = (
        F.when(F.col("n") < 50, "insufficient_data")
        .when((F.col("p_value") < 0.01) & (F.col("effect_size") >= 0.5), "HIGH")
        .when((F.col("p_value") < 0.05) & (F.col("effect_size") >= 0.3), "MEDIUM")
        .otherwise("LOW")
    )
    return s.select(*keys, "n", "p_value", "effect_size", level.alias("significance"))
