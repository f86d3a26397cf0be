"""Operators on LiDAR shots: local maxima along the track, gaps, elevation anomalies, line fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.constants import PRESETS
from terraloom.functions import geo
from terraloom.functions import stats as ST
from terraloom.runtime import null_safe_join

TRACK = ["zone_id", "beam"]


def with_neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str], bucket: int = 1 << 20) -> DataFrame:
    """Add prev_<c> and next_<c> in ``order`` within ``keys``.

    A track may hold most of the data, so it is cut into buckets of the order column (a unique integer),
    each of bounded size. Lag and lead run per bucket; the values across a bucket border come from a
    table with one row per bucket.
    """
    part = [*keys, "_bk"]
    cut = df.withColumn("_bk", F.floor(F.col(order) / bucket))
    w = Window.partitionBy(*part).orderBy(order)
    near = cut.select(
        "*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols], *[F.lead(c).over(w).alias(f"next_{c}") for c in cols],
        F.lag(order).over(w).isNull().alias("_first"), F.lead(order).over(w).isNull().alias("_last"),
    )
    ends = cut.groupBy(*part).agg(
        F.min(F.struct(order, *cols)).alias("_lo"), F.max(F.struct(order, *cols)).alias("_hi")
    )
    wk = Window.partitionBy(*keys).orderBy("_bk")
    ends = ends.select(*part, F.lag("_hi").over(wk).alias("_before"), F.lead("_lo").over(wk).alias("_after"))
    joined = null_safe_join(near, ends, part)  # a track without zone or beam is a track too
    rest = [c for c in df.columns]
    return joined.select(
        *rest,
        *[F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in cols],
        *[F.when(F.col("_last"), F.col(f"_after.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in cols],
    )


def with_local_max(shots: DataFrame, cols=("rh95", "rh100"), keys: list[str] = TRACK) -> DataFrame:
    """Largest of a shot and its two track neighbours, per column (greatest skips missing neighbours)."""
    n = with_neighbours(shots, keys, "shot_number", list(cols))
    out = n.select(*shots.columns, *[F.greatest(f"prev_{c}", c, f"next_{c}").alias(f"localmax_{c}") for c in cols])
    return out


def relative_gap(share: float = 0.5) -> Column:
    return (F.col("rh95") < share * F.col("localmax_rh95")) | (F.col("rh100") < share * F.col("localmax_rh100"))


def absolute_gap(height_m: float = 15.0) -> Column:
    return (F.col("rh95") < height_m) | (F.col("rh100") < height_m)


def elevation_stats(shots: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of valid elevations."""
    return shots.groupBy(*keys).agg(
        F.count("elevation_ground").alias("n_valid"), F.avg("elevation_ground").alias("mean_elevation"),
        F.stddev_pop("elevation_ground").alias("std_elevation"),
    )


def elevation_anomalies(shots: DataFrame, keys: list[str], preset: str = "archaeological", min_valid: int = 10) -> DataFrame:
    """Shots beyond mean +- k sigma of their group, kind mound or ditch, with the group statistics."""
    k = PRESETS[preset]["anomaly_sigma"]
    s = elevation_stats(shots, keys).where(F.col("n_valid") >= min_valid)
    z, m, sd = F.col("elevation_ground"), F.col("mean_elevation"), F.col("std_elevation")
    kind = F.when(z > m + k * sd, "mound").when(z < m - k * sd, "ditch")
    return null_safe_join(shots, s, keys).withColumn("kind", kind).where(F.col("kind").isNotNull())


def anomaly_significance(anomalous: DataFrame, keys: list[str]) -> DataFrame:
    """One-sample test of the high anomalies of each group against the group mean."""
    z = F.col("elevation_ground")
    g = anomalous.where("kind = 'mound'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("m"), F.stddev_samp(z).alias("sd"), F.stddev_pop(z).alias("sp"),
        F.max("mean_elevation").alias("base"),
    )
    t = (F.col("m") - F.col("base")) / (F.col("sd") / F.sqrt("n"))
    few, flat = F.col("n") < 3, ~(F.col("sd") > 0)
    g = g.withColumn("t_stat", F.when(~few & ~flat, t))
    p = F.when(few, 1.0).when(flat, 0.0).otherwise(ST.t_two_sided_p(F.col("t_stat"), (F.col("n") - 1).cast("double")))
    d = F.when(few, 0.0).when(F.col("sp") > 0, (F.col("m") - F.col("base")) / F.col("sp")).otherwise(0.0)
    g = g.withColumn("p_value", p).withColumn("cohens_d", d)
    return g.select(
        *keys, "n", "t_stat", "p_value", "cohens_d",
        ST.significance_level(F.col("p_value"), F.col("cohens_d"), F.col("n")).alias("significance"),
    )


def segment_lengths(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Great-circle distance from the previous point of the same group."""
    n = with_neighbours(points, keys, order, ["lon", "lat"])
    d = geo.haversine_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))
    return n.withColumn("segment_m", d).drop("prev_lon", "prev_lat", "next_lon", "next_lat")


def line_fits(points: DataFrame, keys: list[str], order: str, min_points: int = 4) -> DataFrame:
    """Least-squares line of latitude on longitude per group with F test, RMSE and path length."""
    s = segment_lengths(points, keys, order)
    y, x = F.col("lat"), F.col("lon")
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"),
        F.regr_syy(y, x).alias("syy"), F.coalesce(F.sum("segment_m"), F.lit(0.0)).alias("length_m"),
    ).where(F.col("n") >= min_points)
    exact = F.col("r2") >= 1
    f = F.when(~exact, F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    g = g.withColumn("f_stat", f)
    p = F.when(exact, 0.0).otherwise(ST.f_one_predictor_p(F.col("f_stat"), (F.col("n") - 2).cast("double")))
    rmse = F.sqrt(F.greatest(F.col("syy") * (1 - F.col("r2")) / F.col("n"), F.lit(0.0)))
    g = g.withColumn("p_value", p).withColumn("rmse", rmse)
    good = F.col("p_value") < 0.05
    kind = F.when((F.col("r2") >= 0.75) & good, "linear_causeway").when((F.col("r2") >= 0.70) & good, "field_boundary")
    return g.select(*keys, "n", "r2", "slope", "f_stat", "p_value", "rmse", "length_m", kind.alias("feature_type"))


def clearing_potential(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Mean points per cluster of 10..10000 m2: 5/3/2 by size plus 2 for a typical clearing area."""
    n, a = F.col("n_points"), F.col("area_m2")
    pts = F.when(n >= 10, 5).when(n >= 5, 3).when(n >= 3, 2).otherwise(0) + F.when(a.between(100.0, 5000.0), 2).otherwise(0)
    return clusters.where(a.between(10.0, 10000.0)).groupBy(*keys).agg(
        F.avg(pts).alias("potential"), F.count(F.lit(1)).alias("clearings"), F.max("n_points").alias("largest")
    )


def earthwork_potential(clusters: DataFrame, lines: DataFrame, significance: DataFrame, keys: list[str]) -> DataFrame:
    """Summed points of mounds and lines, scaled by the significance of the anomalies, truncated."""
    n, a = F.col("n_points"), F.col("area_m2")
    mound = F.when((a >= 200) & (n >= 5), 4).when((a >= 50) & (n >= 3), 2).when(n >= 2, 1).otherwise(0)
    line = F.when(F.col("r2") > 0.9, 3).otherwise(2)
    parts = clusters.select(*keys, mound.alias("pts")).unionByName(
        lines.where(F.col("feature_type").isNotNull()).select(*keys, line.alias("pts"))
    )
    total = parts.groupBy(*keys).agg(F.sum("pts").alias("points"))
    scale = F.when(F.col("significance") == "HIGH", 1.2).when(F.col("significance") == "LOW", 0.7).otherwise(1.0)
    return total.join(significance.select(*keys, "significance"), keys, "left").select(
        *keys, "points", (F.col("points") * scale).cast("int").alias("potential")
    )


def fast_potential(clusters: DataFrame, keys: list[str], kind: str = "clearing") -> DataFrame:
    """Summed points per cluster: 3/2/1 for clearings, 4/2 for mounds."""
    n = F.col("n_points")
    pts = F.when(n >= 5, 3).when(n >= 3, 2).otherwise(1) if kind == "clearing" else F.when(n >= 4, 4).otherwise(2)
    return clusters.groupBy(*keys).agg(F.sum(pts).alias("potential"))
