"""Selections for maps and lists: best per cluster, top-k, density limits, de-duplication, viewports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.functions import scores as S
from terraloom.operators import density as de
from terraloom.operators.topn import sliced_rank

MIN_CONFIDENCE, CLUSTER_ABOVE, CLUSTER_M, CLUSTER_MIN, DEDUPE_M = 0.4, 500, 100.0, 3, 50.0  # fixed values


def _conf() -> Column:
    return F.coalesce("confidence", F.lit(0.0))


def best_per_group(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Row with the highest confidence per group, smallest key on ties, as one struct maximum."""
    best = F.max(F.struct(_conf().alias("c"), (-F.col(key)).alias("k")))
    ids = df.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_merged")).select(
        (-F.col("_b.k")).alias(key), "n_merged"
    )
    return df.join(ids, key)


def top_per_group(df: DataFrame, keys: list[str], score: Column, key: str, n: int) -> DataFrame:
    """First ``n`` rows per group by score; the rank filter is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def deduplicated(detections: DataFrame, key: str, metres: float = DEDUPE_M) -> DataFrame:
    """Greedy de-duplication: leaders in key order take near unused points; the best of each is kept."""
    lead = de.leaders(detections.select(key, "lon", "lat"), key, metres / 111320.0, 1)
    return best_per_group(detections.join(lead, key), ["leader"], key).drop("leader")


def viewport_view(detections: DataFrame, key: str, box: dict, clustered: bool = True) -> DataFrame:
    """Cull to the buffered viewport and filter by confidence; clusters of what remains, or with ``clustered`` false every detection for itself.

    n_in_view counts the detections in view, and crowded tells whether a map had better show clusters; the caller decides, no row depends on it.
    """
    inside = geo.in_viewport(F.col("lon"), F.col("lat"), box["west"], box["south"], box["east"], box["north"])
    seen = detections.where(inside & (_conf() >= MIN_CONFIDENCE))
    if clustered:
        shown = de.representatives(seen, key, CLUSTER_M / 111320.0, CLUSTER_MIN)
    else:
        shown = seen.select(
            key, _conf().alias("confidence"), "lon", "lat", F.lit(1).cast("long").alias("clustered_count"),
            _conf().alias("cluster_confidence"), F.lit(-1).cast("long").alias("cluster_id"),
        )
    n = seen.agg(F.count(F.lit(1)).alias("n")).scalar()
    return shown.withColumn("n_in_view", n).withColumn("crowded", n > CLUSTER_ABOVE)


def display_view(detections: DataFrame, key: str) -> DataFrame:
    """Confidence filter, de-duplication, then order by map priority."""
    kept = deduplicated(detections.where(_conf() >= MIN_CONFIDENCE), key)
    return kept.withColumn("priority", S.map_priority(F.col("confidence"), F.col("area_m2"))).orderBy(F.desc("priority"), key)


def zone_quota(zones: DataFrame, micro: Column, scale: float = 1.0) -> DataFrame:
    """Largest number of detections a zone may keep: at least five, else area times expected density."""
    lat = (F.col("north") + F.col("south")) / 2
    km2 = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) * 111 * 111 * F.abs(F.cos(F.radians(lat)))
    expected = km2 * F.when(micro, 0.05).otherwise(0.2) * scale
    return zones.select("zone_id", F.greatest(F.lit(5), F.floor(expected)).cast("long").alias("quota"))


def density_marked(detections: DataFrame, quotas: DataFrame, key: str, radius: float = 0.005) -> DataFrame:
    """Adds quota, quota_rank and over_quota; no detection is removed.

    In a zone above its quota the best detection of each cluster counts, and of those the most confident ones have a quota_rank up to the quota. Everything else there is over quota. Zones
    within their quota, and zones without one, have no rank.
    """
    counts = detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("_n"))
    limits = counts.join(quotas, "zone_id")
    busy = limits.where(F.col("_n") > F.col("quota")).select("zone_id", "quota")
    over = detections.join(busy.select("zone_id"), "zone_id", "left_semi")
    best = best_per_group(de.dbscan(over, key, radius, 1, by=["zone_id"]), ["zone_id", "cluster_id"], key).join(busy, "zone_id")
    ranked = sliced_rank(best, ["zone_id"], [_conf().desc(), F.col(key)], [key], "quota", "quota_rank").select(key, "quota_rank")
    marked = detections.join(limits.select("zone_id", "quota", (F.col("_n") > F.col("quota")).alias("_busy")), "zone_id", "left").join(ranked, key, "left")
    return marked.withColumn("over_quota", F.coalesce(F.col("_busy"), F.lit(False)) & F.col("quota_rank").isNull()).drop("_busy")


def density_limited(detections: DataFrame, quotas: DataFrame, key: str, radius: float = 0.005) -> DataFrame:
    """The detections within their zone's quota: a selection for callers that ask for one (see ``density_marked``)."""
    return density_marked(detections, quotas, key, radius).where(~F.col("over_quota")).select(*detections.columns)


def family_ranked(found: DataFrame, quotas: DataFrame | None) -> DataFrame:
    """Adds family_rank, by confidence within scene and family up to the scene's quota, and over_quota for what lies beyond it. ``quotas`` has (scene_id, quota)."""
    if quotas is None:
        return found.withColumn("family_rank", F.lit(None).cast("int")).withColumn("over_quota", F.lit(False))
    family = F.substring_index("det_type", "_", 2)
    family = F.when(F.col("det_type").isin("line", "circle", "rectangle"), "geometric").otherwise(family)
    limited = found.withColumn("_family", family).join(quotas, "scene_id", "left")
    ranked = sliced_rank(limited.where("quota IS NOT NULL"), ["scene_id", "_family"], [_conf().desc(), F.col("key")], ["key"], "quota", "family_rank")
    return limited.join(ranked.select("key", "family_rank"), "key", "left").withColumn("over_quota", F.col("quota").isNotNull() & F.col("family_rank").isNull()).drop("_family", "quota")
