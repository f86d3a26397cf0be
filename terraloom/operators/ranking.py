"""Ordered selections of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import scores as S
from terraloom.operators.display import top_per_group


def prioritised(detections: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` detections per zone by priority score, with rank and field priority."""
    score = S.priority_score(
        F.col("confidence"), F.col("lidar_support") | F.col("spectral_support"), F.col("convergent_score"),
        F.col("area_m2"), F.col("det_type"), F.col("provider"),
    )
    ranked = top_per_group(detections.withColumn("priority_score", score), ["zone_id"], F.col("priority_score"), "det_id", n)
    return ranked.withColumnRenamed("rank", "priority_rank").withColumn(
        "field_priority", F.when(F.col("priority_rank") <= 3, "high").otherwise("medium")
    )


def with_candidate_score(detections: DataFrame) -> DataFrame:
    """Score of every candidate from confidence, convergence, sensor support and type."""
    return detections.withColumn(
        "enhanced_score",
        S.candidate_score(
            F.col("confidence"), F.col("convergence_score"), F.col("lidar_support"), F.col("spectral_support"),
            F.col("det_type"), F.col("provider"),
        ),
    )


def diverse_top(candidates: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` with at most max(3, k/4) per type unless convergent, filled up by score.

    The scan over the ranking becomes: keep a row if it is among the first m of its type or convergent;
    kept rows come first. Only rows that can reach the result take part: the first m per type, the k best
    convergent ones and the k best of the rest, so no large ranking is ever collected.
    """
    m = max(3, k // 4)
    order = [F.desc("enhanced_score"), F.col("det_id")]
    leading = top_per_group(candidates, ["det_type"], F.col("enhanced_score"), "det_id", m).drop("rank")
    convergent = candidates.where("convergence_score > 0").orderBy(*order).limit(k)
    kept = leading.unionByName(convergent).dropDuplicates(["det_id"])
    # a row outside the first m of its type and not convergent is a filler
    rest = candidates.where("convergence_score = 0").join(leading.select("det_id"), "det_id", "left_anti")
    fill = rest.orderBy(*order).limit(k)
    pool = kept.withColumn("_late", F.lit(0)).unionByName(fill.withColumn("_late", F.lit(1)))
    top = pool.orderBy("_late", *order).limit(k)
    # k rows at most from here on
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_late", *order))).drop("_late")


def unique_first(df: DataFrame, candidates: list[str], order: str) -> DataFrame:
    """One row per first non-null key of ``candidates``, the smallest ``order`` wins."""
    keyed = df.withColumn("result_key", F.coalesce(*candidates))
    first = keyed.groupBy("result_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["result_key", order], "left_semi")


def coverage_gaps(zones: DataFrame, detections: DataFrame, provider: str) -> DataFrame:
    """Zones without any detection of a provider."""
    have = detections.where(F.col("provider") == provider).select("zone_id")
    return zones.select("zone_id").join(have, "zone_id", "left_anti")
