"""Exact interpolated percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import cut_lineage

BINS = 2048
#: Distinct values of a cell that one task may rank.
CELL_LIMIT = 1 << 18


def _magnitude(v: Column) -> Column:
    """A bin per sign and power of two, in the order of the values: at most some 4200 bins for all doubles."""
    power = F.when(F.abs(v) >= 2.0**-1022, F.floor(F.least(F.log2(F.abs(v)), F.lit(1024.0)))).otherwise(F.lit(-1023)) + 1100
    return F.when(v > 0, power).when(v < 0, -power).otherwise(F.lit(0)).cast("long")


def _located(targets: DataFrame, vals: DataFrame, cell: list[str], binned: Column) -> tuple[DataFrame, DataFrame]:
    """One step of the search: every wanted rank moves into its bin, and only the values of such bins stay."""
    vals = vals.withColumn("_bin", binned)
    hist = vals.groupBy(*cell, "_bin").agg(F.sum("_n").alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"), F.count(F.lit(1)).alias("_d2"))
    order = Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_end", F.sum("_c").over(order))
    start = F.col("_end") - F.col("_c")
    keys = cell[:-1]
    deeper = F.xxhash64(F.col("_cell"), F.col("_bin"))
    hit = targets.drop("_lo", "_hi", "_d").join(cum, cell).where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end")))
    targets = hit.select(
        *keys, deeper.alias("_cell"), "_w", (F.col("_rank") - start).alias("_rank"), "_frac", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), F.col("_d2").alias("_d")
    )
    wanted = targets.select(*cell, "_lo", "_hi", "_d").distinct()
    vals = vals.select(*keys, deeper.alias("_cell"), "_v", "_n").join(wanted, cell)
    return cut_lineage(targets), cut_lineage(vals)


def quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row per key with an exact, linearly interpolated percentile per named probability.

    Equal values are counted first, so the source is read once and only distinct values travel. The wanted order statistics are then located for all keys and probabilities
    at once: as long as a cell that holds one has more than ``cell_limit`` distinct values, cells are split, first by power of two and then evenly into 2048, and only the bins that
    hold a wanted rank stay. The values of a power of two are at most a factor of two apart, so six steps end the search for any spread of doubles. The cells that remain are ranked.
    No task ever sees the rows of a whole group, and ``keys`` may be empty.
    """
    v = F.col(value) if isinstance(value, str) else value
    src = df.select(*keys, v.cast("double").alias("_v"))
    counted = src.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counted = cut_lineage(counted)
    # one row per key, computed together with the size of the largest group
    total = cut_lineage(counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d")).where("_d > 0"))

    # wanted ranks: floor and ceiling position of every probability
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.lit(float(p)).alias("p"))
            for i, p in enumerate(probs.values())
            for side in (0, 1)
        ]
    )
    pos = F.col("_w.p") * (F.col("_total") - 1)
    targets = (
        total.withColumn("_w", F.explode(wanted))
        .withColumn("_rank", F.least(F.floor(pos) + F.col("_w.side"), F.col("_total") - 1))
        .select(*keys, F.lit(0).cast("long").alias("_cell"), "_w", "_rank", (pos - F.floor(pos)).alias("_frac"), "_lo", "_hi", "_d")
    )
    cell = [*keys, "_cell"]
    vals = counted.withColumn("_cell", F.lit(0).cast("long"))
    split, cell_limit = _magnitude(F.col("_v")), max(cell_limit, 1)
    while (targets.agg(F.max("_d")).first()[0] or 0) > cell_limit:
        targets, vals = _located(targets, vals, cell, split)
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS
        split = F.when((F.col("_d") > cell_limit) & (F.col("_hi") > F.col("_lo")), F.least(F.floor(share), F.lit(BINS - 1))).otherwise(0).cast("long")
    order = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = vals.select(*cell, "_v", "_n", F.sum("_n").over(order).alias("_end"))
    hits = targets.drop("_lo", "_hi", "_d").join(ranked, cell).where((F.col("_rank") >= F.col("_end") - F.col("_n")) & (F.col("_rank") < F.col("_end")))

    def pick(i, side):
        return F.max(F.when((F.col("_w.i") == i) & (F.col("_w.side") == side), F.col("_v")))

    outs = []
    for i, name in enumerate(probs):
        frac = F.max(F.when(F.col("_w.i") == i, F.col("_frac")))
        outs.append((pick(i, 0) + (pick(i, 1) - pick(i, 0)) * frac).alias(name))
    return hits.groupBy(*keys).agg(*outs)


def band_quantiles(pixels: DataFrame, bands: list[str], probs: dict[str, float], key: str = "scene_id") -> DataFrame:
    """Percentiles of several bands in one pass: columns ``<band>_<name>`` per key."""
    long = pixels.select(key, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands])).alias("p"))
    q = quantiles(long.select(key, F.col("p.band").alias("band"), F.col("p.v").alias("v")), [key, "band"], "v", probs)
    return q.groupBy(key).agg(
        *[F.max(F.when(F.col("band") == b, F.col(n))).alias(f"{b}_{n}") for b in bands for n in probs]
    )
