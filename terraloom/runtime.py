"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; fall back to a temp folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="terraloom-ckpt-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and return it with a short plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, keys: list[str], parts: int = 512) -> DataFrame:
    """Keys holding more than 1/parts of all rows, with the number of slices each should get.

    Fewer than ``parts`` keys can qualify, whatever the input size, so the result is safe to
    broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return counts.where(F.col("_n") * parts > total.scalar()).select(
        *keys, F.ceil(F.col("_n") * parts / total.scalar()).cast("int").alias("_slices")
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: str, parts: int = 512, how: str = "inner", dealt: bool = False
) -> DataFrame:
    """Equi-join (inner or left) where hot keys on the left are cut into slices.

    Left rows of a hot key get a slice from a hash of ``spread``; the matching right rows are
    copied once per slice. Cold keys keep slice 0, so the join result is unchanged.
    ``dealt`` is for sides whose rows were multiplied or whose matches outnumber them: the sizes Spark estimates
    say nothing then, so both sides are always shuffled, into all shuffle partitions, and neither is broadcast.
    """
    hot = F.broadcast(heavy_keys(left, keys, parts))
    l = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce(F.col("_slices"), F.lit(1))).cast("int")
    ).drop("_slices")
    r = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    ).drop("_slices")
    if dealt:
        l, r = l.repartition(shuffle_partitions(left.sparkSession), *keys, "_salt").hint("merge"), r.hint("merge")
    return l.join(r, keys + ["_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys, as they do in groups and windows; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])
