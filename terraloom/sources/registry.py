"""Providers: functions that load one source into a common scene schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.runtime import null_safe_join

SCENE_COLUMNS = ["scene_id", "zone_id", "provider", "west", "south", "east", "north"]
_PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def provider(name: str):
    """Register a loader ``fn(spark, path)`` returning at least the scene columns but ``provider``."""

    def add(fn):
        _PROVIDERS[name] = fn
        return fn

    return add


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _PROVIDERS:
        raise KeyError(f"unknown provider {name}; known: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](spark, path).withColumn("provider", F.lit(name)).select(*SCENE_COLUMNS)


def load_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of several providers' scenes."""
    frames = [load(spark, name, path) for name, path in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _null_row(schema: str, zone) -> "pandas.DataFrame":  # noqa: F821
    import pandas as pd

    names = [part.strip().split()[0] for part in schema.split(",")]
    return pd.DataFrame([{n: (zone if n == "zone_id" else None) for n in names}])


def zone_groups(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a user function ``fn(pandas frame) -> pandas frame`` to all rows of each zone at once.

    For functions that cannot be divided. The caller answers for zones that fit into a task. A zone whose call fails gives one row of NULLs with only ``zone_id`` set.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(ids, pdf):
        try:
            return fn(pdf)[names]
        except Exception:  # noqa: BLE001 - a failing zone is reported as an empty result
            return _null_row(schema, ids[0])

    return df.groupBy("zone_id").applyInPandas(run, schema)


def zone_reduce(df: DataFrame, partial, merge, finish, state: str, schema: str, key: str, batch_rows: int = 100_000, fan: int = 64) -> DataFrame:
    """Apply a user function in two parts, so that no call holds a whole zone.

    ``partial(rows)`` turns a batch of a zone's rows into a state, a frame with the columns of ``state``; ``merge(states)`` turns several states, one below the other, into one; ``finish(state)``
    gives the zone's result with the columns of ``schema``. Batches are cut by a hash of ``key`` and merged ``fan`` at a time. If merging does not depend on the order,
    the result is the same for all batch sizes. A zone in which any call fails gives one row of NULLs with only ``zone_id`` set.
    """
    names = [part.strip().split()[0] for part in state.split(",")]
    out = [part.strip().split()[0] for part in schema.split(",")]
    full = f"{state}, _slice int, _failed boolean"

    def guarded(fn, pdf, zone, index):
        try:
            if "_failed" in pdf and pdf["_failed"].any():
                raise ValueError("a batch has failed")
            made = fn(pdf.drop(columns=["_slice", "_failed"], errors="ignore"))[names].copy()
            made["_failed"] = False
        except Exception:  # noqa: BLE001 - reported once for the zone
            made = _null_row(state, zone)
            made["_failed"] = True
        made["_slice"] = index
        return made

    slices = df.groupBy("zone_id").agg(F.ceil(F.count(F.lit(1)) / batch_rows).cast("int").alias("_k"))
    most = slices.agg(F.max("_k")).first()[0] or 1
    cut = null_safe_join(df, slices, ["zone_id"]).withColumn("_slice", F.pmod(F.xxhash64(key), F.col("_k")).cast("int")).drop("_k")
    states = cut.groupBy("zone_id", "_slice").applyInPandas(lambda ids, pdf: guarded(partial, pdf, ids[0], int(ids[1])), full)
    while most > fan:
        states = states.withColumn("_slice", F.floor(F.col("_slice") / fan).cast("int"))
        states = states.groupBy("zone_id", "_slice").applyInPandas(lambda ids, pdf: guarded(merge, pdf, ids[0], int(ids[1])), full)
        most = -(-most // fan)

    def last(ids, pdf):
        merged = guarded(merge, pdf, ids[0], 0)
        if merged["_failed"].any():
            return _null_row(schema, ids[0])
        try:
            return finish(merged[names])[out]
        except Exception:  # noqa: BLE001 - reported once for the zone
            return _null_row(schema, ids[0])

    return states.groupBy("zone_id").applyInPandas(last, schema)
