"""Shards of near equal bytes by sampled splitters.

The key of a row is (hash of its text, hash of its id), so equal texts are neighbours and stay together unless their
group is larger than a range. Size-weighted samples of the keys give quantile splitters that cut the key space into many small ranges; ranges that
turn out overfull are sampled and cut again, inside one text by the id hash. Shards are runs of neighbouring ranges whose exact byte sums are nearest to
equal shares. Only samples of bounded number and one row per range reach the driver.

Law ``bytes``: shard sizes are equal up to about one range, total / (shards * ranges_per_shard), or one row where a row is larger than that.
Null texts have size 1 and checksum 0; null ids are ordinary keys; equal rows may fall in any slot of their range; an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraloom.llm.common import saved, whole_text
from terraloom.llm.registry import query, table

LOWEST = -(1 << 63)
SAMPLES_PER_RANGE = 16


def _range_of(splitters: list[tuple[int, int]]):
    """Vectorised position of (key, tie) among sorted splitters: the number of splitters at or below it."""
    keys = np.array([k for k, _ in splitters], dtype=np.int64)
    ties = np.array([t for _, t in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def find(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = hi.copy()
        for first, last in {(int(a), int(b)) for a, b in zip(lo[lo < hi], hi[lo < hi])}:
            rows = lo == first
            rows &= hi == last
            out[rows] = first + np.searchsorted(ties[first:last], t[rows], "right")
        return pd.Series(out.astype(np.int32))

    return find


def _quantiles(sample: list, pieces: int) -> list[tuple[int, int]]:
    """Splitters at equal weights of a weighted sample of one range; whole texts unless one text spans several pieces."""
    sample = sorted(sample)
    weight = np.cumsum([w for _, _, w in sample])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces)
    cuts = [sample[min(i, len(sample) - 1)][:2] for i in at]
    hot = {a[0] for a, b in zip(cuts, cuts[1:]) if a[0] == b[0]}
    if len({k for k, _, _ in sample}) == 1:
        hot = {sample[0][0]}
    return [(k, t if k in hot else LOWEST) for k, t in cuts]


def find_splitters(rows: DataFrame, pieces: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Splitters that cut ``rows`` (key, tie, size) into about ``pieces`` ranges of near equal bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    goal = total / pieces
    splitters: list[tuple[int, int]] = []
    for n in range(rounds):
        placed = rows.withColumn("range", _range_of(splitters)("key", "tie"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("b"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n"))
        over = sums.where((F.col("b") > 2 * goal) & (F.col("n") > 1)).collect()  # fewer than pieces / 2 rows
        if not over:
            break
        uniform = (F.xxhash64("key", "tie", F.lit(n)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
        share = F.col("size") * F.lit(SAMPLES_PER_RANGE / goal)
        chosen = (
            placed.where(F.col("range").isin([r["range"] for r in over])).where(uniform < share)
            .groupBy("range", "key", "tie").agg(F.sum(F.greatest(share, F.lit(1.0))).alias("w")).collect()
        )
        by_range: dict[int, list] = {}
        for r in chosen:
            by_range.setdefault(r["range"], []).append((r["key"], r["tie"], r["w"]))
        found = set(splitters)
        for r in over:
            sample = by_range.get(r["range"], [])
            if len(sample) > 1:
                found.update(_quantiles(sample, max(2, round(r["b"] / goal))))
        if len(found) == len(splitters):
            break
        splitters = sorted(found)
    return splitters


def shard_of(rows: DataFrame, shards: int = 16, ranges_per_shard: int = 256) -> DataFrame:
    """``rows`` (key, tie, size, ...) with shard and slot."""
    splitters = find_splitters(rows, shards * ranges_per_shard)
    placed = saved(rows.withColumn("range", _range_of(splitters)("key", "tie")), "placed")
    sums = sorted(placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect())
    total, before, counts, plan = sum(r["b"] for r in sums), 0, [0] * shards, []
    ends = [total * (i + 1) / shards for i in range(shards)]
    for r in sums:
        shard = min(bisect.bisect_right(ends, before + r["b"] / 2), shards - 1)
        plan.append((r["range"], shard, counts[shard]))
        counts[shard] += r["n"]
        before += r["b"]
    plan = rows.sparkSession.createDataFrame(plan, "range int, shard int, first long")  # one row per range
    inside = Window.partitionBy("range").orderBy("key", "tie")
    return placed.join(F.broadcast(plan), "range").withColumn("slot", F.col("first") + F.row_number().over(inside) - 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.xxhash64(F.col(id_col), F.lit(1)).alias("tie"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = saved(_keyed(docs, id_col, text_col), "keyed")
    return shard_of(rows, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """The rows themselves as Parquet, one folder per shard; ranges keep the files of a shard many and of like size."""
    rows = saved(_keyed(docs, id_col, text_col), "keyed")
    plan = shard_of(rows, shards).groupBy("range").agg(F.first("shard").alias("_shard"))
    find = _range_of(find_splitters(rows, shards * 256))
    text = whole_text(text_col)
    out = docs.withColumn("_range", find(F.xxhash64(text), F.xxhash64(F.col(id_col), F.lit(1))))
    out.join(F.broadcast(plan.withColumnRenamed("range", "_range")), "_range").repartition("_range").drop("_range").write.partitionBy("_shard").parquet(path)


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    """Contract query: law ``bytes``, 16 shards."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
