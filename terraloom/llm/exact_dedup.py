"""Exact duplicates with static binary-fuse filters per immutable snapshot.

Documents arrive in batches. Duplicates inside a batch are grouped first. The digests left are screened by the filter of every earlier snapshot:
what a filter denies is new for certain, what it admits joins the exact buckets of that snapshot. What stays new becomes the next
snapshot with a filter of its own; a snapshot is written once and never changed. At the end the texts of every bucket with several rows are compared
byte by byte, and a bucket that holds different texts is split by the text itself.

A filter is built per hash shard of about ``SHARD_KEYS`` digests in one task each, 16-bit fingerprints on three-wise binary fuse hashing
(Graf and Lemire, 2022), by rounds of whole-array peeling.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space; null counts as empty. The row with the smallest id
stays (null ids last; of rows with one id any one). An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import bitmap, in_bitmap, mix64, saved, whole_text
from terraloom.llm.registry import query, table
from terraloom.runtime import salted_join

SHARD_KEYS = 100_000
FILTER = "shard int, seed long, segment int, segments int, marks binary"


# ---- the filter ------------------------------------------------------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments and the fingerprint of every key."""
    h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), (mix64(h) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) for distinct 64-bit keys."""
    n = len(keys)
    segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, math.ceil(n * factor / segment) - 2) if n > 1 else 1
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += max(1, segments // 8)
        slots, mark = _places(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        index = np.arange(n, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, index)
        layers, left = [], n
        ready = np.flatnonzero(count == 1)
        while len(ready):
            key, at = np.unique(owner[ready], return_index=True)  # a key alone in two slots is taken once
            slot = ready[at]
            layers.append((key, slot))
            left -= len(key)
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(slots[:, key])
            ready = touched[count[touched] == 1]
        if left:
            continue
        marks = np.zeros(size, np.uint16)
        for key, slot in reversed(layers):
            a, b, c = slots[:, key]
            marks[slot] = 0
            marks[slot] = mark[key] ^ marks[a] ^ marks[b] ^ marks[c]
        return seed, segment, segments, marks
    raise RuntimeError(f"no binary-fuse filter for {n} keys; are they distinct?")


def may_hold(keys: np.ndarray, seed: int, segment: int, segments: int, marks: np.ndarray) -> np.ndarray:
    """False for keys that are not in the filter for certain."""
    slots, mark = _places(keys, seed, segment, segments)
    return marks[slots[0]] ^ marks[slots[1]] ^ marks[slots[2]] == mark


# ---- snapshots -------------------------------------------------------------------------------------------------------


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.shiftright("key", 40), F.lit(shards)).cast("int"))


def _filters(buckets: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, marks = build_filter(np.unique(group["key"].to_numpy(np.int64).view(np.uint64)))
        return pd.DataFrame([(int(group["shard"].iloc[0]), seed, segment, segments, marks.tobytes())], columns=["shard", "seed", "segment", "segments", "marks"])

    return saved(_sharded(buckets.select("key"), shards).groupBy("shard").applyInPandas(build, FILTER), "filter")


def _admitted(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Rows (key, digest) of the batch that the filter of a snapshot admits."""

    def screen(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or found.empty:
            return rows[["digest"]].iloc[:0]
        f = found.iloc[0]
        keep = may_hold(rows["key"].to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["marks"], np.uint16))
        return rows.loc[keep, ["digest"]]

    left = _sharded(batch.select("key", "digest"), shards).groupBy("shard")
    return left.cogroup(filters.groupBy("shard")).applyInPandas(screen, "digest string")


def group_batches(rows: DataFrame, batches: int) -> DataFrame:
    """(digest, keep, n): one row per digest of ``rows`` (row, doc_id, digest, batch); keep is the first (null, id, row)."""
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    grouped = None
    for b in range(batches):
        new = saved(
            rows.where(F.col("batch") == b).groupBy("digest").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
            ).withColumn("key", F.xxhash64("digest")), "batch",
        )
        grouped = new if grouped is None else grouped.unionByName(new)
        size = new.count()
        for buckets, filters, shards in snapshots:
            positives = saved(_admitted(new, filters, shards), "positives")
            old = buckets.join(positives, "digest", "left_semi").select("digest")
            new = new.join(old, "digest", "left_anti")
        new = saved(new, "snapshot")
        shards = max(1, math.ceil(size / SHARD_KEYS))
        snapshots.append((new, _filters(new, shards), shards))
    return grouped.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _mixed_buckets(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests whose rows do not all have the same bytes. ``texts`` has (digest, text)."""
    packed = bitmap(groups.where("n > 1").select(F.xxhash64("digest").alias("key")), "key")

    def shared(batches):
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield b.filter(pa.array(in_bitmap(packed.value, key)))

    several = texts.select(F.xxhash64("digest").alias("key"), "digest", "text")
    several = several.mapInArrow(shared, several.schema)
    ends = several.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return ends.where("lo <> hi").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row.

    ``batches`` consecutive ranges of ids arrive one after the other. ``digest`` maps the normalised text to a string (SHA-256 by default).
    """
    digest = digest or (lambda text: F.sha2(text, 256))
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(whole_text(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = saved(texts.select("doc_id", "digest").withColumn("row", F.monotonically_increasing_id()), "digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    batch = sum([(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0)) if cuts else F.lit(0)
    rows = rows.withColumn("batch", F.when(F.col("doc_id").isNull(), batches - 1).otherwise(batch))
    groups = saved(group_batches(rows, batches), "groups")
    mixed = saved(_mixed_buckets(texts, groups), "mixed")
    out = salted_join(rows.drop("batch"), groups, ["digest"], "row")
    if not mixed.isEmpty():  # a digest collision: those buckets go by the text itself
        split = saved(texts.join(mixed, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "split")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        by_text = split.groupBy("digest", "text").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("n"))
        split = salted_join(split, by_text, ["digest", "text"], "row").select(*out.columns)
        out = out.join(mixed, "digest", "left_anti").unionByName(split)
    return out.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), "digest"
    )


@query(
    "op5_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op5_exact_dedup(spark, sf_dir):
    """Contract query: three batches of consecutive ids."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
