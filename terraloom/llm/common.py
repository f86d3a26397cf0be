"""Helpers the operators of this subpackage share: written tables, bounded bitmaps and batch text arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.runtime import ensure_checkpoint_dir, heavy_keys

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Characters of text handled at once inside a task.
SLICE_CHARS = 4_000_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one every executor reaches (spark.checkpoint.dir)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts lineage, keeps column pruning."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns; equal rows, and only those, share it. Nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in df.columns]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(-1)) for c in df.columns]
    return F.sha2(F.concat_ws("|", *sizes, *parts), 256)


# ---- bounded bitmaps -------------------------------------------------------------------------------------------------

BITMAP_BITS = 23


def bitmap(keys: DataFrame, col: str, bits: int = BITMAP_BITS):
    """Broadcast bitmap of the 64-bit integers in ``keys[col]``.

    Its size is 2**bits bytes / 8 whatever the number of keys, and the driver receives at most 2**bits slot
    numbers. It has no false negatives; more keys mean more false positives, which the join after it removes.
    """
    spark = keys.sparkSession
    slots = keys.select(F.col(col).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("s")).distinct().toArrow()
    seen = np.zeros(1 << bits, dtype=bool)
    seen[slots.column("s").to_numpy()] = True
    return spark.sparkContext.broadcast(np.packbits(seen, bitorder="little"))


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(len(packed) * 8 - 1)
    return (packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---- what worker processes keep --------------------------------------------------------------------------------------

_HELD: dict = {}


def held(key: str, make):
    """The one large helper this worker process keeps from task to task; asking for another one lets go of it."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Free what tasks of other steps left in this worker process, which Spark uses again."""
    _HELD.clear()
    _POWERS.clear()
    pa.default_memory_pool().release_unused()


# ---- text batches as arrays ------------------------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    lengths = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    group = np.cumsum(lengths) // limit
    start = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1), len(col)]:
        yield batch.slice(start, end - start)
        start = int(end)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, kept per worker process."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def folded_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z folded, whether each is ASCII white space, whether it is not)."""
    out = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    space = _IS_SPACE[out]
    return out, space, ~space


def byte_prefixes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums p and inverse powers v so that (p[b] - p[a]) * v[a] is a hash of the bytes from a to b, wherever they are."""
    power, inverse = _powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])]), inverse


def word_hashes(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other than ASCII white space) and the word offsets per text.

    Words of all texts are found and hashed together on the UTF-8 bytes; A-Z are folded when asked. Hashes are
    polynomials over the bytes from prefix sums, mixed with the length.
    """
    joined = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(joined, dtype=np.uint8)
    if fold:
        raw = _LOWER[raw]
    space = _IS_SPACE[raw]
    inside = np.concatenate([[False], ~space])
    edges = np.flatnonzero(inside[1:] != inside[:-1]) if len(raw) else np.zeros(0, np.int64)
    first, last = edges[0::2], edges[1::2]
    power, inverse = _powers(len(raw) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    h = (prefix[last] - prefix[first]) * inverse[first]
    h = mix64(h ^ ((last - first).astype(np.uint64) << np.uint64(48)))
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)
    return h, offsets


def array_hashes(words: pa.Array) -> np.ndarray:
    """What ``word_hashes`` gives each of ``words`` (without white space, none null) unfolded, read from the array's own bytes; 0 for the empty word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    prefix, inverse = byte_prefixes(raw)
    first, last = ends[:-1] - ends[0], ends[1:] - ends[0]
    h = mix64((prefix[last] - prefix[first]) * inverse[first] ^ ((last - first).astype(np.uint64) << np.uint64(48)))
    h[first == last] = 0
    return h


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their offsets per text; a shorter text is one shingle, an empty one none."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    start = np.arange(out[-1]) - out[owner] + offsets[owner]
    length = np.minimum(n, size)[owner]
    h = np.zeros(len(start), np.uint64)
    for k in range(size):
        use = length > k
        h[use] = mix64(h[use] * np.uint64(31) + words[start[use] + k] + np.uint64(k + 1))
    return h, out


# ---- groups of linked rows -------------------------------------------------------------------------------------------


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014) until only stars are left. Every round is written as Parquet, so that a round starts from a few files and not from every
    partition of the one before it. One pass counts how often a node is the larger and the smaller end, which tells whether a node has two roots or a root has one itself.
    """
    e = saved(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        ends = e.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(x).alias("up"), F.lit(1 - x).alias("down")) for c, x in (("u", 1), ("v", 0))])).alias("end"))
        ends = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
        if ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "edges")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"])).alias("e"))
        e = saved(small.select("e.*").where("u <> v").distinct(), "edges")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after adding the edges ``links`` (a, b): only edges between components are contracted."""
    named = [found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in "ab"]
    between = links.join(named[0], "a", "left").join(named[1], "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    top = components(between).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(new).join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))


def linked_groups(buckets: DataFrame, prepare, near: str, features: DataFrame, pivots: int = 2) -> DataFrame:
    """(node, component) of the graph of verified pairs among ids that share a bucket.

    ``buckets`` has (bucket, id), an id once per bucket; it is read twice, so it should be cheap to make again. ``features`` has (id, <c>...). ``near`` is a cheap SQL condition on a pair that
    every good pair meets, over a, b and the columns a_<c>, b_<c>. ``prepare`` takes the table of ids (id) in shared buckets and returns two functions: one keeps the good rows of a table of
    pairs (a, b); the other, or None, makes the pairs of the last step itself, from rows (id, c, <c>...) with the component c: all good pairs of different components must be among them.

    Members of a bucket are first compared with its hub, the member with most neighbours over all its buckets (the original of a family of copies meets more of them than they
    meet each other), then with random members of other components: a number of pairs linear in the bucket. Pairs whose ends are still apart after that are compared too, so the components are those of all pairs, while members that are joined already are never paired with each other.
    """
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("_a"), F.max("id").alias("_z"), F.count(F.lit(1)).alias("n")).where("_a < _z").select("bucket", "n")
    table = saved(buckets.join(shared, "bucket").select("bucket", "id", "n"), "shared")
    hubs = table.groupBy("id").agg(F.sum("n").alias("degree"))
    centres = table.join(hubs, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id")).alias("hub")).select("bucket", F.col("hub.id").alias("hub"))
    table = saved(table.join(centres, "bucket").select("bucket", "id", "hub"), "starred")
    verify, rest = prepare(table.select("id").distinct())
    cols = [c for c in features.columns if c != "id"]

    def checked(pairs: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(pairs compared so far, good ones of the new pairs)."""
        new = pairs.distinct()
        if seen is not None:
            new = new.join(seen, ["a", "b"], "left_anti")
        new = saved(with_both(saved(new, "pairs"), features, cols).where(near).select("a", "b"), "near")
        return new, saved(verify(new), "links")

    def in_mixed(marked: DataFrame) -> DataFrame:
        """The members (bucket, id, c, ...) of buckets that hold more than one component."""
        mixed = marked.groupBy("bucket").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("bucket")
        return saved(marked.join(mixed, "bucket", "left_semi"), "mixed")

    star = table.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    seen, good = checked(star, None)
    found = saved(components(good), "components")
    for turn in range(pivots + 1):
        marked = in_mixed(table.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")))
        if marked.isEmpty():
            return found
        if turn < pivots:
            one = marked.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket", F.lit(turn)).alias("h"), "id", "c")).alias("p"))
            apart = marked.join(one, "bucket").where(F.col("c") != F.col("p.c"))
            pairs = apart.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        else:
            if rest is not None:
                pairs = rest(marked.select("id", "c").distinct().join(features, "id"))
                tested, links = checked(pairs, seen)
                return found if links.isEmpty() else merged_components(found, links)
            marked = marked.join(features, "id")
            left = marked.select("bucket", F.col("id").alias("a"), F.col("c").alias("_ca"), *[F.col(c).alias(f"a_{c}") for c in cols])
            right = marked.select(F.col("bucket").alias("_bucket"), F.col("id").alias("b"), F.col("c").alias("_cb"), *[F.col(c).alias(f"b_{c}") for c in cols])
            close = F.expr(near)
            pairs = left.join(right, (F.col("bucket") == F.col("_bucket")) & (F.col("_ca") != F.col("_cb")) & (F.col("a") < F.col("b")) & close).select("a", "b")
        tested, links = checked(pairs, seen)
        if not links.isEmpty():
            found = saved(merged_components(found, links), "components")
        if turn < pivots:
            seen = seen.unionByName(tested)
    return found


def with_both(pairs: DataFrame, payload: DataFrame, cols: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``payload`` (id, ...) of both ends, as a_... and b_....

    Ends that occur in many pairs are cut into slices by the other end. Both ends are cut before the first join, so that the pairs are counted as they are and never joined twice.
    """
    ends = [("a", "b"), ("b", "a")]
    hot = {end: F.broadcast(heavy_keys(pairs, [end])) for end, _ in ends}  # fewer than 512 rows each
    out = pairs
    for end, other in ends:
        out = out.join(hot[end].withColumnRenamed("_slices", f"_n{end}"), end, "left")
    out = out.select(*pairs.columns, *[F.pmod(F.xxhash64(other), F.coalesce(F.col(f"_n{end}"), F.lit(1))).cast("int").alias(f"_s{end}") for end, other in ends])
    for end, _ in ends:
        side = payload.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]).join(hot[end], end, "left")
        side = side.withColumn(f"_s{end}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))).drop("_slices")
        out = out.join(side, [end, f"_s{end}"])
    return out.drop("_sa", "_sb")


# ---- ordered sums ----------------------------------------------------------------------------------------------------


def prefix_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with before_<v> for every value: the sum over all rows that come earlier in ``order``.

    Rows are range-partitioned; each partition sums its own rows and starts from the totals of the partitions before
    it, one row per partition.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_t_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, "_part")
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_t_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_t_{v}" for v in values])
