"""Near duplicates by ProbMinHash over sets of word shingles, with banding and exact verification.

A document is the set of its runs of five words (a shorter text is one shingle). ProbMinHash (Ertl, 2020) lets the
arrivals of a Poisson process per shingle, with its weight as rate, compete for the slots of the signature; a shingle stops as soon as its next arrival is
later than every slot's best. All weights are 1 here, however often a passage repeats in a text, so two documents agree in a slot with the probability
of the Jaccard similarity of their sets, the measure that links them. Bands of four of the 128 slots
form buckets; a pair of similarity 0.8 misses all 32 bands with probability below 1e-7.

Two bits per slot make a sketch of 256 bits. Texts of similarity 0.8 differ in 26 of them on average, with a standard deviation below 6; pairs that differ in more
than ``SKETCH_APART`` are not looked at further, which loses about three in a million of them. All others are verified on the shingle sets: Jaccard similarity of 0.8 or more links them. Equal shingle sets are collapsed before banding. Classes are the connected components
of all links; members of a bucket are first compared with representatives. The rest, pairs whose ends are still apart, is found exactly from the shingles of the texts still apart:
a text keeps its place only if 0.8 of its shingles occur in others of them, and pairs must share one of the rarest shingles of both, early enough that what follows can still reach 0.8
(prefix and position filters of set similarity joins, Xiao et al., 2008).

Words are runs of other than ASCII white space, A-Z folded. Texts without words have no shingles and are never linked; each is a class of its own. Null ids are ordinary rows.
Equal rows share a class. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import bitmap, in_bitmap, linked_groups, mix64, row_digest, saved, shingle_hashes, slices, texts_of, whole_text, with_both, word_hashes
from terraloom.llm.registry import query, table
from terraloom.runtime import salted_join

SHINGLE = 5
#: Bytes of text handled at once; arrays of a slice take some fifty times as much.
SLICE = 2_000_000
SLOTS = 128
BAND = 4
SIMILARITY = 0.8
SKETCH_APART = 52


SKETCH = ["s0", "s1", "s2", "s3"]
#: For thresholds in double arithmetic.
EPS = 1e-9


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def weighted(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight): distinct shingles per text and how often they occur, ordered by owner and shingle."""
    shingles, offsets = shingle_hashes(*word_hashes(texts), size)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingles[first], np.diff(np.append(first, len(owner))).astype(np.float64)


def signatures(n_texts: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(n_texts, slots) shingle hashes that arrive first in each slot; rows of texts without shingles stay zero.

    Round i draws the i-th arrival of every shingle that can still win. Arrivals of a shingle fall in random slots; it leaves
    when its arrival is later than the latest best slot of its text.
    """
    best = np.full(n_texts * slots, np.inf)
    who = np.zeros(n_texts * slots, np.uint64)
    time = np.zeros(len(owner))
    live = np.arange(len(owner))
    turn = 0
    while len(live):
        turn += 1
        draw = mix64(shingle[live] + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time[live] -= np.log(_uniform(draw)) / weight[live]
        own, t = owner[live], time[live]
        if turn > 1:  # early termination
            latest = best.reshape(n_texts, slots).max(axis=1)
            stay = t <= latest[own]
            live, own, t, draw = live[stay], own[stay], t[stay], draw[stay]
        slot = own * slots + (mix64(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(slots)).astype(np.int64)
        wins = t < best[slot]  # the later of two arrivals in one slot must lose: write in falling order of time
        slot, t, at = slot[wins], t[wins], live[wins]
        order = np.argsort(-t, kind="stable")
        best[slot[order]] = t[order]
        who[slot[order]] = shingle[at[order]]
    return who.reshape(n_texts, slots)


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, mark, id, bands, sketch, size) of every row (doc_id, digest, mark, text): id is a hash of the shingle set, null without any."""

    def sketch(batches):
        for b in batches:
            for part in slices(b, limit=SLICE):
                texts = texts_of(part)
                owner, shingle, _ = weighted(texts)
                sig = signatures(len(texts), owner, shingle, np.ones(len(owner)))  # the sets, which _similar compares
                bands = np.zeros((len(texts), SLOTS // BAND), np.uint64)
                for k in range(BAND):
                    bands = mix64(bands * np.uint64(31) + sig[:, k::BAND] + np.uint64(k + 1))
                bands = mix64(bands + np.arange(SLOTS // BAND, dtype=np.uint64)[None, :])
                two = mix64(sig)
                bits = np.packbits(np.concatenate([two & np.uint64(1), (two >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8), axis=1).view(np.int64)
                whole = np.zeros(len(texts), np.uint64)
                np.add.at(whole, owner, mix64(shingle))
                some = np.zeros(len(texts), bool)
                some[owner] = True
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel().view(np.int64)))
                ids = pa.array(mix64(whole).view(np.int64), pa.int64(), mask=~some)
                made = [ids, flat, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *made], ["doc_id", "digest", "mark", "id", "bands", *SKETCH, "size"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(sketch, f"doc_id {kind}, digest string, mark long, id long, bands array<long>, {', '.join(f'{c} long' for c in SKETCH)}, size int")


def _shingle_sets(batches):
    """mapInArrow function: (id, shingles) of rows (id, text), the distinct shingles as an array."""
    for b in batches:
        for part in slices(b, limit=SLICE):
            owner, shingle, _ = weighted(texts_of(part))
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle.view(np.int64)))], ["id", "shingles"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """(doc_id, digest, class) of every row: class is a 64-bit number, equal for rows of one class and only those.

    ``digest`` is an expression that identifies rows for the caller (by default the text digest).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (digest if digest is not None else F.sha2(whole_text(text_col), 256)).alias("digest"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    sketched = saved(_sketched(rows.select("doc_id", "digest", "mark", "text")), "sketches")
    ids = saved(sketched.where("id is not null").groupBy("id").agg(*[F.first(c).alias(c) for c in ["bands", *SKETCH, "size"]]), "ids")
    buckets = ids.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    sketches = ids.drop("bands")

    apart = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in SKETCH)
    near = f"{apart} <= {SKETCH_APART} AND least(a_size, b_size) >= {SIMILARITY}D * greatest(a_size, b_size) - {EPS}"

    def prepare(wanted: DataFrame):
        """The shingle sets of the wanted ids, found by one mark each; only texts in the marks' bitmap leave the scan. Pairs are compared row by row on these sets, so no batch of texts is ever held."""
        marks = saved(sketched.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("mark").alias("mark")), "marks")
        packed = bitmap(marks, "mark")

        def pick(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(packed.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

        texts = rows.select("mark", "text").mapInArrow(pick, "mark long, text string").join(marks, "mark")
        one = texts.groupBy("id").agg(F.min("text").alias("text"))
        sets = saved(one.mapInArrow(_shingle_sets, "id long, shingles array<long>"), "sets")

        def verify(pairs: DataFrame) -> DataFrame:
            both = with_both(pairs, sets, ["shingles"])
            both = both.select("a", "b", F.size(F.array_intersect("a_shingles", "b_shingles")).alias("n"), (F.size("a_shingles") + F.size("b_shingles")).alias("total"))
            return both.where(F.col("n") >= SIMILARITY * (F.col("total") - F.col("n"))).select("a", "b")

        def rest(apart: DataFrame) -> DataFrame:
            """Pairs of different components that may be similar, from rows (id, c, size, sketch)."""
            apart = saved(apart, "apart")
            of = lambda ids: sets.join(ids.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
            shingles = of(apart)
            alone = shingles.groupBy("shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
            able = saved(apart.join(alone, "id", "left").where(F.col("size") - F.coalesce("alone", F.lit(0)) >= SIMILARITY * F.col("size") - EPS).drop("alone"), "able")
            shingles = saved(of(able), "shingles")
            often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            ranked = salted_join(shingles, often, ["shingle"], "id", how="left")
            ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(1)), "shingle")))  # one document's shingles
            first = ranked.where("n is not null").join(able, "id").where(F.col("at") <= F.col("size") - SIMILARITY * F.col("size") + 1 + EPS)
            first = saved(first.select("shingle", "id", "c", "at", "size", *SKETCH), "prefixes")
            cols = ["at", "size", *SKETCH]
            left = first.select("shingle", F.col("id").alias("a"), F.col("c").alias("_ca"), *[F.col(c).alias(f"a_{c}") for c in cols])
            right = first.select(F.col("shingle").alias("_shingle"), F.col("id").alias("b"), F.col("c").alias("_cb"), *[F.col(c).alias(f"b_{c}") for c in cols])
            # the first shingle both have: they can share it and what follows it in the shorter remainder
            reach = f"1 + least(a_size - a_at, b_size - b_at) >= {SIMILARITY / (1 + SIMILARITY)}D * (a_size + b_size) - {EPS}"
            return left.join(right, (F.col("shingle") == F.col("_shingle")) & (F.col("_ca") != F.col("_cb")) & (F.col("a") < F.col("b")) & F.expr(f"{reach} AND {near}")).select("a", "b")

        return verify, rest

    groups = linked_groups(buckets, prepare, near, sketches, pivots=1)
    named = salted_join(sketched.select("doc_id", "digest", "id"), groups.withColumnRenamed("node", "id"), ["id"], "digest", how="left")
    # rows without shingles: each text digest and id on its own, so equal rows still share a class
    alone = F.xxhash64(F.lit("none"), "doc_id", "digest")
    return named.select("doc_id", "digest", F.coalesce("component", "id", alone).alias("class"))


def with_keepers(classes: DataFrame) -> DataFrame:
    """``classes`` with class_id (smallest doc_id of the class), class_size and kept (one row per class, by id then digest)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    sums = classes.groupBy("class").agg(first, F.count(F.lit(1)).alias("class_size"))
    out = salted_join(classes, sums, ["class"], "digest")
    kept = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    return out.select("doc_id", "digest", "class", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each class; the row with the smallest doc_id stays."""
    digest = row_digest(docs)
    keep = with_keepers(near_classes(docs, digest=digest)).where("kept").select(F.col("digest").alias("_digest")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), digest.alias("_digest"))
    return rows.join(keep, "_digest", "left_semi").dropDuplicates(["_digest"]).select("_doc.*")


@query("op9_near_dedup")
def op9_near_dedup(spark, sf_dir):
    """One row per document: its class (smallest doc_id in it), the size of the class and whether the document stays."""
    return with_keepers(near_classes(table(spark, sf_dir, "documents"))).select("doc_id", "class_id", "class_size", "kept")
