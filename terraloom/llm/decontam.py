"""Benchmark decontamination by the q-gram lemma on diagonal bands, verified by banded alignment.

Texts are compared as lower-case characters with runs of white space as one space. Benchmark items are cut into overlapping windows of ``WINDOW``
characters (a shorter item is one window), so a passage longer than a window and a step is caught wherever it lies in an item. A window occurs in a document if
some stretch of the document aligns with it within ``ERRORS`` of its length. By the q-gram lemma such a stretch shares at least m + 1 - q - q * k of the window's q-grams,
all within k diagonals. So a task looks up the q-grams of its texts, drops stretches with too few hits, counts hits per window in overlapping diagonal bands of width 2k + 1 or more, and aligns
only the bands that reach the bound, by dynamic programming over the band.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each of which meets all documents, so memory is bounded whatever its size and no document is paired with an item without need.

Null and empty texts and items match nothing; items shorter than ``SHORTEST`` characters are too common to tell and match nothing; equal rows get equal results; null ids are ordinary.
Empty tables give no hits. Rows keep all their columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import prefix_sums, saved, slices, whole_text
from terraloom.llm.registry import query, table

Q = 8
WINDOW = 100
STEP = 25
ERRORS = 0.08
SHORTEST = 24
BLOCK_CHARS = 2_000_000
#: Slots of the first lookup, one bit of information each.
SLOTS = 1 << 22

_FOLD = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and len(_low := chr(_c).lower()) == 1:
        _FOLD[_c] = ord(_low)
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[0] = 1  # code point 0 separates texts


def normal_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, starts): folded code points of all texts, each preceded by a 0, where each came from, and where the texts start."""
    raw = np.frombuffer(("\0" + "\0".join([*texts, ""])).encode("utf-32-le", "surrogatepass"), dtype="<u4") if texts else np.zeros(0, "<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    codes = np.where(raw < 0x10000, _FOLD[np.minimum(raw, 0xFFFF)], raw)
    codes[starts - 1] = 0
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == 32) & (codes[:-1] == 32)
    places = np.flatnonzero(~again)
    return codes[places], places, starts


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q code points from each position on (Q = 8: three doublings)."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    while width < Q:
        h = h[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
        width *= 2
    return h ^ (h >> np.uint64(29))


class Block:
    """The windows of some benchmark items with an index of their q-grams; lives in a broadcast."""

    def __init__(self, items: list[tuple[int, str]]):
        codes, _, starts = normal_codes([t for _, t in items])
        ends = np.flatnonzero(codes == 0)
        self.codes, first, size, item = codes, [], [], []
        for i, (a, b) in enumerate(zip(ends[:-1] + 1, ends[1:])):
            while b > a and codes[b - 1] == 32:
                b -= 1
            while a < b and codes[a] == 32:
                a += 1
            if b - a < SHORTEST:
                continue
            at = list(range(a, max(b - WINDOW, a) + 1, STEP))
            if b - a > WINDOW and at[-1] != b - WINDOW:
                at.append(b - WINDOW)
            first += at
            size += [min(WINDOW, b - x) for x in at]
            item += [items[i][0]] * len(at)
        self.first, self.size, self.item = np.array(first, np.int64), np.array(size, np.int64), np.array(item, np.int64)
        self.budget = (self.size * ERRORS).astype(np.int64)
        self.need = np.maximum(self.size + 1 - Q - Q * self.budget, 1)
        counts = self.size - Q + 1
        window = np.repeat(np.arange(len(self.size)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        grams = gram_hashes(codes)[self.first[window] + offset] if len(window) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.start = np.unique(grams[order], return_index=True)
        self.stop = np.append(self.start[1:], len(grams))
        self.window, self.offset = window[order], offset[order]
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.grams & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def hits(self, texts: list[str]):
        """(text, item, start, end, errors) arrays of verified occurrences; positions are code points of the text."""
        codes, places, starts = normal_codes(texts)
        if not len(self.grams) or len(codes) < Q:
            return [np.zeros(0, np.int64)] * 5
        grams = gram_hashes(codes)
        found = self.slots[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
        # a stretch as long as the longest window and its budget must hold the least number of hits any window needs
        width, least = int((self.size + self.budget).max()), int(self.need.min())
        total = np.concatenate([[0], np.cumsum(found)])
        dense = total[np.minimum(np.arange(len(found)) + width, len(found))] - total[:-1] >= least
        reach = np.zeros(len(found) + 1, np.int64)
        begin = np.flatnonzero(dense)
        np.add.at(reach, begin, 1)
        np.add.at(reach, np.minimum(begin + width, len(found)), -1)
        at = np.flatnonzero(found & (np.cumsum(reach)[:-1] > 0))
        k = np.searchsorted(self.grams, grams[at])
        k[k == len(self.grams)] = 0
        real = self.grams[k] == grams[at]
        at, k = at[real], k[real]
        n = self.stop[k] - self.start[k]
        entry = np.repeat(self.start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pos, window = np.repeat(at, n), self.window[entry]
        diagonal = pos - self.offset[entry] + WINDOW
        # bands of width 4k + 2 at every 2k + 1 diagonals hold every run of 2k + 1 diagonals
        band_step = int(2 * self.budget.max() + 1)
        low = diagonal // band_step
        key = np.concatenate([low, low - 1]) * np.int64(len(self.size)) + np.concatenate([window, window])
        key, count = np.unique(key, return_counts=True)
        keep = count >= self.need[key % len(self.size)]
        return self.aligned(codes, places, starts, key[keep] % len(self.size), (key[keep] // len(self.size)) * band_step - WINDOW, 2 * band_step)

    def aligned(self, codes, places, starts, window, diagonal, band):
        """Banded alignment of windows with the text on diagonals [diagonal - k, diagonal + band + k); all candidates advance together."""
        out = []
        k = int(self.budget.max())
        width = band + 2 * k
        padded = np.concatenate([np.zeros(WINDOW + width, codes.dtype), codes, np.zeros(2 * WINDOW + 2 * width, codes.dtype)])
        for part in np.array_split(np.arange(len(window)), max(1, len(window) // 4096)):
            w, d = window[part], diagonal[part] - k
            cost = np.zeros((len(w), width), np.int16)  # free start in the text
            begin = np.broadcast_to(np.arange(width), cost.shape).copy()
            best, best_end, best_begin = np.full(len(w), 32000, np.int16), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            slide = np.arange(width)
            for row in range(int(self.size[w].max()) if len(w) else 0):
                live = row < self.size[w]
                symbol = self.codes[np.minimum(self.first[w] + row, len(self.codes) - 1)]
                text = padded[(d + row + WINDOW + width)[:, None] + slide[None, :]]
                # cell j is text position d + row + j; its diagonal neighbour is cell j of the row above, the cell above it is j + 1
                swap = cost + ((text != symbol[:, None]) | (text == 0))
                skip = np.full_like(cost, 32000)
                skip[:, :-1] = cost[:, 1:] + 1
                new, came = np.minimum(swap, skip), begin.copy()
                up = skip < swap
                came[:, :-1] = np.where(up[:, :-1], begin[:, 1:], begin[:, :-1])
                run = np.minimum.accumulate(new - slide, axis=1) + slide  # extra characters of the text
                source = np.maximum.accumulate(np.where(new <= run, slide, 0), axis=1)
                came = np.take_along_axis(came, source, 1)
                cost, begin = np.where(live[:, None], run.astype(np.int16), cost), np.where(live[:, None], came, begin)
                done = self.size[w] == row + 1
                if done.any():
                    j = cost[done].argmin(axis=1)
                    best[done] = cost[done, j]
                    best_end[done] = d[done] + row + j
                    best_begin[done] = d[done] + begin[done, j]
            good = best <= self.budget[w]
            last = np.clip(best_end[good], 0, len(places) - 1)
            first = np.clip(best_begin[good], 0, len(places) - 1)
            text = np.searchsorted(starts, places[last], "right") - 1
            first = np.maximum(places[first], starts[text])
            out.append([text, self.item[w[good]], first - starts[text], places[last] + 1 - starts[text], best[good].astype(np.int64)])
        return [np.concatenate(x) for x in zip(*out)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Broadcast indexes of the benchmark, each over items of at most BLOCK_CHARS characters (or one longer piece).

    Long items are cut into pieces that overlap by a window, so a block is bounded whatever the item.
    """
    piece, text = BLOCK_CHARS // 4, whole_text(text_col)
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), text.alias("text"))
    items = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(piece))))
    items = items.select("item", F.substring(F.col("text"), F.col("at") + 1, F.lit(piece + 2 * WINDOW)).alias("text")).withColumn("n", F.length("text"))
    numbered = saved(prefix_sums(items, [F.xxhash64("item", "text")], ["n"]).withColumn("block", F.floor(F.col("before_n") / BLOCK_CHARS)), "benchmark")
    for block in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
        rows = numbered.where(F.col("block") == block).select("item", "text").collect()  # bounded by BLOCK_CHARS
        yield numbered.sparkSession.sparkContext.broadcast(Block([(r["item"], r["text"]) for r in rows if r["item"] is not None]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, errors): for every document and item the occurrence of a window with the fewest errors, and the extent of all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = None
    for block in blocks(benchmark):

        def search(batches, block=block):
            for b in batches:
                for part in slices(b):
                    text, item, start, end, errors = block.value.hits(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(text, pa.int64())), pa.array(text, pa.int64()), *(pa.array(x, pa.int64()) for x in (item, start, end, errors))],
                        ["doc_id", "row", "item_id", "start", "end", "errors"],
                    )

        hits = rows.mapInArrow(search, f"doc_id {kind}, row long, item_id long, start long, end long, errors long")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("errors").alias("errors"), F.count(F.lit(1)).alias("windows")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; every block passes over what the earlier ones left."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark):

        def clean(batches, block=block):
            for b in batches:
                for part in slices(b, text_col):
                    text = block.value.hits([t or "" for t in part.column(at).to_pylist()])[0]
                    keep = np.ones(part.num_rows, bool)
                    keep[text] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, T.StructType(docs.schema.fields))
    return docs


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    """One row per document and benchmark item that occurs in it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
