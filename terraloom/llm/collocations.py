"""Collocations by stripes: every prefix keys an associative counter of the words that follow it.

A task reads its texts in slices and emits, for every prefix of k - 1 words, the words that follow it there with their counts: a stripe. Stripes of one prefix are merged element by element. A merged stripe
gives the counts of all extensions, the prefix's own total (words that cannot belong to a candidate are one nameless entry) and the largest extension, which is all that dropping covered phrases needs: among the
longer phrases around a phrase, one with a single word more has the largest count. A stripe travels as one row, its words as one text. The stripes of prefixes with more than 1 / ``HOT`` of all words, fewer than HOT, and of the
empty prefix are cut into parts by a hash of the following word, so that the stripe of a frequent prefix is spread over tasks.

Lengths are counted one after the other. A phrase of k words with MIN_COUNT occurrences consists of two phrases of k - 1 words that have as many, so at length k a prefix takes part only if it is among the phrases
counted before, and a following word only if the phrase that ends with it is. Tasks test this in a broadcast bitmap of phrase hashes, sized from the number of phrases and never above ``MAX_BITS`` bits (32 MB); a false
positive there costs a row that the count then removes. Counts are of the strings themselves and exact.

Results for special rows: null and empty texts have no words, a null language is ``und``. Texts of any length are read in runs that end between two words, each with the few words after it that its last phrases
need. Repeated rows count each. An empty table gives no rows. Only the text and language columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import byte_prefixes, in_bitmap, mix64, saved, slices, texts_of
from terraloom.llm.registry import query, table
from terraloom.runtime import salted_join

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A longer phrase covers a phrase if it has at least this share of its occurrences, in per cent.
COVER = 80
SCALE = 2_000_000
#: Parts of the stripe of a hot prefix, and of the empty prefix, which every word follows.
PARTS, FIRST_PARTS, HOT = 256, 4096, 512
MAX_BITS = 28
RUN = 2_000_000
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: 1 between words, 2 between pieces.
_GAP = np.zeros(256, dtype=np.uint8)
_GAP[[9, 32]] = 1
_GAP[[10, 11, 12, 13, *b".,;:!?"]] = 2
_SIGNS = r"\x20\x09-\x0D.,;:!?"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_AFTER = re.compile(r"(?:[%s]*[^%s]+){0,%d}" % (_SIGNS, _SIGNS, LONGEST - 1))


class Words:
    """The words of some texts: codes into a dictionary, piece and language of each, and whether phrases may start there."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        parts, owner, own = [], [], []
        for text, lang in zip(texts, langs):
            at = 0
            while True:
                end = _SPACE.search(text, at + RUN) if len(text) - at > RUN else None
                stop = len(text) if end is None else end.start()
                more = "" if end is None else text[stop: _AFTER.match(text, stop).end()]
                part = text[at:stop].encode("utf-8", "surrogatepass")
                own.append(len(part))
                parts.append(part + more.encode("utf-8", "surrogatepass"))
                owner.append(number[lang])
                at = stop
                if end is None:
                    break
        joined = b"\n".join([*parts, b""])
        raw = _FOLD[np.frombuffer(joined, dtype=np.uint8)]
        gap = _GAP[raw]
        inside = np.concatenate([[False], gap == 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[0::2], edges[1::2]
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        part_of = np.searchsorted(starts, first, "right") - 1
        self.piece = np.cumsum(gap == 2)[first] if len(first) else np.zeros(0, np.int64)
        self.lang = np.array(owner, np.int64)[part_of]
        self.starts = first - starts[part_of] < np.array(own, np.int64)[part_of]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw[gap == 0])).dictionary_encode()
        self.words, self.codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.tag = string_hashes(pa.array(self.langs, pa.string()))

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the phrase of ``size`` words from each word on, whether it lies in one piece)."""
        n = len(self.codes)
        h = phrase_start(self.tag)[self.lang] if n else np.zeros(0, np.uint64)
        word = string_hashes(self.words)[self.codes] if n else np.zeros(0, np.uint64)
        whole = np.arange(n) + size <= n
        whole[: n - size + 1] &= self.piece[: n - size + 1] == self.piece[size - 1:] if n >= size else False
        for k in range(size):
            h = phrase_step(h, np.append(word[k:], np.zeros(min(k, n), np.uint64)))
        return h, whole


def string_hashes(strings: pa.StringArray) -> np.ndarray:
    """64-bit hashes of an array of strings without nulls, by their bytes."""
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset: strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    prefix, inverse = byte_prefixes(raw)
    return mix64(mix64((prefix[offsets[1:]] - prefix[offsets[:-1]]) * inverse[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64))


def phrase_start(lang: np.ndarray) -> np.ndarray:
    return mix64(lang + np.uint64(1))


def phrase_step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(31) + word)


def slice_stripes(w: Words, size: int, alive: np.ndarray | None, hot: np.ndarray | None = None) -> pa.RecordBatch | None:
    """The stripes of one slice: rows (lang, prefix, part, words, counts); words are joined by spaces, the nameless entry is the empty word. ``hot`` holds hashes of prefixes to cut."""
    n, k = len(w.codes), size - 1
    if n == 0:
        return None
    width = len(w.words) + 1
    at = np.arange(n)
    if k == 0:
        at = at[w.starts]
        prefix, follow, parts = w.lang[at], w.codes[at], np.full(len(at), FIRST_PARTS)
    else:
        h, whole = w.hashes(k)
        ok = whole & in_bitmap(alive, h)
        at = at[ok & w.starts]
        then = at + k
        inside = then < n
        then = np.where(inside, then, 0)
        inside &= (w.piece[then] == w.piece[at]) & ok[np.minimum(at + 1, n - 1)]
        prefix = w.lang[at]
        for j in range(k):
            _, prefix = np.unique(prefix * width + w.codes[at + j], return_inverse=True)
        follow = np.where(inside, w.codes[then], -1)
        parts = np.where(np.isin(h[at], hot), PARTS, 1) if hot is not None and len(hot) else np.ones(len(at), np.int64)
    if len(at) == 0:
        return None
    _, one, count = np.unique(prefix * width + follow + 1, return_index=True, return_counts=True)
    prefix, follow, at, parts = prefix[one], follow[one], at[one], parts[one]
    spread = (string_hashes(w.words) >> np.uint64(8)).astype(np.int64)
    part = np.where(follow < 0, 0, spread[np.maximum(follow, 0)] % parts)
    order = np.lexsort((part, prefix))
    prefix, follow, at, part, count = prefix[order], follow[order], at[order], part[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]))
    names = [w.words.take(pa.array(w.codes[at[new] + j])) for j in range(k)]
    joined = pc.binary_join_element_wise(*names, " ") if k > 1 else names[0] if k else pa.array([""] * len(new), pa.string())
    offsets = pa.array(np.append(new, len(follow)), pa.int32())
    words = pc.fill_null(w.words.take(pa.array(np.maximum(follow, 0), mask=follow < 0)), "")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(w.langs, pa.string()).take(pa.array(w.lang[at[new]])), joined, pa.array(part[new], pa.int32()), pc.binary_join(pa.ListArray.from_arrays(offsets, words), " "),
            pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())),
        ],
        ["lang", "prefix", "part", "words", "counts"],
    )


def merged_stripes(docs: DataFrame, size: int, alive=None, hot: np.ndarray | None = None, least: int = MIN_COUNT) -> DataFrame:
    """(lang, prefix, part, total, extensions): total over all entries of the part, extensions (word, c) with at least ``least`` occurrences."""

    def emit(batches):
        bits = None if alive is None else alive.value
        for b in batches:
            for s in slices(b, "text"):
                made = slice_stripes(Words(texts_of(s), s.column(1).to_pylist()), size, bits, hot)
                if made is not None:
                    yield made

    stripes = docs.mapInArrow(emit, "lang string, prefix string, part int, words string, counts array<int>").repartition("lang", "prefix", "part")
    entries = stripes.select("lang", "prefix", "part", F.explode(F.arrays_zip(F.split("words", " ", -1).alias("word"), F.col("counts").alias("n"))).alias("e"))
    entries = entries.groupBy("lang", "prefix", "part", F.col("e.word").alias("word")).agg(F.sum(F.col("e.n").cast("long")).alias("c"))
    frequent = F.when((F.col("c") >= least) & (F.col("word") != ""), F.struct("word", "c"))
    return entries.groupBy("lang", "prefix", "part").agg(F.sum("c").alias("total"), F.collect_list(frequent).alias("extensions"))


def hot_prefixes(phrases: DataFrame, size: int, words: int) -> np.ndarray:
    """Hashes of the phrases (lang, phrase, c) with more than 1 / HOT of all ``words``: fewer than HOT, as a word starts one phrase of a length at most."""
    rows = phrases.where(F.col("c") * HOT > words).select("lang", "phrase").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    return phrase_hashes(pa.array([r["lang"] for r in rows], pa.string()), pa.array([r["phrase"] for r in rows], pa.string()), size)


def phrase_hashes(langs: pa.StringArray, phrases: pa.StringArray, size: int) -> np.ndarray:
    """The hashes that ``Words.hashes`` gives, of phrases of ``size`` words joined by spaces."""
    h = phrase_start(string_hashes(langs))
    if len(h):
        word = string_hashes(pc.split_pattern(phrases, " ").flatten()).reshape(-1, size)
        for k in range(size):
            h = phrase_step(h, word[:, k])
    return h


def phrases_of(stripes: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, c, tail): the extensions of merged stripes as phrases; the tail is the phrase without its first word."""
    phrase = F.concat_ws(" ", "prefix", "e.word") if size > 1 else F.col("e.word")
    tail = F.substring_index("phrase", " ", 1 - size) if size > 1 else F.lit("")
    return stripes.select("lang", "prefix", F.explode("extensions").alias("e")).select("lang", "prefix", phrase.alias("phrase"), F.col("e.c").alias("c")).withColumn("tail", tail)


def phrase_bitmap(phrases: DataFrame, size: int):
    """Broadcast bitmap of the hashes of all phrases (lang, phrase) of ``size`` words."""
    spark = phrases.sparkSession
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(16 * phrases.count() + 1))))

    def hashed(batches):
        for b in batches:
            h = phrase_hashes(b.column(0), b.column(1), size)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64((1 << bits) - 1)).astype(np.int64))], ["slot"])

    slots = phrases.select("lang", "phrase").mapInArrow(hashed, "slot long")
    packed = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return spark.sparkContext.broadcast(out.view(np.uint8))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``top`` phrases of every language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    stripes, phrases, alive, hot, words = {}, {}, None, None, 0
    for size in range(1, LONGEST + 1):
        stripes[size] = saved(merged_stripes(rows, size, alive, hot, least), f"stripes{size}")
        phrases[size] = phrases_of(stripes[size], size)
        words = words or stripes[size].agg(F.sum("total")).first()[0] or 0
        if size < LONGEST:
            alive = phrase_bitmap(phrases[size], size)
            hot = hot_prefixes(phrases[size], size, words)

    # all phrases with their counts; those of two words and more are candidates
    def union(frames):
        frames = list(frames)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    counted = saved(union(p.select("lang", "phrase", "c") for p in phrases.values()), "phrases")
    candidates = union(phrases[k].select("lang", "phrase", F.col("c").alias("a"), F.lit(k).alias("k")) for k in range(2, LONGEST + 1))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "k")
    cuts = saved(cuts.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest")), "cuts")
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = salted_join(cuts, counted.select("lang", F.col("phrase").alias(side), F.col("c").alias(name)), ["lang", side], "phrase")
        if name == "l":
            cuts = saved(cuts, "cuts")
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {SCALE}) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))").alias("score")
    scored = cuts.select("lang", "phrase", "a", "cut", "l", "r", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    # the largest count of a phrase with one word more: to the right from its own stripe, to the left from the stripes of that
    right = union(stripes[k].select("lang", F.col("prefix").alias("phrase"), F.array_max(F.expr("transform(extensions, e -> e.c)")).alias("more")) for k in range(3, LONGEST + 1))
    left = union(phrases[k].select("lang", F.col("tail").alias("phrase"), F.col("c").alias("more")) for k in range(3, LONGEST + 1))
    longer = right.where("more IS NOT NULL").unionByName(left).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    covered = F.expr(f"coalesce(cast(more AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {COVER}, false)")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~covered)
    totals = stripes[1].groupBy("lang").agg(F.sum("total").alias("n"))
    ranked = best_rows(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def best_rows(rows: DataFrame, group: str, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group with their rank.

    Rows are dealt out by ranges of (group, order), so a large group is spread over tasks; each range counts its rows of a group and starts from the counts of the ranges before it.
    """
    ranged = saved(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_part", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")).where(F.col("_first") < top)
    inside = Window.partitionBy("_part", group).orderBy(*order)
    ranked = ranged.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top).join(starts, ["_part", group])
    return ranked.withColumn("rank", F.col("rank") + F.col("_first")).where(F.col("rank") <= top).drop("_part", "_first")


SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE f >= 30),
candidates AS (SELECT * FROM frequent WHERE k > 1),
cuts AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM candidates), (SELECT unnest([2, 3]) AS s) WHERE s < k AND i + s - 1 <= k),
longer AS (SELECT lang, phrase, max(a) AS more FROM inside GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.more IS NULL OR 100::HUGEINT * x.more < 80::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


@query("op13_collocations", sql=SQL)
def op13_collocations(spark, sf_dir):
    """Contract query: phrases of 2 to 4 words with 30 occurrences, the best 2000 of each language."""
    return collocations(table(spark, sf_dir, "documents"))
