"""Spelling variants of words by permuterm rotations.

Every word is marked with a terminator (``$``) and rotated. Two words differ by one replaced letter if their rotations that end with that letter agree in all that stands before it: they share the
prefix that skips the edited letter. If a letter is inserted or deleted instead, that prefix is a whole rotation of the shorter word. So each word of L letters gives L prefixes, one per letter to
skip, and its L + 1 whole rotations. Spark deals these strings out by a hash and sorts each partition; equal strings lie side by side and one scan reads every neighbour off. A string holds one word at most
that it is a whole rotation of, and as many others as there are letters (``LETTERS``), whatever the size of the corpus: no group can grow, and two words meet in one group only. Where a letter is
repeated (``aab``), deleting any of its run gives the same word; only the first of the run counts.

Within a group the rows are sorted by count and word, so the best neighbour of a row is the first that is not itself; a row per word goes on, with the number of neighbours and the best, never a pair.

The words are counted in one pass with sums per slice, then added up. Roots follow the forms by pointer doubling; as every form is ten times as frequent as the word, chains are short.

Results for special rows: null and empty texts have no words. Texts of any length are read in runs that end at another sign than a letter; a run of letters stays whole. A null id counts as empty text in the hash. Repeated
rows count each. An empty table gives no rows. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import saved, slices, texts_of
from terraloom.llm.registry import query, table

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: Of the hashes of an id and a word, one in so many deletes a letter (the noise of the task).
NOISE = 31
RUN = 1_000_000
#: Distinct words that a task holds before it hands their sums on.
HELD = 300_000
#: Words whose rotations one task makes.
WORDS_PER_TASK = 50_000

_WORD = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LETTERS)
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_FOLD = {c: c + 32 for c in range(65, 91)}


def folded(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_FOLD)


def noisy_words(doc_id, text: str, noise: int = NOISE) -> Counter:
    """Counts of the words of one text; the hash of the id and a word may delete one of its letters (``noise`` 0: never)."""
    out, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    at = 0
    while at < len(text):
        end = None if len(text) - at <= RUN else _OTHER.search(text, at + RUN)
        stop = len(text) if end is None else end.start()
        for raw, n in Counter(_WORD.findall(text, at, stop)).items():
            word = folded(raw)
            if noise:
                h = zlib.crc32(word.encode(), start)
                if h % noise == 0:
                    cut = h % len(word)
                    word = word[:cut] + word[cut + 1:]
                    if len(word) < MIN_LETTERS:
                        continue
            out[word] += n
        at = stop
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n) of the words with at least MIN_LETTERS letters and MIN_COUNT occurrences."""

    def batch_of(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    def count(batches):
        sums: Counter = Counter()
        for b in batches:
            for s in slices(b, "text"):
                for i, text in zip(s.column(0).to_pylist(), texts_of(s)):
                    for word, n in noisy_words(i, text, noise).items():
                        sums[word] += n
                    if len(sums) > HELD:
                        yield batch_of(sums)
                        sums = Counter()
        if sums:
            yield batch_of(sums)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(key, role, word, n): role 0 for a whole rotation, 1 for one without its last letter, 2 if that letter is the first of its run."""
    skipped = """transform(sequence(1, length(word)), i -> struct(
        concat(substring(word, i + 1), '$', substring(word, 1, i - 1)) AS key,
        CASE WHEN i > 1 AND substring(word, i, 1) = substring(word, i - 1, 1) THEN 1Y ELSE 2Y END AS role))"""
    whole = "transform(sequence(0, length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i)) AS key, 0Y AS role))"
    return words.select("word", "n", F.explode(F.expr(f"concat({skipped}, {whole})")).alias("r")).select("r.key", "r.role", "word", "n")


def group_neighbours(key: pa.Array, role: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have a neighbour in their group, number of neighbours, row of the best); rows are sorted by key, count down and word."""
    m = len(role)
    new = np.ones(m, dtype=bool)
    if m > 1:
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, m - 1)).to_numpy(zero_copy_only=False)
    g = np.cumsum(new) - 1
    groups, none = int(g[-1]) + 1, m
    long, first_of_run, short = np.flatnonzero(role > 0), np.flatnonzero(role == 2), np.flatnonzero(role == 0)

    def leading(rows: np.ndarray) -> np.ndarray:
        out = np.full(groups, none)
        out[g[rows[::-1]]] = rows[::-1]
        return out

    best_long, best_deletable, whole = leading(long), leading(first_of_run), leading(short)
    second = np.full(groups, none)
    follows = np.flatnonzero(g[long[1:]] == g[long[:-1]]) + 1
    later = long[follows]
    second[g[later[::-1]]] = later[::-1]
    n_long, n_deletable = np.bincount(g[long], minlength=groups), np.bincount(g[first_of_run], minlength=groups)

    number, best = np.zeros(m, np.int64), np.full(m, none)
    gl = g[long]
    number[long] = n_long[gl] - 1
    best[long] = np.where(best_long[gl] != long, best_long[gl], second[gl])
    with_short = first_of_run[whole[g[first_of_run]] < none]
    number[with_short] += 1
    best[with_short] = np.minimum(best[with_short], whole[g[with_short]])
    number[short], best[short] = n_deletable[g[short]], best_deletable[g[short]]
    rows = np.flatnonzero(number > 0)
    return rows, number[rows], best[rows]


def _scan(batches):
    """Neighbours of sorted rotations; the last group of a batch waits for the next batch."""
    held = None
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        key = t.column("key").combine_chunks()
        same = pc.equal(key, key[len(key) - 1]).to_numpy(zero_copy_only=False)
        held = t.filter(pa.array(same))
        yield from _neighbours(t.slice(0, int(np.argmax(same))))
    if held is not None:
        yield from _neighbours(held)


def _neighbours(t: pa.Table):
    if t.num_rows < 2:
        return
    t = t.combine_chunks()
    word, n = t.column("word").combine_chunks(), t.column("n").to_numpy()
    rows, number, best = group_neighbours(t.column("key").combine_chunks(), t.column("role").to_numpy(), n)
    if len(rows):
        yield pa.RecordBatch.from_arrays([word.take(pa.array(rows)), pa.array(number), pa.array(n[best]), word.take(pa.array(best))], ["word", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a neighbour."""
    even = words.repartition(max(1, words.count() // WORDS_PER_TASK), "word")  # a word becomes some twenty rows
    dealt = rotations(even).repartition("key").sortWithinPartitions("key", F.desc("n"), "word")
    found = dealt.mapInArrow(_scan, "word string, near long, best_n long, best string")
    sums = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
    return sums.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms (word, form)."""
    at = saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = saved(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "forms")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    words = saved(word_counts(docs, id_col, text_col, noise), "words")
    found = words.join(neighbours(words), "word", "left")
    frequent = F.expr(f"best_n div {times} >= n")
    marked = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")), "marked")
    ends = roots(marked.where("form IS NOT NULL"))
    return marked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h FROM coded),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
keys AS (
  SELECT word, n, TRUE AS long, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
  UNION ALL
  SELECT word, n, FALSE, substr(word, 1, i) || '*' || substr(word, i + 1) FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word AND (a.long OR b.long)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM pairs GROUP BY word),
marked AS (
  SELECT w.word, CASE WHEN best_n >= 10 * w.n THEN best END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS last, 0 AS step FROM marked
  UNION ALL
  SELECT c.word, m.form, step + 1 FROM chain c JOIN marked m ON c.last = m.word WHERE m.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT m.word, m.form, e.root, m.n, m.n_near, m.form_n FROM marked m JOIN ends e ON m.word = e.word
"""


@query("op12_spelling_variants", sql=SQL)
def op12_spelling_variants(spark, sf_dir):
    """Contract query: words of at least 7 letters and 2 occurrences, forms at least ten times as frequent."""
    return variant_groups(table(spark, sf_dir, "documents"))
