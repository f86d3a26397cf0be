"""Quality by a character model: interpolated modified Kneser-Ney, perplexity per document, thresholds per language.

Trusted texts (labelled good and not toxic) train one model of order 4 over all their characters and the ends of texts. Characters have numbers by frequency: 0 is the end of a text, 1 an unseen
character, 2 to 63 are the common ones, the rest is rare. Without context, common characters are equally likely, and a 64th is divided among rare and unseen ones by their counts (Witten-Bell), so every code
point has its own probability. All n-grams of all trusted texts are counted. Count tables are Spark tables, sharded by n-gram: joins with the context totals and the continuation counts give every seen
n-gram its interpolated probability, and every context the mass it leaves to the shorter one. N-grams of common characters have at most 64**4 probabilities, a table of 32 MB of half floats; those with a
rare character are looked up in sorted arrays of some 20 bytes for each n-gram seen. Both are broadcast and one pass scores every text. The arrays grow with the n-grams of rare characters in trusted
texts: few where 62 characters make up nearly all text, but many in scripts of thousands of characters, where they must fit the driver and each worker.

The score is the perplexity per character, drawn to the trusted mean of the language by ``PRIOR`` characters, so that a few odd characters in
a short text weigh little. A language's threshold is a quantile of its trusted documents times a margin; a language without trusted documents uses
all trusted documents. A document is kept unless its perplexity is above the threshold.

Null and empty texts have no characters: their score is the prior mean, so they are kept. Null languages form a language. Equal rows get equal scores, labels
of one document are combined (it is trusted if no label speaks against it). Empty tables give empty results; without trusted documents everything is kept.
Rows keep all their columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import bitmap, in_bitmap, let_go, saved, slices, texts_of, whole_text
from terraloom.llm.registry import query, table

ORDER = 4
SYMBOLS = 64
EDGE, OTHER = 0, 1
#: Bits of a character's number in an n-gram; an n-gram is its context, a long, and its last character.
WIDTH = 21
PRIOR = 300
#: Bytes of text handled at once; arrays of a slice take some fifty times as much.
SLICE = 1_000_000
QUANTILE = 0.99
MARGIN = 1.2


def _symbols(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the characters of all texts with ORDER edges between them, where each text starts, and the code points; code point 0 is the edge symbol."""
    pad = "\0" * ORDER
    joined = np.frombuffer((pad + "".join(t + pad for t in texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = classes[np.minimum(joined, len(classes) - 1)]
    return symbols, ORDER + np.concatenate([[0], np.cumsum([len(t) + ORDER for t in texts])]).astype(np.int64), joined


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Index of the ORDER symbols that end at each position, rare characters counting as unseen ones; the first ORDER - 1 positions have none."""
    s = np.where(symbols < SYMBOLS, symbols, OTHER).astype(np.int32)
    out = s[ORDER - 1:].copy()
    for k in range(1, ORDER):
        out += s[ORDER - 1 - k: len(s) - k] << np.int32(6 * k)
    return out


def _rare(symbols: np.ndarray) -> np.ndarray:
    """Mask over _grams of those with a rare character."""
    rare = np.cumsum(np.concatenate([[0], symbols >= SYMBOLS]))
    return rare[ORDER:] > rare[:-ORDER]


def _contexts(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER - 1 characters before the last one of the grams ``at`` as one integer."""
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER - 1):
        out = (out << WIDTH) | symbols[at + k]
    return out


def _rows(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mask over _grams of the predictions inside the texts: each character and the closing edge."""
    mask = np.zeros(len(symbols) - ORDER + 1, dtype=bool)
    edge = np.zeros(len(mask) + 1, np.int64)
    first = starts[:-1] - (ORDER - 1)
    last = starts[1:] - (ORDER - 1) - (ORDER - 1)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    mask[:] = np.cumsum(edge)[:-1] > 0
    return mask


def _character_classes(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Number of every code point by its frequency in the trusted texts, OTHER for unseen ones; and ln of each code point's share of the 64th that common characters leave."""

    def count(batches):
        let_go()
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for part in slices(b, limit=SLICE):
                total += np.bincount(np.frombuffer("".join(texts_of(part)).encode("utf-32-le", "surrogatepass"), "<u4"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["c", "n"])

    counts = texts.select("text").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    found = counts.where("c > 0").toArrow()  # a row per code point at most
    code, n = found.column("c").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((code, -n))
    top, rest = code[order[: SYMBOLS - 2]], order[SYMBOLS - 2:]
    classes = np.full(0x110000 if len(code) and code.max() > 0xFFFF else 0x10001, OTHER, np.int32)
    classes[code[order]] = np.arange(2, 2 + len(code), dtype=np.int32)
    classes[0] = EDGE
    known, total = len(rest), int(n[rest].sum())
    unseen = 0x110000 - 1 - len(top) - known
    share = np.full(0x110000, np.log(max(known, 1) / ((total + max(known, 1)) * unseen)), np.float32)
    share[code[rest]] = np.log(n[rest] / (total + known))
    share[top] = share[0] = 0.0
    return classes, share


def ngram_counts(texts: DataFrame, classes) -> DataFrame:
    """(context, symbol, n) of order 4 over all texts; a task adds up its n-grams of common characters in one array before anything is shuffled."""

    def count(batches):
        let_go()
        total = np.zeros(SYMBOLS**ORDER, np.int32)
        rows = lambda c, s, n: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int64())], ["context", "symbol", "n"])
        for b in batches:
            for part in slices(b, limit=SLICE):
                symbols, starts, _ = _symbols(texts_of(part), classes.value[0])
                use, rare = _rows(symbols, starts), _rare(symbols)
                grams, n = np.unique(_grams(symbols)[use & ~rare], return_counts=True)
                total[grams] += n.astype(np.int32)
                at = np.flatnonzero(use & rare)
                found, n = np.unique(np.stack([_contexts(symbols, at), symbols[at + ORDER - 1].astype(np.int64)]), axis=1, return_counts=True)
                yield rows(found[0], found[1].astype(np.int32), n)
        at = np.flatnonzero(total)
        digit = lambda k: (at >> 6 * k) & (SYMBOLS - 1)
        context = np.zeros(len(at), np.int64)
        for k in range(ORDER - 1, 0, -1):
            context = (context << WIDTH) | digit(k)
        yield rows(context, digit(0).astype(np.int32), total[at])

    return texts.select("text").mapInArrow(count, "context long, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Tables (context, symbol, alpha, gamma) for orders 1 to ORDER, as joins of the sharded counts.

    alpha is the discounted share of a seen n-gram, gamma the mass its context leaves to the shorter context. Below the highest order the counts are
    the numbers of distinct symbols seen before the n-gram (continuation counts). Discounts follow Chen and Goodman from the counts of counts.
    """
    levels, now = [], counts
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # drop the first symbol: one per distinct longer n-gram
            shorter = F.col("context").bitwiseAND(F.lit((1 << WIDTH * (order - 1)) - 1).cast("long")).alias("context")
            now = saved(now.groupBy(shorter, "symbol").agg(F.count(F.lit(1)).alias("n")), "counts")
        spectrum = {r["n"]: r["k"] for r in now.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
        n1, n2, n3, n4 = (max(spectrum.get(i, 0), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        grams = now.select("context", "symbol", F.col("n").cast("double").alias("n"), discount.alias("d"))
        contexts = grams.groupBy("context").agg(F.sum("n").alias("all"), F.sum("d").alias("left"))
        levels.append(grams.join(contexts, "context").select("context", "symbol", ((F.col("n") - F.col("d")) / F.col("all")).alias("alpha"), (F.col("left") / F.col("all")).alias("gamma")))
    return levels[::-1]


def _common(order: int):
    """Condition that an n-gram's context has no rare character."""
    rare = sum(((1 << WIDTH) - SYMBOLS) << WIDTH * k for k in range(order - 1))
    return F.col("context").bitwiseAND(F.lit(rare).cast("long")) == 0


def dense_model(levels: list[DataFrame]) -> np.ndarray:
    """Natural log probability of every n-gram of the highest order without rare characters, unseen ones included."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS, np.float32)  # order 0: uniform
    for order, level in enumerate(levels, 1):
        packed = sum(((F.shiftright("context", WIDTH * k)).bitwiseAND(F.lit(SYMBOLS - 1).cast("long")) * SYMBOLS**k for k in range(order - 1)), F.lit(0).cast("long")).cast("int")
        level = level.where(_common(order)).withColumn("packed", packed)
        # at most 64**order rows of a fixed symbol set; a context that only rare characters follow leaves mass as well
        rows = level.where(f"symbol < {SYMBOLS}").select((F.col("packed") * SYMBOLS + F.col("symbol")).alias("gram"), "alpha").toArrow()
        left = level.groupBy("packed").agg(F.first("gamma").alias("gamma")).toArrow()
        gamma = np.ones(SYMBOLS ** (order - 1), np.float32)
        gamma[left.column("packed").to_numpy()] = left.column("gamma").to_numpy()
        # p of the shorter context, for each first symbol of the context; in place, as the last one has 64**4 entries
        p = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order > 1 else 1, 1))
        p *= gamma[:, None]
        p = p.ravel()
        p[rows.column("gram").to_numpy()] += rows.column("alpha").to_numpy().astype(np.float32)
    return np.log(p, out=p).astype(np.float16)


def sparse_model(levels: list[DataFrame]) -> list[tuple]:
    """Per order (contexts, their gamma, n-grams as position of the context and symbol, their alpha), sorted: all n-grams but those of the highest order without rare characters."""
    out = []
    for order, level in enumerate(levels, 1):
        rows = (level if order < ORDER else level.where(~_common(order) | (F.col("symbol") >= SYMBOLS))).toArrow()
        context, first, at = np.unique(rows.column("context").to_numpy(), return_index=True, return_inverse=True)
        gram = (at.astype(np.int64) << WIDTH) | rows.column("symbol").to_numpy()
        by = np.argsort(gram)
        out.append((context, rows.column("gamma").to_numpy()[first].astype(np.float32), gram[by], rows.column("alpha").to_numpy()[by].astype(np.float32)))
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def sparse_logs(model: list[tuple], context: np.ndarray, symbol: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Natural log probabilities of n-grams with a rare character. ``share`` is the ln of the last character's share of its symbol."""
    p = np.exp(share.astype(np.float64)) / SYMBOLS
    for order, (contexts, gammas, grams, alphas) in enumerate(model, 1):
        at, known = _found(contexts, context & ((1 << WIDTH * (order - 1)) - 1))
        gram, seen = _found(grams, (at.astype(np.int64) << WIDTH) | symbol)
        if len(contexts):
            p = np.where(known, gammas[at] * p, p)
            p[known & seen] += alphas[gram[known & seen]]
    return np.log(p)


def learned(texts: DataFrame) -> tuple:
    """Broadcast character numbers, with the shares of the code points, and tables of the orders from a table of trusted texts (text)."""
    classes = texts.sparkSession.sparkContext.broadcast(_character_classes(texts))
    return classes, [saved(x, "level") for x in kneser_ney(saved(ngram_counts(texts, classes), "counts"))]


def fit(texts: DataFrame) -> tuple:
    """Broadcast character numbers and log probabilities of n-grams without rare characters from a table of trusted texts (text)."""
    classes, levels = learned(texts)
    return classes, texts.sparkSession.sparkContext.broadcast(dense_model(levels))


def fit_all(texts: DataFrame) -> tuple:
    """``fit`` and the model of n-grams with rare characters."""
    sc = texts.sparkSession.sparkContext
    classes, levels = learned(texts)
    return classes, sc.broadcast(dense_model(levels)), sc.broadcast(sparse_model(levels))


def scored(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """``docs`` with _nll (total -ln p of characters and end) and _chars (number of predictions). A model of ``fit`` takes rare characters for unseen ones, one of ``fit_all`` knows their n-grams."""
    classes, logp, *rare = model
    at = docs.columns.index(text_col)

    def score(batches):
        let_go()
        for b in batches:
            for part in slices(b, text_col, SLICE):
                symbols, starts, codes = _symbols([t or "" for t in part.column(at).to_pylist()], classes.value[0])
                share = classes.value[1][codes[ORDER - 1:]]
                logs = logp.value[_grams(symbols)] + share
                if rare:
                    odd = np.flatnonzero(_rare(symbols))
                    logs[odd] = sparse_logs(rare[0].value, _contexts(symbols, odd), symbols[odd + ORDER - 1], share[odd])
                nll = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
                first, last = starts[:-1] - (ORDER - 1), starts[1:] - 2 * (ORDER - 1)
                extra = [pa.array(nll[first] - nll[last], pa.float64()), pa.array(last - first, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "_nll", "_chars"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_nll", T.DoubleType()), T.StructField("_chars", T.LongType())])
    return docs.mapInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("doc_id is not null and q = 1 and t = 0").select("doc_id")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, lang, text) whose id is in ``ids``; a bitmap keeps most others out of the join's shuffle."""
    packed = bitmap(ids.select(F.xxhash64("doc_id").alias("key")), "key")

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(packed.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    some = docs.select(F.xxhash64("doc_id").alias("key"), *docs.columns)
    some = some.mapInArrow(pick, some.schema).drop("key")
    return some.join(ids.hint("merge"), "doc_id", "left_semi")  # ids grow with the data, so they are not broadcast


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _lang, _text, perplexity, threshold, keep, ...) with all columns of ``docs`` packed in _doc."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    field = lambda c: F.col("_doc").getField(c)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), whole_text(text_col).alias("text"))
    trusted = saved(_texts_of(slim, trusted_ids(labels)), "trusted")
    if trusted.isEmpty():
        return packed.select("_doc", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    model = fit_all(trusted)
    seen = saved(scored(trusted.select("lang", "text"), model).select("lang", "_nll", "_chars"), "seen")
    means = seen.groupBy("lang").agg(F.sum("_nll").alias("a"), F.sum("_chars").alias("b")).collect()  # one row per language
    overall = sum(r["a"] for r in means) / sum(r["b"] for r in means)
    mean = F.coalesce(F.create_map(*[F.lit(x) for r in means for x in (r["lang"], r["a"] / r["b"])])[F.col("_lang")], F.lit(overall))

    def perplexity(nll, chars):
        return F.exp((nll + F.lit(PRIOR) * mean) / (chars + F.lit(PRIOR)))

    ppl = seen.withColumn("_lang", F.col("lang")).select("lang", perplexity(F.col("_nll"), F.col("_chars")).alias("p"))
    level = F.expr(f"percentile(p, {QUANTILE})") * F.lit(MARGIN)
    cuts = ppl.groupBy("lang").agg(level.alias("t")).collect()
    pooled = ppl.agg(level.alias("t")).first()["t"]
    cut = F.coalesce(F.create_map(*[F.lit(x) for r in cuts for x in (r["lang"], r["t"])])[F.col("_lang")], F.lit(pooled))
    rows = packed.select("_doc", F.coalesce(field(lang_col).cast("string"), F.lit("")).alias("_lang"), F.coalesce(field(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = scored(rows, model, "_text").select("_doc", "_lang", perplexity(F.col("_nll"), F.col("_chars")).alias("perplexity"))
    rows = rows.withColumn("threshold", cut)
    return rows.select("_doc", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is within the threshold of its language."""
    return judged(docs, labels).where("keep").select("_doc.*")


@query("op3_quality")
def op3_quality(spark, sf_dir):
    """Every document with its perplexity, the threshold of its language and the decision."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.lang").alias("lang"), "perplexity", "threshold", "keep")
