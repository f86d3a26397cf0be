"""Language-model scores by logistic mixing of hashed-context bit predictors.

Texts are sequences of lower-case words and one end, and every token is scored in its place. A token is coded bit by bit on its way through a Huffman tree over the training counts, whose leaves
are the frequent training words (two occurrences and 1 / ``CODED`` of the training tokens at least), the end, and one leaf for all other words. Three predictors see the bits decided so far
and no word, the last word, and the last two words before the token; words are hashed whole, so rare and unknown ones are contexts too. A text starts after an end.
Another word is then spelled: bit by bit as its bytes and a closing space, by five predictors that see its last 1, 2, 3 and 4 bytes and all of it so far. A
word that training documents do not have is one escape there, like the one unknown word of the base score's V + 1, trained with as many occurrences as words seen once (each was unknown
when it came). Spelling contexts end at the word, so each distinct word is spelled once and its score is joined to its places.

Each predictor keeps, per hashed context and bit position, how often the next
bit was 0 or 1 in the training documents, which is the state an adaptive counter with rate 1 / n reaches. The predictions are combined in the logistic domain with weights that a
gate selects by how much the contexts have seen (for spelling also by bit position). The weights are learned online: every task passes over its share of the training
tokens (or words) in small steps, with a token's own occurrence taken out of the counters, and the tasks' weights are averaged.

``score`` is the sum of these log10 probabilities.
``bits`` also pays for the bytes of unknown words after their escapes: the total bits of the text. Base counts and spelled scores reach the documents in two ways: words with at least
1 / 2**20 of all tokens (at most 2**20 of them) are broadcast, all others are joined; the end is added to every document. The word contexts have four slots per training token, up to 2**``MOST_SLOTS`` a predictor;
the spelling contexts have a fixed number, so the model is bounded whatever the corpus; all training documents are counted.

Null texts are empty: one end token. A null id counts as the text "". Equal rows are scored each for itself. Without training documents the counters hold the escape alone. Empty tables give no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import array_hashes, mix64, saved, slices, whole_text
from terraloom.llm.registry import query, table

#: log2 of the slots per predictor: the last 1, 2, 3, 4 bytes and the whole word so far.
BITS = (16, 18, 19, 20, 21)
CONTEXTS = len(BITS)
FIRST = np.cumsum([0, *(1 << b for b in BITS)])
GATES = 8 * 4 * 4
ROUNDS = 2
#: Tasks that count and train; each holds one set of counters.
MODEL_TASKS = 12
HEAVY = 1 << 20
END, ESCAPE = "\n", "\x0b"  # white space, so never words
WORDS_AT_ONCE = 30_000
#: Least share of the training tokens, as 1 / CODED, of a word with a leaf of its own; at most as many leaves.
CODED = 1 << 20
#: log2 of the most slots of a predictor of word contexts.
MOST_SLOTS = 22
TEXT_CONTEXTS, TEXT_GATES = 3, 4 * 4 * 4
#: Tokens from one learning step to the next.
TOKENS_AT_ONCE = 1 << 16
#: Tokens (bytes of words when spelling) whose bits are handled together: their arrays stay in a core's cache.
PIECE = 1 << 14
#: Slots whose counts travel together.
BLOCK = 1 << 16
END_HASH, START_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
NAMES = ["row", "doc_id", "train", "word", "n", "known", "base", "lp", "bits", "bytes"]


class Packed:
    """An array compressed for a broadcast; each worker process unpacks it once."""

    def __init__(self, array: np.ndarray):
        import zstandard

        self.shape, self.kind = array.shape, array.dtype.str
        self.data = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())

    @property
    def array(self) -> np.ndarray:
        import zstandard

        if "_array" not in self.__dict__:
            self._array = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data), self.kind).reshape(self.shape).copy()  # in large pages, which numpy asks for
            self.data = b""
        return self._array

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_array"}


class Tallies:
    """Counts (2, slots) of zeros and ones as one code per slot, and what each code predicts when its own occurrence is taken out."""

    def __init__(self, counts: np.ndarray):
        small = (counts < 256).all(axis=0)
        code = np.minimum(counts[0], 255) * 256 + np.minimum(counts[1], 255)
        large, where = np.unique(counts[0, ~small].astype(np.int64) << 32 | counts[1, ~small], return_inverse=True)
        code[~small] = 65536 + where
        zeros = np.concatenate([np.arange(65536) >> 8, large >> 32])
        ones = np.concatenate([np.arange(65536) & 255, large & 0xFFFFFFFF])
        left = [np.stack([np.maximum(zeros - 1, 0), ones]), np.stack([zeros, np.maximum(ones - 1, 0)])]
        self.code, self.values = Packed(code.astype(np.int32)), Packed(np.stack([_stretched(x) for x in left], axis=1).ravel())

    def without(self, slots: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions, levels) of the slots without one occurrence of ``bit``."""
        x = self.values.array.take(self.code.array.take(slots) * 2 + bit)
        return x, x.view(np.int32) & 3


def _levels(seen: np.ndarray) -> np.ndarray:
    """0 to 3 for counts of 0, up to 3, up to 50 and more."""
    return (seen > 0).astype(np.int8) + (seen > 3) + (seen > 50)


def _stretched(counts: np.ndarray) -> np.ndarray:
    """The stretched prediction of each of counts (2, n), with the level of what was seen in its last two bits."""
    x = counts[1].astype(np.float32) + np.float32(0.4)
    x /= counts[0].astype(np.float32) + np.float32(0.4)
    np.log(x, out=x)
    bits = x.view(np.int32)
    bits &= ~3
    bits |= _levels(counts[0].astype(np.int64) + counts[1])
    return x


class Stretched(Packed):
    """What scoring reads per slot of counts (2, slots)."""

    def __init__(self, counts: np.ndarray):
        super().__init__(_stretched(counts))

    def at(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions, levels) of the slots."""
        x = self.array.take(slots)
        return x, x.view(np.int32) & 3


def _odds_against(x: np.ndarray, gate: np.ndarray, weights: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """1 / p of each bit as it was, from the stretched predictions and the weights of their gates."""
    z = x[0] * weights[0].take(gate)
    for k in range(1, len(x)):
        z += x[k] * weights[k].take(gate)
    np.clip(z, -14, 14, out=z)
    z *= (1 - 2 * bit).astype(np.float32)
    return np.exp(z, out=z).astype(np.float64) + 1.0


# ---- words -----------------------------------------------------------------------------------------------------------


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(owner, code, words): the lower-cased words of all texts in order, as codes into distinct ``words``."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = flat.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at an end of a text
        keep = codes != empty
        owner, codes = owner[keep], codes[keep]
    return owner, codes, words


def word_totals(docs: DataFrame) -> DataFrame:
    """(word, n, c): occurrences of every word in all and in the training documents of (text, train)."""

    def count(batches):
        for b in batches:
            for part in slices(b):
                owner, codes, words = split_words(part.column(0))
                train = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                n = np.bincount(codes, minlength=len(words))
                c = np.bincount(codes[train[owner]], minlength=len(words))
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(c)], ["word", "n", "c"]).filter(some)

    return docs.select("text", "train").mapInArrow(count, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


# ---- the model -------------------------------------------------------------------------------------------------------


def _contexts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte, owner, contexts): all bytes of the words with their closing spaces, and the hashed contexts before each."""
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    stop = np.flatnonzero(raw == 32)
    start = np.concatenate([[0], stop[:-1] + 1])
    owner = np.repeat(np.arange(len(stop)), stop - start + 1)
    at = np.arange(len(raw)) - start[owner]
    out = np.zeros((CONTEXTS, len(raw)), np.uint64)
    recent = np.zeros(len(raw), np.uint64)
    for k in range(1, 5):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k]
        before[at < k] = 32
        recent = recent * np.uint64(256) + before
        out[k - 1] = mix64(recent + np.uint64(k << 40))
    whole = np.zeros(len(raw), np.uint64)
    value = raw.astype(np.uint64) + np.uint64(1)
    size = stop - start
    longest = start[np.argsort(-size, kind="stable")]
    still = len(size) - np.cumsum(np.bincount(size, minlength=1))
    for depth, n in enumerate(still[:-1].tolist(), 1):  # one step per letter position, over the words that are that long
        here = longest[:n] + depth
        whole[here] = mix64(whole[here - 1] * np.uint64(31) + value[here - 1])
    out[4] = mix64(whole + np.uint64(5 << 40))
    return raw, owner, out


def _bits(raw: np.ndarray, contexts: np.ndarray):
    """For each bit position: (position, bits, slots per predictor)."""
    byte = raw.astype(np.int64)
    mask = np.array([(1 << b) - 1 for b in BITS])[:, None]
    low = contexts.astype(np.int64) & mask
    for j in range(8):
        node = (1 << j) | (byte >> (8 - j))
        yield j, (byte >> (7 - j)) & 1, FIRST[:-1, None] + (low ^ (node * 0x9E3779B1 & mask))


def _word_parts(batches):
    """(words, counts) of (word, c) batches in runs of bounded length, long words included."""
    for b in batches:
        for s in slices(b, "word", WORDS_AT_ONCE * 10):
            yield s.column(0).to_pylist(), s.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def counters(words: DataFrame) -> np.ndarray:
    """(2, slots) counts of zeros and ones per context slot, from training words (word, c)."""

    def count(batches):
        total = np.zeros((2, FIRST[-1]), np.float32)
        for w, c in _word_parts(batches):
            raw, owner, contexts = _contexts(w)
            weight = c[owner].astype(np.float32)
            for _, bit, slots in _bits(raw, contexts):
                for row in slots:
                    np.add.at(total.ravel(), bit * FIRST[-1] + row, weight)
        at = np.flatnonzero(total[0] + total[1])
        for a in range(0, len(at), 500_000):
            i = at[a: a + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total[0, i].astype(np.int64)), pa.array(total[1, i].astype(np.int64))], ["slot", "zeros", "ones"])

    sums = words.coalesce(MODEL_TASKS).mapInArrow(count, "slot int, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    # at most FIRST[-1] rows; counts beyond 32 bits keep their ratio
    top = (1 << 31) - 1
    scale = F.greatest(F.lit(1.0), F.greatest("zeros", "ones") / top)
    rows = sums.select("slot", F.ceil(F.col("zeros") / scale).cast("int").alias("zeros"), F.ceil(F.col("ones") / scale).cast("int").alias("ones")).toArrow()
    out = np.zeros((2, FIRST[-1]), np.int32)
    out[0, rows.column("slot").to_numpy()] = rows.column("zeros").to_numpy()
    out[1, rows.column("slot").to_numpy()] = rows.column("ones").to_numpy()
    return out


def _gate(j: int, level: np.ndarray) -> np.ndarray:
    return ((j * 4 + level[3]) * 4 + level[4]).astype(np.int64)


def _gains(x: np.ndarray, gate: np.ndarray, weights: np.ndarray, bit: np.ndarray, gates: int, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log likelihood, (predictors, gates) each; ``count`` is how often each bit occurs (once without)."""
    p = 1.0 / _odds_against(x, gate, weights.astype(np.float32), np.ones_like(bit))
    miss, bend = bit - p, p * (1 - p)
    if count is None:
        miss, bend = miss.astype(np.float32), bend.astype(np.float32)
    if count is not None:
        miss, bend = miss * count, bend * count
    return np.stack([np.bincount(gate, miss * r, gates) for r in x]), np.stack([np.bincount(gate, bend * (r * r), gates) for r in x])


def refine(words: DataFrame, table, weights: np.ndarray) -> np.ndarray:
    """One round of online learning over all training words; the weights of the tasks are averaged by what their gates saw."""

    def learn(batches):
        w, seen = weights.copy(), np.zeros(GATES)
        for names, c in _word_parts(batches):
            raw, owner, contexts = _contexts(names)
            count = c[owner]
            for j, bit, slots in _bits(raw, contexts):
                x, level = table.value.without(slots, bit)
                gate = _gate(j, level)
                slope, bend = _gains(x, gate, w, bit, GATES, count)
                w = w + slope / (CONTEXTS * bend + 20.0)
                seen += np.bincount(gate, count, GATES)
        yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float64).ravel().tolist()], "n": [seen.tolist()]})

    return _averaged(words.coalesce(MODEL_TASKS).mapInArrow(learn, "w array<double>, n array<double>").collect(), weights)


def _averaged(rows: list, weights: np.ndarray) -> np.ndarray:
    """Weights of the tasks, one row (w, n) each, by what their gates saw; ``weights`` where none saw anything."""
    part = np.array([r["n"] for r in rows]).reshape(len(rows), 1, weights.shape[1])
    value = np.array([r["w"] for r in rows]).reshape(len(rows), *weights.shape)
    return np.where(part.sum(axis=0) > 0, (value * part).sum(axis=0) / np.maximum(part.sum(axis=0), 1e-9), weights)


def word_scores(words: list[str], table: Stretched, weights: np.ndarray) -> np.ndarray:
    """log10 probability of each word."""
    raw, owner, contexts = _contexts(words)
    odds, weights = np.ones(len(raw)), weights.astype(np.float32)
    for a in range(0, len(raw), PIECE):
        part = odds[a: a + PIECE]
        for j, bit, slots in _bits(raw[a: a + PIECE], contexts[:, a: a + PIECE]):
            x, level = table.at(slots)
            part *= _odds_against(x, _gate(j, level), weights, bit)
    return np.bincount(owner, -np.log10(odds), len(words))


def fit(words: DataFrame) -> tuple:
    """Broadcast (predictions, weights) learned from training words (word, c), and the score of the escape."""
    spark = words.sparkSession
    once = words.where("c = 1").count()
    words = words.unionByName(spark.createDataFrame([(ESCAPE, max(once, 1))], "word string, c long"))
    counts = counters(words)
    table = spark.sparkContext.broadcast(Tallies(counts))
    weights = np.full((CONTEXTS, GATES), 0.3)
    for _ in range(ROUNDS):  # a word seen once would be an escape without its own occurrence
        weights = refine(words.where("c > 1"), table, weights)
    table.unpersist()
    stretched = Stretched(counts)
    shared = spark.sparkContext.broadcast(stretched)
    return shared, spark.sparkContext.broadcast(weights), float(word_scores([ESCAPE], stretched, weights)[0])


def scored_words(words: DataFrame, model: tuple) -> DataFrame:
    """``words`` (word, n, c) with lp, the log10 probability of the word or of the escape, and spelled, that with an unknown word's bytes."""
    table, weights, escape = model

    def score(batches):
        for b in batches:
            for s in slices(b, "word", WORDS_AT_ONCE * 10):
                spelled = word_scores(s.column(0).to_pylist(), table.value, weights.value)
                known = s.column(2).to_numpy() > 0
                lp = np.where(known, spelled, escape)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(lp), pa.array(np.where(known, spelled, spelled + escape))], ["word", "n", "c", "lp", "spelled"])

    return words.mapInArrow(score, "word string, n long, c long, lp double, spelled double")


# ---- tokens in their places --------------------------------------------------------------------------------------------


def code_tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, side) of a Huffman tree: leaves in the order of ``weights`` (two at least), then the inner nodes; the last one is the root."""
    n = len(weights)
    order = np.argsort(weights, kind="stable").tolist()
    weight = np.asarray(weights, np.int64).tolist() + [0] * (n - 1)
    parent, side = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.int8)
    leaf, inner = 0, n
    for node in range(n, 2 * n - 1):
        for bit in (0, 1):
            if leaf < n and (inner >= node or weight[order[leaf]] <= weight[inner]):
                child, leaf = order[leaf], leaf + 1
            else:
                child, inner = inner, inner + 1
            parent[child], side[child] = node, bit
            weight[node] += weight[child]
    return parent, side


class TextCode:
    """The coded words (leaves 0 to n - 1), the leaves of the end and of all other words, their tree, and log2 of the slots of a word context."""

    def __init__(self, names: pa.Array, counts: np.ndarray, ends: int, others: int):
        self.names, self.end, self.other = names, len(names), len(names) + 1
        parent, side = code_tree(np.concatenate([counts, [max(ends, 1), max(others, 1)]]))
        self.up = parent * np.int32(2) + side  # of each node, with its side
        self.inner = len(names) + 1
        on = np.arange(len(names) + 2)
        node, self.depth, nodes = on, np.zeros(len(on), np.uint8), np.zeros((self.inner, 2), np.int64)
        weight = np.concatenate([counts, [ends, others]]).astype(np.int64)
        while len(on):
            self.depth[on] += 1
            node, bit = parent[node], side[node]
            np.add.at(nodes, (node - (self.inner + 1), bit), weight[on])
            on, node = on[node != 2 * self.inner], node[node != 2 * self.inner]
        #: Zeros and ones of each inner node in the training documents, which the counts of the words give.
        self.nodes = np.ceil(nodes / np.maximum(1.0, nodes.max(axis=1, keepdims=True) / ((1 << 31) - 1))).astype(np.int32)
        self.bits = int(min(max(math.ceil(math.log2(4 * max(counts.sum() + ends + others, 1))), 12), MOST_SLOTS))
        self.first = np.array([0, self.inner, self.inner + (1 << self.bits), self.inner + (2 << self.bits)])


def token_stream(texts: pa.Array, code: TextCode) -> tuple:
    """(text, leaf, contexts of the last word and of the last two) of all tokens in order, ends included, then what ``split_words`` gives."""
    owner, codes, found = split_words(texts)
    n = len(texts)
    at = pc.fill_null(pc.index_in(found, code.names), code.other).to_numpy().astype(np.int32)
    # the end and the start are hashed like words
    whole = np.concatenate([array_hashes(found), [END_HASH, START_HASH]])
    once, twice = mix64(whole + np.uint64(1)), mix64(whole + np.uint64(2))
    size = np.bincount(owner, minlength=n) + 1
    ends = np.cumsum(size) - 1
    place = np.arange(len(owner)) + owner
    leaf, word = np.full(len(owner) + n, code.end, np.int32), np.full(len(owner) + n, len(found), np.int32)
    leaf[place], word[place] = at[codes], codes
    one = np.concatenate([[len(found)], word[:-1]]).astype(np.int32)
    two = np.concatenate([[len(found) + 1], one[:-1]]).astype(np.int32)
    two[ends - size + 1] = len(found) + 1  # nothing of the text before
    last = once[one]
    return np.repeat(np.arange(n), size), leaf, last, mix64(last * np.uint64(31) + twice[two]), owner, codes, found


def _decisions(code: TextCode, leaf: np.ndarray, last: np.ndarray, both: np.ndarray):
    """For each step from the leaves to the root: (tokens still on the way, bits, slots per predictor).

    Tokens with the longest ways come first, so those still on the way are the first ones of the step before.
    """
    depth = code.depth[leaf]
    order = np.argsort(np.uint8(255) - depth, kind="stable")
    still = len(leaf) - np.cumsum(np.bincount(depth, minlength=1))
    node, shift = leaf[order], np.uint64(64 - code.bits)
    spread = [c[order] * np.uint64(0xD6E8FEB86659FD93) for c in (last, both)]
    turn = np.uint64(0x9E3779B97F4A7C15 * 0xD6E8FEB86659FD93 % (1 << 64))
    for n in still[:-1].tolist():
        up = code.up[node[:n]]
        node, bit = up >> 1, up & 1
        slots = np.empty((TEXT_CONTEXTS, n), np.int64)
        np.subtract(node, code.inner + 1, out=slots[0])
        step = slots[0].view(np.uint64) * turn
        for k, c in enumerate(spread, 1):
            np.right_shift(c[:n] + step, shift, out=slots[k].view(np.uint64))
            slots[k] += code.first[k]
        yield order[:n], bit, slots


def _pieces(code: TextCode, leaf: np.ndarray, last: np.ndarray, both: np.ndarray):
    """(start, ``_decisions``) of runs of tokens."""
    for a in range(0, len(leaf), PIECE):
        yield a, _decisions(code, leaf[a: a + PIECE], last[a: a + PIECE], both[a: a + PIECE])


def _runs(n: int, first: int):
    """Cuts of n tokens; the first ones are short, so that learning has steps on small data too."""
    start = 0
    while start < n:
        stop = min(n, start + max(min(TOKENS_AT_ONCE, start), first))
        yield slice(start, stop)
        start = stop


def _text_tasks(docs: DataFrame) -> DataFrame:
    """Documents in as many tasks as run at once: each holds one set of counters."""
    return docs.select("text").coalesce(max(MODEL_TASKS, docs.sparkSession.sparkContext.defaultParallelism))


def count_decisions(code: TextCode, total: np.ndarray, leaf: np.ndarray, last: np.ndarray, both: np.ndarray) -> None:
    """Add the bits of all tokens to ``total``, zeros and ones of each slot side by side; the nodes without a context are left out."""
    one = np.ones(2 * PIECE, np.int32)  # of one type, which is many times faster
    for _, steps in _pieces(code, leaf, last, both):
        for _, bit, slots in steps:
            at = (slots[1:] * 2 + bit).ravel()
            np.add.at(total, at, one[: len(at)])


def text_counters(docs: DataFrame, code) -> np.ndarray:
    """(2, slots) counts of zeros and ones per slot of the word contexts, from training documents (text); tasks send theirs in blocks that are added up one by one.

    Those without a context are the code's own."""
    import zstandard

    size = int(code.value.first[-1])

    def count(batches):
        total = np.zeros(-(-size // BLOCK) * BLOCK * 2, np.int32)
        for b in batches:
            for part in slices(b):
                _, leaf, last, both, *_ = token_stream(part.column(0), code.value)
                count_decisions(code.value, total, leaf, last, both)
        pack = zstandard.ZstdCompressor(level=1)
        for k, block in enumerate(total.reshape(-1, 2 * BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": [pack.compress(block.astype(np.int64).tobytes())]})

    def add(parts):  # one row per task
        whole = np.zeros(2 * BLOCK, np.int64)
        for x in parts.column("counts"):
            whole += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64)
        scale = max(1.0, whole.max() / ((1 << 31) - 1))  # counts beyond 32 bits keep their ratio
        data = np.ceil(whole / scale).astype(np.int32).tobytes()
        return pa.table({"block": parts.column("block").slice(0, 1), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(data)], pa.binary())})

    schema = "block int, counts binary"
    sums = _text_tasks(docs).mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).toArrow()  # at most 2 * 2**MOST_SLOTS slots and one per leaf
    out = np.zeros((-(-size // BLOCK), 2 * BLOCK), np.int32)
    for k, x in zip(sums.column("block").to_pylist(), sums.column("counts")):
        out[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int32)
    out = out.reshape(-1, 2)[:size]
    out[: code.value.inner] = code.value.nodes
    return out.T


def _text_gate(level: np.ndarray) -> np.ndarray:
    return ((level[0] * 4 + level[1]) * 4 + level[2]).astype(np.int64)


def learned(code: TextCode, tallies: Tallies, w: np.ndarray, leaf: np.ndarray, last: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bits seen per gate) after one step of learning from the tokens."""
    slope, bend, seen = np.zeros((TEXT_CONTEXTS, TEXT_GATES)), np.zeros((TEXT_CONTEXTS, TEXT_GATES)), np.zeros(TEXT_GATES)
    for _, steps in _pieces(code, leaf, last, both):
        for _, bit, slots in steps:
            x, level = tallies.without(slots, bit)  # without the token itself
            gate = _text_gate(level)
            first, second = _gains(x, gate, w, bit, TEXT_GATES)
            slope += first
            bend += second
            seen += np.bincount(gate, minlength=TEXT_GATES)
    return w + slope / (TEXT_CONTEXTS * bend + 20.0), seen


def refine_text(docs: DataFrame, code, table, weights: np.ndarray) -> np.ndarray:
    """One pass of online learning over the training documents (text)."""

    def learn(batches):
        w, seen, first = weights.copy(), np.zeros(TEXT_GATES), 1000
        for b in batches:
            for part in slices(b):
                _, leaf, last, both, *_ = token_stream(part.column(0), code.value)
                for r in _runs(len(leaf), first):
                    w, n = learned(code.value, table.value, w, leaf[r], last[r], both[r])
                    seen += n
                first = TOKENS_AT_ONCE
        yield pa.RecordBatch.from_pydict({"w": [w.ravel().tolist()], "n": [seen.tolist()]})

    return _averaged(_text_tasks(docs).mapInArrow(learn, "w array<double>, n array<double>").collect(), weights)  # one row per task


class TextModel:
    """What scoring reads: the predictions per slot and the weights."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray):
        self.stretched = Stretched(counts)
        self.weights = weights.astype(np.float32)


def token_scores(code: TextCode, model: TextModel, leaf: np.ndarray, last: np.ndarray, both: np.ndarray) -> np.ndarray:
    """log10 probability of each token's leaf in its place."""
    out = np.zeros(len(leaf))
    for a, steps in _pieces(code, leaf, last, both):
        order, odds = None, None
        for turn, (on, bit, slots) in enumerate(steps):
            if order is None:
                order, odds, total = on, np.ones(len(on)), np.zeros(len(on))
            x, level = model.stretched.at(slots)
            odds[: len(on)] *= _odds_against(x, _text_gate(level), model.weights, bit)
            if turn % 32 == 31:  # each step multiplies by e**14 + 1 at most
                total -= np.log10(odds)
                odds[:] = 1.0
        out[a + order] = total - np.log10(odds)
    return out


def fit_text(docs: DataFrame, names: pa.Array, counts: np.ndarray, ends: int, others: int) -> tuple:
    """Broadcast (code, model) of the tokens in their places, from training documents (text)."""
    sc = docs.sparkSession.sparkContext
    code = sc.broadcast(TextCode(names, counts, ends, others))
    found = text_counters(docs, code)
    table = sc.broadcast(Tallies(found))
    weights = refine_text(docs, code, table, np.full((TEXT_CONTEXTS, TEXT_GATES), 0.3))
    table.unpersist()
    return code, sc.broadcast(TextModel(found, weights))


# ---- documents -------------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, n_bytes) of every row."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("train", F.crc32(F.encode(key, "UTF-8")) % 7 != 2)
    train_docs = rows.where("train").count()
    ends = spark.createDataFrame([(END, rows.count(), train_docs)], "word string, n long, c long")
    words = saved(word_totals(rows).unionByName(ends), "words")
    sums = words.agg(F.sum("c").alias("t"), F.sum("n").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train_tokens, all_tokens, distinct = sums["t"], sums["n"], sums["v"]
    own_leaf = (F.col("word") == END) | ((F.col("c") > 1) & (F.col("c") * CODED >= train_tokens))
    coded = words.where(own_leaf & (F.col("word") != END)).select("word", "c").orderBy("word").toArrow().combine_chunks()  # at most CODED rows
    names = coded.column("word").combine_chunks() if coded.num_rows else pa.array([], pa.string())
    counts = coded.column("c").to_numpy()
    train = rows.where("train").select("text")
    code, model = fit_text(train, names, counts, train_docs, train_tokens - train_docs - int(counts.sum()))
    spelled_out = words.where(~own_leaf)
    spelled_out = scored_words(spelled_out, fit(spelled_out.where("c > 0").select("word", "c")))
    in_place = words.where(own_leaf).select("word", "n", "c", F.lit(0.0).alias("lp"), F.lit(0.0).alias("spelled"))  # scored where they stand
    words = saved(spelled_out.unionByName(in_place), "scores")
    heavy = words.where(F.col("n") * HEAVY >= all_tokens).select("word", "c", "lp", "spelled").toArrow().combine_chunks()  # at most HEAVY rows
    shared = spark.sparkContext.broadcast(heavy)
    kind = dict(rows.dtypes)["doc_id"]

    def look_up(batches):
        """Sums over the broadcast words per document, and one row per document and other word."""
        row = TaskContext.get().partitionId() << 40
        known = shared.value
        names = known.column("word").combine_chunks() if known.num_rows else pa.array([], pa.string())
        c = np.append(known.column("c").to_numpy(), 0)
        lp, spelled = (np.append(known.column(x).to_numpy(), 0.0) for x in ("lp", "spelled"))
        log_c = np.log10(c + 1.0)
        for b in batches:
            for part in slices(b):
                text, leaf, last, both, owner, codes, found = token_stream(part.column(1), code.value)
                placed = np.bincount(text, token_scores(code.value, model.value, leaf, last, both), part.num_rows)
                at = pc.fill_null(pc.index_in(found, names), len(names)).to_numpy().astype(np.int64)
                size = pc.binary_length(found).to_numpy() + 1
                n = part.num_rows
                total = lambda v: np.bincount(owner, v[codes], n)
                ids = np.arange(n) + row
                row += n
                nothing = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), part.column(2), nothing(n, pa.string()), pa.array(np.bincount(owner, minlength=n) + 1),
                     pa.array(total((c[at] > 0).astype(float)).astype(np.int64) + int(train_docs > 0)), pa.array(total(log_c[at]) + math.log10(train_docs + 1.0)),
                     pa.array(total(lp[at]) + placed), pa.array(total(spelled[at]) + placed), pa.array(total(size.astype(float)).astype(np.int64) + 1)],
                    NAMES,
                )
                rare = at[codes] == len(names)
                pair, times = np.unique(owner[rare] * np.int64(len(found) + 1) + codes[rare], return_counts=True)
                o, w = pair // (len(found) + 1), pair % (len(found) + 1)
                m = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[o]), nothing(m, part.column(0).type), nothing(m, pa.bool_()), found.take(pa.array(w)), pa.array(times),
                     nothing(m, pa.int64()), nothing(m, pa.float64()), nothing(m, pa.float64()), nothing(m, pa.float64()), nothing(m, pa.int64())],
                    NAMES,
                )

    parts = rows.select("doc_id", "text", "train").mapInArrow(look_up, f"row long, doc_id {kind}, train boolean, word string, n long, known long, base double, lp double, bits double, bytes long")
    parts = saved(parts, "parts")
    own = parts.where("word is null").select("row", "doc_id", "train", "n", "known", "base", "lp", "bits", "bytes")
    light = words.where(F.col("n") * HEAVY < all_tokens).select("word", "c", F.col("lp").alias("word_lp"), "spelled")
    other = parts.where("word is not null").select("row", "word", "n").join(light, "word").select(
        "row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(0).cast("long").alias("n"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.col("c") + 1.0)).alias("base"),
        (F.col("n") * F.col("word_lp")).alias("lp"), (F.col("n") * F.col("spelled")).alias("bits"), F.lit(0).cast("long").alias("bytes"),
    )
    out = own.unionByName(other).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *[F.sum(x).alias(x) for x in ("n", "known", "base", "lp", "bits", "bytes")]
    )
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(train_tokens or 0).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * math.log10((train_tokens or 0) + (distinct or 0) + 1)).alias("base_score"), F.col("lp").alias("score"), (-F.col("bits") / math.log10(2)).alias("bits"), F.col("bytes").alias("n_bytes"),
    )


@query("op8_context_mixing")
def op8_context_mixing(spark, sf_dir):
    """Contract query, with the model's bits per byte of the coded words."""
    found = score_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("bits_per_byte", F.col("bits") / F.col("n_bytes"))
