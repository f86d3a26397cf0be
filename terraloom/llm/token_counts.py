"""Token counts of texts by a two-tier lookup inside the map tasks.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each for itself, so a text has as many tokens as its pre-tokens together. The operator never shuffles pre-tokens:

1. One pass over all texts finds the frequent ones. Every task keeps a bounded summary of its own pieces (at most ``KEPT`` after each slice, the lightest go) and hands over its ``SENT``
   heaviest; their sums give the ``FREQUENT`` heaviest of the corpus, each with its length in tokens. This table decides only where a length is looked up, never what it is.
2. The table is broadcast as an open-addressing hash table of 64-bit piece hashes and 16-bit lengths (at most ``FREQUENT`` entries, some 2 MB). The second pass looks up every piece of a
   slice there at once. Misses go to a cache of the worker process, which outlives its tasks; what is in neither is encoded by the library, once for each distinct piece.

Pieces are cut at places where a pre-token ends whatever stands around them: at white space, as the pattern deals it out (a space goes with the word after it, a run before it stands
alone), and between an ASCII letter, digit or other sign and an ASCII sign of another of these kinds, unless an apostrophe comes first. A piece may hold several pre-tokens. Names of added tokens are cut out of a text
first, as the library does by default, and count as one token each.

Two pieces with one hash would get one length; among n distinct pieces a missed piece meets an entry of the tables with probability n * entries / 2**64.

Results for special rows: null and empty texts have 0 tokens and 0 bytes. Texts of any length are handled in runs of about ``RUN`` characters that end between two words; a longer run without such
a place stays whole. Repeated rows are counted each. An empty table gives no rows. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import mix64, slices, texts_of
from terraloom.llm.registry import query, table

FREQUENT = 1 << 17
KEPT = 1 << 18
SENT = 1 << 13
CACHE = 400_000
#: Longest piece, in characters, that the tables hold; longer ones are encoded where they stand.
PIECE = 64
RUN = 1_000_000
LIMIT = 1024

#: White space of the pre-token pattern above ASCII (fixed values).
WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = np.zeros(0x3002, dtype=bool)
_SPACE[[*range(9, 14), 32, *WIDE_SPACE]] = True
#: 1 letter, 2 digit, 3 other sign, 4 apostrophe, 0 anything else (white space, control characters and all above ASCII).
_KIND = np.zeros(129, dtype=np.uint8)
for _c in range(33, 127):
    _KIND[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 4 if _c == 39 else 3
_GOES_ON = re.compile(r"[A-Za-z](?= [A-Za-z])")


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, first and last position of every piece in them, its text's number, hashes)."""
    joined = "\0".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    bars = np.cumsum([len(t) + 1 for t in texts]) - 1  # the separator after each text
    bar = np.zeros(n + 1, dtype=bool)
    bar[bars] = True
    space = np.append(_SPACE[np.minimum(codes, 0x3001)], False)
    kind = np.append(_KIND[np.minimum(codes, 128)], 0)
    start = np.zeros(n + 1, dtype=bool)
    start[0] = True
    before, here = space[:-1], space[1:]
    word = ~space & ~bar
    start[1:] |= bar[1:] | bar[:-1]
    start[1:] |= here & ~before  # a run of white space
    start[:-1] |= space[:-1] & word[1:]  # its last character, which the word after it may take
    start[1:] |= before & word[1:] & (np.append(codes[:-1], 0) != 32)
    a, b = kind[:-1], kind[1:]
    start[1:] |= (a != b) & (a > 0) & (b > 0) & (a != 4) & ~((a == 3) & (b == 4))
    first = np.flatnonzero(start[:n])
    last = np.append(first[1:], n)
    keep = ~bar[first]
    first, last = first[keep], last[keep]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, np.uint64(0x9E3779B97F4A7C15))]))
    prefix = _rolled(codes, first, last, power)
    return joined, first, last, np.searchsorted(bars, first), prefix


def _rolled(codes: np.ndarray, first: np.ndarray, last: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hash of each run of codes: a polynomial over at most PIECE characters, mixed with the length."""
    size = last - first
    short = np.minimum(size, PIECE)
    owner = np.repeat(np.arange(len(first)), short)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(short) - short, short)
    terms = (codes[first[owner] + within].astype(np.uint64) + np.uint64(1)) * power[within]
    sums = np.add.reduceat(terms, np.cumsum(short) - short) if len(first) else np.zeros(0, np.uint64)
    return mix64(mix64(sums) ^ size.astype(np.uint64)) | np.uint64(1)  # never 0, which marks a free slot


class LengthTable:
    """Lengths by 64-bit hash, open addressing with linear probing; built for at most FREQUENT entries."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.lengths, self.probes = np.zeros(size, np.uint64), np.zeros(size, np.uint16), 1
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.lengths[slot[won]] = keys[todo[won]], lengths[todo[won]]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(7)).astype(np.int64) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Length of each key, 0 where it is absent (no piece has length 0)."""
        slot = self._home(keys)
        out = np.where(self.keys[slot] == keys, self.lengths[slot], 0).astype(np.int64)
        todo = np.flatnonzero((out == 0) & (self.keys[slot] != 0))
        for step in range(1, self.probes + 1):
            if not len(todo):
                break
            at = (slot[todo] + step) & (len(self.keys) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.lengths[at[hit]]
            todo = todo[~hit & (self.keys[at] != 0)]
        return out


class Lengths:
    """The library's tokenizer in one worker process, with the lengths of the pieces it has seen."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[int, int] = {}
        names = sorted((t["content"] for t in json.loads(definition).get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None

    def encoded(self, texts: list[str]) -> np.ndarray:
        return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else [], np.int64)

    def of_pieces(self, joined: str, first: np.ndarray, last: np.ndarray, keys: np.ndarray, tier: LengthTable) -> np.ndarray:
        """Length of each piece: from the broadcast table, the cache or the library."""
        out = np.where(last - first <= PIECE, tier.find(keys), 0)
        todo = np.flatnonzero(out == 0)
        _, one, back = np.unique(keys[todo], return_index=True, return_inverse=True)
        long = np.flatnonzero(last[todo] - first[todo] > PIECE)
        some = todo[one]
        known = np.array([self.cache.get(k, 0) for k in keys[some].tolist()], np.int64)
        new = np.flatnonzero((known == 0) & (last[some] - first[some] <= PIECE))
        known[new] = self.encoded([joined[a:z] for a, z in zip(first[some[new]].tolist(), last[some[new]].tolist())])
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        self.cache.update(zip(keys[some[new]].tolist()[:CACHE], known[new].tolist()))
        out[todo] = known[back]
        far = todo[long]
        out[far] = self.encoded([joined[a:z] for a, z in zip(first[far].tolist(), last[far].tolist())])
        return out


_WORKERS: dict[str, Lengths] = {}


def lengths_of(definition: str) -> Lengths:
    """The one instance of this worker process for a tokenizer."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Lengths(definition)
    return _WORKERS[key]


def runs(texts: list[str], added: re.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(runs of bounded length, the text of each, added tokens per text): names of added tokens end a run."""
    out, owner, special = [], [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        parts = [text] if added is None else added.split(text)
        special[k] = len(parts) - 1
        for part in parts:
            at = 0
            while len(part) - at > RUN:
                end = _GOES_ON.search(part, at + RUN)
                if end is None:
                    break
                out.append(part[at: end.end()])
                owner.append(k)
                at = end.end()
            out.append(part[at:])
            owner.append(k)
    return out, np.array(owner, np.int64), special


def in_groups(texts: list[str], owner: np.ndarray):
    """Consecutive runs of about RUN characters together."""
    total = np.cumsum([len(t) for t in texts]) // RUN if texts else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(texts)]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield texts[a:z], owner[a:z]


def cuttable(definition: str) -> bool:
    """Whether texts fall into pieces as described above; other tokenizers encode whole texts."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    tokens = [t for t in d.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    return plain and not tokens and not d.get("normalizer") and d["model"]["type"] == "BPE" and not d["model"].get("dropout")


def frequent_pieces(docs: DataFrame, definition: str, text_col: str, size: int = FREQUENT) -> LengthTable:
    """The ``size`` heaviest pieces of all texts by the tasks' summaries, with their lengths."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def summarise(batches):
        names = lengths_of(shared.value).added
        held, weight, strings = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for b in batches:
            for s in slices(b, "text"):
                texts, owner, _ = runs(texts_of(s), names)
                for some, _ in in_groups(texts, owner):
                    joined, first, last, _, keys = pieces(some)
                    ok = last - first <= PIECE
                    first, last, keys = first[ok], last[ok], keys[ok]
                    found, one, count = np.unique(keys, return_index=True, return_counts=True)
                    new = np.array([joined[a:z] for a, z in zip(first[one].tolist(), last[one].tolist())] + [None], object)[:-1]
                    both, at, back = np.unique(np.concatenate([held, found]), return_index=True, return_inverse=True)
                    weight = np.bincount(back, np.concatenate([weight, count]), len(both)).astype(np.int64)
                    held, strings = both, np.concatenate([strings, new])[at]
                    if len(held) > KEPT:
                        top = np.sort(np.argpartition(-weight, KEPT)[:KEPT])
                        held, weight, strings = held[top], weight[top], strings[top]
        top = np.argpartition(-weight, SENT)[:SENT] if len(held) > SENT else np.arange(len(held))
        if len(top):
            yield pa.RecordBatch.from_pydict({"piece": pa.array(strings[top].tolist(), pa.string()), "n": pa.array(weight[top], pa.int64())})

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "piece").limit(size).select("piece").toArrow().column("piece").to_pylist()
    if not top:
        return LengthTable(np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    own = Lengths(definition)
    keys = np.array([_key(p) for p in top], np.uint64)
    lengths = own.encoded(top)
    fits = lengths < 1 << 16
    return LengthTable(keys[fits], lengths[fits].astype(np.uint16))


def _key(piece: str) -> int:
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, np.uint64(0x9E3779B97F4A7C15))]))
    return int(_rolled(codes, np.zeros(1, np.int64), np.array([len(codes)]), power)[0])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` with the tokenizer file at ``tokenizer``."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    by_pieces = cuttable(definition)
    shared = spark.sparkContext.broadcast((definition, frequent_pieces(docs, definition, text_col) if by_pieces else None))

    def count(batches):
        own = lengths_of(shared.value[0])
        tier = shared.value[1]
        for b in batches:
            for s in slices(b, "text"):
                whole = texts_of(s)
                if tier is None:
                    tokens = own.encoded(whole)
                else:
                    texts, owner, tokens = runs(whole, own.added)
                    for some, owners in in_groups(texts, owner):
                        joined, first, last, text, keys = pieces(some)
                        lengths = own.of_pieces(joined, first, last, keys, tier)
                        tokens += np.bincount(owners[text], lengths, len(tokens)).astype(np.int64)
                size = pc.fill_null(pc.binary_length(s.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([s.column(0), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_token_counts")
def op11_token_counts(spark, sf_dir):
    """Contract query: whole texts, more than 1024 tokens are over the limit."""
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer())
