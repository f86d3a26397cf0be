"""Token counts against the tokenizer library on whole texts."""

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from terraloom.llm import token_counts as tc

SIGNS = ["a", "B", "é", "ß", "1", "٣", " ", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x85", "'", "'s", "'ll", ".", ",", "!", "<|endoftext|>", "<|endof", "中文", "😀", "\0", "\x1c", "İ", "²", "_", "-", "́", "don't", "THE", " the"]
SCHEMA = "doc_id long, text string"


def mixed(n, seed, longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tc.default_tokenizer())


def want(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def counted(spark, rows, **options):
    out = tc.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), tc.default_tokenizer(), **options)
    return {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()}


def test_equal_to_the_library(spark, library):
    texts = mixed(3000, 1) + mixed(40, 2, 3000) + [None, "", " ", "\n", "<|endoftext|>", "  <|endoftext|> x", "word " * 3000, "x" * 9000, "𝔘" * 300]
    got = counted(spark, list(enumerate(texts)))
    for i, t in enumerate(texts):
        n = want(library, t)
        assert got[i] == (len((t or "").encode()), n, n > 1024), repr(t)


def test_every_code_point(library):
    """Classes of signs come from the library, so each code point is tried between letters, spaces and at the end."""
    own = tc.Lengths(open(tc.default_tokenizer(), encoding="utf-8").read())
    none = tc.LengthTable(np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    texts = [f"a{c} {c}\nb {c}c  {c}" for c in map(chr, [*range(0x3100), *range(0xFF00, 0x10100)])]
    joined, first, last, text, keys = tc.pieces(texts)
    got = np.bincount(text, own.of_pieces(joined, first, last, keys, none), len(texts))
    assert got.tolist() == [want(library, t) for t in texts]


def test_runs_of_long_texts(spark, library, monkeypatch):
    monkeypatch.setattr(tc, "RUN", 50)
    texts = ["some words and, well, don't  stop\n" * 40 + "<|endoftext|>" + "more words here " * 40, "unbroken" * 200, "日本語" * 100]
    own = tc.Lengths(open(tc.default_tokenizer(), encoding="utf-8").read())
    parts, owner, special = tc.runs(texts, own.added)
    assert len(parts) > 20 and "".join(p for p, o in zip(parts, owner) if o == 1) == texts[1]
    none = tc.LengthTable(np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    for some, owners in tc.in_groups(parts, owner):
        joined, first, last, text, keys = tc.pieces(some)
        special += np.bincount(owners[text], own.of_pieces(joined, first, last, keys, none), len(texts)).astype(np.int64)
    assert special.tolist() == [want(library, t) for t in texts]


def test_tiers_and_small_caches_change_nothing(spark, library, monkeypatch):
    texts = mixed(400, 5)
    definition = open(tc.default_tokenizer(), encoding="utf-8").read()
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    tier = tc.frequent_pieces(frame, definition, "text", 50)
    assert 0 < np.count_nonzero(tier.keys) <= 50
    monkeypatch.setattr(tc, "CACHE", 3)
    own = tc.Lengths(definition)
    parts, owner, total = tc.runs(texts, own.added)
    for a in range(0, len(parts), 7):
        joined, first, last, text, keys = tc.pieces(parts[a:a + 7])
        total += np.bincount(owner[a:a + 7][text], own.of_pieces(joined, first, last, keys, tier), len(texts)).astype(np.int64)
        assert len(own.cache) <= 3 + 100
    assert total.tolist() == [want(library, t) for t in texts]


def test_length_table():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 62, 5000).astype(np.uint64) | np.uint64(1))
    table = tc.LengthTable(keys, np.arange(1, len(keys) + 1).astype(np.uint16))
    assert (table.find(keys) == np.arange(1, len(keys) + 1)).all()
    assert (table.find(keys + np.uint64(2)) [~np.isin(keys + np.uint64(2), keys)] == 0).all()


def test_special_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, "")]
    names = ["piece", "n", "n_tokens", "n_bytes", "row"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(wide, tc.default_tokenizer()).collect())
    assert got == [(0, 7, 2), (1, 7, 2), (1, 7, 2), (2, 0, 0), (3, 0, 0)]
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), tc.default_tokenizer()).count() == 0


def test_other_tokenizers_count_whole_texts(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not tc.cuttable(open(path, encoding="utf-8").read())
    library = Tokenizer.from_file(path)
    texts = mixed(100, 9)
    got = tc.token_counts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: want(library, t) for i, t in enumerate(texts)}
    spaced = json.loads(open(tc.default_tokenizer(), encoding="utf-8").read())
    spaced["pre_tokenizer"]["add_prefix_space"] = True
    assert not tc.cuttable(json.dumps(spaced))
