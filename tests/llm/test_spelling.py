"""Spelling variants against a direct version over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from terraloom.llm import spelling as sp

SCHEMA = "doc_id long, text string"


def near(a, b):
    """One replaced, inserted or deleted letter, tried out."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def direct(rows, noise=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    form, beside = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        beside[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], beside[w], n[form[w]] if form[w] else None)
    return out


def got(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sp.variant_groups(df, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_all_pairs(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("aabbé") for _ in range(r.randint(7, 9))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * r.choice([1, 2, 3, 30, 400])
        for _ in range(6):
            at, c = r.randrange(len(w)), r.choice("abéÿ")
            words += [r.choice([w[:at] + c + w[at + 1:], w[:at] + c + w[at:], w[:at] + w[at + 1:]])] * r.choice([1, 2, 4])
    r.shuffle(words)
    rows = [(k, " ".join(w.title() if r.random() < 0.2 else w for w in words[a:a + 60])) for k, a in enumerate(range(0, len(words), 60))]
    rows += [(None, "×aabbaabb÷aabbaab, aabbaab"), (5, None), (5, ""), (6, "short"), (6, "short")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df) == direct(rows)


def test_noise_deletes_a_letter():
    r = random.Random(0)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(2000)]
    rows = [(7, " ".join(words)), (8, " ".join(words))]
    cut = 0
    for i, text in rows:
        for w in words:
            h = zlib.crc32(f"{i}:{w}".encode())
            made = w[:h % 9] + w[h % 9 + 1:] if h % 31 == 0 else w
            assert sp.noisy_words(i, w) == Counter([made])
            cut += made != w
    assert 60 < cut < 200


def test_runs_of_long_texts(monkeypatch):
    text = "abcdefgh ijklmnop,qrstuvwx " * 50 + "z" * 300
    whole = sp.noisy_words(1, text)
    monkeypatch.setattr(sp, "RUN", 40)
    assert sp.noisy_words(1, text) == whole and whole["z" * 300] == 1


def test_groups_over_batches(spark, monkeypatch):
    """The last group of an Arrow batch is joined with the next batch."""
    words = ["aaaaaaa" + c for c in "abcdefghijklmnopqrstuvwxyz"] + ["aaaaaaa"]
    rows = [(0, " ".join(words * 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(df, noise=0) == direct(rows, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chains_of_forms(spark):
    rows = [(0, " ".join(["wordone"] * 2 + ["wordonex"] * 20 + ["wordonexy"] * 200 + ["wordonexyz"] * 2000))]
    assert got(spark.createDataFrame(rows, SCHEMA), noise=0)["wordone"] == ("wordonex", "wordonexyz", 2, 1, 20)


def test_empty_table_and_clashing_columns(spark):
    assert sp.variant_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    names = ["word", "n", "key", "role", "form", "root", "best"]
    wide = spark.createDataFrame([(1, "letters letters", *names)], SCHEMA + "".join(f", {c} string" for c in names))
    assert got(wide, noise=0) == {"letters": (None, "letters", 2, 0, None)}
