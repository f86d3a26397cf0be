"""Collocations against a direct count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def direct(rows, least, top):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i:i + k])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, count[lang, p[:k]], count[lang, p[k:]], score)
    kept = {}
    for (lang, p), v in found.items():
        longer = [q for (g, q) in found if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if not any(100 * found[lang, q][0] >= 80 * v[0] for q in longer):
            kept.setdefault(lang, []).append((-v[3], -v[0], " ".join(p).encode(), v))
    return {(lang, n): (x[2].decode(), *x[3][:3], total[lang], x[3][3]) for lang, xs in kept.items() for n, x in enumerate(sorted(xs)[:top], 1)}


def got(df, **options):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in co.collocations(df, **options).collect()}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "ÀB", "x y", "a-b", "'s", "日本"]
    fixed = ["new york city", "one two three four", "of the", "Bits And"]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(r.randint(0, 80)):
            text += r.choice(fixed) if r.random() < 0.3 else r.choice(words)
            text += r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\x0b", "\r\n"])
        rows.append((k, text, r.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, None, "en"), (1, "", None), (2, " \t. ", "fr"), (2, "one", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("seed,least,top", [(1, 5, 2000), (2, 12, 7), (3, 3, 40)])
def test_equal_to_direct_counts(spark, seed, least, top):
    rows = corpus(seed)
    want = direct(rows, least, top)
    assert len(want) > 10
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, top=top) == want


def test_runs_overlap_by_the_last_phrases(spark, monkeypatch):
    rows = [(0, "one two three four five six " * 30, "en"), (1, "a b c d" * 20, "en")]
    whole = direct(rows, 5, 2000)
    monkeypatch.setattr(co, "RUN", 37)
    for size in (1, 2, 3, 4):
        made = Counter()
        batch = co.slice_stripes(co.Words([t for _, t, _ in rows], ["en", "en"]), size, np.full(1 << 13, 255, np.uint8) if size > 1 else None)
        for r in batch.to_pylist():
            for w, c in zip(r["words"].split(" "), r["counts"], strict=True):
                if w:
                    made[(r["prefix"] + " " + w).strip()] += c
        count = Counter()
        for _, t, _ in rows:
            words = t.split()
            count.update(" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
        assert made == count
    assert whole


def test_hot_prefixes_are_cut(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(co, "HOT", 30)
    seen = []
    real = co.hot_prefixes
    monkeypatch.setattr(co, "hot_prefixes", lambda *a: (lambda h: (seen.append(len(h)), h)[1])(real(*a)))
    assert got(spark.createDataFrame(rows, SCHEMA), least=5) == direct(rows, 5, 2000)
    assert seen[0] > 0


def test_best_rows(spark):
    r = random.Random(3)
    rows = [("a", r.randint(0, 50), f"x{i}") for i in range(900)] + [("b", 1, f"y{i}") for i in range(5)] + [(None, 2, "z")]
    df = spark.createDataFrame(rows, "g string, s long, k string").repartition(6)
    out = co.best_rows(df, "g", [co.F.desc("s"), co.F.asc("k")], 70).where("g IS NOT NULL").collect()
    for g in "ab":
        want = sorted(((-s, k) for h, s, k in rows if h == g))[:70]
        assert [k for _, k in sorted((x["rank"], x["k"]) for x in out if x["g"] == g)] == [k for _, k in want]


def test_bitmap_holds_every_phrase(spark):
    rows = [("en", f"w{i} w{j} é{i}") for i in range(40) for j in range(40)]
    bits = co.phrase_bitmap(spark.createDataFrame(rows, "lang string, phrase string"), 3).value
    w = co.Words([p for _, p in rows], ["en"] * len(rows))
    h, whole = w.hashes(3)
    assert whole.sum() == len(rows) and co.in_bitmap(bits, h[whole]).all()
    other = co.Words([f"v{i} v{i} v{i}" for i in range(2000)], ["en"] * 2000)
    h, whole = other.hashes(3)
    assert co.in_bitmap(bits, h[whole]).mean() < 0.2


def test_string_hashes_ignore_position():
    a = pa.array(["x", "word", "", "é", "word"])
    h = co.string_hashes(a)
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert (co.string_hashes(a.slice(1, 3)) == h[1:4]).all()


def test_empty_table_and_clashing_columns(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    names = ["prefix", "word", "words", "phrase", "part", "c", "total"]
    wide = spark.createDataFrame([(1, "a b " * 40, None, *names)], SCHEMA + "".join(f", {c} string" for c in names))
    assert got(wide) == direct([(1, "a b " * 40, None)], 30, 2000)
