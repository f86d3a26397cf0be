"""The dealt operators on small fixtures: edge cases, and comparison with direct versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from terraloom.llm import common, context_mixing, decontam, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, sharding, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000, 99)
ROWS = [
    (1, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (3, None, "en", None), (4, "", None, "b"),
    (None, prose(30, 2), "de", "c"), (5, "  \t\n ", "en", "a"), (6, LONG, "en", "a"), (7, LONG + " x", "en", "b"), (8, "short text", "de", None),
    (9, prose(60, 1) + " tail", "en", "c"), (10, "mail a@b.co, 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 1, None), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, prose(30, 50)), (1, None), (2, ""), (None, prose(30, 51)), (3, "tiny")], "item_id long, text string")


OPERATORS = {
    "pii": lambda d, lab, b: pii.find_private_spans(d),
    "sharding": lambda d, lab, b: sharding.shard_documents(d),
    "exact": lambda d, lab, b: exact_dedup.exact_duplicates(d),
    "mixing": lambda d, lab, b: mixing.mix_units(d),
    "quality": lambda d, lab, b: quality.judged(d, lab),
    "near": lambda d, lab, b: near_dedup.with_keepers(near_dedup.near_classes(d)),
    "lines": lambda d, lab, b: line_dedup.clean_lines(d),
    "tokens": lambda d, lab, b: token_files.encoded(d, token_files.default_tokenizer()),
    "mixing_model": lambda d, lab, b: context_mixing.score_documents(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each_and_empty_tables(docs, empty, labels, benchmark, name):
    assert OPERATORS[name](docs, labels, benchmark).count() == len(ROWS)
    assert OPERATORS[name](empty, labels, benchmark).count() == 0


def test_clashing_columns(spark, labels, benchmark):
    names = ["row", "key", "size", "id", "digest", "shard", "slot", "g", "h", "copies", "_nll", "bucket", "word", "doc"]
    wide = spark.createDataFrame([(1, prose(40, 1), "en", "a", 9, *names)], SCHEMA + "".join(f", `{n}` string" for n in names))
    for kept in (quality.keep_good(wide, labels), near_dedup.drop_near_duplicates(wide), decontam.drop_leaking(wide, benchmark), mixing.mixed_documents(wide)):
        assert kept.columns == wide.columns
        assert kept.count() >= 1
    for f in OPERATORS.values():
        assert f(wide, labels, benchmark).count() == 1


def test_pii_base_and_discovered(spark):
    texts = [f"call +1 (555) 123-4{i:03d} today" for i in range(40)] + ["call +1 (555) 999-0000 1234567890123456 today", "x" * 5000 + "@", "9" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_private_spans(rows).collect()}
    assert [(x.s, x.e) for x in found[3]["phone"]] == [(5, 22)]
    assert not found[40]["phone"]  # too many digits for the base rule
    assert ("phone", 5, 22) in [(x.kind, x.s, x.e) for x in found[40]["added"]]
    assert not found[41]["email"] and not found[42]["card"]


def test_exact_duplicates_with_colliding_digests(docs):
    from pyspark.sql import functions as F

    want = {}
    for i, t, _, _ in ROWS:
        want.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    for digest in (None, lambda text: F.lit("same")):
        got = exact_dedup.exact_duplicates(docs, digest=digest).collect()
        assert sum(r["kept"] for r in got) == len(want)
        assert sorted(r["group_size"] for r in got) == sorted(len(v) for v in want.values() for _ in v)
        for r in got:
            group = next(v for v in want.values() if r["doc_id"] in v)
            assert r["keep_id"] == min((i for i in group if i is not None), default=None)


@pytest.mark.parametrize("n", [1, 2, 10, 5000])
def test_binary_fuse_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert exact_dedup.may_hold(others, *built).mean() < 0.01


def test_shards_are_near_equal(spark):
    rows = [(i, "same text" if i % 3 else prose(20, i)) for i in range(3000)]  # one text holds two thirds of the rows
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_mix_meets_targets(spark):
    rows = [(i, prose(5 + i % 40, i), None if i % 7 == 0 else f"s{i % 4}") for i in range(800)]
    got = mixing.mix_units(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["taken"] = got["copies"] * got["size"]
    sums = got.groupby("g").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(sums["target"].sum() - 1.5 * sums["size"].sum()) < 1e-6 * sums["size"].sum()
    assert (sums["target"] <= 2 * sums["size"] + 1e-9).all() and (abs(sums["taken"] - sums["target"]) < 20).all()
    assert got["copies"].between(0, 2).all()


def test_kneser_ney_is_a_distribution(spark):
    texts = spark.createDataFrame([(prose(200, k),) for k in range(5)], "text string")
    classes, logp = quality.fit(texts)
    p = np.exp(logp.value.astype(np.float64)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=0.02)


def test_quality_keeps_good_and_drops_noise(spark):
    good = [(i, prose(100, i), "en") for i in range(60)]
    noise = [(100 + i, "".join(random.Random(i).choice("!#$%&*0123456789XYZ") for _ in range(500)), "en") for i in range(5)]
    rows = spark.createDataFrame(good + noise, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.keep_good(rows, marks).collect()} == set(range(60))


def test_near_classes_equal_brute_force(spark):
    r, texts = random.Random(3), []
    for k in range(12):
        words = prose(120, 1000 + k).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = "edit" + str(r.randrange(999))
            texts.append(" ".join(copy))
    shingles = [{tuple(t.split()[i: i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = near_dedup.with_keepers(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == dict(enumerate(label))


def test_near_classes_with_a_repeated_passage(spark):
    """Links are by shingle sets, so a passage that one text repeats many times does not part two texts."""
    texts = []
    for k in range(10):
        words = ["%d%s" % (k, w) for w in map(str, range(204))]
        texts += [" ".join(words), " ".join(words + words[40:56] * 50)]
        assert len({tuple(words[i: i + 5]) for i in range(200)}) == 200
    for a, b in zip(texts[::2], texts[1::2]):
        x, y = ({tuple(t.split()[i: i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        assert len(x & y) >= 0.8 * len(x | y)
    got = near_dedup.with_keepers(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: i - i % 2 for i in range(len(texts))}


def test_signature_estimates_probability_jaccard():
    a, b = prose(400, 5).split(), prose(400, 5).split()
    b[::40] = ["x"] * 10
    owner, shingle, weight = near_dedup.weighted([" ".join(a), " ".join(b)])
    one, two = near_dedup.signatures(2, owner, shingle, weight, 1024)
    left, right = (set(shingle[owner == k].tolist()) for k in (0, 1))
    assert abs((one == two).mean() - len(left & right) / len(left | right)) < 0.06


def test_leaks_with_edits(spark, benchmark):
    item = prose(30, 50)
    edited = item[:40] + "Q" + item[41:90] + item[91:]
    rows = [(1, "head " + item.upper().replace(" ", "\n ") + " tail"), (2, prose(80, 3)), (3, "start " + edited), (4, None), (5, item[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, benchmark).collect()}
    assert set(found) == {(1, 0), (3, 0)}
    assert {r["doc_id"] for r in decontam.drop_leaking(docs, benchmark).collect()} == {2, 4, 5}


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, f"{line}\nshort\nalone in this text as a line"), (2, f"{line.upper()} \nshort"), (2, f"{line.upper()} \nshort"), (None, line), (3, None)]
    got = sorted((r["doc_id"] or 99, r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3, 0, rows[0][1]), (2, 2, 1, "short"), (2, 2, 1, "short"), (3, 0, 0, ""), (99, 1, 1, "")]


def test_near_lines_are_found(spark):
    """Recall of pairs with an edit similarity of 0.9, against brute force, by number of words and kind of edit."""
    r, pairs, kinds = random.Random(7), [], []
    for n in (4, 8, 12, 20, 50):
        for kind in ("word", "letters"):
            for k in range(40):
                words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]
                line = " ".join(words)
                if kind == "word":
                    at = r.randrange(n)
                    words[at] = words[at][:-1] + ("q" if words[at][-1] != "q" else "x") if n < 12 else "edit"
                    other = " ".join(words)
                else:
                    other = list(line)
                    for _ in range(r.randint(0, len(line) // 12)):
                        at = r.randrange(len(other))
                        other[at] = r.choice("abcdefghijklmnopqrstuvwxyz")
                    other = "".join(other)
                codes = [np.array([ord(c) for c in x], np.uint32) for x in (line, other)]
                if line != other and line_dedup.edit_distance_within(*codes, int(0.1 * max(len(line), len(other)))):
                    pairs.append((line, other))
                    kinds.append((n, kind))
    docs = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    dropped = {x["doc_id"] // 2 for x in line_dedup.clean_lines(docs).where("n_dropped = 1").collect()}
    for kind in set(kinds):
        own = [i for i, k in enumerate(kinds) if k == kind]
        assert sum(i in dropped for i in own) >= 0.9 * len(own), kind


def test_short_lines_join_by_identity(spark):
    docs = spark.createDataFrame([(1, "All rights\nown text of one"), (2, "all  RIGHTS\nno copy here"), (3, "all\nall of")], "doc_id long, text string")
    assert {x["doc_id"]: x["text"] for x in line_dedup.clean_lines(docs).collect()} == {1: "All rights\nown text of one", 2: "no copy here", 3: "all\nall of"}


def test_edit_distance():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [min([row[j - 1] + (x != b[j - 1]), row[j] + 1]) if j else i for j in range(len(b) + 1)]
            for j in range(1, len(b) + 1):
                row[j] = min(row[j], row[j - 1] + 1)
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(2))
        codes = [np.array([ord(c) for c in x], np.uint32) for x in (a, b)]
        for limit in range(5):
            assert line_dedup.edit_distance_within(*codes, limit) == (full(a, b) <= limit)


def test_token_files_equal_the_library(docs):
    path = token_files.default_tokenizer()
    tokenizer, start = Tokenizer.from_file(path), 0
    got = sorted(token_files.encoded(docs, path).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    for r, (_, text, _, _) in zip(got, order):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_ids_of_signs_that_fold_to_several(spark):
    """A sign whose lower case ends in a mark joins the stop after it; other tokenizers encode whole texts."""
    import public_tokenizers

    signs = ["a", "B", "é", "É", "İ", "Σ", "ß", "1", " ", "  ", "\n", " ", ".", ",", "..,", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "😀", "́", "THE "]
    r = random.Random(11)
    texts = ["Aİ. b", *("".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(2000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library, start = Tokenizer.from_file(path), 0
        for x, text in zip(sorted(token_files.encoded(rows, path).collect(), key=lambda x: x["doc_id"]), texts, strict=True):
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), repr(text)
            start += len(ids)


def test_context_mixing_base_and_held_out(spark):
    texts = [(i, prose(80, i)) for i in range(150)]
    got = context_mixing.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    train = [t.split() + ["\n"] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for t in train:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got.itertuples():
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in dict(texts)[r.doc_id].split() + ["\n"])
        assert abs(want - r.base_score) < 1e-6 and r.train_tokens == n
    held = got[got["held_out"]]
    assert held["score"].sum() > 1.1 * held["base_score"].sum()  # close to the best there is for words drawn evenly


def test_context_mixing_counts_rare_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(60, i)) for i in range(20)], "doc_id long, text string")
    columns = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits"]
    want = context_mixing.score_documents(docs).toPandas().sort_values("doc_id")[columns].to_numpy(float)
    monkeypatch.setattr(context_mixing, "HEAVY", 1)  # no word is broadcast, the end neither
    got = context_mixing.score_documents(docs).toPandas().sort_values("doc_id")[columns].to_numpy(float)
    assert np.allclose(got, want, rtol=1e-5)


def test_context_mixing_sees_the_words_before(spark):
    """Words follow each other by a rule: texts that keep it score higher than the same words in another order, whether learned from or not."""
    follow = {w: VOCABULARY[(5 * i + 3) % len(VOCABULARY)] for i, w in enumerate(VOCABULARY)}
    r, texts = random.Random(5), []
    for _ in range(200):
        words = [r.choice(VOCABULARY)]
        for _ in range(60):
            words.append(follow[words[-1]] if r.random() < 0.9 else r.choice(VOCABULARY))
        texts.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    held = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows += [(i, " ".join(r.sample(w, len(w)))) for i, w in zip(held, [texts[j] for j in range(200) if zlib.crc32(str(j).encode()) % 7 == 2])]
    got = context_mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    ordered, mixed = got[got["held_out"] & (got.index < 200)], got[got.index >= 200]
    n = min(len(ordered), len(mixed))
    assert n > 5 and (ordered["score"].sort_index().to_numpy()[:n] > 0.8 * mixed["score"].sort_index().to_numpy()[:n]).all()
    assert ordered["score"].sum() > 0.6 * ordered["base_score"].sum()  # the base does not see the rule
    known = got[~got["held_out"]]
    assert known["score"].sum() > 0.6 * known["base_score"].sum()


def test_context_mixing_leaves_share_one(spark):
    """In any place the probabilities of all leaves add up to one, and Huffman codes are as long as a direct construction's."""
    import heapq

    counts = np.array([50, 3, 3, 20, 7, 1, 11])
    code = context_mixing.TextCode(pa.array([f"w{i}" for i in range(7)]), counts, 9, 4)
    heap, weight = [[int(w), i, [i]] for i, w in enumerate([*counts, 9, 4])], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        weight += a[0] + b[0]
        heapq.heappush(heap, [a[0] + b[0], min(a[1], b[1]), a[2] + b[2]])
    depth = np.bincount(np.concatenate([on for on, _, _ in context_mixing._decisions(code, np.arange(9, dtype=np.int32), *np.zeros((2, 9), np.uint64))]))
    assert (depth * [*counts, 9, 4]).sum() == weight
    draw = np.random.default_rng(3)
    model = context_mixing.TextModel(draw.integers(0, 90, (2, code.first[-1])).astype(np.int32), np.full((3, context_mixing.TEXT_GATES), 0.4))
    for last, both in ((1, 2), (1 << 60, 77)):
        p = 10 ** context_mixing.token_scores(code, model, np.arange(9, dtype=np.int32), *np.array([[last] * 9, [both] * 9], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_context_mixing_learns_as_from_plain_counts():
    """Counts without a token itself, learning and scores from the packed tables are those of the counts as they are, and nodes without a context have the counts of the words."""
    draw = np.random.default_rng(8)
    weight = draw.integers(1, 400, 60)
    code = context_mixing.TextCode(pa.array([f"w{i:02d}" for i in range(58)]), weight[:58], int(weight[58]), int(weight[59]))
    leaf = draw.permutation(np.repeat(np.arange(60, dtype=np.int32), weight))
    last, both = draw.integers(0, 9, (2, len(leaf))).astype(np.uint64)
    counts = np.zeros((2, code.first[-1]), np.int32)
    steps = list(context_mixing._decisions(code, leaf, last, both))
    for _, bit, slots in steps:
        np.add.at(counts, (np.broadcast_to(bit, slots.shape), slots), 1)
    assert (counts[:, : code.inner].T == code.nodes).all()
    total = np.zeros(2 * code.first[-1], np.int32)
    context_mixing.count_decisions(code, total, leaf, last, both)
    assert (total.reshape(-1, 2)[code.inner:].T == counts[:, code.inner:]).all()

    level = lambda n: (n > 0) * 1 + (n > 3) + (n > 50)
    first = np.full((3, context_mixing.TEXT_GATES), 0.3)
    slope, bend, score = np.zeros((3, 64)), np.zeros((3, 64)), np.zeros(len(leaf))
    for on, bit, slots in steps:
        zeros, ones = np.maximum(counts[0][slots] - (bit == 0), 0), np.maximum(counts[1][slots] - (bit == 1), 0)
        x, n = np.log((ones + 0.4) / (zeros + 0.4)), level(zeros + ones)
        gate = (n[0] * 4 + n[1]) * 4 + n[2]
        p = 1 / (1 + np.exp(-np.clip((x * first[:, gate]).sum(axis=0), -14, 14)))
        for k in range(3):
            slope[k] += np.bincount(gate, (bit - p) * x[k], 64)
            bend[k] += np.bincount(gate, p * (1 - p) * x[k] ** 2, 64)
        x, n = np.log((counts[1][slots] + 0.4) / (counts[0][slots] + 0.4)), level(counts.sum(axis=0)[slots])
        p = 1 / (1 + np.exp(-np.clip((x * first[:, (n[0] * 4 + n[1]) * 4 + n[2]]).sum(axis=0), -14, 14)))
        score[on] += np.log10(np.where(bit == 1, p, 1 - p))
    learned, seen = context_mixing.learned(code, context_mixing.Tallies(counts), first, leaf, last, both)
    assert np.allclose(learned, first + slope / (3 * bend + 20), atol=1e-5) and seen.sum() == sum(len(on) for on, _, _ in steps)
    assert np.allclose(context_mixing.token_scores(code, context_mixing.TextModel(counts, first), leaf, last, both), score, rtol=1e-5)


def test_words_of_an_array_hash_as_in_texts():
    words = pa.array(["skip", "a", "Wort", "größe", "", "\U0001f600x", "a"]).slice(1)
    want = [common.word_hashes([w], fold=False)[0].sum() for w in words.to_pylist()]
    assert common.array_hashes(words).tolist() == want
    assert len(common.array_hashes(pa.array([], pa.string()))) == 0


def test_quality_tasks_let_go_of_the_encoder():
    """The encoder a worker process kept from a run before is freed before the quality model is used there."""
    import weakref
    from types import SimpleNamespace

    from pyspark.sql import types as T

    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    kept = weakref.ref(token_files.encoder_of(definition))
    assert token_files.encoder_of(definition) is kept()  # from task to task of one step it stays
    texts = SimpleNamespace(columns=["text"], schema=T.StructType([T.StructField("text", T.StringType())]), mapInArrow=lambda function, schema: function)
    assert list(quality.scored(texts, (None, None))(iter([]))) == [] and kept() is None


def test_pipeline_stages_chain(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and (out.sort_values("start")["n_tokens"].cumsum().shift(fill_value=0) == out.sort_values("start")["start"]).all()


def test_row_digest_tells_nulls(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("", None), (None, None), ("a", None)], "x string, y string")
    assert rows.select(common.row_digest(rows).alias("d")).distinct().count() == 4


def test_rare_characters_have_their_own_probability(spark):
    """More letters than the model has symbols: each of the rest still counts by its own frequency, and unseen ones by what is left."""
    letters = [chr(0x4E00 + i) for i in range(100)]
    body = "".join(c * (200 - i) for i, c in enumerate(letters))
    texts = spark.createDataFrame([("en", body)], "lang string, text string")
    model = quality.fit(texts)
    classes, share = model[0].value
    rest = letters[quality.SYMBOLS - 2:]
    seen, total = len(rest), sum(body.count(c) for c in rest)
    assert np.exp(share[[ord(c) for c in rest]]) == pytest.approx([body.count(c) / (total + seen) for c in rest], rel=1e-5)
    assert set(share[[ord(c) for c in letters[: quality.SYMBOLS - 2]]]) == {0.0}
    assert np.exp(share[1:].astype(np.float64)).sum() == pytest.approx(1 + quality.SYMBOLS - 2, rel=1e-4)
    probe = spark.createDataFrame([(1, rest[0]), (2, rest[-1]), (3, "\U0001F600")], "doc_id int, text string")
    nll = {r.doc_id: r._nll for r in quality.scored(probe, model).collect()}
    assert nll[1] < nll[2] < nll[3]


def test_rare_characters_count_in_their_contexts(spark):
    """More letters than fit the table of common ones: each has n-grams of its own, as a direct Kneser-Ney over all characters says."""
    from collections import Counter, defaultdict

    r = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(90)] + ["\U00020000"]
    follow = {c: r.sample(letters, 3) for c in letters}

    def walk(n):
        out = [r.choice(letters)]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return "".join(out)

    body = [walk(120) for _ in range(40)]
    model = quality.fit_all(spark.createDataFrame([(t,) for t in body], "text string").repartition(3))
    share = model[0].value[1]
    grams = Counter()
    for t in body:
        line = "\0" * 3 + t + "\0"
        grams.update(line[i: i + 4] for i in range(len(line) - 3))
    levels, now = [], grams
    for order in (4, 3, 2, 1):
        now = now if order == 4 else Counter(g[1:] for g in now)
        k = [max(sum(v == i for v in now.values()), 1) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        cut = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, left = defaultdict(float), defaultdict(float)
        for g, n in now.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[min(n, 3) - 1]
        levels.append({"gram": {g: (n - cut[min(n, 3) - 1]) / total[g[:-1]] for g, n in now.items()}, "left": {c: left[c] / total[c] for c in total}})

    def nll(t):
        line, out = "\0" * 3 + t + "\0", 0.0
        for i in range(len(line) - 3):
            p = np.exp(float(share[ord(line[i + 3])])) / quality.SYMBOLS
            for order, level in enumerate(levels[::-1], 1):
                g = line[i + 4 - order: i + 4]
                p = level["gram"].get(g, 0.0) + level["left"].get(g[:-1], 1.0) * p
            out -= np.log(p)
        return out

    rare = [c for c in letters if model[0].value[0][ord(c)] >= quality.SYMBOLS]
    assert len(rare) > 20
    probes = [walk(80), "".join(r.choice(letters) for _ in range(80)), "x" + rare[0] + "\U0001F600" + rare[1] + follow[rare[1]][0], "".join(rare), ""]
    got = {x.k: x._nll for x in quality.scored(spark.createDataFrame(list(enumerate(probes)), "k int, text string"), model).collect()}
    assert [got[k] for k in range(len(probes))] == pytest.approx([nll(t) for t in probes], rel=2e-3)
    assert got[0] < 0.5 * got[1]  # what follows a rare character is known
