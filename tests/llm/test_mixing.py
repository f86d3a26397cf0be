"""Entropy balancing against a direct solution of the dual, and the rounding."""

import math
import random

import pytest

from terraloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def solve(sizes, target):
    """The multiplier by bisection: rates min(2, exp(lambda * size / mean)) meet the target."""
    mean = sum(sizes) / len(sizes)
    rates = lambda lam: [min(2.0, math.exp(min(700, lam * x / mean))) for x in sizes]
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * x for r, x in zip(rates(mid), sizes)) < target else (lo, mid)
    return rates(hi)


@pytest.mark.parametrize("share", [0.02, 0.4, 1.0, 1.3, 1.9])
def test_rates_equal_the_direct_solution(spark, share):
    r = random.Random(int(share * 10))
    sizes = [r.choice([1, 2, 5, 30, 400]) for _ in range(200)]
    table = spark.createDataFrame([("a", s, sizes.count(s)) for s in set(sizes)] + [("b", 7, 3), ("c", 0, 5)], "g string, size long, n long")
    targets = spark.createDataFrame([("a", sum(sizes), share * sum(sizes)), ("b", 21, 42.0), ("c", 0, 0.0)], "g string, tokens long, target double")
    got = {(x.g, x.size): x.rate for x in mixing.balanced_rates(table, targets).collect()}
    want = dict(zip(sizes, solve(sizes, share * sum(sizes))))
    assert all(abs(got["a", s] - want[s]) < 1e-6 for s in want)
    assert got["b", 7] == 2.0 and got["c", 0] == 0.0
    if share != 1.0:  # the tilt depends on the document
        assert len({round(v, 6) for (g, _), v in got.items() if g == "a"}) > 2
    by_size = [got["a", s] for s in sorted(want)]
    assert by_size == sorted(by_size, reverse=share < 1)


def test_taken_words_meet_the_targets(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.choice([1, 3, 10, 60, 500])), r.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    rows += [(9000 + i, "same words here", "b") for i in range(800)]  # one size has a third of all rows
    rows += [(20000, None, "a"), (20001, "", "e"), (20002, "w " * 5000, "f")]
    got = mixing.mix_units(spark.createDataFrame(rows, SCHEMA).repartition(6)).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 2).all()
    got["taken"] = got["copies"] * got["size"]
    sums = got.groupby("g").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), least=("size", "min"))
    close = sums[sums["size"] > 6000]
    assert (abs(close["taken"] - close["target"]) <= 2).all()
    again = mixing.mix_units(spark.createDataFrame(rows, SCHEMA).repartition(2)).toPandas()
    merged = got.merge(again, on="doc_id")
    assert (merged["copies_x"] == merged["copies_y"]).mean() > 0.99
