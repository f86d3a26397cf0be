"""Distributed operators against small sequential models."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import stats as ST
from terraloom.operators import density as de
from terraloom.operators import lidar as li
from terraloom.operators import quantiles as qn
from terraloom.operators import ranking as rk
from terraloom.operators import spatial as sp
from terraloom.operators.graph import connected_components
from terraloom.runtime import salted_join

EPS = 0.01


def cloud(seed, n=220, hot=80):
    """Points with exact copies, one dense clump and a scattered rest."""
    rnd = random.Random(seed)
    pts = [(rnd.uniform(0, 0.2), rnd.uniform(0, 0.2)) for _ in range(n)]
    pts += [(0.05 + rnd.gauss(0, 0.002), 0.05 + rnd.gauss(0, 0.002)) for _ in range(hot)]
    pts += [(0.15, 0.15)] * 40 + [(0.1, 0.02)] * 2
    rnd.shuffle(pts)
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)]


def frame(spark, pts):
    return spark.createDataFrame(pts, "id long, lon double, lat double")


def near(p, q, eps, closed):
    d = math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    return d <= eps if closed else d < eps


def model_dbscan(pts, eps, k, closed=True):
    nb = {p[0]: [q[0] for q in pts if near(p, q, eps, closed)] for p in pts}
    core = {i for i, ns in nb.items() if len(ns) >= k}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            for j in nb[stack.pop()]:
                if j in core and j not in label:
                    label[j] = i
                    stack.append(j)
    out = {}
    for i in nb:
        reach = [label[j] for j in nb[i] if j in core]
        out[i] = label[i] if i in core else (min(reach) if reach else -1)
    return out, core


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5), (3, 1)])
def test_dbscan(spark, seed, k):
    pts = cloud(seed)
    want, core = model_dbscan(pts, EPS, k)
    got = {r.id: (r.cluster_id, r.is_core) for r in de.dbscan(frame(spark, pts), "id", EPS, k).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert {i for i, (_, c) in got.items() if c} == core


def test_dbscan_on_chains_at_the_radius(spark):
    """Cells that only touch through points near the radius need all three decision steps."""
    rnd = random.Random(5)
    pts = []
    for k in range(12):
        x = k * EPS * 0.98
        pts += [(x + rnd.uniform(0, EPS * 0.2), rnd.uniform(0, EPS * 0.6)) for _ in range(12)]
    pts = [(i, x, y) for i, (x, y) in enumerate(pts)]
    want, _ = model_dbscan(pts, EPS, 3)
    got = {r.id: r.cluster_id for r in de.dbscan(frame(spark, pts), "id", EPS, 3).collect()}
    assert got == want


def model_leaders(pts, eps, k):
    nb = {p[0]: [q[0] for q in pts if near(p, q, eps, False)] for p in pts}
    owner = {}
    for i in sorted(nb):
        if i not in owner and len(nb[i]) >= k:
            for j in nb[i]:
                owner.setdefault(j, i)
    return {i: owner.get(i) for i in nb}


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 3), (4, 6)])
def test_leaders(spark, seed, k):
    pts = cloud(seed)
    got = {r.id: r.leader for r in de.leaders(frame(spark, pts), "id", EPS, k).collect()}
    assert got == model_leaders(pts, EPS, k)


def test_threshold_graph(spark):
    pts = cloud(9)
    want, _ = model_dbscan(pts, EPS, 1, closed=False)
    size = {}
    for c in want.values():
        size[c] = size.get(c, 0) + 1
    got = {r.id: r.cluster_id for r in de.threshold_graph(frame(spark, pts), "id", EPS, 4).collect()}
    assert got == {i: (c if size[c] >= 4 else -1) for i, c in want.items()}


def test_components_long_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(201)}
    assert got == want


def test_nearest_distance(spark):
    pts = cloud(6, n=150, hot=60) + [(9001, 80.0, 40.0), (9002, -120.0, -30.0)]
    got = {r.id: r.nn_deg for r in sp.nearest_distance(frame(spark, pts), "id").collect()}
    for p in pts:
        want = min(math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) for q in pts if q[0] != p[0])
        assert got[p[0]] == pytest.approx(want, abs=1e-12), p


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_quantiles(spark, limit):
    """Both the histogram search and the direct ranking are exact, also with heavy ties."""
    rnd = random.Random(3)
    groups = {
        "a": [rnd.gauss(0, 1) for _ in range(3000)],
        "b": [1.0] * 500 + [rnd.random() for _ in range(7)],
        "c": [rnd.choice([0.1, 0.2, 0.3]) for _ in range(400)] + [1e9],
        "d": [42.0],
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan"))], "g string, x double")
    probs = {"p1": 0.01, "p50": 0.5, "p98": 0.98}
    got = {r.g: r for r in qn.quantiles(df, ["g"], "x", probs, cell_limit=limit).collect()}
    for g, xs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(xs, p * 100), rel=1e-12, abs=1e-12)


def test_salted_join_keeps_every_row(spark):
    """A key with most rows is sliced without losing or repeating matches."""
    left = [(i, 7 if i % 10 else i % 30) for i in range(3000)]
    right = [(k, k * 10 + j) for k in range(30) for j in range(2)]
    l, r = spark.createDataFrame(left, "id long, k long"), spark.createDataFrame(right, "k long, v long")
    got = sorted((x.id, x.k, x.v) for x in salted_join(l, r, ["k"], "id", parts=16).collect())
    assert got == sorted((i, k, v) for i, k in left for kk, v in right if kk == k)


def test_track_neighbours_across_buckets(spark):
    rnd = random.Random(2)
    rows = [(g, o, float(rnd.random())) for g in (1, 2) for o in rnd.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "g long, o long, x double")
    got = {(r.g, r.o): (r.prev_x, r.next_x) for r in li.with_neighbours(df, ["g"], "o", ["x"], bucket=16).collect()}
    for g in (1, 2):
        s = sorted((o, x) for gg, o, x in rows if gg == g)
        for i, (o, _) in enumerate(s):
            assert got[(g, o)] == (s[i - 1][1] if i else None, s[i + 1][1] if i + 1 < len(s) else None)


def model_first_match(spectral, lidar):
    found, used = [], set()
    for s in spectral:
        for l in lidar:
            d = math.hypot(s[1] - l[1], s[2] - l[2]) * 111000
            if d > 1500:
                continue
            lc = min(0.9, l[3] / 20)
            a, b = (0.6, 0.15) if len(found) < 5 else (0.7, 0.2) if len(found) < 20 else (0.8, 0.3)
            if s[3] >= a and lc >= b:
                found.append((s[0], l[0]))
                used.add(l[0])
                break
    return found, used


@pytest.mark.parametrize("n", [12, 400])
def test_first_match(spark, n):
    rnd = random.Random(n)
    spectral = [(i, rnd.uniform(0, 0.1), rnd.uniform(0, 0.1), round(rnd.random(), 3)) for i in range(n)]
    lidar = [(10_000 + i, rnd.uniform(0, 0.1), rnd.uniform(0, 0.1), rnd.randrange(30)) for i in range(n // 4)]
    rows = [(i, "sentinel2", x, y, c, 0) for i, x, y, c in spectral] + [(i, "gedi", x, y, 0.6, k) for i, x, y, k in lidar]
    df = spark.createDataFrame(rows, "det_id long, provider string, lon double, lat double, confidence double, n_points int")
    out = sp.first_match(df).collect()
    want, used = model_first_match(spectral, lidar)
    assert sorted((r.det_id, r.lidar_id) for r in out if r.convergence_type == "multi_sensor") == sorted(want)
    assert {r.det_id for r in out if r.convergence_type == "gedi_only"} == {l[0] for l in lidar} - used


def test_first_match_without_spectral(spark):
    df = spark.createDataFrame(
        [(1, "gedi", 0.0, 0.0, 0.1, 5)], "det_id long, provider string, lon double, lat double, confidence double, n_points int"
    )
    assert [r.convergence_type for r in sp.first_match(df).collect()] == ["gedi_only"]


def model_diverse(rows, k):
    m, kept, count = max(3, k // 4), [], {}
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    for r in ranked:
        if len(kept) < k and (count.get(r[1], 0) < m or r[3] > 0):
            kept.append(r)
            count[r[1]] = count.get(r[1], 0) + 1
    rest = [r for r in ranked if r not in kept]
    return [r[0] for r in kept + rest[: max(0, k - len(kept))]]


@pytest.mark.parametrize("seed", range(4))
def test_diverse_top(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.choice("aaaaabc"), round(rnd.random(), 2), rnd.choice([0.0, 0.0, 0.0, 0.4]) if seed % 2 else 0.0) for i in range(rnd.choice([8, 60]))
    ]
    df = spark.createDataFrame(rows, "det_id long, det_type string, enhanced_score double, convergence_score double")
    got = [r.det_id for r in rk.diverse_top(df, 12).orderBy("rank").collect()]
    assert got == model_diverse(rows, 12)[:12]


def test_distribution_functions(spark):
    zs = [-6.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 3.1, 5.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = {r.z: r.p for r in df.select("z", ST.normal_cdf(F.col("z")).alias("p")).collect()}
    for z in zs:
        assert got[z] == pytest.approx(statistics.NormalDist().cdf(z), abs=1e-14)
    # t with two degrees of freedom has a closed form; many degrees approach the normal
    ts = [0.0, 0.4, 1.9, 7.5]
    df = spark.createDataFrame([(t,) for t in ts], "t double")
    two = {r.t: r.p for r in df.select("t", ST.t_two_sided_p(F.col("t"), F.lit(2.0)).alias("p")).collect()}
    big = {r.t: r.p for r in df.select("t", ST.t_two_sided_p(F.col("t"), F.lit(5e7)).alias("p")).collect()}
    for t in ts:
        assert two[t] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
        assert big[t] == pytest.approx(2 * (1 - statistics.NormalDist().cdf(t)), abs=1e-7)


def test_beta_fraction_takes_batches(spark):
    """p values of a table with missing and undefined rows; the fraction is evaluated for whole batches, not by a fold per row."""
    df = spark.createDataFrame([(0.5, 1.0), (-2.5, 1.0), (1.5, 2.0), (12.0, 2.0), (None, 2.0), (1.0, None), (1.0, 0.0)], "t double, df double")
    out = df.select("t", "df", ST.t_two_sided_p(F.col("t"), F.col("df")).alias("p"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.t is None or not r.df:
            assert r.p is None
        else:  # closed forms for one and two degrees of freedom
            t = abs(r.t)
            assert r.p == pytest.approx(1 - 2 / math.pi * math.atan(t) if r.df == 1 else 1 - t / math.sqrt(2 + t * t), abs=1e-12)
