"""What grows with the data and what must not: leaders, pyramids, quantiles, covers, flags; and rows with missing values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import circles as ci
from terraloom.operators import contours as ct
from terraloom.operators import coordinates as cs
from terraloom.operators import density as de
from terraloom.operators import display as di
from terraloom.operators import lidar as li
from terraloom.operators import pyramid as py
from terraloom.operators import quantiles as qn
from terraloom.operators import reference_areas as ra
from terraloom.operators import regions as rg
from terraloom.operators import shapes as sh
from terraloom.operators import spatial as sp
from terraloom.plans import analyses as an

POINT = "id long, lon double, lat double"


def scan(points, radius, by=None):
    """The sequential scan over (id, lon, lat), per group if one is given."""
    owner, leads = {}, []
    for i, x, y, *g in sorted(points):
        if i in owner:
            continue
        near = [j for j, u, v, *h in points if h == g and j not in owner and math.sqrt((u - x) ** 2 + (v - y) ** 2) < radius]
        for j in near:
            owner[j] = i
    return owner


def rounds(monkeypatch):
    seen = []
    real = de._block_leaders
    monkeypatch.setattr(de, "_block_leaders", lambda *a: (seen.append(1), real(*a))[1])
    return seen


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_leaders_in_blocks_equal_the_scan(spark, limit):
    r = random.Random(limit)
    pts = [(i, r.choice([0.0, 3.0]) + r.gauss(0, 0.4), r.gauss(0, 0.4)) for i in range(160)]
    r.shuffle(pts)
    pts = [(i, x, y) for i, (_, x, y) in enumerate(pts)] + [(900, pts[0][1], pts[0][2]), (901, 50.0, 50.0)]
    got = {x.id: x.leader for x in de.leaders(spark.createDataFrame(pts, POINT), "id", 0.3, 1, block_points=limit).collect()}
    assert got == scan(pts, 0.3)


def test_leaders_per_group_and_struct_keys(spark):
    r = random.Random(8)
    pts = [(i, r.gauss(0, 0.5), r.gauss(0, 0.5), r.choice("ab")) for i in range(120)]
    df = spark.createDataFrame(pts, POINT + ", g string").withColumn("key", F.struct("id", "g"))
    got = {x.key.id: x.leader.id for x in de.leaders(df, "key", 0.3, 1, by=["g"], block_points=7).collect()}
    assert got == scan(pts, 0.3)


@pytest.mark.parametrize("limit", [20_000, 1_000])
def test_long_chains_take_few_rounds(spark, monkeypatch, limit):
    """10 000 points, each near the next only: the chain of decisions runs through all of them."""
    seen = rounds(monkeypatch)
    n = 10_000
    df = spark.range(n).select("id", (F.col("id") * 0.9).alias("lon"), F.lit(0.0).alias("lat"))
    got = de.leaders(df, "id", 1.0, 1, block_points=limit)
    assert got.where("leader = id").count() == n // 2 and got.where("leader = id AND id % 2 = 1").count() == 0
    assert len(seen) < 20


def test_points_without_coordinates(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0001, 0.0), (3, None, 0.0), (4, 0.0, None), (5, 0.0, 0.0002)]
    df = spark.createDataFrame(rows, POINT)
    assert {r.id: r.leader for r in de.leaders(df, "id", 0.001).collect()} == {1: 1, 2: 1, 5: 1, 3: None, 4: None}
    got = {r.id: (r.cluster_id, r.is_core) for r in de.dbscan(df, "id", 0.001, 3).collect()}
    assert got == {1: (1, True), 2: (1, True), 5: (1, True), 3: (-1, False), 4: (-1, False)}
    assert {r.id: r.nn_deg is None for r in sp.nearest_distance(df, "id").collect()} == {1: False, 2: False, 5: False, 3: True, 4: True}


def test_tracks_without_zone_or_beam(spark):
    rows = [(1, 1, None, 5.0), (2, 1, None, 1.0), (3, None, 2, 7.0), (4, None, 2, 9.0), (5, 1, 1, 3.0)]
    df = spark.createDataFrame(rows, "shot_number long, zone_id long, beam int, rh95 double").withColumn("rh100", F.col("rh95"))
    got = {r.shot_number: r.localmax_rh95 for r in li.with_local_max(df).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 9.0, 4: 9.0, 5: 3.0}
    shots = spark.createDataFrame([(i, None, 100.0 if i else 900.0) for i in range(30)], "shot_number long, zone_id long, elevation_ground double")
    assert [r.shot_number for r in li.elevation_anomalies(shots, ["zone_id"]).collect()] == [0]


# --- pyramid
@pytest.mark.parametrize("seed,opened", [(1, 4), (3, 64)])
def test_circle_aggregates_equal_all_pairs(spark, seed, opened):
    r = random.Random(seed)
    base = [(i, r.choice([0.0, 0.5]) + r.gauss(0, 0.02), r.gauss(0, 0.02), r.random() * 100) for i in range(400)] + [(900, None, 1.0, 5.0)]
    base += [(1000 + i, 0.25, 0.25, 1.0) for i in range(50)]
    probe = [(i, r.gauss(0, 0.05), r.gauss(0, 0.05), r.choice([0.0, 0.001, 0.01, 0.04, 2.0])) for i in range(40)] + [(50, 0.25, 0.25, 0.0), (51, None, 0.0, 1.0)]
    b = spark.createDataFrame(base, POINT + ", v double")
    p = spark.createDataFrame(probe, "key long, lon double, lat double, r double")
    aggs = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "low": ("min", F.col("id")), "high": ("max", F.col("v"))}
    got = {x.key: (x.n, round(x.s, 6), x.low, x.high) for x in py.circle_aggregates(b, p, "key", F.col("r"), aggs, opened).collect()}
    want = {}
    for k, x, y, rad in probe:
        near = [q for q in base if None not in (x, q[1]) and math.sqrt((q[1] - x) ** 2 + (q[2] - y) ** 2) <= rad]
        if near:
            want[k] = (len(near), round(sum(q[3] for q in near), 6), min(q[0] for q in near), max(q[3] for q in near))
    assert got == want


def test_rows_stay_linear_when_all_points_share_a_place(spark, monkeypatch):
    """Thousands of points and as many circles around them: no row per pair, neither for sums nor for nearest partners."""
    n = 4_000
    df = spark.range(n).select("id", (F.rand(1) * 1e-4).alias("lon"), (F.rand(2) * 1e-4).alias("lat"), F.lit(1.0).alias("v")).cache()
    sizes = []
    real = py.cut_lineage
    monkeypatch.setattr(py, "cut_lineage", lambda d: (lambda out: (sizes.append(out.count()), out)[1])(real(d)))
    got = py.circle_aggregates(df, df, "id", F.lit(0.005), {"n": ("sum", F.lit(1))}).agg(F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n) and max(sizes) <= 20 * n
    sizes.clear()
    near = py.nearest_within(df, df.select((F.col("lon") + 1e-5).alias("lon"), "lat"), 1500.0)
    assert near.count() == n and max(sizes) <= 40 * n


@pytest.mark.parametrize("opened", [64])
def test_nearest_within_equals_all_pairs(spark, opened):
    r = random.Random(opened)
    places = [(0.0, 0.0), (179.999, 10.0), (-179.999, 10.0), (30.0, 89.995), (-150.0, 89.995), (10.0, -60.0)]
    cloud = lambda n: [(max(-180.0, min(180.0, x + r.gauss(0, 0.01))), max(-90.0, min(90.0, y + r.gauss(0, 0.004)))) for x, y in places for _ in range(n)]
    base, probe = cloud(25), cloud(12)

    def hav(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    want = {p: m for p in probe if (m := min(hav(p, b) for b in base)) <= 800}
    frame = lambda rows: spark.createDataFrame(rows, "lon double, lat double")
    got = {(x.lon, x.lat): x.metres for x in py.nearest_within(frame(base), frame(probe), 800.0, opened).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    pairs = sp.near_pairs(frame(base), frame(probe), 800.0, "lon")
    listed = {(x.a.lon, x.a.lat, x.b.lon, x.b.lat) for x in pairs.collect()}
    assert pairs.count() == len(listed) and listed == {(*b, *p) for b in base for p in probe if hav(p, b) <= 800}


def test_pairs_across_the_antimeridian(spark):
    rows = [(1, "sentinel2", 179.9995, 0.0, 0.8), (2, "gedi", -179.9995, 0.0, 0.6), (3, "gedi", 170.0, 0.0, 0.6)]
    df = spark.createDataFrame(rows, "det_id long, provider string, lon double, lat double, confidence double").withColumn("det_type", F.lit("x"))
    assert [(r.a.det_id, r.b.det_id) for r in sp.provider_pairs(df).collect()] == [(1, 2)]
    got = {r.det_id: r.convergence_score for r in sp.convergence_per_detection(df).collect()}
    assert got[3] == 0.0 and got[1] == got[2] == pytest.approx(1 - math.radians(0.001) * 6371000 / 1500, abs=1e-9)


# --- quantiles
def test_outliers_do_not_enlarge_the_ranked_cells(spark, monkeypatch):
    """Two outliers pull the range far apart; the cells that are ranked stay below the limit, in few steps."""
    r = random.Random(4)
    xs = [r.gauss(100, 1) for _ in range(3000)] + [1e300, -1e300, float("inf"), 1e-310]
    steps = []
    real = qn._located

    def spied(*args):
        steps.append(real(*args))
        return steps[-1]

    monkeypatch.setattr(qn, "_located", spied)
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0)], "g string, x double")
    probs = {"lo": 0.001, "mid": 0.5, "hi": 0.97}
    got = {x.g: x for x in qn.quantiles(df, ["g"], "x", probs, cell_limit=20).collect()}
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.percentile(xs, p * 100), rel=1e-12) and got["b"][name] == 1.0
    assert 1 <= len(steps) <= 6
    vals = steps[-1][1]
    assert vals.groupBy("g", "_cell").count().agg(F.max("count")).first()[0] <= 20


def test_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert tuple(qn.quantiles(df, [], "x", {"a": 0.25, "b": 0.999}, cell_limit=10).first()) == (25.0, 99.9)


# --- covers
def test_a_large_box_covers_few_cells(spark):
    zones = [(1, -78.0, -20.0, -42.0, 10.0), (2, -60.0, -3.0, -59.9, -2.9), (3, -60.0, -3.0, -60.0, -3.0)]
    z = spark.createDataFrame(zones, "zone_id long, west double, south double, east double, north double")
    box = [F.col(c) for c in cs.ZONE_BOX[1:]]
    per = {r.zone_id: r["count"] for r in sp.box_cover(z, *box, 0.1).groupBy("zone_id").count().collect()}
    assert max(per.values()) <= 4
    assert sp.box_cover(z, *box, 0.25, sp.COVER_LEVELS).groupBy("zone_id").count().agg(F.max("count")).first()[0] < 100
    r = random.Random(1)
    pts = [(i, r.uniform(-80, -40), r.uniform(-22, 12)) for i in range(300)] + [(300 + i, -59.95, -2.95) for i in range(300)] + [(900, -60.0, -3.0), (901, None, 1.0)]
    got = {(x.id, x.z_zone_id) for x in cs.in_zones(spark.createDataFrame(pts, POINT), z).collect()}
    assert got == {(i, k) for i, x, y in pts for k, w, s, e, n in zones if x is not None and w <= x <= e and s <= y <= n}


def test_box_pairs_equal_all_pairs(spark):
    r = random.Random(2)

    def boxes(n):
        out = []
        for i in range(n):
            w, s, a, b = r.uniform(-60, -50), r.uniform(-10, 0), r.choice([0.01, 0.3, 5, 40]), r.choice([0.02, 0.7, 8])
            out.append((i, w, s, w + a * r.random(), s + b * r.random()))
        return out

    left, right = boxes(60), boxes(60)
    schema = "id long, west double, south double, east double, north double"
    got = sorted((x.a.id, x.b.id) for x in sp.box_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4]))


def test_areas_by_cells(spark):
    ref = ra.areas(spark)
    pts = [(i, -72.52 + 0.002 * i, -0.48 - 0.003 * i) for i in range(40)] + [(99, None, None)]
    p = spark.createDataFrame(pts, POINT)
    inside = ra.within(p, ref)
    assert inside.columns == [*p.columns, *ref.columns, "distance_km"]
    ids = {r.id for r in inside.collect()}
    assert 0 < len(ids) < 40 and {r.id for r in ra.outside(p, ref, "id").collect()} == {i for i, _, _ in pts} - ids


# --- crowding is a column: more rows of one group leave the others as they are
def test_twice_the_regions_of_one_scene(spark):
    def stats(n):
        rows = [(1, i, 0, 20 + i % 90) for i in range(n)] + [(2, i, 0, 40) for i in range(3)]
        return spark.createDataFrame(rows, "scene_id long, comp_row int, comp_col int, n_px long")

    few, many = (rg.component_load(stats(n), medium=20, major=60, final=30, medium_top=10, major_top=5) for n in (30, 90))
    assert few.count() == 33 and many.count() == 93
    other = lambda d: sorted(map(tuple, d.where("scene_id = 2").collect()))
    assert other(few) == other(many) and few.where("scene_id = 1 AND passes_load").count() == 10
    assert {r.load_class for r in many.where("scene_id = 1").collect()} == {"major"} and many.where("scene_id = 1 AND passes_load").count() == 5


def test_twice_the_detections_of_one_zone(spark):
    def dets(n):
        rows = [(i, 1, i * 0.05, 0.0, (i * 37 % 100) / 100) for i in range(n)] + [(1000 + i, 2, i * 0.05, 1.0, 0.1) for i in range(3)] + [(2000, 3, 0.0, 5.0, 0.4)]
        return spark.createDataFrame(rows, "det_id long, zone_id long, lon double, lat double, confidence double")

    quota = spark.createDataFrame([(1, 7), (2, 7)], "zone_id long, quota long")
    few, many = (di.density_marked(dets(n), quota, "det_id") for n in (10, 20))
    other = lambda d: sorted(((r.det_id, r.quota, r.quota_rank, r.over_quota) for r in d.where("zone_id <> 1").collect()))
    assert few.count() == 14 and many.count() == 24 and other(few) == other(many)
    assert many.where("zone_id = 1 AND NOT over_quota").count() == 7 and many.where("zone_id = 3 AND over_quota").count() == 0


def test_the_caller_chooses_the_map_view(spark):
    box = dict(west=-61.0, south=-4.0, east=-59.0, north=-2.0)
    for n in (20, 700):
        df = spark.range(n).select(F.col("id").alias("det_id"), (-60 + F.col("id") * 1e-6).alias("lon"), F.lit(-3.0).alias("lat"), F.lit(0.9).alias("confidence"))
        single = di.viewport_view(df, "det_id", box, clustered=False)
        assert single.count() == n and single.where(f"n_in_view = {n}").count() == n and single.first().crowded == (n > 500)
        assert di.viewport_view(df, "det_id", box).count() == 1


# --- sizes that no estimate sees
def spots(spark, n, seed):
    r = random.Random(seed)
    kinds, grades = ["terra_preta", "circle", "gedi_clearing", None], ["high", "medium", "low", None]
    rows = [
        (i % (n - 5), 1, "gedi" if i % 3 == 0 else "sentinel2", r.choice(kinds), round(r.random() * 0.012, 4), round(r.random() * 0.012, 4), r.choice([None, 0.2, 0.7, 0.85, 0.95]), r.choice([None, 5.0, 20000.0, 60000.0]), r.choice(grades))
        for i in range(n)
    ] + [(None, 1, "gedi", "x", 0.001, 0.001, 0.9, 1.0, "high"), (n, 1, "gedi", "x", None, 0.001, 0.9, 1.0, "high")]
    return spark.createDataFrame(rows, "det_id long, zone_id long, provider string, det_type string, lon double, lat double, confidence double, area_m2 double, grade string")


def test_pair_support_is_the_best_pair_and_sorts_no_pairs(spark, monkeypatch):
    df = spots(spark, 160, 5)
    want = {}
    for p in sp.scored_pairs(df).collect():
        k = (p.score, -p.distance, ((p.a.confidence or 0.0) + (p.b.confidence or 0.0)) / 2)
        for i in (p.a.det_id, p.b.det_id):
            if i is not None:
                want[i] = max(want.get(i, k), k)
    plans = []
    real = sp.cut_lineage
    monkeypatch.setattr(sp, "cut_lineage", lambda d: (plans.append(d._jdf.queryExecution().sparkPlan().toString()), real(d))[1])
    got = sp.with_pair_support(df, sp.scored_pairs(df)).collect()
    assert len(got) == df.count() and len(want) > 100
    for r in got:
        k = want.get(r.det_id)
        assert (r.convergent_score, r.combined_confidence) == ((k[0], k[2]) if k else (0.0, None))
        assert r.convergence_distance_m == (-k[1] * 111000 if k else None)
    # the pairs are merged by a hash table of one primitive per end and score, not sorted
    assert any("partial_min(distance" in line and line.lstrip(" +-:").startswith("HashAggregate") for line in plans[0].split("\n"))


def test_multiplied_rows_are_not_broadcast(spark):
    df = spots(spark, 60, 7)
    p = df.select("det_id", "lon", "lat")
    px = spark.range(100).select(F.lit(0).alias("scene_id"), (F.col("id") % 10).cast("int").alias("pix_row"), F.floor(F.col("id") / 10).cast("int").alias("pix_col"), F.lit(1.0).alias("nir"))
    f = p.select("det_id", F.lit(0).alias("scene_id"), F.lit(3).alias("pix_row"), F.lit(4).alias("pix_col"))
    # what is made by exploding is estimated at the size it had before
    for out in (sp.near_pairs(p, p, 0.002, "det_id", metric="planar"), sp.sample_pixels(f, px, "det_id", ["nir"], 1), sp.nearest_distance(p, "det_id")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        for side in plan.split("BroadcastHashJoin")[1:]:
            assert "_dx" not in side.split("\n")[0] and "_salt" not in side.split("\n")[0] and "pix_row" not in side.split("\n")[0]
        assert "SortMergeJoin" in plan


def test_searches_are_dealt_out(spark):
    """A file of one partition must not leave all searches to one task."""
    n = 3 * py.PROBES
    df = spark.range(n).select("id", (F.rand(1) * 0.1).alias("lon"), (F.rand(2) * 0.1).alias("lat")).coalesce(1)
    assert py._dealt(df).rdd.getNumPartitions() == 4


def test_outlines_are_dealt_out(spark):
    """Regions of few bytes must not all be traced in one task."""
    px = spark.range(800).select(
        F.lit(0).alias("scene_id"), F.floor(F.col("id") / 4).cast("int").alias("comp_row"), F.lit(0).alias("comp_col"),
        (F.floor(F.col("id") / 4) * 3 + F.floor(F.col("id") / 2) % 2).cast("int").alias("pix_row"), (F.col("id") % 2).cast("int").alias("pix_col"),
    )
    got = ct.outlines(px).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 200 and {(r.n_px, r.n_steps, r.n_vertices, r.area_px, r.length_px) for r in got} == {(4, 4, 4, 1.0, 1.0)}
    assert len({r.task for r in got}) > 4


def test_components_of_pairs_list_no_pairs(spark, monkeypatch):
    from terraloom.operators import graph as gr

    sizes = []
    real = gr.connected_components
    for seed, n, width in ((5, 160, 0.012), (11, 90, 0.2)):
        df = spots(spark, n, seed)
        df = df.withColumns({c: F.col(c) * (width / 0.012) for c in ("lon", "lat")})
        pairs = sp.scored_pairs(df).select(F.col("a.det_id").alias("src"), F.col("b.det_id").alias("dst"))
        want = {(r.node, r.component) for r in real(pairs).collect()}
        listed = pairs.count()
        monkeypatch.setattr(gr, "connected_components", lambda e: (sizes.append(e.count()), real(e))[1])
        got = [(r.node, r.component) for r in sp.pair_components(df).collect()]
        monkeypatch.undo()
        assert sorted(got) == sorted(want) and want
        if width == 0.012:
            assert max(sizes) <= 5 * n < listed


def test_pair_scores_read_no_texts_per_pair(spark):
    df = spots(spark, 120, 3)
    out = sp.scored_pairs(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0].lower()
    assert "contains" not in plan and "lower(" not in plan and "'high'" not in plan

    def score(a, b, d):
        ladder = lambda v, steps, rest: next((s for t, s in steps if v <= t), rest)
        c = [x.confidence or 0.0 for x in (a, b)]
        mean, gap = sum(c) / 2, abs(c[0] - c[1])
        agree = 3.0 if mean >= 0.9 and gap <= 0.1 else 2.5 if mean >= 0.8 and gap <= 0.2 else 2.0 if mean >= 0.7 and gap <= 0.3 else 1.0 if mean >= 0.6 else 0.5
        kinds = sum(any(s in (x.det_type or "") for s in ("terra_preta", "geometric", "crop_mark")) for x in (a, b))
        area = max(x.area_m2 or 0.0 for x in (a, b))
        g = [x.grade for x in (a, b)]
        grade = {2: 3.0, 1: 2.5}.get(g.count("high")) or {2: 2.0, 1: 1.5}.get(g.count("medium"), 1.0)
        return ladder(d, ((0.0005, 3.0), (0.001, 2.5), (0.002, 2.0), (0.005, 1.0)), 0.5) + agree + 3.0 + (1.0 + kinds) + (0.5 if area >= 50000 else 0.3 if area >= 10000 else 0.0) + grade

    rows = out.collect()
    assert len(rows) > 500 and set(rows[0].a.asDict()) == set(sp.PAIR_COLUMNS)
    for r in rows:
        assert math.isclose(r.score, min(15.0, score(r.a, r.b, r.distance)))


def broadcast_joins(df):
    """The lines of the plan that join a broadcast side."""
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in line]


def from_file(df, folder):
    """``df`` read from a file, whose size is what Spark knows of it."""
    df.coalesce(1).write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_line_votes_are_not_broadcast(spark, tmp_path):
    """An edge pixel becomes 180 rows, which no size estimate sees; repeated pixels vote twice, pixels without a scene do not."""
    px = [(0, r, r) for r in range(20)] + [(0, 30, c) for c in range(25) if c != 12] + [(0, 3, 40), (0, 3, 40), (1, 5, 5), (None, 1, 1)] + [(None, 9, c) for c in range(30)]
    out = sh.straight_segments(from_file(spark.createDataFrame(px, "scene_id long, pix_row int, pix_col int"), tmp_path / "px"), votes=14, max_gap=1.5)
    assert not broadcast_joins(out)
    want, lines = set(), {}
    for s, r, c in px:
        for theta in range(180):
            a = math.radians(theta)
            if s is not None:
                lines.setdefault((s, math.floor(c * math.cos(a) + r * math.sin(a) + 0.5 + 1e-9), theta), []).append((round(r * math.cos(a) - c * math.sin(a), 6), r, c))
    for (s, rho, theta), on in lines.items():
        on.sort()
        cuts = [0] + [i for i in range(1, len(on)) if on[i][0] - on[i - 1][0] > 1.5] + [len(on)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:]), 1):
            if len(on) >= 14 and math.hypot(on[j - 1][1] - on[i][1], on[j - 1][2] - on[i][2]) >= 6:
                want.add((s, rho, theta, len(on), k, j - i, on[i][2], on[i][1], on[j - 1][2], on[j - 1][1]))
    got = [tuple(r)[:10] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(30, 90), (0, 135)} <= {w[1:3] for w in want}


def test_pixels_are_not_broadcast(spark, tmp_path):
    """Of pixels, Spark only knows the size of the files they are made from, so they would pass through the driver."""
    px = from_file(spark.range(900).select(F.lit(0).cast("long").alias("scene_id"), F.floor(F.col("id") / 30).cast("int").alias("pix_row"), (F.col("id") % 30).cast("int").alias("pix_col")), tmp_path / "px")
    settings = ci.scene_settings(px)
    centres = spark.createDataFrame([(0, 12, 12, 40)], "scene_id long, cell_row int, cell_col int, votes long")
    circle = spark.createDataFrame([(0, 15, 15, 8, 40, 40)], "scene_id long, centre_row int, centre_col int, radius int, votes long, support long")
    bands = px.select("*", *[(F.col("pix_row") / 400).alias(b) for b in ("blue", "green", "red", "red_edge_1", "red_edge_3", "nir", "swir1", "swir2")])
    votes = ci.gradient_votes(px.select("*", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy")), settings)
    assert [line for line in broadcast_joins(votes) if "BuildRight" in line] == broadcast_joins(votes) != []  # the settings, one row per scene
    for df in (ci.distance_counts(centres, px, settings), ci.validated_circles(circle, px, settings), an.standard_terra_preta_regions(bands)):
        assert not [line for line in broadcast_joins(df) if "pix_row" in line or "_salt" in line]
