"""Neighbourhood invariants, shape detectors on planted shapes, readers and writers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import display as di
from terraloom.operators import export as ex
from terraloom.operators import quality as qa
from terraloom.operators import regions as rg
from terraloom.operators import shapes as sh
from terraloom.operators import stencil as st
from terraloom.sources import readers as rd
from terraloom.sources import registry as reg
from terraloom.streaming.ingest import process_new_scenes

PX = "scene_id long, pix_row int, pix_col int, v double"


def image(spark, arr, scene=0):
    return spark.createDataFrame([(scene, r, c, float(x)) for (r, c), x in np.ndenumerate(arr)], PX)


def grid(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("pix_row", "pix_col", col).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def mirror_pad(a, h):
    return np.pad(a, h, mode="reflect")


def test_convolution_matches_padding_model(spark):
    a = np.random.default_rng(0).random((9, 7))
    w = st.gaussian_weights(1.0, 3)
    got = grid(st.separable(image(spark, a), "v", w, w, "o"), "o", a.shape)
    p = mirror_pad(a, 3)
    want = sum(w[i] * w[j] * p[i : i + 9, j : j + 7] for i in range(7) for j in range(7))
    assert np.allclose(got, want)


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_opening_and_closing_bracket_the_input(spark, size):
    a = (np.random.default_rng(size).random((16, 16)) > 0.35).astype(float)
    img = image(spark, a)
    low = grid(st.morphology(img, "v", [("open", size)], "o"), "o", a.shape)
    high = grid(st.morphology(img, "v", [("close", size)], "o"), "o", a.shape)
    assert (low <= a).all() and (a <= high).all()
    twice = grid(st.morphology(st.morphology(img, "v", [("open", size)], "v"), "v", [("open", size)], "o"), "o", a.shape)
    assert (twice == low).all()


def test_labels_match_flood_fill(spark):
    a = np.random.default_rng(7).random((20, 20)) > 0.45
    for conn in (4, 8):
        lab = rg.label_regions(image(spark, a.astype(float)).where("v = 1"), conn)
        got = {(r.pix_row, r.pix_col): (r.comp_row, r.comp_col) for r in lab.collect()}
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
        seen = {}
        for r, c in zip(*np.nonzero(a)):
            if (r, c) in seen:
                continue
            stack, seen[(r, c)] = [(r, c)], (r, c)
            while stack:
                y, x = stack.pop()
                for dy, dx in steps:
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < 20 and 0 <= q[1] < 20 and a[q] and q not in seen:
                        seen[q] = (r, c)
                        stack.append(q)
        assert got == {tuple(map(int, k)): tuple(map(int, v)) for k, v in seen.items()}


def test_gap_fill_leaves_large_gaps(spark):
    a = np.ones((24, 24)) * 3.0
    rows = [(0, r, c, None if (r, c) == (3, 3) or (8 <= r < 15 and 8 <= c < 15) else 3.0) for r in range(24) for c in range(24)]
    df = spark.createDataFrame(rows, PX)
    got = grid(st.fill_small_gaps(df, "v", 5, "o"), "o", a.shape)
    assert got[3, 3] == 3.0 and np.isnan(got[11, 11])


def test_planted_line_and_circle_are_found(spark):
    a = np.zeros((60, 60))
    a[10, 5:55] = 1
    edge = spark.createDataFrame([(0, int(r), int(c)) for r, c in zip(*np.nonzero(a))], "scene_id long, pix_row int, pix_col int")
    seg = sh.straight_segments(edge, votes=40).where("theta = 90").collect()
    assert [(s.y1, s.y2, {s.x1, s.x2}, s.length_px) for s in seg] == [(10, 10, {5, 54}, 49.0)]
    ring = {(round(30 + 8 * math.sin(t)), round(25 + 8 * math.cos(t))) for t in np.linspace(0, 2 * math.pi, 400)}
    edge = spark.createDataFrame([(0, r, c) for r, c in ring], "scene_id long, pix_row int, pix_col int")
    best = sh.circles(edge, range(6, 11), 36, 12.0).orderBy(F.desc("votes")).first()
    assert (abs(best.cx - 25) <= 1, abs(best.cy - 30) <= 1, abs(best.radius - 8) <= 1) == (True, True, True)


def test_circle_suppression_is_greedy_by_votes(spark):
    """The leaders are the sequential non-maximum suppression of the accumulator."""
    rng = np.random.default_rng(1)
    px = {(int(r), int(c)) for r, c in rng.integers(0, 30, (160, 2))}
    edge = spark.createDataFrame([(0, r, c) for r, c in px], "scene_id long, pix_row int, pix_col int")
    votes = [(r.votes, r.radius, r.cx, r.cy) for r in sh.circle_votes(edge, range(3, 6), 12).collect()]
    kept = []
    for v in sorted(votes, key=lambda t: (-t[0], t[1], t[2], t[3])):
        if all(math.hypot(v[2] - k[2], v[3] - k[3]) >= 6 for k in kept):
            kept.append(v)
    got = [(r.votes, r.radius, r.cx, r.cy) for r in sh.circles(edge, range(3, 6), 12, 6.0).collect()]
    assert sorted(got) == sorted(kept)


def test_rectangle_is_filled(spark):
    a = np.zeros((30, 30))
    a[5:12, 6:20] = 1
    lab = rg.label_regions(image(spark, a).where("v = 1"), 4)
    r = sh.rectangles(lab).first()
    assert (r.angle_degrees, r.length_px, r.width_px, r.rectangularity) == (0, 14.0, 7.0, 1.0)


def test_granule_files(spark, tmp_path):
    one = dict(longitude=[-53.0, -53.1, -53.2], latitude=[-12.0, -12.1, -12.2], elevation_ground=[100.0, 101.0, float("nan")],
               elevation_canopy_top=[120.0, 99.0, 130.0], shot_number=[1, 2, 3])
    two = dict(longitude=[-54.0], latitude=[-11.0], elevation_ground=[90.0], rh95=[4.0], rh100=[5.0], shot_number=[4])
    for i, g in enumerate((one, two)):
        (tmp_path / f"g{i}_metrics.json").write_text(json.dumps(g))
    got = {r.shot_number: (r.rh95, r.rh100, r.elevation_ground) for r in rd.read_granules(spark, str(tmp_path)).collect()}
    assert got == {1: (20.0, 20.0, 100.0), 2: (0.0, 0.0, 101.0), 3: (None, None, None), 4: (4.0, 5.0, 90.0)}


def test_geojson_round_trip(spark, tmp_path):
    feats = [
        dict(type="Feature", geometry=dict(type="Point", coordinates=[-53.0, -12.0]), properties=dict(id="a", type="circle", confidence=None, area_m2=5.0)),
        dict(type="Feature", geometry=dict(type="LineString", coordinates=[[-53.0, -12.0], [-53.2, -12.4]]), properties=dict(id="b")),
        dict(type="Feature", geometry=dict(type="Polygon", coordinates=[[[-53, -12], [-52, -12], [-52, -11], [-53, -12]]]), properties=dict(id="c", area_m2=None)),
        dict(type="Feature", geometry=dict(type="Point", coordinates=[10.0, 50.0]), properties=dict(id="outside")),
    ]
    (tmp_path / "in.geojson").write_text(json.dumps(dict(type="FeatureCollection", features=feats)))
    d = {r.id: r for r in rd.read_features(spark, str(tmp_path / "in.geojson")).collect()}
    assert set(d) == {"a", "b", "c"}
    assert (d["a"].confidence, d["b"].det_type, d["c"].area_m2) == (0.6, "unknown", 0.0)
    assert (d["b"].lon, d["b"].lat) == (pytest.approx(-53.1), pytest.approx(-12.2))
    out = spark.createDataFrame([(1, "gedi", "gedi_clearing", -12.0, -53.0, 0.9, 2000.0, 12, "trombetas")],
                                "det_id long, provider string, det_type string, lon double, lat double, confidence double, area_m2 double, n_points int, zone_name string")
    ex.write_geojson_lines(ex.lidar_features(out, "r1"), str(tmp_path / "out"))
    j = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert j["geometry"]["coordinates"] == [-53.0, -12.0]  # axis order repaired
    assert j["properties"]["data_provenance"] == dict(zone="trombetas", provider="gedi", run_id="r1")


def test_flag_csv_and_stages(spark, tmp_path):
    d = spark.createDataFrame(
        [(1, 1, "gedi", "line", -53.0, -12.0, None, 200000.0, 90.0)],
        "det_id long, zone_id long, provider string, det_type string, lon double, lat double, confidence double, area_m2 double, angle_degrees double",
    )
    ex.write_flag_csv(qa.detection_flags(d), str(tmp_path / "flags"))
    back = spark.read.option("header", True).csv(str(tmp_path / "flags")).collect()
    assert {r.Severity for r in back} == {"high", "medium"} and {r.Confidence for r in back} == {"N/A"} and len(back) == 3
    ex.write_stage(d, str(tmp_path / "stage"), "r1")
    ex.write_stage(d, str(tmp_path / "stage"), "r2")
    assert ex.read_stage(spark, str(tmp_path / "stage"), "r1").count() == 1


def test_stream_skips_files_already_processed(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "scene_id long, v double"
    spark.createDataFrame([(1, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    process_new_scenes(spark, src, schema, lambda b: b, out, state)
    spark.createDataFrame([(2, 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    process_new_scenes(spark, src, schema, lambda b: b, out, state)
    process_new_scenes(spark, src, schema, lambda b: b, out, state)
    assert sorted(r.scene_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_zone_functions_report_failures(spark):
    df = spark.createDataFrame([(z, i) for z in (1, 2) for i in range(50)], "zone_id long, id long")

    def fn(pdf):
        if pdf["zone_id"].iloc[0] == 2:
            raise ValueError("bad zone")
        assert len(pdf) <= 40
        return pdf.groupby("zone_id", as_index=False).agg(n=("id", "size"))

    merge = lambda states: states.groupby("zone_id", as_index=False).sum()
    schema = "zone_id long, n double"
    rows = reg.zone_reduce(df, fn, merge, lambda s: s, schema, schema, "id", 20).collect()
    assert {r.zone_id: r.n for r in rows} == {1: 50.0, 2: None}
    whole = {r.zone_id: r.n for r in reg.zone_groups(df.where("id < 30"), fn, schema).collect()}
    assert whole == {1: 30.0, 2: None}


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 100])
def test_zone_median_at_every_batch_size(spark, batch):
    import pandas as pd

    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([5, 1, 9, 2, 8, 3, 7, 4, 6, 10])], "zone_id long, id long, x double")
    counts = lambda pdf: pdf.groupby(["zone_id", "x"], as_index=False).agg(n=("x", "size"))
    merge = lambda s: s.groupby(["zone_id", "x"], as_index=False).sum()
    finish = lambda s: pd.DataFrame({"zone_id": [s["zone_id"].iloc[0]], "m": [s["x"].repeat(s["n"].astype(int)).median()]})
    got = reg.zone_reduce(df, counts, merge, finish, "zone_id long, x double, n long", "zone_id long, m double", "id", batch, 2).collect()
    assert [(r.zone_id, r.m) for r in got] == [(1, 5.5)]


def test_density_limit_keeps_the_most_confident(spark):
    rows = [(i, 1, i * 0.05, 0.0, (i * 37 % 100) / 100) for i in range(60)] + [(100 + i, 2, i * 0.05, 1.0, 0.1) for i in range(3)]
    df = spark.createDataFrame(rows, "det_id long, zone_id long, lon double, lat double, confidence double")
    quota = spark.createDataFrame([(1, 7), (2, 7)], "zone_id long, quota long")
    got = {r.det_id for r in di.density_limited(df, quota, "det_id").collect()}
    best = sorted((r for r in rows if r[1] == 1), key=lambda r: (-r[4], r[0]))[:7]
    assert got == {r[0] for r in best} | {100, 101, 102}
