"""Tiles with margins: equal to whole image lines, one exchange for a chain, hot scenes spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import regions as rg
from terraloom.operators import shapes as sh
from terraloom.operators import stencil as st

PX = "scene_id long, pix_row int, pix_col int, v double"
CHAIN = [("open", 2), ("close", 3), ("open", 2)]


@pytest.fixture(scope="module")
def ragged(spark):
    """Two scenes with missing pixels, negative coordinates and NULL values."""
    r = np.random.default_rng(3)
    rows = []
    for scene, shape, low in ((1, (41, 37), (0, 0)), (2, (23, 50), (-9, -4))):
        for i in range(shape[0]):
            for j in range(shape[1]):
                if r.random() < 0.97:
                    rows.append((scene, i + low[0], j + low[1], None if r.random() < 0.06 else float(r.integers(0, 200))))
    return spark.createDataFrame(rows, PX).repartition(5).cache()


def values(df, *cols):
    return sorted((r[0], r[1], r[2], *[None if x is None else x if isinstance(x, list) else round(x, 9) for x in r[3:]]) for r in df.select(*st.PIX, *cols).collect())


FILLED = {
    "opening chain": lambda px, tile: st.morphology(px.fillna(0.0), "v", CHAIN, "o", tile),
    "even dilation": lambda px, tile: st.morphology(px.fillna(0.0), "v", [("dilate", 4), ("erode", 5)], "o", tile),
    "smoothing": lambda px, tile: st.separable(px.fillna(0.0), "v", st.SMOOTH_5, st.SMOOTH_5, "o", "mirror", tile),
    "wide smoothing": lambda px, tile: st.separable(px.fillna(0.0), "v", *[st.gaussian_weights(2.0, 8)] * 2, "o", "edge", tile),
    "gap fill": lambda px, tile: st.fill_small_gaps(px, "v", 3, "o", tile),
    "gradient": lambda px, tile: st.gradient(px.fillna(0.0), "v", "scharr", "edge", tile).withColumn("o", F.col("magnitude")),
}


@pytest.mark.parametrize("name", FILLED)
@pytest.mark.parametrize("tile", [1, 8, 17])
def test_tiles_equal_lines(ragged, name, tile):
    assert values(FILLED[name](ragged, tile), "o") == values(FILLED[name](ragged, None), "o")


@pytest.mark.parametrize("tile", [3, 8])
def test_canny_on_tiles(ragged, tile):
    px = ragged.fillna(0.0)
    for blur in (None, 0.8):
        want = values(sh.canny(px, "v", 150, 400, blur=blur, keep=["gx", "gy"], tile=None), "gx", "gy")
        assert want and values(sh.canny(px, "v", 150, 400, blur=blur, keep=["gx", "gy"], tile=tile), "gx", "gy") == want


def test_irregular_openings_on_tiles(ragged):
    px = ragged.where("v > 60").withColumns({"m": F.lit(1), "row_end": F.lit(40), "col_end": F.lit(49)})
    run = lambda tile: values(st.irregular_open(px, "m", F.col("scene_id") % 3, "o", tile), "o")
    assert run(5) == run(None)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_one_exchange_for_a_chain(spark, ragged):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        px = ragged.fillna(0.0)
        assert exchanges(st.morphology(px, "v", CHAIN, "o")) == 1
        assert exchanges(st.morphology(px, "v", CHAIN, "o", None)) == 7
        bands = px.withColumns({"b": F.col("v"), "c": F.col("v")})
        assert exchanges(st.fill_gaps(bands, {"v2": "v", "b2": "b", "c2": "c"}, 5)) == 1
        assert exchanges(st.gradient(st.separable(st.tiled(px, 3), "v", st.SMOOTH_5, st.SMOOTH_5, "s"), "s")) == 1
        # one scene has all pixels; its tiles are dealt out
        spread = st.tiled(px.where("scene_id = 1"), 2, 4).select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_are_bounded(ragged):
    n = ragged.count()
    assert st.tiled(ragged, 8, 4).count() <= 4 * n
    assert st.untiled(st.tiled(ragged, 8, 4)).count() == n


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [1, 3, 8, 256])
def test_labels_across_tiles(spark, tile, connectivity):
    a = np.random.default_rng(tile).random((26, 31)) > 0.42
    a[5, :], a[:, 11] = True, True  # regions over many tiles
    rows = [(s, int(r) - 6, int(c) - 3, "x") for s in (1, 2) for r, c in zip(*np.nonzero(a if s == 1 else a[::-1]))]
    px = spark.createDataFrame(rows, "scene_id long, pix_row int, pix_col int, extra string")
    lab = rg.label_regions(px, connectivity, tile)
    assert lab.columns == [*px.columns, "comp_row", "comp_col"]
    got = {(r.scene_id, r.pix_row, r.pix_col): (r.comp_row, r.comp_col) for r in lab.collect()}
    todo, want = set((s, r, c) for s, r, c, _ in rows), {}
    for start in sorted(todo):
        if start in want:
            continue
        stack, want[start] = [start], start[1:]
        while stack:
            s, r, c = stack.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    q = (s, r + dr, c + dc)
                    if (connectivity == 8 or dr * dc == 0) and q in todo and q not in want:
                        want[q] = start[1:]
                        stack.append(q)
    assert got == want


def test_component_rounds_do_not_grow_with_a_region(spark, monkeypatch):
    """A spiral through one tile is labelled without a component search; only tiles take part in it."""
    seen = []
    real = rg.connected_components
    monkeypatch.setattr(rg, "connected_components", lambda e: (seen.append(e.count()), real(e))[1])
    for n in (8, 60):
        line = [(1, r, c) for r in range(n) for c in (range(n) if r % 2 == 0 else [n - 1 if r % 4 == 1 else 0])]
        lab = rg.label_regions(spark.createDataFrame(line, "scene_id long, pix_row int, pix_col int"), 4)
        assert lab.select("comp_row", "comp_col").distinct().count() == 1
    assert seen == [0, 0]
