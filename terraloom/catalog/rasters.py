"""Queries over pixel neighbourhoods and scene statistics: N1-N6, N8-N15, G8, F20, F21, A5."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraloom.catalog.pixels import INDEX_SQL, PX
from terraloom.catalog.registry import query
from terraloom.catalog.scalars import beta_sql
from terraloom.functions.indices import index, scaled_reflectance
from terraloom.operators import depression as dep
from terraloom.operators import radiometry as ra
from terraloom.operators import stencil as st
from terraloom.operators.quantiles import quantiles


def r9(c, name=None):
    return F.round(c, 9).alias(name or c)


def mirror_sql(x, top):
    return f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > {top} THEN 2 * {top} - ({x}) ELSE {x} END"


def near_sql(value: str, half: int, how: str = "mirror", source: str = "pixels") -> str:
    """CTE ``n``: one row per pixel and offset with the neighbour's value."""
    if how == "mirror":
        rr, cc = mirror_sql("p.pix_row + o.dr", "e.h"), mirror_sql("p.pix_col + o.dc", "e.w")
    else:
        rr, cc = "p.pix_row + o.dr", "p.pix_col + o.dc"
    return f"""px AS (SELECT scene_id, pix_row, pix_col, {value} AS v FROM {source}), e AS (SELECT scene_id, max(pix_row) AS h, max(pix_col) AS w FROM px GROUP BY scene_id),
    o AS (SELECT a.i AS dr, b.i AS dc FROM range(-{half}, {half + 1}) a(i), range(-{half}, {half + 1}) b(i)),
    n AS (SELECT p.scene_id, p.pix_row, p.pix_col, o.dr, o.dc, p.v AS centre, q.v FROM px p JOIN e ON e.scene_id = p.scene_id CROSS JOIN o
      LEFT JOIN px q ON q.scene_id = p.scene_id AND q.pix_row = {rr} AND q.pix_col = {cc})"""


def kernel_sql(weights: dict[tuple[int, int], float], name="k") -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({r}, {c}, {w!r}::DOUBLE)' for (r, c), w in weights.items())}) t(dr, dc, w))"


def outer(rows, cols):
    h = len(rows) // 2
    return {(i - h, j - h): a * b for i, a in enumerate(rows) for j, b in enumerate(cols)}


def square(flat):
    s = math.isqrt(len(flat))
    return {(i // s - s // 2, i % s - s // 2): w for i, w in enumerate(flat)}


G3, G2S = st.gaussian_weights(0.8, 1), st.gaussian_weights(2.0, 8)
CONV = "SELECT n.scene_id, n.pix_row, n.pix_col, round(sum(n.v * k.w), 9) AS value FROM n JOIN k ON k.dr = n.dr AND k.dc = n.dc GROUP BY 1, 2, 3"


def _smooth3(v):
    return st.separable(v.pixels.select(*PX, "nir"), "nir", G3, G3, "value").select(*PX, r9("value"))


query("n01_gaussian_3x3", f"{near_sql('nir', 1)}, {kernel_sql(outer(G3, G3))} {CONV}")(_smooth3)


@query("n01_gaussian_5x5", f"{near_sql('nir', 2)}, {kernel_sql(outer(st.SMOOTH_5, st.SMOOTH_5))} {CONV}")
def _(v):
    return st.denoise(v.pixels.select(*PX, "nir"), "nir", "gaussian", "value").select(*PX, r9("value"))


def grad_sql(smooth):
    kx, ky = outer(smooth, st.SOBEL_DIFF), outer(st.SOBEL_DIFF, smooth)
    return f"""{near_sql('nir', 1)}, {kernel_sql(kx, 'kx')}, {kernel_sql(ky, 'ky')},
    g AS (SELECT n.scene_id, n.pix_row, n.pix_col, sum(n.v * kx.w) AS gx, sum(n.v * ky.w) AS gy FROM n JOIN kx ON kx.dr = n.dr AND kx.dc = n.dc JOIN ky ON ky.dr = n.dr AND ky.dc = n.dc GROUP BY 1, 2, 3)
    SELECT scene_id, pix_row, pix_col, round(sqrt(gx * gx + gy * gy), 9) AS value FROM g"""


for _m, _s in (("sobel", st.SOBEL_SMOOTH), ("scharr", st.SCHARR_SMOOTH)):

    def _edge(v, m=_m):
        return st.edges(v.pixels.select(*PX, "nir"), "nir", m).select(*PX, r9("edge", "value"))

    query(f"n01_{_m}_gradient", grad_sql(_s))(_edge)


@query("n01_laplacian", f"{near_sql('nir', 1)}, {kernel_sql(square(st.LAPLACE))} {CONV}")
def _(v):
    return st.edges(v.pixels.select(*PX, "nir"), "nir", "laplacian").select(*PX, r9("edge", "value"))


@query(
    "n02_unsharp_mask",
    f"""{near_sql('nir', 8)}, {kernel_sql(outer(G2S, G2S))}, b AS (SELECT n.scene_id, n.pix_row, n.pix_col, any_value(n.centre) AS c, sum(n.v * k.w) AS s FROM n JOIN k ON k.dr = n.dr AND k.dc = n.dc GROUP BY 1, 2, 3)
    SELECT scene_id, pix_row, pix_col, round(c * 2 - s, 9) AS value FROM b""",
)
def _(v):
    return st.unsharp(v.pixels.select(*PX, "nir"), "nir", 1.0, 2.0, "value").select(*PX, r9("value"))


@query(
    "n03_median_3x3",
    f"{near_sql('nir', 1, 'none')} SELECT scene_id, pix_row, pix_col, round(median(coalesce(v, 0)), 9) AS value FROM n GROUP BY 1, 2, 3",
)
def _(v):
    return st.median3(v.pixels.select(*PX, "nir"), "nir", "value").select(*PX, r9("value"))


@query(
    "n04_bilateral",
    f"""{near_sql('floor(nir * 255)', 4)}, b AS (SELECT scene_id, pix_row, pix_col, v, exp(-((dr * dr + dc * dc) / (2 * 75.0E0 * 75))) * exp(-((v - centre) * (v - centre)) / (2 * 75.0E0 * 75)) AS w FROM n WHERE dr * dr + dc * dc <= 16)
    SELECT scene_id, pix_row, pix_col, round(sum(v * w) / sum(w), 8) AS value FROM b GROUP BY 1, 2, 3""",
)
def _(v):
    px = v.pixels.select(*PX, F.floor(F.col("nir") * 255).cast("double").alias("level"))
    return st.denoise(px, "level", "bilateral", "value").select(*PX, F.round("value", 8).alias("value"))


# Mask used by the morphology queries, and its SQL windows.
MASK = f"CAST({INDEX_SQL['terra_preta_enhanced']} > 0.12E0 AND pix_col % 7 <> 3 AS INT)"


def morph_sql(source: str, steps: list[tuple[str, int]], value: str = "m", prefix: str = "mo") -> tuple[str, str]:
    """CTEs applying erode/dilate passes; returns (ctes, name of the last)."""
    ctes, cur, i = [], source, 0
    for op, size in steps:
        a = size // 2
        b = size - 1 - a
        lo, hi, f = (a, b, "min") if op == "erode" else (b, a, "max")
        for part, order in (("pix_col", "pix_row"), ("pix_row", "pix_col")):
            name = f"{prefix}{i}"
            ctes.append(
                f"{name} AS (SELECT * EXCLUDE ({value}), {f}({value}) OVER (PARTITION BY scene_id, {part} ORDER BY {order} RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) AS {value} FROM {cur})"
            )
            cur, i = name, i + 1
    return ", ".join(ctes), cur


MBASE = f"mb AS (SELECT scene_id, pix_row, pix_col, {MASK} AS m FROM pixels)"


def mask_pixels(v):
    m = (index("terra_preta_enhanced") > 0.12) & (F.col("pix_col") % 7 != 3)
    return v.pixels.select(*PX, m.cast("int").alias("m"))


for _name, _ops, _steps in (
    ("erode_3", [("erode", 3)], [("erode", 3)]),
    ("dilate_2", [("dilate", 2)], [("dilate", 2)]),
    ("open_2_close_3_open_2", [("open", 2), ("close", 3), ("open", 2)],
     [("erode", 2), ("dilate", 2), ("dilate", 3), ("erode", 3), ("erode", 2), ("dilate", 2)]),
    ("open_4_close_3_open_2", [("open", 4), ("close", 3), ("open", 2)],
     [("erode", 4), ("dilate", 4), ("dilate", 3), ("erode", 3), ("erode", 2), ("dilate", 2)]),
    ("open_5", [("open", 5)], [("erode", 5), ("dilate", 5)]),
):
    _ctes, _last = morph_sql("mb", _steps)

    def _morph(v, ops=_ops):
        return st.morphology(mask_pixels(v), "m", ops, "value").select(*PX, "value")

    query(f"n05_morphology_{_name}", f"{MBASE}, {_ctes} SELECT scene_id, pix_row, pix_col, m AS value FROM {_last}")(_morph)


GAP = "CASE WHEN (pix_row % 10 < 2 AND pix_col % 13 < 3) OR (pix_row BETWEEN 20 AND 28 AND pix_col BETWEEN 20 AND 29) THEN NULL ELSE nir END"
_fill, _flast = morph_sql("hb", [("erode", 5), ("dilate", 5)])


@query(
    "n06_small_gap_fill",
    f"""gp AS (SELECT scene_id, pix_row, pix_col, {GAP} AS nv FROM pixels), hb AS (SELECT scene_id, pix_row, pix_col, CAST(nv IS NULL AS INT) AS m FROM gp), {_fill},
    {near_sql('nv', 1, 'none', 'gp')}, a AS (SELECT scene_id, pix_row, pix_col, avg(v) AS mean FROM n GROUP BY 1, 2, 3)
    SELECT gp.scene_id, gp.pix_row, gp.pix_col, round(CASE WHEN nv IS NULL AND f.m = 0 THEN a.mean ELSE nv END, 9) AS value
    FROM gp JOIN {_flast} f ON f.scene_id = gp.scene_id AND f.pix_row = gp.pix_row AND f.pix_col = gp.pix_col JOIN a ON a.scene_id = gp.scene_id AND a.pix_row = gp.pix_row AND a.pix_col = gp.pix_col""",
)
def _(v):
    small = (F.col("pix_row") % 10 < 2) & (F.col("pix_col") % 13 < 3)
    big = F.col("pix_row").between(20, 28) & F.col("pix_col").between(20, 29)
    px = v.pixels.select(*PX, F.when(~(small | big), F.col("nir")).alias("nir"))
    return st.fill_small_gaps(px, "nir", 5, "value").select(*PX, r9("value"))


NB = ["blue", "nir", "swir1"]
NORM = {
    "minmax": ("min({b}) AS {b}_lo, max({b}) AS {b}_hi", "CASE WHEN {b}_hi > {b}_lo THEN ({b} - {b}_lo) / ({b}_hi - {b}_lo) ELSE {b} END"),
    "zscore": ("avg({b}) AS {b}_lo, stddev_pop({b}) AS {b}_hi", "CASE WHEN {b}_hi > 0 THEN ({b} - {b}_lo) / {b}_hi ELSE {b} - {b}_lo END"),
    "percentile": (
        "quantile_cont({b}, 0.02) AS {b}_lo, quantile_cont({b}, 0.98) AS {b}_hi",
        "CASE WHEN {b}_hi > {b}_lo THEN least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo), 0), 1) ELSE {b} END",
    ),
}


def norm_sql(agg, expr, bands=NB, digits=9):
    return (
        f"s AS (SELECT scene_id, {', '.join(agg.format(b=b) for b in bands)} FROM pixels GROUP BY scene_id) SELECT scene_id, pix_row, pix_col, "
        + ", ".join(f"round({expr.format(b=b)}, {digits}) AS {b}" for b in bands)
        + " FROM pixels JOIN s USING (scene_id)"
    )


for _m, (_agg, _expr) in NORM.items():

    def _norm(v, m=_m):
        out = ra.normalised(v.pixels.select(*PX, *NB), NB, m)
        return out.select(*PX, *[r9(b) for b in NB])

    query(f"n08_normalise_{_m}", norm_sql(_agg, _expr))(_norm)


@query(
    "n09_outlier_clip",
    norm_sql("quantile_cont({b}, 0.01) AS {b}_lo, quantile_cont({b}, 0.99) AS {b}_hi", "least(greatest({b}, {b}_lo), {b}_hi)"),
)
def _(v):
    return ra.outlier_clipped(v.pixels.select(*PX, *NB), NB).select(*PX, *[r9(b) for b in NB])


for _kind, _bands in ra.COMPOSITES.items():
    _c = ", ".join(
        f"CAST(CASE WHEN {b}_hi > {b}_lo THEN floor(least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo) * 255, 0), 255)) ELSE 0 END AS INT) AS {n}"
        for b, n in zip(_bands, "rgb")
    )
    _s = ", ".join(f"quantile_cont({b}, 0.02) AS {b}_lo, quantile_cont({b}, 0.98) AS {b}_hi" for b in _bands)

    def _comp(v, kind=_kind):
        return ra.composite(v.pixels, kind)

    query(
        f"n10_composite_{_kind}",
        f"s AS (SELECT scene_id, {_s} FROM pixels GROUP BY scene_id) SELECT scene_id, pix_row, pix_col, {_c} FROM pixels JOIN s USING (scene_id)",
    )(_comp)

DARK = "SELECT scene_id, pix_row, pix_col, CASE WHEN pix_row < 6 OR pix_col > 40 THEN 0E0 ELSE red END AS red, CASE WHEN pix_row < 6 OR pix_col > 40 THEN 0E0 ELSE green END AS green, CASE WHEN pix_row < 6 OR pix_col > 40 THEN 0E0 ELSE blue END AS blue FROM "
_pv = ["red", "green", "blue"]


def _pv_channel(b):
    lo, hi = f"{b}_lo * 10000", f"{b}_hi * 10000"
    unit = f"least(greatest(({b} * 10000 - {lo}) / CASE WHEN {hi} > {lo} THEN {hi} - {lo} ELSE 10000 END, 0), 1)"
    return f"CAST(CASE WHEN ok THEN floor(pow({unit}, 0.9E0) * 255) ELSE 0 END AS INT) AS {b}_8bit"


@query(
    "n11_preview_stretch",
    f"""dk AS ({DARK} pixels), d AS (SELECT *, red > 0 OR green > 0 OR blue > 0 AS ok FROM dk),
    x AS (SELECT scene_id, min(pix_row) AS t, max(pix_row) + 1 AS b, min(pix_col) AS l, max(pix_col) + 1 AS r, {', '.join(f'quantile_cont({b}, 0.01) AS {b}_lo, quantile_cont({b}, 0.99) AS {b}_hi' for b in _pv)} FROM d WHERE ok GROUP BY scene_id)
    SELECT scene_id, pix_row, pix_col, {', '.join(_pv_channel(b) for b in _pv)} FROM d JOIN x USING (scene_id)
    WHERE pix_row >= t - greatest(1, floor((b - t) * 0.05E0)) AND pix_row < b + greatest(1, floor((b - t) * 0.05E0)) AND pix_col >= l - greatest(1, floor((r - l) * 0.05E0)) AND pix_col < r + greatest(1, floor((r - l) * 0.05E0))""",
)
def _(v):
    return ra.preview(v.sql(DARK + "{pixels}"))


@query(
    "n12_gamma_lut",
    "SELECT scene_id, pix_row, pix_col, CAST(floor(pow(floor(nir * 255) / 255.0E0, 1 / 1.2E0) * 255) AS INT) AS value FROM pixels",
)
def _(v):
    return v.pixels.select(*PX, ra.gamma_corrected(F.floor(F.col("nir") * 255)).alias("value"))


LEVEL = "SELECT scene_id, pix_row, pix_col, CAST(floor((nir - lo) / (hi - lo) * 255) AS INT) AS level FROM pixels JOIN (SELECT scene_id, min(nir) AS lo, max(nir) AS hi FROM pixels GROUP BY scene_id) s USING (scene_id)"


@query(
    "n12_histogram_equalisation",
    f"""l AS ({LEVEL}), h AS (SELECT scene_id, level, count(*) AS c FROM l GROUP BY 1, 2),
    u AS (SELECT scene_id, level, sum(c) OVER (PARTITION BY scene_id ORDER BY level) AS cum, first_value(c) OVER (PARTITION BY scene_id ORDER BY level) AS f, sum(c) OVER (PARTITION BY scene_id) AS n FROM h)
    SELECT l.scene_id, pix_row, pix_col, CAST(CASE WHEN n > f THEN round((cum - f) / (n - f)::DOUBLE * 255) ELSE l.level END AS INT) AS value FROM l JOIN u ON u.scene_id = l.scene_id AND u.level = l.level""",
)
def _(v):
    return ra.equalised(ra.to_8bit(v.pixels.select(*PX, "nir"), "nir"), "level", "value").select(*PX, "value")


@query(
    "n13_cloud_mask",
    """q AS (SELECT scene_id, quantile_cont((blue + green + red) / 3, 0.95) AS p FROM pixels GROUP BY scene_id)
    SELECT scene_id, pix_row, pix_col, (blue + green + red) / 3 > p AS cloud, round(CASE WHEN (blue + green + red) / 3 > p THEN NULL ELSE nir END, 9) AS nir FROM pixels JOIN q USING (scene_id)""",
)
def _(v):
    return ra.cloud_masked(v.pixels, ["blue", "green", "red", "nir"]).select(*PX, "cloud", r9("nir"))


for _m, _lo, _hi in (
    ("statistical", "avg(red) - 2.5E0 * stddev_pop(red)", "avg(red) + 2.5E0 * stddev_pop(red)"),
    ("percentile", "quantile_cont(red, 0.05)", "quantile_cont(red, 0.95)"),
    ("iqr", "quantile_cont(red, 0.25) - 1.5E0 * (quantile_cont(red, 0.75) - quantile_cont(red, 0.25))",
     "quantile_cont(red, 0.75) + 1.5E0 * (quantile_cont(red, 0.75) - quantile_cont(red, 0.25))"),
):
    # squared twice so that all three rules flag something
    _src = "SELECT scene_id, pix_row, pix_col, pow(red * 10, 8) AS red FROM "

    def _anom(v, m=_m, src=_src):
        return ra.anomalies(v.sql(src + "{pixels}"), "red", m).select(*PX, "anomaly")

    query(
        f"n14_anomaly_{_m}",
        f"a AS ({_src} pixels), s AS (SELECT scene_id, {_lo} AS lo, {_hi} AS hi FROM a GROUP BY scene_id) SELECT scene_id, pix_row, pix_col, red > hi OR red < lo AS anomaly FROM a JOIN s USING (scene_id)",
    )(_anom)


@query("n15_rescale_8bit", LEVEL)
def _(v):
    return ra.to_8bit(v.pixels.select(*PX, "nir"), "nir").select(*PX, "level")


@query(
    "g08_quartile_class",
    """q AS (SELECT scene_id, quantile_cont(nir, 0.5) AS q2, quantile_cont(nir, 0.75) AS q3 FROM pixels GROUP BY scene_id)
    SELECT scene_id, pix_row, pix_col, CASE WHEN nir > q3 THEN 1.0E0 WHEN nir > q2 THEN 0.5E0 ELSE 0.0E0 END AS likelihood FROM pixels JOIN q USING (scene_id)""",
)
def _(v):
    return ra.quartile_class(v.pixels.select(*PX, "nir"), "nir").select(*PX, "likelihood")


@query(
    "n08_scene_percentiles",
    f"""SELECT scene_id, round(quantile_cont({INDEX_SQL['ndvi']}, 0.05), 9) AS p5, round(quantile_cont({INDEX_SQL['ndvi']}, 0.5), 9) AS p50, round(quantile_cont({INDEX_SQL['ndvi']}, 0.99), 9) AS p99 FROM pixels GROUP BY scene_id""",
)
def _(v):
    q = quantiles(v.pixels.select("scene_id", index("ndvi").alias("ndvi")), ["scene_id"], "ndvi", {"p5": 0.05, "p50": 0.5, "p99": 0.99})
    return q.select("scene_id", r9("p5"), r9("p50"), r9("p99"))


@query(
    "a05_reflectance_scaling",
    """SELECT scene_id, pix_row, pix_col, round(CASE WHEN dn <> 0 THEN least(greatest(dn / 10000, 0), 1) END, 9) AS sentinel2,
    round(CASE WHEN dn <> 0 THEN least(greatest(dn * 0.0000275E0 - 0.2E0, 0), 1) END, 9) AS landsat FROM (SELECT *, CASE WHEN pix_row % 11 = 0 THEN 0E0 ELSE round(nir * 40000) - 2000 END AS dn FROM pixels) p""",
)
def _(v):
    dn = F.when(F.col("pix_row") % 11 == 0, 0.0).otherwise(F.round(F.col("nir") * 40000) - 2000)
    return v.pixels.select(
        *PX, r9(scaled_reflectance(dn, 0.0), "sentinel2"), r9(scaled_reflectance(dn, 0.0, "landsat"), "landsat")
    )


# Stronger vegetation contrast than the indices give, so that part of the scenes pass the test.
VEG = "SELECT scene_id, pix_row, pix_col, 0.5E0 + nir - CASE WHEN scene_id % 2 = 0 AND (pix_row % 6 < 3 AND pix_col % 6 < 3) THEN 0.02E0 + (pix_row % 3) * 0.05E0 ELSE 0 END AS m FROM "
_dc, _dl = morph_sql("vg", [("dilate", 5), ("erode", 5)])
TTEST = """st AS (SELECT scene_id, count(*) AS n, avg(d) AS mu, stddev_samp(d) AS sd, stddev_pop(d) AS sp, count(*) - 1.0E0 AS df, (avg(d) - 0.07E0) / (stddev_samp(d) / sqrt(count(*))) AS t FROM dd GROUP BY scene_id)"""


@query(
    "f21_ndvi_depression",
    f"""vg AS ({VEG} pixels), {_dc}, dd AS (SELECT vg.scene_id, vg.pix_row, vg.pix_col, b.m - vg.m AS d FROM vg JOIN {_dl} b ON b.scene_id = vg.scene_id AND b.pix_row = vg.pix_row AND b.pix_col = vg.pix_col),
    {TTEST}, {beta_sql('st', 'df / 2', '0.5E0', 'df / (df + t * t)')}, vd AS (SELECT scene_id, n, tail < 0.05E0 AND abs((mu - 0.07E0) / (sp + 1E-8)) >= 0.3E0 AS ok FROM bq)
    SELECT dd.scene_id, pix_row, pix_col, round(CASE WHEN n <= 100 THEN CASE WHEN d >= 0.07E0 AND d <= 0.15E0 THEN least(1, d / 0.07E0) ELSE 0 END WHEN ok THEN CASE WHEN d < 0.03E0 OR d > 0.15E0 THEN 0 WHEN d <= 0.07E0 THEN (d - 0.03E0) / (0.07E0 - 0.03E0)
      ELSE greatest(0, 1 - (d - 0.07E0) / (0.15E0 - 0.07E0)) END ELSE 0 END, 8) AS depression FROM dd JOIN vd ON vd.scene_id = dd.scene_id""",
)
def _(v):
    px = v.sql(VEG + "{pixels}").withColumnRenamed("m", "ndvi")
    return dep.with_depression(px).select(*PX, F.round("depression", 8).alias("depression"))


@query(
    "f20_index_significance",
    f"""px AS (SELECT scene_id, pix_row, {INDEX_SQL['crop_mark']} AS v FROM pixels), s AS (SELECT scene_id, CAST(floor(pix_row / 3.0E0) AS INT) AS strip, count(*) AS n, avg(v) AS mu, stddev_samp(v) AS sd, stddev_pop(v) AS sp, count(*) - 1.0E0 AS df,
      avg(v) / (stddev_samp(v) / sqrt(count(*))) AS t FROM px GROUP BY 1, 2), {beta_sql('s', 'df / 2', '0.5E0', 'df / (df + t * t)')},
    r AS (SELECT scene_id, strip, n, CASE WHEN n < 50 THEN 1 ELSE tail END AS p, CASE WHEN n < 50 THEN 0 ELSE abs(mu) / (sp + 1E-8) END AS e FROM bq)
    SELECT scene_id, strip, n, round(p, 8) AS p_value, round(e, 8) AS effect_size, CASE WHEN n < 50 THEN 'insufficient_data' WHEN p < 0.01E0 AND e >= 0.5E0 THEN 'HIGH' WHEN p < 0.05E0 AND e >= 0.3E0 THEN 'MEDIUM' ELSE 'LOW' END AS significance FROM r""",
)
def _(v):
    px = v.pixels.select("scene_id", F.floor(F.col("pix_row") / 3.0).cast("int").alias("strip"), index("crop_mark").alias("cm"))
    return dep.index_significance(px, "cm", ["scene_id", "strip"]).select(
        "scene_id", "strip", "n", F.round("p_value", 8).alias("p_value"), F.round("effect_size", 8).alias("effect_size"), "significance"
    )
