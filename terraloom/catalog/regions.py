"""Queries over regions and shapes: N5b, N7, N16-N21, F2, G4, D18-D20."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraloom.catalog.lidar import ordered_leaders_sql
from terraloom.catalog.pixels import INDEX_SQL, PX
from terraloom.catalog.rasters import LEVEL, morph_sql
from terraloom.catalog.registry import query
from terraloom.functions.indices import with_indices
from terraloom.operators import masks
from terraloom.operators import regions as rg
from terraloom.operators import shapes as sh
from terraloom.operators import stencil as st
from terraloom.runtime import cut_lineage

CHAIN = [("open", 2), ("close", 3), ("open", 2)]
STEPS = [("erode", 2), ("dilate", 2), ("dilate", 3), ("erode", 3), ("erode", 2), ("dilate", 2)]
BANDS = ["ndvi", "ndre1", "terra_preta", "terra_preta_enhanced"]
FAST = (
    f"{INDEX_SQL['terra_preta_enhanced']} > 0.12E0 AND {INDEX_SQL['ndvi']} > 0.3E0 AND {INDEX_SQL['ndvi']} < 0.8E0 AND {INDEX_SQL['ndre1']} > 0.1E0"
)
_ctes, _last = morph_sql("mb", STEPS)
CLEAN = f"mb AS (SELECT scene_id, pix_row, pix_col, CAST({FAST} AS INT) AS m FROM pixels), {_ctes}, tp AS (SELECT scene_id, pix_row AS r, pix_col AS c FROM {_last} WHERE m = 1)"


def label_sql(source: str, out: str, diagonal: bool = False) -> str:
    """CTEs labelling (scene_id, r, c) rows with the first pixel of their region."""
    near = "abs(t.r - g.r) <= 1 AND abs(t.c - g.c) <= 1" if diagonal else "abs(t.r - g.r) + abs(t.c - g.c) = 1"
    return f"""{out}_g AS (SELECT scene_id, r, c, r AS sr, c AS sc FROM {source} UNION SELECT t.scene_id, t.r, t.c, g.sr, g.sc FROM {out}_g g JOIN {source} t ON t.scene_id = g.scene_id AND {near}),
    {out} AS (SELECT scene_id, r, c, min(struct_pack(sr := sr, sc := sc)).sr AS comp_row, min(struct_pack(sr := sr, sc := sc)).sc AS comp_col FROM {out}_g GROUP BY scene_id, r, c)"""


REGIONS = f"{CLEAN}, {label_sql('tp', 'lb')}"
STATS = f"""{REGIONS}, fs AS (SELECT lb.scene_id, comp_row, comp_col, count(*) AS n_px, avg(r) AS centre_row, avg(c) AS centre_col,
    greatest(max(r) - min(r) + 1, max(c) - min(c) + 1) / least(max(r) - min(r) + 1, max(c) - min(c) + 1)::DOUBLE AS aspect, count(*) * 100.0E0 AS area_m2,
    {', '.join(f"avg({INDEX_SQL[b]}) AS mean_{b}" for b in BANDS)} FROM lb JOIN pixels p ON p.scene_id = lb.scene_id AND p.pix_row = lb.r AND p.pix_col = lb.c GROUP BY 1, 2, 3),
  nb AS (SELECT a.scene_id, a.r, a.c, a.comp_row, a.comp_col, count(b.r) AS k FROM lb a LEFT JOIN tp b ON b.scene_id = a.scene_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2, 3, 4, 5),
  pe AS (SELECT scene_id, comp_row, comp_col, count(*) AS n, count(*) FILTER (k < 4) AS edge FROM nb GROUP BY 1, 2, 3)"""


def labelled(v, connectivity=4):
    return rg.clean_regions(v.pixels, masks.fast_mask_with_red_edge(), CHAIN, connectivity)


def measured(v):
    return labelled(v).join(with_indices(v.pixels, BANDS), PX)


@query("n07_component_labels_4", f"{REGIONS} SELECT scene_id, r AS pix_row, c AS pix_col, comp_row, comp_col FROM lb")
def _(v):
    return labelled(v).select(*PX, "comp_row", "comp_col")


# A diagonal pattern, so that 8-connectivity differs from 4-connectivity.
DIAG = f"dg AS (SELECT scene_id, pix_row AS r, pix_col AS c FROM pixels WHERE {FAST} AND (pix_row + pix_col) % 2 = 0)"


@query("n07_component_labels_8", f"{DIAG}, {label_sql('dg', 'lb', True)} SELECT scene_id, r AS pix_row, c AS pix_col, comp_row, comp_col FROM lb")
def _(v):
    px = v.pixels.where(masks.fast_mask_with_red_edge() & ((F.col("pix_row") + F.col("pix_col")) % 2 == 0)).select(*PX)
    return rg.label_regions(px, 8).select(*PX, "comp_row", "comp_col")


def _r9(c):
    return F.round(c, 9).alias(c)


@query(
    "f02_region_statistics",
    f"""{STATS} SELECT scene_id, comp_row, comp_col, n_px, round(centre_row, 9) AS centre_row, round(centre_col, 9) AS centre_col, round(aspect, 9) AS aspect, area_m2,
    {', '.join(f'round(mean_{b}, 9) AS mean_{b}' for b in BANDS)} FROM fs""",
)
def _(v):
    s = rg.region_stats(measured(v), BANDS)
    return s.select(*rg.COMP, "n_px", _r9("centre_row"), _r9("centre_col"), _r9("aspect"), "area_m2", *[_r9(f"mean_{b}") for b in BANDS])


@query(
    "n20_perimeter",
    f"{REGIONS}, {STATS.split('nb AS')[1].join(['nb AS', ''])} SELECT scene_id, comp_row, comp_col, edge AS perimeter_px, round(n / edge::DOUBLE, 9) AS area_perimeter, round(4 * pi() * n / (edge * edge), 9) AS compactness FROM pe",
)
def _(v):
    return rg.perimeters(labelled(v)).select(*rg.COMP, "perimeter_px", _r9("area_perimeter"), _r9("compactness"))


@query(
    "d18_region_prefilter",
    f"{STATS} SELECT fs.scene_id, fs.comp_row, fs.comp_col, n_px FROM fs JOIN pe ON pe.scene_id = fs.scene_id AND pe.comp_row = fs.comp_row AND pe.comp_col = fs.comp_col WHERE area_m2 BETWEEN 500 AND 50000 AND n_px >= 3 AND aspect <= 8 AND n / edge::DOUBLE <= 25",
)
def _(v):
    lab = cut_lineage(labelled(v))
    s = rg.region_stats(lab).join(rg.perimeters(lab), rg.COMP)
    return rg.enhanced_prefilter(s).select(*rg.COMP, "n_px")


@query("d19_crop_prefilter", f"{STATS} SELECT scene_id, comp_row, comp_col, n_px FROM fs WHERE area_m2 BETWEEN 300 AND 20000 AND n_px >= 3 AND aspect <= 10")
def _(v):
    return rg.crop_prefilter(rg.region_stats(labelled(v))).select(*rg.COMP, "n_px")


@query(
    "d20_standard_region_filter",
    f"""{STATS}, cf AS (SELECT *, least(1, 0.5E0 * least(1, mean_terra_preta * 10) + 0.3E0 * least(1, (mean_ndvi - 0.35E0) * 4) + 0.2E0 * least(1, n_px / 100.0E0)) AS raw FROM fs)
    SELECT scene_id, comp_row, comp_col, round(CASE WHEN mean_terra_preta > 0.12E0 THEN greatest(raw, 0.6E0) ELSE raw END, 9) AS confidence FROM cf
    WHERE area_m2 BETWEEN 2000 AND 1000000 AND n_px >= 50 AND CASE WHEN mean_terra_preta > 0.12E0 THEN greatest(raw, 0.6E0) ELSE raw END >= 0.5E0""",
)
def _(v):
    s = rg.region_stats(measured(v), BANDS)
    return rg.standard_filter(s, 2000.0, 1000000.0).select(*rg.COMP, _r9("confidence"))


# The brake at the size of the sample scenes; the defaults are the full-size limits.
@query(
    "g04_component_brake",
    f"""{STATS}, k AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS k FROM fs), f AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n_px DESC, comp_row, comp_col) AS rn FROM k WHERE k <= 4 OR n_px BETWEEN 25 AND 400),
    o AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS left_k FROM f WHERE k <= 4 OR rn <= 6) SELECT scene_id, comp_row, comp_col, n_px FROM o WHERE left_k <= 8""",
)
def _(v):
    s = rg.region_stats(labelled(v))
    return rg.component_brake(s, medium=4, major=1000, final=8, medium_top=6).select(*rg.COMP, "n_px")


_el = [{(i // 3 - 1, i % 3 - 1) for i, on in enumerate(e) if on} for e in st.IRREGULAR]
ELEMENTS = "el AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {r}, {c})" for k, e in enumerate(_el) for r, c in sorted(e)) + ") t(k, dr, dc))"


@query(
    "n05b_irregular_open",
    f"""{CLEAN}, {label_sql('tp', 'lb', True)}, rk AS (SELECT scene_id, comp_row, comp_col, (row_number() OVER (PARTITION BY scene_id ORDER BY comp_row, comp_col) - 1) % 3 AS k FROM (SELECT DISTINCT scene_id, comp_row, comp_col FROM lb) d),
    q AS (SELECT lb.*, rk.k FROM lb JOIN rk USING (scene_id, comp_row, comp_col)), {ELEMENTS}, ex AS (SELECT scene_id, max(pix_row) AS h, max(pix_col) AS w FROM pixels GROUP BY scene_id),
    er AS (SELECT q.scene_id, q.r, q.c, q.k, q.comp_row, q.comp_col FROM q JOIN ex ON ex.scene_id = q.scene_id WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.k = q.k AND q.r + el.dr BETWEEN 0 AND ex.h AND q.c + el.dc BETWEEN 0 AND ex.w
      AND NOT EXISTS (SELECT 1 FROM q b WHERE b.scene_id = q.scene_id AND b.r = q.r + el.dr AND b.c = q.c + el.dc AND b.comp_row = q.comp_row AND b.comp_col = q.comp_col)))
    SELECT DISTINCT q.scene_id, q.r AS pix_row, q.c AS pix_col FROM q JOIN el ON el.k = q.k JOIN er ON er.scene_id = q.scene_id AND er.comp_row = q.comp_row AND er.comp_col = q.comp_col AND er.r = q.r - el.dr AND er.c = q.c - el.dc""",
)
def _(v):
    return rg.varied_open(labelled(v, 8), v.pixels)


def clamp(x, top):
    return f"least(greatest({x}, 0), {top})"


def canny_sql(low: float, high: float) -> str:
    """CTE ``ed`` (scene_id, r, c): edge pixels of the 8-bit band."""
    t = repr(math.tan(math.pi / 8)) + "E0"
    t2 = repr(math.tan(math.pi / 8) + 2) + "E0"
    at = lambda r, c: f"coalesce(max(CASE WHEN dr = {r} AND dc = {c} THEN mag END), 0)"
    return f"""lv AS ({LEVEL}), ex AS (SELECT scene_id, max(pix_row) AS h, max(pix_col) AS w FROM lv GROUP BY scene_id),
    of AS (SELECT a.i AS dr, b.i AS dc FROM range(-1, 2) a(i), range(-1, 2) b(i)),
    gr AS (SELECT p.scene_id, p.pix_row AS r, p.pix_col AS c, sum(q.level * of.dc * (2 - abs(of.dr))) AS gx, sum(q.level * of.dr * (2 - abs(of.dc))) AS gy
      FROM lv p JOIN ex ON ex.scene_id = p.scene_id CROSS JOIN of JOIN lv q ON q.scene_id = p.scene_id AND q.pix_row = {clamp('p.pix_row + of.dr', 'ex.h')} AND q.pix_col = {clamp('p.pix_col + of.dc', 'ex.w')} GROUP BY 1, 2, 3),
    mg AS (SELECT *, abs(gx) + abs(gy) AS mag FROM gr),
    nm AS (SELECT a.scene_id, a.r, a.c, any_value(a.gx) AS gx, any_value(a.gy) AS gy, any_value(a.mag) AS m, {at(0, -1)} AS l, {at(0, 1)} AS rr, {at(-1, 0)} AS u, {at(1, 0)} AS d, {at(-1, -1)} AS ul, {at(1, 1)} AS dr_, {at(-1, 1)} AS ur, {at(1, -1)} AS dl
      FROM mg a CROSS JOIN of LEFT JOIN (SELECT scene_id, r, c, mag FROM mg) b ON b.scene_id = a.scene_id AND b.r = a.r + of.dr AND b.c = a.c + of.dc GROUP BY 1, 2, 3),
    wk AS (SELECT scene_id, r, c, m > {high} AS strong FROM nm WHERE m > {low} AND CASE WHEN abs(gy) < abs(gx) * {t} THEN m > l AND m >= rr WHEN abs(gy) > abs(gx) * {t2} THEN m > u AND m >= d
      WHEN gx * gy >= 0 THEN m > ul AND m > dr_ ELSE m > ur AND m > dl END),
    ed AS (SELECT scene_id, r, c FROM wk WHERE strong UNION SELECT w.scene_id, w.r, w.c FROM ed JOIN wk w ON w.scene_id = ed.scene_id AND abs(w.r - ed.r) <= 1 AND abs(w.c - ed.c) <= 1)"""


def _canny_fix(sql: str) -> str:
    # the neighbour's magnitude must come from b, not from the centre row
    return sql.replace("AND dc = ", "AND dc = ").replace("THEN mag END", "THEN b.mag END")


def edge_pixels(v, low, high):
    return sh.canny(sh.detection_level(v.pixels), "level", low, high)


@query("n16_canny_edges", f"{_canny_fix(canny_sql(50, 150))} SELECT scene_id, r AS pix_row, c AS pix_col FROM ed")
def _(v):
    return edge_pixels(v, 50, 150)


@query("n16_canny_edges_sensitive", f"{_canny_fix(canny_sql(30, 100))} SELECT scene_id, r AS pix_row, c AS pix_col FROM ed")
def _(v):
    return edge_pixels(v, 30, 100)


SEGMENTS = f"""{_canny_fix(canny_sql(50, 150))}, vt AS (SELECT scene_id, r, c, t.theta, CAST(floor(c * cos(radians(t.theta::DOUBLE)) + r * sin(radians(t.theta::DOUBLE)) + 0.5E0 + 1E-9) AS INT) AS rho FROM ed, range(0, 180) t(theta)),
  ln AS (SELECT scene_id, rho, theta, count(*) AS votes FROM vt GROUP BY 1, 2, 3 HAVING count(*) >= 14),
  on_ AS (SELECT vt.*, votes, round(r * cos(radians(vt.theta::DOUBLE)) - c * sin(radians(vt.theta::DOUBLE)), 6) AS pos FROM vt JOIN ln ON ln.scene_id = vt.scene_id AND ln.rho = vt.rho AND ln.theta = vt.theta),
  ct AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 2 THEN 1 WHEN lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM on_ WINDOW w AS (PARTITION BY scene_id, rho, theta ORDER BY pos, r, c)),
  sg AS (SELECT *, sum(cut) OVER (PARTITION BY scene_id, rho, theta ORDER BY pos, r, c) AS segment FROM ct),
  se AS (SELECT scene_id, rho, theta, votes, segment, count(*) AS n_px, min(struct_pack(p := pos, r := r, c := c)) AS a, max(struct_pack(p := pos, r := r, c := c)) AS b FROM sg GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "n17_line_segments",
    f"""{SEGMENTS} SELECT scene_id, rho, CAST(theta AS INT) AS theta, votes, CAST(segment AS BIGINT) AS segment, n_px, a.c AS x1, a.r AS y1, b.c AS x2, b.r AS y2,
    round(sqrt(pow(b.c - a.c, 2) + pow(b.r - a.r, 2)), 9) AS length_px FROM se WHERE sqrt(pow(b.c - a.c, 2) + pow(b.r - a.r, 2)) >= 6""",
)
def _(v):
    s = sh.straight_segments(edge_pixels(v, 50, 150), votes=14)
    return s.select("scene_id", "rho", "theta", "votes", "segment", "n_px", "x1", "y1", "x2", "y2", _r9("length_px"))


CIRCLE_VOTES = f"{_canny_fix(canny_sql(40, 120))}, vt AS (SELECT scene_id, r, c, q.radius, a.i AS ang FROM ed, range(3, 6) q(radius), range(0, 360, 10) a(i))"
_CX = "CAST(floor(c - radius * cos(radians(ang::DOUBLE)) + 0.5E0 + 1E-9) AS INT)"
_CY = "CAST(floor(r - radius * sin(radians(ang::DOUBLE)) + 0.5E0 + 1E-9) AS INT)"


@query(
    "n18_circle_votes",
    f"""{CIRCLE_VOTES}
    SELECT scene_id, {_CX} AS cx, {_CY} AS cy, CAST(radius AS INT) AS radius, count(*) AS votes
    FROM vt GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20""",
)
def _(v):
    return sh.circle_votes(edge_pixels(v, 40, 120), range(3, 6), 20)


_ctes, _lead = ordered_leaders_sql("cp", "cl", 6.0, "scene_id")


@query(
    "n18_circle_detection",
    f"""{CIRCLE_VOTES}, cv AS (SELECT scene_id, {_CX} AS cx, {_CY} AS cy, CAST(radius AS INT) AS radius, count(*) AS votes FROM vt GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20),
    cp AS (SELECT *, CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y, row_number() OVER (PARTITION BY scene_id ORDER BY votes DESC, radius, cx, cy) AS k FROM cv), {_ctes}
    SELECT cp.scene_id, cx, cy, radius, votes FROM cp JOIN ({_lead}) g ON g.scene_id = cp.scene_id AND g.k = cp.k""",
)
def _(v):
    return sh.circles(edge_pixels(v, 40, 120), range(3, 6), 20, 6.0)


@query(
    "n19_oriented_rectangles",
    f"""{REGIONS}, tn AS (SELECT lb.*, t.theta, c * cos(radians(t.theta::DOUBLE)) + r * sin(radians(t.theta::DOUBLE)) AS u, r * cos(radians(t.theta::DOUBLE)) - c * sin(radians(t.theta::DOUBLE)) AS v FROM lb, range(0, 90) t(theta)),
    x AS (SELECT scene_id, comp_row, comp_col, theta, count(*) AS n_px, max(u) - min(u) + cos(radians(theta::DOUBLE)) + sin(radians(theta::DOUBLE)) AS w, max(v) - min(v) + cos(radians(theta::DOUBLE)) + sin(radians(theta::DOUBLE)) AS h FROM tn GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, comp_row, comp_col ORDER BY round(w * h, 6), theta) AS rn FROM x)
    SELECT scene_id, comp_row, comp_col, n_px, CAST(theta AS INT) AS angle_degrees, round(greatest(w, h), 8) AS length_px, round(least(w, h), 8) AS width_px, round(n_px / round(w * h, 6), 8) AS rectangularity FROM b WHERE rn = 1 AND n_px / round(w * h, 6) >= 0.8E0""",
)
def _(v):
    r = sh.rectangles(labelled(v).select(*PX, "comp_row", "comp_col"))
    return r.select(
        *rg.COMP, "n_px", "angle_degrees", F.round("length_px", 8).alias("length_px"), F.round("width_px", 8).alias("width_px"),
        F.round("rectangularity", 8).alias("rectangularity"),
    )


_gw = st.gaussian_weights(1.0, 4)
_gv = ", ".join(f"({i - 4}, {w!r}::DOUBLE)" for i, w in enumerate(_gw))


def _mir(x):
    return f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 49 THEN 98 - ({x}) ELSE {x} END"


@query(
    "n21_terrain_grid",
    f"""va AS (SELECT * FROM shots WHERE elevation_ground IS NOT NULL), ex AS (SELECT zone_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, avg(elevation_ground) AS zm FROM va GROUP BY zone_id),
    nd AS (SELECT zone_id, a.i AS gr, b.i AS gc, zm, x0 + b.i * ((x1 - x0) / 49) AS lon, y0 + a.i * ((y1 - y0) / 49) AS lat, 2 * greatest((x1 - x0) / 49, (y1 - y0) / 49) AS reach FROM ex, range(0, 50) a(i), range(0, 50) b(i)),
    iw AS (SELECT nd.zone_id, gr, gc, sum(s.elevation_ground * (1 / (d2 + 1E-12))) / sum(1 / (d2 + 1E-12)) AS z FROM nd JOIN (SELECT zone_id, lon, lat, elevation_ground FROM va) s ON s.zone_id = nd.zone_id AND abs(s.lon - nd.lon) <= reach AND abs(s.lat - nd.lat) <= reach,
      LATERAL (SELECT pow(sqrt((s.lon - nd.lon) * (s.lon - nd.lon) + (s.lat - nd.lat) * (s.lat - nd.lat)), 2) AS d2) l WHERE sqrt((s.lon - nd.lon) * (s.lon - nd.lon) + (s.lat - nd.lat) * (s.lat - nd.lat)) <= reach GROUP BY 1, 2, 3),
    rw AS (SELECT nd.zone_id, nd.gr, nd.gc, coalesce(iw.z, zm) AS raw FROM nd LEFT JOIN iw ON iw.zone_id = nd.zone_id AND iw.gr = nd.gr AND iw.gc = nd.gc),
    k AS (SELECT * FROM (VALUES {_gv}) t(d, w)),
    s1 AS (SELECT a.zone_id, a.gr, a.gc, sum(b.raw * k.w) AS v FROM rw a CROSS JOIN k JOIN rw b ON b.zone_id = a.zone_id AND b.gc = a.gc AND b.gr = {_mir('a.gr + k.d')} GROUP BY 1, 2, 3),
    s2 AS (SELECT a.zone_id, a.gr, a.gc, sum(b.v * k.w) AS v FROM s1 a CROSS JOIN k JOIN s1 b ON b.zone_id = a.zone_id AND b.gr = a.gr AND b.gc = {_mir('a.gc + k.d')} GROUP BY 1, 2, 3)
    SELECT zone_id, CAST(gr AS INT) AS pix_row, CAST(gc AS INT) AS pix_col, round(v, 6) AS elevation FROM s2""",
)
def _(v):
    return sh.terrain_grid(v.shots).select("zone_id", "pix_row", "pix_col", F.round("elevation", 6).alias("elevation"))
