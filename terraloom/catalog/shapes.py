"""Queries over tiles, outlines, circles and whole scenes: N5, N6, N16 across tile borders, N18, N19, G4, G7, P2 with all families."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.lidar import det_points, ordered_leaders_sql
from terraloom.catalog.pixels import PX
from terraloom.catalog.rasters import G3, GAP, LEVEL, MBASE, kernel_sql, mask_pixels, morph_sql, near_sql, outer, r9
from terraloom.catalog.regions import CLEAN, SEGMENTS, STATS, _canny_fix, canny_sql, edge_pixels, label_sql, labelled
from terraloom.catalog.registry import query
from terraloom.operators import circles as ci
from terraloom.operators import contours as co
from terraloom.operators import display as di
from terraloom.operators import regions as rg
from terraloom.operators import shapes as sh
from terraloom.operators import stencil as st
from terraloom.plans import analyses as an

# --- the stencils on tiles much smaller than a scene, so that every pass crosses tile borders
_STEPS = [("erode", 2), ("dilate", 2), ("dilate", 3), ("erode", 3), ("erode", 2), ("dilate", 2)]
_mctes, _mlast = morph_sql("mb", _STEPS)


@query("n05_morphology_tiles", f"{MBASE}, {_mctes} SELECT scene_id, pix_row, pix_col, m AS value FROM {_mlast}")
def _(v):
    return st.morphology(mask_pixels(v), "m", [("open", 2), ("close", 3), ("open", 2)], "value", tile=16).select(*PX, "value")


_GB = ["nir", "red"]
_gaps = GAP.replace("ELSE nir END", "ELSE {b} END")


def _gap_sql(b: str) -> str:
    ctes, last = morph_sql(f"{b}_hb", [("erode", 5), ("dilate", 5)], prefix=f"{b}_mo")
    near = near_sql("nv", 1, "none", f"{b}_gp")
    for name in ("px", "e", "o", "n"):
        near = near.replace(f"{name} AS (", f"{b}_{name} AS (")
    near = near.replace("FROM px", f"FROM {b}_px").replace("JOIN e ON", f"JOIN {b}_e e ON").replace("CROSS JOIN o", f"CROSS JOIN {b}_o o").replace("JOIN px q", f"JOIN {b}_px q")
    return f"""{b}_gp AS (SELECT scene_id, pix_row, pix_col, {_gaps.format(b=b)} AS nv FROM pixels), {b}_hb AS (SELECT scene_id, pix_row, pix_col, CAST(nv IS NULL AS INT) AS m FROM {b}_gp), {ctes}, {near},
    {b}_a AS (SELECT scene_id, pix_row, pix_col, avg(v) AS mean FROM {b}_n GROUP BY 1, 2, 3),
    {b}_f AS (SELECT scene_id, pix_row, pix_col, round(CASE WHEN nv IS NULL AND m = 0 THEN mean ELSE nv END, 9) AS {b} FROM {b}_gp JOIN {last} USING (scene_id, pix_row, pix_col) JOIN {b}_a USING (scene_id, pix_row, pix_col))"""


@query("n06_gap_fill_tiles", f"{', '.join(map(_gap_sql, _GB))} SELECT scene_id, pix_row, pix_col, nir, red FROM nir_f JOIN red_f USING (scene_id, pix_row, pix_col)")
def _(v):
    small = (F.col("pix_row") % 10 < 2) & (F.col("pix_col") % 13 < 3)
    big = F.col("pix_row").between(20, 28) & F.col("pix_col").between(20, 29)
    px = v.pixels.select(*PX, *[F.when(~(small | big), F.col(b)).alias(b) for b in _GB])
    filled = st.fill_gaps(px, {f"f_{b}": b for b in _GB}, 5, tile=16)
    return filled.select(*PX, *[r9(f"f_{b}", b) for b in _GB])


@query("n16_canny_tiles", f"{_canny_fix(canny_sql(50, 150))} SELECT scene_id, r AS pix_row, c AS pix_col FROM ed")
def _(v):
    return sh.canny(sh.detection_level(v.pixels), "level", 50, 150, tile=16)


# --- circles
LEAST = 14
BLURRED = f"""l0 AS ({LEVEL}), {near_sql('level', 1, 'mirror', 'l0')}, {kernel_sql(outer(G3, G3))},
  lv AS (SELECT n.scene_id, n.pix_row, n.pix_col, CAST(floor(sum(n.v * k.w) + 0.5E0) AS INT) AS level FROM n JOIN k ON k.dr = n.dr AND k.dc = n.dc GROUP BY 1, 2, 3)"""
_WIDE = st.gaussian_weights(2.0, 4)


def _own_names(sql: str, prefix: str) -> str:
    """The CTEs of ``near_sql`` under names of their own."""
    for name in ("px", "e", "o", "n"):
        sql = sql.replace(f"{name} AS (", f"{prefix}_{name} AS (")
    return sql.replace("FROM px", f"FROM {prefix}_px").replace("JOIN e ON", f"JOIN {prefix}_e e ON").replace("CROSS JOIN o", f"CROSS JOIN {prefix}_o o").replace("JOIN px q", f"JOIN {prefix}_px q")


SMOOTHED = f"""{_own_names(near_sql('level', 4, 'mirror', 'lv'), 'sm')}, {kernel_sql(outer(_WIDE, _WIDE), 'sk')},
  sv AS (SELECT n.scene_id, n.pix_row, n.pix_col, sum(n.v * sk.w) AS level FROM sm_n n JOIN sk ON sk.dr = n.dr AND sk.dc = n.dc GROUP BY 1, 2, 3),
  sg AS (SELECT p.scene_id, p.pix_row AS r, p.pix_col AS c, sum(q.level * of.dc * (2 - abs(of.dr))) AS gx, sum(q.level * of.dr * (2 - abs(of.dc))) AS gy
    FROM sv p JOIN ex ON ex.scene_id = p.scene_id CROSS JOIN of JOIN sv q ON q.scene_id = p.scene_id AND q.pix_row = least(greatest(p.pix_row + of.dr, 0), ex.h) AND q.pix_col = least(greatest(p.pix_col + of.dc, 0), ex.w) GROUP BY 1, 2, 3)"""
ROUND_EDGES = f"""{_canny_fix(canny_sql(40, 120)).replace(f'lv AS ({LEVEL})', BLURRED)}, {SMOOTHED},
  st AS (SELECT scene_id, h, w, 3 AS r0, least(CAST(floor((h + 1) / 2.0E0) AS INT), 50) AS r1 FROM ex),
  eg AS (SELECT ed.scene_id, ed.r, ed.c, round(gx / sqrt(gx * gx + gy * gy), 9) AS ux, round(gy / sqrt(gx * gx + gy * gy), 9) AS uy FROM ed JOIN sg ON sg.scene_id = ed.scene_id AND sg.r = ed.r AND sg.c = ed.c WHERE gx * gx + gy * gy > 0)"""
GRADIENT_VOTES = f"""{ROUND_EDGES},
  vl AS (SELECT eg.scene_id, radius, c + s * radius * ux AS x, r + s * radius * uy AS y, h, w FROM eg JOIN st ON st.scene_id = eg.scene_id, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS radius) q, (VALUES (-1.0E0), (1.0E0)) t(s)),
  vc AS (SELECT scene_id, CAST(floor(y / 1.2E0) AS INT) AS cell_row, CAST(floor(x / 1.2E0) AS INT) AS cell_col, CAST(radius AS INT) AS radius FROM vl WHERE x BETWEEN 0 AND w AND y BETWEEN 0 AND h),
  sc AS (SELECT scene_id, cell_row, cell_col, count(*) AS votes FROM vc GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
  cc AS (SELECT * FROM sc a WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.scene_id = a.scene_id AND abs(b.cell_row - a.cell_row) + abs(b.cell_col - a.cell_col) = 1
    AND (b.votes > a.votes OR b.votes = a.votes AND b.cell_row + b.cell_col < a.cell_row + a.cell_col)))"""
_found, _leaders = ordered_leaders_sql("pt", "gl", 1.0, "scene_id")
CIRCLES = f"""{GRADIENT_VOTES},
  rn AS (SELECT cc.scene_id, cell_row, cell_col, votes, r0, r1, CAST(floor(sqrt((ed.c - (cell_col + 0.5E0) * 1.2E0) * (ed.c - (cell_col + 0.5E0) * 1.2E0) + (ed.r - (cell_row + 0.5E0) * 1.2E0) * (ed.r - (cell_row + 0.5E0) * 1.2E0)) + 0.5E0) AS INT) AS radius, count(*) AS n
    FROM cc JOIN ed ON ed.scene_id = cc.scene_id JOIN st ON st.scene_id = cc.scene_id GROUP BY 1, 2, 3, 4, 5, 6, 7),
  sp AS (SELECT scene_id, cell_row, cell_col, votes, radius + d AS radius, sum(n) AS support, sum(n * (2 - abs(d))) AS weight FROM rn, (VALUES (-1), (0), (1)) t(d) WHERE radius BETWEEN r0 - 1 AND r1 + 1 AND radius + d BETWEEN r0 AND r1 GROUP BY 1, 2, 3, 4, 5),
  be AS (SELECT *, row_number() OVER (PARTITION BY scene_id, cell_row, cell_col ORDER BY -weight / CAST(radius AS DOUBLE), radius) AS rk FROM sp),
  pt AS (SELECT scene_id, cell_col * (1.2E0 / 6) AS x, cell_row * (1.2E0 / 6) AS y, row_number() OVER (PARTITION BY scene_id ORDER BY votes DESC, cell_row, cell_col) AS k, cell_row, cell_col, votes, radius, support FROM be WHERE rk = 1 AND support >= {LEAST}),
  {_found}, cf AS (SELECT pt.scene_id, CAST(floor((cell_row + 0.5E0) * 1.2E0 + 0.5E0) AS INT) AS centre_row, CAST(floor((cell_col + 0.5E0) * 1.2E0 + 0.5E0) AS INT) AS centre_col, CAST(radius AS INT) AS radius, votes, CAST(support AS BIGINT) AS support
    FROM pt JOIN ({_leaders}) g ON g.scene_id = pt.scene_id AND g.k = pt.k)"""
VALIDATED = f"""{CIRCLES},
  rp AS (SELECT cf.*, centre_row + a.i AS pr, centre_col + b.i AS pc FROM cf, LATERAL (SELECT unnest(range(-radius - 1, radius + 2)) AS i) a, LATERAL (SELECT unnest(range(-radius - 1, radius + 2)) AS i) b
    WHERE a.i * a.i + b.i * b.i BETWEEN (radius - 1) * (radius - 1) AND (radius + 1) * (radius + 1)),
  es AS (SELECT rp.scene_id, centre_row, centre_col, radius, votes, support, count(ed.r) / CAST(count(*) AS DOUBLE) AS edge_strength FROM rp JOIN st ON st.scene_id = rp.scene_id AND pr BETWEEN 0 AND h AND pc BETWEEN 0 AND w
    LEFT JOIN ed ON ed.scene_id = rp.scene_id AND ed.r = pr AND ed.c = pc GROUP BY 1, 2, 3, 4, 5, 6),
  dw AS (SELECT DISTINCT radius, list_transform(range(-radius - 1, radius + 2), lambda y: CAST(floor(sqrt(CAST((radius + 1) * (radius + 1) - y * y AS DOUBLE))) AS BIGINT)) AS ws FROM cf),
  dm AS (SELECT radius, ws, list_transform(range(1, len(ws)), lambda i: abs(ws[i + 1] - ws[i])) AS mv FROM dw),
  dc AS (SELECT radius, 2 * list_sum(ws) + len(ws) AS px, 2 * list_sum(list_transform(mv, lambda m: greatest(m, 1))) AS steps, 2 * list_sum(list_transform(mv, lambda m: CASE WHEN m = 0 THEN 1.0E0 ELSE sqrt(2.0E0) + m - 1 END)) AS len FROM dm),
  vd AS (SELECT es.*, CASE WHEN es.radius * 10 >= 60 THEN least(1, es.radius * 10 / 100.0E0) ELSE 0.5E0 END AS size_coherence, 4 * pi() * (px - steps / 2.0E0 - 1) / (len * len) AS circularity FROM es JOIN dc ON dc.radius = es.radius)"""


def round_edges(v):
    level = sh.detection_level(v.pixels)
    settings = ci.scene_settings(level)
    return ci.circle_edges(level, settings), settings


@query("n18_gradient_centres", f"{GRADIENT_VOTES} SELECT scene_id, cell_row, cell_col, votes FROM cc")
def _(v):
    return ci.centre_candidates(ci.gradient_votes(*round_edges(v)), LEAST)


@query("n18_gradient_circles", f"{CIRCLES} SELECT * FROM cf")
def _(v):
    return ci.gradient_circles(*round_edges(v), LEAST)


@query(
    "n18_circle_validation",
    f"""{VALIDATED} SELECT scene_id, centre_row, centre_col, radius, votes, support, round(edge_strength, 9) AS edge_strength, round(size_coherence, 9) AS size_coherence, round(circularity, 9) AS circularity,
    round(0.4E0 * edge_strength + 0.3E0 * size_coherence + 0.3E0 * circularity, 9) AS significance FROM vd""",
)
def _(v):
    edge, settings = round_edges(v)
    edge = an.cut_lineage(edge)
    out = ci.validated_circles(ci.gradient_circles(edge, settings, LEAST), edge, settings)
    return out.select("scene_id", "centre_row", "centre_col", "radius", "votes", "support", *[r9(c) for c in ("edge_strength", "size_coherence", "circularity", "significance")])


# --- outlines
# Border following: a state (r, c, look) per region; the first of the eight directions from ``look`` on that meets the region is taken. dir: east, then clockwise.
DIRS = "dr AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) t(d, a, b))"


def contour_sql(regions: str) -> str:
    """CTEs from labelled pixels to ``cq``: one row per region with its boundary polygon's measures; ``ct`` has the ordered boundary, ``i`` from 0."""
    return f"""{DIRS}, rg AS (SELECT DISTINCT scene_id, comp_row, comp_col FROM {regions}),
    tr AS (SELECT scene_id, comp_row, comp_col, 0 AS i, comp_row AS r, comp_col AS c, 5 AS look, -1 AS d0, false AS done FROM rg
      UNION ALL SELECT t.scene_id, t.comp_row, t.comp_col, t.i + 1, t.r + q.a, t.c + q.b, (q.d + 6) % 8, CASE WHEN t.d0 < 0 THEN q.d ELSE t.d0 END, t.i > 0 AND t.r = t.comp_row AND t.c = t.comp_col AND q.d = t.d0
      FROM tr t, LATERAL (SELECT d.d, d.a, d.b FROM dr d JOIN {regions} p ON p.scene_id = t.scene_id AND p.comp_row = t.comp_row AND p.comp_col = t.comp_col AND p.r = t.r + d.a AND p.c = t.c + d.b ORDER BY (d.d - t.look + 8) % 8 LIMIT 1) q WHERE NOT t.done),
    ed_ AS (SELECT scene_id, comp_row, comp_col, min(i) FILTER (done) AS stop FROM tr GROUP BY 1, 2, 3),
    ct AS (SELECT tr.scene_id, tr.comp_row, tr.comp_col, tr.i, tr.r, tr.c, coalesce(stop - 1, 1) AS n FROM tr JOIN ed_ ON ed_.scene_id = tr.scene_id AND ed_.comp_row = tr.comp_row AND ed_.comp_col = tr.comp_col WHERE tr.i < coalesce(stop - 1, 1)),
    cx AS (SELECT a.scene_id, a.comp_row, a.comp_col, a.c AS x, a.r AS y, b.c AS nx, b.r AS ny, a.c * b.r - b.c * a.r AS cr FROM ct a JOIN ct b ON b.scene_id = a.scene_id AND b.comp_row = a.comp_row AND b.comp_col = a.comp_col AND b.i = (a.i + 1) % a.n),
    cq AS (SELECT scene_id, comp_row, comp_col, count(*) AS n_steps, abs(sum(cr)) / 2.0E0 AS area_px, sum(sqrt(CAST((nx - x) * (nx - x) + (ny - y) * (ny - y) AS DOUBLE))) AS perimeter_px,
      CASE WHEN sum(cr) = 0 THEN avg(y) ELSE sum((y + ny) * cr) / (3.0E0 * sum(cr)) END AS centre_row, CASE WHEN sum(cr) = 0 THEN avg(x) ELSE sum((x + nx) * cr) / (3.0E0 * sum(cr)) END AS centre_col FROM cx GROUP BY 1, 2, 3)"""


EIGHT = f"{CLEAN}, {label_sql('tp', 'lb', True)}"


@query(
    "n19_outlines",
    f"""{EIGHT}, {contour_sql('lb')} SELECT scene_id, comp_row, comp_col, n_steps, area_px, round(perimeter_px, 8) AS perimeter_px, round(centre_row, 8) AS centre_row, round(centre_col, 8) AS centre_col FROM cq""",
)
def _(v):
    o = co.outlines(labelled(v, 8).select(*PX, "comp_row", "comp_col"))
    return o.select(*rg.COMP, "n_steps", "area_px", *[F.round(c, 8).alias(c) for c in ("perimeter_px", "centre_row", "centre_col")])


# A box per pair of boundary points that has all others on one side: the sides of the hull.
@query(
    "n19_smallest_boxes",
    f"""{EIGHT}, bp AS (SELECT DISTINCT scene_id, comp_row, comp_col, r, c FROM lb a WHERE (SELECT count(*) FROM lb b WHERE b.scene_id = a.scene_id AND b.comp_row = a.comp_row AND b.comp_col = a.comp_col AND abs(a.r - b.r) + abs(a.c - b.c) = 1) < 4),
    hs AS (SELECT p.scene_id, p.comp_row, p.comp_col, p.r, p.c, q.r - p.r AS er, q.c - p.c AS ec FROM bp p JOIN bp q ON q.scene_id = p.scene_id AND q.comp_row = p.comp_row AND q.comp_col = p.comp_col AND (q.r <> p.r OR q.c <> p.c)
      WHERE NOT EXISTS (SELECT 1 FROM bp s WHERE s.scene_id = p.scene_id AND s.comp_row = p.comp_row AND s.comp_col = p.comp_col AND (q.c - p.c) * (s.r - p.r) - (q.r - p.r) * (s.c - p.c) < 0)),
    ex_ AS (SELECT hs.scene_id, hs.comp_row, hs.comp_col, hs.r, hs.c, er, ec, max(s.c * ec + s.r * er) - min(s.c * ec + s.r * er) AS u, max(s.r * ec - s.c * er) - min(s.r * ec - s.c * er) AS w FROM hs JOIN bp s ON s.scene_id = hs.scene_id AND s.comp_row = hs.comp_row AND s.comp_col = hs.comp_col GROUP BY 1, 2, 3, 4, 5, 6, 7),
    sz AS (SELECT scene_id, comp_row, comp_col, u / sqrt(CAST(er * er + ec * ec AS DOUBLE)) AS u, w / sqrt(CAST(er * er + ec * ec AS DOUBLE)) AS w FROM ex_)
    SELECT scene_id, comp_row, comp_col, round(min(u * w), 6) AS box_area FROM sz GROUP BY 1, 2, 3""",
)
def _(v):
    o = co.outlines(labelled(v, 8).select(*PX, "comp_row", "comp_col"), min_px=2)
    return o.select(*rg.COMP, F.round(F.col("length_px") * F.col("width_px"), 6).alias("box_area"))


# --- crowding as columns
@query(
    "g04_load_class",
    f"""{STATS}, k AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS k FROM fs), f AS (SELECT scene_id, comp_row, comp_col, row_number() OVER (PARTITION BY scene_id ORDER BY n_px DESC, comp_row, comp_col) AS rn FROM k WHERE k > 4 AND n_px BETWEEN 25 AND 400),
    o AS (SELECT k.*, k <= 4 OR coalesce(rn <= 6, false) AS ok FROM k LEFT JOIN f ON f.scene_id = k.scene_id AND f.comp_row = k.comp_row AND f.comp_col = k.comp_col)
    SELECT scene_id, comp_row, comp_col, n_px, CASE WHEN k > 4 THEN 'medium' ELSE 'normal' END AS load_class, ok AND count(*) FILTER (ok) OVER (PARTITION BY scene_id) <= 8 AS passes_load FROM o""",
)
def _(v):
    s = rg.component_load(rg.region_stats(labelled(v)), medium=4, major=1000, final=8, medium_top=6)
    return s.select(*rg.COMP, "n_px", "load_class", "passes_load")


@query("p02_scene_families")
def _(v):
    """All families of a scene at the size of the sample scenes, placed on a grid and ranked against a quota."""
    zones = v.sql("""SELECT scene_id, CASE WHEN scene_id % 4 = 1 THEN 'deforested_visible_earthworks' ELSE 'other' END AS zone_type, 30 + 10 * (scene_id % 4) AS min_feature_m, 600 AS max_feature_m, CAST(12 AS BIGINT) AS quota FROM {pixels} GROUP BY scene_id""")
    grid = v.sql("SELECT scene_id, -60.0E0 + scene_id * 0.01E0 AS west, -3.0E0 AS north, 0.0001E0 AS step_deg FROM {pixels} GROUP BY scene_id")
    return an.scene_families(v.pixels, zones, grid, "fast", line_votes=14, circle_votes=LEAST, significance=0.5)
