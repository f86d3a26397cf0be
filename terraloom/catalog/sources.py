"""Queries over sources, dimensions, sinks and hooks: A1-A19, B1-B11, I5, L1-L3."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from terraloom.catalog.coordinates import MOVED
from terraloom.catalog.evidence import PRIO, top_candidates
from terraloom.catalog.pixels import ENH, INDEX_SQL, PX
from terraloom.catalog.registry import query
from terraloom.catalog.reports import FLAGS
from terraloom.catalog.scalars import REASON, DAYS, POINTS, ladder_sql, lookup_sql, q
from terraloom.catalog.spatial import AREAS, PAIRS, SCENE_SCORE, SCORED, SUPPORT
from terraloom.constants import PRESETS, SURVEY_ZONES
from terraloom.functions import labels as L
from terraloom.operators import export as ex
from terraloom.operators import masks
from terraloom.operators import quality as qa
from terraloom.operators import spatial as sp
from terraloom.runtime import ensure_checkpoint_dir
from terraloom.sources import catalogues as cat
from terraloom.sources import readers as rd
from terraloom.sources import registry as reg
from terraloom.sources import tables as tb
from terraloom.streaming.ingest import process_new_scenes


def r9(c, name=None):
    return F.round(c, 9).alias(name or c)


def granule_texts(v, chunk=500):
    """Granule files as JSON text: parallel arrays of up to ``chunk`` consecutive shots each."""
    s = v.shots.select(
        F.floor(F.col("shot_number") / chunk).alias("granule"), "shot_number", "beam", "lon", "lat", "elevation_ground", "rh95", "rh100"
    )
    rows = s.groupBy("granule").agg(
        F.sort_array(F.collect_list(F.struct("shot_number", "beam", "lon", "lat", "elevation_ground", "rh95", "rh100"))).alias("a")
    )
    beam = F.transform("a", lambda x: F.concat(F.lit("BEAM00"), F.lpad(F.bin(x["beam"]), 2, "0")))
    num = lambda f: F.transform("a", lambda x: x[f])
    # canopy height in every third granule, percentiles in every other third, only elevations in the rest
    obj = F.struct(
        num("lon").alias("longitude"), num("lat").alias("latitude"), num("shot_number").alias("shot_number"), beam.alias("beam"),
        F.transform("a", lambda x: F.coalesce(x["elevation_ground"], F.lit(float("nan")))).alias("elevation_ground"),
        F.transform("a", lambda x: x["elevation_ground"] + x["rh100"]).alias("elevation_canopy_top"),
        F.when(F.col("granule") % 3 == 0, num("rh100")).alias("canopy_height"),
        F.when(F.col("granule") % 3 == 1, num("rh95")).alias("rh95"), F.when(F.col("granule") % 3 == 1, num("rh100")).alias("rh100"),
    )
    return rows.select("granule", F.to_json(obj).alias("text"))


def granules(v):
    return granule_texts(v).select("granule", F.from_json("text", rd.GRANULE_SCHEMA).alias("g")).select("granule", "g.*")


@query(
    "a01_granule_scan",
    """SELECT CAST(floor(shot_number / 500) AS BIGINT) AS granule, CAST(row_number() OVER (PARTITION BY floor(shot_number / 500) ORDER BY shot_number) - 1 AS INT) AS position, shot_number, round(lon, 9) AS lon, round(lat, 9) AS lat, round(elevation_ground, 9) AS elevation_ground FROM shots""",
)
def _(v):
    s = rd.explode_granules(granules(v), ["granule"])
    return s.select("granule", "position", "shot_number", r9("longitude", "lon"), r9("latitude", "lat"), r9("elevation_ground"))


@query(
    "a02_granule_union",
    "SELECT CAST(floor(shot_number / 500) AS BIGINT) AS granule, count(*) AS n, min(shot_number) AS first_shot, count(elevation_ground) AS n_valid FROM shots GROUP BY 1",
)
def _(v):
    """Granule folders written and read back: every file of the folder counts, not only the first."""
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext.getCheckpointDir()}/granules-{uuid.uuid4().hex}"
    granule_texts(v).write.partitionBy("granule").text(path)
    shots = rd.read_granules(v.spark, path + "/*")
    g = F.regexp_extract("source_file", "granule=([0-9]+)", 1).cast("long")
    return shots.groupBy(g.alias("granule")).agg(
        F.count(F.lit(1)).alias("n"), F.min("shot_number").alias("first_shot"), F.count("elevation_ground").alias("n_valid")
    )


@query(
    "a03_canopy_height_fallback",
    """s AS (SELECT *, CAST(floor(shot_number / 500) AS BIGINT) % 3 AS k FROM shots) SELECT shot_number, round(CASE k WHEN 0 THEN rh100 WHEN 1 THEN rh95 ELSE greatest(0, elevation_ground + rh100 - elevation_ground) + 0 * elevation_ground END, 8) AS rh95,
    round(CASE k WHEN 2 THEN greatest(0, elevation_ground + rh100 - elevation_ground) + 0 * elevation_ground ELSE rh100 END, 8) AS rh100 FROM s""",
)
def _(v):
    s = rd.with_canopy_heights(rd.explode_granules(granules(v), ["granule"]))
    return s.select("shot_number", F.round("rh95", 8).alias("rh95"), F.round("rh100", 8).alias("rh100"))


@query("a04_beam_attribution", "SELECT shot_number, CASE WHEN beam < 4 THEN 1 ELSE 0 END AS power FROM shots")
def _(v):
    name = F.concat(F.lit("BEAM"), F.lpad(F.bin(F.when(F.col("beam") < 4, F.col("beam")).otherwise(F.col("beam") + 1)), 4, "0"))
    return v.shots.select("shot_number", rd.power_beam(name).alias("power"))


STACK = ["blue", "green", "red", "nir", "red_edge_1", "red_edge_3", "swir1", "swir2"]


@query("a06_band_naming", f"SELECT scene_id, pix_row, pix_col, {', '.join(f'round({b}, 9) AS {b}' for b in STACK)} FROM pixels")
def _(v):
    layers = F.array(*[F.struct(F.lit(i).alias("position"), F.col(b).alias("value")) for i, b in enumerate(STACK, 1)])
    long = v.pixels.select(*PX, F.explode(layers).alias("l")).select(*PX, "l.position", "l.value")
    code = tb.positional_code(F.lit(None).cast("string"), F.col("position"), F.lit(0))
    wide = tb.named_bands(long.withColumn("band", code))
    return wide.select(*PX, *[r9(b) for b in STACK])


COARSE = "co AS (SELECT scene_id, CAST(floor(pix_row / 2) AS INT) AS r, CAST(floor(pix_col / 2) AS INT) AS c, avg(red_edge_1) AS v FROM pixels GROUP BY 1, 2, 3)"


def coarse(v):
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return v.pixels.groupBy("scene_id", half("pix_row"), half("pix_col")).agg(F.avg("red_edge_1").alias("value"))


@query(
    "a07_resample_nearest",
    f"{COARSE} SELECT p.scene_id, p.pix_row, p.pix_col, round(co.v, 9) AS value FROM pixels p LEFT JOIN co ON co.scene_id = p.scene_id AND co.r = floor(p.pix_row / 2) AND co.c = floor(p.pix_col / 2)",
)
def _(v):
    return tb.resample_nearest(coarse(v), v.pixels.select(*PX), "value").select(*PX, r9("value"))


@query(
    "a07_resample_bilinear",
    f"""{COARSE}, g AS (SELECT scene_id, pix_row, pix_col, (pix_row + 0.5E0) / 2 - 0.5E0 AS y, (pix_col + 0.5E0) / 2 - 0.5E0 AS x FROM pixels),
    k AS (SELECT a.i AS a, b.i AS b FROM range(0, 2) a(i), range(0, 2) b(i)), w AS (SELECT g.*, CAST(floor(y) + a AS INT) AS r, CAST(floor(x) + b AS INT) AS c, CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS wt FROM g, k)
    SELECT w.scene_id, pix_row, pix_col, round(sum(co.v * wt) / sum(wt), 9) AS value FROM w JOIN co ON co.scene_id = w.scene_id AND co.r = w.r AND co.c = w.c WHERE wt > 0 GROUP BY 1, 2, 3""",
)
def _(v):
    return tb.resample_bilinear(coarse(v), v.pixels.select(*PX), "value").select(*PX, r9("value"))


# Scenes placed over zones so that some keep plenty of pixels and some only a sliver.
PLACED = "SELECT scene_id, pix_row, pix_col, scene_id % 25 AS zone_id, z_west + (0.13E0 + 0.0005E0 * (scene_id % 3) * 10) + pix_col * 0.0002E0 AS lon, z_north - pix_row * 0.0002E0 AS lat FROM "
PLACED_SRC = "(SELECT p.*, z.west AS z_west, z.north AS z_north FROM {px} p JOIN {zn} z ON z.zone_id = p.scene_id % 25) pz"


@query(
    "a08_clip_to_zone",
    f"""pl AS ({PLACED}{PLACED_SRC.format(px='pixels', zn='zones')}), j AS (SELECT pl.*, z.west, z.east, z.south, z.north, pl.lon BETWEEN z.west AND z.east AND pl.lat BETWEEN z.south AND z.north AS i FROM pl JOIN zones z ON z.zone_id = pl.zone_id),
    s AS (SELECT scene_id, coalesce(max(pix_row) FILTER (i) - min(pix_row) FILTER (i) + 1, 0) < 10 OR coalesce(max(pix_col) FILTER (i) - min(pix_col) FILTER (i) + 1, 0) < 10 AS small FROM j GROUP BY scene_id)
    SELECT j.scene_id, pix_row, pix_col FROM j JOIN s ON s.scene_id = j.scene_id WHERE CASE WHEN small THEN lon BETWEEN west - 0.01E0 AND east + 0.01E0 AND lat BETWEEN south - 0.01E0 AND north + 0.01E0 ELSE i END""",
)
def _(v):
    placed = v.sql(PLACED + PLACED_SRC.format(px="{pixels}", zn="{zones}"))
    return tb.clip_to_zone(placed, v.zones).select(*PX)


def feature_texts(v):
    """GeoJSON feature collections of up to 100 detections: points, lines and polygons with gaps in the properties."""
    i, lon, lat = F.col("det_id"), F.col("lon"), F.col("lat")
    far = F.when(i % 37 == 0, lon + 40).otherwise(lon)
    pt = F.to_json(F.struct(F.array(far, lat).alias("c")))
    line = F.to_json(F.struct(F.array(F.array(lon, lat), F.array(lon + 0.002, lat + 0.004)).alias("c")))
    poly = F.to_json(
        F.struct(F.array(F.array(F.array(lon, lat), F.array(lon + 0.006, lat + 0.001), F.array(lon + 0.002, lat + 0.008), F.array(lon, lat))).alias("c"))
    )
    kind = F.when(i % 3 == 0, "Point").when(i % 3 == 1, "LineString").otherwise("Polygon")
    body = F.when(i % 3 == 0, pt).when(i % 3 == 1, line).otherwise(poly)
    coords = F.regexp_extract(body, r'^\{"c":(.*)\}$', 1)
    props = F.to_json(
        F.struct(
            F.when(i % 5 > 0, i.cast("string")).alias("id"), F.when(i % 11 > 0, F.col("det_type")).alias("type"),
            F.col("confidence"), F.when(i % 13 > 0, F.col("area_m2")).alias("area_m2"),
            F.when(i % 17 == 0, F.format_string("(%.4f, %.4f)", F.round(lon, 4), F.round(lat, 4))).alias("geo_center_calculated"),
        )
    )
    text = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}")
    )
    f = v.detections.select(F.floor(i / 100).alias("part"), i, text.alias("t"))
    g = f.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("det_id", "t"))).alias("a"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("a", lambda x: x["t"]), ","), F.lit("]}"))
    return g.select("part", F.transform("a", lambda x: x["det_id"]).alias("ids"), whole.alias("text"))


def feature_table(v):
    c = feature_texts(v).select("part", "ids", F.from_json("text", rd.COLLECTION_SCHEMA).alias("c")).select("part", "ids", "c.features")
    f = rd.explode_collections(c, ["part", "ids"])
    return f.withColumn("det_id", F.col("ids")[F.col("position")]).drop("ids")


GEOM = """gm AS (SELECT *, CASE det_id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind, CASE WHEN det_id % 37 = 0 AND det_id % 3 = 0 THEN lon + 40 ELSE lon END AS x FROM detections)"""


@query(
    "a09_geojson_reader",
    f"""{GEOM}, p AS (SELECT det_id, CASE WHEN det_id % 11 > 0 THEN det_type ELSE 'unknown' END AS det_type, coalesce(confidence, 0.6E0) AS confidence, CASE WHEN det_id % 13 > 0 THEN area_m2 ELSE 0 END AS area_m2,
      CASE kind WHEN 'Point' THEN x WHEN 'LineString' THEN (lon + lon + 0.002E0) / 2 ELSE CASE WHEN det_id % 17 = 0 THEN round(lon, 4) ELSE (lon + lon + 0.006E0 + lon + 0.002E0 + lon) / 4 END END AS lon,
      CASE kind WHEN 'Point' THEN lat WHEN 'LineString' THEN (lat + lat + 0.004E0) / 2 ELSE CASE WHEN det_id % 17 = 0 THEN round(lat, 4) ELSE (lat + lat + 0.001E0 + lat + 0.008E0 + lat) / 4 END END AS lat FROM gm)
    SELECT CASE WHEN det_id % 5 > 0 THEN CAST(det_id AS VARCHAR) END AS id, det_type, confidence, area_m2, round(lon, 8) AS lon, round(lat, 8) AS lat FROM p WHERE lon BETWEEN -80 AND -44 AND lat BETWEEN -20 AND 10""",
)
def _(v):
    d = rd.feature_rows(feature_table(v))
    return d.select("id", "det_type", "confidence", "area_m2", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


POLY = "111000E0 * 111000E0 * abs(0.006E0 * 0.008E0 - 0.002E0 * 0.001E0) / 2 * cos(radians(lat + 0.009E0 / 4))"


@query(
    "a10_provider_features",
    f"""{GEOM} SELECT det_id, CASE WHEN det_id % 5 > 0 THEN CAST(det_id AS VARCHAR) ELSE 'gedi_' || CAST(det_id AS VARCHAR) END AS id, CASE WHEN det_id % 11 > 0 THEN det_type ELSE 'unknown' END AS det_type, coalesce(confidence, 0) AS confidence,
    round(CASE kind WHEN 'Polygon' THEN {POLY} ELSE 0 END, 4) AS area_m2, round(CASE kind WHEN 'Point' THEN x WHEN 'LineString' THEN lon + 0.001E0 ELSE lon + 0.008E0 / 3 END, 8) AS lon, round(CASE kind WHEN 'Point' THEN lat WHEN 'LineString' THEN lat + 0.002E0 ELSE lat + 0.009E0 / 3 END, 8) AS lat FROM gm""",
)
def _(v):
    f = feature_table(v)
    ids = f.select("det_id", F.struct("geometry", "properties").alias("f"))
    out = rd.provider_rows(ids.select("det_id", "f.*"), "gedi", "det_id")
    # the id carries the detection, so it can be checked row by row
    det = F.regexp_replace("id", "gedi_", "").cast("long").alias("det_id")
    return out.select(det, "id", "det_type", "confidence", F.round("area_m2", 4).alias("area_m2"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(
    "a11_vector_summary",
    f"""{GEOM} SELECT det_id, kind AS geometry_type, round(CASE kind WHEN 'Point' THEN x WHEN 'LineString' THEN lon + 0.001E0 ELSE lon + 0.008E0 / 3 END, 8) AS lon, round(CASE kind WHEN 'Point' THEN lat WHEN 'LineString' THEN lat + 0.002E0 ELSE lat + 0.009E0 / 3 END, 8) AS lat,
    round(CASE kind WHEN 'Polygon' THEN {POLY} ELSE 0 END, 4) AS area_m2 FROM gm""",
)
def _(v):
    s = rd.vector_summary(feature_table(v), "det_id")
    return s.select("det_id", "geometry_type", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round("area_m2", 4).alias("area_m2"))


# Detections as geometries of several parts and with holes, all made of squares (x, y, side), whose areas and centres are known.
PARTS = "SELECT det_id, lon AS x, lat AS y, CAST(det_id % 4 AS INT) AS form FROM "


def square_area(y: str, a: str) -> str:
    """Square metres of a square's ring as measured at the mean latitude of its five vertices."""
    return f"({a} * {a} * 111000.0E0 * 111000.0E0 * cos(radians({y} + 0.4E0 * {a})))"


@query(
    "a11_multipart_summary",
    f"""pt AS ({PARTS} detections) SELECT det_id, CASE form WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'MultiPoint' ELSE 'MultiLineString' END AS geometry_type,
    round(CASE form WHEN 0 THEN (0.0001E0 * (x + 0.005E0) + 0.0004E0 * (x + 0.03E0)) / 0.0005E0 WHEN 1 THEN (0.0016E0 * (x + 0.02E0) - 0.0001E0 * (x + 0.015E0)) / 0.0015E0 WHEN 2 THEN x + 0.02E0 ELSE x + 0.025E0 END, 7) AS lon,
    round(CASE form WHEN 0 THEN (0.0001E0 * (y + 0.005E0) + 0.0004E0 * (y + 0.01E0)) / 0.0005E0 WHEN 1 THEN (0.0016E0 * (y + 0.02E0) - 0.0001E0 * (y + 0.015E0)) / 0.0015E0 WHEN 2 THEN y ELSE y + 0.005E0 END, 7) AS lat,
    round(CASE form WHEN 0 THEN {square_area('y', '0.01E0')} + {square_area('y', '0.02E0')} WHEN 1 THEN {square_area('y', '0.04E0')} - {square_area('(y + 0.01E0)', '0.01E0')} ELSE 0 END, 1) AS area_m2 FROM pt""",
)
def _(v):
    return rd.vector_summary(multipart(v), "det_id").select("det_id", "geometry_type", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("area_m2", 1).alias("area_m2"))


def multipart(v):
    """GeoJSON rows of the detections: two squares, a square with a hole, points, lines."""
    d = v.sql(PARTS + "{detections}")
    at = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    ring = lambda dx, dy, a: F.array(at(dx, dy), at(dx + a, dy), at(dx + a, dy + a), at(dx, dy + a), at(dx, dy))
    two = F.to_json(F.array(F.array(ring(0.0, 0.0, 0.01)), F.array(ring(0.02, 0.0, 0.02))))
    holed = F.to_json(F.array(ring(0.0, 0.0, 0.04), ring(0.01, 0.01, 0.01)))
    points = F.to_json(F.array(at(0.0, 0.0), at(0.04, 0.0)))
    lines = F.to_json(F.array(F.array(at(0.0, 0.0), at(0.01, 0.0)), F.array(at(0.04, 0.01), at(0.05, 0.01))))
    pick = lambda *xs: F.when(F.col("form") == 0, xs[0]).when(F.col("form") == 1, xs[1]).when(F.col("form") == 2, xs[2]).otherwise(xs[3])
    kind = pick(F.lit("MultiPolygon"), F.lit("Polygon"), F.lit("MultiPoint"), F.lit("MultiLineString"))
    return d.select("det_id", F.struct(kind.alias("type"), pick(two, holed, points, lines).alias("coordinates")).alias("geometry"), F.create_map(F.lit("id"), F.col("det_id").cast("string")).alias("properties"))


@query(
    "a10_multipart_features",
    f"""pt AS ({PARTS} detections) SELECT CAST(det_id AS VARCHAR) AS id, round(CASE form WHEN 0 THEN (0.0001E0 * (x + 0.005E0) + 0.0004E0 * (x + 0.03E0)) / 0.0005E0 WHEN 1 THEN x + 0.016E0 WHEN 2 THEN x + 0.02E0 ELSE x + 0.025E0 END, 7) AS lon, CAST(0.6 AS DOUBLE) AS confidence FROM pt""",
)
def _(v):
    return rd.feature_rows(multipart(v)).select("id", F.round("lon", 7).alias("lon"), "confidence")


def preset_mask(name):
    p = PRESETS[name]
    if name == "fast":
        return f"{INDEX_SQL['terra_preta_enhanced']} > 0.12E0 AND {INDEX_SQL['ndvi']} > 0.3E0 AND {INDEX_SQL['ndvi']} < 0.8E0 AND {INDEX_SQL['ndre1']} > 0.1E0"
    return ENH.format(tp=f"{p['tp_enhanced']}E0", nv=f"{p['ndvi_min']}E0", nr=f"{p['ndre1_min']}E0")


@query(
    "a12_parameter_presets",
    f"SELECT scene_id, {', '.join(f'count(*) FILTER ({preset_mask(n)}) AS {n}_px' for n in PRESETS)} FROM pixels GROUP BY scene_id",
)
def _(v):
    cond = {n: masks.fast_mask_with_red_edge() if n == "fast" else masks.enhanced_mask(n) for n in PRESETS}
    return v.pixels.groupBy("scene_id").agg(*[F.count_if(c).alias(f"{n}_px") for n, c in cond.items()])


@query(
    "a13_zone_settings",
    """SELECT det_id, zone_type, CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 0.12E0 ELSE 0.06E0 END AS crop_mark_threshold, 0.15E0 AS terra_preta_threshold,
    CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 50E0 ELSE 10E0 END AS geometric_min_size, CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 2E0 ELSE 1E0 END AS density_factor FROM detections JOIN zones USING (zone_id)""",
)
def _(v):
    z = v.zones.select("zone_id", "zone_type", tb.zone_settings(F.col("zone_type")).alias("s"))
    return v.detections.select("det_id", "zone_id").join(z, "zone_id").select("det_id", "zone_type", "s.*")


SPELLED = "SELECT det_id, CASE det_id % 7 WHEN 0 THEN 'Upper-NapoRegion' WHEN 1 THEN 'Trombetas River Junction' WHEN 2 THEN 'upper_napo' WHEN 3 THEN 'Negro-Madeira Confluence' WHEN 4 THEN 'Maranon-River' WHEN 5 THEN 'UpperNapoRegion' ELSE 'Some New-Zone' END AS zone FROM "


@query(
    "a14_zone_id_normalisation",
    f"s AS ({SPELLED} detections) SELECT det_id, CASE det_id % 7 WHEN 0 THEN 'upper_napo' WHEN 1 THEN 'trombetas' WHEN 2 THEN 'upper_napo' WHEN 3 THEN 'negro_madeira' WHEN 4 THEN 'maranon' WHEN 5 THEN 'upper_napo' ELSE 'some_new_zone' END AS zone FROM s",
)
def _(v):
    return v.sql(SPELLED + "{detections}").select("det_id", tb.normalised_zone(F.col("zone")).alias("zone"))


SOME_ZONES = [z for i, z in enumerate(SURVEY_ZONES) if i in (0, 1, 3, 8)]
ZONE_NAMES = "SELECT det_id, CASE det_id % 6 WHEN 0 THEN 'Xingu-Deep Forest' WHEN 1 THEN 'acre_capixaba_gap' WHEN 2 THEN 'ACRE CORRIDOR-GAP' WHEN 3 THEN 'labrea_terra_preta_belt' WHEN 4 THEN 'upper_naporegion' ELSE 'new_place' END AS zone FROM "


@query(
    "a13_zone_dimension",
    f"""zn AS ({ZONE_NAMES} detections), k AS (SELECT det_id, zone, CASE det_id % 6 WHEN 0 THEN 'xingu_deep_forest' WHEN 1 THEN 'acre_capixaba_gap' WHEN 2 THEN 'acre_corridor_gap' WHEN 3 THEN 'labrea_terra_preta_belt' WHEN 4 THEN 'upper_napo' ELSE 'new_place' END AS zone_key FROM zn),
    d AS (SELECT * FROM (VALUES {', '.join(f"('{z[0]}', {z[2]}::DOUBLE, {z[5]}::DOUBLE, {z[8]}, {z[9]}::DOUBLE, {z[10]}, {z[11]}, '{z[12]}')" for z in SOME_ZONES)}) t(id, lat, west, priority, radius, lo, hi, kind))
    SELECT det_id, zone_key, id IS NOT NULL AS known, coalesce(lat, 0) AS centre_lat, coalesce(west, -73) AS west, CAST(coalesce(priority, 3) AS INT) AS priority, coalesce(radius, 7) AS search_radius_km, CAST(coalesce(lo, 50) AS INT) AS min_feature_m, CAST(coalesce(hi, 500) AS INT) AS max_feature_m,
    coalesce(kind, 'forested_buried_sites') AS zone_type, CASE det_id % 6 WHEN 5 THEN 'New Place' WHEN 4 THEN 'Upper Naporegion' END AS default_title FROM k LEFT JOIN d ON d.id = k.zone_key""",
)
def _(v):
    z = tb.with_zone(v.sql(ZONE_NAMES + "{detections}"), tb.survey_zones(v.spark))
    title = F.when(~F.col("known"), F.col("zone_title")).alias("default_title")
    return z.select("det_id", "zone_key", "known", "centre_lat", "west", "priority", "search_radius_km", "min_feature_m", "max_feature_m", "zone_type", title)


CASCADE = f"""{SCENE_SCORE}, lm AS (SELECT *, CASE WHEN cloud_cover < 10 THEN 10 WHEN cloud_cover < 20 THEN 20 WHEN cloud_cover < 30 THEN 30 WHEN cloud_cover < 40 THEN 40 WHEN cloud_cover < 50 THEN 50 WHEN cloud_cover < 60 THEN 60 WHEN cloud_cover < 70 THEN 70 WHEN cloud_cover < 80 THEN 80 END AS lim
    FROM sq WHERE ov >= 50 AND km <= 75), bk AS (SELECT zone_id, min(lim) AS t FROM lm WHERE lim IS NOT NULL GROUP BY zone_id),
  rk AS (SELECT lm.zone_id, scene_id, quality, t, row_number() OVER (PARTITION BY lm.zone_id ORDER BY quality DESC, scene_id) AS rn FROM lm JOIN bk ON bk.zone_id = lm.zone_id AND lim <= t)"""


@query("a15_scene_search", f"{CASCADE} SELECT zone_id, scene_id, quality, CAST(t AS INT) AS threshold_used, CAST(rn AS INT) AS rank FROM rk WHERE rn <= 5")
def _(v):
    return cat.cascade_search(cat.scored_scenes(v.scenes, v.zones)).select("zone_id", "scene_id", "quality", "threshold_used", "rank")


@query("h06_scenes_by_quality", f"{SCENE_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY quality DESC, scene_id) AS rn FROM sq) SELECT zone_id, scene_id, quality, CAST(rn AS INT) AS rank FROM r WHERE rn <= 3")
def _(v):
    from terraloom.operators.display import top_per_group

    s = cat.scored_scenes(v.scenes, v.zones)
    return top_per_group(s, ["zone_id"], F.col("quality"), "scene_id", 3).select("zone_id", "scene_id", "quality", "rank")


GRAN = "SELECT CAST(floor(shot_number / 100) AS BIGINT) AS granule_id, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM {s} GROUP BY 1"


@query(
    "a16_granule_search",
    f"""g AS (SELECT *, DATE '2021-01-01' + CAST(granule_id * 20 AS INT) AS acquired FROM ({GRAN.format(s='shots')}) a), o AS (SELECT z.zone_id, granule_id, acquired, greatest(0, least(g.east, z.east) - greatest(g.west, z.west)) * greatest(0, least(g.north, z.north) - greatest(g.south, z.south)) / ((z.east - z.west) * (z.north - z.south)) AS ov
      FROM g JOIN zones z ON greatest(g.west, z.west) < least(g.east, z.east) AND greatest(g.south, z.south) < least(g.north, z.north))
    SELECT zone_id, granule_id, round(CASE WHEN DATE '2024-12-31' - acquired < 365 THEN 20 WHEN DATE '2024-12-31' - acquired < 730 THEN 15 WHEN DATE '2024-12-31' - acquired < 1095 THEN 10 ELSE 0 END + ov * 30, 7) AS relevance FROM o""",
)
def _(v):
    g = v.sql(GRAN.format(s="{shots}")).withColumn("acquired", F.date_add(F.to_date(F.lit("2021-01-01")), (F.col("granule_id") * 20).cast("int")))
    out = cat.granule_relevance(g, v.zones, F.to_date(F.lit("2024-12-31")))
    return out.select("zone_id", "granule_id", F.round("relevance", 7).alias("relevance"))


@query("a17_default_zones", "SELECT s.scene_id, z.zone_id FROM scenes s JOIN zones z ON z.zone_id = s.zone_id WHERE z.priority = 1")
def _(v):
    return v.scenes.join(cat.default_zones(v.zones).select("zone_id"), "zone_id").select("scene_id", "zone_id")


HAVE = ["B02", "B03", "B04", "B08", "B05", "B11"]


def bands(v):
    """Scenes with some bands missing by id."""
    arr = F.array_compact(F.array(*[F.when(F.col("scene_id") % (i + 2) > 0, F.lit(b)) for i, b in enumerate(HAVE)]))
    return v.scenes.select("scene_id", arr.alias("bands"))


def _has(b):
    return f"scene_id % {HAVE.index(b) + 2} > 0"


@query("a18_required_bands", f"SELECT scene_id FROM scenes WHERE {' AND '.join(_has(b) for b in ('B02', 'B03', 'B04', 'B08'))}")
def _(v):
    return bands(v).where(cat.has_required_bands(F.col("bands"))).select("scene_id")


@query("a19_composite_bands", f"SELECT scene_id FROM scenes WHERE {' + '.join(f'CAST({_has(b)} AS INT)' for b in ('B02', 'B03', 'B04', 'B08'))} >= 3")
def _(v):
    return bands(v).where(cat.has_composite_bands(F.col("bands"))).select("scene_id")


@query(
    "i05_band_sets",
    f"""SELECT scene_id, {' + '.join(f'CAST({_has(b)} AS INT)' for b in ('B02', 'B03', 'B04', 'B08'))} AS n_essential, concat_ws(',', {', '.join(f"CASE WHEN {_has(b)} THEN NULL ELSE '{b}' END" if b in HAVE else f"'{b}'" for b in ('B02', 'B03', 'B04', 'B08', 'B05', 'B07', 'B11', 'B12'))}) AS missing FROM scenes""",
)
def _(v):
    essential = F.array(*[F.lit(b) for b in ("B02", "B03", "B04", "B08")])
    return bands(v).select(
        "scene_id", F.size(F.array_intersect(essential, F.col("bands"))).alias("n_essential"), F.array_join(cat.missing_bands(F.col("bands")), ",").alias("missing")
    )


@query(
    "a20_download_links",
    """SELECT scene_id, concat_ws(' ', CASE WHEN scene_id % 2 = 0 THEN 'https://host/' || scene_id || '.h5' END, CASE WHEN scene_id % 3 > 0 THEN 's3://bucket/' || scene_id || '.h5' END) AS urls FROM scenes""",
)
def _(v):
    i = F.col("scene_id").cast("string")
    link = lambda rel, *href: F.struct(F.lit(rel).alias("rel"), F.concat(*href).alias("href"))
    data = "http://esipfed.org/ns/fedsearch/1.1/data#"
    links = F.array_compact(
        F.array(
            link("http://esipfed.org/ns/fedsearch/1.1/browse#", F.lit("https://host/"), i, F.lit(".png")),
            F.when(F.col("scene_id") % 3 > 0, link(data, F.lit("s3://bucket/"), i, F.lit(".h5"))),
            F.when(F.col("scene_id") % 2 == 0, link(data, F.lit("https://host/"), i, F.lit(".h5"))),
            link(data, F.lit("https://host/"), i, F.lit(".xml")),
        )
    )
    return v.scenes.select("scene_id", F.array_join(cat.pick_download(links), " ").alias("urls"))


# --- sinks
NAMED = "SELECT d.*, CASE d.zone_id % 4 WHEN 0 THEN 'upano_valley_confirmed' WHEN 1 THEN 'trombetas' WHEN 2 THEN 'upper_napo_micro' ELSE 'elsewhere' END AS zone_name FROM {d} d"
XY = "CASE WHEN abs(lon) < 20 AND abs(lat) > 44 THEN lat ELSE lon END AS x"


def flat(df, *names):
    """Nested feature rows back as columns, read from the JSON text that would be written."""
    j = df.select("det_id", F.to_json(F.struct("type", "geometry", "properties")).alias("j"))
    kinds = {"s": "string", "d": "double", "i": "int", "b": "boolean"}
    return j.select(
        "det_id", F.get_json_object("j", "$.geometry.coordinates[0]").cast("double").alias("x"),
        *[F.get_json_object("j", path).cast(kinds[k]).alias(n) for n, path, k in names],
    )


@query(
    "b01_lidar_export",
    f"""n AS ({NAMED.format(d='detections')}), d AS (SELECT *, zone_name AS zone, det_type AS t FROM n WHERE provider = 'gedi' AND coalesce(confidence, 0) >= 0.4E0)
    SELECT det_id, {XY}, det_type AS type, confidence, area_m2 / 1E6 AS area_km2, n_points AS pulses, CASE WHEN det_type LIKE '%clearing%' THEN {ladder_sql('area_m2', L.LIDAR_TEXT['clearing'])} ELSE {q(L.LIDAR_TEXT['other'])} END AS interpretation,
    {ladder_sql(POINTS, L.PRIORITY_TEXT, '>=')} AS priority, {lookup_sql(L.SEASONS)} AS season, {DAYS} || ' days (' || CASE WHEN {DAYS} <= 5 THEN 'preliminary survey' WHEN {DAYS} <= 10 THEN 'comprehensive survey' ELSE 'extensive excavation campaign' END || ')' AS days FROM d""",
)
def _(v):
    f = ex.lidar_features(v.sql(NAMED.format(d="{detections}")), "run")
    p = "$.properties."
    return flat(
        f, ("type", p + "type", "s"), ("confidence", p + "confidence", "d"), ("area_km2", p + "area_km2", "d"), ("pulses", p + "sensor_details.pulse_density", "i"),
        ("interpretation", p + "archaeological_assessment.interpretation", "s"), ("priority", p + "archaeological_assessment.investigation_priority", "s"),
        ("season", p + "field_investigation.optimal_visit_season", "s"), ("days", p + "field_investigation.estimated_investigation_days", "s"),
    )


@query(
    "b02_spectral_export",
    f"""n AS ({NAMED.format(d='detections')}), d AS (SELECT *, zone_name AS zone, det_type AS t FROM n WHERE provider = 'sentinel2' AND coalesce(confidence, 0) >= 0.5E0)
    SELECT det_id, {XY}, det_type AS type, confidence, area_m2 / 1E6 AS area_km2, CASE WHEN det_type LIKE '%terra%' THEN {ladder_sql('area_m2', L.SPECTRAL_TEXT['terra_preta'])} WHEN det_type LIKE 'crop%' THEN {q(L.SPECTRAL_TEXT['crop_mark'])}
    ELSE {ladder_sql('confidence', L.SPECTRAL_TEXT['other'], '>=')} END AS interpretation, {lookup_sql(L.SEASONS)} AS season, zone FROM d""",
)
def _(v):
    f = ex.spectral_features(v.sql(NAMED.format(d="{detections}")), "run")
    p = "$.properties."
    return flat(
        f, ("type", p + "type", "s"), ("confidence", p + "confidence", "d"), ("area_km2", p + "area_km2", "d"),
        ("interpretation", p + "archaeological_assessment.interpretation", "s"), ("season", p + "field_investigation.optimal_visit_season", "s"), ("zone", p + "data_provenance.zone", "s"),
    )


COMB = re.sub(r"\bcomb\b", "combined_confidence", re.sub(r"\blidar\b", "lidar_support", re.sub(r"\bdist\b", "convergence_distance_m", REASON)))


@query(
    "b03_combined_export",
    f"""{SCORED}, {SUPPORT}, r AS (SELECT *, {COMB} AS reason FROM su WHERE coalesce(confidence, 0) >= 0.5E0)
    SELECT det_id, lon AS x, confidence, round(convergent_score, 6) AS convergent_score, lidar_support, CASE WHEN reason = '' THEN 'Standard archaeological criteria met' ELSE reason END AS selection_reason,
    CASE WHEN confidence >= 0.8E0 THEN 'high' ELSE 'moderate' END AS confidence_level FROM r""",
)
def _(v):
    s = sp.with_pair_support(v.detections, sp.scored_pairs(v.detections))
    p = "$.properties."
    f = flat(
        ex.combined_features(s, "run"), ("confidence", p + "confidence", "d"), ("convergent_score", p + "convergent_score", "d"), ("lidar_support", p + "lidar_support", "b"),
        ("selection_reason", p + "selection_reason", "s"), ("confidence_level", p + "quality_indicators.confidence_level", "s"),
    )
    return f.withColumn("convergent_score", F.round("convergent_score", 6))


@query(
    "b04_top_candidate_export",
    f"{PRIO} SELECT det_id, lon AS x, CAST(rk AS INT) AS priority_rank, CASE WHEN rk <= 3 THEN 'high' ELSE 'medium' END AS field_priority, confidence FROM pk WHERE rk <= 5",
)
def _(v):
    p = "$.properties."
    return flat(
        ex.top_candidate_features(top_candidates(v), "run"), ("priority_rank", p + "priority_rank", "i"),
        ("field_priority", p + "field_investigation_priority", "s"), ("confidence", p + "confidence", "d"),
    )


@query(
    "b05_export_decision",
    """d AS (SELECT det_id, provider, coalesce(confidence, 0) AS c FROM detections)
    SELECT det_id, CASE WHEN provider = 'gedi' THEN c >= 0.4E0 ELSE c >= 0.5E0 END AS exported, CASE WHEN provider = 'sentinel2' AND c >= 0.5E0 THEN 'Meets Sentinel-2 50% confidence threshold' WHEN provider = 'gedi' AND c >= 0.4E0 THEN 'Meets GEDI 40% confidence threshold'
    ELSE printf('Below confidence threshold (%.1f%% < 50%% for Sentinel-2 or 40%% for GEDI)', c * 100) END AS export_reason, CASE WHEN CASE WHEN provider = 'gedi' THEN c >= 0.4E0 ELSE c >= 0.5E0 END THEN 'exported' ELSE 'filtered' END AS marker_style FROM d""",
)
def _(v):
    return ex.export_decision(v.detections).select("det_id", "exported", "export_reason", "marker_style")


@query(
    "b06_pair_export",
    f"{PAIRS} SELECT s.lon AS x1, g.lat AS y2, round(e1.d, 5) AS distance_m, s.det_type AS type1, g.det_type AS type2 FROM e1 JOIN detections s ON s.det_id = id1 JOIN detections g ON g.det_id = id2",
)
def _(v):
    f = ex.pair_lines(sp.provider_pairs(v.detections))
    # every text is parsed once
    line = "geometry struct<coordinates: array<array<double>>>, properties struct<distance_m: double, feature1_type: string, feature2_type: string>"
    j = ex.to_geojson_lines(f).select(F.from_json("value", line).alias("j"))
    return j.select(
        F.col("j.geometry.coordinates")[0][0].alias("x1"), F.col("j.geometry.coordinates")[1][1].alias("y2"), F.round("j.properties.distance_m", 5).alias("distance_m"),
        F.col("j.properties.feature1_type").alias("type1"), F.col("j.properties.feature2_type").alias("type2"),
    )


@query(
    "b07_export_manifest",
    "f AS (SELECT DISTINCT provider, provider || '_zone_' || CAST(zone_id AS VARCHAR) || '.geojson' AS file FROM detections) SELECT provider, count(*) AS n_files, string_agg(file, ',' ORDER BY file) AS files FROM f GROUP BY provider",
)
def _(v):
    files = v.detections.select("provider", F.concat_ws("", "provider", F.lit("_zone_"), F.col("zone_id").cast("string"), F.lit(".geojson")).alias("file")).distinct()
    return ex.manifest(files)


@query(
    "b08_flag_table",
    f"""{AREAS}, m AS ({MOVED} detections), {FLAGS} SELECT m.det_type AS "Detection_Type", CASE WHEN confidence IS NULL THEN 'N/A' ELSE printf('%.3f', confidence) END AS "Confidence", flag_reason AS "Flag_Reason", severity AS "Severity" FROM fl JOIN m ON m.det_id = fl.det_id""",
)
def _(v):
    t = ex.flag_table(qa.detection_flags(v.sql(MOVED + "{detections}")))
    c = F.when(F.col("Confidence") == "N/A", F.lit("N/A")).otherwise(F.format_string("%.3f", F.col("Confidence").cast("double")))
    return t.withColumn("Confidence", c).select("Detection_Type", "Confidence", "Flag_Reason", "Severity")


@query(
    "b09_staged_outputs",
    "SELECT provider, count(*) AS n, CAST(sum(det_id) AS BIGINT) AS id_sum FROM detections GROUP BY provider",
)
def _(v):
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    ex.write_stage(v.detections.select("det_id", "provider", "confidence"), path, "run-1")
    ex.write_stage(v.detections.where("confidence > 0.9").select("det_id", "provider", "confidence"), path, "run-2")
    return ex.read_stage(v.spark, path, "run-1").groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum("det_id").alias("id_sum"))


LEDGER = "SELECT scene_id, scene_id % 4 > 0 AS has_summary, CAST(scene_id % 3 AS INT) AS expected_features, scene_id % 5 = 0 AS has_outputs FROM {s} WHERE scene_id % 2 = 0"


@query(
    "b10_unprocessed_scenes",
    f"l AS ({LEDGER.format(s='scenes')}) SELECT scene_id FROM scenes WHERE scene_id NOT IN (SELECT scene_id FROM l WHERE has_summary AND (expected_features = 0 OR has_outputs))",
)
def _(v):
    return ex.unprocessed(v.scenes, v.sql(LEDGER.format(s="{scenes}"))).select("scene_id")


@query("b10_incremental_ingest", "SELECT p_partkey % 25 AS zone_id, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def _(v):
    """The scene catalogue's source file processed through a stream, twice; the second run finds nothing new."""
    ensure_checkpoint_dir(v.spark)
    base = f"{v.spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    schema = v.table("part").schema

    def step(batch):
        return batch.groupBy((F.col("p_partkey") % 25).alias("zone_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total"))

    for _ in range(2):
        process_new_scenes(v.spark, v.sf_dir, schema, step, f"{base}/out", f"{base}/state", "part.parquet")
    out = v.spark.read.parquet(f"{base}/out")
    return out.groupBy("zone_id").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean_price"))


@query(
    "b11_located_features",
    """f AS (SELECT det_id, CAST((det_id * 7) % 50 AS INT) AS pix_row, CAST((det_id * 11) % 50 AS INT) AS pix_col, 480000E0 + det_id % 6 * 600 AS ox FROM detections) SELECT det_id, round((ox + pix_col * 10 - 500000) / 1000, 9) AS east_km, round((-1345000 - pix_row * 10) / 1000.0E0, 9) AS north_km FROM f""",
)
def _(v):
    from terraloom.functions import geo

    i = F.col("det_id")
    f = v.detections.select("det_id", ((i * 7) % 50).cast("int").alias("pix_row"), ((i * 11) % 50).cast("int").alias("pix_col"))
    out = ex.located_features(f, 480000.0 + i % 6 * 600, F.lit(-1345000.0), F.lit(22))
    # projecting the written locations back must return the grid positions
    u = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(22))
    return out.select("det_id", F.round(F.round((u["easting"] - 500000) / 1000, 5), 9).alias("east_km"), F.round(F.round(u["northing"] / 1000, 5), 9).alias("north_km"))


# --- hooks
@reg.provider("catalogue")
def _catalogue(spark, path):
    from terraloom.catalog.views import Views

    return Views(spark, path).scenes


@reg.provider("granules")
def _granules(spark, path):
    from terraloom.catalog.views import Views

    s = Views(spark, path).shots
    return s.groupBy(F.floor(F.col("shot_number") / 100).alias("scene_id")).agg(
        F.min("zone_id").alias("zone_id"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


@query(
    "l01_provider_registry",
    f"SELECT 'catalogue' AS provider, scene_id, round(west, 9) AS west, round(north, 9) AS north FROM scenes UNION ALL SELECT 'granules', granule_id, round(west, 9), round(north, 9) FROM ({GRAN.format(s='shots')}) g",
)
def _(v):
    return reg.load_all(v.spark, {"catalogue": v.sf_dir, "granules": v.sf_dir}).select("provider", "scene_id", r9("west"), r9("north"))


@query(
    "l02_zone_batches",
    "SELECT zone_id, count(*) AS n, round(avg(rh100), 6) AS mean_rh100 FROM shots GROUP BY zone_id",
)
def _(v):
    import pandas as pd

    def sums(pdf):
        return pd.DataFrame({"zone_id": [int(pdf["zone_id"].iloc[0])], "n": [len(pdf)], "total": [float(pdf["rh100"].sum())]})

    rows = v.shots.select("zone_id", "shot_number", "rh100")
    merge = lambda states: states.groupby("zone_id", as_index=False).sum()
    finish = lambda state: state.assign(mean_rh100=state["total"] / state["n"])
    out = reg.zone_reduce(rows, sums, merge, finish, "zone_id long, n long, total double", "zone_id long, n long, mean_rh100 double", "shot_number", 150, 4)
    return out.withColumn("mean_rh100", F.round("mean_rh100", 6))


@query("l02_zone_groups", "SELECT zone_id, round(quantile_cont(rh100, 0.5), 6) AS median_rh100 FROM shots GROUP BY zone_id")
def _(v):
    def median(pdf):
        return pdf.groupby("zone_id", as_index=False).agg(median_rh100=("rh100", "median"))

    return reg.zone_groups(v.shots.select("zone_id", "rh100"), median, "zone_id long, median_rh100 double").withColumn("median_rh100", F.round("median_rh100", 6))


@query("l02_zone_median_by_parts", "SELECT zone_id, round(quantile_cont(rh100, 0.5), 6) AS median_rh100 FROM shots GROUP BY zone_id")
def _(v):
    """A median from counts of values: the state of a batch is a row per value, which adds up."""
    import numpy as np
    import pandas as pd

    def counts(pdf):
        return pdf.groupby(["zone_id", "rh100"], as_index=False).agg(n=("rh100", "size"))

    def merge(states):
        return states.groupby(["zone_id", "rh100"], as_index=False).sum()

    def middle(state):
        s = state.sort_values("rh100")
        upto, total = s["n"].cumsum().to_numpy(), int(s["n"].sum())
        at = [s["rh100"].to_numpy()[np.searchsorted(upto, k, "right")] for k in ((total - 1) // 2, total // 2)]
        return pd.DataFrame({"zone_id": [s["zone_id"].iloc[0]], "median_rh100": [sum(at) / 2]})

    out = reg.zone_reduce(v.shots.select("zone_id", "shot_number", "rh100"), counts, merge, middle, "zone_id long, rh100 double, n long", "zone_id long, median_rh100 double", "shot_number", 60, 3)
    return out.withColumn("median_rh100", F.round("median_rh100", 6))


@query(
    "l03_method_dispatch",
    """a AS (SELECT scene_id, pow(red * 10, 8) AS v FROM pixels), s AS (SELECT scene_id, avg(v) AS m, stddev_pop(v) AS d, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM a GROUP BY scene_id)
    SELECT a.scene_id, count(*) FILTER (v > m + 2.5E0 * d OR v < m - 2.5E0 * d) AS statistical, count(*) FILTER (v > p95 OR v < p5) AS percentile, count(*) FILTER (v > q3 + 1.5E0 * (q3 - q1) OR v < q1 - 1.5E0 * (q3 - q1)) AS iqr FROM a JOIN s ON s.scene_id = a.scene_id GROUP BY a.scene_id""",
)
def _(v):
    from terraloom.operators import radiometry as ra

    px = v.pixels.select(*PX, F.pow(F.col("red") * 10, F.lit(8)).alias("v"))
    out = None
    for m in ("statistical", "percentile", "iqr"):
        c = ra.anomalies(px, "v", m).groupBy("scene_id").agg(F.count_if("anomaly").alias(m))
        out = c if out is None else out.join(c, "scene_id")
    return out
