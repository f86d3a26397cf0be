"""Queries over coordinates: D1-D10, D24, D25, D27-D29, J1-J8."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.registry import query
from terraloom.functions import geo
from terraloom.operators import coordinates as co

# Detections with some coordinates broken in known ways.
MESSY = """SELECT det_id, zone_id, CASE WHEN det_id % 13 = 0 THEN NULL WHEN det_id % 17 = 0 THEN lon * 10000
  WHEN det_id % 19 = 0 THEN lon + 100 WHEN det_id % 29 = 0 THEN lon - 3 ELSE lon END AS lon,
  CASE WHEN det_id % 23 = 0 THEN lat - 60 WHEN det_id % 31 = 0 THEN lat + 20 ELSE lat END AS lat FROM """
# Detections moved next to the reference areas.
MOVED = "SELECT det_id, zone_id, provider, det_type, lon - 19.355E0 AS lon, lat + 11.785E0 AS lat, confidence, area_m2, angle_degrees FROM "
GEO = "(lon IS NOT NULL AND lat IS NOT NULL AND abs(lon) <= 180 AND abs(lat) <= 90)"
AMZ = "(lon BETWEEN -80 AND -44 AND lat BETWEEN -20 AND 10)"
HAV = """(6371000E0 * 2 * atan2(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)),
  sqrt(1 - (pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"""


def hav(lon1, lat1, lon2, lat2):
    return HAV.format(lon1=lon1, lat1=lat1, lon2=lon2, lat2=lat2)


def messy(v):
    return v.sql(MESSY + "{detections}")


@query(
    "d01_coordinate_validity",
    f"m AS ({MESSY} detections) SELECT det_id, coalesce({GEO} AND {AMZ}, false) AS valid FROM m",
)
def _(v):
    return co.with_validity(messy(v)).select("det_id", "valid")


@query(
    "d01_coordinate_validity_strict",
    f"""m AS ({MESSY} detections) SELECT det_id, coalesce({GEO} AND lon BETWEEN west AND east AND lat BETWEEN south AND north, false) AS valid
    FROM m JOIN zones USING (zone_id)""",
)
def _(v):
    return co.with_validity(messy(v), v.zones).select("det_id", "valid")


@query(
    "d02_batch_validity",
    f"""m AS ({MESSY} detections), z AS (SELECT * FROM zones WHERE zone_type <> 'other')
    SELECT m.zone_id, count(*) AS n_rows, count(*) FILTER (coalesce({GEO} AND CASE WHEN west IS NULL THEN {AMZ}
      ELSE lon BETWEEN west AND east AND lat BETWEEN south AND north END, false)) AS n_valid
    FROM m LEFT JOIN z ON z.zone_id = m.zone_id GROUP BY m.zone_id""",
)
def _(v):
    known = v.zones.where("zone_type <> 'other'")
    return co.with_validity(messy(v), known).groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("valid").alias("n_valid")
    )


FIXED = f"""SELECT det_id, coalesce({GEO} AND {AMZ}, false) AS ok, lon, lat, (west + east) / 2 AS clon, (south + north) / 2 AS clat
  FROM m LEFT JOIN z ON z.zone_id = m.zone_id"""


@query(
    "d03_fallback_coordinates",
    f"""m AS ({MESSY} detections), z AS (SELECT * FROM zones WHERE zone_type <> 'other'), f AS ({FIXED})
    SELECT det_id, round(CASE WHEN ok THEN lon ELSE coalesce(clon, -60) END, 9) AS lon,
      round(CASE WHEN ok THEN lat ELSE coalesce(clat, -3) END, 9) AS lat, NOT ok AS coordinate_fixed FROM f""",
)
def _(v):
    fixed = co.with_fallback(messy(v), v.zones.where("zone_type <> 'other'"))
    return fixed.select("det_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "coordinate_fixed")


@query(
    "d04_coordinate_system",
    f"""m AS (SELECT det_id % 40 AS batch, lon, lat FROM ({MESSY} detections) a)
    SELECT batch, CASE WHEN greatest(max(abs(lon)), max(abs(lat))) > 1000 THEN 'utm'
      WHEN max(abs(lon)) <= 180 AND max(abs(lat)) <= 90 THEN 'geographic' ELSE 'unknown' END AS coordinate_system
    FROM m GROUP BY batch""",
)
def _(v):
    return co.coordinate_system(messy(v).withColumn("batch", F.col("det_id") % 40), ["batch"])


@query(
    "d05_standardised_export",
    f"""m AS (SELECT det_id, zone_id, CASE det_id % 5 WHEN 0 THEN lon WHEN 1 THEN lon + 0.001E0 WHEN 2 THEN lon + 0.002E0
        WHEN 3 THEN lon + 0.003E0 END AS lon, CASE WHEN det_id % 5 < 4 THEN lat END AS lat,
        det_id % 5 < 4 AS has FROM ({MESSY} detections) a),
      z AS (SELECT * FROM zones), f AS (SELECT det_id, coalesce({GEO} AND {AMZ}, false) AS ok, lon, lat,
        (west + east) / 2 AS clon, (south + north) / 2 AS clat FROM m LEFT JOIN z ON z.zone_id = m.zone_id WHERE has)
    SELECT det_id, round(CASE WHEN ok THEN lon ELSE clon END, 9) AS lon, round(CASE WHEN ok THEN lat ELSE clat END, 9) AS lat,
      NOT ok AS coordinate_fixed FROM f""",
)
def _(v):
    def at(k, name):
        return F.when(F.col("det_id") % 5 == k, geo.point(F.col("lon") + k * 0.001, F.col("lat"))).alias(name)

    names = ["coordinates", "center", "location", "position"]
    located = messy(v).select("det_id", "zone_id", *[at(k, n) for k, n in enumerate(names)])
    out = co.standardised(located, v.zones, names)
    return out.select("det_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "coordinate_fixed")


@query(
    "d06_axis_order_repair",
    """s AS (SELECT det_id, CASE WHEN det_id % 4 = 0 THEN lat ELSE lon END AS a, CASE WHEN det_id % 4 = 0 THEN lon ELSE lat END AS b FROM detections)
    SELECT det_id, CASE WHEN abs(a) < 20 AND abs(b) > 44 THEN b ELSE a END AS lon, CASE WHEN abs(a) < 20 AND abs(b) > 44 THEN a ELSE b END AS lat,
      CASE WHEN abs(a) > abs(b) THEN b ELSE a END AS alt_lon, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS alt_lat FROM s""",
)
def _(v):
    turn = F.col("det_id") % 4 == 0
    s = v.detections.select(
        "det_id", F.when(turn, F.col("lat")).otherwise(F.col("lon")).alias("a"),
        F.when(turn, F.col("lon")).otherwise(F.col("lat")).alias("b"),
    )
    one, two = geo.axis_repaired(F.col("a"), F.col("b")), geo.axis_repaired(F.col("a"), F.col("b"), "magnitude")
    return s.select(
        "det_id", one["lon"].alias("lon"), one["lat"].alias("lat"), two["lon"].alias("alt_lon"), two["lat"].alias("alt_lat")
    )


REGION = """CASE WHEN lon IS NULL OR lat IS NULL THEN 'Missing coordinates' WHEN lat NOT BETWEEN -90 AND 90 THEN 'Invalid latitude'
  WHEN lon NOT BETWEEN -180 AND 180 THEN 'Invalid longitude' WHEN lat NOT BETWEEN -18 AND 5 THEN 'Latitude outside Amazon region'
  WHEN lon NOT BETWEEN -84 AND -44 THEN 'Longitude outside Amazon region' ELSE 'Valid coordinates' END"""


@query("d07_map_region_check", f"m AS ({MESSY} detections) SELECT det_id, {REGION} = 'Valid coordinates' AS valid, {REGION} AS reason FROM m")
def _(v):
    check = geo.map_region_check(F.col("lon"), F.col("lat"))
    return messy(v).select("det_id", check["valid"].alias("valid"), check["reason"].alias("reason"))


@query("d08_clean_coordinates", f"m AS ({MESSY} detections) SELECT det_id, lon, lat FROM m WHERE {REGION} = 'Valid coordinates'")
def _(v):
    return messy(v).where(geo.map_region_check(F.col("lon"), F.col("lat"))["valid"]).select("det_id", "lon", "lat")


@query(
    "d09_zone_bbox_filter",
    """SELECT shot_number, z.zone_id AS in_zone FROM shots s JOIN zones z ON s.lon BETWEEN z.west AND z.east
    AND s.lat BETWEEN z.south AND z.north""",
)
def _(v):
    return co.in_zones(v.shots, v.zones).select("shot_number", F.col("z_zone_id").alias("in_zone"))


@query(
    "d10_adaptive_zone_expansion",
    """z AS (SELECT zone_id, west, south, west + 0.004E0 AS east, south + 0.005E0 AS north FROM zones),
    b AS (SELECT *, greatest(north - south, east - west) / 2 AS half, (north + south) / 2 AS clat, (east + west) / 2 AS clon FROM z),
    e AS (SELECT * FROM (VALUES (0, 0.025E0), (1, 0.05E0), (2, 0.075E0), (3, 0.1E0), (4, 0.15E0), (5, 0.2E0)) t(i, e)),
    o AS (SELECT b.zone_id, count(s.shot_number) AS n FROM b LEFT JOIN shots s ON s.lon BETWEEN b.west AND b.east AND s.lat BETWEEN b.south AND b.north GROUP BY b.zone_id),
    x AS (SELECT b.zone_id, e.i, e.e, count(s.shot_number) AS n FROM b CROSS JOIN e LEFT JOIN shots s
      ON s.lon BETWEEN b.clon - (b.half + e.e) AND b.clon + (b.half + e.e) AND s.lat BETWEEN b.clat - (b.half + e.e) AND b.clat + (b.half + e.e)
      GROUP BY b.zone_id, e.i, e.e),
    f AS (SELECT zone_id, min(i) AS i FROM x WHERE n >= 50 GROUP BY zone_id)
    SELECT o.zone_id, o.n AS original_count, CASE WHEN o.n < 50 THEN x.e END AS expansion_deg,
      CASE WHEN o.n >= 50 OR x.n IS NULL THEN o.n ELSE x.n END AS shot_count, o.n < 50 AND x.e IS NOT NULL AS expanded
    FROM o LEFT JOIN f ON f.zone_id = o.zone_id LEFT JOIN x ON x.zone_id = f.zone_id AND x.i = f.i""",
)
def _(v):
    small = v.zones.withColumn("east", F.col("west") + 0.004).withColumn("north", F.col("south") + 0.005)
    return co.adaptive_zones(v.shots, small)


@query(
    "d24_viewport_cull",
    """SELECT det_id, lon, lat FROM detections WHERE lat BETWEEN -12.0E0 - 0.4E0 * (1.2E0 - 1) / 2 AND -11.6E0 + 0.4E0 * (1.2E0 - 1) / 2
    AND lon BETWEEN -53.0E0 - 0.5E0 * (1.2E0 - 1) / 2 AND -52.5E0 + 0.5E0 * (1.2E0 - 1) / 2""",
)
def _(v):
    return v.detections.where(geo.in_viewport(F.col("lon"), F.col("lat"), -53.0, -12.0, -52.5, -11.6)).select("det_id", "lon", "lat")


@query("d25_confidence_filter", "SELECT det_id, confidence FROM detections WHERE coalesce(confidence, 0) >= 0.4E0")
def _(v):
    return v.detections.where(F.coalesce("confidence", F.lit(0.0)) >= 0.4).select("det_id", "confidence")


@query(
    "d28_feature_integrity",
    """g AS (SELECT det_id, lon, lat, CASE WHEN det_id % 7 = 0 THEN lon + 0.002E0 WHEN det_id % 11 = 0 THEN NULL ELSE lon END AS glon, lat AS glat FROM detections)
    SELECT det_id, glon IS NOT NULL AS has_geometry, coalesce(abs(lon) <= 180 AND abs(lat) <= 90, false) AS coordinates_ok,
      coalesce(abs(lon - glon) > 0.001E0 OR abs(lat - glat) > 0.001E0, false) AS mismatch FROM g""",
)
def _(v):
    g = v.detections.withColumn(
        "glon",
        F.when(F.col("det_id") % 7 == 0, F.col("lon") + 0.002).when(F.col("det_id") % 11 == 0, None).otherwise(F.col("lon")),
    ).withColumn("glat", F.col("lat"))
    far = (F.abs(F.col("lon") - F.col("glon")) > 0.001) | (F.abs(F.col("lat") - F.col("glat")) > 0.001)
    return g.select(
        "det_id", F.col("glon").isNotNull().alias("has_geometry"),
        geo.is_geographic(F.col("lon"), F.col("lat")).alias("coordinates_ok"), F.coalesce(far, F.lit(False)).alias("mismatch"),
    )


@query("d29_area_sanity", "SELECT det_id, area_m2 BETWEEN 1000 AND 1000000 AS area_ok FROM detections")
def _(v):
    return v.detections.select("det_id", F.col("area_m2").between(1000.0, 1000000.0).alias("area_ok"))


CENTRE = "SELECT det_id, lon, lat, area_m2, length_m, det_type, (west + east) / 2 AS clon, (south + north) / 2 AS clat FROM detections JOIN zones USING (zone_id)"


def with_centres(v):
    c = co.zone_centres(v.zones).select("zone_id", F.col("centre_lon").alias("clon"), F.col("centre_lat").alias("clat"))
    return v.detections.join(c, "zone_id")


@query("j01_haversine", f"c AS ({CENTRE}) SELECT det_id, round({hav('lon', 'lat', 'clon', 'clat')}, 5) AS distance_m FROM c")
def _(v):
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
    return with_centres(v).select("det_id", F.round(d, 5).alias("distance_m"))


@query(
    "j02_planar_distance",
    f"""c AS ({CENTRE}) SELECT det_id, round(sqrt((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat)) * 111000, 6) AS planar_m,
    round(length_m / (111320 * cos(radians(lat))), 12) AS length_deg FROM c""",
)
def _(v):
    return with_centres(v).select(
        "det_id", F.round(geo.planar_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")), 6).alias("planar_m"),
        F.round(geo.metres_to_degrees(F.col("length_m"), F.col("lat")), 12).alias("length_deg"),
    )


RING = """SELECT det_id, i, lon + sqrt(area_m2 / pi()) / 111000 * cos((i % 32) * (2 * pi() / 32)) AS x,
  lat + sqrt(area_m2 / pi()) / 111000 * sin((i % 32) * (2 * pi() / 32)) AS y FROM detections, range(0, 33) t(i)"""


@query("j03_circle_polygon", f"r AS ({RING}) SELECT det_id, CAST(i AS INT) AS vertex, round(x, 9) AS lon, round(y, 9) AS lat FROM r")
def _(v):
    ring = geo.circle_ring(F.col("lon"), F.col("lat"), F.sqrt(F.col("area_m2") / F.pi()))
    return v.detections.select("det_id", F.posexplode(ring).alias("vertex", "p")).select(
        "det_id", "vertex", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat")
    )


@query(
    "j04_wkt_polygon",
    """SELECT det_id, 'POLYGON((' || list_aggregate(list_transform(range(0, 37), lambda i: printf('%.6f %.6f',
      lon + 50 / 111000.0E0 / cos(radians(lat)) * sin(radians((i * 10) % 360)), lat + 50 / 111000.0E0 * cos(radians((i * 10) % 360)))), 'string_agg', ', ') || '))' AS wkt FROM detections""",
)
def _(v):
    ring = geo.footprint_ring(F.col("lon"), F.col("lat"), F.lit(50.0))
    return v.detections.select("det_id", geo.wkt_polygon(ring).alias("wkt"))


_N = geo._N
UTM = f"""SELECT det_id, lon, lat, z, 500000 + {geo._K0A!r}E0 * (eta {' '.join(f'+ {a!r} * cos({2*j} * xi) * sinh({2*j} * eta)' for j, a in enumerate(geo._ALPHA, 1))}) AS easting,
  {geo._K0A!r}E0 * (xi {' '.join(f'+ {a!r} * sin({2*j} * xi) * cosh({2*j} * eta)' for j, a in enumerate(geo._ALPHA, 1))}) AS northing
  FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta
    FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {geo._ECC!r}E0 * atanh({geo._ECC!r}E0 * sin(radians(lat)))) AS t, radians(lon - (z * 6 - 183)) AS dl
      FROM (SELECT det_id, lon, lat, CAST(least(greatest(floor((lon + 180) / 6) + 1, 18), 21) AS INT) AS z FROM detections) a) b) c"""


@query("j06_lonlat_to_utm", f"u AS ({UTM}) SELECT det_id, z AS utm_zone, round(easting, 4) AS easting, round(northing, 4) AS northing FROM u")
def _(v):
    z = geo.utm_zone(F.col("lon"))
    u = v.detections.select("det_id", z.alias("utm_zone"), geo.to_utm(F.col("lon"), F.col("lat"), z).alias("u"))
    return u.select("det_id", "utm_zone", F.round("u.easting", 4).alias("easting"), F.round("u.northing", 4).alias("northing"))


@query(
    "j05_pixel_to_lonlat",
    """p AS (SELECT scene_id, pix_row, pix_col, 480000E0 + scene_id * 600 + pix_col * 10 AS e, -1345000E0 - pix_row * 10 AS n FROM pixels),
    a AS (SELECT *, n / K0A AS xi, (e - 500000) / K0A AS eta FROM p),
    b AS (SELECT *, xi - (B1 * sin(2 * xi) * cosh(2 * eta) + B2 * sin(4 * xi) * cosh(4 * eta) + B3 * sin(6 * xi) * cosh(6 * eta)) AS x,
      eta - (B1 * cos(2 * xi) * sinh(2 * eta) + B2 * cos(4 * xi) * sinh(4 * eta) + B3 * cos(6 * xi) * sinh(6 * eta)) AS h FROM a),
    c AS (SELECT *, asin(sin(x) / cosh(h)) AS chi FROM b)
    SELECT scene_id, pix_row, pix_col, round(degrees(atan2(sinh(h), cos(x))) + (22 * 6 - 183), 9) AS lon,
      round(degrees(chi + D1 * sin(2 * chi) + D2 * sin(4 * chi) + D3 * sin(6 * chi)), 9) AS lat FROM c"""
    .replace("K0A", repr(geo._K0A) + "E0")
    .replace("B1", repr(geo._BETA[0])).replace("B2", repr(geo._BETA[1])).replace("B3", repr(geo._BETA[2]))
    .replace("D1 *", repr(geo._DELTA[0]) + " *").replace("D2 *", repr(geo._DELTA[1]) + " *").replace("D3 *", repr(geo._DELTA[2]) + " *"),
)
def _(v):
    grid = geo.pixel_to_projected(F.col("pix_row"), F.col("pix_col"), 480000.0 + F.col("scene_id") * 600, F.lit(-1345000.0))
    p = v.pixels.select("scene_id", "pix_row", "pix_col", grid.alias("g"))
    p = p.withColumn("p", geo.from_utm(F.col("g.easting"), F.col("g.northing"), F.lit(22)))
    return p.select("scene_id", "pix_row", "pix_col", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query(
    "j07_centres_and_centroids",
    """SELECT det_id, round((lon + lon + 0.003E0 + lon + 0.009E0) / 3, 9) AS line_lon, round((lat + lat + 0.004E0 + lat + 0.002E0) / 3, 9) AS line_lat,
    CAST(4 AS INT) AS closed_vertices, round(lon + (0 + 0.006E0 + 0.002E0) / 3, 9) AS centroid_lon, round(lat + (0 + 0.001E0 + 0.008E0) / 3, 9) AS centroid_lat,
    round(abs(0.006E0 * 0.008E0 - 0.002E0 * 0.001E0) / 2, 12) AS area_deg2 FROM detections""",
)
def _(v):
    lon, lat = F.col("lon"), F.col("lat")
    line = F.array(geo.point(lon, lat), geo.point(lon + 0.003, lat + 0.004), geo.point(lon + 0.009, lat + 0.002))
    ring = geo.closed_ring(F.array(geo.point(lon, lat), geo.point(lon + 0.006, lat + 0.001), geo.point(lon + 0.002, lat + 0.008)))
    s = v.detections.select("det_id", geo.vertex_mean(line).alias("l"), ring.alias("ring"))
    s = s.withColumn("c", geo.ring_centroid(F.col("ring")))
    return s.select(
        "det_id", F.round("l.lon", 9).alias("line_lon"), F.round("l.lat", 9).alias("line_lat"),
        F.size("ring").alias("closed_vertices"), F.round("c.lon", 9).alias("centroid_lon"),
        F.round("c.lat", 9).alias("centroid_lat"), F.round(geo.ring_area_deg2(F.col("ring")), 12).alias("area_deg2"),
    )


@query(
    "j08_geometry_choice",
    """SELECT det_id, CASE WHEN det_type = 'rectangle' THEN 'Polygon' WHEN det_type = 'line' THEN 'LineString' WHEN det_type = 'circle' AND area_m2 > 0 THEN 'Polygon' ELSE 'Point' END AS kind,
    CAST(CASE WHEN det_type = 'rectangle' THEN 5 WHEN det_type = 'line' THEN 2 WHEN det_type = 'circle' AND area_m2 > 0 THEN 33 ELSE 1 END AS INT) AS vertices FROM detections""",
)
def _(v):
    lon, lat, t = F.col("lon"), F.col("lat"), F.col("det_type")
    ring = F.when(t == "rectangle", geo.box_ring(lon, lat, F.lit(0.001), F.lit(0.001)))
    line = F.when(t == "line", F.array(geo.point(lon, lat), geo.point(lon + 0.01, lat)))
    g = geo.geometry_choice(ring, line, t, F.sqrt(F.col("area_m2") / F.pi()), lon, lat)
    return v.detections.select("det_id", g.alias("g")).select("det_id", F.col("g.kind").alias("kind"), F.size("g.points").alias("vertices"))


@query(
    "d27_control_area_exclusion",
    f"""m AS ({MOVED} detections) SELECT det_id FROM m WHERE NOT (
      {hav('lon', 'lat', '-72.515E0', '-0.485E0')} / 1000 <= 0.1E0 OR {hav('lon', 'lat', '-72.505E0', '-0.495E0')} / 1000 <= 0.1E0)""",
)
def _(v):
    from terraloom.operators import reference_areas as ra

    areas = ra.areas(v.spark).where(F.col("name").startswith("Infrastructure Exclusion"))
    return ra.outside(v.sql(MOVED + "{detections}"), areas, "det_id").select("det_id")
