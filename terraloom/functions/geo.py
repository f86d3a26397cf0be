"""Geometry as column expressions. Coordinates are always separate lon and lat columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.constants import AMAZON_BOUNDS, DEG_M, EARTH_RADIUS_M, MAP_REGION


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2) / 1000


def planar_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx, dy = lon1 - lon2, lat1 - lat2
    return F.sqrt(dx * dx + dy * dy)


def planar_m(lon1, lat1, lon2, lat2) -> Column:
    return planar_deg(lon1, lat1, lon2, lat2) * DEG_M


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    return metres / (111320 * F.cos(F.radians(lat)))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def circle_ring(lon: Column, lat: Column, radius_m: Column, vertices: int = 32, correct_lat: bool = False) -> Column:
    """Closed ring approximating a circle; ``correct_lat`` widens longitudes away from the equator."""
    r = radius_m / DEG_M
    rx = r / F.cos(F.radians(lat)) if correct_lat else r

    def vertex(i):
        angle = (i % vertices) * (2 * math.pi / vertices)
        return point(lon + rx * F.cos(angle), lat + r * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), vertex)


def footprint_ring(lon: Column, lat: Column, radius_m: Column, step_deg: int = 10) -> Column:
    """Closed ring that starts due north and runs clockwise, with longitudes widened for latitude."""
    r = radius_m / DEG_M

    def vertex(i):
        angle = F.radians((i * step_deg) % 360)
        return point(lon + r / F.cos(F.radians(lat)) * F.sin(angle), lat + r * F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(360 // step_deg)), vertex)


def box_ring(lon: Column, lat: Column, half_width: Column, half_height: Column) -> Column:
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(*[point(lon + sx * half_width, lat + sy * half_height) for sx, sy in corners])


def closed_ring(points: Column) -> Column:
    """Repeat the first vertex at the end unless it is there already."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(first == last, points).otherwise(F.concat(points, F.array(first)))


def vertex_mean(points: Column) -> Column:
    """Plain mean of the vertices, as a point."""
    n = F.size(points)
    total = F.aggregate(
        points,
        point(F.lit(0.0), F.lit(0.0)),
        lambda acc, p: point(acc["lon"] + p["lon"], acc["lat"] + p["lat"]),
    )
    return point(total["lon"] / n, total["lat"] / n)


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs relative to the first vertex, which keeps the cross products small."""
    o = F.element_at(ring, 1)
    local = F.transform(ring, lambda p: point(p["lon"] - o["lon"], p["lat"] - o["lat"]))
    return F.zip_with(
        F.slice(local, F.lit(1), F.size(ring) - 1),
        F.slice(local, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(
            (a["lon"] * b["lat"] - b["lon"] * a["lat"]).alias("cross"),
            (a["lon"] + b["lon"]).alias("sx"),
            (a["lat"] + b["lat"]).alias("sy"),
        ),
    )


def ring_area_deg2(ring: Column) -> Column:
    """Shoelace area of a closed ring in square degrees."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + e["cross"])) / 2


def ring_area_m2(ring: Column) -> Column:
    """Area with the degree scaled locally at the ring's mean latitude."""
    return ring_area_deg2(ring) * DEG_M * DEG_M * F.cos(F.radians(vertex_mean(ring)["lat"]))


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring; the mean of the vertices if the ring has no area."""
    e = _edges(ring)
    cross = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["cross"])
    cx = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["sx"] * x["cross"])
    cy = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["sy"] * x["cross"])
    mx = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["sx"])
    my = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["sy"])
    o = F.get(ring, F.lit(0))
    lon = F.coalesce(F.try_divide(cx, 3 * cross), F.try_divide(mx, 2 * F.size(e)))
    lat = F.coalesce(F.try_divide(cy, 3 * cross), F.try_divide(my, 2 * F.size(e)))
    return point(o["lon"] + lon, o["lat"] + lat)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(items: Column, terms: dict) -> Column:
    """struct of the sums of several terms over an array, in one pass."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in terms])
    return F.aggregate(items, zero, lambda acc, x: F.struct(*[(acc[n] + f(x)).alias(n) for n, f in terms.items()]))


def polygons_measure(polygons: Column) -> Column:
    """struct(lon, lat, area_m2) of an array of polygons, each an array of rings with the outer one first and holes after it.

    Holes count negatively in the area and in the centroid, which is the mean of the ring centroids by area. Without any area it is the mean of the outer rings' centroids.
    """
    edge_terms = {
        "cross": lambda x: x["cross"], "cx": lambda x: x["sx"] * x["cross"], "cy": lambda x: x["sy"] * x["cross"],
        "mx": lambda x: x["sx"], "my": lambda x: x["sy"], "n": lambda x: F.lit(1.0),
    }

    def measured(closed, outer):
        def from_sums(t):
            at = lambda c, m: F.coalesce(F.try_divide(t[c], 3 * t["cross"]), F.try_divide(t[m], 2 * t["n"]))
            o = F.get(closed, F.lit(0))
            area = F.when(outer, 1.0).otherwise(-1.0) * F.abs(t["cross"]) / 2
            scale = DEG_M * DEG_M * F.cos(F.radians(vertex_mean(closed)["lat"]))
            return F.struct(outer.cast("double").alias("outer"), area.alias("area"), (area * scale).alias("m2"), (o["lon"] + at("cx", "mx")).alias("lon"), (o["lat"] + at("cy", "my")).alias("lat"))

        return _let(_sums(_edges(closed), edge_terms), from_sums)

    ring = lambda r, i: _let(closed_ring(r), lambda closed: measured(closed, i == 0))
    rings = F.flatten(F.transform(polygons, lambda p: F.transform(F.filter(p, lambda r: F.size(r) >= 1), ring)))
    terms = {
        "area": lambda x: x["area"], "m2": lambda x: x["m2"], "outer": lambda x: x["outer"],
        **{f"a_{c}": (lambda x, c=c: x["area"] * x[c]) for c in ("lon", "lat")}, **{f"o_{c}": (lambda x, c=c: x["outer"] * x[c]) for c in ("lon", "lat")},
    }

    def finished(t):
        mean = lambda c: F.coalesce(F.try_divide(t[f"a_{c}"], t["area"]), F.try_divide(t[f"o_{c}"], t["outer"])).alias(c)
        return F.struct(mean("lon"), mean("lat"), t["m2"].alias("area_m2"))

    return _let(_sums(rings, terms), finished)


def wkt_polygon(ring: Column, digits: int = 6) -> Column:
    text = F.transform(ring, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["lon"], p["lat"]))
    return F.concat(F.lit("POLYGON(("), F.array_join(text, ", "), F.lit("))"))


def geometry_choice(
    ring: Column, line: Column, det_type: Column, radius_m: Column, lon: Column, lat: Column
) -> Column:
    """Polygon if a ring exists, else line, else circle polygon, else point; struct(kind, points)."""
    is_circle = det_type.isin("geometric_circle", "circular_anomaly", "circle") & (radius_m > 0)

    def geom(kind, points):
        return F.struct(F.lit(kind).alias("kind"), points.alias("points"))

    return (
        F.when(F.coalesce(F.size(ring), F.lit(0)) >= 3, geom("Polygon", ring))
        .when(F.coalesce(F.size(line), F.lit(0)) >= 2, geom("LineString", line))
        .when(is_circle, geom("Polygon", circle_ring(lon, lat, radius_m)))
        .otherwise(geom("Point", F.array(point(lon, lat))))
    )


# --- transverse Mercator (Krueger series, third order) on the WGS84 ellipsoid
_A, _FL = 6378137.0, 1 / 298.257223563
_N = _FL / (2 - _FL)
_K0A = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def utm_zone(lon: Column, clamp: bool = True) -> Column:
    z = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.least(F.greatest(z, F.lit(18)), F.lit(21)) if clamp else z


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """struct(easting, northing) in the northern-hemisphere grid (negative northing below the equator)."""
    phi = F.radians(lat)
    dlam = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + _K0A * east).alias("easting"), (_K0A * north).alias("northing"))


def from_utm(easting: Column, northing: Column, zone: Column) -> Column:
    """Inverse of :func:`to_utm`, struct(lon, lat)."""
    xi, eta = northing / _K0A, (easting - 500000) / _K0A
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(e), F.cos(x))) + (zone * 6 - 183)
    return point(lon, F.degrees(lat))


def pixel_to_projected(row: Column, col: Column, origin_x, origin_y, size: float = 10.0) -> Column:
    """Affine transform of a north-up grid, struct(easting, northing)."""
    return F.struct((origin_x + col * size).alias("easting"), (origin_y - row * size).alias("northing"))


# --- coordinate predicates
def in_box(lon: Column, lat: Column, west, south, east, north) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def is_geographic(lon: Column, lat: Column) -> Column:
    """Present, not NaN, and in degree range."""
    ok = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.coalesce(ok, F.lit(False))


def in_amazon(lon: Column, lat: Column) -> Column:
    b = AMAZON_BOUNDS
    return in_box(lon, lat, b["west"], b["south"], b["east"], b["north"])


def valid_coordinates(lon: Column, lat: Column) -> Column:
    return F.coalesce(is_geographic(lon, lat) & in_amazon(lon, lat), F.lit(False))


def swap_needed(first: Column, second: Column, rule: str = "range") -> Column:
    """Does a (first, second) pair look like (lat, lon)?"""
    if rule == "range":
        return (F.abs(first) < 20) & (F.abs(second) > 44)
    return F.abs(first) > F.abs(second)


def axis_repaired(first: Column, second: Column, rule: str = "range") -> Column:
    swap = F.coalesce(swap_needed(first, second, rule), F.lit(False))
    return F.when(swap, point(second, first)).otherwise(point(first, second))


def map_region_check(lon: Column, lat: Column) -> Column:
    """struct(valid, reason) against the map region."""
    b = MAP_REGION

    def verdict(ok, reason):
        return F.struct(F.lit(ok).alias("valid"), F.lit(reason).alias("reason"))

    return (
        F.when(lon.isNull() | lat.isNull(), verdict(False, "Missing coordinates"))
        .when(~lat.between(-90.0, 90.0), verdict(False, "Invalid latitude"))
        .when(~lon.between(-180.0, 180.0), verdict(False, "Invalid longitude"))
        .when(~lat.between(b["south"], b["north"]), verdict(False, "Latitude outside Amazon region"))
        .when(~lon.between(b["west"], b["east"]), verdict(False, "Longitude outside Amazon region"))
        .otherwise(verdict(True, "Valid coordinates"))
    )


def in_viewport(lon: Column, lat: Column, west, south, east, north, buffer: float = 1.2) -> Column:
    by, bx = (north - south) * (buffer - 1) / 2, (east - west) * (buffer - 1) / 2
    return in_box(lon, lat, west - bx, south - by, east + bx, north + by)
