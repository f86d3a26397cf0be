"""Aggregates over circles and nearest partners by a pyramid of pre-summed cells.

Cells are squares whose side is a power of four degrees, so a cell splits into sixteen. A cell row holds the number of locations, their outline and their sums. A search starts at the level whose cells
are at least as wide as the reach and goes down level by level: a cell that lies inside is taken as a whole, one that lies outside is left, and of the cells in between, those of at most ``OPEN`` locations
are opened and the others go on as their children. A circle has few cells on its border at any level, so the rows grow with the circles and not with the pairs of points,
however many points lie in one place. Copies of a location are summed first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import EARTH_RADIUS_M
from terraloom.functions import geo
from terraloom.runtime import cut_lineage, salted_join

#: Locations of a cell that are looked at one by one.
OPEN = 64
#: Probes whose searches one task makes.
PROBES = 4_000
#: The finest level, cells of 4**-24 degrees; what is left there is opened.
FINEST, COARSEST = -24, 5
_SLACK = 1e-9
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _side(level) -> Column:
    return F.pow(F.lit(4.0), F.lit(level) if isinstance(level, int) else level)


def _index(c: str, level) -> Column:
    return F.floor(F.col(c) / _side(level))


def _level(reach: Column) -> Column:
    """The first level whose cells are no narrower than the reach."""
    level = F.ceil(F.log(F.greatest(reach, F.lit(4.0**FINEST))) / math.log(4.0))
    return F.greatest(F.lit(FINEST), F.least(level, F.lit(COARSEST))).cast("int")


def _locations(base: DataFrame, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Distinct locations with the merged values of their points."""
    located = base.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    if not aggs:
        return cut_lineage(located.select("lon", "lat").distinct())
    return cut_lineage(located.groupBy("lon", "lat").agg(*[_MERGE[kind](value).alias(name) for name, (kind, value) in aggs.items()]))


def _cells(locs: DataFrame, level: int, aggs) -> DataFrame:
    return locs.groupBy(_index("lon", level).alias("_cx"), _index("lat", level).alias("_cy")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.min("lat").alias("_s"), F.max("lat").alias("_t"),
        *[_MERGE[kind](name).alias(name) for name, (kind, _) in aggs.items()],
    )


def _covered(probe: DataFrame, level: int) -> DataFrame:
    """Probes of this level at the cells their reach touches."""
    span = lambda c, r: F.explode(F.sequence(F.floor((F.col(c) - F.col(r)) / _side(level)), F.floor((F.col(c) + F.col(r)) / _side(level))))
    return probe.where(F.col("_lv") == level).withColumn("_cx", span("_x", "_rx")).withColumn("_cy", span("_y", "_ry"))


def _met(spots: DataFrame, state: DataFrame | None, cells: DataFrame, level: int, span: tuple[int, int], keep: list[str], spread: str) -> DataFrame:
    """Searches of this level with the cells they reach: those that start here, and those going on from a coarser cell to the children it has."""
    met = []
    if level >= span[1]:
        met.append(salted_join(_covered(spots, level).select(*keep), cells, ["_cx", "_cy"], spread))
    if state is not None:
        at = cells.withColumn("_ux", F.floor(F.col("_cx") / 4)).withColumn("_uy", F.floor(F.col("_cy") / 4))
        down = state.withColumnsRenamed({"_cx": "_ux", "_cy": "_uy"})
        met.append(salted_join(down, at, ["_ux", "_uy"], spread).drop("_ux", "_uy"))
    return _union(met)


def _dealt(probe: DataFrame) -> DataFrame:
    """Probes in partitions of about ``PROBES`` rows: a search has many rows per probe, and a small input file would give them all to one task."""
    return probe.repartition(1 + probe.count() // PROBES)


def _levels(probe: DataFrame) -> tuple[int, int] | None:
    top, bottom = probe.agg(F.max("_lv"), F.min("_lv")).first()
    return None if top is None else (top, bottom)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def circle_aggregates(base: DataFrame, probe: DataFrame, key: str, radius: Column, aggs: dict[str, tuple[str, Column]], open_cells: int = OPEN) -> DataFrame:
    """(key, <names>) of the ``base`` points within ``radius`` degrees (planar, closed) of each ``probe`` row; probes that reach none are missing.

    ``aggs`` maps a name to how values merge (sum, min or max) and the value of a base row.
    """
    locs = _locations(base, aggs)
    spots = probe.select(key, F.col("lon").alias("_x"), F.col("lat").alias("_y"), radius.alias("_r")).where("_x IS NOT NULL AND _y IS NOT NULL AND _r >= 0")
    spots = cut_lineage(_dealt(spots.withColumn("_rx", F.col("_r")).withColumn("_ry", F.col("_r")).withColumn("_lv", _level(F.col("_r")))))
    span = _levels(spots)
    names = list(aggs)
    merged = [_MERGE[kind](name).alias(name) for name, (kind, _) in aggs.items()]
    if span is None:
        empty = [F.lit(None).cast(locs.schema[n].dataType).alias(n) for n in names]
        return probe.select(key, *empty).limit(0)
    gap = lambda lo, hi, at: F.greatest(F.col(lo) - F.col(at), F.col(at) - F.col(hi), F.lit(0.0))
    far = lambda lo, hi, at: F.greatest(F.abs(F.col(lo) - F.col(at)), F.abs(F.col(hi) - F.col(at)))
    parts, state, keep = [], None, [key, "_x", "_y", "_r", "_cx", "_cy"]
    for level in range(span[0], FINEST - 1, -1):
        if level < span[1] and state is None:
            break
        met = _met(spots, state, _cells(locs, level, aggs), level, span, keep, key)
        gx, gy = gap("_w", "_e", "_x"), gap("_s", "_t", "_y")
        fx, fy = far("_w", "_e", "_x"), far("_s", "_t", "_y")
        near, reach = F.sqrt(gx * gx + gy * gy), F.sqrt(fx * fx + fy * fy)
        inside = reach <= F.col("_r") * (1 - _SLACK)
        met = cut_lineage(met.where(near <= F.col("_r") * (1 + _SLACK)).withColumn("_inside", inside))
        parts.append(met.where("_inside").select(key, *names))
        border = met.where("NOT _inside")
        small = F.lit(True) if level == FINEST else F.col("_n") <= open_cells
        at = locs.withColumn("_cx", _index("lon", level)).withColumn("_cy", _index("lat", level))
        opened = salted_join(border.where(small).select(*keep), at, ["_cx", "_cy"], key)
        parts.append(opened.where(geo.planar_deg(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")) <= F.col("_r")).groupBy(key).agg(*merged))
        left = border.where(~small).select(*keep)
        state = None if left.isEmpty() else left
    return _union(parts).groupBy(key).agg(*merged)


def _flat() -> Column:
    """Whether a cell and a probe lie so close together, and so far from the poles, that the plane is exact to a thousandth."""
    wide = F.greatest(F.abs(F.col("_w") - F.col("_x")), F.abs(F.col("_e") - F.col("_x")), F.abs(F.col("_s") - F.col("_y")), F.abs(F.col("_t") - F.col("_y")))
    return (wide <= 0.05) & (F.abs("_y") <= 80)


def _in_plane(dx: Column, dy: Column) -> Column:
    dx = F.radians(dx) * F.cos(F.radians("_y"))
    dy = F.radians(dy)
    return F.sqrt(dx * dx + dy * dy)


def _sphere_gap() -> Column:
    """A distance in metres that no location of the cell is nearer than."""
    lat, turn = F.radians("_y"), F.greatest(F.col("_w") - F.col("_x"), F.col("_x") - F.col("_e"), F.lit(0.0))
    rise = F.greatest(F.col("_s") - F.col("_y"), F.col("_y") - F.col("_t"), F.lit(0.0))
    # beyond a quarter turn, and for cells that may be nearer round the other side, only the latitudes count
    aside = F.when(F.greatest(F.abs(F.col("_w") - F.col("_x")), F.abs(F.col("_e") - F.col("_x"))) <= 90, F.asin(F.cos(lat) * F.sin(F.radians(turn)))).otherwise(0.0)
    far = F.greatest(aside, F.radians(rise)) * (1 - 1e-6)
    return F.when(_flat(), _in_plane(turn, rise) * (1 - 1e-2)).otherwise(far) * EARTH_RADIUS_M


def _sphere_reach() -> Column:
    """A distance in metres that no location of the cell is farther than: along the meridian, then along the parallel nearer the equator."""
    up = F.greatest(F.abs(F.col("_s") - F.col("_y")), F.abs(F.col("_t") - F.col("_y")))
    aside = F.greatest(F.abs(F.col("_w") - F.col("_x")), F.abs(F.col("_e") - F.col("_x")))
    return F.when(_flat(), _in_plane(aside, up) * (1 + 1e-2)).otherwise(F.radians(up + aside) * (1 + 1e-6)) * EARTH_RADIUS_M


def nearest_within(base: DataFrame, probe: DataFrame, metres: float, open_cells: int = OPEN) -> DataFrame:
    """(lon, lat, metres): great-circle distance from each distinct ``probe`` location to the nearest ``base`` location, where it is at most ``metres``.

    A cell is left as soon as another one is certainly nearer. Locations within reach of the antimeridian are searched from both sides of it.
    """
    locs = _locations(base, {})
    spots = probe.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).select("lon", "lat").distinct()
    ry = F.lit(math.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-6))
    top = F.abs("lat") + ry
    rx = F.when(top >= 89.9, 180.0).otherwise(F.least(ry / F.cos(F.radians(F.least(top, F.lit(89.9)))), F.lit(180.0)))
    spots = spots.withColumn("_rx", rx).withColumn("_ry", ry).withColumn("_lv", _level(F.greatest("_rx", "_ry")))
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon") - F.col("_rx") < -180, 360.0), F.when(F.col("lon") + F.col("_rx") > 180, -360.0)))
    spots = spots.withColumn("_id", F.struct("lon", "lat")).withColumn("_turn", F.explode(turns))
    spots = cut_lineage(_dealt(spots.withColumns({"_x": F.col("lon") + F.col("_turn"), "_y": F.col("lat")}).drop("lon", "lat", "_turn")))
    span = _levels(spots)
    if span is None:
        return probe.select("lon", "lat", F.lit(None).cast("double").alias("metres")).limit(0)
    found, state, keep = [], None, ["_id", "_x", "_y", "_cx", "_cy"]
    limit = F.lit(float(metres))
    for level in range(span[0], FINEST - 1, -1):
        if level < span[1] and state is None:
            break
        met = _met(spots, state, _cells(locs, level, {}), level, span, keep, "_id").withColumn("_near", _sphere_gap()).withColumn("_far", _sphere_reach())
        met = met.where(F.col("_near") <= limit).select(*keep, "_n", "_near", "_far")
        sure = met.groupBy("_id").agg(F.min("_far").alias("_best"))
        met = cut_lineage(met.join(sure, "_id").where(F.col("_near") <= F.col("_best")).select(*keep, "_n"))
        small = F.lit(True) if level == FINEST else F.col("_n") <= open_cells
        at = locs.withColumn("_cx", _index("lon", level)).withColumn("_cy", _index("lat", level))
        opened = salted_join(met.where(small).select(*keep), at, ["_cx", "_cy"], "_id")
        d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("_id.lon"), F.col("_id.lat"))
        found.append(opened.groupBy("_id").agg(F.min(d).alias("metres")))
        left = met.where(~small).select(*keep)
        state = None if left.isEmpty() else left
    best = _union(found).groupBy("_id").agg(F.min("metres").alias("metres")).where(F.col("metres") <= limit)
    return best.select("_id.lon", "_id.lat", "metres")
