"""Density clustering, threshold graphs and ordered leader selection over points.

Points are bucketed into square cells whose diagonal is just below the radius, so all points of one
cell are neighbours of each other. That removes every within-cell pair from the work: a well-filled
cell is dense without looking at pairs, and at most one point per cell can lead.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.operators.graph import connected_components
from terraloom.runtime import cut_lineage, salted_join

_SUB = 8  # sub-boxes per cell side when two cells cannot be decided from their outlines


def _side(radius: float) -> float:
    return radius / (math.sqrt(2) * (1 + 1e-9))


def _near(d: Column, radius: float, closed: bool) -> Column:
    return d <= radius if closed else d < radius


def _locations(points: DataFrame, key: str, radius: float, by: list[str]) -> DataFrame:
    """Distinct locations with weight, smallest member key and cell."""
    side = _side(radius)
    return (
        points.groupBy(*by, "lon", "lat")
        .agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("low"))
        .withColumn("cx", F.floor(F.col("lon") / side))
        .withColumn("cy", F.floor(F.col("lat") / side))
    )


def _around(df: DataFrame, cells: int = 2) -> DataFrame:
    """Copy rows to their cell and the cells around it."""
    off = F.sequence(F.lit(-cells), F.lit(cells))
    return (
        df.withColumn("_dx", F.explode(off)).withColumn("_dy", F.explode(off))
        .withColumn("cx", F.col("cx") + F.col("_dx")).withColumn("cy", F.col("cy") + F.col("_dy")).drop("_dx", "_dy")
    )


def _core_locations(points: DataFrame, key: str, radius: float, min_points: int, closed: bool, by: list[str]) -> DataFrame:
    """Locations with ``is_core``: at least ``min_points`` points (itself included) within the radius.

    Cells with enough weight are core as a whole. Only points of thin cells are compared, and a cell
    has fewer than ``min_points`` of those, so comparisons grow linearly with the data.
    """
    locs = _locations(points, key, radius, by)
    if min_points <= 1:
        return locs.withColumn("is_core", F.lit(True))
    locs = cut_lineage(locs)  # a compact table that every step below reads
    cell = [*by, "cx", "cy"]
    weight = locs.groupBy(*cell).agg(F.sum("w").alias("cw"))
    dense = weight.where(F.col("cw") >= min_points).select(*cell)
    thin = weight.where(F.col("cw") < min_points).select(*cell)
    thin_locs = locs.join(thin, cell)
    probe = _around(thin_locs.select(*cell, F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col("low").alias("plow")))
    base = locs.select(*cell, "lon", "lat", "w", "low")
    pairs = salted_join(base, probe, cell, "low")
    d = geo.planar_deg(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    counts = pairs.where(_near(d, radius, closed)).groupBy("plow").agg(F.sum("w").alias("n"))
    checked = thin_locs.join(counts.withColumnRenamed("plow", "low"), "low", "left").select(
        *locs.columns, (F.coalesce("n", F.lit(0)) >= min_points).alias("is_core")
    )
    return locs.join(dense, cell).withColumn("is_core", F.lit(True)).select(*checked.columns).unionByName(checked)


def _back_to_points(points: DataFrame, labelled: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Attach location columns to every point; locations with very many copies are sliced. Points without coordinates are noise."""
    p = points.withColumn("_spread", F.col(key))
    out = salted_join(p, labelled, [*by, "lon", "lat"], "_spread", how="left").drop("_spread")
    defaults = {"is_core": F.coalesce("is_core", F.lit(False)), "cluster_id": F.coalesce("cluster_id", F.lit(-1)) if "cluster_id" in out.columns else None}
    return out.withColumns({c: d for c, d in defaults.items() if c in out.columns})


def with_core_flag(
    points: DataFrame, key: str, radius: float, min_points: int, closed: bool = True, by: list[str] = ()
) -> DataFrame:
    by = list(by)
    locs = _core_locations(points, key, radius, min_points, closed, by).select(*by, "lon", "lat", "is_core")
    return _back_to_points(points, locs, key, by)


def _outline(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tight bounding box of the locations per key."""
    return df.groupBy(*keys).agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )


def _box_gap(a: str, b: str) -> Column:
    """Smallest possible distance between points of two boxes."""
    gx = F.greatest(F.col(f"{a}.w") - F.col(f"{b}.e"), F.col(f"{b}.w") - F.col(f"{a}.e"), F.lit(0.0))
    gy = F.greatest(F.col(f"{a}.s") - F.col(f"{b}.n"), F.col(f"{b}.s") - F.col(f"{a}.n"), F.lit(0.0))
    return F.sqrt(gx * gx + gy * gy)


def _box_reach(a: str, b: str) -> Column:
    """Largest possible distance between points of two boxes."""
    gx = F.greatest(F.col(f"{a}.e") - F.col(f"{b}.w"), F.col(f"{b}.e") - F.col(f"{a}.w"))
    gy = F.greatest(F.col(f"{a}.n") - F.col(f"{b}.s"), F.col(f"{b}.n") - F.col(f"{a}.s"))
    return F.sqrt(gx * gx + gy * gy)


def _cell_edges(core: DataFrame, radius: float, closed: bool, by: list[str]) -> DataFrame:
    """Pairs of cells (by smallest core key) that hold core points within the radius of each other.

    Decided in three steps, each only for what the one before left open: outlines of cells, outlines of
    sub-boxes, and the points of sub-boxes whose outlines straddle the radius.
    """
    cell = [*by, "cx", "cy"]
    slack = radius * 1e-9  # outlines decide only clear cases; the rest goes to exact distances
    ids = core.groupBy(*cell).agg(
        F.min("low").alias("id"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )
    box = lambda *extra: F.struct(*extra, "w", "e", "s", "n")
    a = ids.select(*cell, box("id", "cx", "cy").alias("a"))
    b = _around(ids.select(*cell, box("id", "cx", "cy").alias("b")))
    ordered = (F.col("a.cx") < F.col("b.cx")) | ((F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") < F.col("b.cy")))
    cells = a.join(b, cell).where(ordered & (_box_gap("a", "b") <= radius + slack)).select(
        F.col("a.id").alias("src"), F.col("b.id").alias("dst"), (_box_reach("a", "b") <= radius - slack).alias("sure")
    )
    cells = cut_lineage(cells)
    sure, undecided = cells.where("sure").select("src", "dst"), cells.where("NOT sure").select("src", "dst")
    if undecided.isEmpty():
        return sure

    side = _side(radius) / _SUB
    owned = core.join(ids.select(*cell, "id"), cell).select("id", "lon", "lat").withColumn(
        "sub", F.struct(F.floor(F.col("lon") / side).alias("x"), F.floor(F.col("lat") / side).alias("y"))
    )
    subs = _outline(owned, ["id", "sub"])
    sa = undecided.join(subs.select(F.col("id").alias("src"), box("sub").alias("a")), "src")
    sb = sa.join(subs.select(F.col("id").alias("dst"), box("sub").alias("b")), "dst")
    sub_pairs = sb.where(_box_gap("a", "b") <= radius + slack).select(
        "src", "dst", F.col("a.sub").alias("sa"), F.col("b.sub").alias("sb"), (_box_reach("a", "b") <= radius - slack).alias("sure")
    )
    sub_pairs = cut_lineage(sub_pairs)
    sub_sure = sub_pairs.where("sure").select("src", "dst").distinct()
    if sub_pairs.where("NOT sure").isEmpty():
        return sure.unionByName(sub_sure)
    open_pairs = sub_pairs.where("NOT sure").join(sub_sure, ["src", "dst"], "left_anti")
    pa = open_pairs.join(
        owned.select(F.col("id").alias("src"), F.col("sub").alias("sa"), F.col("lon").alias("ax"), F.col("lat").alias("ay")), ["src", "sa"]
    )
    pb = owned.select(F.col("id").alias("dst"), F.col("sub").alias("sb"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    d = geo.planar_deg(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    exact = pa.join(pb, ["dst", "sb"]).where(_near(d, radius, closed)).select("src", "dst").distinct()
    return sure.unionByName(sub_sure).unionByName(exact)


def dbscan(
    points: DataFrame, key: str, radius: float, min_points: int, closed: bool = True, by: list[str] = ()
) -> DataFrame:
    """Density clusters of points (planar degrees): adds cluster_id (-1 for noise) and is_core.

    A cluster is named after its smallest core key; a border point belongs to the smallest cluster
    that reaches it. ``by`` keeps groups (scenes, zones) apart.
    """
    by = list(by)
    cell = [*by, "cx", "cy"]
    locs = cut_lineage(_core_locations(points, key, radius, min_points, closed, by))
    core = locs.where("is_core")
    comp = connected_components(_cell_edges(core, radius, closed, by))
    cell_ids = core.groupBy(*cell).agg(F.min("low").alias("id"))
    named = cell_ids.join(comp, F.col("id") == F.col("node"), "left").select(
        *cell, F.coalesce("component", "id").alias("cluster_id")
    )
    core = core.join(named, cell)
    if min_points <= 1:
        labelled = core.select(*by, "lon", "lat", "cluster_id", "is_core")
        return _back_to_points(points, labelled, key, by)
    loose = locs.where("NOT is_core")
    probe = _around(loose.select(*cell, F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col("low").alias("plow")))
    d = geo.planar_deg(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    reach = salted_join(core.select(*cell, "lon", "lat", "cluster_id", "low"), probe, cell, "low")
    reach = reach.where(_near(d, radius, closed)).groupBy(F.col("plow").alias("low")).agg(F.min("cluster_id").alias("cluster_id"))
    border = loose.join(reach, "low", "left").select(
        *by, "lon", "lat", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "is_core"
    )
    labelled = core.select(*by, "lon", "lat", "cluster_id", "is_core").unionByName(border)
    return _back_to_points(points, labelled, key, by)


def threshold_graph(points: DataFrame, key: str, radius: float, min_size: int, by: list[str] = ()) -> DataFrame:
    """Components of the graph joining points closer than the radius; small components become -1."""
    labelled = dbscan(points, key, radius, 1, closed=False, by=by).drop("is_core")
    small = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_size)
    return labelled.join(small, "cluster_id", "left").select(
        *points.columns, F.when(F.col("_n").isNotNull(), F.lit(-1)).otherwise(F.col("cluster_id")).alias("cluster_id")
    )


#: Points of a block that one task scans at a time.
BLOCK_POINTS = 20_000
#: Block sides that are tried, in cells; beyond the last, a block is as good as everything.
_BLOCK_SIDES = [8 * 2**k for k in range(24)]


def _block_side(live: DataFrame, by: list[str], limit: int) -> tuple[int, bool]:
    """(the widest block side whose fullest block holds at most ``limit`` points, whether one does); one job."""
    small = _BLOCK_SIDES[0]
    fine = live.groupBy(*by, F.floor(F.col("cx") / small).alias("_bx"), F.floor(F.col("cy") / small).alias("_by")).agg(F.count(F.lit(1)).alias("n"))
    level = fine.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(len(_BLOCK_SIDES) - 1))))
    up = F.pow(F.lit(2.0), F.col("_l"))
    sums = level.groupBy(*by, "_l", F.floor(F.col("_bx") / up).alias("_bx"), F.floor(F.col("_by") / up).alias("_by")).agg(F.sum("n").alias("n"))
    fits = [r[0] for r in sums.groupBy("_l").agg(F.max("n").alias("n")).where(F.col("n") <= limit).select("_l").collect()]
    return (_BLOCK_SIDES[max(fits)], True) if fits else (small, False)


def _scan_blocks(radius: float, side: int, columns: list[str]):
    """Task function: decides the points of each block in key order; yields the rows of the new leaders.

    Rows come sorted by block and key. A point is decided once every smaller near point is: near a leader it retires, near an undecided point it waits, else it leads. Points of
    neighbouring blocks, and the points a block holds back, are undecided here.
    """
    reach = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]

    def scan(batches):
        block, lead, waiting, barred = None, {}, {}, []
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            found = []
            rows = zip(col("_block"), col("lon"), col("lat"), col("cx"), col("cy"), col("_ox"), col("_oy"), col("_dx"), col("_dy"), col("_held"))
            for i, (name, x, y, cx, cy, ox, oy, dx, dy, held) in enumerate(rows):
                if name != block:
                    block, lead, waiting, barred = name, {}, {}, []
                if held:  # from this key on the neighbour in this direction has points that nobody sees
                    barred.append((dx, dy))
                    continue
                own = dx == 0 and dy == 0
                if own and (cx, cy) in lead:
                    continue
                around = [(cx + a, cy + b) for a, b in reach]
                if any(math.sqrt((p[0] - x) * (p[0] - x) + (p[1] - y) * (p[1] - y)) < radius for p in map(lead.get, around) if p is not None):
                    continue
                wait = not own or (cx, cy) in waiting
                wait = wait or any((a == 0 or (ox < 2 if a < 0 else ox >= side - 2)) and (b == 0 or (oy < 2 if b < 0 else oy >= side - 2)) for a, b in barred)
                wait = wait or any(math.sqrt((p[0] - x) * (p[0] - x) + (p[1] - y) * (p[1] - y)) < radius for c in around for p in waiting.get(c, ()))
                if wait:
                    waiting.setdefault((cx, cy), []).append((x, y))
                else:
                    lead[(cx, cy)] = (x, y)
                    found.append(i)
            if found:
                yield batch.select(columns).take(pa.array(found))

    return scan


def _block_leaders(live: DataFrame, by: list[str], radius: float, limit: int) -> DataFrame:
    """The points that are known to lead after every block has been scanned once."""
    side, whole = _block_side(live, by, limit)
    at, inside = lambda c: F.floor(F.col(c) / side), lambda c: F.pmod(F.col(c), F.lit(side))
    placed = live.select(*live.columns, at("cx").alias("_bx"), at("cy").alias("_by"), inside("cx").alias("_ox"), inside("cy").alias("_oy"))
    held = F.lit(False)
    if not whole:
        # the smallest keys go first; the next one bars its neighbours from deciding anything beyond it
        rank = F.row_number().over(Window.partitionBy(*by, "_bx", "_by").orderBy("k"))
        placed = placed.withColumn("_rank", rank).where(F.col("_rank") <= limit + 1)
        held = F.col("_rank") == limit + 1
    placed = placed.withColumn("_held", held)

    def sides(off):
        return F.array_compact(F.array(F.lit(0), F.when((F.col(off) < 2) | F.col("_held"), -1), F.when((F.col(off) >= side - 2) | F.col("_held"), 1)))

    # a copy for the block in direction (ex, ey) comes, seen from there, from the direction (-ex, -ey)
    copies = placed.withColumn("_ex", F.explode(sides("_ox"))).withColumn("_ey", F.explode(sides("_oy")))
    copies = copies.select(
        *live.columns, "_ox", "_oy", "_held", (-F.col("_ex")).alias("_dx"), (-F.col("_ey")).alias("_dy"),
        F.to_json(F.struct(*by, (F.col("_bx") + F.col("_ex")).alias("_bx"), (F.col("_by") + F.col("_ey")).alias("_by"))).alias("_block"),
    )
    dealt = copies.repartition("_block").sortWithinPartitions("_block", "k")
    return dealt.mapInArrow(_scan_blocks(radius, side, live.columns), live.schema)


def leaders(
    points: DataFrame, key: str, radius: float, min_points: int = 1, by: list[str] = (), block_points: int = BLOCK_POINTS
) -> DataFrame:
    """Greedy leaders in key order, as (key, leader); leader is NULL for points no leader takes.

    Scanning in key order, an unused point with at least ``min_points`` points closer than the radius
    (itself included, used ones counted) leads and takes all its unused neighbours. The scan runs in
    blocks of cells with at most ``block_points`` points: a task decides every point of its block whose
    smaller neighbours it knows, so chains inside a block end in one round, and only what hangs on a
    block border waits for the next round. Blocks grow as points are decided, until one holds the rest.
    Where even the smallest block is too full, its smallest keys go first. Points near a new leader
    retire by a join; all points of a cell are neighbours, so a cell has one leader at most. Afterwards
    each point goes to its smallest near leader. Points without coordinates take no part.
    """
    by = list(by)
    cell = [*by, "cx", "cy"]
    side = _side(radius)
    located = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    flagged = located.select(*by, key, "lon", "lat")
    if min_points > 1:
        flagged = with_core_flag(flagged, key, radius, min_points, closed=False, by=by).where("is_core")
    cand = (
        flagged.select(*by, F.col(key).alias("k"), "lon", "lat")
        .withColumn("cx", F.floor(F.col("lon") / side)).withColumn("cy", F.floor(F.col("lat") / side))
    )
    # copies of one location cannot lead: only its smallest key stays a candidate
    cand = cand.groupBy(*cell, "lon", "lat").agg(F.min("k").alias("k"))
    live = cut_lineage(cand)
    d = geo.planar_deg(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat"))
    found = None
    while not live.isEmpty():
        lead = cut_lineage(_block_leaders(live, by, radius, block_points))
        lead = lead.select(*cell, F.col("k").alias("ok"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
        found = lead if found is None else found.unionByName(lead)
        retired = salted_join(live, _around(lead), cell, "k").where(d < radius).select("k").distinct()
        live = cut_lineage(live.join(retired, "k", "left_anti"))
    if found is None:
        return points.select(key, F.lit(None).cast(points.schema[key].dataType).alias("leader"))
    base = located.select(*by, F.col(key).alias("k"), "lon", "lat").withColumn("cx", F.floor(F.col("lon") / side)).withColumn(
        "cy", F.floor(F.col("lat") / side)
    )
    taken = salted_join(base, _around(found), cell, "k").where(d < radius).groupBy("k").agg(F.min("ok").alias("leader"))
    return points.select(key).join(taken.withColumnRenamed("k", key), key, "left")


def cluster_summary(clustered: DataFrame, keys: list[str] = (), max_km2: float | None = None) -> DataFrame:
    """Count, centroid and footprint area per cluster; over-large clusters are dropped."""
    from terraloom.constants import FOOTPRINT_RADIUS_M

    n = F.count(F.lit(1))
    out = clustered.where("cluster_id <> -1").groupBy(*keys, "cluster_id").agg(
        n.alias("n_points"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        (n * (math.pi * FOOTPRINT_RADIUS_M**2)).alias("area_m2"),
    )
    return out if max_km2 is None else out.where(F.col("area_m2") / 1e6 <= max_km2)


def representatives(detections: DataFrame, key: str, radius: float, min_points: int = 3) -> DataFrame:
    """Best detection, centroid, size and mean confidence per cluster; noise passes through unchanged."""
    c = dbscan(detections, key, radius, min_points)
    group = F.when(F.col("cluster_id") == -1, -F.col(key) - 2).otherwise(F.col("cluster_id"))
    conf = F.coalesce("confidence", F.lit(0.0))
    best = F.max(F.struct(conf.alias("c"), (-F.col(key)).alias("k")))
    g = c.groupBy(group.alias("_g")).agg(
        best.alias("_b"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        F.count(F.lit(1)).alias("clustered_count"), F.avg(conf).alias("cluster_confidence"),
    )
    return g.select(
        (-F.col("_b.k")).alias(key), F.col("_b.c").alias("confidence"), "lon", "lat", "clustered_count", "cluster_confidence",
        F.when(F.col("_g") >= 0, F.col("_g")).otherwise(F.lit(-1)).alias("cluster_id"),
    )
