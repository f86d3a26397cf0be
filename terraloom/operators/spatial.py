"""Distance, box and sampling joins. All of them are equi-joins on grid cells plus an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.functions.scores import pair_parts, pair_score
from terraloom.runtime import cut_lineage, salted_join

_DEG_LOW = 111000.0  # below the true metres per degree of latitude, so reaches are never too short


def _span(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def near_pairs(
    base: DataFrame,
    probe: DataFrame,
    radius: float | Column,
    base_id: str,
    metric: str = "haversine",
    closed: bool = True,
    cell: float | None = None,
) -> DataFrame:
    """All (a, b) with ``distance`` within ``radius``: metres for haversine, degrees for planar.

    Columns of the result are the structs ``a`` (a base row) and ``b`` (a probe row) and
    ``distance``. Probe rows are copied to the few cells their radius touches; base rows stay in one
    cell each, and cells holding a large share of the base are cut into slices. ``radius`` may be a
    column of the probe, in which case ``cell`` must be given. The haversine cells close at the antimeridian
    and at the poles: a probe whose reach passes 180 degrees looks into the cells on the other side as well,
    and one that reaches a pole into all cells around it. Planar distances are those of the plane.
    """
    fixed = isinstance(radius, (int, float))
    r = F.lit(float(radius)) if fixed else radius
    a = base.select(F.struct(*base.columns).alias("a"))
    b = probe.withColumn("_r", r).select(F.struct(*probe.columns, F.col("_r")).alias("b"))
    blon, blat = F.col("b.lon"), F.col("b.lat")
    if metric == "haversine":
        reach_y = F.col("b._r") / _DEG_LOW
        top = F.abs(blat) + reach_y
        reach_x = F.when(top >= 89.9, 180.0).otherwise(F.least(reach_y / F.cos(F.radians(F.least(top, F.lit(89.9)))), F.lit(180.0)))
        size = cell or radius / _DEG_LOW
        dist = geo.haversine_m(F.col("a.lon"), F.col("a.lat"), blon, blat)
    else:
        reach_y = reach_x = F.col("b._r")
        size = cell or radius
        dist = geo.planar_deg(F.col("a.lon"), F.col("a.lat"), blon, blat)
    a = a.withColumn("_cx", F.floor(F.col("a.lon") / size)).withColumn("_cy", F.floor(F.col("a.lat") / size))
    west, east = blon - reach_x, blon + reach_x
    if metric == "haversine":
        # the part of the reach beyond 180 degrees, seen from the other side
        none = F.array().cast("array<bigint>")
        cells = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
        edge = F.lit(180.0)
        wrapped = F.array_distinct(F.concat(
            cells(F.greatest(west, -edge), F.least(east, edge)),
            F.when(west < -180, cells(F.least(west + 360, edge), edge)).otherwise(none),
            F.when(east > 180, cells(-edge, F.greatest(east - 360, -edge))).otherwise(none),
        ))
        b = b.withColumn("_cx", F.explode(wrapped))
    else:
        b = b.withColumn("_cx", _span(west, east, size))
    b = b.withColumn("_cy", _span(blat - reach_y, blat + reach_y, size))
    a = a.withColumn("_spread", F.col(f"a.{base_id}"))
    joined = salted_join(a, b, ["_cx", "_cy"], "_spread", dealt=True).withColumn("distance", dist)
    limit = F.col("distance") <= F.col("b._r") if closed else F.col("distance") < F.col("b._r")
    return joined.where(limit).select("a", "b", "distance")


# --- cross-provider convergence
def provider_pairs(detections: DataFrame, radius_m: float = 1500.0, providers=("sentinel2", "gedi")) -> DataFrame:
    """Pairs of detections from two providers within ``radius_m``, with strength and mean confidence."""
    cols = ["det_id", "provider", "det_type", "lon", "lat", "confidence"]
    base = detections.where(F.col("provider") == providers[0]).select(*cols)
    probe = detections.where(F.col("provider") == providers[1]).select(*cols)
    mean = (F.coalesce("a.confidence", F.lit(0.0)) + F.coalesce("b.confidence", F.lit(0.0))) / 2
    return near_pairs(base, probe, radius_m, "det_id").select(
        "a", "b", F.col("distance").alias("distance_m"),
        (1 - F.col("distance") / radius_m).alias("strength"), mean.alias("combined_confidence"),
    )


def convergence_per_detection(detections: DataFrame, radius_m: float = 1500.0, providers=("sentinel2", "gedi")) -> DataFrame:
    """Strength of the closest detection of the other provider, and the sensor support flags.

    Only the closest counts, so no pair is listed: both sides are reduced to distinct locations, and a pyramid of cells finds the nearest of the other side.
    """
    from terraloom.operators.pyramid import nearest_within

    locs = cut_lineage(detections.where(F.col("provider").isin(*providers)).select("provider", "lon", "lat").distinct())
    side = lambda p: locs.where(F.col("provider") == p)
    known = None
    for own, other in (providers, providers[::-1]):
        near = nearest_within(side(other), side(own), radius_m).select(F.lit(own).alias("provider"), "lon", "lat", (1 - F.col("metres") / radius_m).alias("_s"))
        known = near if known is None else known.unionByName(near)
    hit = F.col("_s").isNotNull()
    return (
        salted_join(detections, known, ["provider", "lon", "lat"], "det_id", how="left")
        .withColumn("convergence_score", F.coalesce("_s", F.lit(0.0)))
        .withColumn("lidar_support", (F.col("provider") == "gedi") | hit)
        .withColumn("spectral_support", (F.col("provider") == "sentinel2") | hit)
        .drop("_s")
    )


PAIR_COLUMNS = ["det_id", "zone_id", "provider", "det_type", "lon", "lat", "confidence", "area_m2", "grade"]


def scored_pairs(detections: DataFrame, radius_deg: float = 0.005) -> DataFrame:
    """Planar cross-provider pairs with the 0..15 convergence score."""
    d = detections.select(*PAIR_COLUMNS, pair_parts().alias("_parts"))
    base, probe = d.where("provider = 'sentinel2'"), d.where("provider = 'gedi'")
    pairs = near_pairs(base, probe, radius_deg, "det_id", metric="planar")
    score = pair_score("a", "b", F.col("distance"), parts=("a._parts", "b._parts"))
    plain = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in (*PAIR_COLUMNS, *(["_r"] if c == "b" else []))])
    return pairs.select(plain("a").alias("a"), plain("b").alias("b"), "distance", score.alias("score"))


def pair_components(detections: DataFrame, radius_deg: float = 0.005, providers=("sentinel2", "gedi")) -> DataFrame:
    """(node, component) of every detection that has a partner of the other provider within the radius: the connected components of all such pairs, named after their smallest id.

    No pair is listed. In every round a location learns the least and the greatest label among the other provider's locations in its circle, from a pyramid of cells. Where a partner has
    another label, one of the two differs from its own, so each component that is not complete meets another one and their number at least halves. A round has four edges per location at most.
    """
    from terraloom.operators.graph import connected_components
    from terraloom.operators.pyramid import circle_aggregates

    names = [f"_l{i}" for i in range(2)]
    d = detections.where(F.col("provider").isin(*providers) & F.col("det_id").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    d = cut_lineage(d.select("det_id", "provider", "lon", "lat"))
    locs = cut_lineage(d.groupBy("lon", "lat").agg(*[F.min(F.when(F.col("provider") == p, F.col("det_id"))).alias(c) for p, c in zip(providers, names)]))
    aggs = {f"{c}_{kind}": (kind, F.col(c)) for c in names for kind in ("min", "max")}
    opposite = list(zip(names, names[::-1]))
    labels = None
    while True:
        met = circle_aggregates(locs, locs.withColumn("_at", F.struct("lon", "lat")), "_at", F.lit(radius_deg), aggs)
        met = locs.join(met.select("_at.lon", "_at.lat", *aggs), ["lon", "lat"])
        met = cut_lineage(met.where(" OR ".join(f"({a} IS NOT NULL AND {b}_min IS NOT NULL)" for a, b in opposite)))
        edge = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        edges = met.select(F.explode(F.array(*[edge(a, f"{b}_{kind}") for a, b in opposite for kind in ("min", "max")])).alias("e")).select("e.src", "e.dst").where("src <> dst")
        if labels is None:  # a location's detections have the same partners
            linked = F.coalesce(*[F.when((F.col("provider") == p) & F.col(f"{b}_min").isNotNull(), F.col(a)) for p, (a, b) in zip(providers, opposite)])
            labels = cut_lineage(d.join(met, ["lon", "lat"]).select(F.col("det_id").alias("node"), linked.alias("component")).where("component IS NOT NULL").distinct())
            edges = edges.unionByName(labels.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        elif edges.isEmpty():
            break
        found = cut_lineage(connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("_root")))
        relabelled = lambda df, c: df.join(found.withColumnRenamed("component", c), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
        labels = cut_lineage(relabelled(labels, "component").distinct())
        locs = met.select("lon", "lat", *names)
        for c in names:
            locs = relabelled(locs, c)
        locs = cut_lineage(locs)
    alone = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")  # an id that only meets itself has no pair
    return labels.join(alone, "component", "left_anti").select("node", "component")


#: Cell sides of the partner search halve twice from one level to the next.
PARTNER_LEVELS = 9


def _partners_at(detections: DataFrame, best: DataFrame, providers=("sentinel2", "gedi"), widest: float = 0.005) -> DataFrame:
    """Scored pairs (a, b, distance, score) in which an end of ``best`` (det_id, _d) is no farther than _d from the other end; _own is that row of ``best``.

    Each row looks into cells about as wide as its own distance, so it meets few partners besides those it looks for.
    """
    d = detections.select(*PAIR_COLUMNS)
    side = lambda level: widest / F.pow(F.lit(4.0), level)
    reach = F.col("_own._d") * (1 + 1e-9)
    fits = F.floor(F.log(widest / F.greatest(F.col("_own._d"), F.lit(1e-12))) / F.log(F.lit(4.0)))
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(f"q.{c}") - reach) / side("_lv")), F.floor((F.col(f"q.{c}") + reach) / side("_lv"))))
    found = []
    for own, other, name in ((*providers, "a"), (*providers[::-1], "b")):
        base = d.where(F.col("provider") == other).select(F.struct(*PAIR_COLUMNS).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(PARTNER_LEVELS - 1))).alias("_lv"))
        base = base.withColumn("_cx", F.floor(F.col("p.lon") / side("_lv"))).withColumn("_cy", F.floor(F.col("p.lat") / side("_lv"))).withColumn("_spread", F.col("p.det_id"))
        probe = d.where(F.col("provider") == own).join(best, "det_id").select(F.struct(*PAIR_COLUMNS).alias("q"), F.struct("det_id", "_score", "_d").alias("_own"))
        probe = probe.withColumn("_lv", F.greatest(F.lit(0), F.least(fits, F.lit(PARTNER_LEVELS - 1))).cast("int")).withColumn("_cx", cells("lon")).withColumn("_cy", cells("lat"))
        met = salted_join(base, probe, ["_lv", "_cx", "_cy"], "_spread", dealt=True)
        a, b = ("q", "p") if name == "a" else ("p", "q")
        found.append(met.select(F.col(a).alias("a"), F.col(b).alias("b"), "_own"))
    met = found[0].unionByName(found[1]).withColumn("distance", geo.planar_deg(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")))
    met = met.where(F.col("distance") <= F.col("_own._d"))
    return met.withColumn("score", pair_score("a", "b", F.col("distance")))


def with_pair_support(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Write the best score, its distance and the mean confidence of that pair back to both ends.

    Largest score first, then the shortest distance, then the larger mean confidence. ``pairs`` are scored pairs of ``detections``. They are read once and merged
    before they are shuffled: there are few scores, so a task keeps one shortest distance per end and score. The confidence is then looked up among the partners at just that distance.
    """
    ends = pairs.select(F.explode(F.array("a.det_id", "b.det_id")).alias("det_id"), "score", "distance")
    near = ends.groupBy("det_id", "score").agg(F.min("distance").alias("distance"))
    best = near.groupBy("det_id").agg(F.max(F.struct(F.col("score"), (-F.col("distance")).alias("neg"))).alias("_k"))
    best = cut_lineage(best.select("det_id", F.col("_k.score").alias("_score"), (-F.col("_k.neg")).alias("_d")))
    mean = (F.coalesce("a.confidence", F.lit(0.0)) + F.coalesce("b.confidence", F.lit(0.0))) / 2
    same = (F.col("score") == F.col("_own._score")) & (F.col("distance") == F.col("_own._d"))
    found = _partners_at(detections, best).where(same).groupBy(F.col("_own.det_id").alias("det_id")).agg(F.max(mean).alias("mean"))
    best = best.join(found, "det_id").select("det_id", F.struct(F.col("_score").alias("score"), (-F.col("_d")).alias("neg"), "mean").alias("_k"))
    hit = F.col("_k").isNotNull()
    return (
        detections.join(best, "det_id", "left")
        .withColumn("convergent_score", F.coalesce("_k.score", F.lit(0.0)))
        .withColumn("convergence_distance_m", -F.col("_k.neg") * 111000)
        .withColumn("combined_confidence", F.col("_k.mean"))
        .withColumn("lidar_support", hit & (F.col("provider") != "gedi"))
        .withColumn("spectral_support", hit & (F.col("provider") != "sentinel2"))
        .withColumn("convergence_type", F.when(hit, "spatial_overlap"))
        .drop("_k")
    )


def midpoint_rows(pairs: DataFrame, min_score: float = 8.0) -> DataFrame:
    """One multi-sensor row at the midpoint of every well-scored pair."""
    conf = (F.coalesce("a.confidence", F.lit(0.0)) + F.coalesce("b.confidence", F.lit(0.0))) / 2
    return pairs.where(F.col("score") >= min_score).select(
        F.col("a.det_id").alias("source_a"),
        F.col("b.det_id").alias("source_b"),
        F.col("a.zone_id").alias("zone_id"),
        F.lit("multi_sensor").alias("provider"),
        F.concat(F.col("a.det_type"), F.lit("+"), F.col("b.det_type")).alias("det_type"),
        ((F.col("a.lon") + F.col("b.lon")) / 2).alias("lon"),
        ((F.col("a.lat") + F.col("b.lat")) / 2).alias("lat"),
        conf.alias("confidence"),
        F.greatest("a.area_m2", "b.area_m2").alias("area_m2"),
        F.col("score").alias("convergent_score"),
        (F.col("distance") * 111000).alias("distance_m"),
        F.lit("high").alias("grade"),
    )


PHASES = ((0.60, 0.15, 5), (0.70, 0.20, 15), (0.80, 0.30, None))  # spectral min, lidar min, quota (fixed values)


_M_PER_DEG = 111000.0


def _lidar_confidence(points: Column) -> Column:
    return F.least(F.lit(0.9), points / 20.0)


def tier_matches(detections: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """Per spectral detection the first LiDAR detection (least id) within the radius at each pair of thresholds of PHASES: columns m0, m1, m2, NULL where none.

    A pyramid of cells holds the least id per threshold, so no pair is listed.
    """
    from terraloom.operators.pyramid import circle_aggregates

    spectral = detections.where("provider = 'sentinel2'").select("det_id", "lon", "lat", "confidence")
    lidar = detections.where("provider = 'gedi'").select("det_id", "lon", "lat", "n_points")
    l_conf, s_conf = _lidar_confidence(F.col("n_points")), F.coalesce("confidence", F.lit(0.5))
    least = {f"m{i}": ("min", F.when(l_conf >= l_min, F.col("det_id"))) for i, (_, l_min, _) in enumerate(PHASES)}
    found = circle_aggregates(lidar, spectral, "det_id", F.lit(radius_m / _M_PER_DEG), least)
    return found.join(spectral.select("det_id", s_conf.alias("_s")), "det_id").select(
        "det_id", *[F.when(F.col("_s") >= s_min, F.col(f"m{i}")).alias(f"m{i}") for i, (s_min, _, _) in enumerate(PHASES)]
    )


def match_tiers(detections: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """Every spectral detection with its strictest match: tier 3, 2 or 1 (the thresholds of PHASES from strict to loose) and its LiDAR partner, or tier 0 and none.

    One rule for every row, whatever the number of matches.
    """
    m = tier_matches(detections, radius_m)
    tier = F.when(F.col("m2").isNotNull(), 3).when(F.col("m1").isNotNull(), 2).when(F.col("m0").isNotNull(), 1).otherwise(0)
    spectral = detections.where("provider = 'sentinel2'").select("det_id")
    return spectral.join(m, "det_id", "left").select("det_id", tier.alias("tier"), F.coalesce("m2", "m1", "m0").alias("lidar_id"))


def first_match(detections: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """First LiDAR match per spectral detection with thresholds that tighten as matches accumulate.

    The sequential rule (5 matches at the loosest thresholds, 15 at the middle ones, the rest at the
    strictest) becomes three ordered takes: each phase starts after the last id the previous phase
    accepted, and a phase that does not fill its quota ends the matching. ``match_tiers`` is the rule
    without quotas.
    """
    d = detections.select("det_id", "provider", "lon", "lat", "confidence", "n_points")
    spectral, lidar = d.where("provider = 'sentinel2'"), d.where("provider = 'gedi'")
    matched = cut_lineage(tier_matches(d, radius_m))  # one row per spectral detection, read by all three phases
    taken, after = [], None
    for i, (_, _, quota) in enumerate(PHASES):
        phase = matched.where(F.col(f"m{i}").isNotNull())
        if after is not None:
            phase = phase.where(F.col("det_id") > after)
        phase = phase.select("det_id", F.col(f"m{i}").alias("lidar_id"))
        if quota is not None:
            phase = phase.orderBy("det_id").limit(quota)
            last = phase.agg(F.when(F.count(F.lit(1)) == quota, F.max("det_id")))
            after = last.scalar()
        taken.append(phase)
    hits = cut_lineage(taken[0].unionByName(taken[1]).unionByName(taken[2]))
    conf = F.coalesce("confidence", F.lit(0.0))
    none = F.lit(None)
    partner = lidar.select(F.col("det_id").alias("lidar_id"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("n_points").alias("_n"))
    metres = geo.planar_deg(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")) * _M_PER_DEG
    converged = salted_join(spectral.join(hits, "det_id"), partner, ["lidar_id"], "det_id").select(
        "det_id", "lidar_id", metres.alias("convergence_distance_m"),
        ((F.coalesce("confidence", F.lit(0.5)) + _lidar_confidence(F.col("_n"))) / 2).alias("combined_confidence"), F.lit("multi_sensor").alias("convergence_type"),
    )

    def alone(side: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
        return side.join(ids, "det_id", "left_anti").select(
            "det_id", none.cast("long").alias("lidar_id"), none.cast("double").alias("convergence_distance_m"),
            none.cast("double").alias("combined_confidence"), F.lit(tag).alias("convergence_type"),
        )

    n_spectral = spectral.limit(1).agg(F.count(F.lit(1))).scalar()
    lone_s = alone(spectral.where(conf >= 0.5), hits.select("det_id"), "sentinel2_only")
    lone_l = alone(
        lidar.where((conf >= 0.5) | (n_spectral == 0)), hits.select(F.col("lidar_id").alias("det_id")), "gedi_only"
    )
    return converged.unionByName(lone_s).unionByName(lone_l)


# --- nearest zone, radius statistics, sampling
def nearest_zone(points: DataFrame, centres: DataFrame, key: str, max_km: float = 50.0) -> DataFrame:
    """Closest zone centre within ``max_km`` per point; NULL when none is that close."""
    c = centres.select("zone_id", F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"))
    pairs = near_pairs(points.select(key, "lon", "lat"), c, max_km * 1000.0, key, closed=False)
    best = pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(
        F.min(F.struct("distance", F.col("b.zone_id").alias("zone"))).alias("_b")
    )
    return points.join(best, key, "left").select(
        key, F.col("_b.zone").alias("nearest_zone"), (F.col("_b.distance") / 1000).alias("distance_km")
    )


def radius_statistics(centres: DataFrame, shots: DataFrame, key: str, radius: Column) -> DataFrame:
    """Mean, population deviation and variance of shot elevation within each centre's radius (degrees).

    Sums come from a pyramid of pre-summed cells; only cells on a circle's border are opened. Elevations are taken from their overall mean, so that the squares lose no digits.
    """
    from terraloom.operators.pyramid import circle_aggregates

    valid = shots.where(F.col("elevation_ground").isNotNull()).select("lon", "lat", "elevation_ground")
    middle = valid.agg(F.avg("elevation_ground")).scalar()
    valid = valid.withColumn("_e", F.col("elevation_ground") - middle)
    e = F.col("_e")
    sums = circle_aggregates(valid, centres, key, radius, {"n_shots": ("sum", F.lit(1)), "_s1": ("sum", e), "_s2": ("sum", e * e)})
    mean = F.col("_s1") / F.col("n_shots")
    var = F.greatest(F.col("_s2") / F.col("n_shots") - mean * mean, F.lit(0.0))
    return sums.select(key, "n_shots", (mean + middle).alias("mean_elevation"), F.sqrt(var).alias("std_elevation"), var.alias("local_variance"))


def sample_pixels(features: DataFrame, pixels: DataFrame, key: str, bands: list[str], half: int = 0) -> DataFrame:
    """Mean of each band over the (2*half+1) square around a feature's pixel, plus its own pixel's values."""
    off = F.sequence(F.lit(-half), F.lit(half))
    spots = (
        features.select(key, "scene_id", "pix_row", "pix_col")
        .withColumn("_dr", F.explode(off)).withColumn("_dc", F.explode(off))
        .withColumn("pix_row", (F.col("pix_row") + F.col("_dr")).cast("int"))
        .withColumn("pix_col", (F.col("pix_col") + F.col("_dc")).cast("int"))
    )
    # the spots are (2*half+1)**2 times the features, which no size estimate sees, so neither side is broadcast
    joined = spots.hint("merge").join(pixels.select("scene_id", "pix_row", "pix_col", *bands), ["scene_id", "pix_row", "pix_col"])
    own = (F.col("_dr") == 0) & (F.col("_dc") == 0)
    return joined.groupBy(key).agg(
        *[F.avg(b).alias(f"mean_{b}") for b in bands], *[F.max(F.when(own, F.col(b))).alias(f"at_{b}") for b in bands]
    )


# --- boxes
BOX = ["west", "south", "east", "north"]


#: Levels of the cell cover: the side of a cell doubles from one to the next.
COVER_LEVELS = 16


def cover_level(width: Column, height: Column, cell: float) -> Column:
    """The first level at which a box is no wider or higher than a cell, so that it touches four cells at most; larger boxes take the last level."""
    wide = F.greatest(width, height, F.lit(0.0)) / cell
    return F.greatest(F.lit(0), F.least(F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))), F.lit(COVER_LEVELS - 1))).cast("int")


def cover_index(value: Column, level: Column, cell: float) -> Column:
    return F.floor(value / (F.lit(cell) * F.pow(F.lit(2.0), level)))


def box_cover(boxes: DataFrame, west: Column, south: Column, east: Column, north: Column, cell: float, upwards: int = 0) -> DataFrame:
    """Boxes at the cells (_lv, _cx, _cy) they touch at their own level, and at ``upwards`` coarser levels as well."""
    own = cover_level(east - west, north - south, cell)
    levels = F.sequence(own, F.least(own + upwards, F.lit(COVER_LEVELS - 1))) if upwards else F.array(own)
    lv = F.col("_lv")
    span = lambda lo, hi: F.explode(F.sequence(cover_index(lo, lv, cell), cover_index(hi, lv, cell)))
    return boxes.withColumn("_own", own).withColumn("_lv", F.explode(levels)).withColumn("_cx", span(west, east)).withColumn("_cy", span(south, north))


def box_pairs(left: DataFrame, right: DataFrame, cell: float = 0.25) -> DataFrame:
    """Pairs of overlapping boxes (structs ``a``, ``b``) with intersection and share of ``b`` covered.

    A box covers a few cells at the level of its size and at the coarser ones, some 60 rows however large it is. Two boxes meet at the larger one's level, in the cell of the lower-left corner of
    their intersection, so no pair appears twice and nothing needs deduplication. Cells with a large share of the boxes are cut into slices.
    """

    def spread(df, name):
        s = df.select(F.struct(*df.columns).alias(name))
        box = [F.col(f"{name}.{c}") for c in BOX]
        return box_cover(s.where((box[0] <= box[2]) & (box[1] <= box[3])), *box, cell, COVER_LEVELS).withColumnRenamed("_own", f"_own_{name}")

    w, s = F.greatest("a.west", "b.west"), F.greatest("a.south", "b.south")
    e, n = F.least("a.east", "b.east"), F.least("a.north", "b.north")
    joined = salted_join(spread(left, "a"), spread(right, "b"), ["_lv", "_cx", "_cy"], "a")
    lv = F.col("_lv")
    once = (lv == F.greatest("_own_a", "_own_b")) & (F.col("_cx") == cover_index(w, lv, cell)) & (F.col("_cy") == cover_index(s, lv, cell))
    kept = joined.where((w < e) & (s < n) & once)
    area = (F.col("b.east") - F.col("b.west")) * (F.col("b.north") - F.col("b.south"))
    return kept.select("a", "b", ((e - w) * (n - s) / area).alias("overlap"))


# --- merging by rounded coordinate
def _key(c: str) -> Column:
    return F.round(F.col(c), 6)


def merged_by_coordinate(layers: DataFrame) -> DataFrame:
    """One row per rounded coordinate from all layers.

    ``layers`` has layer, lon, lat, provider, rank, lidar_support, convergent_score,
    convergence_distance_m. Only constant-size states are kept per key, so copies of one coordinate
    combine map-side however many there are.
    """
    has = lambda p: F.max(F.col("layer").contains(p) | (F.col("provider") == p))
    best = F.max(
        F.struct(F.coalesce("convergent_score", F.lit(0.0)).alias("s"), (-F.col("convergence_distance_m")).alias("d"))
    )
    g = layers.groupBy(_key("lon").alias("lon"), _key("lat").alias("lat")).agg(
        F.max("rank").alias("rank"),
        F.coalesce(F.bool_or("lidar_support"), F.lit(False)).alias("lidar_support"),
        best.alias("_best"), has("gedi").alias("_l"), has("sentinel2").alias("_s"),
        F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("sources"),
    )
    return g.select(
        "lon", "lat", "rank", "lidar_support", F.col("_best.s").alias("convergent_score"),
        (-F.col("_best.d")).alias("convergence_distance_m"),
        F.when(F.col("_l"), "gedi").when(F.col("_s"), "sentinel2").otherwise("unknown").alias("provider"), "sources",
    )


def flag_membership(points: DataFrame, members: DataFrame, key: str, out: str = "is_convergent") -> DataFrame:
    """Flag points whose rounded coordinate occurs in ``members``; coordinates with many copies are sliced."""
    keys = members.select(_key("lon").alias("_kx"), _key("lat").alias("_ky")).distinct().withColumn("_hit", F.lit(True))
    p = points.withColumn("_kx", _key("lon")).withColumn("_ky", _key("lat"))
    return salted_join(p, keys, ["_kx", "_ky"], key, how="left").withColumn(out, F.col("_hit").isNotNull()).drop("_kx", "_ky", "_hit")


# --- nearest neighbour
_LEVELS = 12  # each level divides cells by 8; the finest is about 5e-9 degrees


def _grid(c: str, low: float) -> Column:
    return F.floor((F.col(c) - low) / 360.0 * (8**_LEVELS)).cast("long")


def nearest_distance(points: DataFrame, key: str) -> DataFrame:
    """Planar distance in degrees from each point to its nearest other point (NULL for a lone point).

    Copies of one location are answered with zero from a count. Every other location is assigned the
    coarsest grid level at which it is alone in its cell; its parent cell then holds another point,
    which bounds the search to two cells around it. A cell has at most 64 such children, so the work
    stays linear in the data even when one cell holds most of it.
    """
    locs = points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_w"))
    base = locs.withColumn("_ix", _grid("lon", -180.0)).withColumn("_iy", _grid("lat", -90.0))
    lv = base.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))))
    shift = (3 * (F.lit(_LEVELS) - F.col("_lv"))).cast("int")
    at_level = lambda c: F.call_function("shiftright", F.col(c), shift)
    rows = lv.withColumn("_cx", at_level("_ix")).withColumn("_cy", at_level("_iy"))
    cells = rows.groupBy("_lv", "_cx", "_cy").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("lon", "lat", "_w")).alias("_p")
    )
    parents = cells.where("_n > 1 AND _lv < %d" % _LEVELS).select("_lv", "_cx", "_cy")
    child = cells.where("_n = 1 AND _lv > 0").select(
        (F.col("_lv") - 1).alias("_lv"), F.shiftright("_cx", 3).alias("_cx"), F.shiftright("_cy", 3).alias("_cy"), "_p"
    )
    alone = child.join(parents, ["_lv", "_cx", "_cy"], "left_semi").select("_lv", "_cx", "_cy", "_p.lon", "_p.lat", "_p._w")
    # locations that share even a finest cell search from that cell
    tight = cells.where(f"_n > 1 AND _lv = {_LEVELS}").select("_lv", "_cx", "_cy")
    crowded = rows.join(tight, ["_lv", "_cx", "_cy"], "left_semi").select("_lv", "_cx", "_cy", "lon", "lat", "_w")
    off = F.sequence(F.lit(-2), F.lit(2))
    probe = (
        alone.unionByName(crowded).where("_w = 1")
        .withColumn("_dx", F.explode(off)).withColumn("_dy", F.explode(off))
        .select(
            "_lv", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"),
            F.col("lon").alias("_plon"), F.col("lat").alias("_plat"),
        )
    )
    cand = salted_join(
        rows.select("_lv", "_cx", "_cy", "lon", "lat", F.struct("lon", "lat").alias("_at")), probe, ["_lv", "_cx", "_cy"], "_at", dealt=True
    )
    other = (F.col("lon") != F.col("_plon")) | (F.col("lat") != F.col("_plat"))
    d = geo.planar_deg(F.col("lon"), F.col("lat"), F.col("_plon"), F.col("_plat"))
    near = cand.where(other).groupBy(F.col("_plon").alias("lon"), F.col("_plat").alias("lat")).agg(F.min(d).alias("_d"))
    answer = locs.join(near, ["lon", "lat"], "left").select(
        "lon", "lat", F.when(F.col("_w") > 1, F.lit(0.0)).otherwise(F.col("_d")).alias("nn_deg")
    )
    located = points.withColumn("_at", F.col(key))
    return salted_join(located, answer, ["lon", "lat"], "_at", how="left").drop("_at")  # points without coordinates have no distance


def best_discovery(detections: DataFrame) -> DataFrame:
    """Per zone the discovery to report.

    Convergent terra preta by confidence comes first, then any convergent detection by confidence,
    then the largest single-sensor terra preta, then the largest detection. One max over a struct, so
    a zone with most of the rows still combines map-side.
    """
    conv, soil = F.col("convergent_score") > 0, F.col("det_type").contains("terra_preta")
    tier = F.when(conv & soil, 4).when(conv, 3).when(soil, 2).otherwise(1)
    value = F.when(conv, F.coalesce("confidence", F.lit(0.0))).otherwise(F.coalesce("area_m2", F.lit(0.0)))
    best = F.max(F.struct(tier.alias("tier"), value.alias("value"), (-F.col("det_id")).alias("neg")))
    return detections.groupBy("zone_id").agg(best.alias("_k"), F.count_if(conv).alias("n_convergent")).select(
        "zone_id", (-F.col("_k.neg")).alias("best_det_id"), F.col("_k.tier").alias("tier"), "n_convergent"
    )
