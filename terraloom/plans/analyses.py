"""End-to-end analyses: LiDAR scenes, spectral scenes, preprocessing, scoring, fusion, discovery, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import FOOTPRINT_RADIUS_M, PRESETS
from terraloom.functions import geo
from terraloom.functions import scores as S
from terraloom.functions.indices import scaled_reflectance, with_indices
from terraloom.operators import circles as ci
from terraloom.operators import contours as co
from terraloom.operators import density as de
from terraloom.operators import display as di
from terraloom.operators import evidence as ev
from terraloom.operators import export as ex
from terraloom.operators import lidar as li
from terraloom.operators import masks
from terraloom.operators import quality as qa
from terraloom.operators import radiometry as ra
from terraloom.operators import ranking as rk
from terraloom.operators import reference_areas as areas
from terraloom.operators import regions as rg
from terraloom.operators import reporting as rp
from terraloom.operators import shape_filters as sf
from terraloom.operators import shapes as sh
from terraloom.operators import spatial as sp
from terraloom.operators import stencil as st
from terraloom.runtime import cut_lineage


# --- LiDAR
def lidar_scene(shots: DataFrame, preset: str = "archaeological", **overrides) -> DataFrame:
    """Clearings and mounds per zone with elevation statistics around them. Overrides replace preset values."""
    p = {**PRESETS[preset], **overrides}
    if preset == "fast":
        gaps = shots.where(li.absolute_gap(p["gap_threshold_m"]))
    else:
        gaps = li.with_local_max(shots).where(li.relative_gap())
    cols = ["shot_number", "zone_id", "lon", "lat"]
    anomalies = li.elevation_anomalies(shots, ["zone_id"], preset)
    group = de.threshold_graph if preset == "fast" else None

    def clusters(points, eps, size):
        pts = points.select(*cols)
        c = group(pts, "shot_number", eps, size, by=["zone_id"]) if group else de.dbscan(pts, "shot_number", eps, size, by=["zone_id"])
        return de.cluster_summary(c, ["zone_id"], p["max_feature_km2"])

    found = clusters(gaps, p["cluster_eps"], p["min_cluster_size"]).withColumn("det_type", F.lit("gedi_clearing")).unionByName(
        clusters(anomalies.where("kind = 'mound'"), p["mound_eps"], p["min_mound_size"]).withColumn("det_type", F.lit("gedi_mound"))
    )
    found = cut_lineage(found.withColumn("key", F.concat_ws(":", "det_type", "zone_id", "cluster_id")))
    radius = F.greatest(F.sqrt(F.col("area_m2") / F.pi()) / 111320, F.lit(0.001))
    around = sp.radius_statistics(found.select("key", "lon", "lat", "area_m2"), shots, "key", radius)
    conf = F.when(F.col("det_type") == "gedi_clearing", p["clearing_confidence"])
    return found.join(around, "key", "left").select(
        "zone_id", "det_type", "cluster_id", "n_points", "lon", "lat", "area_m2", conf.alias("confidence"),
        "mean_elevation", "std_elevation", "local_variance",
        (F.col("n_points") / F.greatest(F.col("area_m2"), F.lit(3.141592653589793 * FOOTPRINT_RADIUS_M**2))).alias("pulse_density"),
    )


def lidar_lines(shots: DataFrame, preset: str = "archaeological") -> DataFrame:
    """Linear features per zone: the line through its ditches where one fits, with its centre and the elevations within 0.002 degrees of it."""
    ditches = li.elevation_anomalies(shots, ["zone_id"], preset).where("kind = 'ditch'").select("shot_number", "zone_id", "lon", "lat")
    fits = li.line_fits(ditches, ["zone_id"], "shot_number").where("feature_type IS NOT NULL")
    centres = ditches.groupBy("zone_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    found = cut_lineage(fits.join(centres, "zone_id"))
    around = sp.radius_statistics(found.select("zone_id", "lon", "lat"), shots, "zone_id", F.lit(0.002))
    return found.join(around, "zone_id", "left").withColumn("det_type", F.lit("gedi_linear"))


def lidar_features(shots: DataFrame, preset: str = "archaeological", **overrides) -> DataFrame:
    """All features of a LiDAR scene: clearings, mounds and linear features; a linear feature has a length and a type, no area and no confidence."""
    clusters = lidar_scene(shots, preset, **overrides).select(
        "zone_id", "det_type", "cluster_id", "n_points", "lon", "lat", "area_m2", "confidence", "mean_elevation", "std_elevation", "local_variance", "pulse_density"
    )
    null = F.lit(None)
    lines = lidar_lines(shots, preset).select(
        "zone_id", "det_type", null.cast(clusters.schema["cluster_id"].dataType).alias("cluster_id"), F.coalesce("n_shots", F.lit(0)).cast("long").alias("n_points"), "lon", "lat",
        null.cast("double").alias("area_m2"), null.cast("double").alias("confidence"), "mean_elevation", "std_elevation", "local_variance", null.cast("double").alias("pulse_density"),
        "r2", "length_m", "feature_type",
    )
    return clusters.unionByName(lines, allowMissingColumns=True)


def lidar_potentials(shots: DataFrame, preset: str = "archaeological", **overrides) -> DataFrame:
    """Clearing and earthwork potential per zone."""
    found = cut_lineage(lidar_scene(shots, preset, **overrides))
    anomalies = li.elevation_anomalies(shots, ["zone_id"], preset)
    ditches = anomalies.where("kind = 'ditch'").select("shot_number", "zone_id", "lon", "lat")
    clear = li.clearing_potential(found.where("det_type = 'gedi_clearing'"), ["zone_id"]).withColumnRenamed("potential", "clearing_potential")
    earth = li.earthwork_potential(
        found.where("det_type = 'gedi_mound'"), li.line_fits(ditches, ["zone_id"], "shot_number"),
        li.anomaly_significance(anomalies, ["zone_id"]), ["zone_id"],
    ).select("zone_id", F.col("potential").alias("earthwork_potential"))
    return clear.join(earth, "zone_id", "full")


# --- spectral
BANDS_USED = ["ndvi", "ndre1", "terra_preta", "terra_preta_enhanced", "crop_mark"]
TERRA_CHAIN = [("open", 2), ("close", 3), ("open", 2)]
CROP_CHAIN = [("open", 4), ("close", 3), ("open", 2)]


def terra_preta_regions(pixels: DataFrame, preset: str = "archaeological") -> DataFrame:
    """Scored terra-preta regions: mask, clean, label, measure, filter, score."""
    mask = masks.fast_mask_with_red_edge() if preset == "fast" else masks.enhanced_mask(preset)
    lab = cut_lineage(rg.clean_regions(pixels, mask, TERRA_CHAIN, 8 if preset == "fast" else 4))
    measured = lab.join(with_indices(pixels, BANDS_USED).hint("merge"), st.PIX)  # a table of pixels is never broadcast: its size in the files says little about it
    stats = rg.region_stats(measured, BANDS_USED).join(rg.perimeters(lab), rg.COMP)
    conf = S.region_confidence_enhanced(F.col("mean_terra_preta_enhanced"), F.col("mean_ndvi"), F.col("mean_ndre1"), F.col("area_m2"))
    scored = rg.enhanced_prefilter(stats).withColumn("confidence", conf)
    return scored.where(F.col("confidence") >= PRESETS[preset]["base_confidence"])


def crop_mark_regions(pixels: DataFrame, threshold: Column) -> DataFrame:
    """Positive and negative crop marks as scored regions, with their scene's load class."""
    out = None
    for kind, mask in (("positive", masks.crop_positive(threshold)), ("negative", masks.crop_negative(threshold))):
        lab = rg.clean_regions(pixels, mask, CROP_CHAIN, 4).join(with_indices(pixels, ["crop_mark"]).hint("merge"), st.PIX)
        stats = rg.component_load(rg.region_stats(lab, ["crop_mark"]))
        conf = S.crop_confidence(F.col("area_m2"), F.col("mean_crop_mark"))
        marks = rg.crop_prefilter(stats).withColumn("confidence", conf).where("confidence >= 0.3").withColumn("det_type", F.lit(f"crop_mark_{kind}"))
        out = marks if out is None else out.unionByName(marks)
    return out


#: Columns of a shape found in a scene image; sizes in metres, the centre in pixels.
SHAPE = ["scene_id", "det_type", "centre_row", "centre_col", "length_m", "area_m2", "angle_degrees", "aspect_ratio", "radius_m", "edge_strength", "confidence"]


def geometric_shapes(pixels: DataFrame, zones: DataFrame | None = None, line_votes: int = 140, circle_votes: int = ci.VOTES, significance: float = ci.MIN_SIGNIFICANCE) -> DataFrame:
    """Lines, circles and rectangles of the scene image that pass their size, confidence and axis gates.

    ``zones`` (scene_id, zone_type, min_feature_m, max_feature_m) gives each scene its edge thresholds, radius range and least size.
    """
    level = cut_lineage(sh.detection_level(pixels))
    settings = cut_lineage(ci.scene_settings(level, zones))  # one row per scene
    hard = cut_lineage(sh.canny(level, "level", 50, 150))
    soft = cut_lineage(ci.circle_edges(level, settings))
    size = settings.select("scene_id", "min_size_m")
    null, px = F.lit(None).cast("double"), ci.PIXEL_M

    turn = F.pmod(F.col("angle_degrees"), F.lit(90.0))
    off_axis = ~((turn < 2) | (turn > 88))
    length = F.col("length_px") * px
    lines = sh.straight_segments(hard, line_votes).select(
        "scene_id", F.lit("line").alias("det_type"), ((F.col("y1") + F.col("y2")) / 2).alias("centre_row"),
        ((F.col("x1") + F.col("x2")) / 2).alias("centre_col"), length.alias("length_m"), F.lit(0.0).alias("area_m2"),
        F.pmod(F.col("angle_degrees"), F.lit(180.0)).alias("angle_degrees"), null.alias("aspect_ratio"), null.alias("radius_m"), null.alias("edge_strength"),
        S.line_confidence(length).alias("confidence"),
    ).join(size, "scene_id").where((F.col("length_m") >= F.col("min_size_m")) & (F.col("confidence") >= 0.5) & off_axis)

    r = F.col("radius") * px
    rounds = ci.circle_features(soft, settings, circle_votes, significance).select(
        "scene_id", F.lit("circle").alias("det_type"), F.col("centre_row").cast("double").alias("centre_row"), F.col("centre_col").cast("double").alias("centre_col"),
        (r * 2).alias("length_m"), (F.pi() * r * r).alias("area_m2"), F.lit(0.0).alias("angle_degrees"), F.lit(1.0).alias("aspect_ratio"),
        r.alias("radius_m"), "edge_strength", F.col("significance").alias("confidence"),
    )

    # the least area of a scene is tested below; its square of three pixels is the least of all
    boxes = co.rectangles(rg.label_regions(hard, 8), 9.0, ci.MAX_AREA_M2 / px**2).join(size, "scene_id")
    area, aspect = F.col("area_px") * px * px, F.col("length_px") / (F.col("width_px") + 1e-6 / px)
    rects = boxes.select(
        "scene_id", F.lit("rectangle").alias("det_type"), "centre_row", "centre_col", (F.col("length_px") * px).alias("length_m"), area.alias("area_m2"),
        "angle_degrees", aspect.alias("aspect_ratio"), null.alias("radius_m"), null.alias("edge_strength"), S.rectangle_confidence(area, aspect).alias("confidence"), "min_size_m",
    ).where((F.col("area_m2") >= F.col("min_size_m") * F.col("min_size_m")) & (F.col("confidence") >= 0.5) & off_axis)
    return lines.select(*SHAPE).unionByName(rounds).unionByName(rects.select(*SHAPE))


def standard_terra_preta_regions(pixels: DataFrame, preset: str = "archaeological") -> DataFrame:
    """Terra preta by the plain index: mask, clean, label, measure, filter."""
    p = PRESETS[preset]
    lab = rg.clean_regions(pixels, masks.standard_mask(), TERRA_CHAIN, 4).join(with_indices(pixels, BANDS_USED).hint("merge"), st.PIX)
    return rg.standard_filter(rg.region_stats(lab, BANDS_USED), p["min_area_m2"], p["max_area_m2"])


def spectral_scene(pixels: DataFrame, preset: str = "archaeological", threshold: Column | None = None) -> DataFrame:
    """Terra-preta and crop-mark detections of every scene, after the ground filter."""
    cols = ["scene_id", "det_type", "comp_row", "comp_col", "n_px", "area_m2", "confidence", "centre_row", "centre_col"]
    soil = terra_preta_regions(pixels, preset).withColumn("det_type", F.lit("terra_preta"))
    marks = crop_mark_regions(pixels, threshold if threshold is not None else F.lit(0.06))
    found = cut_lineage(soil.select(*cols).unionByName(marks.select(*cols)))
    keyed = found.withColumn("key", F.concat_ws(":", "det_type", "scene_id", "comp_row", "comp_col"))
    keyed = keyed.withColumn("pix_row", F.round("centre_row").cast("int")).withColumn("pix_col", F.round("centre_col").cast("int"))
    kept = sf.without_unsuitable_ground(keyed, pixels, "key")
    return kept.where(F.col("confidence") <= 0.98).select(*cols)


def scene_families(
    pixels: DataFrame, zones: DataFrame | None = None, grid: DataFrame | None = None, preset: str = "archaeological", threshold: Column | None = None,
    line_votes: int = 140, circle_votes: int = ci.VOTES, significance: float = ci.MIN_SIGNIFICANCE,
) -> DataFrame:
    """Every family of a scene: terra preta (enhanced and standard), crop marks, lines, circles and rectangles, with integrity and density flags.

    Shapes go through the spectral false-positive test, all families through the shape and ground filters. ``grid`` (scene_id, west, north, step_deg) places a scene; its detections then
    get lon, lat and the integrity flag, else both stay NULL. ``zones`` may hold (scene_id, quota) rows; family_rank counts a scene's detections of a family from the most confident one on, and
    over_quota marks those beyond the quota. No detection is removed because of how many there are.
    """
    def as_shape(df: DataFrame, kind: Column) -> DataFrame:
        null = F.lit(None).cast("double")
        return df.select(
            "scene_id", kind.alias("det_type"), "centre_row", "centre_col", null.alias("length_m"), "area_m2", null.alias("angle_degrees"), null.alias("aspect_ratio"),
            null.alias("radius_m"), null.alias("edge_strength"), "confidence",
        )

    shapes = cut_lineage(_placed(geometric_shapes(pixels, zones, line_votes, circle_votes, significance)))
    shapes = sf.without_false_positives(shapes, pixels, "key").select(*SHAPE)
    soil = as_shape(terra_preta_regions(pixels, preset), F.lit("terra_preta"))
    plain = as_shape(standard_terra_preta_regions(pixels, preset), F.lit("terra_preta_standard"))
    marks = as_shape(crop_mark_regions(pixels, threshold if threshold is not None else F.lit(0.06)), F.col("det_type"))
    found = cut_lineage(_placed(shapes.unionByName(soil).unionByName(plain).unionByName(marks)))
    kept = sf.without_unsuitable_ground(sf.without_shape_artifacts(found), pixels, "key").drop("pix_row", "pix_col")
    if grid is None:
        placed = kept.withColumn("lon", F.lit(None).cast("double")).withColumn("lat", F.lit(None).cast("double")).withColumn("located", F.lit(None).cast("boolean"))
    else:
        lon = F.col("west") + (F.col("centre_col") + 0.5) * F.col("step_deg")
        lat = F.col("north") - (F.col("centre_row") + 0.5) * F.col("step_deg")
        placed = kept.join(grid.select("scene_id", "west", "north", "step_deg"), "scene_id", "left").withColumn("lon", lon).withColumn("lat", lat)
        placed = placed.withColumn("located", geo.valid_coordinates(F.col("lon"), F.col("lat"))).drop("west", "north", "step_deg")
    quota = zones.select("scene_id", "quota") if zones is not None and "quota" in zones.columns else None
    return di.family_ranked(placed, quota)


def _placed(found: DataFrame) -> DataFrame:
    """A key and the pixel of the centre for the filters that look at the scene."""
    keyed = found.withColumn("key", F.concat_ws(":", "det_type", "scene_id", *[F.round(c, 3).cast("string") for c in ("centre_row", "centre_col")], F.round("length_m", 3).cast("string"), F.round("area_m2", 3).cast("string")))
    return keyed.withColumn("pix_row", F.round("centre_row").cast("int")).withColumn("pix_col", F.round("centre_col").cast("int"))


def landsat_bands(dn: DataFrame, bands: list[str]) -> DataFrame:
    """Scaling, outlier clip, gap fill and cloud mask."""
    scaled = dn.select("scene_id", "pix_row", "pix_col", *[scaled_reflectance(F.col(b), 0.0, "landsat").alias(b) for b in bands])
    out = ra.outlier_clipped(scaled, bands)
    out = st.fill_gaps(out, {f"_f_{b}": b for b in bands}, 5)  # one pixel exchange for all bands
    out = out.select(*st.PIX, *[F.col(f"_f_{b}").alias(b) for b in bands])
    return ra.cloud_masked(out, bands)


def landsat_preprocessed(dn: DataFrame, bands: list[str], method: str = "minmax") -> DataFrame:
    """Scaling, outlier clip, gap fill, cloud mask, normalisation and indices."""
    return with_indices(ra.normalised(landsat_bands(dn, bands), bands, method), ["ndvi", "evi", "ndwi", "brightness", "greenness"])


def landsat_products(dn: DataFrame, bands: list[str], composites: tuple[str, ...] = ("true_color", "false_color", "archaeology")) -> dict[str, DataFrame]:
    """The whole preprocessing of a scene: normalised bands with indices, and 8-bit composites of the normalised bands that the scene has bands for."""
    normal = cut_lineage(ra.normalised(landsat_bands(dn, bands), bands, "percentile"))
    out = {"indices": with_indices(normal, ["ndvi", "evi", "ndwi", "brightness", "greenness"])}
    for kind in composites:
        if set(ra.COMPOSITES[kind]) <= set(bands):
            out[kind] = ra.composite(normal.select(*st.PIX, *bands), kind)
    return out


# --- zones and fusion
#: Per family: the type zones are scored by, confidence and area where a detection has none (fixed values).
FAMILY_DEFAULTS = {
    "terra_preta": ("terra_preta", 0.85, 5000.0),
    "geometric": (None, 0.70, 15000.0),
    "crop_mark": ("terra_preta", 0.75, 3000.0),
    "gedi_clearing": ("gedi_clearing", 0.8, 0.0),
    "gedi_earthwork": ("gedi_earthwork", 0.75, 0.0),
}


def with_family_defaults(detections: DataFrame) -> DataFrame:
    """Detections as zones are scored by them: inside the basin, axes repaired for LiDAR, family, and the family's confidence and area where they are missing.

    Crop marks count as terra preta. LiDAR families have their fixed confidence whatever the detection says.
    """
    t = F.col("det_type")
    family = F.when(t.startswith("terra_preta"), "terra_preta").when(t.startswith("crop_mark"), "crop_mark").when(t.isin("gedi_clearing", "gedi_earthwork"), t).otherwise("geometric")
    of = lambda i: F.coalesce(*[F.when(F.col("family") == k, F.lit(v[i])) for k, v in FAMILY_DEFAULTS.items() if v[i] is not None])
    lidar = F.col("family").startswith("gedi")
    swapped = F.struct(F.col("lat").alias("lon"), F.col("lon").alias("lat"))
    at = F.when(lidar & (F.abs("lon") < F.abs("lat")), swapped).otherwise(F.struct("lon", "lat"))
    out = detections.withColumn("family", family).withColumn("_at", at)
    out = out.withColumns({"lon": F.col("_at.lon"), "lat": F.col("_at.lat")}).drop("_at").where(geo.in_amazon(F.col("lon"), F.col("lat")))
    return out.withColumns({
        "confidence": F.when(lidar, of(1)).otherwise(F.coalesce("confidence", of(1))), "area_m2": F.coalesce("area_m2", of(2)), "det_type": F.coalesce(of(0), t),
    })


def scored_zones(detections: DataFrame, zones: DataFrame, defaults: bool = False) -> DataFrame:
    """Zone score, class, confidence metrics and fused site confidence; with ``defaults`` of detections completed by ``with_family_defaults``."""
    detections = with_family_defaults(detections) if defaults else detections
    agg = ev.zone_aggregates(detections, zones)
    site = ev.site_confidence(ev.sensor_confidence(agg)).select("zone_id", "combined_score", "cohens_d", "p_value", "confidence_level", "meets_standards")
    return ev.zone_scores(detections, zones).join(ev.confidence_metrics(ev.evidence_rows(agg)), "zone_id").join(site, "zone_id")


def fused_candidates(detections: DataFrame, k: int = 20, radius_m: float = 1500.0) -> DataFrame:
    """Diverse top candidates across providers, ranked, with field priority."""
    c = rk.with_candidate_score(sp.convergence_per_detection(detections, radius_m))
    top = rk.diverse_top(c, k)
    return top.withColumn("field_priority", F.when(F.col("rank") <= 3, "high").otherwise("medium"))


def unified_features(detections: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Pair support, combined and top-candidate exports, and midpoint rows."""
    pairs = sp.scored_pairs(detections)  # as many as the points are dense: read as they are found, never written
    supported = sp.with_pair_support(detections, pairs)
    both = supported.where(F.col("convergence_type").isNotNull())
    mid = sp.midpoint_rows(pairs)
    return {
        "detections": supported,
        "midpoints": mid,
        "combined": ex.combined_features(both, run_id),
        "top": ex.top_candidate_features(rk.prioritised(supported), run_id),
    }


def discovery_footprints(detections: DataFrame, micro_zone: Column, n: int = 5) -> DataFrame:
    """Ingest filter, control-area exclusion, first-match fusion, best footprints with WKT polygons."""
    spark = detections.sparkSession
    excluded = areas.areas(spark).where(F.col("name").startswith("Infrastructure Exclusion"))
    kept = areas.outside(detections.where(sf.ingest_allowed(micro_zone)), excluded, "det_id")
    kept = cut_lineage(kept)
    fused = sp.first_match(kept).join(kept.select("det_id", "det_type", "provider", "zone_id", "lon", "lat", "confidence"), "det_id")
    # cross-validated first, then by confidence; a top-k report
    score = F.coalesce("combined_confidence", "confidence", F.lit(0.0))
    tier = F.when(F.col("convergence_type") == "multi_sensor", 0).otherwise(1)
    top = fused.withColumn("_t", tier).withColumn("score", score).orderBy("_t", F.desc("score"), "det_id").limit(n)
    ring = geo.footprint_ring(F.col("lon"), F.col("lat"), F.lit(50.0))
    return top.select("det_id", "det_type", "provider", "zone_id", "convergence_type", "score", geo.wkt_polygon(ring).alias("wkt"))


DISCOVERY_RULES = [  # fixed values
    dict(name="five_footprints", type="min_count", column="det_id", n=5),
    dict(name="footprints_located", type="not_empty", column="wkt"),
    dict(name="two_sources", type="min_count", column="provider", distinct=True, n=2),
]


def discovery_report(detections: DataFrame, micro_zone: Column, n: int = 5) -> dict[str, DataFrame]:
    """Footprints of the best discoveries, and what is reported with them: flags of the same detections, numbers per convergence type, data set ids per provider, requirement checks."""
    footprints = cut_lineage(discovery_footprints(detections, micro_zone, n))
    chosen = detections.join(footprints.select("det_id"), "det_id", "left_semi")
    return {
        "footprints": footprints,
        "flags": qa.detection_flags(chosen),
        "convergence": rp.convergence_summary(footprints),
        "datasets": rp.dataset_ids(detections.select("provider", F.col("det_id").alias("dataset_id"))),
        "requirements": qa.check_requirements(footprints, DISCOVERY_RULES),
    }


def validated(detections: DataFrame, centres: DataFrame) -> dict[str, DataFrame]:
    """All flag tables, metrics and advice of the validation step."""
    metrics = qa.validation_metrics(detections, ["zone_id"], centres)
    flags = qa.detection_flags(detections)
    per_zone = flags.join(detections.select("det_id", "zone_id"), "det_id").groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_flags"))
    return {
        "metrics": metrics,
        "flags": flags,
        "density": qa.density_flags(metrics, ["zone_id"]),
        "advice": qa.recommendations(metrics.join(per_zone, "zone_id", "left"), F.coalesce("n_flags", F.lit(0))),
    }


def report_tables(detections: DataFrame, zones: DataFrame, scores: DataFrame, shots: DataFrame) -> dict[str, DataFrame]:
    """Every table of the report."""
    return {
        "summary": rp.executive_summary(scores, detections),
        "feature_counts": rp.feature_counts(detections),
        "zone_details": rp.zone_details(zones, scores, detections),
        "high_priority": rp.high_priority_sites(scores),
        "providers": rp.provider_analysis(detections),
        "inventory": rp.feature_inventory(detections),
        "data_quality": rp.data_quality(shots),
        "resources": rp.resource_plan(scores),
        "gaps_lidar": rk.coverage_gaps(zones, detections, "gedi"),
        "gaps_spectral": rk.coverage_gaps(zones, detections, "sentinel2"),
    }
