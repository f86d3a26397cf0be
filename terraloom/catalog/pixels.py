"""Queries over pixel tables: indices (C), masks (D11-D14), coverage (F22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.catalog.registry import query
from terraloom.functions.indices import INDICES, SUITE, index, with_indices
from terraloom.operators import masks

PX = ["scene_id", "pix_row", "pix_col"]


def nd(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / (({a}) + ({b}) + 1E-8)"


RE_MEAN = "(red_edge_1 + red_edge_3) / 2"
RED_SAFE = "CASE WHEN red = 0 THEN 0.001E0 ELSE red END"
INDEX_SQL = {
    "ndvi": nd("nir", "red"),
    "ndre1": nd("red_edge_1", "red"),
    "ndre3": nd("red_edge_3", "red"),
    "avi": nd("red_edge_3", "red_edge_1"),
    "terra_preta": nd("nir", "swir1"),
    "terra_preta_enhanced": nd("red_edge_3", "swir1"),
    "clay_minerals": "swir1 / (swir2 + 1E-8)",
    "ndii": nd("nir", "swir1"),
    "ndwi": nd("green", "nir"),
    "brightness": "sqrt((blue * blue + green * green + red * red) / 3)",
    "crop_mark": "((red_edge_1 - red) * (nir - red_edge_1)) / ((red_edge_1 + red) * (nir + red_edge_1) + 1E-8)",
    "s2_archaeological": nd(RE_MEAN, "swir1"),
    "band_pair_confidence": "tanh(abs(nir - red) / (abs(nir - red) / 2 + 1E-8) / 10)",
    "evi": "2.5E0 * (nir - red) / (nir + 6 * red - 7.5E0 * blue + 1 + 1E-8)",
    "mndwi": nd("green", "swir1"),
    "ndsi": nd("swir1", "red"),
    "greenness": "-0.2848E0 * blue - 0.2435E0 * green - 0.5436E0 * red + 0.7243E0 * nir",
    "terra_preta_8band": f"(red_edge_1 - red) / (red_edge_1 + {RED_SAFE}) + 0.5E0 * ((swir1 - red) / (swir1 + {RED_SAFE}))",
    "terra_preta_4band": f"((nir - red) / (nir + {RED_SAFE})) * (green / ({RED_SAFE}))",
    "moisture": nd("nir", "swir1"),
}
IDS = {
    "ndvi": "c01", "ndre1": "c02", "ndre3": "c03", "avi": "c04", "terra_preta": "c05", "terra_preta_enhanced": "c06",
    "clay_minerals": "c07", "ndii": "c08", "ndwi": "c09", "brightness": "c10", "crop_mark": "c11",
    "s2_archaeological": "c12", "band_pair_confidence": "c13", "evi": "c14", "mndwi": "c15", "ndsi": "c16",
    "greenness": "c17", "terra_preta_8band": "c18a", "terra_preta_4band": "c18b", "moisture": "c19",
}

for _name, _id in IDS.items():
    assert _name in INDICES

    def _run(v, name=_name):
        return v.pixels.select(*PX, F.round(index(name), 9).alias("value"))

    query(f"{_id}_{_name}", f"SELECT scene_id, pix_row, pix_col, round({INDEX_SQL[_name]}, 9) AS value FROM pixels")(_run)


@query(
    "c20_index_suite",
    "SELECT scene_id, pix_row, pix_col, "
    + ", ".join(f"round({INDEX_SQL[n]}, 9) AS {n}" for n in SUITE)
    + " FROM pixels",
)
def _(v):
    return with_indices(v.pixels).select(*PX, *[F.round(n, 9).alias(n) for n in SUITE])


ENH = (
    f"{INDEX_SQL['terra_preta_enhanced']} > {{tp}} AND {INDEX_SQL['ndvi']} > {{nv}} AND {INDEX_SQL['ndvi']} < 0.7E0 "
    f"AND {INDEX_SQL['ndre1']} > {{nr}} AND {INDEX_SQL['moisture']} < 0.2E0"
)
ARCH_MASK = ENH.format(tp="0.30E0", nv="0.45E0", nr="0.25E0")
FAST_MASK = (
    f"{INDEX_SQL['terra_preta_enhanced']} > 0.12E0 AND {INDEX_SQL['ndvi']} > 0.3E0 AND {INDEX_SQL['ndvi']} < 0.8E0 "
    f"AND {INDEX_SQL['ndre1']} > 0.1E0"
)


@query("d11_enhanced_terra_preta_mask", f"SELECT scene_id, pix_row, pix_col, {ARCH_MASK} AS mask FROM pixels")
def _(v):
    return v.pixels.select(*PX, masks.enhanced_mask("archaeological").alias("mask"))


@query(
    "d11_depression_branch_mask",
    f"""p AS (SELECT *, red_edge_1 * 3 AS depression FROM pixels),
    f AS (SELECT scene_id, max(depression) > 0.4E0 AS b FROM p GROUP BY scene_id)
    SELECT scene_id, pix_row, pix_col, CASE WHEN b THEN {ENH.format(tp='0.25E0', nv='0.45E0', nr='0.25E0')}
      AND depression > 0.4E0 ELSE {ARCH_MASK} END AS mask FROM p JOIN f USING (scene_id)""",
)
def _(v):
    px = v.pixels.withColumn("depression", F.col("red_edge_1") * 3)
    return masks.with_enhanced_mask(px).select(*PX, "mask")


@query(
    "d12_standard_terra_preta_mask",
    f"""SELECT scene_id, pix_row, pix_col, {INDEX_SQL['terra_preta']} > 0.12E0 AND {INDEX_SQL['ndvi']} > 0.4E0
    AND {INDEX_SQL['ndvi']} < 0.7E0 AS mask FROM pixels""",
)
def _(v):
    return v.pixels.select(*PX, masks.standard_mask().alias("mask"))


@query(
    "d13_fast_terra_preta_masks",
    f"""SELECT scene_id, pix_row, pix_col, {FAST_MASK} AS red_edge_mask, {INDEX_SQL['terra_preta']} > 0.1E0
    AND {INDEX_SQL['ndvi']} > 0.3E0 AND {INDEX_SQL['ndvi']} < 0.8E0 AS standard_mask FROM pixels""",
)
def _(v):
    return v.pixels.select(
        *PX, masks.fast_mask_with_red_edge().alias("red_edge_mask"), masks.fast_mask_standard().alias("standard_mask")
    )


@query(
    "d14_crop_mark_masks",
    f"""SELECT scene_id, pix_row, pix_col,
    {INDEX_SQL['crop_mark']} > t AND {INDEX_SQL['ndvi']} > 0.5E0 AS positive_mark,
    {INDEX_SQL['crop_mark']} < -t AND {INDEX_SQL['ndvi']} > 0.4E0 AS negative_mark
    FROM pixels JOIN (SELECT zone_id, CASE WHEN zone_type = 'deforested_visible_earthworks' THEN 0.12E0 ELSE 0.06E0 END AS t
      FROM zones) z ON z.zone_id = scene_id % 25""",
)
def _(v):
    zoned = v.pixels.withColumn("zone_id", F.col("scene_id") % 25).join(v.zones.select("zone_id", "zone_type"), "zone_id")
    t = masks.zone_type_threshold(F.col("zone_type"), 0)
    return zoned.select(*PX, masks.crop_positive(t).alias("positive_mark"), masks.crop_negative(t).alias("negative_mark"))


@query(
    "f22_mask_coverage",
    f"""SELECT scene_id, count(*) AS n_pixels, CAST(sum(CASE WHEN {FAST_MASK} THEN 1 ELSE 0 END) AS BIGINT) AS mask_pixels,
    round(avg(CASE WHEN {FAST_MASK} THEN 1E0 ELSE 0E0 END) * 100, 9) AS coverage_pct,
    round(avg({INDEX_SQL['ndvi']}), 9) AS mean_ndvi, round(avg({INDEX_SQL['terra_preta_enhanced']}), 9) AS mean_tp
    FROM pixels GROUP BY scene_id""",
)
def _(v):
    px = with_indices(v.pixels, ["ndvi", "terra_preta_enhanced"]).withColumn("mask", masks.fast_mask_with_red_edge())
    cover = masks.mask_coverage(px, "mask", ["scene_id"], ["ndvi", "terra_preta_enhanced"])
    return cover.select(
        "scene_id", "n_pixels", "mask_pixels", F.round("coverage_pct", 9).alias("coverage_pct"),
        F.round("mean_ndvi", 9).alias("mean_ndvi"), F.round("mean_terra_preta_enhanced", 9).alias("mean_tp"),
    )
