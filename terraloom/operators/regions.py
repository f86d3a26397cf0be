"""Connected pixel regions: labelling, statistics, perimeter, load limits and pre-filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.constants import PIXEL_AREA_M2
from terraloom.functions import scores as S
from terraloom.operators.graph import connected_components
from terraloom.operators.stencil import PIX, TILE, irregular_open, morphology
from terraloom.operators.topn import sliced_rank
from terraloom.runtime import cut_lineage

COMP = ["scene_id", "comp_row", "comp_col"]


def _tile_labels(row: np.ndarray, col: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """First pixel, in raster order, of the region of each pixel of one tile; pixels come in raster order.

    Pixels are merged into horizontal runs. Runs of neighbouring rows that touch are united, the earlier run being the root, so the root of a region is its first run.
    """
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    first = np.flatnonzero(new)
    start, end, line = col[first], col[np.append(first[1:], len(row)) - 1], row[first]
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # the runs of the row below that a run touches lie side by side: one search finds them for all runs
    reach = 1 if diagonal else 0
    wide = int(max(end.max(), 0) - min(start.min(), 0)) + 3
    key = lambda r, c: r.astype(np.int64) * wide + (c - min(int(start.min()), 0) + 1)
    low = np.searchsorted(key(line, end), key(line + 1, start - reach))
    high = np.searchsorted(key(line, start), key(line + 1, end + reach), "right")
    for i in np.flatnonzero(low < high).tolist():
        for j in range(low[i], high[i]):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(first))])[np.cumsum(new) - 1]
    return line[roots], start[roots]


def _label_tiles(diagonal: bool):
    """Task function: appends the local labels to the pixels of each tile; pixels come sorted by tile and raster order."""

    def label(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = t.column("_tile").combine_chunks()
            cuts = np.append(0, np.flatnonzero(pc.not_equal(tile.slice(1), tile.slice(0, len(tile) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
            held = t.slice(cuts[-1])  # the last tile may go on
            for a, z in zip(cuts, cuts[1:]):
                yield from labelled(t.slice(a, z - a))
        if held is not None:
            yield from labelled(held)

    def labelled(t: pa.Table):
        lr, lc = _tile_labels(t.column("pix_row").to_numpy(), t.column("pix_col").to_numpy(), diagonal)
        out = t.drop_columns(["_tile"]).append_column("_lr", pa.array(lr, pa.int32())).append_column("_lc", pa.array(lc, pa.int32()))
        yield from out.combine_chunks().to_batches()

    return label


def label_regions(true_pixels: DataFrame, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """Add comp_row, comp_col: the first pixel, in raster order, of each pixel's region.

    Regions are found in two levels. Pixels are exchanged once, by tile, and a task labels the regions of each of its tiles by itself. Then only pixels on tile borders
    look across; the local labels that meet there are the nodes of the component search, so its rounds depend on how many tiles a region crosses, not on its pixels.
    """
    side = lambda c: F.floor(F.col(c) / tile)
    kinds = {f.name: f.dataType for f in true_pixels.schema.fields}
    names = true_pixels.columns
    px = true_pixels.withColumns({"pix_row": F.col("pix_row").cast("int"), "pix_col": F.col("pix_col").cast("int")})
    px = px.withColumn("_tile", F.to_json(F.struct("scene_id", side("pix_row").alias("r"), side("pix_col").alias("c"))))
    dealt = px.repartition("_tile").sortWithinPartitions("_tile", "pix_row", "pix_col")
    schema = T.StructType([*px.drop("_tile").schema.fields, T.StructField("_lr", T.IntegerType()), T.StructField("_lc", T.IntegerType())])
    local = cut_lineage(dealt.mapInArrow(_label_tiles(connectivity == 8), schema))

    label = F.struct("scene_id", F.col("_lr").alias("row"), F.col("_lc").alias("col"))
    at = lambda c: F.pmod(F.col(c), F.lit(tile))
    rim = local.where((at("pix_row") == 0) | (at("pix_row") == tile - 1) | (at("pix_col") == 0) | (at("pix_col") == tile - 1)).select(*PIX, label.alias("label"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    to = rim.withColumn("_s", step).select("scene_id", (F.col("pix_row") + F.col("_s.r")).alias("pix_row"), (F.col("pix_col") + F.col("_s.c")).alias("pix_col"), F.col("label").alias("other"))
    edges = rim.join(to.hint("merge"), PIX).where(F.col("label") != F.col("other")).select(F.col("label").alias("src"), F.col("other").alias("dst"))
    comp = connected_components(edges).select(
        F.col("node.scene_id").alias("scene_id"), F.col("node.row").alias("_lr"), F.col("node.col").alias("_lc"),
        F.col("component.row").alias("_cr"), F.col("component.col").alias("_cc"),
    )
    out = local.join(comp, ["scene_id", "_lr", "_lc"], "left")
    same = lambda c: F.col(c).cast(kinds[c]).alias(c) if c in ("pix_row", "pix_col") else F.col(c)
    return out.select(*[same(c) for c in names], F.coalesce("_cr", "_lr").alias("comp_row"), F.coalesce("_cc", "_lc").alias("comp_col"))


def clean_regions(pixels: DataFrame, mask: Column, chain: list[tuple[str, int]], connectivity: int = 4) -> DataFrame:
    """Labelled pixels of a cleaned mask: (scene_id, pix_row, pix_col, comp_row, comp_col).

    Only the pixel key and one byte pass through the morphology shuffles; band values are joined to the
    surviving pixels afterwards by whoever needs them.
    """
    slim = pixels.select(*PIX, mask.cast("byte").alias("m"))
    kept = morphology(slim, "m", chain, "_c").where("_c = 1").select(*PIX)
    return label_regions(kept, connectivity)


def region_stats(labelled: DataFrame, means: list[str] = ()) -> DataFrame:
    """Size, centroid, box, aspect, area and mean of any columns, per region, in one aggregate."""
    h = F.max("pix_row") - F.min("pix_row") + 1
    w = F.max("pix_col") - F.min("pix_col") + 1
    n = F.count(F.lit(1))
    return labelled.groupBy(*COMP).agg(
        n.alias("n_px"), F.avg("pix_row").alias("centre_row"), F.avg("pix_col").alias("centre_col"),
        F.min("pix_row").alias("row_min"), F.max("pix_row").alias("row_max"),
        F.min("pix_col").alias("col_min"), F.max("pix_col").alias("col_max"),
        (F.greatest(h, w) / F.least(h, w)).alias("aspect"), (n * PIXEL_AREA_M2).alias("area_m2"),
        *[F.avg(m).alias(f"mean_{m}") for m in means],
    )


def perimeters(labelled: DataFrame) -> DataFrame:
    """Boundary-pixel count per region and the area/perimeter ratio and compactness from it.

    A pixel is on the boundary unless all four neighbours belong to the mask; the neighbours are read
    with one window per axis.
    """
    across = Window.partitionBy("scene_id", "pix_row").orderBy("pix_col")
    down = Window.partitionBy("scene_id", "pix_col").orderBy("pix_row")

    def adjacent(w, c):
        return F.coalesce(
            (F.lag(c).over(w) == F.col(c) - 1) & (F.lead(c).over(w) == F.col(c) + 1), F.lit(False)
        )

    inner = labelled.withColumn("_h", adjacent(across, "pix_col")).withColumn("_v", adjacent(down, "pix_row"))
    n, edge = F.count(F.lit(1)), F.count_if(~(F.col("_h") & F.col("_v")))
    return inner.groupBy(*COMP).agg(
        edge.alias("perimeter_px"), (n / edge).alias("area_perimeter"),
        (4 * F.pi() * n / (edge * edge)).alias("compactness"),
    )


def enhanced_prefilter(stats: DataFrame) -> DataFrame:
    """Settlement-sized, not linear, not blocky (needs area_perimeter)."""
    return stats.where(
        F.col("area_m2").between(500.0, 50000.0) & (F.col("n_px") >= 3) & (F.col("aspect") <= 8)
        & (F.col("area_perimeter") <= 25)
    )


def crop_prefilter(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("area_m2").between(300.0, 20000.0) & (F.col("n_px") >= 3) & (F.col("aspect") <= 10))


def standard_filter(stats: DataFrame, min_area: float, max_area: float) -> DataFrame:
    """Area range, at least 50 pixels and confidence 0.5 (needs mean_terra_preta and mean_ndvi)."""
    conf = S.region_confidence_standard(F.col("mean_terra_preta"), F.col("mean_ndvi"), F.col("n_px"))
    return stats.withColumn("confidence", conf).where(
        F.col("area_m2").between(min_area, max_area) & (F.col("n_px") >= 50) & (F.col("confidence") >= 0.5)
    )


def component_load(
    stats: DataFrame, medium: int = 200, major: int = 1000, final: int = 250,
    medium_px=(25, 400), major_px=(50, 200), medium_top: int = 150, major_top: int = 200,
) -> DataFrame:
    """Adds load_class, the crowding of a region's scene, and passes_load, whether it is among those to look at first; no region is removed.

    In scenes with more than ``medium`` regions (class medium) the mid-sized ones pass, largest first up to a limit; with
    more than ``major`` (class major) the limits tighten; where more than ``final`` would still pass, none does.
    """
    stats = cut_lineage(stats)  # one row per region, read three times below
    counts = stats.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_k"))
    kind = F.when(F.col("_k") > major, "major").when(F.col("_k") > medium, "medium").otherwise("normal")
    s = stats.join(counts.select("scene_id", kind.alias("load_class"), "_k"), "scene_id")
    by_class = lambda normal, med, maj: F.when(F.col("load_class") == "major", maj).when(F.col("load_class") == "medium", med).otherwise(normal)
    n = F.col("n_px")
    right_size = by_class(F.lit(True), n.between(*medium_px), n.between(*major_px))
    top = by_class(F.lit(0), F.lit(medium_top), F.lit(major_top))
    first = sliced_rank(
        s.where((F.col("load_class") != "normal") & right_size).select(*COMP, "n_px", top.alias("_top")), ["scene_id"], [F.desc("n_px"), "comp_row", "comp_col"], COMP[1:], "_top"
    ).select(*COMP, F.lit(True).alias("_first"))
    marked = s.join(first, COMP, "left").withColumn("_ok", (F.col("load_class") == "normal") | F.col("_first").isNotNull())
    passing = marked.groupBy("scene_id").agg(F.count_if("_ok").alias("_p"))
    ok = F.col("_ok") & (F.col("_p") <= final)
    return marked.join(passing, "scene_id").select(*stats.columns, "load_class", ok.alias("passes_load"))


def component_brake(stats: DataFrame, **limits) -> DataFrame:
    """The regions that pass ``component_load``: a selection for callers that ask for one; composed analyses keep all regions."""
    return component_load(stats, **limits).where("passes_load").select(*stats.columns)


def varied_open(labelled: DataFrame, pixels: DataFrame) -> DataFrame:
    """Opening of every region with one of three irregular elements, alternating in raster order.

    Each region is opened on its own: windows run inside a region because its pixels are given a
    private scene key. ``pixels`` gives the image extent of each scene.
    """
    extent = pixels.groupBy("scene_id").agg(F.max("pix_row").alias("row_end"), F.max("pix_col").alias("col_end"))
    firsts = labelled.select(*COMP).distinct()
    # position of a region within its scene: count regions per start row, then rank inside the row
    rows = firsts.groupBy("scene_id", "comp_row").agg(F.count(F.lit(1)).alias("_k"))
    up = Window.partitionBy("scene_id").orderBy("comp_row").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("scene_id", "comp_row", F.coalesce(F.sum("_k").over(up), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("scene_id", "comp_row").orderBy("comp_col")
    ranked = firsts.withColumn("_rn", F.row_number().over(inside) - 1).join(before, ["scene_id", "comp_row"])
    choice = ranked.select(*COMP, ((F.col("_before") + F.col("_rn")) % 3).alias("_choice"))
    own = labelled.join(choice, COMP).join(extent, "scene_id").select(
        F.struct(*COMP).alias("scene_id"), "pix_row", "pix_col", F.lit(1).alias("m"), "_choice", "row_end", "col_end"
    )
    # an opening never leaves its input, so the region's own pixels are all that has to be looked at
    opened = irregular_open(own, "m", F.col("_choice")).where("opened")
    return opened.select(F.col("scene_id.scene_id").alias("scene_id"), "pix_row", "pix_col")
