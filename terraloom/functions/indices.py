"""Spectral indices as column expressions over a wide pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.constants import EPS


def ratio_difference(a: Column, b: Column) -> Column:
    """Normalised difference with a guarded denominator."""
    return (a - b) / (a + b + EPS)


def _re_mean(c):
    return (c("red_edge_1") + c("red_edge_3")) / 2


def _variant_8(c):
    red, edge = c("red"), c("red_edge_1")
    safe = F.when(red == 0, 0.001).otherwise(red)
    return (edge - red) / (edge + safe) + 0.5 * ((c("swir1") - red) / (c("swir1") + safe))


def _variant_4(c):
    safe = F.when(c("red") == 0, 0.001).otherwise(c("red"))
    return (c("nir") - c("red")) / (c("nir") + safe) * (c("green") / safe)


def _band_pair_confidence(c):
    a, b = c("nir"), c("red")
    spread = F.abs(a - b) / 2  # population deviation of two values
    return F.tanh(F.abs(a - b) / (spread + EPS) / 10)


# name -> (bands needed, builder)
INDICES = {
    "ndvi": (("nir", "red"), lambda c: ratio_difference(c("nir"), c("red"))),
    "ndre1": (("red_edge_1", "red"), lambda c: ratio_difference(c("red_edge_1"), c("red"))),
    "ndre3": (("red_edge_3", "red"), lambda c: ratio_difference(c("red_edge_3"), c("red"))),
    "avi": (("red_edge_3", "red_edge_1"), lambda c: ratio_difference(c("red_edge_3"), c("red_edge_1"))),
    "terra_preta": (("nir", "swir1"), lambda c: ratio_difference(c("nir"), c("swir1"))),
    "terra_preta_enhanced": (("red_edge_3", "swir1"), lambda c: ratio_difference(c("red_edge_3"), c("swir1"))),
    "clay_minerals": (("swir1", "swir2"), lambda c: c("swir1") / (c("swir2") + EPS)),
    "ndii": (("nir", "swir1"), lambda c: ratio_difference(c("nir"), c("swir1"))),
    "ndwi": (("green", "nir"), lambda c: ratio_difference(c("green"), c("nir"))),
    "brightness": (
        ("blue", "green", "red"),
        lambda c: F.sqrt((c("blue") * c("blue") + c("green") * c("green") + c("red") * c("red")) / 3),
    ),
    "crop_mark": (
        ("red_edge_1", "red", "nir"),
        lambda c: ((c("red_edge_1") - c("red")) * (c("nir") - c("red_edge_1")))
        / ((c("red_edge_1") + c("red")) * (c("nir") + c("red_edge_1")) + EPS),
    ),
    "s2_archaeological": (("red_edge_1", "red_edge_3", "swir1"), lambda c: ratio_difference(_re_mean(c), c("swir1"))),
    "band_pair_confidence": (("nir", "red"), _band_pair_confidence),
    "evi": (
        ("nir", "red", "blue"),
        lambda c: 2.5 * (c("nir") - c("red")) / (c("nir") + 6.0 * c("red") - 7.5 * c("blue") + 1.0 + EPS),
    ),
    "mndwi": (("green", "swir1"), lambda c: ratio_difference(c("green"), c("swir1"))),
    "ndsi": (("swir1", "red"), lambda c: ratio_difference(c("swir1"), c("red"))),
    "greenness": (
        ("blue", "green", "red", "nir"),
        lambda c: -0.2848 * c("blue") - 0.2435 * c("green") - 0.5436 * c("red") + 0.7243 * c("nir"),
    ),
    "terra_preta_8band": (("red_edge_1", "red", "swir1"), _variant_8),
    "terra_preta_4band": (("nir", "red", "green"), _variant_4),
    "moisture": (("nir", "swir1"), lambda c: ratio_difference(c("nir"), c("swir1"))),
}

SUITE = [
    "ndvi", "ndre1", "ndre3", "avi", "terra_preta", "terra_preta_enhanced", "clay_minerals", "ndii", "ndwi",
    "brightness", "crop_mark", "s2_archaeological",
]


def index(name: str) -> Column:
    return INDICES[name][1](F.col)


def with_indices(pixels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add every requested index whose bands the table has, in one projection."""
    have = set(pixels.columns)
    usable = [n for n in (names or SUITE) if set(INDICES[n][0]) <= have]
    return pixels.select("*", *[index(n).alias(n) for n in usable])


def scaled_reflectance(dn: Column, nodata: float | None = None, sensor: str = "sentinel2") -> Column:
    """Digital numbers to reflectance clipped to [0, 1]; nodata becomes NULL."""
    v = dn / 10000.0 if sensor == "sentinel2" else dn * 0.0000275 - 0.2
    clipped = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return clipped if nodata is None else F.when(dn != nodata, clipped)
