"""Rows that must not end a job: constant layers and malformed feature properties."""

from pyspark.sql import functions as F

from terraloom.functions.geo import ring_centroid
from terraloom.operators.depression import index_significance
from terraloom.sources import readers


def test_constant_layer(spark):
    pixels = spark.range(120).select((F.col("id") % 2).alias("scene_id"), (F.col("id") % 2 * 0.5).alias("v"))
    got = {r["scene_id"]: r for r in index_significance(pixels, "v", ["scene_id"]).collect()}
    assert (got[0]["p_value"], got[0]["significance"]) == (1.0, "LOW")
    assert (got[1]["p_value"], got[1]["significance"]) == (0.0, "HIGH")


def test_malformed_properties(spark):
    kind = "struct<type:string,coordinates:string>"
    rows = spark.createDataFrame(
        [(("Point", "[-53.1, -12.2]"), {"id": "a", "confidence": "N/A"}), (("Point", "[]"), {"id": "b"}),
         (("Polygon", "[[[-53.1, -12.2], [-53.0, -12.2], [-53.0, -12.1]]]"), {"id": "c", "geo_center_calculated": "unknown", "area_m2": "n/a"})],
        f"geometry {kind}, properties map<string,string>",
    )
    got = {r["id"]: r for r in readers.feature_rows(rows).collect()}
    assert got["a"]["confidence"] == 0.6
    assert "b" not in got


def test_flat_ring(spark):
    corners = [[(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)]]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(corners)], "k int, ring array<struct<lon:double,lat:double>>")
    got = [tuple(r["p"]) for r in rows.select("k", ring_centroid(F.col("ring")).alias("p")).orderBy("k").collect()]
    assert got == [(2.0, 0.0), (1.0, 1.0)]
