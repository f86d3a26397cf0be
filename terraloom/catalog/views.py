"""The observation tables, defined over the driver tables in SQL both engines accept."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEW_SQL = {
    "zones": """
SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS zone_name,
  CASE n_nationkey % 4 WHEN 0 THEN 'forested_buried_sites' WHEN 1 THEN 'deforested_visible_earthworks' WHEN 2 THEN 'deep_forest_isolation' ELSE 'other' END AS zone_type,
  CAST(1 + n_nationkey % 3 AS INT) AS priority,
  -12.29E0 + 0.2E0 * CAST(floor(n_nationkey / 5.0E0) AS INT) AS south, -53.17E0 + 0.2E0 * (n_nationkey % 5) AS west,
  -12.29E0 + 0.2E0 * CAST(floor(n_nationkey / 5.0E0) AS INT) + 0.18E0 AS north, -53.17E0 + 0.2E0 * (n_nationkey % 5) + 0.14E0 AS east
FROM {nation}""",
    "shots": """
SELECT event_id AS shot_number, user_id % 25 AS zone_id, CAST(event_id % 8 AS INT) AS beam, ts,
  -53.17E0 + 0.2E0 * ((user_id % 25) % 5) + ((event_id * 7919) % 1400) / 10000.0E0 AS lon,
  -12.29E0 + 0.2E0 * CAST(floor((user_id % 25) / 5.0E0) AS INT) + ((event_id * 104729) % 1800) / 10000.0E0 AS lat,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 100.0E0 + ((event_id * 31) % 400) / 10.0E0 + CASE WHEN event_id % 41 = 0 THEN 150.0E0 WHEN event_id % 43 = 0 THEN -150.0E0 ELSE 0.0E0 END END AS elevation_ground,
  value / 10.0E0 AS rh100, value / 10.0E0 * 0.9E0 AS rh95,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INT) AS quality_flag
FROM {events}""",
    "pixels": """
SELECT scene_id, r AS pix_row, c AS pix_col,
  0.05E0 + n1 * 0.02E0 AS blue, 0.08E0 + n1 * 0.02E0 AS green, 0.06E0 + n2 * 0.02E0 AS red,
  CASE WHEN blob THEN 0.14E0 ELSE 0.09E0 END + n1 * 0.02E0 AS red_edge_1,
  CASE WHEN blob THEN CASE WHEN (scene_id + CAST(floor(r / 9.0E0) AS INT)) % 2 = 0 THEN 0.40E0 ELSE 0.30E0 END ELSE 0.25E0 END + n2 * 0.02E0 AS red_edge_3,
  CASE WHEN blob THEN 0.25E0 ELSE 0.35E0 END + n1 * 0.02E0 AS nir,
  CASE WHEN blob THEN 0.19E0 ELSE 0.22E0 END + n2 * 0.02E0 AS swir1, 0.12E0 + n1 * 0.02E0 AS swir2
FROM (SELECT scene_id, r, c, n1, n2, ((CAST(floor(r / 9.0E0) AS INT) * 7 + CAST(floor(c / 11.0E0) AS INT) * 5 + scene_id) % 3 = 0 AND r % 9 < 7 AND c % 11 < 8) AS blob
 FROM (SELECT CAST(floor(o_orderkey / 2500.0E0) AS BIGINT) AS scene_id, CAST(floor((o_orderkey % 2500) / 50.0E0) AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c,
   ((o_orderkey * 7919) % 1000) / 1000.0E0 AS n1, ((o_orderkey * 104729) % 1000) / 1000.0E0 AS n2 FROM {orders}) a) b""",
    "detections": """
SELECT c_custkey AS det_id, CAST(c_nationkey AS BIGINT) AS zone_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'gedi' ELSE 'sentinel2' END AS provider,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'gedi_clearing' ELSE 'gedi_earthwork' END
       ELSE CASE c_custkey % 5 WHEN 0 THEN 'terra_preta' WHEN 1 THEN 'crop_mark_positive' WHEN 2 THEN 'circle' WHEN 3 THEN 'line' ELSE 'rectangle' END END AS det_type,
  -53.17E0 + 0.2E0 * (c_nationkey % 5) + ((c_custkey * 7919) % 1400) / 50000.0E0 + (c_custkey % 7) / 10000.0E0 AS lon,
  -12.29E0 + 0.2E0 * CAST(floor(c_nationkey / 5.0E0) AS INT) + ((c_custkey * 104729) % 1800) / 50000.0E0 + (c_custkey % 11) / 10000.0E0 AS lat,
  CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE ((c_custkey * 37) % 1000) / 1000.0E0 END AS confidence,
  ((c_custkey * 6151) % 120000) / 1.0E0 AS area_m2, CAST((c_custkey * 13) % 120 AS INT) AS n_points,
  ((c_custkey * 29) % 1800) / 10.0E0 AS angle_degrees, ((c_custkey * 53) % 6000) / 1.0E0 AS length_m,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS grade
FROM {customer}""",
    "scenes": """
SELECT p_partkey AS scene_id, p_partkey % 25 AS zone_id, ((p_partkey * 7919) % 1000) / 10.0E0 AS cloud_cover,
  -53.27E0 + 0.2E0 * ((p_partkey % 25) % 5) + ((p_partkey * 31) % 100) / 1000.0E0 AS west, -12.39E0 + 0.2E0 * CAST(floor((p_partkey % 25) / 5.0E0) AS INT) + ((p_partkey * 17) % 100) / 1000.0E0 AS south,
  -53.27E0 + 0.2E0 * ((p_partkey % 25) % 5) + ((p_partkey * 31) % 100) / 1000.0E0 + 0.3E0 AS east, -12.39E0 + 0.2E0 * CAST(floor((p_partkey % 25) / 5.0E0) AS INT) + ((p_partkey * 17) % 100) / 1000.0E0 + 0.3E0 AS north,
  CAST(1 + (p_partkey * 7) % 12 AS INT) AS acq_month
FROM {part}""",
}
BASE_TABLE = {"zones": "nation", "shots": "events", "pixels": "orders", "detections": "customer", "scenes": "part"}


class Views:
    """Lazy access to the driver tables and the observation views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        base = BASE_TABLE[name]
        return self.spark.sql(VIEW_SQL[name], **{base: self.table(base)})

    @cached_property
    def zones(self) -> DataFrame:
        return self._view("zones")

    @cached_property
    def shots(self) -> DataFrame:
        return self._view("shots")

    @cached_property
    def pixels(self) -> DataFrame:
        return self._view("pixels")

    @cached_property
    def detections(self) -> DataFrame:
        return self._view("detections")

    @cached_property
    def scenes(self) -> DataFrame:
        return self._view("scenes")

    def sql(self, text: str) -> DataFrame:
        """Input tables derived with SQL; ``{name}`` stands for a view."""
        used = {n: self._view(n) for n in VIEW_SQL if "{" + n + "}" in text}
        return self.spark.sql(text, **used)
