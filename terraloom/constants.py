"""Thresholds, weights, zones, reference areas and band names.

Everything here is a value that results depend on, kept together and in natural order.
"""

EPS = 1e-8

# Band code -> band name; positional order of an unlabelled stack.
BAND_NAMES = {
    "B02": "blue", "B03": "green", "B04": "red", "B05": "red_edge_1", "B06": "red_edge_2",
    "B07": "red_edge_3", "B08": "nir", "B11": "swir1", "B12": "swir2",
}
BAND_ORDER = ["B02", "B03", "B04", "B08", "B05", "B07", "B11", "B12"]
ESSENTIAL_BANDS = ["B02", "B03", "B04", "B08"]

# Threshold presets.
PRESETS = {
    "original": dict(
        tp_base=0.12, tp_enhanced=0.12, ndvi_min=0.35, depression_min=0.2, ndre1_min=0.15,
        min_area_m2=2000.0, max_area_m2=1000000.0, min_patch_px=3, base_confidence=0.75, strength_min=0.35,
        max_aspect=10.0, gap_threshold_m=15.0, min_cluster_size=5, cluster_eps=0.001, max_feature_km2=50.0,
        anomaly_sigma=2.0, min_mound_size=2, mound_eps=0.002, clearing_confidence=0.8,
        eventual_confidence=0.50, probable_confidence=0.60, max_density_varzea=15.0, max_density_terra_firme=1.0,
        min_density=0.1,
    ),
    "archaeological": dict(
        tp_base=0.25, tp_enhanced=0.30, ndvi_min=0.45, depression_min=0.4, ndre1_min=0.25,
        min_area_m2=50000.0, max_area_m2=4000000.0, min_patch_px=20, base_confidence=0.80, strength_min=0.55,
        max_aspect=4.0, gap_threshold_m=12.0, min_cluster_size=3, cluster_eps=0.002, max_feature_km2=10.0,
        anomaly_sigma=2.5, min_mound_size=3, mound_eps=0.0015, clearing_confidence=0.75,
        eventual_confidence=0.50, probable_confidence=0.60, max_density_varzea=50.0, max_density_terra_firme=5.0,
        min_density=0.01,
    ),
    "experimental": dict(
        tp_base=0.35, tp_enhanced=0.40, ndvi_min=0.55, depression_min=0.5, ndre1_min=0.35,
        min_area_m2=100000.0, max_area_m2=250000.0, min_patch_px=50, base_confidence=0.85, strength_min=0.70,
        max_aspect=3.0, gap_threshold_m=10.0, min_cluster_size=5, cluster_eps=0.0015, max_feature_km2=5.0,
        anomaly_sigma=3.0, min_mound_size=4, mound_eps=0.001, clearing_confidence=0.70,
        eventual_confidence=0.50, probable_confidence=0.60, max_density_varzea=20.0, max_density_terra_firme=2.0,
        min_density=0.001,
    ),
}
PRESETS["fast"] = dict(PRESETS["archaeological"], tp_enhanced=0.12, ndvi_min=0.3, ndre1_min=0.1, gap_threshold_m=15.0)
FAST_NDVI_MAX = 0.8

# Per zone type: crop-mark threshold, terra-preta threshold, minimum geometric size, density factor.
ZONE_TYPE_CONFIG = {
    "deep_forest_isolation": (0.06, 0.15, 10, 1.0),
    "cloud_forest_isolation": (0.06, 0.15, 10, 1.0),
    "deforested_visible_earthworks": (0.12, 0.15, 50, 2.0),
    "forested_buried_sites": (0.06, 0.15, 10, 1.0),
}
DEFAULT_ZONE_TYPE = "forested_buried_sites"

# Survey zones: id, name, centre lat, centre lon, south, west, north, east, priority, radius km, min m, max m, type.
SURVEY_ZONES = [
    ("xingu_deep_forest", "Xingu Deep Forest - Protected Interior", -12.2, -53.1, -12.29, -53.17, -12.11, -53.03, 1, 7.0, 40, 300, "deep_forest_isolation"),
    ("acre_capixaba_gap", "Acre-Capixaba Archaeological Gap", -9.2456, -67.8934, -9.3156, -67.9634, -9.1756, -67.8234, 1, 7.0, 100, 800, "cultural_corridor"),
    ("negro_madeira_interfluve", "Negro–Madeira Interfluve – Strategic Central Gap", -4.1, -62.8, -4.19, -62.89, -4.01, -62.71, 2, 7.0, 30, 800, "technology_optimal"),
    ("acre_corridor_gap", "Southern Acre - Geoglyph Corridor Gap", -11.0, -68.9, -11.07, -68.97, -10.93, -68.83, 1, 7.0, 30, 800, "deforested_visible_earthworks"),
    ("bolivian_pantanal_edge", "Bolivian Pantanal Edge - Seasonal Settlement Zone", -16.0, -60.0, -16.07, -60.07, -15.93, -59.93, 3, 7.0, 30, 600, "forested_buried_sites"),
    ("upper_napo_quijos", "Upper Napo Quijos - Terra Preta Archaeological Complex", -0.4876, -76.8234, -0.5576, -76.8934, -0.4176, -76.7534, 1, 7.0, 30, 400, "confirmed_extension"),
    ("envira_humaita_bridge", "Envira-Humaitá Cultural Bridge", -7.8234, -66.4567, -7.8934, -66.5267, -7.7534, -66.3867, 1, 7.0, 80, 600, "environmental_optimal"),
    ("guapore_lamego_complex", "Guaporé-Lamego Archaeological Complex", -12.5678, -63.2345, -12.6378, -63.3045, -12.4978, -63.1645, 2, 7.0, 120, 1000, "confirmed_extension"),
    ("labrea_terra_preta_belt", "Lábrea Terra Preta Belt", -7.2345, -64.7890, -7.3045, -64.8590, -7.1645, -64.7190, 1, 7.0, 60, 500, "forested_buried_sites"),
    ("xingu_iriri_plateau", "Xingu-Iriri Plateau Interface", -8.9876, -55.1234, -9.0576, -55.1934, -8.9176, -55.0534, 2, 7.0, 40, 300, "technology_optimal"),
    ("upper_purus_peru", "Upper Purus Peru Extension", -9.3456, -70.8901, -9.4156, -70.9601, -9.2756, -70.8201, 1, 7.0, 150, 1200, "environmental_optimal"),
    ("mojos_east_extension", "Mojos Eastern Extension", -14.7890, -64.5678, -14.8590, -64.6378, -14.7190, -64.4978, 2, 7.0, 200, 1500, "confirmed_extension"),
]

# Known sites and control areas: name, lat, lon, radius km, type, confidence, is control.
REFERENCE_AREAS = [
    ("Example Known Site 1", -0.48, -72.52, 0.5, "confirmed_settlement", 1.0, False),
    ("Example Known Site 2", -0.46, -72.54, 0.3, "confirmed_earthworks", 1.0, False),
    ("Modern Settlement", -0.45, -72.50, 1.0, "modern_infrastructure", 1.0, True),
    ("Natural Forest", -0.52, -72.48, 2.0, "pristine_forest", 1.0, True),
    ("Lago Agrio Oil Field", 0.085, -76.894, 5.0, "oil_infrastructure", 0.95, True),
    ("Shushufindi Oil Field", -0.160, -76.895, 3.0, "oil_infrastructure", 0.95, True),
    ("Cuyabeno Wetlands", -0.5, -76.0, 10.0, "wetland", 0.9, True),
    ("Yasuní Wetlands", -1.0, -76.0, 15.0, "wetland", 0.9, True),
    ("Infrastructure Exclusion Zone 1", -0.485, -72.515, 0.1, "modern_infrastructure", 1.0, True),
    ("Infrastructure Exclusion Zone 2", -0.495, -72.505, 0.1, "modern_infrastructure", 1.0, True),
]

# Regions.
AMAZON_BOUNDS = dict(west=-80.0, east=-44.0, south=-20.0, north=10.0)
MAP_REGION = dict(west=-84.0, east=-44.0, south=-18.0, north=5.0)
FALLBACK_LON, FALLBACK_LAT = -60.0, -3.0

# Evidence scoring.
WEIGHT_GEOMETRIC, WEIGHT_TERRA_PRETA, WEIGHT_ENVIRONMENT, WEIGHT_PRIORITY = 3.0, 2.0, 1.0, 1.0
MAX_GEOMETRIC, MAX_TOTAL = 6.0, 13.0
CLASS_HIGH, CLASS_PROBABLE, CLASS_POSSIBLE = 10.0, 7.0, 4.0
CLASS_LABELS = (
    "HIGH CONFIDENCE ARCHAEOLOGICAL SITE", "PROBABLE ARCHAEOLOGICAL FEATURE",
    "POSSIBLE ANOMALY - INVESTIGATE", "NATURAL VARIATION",
)

# Site-confidence fusion.
BASELINE_MEAN, BASELINE_STD = 0.12, 0.18
SENSOR_WEIGHTS = dict(lidar=0.35, spectral=0.35, temporal=0.20, bonus=0.10)

# Geometry.
EARTH_RADIUS_M = 6371000.0
DEG_M = 111000.0
FOOTPRINT_RADIUS_M = 12.5
PIXEL_AREA_M2 = 100.0

# Export confidence gates.
EXPORT_MIN_LIDAR, EXPORT_MIN_SPECTRAL, EXPORT_MIN_COMBINED = 0.40, 0.50, 0.50
