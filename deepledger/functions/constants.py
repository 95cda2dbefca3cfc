"""Fixed values of the survey model."""

EARTH_RADIUS_M, DEGREE_M = 6371008.8, 111320.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563

MAX_SPEED_MPS, MIN_JUMP_M, GAP_S, EXACT_SYNC_S = 15.0, 50.0, 60.0, 1.0

CLASSES = ("wreck", "debris", "structure", "tire")

ASSOCIATION_WEIGHTS = {"class": 0.35, "geographic": 0.30, "frame": 0.15, "spatial": 0.20}
CLASS_PENALTY, GEO_PENALTY, SPATIAL_PENALTY = 0.35, 0.35, 0.50
FRAME_RAMP, DISTANCE_RAMP, OVERLAP_RAMP = (1.0, 8.0), (8.0, 40.0), (0.45, 0.95)
ACCEPT, AMBIGUITY = 0.62, 0.06

CONSISTENCY_M, CONSISTENCY_OVERLAP = 25.0, 0.55
LOCATION_FLOOR_M = 20.0

FUSION_WEIGHTS = {"detection": 0.30, "segmentation": 0.15, "natural": 0.20, "shadow": 0.15, "physics": 0.10, "consistency": 0.10}
GAIN, INTERCEPT = 3.2, -0.4
CONFIRM, REVIEW = 0.63, 0.45

PRIORITY_WEIGHTS = {"type": 0.20, "size": 0.10, "entanglement": 0.25, "environmental": 0.20, "confidence": 0.15, "location": 0.10}
#: class: (type, entanglement, environmental)
RISKS = {
    "wreck": (0.85, 0.45, 0.70),
    "structure": (0.55, 0.25, 0.40),
    "tire": (0.60, 0.30, 0.45),
    "debris": (0.60, 0.35, 0.60),
    "unknown_anomaly": (0.50, 0.50, 0.50),
    "unknown": (0.50, 0.40, 0.50),
}
TIERS = (("critical", 80.0), ("high", 60.0), ("medium", 40.0))

GRAZING_MIN, GRAZING_MAX = 8.0, 65.0
HEADING_SIGMA, GPS_SIGMA, GPS_SIGMA_MIN, RANGE_SIGMA, ALTITUDE_SIGMA, DRAWS = 2.0, 5.0, 0.5, 0.05, 0.05, 300
