"""Fixed values that must equal the original application's for equal results.

All values below are stated plainly and in their natural order; they are the
behavioural contract (weights, thresholds, plans, texts, boxes), not logic.
"""

# --- fixed values: default fills for the incident history -----------------
DEFAULT_PRIORITY = "Low"
DEFAULT_CORRIDOR = "Non-corridor"
DEFAULT_STATION = "Unknown"
DEFAULT_CAUSE = "others"
DEFAULT_CLOSURE = False
UNKNOWN = "Unknown"

# --- fixed values: feedback feature defaults (event_type, cause, closure,
# priority, corridor, station, hour, day_of_week) ----------------------------
FEEDBACK_DEFAULTS = {
    "event_type": "unplanned",
    "event_cause": "others",
    "requires_road_closure": False,
    "priority": "Low",
    "corridor": "Non-corridor",
    "police_station": "Unknown",
    "hour": 12,
    "day_of_week": 1,
}

# --- fixed values: bounding boxes (strict inequalities) ---------------------
# (lat_min, lat_max, lng_min, lng_max)
TIGHT_BOX = (12.8, 13.2, 77.4, 77.8)
WIDE_BOX = (12.0, 14.0, 77.0, 78.5)

# --- fixed values: peak hours ------------------------------------------------
PEAK_HOURS = (8, 9, 10, 11, 17, 18, 19, 20)

# --- fixed values: training cause weights (unlisted cause -> 2) -------------
CAUSE_WEIGHTS = {
    "accident": 4,
    "protest": 5,
    "procession": 4,
    "public_event": 5,
    "vip_movement": 5,
    "water_logging": 4,
    "tree_fall": 3,
    "construction": 3,
    "pot_holes": 2,
    "road_conditions": 2,
    "congestion": 3,
    "vehicle_breakdown": 2,
    "others": 2,
}
DEFAULT_CAUSE_WEIGHT = 2

# --- fixed values: display (attribution) cause weights, unlisted -> 20 ------
DISPLAY_CAUSE_WEIGHTS = {
    "accident": 40,
    "protest": 50,
    "procession": 40,
    "public_event": 50,
    "vip_movement": 50,
    "water_logging": 40,
    "tree_fall": 30,
    "construction": 35,
    "pot_holes": 20,
    "road_conditions": 20,
    "congestion": 30,
    "vehicle_breakdown": 25,
    "others": 20,
}
DEFAULT_DISPLAY_WEIGHT = 20

# --- fixed values: score multipliers ----------------------------------------
PRIORITY_MULT = 1.3
CLOSURE_MULT = 1.5
CORRIDOR_MULT = 1.2
PEAK_MULT = 1.2

# --- fixed values: attribution shares of the base weight --------------------
ATTR_PEAK = 0.25
ATTR_CLOSURE = 0.50
ATTR_PRIORITY = 0.30
ATTR_CORRIDOR = 0.20
ATTR_NON_CORRIDOR = 0.05

# --- fixed values: severity thresholds (score < 3 Low, < 5 Medium, < 7 High,
# else Critical) --------------------------------------------------------------
SEVERITY_BOUNDS = ((3.0, "Low"), (5.0, "Medium"), (7.0, "High"))
SEVERITY_TOP = "Critical"
SEVERITY_LEVELS = ("Low", "Medium", "High", "Critical")

# --- fixed values: resource plan per severity -------------------------------
# severity, officers, barricades, diversion, barricade text, diversion text
RESOURCE_PLAN = (
    ("Low", 2, 0, False,
     "No barricades required. Maintain free flow.",
     "No traffic diversion required. Direct flow along normal paths."),
    ("Medium", 4, 5, True,
     "Setup minor warning barricades 50m upstream of incident.",
     "Lane merges advised. Divert slow-moving traffic to service lanes if available."),
    ("High", 8, 15, True,
     "Channelize traffic using heavy barricades 100m and 200m upstream. Create visual blocker.",
     "Implement partial detour. Divert vehicles around the block."),
    ("Critical", 15, 30, True,
     "Establish complete blockades. Deploy hazard reflective panels at core incident site and upstream exit points.",
     "Full segment closure. Divert all major traffic streams to adjacent corridors."),
)
PLAN_FALLBACK = "Critical"

# --- fixed values: action scope text per severity (anything else -> Medium's)
SCOPE_TEXT = {
    "Critical": "Full Segment Closure",
    "High": "Partial Detour / Diversion",
    "Medium": "Lane Merge / Advisory",
    "Low": "Ad-hoc Ground Monitoring",
}
SCOPE_DEFAULT = "Lane Merge / Advisory"

# --- fixed values: junction fallback when no history matches ----------------
FALLBACK_JUNCTIONS = ("Mekhri Circle", "Richmond Circle", "Silk Board Junction")

# --- fixed values: station default centroid ---------------------------------
DEFAULT_CENTROID = ("default", 12.9716, 77.5946)

# --- fixed values: duration calibration -------------------------------------
# (cause, threshold, base, modulus); min duration 10.0, round to 1 dp
CALIBRATION = (
    ("vehicle_breakdown", 180.0, 45.0, 60.0),
    ("accident", 240.0, 60.0, 90.0),
)
MIN_DURATION = 10.0
DURATION_CAP_MIN = 2880.0

# --- fixed values: cause category by first matching substring ---------------
CAUSE_CATEGORIES = (
    ("accident", "accident"),
    ("protest", "protest"),
    ("water", "water"),
    ("construction", "construction"),
    ("breakdown", "breakdown"),
    ("other", "other"),
)
CAUSE_CATEGORY_DEFAULT = "generic"

# --- fixed values: geometry --------------------------------------------------
HULL_PAD = 0.015            # half side of the fallback square (degrees)
JURISDICTION_RADIUS_M = 2200.0
DEST_OFFSET = (0.0005, -0.001)   # destination = source + (dlat, dlng)
DETOUR_OFFSET = 0.002
DETOUR_ZERO_OFFSET = 0.0015
CURVE_STEP = 0.08
CURVE_STEPS = 13            # t = 0, 0.08, ... 0.96, then the end point
CURVE_OFFSET_FACTOR = 0.15
OFFSET_BASE_DIST = 0.005
OFFSET_STEP_DIST = 0.003
EXTENT_PAD = 0.2
PRIMARY_SHARE = 0.6
SECONDARY_SHARE = 0.4
EARTH_RADIUS_M = 6371000.0

# --- fixed values: learning ---------------------------------------------------
FEEDBACK_WEIGHT = 10.0
HISTORY_WEIGHT = 1.0
LEARNING_CURVE_START = 5
TEST_FRACTION_PREFIX = "3333"   # md5 prefix threshold: 0x3333/0x10000 = 20 %
SPLIT_SEED = 42
SAMPLE_SIZE = 120
SAMPLE_SEED = 42
FALLBACK_DURATION = 60.0
CATEGORICAL_FEATURES = ("event_type", "event_cause", "priority", "corridor", "police_station")
FEATURE_ORDER = ("event_type", "event_cause", "requires_road_closure", "priority", "corridor",
                 "police_station", "hour", "day_of_week", "is_peak_hour")
