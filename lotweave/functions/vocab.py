"""Fixed values. Results depend on these exact words, weights and thresholds."""

LAND_USES = ("residential", "commercial", "industrial", "green")
BUILT_USES = ("residential", "commercial", "industrial")

# Parcel id field orders, one per caller.
ID_ORDER_PLANNER = ("parcel_id", "parcelId", "APN", "apn", "PARCELID", "PARNO", "join_key", "id")
ID_ORDER_PROXIMITY = ("APN", "apn", "parcel_id", "parcelId", "PARCELID", "PARNO", "join_key", "id")
ID_ORDER_WORKSPACE = ("APN", "apn", "parcel_id", "parcelId", "PARCELID", "PARNO", "id", "OBJECTID")
ID_ORDER_METRICS = ("APN", "apn", "parcel_id", "PARCELID")

# Risk field orders, one per caller.
RISK_KEYS_PROXIMITY = (
    "xgb_risk_score", "rule_risk_score", "environmental_risk", "risk_score",
    "XGB_RISK_SCORE", "RULE_RISK_SCORE", "ENVIRONMENTAL_RISK", "RISK_SCORE",
)
RISK_KEYS_COMPATIBILITY = (
    "xgb_risk_score", "rule_risk_score", "environmental_risk", "risk_score", "risk_score_norm",
)
RISK_KEYS_EXPLANATION = ("environmental_risk", "xgb_risk_score", "rule_risk_score")
RISK_KEYS_COMPARISON = (
    "risk_score_norm", "environmental_risk", "risk_score", "xgb_risk_score", "rule_risk_score",
)
RISK_KEYS_AREA = ("risk_score_norm", "environmental_risk", "xgb_risk_score", "rule_risk_score")

# Hazard flag -> (weight, label, layer number order of the flag table).
RISK_WEIGHTS = {
    "has_flood": 0.25,
    "has_fault": 0.20,
    "has_liquefaction": 0.15,
    "is_steep": 0.15,
    "is_fire_zone": 0.15,
    "in_esa": 0.05,
    "in_mscp": 0.05,
}
RISK_LABELS = {
    "has_flood": "100-Year Floodplain",
    "has_fault": "Active Fault Zone",
    "has_liquefaction": "Liquefaction Risk",
    "is_steep": "Steep Slope (>25%)",
    "is_fire_zone": "Fire Hazard Severity",
    "in_esa": "Environmentally Sensitive Area",
    "in_mscp": "MSCP Habitat Coverage",
}
METRIC_HAZARD_FLAGS = ("has_flood", "has_fault", "has_liquefaction", "is_steep", "is_fire_zone")

# Proximity field aliases.
ZONING_KEYS_PROXIMITY = ("zoning", "ZONING", "zoning_code", "ZONE", "GP_LAND_USE", "land_use")
LAND_USE_KEYS_PROXIMITY = ("assigned_use", "land_use", "existing_land_use", "GP_LAND_USE", "best_use")
HAZARD_ALIASES = {
    "flood": ("has_flood", "hasFlood", "HAS_FLOOD", "flood", "FLOOD"),
    "fault": ("has_fault", "hasFault", "HAS_FAULT", "fault", "FAULT"),
    "liquefaction": (
        "has_liquefaction", "hasLiquefaction", "HAS_LIQUEFACTION", "liquefaction", "LIQUEFACTION",
    ),
    "steep_slope": ("is_steep", "isSteep", "IS_STEEP", "steep_slope", "STEEP_SLOPE"),
    "fire": ("is_fire_zone", "isFireZone", "IS_FIRE_ZONE", "fire_zone", "FIRE_ZONE"),
    "esa": ("in_esa", "inEsa", "IN_ESA", "esa", "ESA"),
    "mscp": ("in_mscp", "inMscp", "IN_MSCP", "mscp", "MSCP"),
}

# Area summary fields.
ZONE_KEYS_AREA = ("ZONING_CODE", "zoning_code", "zone", "zoning", "zone_code", "allowed_uses")
JURISDICTION_KEYS_AREA = ("jurisdiction", "JURISDICTION", "city", "CITY", "municipality", "county")
CONSTRAINTS = (  # (key, label, field, kind)
    ("steep", "Steep Slope", "is_steep", "hazard"),
    ("liquefaction", "Liquefaction", "has_liquefaction", "hazard"),
    ("flood", "Flood", "has_flood", "hazard"),
    ("fault", "Fault", "has_fault", "hazard"),
    ("fire", "Fire Zone", "is_fire_zone", "hazard"),
    ("esa", "ESA", "in_esa", "policy"),
    ("mscp", "MSCP", "in_mscp", "policy"),
)

# Truthy words per caller.
TRUE_WORDS_PROXIMITY = ("1", "true", "yes", "y", "t", "on")
TRUE_WORDS_REPORT = ("true", "yes", "y", "1", "active", "present")
TRUE_WORDS_AREA = ("1", "true", "yes", "y")
TRUE_WORDS_COMPARISON = ("true", "yes", "y", "1", "compatible")
FALSE_WORDS_COMPARISON = ("false", "no", "n", "0", "incompatible")

# Planner zoning keywords, substring match.
PLANNER_ZONING_KEYWORDS = {
    "residential": ("residential", "rs", "rm", "r-"),
    "commercial": ("commercial", "cn", "cc", "cg", "c-"),
    "industrial": ("industrial", "ig", "il", "ih", "i-"),
    "green": ("green", "open space", "park", "agri", "conservation"),
}
PLANNER_ZONING_FIELDS = ("ZONING_CODE", "GP_LAND_USE", "zoning_code", "gp_land_use")
COMPARISON_ZONING_FIELDS = ("zoning", "ZONING_CODE", "zoning_code", "GP_LAND_USE", "gp_land_use")

# Neighbour scoring: label aliases and the pair matrix.
COMPATIBILITY_ALIASES = {
    "res": "residential", "r": "residential", "housing": "residential",
    "house": "residential", "homes": "residential",
    "commercial": "commercial", "com": "commercial", "c": "commercial",
    "retail": "commercial", "mixed": "commercial", "mixeduse": "commercial",
    "mixed_use": "commercial", "mixed-use": "commercial",
    "industrial": "industrial", "ind": "industrial", "i": "industrial",
    "manufacturing": "industrial", "warehouse": "industrial", "warehousing": "industrial",
    "green": "green", "open_space": "green", "openspace": "green", "open-space": "green",
    "park": "green", "parks": "green", "conservation": "green",
    "recreation": "green", "recreational": "green",
}
COMPATIBILITY_PAIRS = {  # symmetric; pairs not listed score 0
    ("residential", "residential"): 2.0,
    ("residential", "commercial"): 0.5,
    ("residential", "industrial"): -4.0,
    ("residential", "green"): 1.0,
    ("commercial", "commercial"): 2.0,
    ("commercial", "industrial"): -1.0,
    ("industrial", "industrial"): 2.0,
    ("industrial", "green"): -2.0,
    ("green", "green"): 3.0,
}

# Substring buckets.
PROXIMITY_USE_WORDS = (
    ("residential", ("residential", "res", "housing", "dwelling", "single-family", "single family")),
    ("commercial", ("commercial", "retail", "office", "service", "mixed use", "mixed-use", "mixeduse")),
    ("industrial", ("industrial", "manufacturing", "warehouse", "distribution", "heavy")),
    ("green", ("green", "open space", "openspace", "park", "recreation", "agric", "conservation")),
)
COMPARISON_USE_WORDS = {
    "green": ("open_space", "conservation", "park", "green", "agri"),
    "residential": (
        "residential", "housing", "single_family", "multi_family", "multifamily", "duplex", "townhome",
    ),
    "commercial": ("commercial", "retail", "office"),
    "industrial": ("industrial", "warehouse", "manufacturing"),
}
MAP_USE_EXACT = {"residential": "res", "commercial": "com", "industrial": "ind"}

# Report hazard fields and their labels.
REPORT_HAZARD_LABELS = (
    ("has_flood", "Flood"), ("flood", "Flood"), ("floodplain", "Floodplain"),
    ("steep_slope", "Steep slope"), ("is_steep", "Steep slope"),
    ("fault", "Fault"), ("has_fault", "Fault"),
    ("liquefaction", "Liquefaction"), ("has_liquefaction", "Liquefaction"),
    ("fire", "Fire hazard"), ("fire_zone", "Fire hazard"), ("is_fire_zone", "Fire hazard"),
    ("esa", "Environmentally sensitive area"), ("in_esa", "Environmentally sensitive area"),
    ("mscp", "MSCP area"), ("in_mscp", "MSCP area"),
    ("protected", "Protected land"), ("sensitive", "Sensitive resource"),
)

# Assignment containers and field names.
ASSIGNMENT_KEYS = ("assignments", "assignment", "parcel_assignments")
ASSIGNMENT_ID_KEYS = ("parcel_id", "parcelId", "apn", "APN", "id", "parcel")
ASSIGNMENT_USE_KEYS = ("use_label", "assigned_use", "use", "land_use", "landUse", "label")
NEIGHBOUR_KEYS = (
    "neighbors", "neighbor_ids", "neighborIds", "adjacent_parcels", "adjacentParcelIds",
    "ADJACENT_PARCELS", "adjacency",
)

# Planning metrics.
UNIT_SIZE_M2 = 85.0
HOUSEHOLD_SIZE = 2.5
GREEN_TARGET_M2 = 9.0
TAX_PER_M2 = {"residential": 12.0, "commercial": 18.0, "industrial": 9.0, "green": 0.0}
DEFAULT_AREA_M2 = 500.0

# Target mix defaults for free text.
TEXT_MIX_DEFAULTS = {"residential": 0.4, "commercial": 0.2, "industrial": 0.1, "green": 0.3}

# Question routing words.
ROUTE_WORDS = (
    ("explain_risk", ("explain", "why", "factor", "cause", "attribute", "breakdown", "contribution",
                      "what causes")),
    ("analyze_environment", ("risk", "environment", "hazard", "flood", "fault", "slope", "fire", "esa",
                             "liquefaction", "suitability", "environmental", "danger", "unsafe")),
    ("query_zoning", ("zoning", "zone", "regulation", "code", "allowed", "permit", "use", "ordinance",
                      "compliance", "setback", "fsr", "far", "height limit", "residential",
                      "commercial", "industrial")),
    ("optimize_land_use", ("optimize", "optimise", "plan", "mix", "layout", "pareto", "allocation",
                           "assign", "land use", "generate", "suggest", "recommend", "best use")),
)

# Zone code patterns in order.
ZONE_PATTERNS = (
    ("Agricultural", r"\bA\d{2}\b"),
    ("Residential", r"\b(RS|RD|RM|RV|RU|RMH|RR|RRO|RC)[-\s]?\d*\b"),
    ("Commercial", r"\bC\d{2}\b"),
    ("Industrial", r"\bM\d{2}\b"),
    ("Special", r"\bS\d{2}\b"),
)
SECTION_PATTERNS = (r"(?i)§(131\.\d{4})", r"(?i)§(\d{4})", r"(?i)\bSection\s+(\d{4})\b")
SECTION_MARK = r"(?i)(§\d{4}|Section\s+\d{4})"
COUNTY = "San Diego County"
CITY = "City of San Diego"
COUNTY_MARKERS = ("unincorporated", "county of san diego", "county zoning ordinance")
CITY_MARKERS = ("municipal code", "city of san diego", "chapter 13")

# Zone parameters: code -> (height, far, lot size, uses).
ZONE_PARAMETERS = (
    ("RS-1-7", 30.0, 0.5, 7000.0, ("single-family", "accessory dwelling unit")),
    ("RS-1-14", 30.0, 0.45, 14000.0, ("single-family",)),
    ("RM-1-1", 30.0, 0.75, 5000.0, ("single-family", "duplex")),
    ("RM-3-7", 45.0, 1.5, 5000.0, ("multi-family", "townhomes")),
    ("CN-1-2", 30.0, 1.0, 5000.0, ("neighborhood commercial", "mixed-use")),
    ("CC-3-6", 65.0, 3.0, None, ("commercial", "office", "residential")),
)

# Model column names.
MODEL_COLUMNS = {
    "lon": "Longitude",
    "lat": "Latitude",
    "soil_sand_pct": "SandContent",
    "soil_clay_pct": "ClayContent",
    "aqi_mean": "AirQualityIndex",
    "impervious_mean": "ImperviousSurface",
}
FALLBACK_RANGES = {
    "soil_sand_pct": (10.0, 80.0),
    "soil_clay_pct": (5.0, 40.0),
    "aqi_mean": (20.0, 150.0),
    "impervious_mean": (0.0, 1.0),
}

# Notice line of answers given without the answering service.
NOTICE_TEXT = "Gemini API unavailable"

# Plan change labels, rules and sentences.
USE_TITLES = {
    "residential": "Residential", "commercial": "Commercial", "industrial": "Industrial",
    "green": "Green/Open Space",
}

# Objective tokens -> (label, explanation), first match wins; all tokens of a group are alternatives
# except the pair marked "all".
OBJECTIVE_MEANINGS = (
    ("any", ("environment", "risk"), "Environmental risk exposure",
     "Measures how much development is assigned to environmentally risky parcels. Lower is better."),
    ("any", ("zoning", "violation"), "Zoning violation penalty",
     "Measures possible mismatch between assigned land use and zoning/regulatory suitability. "
     "Lower is better."),
    ("all", ("green", "deviation"), "Green area deviation",
     "Measures how far the plan is from the requested green/open-space target. Lower is better."),
    ("any", ("fragment", "adjacency"), "Fragmentation penalty",
     "Measures whether similar land uses are scattered or spatially disconnected. Lower is better."),
    ("any", ("balance", "target_mix"), "Land use balance penalty",
     "Measures how far the actual land-use mix is from the requested target mix. Lower is better."),
)
OBJECTIVE_DEFAULT_TEXT = (
    "Optimization objective returned by the spatial planning model. Lower values are generally "
    "treated as better unless otherwise specified."
)
OBJECTIVE_TOKENS = {
    "risk": ("risk", "environment", "hazard"),
    "zoning": ("zoning", "violation", "compliance"),
    "compact": ("fragment", "compact", "adjacency"),
}

# Plan badges in priority order: (key, label, description).
BADGES = (
    ("overall", "Best Overall Tradeoff", "Best normalized balance across available objectives."),
    ("risk", "Safest Plan", "Lowest environmental risk exposure among generated plans."),
    ("target_mix", "Closest to Target Mix", "Most closely matches the requested land-use mix."),
    ("zoning", "Best Zoning Compliance", "Lowest zoning violation penalty among generated plans."),
    ("compact", "Most Compact / Least Fragmented", "Lowest fragmentation or adjacency penalty."),
    ("green", "Greenest Plan", "Highest share of green/conservation assignments."),
    ("development", "Most Development-Friendly", "Highest share of built-use assignments."),
)
BADGE_BUILT_USES = ("residential", "commercial", "industrial", "mixed_use")
BADGE_GREEN_USES = ("green", "open_space", "conservation", "park", "parks")

# Job steps with the progress reached when each one completes.
JOB_STEPS = (("environment", 30), ("zoning", 60), ("merge", 80), ("spatial", 100))
