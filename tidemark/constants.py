"""Fixed values of the engine: thresholds, windows and tiers."""

RISING, BOOM, FALLING = 10.0, 40.0, -10.0
MIN_BASE, MIN_COUNT = 10, 4
MARGIN, TOP_N = 2.0, 3
MIN_WEIGHT = {"t1": 15.0, "t2": 8.0, "t3": 8.0, "t4": 500.0}
TIERS = ("t1", "t2", "t3", "t4")
STAGE_RANK = {"emerging": 5, "early": 4, "building": 3, "mainstream": 2, "cooling": 1, "quiet": 0, "nodata": 0}
HORIZON_DAYS, MATURITY_WINDOW_DAYS, CONFIRM_GAP_DAYS = 365, 45, 7

# Onset estimator.
K_SMOOTH, Z_TRIGGER, Z_SUSTAIN, SUSTAIN_MONTHS = 3.0, 3.0, 1.5, 3
BASELINE_N, MIN_SD, GROWTH_X, TRIM_FRAC, LOW_COUNT = 24, 0.02, 1.5, 0.6, 36.0
FLOORS = {"T1": 120.0, "T2": 12.0, "T3": 6.0, "T4": 500.0}
PUBLICATION_LAG = {"T1": 0, "T2": 0, "T3": 1, "T4": 3}

# Discovery.
MIN_OPERATORS, MAX_MENTIONS_PER_OPERATOR, Z_MIN, MIN_REGIONS = 6, 3.0, 2.4, 3
LIFT_CAP, YOY_CAP, W_LIFT, W_YOY, W_MONOTONE, W_NOVELTY, CTX_BONUS, W_SELF_CLINICAL = 8.0, 8.0, 0.45, 0.35, 0.6, 1.5, 0.15, 0.3
MAX_ROWS = 40

# Market structure.
MIN_TARGETS, THIN_TARGETS = 30, 100
HHI_CONCENTRATED, HHI_MODERATE = 0.20, 0.10
MAX_ADDRESS_GROUP, MAX_DIRECTOR_GROUP = 4, 25
SPV_MIN_CLUSTER, SPV_WINDOW_DAYS, FORMULAIC_MIN = 4, 120, 4
ENTRY_HOT, ENTRY_WARM = 0.15, 0.08
PANEL_GRACE_MONTHS = 3
