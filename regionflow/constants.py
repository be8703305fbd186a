"""Names, tables and constants that results depend on."""

from __future__ import annotations

# --- Fixed values: actions (id, label, stringency, base cost) ---------------
ACTIONS = [
    (0, "None", 0.0, 0.0),
    (1, "Distancing", 0.4, 0.05),
    (2, "TravelBan", 0.6, 0.08),
    (3, "Lockdown", 0.8, 0.15),
    (4, "NormalCare", 0.1, 0.01),
    (5, "SurgeCare", 0.2, 0.06),
    (6, "TargetedVax", 0.1, 0.03),
    (7, "MassVax", 0.15, 0.05),
]
DISTANCING, TRAVEL_BAN, LOCKDOWN, SURGE_CARE = 1, 2, 3, 5
TARGETED_VAX, MASS_VAX = 6, 7
MAX_ACTION = 7

# --- Fixed values: region profiles ------------------------------------------
PROFILE_SCHEMA = (
    "entity STRING, pop BIGINT, lat DOUBLE, lon DOUBLE, beds_per_1k DOUBLE, "
    "beta_mul DOUBLE, ifr_mul DOUBLE, noise DOUBLE, density DOUBLE, gdp DOUBLE, "
    "healthcare DOUBLE, mobility DOUBLE, elderly DOUBLE, climate DOUBLE, "
    "connectivity DOUBLE, resilience DOUBLE"
)
PROFILES = [
    ("USA", 331000000, 39.8, -98.5, 2.9, 1.0, 1.0, 0.05, 36.0, 65000.0, 0.85, 0.9, 0.20, 0.7, 0.95, 0.9),
    ("Japan", 125000000, 36.2, 138.2, 13.1, 0.8, 0.9, 0.03, 347.0, 42000.0, 0.95, 0.6, 0.30, 0.5, 0.8, 0.8),
    ("India", 1380000000, 20.6, 78.9, 0.5, 1.3, 1.2, 0.08, 464.0, 2100.0, 0.3, 0.4, 0.07, 0.8, 0.4, 0.3),
    ("Italy", 60000000, 41.9, 12.6, 3.2, 1.1, 1.4, 0.04, 206.0, 35000.0, 0.8, 0.7, 0.28, 0.6, 0.85, 0.7),
    ("Germany", 83000000, 51.2, 10.5, 8.0, 0.9, 0.8, 0.03, 240.0, 46000.0, 0.9, 0.8, 0.25, 0.4, 0.9, 0.85),
    ("China", 1400000000, 35.9, 104.2, 4.3, 1.0, 1.0, 0.06, 153.0, 10500.0, 0.6, 0.5, 0.18, 0.7, 0.7, 0.6),
]
DEFAULT_PROFILE = {
    "pop": 50000000,
    "lat": 0.0,
    "lon": 0.0,
    "beds_per_1k": 3.0,
    "beta_mul": 1.0,
    "ifr_mul": 1.0,
    "noise": 0.05,
    "density": 100.0,
    "gdp": 30000.0,
    "healthcare": 0.7,
    "mobility": 0.8,
    "elderly": 0.15,
    "climate": 0.6,
    "connectivity": 0.8,
    "resilience": 0.7,
}

# --- Fixed values: the six regions of the connected world -------------------
WORLD_SCHEMA = (
    "idx INT, entity STRING, pop BIGINT, lat DOUBLE, lon DOUBLE, beds_per_1k DOUBLE, "
    "beta_mul DOUBLE, ifr_mul DOUBLE, noise DOUBLE"
)
WORLD = [
    (0, "USA", 330000000, 38.0, -97.0, 2.9, 1.00, 1.00, 0.05),
    (1, "Japan", 125000000, 36.0, 138.0, 7.8, 0.92, 0.90, 0.04),
    (2, "Italy", 60000000, 42.5, 12.5, 3.2, 0.98, 1.05, 0.05),
    (3, "India", 1420000000, 22.0, 79.0, 0.7, 1.05, 0.95, 0.06),
    (4, "Germany", 83000000, 51.0, 10.0, 8.0, 0.96, 0.95, 0.04),
    (5, "China", 1410000000, 35.0, 103.0, 4.3, 1.03, 1.00, 0.05),
]

# --- Fixed values: pair multipliers (a pair not listed has 1.0) -------------
PAIR_MULTIPLIERS = [
    ("China", "India", 1.8),
    ("India", "China", 1.2),
    ("USA", "Japan", 1.6),
    ("Japan", "USA", 1.6),
    ("Germany", "Italy", 1.3),
    ("Italy", "Germany", 1.2),
]

# --- Fixed values: region name in the results -> name in the source ---------
NAME_ALIASES = [
    ("China", "China"),
    ("Japan", "Japan"),
    ("India", "India"),
    ("Germany", "Germany"),
    ("Italy", "Italy"),
    ("USA", "United States"),
]

# --- Fixed values: targets used when no observations can be read ------------
DEFAULT_TARGETS = [
    ("Japan", 40.0, 10000.0),
    ("India", 55.0, 18000.0),
    ("Italy", 60.0, 8000.0),
    ("Germany", 58.0, 9000.0),
    ("USA", 52.0, 12000.0),
    ("China", 0.0, 35000.0),
]

# --- Fixed values: per-region multipliers of a run (beta, ifr, noise) -------
RUN_MULTIPLIERS = [
    ("China", 1.00, 0.90, 0.8),
    ("Japan", 0.75, 1.40, 0.9),
    ("India", 1.50, 1.30, 1.3),
    ("Germany", 0.80, 0.70, 0.7),
    ("Italy", 1.20, 1.60, 1.1),
    ("USA", 1.10, 1.00, 1.2),
]

# --- Fixed values: the calibration grid --------------------------------------
BETA_GRID = [0.24, 0.25, 0.26, 0.27]
TRAVEL_GRID = [0.5, 0.6, 0.7, 0.8, 0.9]
NO_CELL_BETA, NO_CELL_TRAVEL = 0.25, 1.0
NO_CELL_LOSS = 1.7976931348623157e308

# --- Fixed values: evaluation states (name, s, i, r, d, v, hosp_cap, t, t_max, seed)
EVALUATION_STATES = [
    ("Early", 990000.0, 10000.0, 0.0, 0.0, 5000.0, 10000.0, 0, 200, 0),
    ("Peak", 800000.0, 150000.0, 30000.0, 10000.0, 50000.0, 10000.0, 0, 200, 0),
    ("Control", 300000.0, 1000.0, 650000.0, 10000.0, 800000.0, 10000.0, 0, 200, 0),
    ("Overflow", 600000.0, 250000.0, 100000.0, 20000.0, 100000.0, 10000.0, 0, 200, 0),
]

# --- Fixed values: bands, as (lower bound, value when above it), then the rest
HEALTH_WEIGHT_MAIN = ([(0.8, 0.2), (0.5, 0.6)], 0.9)
HEALTH_WEIGHT_COUNTRY = ([(0.8, 0.3), (0.5, 0.5)], 0.7)
HEALTHCARE_FACTOR = ([(0.8, 0.2), (0.5, 1.0)], 8.0)
GDP_FACTOR = ([(50000.0, 0.3), (20000.0, 1.0), (5000.0, 2.5)], 5.0)
GDP_COST_FACTOR = ([(50000.0, 0.3), (20000.0, 1.0), (5000.0, 3.0)], 8.0)
DENSITY_FACTOR = ([(400.0, 3.0), (200.0, 2.0), (100.0, 1.0)], 0.5)

# --- Fixed values: base rates -------------------------------------------------
BASE_BETA, BASE_GAMMA, BASE_IFR, BASE_NOISE = 0.35, 0.12, 0.008, 0.05
REWARD_CLIP = 5.0
EARTH_RADIUS_KM = 6371.0
ONE_HOP_RATE = 0.004
