"""Vendors' drawing habits, as a dimension of a few rows over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: defaults, and what each vendor's profile says otherwise ---------------------
DEFAULTS: dict[str, object] = {
    "black_threshold": 0.15, "min_points": 50, "min_size_ratio": 0.15, "max_traces": 15,
    "line_straightness": 1.5, "min_h_fraction": 0.15, "min_v_fraction": 0.15, "dedup_distance": 0.8, "major_threshold": 8.0, "min_lines": 3,
    "pulse_min_points": 4, "pulse_max_points": 100, "pulse_tolerance": 0.15,
    "monotone_share": 0.8, "monotone_tolerance": 0.5, "col_fraction": 0.10, "row_fraction": 0.08, "wide_fraction": 0.6,
    "expected_layout": None, "rhythm_ratio": 1.8, "forced_rotation": None, "weld": False,
}
VENDORS: dict[str, dict[str, object]] = {
    "GE MUSE": {"expected_layout": "sequential_6x2", "pulse_min_points": 10, "pulse_max_points": 80},
    "Schiller": {"expected_layout": "stacked_12x1", "min_points": 30, "min_size_ratio": 0.10},
    "Schiller CS": {"min_points": 20, "min_size_ratio": 0.08},
    "Mortara/Burdick": {"expected_layout": "grid_4x3", "line_straightness": 2.0, "dedup_distance": 1.2, "rhythm_ratio": 1.6},
    "PTB-XL": {},
    "Vectracor": {"weld": True, "forced_rotation": 90, "min_size_ratio": 0.05},
    "AMPS-LLC": {"weld": True, "min_size_ratio": 0.05},
}
# --- end of fixed values -----------------------------------------------------------------------
SCHEMA = "vendor string, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string' if k == 'expected_layout' else 'int'}" for k, v in DEFAULTS.items())


def profiles(spark: SparkSession, extra: dict[str, dict[str, object]] | None = None) -> DataFrame:
    """One row per vendor, complete; extra profiles are laid over the known ones, by field."""
    merged = {name: DEFAULTS | VENDORS.get(name, {}) | (extra or {}).get(name, {}) for name in [*VENDORS, "Unknown", *(extra or {})]}
    return spark.createDataFrame([(name, *(p[k] for k in DEFAULTS)) for name, p in merged.items()], SCHEMA)
