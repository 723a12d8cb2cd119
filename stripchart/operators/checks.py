"""Checks of stored arrays and of image sizes, as lists of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the keys of a stored page ---------------------------------------------------
METADATA = ["layout_type", "channel_names", "speed_mm_per_s", "gain_mm_per_mV", "page_width_px", "page_height_px", "nomenclature_periph", "nomenclature_precord"]
GRID = ["grid_major_x", "grid_major_y", "grid_minor_x", "grid_minor_y", "grid_x_range", "grid_y_range", "grid_major_5mm", "grid_minor_1mm"]
MAPS = ["map_forward_x", "map_forward_y", "map_inverse_x", "map_inverse_y"]
LABELS = ["label_centers", "label_names"]
SIGNAL, RESAMPLED, AUGMENTED = "signal_", "_resampled_", "applied_augmentations"
MAP_TYPES = ["int16", "uint16"]
# --- end of fixed values -----------------------------------------------------------------------

#: A stored page's entries by key: element type and shape (null for what is not an array).
ENTRIES = "map<string, struct<dtype: string, shape: array<int>>>"


def signal_keys(entries: str) -> Column:
    """Sorted keys of the two-dimensional arrays that are signals, without resampled ones."""
    return F.expr(f"array_sort(map_keys(map_filter({entries}, (k, e) -> startswith(k, '{SIGNAL}') and not contains(k, '{RESAMPLED}') and size(e.shape) = 2)))")


def is_augmented(entries: str) -> Column:
    return F.map_contains_key(entries, AUGMENTED)


def array_issues(entries: str) -> Column:
    """What is missing or has another form, in a fixed order; none for a valid page."""
    e = F.col(entries)
    has = lambda k: F.map_contains_key(e, k)
    shape = lambda s: F.concat(F.lit("("), F.array_join(s.cast("array<string>"), ", "), F.lit(")"))
    found = [F.when(~has(k), f"Missing metadata: {k}") for k in METADATA] + [F.when(~has(k), f"Missing grid: {k}") for k in GRID]
    for k in MAPS:
        kind = F.coalesce(e[k]["dtype"], F.lit("none"))
        found.append(F.when(~has(k), f"Missing map: {k}").when(~kind.isin(MAP_TYPES), F.concat(F.lit(f"{k}: expected int16/uint16, got "), kind)))
    signals = signal_keys(entries)
    found.append(F.when(F.size(signals) == 0, "No signal_* keys found"))
    wrong = F.transform(F.filter(signals, lambda k: e[k]["shape"][1] != 3), lambda k: F.concat(k, F.lit(": expected Nx3, got shape "), shape(e[k]["shape"])))
    major = e[GRID[6]]["shape"]
    last = [F.when((F.size(major) != 2) | (major[1] != 2), F.concat(F.lit(f"{GRID[6]}: expected Nx2, got "), shape(major)))] + [F.when(~has(k), f"Missing {k}") for k in LABELS]
    return F.array_compact(F.concat(F.array(*found), wrong, F.array(*last)))


def size_checked(path: Column, width: Column, height: Column, want_width: int = 3564, want_height: int = 2520) -> Column:
    """(ok, path): the path as it is where the image has the wanted size, else with a prefix of
    its real size before the file's name; a size of null stays, as an image that cannot be read."""
    ok = (width == want_width) & (height == want_height)
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    renamed = F.concat(folder, F.lit("SIZE_ERROR_"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("_"), name)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, path).otherwise(F.coalesce(renamed, path)).alias("path"))
