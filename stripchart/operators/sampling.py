"""Seeded draws for synthetic configurations. A draw depends on the seed, the sampler's name and
the row's key only, so it is the same however the rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: (value, weight) of the weighted samplers -----------------------------------
WEIGHTS: dict[str, list[tuple]] = {
    "page_size": [("a4", 60), ("us_letter", 40)],
    "signal_color": [("black", 80), ("shade", 18), ("blue", 2)],
    "lead_order": [("normal", 80), ("cabrera", 10), ("territoire", 6), ("shuffle", 4)],
    "line_width": [(2, 20), (4, 60), (6, 20)],
    "gain": [(5, 5), (10, 75), (20, 20)],
    "noise": [("none", 80), ("low", 8), ("powerline", 7), ("high", 5)],
    "format": [("3x4", 13), ("3x4_paramedic", 3), ("3x4+1", 12), ("3x4+2", 2), ("3x4+3", 7), ("6x2", 14), ("6x2+1", 14), ("4x2", 7), ("4x2+1", 6), ("12x1", 10), ("3x4_cardiofax", 4), ("3x4+1_cardiofax", 4), ("6x1;6x1", 4)],
    "separation_color": [("black", 95), ("blue", 5)],
    "separation_style": [("none", 50), ("double_line_3mm", 10), ("quad_line_3mm", 2.5), ("thick_line_3mm", 2.5), ("line_5mm", 10), ("line_10mm", 2.5), ("dashes_10mm", 2.5), ("line_20mm", 2.5), ("dashes_25mm", 2.5), ("dashed", 10), ("dotted", 2.5), ("solid", 2.5), ("solid_thick", 3)],
    "lead_text_color": [("black", 90), ("blue", 5), ("red", 2.5), ("green", 2.5)],
    "lead_text_spacing": [("-10", 5), ("-5", 5), ("0", 80), ("10", 5), ("centered", 5)],
}
#: leads of rhythm strips; a format has as many as its last digit says
RHYTHM_LEADS = [("I", 2.5), ("II", 50), ("III", 5), ("aVR", 2.5), ("aVL", 2.5), ("aVF", 2.5), ("V1", 20), ("V2", 2.5), ("V3", 2.5), ("V4", 2.5), ("V5", 5), ("V6", 2.5)]
RHYTHM_FORMATS = ["3x4+1", "3x4+2", "3x4+3", "6x2+1", "4x2+1"]
#: (least, most, weight) of whole numbers, by format; the last entry holds for all others
H_SPACING = [
    (["3x4", "3x4+1", "3x4+2", "3x4+3", "3x4_paramedic", "3x4_cardiofax", "3x4+1_cardiofax"], [(0, 0, 45), (1, 5, 30), (6, 10, 15), (11, 15, 10)]),
    (["6x2", "6x2+1", "4x2", "4x2+1"], [(0, 0, 40), (1, 5, 30), (6, 10, 10), (11, 15, 10), (16, 20, 10)]),
    ([], [(0, 0, 1)]),
]
V_SPACING = [
    (["3x4_paramedic"], [(20, 20, 1)]),
    (["3x4_cardiofax", "3x4+1_cardiofax"], [(15, 15, 60), (18, 18, 40)]),
    (["12x1"], [(10, 10, 7), (15, 15, 4)]),
    (["6x2+1"], [(10, 10, 7), (15, 15, 4), (20, 20, 6), (25, 25, 71)]),
    ([], [(10, 10, 7), (15, 15, 4), (20, 20, 6), (25, 25, 71), (30, 30, 5), (35, 35, 7)]),
]
PULSE_ROWS = [
    (["3x4"], [1, 1, 1]),
    (["3x4+1"], [5, 5, 40, 50]),
    (["3x4+2"], [1, 1, 1, 1, 1]),
    (["3x4+3", "6x2"], [1, 1, 1, 1, 1, 2]),
    (["4x2"], [1, 1, 1, 2]),
    (["4x2+1"], [5, 5, 5, 15, 70]),
    (["6x2+1"], [5, 5, 5, 5, 5, 15, 60]),
    ([], [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2]),
]
PULSE_SHIFT = [(-22, -10, 5), (-9, -1, 40), (0, 0, 25), (1, 5, 25), (6, 13, 5)]
TEXT_SHIFT = [(-10, -5, 5), (-4, 0, 15), (1, 6, 50), (7, 12, 22), (13, 20, 8)]
TWO_COLUMNS = ["6x2", "4x2"]
PULSES = {True: [("none", 20), ("one", 14), ("one_column", 56), ("two_columns", 10)], False: [("none", 20), ("one", 16), ("one_column", 64)]}
PULSE_SIDES = {"two_columns": [("left", 50), ("middle", 25), ("right", 25)], "spaced": [("left", 45), ("middle", 15), ("right", 40)], "other": [("left", 50), ("right", 50)]}
#: 12.5 mm/s only in formats of few columns
SPEED_FORMATS = ["6x2", "3x4", "4x2"]
SPEEDS = {True: [(12.5, 5), (25.0, 80), (50.0, 5), (100.0, 3), (200.0, 2)], False: [(25.0, 85), (50.0, 5), (100.0, 3), (200.0, 2)]}
SPACED_DURATIONS = [("space_excluded", 60), ("space_included", 20), ("random_short", 20)]
CALIBRATED_DURATIONS = [("standard", 90), ("with_calib", 10)]
#: chance of yes
CHANCES = {"medical_text": 0.9, "black_square": 0.85, "top_black_line": 0.2, "antialiased": 0.2, "double_grid": 0.15, "subscript": 0.15, "bi_paper": 0.04, "vertical_offset": 0.3, "lead_offsets": 0.25}
# --- end of fixed values -----------------------------------------------------------------------


def uniform(name: str, *keys: Column, seed: int = 42) -> Column:
    """In [0, 1), from a hash of the seed, the name and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def weighted(name: str, *keys: Column, seed: int = 42, choices: list[tuple] | None = None) -> Column:
    choices = choices or WEIGHTS[name]
    total, u, below, out = sum(w for _, w in choices), uniform(name, *keys, seed=seed), 0.0, None
    for value, weight in choices[:-1]:
        below += weight
        out = (F.when if out is None else out.when)(u < below / total, F.lit(value))
    return F.lit(choices[-1][0]) if out is None else out.otherwise(F.lit(choices[-1][0]))


def chance(name: str, *keys: Column, seed: int = 42) -> Column:
    return uniform(name, *keys, seed=seed) < CHANCES[name]


def distinct_draws(name: str, k: int, *keys: Column, choices: list[tuple], seed: int = 42) -> Column:
    """k different values, as if drawn one after another by their weights: those with the least
    -ln(u) / weight."""
    races = F.array(*(F.struct((-F.log(F.greatest(uniform(f"{name}:{v}", *keys, seed=seed), F.lit(1e-300))) / w).alias("t"), F.lit(v).alias("v")) for v, w in choices))
    return F.transform(F.slice(F.array_sort(races), 1, k), lambda s: s["v"])


def shuffled(values: list[str], *keys: Column, seed: int = 42) -> Column:
    pairs = F.array(*(F.struct(uniform(f"shuffle:{v}", *keys, seed=seed).alias("u"), F.lit(v).alias("v")) for v in values))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])


def ranged(name: str, *keys: Column, choices: list[tuple], seed: int = 42) -> Column:
    """A whole number from one of the ranges (least, most, weight)."""
    pick = weighted(f"{name}:range", *keys, seed=seed, choices=[(i, w) for i, (_, _, w) in enumerate(choices)])
    least, most = (F.element_at(F.array(*(F.lit(c[i]) for c in choices)), pick + 1) for i in (0, 1))
    return (least + F.floor(uniform(name, *keys, seed=seed) * (most - least + 1))).cast("int")


def by_format(form: Column, table: list[tuple], draw) -> Column:
    """draw(choices) of the first entry of the table whose formats hold the row's; the last for all others."""
    out = None
    for formats, choices in table[:-1]:
        out = (F.when if out is None else out.when)(form.isin(formats), draw(choices))
    return draw(table[-1][1]) if out is None else out.otherwise(draw(table[-1][1]))


def rhythm_leads(form: Column, *keys: Column, seed: int = 42) -> Column:
    """As many different leads as the format has strips; null for a format without."""
    drawn = distinct_draws("rhythm", 3, *keys, choices=RHYTHM_LEADS, seed=seed)
    return F.when(form.isin(RHYTHM_FORMATS), F.slice(drawn, F.lit(1), F.substring(form, -1, 1).cast("int")))


def shaded(color: Column, most: int, *keys: Column, seed: int = 42) -> Column:
    """A colour #rrggbb with each channel moved by up to `most`, within 0 to 255."""
    out = [F.lit("#")]
    for i, channel in enumerate("rgb"):
        value = F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int") + ranged(f"shade:{channel}", *keys, choices=[(-most, most, 1)], seed=seed)
        out.append(F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), value)))), 2, "0"))
    return F.concat(*out)


def configurations(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """keys with a drawn configuration each. What depends on another draw (the spacings, pulse,
    speed and strips on the format, the pulse's side on the spacing) is drawn from its weights."""
    c = F.col(key)
    w = lambda name, choices: weighted(name, c, seed=seed, choices=choices)
    made = keys.select("*", *(weighted(n, c, seed=seed).alias(n) for n in WEIGHTS), *(chance(n, c, seed=seed).alias(n) for n in CHANCES))
    form, pulse = F.col("format"), F.col("pulse")
    two = form.isin(TWO_COLUMNS)
    made = made.withColumns(
        {
            "speed": F.when(form.isin(SPEED_FORMATS), w("speed", SPEEDS[True])).otherwise(w("speed", SPEEDS[False])),
            "rhythm_leads": rhythm_leads(form, c, seed=seed),
            "h_spacing": by_format(form, H_SPACING, lambda x: ranged("h_spacing", c, choices=x, seed=seed)),
            "v_spacing": by_format(form, V_SPACING, lambda x: ranged("v_spacing", c, choices=x, seed=seed)),
            "pulse": F.when(two, w("pulse", PULSES[True])).otherwise(w("pulse", PULSES[False])),
            "text_shift": ranged("text_shift", c, choices=TEXT_SHIFT, seed=seed),
            "layout_style": F.when((form == "3x4_paramedic") | form.endswith("_cardiofax"), "full_grid").otherwise(w("layout_style", [("full_grid", 50), ("with_text_zones", 50)])),
            "shade": F.when(F.col("signal_color") == "shade", shaded(F.lit("#000000"), 80, c, seed=seed)),
        }
    )
    single = pulse.isin("one", "one_column")
    side = F.when(two & single, w("side", PULSE_SIDES["two_columns"])).when(~two & single & (F.col("h_spacing") > 0), w("side", PULSE_SIDES["spaced"])).otherwise(w("side", PULSE_SIDES["other"]))
    row = by_format(form, PULSE_ROWS, lambda x: weighted("pulse_row", c, seed=seed, choices=list(enumerate(x, 1))))
    mode = (
        F.when(form.isin("12x1", "6x1;6x1"), "standard")
        .when(F.col("h_spacing") > 0, w("duration", SPACED_DURATIONS))
        .when(pulse == "one_column", w("duration", CALIBRATED_DURATIONS))
        .otherwise("standard")
    )
    made = made.withColumns(
        {
            "pulse_side": F.when(pulse != "none", side),
            "pulse_row": F.when(pulse == "one", row),
            "pulse_space": F.when(pulse != "none", uniform("pulse_space", c, seed=seed) < 0.2),
            "pulse_shift": F.when(pulse != "none", ranged("pulse_shift", c, choices=PULSE_SHIFT, seed=seed)),
            "duration_mode": mode,
        }
    )
    return made.withColumn("duration_fraction", F.when(F.col("duration_mode") == "random_short", 0.8 + 0.2 * uniform("fraction", c, seed=seed)))


def jobs(keys: DataFrame, key: str, repeats: int, pages: Column) -> DataFrame:
    """A row for each repeat and page of each key, with its own seed."""
    each = keys.withColumn("repeat", F.explode(F.expr(f"sequence(0, {repeats - 1})"))).withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1)))
    return each.withColumn("seed", F.xxhash64(key, "repeat", "page"))
