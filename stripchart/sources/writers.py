"""Rows and texts of exports: the data set's table, the correspondence of names, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stripchart.session import settled

# --- fixed values: columns of the data set's table, in order, and the configuration behind them --
CONFIGURED = {
    "format_choice": "format_choice", "rythm_leads": "rythm_leads", "signal_color": "signal_color", "lead_order": "lead_order",
    "page_size": "page_size", "speed_mm_per_s": "speed_mm_per_s", "gain_mm_per_mV": "gain_mm_per_mV", "signal_line_width": "signal_line_width", "signal_antialiased": "signal_antialiased",
    "horizontal_spacing_mm": "horizontal_spacing_mm", "vertical_spacing_mm": "vertical_spacing_mm", "vertical_offset_max_mm": "vertical_offset_max_mm",
    "special_spacing_type": "special_spacing.type", "special_spacing_params": "special_spacing",
    "separation_style": "separation_style", "separation_color": "separation_color",
    "grid_layout_style": "grid_layout_style", "grid_style_major": "grid_style[0]", "grid_style_minor": "grid_style[1]", "grid_color": "grid_color",
    "reference_pulse_number": "reference_pulse.number_of_ref_pulse", "reference_pulse_h_pos": "reference_pulse.horizontal_position_ref_pulse", "reference_pulse_v_pos": "reference_pulse.vertical_position_ref_pulse",
    "pulse_and_signal_space": "reference_pulse.pulse_and_signal_space", "signal_and_pulse_shift_mm": "reference_pulse.signal_and_pulse_shift_mm",
    "lead_text_color": "text_formatting.lead_text_color", "lead_text_shift": "text_formatting.lead_text_shift", "spacing_lead_text": "text_formatting.spacing_lead_text", "lead_text_size": "text_formatting.lead_text_size",
    "lead_nomenclature_peripheriques": "lead_nomenclatures.peripheriques", "lead_nomenclature_precordiales": "lead_nomenclatures.precordiales",
    "added_noise": "added_noise", "applied_noise_type": "applied_noise_type", "applied_noise_seed": "applied_noise_seed", "show_medical_text": "show_medical_text",
}
EXTRA_LEADS = ["3x4+1", "3x4+2", "3x4+3", "6x2+1"]
SOURCE_TYPES = {"xml": ["xml"], "hdf5": ["hdf5", "h5"]}
CORRESPONDENCE = "nom_anonymise,nom_original"
# --- end of fixed values -----------------------------------------------------------------------

BOM = "﻿"


def base_name(path: Column) -> Column:
    """The file's name without folder and without its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def dataset_rows(images: DataFrame, config: str = "config") -> DataFrame:
    """The 46 columns of the data set's table. images: source_path, image_path, json_path,
    masks_folder_path (relative ones), page_index, page_count, num_masks, and the configuration as
    JSON. What the configuration does not say is null; rhythm leads are joined by commas."""
    ending = F.lower(F.regexp_extract("source_path", r"\.([^./]*)$", 1))
    kind = F.when(ending.isin(SOURCE_TYPES["xml"]), "xml").when(ending.isin(SOURCE_TYPES["hdf5"]), "hdf5").otherwise("unknown")
    value = lambda at: F.get_json_object(config, f"$.{at}")
    leads = F.coalesce(F.array_join(F.from_json(value("rythm_leads"), "array<string>"), ","), value("rythm_leads"))
    own = {n: leads if n == "rythm_leads" else value(at) for n, at in CONFIGURED.items()}
    own["format_choice"] = F.coalesce(own["format_choice"], F.lit(""))
    return images.select(
        base_name(F.col("image_path")).alias("image_id"), "source_path", kind.alias("source_type"), "image_path", "json_path", "masks_folder_path",
        "page_index", "page_count", (F.col("page_count") > 1).alias("is_multipage"),
        *(c.alias(n) for n, c in own.items()), "num_masks", own["format_choice"].isin(EXTRA_LEADS).alias("has_extra_leads"),
    )


def write_dataset(images: DataFrame, path: str) -> None:
    """The data set's table as CSV files with headers."""
    dataset_rows(images).write.option("header", True).csv(path)


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def numbered(rows: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """rows with their place from 1 in an order, ties in any: dealt by ranges, sorted and counted
    in each, so that a row's place is its own in its range and the counts of the ranges before.
    The driver holds one number for each range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = settled(ranged.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.monotonically_increasing_id().alias("at")))
    kept = kept.withColumn("range", F.shiftright("at", 33))
    before, starts = 0, []
    for r in sorted(kept.groupBy("range").count().collect(), key=lambda r: r["range"]):
        starts.append((r["range"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "range long, start long")
    own = F.col("at").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(offsets), "range").select("row.*", (F.col("start") + own + 1).alias(place))


def correspondence_lines(names: DataFrame, order: str, anonymous: str, original: str) -> DataFrame:
    """`place` and `line` of the correspondence: the head, after a byte order mark, then a quoted
    pair for each row. Joined by carriage return and line feed they are the file."""
    pairs = numbered(names.select(F.col(order).alias("by"), F.concat(quoted(F.col(anonymous)), F.lit(","), quoted(F.col(original))).alias("line")), ["by"]).select("place", "line")
    return names.sparkSession.createDataFrame([(0, BOM + CORRESPONDENCE)], "place bigint, line string").unionByName(pairs)


def export_names(items: DataFrame, order: list[str], failed: str, keys: list[str] = ()) -> DataFrame:
    """Items that did not fail, named ecg_anonymise_1, _2 and so on in their order, per key."""
    made = items.where(~F.coalesce(F.col(failed), F.lit(False)))
    if keys:
        place = made.withColumn("export_name", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        place = numbered(made, order, "export_name")
    return place.withColumn("export_name", F.concat(F.lit("ecg_anonymise_"), F.col("export_name").cast("string")))
