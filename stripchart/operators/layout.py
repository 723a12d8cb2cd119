"""Page layouts: which lead goes where, what a record's length allows, sizes and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stripchart.functions import arrays

# --- fixed values: orders and formats -----------------------------------------------------------
MEASURED = ["I", "II", "V1", "V2", "V3", "V4", "V5", "V6"]
LEAD_ORDERS = {
    "normal": ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"],
    "cabrera": ["aVL", "I", "aVR", "II", "aVF", "III", "V1", "V2", "V3", "V4", "V5", "V6"],
    "territoire": ["II", "III", "aVF", "I", "aVL", "V5", "V6", "V1", "V2", "V3", "V4", "aVR"],
}
NOMENCLATURES = {
    "peripheriques": {"I": "DI", "II": "DII", "III": "DIII", "aVR": "AVr", "aVL": "AVl", "aVF": "AVf"},
    "precordiales": {"V1": "C1", "V2": "C2", "V3": "C3", "V4": "C4", "V5": "C5", "V6": "C6"},
}
#: format: (rows, columns, rhythm strips, pages); leads run down the columns.
FORMATS = {
    "3x4": (3, 4, 0, 1),
    "3x4_paramedic": (3, 4, 0, 1),
    "3x4+1": (3, 4, 1, 1),
    "3x4+2": (3, 4, 2, 1),
    "3x4+3": (3, 4, 3, 1),
    "6x2": (6, 2, 0, 1),
    "6x2+1": (6, 2, 1, 1),
    "4x2": (4, 2, 0, 1),
    "4x2+1": (4, 2, 1, 1),
    "12x1": (12, 1, 0, 1),
    "3x4_cardiofax": (3, 4, 0, 1),
    "3x4+1_cardiofax": (3, 4, 1, 1),
    "6x1;6x1": (6, 1, 0, 2),
}
SPEED_MM_S, GAIN_MM_MV, PX_PER_MM = 25.0, 10.0, 12.0
# --- end of fixed values -----------------------------------------------------------------------


def slots(spark: SparkSession) -> DataFrame:
    """format, page, row, col, kind (lead or rhythm), idx: every cell of every format."""
    formats = spark.createDataFrame([(k, *v) for k, v in FORMATS.items()], "format string, rows int, cols int, rhythms int, pages int")
    cells = (
        formats.withColumn("page", F.explode(F.expr("sequence(0, pages - 1)")))
        .withColumn("row", F.explode(F.expr("sequence(0, rows + rhythms - 1)")))
        .withColumn("col", F.explode(F.expr("sequence(0, cols - 1)")))
    )
    lead = F.col("row") < F.col("rows")
    return cells.select("format", "page", "row", "col", F.when(lead, "lead").otherwise("rhythm").alias("kind"), F.when(lead, F.col("page") * F.col("rows") * F.col("cols") + F.col("col") * F.col("rows") + F.col("row")).otherwise(F.col("row") - F.col("rows")).alias("idx"))


def lead_orders(spark: SparkSession, orders: dict[str, list[str]] | None = None) -> DataFrame:
    """lead_order, idx, lead, and measured_idx: the place with the measured leads first."""
    rows = [(name, i, lead) for name, leads in (orders or LEAD_ORDERS).items() for i, lead in enumerate(leads)]
    base = spark.createDataFrame(rows, "lead_order string, idx int, lead string")
    w = Window.partitionBy("lead_order").orderBy(~F.col("lead").isin(MEASURED), "idx")
    return base.withColumn("measured_idx", F.row_number().over(w) - 1)


def assigned(cells: DataFrame, orders: DataFrame, rhythm: list[str] = ()) -> DataFrame:
    """cells of formats crossed with lead orders: the lead in each. Formats of fewer than twelve
    slots take the measured leads first; a rhythm cell without a lead keeps its placeholder."""
    most = F.max(F.when(F.col("kind") == "lead", F.col("idx"))).over(Window.partitionBy("format"))
    sized = cells.withColumn("_few", most < 11)
    names = orders.select("lead_order").distinct()
    every = sized.crossJoin(F.broadcast(names))  # two dimensions of a few rows each
    place = F.when(F.col("_few"), F.col("measured_idx")).otherwise(F.col("o.idx"))
    joined = every.alias("c").join(F.broadcast(orders.alias("o")), (F.col("c.lead_order") == F.col("o.lead_order")) & (F.col("kind") == "lead") & (F.col("c.idx") == place), "left")
    strip = F.get(F.array(*map(F.lit, rhythm)) if rhythm else F.expr("cast(array() as array<string>)"), F.col("c.idx"))
    lead = F.when(F.col("kind") == "lead", F.col("o.lead")).otherwise(F.coalesce(strip, F.format_string("rhythm[%d]", F.col("c.idx"))))
    return joined.select("format", F.col("c.lead_order").alias("lead_order"), "page", "row", "col", "kind", F.col("c.idx").alias("idx"), lead.alias("lead"))


def pages_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("format").agg((F.max("page") + 1).alias("pages"))


def format_size(name: Column) -> Column:
    """Rows, columns and rhythm strips of RxC or RxC+N; null fields for any other name."""
    get = lambda i: F.nullif(F.regexp_extract(name, r"^(\d+)x(\d+)(?:\+(\d+))?$", i), F.lit("")).cast("int")
    return F.struct(get(1).alias("rows"), get(2).alias("cols"), F.when(get(1).isNotNull(), F.coalesce(get(3), F.lit(0))).alias("rhythms"))


def native_format(duration: Column) -> Column:
    """The format of a record of so many seconds."""
    return F.when(duration <= 4, "3x4+1").when(duration <= 8, "6x2+1").otherwise("12x1")


def availability(duration: Column, least: Column, needs_rhythm: Column, has_rhythm: Column) -> Column:
    """Why a format cannot be had: too short a record, no rhythm channel in a short record; null
    where it can."""
    return F.when(duration <= least, "duration").when(needs_rhythm & ~has_rhythm & (duration <= 8), "rhythm")


def target_seconds(fmt: Column, native: Column, duration: Column) -> Column:
    """Seconds to fit channels to: the record's own in its native format, else the format's."""
    base = lambda c: F.regexp_replace(c, r"\+\d+$", "")
    usual = F.when(base(fmt) == "3x4", 2.5).when(base(fmt) == "6x2", 5.0).otherwise(10.0)
    return F.when(base(fmt) == base(native), duration).otherwise(usual)


def checked_config(configs: DataFrame) -> DataFrame:
    """Configurations with conflicts resolved, rule after rule: room for a middle pulse, pulses at
    high speed, thick separations without room, gain against row height, pulse shift. Columns:
    format, pulses, pulse_position, separation, speed, gain, horizontal_mm, vertical_mm, shift_mm."""
    middle = F.col("format").isin("6x2", "4x2") & ((F.col("pulses") == "two_columns") | (F.col("pulse_position") == "middle"))
    out = configs.withColumn("separation", F.when(~F.coalesce(middle, F.lit(False)), F.col("separation"))).withColumn("horizontal_mm", F.when(middle, F.greatest("horizontal_mm", F.lit(7.0))).otherwise(F.col("horizontal_mm")))
    fast, two = F.coalesce(F.col("speed"), F.lit(25.0)) >= 50, F.col("pulses") == "two_columns"
    out = out.withColumn("pulse_position", F.when(fast & ((F.col("pulse_position") == "middle") | two), "left").otherwise(F.col("pulse_position"))).withColumn("pulses", F.when(fast & two, "one_column").otherwise(F.col("pulses")))
    thick = F.col("separation").isin("quad_line_3mm", "thick_line_3mm") & (F.col("horizontal_mm") == 0)
    out = out.withColumn("separation", F.when(~F.coalesce(thick, F.lit(False)), F.col("separation")))
    tall = (F.col("gain") == 20) & (F.col("format").isin("6x2", "6x2+1", "12x1", "6x1;6x1") | (F.col("vertical_mm") < 20))
    out = out.withColumn("gain", F.when(tall, 10.0).otherwise(F.col("gain")))
    limit, shift = F.col("vertical_mm") * 0.3, F.coalesce(F.col("shift_mm"), F.lit(0.0))
    return out.withColumn("shift_mm", F.when(F.abs(shift) > limit, F.signum(shift) * limit).otherwise(F.col("shift_mm")))


def lattice(spark: SparkSession, width: int, height: int, step: int = 1) -> DataFrame:
    """Crossings of lines `step` apart: x, y from 0 to width and height."""
    xs = spark.range(0, width + 1, step).withColumnRenamed("id", "x")
    return xs.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height), F.lit(step))))


def minor_only(crossings: DataFrame, major: int = 5) -> DataFrame:
    """Crossings that do not lie on a major line both ways."""
    return crossings.where(~((F.col("x") % major == 0) & (F.col("y") % major == 0)))


def paper_points(samples: str, x0: str, y0: str, seconds: str, speed: float = SPEED_MM_S, gain: float = GAIN_MM_MV, px: float = PX_PER_MM) -> Column:
    """Samples in millivolts as points of the page, the last one at `seconds`."""
    t = f"if(size({samples}) > 1, i * {seconds} / (size({samples}) - 1), 0D)"
    return F.expr(f"transform({samples}, (v, i) -> struct({x0} + {t} * {speed}D * {px}D as x, {y0} + v * {gain}D * {px}D as y))")


def placed_cells(cells: DataFrame, keys: list[str], width: str, spacing: str, row_height: float, left: float, top: float) -> DataFrame:
    """cells with x, from the widths and spacings of those before them in their row, and y."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    before = F.sum(F.col(width) + F.col(spacing)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("x", F.coalesce(before, F.lit(0.0)) + left).withColumn("y", F.lit(top) - F.col("row") * row_height)


def canvas(rows: Column, cols: Column, cell_mm: Column, spacing_mm: Column, row_mm: Column, margin_mm: float = 5.0, px: float = PX_PER_MM) -> Column:
    """Whole pixels that a grid of cells needs, margins included."""
    return F.struct(F.ceil((cols * cell_mm + (cols - 1) * spacing_mm + 2 * margin_mm) * px).alias("width"), F.ceil((rows * row_mm + 2 * margin_mm) * px).alias("height"))


def shrunk_spacing(cols: Column, cell_mm: Column, spacing_mm: Column, page_mm: Column) -> Column:
    """Spacing between columns, less where the row is too wide, never below 0."""
    fits = cols * cell_mm + (cols - 1) * spacing_mm <= page_mm
    return F.when(fits | (cols <= 1), spacing_mm).otherwise(F.greatest(F.lit(0.0), (page_mm - cols * cell_mm) / (cols - 1)))


def pulse_points(x: str, y: str, width: float = 5.0, height: float = 10.0, px: float = PX_PER_MM) -> Column:
    """The six corners of a calibration pulse, a fifth of its width flat on either side."""
    a, b, h = width * px * 0.2, width * px * 0.8, height * px
    steps = [(0, 0), (a, 0), (a, h), (b, h), (b, 0), (width * px, 0)]
    return F.expr("array(" + ", ".join(f"struct({x} + {dx}D as x, {y} + {dy}D as y)" for dx, dy in steps) + ")")


def text_position(x: Column, y: Column, spacing: Column, shift_mm: Column, width_px: Column, px_per_mm: float = 12.0) -> tuple[Column, Column]:
    """Where a lead's text stands: beside the trace's start by 10 or 5 mm, over the middle of the
    trace (where it has a width) for `centered`, at its start for any other spacing."""
    beside = spacing.isin("-10", "-5", "10")
    middle = x + F.when((spacing == "centered") & (width_px > 0), width_px / 2).otherwise(0.0)
    return F.when(beside, x + spacing.try_cast("double") * px_per_mm).otherwise(middle), y + shift_mm * px_per_mm


def pulse_at(number: Column, row_from_1: Column, side: Column, row: Column, column: Column, columns: Column, extra_line: bool = False) -> Column:
    """Whether the only pulse belongs in a cell: its row, and the first, middle or (for any other
    side) last column; a strip of full width has its row alone."""
    own = F.when(side == "left", 0).when(side == "middle", F.floor(columns / 2)).otherwise(columns - 1)
    here = row == row_from_1 - 1
    return F.coalesce((number == "one") & (here if extra_line else here & (column == own)), F.lit(False))


def extent(samples: str, first: str, count: str, above: bool) -> Column:
    """How far a window of the samples reaches above (or below) the median of all of them, never
    below 0; null where the window is empty."""
    centred = arrays.median_centred(samples)
    window = F.slice(centred, F.expr(f"cast({first} as int)") + 1, F.greatest(F.expr(f"cast({count} as int)"), F.lit(0)))
    far = F.array_max(window) if above else -F.array_min(window)
    return F.when(F.size(window) > 0, F.greatest(far, F.lit(0.0)))


def row_extents(cells: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """keys, row, above, below of each row of cells (row, col, cols, slice, strip, samples): a cell
    shows its slice of the source, a strip's row the first `cols` slices in one."""
    first, count = "if(strip, 0, col * slice)", "if(strip, cols * slice, slice)"
    each = cells.select(*keys, "row", extent(samples, first, count, True).alias("a"), extent(samples, first, count, False).alias("b"))
    return each.groupBy(*keys, "row").agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("above"), F.coalesce(F.max("b"), F.lit(0.0)).alias("below"))


#: Millimetres around the signals of a canvas: left, right, top, above the strip, bottom, from the
#: top of a row to its line.
INSET_MM, RIGHT_MM, TOP_MM, OVER_STRIP_MM, BOTTOM_MM, SHIFT_MM = 5.0, 2.0, 3.0, 2.0, 1.0, 5.0
CANVAS = {
    "rows": 1, "cols": 1, "speed": 25.0, "gain": 10.0, "h_spacing": 0.0, "v_spacing": 24.0, "text_shift": 14.0, "text_size": 4.0, "pulse": False, "pulse_s": 0.28, "pulse_gap_mm": 0.0,
    "pulse_side": "right", "pulse_on_strip": False, "source_s": 10.0, "independent": False, "above": 0.0, "below": 0.0, "strip_px": 0.0,
}


def canvas_size(px: float = PX_PER_MM, **given: Column) -> Column:
    """Size of a page that fits its signals, and where they start on it, in closed form. given: any
    of CANVAS, as columns; `above` and `below` are the extents of the first and the last row."""
    c = {k: given.get(k, F.lit(v)) for k, v in CANVAS.items()}
    segment = c["speed"] * px * c["source_s"] / F.when(c["independent"], 1).otherwise(c["cols"])
    block = c["cols"] * segment + (c["cols"] - 1) * c["h_spacing"] * px
    extra = F.when(c["pulse"], c["pulse_s"] * c["speed"] * px + c["pulse_gap_mm"] * px).otherwise(0.0)
    left = INSET_MM * px + F.when(c["pulse_side"] == "left", extra).otherwise(0.0)
    # a pulse stands past the signals on a strip, and where it leaves a cell less than half its width
    past = F.when(c["pulse_on_strip"], F.greatest(left + block, left + c["cols"] * segment + extra)).when(segment - extra < segment * 0.5, left + block + extra).otherwise(left + block)
    right = F.when(c["pulse"], past).otherwise(left + block)
    top = F.greatest(c["above"] * c["gain"], c["text_shift"] - SHIFT_MM + c["text_size"]) * px
    span, under = (c["rows"] - 1) * c["v_spacing"] * px, c["below"] * c["gain"] * px
    strip = F.when(c["strip_px"] > 0, c["strip_px"] + OVER_STRIP_MM * px).otherwise(0.0)
    height = F.ceil(TOP_MM * px + top + span + under + strip + BOTTOM_MM * px)
    return F.struct(
        F.ceil(right + RIGHT_MM * px).alias("width"), height.alias("height"), left.alias("x"), (height - TOP_MM * px - top + SHIFT_MM * px).alias("y"), block.alias("signal_width"), (span + under + SHIFT_MM * px).alias("signal_height"),
    )


# --- fixed values: millimetres left free for texts around a grid --------------------------------
TEXT_ZONES = {"left": 5.0, "right": 20.0, "top": 50.0, "bottom": 10.0}
# --- end of fixed values -----------------------------------------------------------------------


def grid_area(style: Column, width: Column, height: Column, rows: Column, squares: Column | None = None, text_mm: Column | None = None, px: float = PX_PER_MM) -> Column:
    """Where the grid lies on a page: all of it, or (`with_text_zones`) whole 5 mm squares between
    the zones for texts. squares: struct x, y, align_x, left_mm, align_y, top_mm, or null; text_mm:
    height of the texts that are shown. Rows are at most 25 mm apart there, at least 10, and 30
    on a full grid."""
    square = 5 * px
    zone = {k: F.lit(v * px) for k, v in TEXT_ZONES.items()}
    whole = lambda length: F.floor(length / square) * square
    w, h = whole(width - zone["left"] - zone["right"]), whole(height - zone["top"] - zone["bottom"])
    x, y = zone["left"], zone["bottom"]
    if squares is not None:
        asked = squares.isNotNull()
        w, h = (F.when(asked, whole(F.least(squares[n] * square, own))).otherwise(own) for n, own in (("x", w), ("y", h)))
        texts = (F.lit(8.0) if text_mm is None else F.coalesce(text_mm, F.lit(8.0))) * px
        centred_x = zone["left"] + (width - zone["left"] - zone["right"] - w) / 2
        left = F.when(squares["align_x"] == "left", F.least(F.coalesce(squares["left_mm"], F.lit(0)) * px, width - w)).otherwise(centred_x)
        high = F.greatest(height - texts - h - F.coalesce(squares["top_mm"], F.lit(0)) * px, zone["bottom"])
        low = F.when(squares["align_y"] == "top", high).when(squares["align_y"] == "bottom", zone["bottom"]).otherwise(zone["bottom"] + (height - texts - zone["bottom"] - h) / 2)
        x, y = F.when(asked, left).otherwise(x), F.when(asked, low).otherwise(y)
    zoned = style == "with_text_zones"
    spacing = F.greatest(F.lit(10.0), F.least(F.lit(25.0), (h - 20 * px) / rows / px))
    pick = lambda own, full: F.when(zoned, own).otherwise(full).cast("double")
    return F.struct(pick(x, F.lit(0)).alias("x"), pick(y, F.lit(0)).alias("y"), pick(w, width).alias("width"), pick(h, height).alias("height"), pick(spacing, F.lit(30)).alias("most_spacing_mm"))


#: Pixels around a rendered page in its image.
BORDER = 4


def image_point(x: Column, y: Column, width: Column, height: Column, border: int = BORDER) -> tuple[Column, Column]:
    """A point of a page (y upward) in its image (y downward), which is half a pixel wider in its
    scale and has a border. width, height: of the page without the border."""
    scale = lambda size: (size + 0.5) / size
    return x * scale(width) + border, height - y * scale(height) + border


def image_line(at: Column, size: Column, upward: bool, border: int = BORDER) -> Column:
    """A grid line's place in the image: whole pixels, within the content."""
    placed = F.rint(at) * (size + 0.5) / size
    return F.rint(F.least(F.greatest(size - placed + border if upward else placed + border, F.lit(float(border))), size + border - 1))


def lattice_lines(length: Column, origin: Column | None = None, px: float = PX_PER_MM) -> tuple[Column, Column]:
    """(major, minor) places of lines 5 mm and 1 mm apart over a length: with an origin a major line
    passes through it, else whole squares lie in the middle. Minor lines on major ones are left out."""
    square = 5 * px
    whole = F.floor(length / square) * square
    start = (length - whole) / 2 if origin is None else origin - F.floor(origin / square) * square
    end = start + whole if origin is None else length
    first = start if origin is None else start - F.floor(start / px) * px
    places = lambda a, b, step: F.transform(F.sequence(F.lit(0), F.floor((b - a) / step).cast("int")), lambda i: (a + i * step).cast("double"))
    major, minor = places(start, end, square), places(first, end, px)
    taken = F.transform(major, lambda v: F.rint(v))
    return major, F.filter(minor, lambda v: ~F.array_contains(taken, F.rint(v)))
