"""Verification, checks, exports, and texts in page description streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stripchart.functions import streams, text
from stripchart.functions.arrays import in_order
from stripchart.operators import checks, layout, match, noise, raster, sampling, verify
from stripchart.queries.drawings import drawn
from stripchart.queries.registry import query, rounded, samples, table
from stripchart.queries.texts import _LABELS, _sql_patterns
from stripchart.session import spread
from stripchart.sources import drawing, files, stored, waveform_xml, writers

#: Streams that one task cuts.
CUT = 20_000

_POINTS_SQL = """m as (select l_orderkey as page, l_returnflag as lead, l_linenumber as sample, l_extendedprice / 20000 as mv, 500.0 as base, 500 - l_extendedprice / 20000 * 120 - (l_orderkey % 15 - 7) as y from lineitem),
e as (select *, mv * 10 as expected, (base - y) / 12 as actual, (base - y) / 12 - mv * 10 as error from m)"""


def _points(spark, sf_dir):
    """Order lines as measured points: a page an order, drawn up to 7 pixels off."""
    mv = F.col("l_extendedprice") / 20000
    points = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("lead"), F.col("l_linenumber").alias("sample"), mv.alias("mv"), F.lit(500.0).alias("base"), (500 - mv * 120 - (F.col("l_orderkey") % 15 - 7)).alias("y")
    )
    return verify.measured(points, "sample", "mv", "base", "y")


@query(f"""with {_POINTS_SQL} select page, lead, sample, round(sample / 500.0, 6) as time_s, round(expected, 6) as expected_mm, round(actual, 6) as actual_mm, round(error, 6) as error_mm,
 round(case when abs(expected) > 0.001 then error / expected * 100 else 0 end, 6) as error_percent, case when abs(error) <= 0.5 then 'PASS' else 'FAIL' end as status from e""")
def q_measured_points(spark, sf_dir):
    """Drawn heights against those of the samples."""
    found = _points(spark, sf_dir).select("page", "lead", "sample", "time_s", "expected_mm", "actual_mm", "error_mm", "error_percent", "status")
    return rounded(found, "time_s", "expected_mm", "actual_mm", "error_mm", "error_percent")


@query(f"with {_POINTS_SQL} select page, case when bool_or(abs(error) > 0.5) then 'FAIL' else 'PASS' end as overall_status, round(max(abs(error)), 4) as max_error_mm, count(*) as points from e group by page")
def q_page_status(spark, sf_dir):
    """Pages by their worst point."""
    return rounded(verify.overall(_points(spark, sf_dir), ["page"]), "max_error_mm", digits=4)


@query(f"""with {_POINTS_SQL}, l as (select page, lead, count(*) as n, count(*) filter (abs(error) <= 0.5) as passed, count(*) filter (abs(error) > 0.5) as failed, round(avg(error), 3) as mean from e group by page, lead)
select page, string_agg(lead, ',' order by lead) as leads, string_agg(n, ',' order by lead) as points, string_agg(failed, ',' order by lead) as failed, string_agg(cast(round(mean * 1000) as integer), ',' order by lead) as means, case when sum(failed) > 0 then 'FAIL' else 'PASS' end as overall, count(*) + 1 as lines from l group by page""")
def q_report(spark, sf_dir):
    """Reports as JSON and text, read back."""
    made = verify.reports(_points(spark, sf_dir), ["page"], "lead")
    read = made.withColumn("r", F.from_json("report", "struct<lead_measurements: array<struct<lead_name: string, num_points: bigint, num_failed: bigint, mean_error_mm: double>>, overall_status: string>"))
    return read.select(
        "page", F.array_join("r.lead_measurements.lead_name", ",").alias("leads"), *(F.array_join(F.col(f"r.lead_measurements.num_{c}").cast("array<string>"), ",").alias(c) for c in ("points", "failed")),
        F.array_join(F.transform("r.lead_measurements.mean_error_mm", lambda x: F.round(x * 1000).cast("int").cast("string")), ",").alias("means"), F.col("r.overall_status").alias("overall"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"),
    )


@query("select p_partkey, abs(10 + (p_partkey % 5 - 2) * 0.3 - 10) <= 0.5 + 1e-9 and abs(5 + (p_partkey % 3 - 1) * 0.6 - 5) <= 0.5 as passed, round((p_partkey % 5 - 2) * 0.3, 6) as height_error, round((p_partkey % 3 - 1) * 0.6, 6) as width_error from part")
def q_pulse_check(spark, sf_dir):
    """Drawn calibration pulses against one millivolt and a fifth of a second."""
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").select("p_partkey", verify.pulse_check((10 + (k % 5 - 2) * 0.3) * 12, (5 + (k % 3 - 1) * 0.6) * 12).alias("c"))
    return rounded(found.select("p_partkey", (F.col("c.status") == "PASS").alias("passed"), F.col("c.height_error_mm").alias("height_error"), F.col("c.width_error_mm").alias("width_error")), "height_error", "width_error")


_KEYS = [*checks.METADATA, *checks.GRID, *checks.MAPS, *checks.LABELS]


@query(f"""with k as (select unnest({_KEYS!r}) as key, unnest(range({len(_KEYS)})) as i), g as (select o_orderkey, key, i, o_orderkey % 29 <> i as has from orders, k),
w as (select o_orderkey, count(*) filter (not has) as missing from g group by o_orderkey)
select o_orderkey, missing + case when o_orderkey % 7 = 0 then 1 else 0 end + case when o_orderkey % 11 = 0 and o_orderkey % 29 <> {8 + 8} then 1 else 0 end + case when o_orderkey % 5 = 0 and o_orderkey % 7 <> 0 then 1 else 0 end as issues,
 case when o_orderkey % 7 = 0 then '' when o_orderkey % 3 = 0 then 'signal_I,signal_V1' else 'signal_I' end as signals, o_orderkey % 13 = 0 as augmented from w""")
def q_array_issues(spark, sf_dir):
    """Stored pages with a key left out, a map of another type, a signal of another shape or none."""
    o = F.col("o_orderkey")
    entry = lambda key, kind, *shape: F.struct(F.lit(key).alias("key"), F.struct(F.lit(kind).alias("dtype"), F.array(*map(F.lit, shape)).cast("array<int>").alias("shape")).alias("value"))
    shapes = {"grid_major_5mm": (40, 2)}
    usual = [F.when(o % 29 != i, F.when((o % 11 == 0) & F.lit(key == checks.MAPS[0]), entry(key, "float32", 9, 9)).otherwise(entry(key, "uint16", *shapes.get(key, (9, 9))))) for i, key in enumerate(_KEYS)]
    wide = F.when(o % 5 == 0, 4).otherwise(3)
    signal = lambda name: F.struct(F.lit(name).alias("key"), F.struct(F.lit("float32").alias("dtype"), F.array(F.lit(500), wide).alias("shape")).alias("value"))
    some = [F.when(o % 7 != 0, signal("signal_I")), F.when((o % 7 != 0) & (o % 3 == 0), entry("signal_V1", "float32", 500, 3)), entry("signal_I_resampled_250", "float32", 250, 3), entry("signal_line_width_px", "float64"), F.when(o % 13 == 0, entry("applied_augmentations", "str", 2))]
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.map_from_entries(F.array_compact(F.array(*usual, *some))).alias("e"))
    return made.select("o_orderkey", F.size(checks.array_issues("e")).cast("bigint").alias("issues"), F.array_join(checks.signal_keys("e"), ",").alias("signals"), checks.is_augmented("e").alias("augmented"))


@query("""with i as (select ps_partkey, ps_suppkey, 3564 + ps_suppkey % 3 - 1 as w, 2520 + ps_partkey % 2 as h, 'out/' || ps_suppkey || '/ecg_' || ps_partkey || '_p0.png' as path from (select l_partkey as ps_partkey, l_suppkey as ps_suppkey from lineitem group by all))
select ps_partkey, ps_suppkey, w = 3564 and h = 2520 as ok, case when w = 3564 and h = 2520 then path else 'out/' || ps_suppkey || '/SIZE_ERROR_' || w || 'x' || h || '_ecg_' || ps_partkey || '_p0.png' end as path from i""")
def q_image_sizes(spark, sf_dir):
    """Images of another size than their page's, renamed."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    path = F.format_string("out/%d/ecg_%d_p0.png", "ps_suppkey", "ps_partkey")
    checked = pairs.withColumn("c", checks.size_checked(path, (F.col("ps_suppkey") % 3 + 3563).cast("int"), (F.col("ps_partkey") % 2 + 2520).cast("int")))
    return checked.select("ps_partkey", "ps_suppkey", "c.ok", "c.path")


@query("""select o_orderkey, 'ECG_' || o_orderkey || '_p1' as image_id, case o_orderkey % 3 when 0 then 'xml' when 1 then 'hdf5' else 'unknown' end as source_type, o_orderkey % 2 = 1 as is_multipage,
 ['3x4', '3x4+1', '6x2+1', '4x2+1', '12x1'][o_orderkey % 5 + 1] as format_choice, case when o_orderkey % 2 = 0 then 'II,V1' end as rythm_leads, o_orderkey % 5 in (1, 2) as has_extra_leads, cast(o_orderkey % 4 as varchar) as shift, 46 as columns from orders""")
def q_dataset_rows(spark, sf_dir):
    """Rows of the data set's table from nested configurations."""
    o = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (o % n + 1).cast("int"))
    config = F.to_json(
        F.struct(
            pick(["3x4", "3x4+1", "6x2+1", "4x2+1", "12x1"], 5).alias("format_choice"), F.when(o % 2 == 0, F.array(F.lit("II"), F.lit("V1"))).alias("rythm_leads"),
            F.struct((o % 4).alias("lead_text_shift")).alias("text_formatting"), F.array(F.lit("solid"), F.lit("dotted")).alias("grid_style"),
        )
    )
    images = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("in/a.b/"), o.cast("string"), pick([".XML", ".h5", ".npy"], 3)).alias("source_path"), F.concat(F.lit("out/ECG_"), o.cast("string"), F.lit("_p1.png")).alias("image_path"),
        F.lit("j").alias("json_path"), F.lit("m").alias("masks_folder_path"), F.lit(0).alias("page_index"), (o % 2 + 1).alias("page_count"), F.lit(9).alias("num_masks"), config.alias("config"),
    )
    rows = writers.dataset_rows(images)
    key = F.regexp_extract("image_id", "([0-9]+)_", 1).cast("bigint").alias("o_orderkey")
    return rows.select(key, "image_id", "source_type", "is_multipage", "format_choice", "rythm_leads", "has_extra_leads", F.col("lead_text_shift").alias("shift"), F.lit(len(rows.columns)).alias("columns"))


@query("""with n as (select c_custkey, c_name || case when c_custkey % 3 = 0 then '"x"' else '' end as original, row_number() over (order by c_custkey) as place from customer where c_custkey % 10 <> 4)
select cast(0 as bigint) as place, chr(65279) || 'nom_anonymise,nom_original' as line union all select place, '"ecg_anonymise_' || place || '","' || replace(original, '"', '""') || '"' from n""")
def q_correspondence(spark, sf_dir):
    """Names of exported items, those that failed left out, and their correspondence."""
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, '"x"').otherwise("")).alias("original"), (F.col("c_custkey") % 10 == 4).alias("failed"))
    return writers.correspondence_lines(writers.export_names(named, ["c_custkey"], "failed"), "c_custkey", "export_name", "original")


def _streams(spark, sf_dir):
    """A stream for each customer: a lead label (for all but every fifth), the name with escaped
    parentheses, an octal letter in a list, a hexadecimal string, a string that is in no block and
    a block that does not close; strokes between."""
    k = F.col("c_custkey")
    label = F.when(k % 5 != 0, "BT /F1 9 Tf (V1) Tj ET\n").otherwise("")
    body = F.concat(
        F.lit("q 1 0 0 1 0 0 cm\n"), label, F.lit("BT 1 0 0 1 9 9 Tm ("), F.replace("c_name", F.lit("#"), F.lit(r" \(BT ET\) ")), F.lit(") Tj ET\n0 0 m 9 9 l S\n"),
        F.lit(r"BT [(caf\351) -20 (12)] TJ ET Q BT <"), F.hex(F.encode(F.format_string("%d bpm", k), "ISO-8859-1")), F.lit("> Tj ET (BT (not) a block ET) BT (open"),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), rows=CUT).select("c_custkey", streams.pieces(body).alias("cut"))


_STREAM_SQL = f"""s as (select c_custkey, c_custkey % 5 <> 0 as plain, case when c_custkey % 5 <> 0 then 'BT /F1 9 Tf (V1) Tj ET' || chr(10) else '' end as label, 'BT 1 0 0 1 9 9 Tm (' || replace(c_name, '#', ' \\(BT ET\\) ') || ') Tj ET' || chr(10) as named,
 replace(c_name, '#', ' (BT ET) ') as t, c_custkey || ' bpm' as rate, 'BT <' || hex(encode(c_custkey || ' bpm')) || '> Tj ET ' as hexed from customer),
k as (select *, t in ({_LABELS}) or {_sql_patterns()} as stays from s)"""


@query(f"""with {_STREAM_SQL} select c_custkey, plain as readable,
 'q 1 0 0 1 0 0 cm' || chr(10) || label || '0 0 m 9 9 l S' || chr(10) || 'Q (BT (not) a block ET) ' || case when plain then 'BT (open' else '' end as without_texts,
 'q 1 0 0 1 0 0 cm' || chr(10) || label || case when plain and stays then named else '' end || '0 0 m 9 9 l S' || chr(10) || 'Q ' || case when plain then hexed else '' end || '(BT (not) a block ET) ' || case when plain then 'BT (open' else '' end as by_whitelist from k""")
def q_stream_redact(spark, sf_dir):
    """Streams without the texts that may not stay: readable ones by either mode, others wholly."""
    cut = F.col("cut")
    return _streams(spark, sf_dir).select("c_custkey", streams.is_readable(cut).alias("readable"), streams.redacted(cut, "full").alias("without_texts"), streams.redacted(cut, "smart").alias("by_whitelist"))


@query(f"with {_STREAM_SQL} select c_custkey, case when plain then 'V1|' else '' end || t || '|caf' || chr(233) || ' 12|' || rate || '|' as texts from k")
def q_stream_audit(spark, sf_dir):
    """All texts that streams show, whatever their form."""
    return _streams(spark, sf_dir).select("c_custkey", F.array_join(streams.audit(F.col("cut")), "|").alias("texts"))


@query("""with recursive objects as (select o_custkey as document, o_orderkey as object, lead(o_orderkey) over w as after, lag(o_orderkey) over w as before, min(o_orderkey) over (partition by o_custkey) as first
  from orders window w as (partition by o_custkey order by o_orderkey)),
edges as (select document, object, after as to_object from objects where object % 3 <> 0 and after is not null union all select document, object, before from objects where object % 5 = 0 and before is not null),
reached as (select distinct document, first as object from objects union select reached.document, to_object from reached join edges on edges.document = reached.document and edges.object = reached.object),
plain as (select document, bool_or(object % 7 = 0) as readable from reached group by document)
select document, objects.object, readable, case when readable then 'q' || chr(10) || case when object % 7 = 0 then 'BT (V1) Tj ET' || chr(10) else '' end || 'BT (25mm/s) Tj ET' || chr(10) || 'Q' else 'q' || chr(10) || 'Q' end as stream
from objects join plain using (document)""")
def q_redact_documents(spark, sf_dir):
    """Streams of documents of several objects that draw each other, some in circles: readable is
    a document of which anything that its first page draws shows a lead label."""
    w = Window.partitionBy("document").orderBy("object")
    orders = spread(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("object")), "document", rows=CUT)
    placed = orders.withColumn("after", F.lead("object").over(w)).withColumn("before", F.lag("object").over(w))
    draws = F.array_compact(F.array(F.when(F.col("object") % 3 != 0, F.col("after")), F.when(F.col("object") % 5 == 0, F.col("before"))))
    edges = placed.select("document", "object", F.explode(draws).alias("to_object"))
    first = orders.groupBy("document").agg(F.min("object").alias("object"))
    stream = F.concat(F.lit("q\n"), F.when(F.col("object") % 7 == 0, "BT (V1) Tj ET\n").otherwise(""), F.lit("BT (25mm/s) Tj ET\n"), F.format_string("BT (Name %d) Tj ET\nQ", "document"))
    cut = orders.withColumn("cut", streams.pieces(stream))
    return streams.redacted_documents(cut, streams.drawn_objects(edges, first), "smart").select("document", "object", "readable", "stream")



@query("select p_partkey, 'a(' || p_partkey || ')' || chr(9) || chr(cast(65 + p_partkey % 26 as integer)) || '/' || chr(92) as t from part")
def q_stream_escapes(spark, sf_dir):
    """Escapes of strings, by name and by octal number."""
    raw = F.concat(F.lit(r"a\("), F.col("p_partkey").cast("string"), F.lit(r"\)\t\1"), F.lpad(F.conv(((F.col("p_partkey") % 26) + 1).cast("string"), 10, 8), 2, "0"), F.lit(r"\/\\"))
    return table(spark, sf_dir, "part").select("p_partkey", streams.decoded(raw).alias("t"))


@query("""select p_partkey, round(100 + case p_partkey % 6 when 0 then -120 when 1 then -60 when 3 then 120 when 4 then 250 else 0 end, 6) as x, round(50.0 + (p_partkey % 36 - 15) * 12, 6) as y,
 case when p_partkey % 4 <> 0 then false when p_partkey % 3 = 0 then p_size % 4 = 1 and p_partkey % 5 = 0 when p_partkey % 3 = 1 then p_size % 4 = 1 and p_partkey % 5 = 2 else p_size % 4 = 1 and p_partkey % 5 = 4 end as pulse from part""")
def q_text_and_pulse_places(spark, sf_dir):
    """Where a lead's text stands, and whether the one pulse belongs in a cell."""
    k = F.col("p_partkey")
    spacing = F.element_at(F.array(*map(F.lit, ["-10", "-5", "0", "10", "centered", "7"])), (k % 6 + 1).cast("int"))
    x, y = layout.text_position(F.lit(100.0), F.lit(50.0), spacing, k % 36 - 15, F.lit(500.0))
    side = F.when(k % 3 == 0, "left").when(k % 3 == 1, "middle").otherwise("right")
    pulse = layout.pulse_at(F.when(k % 4 == 0, "one").otherwise("one_column"), F.lit(2), side, (F.col("p_size") % 4).cast("int"), (k % 5).cast("int"), F.lit(5))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), pulse.alias("pulse"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') as hl7, 'ecg_' || 'GE_MUSE_' || o_orderkey || '_' || strftime(o_orderdate, '%Y_%m_%d_%H_%M_%S') as name from orders")
def q_dates(spark, sf_dir):
    """Times as digits, and in the names of exports."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.hl7_time(F.col("o_orderdate")).alias("hl7"), text.export_base(F.concat(F.lit("GE MUSE "), F.col("o_orderkey").cast("string")), F.col("o_orderdate")).alias("name"))


@query("select o_orderkey, true as within from orders")
def q_shades(spark, sf_dir):
    """Drawn shades of a colour: each channel within the bound of the base's, and within a byte."""
    o = F.col("o_orderkey")
    base = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(o), F.lit(1 << 24))), 6, "0")))
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", base.alias("base"), sampling.shaded(base, 25, o).alias("shade"))
    channel = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")
    near = F.col("shade").rlike("^#[0-9a-f]{6}$")
    for i in range(3):
        near = near & (F.abs(channel("base", i) - channel("shade", i)) <= 25)
    return drawn.select("o_orderkey", near.alias("within"))


_SPEEDS = ["full_with_hz", "compact", "compact_no_space", "french_abbreviated", "french_full", "english_labeled", "minimal_speed_only", "minimal_both", "german", "spanish", "italian", "portuguese", "other"]


@query("""with s as (select p_partkey, [12.5, 25, 50][p_partkey % 3 + 1] as v, [5, 10, 20][p_size % 3 + 1] as g, p_partkey % 13 as k from part), t as (select *, case when v = floor(v) then cast(cast(v as integer) as varchar) else cast(v as varchar) end as s from s)
select p_partkey, case k when 0 then s || ' mm/s        ' || g || ' mm/mV        40Hz' when 1 then s || ' mm/s   ' || g || ' mm/mV' when 3 then 'Vit. : ' || s || ' mm/s   Gain : ' || g || ' mm/mV' when 4 then 'Vitesse : ' || s || ' mm/s   Gain : ' || g || ' mm/mV'
 when 5 then 'Speed: ' || s || ' mm/s   Gain: ' || g || ' mm/mV' when 6 then s || ' mm/s' when 8 then 'Geschw.: ' || s || ' mm/s   Verst.: ' || g || ' mm/mV' when 9 then 'Vel.: ' || s || ' mm/s   Gan.: ' || g || ' mm/mV' when 10 then 'Vel.: ' || s || ' mm/s   Guad.: ' || g || ' mm/mV'
 when 11 then 'Vel.: ' || s || ' mm/s   Ganho: ' || g || ' mm/mV' when 12 then s || 'mm/s   ' || g || 'mm/mV' else s || 'mm/s ' || g || 'mm/mV' end as line from t""")
def q_speed_gain_texts(spark, sf_dir):
    """The line that names speed and gain, in each of its forms."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.speed_gain(pick([12.5, 25.0, 50.0], k % 3), pick([5.0, 10.0, 20.0], F.col("p_size") % 3), pick(_SPEEDS, k % 13), F.lit(" ")).alias("line"))


@query("""with c as (select user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as i, floor(value / 100 * 1000 / 5 + 0.5) as digit from events),
n as (select user_id, max(i) + 1 as n from c group by user_id)
select c.user_id, 'MDC_ECG_LEAD_' || upper(event_type) as code, max(n) as digits, cast(sum(digit * (i + 1)) as bigint) as weight, 'Anonymous' as given, '19700101000000' as low, strftime(to_timestamp(max(n) / 500.0) at time zone 'UTC', '%Y%m%d%H%M%S') as high from c join n using (user_id) group by c.user_id, event_type""")
def q_annotated_xml(spark, sf_dir):
    """Annotated ECG written from channels and read back with Spark's own paths."""
    rows = samples(spark, sf_dir).groupBy("user_id", "event_type").agg(in_order("struct(t, event_id)", "v / 100").alias("samples"))
    placed = rows.select(F.col("user_id").alias("ecg_id"), F.hash("event_type").alias("pos"), F.concat("event_type", F.lit("_rhythm")).alias("name"), "samples", F.lit(500).alias("sample_rate_hz"))
    written = waveform_xml.write_annotated(placed)
    at = lambda path: F.expr(f"""xpath(xml, "{path}")""")
    local = lambda *names: "".join(f"//*[local-name()='{n}']" for n in names)
    value = local("sequence") + "[.//*[local-name()='digits']]"
    read = written.select("ecg_id", at(local("given") + "/text()")[0].alias("given"), at(local("effectiveTime", "low") + "/@value")[0].alias("low"), at(local("effectiveTime", "high") + "/@value")[0].alias("high"), F.arrays_zip(at(value + "/*[local-name()='code']/@code").alias("code"), at(local("digits") + "/text()").alias("text")).alias("z"))
    each = read.select("ecg_id", "given", "low", "high", F.explode("z").alias("z")).withColumn("d", F.split("z.text", " ").cast("array<bigint>"))
    weight = F.expr("aggregate(transform(d, (x, i) -> x * (i + 1)), 0L, (a, x) -> a + x)")
    return each.select(F.col("ecg_id").alias("user_id"), F.col("z.code").alias("code"), F.size("d").cast("bigint").alias("digits"), weight.alias("weight"), "given", "low", "high")


@query("""with c as (select user_id, event_type, list(least(32767, greatest(-32768, floor((value - 250) * 10 / 0.5 + 0.5))) * 0.5 / 1000 order by ts, event_id) as s from events group by 1, 2),
f as (select user_id, arg_min(s, case event_type when 'view' then 0 when 'click' then 1 else 2 end) filter (event_type in ('view', 'click')) as s from c group by user_id)
select user_id, len(s) as samples, round(list_sum(s), 4) as total from f where s is not null""")
def q_rhythm_strip(spark, sf_dir):
    """The rhythm strip of documents with two, named in either case: the first by position."""
    rows = samples(spark, sf_dir).groupBy("user_id", "event_type").agg(in_order("struct(t, event_id)", "(v - 250) / 100").alias("samples"))
    place = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    name = F.when(F.col("event_type") == "view", "V1_RHYTHM").when(F.col("event_type") == "click", "II_rhythm").otherwise(F.concat("event_type", F.lit("_rhythm_x")))
    placed = rows.select(F.col("user_id").alias("ecg_id"), place.alias("pos"), name.alias("name"), "samples", F.lit(500).alias("sample_rate_hz"))
    found = waveform_xml.rhythm_strip(waveform_xml.write_muse(placed))
    return found.select(F.col("ecg_id").alias("user_id"), F.size("samples").cast("bigint").alias("samples"), F.round(F.expr("aggregate(samples, 0D, (a, x) -> a + x)"), 4).alias("total"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as s, vec_id % 4 as col, vec_id % 3 = 0 as strip from embeddings), m as (select *, list_median(s) as mid from e),
w as (select *, case when strip then s[1:64] else s[col * 16 + 1 : col * 16 + 16] end as own from m),
x as (select vec_id // 8 as page, vec_id % 2 as row, greatest(0, list_max(own) - mid) as a, greatest(0, mid - list_min(own)) as b from w)
select page, row, round(max(a), 6) as above, round(max(b), 6) as below from x group by page, row""".replace("list_median(s)", "list_aggregate(s, 'median')"))
def q_row_extents(spark, sf_dir):
    """How far rows reach above and below their lines: cells by their slices, strips as a whole."""
    v = F.col("vec_id")
    cells = table(spark, sf_dir, "embeddings").select(F.floor(v / 8).alias("page"), (v % 2).alias("row"), (v % 4).alias("col"), F.lit(4).alias("cols"), F.lit(16).alias("slice"), (v % 3 == 0).alias("strip"), F.expr("transform(embedding, x -> cast(x as double))").alias("samples"))
    return rounded(layout.row_extents(cells, ["page"]), "above", "below")


@query("""with p as (select p_partkey, 1 + p_size % 6 as rows, 1 + p_partkey % 4 as cols, [12.5, 25, 50][p_size % 3 + 1] as speed, [5, 10, 20][p_partkey % 3 + 1] as gain, cast(p_size % 11 as double) as gap, p_partkey % 2 = 0 as pulse, case p_partkey % 5 when 0 then 'left' else 'right' end as side, p_partkey % 7 = 0 as on_strip,
 p_size / 20.0 as above, p_size / 30.0 as below, case when p_partkey % 3 = 0 then 90.0 else 0.0 end as strip from part),
s as (select *, speed * 12 * 10 / cols as seg, case when pulse then 0.28 * speed * 12 + 12 else 0 end as extra from p),
b as (select *, cols * seg + (cols - 1) * gap * 12 as block, 60 + case when side = 'left' then extra else 0 end as x0 from s),
r as (select *, case when not pulse then x0 + block when on_strip then greatest(x0 + block, x0 + cols * seg + extra) when seg - extra < seg * 0.5 then x0 + block + extra else x0 + block end as right_end, greatest(above * gain, 13) * 12 as top from b),
h as (select *, ceil(36 + top + (rows - 1) * 24 * 12 + below * gain * 12 + case when strip > 0 then strip + 24 else 0 end + 12) as height from r)
select p_partkey, cast(ceil(right_end + 24) as bigint) as width, cast(height as bigint) as height, round(x0, 6) as x, round(height - 36 - top + 60, 6) as y, round(block, 6) as signal_width from h""")
def q_canvas_layout(spark, sf_dir):
    """Pages that fit their signals, in closed form."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    size = layout.canvas_size(
        rows=n % 6 + 1, cols=k % 4 + 1, speed=pick([12.5, 25.0, 50.0], n % 3), gain=pick([5, 10, 20], k % 3), h_spacing=(n % 11).cast("double"), pulse=k % 2 == 0, pulse_gap_mm=F.lit(1.0),
        pulse_side=F.when(k % 5 == 0, "left").otherwise("right"), pulse_on_strip=k % 7 == 0, above=n / 20.0, below=n / 30.0, strip_px=F.when(k % 3 == 0, 90.0).otherwise(0.0),
    )
    found = table(spark, sf_dir, "part").select("p_partkey", size.alias("z"))
    return rounded(found.select("p_partkey", F.col("z.width").cast("bigint").alias("width"), F.col("z.height").cast("bigint").alias("height"), "z.x", "z.y", "z.signal_width"), "x", "y", "signal_width")


@query("""with p as (select p_partkey, case p_size % 3 when 0 then 'full_grid' else 'with_text_zones' end as style, case p_partkey % 2 when 0 then 3564.0 else 3352.0 end as w, case p_partkey % 2 when 0 then 2520.0 else 2590.0 end as h, 1 + p_size % 12 as rows, p_partkey % 3 > 0 as asked, 40 + p_size % 20 as sx, 20 + p_size % 18 as sy,
 case p_partkey % 4 when 0 then 'left' else 'centered' end as ax, ['top', 'bottom', 'centered'][p_partkey % 3 + 1] as ay, 10 + p_size % 6 * 4 + 2 as texts from part),
g as (select *, floor((w - 300) / 60) * 60 as gw0, floor((h - 720) / 60) * 60 as gh0 from p),
s as (select *, case when asked then least(sx * 60, gw0) else gw0 end as gw, case when asked then least(sy * 60, gh0) else gh0 end as gh from g),
z as (select *, case when not asked then 60 when ax = 'left' then least(15 * 12, w - gw) else 60 + (w - 300 - gw) / 2 end as x, case when not asked or ay = 'bottom' then 120 when ay = 'top' then greatest(h - texts * 12 - gh - 60, 120) else 120 + (h - texts * 12 - 120 - gh) / 2 end as y from s)
select p_partkey, case when style = 'full_grid' then 0 else round(x, 6) end as x, case when style = 'full_grid' then 0 else round(y, 6) end as y, case when style = 'full_grid' then w else gw end as width, case when style = 'full_grid' then h else gh end as height,
 case when style = 'full_grid' then 30 else round(greatest(10, least(25, (gh - 240) / rows / 12)), 6) end as most_spacing_mm from z""")
def q_grid_area(spark, sf_dir):
    """Where grids lie on their pages: whole ones, and whole squares between the zones for texts."""
    k, n = F.col("p_partkey"), F.col("p_size")
    side = F.element_at(F.array(*map(F.lit, ["top", "bottom", "centered"])), (k % 3 + 1).cast("int"))
    squares = F.when(k % 3 > 0, F.struct((n % 20 + 40).alias("x"), (n % 18 + 20).alias("y"), F.when(k % 4 == 0, "left").otherwise("centered").alias("align_x"), F.lit(15).alias("left_mm"), side.alias("align_y"), F.lit(5).alias("top_mm")))
    even = k % 2 == 0
    area = layout.grid_area(F.when(n % 3 == 0, "full_grid").otherwise("with_text_zones"), F.when(even, 3564.0).otherwise(3352.0), F.when(even, 2520.0).otherwise(2590.0), n % 12 + 1, squares, n % 6 * 4 + 12)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", area.alias("a")).select("p_partkey", "a.*"), "x", "y", "most_spacing_mm")



@query("""with e as (select vec_id, vec_id % 9 <> 4 as ok, len(embedding) as n, list_sum(list_transform(embedding, lambda x: floor(x * 1000))) as total from embeddings)
select vec_id, ok as readable, case when ok then n || 'x1' end as shape, case when ok then total end as total, case when ok then case when vec_id % 3 = 0 then 1 else 2 end end as arrays, case when ok then case when vec_id % 3 = 0 then 22 else 21 end end as missing from e""")
def q_stored_arrays(spark, sf_dir):
    """Arrays written to archives and read back; every ninth archive is damaged. An archive lacks
    the keys of a page, but for a signal and, in two of three, the speed."""
    v = F.col("vec_id")
    # whole numbers as text, one a line: bytes that Spark can make, of type S6; products in single
    # precision, as the SQL's
    lines = F.expr("array_join(transform(embedding, x -> lpad(cast(cast(floor(x * 1000F) as int) as string), 6, ' ')), '')")
    entry = lambda name, dtype, shape, data: F.struct(F.lit(name).alias("name"), F.lit(dtype).alias("dtype"), shape.cast("array<int>").alias("shape"), data.cast("binary").alias("data"))
    signal = entry("signal_I", "S6", F.array(F.size("embedding"), F.lit(1)), lines)
    speed = entry("speed_mm_per_s", "S2", F.expr("cast(array() as array<int>)"), F.lit("25"))
    made = table(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 3 == 0, F.array(signal)).otherwise(F.array(signal, speed)).alias("e"))
    content = made.withColumn("content", stored.packed("e")).withColumn("content", F.when(v % 9 == 4, F.expr("substr(content, 1, 40)")).otherwise(F.col("content")))
    read = content.withColumn("u", stored.unpacked("content")).select("vec_id", "u.entries", "u.error").withColumn("d", stored.described("entries"))
    first = F.expr("filter(entries, e -> e.name = 'signal_I')[0]")
    data = F.expr("decode(f.data, 'US-ASCII')")
    numbers = F.transform(F.sequence(F.lit(0), F.element_at("f.shape", 1) - 1), lambda i: F.trim(F.substring(data, i * 6 + 1, F.lit(6))).cast("double"))
    shown = read.withColumn("f", first)
    return shown.select(
        "vec_id", F.col("error").isNull().alias("readable"), F.array_join(F.col("f.shape").cast("array<string>"), "x").alias("shape"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.when(F.col("error").isNull(), F.size("entries")).alias("arrays"), F.when(F.col("error").isNull(), F.size(stored.missing_keys("d"))).alias("missing"),
    )


@query("select doc_id, md5(text) as digest, octet_length(encode(text)) as bytes, doc_id % 5 = 0 as damaged from documents where text is not null")
def q_deflated_streams(spark, sf_dir):
    """Texts deflated and inflated again; a stream that is cut has none."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    made = docs.select("doc_id", stored.deflated(F.col("b")).alias("z")).withColumn("part", F.when(F.col("doc_id") % 5 == 0, F.expr("substr(z, 1, length(z) - 3)")).otherwise(F.col("z")))
    read = made.select("doc_id", stored.inflated(F.col("z")).alias("t"), stored.inflated(F.col("part")).isNull().alias("damaged"))
    return read.select("doc_id", F.md5("t").alias("digest"), F.octet_length("t").cast("bigint").alias("bytes"), "damaged")


@query("""with n as (select *, unnest(['I', 'aVR', 'V6', 'X', 'V1']) as name from (select n_nationkey from nation)), p as (select *, case name when 'I' then 0 when 'aVR' then 3 when 'V1' then 6 when 'V6' then 11 else 99 end as place from n)
select n_nationkey, string_agg(name, ',' order by place) as leads from p group by n_nationkey""")
def q_lead_order(spark, sf_dir):
    """Channels in the standard order of their leads, others last."""
    each = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ["V1", "X", "V6", "aVR", "I"]))).alias("name"))
    return each.withColumn("place", match.lead_order(F.col("name"))).groupBy("n_nationkey").agg(F.array_join(in_order("place", "name"), ",").alias("leads"))


@query("""with c as (select s_suppkey, cast(s_suppkey as double) as x, cast(s_nationkey as double) as y, unnest([0, 12, 12, 48, 48, 60]) as dx, unnest([0, 0, 120, 120, 0, 0]) as dy, unnest(range(6)) as pos from supplier) select s_suppkey, pos, x + dx as x, y + dy as y from c""")
def q_pulse_corners(spark, sf_dir):
    """The corners of calibration pulses."""
    base = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    each = base.select("s_suppkey", F.posexplode(layout.pulse_points("x", "y")).alias("pos", "p"))
    return rounded(each.select("s_suppkey", F.col("pos").cast("bigint").alias("pos"), "p.x", "p.y"), "x", "y")


@query("""with p as (select cast(s_suppkey as bigint) as page_id, [200, 100, 60][s_suppkey % 3 + 1] as n from supplier), c as (select page_id, case when page_id % 7 = 5 then 0 else 92 * 2 end + case when page_id % 7 = 3 then 0 else 12 * n end as k from p)
select page_id, cast(k as bigint) as vector_ops, k >= 50 as drawn from c""")
def q_vector_operations(spark, sf_dir):
    """How much is drawn on pages, and whether they count as drawn records."""
    return files.vector_operations(drawn(spark, sf_dir)[0], ["page_id"])


@query("select o_orderkey, case when o_orderkey % 4 <> 1 and o_orderkey % 6 > 0 then round(o_orderkey % 6 * 1000 / (o_orderkey % 4 * 125 + 250.0), 6) end as duration_s from orders")
def q_source_duration(spark, sf_dir):
    """Real durations by the documents' sample bases, some of which are none."""
    o = F.col("o_orderkey")
    base = F.when(o % 4 == 1, "fast").otherwise((o % 4 * 125 + 250).cast("string"))
    documents = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<R><SampleBase>"), base, F.lit("</SampleBase><W><SampleBase>1</SampleBase></W></R>")).alias("xml"), (o % 6 * 1000).alias("n"))
    return rounded(waveform_xml.source_duration(documents, "n").select("o_orderkey", "duration_s"), "duration_s")


@query("""select c_custkey, 'Author=,Creator=,Kept=' || c_mktsegment || ',Keywords=,Producer=,Subject=,Title=' as info, case when c_custkey % 3 = 0 then null else 'Rotate=90' end as page,
 'q /Im10 Do Q /Fm' || c_custkey || ' Do  /Im1Do ' || case when c_custkey % 2 = 0 then '' else '/Im$.' || c_custkey || chr(10) || 'Do' end || ' /Im1 Dot' as stream from customer""")
def q_without_metadata(spark, sf_dir):
    """Documents without what names persons or programs: entries, annotations, draws of images."""
    k = F.col("c_custkey")
    info = F.create_map(F.lit("Author"), F.col("c_name"), F.lit("ModDate"), F.lit("D:2020"), F.lit("Kept"), F.col("c_mktsegment"))
    page = F.when(k % 3 != 0, F.create_map(F.lit("Annots"), F.lit("x"), F.lit("Rotate"), F.lit("90")))
    stream = F.concat(F.lit("q /Im10 Do Q /Fm"), k.cast("string"), F.lit(" Do /Im1 Do /Im1Do /Im$."), k.cast("string"), F.lit("\nDo /Im1 Dot"))
    images = F.when(k % 2 == 0, F.array(F.lit("/Im1"), F.concat(F.lit("/Im$."), k.cast("string")))).otherwise(F.array(F.lit("/Im1")))
    line = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", line(streams.without_metadata(info)).alias("info"), line(streams.without_entries(page, streams.REMOVED_FROM_PAGE)).alias("page"), streams.without_images(stream, images).alias("stream"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then [strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%Y-%m-%d')][o_orderkey % 5 % 3 + 1] when 1 then [strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%Y-%m-%d')][o_orderkey % 5 % 2 + 1]
 when 2 then [strftime(o_orderdate, '%Y年%m月%d日'), strftime(o_orderdate, '%Y/%m/%d')][o_orderkey % 5 % 2 + 1] when 3 then [strftime(o_orderdate, '%Y년 %m월 %d일'), strftime(o_orderdate, '%Y.%m.%d')][o_orderkey % 5 % 2 + 1] when 4 then strftime(o_orderdate, '%d.%m.%Y')
 else [strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%Y-%m-%d')][o_orderkey % 5 % 3 + 1] end as day from orders""")
def q_local_dates(spark, sf_dir):
    """Dates in the forms of their languages."""
    o = F.col("o_orderkey")
    language = F.element_at(F.array(*map(F.lit, ["en", "de", "zh", "ko", "ru", "unknown"])), (o % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.local_date(F.col("o_orderdate"), language, o % 5).alias("day"))


@query("""with p as (select p_partkey, 3000.0 + p_size as w, 2000.0 + p_partkey % 90 as h, p_size * 31.3 as x, p_partkey % 977 * 1.7 as y from part)
select p_partkey, round(x * ((w + 0.5) / w) + 4, 6) as x, round(h - y * ((h + 0.5) / h) + 4, 6) as y, round_even(least(greatest(round_even(x, 0) * (w + 0.5) / w + 4, 4), w + 3), 0) as line_x, round_even(least(greatest(h - round_even(y, 0) * (h + 0.5) / h + 4, 4), h + 3), 0) as line_y from p""")
def q_image_points(spark, sf_dir):
    """Points and lines of pages in their images."""
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 3000.0).alias("w"), (F.col("p_partkey") % 90 + 2000.0).alias("h"), (F.col("p_size") * 31.3).alias("x"), (F.col("p_partkey") % 977 * 1.7).alias("y"))
    x, y = layout.image_point(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return rounded(pages.select("p_partkey", x.alias("x"), y.alias("y"), layout.image_line(F.col("x"), F.col("w"), False).alias("line_x"), layout.image_line(F.col("y"), F.col("h"), True).alias("line_y")), "x", "y")


@query("""with p as (select p_partkey, 500.0 + p_size as n, p_size % 2 = 0 as anchored, cast(p_partkey % 83 as double) as origin from part),
s as (select *, case when anchored then origin - floor(origin / 60) * 60 else (n - floor(n / 60) * 60) / 2 end as start, case when anchored then n else (n - floor(n / 60) * 60) / 2 + floor(n / 60) * 60 end as stop from p),
f as (select *, case when anchored then start - floor(start / 12) * 12 else start end as first from s),
j as (select p_partkey, start + unnest(range(cast(floor((stop - start) / 60) as bigint) + 1)) * 60 as v from s), m as (select p_partkey, first + unnest(range(cast(floor((stop - first) / 12) as bigint) + 1)) * 12 as v from f),
o as (select m.* from m where not exists (select 1 from j where j.p_partkey = m.p_partkey and round_even(j.v, 0) = round_even(m.v, 0)))
select p_partkey, (select count(*) from j where j.p_partkey = p.p_partkey) as major, (select round(sum(v), 4) from j where j.p_partkey = p.p_partkey) as major_sum, (select count(*) from o where o.p_partkey = p.p_partkey) as minor, (select round(sum(v), 4) from o where o.p_partkey = p.p_partkey) as minor_sum from p""")
def q_lattice_lines(spark, sf_dir):
    """Fine and coarse lines of pages, centred or anchored."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") + 500.0).alias("n"), (F.col("p_partkey") % 83).cast("double").alias("origin"))
    centred, anchored = layout.lattice_lines(F.col("n")), layout.lattice_lines(F.col("n"), F.col("origin"))
    choose = lambda i: F.when(F.col("p_size") % 2 == 0, anchored[i]).otherwise(centred[i])
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    lines = part.select("p_partkey", choose(0).alias("j"), choose(1).alias("m"))
    return lines.select("p_partkey", F.size("j").cast("bigint").alias("major"), total("j").alias("major_sum"), F.size("m").cast("bigint").alias("minor"), total("m").alias("minor_sum"))


@query("""with s as (select user_id, event_id, value / 100 as mv, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n, lag(value) over w as a, lead(value) over w as b, value from events window w as (partition by user_id order by ts, event_id)),
p as (select user_id, i, row_number() over (partition by user_id order by abs(value) desc, i) as place from s where (value > a and value > b) or (value < a and value < b)),
m as (select s.* from s left join p on s.user_id = p.user_id and s.i = p.i and p.place <= 5 where p.place is not null or s.i % greatest(1, n // 5) = 0 or s.i = n - 1)
select user_id, cast(i as bigint) as index, round((event_id % 19 - 9) / 12.0, 6) as error_mm, case when abs((event_id % 19 - 9) / 12.0) <= 0.5 + 1e-9 then 'PASS' else 'FAIL' end as status from m""")
def q_verify_leads(spark, sf_dir):
    """Traces drawn up to nine pixels off, measured at their peaks and at regular places."""
    drawn_ones = samples(spark, sf_dir).select("user_id", "event_id", "t", (F.col("v") / 100).alias("mv"), F.lit(300.0).alias("base"), (300 - F.col("v") / 100 * 120 - (F.col("event_id") % 19 - 9)).alias("y"))
    found = verify.lead_points(drawn_ones, ["user_id"], ["t", "event_id"], "mv", "y", "base", tolerance=0.5 + 1e-9)
    return rounded(found.select("user_id", F.col("index").cast("bigint").alias("index"), "error_mm", "status"), "error_mm")


@query("""with p as (select cast(s_suppkey as bigint) as page_id, [200, 100, 60][s_suppkey % 3 + 1] as n from supplier) select page_id, case when page_id % 7 <> 5 or (page_id % 7 <> 3 and 12 * n >= 50) then case when page_id % 4 = 0 then 'raster' else 'drawn' end else 'raster' end as kind from p""")
def q_inspected(spark, sf_dir):
    """Documents by their first pages; of every fourth only a later page was read."""
    ops = drawn(spark, sf_dir)[0].withColumn("page", F.when(F.col("page_id") % 4 == 0, 2).otherwise(1))
    documents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"))
    return files.inspected(documents, ops, "page_id")


@query("""with s as (select s_suppkey as k, s_nationkey as n from supplier),
g as (select k, 'grid_major' as mask, cast(k % 30 as integer) as y, unnest(range(20)) as x from s union all select k, 'grid_major', cast(k % 30 as integer), unnest(range(20)) from s),
l as (select k, 'lead_labels' as mask, unnest(range(cast(n % 10 as bigint), cast(n % 10 + 4 as bigint))) as y, 7 as x from s),
d as (select k, 'signal_I' as mask, cast(n as integer) as y, cast(k % 20 as integer) as x from s)
select k, mask, y, x, 255 as value from (select * from g union all select * from l union all select * from d) where x between 0 and 19 and y between 0 and 29 group by all""")
def q_page_masks(spark, sf_dir):
    """Masks of pages from points, lines and boxes."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lines = s.select("k", F.lit("grid_major").alias("mask"), F.array(point(F.lit(0), F.col("k") % 30), point(F.lit(19), F.col("k") % 30)).alias("pts"))
    shapes = s.select("k", F.lit("lead_labels").alias("mask"), F.lit(7).alias("x0"), F.lit(7).alias("x1"), (F.col("n") % 10).alias("y0"), (F.col("n") % 10 + 3).alias("y1"))
    points = s.select("k", F.lit("signal_I").alias("mask"), (F.col("k") % 20).cast("double").alias("x"), F.col("n").cast("double").alias("y"))
    return raster.page_masks(["k"], 20, 30, points, lines, shapes)


_ALIAS = min(text.ALIASES)
_SHOWN = ["I", "II", " V1 ", "Smith", "aVR", _ALIAS, "v", "V6"]
_READ = ["I", "II", "V1", None, "aVR", text.ALIASES[_ALIAS], None, "V6"]


@query(f"""with t as (select l_orderkey, l_linenumber, {[x or "" for x in _READ]!r}[l_partkey % 8 + 1] as label, l_suppkey from lineitem)
select l_orderkey, label, min(l_linenumber * 1000000 + l_suppkey)::bigint as pos, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey)::double as x from t where label <> '' group by all""")
def q_page_labels(spark, sf_dir):
    """Lead labels among a page's texts, the first of those that repeat."""
    shown = F.get(F.array(*map(F.lit, _SHOWN)), (F.col("l_partkey") % 8).cast("int"))
    texts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).cast("bigint").alias("pos"), shown.alias("text"), F.col("l_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return drawing.labels(texts).select(F.col("page_id").alias("l_orderkey"), F.col("text").alias("label"), "pos", "x")


@query(f"""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, 'doc.' || o_custkey || case when n = 1 then '.PDF' else '_p' || i || '.pdf' end as page_name, n = 1 or o_orderkey % 97 >= {files.DRAWN_FROM} as is_drawn from o""")
def q_expanded_pages(spark, sf_dir):
    """Documents of several pages taken apart; those of one page pass."""
    page = F.struct("o_orderkey", (F.col("o_orderkey") % 97).alias("n"))
    documents = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(page)).alias("pages")).withColumn("name", F.format_string("doc.%d.PDF", "o_custkey"))
    return files.pages_of_documents(documents, "name", "pages", "n").select("page.o_orderkey", F.col("page_name"), "is_drawn")


_NOISES = [*noise.SUFFIX, "other"]


@query(f"""select o_orderkey, 'ecg_' || o_orderkey || {[*noise.SUFFIX.values(), ""]!r}[o_orderkey % {len(_NOISES)} + 1] as name from orders""")
def q_noise_names(spark, sf_dir):
    """Records named by the noise that was added; unknown noises add nothing."""
    kind = F.get(F.array(*map(F.lit, _NOISES)), (F.col("o_orderkey") % len(_NOISES)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ecg_"), F.col("o_orderkey").cast("string"), noise.suffix(kind)).alias("name"))
