"""Aggregations, clusters and windows over traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripchart.functions import arrays, codec, numeric
from stripchart.operators import cluster, geometry, match, raster, signal, stats
from stripchart.queries.registry import SAMPLES_SQL, query, rounded, samples, table

KEY, ORDER = ["user_id"], ["t", "event_id"]


@query(f"""{SAMPLES_SQL}, g as (select user_id, t - lag(t) over (partition by user_id order by t, event_id) as gap from samples),
s as (select user_id, gap, row_number() over (partition by user_id order by gap) - 1 as i, count(*) over (partition by user_id) as n from g where gap is not null)
select user_id, cast(max(n) as bigint) as gaps, round(max(case when i = n // 2 then gap end), 6) as median_gap from s group by user_id""")
def q_upper_median_gap(spark, sf_dir):
    """Element n // 2 of the sorted distances between samples."""
    found = stats.spacing(samples(spark, sf_dir), KEY, "t", ORDER)
    return rounded(found.select("user_id", "gaps", "median_gap"), "median_gap")


@query(f"""{SAMPLES_SQL}, o as (select user_id, row_number() over (partition by user_id order by t, event_id) as i from samples),
e as (select user_id, i * 2.0 + (i % 3) * 0.01 * (user_id % 10) as t from o), g as (select user_id, t - lag(t) over (partition by user_id order by t) as gap from e),
s as (select user_id, gap, row_number() over (partition by user_id order by gap) - 1 as i, count(*) over (partition by user_id) as n from g where gap is not null),
m as (select user_id, max(case when i = n // 2 then gap end) as m from s group by user_id)
select s.user_id, bool_and(m > 0 and abs(gap - m) / m <= 0.10) as uniform from s join m using (user_id) group by s.user_id""")
def q_uniformity(spark, sf_dir):
    """Whether every distance is within a tenth of the median one; traces whose samples are moved
    off an even axis by a share of up to a tenth, by user."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    rows = samples(spark, sf_dir).select("user_id", place.alias("i")).select("user_id", (F.col("i") * 2.0 + F.col("i") % 3 * 0.01 * (F.col("user_id") % 10)).alias("t"))
    return stats.spacing(rows, KEY, "t", ["t"], tolerance=0.10).select("user_id", "uniform")


@query(f"""{SAMPLES_SQL}, b as (select user_id, floor(v) as bin, count(*) as n, min(row(t, event_id)) as first from samples group by user_id, floor(v)),
r as (select user_id, bin, sum(n) over (partition by user_id) as total, row_number() over (partition by user_id order by n desc, first) as place from b),
one as (select user_id, min(v) as v from samples group by user_id)
select r.user_id, case when total = 1 then v else bin + 0.5 end as baseline from r join one using (user_id) where place = 1""")
def q_mode_baseline(spark, sf_dir):
    """Baseline by histogram mode, first-met bin on ties."""
    return stats.histogram_mode(samples(spark, sf_dir), KEY, "v", ORDER)


@query(f"""{SAMPLES_SQL}, p as (select user_id, v, event_id % 7 as w from samples),
f as (select *, case when v - lag(v) over (partition by user_id order by v, w) < 0.8 then 0 else 1 end as new from p),
c as (select *, sum(new) over (partition by user_id order by v, w rows unbounded preceding) - 1 as cluster from f)
select user_id, cast(cluster as bigint) as cluster, round(avg(v), 6) as v, max(w) as w, count(*) as n from c group by user_id, cluster""")
def q_gap_cluster(spark, sf_dir):
    """Lines nearer than a distance merge; an equal gap splits."""
    lines = samples(spark, sf_dir).select("user_id", "v", (F.col("event_id") % 7).alias("w"))
    return rounded(cluster.merged_lines(lines, KEY, "v", "w", 0.8).select("user_id", F.col("cluster").cast("bigint").alias("cluster"), "v", "w", "n"), "v")


@query(f"""{SAMPLES_SQL}, p as (select user_id, floor(v) as v, event_id from samples),
f as (select *, case when v - lag(v) over (partition by user_id order by v, event_id) <= 2 then 0 else 1 end as new from p),
c as (select *, sum(new) over (partition by user_id order by v, event_id rows unbounded preceding) - 1 as cluster from f)
select user_id, cast(cluster as bigint) as cluster, cast(min(v) as double) as lo, cast(max(v) as double) as hi, count(*) as n from c group by user_id, cluster""")
def q_value_clusters(spark, sf_dir):
    """Single-link clusters; an equal gap still merges."""
    points = samples(spark, sf_dir).select("user_id", "event_id", F.floor("v").cast("double").alias("v"))
    found = cluster.gap_clusters(points, KEY, "v", 2.0, ["v", "event_id"])
    return found.groupBy("user_id", F.col("cluster").cast("bigint").alias("cluster")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))


@query(f"""{SAMPLES_SQL}, p as (select user_id, row_number() over (partition by user_id order by t, event_id) - 1 as i, v, event_type from samples),
s as (select user_id, i, event_type as style, cast(i as double) as x0, v as y0, i + 1.0 as x1, case when i % 4 = 3 then v + 3 else lead(v) over (partition by user_id order by i) end as y1 from p),
k as (select * from s where y1 is not null),
f as (select *, case when style = lag(style) over w and pow(x0 - lag(x1) over w, 2) + pow(y0 - lag(y1) over w, 2) <= 0.25 then 0 else 1 end as new from k window w as (partition by user_id order by i)),
c as (select *, sum(new) over (partition by user_id order by i rows unbounded preceding) as island from f)
select user_id, min(i) as first, count(*) + 1 as points, min(style) as style, round(arg_min(y0, i) + sum(y1 * (i + 1)), 4) as weight from c group by user_id, island""")
def q_weld_islands(spark, sf_dir):
    """Two-point segments of one style that start where the last one ended, welded to polylines;
    every fourth ends elsewhere."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = samples(spark, sf_dir).select("user_id", (F.row_number().over(w) - 1).alias("i"), "v", "event_type", F.lead("v").over(w).alias("next"))
    end = F.when(F.col("i") % 4 == 3, F.col("v") + 3).otherwise(F.col("next"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y"))
    segments = rows.withColumn("end", end).where("end is not null").select("user_id", "i", F.array(point(F.col("i"), F.col("v")), point(F.col("i") + 1, F.col("end"))).alias("pts"), "event_type")
    lines = cluster.welded(segments, KEY, "i", style=("event_type",))
    weight = F.expr("pts[0].y + aggregate(transform(slice(pts, 2, size(pts) - 1), (p, k) -> p.y * (i + k + 1)), 0D, (a, x) -> a + x)")
    return lines.select("user_id", F.col("i").cast("bigint").alias("first"), F.size("pts").cast("bigint").alias("points"), F.col("event_type").alias("style"), F.round(weight, 4).alias("weight"))


@query(f"""{SAMPLES_SQL}, x as (select *, lag(v) over w as a, lead(v) over w as b from samples window w as (partition by user_id order by t, event_id)),
p as (select *, row_number() over (partition by user_id order by abs(v) desc, t, event_id) as place from x where (v > a and v > b) or (v < a and v < b))
select user_id, event_id, v, place from p where place <= 5""")
def q_peaks_top5(spark, sf_dir):
    """The five highest strict turning points of each trace."""
    return signal.peaks(samples(spark, sf_dir), KEY, ORDER, "v", 5).select("user_id", "event_id", "v", F.col("place").cast("bigint").alias("place"))


@query(f"""{SAMPLES_SQL}, i as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as idx, count(*) over (partition by user_id) as n,
 lag(v) over (partition by user_id order by t, event_id) as a, lead(v) over (partition by user_id order by t, event_id) as b from samples),
p as (select user_id, idx, row_number() over (partition by user_id order by abs(v) desc, t, event_id) as place from i where (v > a and v > b) or (v < a and v < b))
select i.user_id, cast(i.idx as bigint) as index, v, p.place is not null as is_peak from i left join p on i.user_id = p.user_id and i.idx = p.idx and p.place <= 5
where p.place is not null or i.idx % greatest(1, n // 5) = 0 or i.idx = n - 1""")
def q_measurement_points(spark, sf_dir):
    """Peaks and regular samples to measure a trace at."""
    found = signal.measurement_points(samples(spark, sf_dir), KEY, ORDER, "v", 10)
    return found.select("user_id", F.col("index").cast("bigint").alias("index"), "v", "is_peak")


@query(f"{SAMPLES_SQL} select event_id, round(v - median(v) over (partition by user_id), 6) as centred from samples")
def q_median_center(spark, sf_dir):
    return rounded(signal.centred(samples(spark, sf_dir), KEY, "v").select("event_id", "centred"), "centred")


@query(f"""{SAMPLES_SQL} select event_id, round(coalesce(sum(v) over (partition by user_id order by t, event_id rows between 50 preceding and 49 following), 0) / 100, 6) as smooth from samples""")
def q_moving_average(spark, sf_dir):
    return rounded(signal.moving_average(samples(spark, sf_dir), KEY, ORDER, "v").select("event_id", "smooth"), "smooth")


@query(f"""{SAMPLES_SQL}, b as (select user_id, min(v) as base from samples group by user_id)
select event_id, floor(((base - v) / 40) * 10000 + 0.5) / 10000 as mv from samples join b using (user_id)""")
def q_js_round_mv(spark, sf_dir):
    """Strokes to millivolts, four decimals, halves up, inverted axis."""
    rows = samples(spark, sf_dir)
    base = rows.groupBy("user_id").agg(F.min("v").alias("base"))
    return signal.millivolts(rows.join(base, "user_id"), "v", "base", 40.0, inverted=True).select("event_id", "mv")


@query(f"{SAMPLES_SQL} select user_id, count(*) as n, min(t) as x0, max(t) as x1, min(v) as y0, max(v) as y1, round((min(t) + max(t)) / 2, 3) as cx, round((min(v) + max(v)) / 2, 3) as cy, round(max(t) - min(t), 3) as dx, round(max(v) - min(v), 3) as dy from samples group by user_id")
def q_bbox(spark, sf_dir):
    return rounded(stats.bounding_box(samples(spark, sf_dir), KEY, "t", "v"), "cx", "cy", "dx", "dy", digits=3)


@query("""with e as (select vec_id, list_min(list_transform(embedding, lambda x: cast(x as double))) as lo, list_max(list_transform(embedding, lambda x: cast(x as double))) as hi from embeddings)
select vec_id, round(lo, 6) as lo, round(hi, 6) as hi, round((lo + hi) / 2, 6) as centre from e""")
def q_array_extent(spark, sf_dir):
    """Extent of an array column, without taking it apart."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    return rounded(v.select("vec_id", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"), ((F.array_min("v") + F.array_max("v")) / 2).alias("centre")), "lo", "hi", "centre")


@query(f"""{SAMPLES_SQL}, s as (select user_id, t - lag(t) over w as dt, v - lag(v) over w as dv from samples window w as (partition by user_id order by t, event_id))
select user_id, coalesce(bool_and(dt >= -0.5), true) as x_up, coalesce(bool_and(dv >= -300), true) as y_up_300, coalesce(bool_and(dv <= 300), true) as y_down_300 from s group by user_id""")
def q_monotone_share(spark, sf_dir):
    """Whether traces run one way along an axis, within a tolerance."""
    rows = samples(spark, sf_dir)
    time = stats.monotone(rows, KEY, "t", "v", ORDER, 0.5).select("user_id", "x_up")
    value = stats.monotone(rows, KEY, "t", "v", ORDER, 300.0).select("user_id", F.col("y_up").alias("y_up_300"), F.col("y_down").alias("y_down_300"))
    return time.join(value, "user_id")


@query(f"""{SAMPLES_SQL}, e as (select user_id, (v - 250) / 500 as e from samples)
select user_id, count(*) as n, round(arg_max(e, row(abs(e), e)), 6) as max_error, round(avg(e), 6) as mean_error, round(stddev_pop(e), 6) as std_error,
 count(*) filter (abs(e) <= 0.49) as passed, count(*) filter (abs(e) > 0.49) as failed, case when count(*) filter (abs(e) > 0.49) > 0 then 'FAIL' else 'PASS' end as status from e group by user_id""")
def q_verify_summary(spark, sf_dir):
    """Errors of measured points per trace, the largest with its sign."""
    errors = samples(spark, sf_dir).select("user_id", ((F.col("v") - 250) / 500).alias("e"))
    return rounded(stats.error_summary(errors, KEY, "e", 0.49), "max_error", "mean_error", "std_error")


@query("""with g as (select l_orderkey, count(*) as n from lineitem group by l_orderkey), r as (select g.n, o_custkey, l_orderkey, max(g.n) over (partition by o_custkey) as longest from g join orders on l_orderkey = o_orderkey where g.n > 1),
k as (select *, row_number() over (partition by o_custkey order by n desc, l_orderkey) as place from r where n >= longest * 0.5)
select o_custkey, l_orderkey, n from k where place <= 3""")
def q_top_traces(spark, sf_dir):
    """Long rows of a page against its longest, and the first few of them."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    pages = sizes.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "n")
    limits = pages.select("*", *(F.lit(0.0).alias(c) for c in "rgb"), F.lit(0.15).alias("black_threshold"), F.lit(1).alias("min_points"), F.lit(0.5).alias("min_size_ratio"), F.lit(3).alias("max_traces"))
    return geometry.signal_traces(limits, ["o_custkey"], "l_orderkey").select("o_custkey", "l_orderkey", "n")


@query("""with g as (select l_returnflag as flag, l_linestatus as status, count(*) as n, min(row(l_orderkey, l_linenumber)) as first from lineitem where l_quantity >= 10 group by 1, 2)
select flag, status, n from g order by n desc, first limit 1""")
def q_dominant_group(spark, sf_dir):
    """The style that most long strokes have."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_orderkey", "l_linenumber")
    return stats.dominant_group(rows, ["flag", "status"], F.col("l_quantity") >= 10, ["l_orderkey", "l_linenumber"])


@query("select p_partkey, p_size > (min(p_size) over () + max(p_size) over ()) / 2.0 as major from part")
def q_width_threshold(spark, sf_dir):
    """Wide lines against the middle of the widths."""
    return stats.width_threshold(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [], "p_size").select("p_partkey", "major")


@query("select p_brand, count(*) as total, count(*) filter (v = 255) as signal, count(*) filter (v = 0) as background, count(*) filter (v not in (0, 255)) as other, round(count(*) filter (v = 255) * 100.0 / count(*), 6) as percent, bool_and(v in (0, 255)) as is_binary from (select p_brand, case when p_size > 25 then 255 when p_size < 25 then 0 else 128 end as v from part) group by p_brand")
def q_mask_statistics(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", F.expr("case when p_size > 25 then 255 when p_size < 25 then 0 else 128 end").alias("v"))
    return rounded(stats.mask_statistics(part, ["p_brand"], "v"), "percent")


@query("select l_linestatus, count(*) as n, round(sum(l_tax), 4) as total, round(avg(l_tax), 6) as mean, min(l_tax) as least, max(l_tax) as most from lineitem group by l_linestatus")
def q_timing_log(spark, sf_dir):
    return rounded(rounded(stats.timing(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_tax"), "mean"), "total", digits=4)


@query("""select cast(floor(value / 100) as integer) as y, cast(event_id % 16 as integer) as x, max(cast(floor(value) % 256 as integer)) as value from events group by 1, 2""")
def q_max_merge(spark, sf_dir):
    """Masks merged by the greatest value of each pixel."""
    e = table(spark, sf_dir, "events")
    pixels = e.select(F.floor(F.col("value") / 100).cast("int").alias("y"), (F.col("event_id") % 16).cast("int").alias("x"), (F.floor("value") % 256).cast("int").alias("value"))
    return raster.merged(pixels, [])


@query(f"""{SAMPLES_SQL}, c as (select user_id, event_type, count(*) as n, case when user_id % 4 = 0 then 0 else (max(t) - min(t)) / 1000 end as d from samples group by user_id, event_type),
r as (select *, case when d > 0 then cast(floor(n / d * 1000) as integer) else 0 end as rate from c)
select user_id, round(case when max(d) > 0 then max(d) else 10 end, 6) as duration_s, case when max(rate) > 0 then max(rate) else 500 end as sample_rate_hz, max(n) as samples, count(*) as channels from r group by user_id""")
def q_channel_metadata(spark, sf_dir):
    """Longest channel, highest rate and most samples of a record, with what holds where there is none."""
    each = samples(spark, sf_dir).groupBy("user_id", "event_type").agg(arrays.in_order("struct(t, event_id)", "v").alias("samples"), ((F.max("t") - F.min("t")) / 1000).alias("d"))
    channels = each.withColumn("duration_s", F.when(F.col("user_id") % 4 == 0, 0.0).otherwise(F.col("d")))
    channels = channels.withColumn("sample_rate_hz", F.when(F.col("duration_s") > 0, F.floor(F.size("samples") / F.col("duration_s") * 1000)).otherwise(0).cast("int"))
    found = signal.channel_metadata(channels, KEY)
    return rounded(found, "duration_s").withColumn("samples", F.col("samples").cast("bigint"))


@query(f"""{SAMPLES_SQL} select event_id, cast(least(65535, greatest(0, round_even((v * 9 - 250 + 200) * 16, 0))) as integer) as code,
 round(least(65535, greatest(0, round_even((v * 9 - 250 + 200) * 16, 0))) / 16 - 200, 6) as decoded from samples""")
def q_encode_u16(spark, sf_dir):
    """Coordinates as unsigned 16-bit, halves to even, clamped."""
    coded = samples(spark, sf_dir).withColumn("code", codec.map_code(F.col("v") * 9 - 250))
    return rounded(coded.select("event_id", "code", codec.map_coordinate(F.col("code")).alias("decoded")), "decoded")


@query(f"""{SAMPLES_SQL}, a as (select user_id, list(v order by t, event_id) as s, count(*) as n from samples group by user_id), k as (select user_id, s, n, unnest(range(cast(n * 2 as bigint))) as i from a)
select user_id, i as pos, s[cast(i % n as bigint) + 1] as v from k""")
def q_cyclic_repeat(spark, sf_dir):
    """A channel repeated from its start to twice its length."""
    made = samples(spark, sf_dir).groupBy("user_id").agg(arrays.in_order("struct(t, event_id)", "v").alias("s"))
    longer = made.select("user_id", arrays.cyclic("s", "(2 * size(s))").alias("s"))
    return longer.select("user_id", F.posexplode("s").alias("pos", "v")).select("user_id", F.col("pos").cast("bigint").alias("pos"), "v")


@query(f"""{SAMPLES_SQL}, a as (select user_id, list(v order by t, event_id) as s, count(*) as n, (max(t) - min(t)) / 86400 as d from samples group by user_id),
k as (select *, case when abs(7.0 - d) < 1e-3 then n else greatest(1, cast(floor(7.0 * n / d + 0.5) as bigint)) end as m from a where d > 0), i as (select *, unnest(range(m)) as pos from k)
select user_id, pos, s[cast(pos % n as bigint) + 1] as v from i""")
def q_fit_duration(spark, sf_dir):
    """Channels cut or repeated to seven days at their own rate, sample by sample."""
    made = samples(spark, sf_dir).groupBy("user_id").agg(arrays.in_order("struct(t, event_id)", "v").alias("s"), ((F.max("t") - F.min("t")) / 86400).alias("d")).where("d > 0")
    fitted = made.select("user_id", F.posexplode(arrays.fit_to_duration("s", "d", 7.0)).alias("pos", "v"))
    return fitted.withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""{SAMPLES_SQL}, a as (select user_id, event_type, list(v order by t, event_id) as s, count(*) as n, (max(t) - min(t)) / 86400 as d from samples group by user_id, event_type),
k as (select *, unnest(range(cast(n * case when d >= 30 then 1 else greatest(1, ceil(30 / d - 0.05)) end as bigint))) as pos from a where d > 10)
select user_id, event_type, pos, s[cast(pos % n as bigint) + 1] as v from k""")
def q_rhythm_repeat(spark, sf_dir):
    """Short rhythm channels repeated in whole, sample by sample."""
    made = samples(spark, sf_dir).groupBy("user_id", "event_type").agg(arrays.in_order("struct(t, event_id)", "v").alias("s"), ((F.max("t") - F.min("t")) / 86400).alias("d")).where("d > 10")
    longer = made.select("user_id", "event_type", F.posexplode(arrays.repeated_to("s", "d", 30.0)).alias("pos", "v"))
    return longer.withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""{SAMPLES_SQL}, p as (select user_id, v, row_number() over (partition by user_id order by t, event_id) - 1 as i, count(*) over (partition by user_id) as n from samples),
h as (select user_id, i // 2 as pos, max(case when i % 2 = 0 then v end) as a, max(case when i % 2 = 1 then v end) as b from p where i < n - n % 2 group by 1, 2)
select user_id, pos, round(b - a, 6) as iii, round(-(a + b) / 2, 6) as avr, round((a - (b - a)) / 2, 6) as avl, round((b + (b - a)) / 2, 6) as avf from h""")
def q_derived_leads(spark, sf_dir):
    """Limb leads from the first two, which take turns in each trace."""
    made = samples(spark, sf_dir).groupBy("user_id").agg(arrays.in_order("struct(t, event_id)", "v").alias("s"))
    half = lambda k: F.expr(f"transform(sequence(0, size(s) div 2 - 1), i -> s[cast(2 * i + {k} as int)])")
    two = made.where("size(s) > 1").select("user_id", half(0).alias("a"), half(1).alias("b"))
    leads = two.select("user_id", F.arrays_zip(*(arrays.derived("a", "b", n).alias(n) for n in ("III", "aVR", "aVL", "aVF"))).alias("z"))
    each = leads.select("user_id", F.posexplode("z").alias("pos", "z")).select("user_id", F.col("pos").cast("bigint").alias("pos"), *(F.col("z")[n].alias(n.lower()) for n in ("III", "aVR", "aVL", "aVF")))
    return rounded(each, "iii", "avr", "avl", "avf")


@query(f"""{SAMPLES_SQL} select user_id, row_number() over (partition by user_id order by t, event_id) - 1 as pos, cast(least(32767, greatest(-32768, floor((v - 250) * 0.1 * 1000 / 0.5 + 0.5))) as integer) as count,
 round(least(32767, greatest(-32768, floor((v - 250) * 0.1 * 1000 / 0.5 + 0.5))) * 0.5 / 1000, 6) as mv from samples""")
def q_int16_roundtrip(spark, sf_dir):
    """Traces to base64 of 16-bit counts and back, sample by sample."""
    made = samples(spark, sf_dir).groupBy("user_id").agg(arrays.in_order("struct(t, event_id)", "(v - 250) * 0.1D").alias("s"))
    coded = made.withColumn("c", codec.adc_counts("s")).withColumn("b64", codec.int16_base64("c")).withColumn("mv", codec.int16_samples("b64", "0.5"))
    each = coded.select("user_id", F.posexplode(F.arrays_zip("c", "mv")).alias("pos", "z"))
    return rounded(each.select("user_id", F.col("pos").cast("bigint").alias("pos"), F.col("z.c").alias("count"), F.col("z.mv").alias("mv")), "mv")


@query(f"""{SAMPLES_SQL}, a as (select user_id, list(cast(floor(v / 100 * 1000 / 5 + 0.5) as bigint) order by t, event_id) as d, count(*) as n from samples group by user_id), m as (select max(n) as longest from a)
select user_id, array_to_string(list_concat(d, list_transform(range(cast(longest - n as bigint)), lambda x: 0)), ' ') as digits from a, m""")
def q_hl7_digits(spark, sf_dir):
    """Digits of each channel, padded with zeros to the longest."""
    made = samples(spark, sf_dir).groupBy("user_id").agg(arrays.in_order("struct(t, event_id)", "v / 100").alias("s"))
    longest = made.agg(F.max(F.size("s")).alias("longest"))
    return made.crossJoin(F.broadcast(longest)).select("user_id", codec.hl7_digits("s", "longest").alias("digits"))


@query(f"""{SAMPLES_SQL}, g as (select user_id, cast(unnest(range(cast(floor(min(t)) as bigint), cast(floor(max(t)) as bigint) + 1, 43200)) as double) as at_s from samples group by user_id),
j as (select g.user_id, g.at_s, lo.t as t0, lo.v as v0 from g asof left join samples lo on g.user_id = lo.user_id and g.at_s >= lo.t),
k as (select j.*, hi.t as t1, hi.v as v1 from j asof left join samples hi on j.user_id = hi.user_id and j.at_s <= hi.t)
select user_id, at_s, round(v0 + (v1 - v0) * case when t1 = t0 then 0 else (at_s - t0) / (t1 - t0) end, 4) as v from k""")
def q_asof_interp(spark, sf_dir):
    """Traces at even times, between the samples around each."""
    rows = samples(spark, sf_dir)
    grid = rows.groupBy("user_id").agg(F.floor(F.min("t")).alias("lo"), F.floor(F.max("t")).alias("hi")).select("user_id", F.explode(F.expr("transform(sequence(lo, hi, 43200), x -> cast(x as double))")).alias("at_s"))
    return rounded(match.bracketed(rows, grid, KEY, "t", "v", "at_s"), "v", digits=4)


@query(f"""{SAMPLES_SQL} select event_id, round(case event_id % 4 when 1 then 600 - v when 2 then 800 - event_id % 100 when 3 then v else event_id % 100 end, 6) as x,
 round(case event_id % 4 when 1 then event_id % 100 when 2 then 600 - v when 3 then 800 - event_id % 100 else v end, 6) as y,
 round(2 * (event_id % 100) + 0.5 * v + 10, 6) as ax, round(-1 * v + 20, 6) as ay from samples""")
def q_rotate_affine(spark, sf_dir):
    """Points turned with their page, and through a product of affine maps."""
    rows = samples(spark, sf_dir).select("event_id", (F.col("event_id") % 100).cast("double").alias("px"), F.col("v").alias("py"), (F.col("event_id") % 4 * 90).alias("turn"))
    x, y = geometry.rotated(F.col("px"), F.col("py"), F.col("turn"), F.lit(800.0), F.lit(600.0))
    product = rows.select("*", x.alias("x"), y.alias("y"), F.expr("array(1D,0D,0D,1D,10D,20D)").alias("m1"), F.expr("array(2D,0D,0.5D,-1D,0D,0D)").alias("m2")).withColumn("m", geometry.affine_product("m1", "m2"))
    return rounded(product.withColumn("p", geometry.affine("m", "px", "py")).select("event_id", "x", "y", F.col("p.x").alias("ax"), F.col("p.y").alias("ay")), "x", "y", "ax", "ay")


@query(f"{SAMPLES_SQL} select event_id, floor(v / 7 - 35 + 0.5) as up, round_even(floor(v) / 2, 0) as even, least(greatest(v, 100.0), 300.0) as clipped from samples")
def q_rounding_rules(spark, sf_dir):
    """Halves up, halves to even, and clipping."""
    return samples(spark, sf_dir).select("event_id", numeric.half_up(F.col("v") / 7 - 35).alias("up"), numeric.half_even(F.floor("v").cast("double") / 2).alias("even"), numeric.clip(F.col("v"), 100.0, 300.0).alias("clipped"))
