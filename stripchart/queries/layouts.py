"""Joins by place, lookups and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripchart.functions.text import LEADS
from stripchart.operators import geometry, layout, match
from stripchart.queries.registry import SAMPLES_SQL, query, rounded, samples, table

_LEADS_SQL = "[" + ", ".join(f"'{x}'" for x in LEADS) + "]"


@query(f"""with c as (select c_custkey, c_nationkey as nation, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) - 1 as rank from customer),
s as (select s_name, s_nationkey as nation, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) - 1 as rank from supplier)
select c_custkey, cast(c.rank as bigint) as rank, coalesce(s_name, {_LEADS_SQL}[c.rank + 1], 'L' || (c.rank + 1)) as name from c left join s on c.nation = s.nation and c.rank = s.rank""")
def q_rank_pair(spark, sf_dir):
    """Traces with labels by their place, then standard names, then numbers."""
    traces = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    labels = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    paired = match.rank_join(traces, labels, ["nation"], ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"])
    return paired.select("c_custkey", F.col("rank").cast("bigint").alias("rank"), F.coalesce("s_name", match.lead_at(F.col("rank"))).alias("name"))


@query("""with h as (select s_suppkey, s_nationkey, s_acctbal, case when s_acctbal < (min(s_acctbal) over (partition by s_nationkey) + max(s_acctbal) over (partition by s_nationkey)) / 2 then 0 else 1 end as half from supplier),
r as (select *, row_number() over (partition by s_nationkey, half order by s_acctbal, s_suppkey) - 1 as rank from h)
select s_suppkey, half, 'L' || cast(rank + 1 + 6 * half as varchar) as name from r""")
def q_halves_pair(spark, sf_dir):
    """Upper and lower halves of a page, named by place within each."""
    split = match.halves(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal")
    placed = match.ranked(split, ["s_nationkey", "half"], ["s_acctbal", "s_suppkey"])
    return placed.select("s_suppkey", "half", F.when(F.col("half") == 0, match.fallback_name(F.col("rank"))).otherwise(match.fallback_name(F.col("rank"), 6)).alias("name"))


@query("""with p as (select s_suppkey, s_nationkey % 5 as page, s_acctbal as cx, s_suppkey % 17 as cy from supplier),
f as (select *, case when cx - lag(cx) over (partition by page order by cx, s_suppkey) <= 500 then 0 else 1 end as new from p),
c as (select *, sum(new) over (partition by page order by cx, s_suppkey rows unbounded preceding) - 1 as col from f),
r as (select *, row_number() over (partition by page, col order by cy, s_suppkey) - 1 as row from c)
select s_suppkey, cast(col as bigint) as col, cast(row as bigint) as row, [['I', 'II', 'III'], ['aVR', 'aVL', 'aVF'], ['V1', 'V2', 'V3'], ['V4', 'V5', 'V6']][cast(col + 1 as bigint)][cast(row + 1 as bigint)] as name from r where col < 4 and row < 3""")
def q_grid_pair(spark, sf_dir):
    """Columns by gaps, rows by rank, names from the grid; cells beyond it drop."""
    from stripchart.operators import cluster

    cells = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("page"), F.col("s_acctbal").alias("cx"), (F.col("s_suppkey") % 17).alias("cy"))
    columns = cluster.gap_clusters(cells, ["page"], "cx", 500.0, ["cx", "s_suppkey"], out="col")
    rows = match.ranked(columns, ["page", "col"], ["cy", "s_suppkey"], "row")
    grid = spark.createDataFrame([(i // 3, i % 3, n) for i, n in enumerate(["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"])], "col long, row int, name string")
    return rows.join(F.broadcast(grid), ["col", "row"]).select("s_suppkey", F.col("col").cast("bigint").alias("col"), F.col("row").cast("bigint").alias("row"), "name")


@query("""with l as (select distinct round(o_totalprice / 100) as c from orders), a as (select p_partkey, p_retailprice as v, l.c as lo from part asof left join l on p_retailprice >= l.c),
b as (select a.*, l.c as hi from a asof left join l on a.v <= l.c), n as (select p_partkey, v, case when hi is null or abs(v - lo) <= abs(hi - v) then lo else hi end as nearest from b)
select p_partkey, case when abs(nearest - v) <= 5 then nearest end as nearest from n""")
def q_nearest_snap(spark, sf_dir):
    """The nearest line within reach, the lower of two."""
    lines = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") / 100).alias("line")).distinct()
    return match.nearest(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", lines, "line", 5.0).select("p_partkey", "nearest")


@query("""select p_partkey, list_reduce([900.0::double, 1100.0::double, 1300.0::double, 1500.0::double], lambda best, c: case when abs(p_retailprice - c) < abs(p_retailprice - best) then c else best end) as line from part""")
def q_array_snap(spark, sf_dir):
    """The first nearest of a few candidates in an array."""
    part = table(spark, sf_dir, "part").withColumn("lines", F.array(*map(F.lit, (900.0, 1100.0, 1300.0, 1500.0))))
    return part.select("p_partkey", match.nearest_in("p_retailprice", "lines").alias("line"))


@query(f"""with names as (select n_nationkey, {_LEADS_SQL}[n_nationkey % 12 + 1] as name from nation)
select n_nationkey, case n_nationkey % 3 when 0 then name when 1 then case name when 'I' then 'DI' when 'II' then 'DII' when 'III' then 'DIII' when 'aVR' then 'AVr' when 'aVL' then 'AVl' when 'aVF' then 'AVf' else name end else 'x' end as shown,
 case when n_nationkey % 3 = 2 then null when n_nationkey % 3 = 1 and name in ('aVR', 'aVL', 'aVF') then null else name end as normal from names""")
def q_alias_lookup(spark, sf_dir):
    """Alternative names of leads, and labels back to standard names."""
    from stripchart.functions.text import normal_lead

    lead = F.get(F.array(*map(F.lit, LEADS)), F.col("n_nationkey") % 12)
    third = F.col("n_nationkey") % 3
    shown = F.when(third == 0, lead).when(third == 1, match.mapped(lead, layout.NOMENCLATURES["peripheriques"])).otherwise("x")
    return table(spark, sf_dir, "nation").select("n_nationkey", shown.alias("shown")).withColumn("normal", normal_lead(F.col("shown")))


@query("""with p(vendor, min_points, min_size_ratio) as (values ('AFRICA', 30, 0.10), ('ASIA', null, 0.05))
select n_nationkey, coalesce(min_points, 50) as min_points, coalesce(cast(min_size_ratio as double), 0.15) as min_size_ratio, coalesce(r_name, '') as vendor from nation join region on n_regionkey = r_regionkey left join p on vendor = r_name""")
def q_profile_merge(spark, sf_dir):
    """Defaults under the profile of each vendor."""
    profiles = spark.createDataFrame([("AFRICA", 30, 0.10), ("ASIA", None, 0.05)], "vendor string, min_points int, min_size_ratio double")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("vendor"))
    return match.coalesced_profile(nations, profiles, "vendor", {"min_points": 50, "min_size_ratio": 0.15}).select("n_nationkey", "min_points", "min_size_ratio", "vendor")


@query("""with o(lead_order, leads) as (values ('normal', ['I','II','III','aVR','aVL','aVF','V1','V2','V3','V4','V5','V6']), ('cabrera', ['aVL','I','aVR','II','aVF','III','V1','V2','V3','V4','V5','V6'])),
m as (select lead_order, leads, list_concat(list_filter(leads, lambda x: x in ('I','II','V1','V2','V3','V4','V5','V6')), list_filter(leads, lambda x: x not in ('I','II','V1','V2','V3','V4','V5','V6'))) as measured from o),
f(format, nrow, ncol, nrh) as (values ('3x4', 3, 4, 0), ('6x2+1', 6, 2, 1), ('4x2', 4, 2, 0), ('12x1', 12, 1, 0)),
c as (select format, nrow, ncol, nrh, unnest(range(nrow + nrh)) as row from f), d as (select *, unnest(range(ncol)) as col from c)
select format, lead_order, cast(row as integer) as row, cast(col as integer) as col, case when row < nrow then case when nrow * ncol < 12 then measured[col * nrow + row + 1] else leads[col * nrow + row + 1] end else 'II' end as lead from d, m""")
def q_layout_assign(spark, sf_dir):
    """The lead of every cell of some formats, in two orders."""
    orders = layout.lead_orders(spark, {k: layout.LEAD_ORDERS[k] for k in ("normal", "cabrera")})
    cells = layout.slots(spark).where(F.col("format").isin("3x4", "6x2+1", "4x2", "12x1"))
    return layout.assigned(cells, orders, ["II"]).select("format", "lead_order", "row", "col", "lead")


@query("select '6x1;6x1' as format, 2 as pages union all select unnest(['3x4','3x4_paramedic','3x4+1','3x4+2','3x4+3','6x2','6x2+1','4x2','4x2+1','12x1','3x4_cardiofax','3x4+1_cardiofax']), 1")
def q_layout_pages(spark, sf_dir):
    return layout.pages_of(layout.slots(spark)).select("format", F.col("pages").cast("int").alias("pages"))


@query(f"""{SAMPLES_SQL}, d as (select user_id, user_id % 2 = 0 as rhythm, (max(t) - min(t)) / 250000 as d from samples group by user_id)
select user_id, case when d <= 4 then '3x4+1' when d <= 8 then '6x2+1' else '12x1' end as native,
 case when d <= 4 then 'duration' when not rhythm and d <= 8 then 'rhythm' end as no_6x2_1, case when d <= 8 then 'duration' end as no_12x1, round(case when d > 4 and d <= 8 then d else 5.0 end, 6) as seconds_6x2 from d""")
def q_layout_available(spark, sf_dir):
    """What formats a record's length and channels allow."""
    d = samples(spark, sf_dir).groupBy("user_id").agg(((F.max("t") - F.min("t")) / 250000).alias("d")).withColumn("rhythm", F.col("user_id") % 2 == 0)
    native = layout.native_format(F.col("d"))
    return rounded(
        d.select(
            "user_id",
            native.alias("native"),
            layout.availability(F.col("d"), F.lit(4), F.lit(True), F.col("rhythm")).alias("no_6x2_1"),
            layout.availability(F.col("d"), F.lit(8), F.lit(False), F.col("rhythm")).alias("no_12x1"),
            layout.target_seconds(F.lit("6x2"), native, F.col("d")).alias("seconds_6x2"),
        ),
        "seconds_6x2",
    )


@query("select x, y from range(0, 41) a(x), range(0, 31) b(y) where not (x % 5 = 0 and y % 5 = 0)")
def q_lattice_minor_only(spark, sf_dir):
    """Crossings of the fine grid that are not crossings of the coarse one."""
    return layout.minor_only(layout.lattice(spark, 40, 30)).select("x", F.col("y").cast("bigint").alias("y"))


@query("""select distinct o_custkey % 60 as x, o_orderkey % 45 as y from orders where not (o_custkey % 60 % 5 = 0 and o_orderkey % 45 % 5 = 0)""")
def q_anti_lines(spark, sf_dir):
    """Crossings of fine lines that are not crossings of major ones."""
    fine = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 45).alias("y")).distinct()
    return layout.minor_only(fine)


@query(f"""{SAMPLES_SQL}, k as (select event_id, least(49, greatest(0, cast(round_even(v / 10, 0) as integer))) as kx, least(39, greatest(0, cast(round_even(event_id % 83 / 2.0, 0) as integer))) as ky from samples)
select event_id, kx * 3 + ky as mapped from k""")
def q_point_lookup(spark, sf_dir):
    """Points through a coordinate map by their nearest cell."""
    points = samples(spark, sf_dir).select("event_id", (F.col("v") / 10).alias("x"), ((F.col("event_id") % 83) / 2.0).alias("y"))
    near = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0), F.rint(c).cast("int")))
    grid = layout.lattice(spark, 49, 39).select(F.col("x").cast("int").alias("kx"), F.col("y").cast("int").alias("ky"), (F.col("x") * 3 + F.col("y")).cast("int").alias("mapped"))
    return points.select("event_id", near("x", 49).alias("kx"), near("y", 39).alias("ky")).join(F.broadcast(grid), ["kx", "ky"]).select("event_id", "mapped")


@query("""with c as (select p_partkey, ['6x2','3x4','12x1','4x2'][p_size % 4 + 1] as format, case when p_size % 3 = 0 then 'two_columns' else 'one' end as pulses, case when p_size % 5 = 0 then 'middle' else 'left' end as pos,
 case when p_size % 2 = 0 then 'thick_line_3mm' else 'line' end as sep, case when p_size > 40 then 50.0 else 25.0 end as speed, case when p_size % 7 < 3 then 20.0 else 10.0 end as gain, cast(p_size % 10 as double) as hor, cast(p_size as double) as ver, p_size - 25.0 as shift from part),
m as (select *, format in ('6x2', '4x2') and (pulses = 'two_columns' or pos = 'middle') as mid from c),
n as (select *, case when mid then null else sep end as sep2, case when mid then greatest(hor, 7) else hor end as hor2 from m)
select p_partkey, case when speed >= 50 and pulses = 'two_columns' then 'one_column' else pulses end as pulses, case when speed >= 50 and (pos = 'middle' or pulses = 'two_columns') then 'left' else pos end as pulse_position,
 case when sep2 = 'thick_line_3mm' and hor2 = 0 then null else sep2 end as separation, case when gain = 20 and (format in ('6x2', '12x1') or ver < 20) then 10.0 else gain end as gain, hor2 as horizontal_mm, round(case when abs(shift) > ver * 0.3 then sign(shift) * ver * 0.3 else shift end, 6) as shift_mm from n""")
def q_config_rules(spark, sf_dir):
    """Drawing configurations with their conflicts resolved."""
    p = F.col("p_size")
    configs = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.element_at(F.array(*map(F.lit, ("6x2", "3x4", "12x1", "4x2"))), p % 4 + 1).alias("format"),
        F.when(p % 3 == 0, "two_columns").otherwise("one").alias("pulses"),
        F.when(p % 5 == 0, "middle").otherwise("left").alias("pulse_position"),
        F.when(p % 2 == 0, "thick_line_3mm").otherwise("line").alias("separation"),
        F.when(p > 40, 50.0).otherwise(25.0).alias("speed"),
        F.when(p % 7 < 3, 20.0).otherwise(10.0).alias("gain"),
        (p % 10).cast("double").alias("horizontal_mm"),
        p.cast("double").alias("vertical_mm"),
        (p - 25.0).alias("shift_mm"),
    )
    return rounded(layout.checked_config(configs).select("p_partkey", "pulses", "pulse_position", "separation", "gain", "horizontal_mm", "shift_mm"), "shift_mm")


@query("""select p_partkey, cast(ceil((c * 60 + (c - 1) * case when c <= 1 or c * 60 + (c - 1) * s <= 260 then s else greatest(0, (260 - c * 60) / (c - 1)) end + 10) * 12) as bigint) as width, cast(ceil((r * 25 + 10) * 12) as bigint) as height
from (select p_partkey, p_size % 4 + 1 as c, p_size % 12 + 1 as r, p_size / 2.0 as s from part)""")
def q_canvas_size(spark, sf_dir):
    """Pixels of a page from its cells, with spacing shrunk to fit."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("c"), (F.col("p_size") % 12 + 1).alias("r"), (F.col("p_size") / 2.0).alias("s"))
    room = layout.shrunk_spacing(F.col("c"), F.lit(60.0), F.col("s"), F.lit(260.0))
    size = part.select("p_partkey", layout.canvas(F.col("r"), F.col("c"), F.lit(60.0), room, F.lit(25.0)).alias("z"))
    return size.select("p_partkey", F.col("z.width").cast("bigint").alias("width"), F.col("z.height").cast("bigint").alias("height"))


@query("""with c as (select o_custkey as page, cast(o_orderkey % 3 as integer) as row, o_orderkey as col, o_totalprice as width, o_orderkey % 4 as spacing from orders)
select page, row, col, round(10 + coalesce(sum(width + spacing) over (partition by page, row order by col rows between unbounded preceding and 1 preceding), 0), 2) as x, 200.0 - row * 25.0 as y from c""")
def q_cell_places(spark, sf_dir):
    """Cells side by side in their rows."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 3).cast("int").alias("row"), F.col("o_orderkey").alias("col"), F.col("o_totalprice").alias("width"), (F.col("o_orderkey") % 4).cast("double").alias("spacing"))
    return rounded(layout.placed_cells(cells, ["page"], "width", "spacing", 25.0, 10.0, 200.0).select("page", "row", "col", "x", "y"), "x", digits=2)


@query("""with e as (select vec_id, embedding, len(embedding) as n, unnest(range(len(embedding))) as i from embeddings)
select vec_id, i as pos, round(case when n > 1 then i * 2.5 / (n - 1) else 0 end * 300, 4) as x, round(50 + cast(embedding[i + 1] as double) * 120, 4) as y from e""")
def q_paper_points(spark, sf_dir):
    """Channels as points of a page."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("s"))
    drawn = e.select("vec_id", F.posexplode(layout.paper_points("s", "0D", "50D", "2.5D")).alias("pos", "p"))
    return rounded(drawn.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "p.x", "p.y"), "x", "y", digits=4)


@query("""with f(format) as (select unnest(['3x4', '3x4+2', '6x2+1', '12x1', '3x4_paramedic', '6x1;6x1']))
select format, cast(nullif(regexp_extract(format, '^(\\d+)x(\\d+)(?:\\+(\\d+))?$', 1), '') as integer) as rows, cast(nullif(regexp_extract(format, '^(\\d+)x(\\d+)(?:\\+(\\d+))?$', 2), '') as integer) as cols,
 case when regexp_matches(format, '^(\\d+)x(\\d+)(?:\\+(\\d+))?$') then coalesce(cast(nullif(regexp_extract(format, '^(\\d+)x(\\d+)(?:\\+(\\d+))?$', 3), '') as integer), 0) end as rhythms from f""")
def q_parse_format(spark, sf_dir):
    formats = spark.createDataFrame([(f,) for f in ("3x4", "3x4+2", "6x2+1", "12x1", "3x4_paramedic", "6x1;6x1")], "format string")
    return formats.withColumn("s", layout.format_size(F.col("format"))).select("format", "s.rows", "s.cols", "s.rhythms")


@query("""with m as (select n_nationkey, map([n_name, 'x'], [cast(n_regionkey as varchar), 'y']) as m from nation)
select n_nationkey, map_from_entries(list_transform(map_entries(m), lambda e: row(e.value, e.key)))['y'] as y, map_from_entries(list_transform(map_entries(m), lambda e: row(e.value, e.key)))[cast(n_nationkey % 5 as varchar)] as named from m""")
def q_map_invert(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map("n_name", F.col("n_regionkey").cast("string"), F.lit("x"), F.lit("y")).alias("m"))
    return nations.select("n_nationkey", match.inverted("m").alias("i")).select("n_nationkey", F.col("i")["y"].alias("y"), F.col("i")[(F.col("n_nationkey") % 5).cast("string")].alias("named"))


@query("""with p as (select l_orderkey, l_linenumber, l_extendedprice as dx, l_quantity as dy, l_discount * 10 as c from lineitem)
select l_orderkey, l_linenumber, case when dy < 20 and dx > 15000 then 'h' when dx < 20 and dy > 15 then 'v' end as kind from p where c >= 0.15""")
def q_line_kind(spark, sf_dir):
    """Grid lines by the shape of their boxes, dark strokes left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("dx"), F.col("l_quantity").alias("dy"), (F.col("l_discount") * 10).alias("c"))
    light = lines.withColumns({c: F.col("c") for c in "rgb"}).where(~geometry.is_dark(0.15))
    return light.select("l_orderkey", "l_linenumber", geometry.line_kind(20, 15000, 15).alias("kind"))


@query("""with p as (select c_custkey, c_acctbal - 10 as lo, c_acctbal + c_custkey % 30 as hi from customer) select c_custkey, case when c_custkey % 2 = 0 then hi else lo end as baseline from p where abs((hi - lo) - 25) < 25 * 0.15""")
def q_calibration_pulses(spark, sf_dir):
    """Strokes one millivolt high, and the line they start from."""
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") - 10).alias("lo"), (F.col("c_acctbal") + F.col("c_custkey") % 30).alias("hi")).withColumn("h", F.col("hi") - F.col("lo"))
    return geometry.calibration_pulses(p, "h", F.lit(25.0), 0.15, F.col("c_custkey") % 2 == 0, "lo", "hi").select("c_custkey", "baseline")


@query("""select p_partkey, round(case when greatest(r, g, b) > 1 then r / 255.0 else r end, 6) as r, round(case when greatest(r, g, b) > 1 then g / 255.0 else g end, 6) as g, greatest(case when greatest(r, g, b) > 1 then r / 255.0 else r end, case when greatest(r, g, b) > 1 then g / 255.0 else g end, case when greatest(r, g, b) > 1 then b / 255.0 else b end) < 0.15 as dark
from (select p_partkey, case when p_size % 2 = 0 then p_size * 1.0 else p_size / 50.0 end as r, case when p_size % 2 = 0 then 10.0 else 0.1 end as g, 0.0 as b from part)""")
def q_colours(spark, sf_dir):
    """Colours to 0..1 and which are dark."""
    even = F.col("p_size") % 2 == 0
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(even, F.col("p_size") * 1.0).otherwise(F.col("p_size") / 50.0).alias("r"), F.when(even, 10.0).otherwise(0.1).alias("g"), F.lit(0.0).alias("b"))
    return rounded(raw.select("p_partkey", *geometry.unit_colour("r", "g", "b")).select("p_partkey", "r", "g", geometry.is_dark(0.15).alias("dark")), "r", "g")
