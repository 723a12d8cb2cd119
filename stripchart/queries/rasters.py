"""Masks and windows in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripchart.operators import raster, warp
from stripchart.queries.registry import query, rounded, table
from stripchart.session import spread
from stripchart.streaming import samples as streaming


@query("""with p as (select user_id % 5 as page, cast(floor(value / 4) as integer) as px, cast(event_id % 90 as integer) as py from events),
k(dx, dy, v) as (values (-1, 0, 128), (0, -1, 128), (0, 0, 255), (0, 1, 128), (1, 0, 128))
select page, py + dy as y, px + dx as x, max(v) as value from p, k where px + dx between 0 and 99 and py + dy between 0 and 79 group by 1, 2, 3""")
def q_point_mask(spark, sf_dir):
    """Points as small cones on pages, merged."""
    points = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("page"), (F.col("value") / 4).alias("x"), (F.col("event_id") % 90).cast("double").alias("y"))
    return raster.dots(points, ["page"], 100, 80, 1)


@query("""with s as (select s_suppkey, cast(s_suppkey % 40 as integer) as x0, cast(s_suppkey % 30 as integer) as y0, cast(s_nationkey as integer) as len from supplier)
select s_suppkey, unnest(range(y0, least(y0, 59) + 1)) as y, x, 255 as value from (select s_suppkey, y0, unnest(range(x0, least(x0 + len, 59) + 1)) as x from s)""")
def q_line_mask(spark, sf_dir):
    """Level strokes as pixels, cut at the edge."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).cast("double").alias("x"), (F.col("s_suppkey") % 30).cast("double").alias("y"), F.col("s_nationkey").cast("double").alias("len"))
    lines = s.select("s_suppkey", F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("len")).alias("x"), "y")).alias("pts"))
    return raster.strokes(lines, ["s_suppkey"], 60, 60).select("s_suppkey", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "value")


@query("""with n as (select n_nationkey, ['I','II','III','aVR','aVL','aVF','V1','V2','V3','V4','V5','V6','X'][n_nationkey % 13 + 1] || case n_nationkey % 3 when 1 then '_seg2' when 2 then '_extra' else '' end as name from nation)
select n_nationkey % 13 as class, count(*) as n from n where n_nationkey % 13 < 12 group by 1""")
def q_channel_class(spark, sf_dir):
    """Channels by the class of their lead; unknown ones drop."""
    names = F.get(F.array(*map(F.lit, [*raster.LEADS, "X"])), F.col("n_nationkey") % 13)
    name = F.concat(names, F.when(F.col("n_nationkey") % 3 == 1, "_seg2").when(F.col("n_nationkey") % 3 == 2, "_extra").otherwise(""))
    known = table(spark, sf_dir, "nation").select(raster.channel_class(name).alias("class")).where("class is not null")
    return known.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("""select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by 1, 2""")
def q_event_windows(spark, sf_dir):
    """Windows of six hours in event time; the same plan runs on a stream."""
    found = streaming.windowed(table(spark, sf_dir, "events"), "6 hours")
    return rounded(found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "mean")


@query("""with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, max(value) as most from s group by user_id, s""")
def q_sessions(spark, sf_dir):
    """Recordings with less than twelve hours between samples."""
    found = streaming.sessions(table(spark, sf_dir, "events"), "12 hours")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("select p_partkey, case when 0.299 * (p_size * 5) + 0.587 * (p_partkey % 256) + 0.114 * 100 > 128 then 255 else 0 end as pixel from part")
def q_binary_pixels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", raster.binary(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(100)).alias("pixel"))


_MASKS = ["grid_major", "grid_minor", "grid_combined", "signal_I", "signal_I_seg2", "signal_V6_extra", "signal_all", "lead_labels", "medical_text", "black_square", "reference_pulse", "etiquette", "handwriting", "other"]
_MASKS_SQL = f"""m as (select user_id % 7 as page, {_MASKS!r}[event_id % {len(_MASKS)} + 1] as mask, cast(floor(value / 20) as integer) as y, cast(event_id % 37 as integer) as x, cast(floor(value) % 256 as integer) as value from events),
k as (select * from m where not (page % 2 = 0 and mask = 'grid_combined')),
w as (select distinct page from k where mask = 'grid_combined'),
c as (select page, case mask when 'grid_combined' then 1 when 'reference_pulse' then 14 when 'lead_labels' then 15 when 'medical_text' then 16 when 'black_square' then 17 when 'etiquette' then 18 when 'handwriting' then 19 when 'signal_I' then 2 when 'signal_I_seg2' then 2 when 'signal_V6_extra' then 13
 when 'grid_major' then case when page not in (select page from w) then 1 end when 'grid_minor' then case when page not in (select page from w) then 1 end end as class, y, x, value from k)"""


def _masks(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _MASKS)), (F.col("event_id") % len(_MASKS) + 1).cast("int"))
    pixels = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("page"), name.alias("mask"), F.floor(F.col("value") / 20).cast("int").alias("y"), (F.col("event_id") % 37).cast("int").alias("x"), (F.floor("value") % 256).cast("int").alias("value"))
    return raster.multiclass(pixels.where("not (page % 2 = 0 and mask = 'grid_combined')"), ["page"])


@query(f"with {_MASKS_SQL} select page, class, y, x, max(value) as value from c where class is not null group by all")
def q_multiclass(spark, sf_dir):
    """Masks of pages by class; half of the pages have their grid in parts."""
    return _masks(spark, sf_dir)


@query(f"""with {_MASKS_SQL}, f as (select distinct page, y, x from c where class is not null and value > 0), l as (select distinct user_id % 7 as page from events), g as (select page, unnest(range(30)) as y from l), p as (select page, y, unnest(range(40)) as x from g)
select p.page, cast(p.y as integer) as y, count(*) filter (f.x is null) as free, coalesce(sum(p.x) filter (f.x is null), 0)::bigint as total from p left join f on p.page = f.page and p.y = f.y and p.x = f.x group by 1, 2""")
def q_background(spark, sf_dir):
    """What no class of a page covers, line by line."""
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("page"), F.lit(40).alias("width"), F.lit(30).alias("height")).distinct()
    free = raster.background(_masks(spark, sf_dir), pages, ["page"])
    return free.select("page", "y", F.size("xs").cast("bigint").alias("free"), F.expr("aggregate(xs, 0L, (a, x) -> a + x)").alias("total"))


@query("""with p as (select user_id % 5 as page, ['I', 'II_seg2', 'V1_extra', 'none'][event_id % 4 + 1] as name, value / 9 - 4 as x, event_id % 70 - 5.5 as y from events),
k as (select page, case name when 'I' then 0 when 'II_seg2' then 1 when 'V1_extra' then 6 end as class, cast(floor(x) as integer) as x, cast(floor(y) as integer) as y from p),
i as (select distinct * from k where class is not null and x between 0 and 39 and y between 0 and 49)
select page, class, y, x, case when (x + y + class) % 2 = 0 then 255 end as red from i""")
def q_class_overlay(spark, sf_dir):
    """Points on the page by the class of their channel, and the full ones as an overlay."""
    name = F.element_at(F.array(*map(F.lit, ["I", "II_seg2", "V1_extra", "none"])), (F.col("event_id") % 4 + 1).cast("int"))
    points = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("page"), name.alias("name"), (F.col("value") / 9 - 4).alias("x"), (F.col("event_id") % 70 - 5.5).alias("y"))
    pixels = raster.inside(points, 40, 50).withColumn("value", F.when((F.col("x") + F.col("y") + raster.channel_class(F.col("name"))) % 2 == 0, 255).otherwise(100))
    return raster.overlay(raster.classes(pixels, ["page"]), ["page", "class"]).select("page", "class", "y", "x", F.col("rgb")[0].alias("red"))


@query("""with i as (select p_partkey, 5 + p_size % 4 as w, 4 + p_partkey % 3 as h, cast(p_size as double) as d from part), p as (select *, unnest(range(w * h)) as pos from i)
select p_partkey, pos, pos % w + d as x, (pos // w) * 2.0 + 1 as y from p""")
def q_composed_maps(spark, sf_dir):
    """Coordinate maps that leave all where it is, with a function run over them."""
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4 + 5).cast("int").alias("width"), (F.col("p_partkey") % 3 + 4).cast("int").alias("height"), F.col("p_size").cast("double").alias("d"))
    made = raster.composed(raster.identity_maps(images), lambda x, y: (x, 2 * y + 1))
    each = made.select("p_partkey", "d", F.posexplode(F.arrays_zip("map_x", "map_y")).alias("pos", "z"))
    return each.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), (F.col("z.map_x") + F.col("d")).alias("x"), F.col("z.map_y").alias("y"))


def _warp_sql(rounds: int) -> str:
    """The map's inverse with its rounds written out one by one."""
    steps = "".join(
        f""", n{i} as (select s, hy as y, hx as x, avg(from_x) as from_x, avg(from_y) as from_y from (select h.s, h.y as hy, h.x as hx, least(greatest(h.y + dy, 0), 13) as y, least(greatest(h.x + dx, 0), 21) as x
  from (select * from every anti join d{i} using (s, y, x)) h, k) join d{i} using (s, y, x) group by all), d{i + 1} as (select * from d{i} union all select * from n{i})"""
        for i in range(rounds)
    )
    return f"""with k as (select a.range - 1 as dy, b.range - 1 as dx from range(3) a, range(3) b), g as (select s_suppkey as s, x, y, x * 1.875 + s_suppkey % 3 * 0.25 - 1 as u, y * 1.375 + s_nationkey * 0.125 - x * 0.0625 as v, case when (x * y + s_suppkey) % 4 = 0 then 255 else 0 end as value
  from supplier, range(12) r(x), range(9) q(y)),
every as (select s_suppkey as s, y, x from supplier, range(22) r(x), range(14) q(y)),
put as (select s, y as sy, x as sx, round_even(u, 0)::bigint as x, round_even(v, 0)::bigint as y from g),
d0 as (select s, y, x, sx::double as from_x, sy::double as from_y from put where x between 0 and 21 and y between 0 and 13 qualify row_number() over (partition by s, y, x order by sy desc, sx desc) = 1){steps},
seen as (select t.s, t.y, t.x, sum((1 - abs(from_x - g.x)) * (1 - abs(from_y - g.y)) * g.value) as value from d{rounds} t join g on g.s = t.s and abs(from_x - g.x) < 1 and abs(from_y - g.y) < 1 group by all)
select s, y, x, round_even(round(value, 9), 0)::integer as value from seen where round_even(round(value, 9), 0) > 0"""


@query(_warp_sql(warp.ROUNDS))
def q_warped_masks(spark, sf_dir):
    """A mask for each supplier, carried through a map that stretches, shears and moves it."""
    base = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), "s_nationkey"), "s")
    grid = base.withColumn("y", F.explode(F.expr("sequence(0L, 8L)"))).withColumn("x", F.explode(F.expr("sequence(0L, 11L)")))
    moves = grid.select("s", "y", "x", (F.col("x") * 1.875 + F.col("s") % 3 * 0.25 - 1).alias("u"), (F.col("y") * 1.375 + F.col("s_nationkey") * 0.125 - F.col("x") * 0.0625).alias("v"))
    mask = grid.where("(x * y + s) % 4 = 0").select("s", "y", "x", F.lit(255).alias("value"))
    return warp.warped(mask, moves, base.select("s", F.lit(22).alias("width"), F.lit(14).alias("height")), ["s"])


@query("""with s as (select s_suppkey, s_suppkey % 9 - 3.5 as x, s_nationkey % 7 - 2.25 as y from supplier),
e as (select s_suppkey, unnest([[x, y, x + 30, y + 2], [x + 30, y + 2, x + 12, y + 9], [x + 12, y + 9, x + 28, y + 21], [x + 28, y + 21, x + 3, y + 17], [x + 3, y + 17, x, y]]) as e from s),
p as (select s_suppkey, b.range as y, a.range as x from supplier, range(32) a, range(16) b),
i as (select p.s_suppkey, p.y, p.x from p join e using (s_suppkey) where (e[2] <= p.y) <> (e[4] <= p.y) and e[1] + (p.y - e[2]) * (e[3] - e[1]) / (e[4] - e[2]) > p.x group by all having count(*) % 2 = 1)
select s_suppkey, y, count(*) as covered, sum(x)::bigint as total from i group by all""")
def q_polygon_fill(spark, sf_dir):
    """Concave outlines filled line by line, cut at the page's edge."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 - 3.5).alias("x"), (F.col("s_nationkey") % 7 - 2.25).alias("y"))
    corners = [(0, 0), (30, 2), (12, 9), (28, 21), (3, 17)]
    outlines = s.select("s_suppkey", F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in corners)).alias("pts"))
    pages = s.select("s_suppkey", F.lit(32).alias("width"), F.lit(16).alias("height"))
    spans = raster.polygon_spans(outlines, pages, ["s_suppkey"])
    covered = F.sum(F.expr("x1 - x0")).cast("bigint")
    total = F.sum(F.expr("(x1 - x0) * (x0 + x1 - 1) div 2")).cast("bigint")
    return spans.groupBy("s_suppkey", "y").agg(covered.alias("covered"), total.alias("total"))
