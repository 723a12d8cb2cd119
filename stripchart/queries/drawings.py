"""Drawings made from suppliers, and what is extracted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.functions.text import LEADS
from stripchart.operators import geometry
from stripchart.plans import extract, profiles
from stripchart.queries.registry import query, table
from stripchart.session import spread

#: Pages are 1000 x 800 points, 4 points a millimetre; grid lines every 5 mm, samples every millimetre.
#: Columns, rows, samples a trace, x of the first column, distance of columns, y of the first row, of rows.
SHAPES = {"stacked_12x1": (1, 12, 200, 100, 0, 60, 60), "sequential_6x2": (2, 6, 100, 50, 480, 120, 120), "grid_4x3": (4, 3, 60, 10, 245, 200, 200)}


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ops, pages, texts): a page for each supplier, of one of three layouts; every fifth lies on
    its side, of seven one has no traces and one no grid. A trace rests on its line but for a peak
    and a dip in every sixteen samples."""
    shape = "element_at(map(" + ", ".join(f"{i}, array{SHAPES[n]}" for i, n in enumerate(SHAPES)) + "), cast(page_id % 3 as int))"
    base = spread(table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as page_id"), "page_id").withColumn("s", F.expr(shape)).withColumn("turned", F.expr("page_id % 5 = 0"))
    point = lambda x, y: f"struct(cast({x} as double) as x, cast({y} as double) as y)"
    lines = (
        f"if(page_id % 7 = 5, array(), concat(transform(sequence(0, 50), i -> struct(0.6D as ink, array({point('20 * i', '0')}, {point('20 * i', '800')}) as pts)), "
        f"transform(sequence(0, 40), i -> struct(0.6D as ink, array({point('0', '20 * i')}, {point('1000', '20 * i')}) as pts))))"
    )
    height = "case i % 16 when 5 then 20 * (1 + (page_id + k) % 3) when 7 then -10 else 0 end"
    trace = f"transform(sequence(0, s[2] - 1), i -> {point('s[3] + s[4] * (k div s[1]) + 4 * i', f's[5] + s[6] * (k % s[1]) - ({height})')})"
    traces = f"if(page_id % 7 = 3, array(), transform(sequence(0, 11), k -> struct(0D as ink, {trace} as pts)))"
    each = base.select("page_id", "turned", F.posexplode(F.expr(f"concat({lines}, {traces})")).alias("pos", "p"))
    # turning the page by 90 degrees brings (x, y) to (height - y, x)
    args = F.flatten(F.expr("transform(p.pts, q -> if(turned, array(q.y, 1000D - q.x), array(q.x, q.y)))"))
    strokes = F.array(
        F.struct(F.lit("setStrokeRGBColor").alias("op"), F.expr("array(p.ink, p.ink, p.ink * 1.5)").alias("args"), F.lit(None).cast("array<string>").alias("sub_ops")),
        F.struct(F.lit("constructPath").alias("op"), args.alias("args"), F.expr("transform(p.pts, (q, i) -> if(i = 0, 'moveTo', 'lineTo'))").alias("sub_ops")),
        F.struct(F.lit("stroke").alias("op"), F.expr("cast(array() as array<double>)").alias("args"), F.lit(None).cast("array<string>").alias("sub_ops")),
    )
    ops = each.select("page_id", "pos", F.posexplode(strokes).alias("i", "o")).select("page_id", (F.col("pos") * 3 + F.col("i")).cast("int").alias("op_pos"), "o.op", "o.args", "o.sub_ops")
    none = F.lit(None).cast("string")
    pages = base.select("page_id", F.expr("if(turned, 800D, 1000D)").alias("width"), F.expr("if(turned, 1000D, 800D)").alias("height"), F.lit(None).cast("array<double>").alias("viewport"), none.alias("producer"), none.alias("creator"), none.alias("author"))
    return ops, pages, spark.createDataFrame([], "page_id long, pos int, text string, x double, y double")


_LEADS = "[" + ", ".join(f"'{x}'" for x in LEADS) + "]"
_PAGES_SQL = "p as (select cast(s_suppkey as bigint) as page_id, ['stacked_12x1', 'sequential_6x2', 'grid_4x3'][s_suppkey % 3 + 1] as layout, [12, 6, 3][s_suppkey % 3 + 1] as rows, [200, 100, 60][s_suppkey % 3 + 1] as n from supplier)"


@query(f"with {_PAGES_SQL} select page_id, case page_id % 7 when 3 then 'NO_TRACES' when 5 then 'GRID_NOT_DETECTED' else 'ok' end as status from p")
def q_extract_status(spark, sf_dir):
    """What each drawing was found to be."""
    ops, pages, _ = drawn(spark, sf_dir)
    return extract.page_status(ops, pages)


@query(f"""with {_PAGES_SQL},
t as (select *, k // rows as c, k % rows as r from p, range(12) k(k) where page_id % 7 not in (3, 5)),
i as (select *, unnest(range(n)) as i from t),
s as (select page_id, layout, n, k, c, r, i, case i % 16 when 5 then 20 * (1 + (page_id + k) % 3) when 7 then -10 else 0 end / 40.0 as mv from i),
named as (select *, {_LEADS}[case layout when 'sequential_6x2' then (r // 3) * 6 + c * 3 + r % 3 else k end + 1] as name from s),
own as (select page_id, layout, name, n, i, mv, (n - 1) * 4 / 100.0 as d, 1 as times from named),
rhythm as (select page_id, layout, 'II_rhythm' as name, n, i, mv, d, greatest(1, cast(ceil(10 / d - 0.05) as integer)) as times from own where name = 'II')
select page_id, name, layout, case when page_id % 5 = 0 then 90 else 0 end as rotation, cast(max(n * times) as bigint) as samples, round(max(d * times), 6) as duration_s, cast(max(floor(n / d + 0.5)) as integer) as rate,
 round(sum(mv * times), 4) as total, round(sum(mv * (i + 1)), 4) as first_pass, round(max(mv), 4) as top, round(min(mv), 4) as low
from (select * from own union all select * from rhythm) group by page_id, name, layout""")
def q_extract_channels(spark, sf_dir):
    """The channels of all drawings in millivolts: their names by place, times, sums and extremes."""
    channels, _ = extract.extract(*drawn(spark, sf_dir))
    first = F.expr("aggregate(transform(slice(samples, 1, n0), (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)")
    sized = channels.withColumn("n0", F.expr("case layout when 'stacked_12x1' then 200 when 'sequential_6x2' then 100 else 60 end"))
    return sized.select(
        "page_id", "name", "layout", "rotation", F.size("samples").cast("bigint").alias("samples"), F.round("duration_s", 6).alias("duration_s"), F.col("sample_rate_hz").alias("rate"),
        F.round(F.expr("aggregate(samples, 0D, (a, x) -> a + x)"), 4).alias("total"), F.round(first, 4).alias("first_pass"), F.array_max("samples").alias("top"), F.array_min("samples").alias("low"),
    )


@query("""with l as (select cast(s_suppkey as bigint) as page_id, 2 + s_suppkey % 4 as mm, unnest(range(30)) as i from supplier),
a as (select page_id, mm, count(*) as lines, count(*) filter (i % 5 = 0) as major from l group by page_id, mm)
select page_id, cast(mm as double) as spacing_x, cast(mm as double) as spacing_y, cast(lines as integer) as h_lines, cast(lines as integer) as v_lines, cast(major as integer) as h_major, cast(major as integer) as v_major from a where page_id % 4 <> 3
union all select page_id, cast(mm as double), cast(mm as double), cast(lines as integer), cast(lines as integer), null, null from a where page_id % 4 = 3""")
def q_grid_spacing(spark, sf_dir):
    """Spacing of grids whose lines are drawn 5 mm apart, each twice with a small shift, and their
    wide lines; of every fourth page all lines are equally wide."""
    limits = profiles.DEFAULTS
    page = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"), (F.col("s_suppkey") % 4 + 2).alias("mm"))
    each = page.select("page_id", "mm", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"), F.lit(0.0).alias("shift")).unionByName(page.select("page_id", "mm", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"), F.lit(0.3).alias("shift")))
    at = F.col("mm") * 5 * F.col("i") + F.col("shift") - 0.15
    wide = F.when((F.col("page_id") % 4 != 3) & (F.col("i") % 5 == 0), 2.0).otherwise(1.0)
    end = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    sides = [F.array(end(at, F.lit(0)), end(at, F.lit(700))), F.array(end(F.lit(0), at), end(F.lit(700), at))]
    lines = each.select("page_id", F.explode(F.array(*sides)).alias("pts"), wide.alias("w"), *(F.lit(0.7).alias(c) for c in "rgb"), F.lit(750.0).alias("page_width"), F.lit(750.0).alias("page_height"))
    lines = lines.select("*", *(F.lit(limits[c]).alias(c) for c in ("black_threshold", "line_straightness", "min_h_fraction", "min_v_fraction", "dedup_distance", "major_threshold", "min_lines")))
    found = extract.grid(geometry.boxed(lines))
    return found.select("page_id", F.round("spacing_x", 6).alias("spacing_x"), F.round("spacing_y", 6).alias("spacing_y"), *(F.when(F.col(c).isNotNull(), F.size(c)).alias(c) for c in ("h_lines", "v_lines", "h_major", "v_major")))


@query("""with p as (select cast(s_suppkey as bigint) as page_id, s_suppkey % 10 as kind from supplier),
l as (select page_id, kind, unnest(range(case when kind in (3, 4) then 3200 else 40 end)) as i from p),
s as (select *, case when i < case kind when 3 then 6 when 4 then 5 else 3 end then 60 when kind in (3, 4) then 2 else 3 end as n,
 case when i < 6 then 0.0 when kind in (5, 8) then 0.95 when kind = 6 then 0.9 else 0.3 end as r, case when i < 6 then 0.0 when kind = 6 then 0.6 when kind in (5, 8) then 0.05 else 0.3 end as g from l),
c as (select page_id, count(*) as every, count(*) filter (n = 2) as two, count(*) filter (n >= 50 and r < 0.4) as dark, bool_or(r > 0.9 and g < 0.1) as red, bool_or(r > 0.8 and g > 0.5 and g < 0.8) as pink from s group by page_id)
select p.page_id, case when kind in (0, 8) then 'GE MUSE' when kind = 1 then 'PTB-XL' when kind = 2 then 'Mortara/Burdick' when every > 3000 and two / every > 0.8 then case when dark >= 6 then 'AMPS-LLC' else 'Vectracor' end
 when red then 'Schiller' when pink then 'Schiller CS' else 'Unknown' end as vendor from p left join c using (page_id)""")
def q_vendor(spark, sf_dir):
    """The maker of a drawing: by what its file says, its size, its polylines, its grid's colour."""
    page = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"), (F.col("s_suppkey") % 10).alias("kind"))
    kind, none = F.col("kind"), F.lit(None).cast("string")
    pages = page.select(
        "page_id", F.when(kind == 2, 2500.0).otherwise(800.0).alias("width"), F.lit(600.0).alias("height"),
        F.when(kind == 0, "GE MUSE 9").otherwise(none).alias("producer"), F.when(kind == 1, "Matplotlib v3").otherwise(none).alias("creator"), F.when(kind == 8, "a Muse cart").otherwise(none).alias("author"),
    )
    each = page.select("page_id", "kind", F.explode(F.sequence(F.lit(0), F.when(kind.isin(3, 4), 3199).otherwise(39))).alias("i"))
    long = F.when(kind == 3, 6).when(kind == 4, 5).otherwise(3)
    first = F.col("i") < 6
    n = F.when(F.col("i") < long, 60).when(kind.isin(3, 4), 2).otherwise(3)
    red = F.when(first, 0.0).when(kind.isin(5, 8), 0.95).when(kind == 6, 0.9).otherwise(0.3)
    green = F.when(first, 0.0).when(kind == 6, 0.6).when(kind.isin(5, 8), 0.05).otherwise(0.3)
    polylines = each.select("page_id", n.alias("n"), red.alias("r"), green.alias("g"), green.alias("b"))
    return geometry.vendor(pages, polylines, ["page_id"]).select("page_id", "vendor")


@query("""with p as (select cast(s_suppkey as bigint) as page_id, [0, 90, 180, 270][s_suppkey % 4 + 1] as turn, 3 + s_suppkey % 5 as good from supplier), l as (select *, unnest(range(8)) as k from p),
c as (select page_id, turn, good, count(*) as n, count(*) filter (k < good) as rising from l group by 1, 2, 3)
select page_id, case when turn <> 0 and rising >= greatest(4, n / 2.0) then turn else 0 end as rotation from c""")
def q_rotation_scores(spark, sf_dir):
    """How pages lie, by which way most of their long dark traces run; 3 to 7 of 8 run one way."""
    page = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").cast("bigint").alias("page_id"), F.expr("cast(array(0, 90, 180, 270)[cast(s_suppkey % 4 as int)] as int)").alias("turn"), (F.col("s_suppkey") % 5 + 3).alias("good"))
    traces = page.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("poly_id"))
    # upright, x rises and y swings by 40; the others swing both ways
    x = "if(poly_id < good, 5D * i, 300D + 40D * (i % 2))"
    y = "100D + 40D * (i % 2)"
    turned = f"case turn when 90 then struct({y} as x, 600D - {x} as y) when 180 then struct(800D - {x} as x, 600D - {y} as y) when 270 then struct(800D - {y} as x, {x} as y) else struct({x} as x, {y} as y) end"
    drawn_ones = traces.select("page_id", "poly_id", F.expr(f"transform(sequence(0, 59), i -> {turned})").alias("pts"), *(F.lit(0.0).alias(c) for c in "rgb"), F.lit(60).alias("n"))
    return geometry.rotation_scores(geometry.rotation_candidates(drawn_ones, ["page_id"], "poly_id"), ["page_id"]).select("page_id", "rotation")
