"""Operators on small literal frames: order, ties, edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.operators import cluster, geometry, match, noise, raster, signal, stats
from stripchart.sources import drawing, files, waveform_xml
from stripchart.streaming import samples as streaming


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_histogram_mode(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.2, 1.1, 1.9, 3.9])] + [(2, 0, 7.3)], "k int, i int, v double")
    assert rows(stats.histogram_mode(df, ["k"], "v", ["i"]), "k") == [(1, 3.5), (2, 7.3)]


def test_clusters(spark):
    lines = spark.createDataFrame([(1, p, w) for p, w in [(0.0, 0.1), (0.5, 0.3), (2.0, 0.1), (2.6, 0.1), (3.3, 0.2)]], "k int, p double, w double")
    merged = rows(cluster.merged_lines(lines, ["k"], "p", "w", 0.8).select("p", "w"), "p")
    assert merged[0] == (0.25, 0.3) and math.isclose(merged[1][0], 7.9 / 3) and merged[1][1] == 0.2
    even = spark.createDataFrame([(1, float(i)) for i in range(3)], "k int, p double")
    n = lambda split: cluster.gap_clusters(even, ["k"], "p", 1.0, split_at=split).agg(F.max("cluster")).first()[0]
    assert (n(False), n(True)) == (0, 2)


def test_welding(spark):
    seg = lambda i, a, b, w=1.0: (1, i, [(a, 0.0), (b, 0.0)], 0.0, 0.0, 0.0, w)
    data = [seg(0, 0.0, 1.0), seg(1, 1.2, 2.0), seg(2, 3.0, 4.0), seg(3, 4.0, 5.0, 2.0), (1, 4, [(5.0, 0.0), (6.0, 0.0), (7.0, 0.0)], 0.0, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(data, "k int, i int, pts array<struct<x:double,y:double>>, r double, g double, b double, w double")
    found = [[p["x"] for p in r["pts"]] for r in cluster.welded(df, ["k"], "i").orderBy("i").collect()]
    assert found == [[0, 1, 2], [3, 4], [4, 5], [5, 6, 7]]


def test_error_summary(spark):
    df = spark.createDataFrame([("a", e) for e in (1.0, 2.0, 4.0)] + [("b", 0.5), ("b", -0.5), ("c", None)], "k string, e double")
    found = {r["k"]: r for r in stats.error_summary(df, ["k"], "e", 0.5).collect()}
    assert math.isclose(found["a"]["std_error"], 1.24721912892, rel_tol=1e-9) and found["a"]["status"] == "FAIL"
    assert found["b"]["status"] == "PASS" and found["b"]["max_error"] == 0.5 and found["c"]["status"] == "NO_DATA"


def test_nearest_and_brackets(spark):
    left = spark.createDataFrame([(1, 2.0), (2, 2.5), (3, 99.0)], "i int, v double")
    right = spark.createDataFrame([(2.0,), (3.0,), (7.0,)], "c double")
    assert rows(match.nearest(left, "v", right, "c", 2.0).select("i", "nearest"), "i") == [(1, 2.0), (2, 2.0), (3, None)]
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0)], "k string, t double, v double")
    asked = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 9.0), ("z", 1.0)], "k string, s double")
    assert rows(match.bracketed(points, asked, ["k"], "t", "v", "s"), "k", "s") == [("a", 0.5, 1.0), ("a", 2.0, 4.0), ("a", 9.0, None), ("z", 1.0, None)]


def test_peaks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 3.0, 1.0, -3.0, 0.0, 1.0, 1.0])], "k int, i int, v double")
    assert [r["i"] for r in signal.peaks(df, ["k"], ["i"], "v", 2).orderBy("place").collect()] == [1, 3]


def test_moving_average(spark):
    values = np.random.default_rng(0).normal(size=300)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    found = [r["smooth"] for r in signal.moving_average(df, ["k"], ["i"], "v").orderBy("i").collect()]
    assert np.allclose(found, np.convolve(values, np.ones(100) / 100, mode="same"))


def test_affine(spark):
    row = spark.range(1).select(F.expr("array(1D,0D,0D,1D,10D,20D)").alias("a"), F.expr("array(2D,0D,0D,2D,0D,0D)").alias("b"))
    assert row.select(geometry.affine_product("a", "b")).first()[0] == [2, 0, 0, 2, 10, 20]


@pytest.mark.parametrize("head, kind", [("255044462D", "pdf"), ("424D", "bmp"), ("5249464600000000574542", "unknown"), ("524946460000000057454250", "webp"), ("EFBBBF20203C3F786D6C", "xml"), ("3C21444F43545950452068746D6C3E", "unknown"), ("", "unknown"), ("3CC3", "xml")])
def test_file_kinds(spark, head, kind):
    assert spark.range(1).select(F.unhex(F.lit(head)).alias("c")).select(files.file_kind("c")).first()[0] == kind


def test_pages_of_documents(spark):
    df = spark.createDataFrame([("a.PDF", [(10,)]), ("b.pdf", [(80,), (3,)])], "name string, pages array<struct<ops:int>>")
    found = files.pages_of_documents(df, "name", "pages", "ops").select("page_name", "is_drawn")
    assert rows(found, "page_name") == [("a.PDF", True), ("b_p1.pdf", True), ("b_p2.pdf", False)]
    assert files.within_cap(df, 1).count() == 0 and files.within_cap(df, 2).count() == 2


OPS = "page_id long, op_pos int, op string, args array<double>, sub_ops array<string>"
PAGES = "page_id long, width double, height double, viewport array<double>"


def test_polylines(spark):
    ops = [
        ("save", [], None), ("transform", [2.0, 0, 0, 2, 10, 0], None), ("setStrokeRGBColor", [255.0, 0, 0], None), ("setLineWidth", [3.0], None), ("moveTo", [1.0, 1], None), ("lineTo", [2.0, 2], None), ("stroke", [], None),
        ("restore", [], None), ("constructPath", [0.0, 0, 1, 1, 2, 2, 3, 3, 5, 5], ["moveTo", "curveTo", "lineTo"]), ("stroke", [], None),
        ("moveTo", [1.0, 1], None), ("lineTo", [9.0, 9], None), ("fill", [], None), ("moveTo", [4.0, 4], None), ("stroke", [], None),
    ]
    df = spark.createDataFrame([(1, i, o, [float(a) for a in args], sub) for i, (o, args, sub) in enumerate(ops)], OPS)
    found = drawing.polylines(df, spark.createDataFrame([(1, 100.0, 100.0, None)], PAGES)).orderBy("poly_id").collect()
    assert [[tuple(p) for p in r["pts"]] for r in found] == [[(12, 2), (14, 4)], [(0, 0), (3, 3), (5, 5)]]
    assert (found[0]["r"], found[0]["w"]) == (1.0, 3.0)


def test_polylines_off_the_page(spark):
    df = spark.createDataFrame([(1, 0, "transform", [1.0, 0.0, 0.0, 1.0, 9000.0, 0.0], None), (1, 1, "moveTo", [1.0, 1.0], None), (1, 2, "lineTo", [2.0, 1.0], None)], OPS)
    found = drawing.polylines(df, spark.createDataFrame([(1, 100.0, 100.0, None)], PAGES)).collect()
    assert [tuple(p) for p in found[0]["pts"]] == [(1, 1), (2, 1)]


def test_waveform_xml(spark):
    channels = spark.createDataFrame([("e", 0, "I", [0.1, -0.2, 0.30012], 500), ("e", 1, "II", [1.0, 20.0, 0.0], 500), ("e", 2, "III", [9.0, 9.0, 9.0], 500), ("e", 3, "II_rhythm", [0.5] * 5, 500)], "ecg_id string, pos int, name string, samples array<double>, sample_rate_hz int")
    written = waveform_xml.write_muse(channels)
    read = {r["name"]: r["samples"] for r in waveform_xml.channels(written).collect()}
    assert all(abs(a - b) <= 0.00025 + 1e-12 for a, b in zip(read["I"], [0.1, -0.2, 0.30012])) and read["II"][1] == 16.3835
    assert np.allclose(read["III"], np.subtract(read["II"], read["I"])) and np.allclose(read["aVR"], -np.add(read["I"], read["II"]) / 2)
    longer = {r["name"]: r["samples"] for r in waveform_xml.longer_rhythm(waveform_xml.channels(written), written).collect()}
    assert len(longer["II"]) == 5 and waveform_xml.sample_base(written).first()["sample_rate_hz"] == 500
    odd = spark.createDataFrame([("a", "<R><Waveform><WaveformType>rHyThM</WaveformType><LeadData><LeadID>I</LeadID><LeadAmplitudeUnitsPerBit>2</LeadAmplitudeUnitsPerBit><WaveFormData>AQA=</WaveFormData></LeadData><LeadData><LeadID>I</LeadID><LeadAmplitudeUnitsPerBit>1000</LeadAmplitudeUnitsPerBit><WaveFormData>AgD/\n/w==</WaveFormData></LeadData></Waveform><Waveform><WaveformType>Median</WaveformType><LeadData><LeadID>V1</LeadID></LeadData></Waveform></R>")], "ecg_id string, xml string")
    assert [(r["name"], r["samples"]) for r in waveform_xml.channels(odd).collect()] == [("I", [2.0, -1.0])]
    note = waveform_xml.write_annotated(channels).first()["xml"]
    assert "<digits>20 -40 60 0 0</digits>" in note and note.count("MDC_ECG_LEAD_II\"") == 2 and 'increment value="0.00200000"' in note


def test_noise(spark):
    df = spark.createDataFrame([(i, 0, "I", [0.0] * 600, k) for i, k in enumerate(["none", "low", "powerline", "high"])], "ecg_id long, place int, name string, samples array<double>, noise string")
    found = {r["noise"]: r["samples"] for r in noise.with_noise(df).collect()}
    assert not any(found["none"]) and all(any(found[k]) for k in ("low", "powerline", "high"))
    assert found == {r["noise"]: r["samples"] for r in noise.with_noise(df.repartition(3)).collect()}
    many = spark.range(200).select(F.col("id").alias("ecg_id"), F.lit(0).alias("place"), F.lit("I").alias("name"), F.expr("transform(sequence(0, 499), i -> cast(i as double))").alias("samples"), F.lit("none").alias("noise"))
    sizes = {r[0] for r in noise.thinned(many).select(F.size("samples")).collect()}
    assert sizes == {500, 72, 100, 200}


def test_masks(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 3.0)])], "k int, pts array<struct<x:double,y:double>>")
    assert rows(raster.strokes(lines, ["k"], 10, 10).select("x", "y"), "x") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert raster.strokes(lines, ["k"], 10, 10, 2).count() == 13
    shape = spark.createDataFrame([(1, -5, 1, 0, 9)], "k int, x0 int, x1 int, y0 int, y1 int")
    assert raster.boxes(shape, ["k"], 4, 3).count() == 6


def test_inverse_map(spark):
    h, w = 40, 50
    gy, gx = np.mgrid[:h, :w].astype(float)
    x, y = gx + 2 * np.sin(gy / 9), gy + 1.5 * np.cos(gx / 11)
    ix, iy = raster.inverse_of(x, y)
    inner = np.s_[8:-8, 8:-8]
    assert np.abs(raster.sampled(x, ix, iy) - gx)[inner].max() < 1e-3
    plane = 2 * gx + 3 * gy
    broken = plane.copy()
    broken[:5] = broken[-5:] = 0
    broken[:, :5] = broken[:, -5:] = 0
    assert np.allclose(raster.extended_borders(broken, 5), plane)
    images = raster.identity_maps(spark.createDataFrame([(1, 3, 2)], "k int, width int, height int"))
    assert raster.inverse_maps(images).first()["map_x"] == [0, 1, 2, 0, 1, 2]


def test_stream_matches_batch(spark, tmp_path):
    events = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7,0) as ts, id % 3 as user_id, concat('k', id % 2) as event_type, cast(id as double) as value from range(500)")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.watch(spark, str(tmp_path / "in"), "ts timestamp_ntz, user_id long, event_type string, value double", 1)
    query = streaming.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streaming.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))
    files_query = streaming.append_batches(stream, lambda b: b.groupBy("user_id").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    files_query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 500


def test_polylines_of_many_parts(spark):
    """Moves and rectangles within a path, a transform in the midst of one, unknown parts, nulls; pages come out
    of one part of the table, and operators that few rows explode to are not gathered."""
    path = ["moveTo", "lineTo", "moveTo", "lineTo", "curveTo2", "none", "rectangle", "lineTo", "lineTo", None]
    numbers = [float(i) for i in range(2 + 2 + 2 + 2 + 4 + 4 + 2 + 2)]
    each = [("constructPath", numbers, path), ("transform", [1.0, 0, 0, 1, 0, 5], None), ("lineTo", [7.0, 7], None), ("moveTo", [1.0, 1], ["moveTo"]), ("stroke", None, None)]
    few = spark.createDataFrame([(k, [(i, o, a and [float(x) for x in a], sub) for i, (o, a, sub) in enumerate(each)]) for k in (1, 2)], "page_id long, o array<struct<op_pos:int, op:string, args:array<double>, sub_ops:array<string>>>")
    made = drawing.polylines(few.select("page_id", F.inline("o")), spark.createDataFrame([(1, 100.0, 100.0, None), (2, 100.0, 100.0, [2.0, 0.0, 0.0, 1.0, 0.0, 0.0])], PAGES))
    found = {(r["page_id"], r["poly_id"]): [tuple(p) for p in r["pts"]] for r in made.collect()}
    # a rectangle drops what was begun; the transform moves the last point only
    lines = [[(0, 1), (2, 3)], [(16, 17), (18, 19), (7, 12)]]
    assert found == {(k, i): [(x * k, y) for x, y in line] for k in (1, 2) for i, line in enumerate(lines)}
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
