"""Verification, checks, exports and streams on small literal frames: odd and damaged input."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.functions import arrays, codec, streams, text
from stripchart.operators import checks, geometry, noise, raster, sampling, verify
from stripchart.plans import extract
from stripchart.sources import files, stored, waveform_xml, writers


@pytest.mark.parametrize(
    "stream, found",
    [
        ("", []),
        ("BT (a) Tj ET  q", ["BT (a) Tj ET  "]),
        ("BT(a)Tj ET", []),
        ("x BT (ET) Tj (a (b) ET) Tj ET\nBT ET", ["BT (ET) Tj (a (b) ET) Tj ET\n", "BT ET"]),
        (r"(BT \) BT) BT (\)) Tj", [r"BT (\)) Tj"]),
        ("BT (never closed", ["BT (never closed"]),
        ("ABT x ET BTA ET", []),
    ],
)
def test_text_blocks(stream, found):
    assert [stream[a:b] for a, b in streams.blocks(stream)] == found


def test_long_stream():
    body = "BT (x) Tj ET 0 0 m " * 60_000
    assert len(streams.blocks(body)) == 60_000


def test_shown_texts():
    assert streams.shown(r"(a\(b\)\101\n) Tj <4142> Tj [(c) 5 (d) <45>] TJ (e) Tj") == "a(b)A\n e AB c d E"
    assert streams.unescaped(r"\\ \q \7 \050") == "\\ \\q \x07 ("


def test_streams_by_mode(spark):
    rows = [(1, "BT (V1) Tj ET BT (Dupont) Tj ET BT (25mm/s) Tj ET q"), (2, "BT (Dupont) Tj ET BT (25mm/s) Tj ET q"), (3, ""), (4, None)]
    cut = spark.createDataFrame(rows, "k int, s string").select("k", streams.pieces(F.col("s")).alias("c"))
    found = {r["k"]: tuple(r)[1:] for r in cut.select("k", streams.redacted(F.col("c"), "full"), streams.redacted(F.col("c"), "smart")).collect()}
    assert found == {1: ("BT (V1) Tj ET q", "BT (V1) Tj ET BT (25mm/s) Tj ET q"), 2: ("q", "q"), 3: ("", ""), 4: (None, None)}


@pytest.mark.parametrize(
    "value, kept",
    [("sinu\u017f", False), ("onde \u017fegment", True), ("\u017fegmen", False), ("bloc\u212a", True), ("\u212aHz", True), ("\u0130schem", False), ("ISCH\u00c9MIE", True), ("FC\u212a", True), ("x FC\u0130 y", True), ("x xFC y", False), ("x ecg\u017f y", True), ("b " * 100_000, False)],
)
def test_folding(spark, value, kept):
    """Letters outside ASCII are not ASCII ones, whatever their small form, and end words."""
    assert spark.range(1).select(text.kept(F.lit(value), "smart")).first()[0] == kept


def test_measured_points(spark):
    points = spark.createDataFrame([("p", "I", 0, 1.0, 100.0, -20.0), ("p", "I", 5, 0.0, 100.0, 106.0), ("p", "II", 2, -1.0, 100.0, 227.0)], "page string, lead string, i int, mv double, base double, y double")
    found = verify.measured(points, "i", "mv", "base", "y")
    assert [(r["error_mm"], r["error_percent"], r["status"]) for r in found.orderBy("lead", "i").collect()] == [(0.0, 0.0, "PASS"), (-0.5, 0.0, "PASS"), (pytest.approx(-7 / 12), pytest.approx(7 / 1.2), "FAIL")]
    assert tuple(verify.overall(found, ["page"]).first())[1] == "FAIL"
    report = verify.reports(found, ["page"], "lead").first()
    assert '"overall_status":"FAIL"' in report["report"] and report["text"].endswith("OVERALL STATUS: FAIL") and report["text"].startswith("Lead I: 2 points, max -0.500 mm")
    assert verify.reports(found.where("false"), ["page"], "lead").count() == 0


def test_issues_of_nothing(spark):
    empty = spark.range(1).select(F.from_json(F.lit("{}"), checks.ENTRIES).alias("e"))
    issues = empty.select(checks.array_issues("e")).first()[0]
    assert len(issues) == 8 + 8 + 4 + 1 + 2 and issues[0] == "Missing metadata: layout_type" and "No signal_* keys found" in issues


@pytest.mark.parametrize("path, w, h, ok, renamed", [("a/b/c_p0.png", 3564, 2520, True, "a/b/c_p0.png"), ("a/b/c_p0.png", 1, 2, False, "a/b/SIZE_ERROR_1x2_c_p0.png"), ("c", 1, 2, False, "SIZE_ERROR_1x2_c"), ("c", None, None, False, "c")])
def test_sizes(spark, path, w, h, ok, renamed):
    frame = spark.createDataFrame([(path, w, h)], "p string, w int, h int")
    assert tuple(frame.select(checks.size_checked(F.col("p"), F.col("w"), F.col("h")).alias("c")).first()["c"]) == (ok, renamed)


def test_exports(spark):
    images = spark.createDataFrame([("in/x.y/a.HDF5", "out/b.c.png", "j", "m", 0, 1, 3, '{"format_choice": "3x4+1", "rythm_leads": ["II"], "grid_style": ["a"]}'), ("n", "out/.png", "j", "m", 0, 2, 3, None)], "source_path string, image_path string, json_path string, masks_folder_path string, page_index int, page_count int, num_masks int, config string")
    first, second = writers.dataset_rows(images).orderBy("page_count").collect()
    assert (first["image_id"], first["source_type"], first["rythm_leads"], first["grid_style_major"], first["grid_style_minor"], first["has_extra_leads"]) == ("b.c", "hdf5", "II", "a", None, True)
    assert (second["image_id"], second["source_type"], second["format_choice"], second["is_multipage"]) == (".png", "unknown", "", True) and len(first) == 46
    names = spark.createDataFrame([(1, 'x"y', False), (2, "z", True), (3, None, None)], "k int, n string, bad boolean")
    lines = writers.correspondence_lines(writers.export_names(names, ["k"], "bad"), "k", "export_name", "n")
    assert [r["line"] for r in lines.orderBy("place").collect()] == ["﻿nom_anonymise,nom_original", '"ecg_anonymise_1","x""y"', '"ecg_anonymise_2",""']


def test_archives(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", signal_I=np.arange(6, dtype="<i2").reshape(3, 2), speed=np.array(25.0))
    (tmp_path / "b.npz").write_bytes(b"PK damaged")
    found = {r["path"][-5]: r for r in stored.read_archives(spark, str(tmp_path)).collect()}
    entries = {e["name"]: e for e in found["a"]["entries"]}
    assert found["a"]["error"] is None and entries["signal_I"]["shape"] == [3, 2] and entries["speed"]["shape"] == [] and np.frombuffer(entries["signal_I"]["data"], "<i2").tolist() == list(range(6))
    assert found["b"]["entries"] is None and "cannot be read" in found["b"]["error"]


def test_streams_and_archives_of_nothing(spark):
    frame = spark.createDataFrame([(0, None), (1, b""), (2, b"abc")], "k int, b binary").withColumn("z", stored.deflated(F.col("b")))
    read = frame.select("k", stored.inflated(F.col("z")).alias("b"), stored.inflated(F.expr("substr(z, 1, length(z) - 3)")).alias("cut"))
    assert [tuple(r) for r in read.orderBy("k").collect()] == [(0, None, None), (1, b"", None), (2, b"abc", None)]
    none = spark.range(1).select(F.expr("cast(null as array<struct<name: string, dtype: string, shape: array<int>, data: binary>>)").alias("e"))
    read = none.select(stored.packed("e").alias("c")).select("c", stored.unpacked("c").alias("u")).first()
    assert read["c"] is None and read["u"]["entries"] is None and "cannot be read" in read["u"]["error"]


def test_long_streams_are_not_held_together(spark):
    """2,000 texts of 100 KB in one task: 200 MB, of which a worker holds few at a time."""
    psutil = pytest.importorskip("psutil")
    done, peak = threading.Event(), 0

    def workers():
        for p in psutil.Process().children(recursive=True):
            try:
                if "pyspark" in " ".join(p.cmdline()) and "python" in p.name():
                    yield p.pid, p.memory_info().rss
            except psutil.Error:
                pass

    before = dict(workers())

    def watch():
        nonlocal peak
        while not done.wait(0.02):
            peak = max([peak, *(rss - before.get(pid, 0) for pid, rss in workers())])

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        made = spark.range(0, 2000, 1, 1).select(stored.deflated(F.encode(F.repeat(F.lit("x"), 100_000), "UTF-8")).alias("z"))
        whole = made.select(stored.inflated(F.expr("substr(z, 1)")).alias("t")).agg(F.sum(F.octet_length("t"))).first()[0]
    finally:
        done.set()
        watcher.join()
    assert whole == 200_000_000
    assert 0 < peak < 300 * 2**20


def test_files(spark, tmp_path):
    for name, data in (("a.b.pdf", b"%PDF-1.4"), ("c.xml", b"\xef\xbb\xbf <?xml"), ("d", b"\0")):
        (tmp_path / name).write_bytes(data)
    found = {r["id"]: (r["kind"], r["length"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert found == {"a.b": ("pdf", 8), "c": ("xml", 9), "d": ("unknown", 1)}


def test_interpolation_and_words(spark):
    frame = spark.createDataFrame([([0.0, 1.0, 1.0, 3.0], [1.0, 2.0, 5.0, 3.0], [-1.0, 0.0, 1.0, 2.0, 4.0], "AQACAA==", "AQ"), ([0.0], [1.0], [0.0], "", None)], "t array<double>, v array<double>, g array<double>, p string, q string")
    many, few = frame.select(arrays.interpolated("t", "v", "g").alias("i"), codec.int16_samples("p", "1000").alias("p"), codec.int16_samples("q", "1000").alias("q")).collect()
    assert many["i"] == [0.0, 1.0, 2.0, 4.0, 2.0] and few["i"] is None
    assert (many["p"], many["q"], few["p"], few["q"]) == ([1.0, 2.0], [], [], None)


def test_noise_sizes():
    for kind, levels in noise.LEVELS.items():
        sizes = []
        for seed in range(300):
            made = noise.KINDS[kind](np.random.RandomState(seed), 5000, 500.0)
            assert len(made) == 5000
            sizes.append(np.abs(made).max())
        assert min(sizes) > 0.5 * levels[0][0] and levels[2][0] < max(sizes) < 2.2 * levels[2][1]
        assert all(len(noise.KINDS[kind](np.random.RandomState(1), n, 500.0)) == n for n in (1, 2, 99, 101))


def test_shades(spark):
    assert spark.range(1).select(sampling.shaded(F.lit("#00ff80"), 0, F.col("id"))).first()[0] == "#00ff80"


def test_background_of_an_empty_page(spark):
    pages = spark.createDataFrame([(1, 3, 2)], "k int, width int, height int")
    none = spark.createDataFrame([], "k int, y int, x int, value int")
    assert sorted((r["y"], r["xs"]) for r in raster.background(none, pages, ["k"]).collect()) == [(0, [0, 1, 2]), (1, [0, 1, 2])]


def test_rotation_needs_most_traces(spark):
    rising = [{"x": 40.0 * (i % 2), "y": 5.0 * i} for i in range(60)]
    level = [{"x": 5.0 * i, "y": 40.0 * (i % 2)} for i in range(60)]
    rows = [(1, i, rising) for i in range(5)] + [(2, i, rising if i < 3 else level) for i in range(6)] + [(3, i, rising) for i in range(3)]
    lines = spark.createDataFrame(rows, "page_id int, poly_id int, pts array<struct<x:double,y:double>>").select("*", *(F.lit(0.0).alias(c) for c in "rgb"), F.lit(60).alias("n"))
    found = {r["page_id"]: r["rotation"] for r in geometry.rotation_scores(geometry.rotation_candidates(lines, ["page_id"], "poly_id"), ["page_id"]).collect()}
    assert found[1] == 270 and found[2] == 0 and 3 not in found


def test_extract_of_nothing(spark):
    ops = spark.createDataFrame([], "page_id long, op_pos int, op string, args array<double>, sub_ops array<string>")
    pages = spark.createDataFrame([(1, 100.0, 100.0, None, None, None, None)], "page_id long, width double, height double, viewport array<double>, producer string, creator string, author string")
    texts = spark.createDataFrame([], "page_id long, pos int, text string, x double, y double")
    channels, status = extract.extract(ops, pages, texts)
    assert channels.count() == 0 and [tuple(r) for r in status.collect()] == [(1, "NO_TRACES")]


def test_documents_of_a_path(spark, tmp_path):
    (tmp_path / "a.b.XML").write_text("<R><SampleBase>250</SampleBase></R>")
    found = waveform_xml.read_documents(spark, str(tmp_path))
    assert [tuple(r) for r in waveform_xml.source_duration(found.withColumn("n", F.lit(500)), "n").select("ecg_id", "duration_s").collect()] == [("a.b", 2.0)]
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError, match="c.txt"):
        waveform_xml.read_documents(spark, str(tmp_path))


def test_places_without_one_task(spark):
    """Places over ranges, for ties, nulls and no rows; no window without keys in the plan."""
    from stripchart.sources import writers

    rows = spark.createDataFrame([(i * 7 % 50, f"n{i}") for i in range(200)] + [(None, "x")], "k int, n string").repartition(5)
    found = writers.numbered(rows, ["k", "n"])
    wanted = sorted(((r["k"] is not None, r["k"] or 0, r["n"]) for r in rows.collect()))
    assert [(r["k"] is not None, r["k"] or 0, r["n"]) for r in sorted(found.collect(), key=lambda r: r["place"])] == wanted
    assert sorted(r["place"] for r in found.collect()) == list(range(1, 202))
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert writers.numbered(rows.where("false"), ["k"]).count() == 0


def test_strip_of_most_points(spark):
    from stripchart.plans.extract import with_rhythm

    fields = "page_id long, poly_id int, name string, samples array<double>, duration_s double, sample_rate_hz int, n_points int"
    rows = [(1, 1, "II_rhythm", [1.0], 10.0, 1, 60), (1, 2, "V1_rhythm", [2.0], 10.0, 1, 200), (1, 3, "V5_rhythm", [3.0], 10.0, 1, 200), (1, 0, "II", [0.0], 10.0, 1, 9)]
    found = {r["name"]: r["samples"] for r in with_rhythm(spark.createDataFrame(rows, fields)).collect()}
    assert found == {"II": [0.0], "II_rhythm": [2.0]}


def test_documents_judged_as_wholes(spark):
    """Circles end; a label that the first page cannot reach counts for nothing; objects without
    documents and null streams stay."""
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 5, 5), (2, 7, 8)], "document int, object int, to_object int")
    first = spark.createDataFrame([(1, 1), (2, 5), (3, 9)], "document int, object int")
    drawn = streams.drawn_objects(edges, first)
    assert sorted(map(tuple, drawn.collect())) == [(1, 1), (1, 2), (1, 3), (2, 5), (3, 9)]
    label, other = "BT (V1) Tj ET ", "BT (25mm/s) Tj ET "
    rows = [(1, 1, other), (1, 3, label), (1, 4, other), (2, 5, other), (2, 8, label), (3, 9, None), (4, 1, other)]
    cut = spark.createDataFrame(rows, "document int, object int, s string").select("document", "object", streams.pieces(F.col("s")).alias("cut"))
    found = {(r["document"], r["object"]): (r["readable"], r["stream"]) for r in streams.redacted_documents(cut, drawn, "smart").collect()}
    assert found[1, 1] == (True, other) and found[1, 3] == (True, label) and found[1, 4] == (True, other)
    assert not any(found[k][0] or "mm" in (found[k][1] or "") for k in ((2, 5), (2, 8), (4, 1))) and found[3, 9][0] is False


def test_stored_arrays_multiply_in_single_precision(spark, tmp_path):
    """0.053 and -0.149 times 1000 are whole in single precision and not in double."""
    from stripchart.catalogue import ORACLE_SQL, QUERIES

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, [0.053, 0.25]), (2, [-0.149, 0.5])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["total"] for r in QUERIES["q_stored_arrays"](spark, str(tmp_path)).collect()}
    sql = duckdb.sql(f"with embeddings as (select * from '{tmp_path}/embeddings.parquet/*.parquet') select vec_id, total from ({ORACLE_SQL['q_stored_arrays']})")
    assert found == dict(sql.fetchall()) == {1: 303.0, 2: 351.0}


def test_points_of_candidates_are_not_sorted(spark):
    """What is told of polylines is shuffled and sorted, their points are not."""
    lines = spark.range(4).select(F.lit(1).alias("page_id"), F.col("id").alias("poly_id"), F.expr("transform(sequence(0, 59), i -> struct(2D * i as x, 0D as y))").alias("pts"), *(F.lit(0.0).alias(c) for c in "rgb"), F.lit(60).alias("n"))
    found = geometry.rotation_candidates(lines, ["page_id"], "poly_id")
    assert "pts" not in found.columns and found.where("s0 and s180 = false").count() == 4
    assert geometry.rotation_scores(found, ["page_id"]).first()["rotation"] == 0


@pytest.mark.parametrize("name", ["q_vector_operations", "q_inspected", "q_redact_documents", "q_stream_redact"])
def test_short_rows_are_dealt_before_they_cost(spark, tmp_path, name):
    """A file of short rows is read by one task; what its rows explode to or cost is made by several."""
    from stripchart.catalogue import QUERIES

    spark.range(8).selectExpr("id as s_suppkey", "id as c_custkey", "'a#' as c_name", "id as o_orderkey", "id % 3 as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for other in ("customer", "orders"):
        spark.read.parquet(f"{tmp_path}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/{other}.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() >= 7 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
