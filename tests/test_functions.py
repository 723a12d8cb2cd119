"""Rules with known results: rounding, ties, arrays, codecs, texts."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from stripchart.functions import arrays, codec, numeric, text
from stripchart.operators import layout, sampling


def one(df, *columns):
    row = df.select(*columns).collect()[0]
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


@pytest.mark.parametrize("value, up, even", [(-2.5, -2, -2), (-0.5, 0, 0), (0.5, 1, 0), (1.5, 2, 2), (2.5, 3, 2)])
def test_rounding(row, value, up, even):
    assert one(row, numeric.half_up(F.lit(value)), numeric.half_even(F.lit(value))) == (up, even)


def test_upper_median(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "v double")
    assert df.agg(numeric.upper_median("v")).first()[0] == 3
    assert df.where("v < 4").agg(numeric.upper_median("v")).first()[0] == 2


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [], 4.998)], "a array<double>, e array<double>, d double")
    assert one(df, arrays.cyclic("a", "7")) == [1, 2, 3, 1, 2, 3, 1]
    assert one(df, arrays.cyclic("a", "2")) == [1, 2] and one(df, arrays.cyclic("e", "2")) == []
    assert len(one(df, arrays.repeated_to("a", "d"))) == 6
    assert one(df, arrays.even_grid("0D", "3D", "4")) == [0, 1, 2, 3] and one(df, arrays.even_grid("5D", "9D", "1")) == [5]
    assert one(df, arrays.median_centred("a")) == [-1, 0, 1]
    assert one(df, arrays.fit_to_duration("a", "3D", 5.0)) == [1, 2, 3, 1, 2] and one(df, arrays.fit_to_duration("e", "3D", 5.0)) == []
    assert one(df, arrays.interpolated("array(0D, 1D, 3D)", "a", "array(0D, 0.5D, 2D, 3D)")) == [1, 1.5, 2.5, 3]
    lead = spark.createDataFrame([([1.0], [3.0])], "i array<double>, ii array<double>")
    assert one(lead, *(arrays.derived("i", "ii", n)[0] for n in ("III", "aVR", "aVL", "aVF"))) == (2, -2, -0.5, 2.5)


def test_int16(spark):
    values = [0.0, 0.00024, 0.00025, -0.00025, 16.3835, 20.0, -20.0, None]
    df = spark.createDataFrame([(values,)], "s array<double>").withColumn("c", codec.adc_counts("s")).withColumn("b", codec.int16_base64("c"))
    wanted = [0, 0, 1, 0, 32767, 32767, -32768, 0]
    assert one(df, "c") == wanted
    assert base64.b64decode(one(df, "b")) == struct.pack("<8h", *wanted)
    assert one(df, codec.int16_samples("b", "0.5")) == [c * 0.5 / 1000 for c in wanted]
    assert one(df, codec.int16_samples("''", "0.5")) == []


def test_map_codes(row):
    code = lambda x: one(row, codec.map_code(F.lit(float(x))))
    assert [code(x) for x in (-300, -200, 0, 5000, -199.96875, -199.90625)] == [0, 0, 3200, 65535, 0, 2]
    assert one(row, codec.map_coordinate(F.lit(3200)), codec.map_coordinate(F.lit(8), 1)) == (0, 2)


def test_digits(spark):
    df = spark.createDataFrame([([0.01, -0.0025, None],)], "s array<double>")
    assert one(df, codec.hl7_digits("s", "5")) == "2 0 0 0 0"
    assert one(df, codec.xml_escaped(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"


@pytest.mark.parametrize(
    "value, smart, full",
    [("aVR", True, True), (" II ", True, True), ("", True, True), ("25mm/s", True, False), ("-60", True, False), ("450/535", True, False), ("éFC", True, False), ("ISCHÉMIE", True, False), ("DOE", True, False), ("1962", True, False), ("Dupont Marie", False, False), ("12/03/1962", False, False)],
)
def test_whitelist(row, value, smart, full):
    assert one(row, text.kept(F.lit(value), "smart"), text.kept(F.lit(value), "full")) == (smart, full)


def test_names(row):
    assert one(row, text.latin1(F.lit("a–b… “c” d中")), text.safe_name(F.lit("a b.é")), text.stem(F.lit("x.PDF"))) == ('a-b... "c" d', "a_b__", "x")
    assert one(row, text.normal_lead(F.lit(" DII ")), text.normal_lead(F.lit("Q")), text.normal_lead(F.lit("X9"), {"X9": "V3"})) == ("II", None, "V3")
    assert one(row, text.base_lead(F.lit("V1_seg3")), text.mdc_code(F.lit("aVR_rhythm")), text.is_rhythm(F.lit("II_RHYTHM"))) == ("V1", "MDC_ECG_LEAD_AVR", True)


def test_draws(spark):
    df = spark.range(20000)
    share = {r[0]: r[1] / 20000 for r in df.groupBy(sampling.weighted("noise", F.col("id"))).count().collect()}
    assert abs(share["none"] - 0.8) < 0.02 and abs(share["high"] - 0.05) < 0.01
    twice = [sorted(df.repartition(n).select("id", sampling.weighted("format", F.col("id"))).collect()) for n in (2, 5)]
    assert twice[0] == twice[1]
    drawn = df.limit(100).select(sampling.distinct_draws("r", 3, F.col("id"), choices=[("II", 5), ("V1", 2), ("V5", 1), ("I", 1)]).alias("d")).collect()
    assert all(len(set(r["d"])) == 3 for r in drawn)
    assert all(sorted(r[0]) == sorted(text.LEADS) for r in df.limit(9).select(sampling.shuffled(text.LEADS, F.col("id"))).collect())


def test_layout_rules(row):
    parts = one(row, layout.format_size(F.lit("3x4+2")))
    assert (parts["rows"], parts["cols"], parts["rhythms"]) == (3, 4, 2)
    assert one(row, layout.format_size(F.lit("6x1;6x1")))["rows"] is None
    assert one(row, layout.availability(F.lit(0.0), F.lit(0), F.lit(False), F.lit(True)), layout.native_format(F.lit(4.0)), layout.target_seconds(F.lit("6x2+1"), F.lit("6x2+1"), F.lit(7.0))) == ("duration", "3x4+1", 7.0)
