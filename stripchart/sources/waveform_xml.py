"""Waveform XML: channels from documents, and documents from channels.

Documents are rows (ecg_id, xml). Spark's own XPath functions read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.functions import arrays, codec
from stripchart.functions.text import LEADS, mdc_code
from stripchart.functions.codec import xml_escaped

_RHYTHM = "//Waveform[translate(WaveformType, 'rhytm', 'RHYTM')='RHYTHM']"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """ecg_id (file stem), xml of the files under a path. ValueError where one is no .xml file."""
    found = spark.read.format("binaryFile").load(path)
    other = found.where(~F.col("path").rlike(r"(?i)\.xml$")).select("path").limit(1).collect()
    if other:
        raise ValueError(f"only .xml files are read: {other[0]['path']}")
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("ecg_id"), F.decode("content", "UTF-8").alias("xml"))


def _lead_data(documents: DataFrame) -> DataFrame:
    """ecg_id, pos, name, gain, payload of the lead data of rhythm waveforms, in their order."""
    path = lambda field: F.expr(f"""xpath(xml, "{_RHYTHM}/LeadData/{field}/text()")""")
    ok = documents.where(F.col("xml").isNotNull()).select("ecg_id", path("LeadID").alias("n"), path("LeadAmplitudeUnitsPerBit").alias("g"), path("WaveFormData").alias("d"))
    return ok.select("ecg_id", F.posexplode(F.arrays_zip("n", "g", "d")).alias("pos", "z")).select("ecg_id", "pos", F.trim("z.n").alias("name"), F.col("z.g").alias("gain"), F.col("z.d").alias("payload"))


def channels(documents: DataFrame, derive: bool = True) -> DataFrame:
    """ecg_id, name, samples (millivolts), of the rhythm waveforms of each document.

    Of leads with the same name the last counts. With `derive`, leads III, aVR, aVL and aVF are
    computed from I and II where both are there, in place of what the document says. Documents
    that are not well-formed have no channels.
    """
    each = _lead_data(documents)
    last = each.groupBy("ecg_id", "name").agg(F.max_by(F.struct("gain", "payload"), "pos").alias("v"))
    read = last.select("ecg_id", "name", codec.int16_samples("v.payload", "v.gain").alias("samples"))
    if not derive:
        return read
    limb = read.where(F.col("name").isin("I", "II")).groupBy("ecg_id").pivot("name", ["I", "II"]).agg(F.first("samples")).where("I is not null and II is not null")
    made = limb.select("ecg_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), arrays.derived("I", "II", n).alias("samples")) for n in ("III", "aVR", "aVL", "aVF")))).alias("z")).select("ecg_id", "z.name", "z.samples")
    return read.join(made.select("ecg_id", "name"), ["ecg_id", "name"], "left_anti").unionByName(made)


def standard(read: DataFrame) -> DataFrame:
    """The twelve leads only, with their place."""
    place = F.array_position(F.array(*map(F.lit, LEADS)), F.col("name"))
    return read.where(place > 0).withColumn("place", place - 1)


def sample_base(documents: DataFrame) -> DataFrame:
    return documents.select("ecg_id", F.expr("try_cast(xpath_string(xml, '//SampleBase') as int)").alias("sample_rate_hz"))


def source_duration(documents: DataFrame, samples: str) -> DataFrame:
    """documents with duration_s: the number of samples (a column) over the first sample base; null
    where either is not positive or cannot be read."""
    rate = F.expr("try_cast(xpath_string(xml, '//SampleBase') as double)")
    return documents.withColumn("duration_s", F.when((rate > 0) & (F.col(samples) > 0), F.col(samples) / rate))


def rhythm_strip(documents: DataFrame) -> DataFrame:
    """ecg_id, samples of the first channel, by its position, whose name ends as a rhythm strip's,
    in either case, and which has a gain and data."""
    found = _lead_data(documents).where(F.col("name").rlike("(?i)_rhythm$") & F.col("gain").isNotNull() & F.col("payload").isNotNull())
    first = found.groupBy("ecg_id").agg(F.min_by(F.struct("gain", "payload"), "pos").alias("v"))
    return first.select("ecg_id", codec.int16_samples("v.payload", "v.gain").alias("samples"))


def longer_rhythm(read: DataFrame, documents: DataFrame) -> DataFrame:
    """Channels of the documents with lead II replaced by the rhythm strip where that is longer."""
    strips = rhythm_strip(documents).withColumnRenamed("samples", "_strip")
    joined = read.join(strips, "ecg_id", "left")
    use = (F.col("name") == "II") & (F.size("_strip") > F.size("samples"))
    return joined.withColumn("samples", F.when(use, F.col("_strip")).otherwise(F.col("samples"))).drop("_strip")


def _gathered(parts: DataFrame) -> DataFrame:
    """parts: ecg_id, pos, text, rate; one row per record with its texts in order."""
    return parts.groupBy("ecg_id").agg(F.max("rate").alias("rate"), arrays.in_order("pos", "text").alias("texts"))


def write_muse(rows: DataFrame) -> DataFrame:
    """ecg_id, xml from channel rows (ecg_id, pos, name, samples, sample_rate_hz)."""
    coded = rows.withColumn("c", codec.adc_counts("samples"))
    text = F.concat(
        F.lit("    <LeadData>\n      <LeadID>"), F.col("name"), F.lit("</LeadID>\n      <LeadAmplitudeUnitsPerBit>0.5</LeadAmplitudeUnitsPerBit>\n      <LeadAmplitudeUnits>MICROVOLTS</LeadAmplitudeUnits>\n      <LeadSampleCountTotal>"),
        F.size("samples").cast("string"), F.lit("</LeadSampleCountTotal>\n      <WaveFormData>"), codec.int16_base64("c"), F.lit("</WaveFormData>\n    </LeadData>"),
    )
    whole = _gathered(coded.select("ecg_id", "pos", text.alias("text"), F.col("sample_rate_hz").alias("rate")))
    rate = F.when(F.col("rate") > 0, F.col("rate")).otherwise(500).cast("string")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<RestingECG>\n  <SampleBase>'), rate, F.lit("</SampleBase>\n  <Waveform>\n    <WaveformType>Rhythm</WaveformType>\n    <SampleBase>"), rate, F.lit("</SampleBase>\n"))
    return whole.select("ecg_id", F.concat(head, F.array_join("texts", "\n"), F.lit("\n  </Waveform>\n</RestingECG>")).alias("xml"))


# --- fixed values: elements and code systems of annotated ECG ------------------------------------
HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<AnnotatedECG xmlns="urn:hl7-org:v3" xmlns:voc="urn:hl7-org:v3/voc" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="urn:hl7-org:v3 ../schema/PORT_MT020001.xsd" classCode="OBS" moodCode="EVN" type="Observation">
  <id extension="{id}"/>
  <code code="93000" codeSystem="2.16.840.1.113883.6.12" codeSystemName="CPT-4"/>
  <effectiveTime><low value="{low}"/><high value="{high}"/></effectiveTime>
  <confidentialityCode code="N" codeSystem="2.16.840.1.113883.5.25"/>
  <componentOf><timepointEvent><componentOf><subjectAssignment><subject><trialSubject><subjectDemographicPerson>
    <name><given>Anonymous</given><family>Patient</family></name>
    <administrativeGenderCode code="UN" codeSystem="2.16.840.1.113883.5.1"/>
    <birthTime value=""/>
  </subjectDemographicPerson></trialSubject></subject></subjectAssignment></componentOf></timepointEvent></componentOf>
  <component><series classCode="OBSSER" moodCode="EVN">
    <id extension="{id}"/>
    <code code="RHYTHM" codeSystem="2.16.840.1.113883.5.4" codeSystemName="ActCode" displayName="Rhythm Waveforms"/>
    <effectiveTime><low value="{low}" inclusive="true"/><high value="{high}" inclusive="false"/></effectiveTime>
    <author><seriesAuthor><manufacturedSeriesDevice><manufacturerModelName>{maker}</manufacturerModelName></manufacturedSeriesDevice><manufacturerOrganization><name>{maker}</name></manufacturerOrganization></seriesAuthor></author>
    <component><sequenceSet>
      <component><sequence><code code="TIME_ABSOLUTE" codeSystem="2.16.840.1.113883.5.4" codeSystemName="ActCode"/><value xsi:type="GLIST_TS"><head value="{low}" unit="s"/><increment value="{step}" unit="s"/></value></sequence></component>
"""
SEQUENCE = """      <component><sequence><code code="{code}" codeSystem="2.16.840.1.113883.6.24" codeSystemName="MDC"/><value xsi:type="SLIST_PQ"><origin value="0" unit="uV"/><scale value="5" unit="uV"/><digits>{digits}</digits></value></sequence></component>"""
TAIL = """
    </sequenceSet></component>
  </series></component>
</AnnotatedECG>"""
# --- end of fixed values -----------------------------------------------------------------------


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def write_annotated(rows: DataFrame, maker: str = "stripchart") -> DataFrame:
    """ecg_id, xml: annotated ECG from channel rows (ecg_id, pos, name, samples, sample_rate_hz);
    all leads padded with 0 to the longest, the subject anonymous, times from the start of 1970 so
    that a rerun writes the same."""
    from pyspark.sql import Window

    longest = F.max(F.size("samples")).over(Window.partitionBy("ecg_id"))
    coded = rows.withColumn("_n", longest)
    text = _filled(SEQUENCE, code=mdc_code(F.col("name")), digits=codec.hl7_digits("samples", "_n"))
    parts = coded.select("ecg_id", "pos", text.alias("text"), F.col("sample_rate_hz").alias("rate"), "_n")
    whole = parts.groupBy("ecg_id").agg(F.max("rate").alias("rate"), F.max("_n").alias("_n"), arrays.in_order("pos", "text").alias("texts"))
    rate = F.when(F.col("rate") > 0, F.col("rate")).otherwise(500)
    time = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")
    head = _filled(HEAD, id=xml_escaped(F.col("ecg_id").cast("string")), low=time(F.lit(0)), high=time(F.col("_n") / rate), maker=xml_escaped(F.lit(maker)), step=F.format_string("%.8f", 1.0 / rate))
    return whole.select("ecg_id", F.concat(head, F.array_join("texts", "\n"), F.lit(TAIL)).alias("xml"))
