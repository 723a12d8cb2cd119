"""Texts, files and documents: whitelists, names, payloads, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripchart.functions import codec, text
from stripchart.operators import noise, sampling
from stripchart.queries.registry import query, samples, table
from stripchart.sources import files, waveform_xml


def _sql_patterns() -> str:
    tests = []
    for pattern, case in text.KEPT_PATTERNS:
        quoted = pattern.replace("'", "''")
        tests.append(f"regexp_matches(t, '{quoted}'{'' if case else ', chr(105)'})".replace("chr(105)", "'i'"))
    return " or ".join(tests)


_LABELS = ", ".join(f"'{x}'" for x in text.LEAD_LABELS)


@query(f"""with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents), d as (select w, regexp_replace(w, '^[\\t\\n\\v\\f\\r \\x{{00A0}}]+|[\\t\\n\\v\\f\\r \\x{{00A0}}]+$', '', 'g') as t, count(*) as n from w group by w)
select t in ({_LABELS}) as label, t = '' or t in ({_LABELS}) or {_sql_patterns()} as kept, count(*) as tokens, cast(sum(n) as bigint) as uses from d group by all""")
def q_whitelist_regex(spark, sf_dir):
    """Tokens of all documents that the whitelist keeps."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    judged = words.select("n", text.is_lead_label(F.col("w")).alias("label"), text.is_kept_text(F.col("w")).alias("kept"))
    return judged.groupBy("label", "kept").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("uses"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), t as (select doc_id, regexp_replace(line, '^[\\t\\n\\v\\f\\r \\x{{00A0}}]+|[\\t\\n\\v\\f\\r \\x{{00A0}}]+$', '', 'g') as t from l)
select doc_id, count(*) as lines, count(*) filter (t = '' or t in ({_LABELS})) as kept_full, count(*) filter (t = '' or t in ({_LABELS}) or {_sql_patterns()}) as kept_smart from t group by doc_id""")
def q_redact_lines(spark, sf_dir):
    """Lines of documents that either mode of redaction keeps."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(text.kept(F.col("line"), "full")).alias("kept_full"), F.count_if(text.kept(F.col("line"), "smart")).alias("kept_smart"))


@query("""with p as (select page_id, case page_id % 5 when 0 then html when 1 then '<?xml version="1.0"?>' || html when 2 then chr(65279) || '  <svg>' || html when 3 then 'text ' || html else regexp_replace(html, '^<!DOCTYPE html', '<!doctype') end as t from pages),
h as (select page_id, ltrim(replace(t, chr(65279), ''), ' ' || chr(9) || chr(10) || chr(13)) as t from p)
select page_id, case when starts_with(t, '<?xml') or (starts_with(t, '<') and not starts_with(t, '<!DOCTYPE html')) then 'xml' else 'unknown' end as kind from h""")
def q_sniff_markup(spark, sf_dir):
    """Markup by its first characters; web pages are none."""
    variant = F.col("page_id") % 5
    head = F.when(variant == 1, '<?xml version="1.0"?>').when(variant == 2, "\ufeff  <svg>").when(variant == 3, "text ").otherwise("")
    body = F.when(variant == 4, F.regexp_replace("html", "^<!DOCTYPE html", "<!doctype")).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(head, body), "UTF-8").alias("content"))
    return pages.select("page_id", files.file_kind("content").alias("kind"))


@query("""with c as (select page_id, page_id % 10 as k, ['255044462D', '89504E470D0A1A0A00', 'FFD8FFE0', '474946383961', '424D0000', '49492A00', '52494646000000005745425056503820', repeat('00', 128) || '4449434D', '0102', ''][page_id % 10 + 1] || hex(encode(html)) as h from pages)
select page_id, case when starts_with(h, '25504446') then 'pdf' when starts_with(h, '89504E47') then 'png' when starts_with(h, 'FFD8FF') then 'jpeg' when starts_with(h, '47494638') then 'gif' when starts_with(h, '424D') then 'bmp' when starts_with(h, '49492A00') or starts_with(h, '4D4D002A') then 'tiff'
 when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'webp' when substr(h, 257, 8) = '4449434D' then 'dicom' when starts_with(h, '3C3F786D6C') or (starts_with(h, '3C') and not starts_with(h, '3C21444F43545950452068746D6C')) then 'xml' else 'unknown' end as kind from c""")
def q_file_kind(spark, sf_dir):
    """Files by their signatures: pages behind the heads of nine kinds of file, and as they are."""
    heads = ["255044462D", "89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "424D0000", "49492A00", "52494646000000005745425056503820", "00" * 128 + "4449434D", "0102", ""]
    content = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % len(heads) + 1).cast("int"))), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", content.alias("content")).select("page_id", files.file_kind("content").alias("kind"))


@query("""select page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') as safe, replace(replace(replace(replace(url || '<"&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped,
 regexp_replace(url || '.PDF', '\\.pdf$', '', 'i') as stem, regexp_replace('V' || (page_id % 6 + 1) || case page_id % 3 when 0 then '_seg' || page_id when 1 then '_extra' else '' end, '(_seg\\d+|_extra)$', '') as lead from pages""")
def q_names(spark, sf_dir):
    """File names, markup escapes, channel names."""
    pages = table(spark, sf_dir, "pages")
    channel = F.concat(F.lit("V"), F.col("page_id") % 6 + 1, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("_seg"), "page_id")).when(F.col("page_id") % 3 == 1, "_extra").otherwise(""))
    return pages.select(
        "page_id", text.safe_name(F.col("url")).alias("safe"), codec.xml_escaped(F.concat("url", F.lit('<"&>'))).alias("escaped"), text.stem(F.concat("url", F.lit(".PDF"))).alias("stem"), text.base_lead(channel).alias("lead")
    )


@query("""select doc_id, md5(regexp_replace(replace(regexp_replace(replace(replace(replace(text, chr(233), chr(8211)), 'the', '…'), 'a', chr(8217)), '[‐-―]', '-', 'g'), chr(8217), chr(39)), '[^\\x{00}-\\x{FF}…]', '', 'g').replace('…', '...')) as digest,
 length(text) as chars from documents""")
def q_latin1(spark, sf_dir):
    """Texts with typographic marks made plain."""
    odd = F.replace(F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("–")), F.lit("the"), F.lit("…")), F.lit("a"), F.lit("’"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(text.latin1(odd), "UTF-8")).alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k, json_object('k', cast(json_extract(props, '$.k') as integer), 'type', event_type) as config from events")
def q_json_config(spark, sf_dir):
    """Configurations from and to JSON."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", "p.k", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("config"))


@query("""with c as (select user_id, event_type as name, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos, least(32767, greatest(-32768, floor((value - 250) * 10 / 0.5 + 0.5))) * 0.5 / 1000 as mv from events)
select user_id, name, pos, round(mv, 6) as mv from c""")
def q_waveform_xml(spark, sf_dir):
    """Channels written as waveform XML and read back from it, sample by sample."""
    from stripchart.functions.arrays import in_order

    rows = samples(spark, sf_dir).groupBy("user_id", "event_type").agg(in_order("struct(t, event_id)", "(v - 250) / 100").alias("samples"))
    placed = rows.select(F.col("user_id").alias("ecg_id"), F.hash("event_type").alias("pos"), F.col("event_type").alias("name"), "samples", F.lit(500).alias("sample_rate_hz"))
    read = waveform_xml.channels(waveform_xml.write_muse(placed), derive=False)
    each = read.select(F.col("ecg_id").alias("user_id"), "name", F.posexplode("samples").alias("pos", "mv"))
    return each.select("user_id", "name", F.col("pos").cast("bigint").alias("pos"), F.round("mv", 6).alias("mv"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def q_resume_jobs(spark, sf_dir):
    """Jobs whose result is not there yet."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.unfinished(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


_SHARES = [(n, str(v), w / sum(x for _, x in sampling.WEIGHTS[n])) for n in sampling.WEIGHTS for v, w in sampling.WEIGHTS[n]]
_SHARES += [("speed_some", str(v), w / 100 * 34 / 100) for v, w in sampling.SPEEDS[True][:1]] + [("first_rhythm", v, w / 100) for v, w in sampling.RHYTHM_LEADS] + [("chance_" + n, "true", p) for n, p in sampling.CHANCES.items()]


@query(f"select unnest({[n for n, _, _ in _SHARES]!r}) as sampler, unnest({[v for _, v, _ in _SHARES]!r}) as value, true as within")
def q_weighted_sampler(spark, sf_dir):
    """Draws for all lines of orders: the share of every value against its weight, within five
    standard deviations."""
    drawn = sampling.configurations(table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("k")).distinct(), "k")
    picks = [F.struct(F.lit(n).alias("sampler"), F.col(n).cast("string").alias("value")) for n in sampling.WEIGHTS]
    picks.append(F.struct(F.lit("speed_some").alias("sampler"), F.col("speed").cast("string").alias("value")))
    picks.append(F.struct(F.lit("first_rhythm").alias("sampler"), F.col("rhythm_leads")[0].alias("value")))
    picks += [F.struct(F.lit(f"chance_{n}").alias("sampler"), F.col(n).cast("string").alias("value")) for n in sampling.CHANCES]
    each = drawn.select(F.explode(F.array(*picks)).alias("p")).select("p.*").where("value is not null").groupBy("sampler", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("sampler").agg(F.sum("n").alias("total"))
    wanted = spark.createDataFrame(_SHARES, "sampler string, value string, share double")
    joined = wanted.join(totals, "sampler").join(each, ["sampler", "value"], "left")
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("total") * F.col("share"))
    return joined.select("sampler", "value", (off <= 5 * F.sqrt(F.col("total") * F.col("share") * (1 - F.col("share"))) + 1).alias("within"))


@query("""select unnest(['h_spacing', 'v_spacing', 'pulse', 'pulse_side', 'pulse_row', 'pulse_space', 'pulse_shift', 'text_shift', 'speed', 'rhythm_leads', 'duration', 'layout_style', 'shade']) as rule, cast(0 as bigint) as broken""")
def q_dependent_draws(spark, sf_dir):
    """What no drawn configuration may have, by rule: a spacing, pulse, speed or strip that its
    format does not allow."""
    d = sampling.configurations(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    form, pulse, strips = F.col("format"), F.col("pulse"), F.coalesce(F.size("rhythm_leads"), F.lit(0))
    rows = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for names, weights in sampling.PULSE_ROWS for n in names for x in (n, len(weights)))), form), F.lit(12))
    broken = {
        "h_spacing": ~F.col("h_spacing").between(0, F.when(form.startswith("3x4"), 15).when(form.startswith("6x2") | form.startswith("4x2"), 20).otherwise(0)),
        "v_spacing": ~F.col("v_spacing").isin(10, 15, 18, 20, 25, 30, 35) | ((form == "12x1") & (F.col("v_spacing") > 15)) | ((form == "3x4_paramedic") & (F.col("v_spacing") != 20)),
        "pulse": (pulse == "two_columns") & ~form.isin("6x2", "4x2"),
        "pulse_side": (F.col("pulse_side").isNull() != (pulse == "none")) | ((F.col("pulse_side") == "middle") & ~form.isin("6x2", "4x2") & (F.col("h_spacing") == 0)),
        "pulse_row": (F.col("pulse_row").isNull() != (pulse != "one")) | ~F.col("pulse_row").between(1, rows),
        "pulse_space": F.col("pulse_space").isNull() != (pulse == "none"),
        "pulse_shift": ~F.col("pulse_shift").between(-22, 13),
        "text_shift": ~F.col("text_shift").between(-10, 20),
        "speed": (F.col("speed") == 12.5) & ~form.isin("6x2", "3x4", "4x2"),
        "rhythm_leads": (strips != F.when(form.isin(sampling.RHYTHM_FORMATS), F.substring(form, -1, 1).cast("int")).otherwise(0)) | (F.size(F.array_distinct("rhythm_leads")) != strips),
        "duration": ((F.col("duration_mode") == "random_short") != F.col("duration_fraction").isNotNull()) | ~F.col("duration_fraction").between(0.8, 1.0) | ((F.col("h_spacing") > 0) & ~form.isin("12x1", "6x1;6x1") & F.col("duration_mode").isin("standard", "with_calib")),
        "layout_style": (F.col("layout_style") != "full_grid") & (form.endswith("_cardiofax") | (form == "3x4_paramedic")),
        "shade": (F.col("signal_color") == "shade") != F.col("shade").isNotNull(),
    }
    counts = d.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in broken.items()))
    return counts.select(F.explode(F.create_map(*(x for n in broken for x in (F.lit(n), F.col(n))))).alias("rule", "broken"))


@query("select vec_id as ecg_id, true as within, true as changed from embeddings")
def q_noise(spark, sf_dir):
    """Embeddings as channels with drawn noise: how far each kind may move a sample, by the largest
    of its levels (eight deviations of what is normal in it), and that it moves some."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select(F.col("vec_id").alias("ecg_id"), F.lit(0).alias("place"), F.lit("II").alias("name"), F.expr("transform(embedding, x -> cast(x as double))").alias("samples"), sampling.weighted("kind", F.col("vec_id"), choices=[("none", 1), ("low", 1), ("powerline", 1), ("high", 1)]).alias("noise"))
    noisy = noise.with_noise(base).select("ecg_id", "noise", F.col("samples").alias("after"))
    moved = noisy.join(base.select("ecg_id", "samples"), "ecg_id").withColumn("far", F.expr("array_max(zip_with(after, samples, (a, b) -> abs(a - b)))"))
    most = F.when(F.col("noise") == "low", 0.75 * (1 + 0.08)).when(F.col("noise") == "powerline", 0.15 * 1.4).when(F.col("noise") == "high", 0.15 * (1 + 8 * 0.2)).otherwise(0.0)
    return moved.select("ecg_id", (F.col("far") <= most).alias("within"), ((F.col("far") > 0) == (F.col("noise") != "none")).alias("changed"))


@query("""select vec_id as ecg_id, len(embedding) * 3 as before, true as known_rate, true as on_the_line, vec_id::double as first, vec_id + 2.0 * (3 * len(embedding) - 1) as last, vec_id + 3.0 * len(embedding) - 1 as mean from embeddings""")
def q_thinned(spark, sf_dir):
    """Straight channels thinned: each has the samples of one of the rates, on its line, with its ends and its mean."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ecg_id"), (F.size("embedding") * 3).alias("before"))
    rows = e.select("ecg_id", "before", F.lit(0).alias("place"), F.lit("II").alias("name"), F.expr("transform(sequence(0, before - 1), i -> cast(2 * i + ecg_id as double))").alias("samples"), F.lit("none").alias("noise"))
    made = noise.thinned(rows)
    sizes = F.array(F.col("before").cast("double"), *(F.rint(F.col("before") * r / 500) for r in noise.RATES))
    line = F.expr("forall(transform(samples, (x, i) -> abs(x - (ecg_id + 2 * i * (before - 1) / (size(samples) - 1)))), d -> d < 1e-6)")
    return made.select("ecg_id", F.col("before").cast("bigint").alias("before"), F.array_contains(sizes, F.size("samples").cast("double")).alias("known_rate"), line.alias("on_the_line"),
        F.col("samples")[0].alias("first"), F.element_at("samples", -1).alias("last"), F.round(F.expr("aggregate(samples, 0D, (a, x) -> a + x) / size(samples)"), 6).alias("mean"))


@query("select o_orderkey, r as repeat, p as page from orders, range(2) a(r), range(3) b(p) where p < o_orderkey % 3 + 1")
def q_jobs(spark, sf_dir):
    """Repeats and pages of each record, with seeds of their own."""
    made = sampling.jobs(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 2, (F.col("o_orderkey") % 3 + 1).cast("int"))
    return made.select("o_orderkey", F.col("repeat").cast("bigint").alias("repeat"), F.col("page").cast("bigint").alias("page"))
