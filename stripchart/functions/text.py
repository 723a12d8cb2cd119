"""Strings of documents: whitelists, names, characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: lead names, aliases and what a drawing may keep ----------------------------
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
ALIASES = {"D1": "I", "D2": "II", "D3": "III", "DI": "I", "DII": "II", "DIII": "III"}
LEAD_LABELS = ["I", "II", "III", "aVR", "aVL", "aVF", "AVR", "AVL", "AVF", "avr", "avl", "avf", "D1", "D2", "D3", "DI", "DII", "DIII", "V1", "V2", "V3", "V4", "V5", "V6"]
#: (pattern, case matters): a text that any of them finds stays. \b is the ASCII word boundary.
KEPT_PATTERNS = [
    (r"^(I{1,3}|aV[RLF]|AVR|AVL|AVF|D[123I]{1,3}|V[1-6])$", True),
    (r"(mm\/s|mm\/mV)", False),
    (r"Hz", False),
    (r"bpm", False),
    (r"\bms\b", False),
    (r"\b(FC|HR|PR|QRS|QRSD|QT|QTc[BF]?|RR|Axes?)\b", False),
    (r"(Fr[ée]q|Intervalle|Dur[ée]e|Vent)", False),
    (r"(Vit\b|Speed|Gain|P[ée]r[ií]ph|Pr[ée]c|Filter|Filtre)", False),
    (r"(calibr|1\s*mV)", False),
    (
        r"(sinusal|sinus|tachycard|bradycard|fibrillat|flutter|block|bloc|branche|infarct|isch[ée]mi|hypertro|rythm|rhythm|segment|onde|wave|normal|anormal|abnormal|interval|d[ée]riv|d[ée]viation|axial|gauche|droit|complet|incomplet|ant[ée]rieur|post[ée]rieur|lat[ée]ral|ind[ée]termin|BBG|BBD|BAV|ESV|WPW|LVH|RVH|STEMI|NSTEMI)",
        False,
    ),
    (
        r"(aucun\s+ECG|pr[ée]c[ée]dent|disponible|repolarisation|conduction|extrasystol|big[ée]min|trig[ée]min|sous[\s-]?d[ée]cal|sus[\s-]?d[ée]cal|allongement|raccourcissement|microvoltage|alternance)",
        False,
    ),
    (r"\bECG\b", False),
    (r"(Page|page)\s+\d", True),
    (r"d[ée]rivation", False),
    (r"^\d+\.\d+\.\d+$", True),
    (r"\d+SL", True),
    (r"IDC:", True),
    (r"^-?\d{1,4}$", True),
    (r"^\d{1,4}\/\d{1,4}$", True),
    (r"^[A-Z]{1,4}\s*\??$", True),
    (r"(Unconfirmed|Confirmed|Diagnosis|Interpr[ée]tation|Rapport|Report)", False),
    (r"°", True),
    (r"(S[ée]quentiel|Sequential|Standard|Simultan[ée]|Simultaneous)", False),
    (r"\b(FPB|FPH|SBS|SSF)\b", True),
    (r"^[A-Z]{2,}[‐‑‒–-]\d", False),
    (r"position\s+standard", False),
]
#: Lines that name speed and gain; {s} stands for the speed, {g} for the gain, {_} for a blank or none.
SPEED_GAIN = {
    "full_with_hz": "{s}{_}mm/s        {g}{_}mm/mV        40Hz",
    "compact": "{s} mm/s   {g} mm/mV",
    "compact_no_space": "{s}mm/s {g}mm/mV",
    "french_abbreviated": "Vit. : {s} mm/s   Gain : {g} mm/mV",
    "french_full": "Vitesse : {s} mm/s   Gain : {g} mm/mV",
    "english_labeled": "Speed: {s} mm/s   Gain: {g} mm/mV",
    "minimal_speed_only": "{s} mm/s",
    "minimal_both": "{s}mm/s {g}mm/mV",
    "german": "Geschw.: {s} mm/s   Verst.: {g} mm/mV",
    "spanish": "Vel.: {s} mm/s   Gan.: {g} mm/mV",
    "italian": "Vel.: {s} mm/s   Guad.: {g} mm/mV",
    "portuguese": "Vel.: {s} mm/s   Ganho: {g} mm/mV",
}
#: Dates by language; {d}, {m} and {y} stand for day, month (two digits each) and year.
DATES = {
    "en": ["{d}/{m}/{y}", "{m}/{d}/{y}", "{y}-{m}-{d}"],
    "fr": ["{d}/{m}/{y}", "{d}.{m}.{y}"],
    "de": ["{d}.{m}.{y}", "{y}-{m}-{d}"],
    "es": ["{d}/{m}/{y}", "{d}-{m}-{y}"],
    "pt": ["{d}/{m}/{y}"],
    "it": ["{d}/{m}/{y}"],
    "tr": ["{d}.{m}.{y}", "{d}/{m}/{y}"],
    "zh": ["{y}年{m}月{d}日", "{y}/{m}/{d}"],
    "ja": ["{y}年{m}月{d}日", "{y}/{m}/{d}"],
    "ko": ["{y}년 {m}월 {d}일", "{y}.{m}.{d}"],
    "ar": ["{d}/{m}/{y}", "{y}/{m}/{d}"],
    "ru": ["{d}.{m}.{y}"],
    "el": ["{d}/{m}/{y}"],
    "hi": ["{d}/{m}/{y}"],
}
SPEED_GAIN_OTHER = "{s}mm/s   {g}mm/mV"
# --- end of fixed values -----------------------------------------------------------------------

#: What counts as white space at the edges and in patterns: Unicode's, with no-break space.
SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same, as characters.
_TRIMMED = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
#: Letters outside ASCII whose small form is an ASCII letter: ignoring case, they are not it.
_LIKE_ASCII = "\u212a\u0130"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_TRIMMED))


def java_pattern(pattern: str) -> str:
    """The pattern for Spark: ASCII word boundaries (before words at its start, after them
    elsewhere), Unicode spaces."""
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{_WORD}){pattern[2:]}"
    return pattern.replace(r"\b", f"(?!{_WORD})").replace(r"[\s-]", f"[{SPACES}-]").replace(r"\s", f"[{SPACES}]")


def one_of(patterns: list[str]) -> str:
    """A pattern that finds what any of the patterns does. Plain choices in parentheses are taken
    apart and grouped by their first letter, so that few are tried at each character."""
    rest, by_letter = [], {}
    for pattern in patterns:
        inner = pattern[1:-1]
        if pattern[0] + pattern[-1] == "()" and "(" not in inner and ")" not in inner:
            for choice in inner.split("|"):
                if choice[0].isalpha() and choice[1:2] not in ("?", "*", "+", "{"):
                    by_letter.setdefault(choice[0], []).append(choice[1:])
                else:
                    rest.append(choice)
        else:
            rest.append(pattern)
    grouped = [f"{letter}(?:{'|'.join(map(java_pattern, ends))})" for letter, ends in by_letter.items()]
    return "|".join(grouped + [f"(?:{java_pattern(p)})" for p in rest])


def is_lead_label(text: Column) -> Column:
    return trimmed(text).isin(LEAD_LABELS)


def is_kept_text(text: Column) -> Column:
    """Whether any whitelist pattern finds the trimmed text; empty texts and lead labels stay.
    The list is leaky by design of its short patterns: four capitals or digits pass."""
    t = trimmed(text)
    small = F.lower(F.translate(t, _LIKE_ASCII, "\ufffd" * len(_LIKE_ASCII)))
    whole = one_of([p for p, case in KEPT_PATTERNS if case])
    folded = one_of([p.lower() for p, case in KEPT_PATTERNS if not case])  # none has an escape in capitals
    return (t == "") | t.isin(LEAD_LABELS) | small.rlike(folded) | t.rlike(whole)


def kept(text: Column, mode: str) -> Column:
    """mode `full` keeps lead labels and empty texts only, `smart` the whitelist."""
    t = trimmed(text)
    return ((t == "") | t.isin(LEAD_LABELS)) if mode == "full" else is_kept_text(text)


def latin1(text: Column) -> Column:
    """Typographic marks to plain ones; what is left outside Latin-1 goes."""
    out = F.regexp_replace(text, "[‐-―]", "-")
    out = F.regexp_replace(out, "[‘’‚‛]", "'")
    out = F.regexp_replace(out, "[“”„]", '"')
    out = F.regexp_replace(F.regexp_replace(out, "…", "..."), r"\x{00A0}", " ")
    return F.regexp_replace(out, r"[^\x00-\xFF]", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")


def stem(name: Column) -> Column:
    """A file name without .pdf, in either case."""
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def without_rhythm(name: Column) -> Column:
    return F.regexp_replace(name, "_rhythm$", "")


def is_rhythm(name: Column) -> Column:
    return name.rlike("(?i)_rhythm$")


def base_lead(name: Column) -> Column:
    """A channel's lead without the suffix of a segment or an extra line."""
    return F.regexp_replace(name, r"(_seg\d+|_extra)$", "")


def normal_lead(text: Column, extra: dict[str, str] | None = None) -> Column:
    """The standard name of a label: aliases, of which a vendor's own come first; null for any
    other text."""
    names = {n: n for n in LEADS} | ALIASES | (extra or {})
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return pairs[trimmed(text)]


def mdc_code(name: Column) -> Column:
    return F.concat(F.lit("MDC_ECG_LEAD_"), F.upper(without_rhythm(name)))


def hl7_time(at: Column) -> Column:
    """Fourteen digits, from the year to the second, in the session's time zone."""
    return F.date_format(at, "yyyyMMddHHmmss")


def export_base(maker: Column, at: Column) -> Column:
    """ecg_, the maker (`unknown` where it is null or empty) as a safe name, and the time."""
    known = F.when((maker == "") | maker.isNull(), "unknown").otherwise(maker)
    return F.concat(F.lit("ecg_"), safe_name(known), F.lit("_"), F.date_format(at, "yyyy_MM_dd_HH_mm_ss"))


def speed_gain(speed: Column, gain: Column, form: Column, blank: Column) -> Column:
    """The line of the form's template; a whole speed has no decimals, the gain never."""
    number = F.when(speed == F.floor(speed), F.floor(speed).cast("string")).otherwise(speed.cast("string"))
    templates = F.create_map(*(F.lit(x) for pair in SPEED_GAIN.items() for x in pair))
    line = F.coalesce(templates[form], F.lit(SPEED_GAIN_OTHER))
    for mark, value in (("{s}", number), ("{g}", gain.cast("int").cast("string")), ("{_}", blank)):
        line = F.replace(line, F.lit(mark), value)
    return line


def local_date(at: Column, language: Column, pick: Column) -> Column:
    """A date in one of its language's forms (English where the language has none); `pick`, any
    whole number, chooses among them."""
    forms = F.create_map(*(x for lang, known in DATES.items() for x in (F.lit(lang), F.array(*map(F.lit, known)))))
    known = F.coalesce(forms[language], F.array(*map(F.lit, DATES["en"])))
    out = F.element_at(known, (F.pmod(pick, F.size(known)) + 1).cast("int"))
    for mark, form in (("{d}", "dd"), ("{m}", "MM"), ("{y}", "yyyy")):
        out = F.replace(out, F.lit(mark), F.date_format(at, form))
    return out
