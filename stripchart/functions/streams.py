"""Texts in page description streams: found, read, and taken out. A stream is a string of
characters below 256. Strings in parentheses may nest, so Spark's own patterns cannot tell where
they end; small Arrow functions do."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from stripchart.functions import text
from stripchart.session import settled, ship

_STRING = r"(?P<string>\((?:[^()\\]|\\.|(?&string))*+\)?)"
_WHITE = r"\t\n\r "
#: A string in parentheses, or the word that opens or closes a text block, on its own.
_TOKENS = regex.compile(rf"{_STRING}|(?<![^{_WHITE}])(?:(?P<open>BT)(?![^{_WHITE}])|(?P<close>ET)(?![^{_WHITE}])[{_WHITE}]*+)", regex.S)
_SHOWN = regex.compile(r"\(((?:[^()\\]|\\.)*)\)\s*Tj")
_SHOWN_HEX = regex.compile(r"<([0-9a-fA-F]+)>\s*Tj")
_SHOWN_LIST = regex.compile(r"\[([^\]]*)\]\s*TJ", regex.I)
_PLAIN, _HEX = regex.compile(r"\(((?:[^()\\]|\\.)*)\)"), regex.compile(r"<([0-9a-fA-F]+)>")
_ESCAPE = regex.compile(r"\\([0-7]{1,3}|[nrtbf\\()/])")
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def unescaped(raw: str) -> str:
    """A string's escapes, by name or octal number, as what they stand for."""
    return _ESCAPE.sub(lambda m: _NAMED.get(m[1]) or (chr(int(m[1], 8)) if m[1].isdigit() else m[1]), raw)


def blocks(stream: str) -> list[tuple[int, int]]:
    """(start, end) of the text blocks, each with the white space after it; one that does not
    close goes on to the end."""
    found, start = [], None
    for m in _TOKENS.finditer(stream):
        if start is None and m["open"]:
            start = m.start()
        elif start is not None and m["close"]:
            found.append((start, m.end()))
            start = None
    return found + ([(start, len(stream))] if start is not None else [])


def shown(body: str) -> str:
    """The text a block shows: plain strings first, then hexadecimal ones, then those of lists."""
    from_hex = lambda digits: "".join(chr(int(digits[i : i + 2], 16)) for i in range(0, len(digits), 2))
    parts = [unescaped(s) for s in _SHOWN.findall(body)] + [from_hex(s) for s in _SHOWN_HEX.findall(body)]
    for inner in _SHOWN_LIST.findall(body):
        parts += [unescaped(s) for s in _PLAIN.findall(inner)] + [from_hex(s) for s in _HEX.findall(inner)]
    return " ".join(parts).strip()


BLOCKS = ArrayType(StructType([StructField("piece", StringType()), StructField("shown", StringType())]))


@F.pandas_udf(BLOCKS)
def _cut(streams: pd.Series) -> pd.Series:
    def cut(stream: str | None) -> list[dict] | None:
        if stream is None:
            return None
        pieces, at = [], 0
        for start, end in blocks(stream):
            pieces += [{"piece": stream[at:start], "shown": None}, {"piece": stream[start:end], "shown": shown(stream[start + 3 : end])}]
            at = end
        return [*pieces, {"piece": stream[at:], "shown": None}]

    return streams.map(cut)


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: None if s is None else unescaped(s))


def decoded(raw: Column) -> Column:
    """Strings with their escapes resolved."""
    ship(SparkSession.active())
    return _decoded(raw)


def pieces(stream: Column) -> Column:
    """The stream in pieces, in order: text blocks with what they show, and what lies between."""
    ship(SparkSession.active())
    return _cut(stream)


def is_readable(cut: Column) -> Column:
    """Whether a block of a cut stream shows a plain lead label, so that its fonts are plain."""
    return F.exists(cut, lambda p: text.is_lead_label(p["shown"]) & p["shown"].isNotNull())


def stripped(cut: Column, mode: str) -> Column:
    """The stream without the blocks whose text does not stay; mode `all` takes every block."""
    keep = (lambda p: p["shown"].isNull()) if mode == "all" else (lambda p: p["shown"].isNull() | text.kept(p["shown"], mode))
    return F.array_join(F.transform(F.filter(cut, keep), lambda p: p["piece"]), "")


def redacted(cut: Column, mode: str) -> Column:
    """A readable stream without the texts that do not stay; of any other all texts go."""
    return F.when(is_readable(cut), stripped(cut, mode)).otherwise(stripped(cut, "all"))


def drawn_objects(edges: DataFrame, first: DataFrame) -> DataFrame:
    """document, object: all that a first page draws, directly or through others. edges: document,
    object, to_object; first: document, object. Each round goes one step on from what the last
    one found anew, so that circles end; what is found is kept in the shared folder."""
    found = settled(first.select("document", "object").distinct())
    fresh = found
    while not fresh.isEmpty():
        further = fresh.join(edges, ["document", "object"]).select("document", F.col("to_object").alias("object")).distinct()
        fresh = settled(further.join(found, ["document", "object"], "left_anti"))
        found = settled(found.unionByName(fresh))
    return found


def redacted_documents(cut: DataFrame, drawn: DataFrame, mode: str) -> DataFrame:
    """cut (document, object, cut and others) with `readable` and `stream`. Documents are judged
    as a whole: readable is one of which an object in `drawn` (document, object) shows a plain
    lead label; of all others every text goes, in each of their streams. Null streams stay null."""
    plain = cut.join(drawn, ["document", "object"], "left_semi").groupBy("document").agg(F.max(is_readable(F.col("cut"))).alias("readable"))
    judged = cut.join(plain, "document", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    return judged.withColumn("stream", F.when(F.col("readable"), stripped(F.col("cut"), mode)).otherwise(stripped(F.col("cut"), "all")))


def audit(cut: Column) -> Column:
    """All texts that a stream shows."""
    return F.transform(F.filter(cut, lambda p: p["shown"].isNotNull()), lambda p: p["shown"])


# --- fixed values: entries of a document that name persons or programs -----------------------------
BLANKED = ["Title", "Author", "Subject", "Keywords", "Producer", "Creator"]
REMOVED = ["CreationDate", "ModDate"]
REMOVED_FROM_CATALOG, REMOVED_FROM_PAGE = ["Metadata"], ["Annots"]
# --- end of fixed values -----------------------------------------------------------------------


def without_metadata(info: Column) -> Column:
    """A document's entries (a map): some blank, whether they were there or not, dates gone."""
    kept = F.map_filter(F.coalesce(info, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*BLANKED, *REMOVED))
    return F.map_concat(kept, F.create_map(*(x for k in BLANKED for x in (F.lit(k), F.lit("")))))


def without_entries(entries: Column, names: list[str]) -> Column:
    """A dictionary (a map) without some entries; null stays null."""
    return F.map_filter(entries, lambda k, v: ~k.isin(*names))


def without_images(stream: Column, images: Column) -> Column:
    """The stream without the draws of the named images (an array of names with their slash): the
    name, white space, and Do as a word."""
    def taken_out(left: Column, name: Column) -> Column:
        literal = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")
        return F.regexp_replace(left, F.concat(literal, F.lit(r"[ \t\n\x0B\f\r]+Do(?![A-Za-z0-9_])")), F.lit(""))

    return F.aggregate(images, stream, taken_out)
