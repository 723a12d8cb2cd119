"""What a file is, by its first bytes; pages of documents; drawing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: (kind, offset from 0, hex of the signature), in the order they are tried ----
SIGNATURES = [
    ("pdf", 0, "25504446"),
    ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8FF"),
    ("gif", 0, "47494638"),
    ("bmp", 0, "424D"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
]
# --- end of fixed values -----------------------------------------------------------------------
HEAD = 4096
#: Vector operators from which a page counts as a drawn record.
DRAWN_FROM = 50


def bytes_at(content: str, offset: int, signature: str) -> Column:
    """Whether the bytes at the offset (from 0) are the signature; false past the end."""
    return F.expr(f"coalesce(substr({content}, {offset + 1}, {len(signature) // 2}) = X'{signature}', false)")


def looks_like_markup(content: str) -> Column:
    """Text that starts as markup, after a byte order mark and white space, but not as a web page."""
    text = F.ltrim(F.regexp_replace(F.expr(f"make_valid_utf8(cast(substr({content}, 1, 1024) as string))"), "^\\x{FEFF}", ""))
    text = F.regexp_replace(text, r"^[\s\x{00A0}]+", "")
    return text.startswith("<?xml") | (text.startswith("<") & ~text.startswith("<!DOCTYPE html"))


def file_kind(content: str) -> Column:
    kind = F.when(F.lit(False), "")
    for name, offset, signature in SIGNATURES:
        kind = kind.when(bytes_at(content, offset, signature), name)
    webp = bytes_at(content, 0, "52494646") & bytes_at(content, 8, "57454250")
    return kind.when(webp, "webp").when(bytes_at(content, 128, "4449434D"), "dicom").when(looks_like_markup(content), "xml").otherwise("unknown")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, id (file stem), length, kind of the files under a path; Spark leaves empty ones out."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select("path", stem.alias("id"), "length", file_kind("content").alias("kind"), F.expr(f"substr(content, 1, {HEAD})").alias("head"))


def vector_operations(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Strokes of a page: moves and lines count one, a path as many as it has parts."""
    n = F.when(F.col("op").isin("moveTo", "lineTo"), 1).when(F.col("op") == "constructPath", F.size(F.coalesce("sub_ops", F.expr("cast(array() as array<string>)")))).otherwise(0)
    return ops.groupBy(*keys).agg(F.sum(n).alias("vector_ops"), (F.sum(n) >= DRAWN_FROM).alias("drawn"))


def pages_of_documents(documents: DataFrame, name: str, pages: str, ops: str) -> DataFrame:
    """One row per page, named base_pN.pdf; a document of one page passes as it is and counts as
    drawn. pages: an array of structs with the page's number of vector operators in `ops`."""
    base = F.regexp_replace(name, r"(?i)\.pdf$", "")
    single = F.size(pages) == 1
    each = documents.select("*", F.posexplode(pages).alias("_i", "page"))
    return each.withColumn("page_name", F.when(single, F.col(name)).otherwise(F.concat(base, F.lit("_p"), F.col("_i") + 1, F.lit(".pdf")))).withColumn("is_drawn", F.when(single, True).otherwise(F.col(f"page.{ops}") >= DRAWN_FROM)).drop("_i")


def within_cap(batch: DataFrame, cap: int = 100) -> DataFrame:
    """The batch, or nothing of it where it has more rows than the cap."""
    n = batch.agg((F.count(F.lit(1)) <= cap).alias("_ok"))
    return batch.join(F.broadcast(n), F.col("_ok")).drop("_ok")


def unfinished(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def inspected(documents: DataFrame, ops: DataFrame, key: str, page: str = "page") -> DataFrame:
    """documents with `kind`: drawn, where the first page (number 1 in ops) has enough vector
    operators, else raster, as also where none could be read."""
    first = vector_operations(ops.where(F.col(page) == 1), [key]).select(key, F.col("drawn").alias("_drawn"))
    return documents.join(first, key, "left").withColumn("kind", F.when(F.col("_drawn"), "drawn").otherwise("raster")).drop("_drawn")
