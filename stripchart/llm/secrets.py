"""Secret scans with corpus-wide ownership: candidate values are hashed and counted by distinct
repositories and owners; values that many share are examples, random-looking values that belong
to few are credentials that may be live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_batches, stored, table

#: The kinds in their order, base kinds first.
KINDS = ("assign", "access", "hex", "live", "example")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_FROM, ACCESS_FROM = 8, 16
#: What every match of a base kind contains, as a condition Spark evaluates.
HINT = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}"

#: A value found with so many owners, or in so many repositories, is an example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 3
#: Bits of entropy per character from which a value looks random.
RANDOM_BITS = 2.5
REDACTED = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base matches, in code points, by start
    and then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_FROM:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_FROM]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def looks_random(value: str) -> bool:
    """The entropy of a generated string."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= RANDOM_BITS


def credible(kind: int, value: str) -> bool:
    """Whether a match of the kind can be a credential: an access key is one by its form, an
    assigned value if it looks random, a hex run if it has letters and digits too."""
    return KINDS[kind] == "access" or looks_random(value) and (KINDS[kind] == "assign" or any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


SPAN = "array<struct<start:int,kind:int,end:int,vstart:int,vend:int,hash:string,random:boolean>>"


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `spans`, the base matches of each whole text with the hash of their value. The
    values themselves do not leave the task. A null text is an empty one."""
    source = docs.select(*keys, text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("vstart", pa.int32()), ("vend", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(len(keys)).to_pylist():
            rows.append([(s, k, e, a, b, hashlib.sha256((v := t[a:b]).encode("utf-8", "surrogatepass")).hexdigest(), credible(k, v)) for s, k, e, a, b in base_spans(t or "")])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([[dict(zip(("start", "kind", "end", "vstart", "vend", "hash", "random"), x)) for x in r] for r in rows], span)], names=[*keys, "spans"])

    return over_batches(source, run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys) + f", spans {SPAN}")


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """hash, repositories, owners, verdict for each distinct candidate value, over the whole
    corpus. Triples are made distinct first, so a value in a third of all rows is a few rows per
    task; a null repository or owner is one of its own name."""
    triples = found.select(repository.alias("r"), owner.alias("o"), F.explode("spans").alias("s")).select(
        F.col("s.hash").alias("hash"), F.col("s.random").alias("random"), F.coalesce("r", F.lit("")).alias("r"), F.coalesce("o", F.lit("")).alias("o")
    )
    counted = triples.distinct().groupBy("hash").agg(F.max("random").alias("random"), F.countDistinct("r").alias("repositories"), F.countDistinct("o").alias("owners"))
    shared = (F.col("owners") >= SHARED_OWNERS) | (F.col("repositories") >= SHARED_REPOSITORIES)
    return counted.select("hash", "repositories", "owners", F.when(shared, "example").when(F.col("random"), "live").alias("verdict"))


def owner_of(repository: Column) -> Column:
    """What stands before the first slash of a repository's name; the name where there is none."""
    return F.split_part(repository, F.lit("/"), F.lit(1))


def judged(found: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys (which must be distinct) and `added`: a live or example span over each value that
    has such a verdict."""
    each = found.select(*keys, F.explode("spans").alias("s"))
    hit = each.withColumn("hash", F.col("s.hash")).join(verdicts.where("verdict is not null").select("hash", "verdict"), "hash")
    kind = F.when(F.col("verdict") == "live", KINDS.index("live")).otherwise(KINDS.index("example"))
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("s.vstart").alias("start"), kind.cast("int").alias("kind"), F.col("s.vend").alias("end")))).alias("added"))


def listed(spans: str) -> Column:
    """kind:start:end of spans ordered by start and kind, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")


def scan(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document.

    The repository is `source`, its owner what stands before a slash there. Rows are told apart
    by a number given when the matches are stored, so repeated and null ids stay rows of their
    own. Documents without a match are not shuffled.
    """
    numbered = candidates(docs.select("doc_id", F.col(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"])
    found = stored(numbered.withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.where("size(spans) > 0")
    verdicts = stored(ownership(some, F.col("source"), owner_of(F.col("source"))), "ownership")
    added = judged(some, verdicts, ["row"])
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    joined = some.join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    every = joined.unionByName(found.where("size(spans) = 0").withColumn("added", none))
    plain = every.withColumn("base", F.expr("transform(spans, s -> struct(s.start as start, s.kind as kind, s.end as end))"))
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = {KINDS.index(kind)})) as bigint)")
    return plain.withColumn("whole", F.expr("array_sort(concat(base, added))")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("whole").alias("spans")
    )


def redacted(docs: DataFrame, text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """docs, all its columns and rows, with live-looking values in `text` replaced by a mark and
    the column `length`, if there is one, brought up to date in those rows.
    Shared examples stay. Only documents that contain what a base match needs are shuffled; they
    are matched by a digest of their text, so copies share one entry."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    doc_text = F.col(f"doc.`{text}`")
    hint = doc_text.rlike(HINT)
    some = whole.where(hint).withColumn("key", F.sha2(doc_text, 256))
    found = stored(candidates(some.select("key", F.col(f"doc.`{source}`").alias("source"), doc_text.alias("text")), ["key", "source"]).where("size(spans) > 0"), "candidates")
    verdicts = stored(ownership(found, F.col("source"), owner_of(F.col("source"))), "ownership")
    distinct = found.groupBy("key").agg(F.first("spans").alias("spans"))
    marks = judged(distinct, verdicts, ["key"]).select("key", F.expr(f"filter(added, s -> s.kind = {KINDS.index('live')})").alias("marks")).where("size(marks) > 0")
    merged = F.expr(
        """aggregate(marks, cast(array() as array<struct<start:int,kind:int,end:int>>), (a, s) ->
           if(size(a) > 0 and s.start < element_at(a, -1).end,
              concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, s.kind as kind, greatest(element_at(a, -1).end, s.end) as end))),
              concat(a, array(s))))"""
    )
    # from the last mark to the first, so that positions before it stay right
    cut = F.expr(f"aggregate(reverse(marks), clean, (t, s) -> concat(substring(t, 1, s.start), '{REDACTED}', substring(t, s.end + 1)))")
    marked = some.join(marks, "key", "left").select("doc", doc_text.alias("clean"), merged.alias("marks"))
    marked = marked.select("doc", F.col("marks").isNull().alias("same"), F.when(F.col("marks").isNull(), F.col("clean")).otherwise(cut).alias("clean"))

    def column(name: str) -> Column:
        own = F.col(f"doc.`{name}`")
        if name == text:
            own = F.col("clean")
        elif name == length:
            own = F.when(F.col("same"), own).otherwise(F.char_length("clean")).cast(docs.schema[name].dataType)
        return own.alias(name)

    return whole.where(~hint | hint.isNull()).select("doc.*").unionByName(marked.select(*map(column, names)))


def op6_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base matches, their digest and all spans of every document, with a
    span added over each value that the corpus-wide ownership judges. Null texts are empty ones,
    a null source is a repository of its own name; repeated rows stay and are one repository's;
    no rows give no rows; other columns are not looked at."""
    return scan(table(spark, sf_dir, "documents"))
