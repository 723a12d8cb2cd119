"""Phrases mined by pivot partitioning, as in MG-FSM.

Words that are too rare for any frequent phrase cut the texts. Of the others each phrase has a
rarest, its pivot. For every place of a word the text round it is rewritten to what phrases with
this pivot can use: up to four words before it that are more frequent, and up to four after it
that are not rarer; so each place of a phrase lies in one fragment, that of the first place of its
pivot. Fragments are counted where they are made, then routed by pivot and mined there: a part
counts, and emits, the phrases of its pivots alone. A frequent word's fragments hold more frequent
words only, so they are short and collapse; those of a pivot with very many places are dealt to
several parts by their content, whose counts are added up.

Words are numbered by language and frequency, so that fragments are small numbers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stripchart.llm.common import over_partitions, stored, table
from stripchart.session import ship

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: The most frequent words, this many at most, are sent to all tasks with their numbers. Where
#: more are frequent enough, the rest are numbered by a hash, beyond all others.
VOCABULARY = 1_000_000
HASHED = 1 << 60
#: Distinct words a task counts at once; bytes of text rewritten at once; places of words whose fragments meet in one part, about.
HELD, SLICE, PLACES = 500_000, 4_000_000, 4_000_000

_CUTS = b".,;:!?\n\x0b\x0c\r"
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _CUTS else 32 if c == 9 else c for c in range(256))
_SPACED = bytes(32 if c == 10 else c for c in _FOLDED)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word, n over all whole texts, lower-cased in A-Z; a null lang is `und`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter[bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            while total:
                name, own = total.popitem()
                words = pa.array(own.keys(), pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), words, pa.array(own.values(), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                total.setdefault(name, Counter()).update((value.as_py() or b"").translate(_SPACED).split())
                if sum(map(len, total.values())) >= HELD:
                    yield from flushed()
        yield from flushed()

    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    return over_partitions(source, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed(lang: str, word: bytes) -> int:
    """The number of a frequent word outside the vocabulary."""
    return HASHED | int(hashlib.md5(lang.encode() + b"\0" + word).hexdigest()[:15], 16)


def numbered(words: DataFrame, most: int) -> tuple[DataFrame, dict[str, dict[bytes, int]], bool]:
    """(id, lang, word, n of all words given), {lang: {word: id}} of the `most` most frequent and
    whether there are others."""
    spark = words.sparkSession
    top = words.orderBy(F.desc("n"), "lang", "word").limit(most).toArrow()
    known: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(top["lang"].to_pylist(), top["word"].to_pylist())):
        known.setdefault(lang, {})[word.encode()] = i
    ids = pa.table([pa.array(range(top.num_rows), pa.int64()), top["lang"], top["word"], top["n"]], names=["id", "lang", "word", "n"])
    if top.num_rows:
        listed = stored(spark.createDataFrame(ids).selectExpr("id", "lang", "word", "n"), "vocabulary")
    else:
        listed = spark.createDataFrame([], "id long, lang string, word string, n long")
    more = top.num_rows == most and words.count() > most
    if more:
        digest = F.substring(F.md5(F.concat("lang", F.lit("\0"), "word")), 1, 15)
        rest = words.join(listed.select("lang", "word"), ["lang", "word"], "left_anti").select((F.conv(digest, 16, 10).cast("long") + HASHED).alias("id"), "lang", "word", "n")
        listed = stored(listed.unionByName(rest), "vocabulary")
        if not listed.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("two words have one number")
    return listed, known, more


def counted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct row first stands, the sum of its counts)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]]
    differ = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    if (differ & ~new[1:]).any():  # rows of one hash: by the rows themselves
        order = np.lexsort(rows.T[::-1])
        new = np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)]
    starts = np.flatnonzero(new)
    return order[starts], np.add.reduceat(counts[order], starts)


def fragments(ids: np.ndarray, longest: int) -> np.ndarray:
    """A row for each place of a word with a neighbour that its phrases can use: the words before
    it, the word in the middle column and those after it, numbers plus one, 0 where none is.
    Negative numbers cut the text."""
    reach = longest - 1
    padded = np.concatenate([np.full(reach, -1), ids, np.full(reach, -1)])
    at = reach + np.flatnonzero(ids >= 0)
    own = padded[at]
    columns = {0: own + 1}
    for side in (-1, 1):
        going = np.ones(len(at), bool)
        for d in range(1, longest):
            other = padded[at + side * d]
            going &= (other >= 0) & ((other < own) if side < 0 else (other <= own))
            columns[side * d] = np.where(going, other + 1, 0)
    used = (columns[-1] > 0) | (columns[1] > 0)
    return np.stack([columns[d][used] for d in range(-reach, reach + 1)], axis=1)


def phrases_of(rows: np.ndarray, counts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, counts, pivots) of the distinct phrases of each length and place of the pivot."""
    middle = longest - 1
    for before in range(longest):
        for after in range(max(0, 1 - before), longest - before):
            whole = np.flatnonzero((rows[:, middle - before] > 0) & (rows[:, middle + after] > 0))
            part = rows[whole, middle - before : middle + after + 1]
            first, total = counted(part, counts[whole])
            yield part[first].astype(np.int64) - 1, total, part[first, before].astype(np.int64) - 1


def frequent_phrases(docs: DataFrame, known: dict[str, dict[bytes, int]], more: bool, heavy: dict[int, int], parts: int, least: int, longest: int, text: str, lang: str) -> DataFrame:
    """gram (numbers of words), a: the phrases of 2 to `longest` words that occur `least` times.
    `heavy` has the number of parts of each pivot that is dealt to several."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, heavy))
    width = 2 * longest - 1
    kind = np.dtype("<i8" if more else "<u4")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = shared.value
        tables = {name: own | {b"": -2, b"\n": -1} for name, own in vocabulary.items()}
        none = {b"": -2, b"\n": -1}
        heavy_ids = np.array(sorted(split), np.int64)
        heavy_parts = np.array([split[i] for i in heavy_ids.tolist()], np.int64)

        def made(texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = fragments(np.concatenate(texts), longest)
            first, counts = counted(rows, np.ones(len(rows), np.int64))
            rows = rows[first]
            pivot = rows[:, longest - 1] - 1
            to = pivot.astype(np.uint64)
            if len(heavy_ids):
                at = np.minimum(np.searchsorted(heavy_ids, pivot), len(heavy_ids) - 1)
                dealt = np.where(heavy_ids[at] == pivot, heavy_parts[at], 1).astype(np.uint64)
                content = np.zeros(len(rows), np.uint64)
                for column in rows.T:
                    content = (content ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    content ^= content >> np.uint64(32)
                to = to * np.uint64(0x9E3779B1) + content % dealt
            to = to * np.uint64(0x9E3779B97F4A7C15)
            part = ((to ^ (to >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            rows, counts, part = rows[by].astype(kind), counts[by].astype("<u4"), part[by]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            data = []
            for i, j in zip(starts, np.r_[starts[1:], len(part)]):
                # byte by byte, so that the high bytes, mostly zero, stand together
                data.append(np.ascontiguousarray(rows[i:j].view(np.uint8).reshape(j - i, -1).T).tobytes() + np.ascontiguousarray(counts[i:j].view(np.uint8).reshape(j - i, -1).T).tobytes())
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                content = (value.as_py() or b"").translate(_FOLDED)
                words = content.replace(b"\n", b" \n ").split(b" ")
                own = tables.get(name, none)
                if more:
                    numbers = [own[w] if w in own else hashed(name, w) for w in words]
                else:
                    numbers = [own.get(w, -1) for w in words]
                ids = np.array([*numbers, -1], np.int64)
                held.append(ids[ids != -2])
                size += len(content)
                if size >= SLICE:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    def mine(group: pa.Table) -> pa.Table:
        row = width * kind.itemsize + 4
        blocks, sums = [], []
        for data in group["data"].to_pylist():
            planes = np.frombuffer(data, np.uint8)
            n = len(planes) // row
            blocks.append(np.ascontiguousarray(planes[: n * (row - 4)].reshape(-1, n).T).view(kind))
            sums.append(np.ascontiguousarray(planes[n * (row - 4) :].reshape(4, n).T).view("<u4").ravel())
        rows, counts = np.concatenate(blocks), np.concatenate(sums).astype(np.int64)
        del blocks, sums
        first, counts = counted(rows, counts)
        rows = rows[first]
        partial = np.array(sorted(shared.value[1]), np.int64)
        found: list[pa.Table] = []
        for grams, total, pivot in phrases_of(rows, counts, longest):
            keep = (total >= least) | np.isin(pivot, partial)
            grams, total = grams[keep], total[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * grams.shape[1]), pa.array(grams.ravel()))
            found.append(pa.table([lists, pa.array(total)], names=["gram", "a"]))
        return pa.concat_tables(found)

    ship(spark)
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    routed = over_partitions(source, rewrite, "part int, data binary")
    mined = routed.groupBy("part").applyInArrow(mine, "gram array<bigint>, a long")
    return mined.groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, vocabulary: int = VOCABULARY, places: int = PLACES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases that are not part
    of a longer one as frequent, by the least score among their cuts in two.

    A null lang is `und`, null texts are empty, repeated rows count each, long texts are rewritten
    whole. Ties go to the larger a, then to the phrase that comes first byte by byte; among cuts
    to the earliest. No rows, or no frequent phrase, give no rows."""
    spark = docs.sparkSession
    words = stored(word_counts(docs, text, lang), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = stored(words.where(F.col("n") >= least), "frequent")
    listed, known, more = numbered(frequent, vocabulary)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals.agg(F.sum("n")).first()[0] or 0) // places))
    # no more of these than the corpus has parts
    heavy = {r["id"]: -(-r["n"] // places) for r in listed.where(F.col("n") > places).select("id", "n").collect()}
    grams = stored(frequent_phrases(docs, known, more, heavy, parts, least, longest, text, lang), "phrases")
    counts = grams.unionByName(listed.select(F.array("id").alias("gram"), F.col("n").alias("a")))
    cuts = grams.select("gram", "a", F.explode(F.expr("transform(sequence(1, size(gram) - 1), k -> struct(k, slice(gram, 1, k) as head, slice(gram, k + 1, size(gram)) as tail))")).alias("cut")).select("gram", "a", "cut.*")
    sides = cuts.join(counts.select(F.col("gram").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("gram").alias("tail"), F.col("a").alias("r")), "tail")
    of = listed.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    scored = sides.withColumn("first", F.col("gram")[0]).join(of, "first")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    lowest = scored.withColumn("score", score).groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # a longer candidate as frequent as a phrase in it makes every phrase between them as frequent
    within = grams.where("size(gram) > 2").select(F.explode(F.expr("array(slice(gram, 1, size(gram) - 1), slice(gram, 2, size(gram) - 1))")).alias("gram"), "a")
    kept = lowest.join(within, ["gram", "a"], "left_anti").select("lang", "gram", "a", "low.l", "low.r", "n", "low.score")
    leading = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    leading = stored(leading.drop("place"), "leading")
    spelled = leading.select("gram").select("gram", F.posexplode("gram").alias("at", "id")).join(listed.select("id", "word"), "id")
    named = spelled.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = leading.join(named, "gram").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_pivot_partitioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first 2,000 phrases of two to five
    words that occur 100 times or more in documents. A null lang is `und`, null texts are empty,
    long texts are read whole, repeated rows count each, ties are decided by a and the phrase; no
    rows give no rows; other columns are not looked at."""
    return collocations(table(spark, sf_dir, "documents"))


#: All phrases of all pieces, counted, cut and compared as the contract has it.
OP12_SQL = r"""
with pieces as (select coalesce(lang, 'und') lang, doc_id, i, regexp_extract_all(p, '[^\x20\x09]+') w from (
    select lang, doc_id, unnest(ps) p, generate_subscripts(ps, 1) i from (
      select lang, doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents where text is not null))),
words as (select lang, doc_id, i, unnest(w) x1, generate_subscripts(w, 1) place from pieces),
ahead as (select lang, x1, lead(x1, 1) over p x2, lead(x1, 2) over p x3, lead(x1, 3) over p x4, lead(x1, 4) over p x5 from words window p as (partition by doc_id, i order by place)),
grams as (select lang, 1 k, x1 g from ahead union all select lang, 2, x1 || ' ' || x2 from ahead where x2 is not null
  union all select lang, 3, x1 || ' ' || x2 || ' ' || x3 from ahead where x3 is not null
  union all select lang, 4, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 from ahead where x4 is not null
  union all select lang, 5, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 || ' ' || x5 from ahead where x5 is not null),
f as materialized (select lang, k, g, string_split(g, ' ') ws, count(*) a from grams group by lang, k, g having count(*) >= 100 or k = 1),
n as (select lang, sum(a)::bigint n from f where k = 1 group by lang),
cuts as materialized (select f.lang, f.g, f.k, f.ws, f.a, c, array_to_string(f.ws[:c], ' ') head, array_to_string(f.ws[c + 1:], ' ') tail from f, range(1, 5) r(c) where f.k > 1 and c < f.k),
heads as materialized (select cuts.*, f.a l from cuts join f on f.lang = cuts.lang and f.g = head and f.k = c),
sides as materialized (select heads.*, f.a r from heads join f on f.lang = heads.lang and f.g = tail and f.k = heads.k - c),
scored as (select sides.*, n.n, (1000::hugeint * a * n.n // (l::hugeint * r))::bigint score from sides join n using (lang)),
lowest as (select * from scored qualify row_number() over (partition by lang, k, g order by score, c) = 1),
longer as (select lang, k, a, ws from f where k > 2),
within as (select distinct lang, m k, array_to_string(ws[s:s + m - 1], ' ') g, a from longer, range(2, 5) q(m), range(1, 5) r(s) where m < k and s + m - 1 <= k),
kept as (select lowest.* from lowest anti join within using (lang, k, g, a)),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(g)) rank, g phrase, a, l, r, n, score from kept)
select * from ranked where rank <= 2000
"""
