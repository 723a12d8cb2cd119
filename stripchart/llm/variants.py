"""Spelling variants by merging the subtrees of a trie, as an errata tree does.

The words form a trie. At each node the child with the most words is heavy, the others and the
end of a word there are light. Two words one edit apart part at one node, where at most one of
them is in the heavy child. So at each node its light subtrees are merged into what lies beside
them, with one character changed: a light word is put where it would stand with its character
replaced by the heavy one, skipped, or pushed down below the heavy one, and light words meet each
other with that character as a wildcard. Terminals that coincide are the pairs, each found once.
A word is light at few nodes (no more than the binary logarithm of the words, and its end), so the
merges move little: the smaller subtrees always move into the larger.

Nodes are keyed by a hash of their prefix. Were two nodes to share one, they would share a heavy
character too, which any choice of it allows: pairs come from whole words alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_partitions, stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a character.
ONE_IN = 199
CODE_POINTS, OCCURRENCES = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Distinct words a task counts at once.
HELD = 500_000
#: Branching nodes (16 bytes each) up to which they are sent to all tasks; beyond, both sides are shuffled.
SENT = 1_000_000
_MASK = (1 << 64) - 1


def spelled(key: int | None, text: str, one_in: int = ONE_IN) -> Counter[str]:
    """How often each run of letters occurs in a text, lower-cased in A-Z only; a run that the
    hash of the id and the run picks has lost one character. A null id is written as nothing."""
    prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
    found: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        if len(run) >= CODE_POINTS:
            h = zlib.crc32(run.encode(), prefix)
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < CODE_POINTS:
                    continue
            found[run] += n
    return found


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n over all whole texts; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.update(spelled(own, value.as_py() or ""))
                if len(total) >= HELD:
                    yield flushed()
        yield flushed()

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return over_partitions(source, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _edges(words: DataFrame) -> DataFrame:
    """word, n, at, node, next: the trie nodes on each word's path and the code point that
    follows, 0 at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, node, follows = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                h = 0x9E3779B97F4A7C15
                for p, c in enumerate(map(ord, word)):
                    row.append(i)
                    at.append(p)
                    node.append(h)
                    follows.append(c)
                    h = ((h ^ c) * 0xD6E8FEB86659FD93 + 0x2545F491) & _MASK
                    h ^= h >> 32
                row.append(i)
                at.append(len(word))
                node.append(h)
                follows.append(0)
            made = [batch.column(j).take(pa.array(row, pa.int32())) for j in (0, 1)]
            keys = pa.array(node, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([*made, pa.array(at, pa.int32()), keys, pa.array(follows, pa.int32())], names=["word", "n", "at", "node", "next"])

    return over_partitions(words.select("word", "n"), run, "word string, n long, at int, node long, next int")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: all pairs of distinct words (word, n) that one inserted, deleted or
    replaced code point turns into each other, each pair once, in either order."""
    edges = _edges(words)
    children = edges.groupBy("node", "next").agg(F.count(F.lit(1)).alias("n"))
    branching = children.groupBy("node").agg(F.count(F.lit(1)).alias("children"), F.max(F.when(F.col("next") > 0, F.struct("n", (-F.col("next")).alias("next")))).alias("most"))
    heavy = stored(branching.where("children > 1").select("node", (-F.col("most.next")).alias("heavy")), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= SENT else heavy
    light = stored(
        edges.join(heavy, "node")
        .where("next <> heavy")
        .selectExpr("word", "n", "substring(word, 1, at) as x", "substring(word, at + 1, 1) as c", "substring(word, at + 2) as s", "char(heavy) as h"),
        "light",
    )
    # replaced by the heavy character, pushed down below it, skipped (only where the next one differs, else they part below)
    moved = """filter(if(c = '', array(concat(x, h)), array(concat(x, h, s), concat(x, h, c, s), if(startswith(s, c), null, concat(x, s)))), p -> p is not null)"""
    probes = light.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.expr(moved)).alias("b"))
    merged = probes.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")
    # a group has one word at most for each character of the alphabet
    met = light.where("c <> ''").groupBy("x", "s").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("g")).where("size(g) > 1")
    beside = met.select(F.explode(F.expr("flatten(transform(g, (u, i) -> transform(slice(g, i + 2, size(g)), v -> struct(u, v))))")).alias("p")).select(
        F.col("p.u.word").alias("a"), F.col("p.u.n").alias("a_n"), F.col("p.v.word").alias("b"), F.col("p.v.n").alias("b_n")
    )
    return merged.unionByName(beside)


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (distinct, with n). Ties go to the
    smallest near word in code-point order; no words give no rows."""
    words = stored(words, "words")
    pairs = stored(one_edit_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    far = -F.col("best.n") >= times * F.col("n")
    named = stored(
        words.join(best, "word", "left").select(
            "word", F.when(far, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.n")).alias("form_n")
        ),
        "forms",
    )
    ways = named.where("form is not null").select("word", F.col("form").alias("root"))
    # n grows `times` fold with each form, and each round doubles the steps taken
    most = words.agg(F.max("n")).first()[0] or 0
    steps = 1
    while times**steps <= most:
        ways = stored(ways, "ways")
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps *= 2
    return named.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of documents. Null and empty texts have
    no words; a null doc_id is written as nothing before the colon; long texts are read whole;
    repeated rows count each; ties go to the smallest word; no rows give no rows; other columns
    are not looked at."""
    return grouped(words_of(table(spark, sf_dir, "documents")))


#: Checksums byte by byte from the table of their polynomial, pairs by what is left of two words without one character.
OP13_SQL = """
with recursive crc as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))),
runs as (select doc_id, r, count(*) n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) r from documents)
  where length(r) >= 6 group by doc_id, r),
hexed as (select r, n, hex(encode(doc_id || ':' || r)) x from runs),
hashed as (select r, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) h from hexed, crc),
spelled as (select case when h % 199 = 0 then left(r, h % length(r)) || substr(r, h % length(r) + 2) else r end word, n from hashed),
words as (select word, sum(n)::bigint n from spelled where length(word) >= 6 group by word having sum(n) >= 5),
less as (select word, n, i, left(word, i) || substr(word, i + 2) d from (select word, n, unnest(range(length(word))) i from words)),
pairs as (select a.word, b.word near, b.n near_n from less a join less b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select less.word, words.word, words.n from less join words on d = words.word
  union select words.word, less.word, less.n from less join words on d = words.word),
best as (select word, count(*) n_near, max(near_n) most, arg_min(near, (-near_n, near)) near from pairs group by word),
named as (select word, case when most >= 5 * n then near end form, n, coalesce(n_near, 0)::bigint n_near, case when most >= 5 * n then most end form_n
  from words left join best using (word)),
ways as (select word, word root from named union all select ways.word, form from ways join named on named.word = root where form is not null),
ends as (select ways.word, root from ways join named on named.word = root where form is null)
select word, form, root, n, n_near, form_n from named join ends using (word)
"""
