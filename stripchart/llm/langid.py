"""Language identification by mixture inference: a document's letter trigrams come from a
mixture of languages; expectation-maximisation estimates the proportions, and the set of
languages is chosen by penalised likelihood.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_batches, over_partitions, table

#: Trigrams are counted in so many hash buckets.
BUCKETS = 1 << 16
#: About so many labelled documents of a language are learned from; the sample is by a hash of
#: the id, so it is the same in every run.
LEARNED = 2000
#: Every label is learned. The table takes 0.5 MB for each, in the driver and in each worker; with
#: more labels than this (256 MB) learning fails rather than leave any out.
LANGUAGES = 512
#: Labels a task holds counts of at once.
HELD = 64
SMOOTHING = 0.5
ROUNDS, TOLERANCE = 12, 1e-3
#: Trigrams overlap and words repeat: a further language must gain so many times the log of the
#: number of trigrams.
PENALTY = 4.0
#: Characters of a text whose trigrams are counted at once.
BLOCK = 1 << 20
UNKNOWN = "und"
MADE = ("lang_pred", "score", "languages")


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the trigrams of the lower-cased text in which every run of
    characters other than letters is one boundary; none where the text has no letter."""
    total: np.ndarray | None = None
    tail = np.zeros(1, np.uint32)  # a boundary stands before the first letter
    for at in range(0, len(text) or 1, BLOCK):
        block = text[at : at + BLOCK]
        points = np.frombuffer(block.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(_letters()[points], points, 0)
        if at + BLOCK >= len(text):
            points = np.append(points, 0)
        points = np.concatenate([tail, points])
        kept = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]
        if len(kept) > 2:
            x = kept.astype(np.uint64)
            mixed = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1]) * np.uint64(0x85EBCA6B) + x[2:]
            buckets = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
            if total is None and at + BLOCK >= len(text):
                return np.unique(buckets, return_counts=True)
            total = (0 if total is None else total) + np.bincount(buckets, minlength=BUCKETS)
        tail = kept[-2:].astype(np.uint32)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero(total)
    return used, total[used]


def mixture(likelihood: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) by expectation-maximisation: likelihood[i, k] of bucket i
    in language k, counts of the buckets."""
    n, k = counts.sum(), likelihood.shape[1]
    share = np.full(k, 1 / k) if start is None else start
    before = -np.inf
    for _ in range(ROUNDS):
        joint = likelihood * share
        total = joint.sum(axis=1)
        value = float(counts @ np.log(total))
        share = (counts / total) @ joint / n
        if value - before < TOLERANCE * abs(value) / n:
            break
        before = value
    return share, value


def infer(log_likelihood: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of a document, the largest proportion first. Languages are added
    in the order of their proportions among all of them, while the likelihood gains more than
    the penalty."""
    single = counts @ log_likelihood
    best = int(single.argmax())
    chosen, share, value = [best], np.ones(1), float(single[best])
    if log_likelihood.shape[1] > 1:
        shifted = np.exp(log_likelihood - log_likelihood.max(axis=1, keepdims=True))
        base = float(counts @ log_likelihood.max(axis=1))
        order = np.argsort(-mixture(shifted, counts)[0], kind="stable")
        penalty = PENALTY * np.log(counts.sum() + 1.0)
        for k in order:
            if k == best:
                continue
            new = [*chosen, int(k)]
            new_share, new_value = mixture(shifted[:, new], counts)
            if new_value + base - value <= penalty:
                break
            chosen, share, value = new, new_share, new_value + base
    rank = np.argsort(-share, kind="stable")
    return [chosen[i] for i in rank], share[rank]


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in alphabetical order, log likelihoods of shape buckets x languages) from the
    rows of labelled whose lang is not null. Counting is done in the tasks; the driver gets as
    many numbers as there are buckets and languages at most. ValueError for more than LANGUAGES."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: the table of their trigrams would exceed its memory bound")
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    rate = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, LEARNED / r["count"]))))
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(part < F.coalesce(rate[F.col("lang")], F.lit(0.0))).select("lang", "text")

    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            while totals:
                name, total = totals.popitem()
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), place[name], np.int32)), pa.array(used), pa.array(total[used])], names=["lang", "bucket", "n"])

        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in totals and len(totals) >= HELD:
                    yield from flushed()
                buckets, counts = trigram_counts(value or "")
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))[buckets] += counts
        yield from flushed()

    table_of = np.full((BUCKETS, len(names)), SMOOTHING)
    counted = over_partitions(sample, count, "lang int, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    np.add.at(table_of, (counted["bucket"].to_numpy(), counted["lang"].to_numpy()), counted["n"].to_numpy().astype(np.float64))
    table_of /= table_of.sum(axis=0)
    return names, np.log(table_of, out=table_of)


def predicted(docs: DataFrame, names: list[str], table_of: np.ndarray, text: str = "text", keep: list[str] | None = None, made: tuple[str, str, str] = MADE) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred, score and languages added, or
    under the names in `made`, where docs has columns of those names.

    lang_pred has the largest share in the document's mixture, score is that share, languages
    lists the chosen ones with theirs. A null text, one without a letter, and any text where
    nothing was learned have `und`, 0 and null. Whole texts are read, in blocks.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(table_of)

    def judge(value: str | None) -> tuple[str, float, str | None]:
        buckets, counts = trigram_counts(value or "")
        if not len(buckets) or not names:
            return UNKNOWN, 0.0, None
        chosen, share = infer(shared.value[buckets], counts.astype(np.float64))
        return names[chosen[0]], float(min(1.0, max(0.0, share[0]))), ",".join(f"{names[k]}:{s:.4f}" for k, s in zip(chosen, share))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(judge, batch.column(batch.num_columns - 1).to_pylist()))
        made = [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names_out)

    names_out = [*(f"c{i}" for i in range(len(keep))), *MADE]
    schema = ", ".join(f"{n} {docs.schema[k].dataType.simpleString()}" for n, k in zip(names_out, keep)) + ", lang_pred string, score double, languages string"
    source = docs.select(*(F.col(f"`{k}`").alias(n) for n, k in zip(names_out, keep)), F.col(text).alias("text"))
    found = over_batches(source, run, schema)
    return found.select(*(F.col(n).alias(k) for n, k in zip(names_out, keep)), *(F.col(c).alias(m) for c, m in zip(MADE, made)))


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at).to_pylist()]))

    return over_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def identified(docs: DataFrame, keep: list[str] | None = None, made: tuple[str, str, str] = MADE) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them. No rows give no rows."""
    names, table_of = learn(docs.where(~held_out()))
    return predicted(docs, names, table_of, keep=keep, made=made)


def explained(text: str | None, table_of: np.ndarray) -> bool:
    """Whether the mixture of languages found for a text gains more than the penalty of a language
    over the empty set, in which all trigrams are equally likely. A text without a letter is not
    explained."""
    buckets, counts = trigram_counts(text or "")
    if not len(buckets):
        return False
    likelihood = table_of[buckets]
    chosen, share = infer(likelihood, counts.astype(np.float64))
    mixed = np.logaddexp.reduce(likelihood[:, chosen] + np.log(np.maximum(share, 1e-300)), axis=1)
    return float(counts @ (mixed + np.log(BUCKETS))) > PENALTY * np.log(counts.sum() + 1.0)


def recognised(docs: DataFrame, names: list[str], table_of: np.ndarray) -> DataFrame:
    """The rows of docs, with its columns, whose language is among those learned: texts that their
    mixture explains. Null texts, texts without a letter and texts in scripts or letter sequences
    that no learned language has go; repeated rows stay, long texts are read whole, and no rows
    give no rows. Where nothing was learned all texts with a letter stay."""
    if not names:
        return lettered(docs)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(table_of)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([explained(t, shared.value) for t in batch.column(at).to_pylist()], pa.bool_()))

    return over_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (the mixture) of every document, learned
    from those that are not held out. Null texts, empty ones and those without a letter are
    `und` with score 0; a null doc_id is not held out; long texts are read whole, in blocks;
    equal texts have equal predictions, repeated rows stay; no rows give no rows, and where no
    row has a lang all are `und`. Other columns are not looked at."""
    found = identified(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
