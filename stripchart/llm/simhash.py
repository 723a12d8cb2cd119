"""SimHash near duplicates by a binary trie self-join.

Fingerprints that differ in few bits are found by walking a trie of fingerprints against itself:
pairs of nodes go down together, the bits in which their paths differ add up, and a pair is
dropped when it has more than the budget. To spread the walk, the 64 bits are cut into one block
more than the budget: any two linked fingerprints agree in a whole block, so the trie is built
once for each block, with that block's bits first, and each of its subtrees below a block is
walked on its own. Subtrees with very many leaves are dealt out as all pairs of their parts.
Each walk returns a spanning star of every connected set that it finds, so that a dense group
gives as many rows as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_batches, over_partitions, stored, table

SEED, WORDS, BITS = 42, 3, 64
BUDGET = 3
#: Fingerprints below one block of the trie, from which a subtree is split into parts.
LEAVES = 8192
#: Fingerprints a task walks at once; node pairs compared leaf by leaf; pairs held at once.
BATCH, DIRECT, HELD = 1 << 15, 32, 1 << 20


def fingerprint(text: str) -> int:
    """64 bits: of the XXH64 (seed 42) of all runs of three words, lower-cased in A-Z only, the
    bits set in over half. Fewer words: their whole sequence; none: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - WORDS + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BATCH):
        hashes = np.array([digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(at, min(n, at + BATCH))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the bits as a signed long) of each whole text; a null text is an empty one.
    The key may be a struct."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    return over_batches(docs.select(key, text), run, f"key {docs.schema[key].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def trie_pairs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose values differ in at most `budget` bits, within each of the given
    stretches. A stretch is a trie node: its values are sorted and agree in their first `depth`
    bits."""
    none = np.zeros(len(starts), np.int8)
    stack = [(starts, stops, starts, stops, none, depth)]
    while stack:
        alo, ahi, blo, bhi, diff, depth = stack.pop()
        size = (ahi - alo) * (bhi - blo)
        small = size <= DIRECT if depth < BITS else np.ones(len(size), bool)
        yield from _leaf_pairs(values, alo[small], ahi[small], blo[small], bhi[small], size[small], budget)
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        # sorted values with a common prefix: those whose next bit is set come last
        ones = np.r_[0, np.cumsum(values >> np.uint64(BITS - 1 - depth) & np.uint64(1), dtype=np.int64)]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        other = alo != blo  # nodes of the trie are equal or apart
        pairs = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1)),
        ]
        new = [np.concatenate(x) for x in zip(*pairs)]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        new = [x[keep] for x in new]
        for at in range(0, len(new[0]), HELD):
            stack.append((*(x[at : at + HELD] for x in new), depth + 1))


def _leaf_pairs(values, alo, ahi, blo, bhi, size, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD)))
        n = size[at:to]
        node = np.repeat(np.arange(at, to), n)
        inner = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
        wide = (bhi - blo)[node]
        i, j = alo[node] + inner // wide, blo[node] + inner % wide
        near = ((i < j) | (alo != blo)[node]) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        at = to


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with the sets of each pair's members united under their smallest label."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(label, up := label[label]):
            label = up


def links(fps: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """a, b: links that connect exactly the fingerprints (column fp, distinct) that a chain of
    differences of at most `budget` bits connects; b is the smaller one in its walk."""
    width = BITS // (budget + 1)
    turned = ", ".join(f"struct({k} as block, {f'shiftleft(fp, {k * width}) | shiftrightunsigned(fp, {BITS - k * width})' if k else 'fp'} as v)" for k in range(budget + 1))
    keyed = fps.select(F.explode(F.expr(f"array({turned})")).alias("x")).select(
        F.expr(f"(cast(x.block as bigint) << {width}) + shiftrightunsigned(x.v, {BITS - width})").alias("node"), F.col("x.v").alias("v")
    )
    large = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaves).select("node", F.ceil(F.col("n") / leaves).cast("int").alias("parts"))
    dealt = (
        keyed.join(large, "node", "left")
        .withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
        .select("node", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "v")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def walked(rows: np.ndarray) -> pa.RecordBatch:
            values = rows[:, 3].view(np.uint64)
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            starts = np.flatnonzero(new)
            stops = np.r_[starts[1:], len(rows)]
            more = stops - starts > 1
            label = np.arange(len(rows))
            for i, j in trie_pairs(values, starts[more], stops[more], width, budget):
                label = joined_labels(label, i, j)
            linked = np.flatnonzero(label != np.arange(len(rows)))
            block = (rows[linked, 0] >> width).astype(np.uint64) * np.uint64(width)
            back = lambda v: (v >> block) | np.where(block > 0, v << (np.uint64(BITS) - np.maximum(block, np.uint64(1))), np.uint64(0))
            a, b = back(values[linked]).view(np.int64), back(values[label[linked]]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rest.append(rows)
            held += len(rows)
            if held >= BATCH:
                rows = np.ascontiguousarray(np.concatenate(rest))
                # the last node may go on in the next batch
                last = int(np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])[-1])
                if last:
                    yield walked(np.ascontiguousarray(rows[:last]))
                rest, held = [rows[last:]], len(rows) - last
        if held:
            yield walked(np.ascontiguousarray(np.concatenate(rest)))

    return over_partitions(dealt.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q", "v"), walk, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """a, root (the smallest of its component) for each end of an edge that is not itself the
    root, by alternating stars: neighbours are tied to the least of them until every component
    is one star. Each round is written to the shared folder; a node with very many neighbours is
    only ever aggregated and joined, never gathered."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").unionByName(edges.groupBy("a").agg(F.count(F.lit(1)).alias("b")).where("b > 1")).isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
    return edges.withColumnRenamed("b", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable over links,
    itself included), a row per document.

    Texts that are null, empty or without words have fingerprint zero and are linked like any
    other. Rows that repeat a key stay rows; a null key is never the smallest, and a component
    of null keys alone has a null id.
    """
    found = stored(fingerprints(docs, key, text).withColumnRenamed(key, "key"), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp"), budget))
    rooted = distinct.join(roots, distinct.fp == roots.a, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    components = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(components, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all its columns, with one row of each group of near duplicates: the one with the
    smallest key; of rows that repeat it any one, and one with a null key only where the group
    has no other. Rows are numbered in a stored copy, so any may repeat."""
    numbered = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    # structs compare field by field: nulls last, then the key, then the number
    named = numbered.select(F.struct(F.col(f"doc.`{key}`").isNull().alias("last"), F.col(f"doc.`{key}`").alias("key"), "row").alias("id"), F.col(f"doc.`{text}`").alias("text"))
    chosen = near_duplicates(named, "id", "text").where("id = component_id").select(F.col("id.row").alias("row"))
    return numbered.join(chosen, "row", "left_semi").select("doc.*")


def op2_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document. Texts that are null, empty or without
    words have fingerprint zero and are linked like any other; long texts are hashed in blocks;
    repeated rows stay; a null doc_id is never the smallest; no rows give no rows; other columns
    are not looked at."""
    return near_duplicates(table(spark, sf_dir, "documents"))
