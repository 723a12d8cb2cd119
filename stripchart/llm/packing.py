"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A bin's gap is the room left in it. Each piece goes where the sum, over all gaps, of the squared
number of open bins with that gap becomes smallest, of the bins with room for it; a new bin is
opened where none has room (opening one whenever that gives the smaller sum took 3 % more
sequences here). Pieces are packed within partitions, longest first; what ends in bins that are
left too empty is packed again with that of other partitions, in a few rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_batches, over_partitions, stored, table, text_slices
from stripchart.llm.tokens import ids_of, tokenizers_cache

MODEL = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
#: Pieces packed together in a task, about.
PIECES = 100_000
#: A bin with a larger gap is packed again, in so many rounds at most.
LOOSE, ROUNDS = 64, 3


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given, and the gap of each bin. A new bin is
    opened only where no open one has room; of equally good bins the fullest is taken."""
    n = len(lengths)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins are not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(n, np.int64), np.empty(n, np.int64), []
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # the change of the sum when a bin with gap g gets the gap g - size: of the two
        # counts one falls and one rises; a bin that becomes full is no longer counted
        rise = 2 * (count[: capacity - size] - count[size:capacity]) + 2
        if size < capacity:
            rise[0] -= 1
            rise[count[size:capacity] == 0] = never
        left = int(rise.argmin()) if len(rise) else 0
        if len(rise) and rise[left] != never:
            where = stacks[left + size].pop()
            count[left + size] -= 1
        else:
            left, where = capacity - size, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = where, capacity - left - size
        gaps[where] = left
        if left:
            stacks[left].append(where)
            count[left] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pieces_of(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids): the whole text's ids and the end id, cut
    only where they are more than `capacity`: all pieces but the first are full. A null text is
    an empty one, of the end id alone. Repeated and null keys are carried as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = tokenizers_cache(model)
        at, rows = [], []
        i = 0
        for texts in text_slices(batch.column(1)):
            for data in cache(texts):
                ids = np.append(ids_of(data), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    rows.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] if keep_ids else [])))
                i += 1
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["key", "piece", "start", "length", "ids_crc32", "ids"][: 1 + len(columns)])

    schema = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return over_batches(docs.select(key, text), run, schema).withColumnRenamed("key", key)


def _pack_round(pieces: DataFrame, parts: int, round_no: int, capacity: int, final: bool) -> DataFrame:
    """pieces dealt evenly to `parts` tasks and packed; sequence_id is null for what is left to
    the next round. Pieces are stored, so their places in the table, which spread equal ones, are
    the same in every attempt."""
    names = pieces.columns
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("piece", "start", "ids_crc32"))])
        bins, offsets, gaps = sum_of_squares(rows["length"].to_numpy(), capacity)
        loose = (gaps > LOOSE)[bins] & (not final)
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        rows = rows.append_column("sequence_id", pa.array(bins + base, mask=loose)).append_column("offset", pa.array(offsets, mask=loose))
        yield from rows.combine_chunks().to_batches(max_chunksize=50_000)

    dealt = pieces.repartition(parts, F.xxhash64(*(c for c in names if c != "ids"), F.monotonically_increasing_id()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return over_partitions(dealt, run, f"{kinds}, sequence_id long, offset long")


def packed(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES) -> DataFrame:
    """Each piece with its sequence_id and offset. Full pieces are sequences of their own and
    are not shuffled. Rounds are written to the shared folder. Equal pieces are packed each; no
    pieces give no rows."""
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() - F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    done: list[DataFrame] = [full]
    left, round_no = rest.count(), 1
    while left:
        parts = max(1, -(-left // per_task))
        final = parts == 1 or round_no == ROUNDS
        tried = stored(_pack_round(rest, parts, round_no, capacity, final), f"packed-{round_no}")
        done.append(tried.where("sequence_id is not null"))
        if final:
            break
        rest = tried.where("sequence_id is null").drop("sequence_id", "offset")
        left, round_no = rest.count(), round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there. A null or empty text is
    one piece of the end id alone; repeated rows and null ids are pieces of their own; no rows
    give no rows; other columns are not looked at."""
    pieces = stored(pieces_of(table(spark, sf_dir, "documents")), "pieces")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
