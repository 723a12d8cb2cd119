"""Token-id files: ids are ranked by their frequency in the corpus and written byte-aligned,
1 to 4 bytes each, with the lengths apart in control bytes (2 bits an id, four ids a byte).
Reading takes the lengths of four ids from a table by their control byte.

A file set is a folder of Parquet tables: `ranks` (rank, id) and `blocks`, rows of at most
BLOCK_IDS ids or one document, in ascending document order within each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stripchart.llm.common import new_path, over_batches, over_partitions, stored, table, text_slices
from stripchart.llm.tokens import ids_of, tokenizers_cache

MODEL = "word_bpe_49k.json"
#: Closes each document.
END_ID = 2
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18

#: For each control byte, the bytes that its four ids take.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    if not len(ranks):
        return b"", b""
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks again; ValueError where control and data do not belong together."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    if len(lengths) != n or int(lengths.sum()) != len(data):
        raise ValueError("damaged block")
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def tokenised(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """key, ids (binary): the whole text's ids and the end id, two bytes an id where the
    vocabulary allows it (`wide` says otherwise). A null text is an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = tokenizers_cache(model)
        out = []
        for texts in text_slices(batch.column(1)):
            for data in cache(texts):
                ids = np.append(ids_of(data), np.uint32(end_id))
                out.append(ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\xff" + ids.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    return over_batches(docs.select(key, text), run, f"key {docs.schema[key].dataType.simpleString()}, ids binary").withColumnRenamed("key", key)


def _ids(data: bytes) -> np.ndarray:
    """An odd number of bytes marks ids of four bytes, after one byte to skip."""
    return np.frombuffer(data[1:], "<u4") if len(data) & 1 else np.frombuffer(data, "<u2").astype("<u4")


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """rank, id: all ids that occur, the most frequent first, ties to the smaller id. Counted
    in each task, then summed; as many rows as the vocabulary has ids at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = np.bincount(_ids(data), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    counts = over_partitions(tokens.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"), "id")


def write_files(tokens: DataFrame, path: str, key: str = "doc_id", parts: int | None = None) -> str:
    """Write key, ids in ascending order of key as a file set. Rows with the same key are
    ordered by their ids' checksum, so that any run writes the same; a null key comes first. No
    rows give empty tables."""
    spark = tokens.sparkSession
    frequency_ranks(tokens).write.parquet(f"{path}/ranks")
    table_of_ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy()
    rank_of = np.zeros(int(table_of_ranks.max(initial=0)) + 1, "<u4")
    rank_of[table_of_ranks] = np.arange(len(table_of_ranks), dtype="<u4")
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        rows: list[np.ndarray] = []
        held = number = 0

        def block() -> pa.RecordBatch:
            control, data = pack_ranks(shared.value[np.concatenate(rows)])
            row = {"block": number, "keys": keys, "lengths": [len(r) for r in rows], "control": control, "data": data}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                rows.append(_ids(data))
                held += len(rows[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    keys, rows, held, number = [], [], 0, number + 1
        if keys:
            yield block()

    # the place in the table tells repeated rows apart, so that many of them take several parts
    order = tokens.select(F.col(key).cast("long").alias("key"), "ids", F.crc32("ids").alias("tie"), F.monotonically_increasing_id().alias("place"))
    by = ("key", "tie", "place")
    dealt = order.repartitionByRange(parts, *by) if parts else order.repartitionByRange(*by)
    blocks = over_partitions(dealt.sortWithinPartitions("key", "tie").select("key", "ids"), run, "block long, keys array<long>, lengths array<long>, control binary, data binary")
    blocks.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 and, with `with_ids`,
    ids, of each document of a file set. The starts come from the block totals: summed by part,
    of which there are as many as files, then within each part."""
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = sizes.join(F.broadcast(before_part), "part").select("part", "block", (F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("start"))
    id_of = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast(id_of)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        column = batch.to_pydict()
        for part, number, keys, lengths, control, data in zip(*(column[c] for c in ("part", "block", "keys", "lengths", "control", "data"))):
            ids = shared.value[unpack_ranks(control, data, sum(lengths))]
            ends = np.cumsum(lengths)
            for k, n, end in zip(keys, lengths, ends.tolist()):
                own = ids[end - n : end]
                rows.append((part, number, k, end - n, n, zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["part", "block", "key", "inside", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    schema = "part int, block long, key long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = over_batches(blocks.select("part", "block", "keys", "lengths", "control", "data"), run, schema)
    return found.join(starts, ["part", "block"]).select("key", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op9_ranked_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files its ids were
    written to. A null or empty text has the end id alone; documents without an id come first,
    rows that repeat one stand side by side, ordered by a checksum; no rows give empty files and
    no rows; other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    tokens = stored(tokenised(docs), "ids")
    path = write_files(tokens, new_path(spark, "id-files"))
    return read_files(spark, path, with_ids=False).withColumnRenamed("key", "doc_id")
