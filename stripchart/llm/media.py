"""Media in binary columns: 8-bit greyscale PNG written and read through its zlib chunks, with
checksum tests and numpy unfiltering, and a perceptual hash of the low cosine frequencies."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_batches, stored, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of the images that hold plain bytes; payloads are padded to whole rows.
WIDTH = 576
PAD = b"\xff"
#: Side of the square an image is averaged to, and of the block of frequencies that is kept.
HASH_SIDE, HASH_KEEP = 32, 8


class BadImage(ValueError):
    """The bytes are not a PNG this module reads, or a checksum in them fails."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(samples: np.ndarray, level: int = 1) -> bytes:
    """Greyscale PNG of a (height, width) uint8 array. Each row takes the filter (none, sub or
    up) whose residues have the smallest sum of absolute values."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    kinds = np.stack([samples, sub, up])
    best = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = kinds[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; BadImage where the signature, a length or a CRC is wrong."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    found, at = [], 8
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("truncated chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"chunk {kind!r} fails its checksum")
        found.append((kind, body))
        at += 12 + size
    if not found or found[0][0] != b"IHDR" or found[-1][0] != b"IEND":
        raise BadImage("chunks out of order")
    return found


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of one-byte samples; runs of rows with the same filter at once."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown filter")
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], len(rows)]):
        part, kind = out[start:stop], kinds[start]
        above = out[start - 1] if start else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind > 2:
            for row in part:
                _unfilter_sequential(row, above, kind)
                above = row
    return out


def _unfilter_sequential(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Average (3) and Paeth (4): each sample needs the one before it."""
    left = corner = 0
    up = above.tolist()
    for i, x in enumerate(row.tolist()):
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        corner, left = up[i], (x + guess) & 255
        row[i] = left


def png_decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG without interlace; all checksums are tested."""
    chunks = png_chunks(data)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if (depth, colour, interlace) != (8, 0, 0):
        raise BadImage("only 8-bit greyscale without interlace is read")
    try:
        raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    except zlib.error as wrong:
        raise BadImage(str(wrong)) from wrong
    if len(raw) != height * (width + 1):
        raise BadImage("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@functools.cache
def _cosines() -> np.ndarray:
    k, x = np.arange(HASH_KEEP)[:, None], np.arange(HASH_SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * HASH_SIDE))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: the image averaged to 32 x 32, its 8 x 8 lowest cosine frequencies, a bit where
    one is above their median (the mean level is left out of the median)."""
    small = samples.astype(np.float64)
    for axis, size in enumerate(samples.shape):
        cuts = np.arange(HASH_SIDE) * size // HASH_SIDE
        spans = np.maximum(np.diff(np.r_[cuts, size]), 1)
        small = np.add.reduceat(small, cuts, axis=axis) / (spans[:, None] if axis == 0 else spans)
    low = (_cosines() @ small @ _cosines().T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def as_samples(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Bytes as rows of samples, padded with 255 to a positive number of whole rows."""
    padded = data + PAD * (-len(data) % width or (0 if data else width))
    return np.frombuffer(padded, np.uint8).reshape(-1, width)


def stored_images(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The keys, n_bytes and media (binary): each text's bytes as a PNG, written to the shared
    folder (or `path`) as Parquet and read back.

    A null text is an empty one: one row of padding. Null or repeated keys are carried as they
    are; no rows give an empty table. Texts are handled one by one, so the longest text bounds a
    task's memory.
    """
    source = docs.select(*keys, text)
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys) + ", n_bytes long, media binary"

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(keys)).to_pylist()]
        media = [png_encode(as_samples(d)) for d in data]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=[*keys, "n_bytes", "media"])

    return stored(over_batches(source, draw, schema), "media", path, codec="none")


def measured(images: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What reading the stored PNGs gives: the keys, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature (binary, the cosine hash). An image whose
    bytes are damaged stops the job."""
    schema = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"

    def measure(media: bytes) -> tuple:
        samples = png_decode(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(measure, batch.column(len(keys) + 1).to_pylist()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keys) + 1], *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=[*keys, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return over_batches(images.select(*keys, "n_bytes", "media"), run, schema)


def op5_png_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a PNG in a binary column that is written and read back, with what
    the read bytes give; the feature in hexadecimal. Null and empty texts are one row of padding,
    equal texts have equal values, repeated rows stay, other columns are not looked at."""
    found = measured(stored_images(table(spark, sf_dir, "documents")))
    return found.withColumn("feature", F.lower(F.hex("feature")))
