"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
id. Documents are kept in slices of a bounded size, a row each. Three passes over them meet in
two shuffles, of which no row grows with the number of copies:

1. Every window of `length` bytes has a mark, the least hash of the shorter strings within it, so
   equal windows have equal marks. Each slice deals its distinct marks to parts; a part answers
   with a bit a mark: whether several documents hold it.
2. The stretches of windows with a shared mark are the only text that is dealt on: a slice sends
   each distinct stretch once, with the least id that holds it there. A part joins its stretches
   to one text and builds its Burrows-Wheeler transform. Backward extension, breadth first, sets
   the common prefixes of neighbouring suffixes by increasing value and stops at `length`; what is
   not set then separates nothing, so the suffixes between set places begin with equal windows.
   The part answers with a bit a window: whether a smaller id than the slice's own least holds it.
   It goes through its stretches mark by mark, some at once; what shares one mark and is large is
   cut by the marks of longer strings first, so that what is transformed at once stays small.
3. Within a slice a window goes if that bit is set, or the slice's least id for it is smaller.

Exact copies of whole texts are taken out before and lose everything to the smallest id. A mark
of very many stretches is not dealt as stretches but window by window, by their own hashes, so
that the texts around one very frequent passage do not meet in one part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import over_partitions, stored, table
from stripchart.session import ship

LENGTH = 50
#: Bytes of the strings whose hashes are marks; windows of a stretch at most (a bit each).
MARK, STRETCH = 16, 64
#: Bytes of a slice, but for longer documents; windows whose marks are found at once. One slice
#: gives a part a few bytes for each mark, so for corpora far beyond 10 TB larger slices pay.
SLICE, BLOCK = 2_000_000, 1 << 15
#: Bytes of text whose distinct marks or stretches meet in one part, about; of text transformed at once.
PART, TRANSFORMED = 64_000_000, 500_000
#: Bytes of stretches that a part opens at once, and stretches whose first windows are hashed at once.
OPENED, HASHED = 2_000_000, 1 << 12
#: Stretches, distinct in each slice, that share a mark, from which its windows are dealt one by one.
FREQUENT = 200_000
#: Bytes of answers up to which they are sent to all tasks; beyond, slices are shuffled to them.
SENT = 32_000_000
#: Stands for a null id: larger than all others, and no smaller than itself.
LAST = np.iinfo(np.int64).max

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD6E8FEB86659FD93)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STIR
    return h ^ (h >> np.uint64(29))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, by doubling."""
    powers, out, base, done = {1: data.astype(np.uint64)}, None, {1: np.array([_ODD])}, 0
    step = 1
    while 2 * step <= size:
        h = powers[step]
        powers[2 * step] = h[:-step] * base[step] + h[step:]
        base[2 * step] = base[step] * base[step]
        step *= 2
    for step in sorted(powers, reverse=True):
        if done + step <= size:
            h = powers[step]
            out = h if out is None else out[: len(h) - done] * base[step] + h[done:]
            done += step
    return _stirred(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, most: int = STRETCH, size: int = MARK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark, document, start, windows) of all stretches of at most `most` neighbouring windows
    of a document with one mark, of strings of `size` bytes. `ends` are the ends of the documents
    in data."""
    found = []
    mark_size = min(size, length)
    for at in range(0, len(data) - length + 1, BLOCK):
        block = data[at : at + BLOCK + length - 1]
        mark = _least(_hashes(block, mark_size), length - mark_size + 1)
        place = np.arange(at, at + len(mark))
        document = np.searchsorted(ends, place, side="right")
        whole = place + length <= ends[document]
        new = np.r_[True, (mark[1:] != mark[:-1]) | (document[1:] != document[:-1]) | (whole[1:] != whole[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(mark)])
        keep = whole[starts]
        starts, sizes = starts[keep], sizes[keep]
        if (sizes > most).any():
            starts, sizes = _pieces(starts, sizes, most)
        found.append((mark[starts], document[starts], starts + at, sizes))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pieces(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    n = -(-sizes // most)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n) + inner * most, np.minimum(most, np.repeat(sizes, n) - inner * most)


def _first_marks(text: np.ndarray, starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """The mark of the window at each of the starts."""
    size = min(size, length)
    found = [np.zeros(0, np.uint64)]
    for i in range(0, len(starts), HASHED):
        windows = np.lib.stride_tricks.sliding_window_view(text, length)[starts[i : i + HASHED]]
        found.append(_least(_hashes(windows.ravel(), size), length - size + 1)[::length])
    return np.concatenate(found)


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of starts on, as many as sizes say."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _batches(marks: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of things in the order of their marks: whole marks, of about `most` bytes together."""
    total, at = np.cumsum(sizes), 0
    while at < len(marks):
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most))
        to = int(np.searchsorted(marks, marks[max(to, at + 1) - 1], side="right"))
        yield slice(at, to)
        at = to


def _suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """The rotations of text in the order of their first `length` bytes at least."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | around[i : i + n].astype(np.uint64)
    order = np.argsort(key)
    seen = 8
    group = np.zeros(n, np.int64)  # of each text position: the place of the first that is equal so far
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while seen < length:
        single = new & np.r_[new[1:], True]
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        step = min(seen, length - seen)
        rows = order[tied]
        key = (group[rows].astype(np.uint64) << np.uint64(32)) | group[(rows + step) % n].astype(np.uint64)
        by = np.argsort(key)
        order[tied] = rows[by]
        key = key[by]
        new[tied] = np.r_[True, key[1:] != key[:-1]]
        group[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        seen += step
    return order


def window_classes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of text a number that is equal where the next `length` bytes, round the end,
    are: the intervals between suffixes whose common prefix is shorter.

    The queue holds the suffix intervals of the strings of one size whose right end was not yet
    known to separate; extending each by every byte before it gives those of the next size."""
    n = len(text)
    order = _suffixes(text, length)
    before = text[order - 1]
    first = text[order]
    back = np.empty(n, np.int32)
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    apart = np.zeros(n + 1, bool)
    apart[[0, n]] = True
    stamp = np.zeros(n + 2, np.int32)
    same_first = np.r_[False, first[1:] == first[:-1], False]
    lows, highs = np.array([0]), np.array([n])
    for _ in range(length):
        size = highs - lows
        label = np.repeat(np.arange(1, len(lows) + 1, dtype=np.int32), size)
        to = back[np.repeat(lows - np.cumsum(size) + size, size) + np.arange(len(label))]
        stamp[to + 1] = label
        begins = np.sort(to[(stamp[to] != label) | ~same_first[to]])
        ends = np.sort(to[(stamp[to + 2] != label) | ~same_first[to + 1]]) + 1
        stamp[to + 1] = 0
        new = ~apart[ends]
        lows, highs = begins[new], ends[new]
        apart[highs] = True
        if not len(lows):
            break
    found = np.empty(n, np.int64)
    found[order] = np.cumsum(apart[:n])
    return found


def _slices(docs: DataFrame, size: int) -> DataFrame:
    """slice, ids, sizes, data: the documents (id, text) of a partition joined, a row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        total = 0

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([x], k) for x, k in zip((number, ids, list(map(len, texts)), b"".join(texts)), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "ids", "sizes", "data"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if texts and total + len(text) > size:
                    yield made()
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(key)
                texts.append(text)
                total += len(text)
        if texts:
            yield made()

    return over_partitions(docs, run, "slice long, ids array<long>, sizes array<long>, data binary")


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders of the documents, their ends, the bytes) of a slice."""
    ids = batch.column("ids")[i].values.fill_null(LAST).to_numpy(zero_copy_only=False)
    ends = np.cumsum(batch.column("sizes")[i].values.to_numpy(zero_copy_only=False))
    return ids, ends, np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)


def _marks(mark: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, inverse): the distinct marks as part and 32 bits in one number, in order."""
    part = (mark >> np.uint64(32)) % np.uint64(parts)
    keys, inverse = np.unique((part << np.uint64(32)) | (mark & np.uint64(0xFFFFFFFF)), return_inverse=True)
    return keys, (keys >> np.uint64(32)).astype(np.int64), inverse


def _each_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for i, j in zip(starts, np.r_[starts[1:], len(part)] if len(part) else []):
        yield int(part[i]), slice(int(i), int(j))


def _answers(df: DataFrame, name: str) -> DataFrame:
    """The rows (slice, part, data) of df, a row for each slice; broadcast where all are small."""
    kept = stored(df, name)
    total = kept.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    rows = kept.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias(name))
    return F.broadcast(rows) if total <= SENT else rows


def _joined_data(batch: pa.RecordBatch, name: str, i: int) -> bytes:
    return b"".join(zlib.decompress(x["data"]) for x in batch.column(name)[i].as_py() or [])


ROWS = "slice long, part int, data binary"
#: With the number of marks or stretches in data.
DEALT = ROWS + ", n long"


def _row(number: int, part: int, data: bytes, n: int) -> pa.RecordBatch:
    columns = [pa.array([x], k) for x, k in zip((number, part, data, n), (pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "part", "data", "n"])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["slice", "part", "data"])


def shared_marks(slices: DataFrame, parts: int, length: int, frequent: int) -> DataFrame:
    """slice, part, data: two bits for each distinct mark that the slice has of the part, in
    order: whether several documents hold it, and whether it has more than `frequent` stretches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                ids, ends, data = _opened(batch, i)
                mark, document, start, windows = stretches(data, ends, length)
                keys, part, inverse = _marks(mark, parts)
                low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
                np.minimum.at(low, inverse, ids[document])
                np.maximum.at(high, inverse, ids[document])
                held = np.bincount(inverse, minlength=len(keys))
                some = np.flatnonzero(held[inverse] > 2)
                content = data.tobytes()
                distinct = {content[s : s + w + length - 1]: k for k, s, w in zip(*(x[some].tolist() for x in (inverse, start, windows)))}
                held = np.where(held > 2, np.bincount(list(distinct.values()) or [0], minlength=len(keys)), held)
                held = np.minimum(held, 65_535).astype("<u2")
                for p, at in _each_part(part):
                    bits = np.packbits(low[at] < high[at]).tobytes()
                    yield _row(number, p, (keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + bits + zlib.compress(held[at].tobytes(), 1), at.stop - at.start)

    def count(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group[n].to_pylist() for n in ("slice", "part", "data", "n"))))
        # 4 bytes a mark, a bit for each, then the stretches of each
        keys = np.concatenate([np.frombuffer(d, "<u4", n) for *_, d, n in rows])
        own = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8, -(-n // 8), 4 * n))[:n] for *_, d, n in rows])
        held = np.concatenate([np.frombuffer(zlib.decompress(d[4 * n - (-n // 8) :]), "<u2") for *_, d, n in rows])
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        many = np.bincount(inverse, own, len(counts)) > 0
        often = np.bincount(inverse, held, len(counts)) > frequent
        code = np.stack([((counts > 1) | many)[inverse], often[inverse]], axis=1)
        ends = np.cumsum([n for *_, n in rows])
        return _rows([(s, p, np.packbits(code[e - n : e]).tobytes()) for (s, p, _, n), e in zip(rows, ends)])

    ship(slices.sparkSession)
    return over_partitions(slices, read, DEALT).groupBy("part").applyInArrow(count, ROWS)


def _dealt(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, answer: list[dict], parts: int, length: int):
    """The stretches of a slice with shared marks: (document, start, windows, part, which of the
    distinct ones) of each, and of the distinct ones (part, start, windows, least id)."""
    mark, document, start, windows = stretches(data, ends, length)
    keys, part, inverse = _marks(mark, parts)
    sizes = {p: at.stop - at.start for p, at in _each_part(part)}
    code = np.concatenate([np.unpackbits(np.frombuffer(a["data"], np.uint8))[: 2 * sizes[a["part"]]].reshape(-1, 2) for a in answer]) if answer else np.zeros((0, 2), np.uint8)
    shared, often = code[inverse].T.astype(bool)
    deal = mark
    if often.any():
        at = np.flatnonzero(shared & ~often), np.flatnonzero(shared & often)
        single, _ = _pieces(start[at[1]], windows[at[1]], 1)
        document = np.r_[document[at[0]], np.repeat(document[at[1]], windows[at[1]])]
        # a window's own hash takes the place of the mark
        own = [int.from_bytes(hashlib.blake2b(data[s : s + length].tobytes(), digest_size=8).digest(), "little") for s in single]
        deal = np.r_[mark[at[0]], np.array(own, np.uint64)]
        start, windows = np.r_[start[at[0]], single], np.r_[windows[at[0]], np.ones(len(single), np.int64)]
    else:
        document, start, windows, deal = document[shared], start[shared], windows[shared], mark[shared]
    to = ((deal >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    which: dict[bytes, int] = {}
    content = data.tobytes()
    at = np.array([which.setdefault(content[s : s + w + length - 1], len(which)) for s, w in zip(start.tolist(), windows.tolist())], np.int64)
    _, first = np.unique(at, return_index=True)
    least = np.full(len(which), LAST)
    np.minimum.at(least, at, ids[document])
    by = np.argsort(to[first], kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    first = first[by]
    return (document, start, windows, place[at]), (to[first], start[first], windows[first], least[by])


def smaller_elsewhere(slices: DataFrame, shared: DataFrame, parts: int, length: int) -> DataFrame:
    """slice, part, data (deflated): 8 bytes for each distinct stretch that the slice has of the
    part, in order, with a bit for each of its windows that a smaller id holds than any there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                ids, ends, data = _opened(batch, i)
                _, (part, start, windows, least) = _dealt(ids, ends, data, batch.column("shared")[i].as_py(), parts, length)
                for p, at in _each_part(part):
                    text = b"".join(data[s : s + w + length - 1].tobytes() for s, w in zip(start[at], windows[at]))
                    yield _row(number, p, least[at].astype("<i8").tobytes() + windows[at].astype(np.uint8).tobytes() + text, at.stop - at.start)

    def judge(group: pa.Table) -> pa.Table:
        texts, of, starts, least, windows, marks = [], [], [], [], [], []
        for batch in group.to_batches():  # read where Arrow holds them
            data = batch.column("data")
            at = np.frombuffer(data.buffers()[1], "<i8" if pa.types.is_large_binary(data.type) else "<i4")[data.offset :].tolist()
            text = np.frombuffer(data.buffers()[2], np.uint8)
            begun = []
            for a, n in zip(at, batch.column("n").to_pylist()):
                least.append(np.frombuffer(text, "<i8", n, a))
                windows.append(np.frombuffer(text, np.uint8, n, a + 8 * n))
                begun.append(a + 9 * n + np.r_[0, np.cumsum(windows[-1][:-1].astype(np.int64) + length - 1)])
            starts += begun
            of.append(np.full(sum(map(len, begun)), len(texts), np.uint16))
            marks += [_first_marks(text, np.concatenate(begun), length, MARK)]
            texts.append(memoryview(text))
        of, starts, least, windows, marks = map(np.concatenate, (of, starts, least, windows, marks))
        masks = np.empty(len(marks), "<u8")
        order = np.argsort(marks, kind="stable")
        for some in _batches(marks[order], windows[order].astype(np.int64) + length - 1, OPENED):
            rows = order[some]
            which: dict[bytes, int] = {}
            sizes, low = windows[rows].astype(np.int64), least[rows]
            at = np.array([which.setdefault(bytes(texts[t][s : s + w + length - 1]), len(which)) for t, s, w in zip(of[rows].tolist(), starts[rows].tolist(), sizes.tolist())])
            own = np.full(len(which), LAST)
            np.minimum.at(own, at, low)
            smaller = _smallest(list(which), own, length)  # of each distinct stretch, for each window
            count = np.array([len(w) for w in which]) - length + 1
            bits = smaller[_each((np.cumsum(count) - count)[at], sizes)] < np.repeat(low, sizes)
            bits = bits.astype(np.uint64) << _each(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
            masks[rows] = np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes)
        sizes = group["n"].to_pylist()
        ends = np.cumsum(sizes)
        return _rows([(s, p, zlib.compress(masks[e - n : e].tobytes(), 1)) for s, p, n, e in zip(group["slice"].to_pylist(), group["part"].to_pylist(), sizes, ends)])

    ship(slices.sparkSession)
    return over_partitions(slices.join(shared, "slice"), read, DEALT).groupBy("part").applyInArrow(judge, ROWS)


def _smallest(pieces: list[bytes], least: np.ndarray, length: int, size: int = MARK) -> np.ndarray:
    """The least id for each window of each of the pieces, in order. Pieces are transformed in
    batches; those with a mark in common are in one. A piece alone with its mark has no window in
    common with any other. Where pieces with one mark are too many for a batch, their stretches by
    marks of longer strings, at last of whole windows, are the pieces."""
    sizes = np.array([len(p) for p in pieces])
    marks = _first_marks(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, length, size)
    order = np.argsort(marks, kind="stable")
    count = sizes - length + 1
    starts = np.cumsum(count) - count
    out = np.repeat(least, count)
    marks = marks[order]
    more = np.r_[False, marks[1:] == marks[:-1]]
    more |= np.r_[more[1:], False]
    order, marks = order[more], marks[more]
    for some in _batches(marks, sizes[order], TRANSFORMED):
        rows = order[some]
        text = np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)
        ends = np.cumsum(sizes[rows])
        begins = ends - sizes[rows]
        if len(text) > 2 * TRANSFORMED and size < length:
            _, piece, start, windows = stretches(text, ends, length, size=2 * size)
            which: dict[bytes, int] = {}
            content = text.tobytes()
            at = np.array([which.setdefault(content[s : s + w + length - 1], len(which)) for s, w in zip(start.tolist(), windows.tolist())])
            own = np.full(len(which), LAST)
            np.minimum.at(own, at, least[rows][piece])
            low = _smallest(list(which), own, length, min(2 * size, length))
            n = np.array([len(w) for w in which]) - length + 1
            out[_each(starts[rows][piece] + start - begins[piece], windows)] = low[_each((np.cumsum(n) - n)[at], windows)]
        else:
            n = count[rows]
            label = window_classes(text, length)[_each(begins, n)]
            low = np.full(label.max() + 1, LAST)
            np.minimum.at(low, label, np.repeat(least[rows], n))
            out[_each(starts[rows], n)] = low[label]
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, slice_bytes: int = SLICE, frequent: int = FREQUENT, part_bytes: int = PART, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, and with `spans` also
    the spans that are removed (start, end in bytes of the text; 0 to the end for exact copies).

    Null texts are empty. Rows with one id do not count against each other; null ids are larger
    than all others and equal. Texts under `length` bytes lose nothing. Long texts are read in
    blocks, and a text is one row throughout. Repeated rows stay."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = F.coalesce("id", F.lit(int(LAST)))
    named = stored(source.select("id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n")), "digests")
    several = named.groupBy("digest").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").select("digest", "least")
    copies = stored(named.join(several, "digest").where(order > F.col("least")).select("id", "digest", "n"), "copies")
    gone = copies.select(order.alias("order"), "digest").distinct()
    gone = F.broadcast(gone) if copies.count() <= SENT // 64 else gone
    single = source.withColumn("order", order).withColumn("digest", F.sha2("text", 256)).join(gone, ["order", "digest"], "left_anti").select("id", "text")
    slices = stored(_slices(single, slice_bytes), "slices")
    total = slices.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    shared = _answers(shared_marks(slices, parts, length, frequent), "shared")
    masks = _answers(smaller_elsewhere(slices, shared, parts, length), "masks")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, data = _opened(batch, i)
                begun = np.zeros(len(data) + 1, np.int32)
                if batch.column("masks")[i].is_valid:
                    (document, start, windows, at), (*_, least) = _dealt(ids, ends, data, batch.column("shared")[i].as_py(), parts, length)
                    mask = np.frombuffer(_joined_data(batch, "masks", i), "<u8")[at]
                    mask = np.where(ids[document] > least[at], np.uint64(0xFFFFFFFFFFFFFFFF), mask)
                    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                    hit = (np.repeat(mask, windows) >> inner.astype(np.uint64)) & np.uint64(1)
                    begun[(np.repeat(start, windows) + inner)[hit > 0] + 1] = 1
                begun = np.cumsum(begun)
                # a byte is covered if one of the `length` windows that hold it goes
                covered = begun[1:] > begun[np.maximum(np.arange(len(data)) - length + 1, 0)]
                yield _kept(batch.column("ids")[i].values, ends, data, covered)

    def _kept(ids: pa.Array, ends: np.ndarray, data: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
        begins = np.r_[0, ends[:-1]]
        edge = np.zeros(len(data) + 1, bool)
        edge[begins] = True
        opens = covered & (edge[:-1] | ~np.r_[False, covered[:-1]]) if len(data) else covered
        closes = covered & (np.r_[edge[1:-1], True] | ~np.r_[covered[1:], False]) if len(data) else covered
        kept = data[~covered].tobytes()
        sums = [np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (covered, opens)]
        removed, n_spans = (s[ends] - s[begins] for s in sums)
        at = np.r_[0, np.cumsum(ends - begins - removed)]
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        columns = [ids, pa.array(ends - begins), pa.array(removed), pa.array(n_spans), pa.array(digests)]
        if spans:
            first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            of = np.searchsorted(first, np.r_[begins, len(data)])
            columns.append(pa.array([[{"start": int(a - b), "end": int(e - b)} for a, e in zip(first[i:j], last[i:j])] for b, i, j in zip(begins, of[:-1], of[1:])], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    span_type = "array<struct<start:bigint,end:bigint>>"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans"] * spans
    found = over_partitions(slices.join(shared, "slice", "left").join(masks, "slice", "left"), judge, KEPT + f", spans {span_type}" * spans)
    long = F.col("n") >= length
    rest = copies.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(long, F.col("n")).otherwise(0).alias("n_removed"),
        F.when(long, F.lit(1)).otherwise(0).cast("long").alias("n_spans"),
        F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
        *([F.expr(f"if(n >= {length}, array(struct(0L as start, n as end)), cast(array() as {span_type}))").alias("spans")] if spans else []),
    )
    return found.unionByName(rest)


def op11_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, without the bytes
    that a string of 50 covers which also starts in a document with a smaller id. Null texts are
    empty; long texts are read in blocks; rows with equal ids do not count against each other, a
    null id is larger than all others; repeated rows stay; no rows give no rows; other columns are
    not looked at."""
    return without_repeats(table(spark, sf_dir, "documents"))


#: Windows as hexadecimal, their least ids, covered bytes and maximal runs, by the definition.
OP11_SQL = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
sized as (select doc_id, h, length(h) // 2 n from docs),
places as (select doc_id, n, h, unnest(range(0, n - 49, 500)) b from sized where n >= 50),
blocks as (select doc_id, b, substr(h, 2 * b + 1, 1098) h, least(500, n - 49 - b) m from places),
starts as (select doc_id, b, h, unnest(range(0, m)) i from blocks),
windows as (select doc_id, b + i p, substr(h, 2 * i + 1, 100) w from starts),
least as (select w, min(doc_id) first from windows group by w having min(doc_id) < max(doc_id)),
hits as (select doc_id, p from windows join least using (w) where doc_id > first),
edges as (select doc_id, p, max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) q from hits),
grouped as (select doc_id, p, sum(case when q is null or p > q + 50 then 1 else 0 end) over (partition by doc_id order by p rows unbounded preceding) g from edges),
spans as (select doc_id, g, min(p) a, max(p) + 50 b from grouped group by doc_id, g),
between_spans as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) was from spans),
cut as (select doc_id, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' order by a) head, max(b) last, sum(b - a) n_removed, count(*) n_spans
  from between_spans join sized using (doc_id) group by doc_id)
select doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) kept_sha256
from sized left join cut using (doc_id)
"""
