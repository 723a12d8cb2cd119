"""Repeated passages (operator 11) against the definition."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.llm import repeats


def plain(rows, length):
    """(id, bytes, removed, spans, digest) of each row, from all strings of the length."""
    texts = [((1, 0) if i is None else (0, i), i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, tuple] = {}
    for order, _, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, order), order)
    found = []
    for order, key, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < order:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        found.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def rows():
    """Passages shared by few and by many, near and exact copies, periodic texts, letters of two
    bytes, nulls, short texts, repeated rows and ids, and a long text."""
    rng = random.Random(4)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    texts = []
    for i in range(90):
        body = rng.choices(words, k=rng.choice([3, 40, 90]))
        if i % 3 == 0:
            body[rng.randrange(len(body)) :] += [passage]
        texts.append(" ".join(body))
    texts += [texts[5], texts[6] + " more", texts[7][:200], "ab" * 400, "ab" * 90 + "c" + "ab" * 90, "a" * 300, None, "", "short", "short"]
    texts += [" ".join(rng.choices(words, k=9000)) + passage]
    found = [(1000 - 3 * i if i % 2 else i, t) for i, t in enumerate(texts)]
    return found + [(None, texts[3]), (None, texts[3]), (None, passage), (None, None), found[9], (found[9][0], "tail " + found[9][1])]


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 3000, "part_bytes": 20_000}, {"slice_bytes": 3000, "frequent": 3}])
def test_against_the_definition(spark, rows, options, monkeypatch):
    monkeypatch.setattr(repeats, "SENT", 32_000_000 if len(options) else 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.without_repeats(docs, **options)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 50)


@pytest.mark.parametrize("length", [7, 20])
def test_other_lengths_and_spans(spark, rows, length):
    some = [(i, (t or "")[:900]) for i, t in rows]
    found = repeats.without_repeats(spark.createDataFrame(some, "doc_id long, text string"), length=length, slice_bytes=4000, spans=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == plain(some, length)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
        assert all(a["end"] <= b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_window_classes():
    rng = np.random.default_rng(2)
    for n, length in ((1, 3), (9, 9), (300, 4), (4000, 50)):
        text = rng.integers(97, 99, n).astype(np.uint8)
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        label, around = repeats.window_classes(text, length), np.resize(text, n + length).tobytes()
        strings = defaultdict(set)
        for i, x in enumerate(label):
            strings[around[i : i + length]].add(int(x))
        assert all(len(x) == 1 for x in strings.values()) and len(strings) == len(set(label.tolist()))


def test_registered(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("id", "digest", "order", "n", "slice", "data")))
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    found = repeats.op11_interval_expansion(spark, f"{tmp_path}/full")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 50)
    assert repeats.op11_interval_expansion(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("length", [7, 50])
def test_what_is_transformed_at_once_is_bounded(length, monkeypatch):
    """Many stretches round one string, so with one mark, are cut before they are transformed."""
    rng = random.Random(5)
    middle = "".join(rng.choices("abcdefgh", k=min(16, length)))
    side = lambda: "".join(rng.choices("ab" if length == 7 else "abcdefgh", k=length - len(middle)))
    pieces = list({(side() + middle + side()).encode()[: 64 + length - 1] for _ in range(2000)})
    least = np.array(rng.choices(range(500), k=len(pieces)))
    wanted: dict[bytes, int] = {}
    windows = [(p[i : i + length], x) for p, x in zip(pieces, least.tolist()) for i in range(len(p) - length + 1)]
    for w, x in windows:
        wanted[w] = min(wanted.get(w, x), x)
    seen, classes = [], repeats.window_classes
    monkeypatch.setattr(repeats, "TRANSFORMED", 1000)
    monkeypatch.setattr(repeats, "_least", lambda h, width, f=repeats._least: f(h, width) if width < 20 else f(h, width) & np.uint64(1))  # few marks at first
    monkeypatch.setattr(repeats, "window_classes", lambda text, n: seen.append(len(text)) or classes(text, n))
    assert repeats._smallest(pieces, least, length).tolist() == [wanted[w] for w, _ in windows]
    assert max(seen, default=0) <= 12_000


def test_memory_for_many_stretches():
    rng = np.random.default_rng(6)
    pieces = [bytes(x) for x in rng.integers(97, 123, (60_000, 67)).astype(np.uint8)]
    tracemalloc.start()
    try:
        repeats._smallest(pieces, np.arange(len(pieces)), 50)
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()


def test_frequent_marks_count_their_stretches(spark):
    """One string in many contexts of two documents is frequent, however few the slices."""
    rng = random.Random(7)
    texts = ["".join("".join(rng.choices("abcdefgh", k=40)) + "0123456789ABCDEF" for _ in range(900)) for _ in range(2)]
    slices = repeats._slices(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), 10)
    for frequent, often in ((20, True), (20_000, False)):
        rows = repeats.shared_marks(slices, 1, 50, frequent).collect()
        assert any(np.unpackbits(np.frombuffer(r.data, np.uint8))[1::2].any() for r in rows) == often
