"""Phrases by pivot partitioning (operator 12) against the definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.llm import phrases


def plain(rows, least, top):
    """The rows by the definition, from all phrases of all pieces."""
    f: dict[str, Counter] = {}
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(v for g, v in own.items() if len(g) == 1)
        grams = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in grams.items():
            if any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in grams.items()):
                continue
            score, k = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Set phrases, words repeated in a row, a very common line, all cuts and spaces, letters
    outside A-Z, two languages, nulls, repeated rows and a long text."""
    rng = random.Random(9)
    fixed = ["new york city", "as well as the", "the the the", "Één twee drie vier vijf zes", "red\tgreen  blue", "a\x1cb c\x85d", "café au lait"]
    found = []
    for i in range(160):
        words = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(40 * rng.random() ** 2)}" for _ in range(30)]
        found.append((" ".join(w + rng.choice(["", "", "", "", ".", ",", ";", ":", "!", "?", "\n", "\x0b", "\x0c", "\r"]) for w in words), rng.choice(["en", "en", "fr"])))
    found += [("This work is licensed to all of you.", "en")] * 90
    return found + [(None, "en"), ("", None), (None, None), ("new york city " * 40, None), ("the cat and the dog " * 4000, "fr")]


@pytest.mark.parametrize("options", [{}, {"vocabulary": 9}, {"places": 300}, {"vocabulary": 9, "places": 300}])
def test_against_the_definition(spark, rows, options, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 4000)
    monkeypatch.setattr(phrases, "HELD", 50)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = phrases.collocations(docs, least=12, top=60, **options).collect()
    assert sorted(map(tuple, found)) == plain(rows, 12, 60)


def test_rows_of_one_hash(monkeypatch):
    """Counting stays exact where distinct rows have one hash."""
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 4]], np.int64) << 62  # the hash keeps the low bits apart only
    first, total = phrases.counted(rows, np.array([1, 2, 3, 4, 5]))
    wanted = Counter()
    for r, n in zip(map(tuple, rows.tolist()), [1, 2, 3, 4, 5]):
        wanted[r] += n
    assert {tuple(rows[i].tolist()): int(n) for i, n in zip(first, total)} == dict(wanted)


def test_registered(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows * 3, "text string, lang string").select(F.monotonically_increasing_id().alias("doc_id"), "*", *(F.lit(1).alias(c) for c in ("word", "n", "gram", "rank", "a", "part")))
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    found = phrases.op12_pivot_partitioning(spark, f"{tmp_path}/full")
    assert sorted(map(tuple, found.collect())) == plain(rows * 3, 100, 2000)
    assert phrases.op12_pivot_partitioning(spark, f"{tmp_path}/none").collect() == []
