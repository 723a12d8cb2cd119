"""Spelling variants (operator 13) against the definition."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from stripchart.llm import variants


def near(u, v):
    """Whether one insertion, deletion or replacement turns u into v."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(counts):
    """The rows by definition from {word: n}."""
    rows = {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        form = min(found, key=lambda v: (-counts[v], v), default=None)
        if form is not None and counts[form] < 5 * n:
            form = None
        rows[w] = (form, n, len(found))
    out = []
    for w, (form, n, size) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.append((w, form, root, n, size, counts[form] if form else None))
    return sorted(out)


@pytest.mark.parametrize("sent", [variants.SENT, 0])
def test_pairs_and_forms(spark, monkeypatch, sent):
    """Few letters, so that words are near many others in every way; repeated letters; ends
    within other words; a very long word; chains of forms."""
    monkeypatch.setattr(variants, "SENT", sent)
    rng = random.Random(3)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 6))): 5 ** rng.randint(1, 6) + rng.randint(0, 2) for _ in range(400)}
    counts |= {"ab" * 4000: 700, "ab" * 4000 + "a": 5, "ab" * 2000 + "c" + "ab" * 2000: 9}
    counts |= {"chainzzzz": 10, "chainyzzz": 60, "chainyyzz": 400, "chainyyyz": 3000, "chainyyyy": 20000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = variants.one_edit_pairs(words).collect()
    found = sorted(tuple(sorted((r["a"], r["b"]))) for r in pairs)
    assert found == sorted({tuple(sorted((u, v))) for u in counts for v in counts if near(u, v)})
    assert all(counts[r["a"]] == r["a_n"] and counts[r["b"]] == r["b_n"] for r in pairs)
    assert sorted(map(tuple, variants.grouped(words).collect())) == plain(counts)


def test_registered(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    stems = ["Élan vital", "calendar", "separate", "definitely", "ÀÉÎõü", "accommodate"]
    rows = []
    for i in range(300):
        words = rng.choices(stems, k=12)
        rows.append((i, " ".join(w if rng.random() < 0.9 else w[:3] + w[4:] for w in words) + " ÷times× 12ab_cdefgh ABCDEFghi"))
    rows += [(1, None), (2, ""), (None, "separate " * 9), (None, None), rows[4], rows[4], (7, "calendar-" * 30_000), (8, "ab" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("word", "n", "node", "key", "form")))
    docs.repartition(3).write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    counts: dict[str, int] = {}
    lost = 0
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or 0xC0 <= ord(c) <= 0xFF:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    lost += 1
                if len(run) >= 6:
                    counts[run] = counts.get(run, 0) + 1
            run = ""
    assert lost > 10
    monkeypatch.setattr(variants, "HELD", 5)
    found = variants.op13_errata_trie(spark, f"{tmp_path}/full")
    assert sorted(map(tuple, found.collect())) == plain({w: n for w, n in counts.items() if n >= 5})
    assert variants.op13_errata_trie(spark, f"{tmp_path}/none").collect() == []
