"""The pipeline's stages against brute force on small rows, odd rows included."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stripchart.llm import overlap, packing


def plain_runs(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest id of each group that chains of similarities connect."""
    sets = [plain_runs(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if label[i] != label[j] and 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))


@pytest.fixture(scope="module")
def edited():
    """Edited copies around the limit, a dense group, copies, short and empty texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    found = []
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        found.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            found.append(" ".join(copy))
    dense = rng.choices(vocabulary, k=120)
    for _ in range(60):
        copy = list(dense)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        found.append(" ".join(copy))
    found += ["", None, "one two", "one  two", "one two three"]
    rng.shuffle(found)
    return list(enumerate(found))


@pytest.mark.parametrize("part", [512, 7])
def test_near_copies(spark, edited, part):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in overlap.one_of_each(docs, part=part).collect())
    assert kept == plain_kept(edited)
    assert len(kept) < len(edited) - 60


def test_stage_links_edited_copies(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in found.collect()) == plain_kept(edited)


def test_near_copies_odd_rows(spark, docs, empty):
    kept = overlap.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 9, 10]
    assert overlap.one_of_each(empty).count() == 0
    assert overlap.one_of_each(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 8


def test_every_stage_and_run(spark, tmp_path):
    """Each stage on what the stage before it left, then run() as a whole, and both when empty."""
    en, fr = "the cat and the dog of the house with that door", "le chat et le chien de la maison avec des portes"
    rows = [(i, f"{en if i % 2 else fr} " * 3 + f"x{i} y{i} z{i}", "en" if i % 2 else "fr", f"src{i}", 9) for i in range(40)]
    rows += [(100, rows[3][1], "en", "src0", 9), (101, rows[5][1] + " more", "en", "src1", 9)]
    rows += [(102, None, None, None, None), (103, "12 !", "en", "src2", 4), (104, "", None, None, 0)]
    rows += [(107, "ωραίος καιρός σήμερα στην πόλη", None, "src4", 9), (108, "qzxj vkwq xjzz qqkv zxvj kqxw jjqz vvxk", None, "src4", 9)]
    rows += [(105, 'set password = "q1w2e3r4t5y6" before the house of the dog', "en", "src3", 9), (106, None, "en", "src3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")

    def pairs(frame):
        return sorted((r["doc_id"], r["text"]) for r in frame.collect())

    # 107 and 108 have letters, but are in no language that is learned
    lettered = sorted((i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "") and i not in (107, 108))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, "")
    assert pairs(first) == lettered
    second = stages["near_duplicates"](spark, first, "")
    kept = plain_kept(lettered)
    assert pairs(second) == [x for x in lettered if x[0] in kept] and 100 not in kept and 101 not in kept
    third = stages["secret_scan"](spark, second, "")
    clean = [(i, t.replace("q1w2e3r4t5y6", "[secret]")) for i, t in lettered if i in kept]
    assert pairs(third) == clean
    for found in (stages["pack"](spark, third, ""), corpus_pipeline.run(spark, f"{tmp_path}/full")):
        packed = found.collect()
        assert sorted(r["doc_id"] for r in packed) == kept and all(r["piece"] == 0 for r in packed)
        places: dict[int, list] = {}
        for r in packed:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for place in places.values():
            at = 0
            for offset, length in sorted(place):
                assert offset == at
                at += length
            assert at <= 1024
        crcs = {r["doc_id"]: r["ids_crc32"] for r in packed}
        assert crcs == {r["doc_id"]: r["ids_crc32"] for r in packing.pieces_of(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_shared_paragraphs_are_not_compared(spark):
    """Texts of shared paragraphs, two of them alike: few pairs pass the filters, the link does."""
    rng = random.Random(3)
    paragraphs = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(40)]
    found = [" ".join(rng.sample(paragraphs, 10)) for _ in range(200)]
    found.append(found[7] + " and more")
    texts = spark.createDataFrame(list(enumerate(found)), "row long, text string")
    heads = overlap.stored(overlap.prefixes(texts), "heads")
    pairs = overlap.candidates(overlap._rooted(heads.where("place <= n div 5"), None), heads).collect()
    assert (200, 7) in {(r["row"], r["center"]) for r in pairs}
    assert len(pairs) < 200 * 200 // 100
    assert {(r["a"], r["b"]) for r in overlap.links(texts, rounds=0).collect()} == {(200, 7)}


def test_rounds_link_copies_before_pairs_are_made(spark):
    """120 copies with a word or two replaced: nearly all pass the filters in pairs at first; a round
    makes them few components by links that stand, and few pairs are left."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    found = []
    for _ in range(120):
        copy = list(words)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(200)] = f"x{rng.randrange(5000)}"
        found.append(" ".join(copy))
    texts = spark.createDataFrame(list(enumerate(found)), "row long, text string")
    heads = overlap.stored(overlap.prefixes(texts), "heads")
    first = heads.where("place <= n div 5")
    entries = overlap._rooted(first, None)
    assert overlap.candidates(entries, heads).count() > 120 * 119 // 4
    met = overlap.compared(overlap.stored(overlap.chosen(entries), "chosen"), texts)
    sets = [plain_runs(t) for t in found]
    label = list(range(120))
    for r in met.collect():
        label = [label[r["b"]] if x == label[r["a"]] else x for x in label]
    center = {r["center"] for r in overlap.chosen(entries).collect()}
    for r in overlap.chosen(entries).collect():
        a, b = sets[r["row"]], sets[r["center"]]
        assert label[r["row"]] == label[r["center"]] or 9 * len(a & b) < 4 * (len(a) + len(b))
    assert center and len(set(label)) < 12
    assert overlap.candidates(overlap._rooted(first, overlap.connected(met)), heads).count() < 120
