"""Each operator against brute force on small rows, odd rows included."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.llm import ann, bpe, common, idfile, langid, media, packing, secrets, sharding, simhash, tokens, warc


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------
def test_language(spark, docs, empty):
    en, fr = "the cat and the dog of the house with that ", "le chat et le chien de la maison avec des "
    labelled = spark.createDataFrame([(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr", "s", 1) for i in range(200)], empty.schema)
    found = {r["doc_id"]: r for r in langid.identified(labelled.unionByName(docs.select(*labelled.columns).withColumn("doc_id", F.col("doc_id") + 1000))).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(200))
    assert [found[1000 + i]["lang_pred"] for i in (0, 2, 3, 4, 5, 10)] == ["en", "und", "und", "und", "fr", "und"]
    assert found[1002]["score"] == 0 and 0 < found[1000]["score"] <= 1
    assert langid.identified(docs, made=("a1", "a2", "a3")).columns == [*docs.columns, "a1", "a2", "a3"]
    assert {r["lang_pred"] for r in langid.identified(docs.where("lang is null"), keep=["doc_id"]).collect()} == {"und"}
    assert langid.identified(empty).count() == 0


def test_language_mixture():
    rng = np.random.default_rng(0)
    a, b = rng.dirichlet(np.ones(50)), rng.dirichlet(np.ones(50))
    counts = rng.multinomial(4000, 0.7 * a + 0.3 * b).astype(float)
    chosen, share = langid.infer(np.log(np.c_[a, b, rng.dirichlet(np.ones(50))]), counts)
    assert chosen == [0, 1] and abs(share[0] - 0.7) < 0.06
    assert langid.infer(np.log(np.c_[a, b]), rng.multinomial(4000, a).astype(float))[0] == [0]


def test_trigram_blocks(monkeypatch):
    text = "Ab, c dé 12 fgh! " * 9
    whole = langid.trigram_counts(text)
    for block in (1, 5, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert all(np.array_equal(x, y) for x, y in zip(whole, langid.trigram_counts(text)))
    assert not len(langid.trigram_counts("12 !")[0])


# 2 ---------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_near_duplicates(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    wanted = sorted(f"{plain_fingerprint(t):016x}" for _, t in texts(docs))
    assert sorted(r["fingerprint"] for r in rows) == wanted
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[1] == 0 and by[3] == 2 and by[4] == 2 and by[6] == 6
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("leaves", [8192, 40])
def test_links_against_all_pairs(spark, leaves):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(200)}
    for v in list(values)[:60]:
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    hot = rng.getrandbits(64)
    values |= {hot ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["a"]: r["root"] for r in simhash.connected(simhash.links(fps, leaves=leaves)).collect()}
    label = np.arange(len(values))
    v = np.array(values, np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    label = simhash.joined_labels(label, i, j)
    groups, wanted = {}, {}
    for k, s in enumerate(signed):
        groups.setdefault(roots.get(s, s), set()).add(s)
        wanted.setdefault(label[k], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_joined_labels():
    """Against sets united pair by pair; labels may stand for sets already."""
    rng = random.Random(9)
    for n, m in ((1, 0), (2, 1), (40, 25), (300, 280), (300, 2000)):
        label, sets = np.arange(n), {k: {k} for k in range(n)}
        for _ in range(2):
            pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            label = simhash.joined_labels(label, *np.array(pairs, np.int64).reshape(-1, 2).T)
            for a, b in pairs:
                both = sets[a] | sets[b]
                for k in both:
                    sets[k] = both
            assert label.tolist() == [min(sets[k]) for k in range(n)]


# 3 ---------------------------------------------------------------------------------------------
def test_archive(spark, monkeypatch):
    long, other = "<html>" + "x" * 200, "é" * 90
    rows = [(3, "u3\r\nX: y", long), (1, None, long), (2, "u2", "short"), (5, "u5", "short"), (4, "u4", None), (6, "u6", other), (7, "u7", other), (None, "n", long), (1, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = warc.write_archive(pages, common.new_path(spark, "warc"))
    found = warc.read_archive(spark, path).collect()
    assert len(found) == len(rows)
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"] or 0) for r in found)
    assert got == [(-1, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 1), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "revisit", 6)]
    wanted = {p: (h or "").encode() for p, _, h in rows}
    assert all(r["payload_digest"] == hashlib.sha256(wanted[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(wanted[r["page_id"]]) for r in found)
    types = sorted((str(r["page_id"]), r["record_type"]) for r in found)
    records = warc.read_records(spark, path).collect()
    names = {}
    for r in records:
        assert bytes(r["payload"]) == wanted[r["page_id"]]
        fields, block = warc.parsed(bytes(r["record"]))
        assert block == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"")
        names.setdefault(re.search(rb"WARC-Record-ID: (\S+)", r["record"])[1], []).append(fields["WARC-Type"])
    assert sorted((str(r["page_id"]), warc.parsed(bytes(r["record"]))[0]["WARC-Type"]) for r in records) == types
    assert len(names) == len(rows)  # rows that repeat an id have records of their own
    assert {names[x][0] for r in records for x in re.findall(rb"WARC-Refers-To: (\S+)", r["record"])} == {"response"}
    with pytest.raises(ValueError):
        warc.parsed(bytes(records[0]["record"])[:-5] + b"\r\n\r\n")
    monkeypatch.setattr(warc, "TOGETHER", 1)  # every payload with copies is dealt in parts
    monkeypatch.setattr(warc, "SHARES", 9)
    assert sorted(map(tuple, warc.read_archive(spark, path).select("page_id", "record_type", "refers_to").collect()), key=str) == sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    nothing = warc.write_archive(pages.where("false"), common.new_path(spark, "warc"))
    assert warc.read_archive(spark, nothing).count() == 0


def test_damaged_archive(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 200)], "page_id long, url string, html string")
    path = warc.write_archive(pages, common.new_path(spark, "warc"))
    bad = spark.createDataFrame([(hashlib.sha256(b"other").hexdigest(), zlib.compress(b"a" * 200))], "digest string, stored binary")
    bad.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="missing"):
        warc.read_archive(spark, path).collect()
    kept = spark.createDataFrame([(hashlib.sha256(b"a" * 200).hexdigest(), zlib.compress(b"b" * 200))], "digest string, stored binary")
    kept.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, path).collect()


# 4 ---------------------------------------------------------------------------------------------
def check_law(rows, docs_texts):
    """Sizes and checksums of all texts, gapless places, near-equal bytes: as the law says."""
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in docs_texts)
    load = [0] * 8
    for shard in range(8):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load[shard] = sum(r["size"] for r in own)
    assert max(load) - min(load) <= 2 * max((r["size"] for r in rows), default=0)


def test_sharding(spark, docs, empty):
    rows, path = sharding.shard_documents(docs, slots=64)
    found = rows.collect()
    check_law(found, [t for _, t in texts(docs)])
    assert sharding.shard_documents(empty)[0].count() == 0
    assert {r["version"] for r in sharding.versions_of(spark, path).collect()} == {1, 2}


def test_repeated_rows_are_spread(spark):
    """2,000 copies of one row, 300 of one of null id, and 500 others."""
    rows = [(7, "copy " * 400)] * 2000 + [(None, "none " * 20)] * 300 + [(i, "x" * (i % 50)) for i in range(100, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed, path = sharding.shard_documents(docs)
    check_law(placed.collect(), [t for _, t in rows])
    # the stored map is read and edited: with the same sizes nothing moves
    again, _ = sharding.shard_documents(docs, map_path=path, first=False)
    check_law(again.collect(), [t for _, t in rows])
    versions = {}
    for r in sharding.versions_of(spark, path).collect():
        versions.setdefault(r["version"], {})[r["slot"]] = r["shard"]
    assert sorted(versions) == [1, 2, 3] and all(len(v) == sharding.SLOTS for v in versions.values())
    assert sum(versions[2][s] != versions[3][s] for s in versions[2]) < sum(versions[1][s] != versions[2][s] for s in versions[2])
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_version(sharding.latest_version(spark, path).withColumn("version", F.lit(2)), path)


def test_rebalance_and_grow(spark):
    rng = random.Random(1)
    sizes = spark.createDataFrame([(i, rng.randint(1, 1000), 1) for i in range(256)], "slot int, bytes long, records long")
    first = sharding.initial_map(sizes, 8, 256)
    second = sharding.rebalanced(first, 8)
    load = {r["shard"]: r["b"] for r in second.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert max(load.values()) - min(load.values()) < 100 and len(load) == 8
    third = sharding.grown(second, 8)
    moved = third.alias("n").join(second.alias("o"), "slot").where("n.shard != o.shard")
    assert {r[0] for r in moved.select("n.shard").distinct().collect()} == {8}
    load = {r["shard"]: r["b"] for r in third.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert abs(load[8] - sum(load.values()) / 9) < 0.05 * sum(load.values()) / 9


# 5 ---------------------------------------------------------------------------------------------
def plain_hash(samples):
    """The cosine hash by its definition: means of cells, then each frequency as a plain sum."""
    h, w = samples.shape
    cells = lambda n: [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    small = [[np.float64(samples[a:b, c:d].astype(float).mean()) for c, d in cells(w)] for a, b in cells(h)]
    low = [sum(small[y][x] * math.cos(math.pi * k * (2 * y + 1) / 64) * math.cos(math.pi * m * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for k in range(8) for m in range(8)]
    low = [round(v, 6) for v in low]
    middle = (sorted(low[1:])[31])
    return [v > middle for v in low], min(abs(v - middle) for v in low if v != middle)


def test_media(spark, docs, empty):
    images = media.stored_images(docs)
    assert dict(images.dtypes)["media"] == "binary"
    found = {}
    for r in media.measured(images).collect():
        found.setdefault((r["media_sha256"], r["n_bytes"]), []).append(r)
    assert sum(map(len, found.values())) == docs.count()
    checked = 0
    for image in images.collect():
        data = bytes(image["media"])
        raw = media.png_decode(data).tobytes()
        for r in found[hashlib.sha256(data).hexdigest(), image["n_bytes"]]:
            assert len(raw) == r["payload_bytes"] and len(raw) % 576 == 0 and raw[r["n_bytes"] :] == b"\xff" * (len(raw) - r["n_bytes"])
            assert hashlib.sha256(raw).hexdigest() == r["payload_sha256"] and zlib.crc32(raw[-32:]) == r["tail_crc32"] and len(data) == r["media_bytes"]
            bits, gap = plain_hash(np.frombuffer(raw, np.uint8).reshape(-1, 576))
            if gap > 1e-4:
                assert np.unpackbits(np.frombuffer(r["feature"], np.uint8)).astype(bool).tolist() == bits
                checked += 1
    assert checked >= 10
    assert media.measured(media.stored_images(empty)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    assert np.array_equal(media.png_decode(media.png_encode(image)), image)
    rows = np.zeros((9, 8), np.uint8)
    padded = np.zeros((10, 8), int)
    padded[1:, 1:] = image
    for y in range(9):
        kind = rows[y, 0] = y % 5
        for x in range(7):
            a, b, c = padded[y + 1, x], padded[y, x + 1], padded[y, x]
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert np.array_equal(media._unfilter(rows), image)
    data = bytearray(media.png_encode(image))
    data[45] ^= 1
    with pytest.raises(media.BadImage):
        media.png_decode(bytes(data))
    smooth = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    near = np.unpackbits(np.frombuffer(media.cosine_hash(smooth), np.uint8)) != np.unpackbits(np.frombuffer(media.cosine_hash(smooth // 2 + 20), np.uint8))
    assert near.sum() <= 16


# 6 ---------------------------------------------------------------------------------------------
def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.A) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, docs, empty):
    found = secrets.scan(docs).collect()
    wanted = sorted(hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t)).encode()).hexdigest() for _, t in texts(docs))
    assert sorted(r["base_sha256"] for r in found) == wanted
    six = [r for r in found if r["doc_id"] == 6]
    assert len(six) == 2 and all("live:" in r["spans"] and r["n_assign"] == 1 and r["n_access"] == 1 for r in six)
    assert secrets.scan(empty).count() == 0


def test_shared_values_are_examples(spark):
    rows = [(i, 'api_key = "x9y8z7w6v5u4"', f"org{i}/repo") for i in range(5)] + [(9, "secret: q1w2e3r4t5y6", "org0/repo"), (10, "secret: q1w2e3r4t5y6", "org0/repo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert all("example:" in spans[i] for i in range(5)) and "live:" in spans[9] and "live:" in spans[10]
    clean = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert clean[0]["text"] == rows[0][1] and clean[9]["text"] == "secret: [secret]" and clean[9]["n_chars"] == 16


def test_redaction_keeps_rows(docs):
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not [r for r in out.collect() if r["text"] and "s3cr3tvalue99" in r["text"]]


# 7 ---------------------------------------------------------------------------------------------
def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:130] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (None, x[0].tolist()), (2060, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    found: dict[int, list] = {}
    for r in ann.nearest(table, block_rows=300, block_queries=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 900, 20))
    hits = 0
    for q, near in found.items():
        score = x @ x[q]
        score[q] = -9
        top = np.lexsort((np.arange(900), -score.round(12)))[:20]
        hits += len({v for v, _ in near} & set(top.tolist()))
        assert len(near) == 20 and all(abs(s - score[v]) < 1e-12 for v, s in near)
    assert hits >= 0.9 * 20 * len(found)
    assert ann.nearest(table.where("vec_id < 0")).count() == 0
    assert ann.nearest(table.where("vec_id < 5")).count() == 4


def test_nearest_with_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 12)) * rng.uniform(0.2, 3, (800, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(table).collect()
    hits = 0
    for q in range(0, 800, 20):
        score = x @ x[q]
        score[q] = -1e9
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 40


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    codes[:100] = codes[3]
    for i in range(100):  # rows at all small distances
        for bit in rng.choice(128, i // 4, replace=False):
            codes[i, bit // 8] ^= 1 << bit % 8
    for m in ann.SUBSTRINGS:
        index = ann.Index(np.arange(500), np.zeros((500, 2)), codes, m)
        for radius in (0, 1, 3, 7, 10, 17, 40, 55, 70, 128):
            wanted = np.flatnonzero(np.bitwise_count(codes ^ codes[3]).sum(axis=1) <= radius)
            assert np.array_equal(index.within(codes[3], radius), wanted)
            assert sum(r + 1 for r in ann.radii(radius, m)) > radius and ann.probed(codes, codes[3], m, radius)[wanted].all()


# 8, 9, 10 --------------------------------------------------------------------------------------
ODD = ["", " ", "  a  b ", "\n a\tb", " x", "x ", "日本語 の 文 章", "a\x1c b", "'s it's  don't", "<|endoftext|> |x| |", "A" * 300, "Aİ, b. İ.", "a" + " " * 40 + "b", "one,two. three; four:"]


def many_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("ab \n\té 😀日'sthe12.,-|İΣ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_bpe_is_exact():
    import public_tokenizers
    import tiktoken

    own, cache = bpe.worker_bpe(bpe.RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, data in zip(many_texts(), cache(many_texts())):
        ids = tokens.ids_of(data).tolist()
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcthe \xc3\xa9") for _ in range(rng.randint(1, 30)))
        if piece not in own.ranks:
            assert [own.bytes_of[i] for i in own.encode_piece(piece)] == bpe.merge_in_order(piece, own.ranks)


@pytest.mark.parametrize("name", [packing.MODEL, idfile.MODEL])
def test_piece_cache_is_exact(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.file_of(name))
    model.encode_special_tokens = True
    own = tokens.tokenizers_cache(name)
    assert own.words and own.folds != own.lines
    rng = random.Random(3)
    more = ["".join(rng.choice("aAjJhH\u030c\u0331\u0301\u212a\u1100\u1161éÉ \n\t\u00a0\u2028ß's.,!$(-ʹΣσ字1Ⅷ_") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    words = [" ".join(rng.choice(["the", "The", "word,", "end.\nNext", "naïve!!", "É.", "x's", "a\nb", "(no)", "J\u030c", "İ.", "12"]) for _ in range(30)) for _ in range(300)]
    for limit, whole in ((tokens.CACHE, True), (50, True), (50, False)):
        cache = tokens.PieceCache(own.encode, limit, own.words if whole else None, own.lines, own.folds)
        for part in (many_texts() + more + words, (many_texts() + more + words)[::-1], ["one alone"], [""], []):
            assert [tokens.ids_of(x).tolist() for x in cache(part)] == [e.ids for e in model.encode_batch(part, add_special_tokens=False)]


def test_bpe_round_trips(docs, empty):
    found = bpe.round_trips(docs).collect()
    assert sorted(r["decoded_sha256"] for r in found) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts(docs))
    assert bpe.round_trips(empty).count() == 0
    assert bpe.encoded(docs).where("size(ids) = 0").count() == 3


def test_packed_ranks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4, 1001):
        ranks = (2.0 ** rng.uniform(0, 31.9, n)).astype("<u4")
        control, data = idfile.pack_ranks(ranks)
        assert np.array_equal(idfile.unpack_ranks(control, data, n), ranks)
    with pytest.raises(ValueError):
        idfile.unpack_ranks(control, data[:-1], n)


def library_ids(name, text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.file_of(name))
    model.encode_special_tokens = True
    return [*model.encode(text or "", add_special_tokens=False).ids, 2]


def test_id_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK_IDS", 7)
    path = idfile.write_files(idfile.tokenised(docs), common.new_path(spark, "ids"), parts=3)
    found = idfile.read_files(spark, path).collect()
    wanted = sorted(library_ids(idfile.MODEL, t) for _, t in texts(docs))
    assert sorted(list(r["ids"]) for r in found) == wanted
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    keys = [r["key"] for r in sorted(found, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    nothing = idfile.write_files(idfile.tokenised(empty), common.new_path(spark, "ids"))
    assert idfile.read_files(spark, nothing).count() == 0


def test_packing(docs, empty):
    pieces = packing.pieces_of(docs, keep_ids=True)
    found = packing.packed(pieces, per_task=5).collect()
    wanted = sorted(library_ids(packing.MODEL, t) for _, t in texts(docs))
    assert sum(r["length"] for r in found) == sum(map(len, wanted))
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and (r["piece"] == 0 or r["length"] == 1024)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(packing.pieces_of(empty)).count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 1024))[::-1]
    bins, offsets, gaps = packing.sum_of_squares(lengths)
    assert np.array_equal(np.bincount(bins, weights=lengths) + gaps, np.full(len(gaps), 1024))
    assert len(gaps) <= 1.01 * -(-lengths.sum() // 1024)
    assert len(packing.sum_of_squares(np.array([], int))[2]) == 0
