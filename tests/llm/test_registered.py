"""The registered queries themselves, run over small tables in a folder, against plain answers."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.llm import langid, media, packing, registry, secrets, simhash, tokens
from test_llm_operators import check_law, library_ids, plain_hash, plain_spans

EN, FR = "the cat and the dog of the house with that door and this wall", "le chat et le chien de la maison avec des portes et les murs"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Two languages and texts of both, copies from two to many, nulls in every column, ties,
    repeated rows, an empty text, secrets of few and of many sources, and a text of a million
    characters."""
    rng = random.Random(8)
    found = []
    for i in range(120):
        lang = i % 2
        words = rng.choices((EN, FR)[lang].split(), k=30)
        found.append((i, " ".join(words) + (f' token = "q{i % 5}w2e3r4t5y{i % 5}"' if i % 6 == 0 else ""), ("en", "fr")[lang], f"org{i % 4}/src{i % 9}", 9))
    found += [(200, f"{EN} {EN} {FR}", "en", "src1", 1), (201, "AKIA" + "ABCD1234EFGH5678" + " and " + "0123456789abcdef" * 3, None, None, None)]
    found += [(300 + i, EN, "en", "src0", 1) for i in range(40)] + [(7, found[7][1], "fr", "org3/src7", 9)] * 3
    found += [(400, None, None, None, None), (401, "", "en", "src2", 0), (402, " \n ", None, "src2", 3), (403, "12 345 !", "fr", "src2", 8), (None, FR, "fr", "src3", 1), (None, None, None, None, None)]
    found += [(500, "word and line " * 71_500, "en", "src5", 1_001_000)]
    return found


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    """(full, empty) folders of tables, with extra columns whose names operators use."""
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("full", "none"))
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(i).alias(n) for i, n in enumerate(("key", "row", "slot", "spans", "fp", "score", "payload", "_marks", "_key", "__row", "digest"))))
    pages = spark.createDataFrame([(i, f"http://x/{i % 7}", None if i == 5 else "<p>" + "yx"[i % 2] * (40 * (i % 4))) for i in range(40)] + [(3, "again", "<p>" + "x" * 120), (None, None, "<p>" + "x" * 120)], "page_id long, url string, html string").withColumn("row", F.lit(1))
    x = rng.normal(size=(400, 24))
    x[40:60] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (520, [0.0] * 24), (None, x[1].tolist())], "vec_id long, embedding array<double>").withColumn("b", F.lit(1))
    for name, table in (("documents", docs), ("pages", pages), ("embeddings", vectors)):
        table.repartition(3).write.parquet(f"{full}/{name}.parquet")
        table.where("false").write.parquet(f"{none}/{name}.parquet")
    return full, none, x


def texts_of(rows):
    return [(r[0], r[1]) for r in rows]


def run(spark, folders, name, at=0):
    query = next(q for n, q in registry.QUERIES.items() if n.startswith(name + "_"))
    return query(spark, folders[at]).collect()


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty_tables(spark, folders, name):
    assert run(spark, folders, name, 1) == []


def plain_mixture(text, names, table):
    """The prediction by its definition: trigrams one by one in dictionaries, plain sums."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return "und", 0.0
    words = "\0" + "\0".join(letters.split()) + "\0"
    counts = Counter()
    for a, b, c in zip(words, words[1:], words[2:]):
        mixed = (((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA6B + ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
        counts[mixed >> 48] += 1
    n = sum(counts.values())

    def em(langs):
        share, before = [1 / len(langs)] * len(langs), -math.inf
        for _ in range(langid.ROUNDS):
            value, new = 0.0, [0.0] * len(langs)
            for bucket, times in counts.items():
                joint = [s * math.exp(table[bucket][k]) for s, k in zip(share, langs)]
                total = sum(joint)
                value += times * math.log(total)
                new = [x + times * j / total / n for x, j in zip(new, joint)]
            share = new
            if value - before < langid.TOLERANCE * abs(value) / n:
                break
            before = value
        return share, value

    single = [sum(t * table[b][k] for b, t in counts.items()) for k in range(len(names))]
    best = max(range(len(names)), key=lambda k: single[k])
    chosen, share, value = [best], [1.0], single[best]
    first, _ = em(list(range(len(names))))
    for k in sorted(range(len(names)), key=lambda k: -first[k]):
        if k == best:
            continue
        new_share, new_value = em([*chosen, k])
        if new_value - value <= langid.PENALTY * math.log(n + 1):
            break
        chosen, share, value = [*chosen, k], new_share, new_value
    top = max(range(len(chosen)), key=lambda i: share[i])
    return names[chosen[top]], share[top]


def test_op1(spark, folders, rows):
    found = run(spark, folders, "op1")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert Counter((r["doc_id"], r["held_out"]) for r in found) == Counter((i, held(i)) for i, _ in texts_of(rows))
    names, table = langid.learn(spark.createDataFrame(rows, SCHEMA).where(~langid.held_out()))
    wanted = {}
    for i, t in texts_of(rows):
        if i is not None and i != 500:
            wanted[i] = plain_mixture(t, names, table)
    for r in found:
        if r["doc_id"] in wanted:
            lang, score = wanted[r["doc_id"]]
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 0.02, r
    assert {r["lang_pred"] for r in found if r["doc_id"] in (400, 401, 402, 403)} == {"und"}
    languages = {r["doc_id"]: r["languages"] for r in found}
    assert languages[200].count(":") == 2  # a text of both


def test_op2(spark, folders, rows):
    import xxhash

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = Counter()
        for gram, times in Counter(grams).items():
            h = xxhash.xxh64_intdigest(gram, 42)
            for bit in range(64):
                ones[bit] += times * (h >> bit & 1)
        return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(grams))

    fps = [(i, fingerprint(t)) for i, t in texts_of(rows)]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                old, new = root[b], root[a]
                root = {f: new if r == old else r for f, r in root.items()}
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root[f]].append(i)
    wanted = Counter((i, f"{f:016x}", min(least[root[f]]) if least[root[f]] else None) for i, f in fps)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, folders, "op2")) == wanted


def test_op3(spark, folders):
    duckdb = pytest.importorskip("duckdb")
    pages = spark.read.parquet(f"{folders[0]}/pages.parquet").where("page_id is not null").dropDuplicates(["page_id"])
    connection = duckdb.connect()
    connection.register("pages", pages.select("page_id", "url", "html").toPandas())
    wanted = {r[0]: r for r in connection.execute("select page_id, payload_bytes, payload_digest, record_type, refers_to from (" + registry.ORACLE_SQL["op3_content_addressed"] + ")").fetchall()}
    found = [tuple(r) for r in run(spark, folders, "op3")]
    assert len(found) == 42
    seen = {r[0]: r for r in found if r[0] is not None and r[0] != 3}
    assert all(tuple(wanted[i]) == r for i, r in seen.items()) and len(seen) == 39


def test_op4(spark, folders, rows):
    found = run(spark, folders, "op4")
    check_law(found, [t for _, t in texts_of(rows)])
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_op5(spark, folders, rows):
    found = run(spark, folders, "op5")
    plain = {}
    for i, t in texts_of(rows):
        data = (t or "").encode()
        raw = data + b"\xff" * (576 - len(data) % 576 if len(data) % 576 or not data else 0)
        png = media.png_encode(np.frombuffer(raw, np.uint8).reshape(-1, 576))
        plain.setdefault((i, len(data)), (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(png), hashlib.sha256(png).hexdigest(), raw))
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in texts_of(rows))
    for r in found:
        *wanted, raw = plain[r["doc_id"], r["n_bytes"]]
        assert [r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]] == wanted
    for r in found[:40]:
        bits, gap = plain_hash(np.frombuffer(plain[r["doc_id"], r["n_bytes"]][-1], np.uint8).reshape(-1, 576))
        if gap > 1e-4:
            assert r["feature"] == np.packbits(bits).tobytes().hex()


def test_op6(spark, folders, rows):
    """Base spans and added ones: a value is an example where three sources, or three owners, have
    it, else live if it can be a credential."""
    value_at = {0: lambda s: secrets.ASSIGN.match(s)[2], 1: str, 2: str}
    users = defaultdict(set)
    for _, text, _, source, _ in rows:
        for s, k, e in plain_spans(text):
            users[value_at[k](text[s:e])].add(source or "")

    def random_bits(v):
        return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())

    wanted = Counter()
    for i, text, *_ in rows:
        base = plain_spans(text)
        spans = [(s, k, e) for s, k, e in base]
        for s, k, e in base:
            v = value_at[k](text[s:e])
            begin = text.index(v, s)
            can_be = k == 1 or random_bits(v) >= secrets.RANDOM_BITS and (k == 0 or any(c.isdigit() for c in v) and any(c.isalpha() for c in v))
            owners = {u.split("/")[0] for u in users[v]}
            kind = 4 if len(users[v]) >= 3 or len(owners) >= 3 else 3 if can_be else None
            if kind and (begin, kind, begin + len(v)) not in spans:
                spans.append((begin, kind, begin + len(v)))
        line = lambda found: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        wanted[i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(spans)] += 1
    found = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in run(spark, folders, "op6"))
    assert found == wanted and any("live:" in k[-1] for k in wanted) and any("example:" in k[-1] for k in wanted)


def test_op7(spark, folders):
    x, found = folders[2], defaultdict(list)
    for r in sorted(run(spark, folders, "op7"), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r)
    assert sorted(found) == list(range(0, 400, 20))
    hits = 0
    for q, near in found.items():
        score = x @ x[q]
        assert [r["rank"] for r in near] == list(range(1, 21)) and all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 or r["vec_id"] == 1 for r in near)
        score[q] = -math.inf
        hits += len({r["vec_id"] for r in near} & set(np.lexsort((np.arange(400), -score))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_op8(spark, folders, rows):
    import public_tokenizers
    import tiktoken

    from stripchart.llm import bpe

    own = bpe.load_ranks(tokens.file_of(bpe.RANKS))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    wanted = Counter()
    for i, t in texts_of(rows):
        ids = other.encode_ordinary(t or "")
        wanted[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in run(spark, folders, "op8")) == wanted


def test_op9(spark, folders, rows):
    from stripchart.llm import idfile

    found = sorted(run(spark, folders, "op9"), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in found]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    wanted = Counter((i, len(ids := library_ids(idfile.MODEL, t)), crc(ids)) for i, t in texts_of(rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == wanted


def test_op10(spark, folders, rows):
    found = run(spark, folders, "op10")
    places, total = defaultdict(list), 0
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
        assert r["piece"] == 0 or r["length"] == packing.CAPACITY
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= -(-total // packing.CAPACITY) * 1.05 + 1
    wanted = Counter()
    for i, t in texts_of(rows):
        ids = library_ids(packing.MODEL, t)
        first = (len(ids) - 1) % packing.CAPACITY + 1
        cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted


def test_stages_keep_columns_of_any_name(spark, folders):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folders[0]}/documents.parquet").withColumns({c: F.lit("x") for c in ("__lang_pred", "lang_pred_", "doc", "clean", "marks", "same", "id", "text_")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folders[0]).columns == docs.columns
    assert simhash.one_of_each(docs).columns == docs.columns
    kept = {r["doc_id"]: json.loads(r["all"]) for r in simhash.one_of_each(docs).select("doc_id", F.to_json(F.struct("*")).alias("all")).collect()}
    assert all(r["__row"] == 9 for r in kept.values())
