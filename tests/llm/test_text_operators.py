"""Text operators: edge cases and brute-force versions on small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, common, decontam, exact_dedup, langid, minhash, quality, simhash, token_counts, toxicity, warc
from gridloom.llm.queries import SEPARATOR, tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, fp int, digest int, rows int, ids int, score int, h int"


def docs(spark, texts, first=0):
    """Documents with columns whose names clash with those that operators use inside; a few nulls."""
    rows = [(first + i, t, None if i % 5 == 0 else "en", None, None, i, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "a", "A", "one two three", "ONE two  three", "x" * 5000, " ".join(f"w{i}" for i in range(20000)), "émoji 😀 ünï", "<|endoftext|>", "one two three"]


# Exact deduplication


def test_exact_dedup(spark):
    index = exact_dedup.DigestIndex(spark)
    got = {r.doc_id: r for r in index.ingest(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    assert (got[0].keep_id, got[1].keep_id, got[0].group_size, got[2].kept) == (0, 0, 2, True)  # null is empty; white space becomes one space
    assert (got[11].keep_id, got[11].group_size, got[11].kept, got[6].kept) == (5, 2, False, True)
    again = index.ingest(docs(spark, ["new", "a", "new"], 100)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in again} == {(100, 100, 2, True), (101, 3, 1, False), (102, 100, 2, False)}
    n = index.read().count()
    index.ingest(docs(spark, ODD))
    assert index.read().count() == n == index.read().select("digest").distinct().count()
    assert index.ingest(docs(spark, [])).count() == 0
    none = spark.createDataFrame([(None, "q"), (None, "q"), (7, "q")], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.ingest(none).collect()} == {(None, 7, False), (7, 7, True)}


def test_index_outlives_its_session(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    one = exact_dedup.DigestIndex(spark, path)
    one.ingest(docs(spark, ["a", "b"]))
    spark.sql(f"DROP TABLE {one.name}")  # what the end of a session does to its catalogue
    two = exact_dedup.DigestIndex(spark.newSession(), path)
    found = {(r.doc_id, r.keep_id, r.kept) for r in two.ingest(docs(spark, ["b", "c"], 50)).collect()}
    assert found == {(50, 1, False), (51, 51, True)} and two.read().count() == 3
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "BUCKETS", 1)
    two.compact()
    assert (two.generation, two.buckets, two.read().count()) == (1, 4, 3)
    (tmp_path / "index" / "next").mkdir()  # what a crash in compact() leaves
    three = exact_dedup.DigestIndex(spark.newSession(), path)
    assert three.ingest(docs(spark, ["c"], 90)).first().keep_id == 51 and three.read().count() == 3
    three.compact()
    three.drop()
    assert not (tmp_path / "index").exists()


def test_batches_give_the_same(spark):
    rng = random.Random(9)
    d = docs(spark, [rng.choice(["x", "y  y", "y y", None, "", str(i)]) for i in range(60)])
    d = d.unionByName(d.limit(5)).unionByName(d.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    runs = []
    for batches in (1, 2, 7):
        index = exact_dedup.DigestIndex(spark)
        runs.append(sorted((tuple(r) for r in index.ingest(d, batches=batches).collect()), key=repr))
        index.drop()
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 68


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "same"), (1, "same"), (2, "same"), (2, "unique"), (None, "same"), (None, "nameless"), (None, "nameless")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, row int")
    assert sorted(map(repr, exact_dedup.distinct_texts(d).collect())) == sorted(["Row(doc_id=1, text='same', row=0)", "Row(doc_id=2, text='unique', row=0)", "Row(doc_id=None, text='nameless', row=0)"])


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex(spark)
    index.ingest(docs(spark, ODD))
    groups = spark.createDataFrame([(b"\1" * 32, 1, 1)], "digest binary, keep_id bigint, rows bigint")
    plan = index.fresh(groups)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "LeftAnti" in plan


# SimHash


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    import xxhash

    text = "The quick brown FOX jumps over é the lazy dog " * 3
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert simhash.shingle_hashes(text, 4).tolist() == h
    assert simhash.majority(np.array(h, np.uint64)) == sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    assert simhash.majority(simhash.shingle_hashes(None, 4)) == 0
    assert simhash.shingle_hashes("a b", 4).tolist() == [xxhash.xxh64_intdigest("a b", 42)]


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_links_and_components(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # so that buckets are split
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds[:12]:
        for _ in range(40):
            f = s
            for _ in range(rng.randint(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):  # a chain whose ends are far apart
        chain ^= 7 << b
        fps.add(chain)
    fps = dict(enumerate(sorted(fps)))
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    reps = spark.createDataFrame([(f, i) for i, f in signed.items()], "fp bigint, first bigint")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(reps, radius)).collect()}
    want, found = brute_components(fps, radius), {}
    for i, f in signed.items():
        found.setdefault(roots.get(f, f), set()).add(i)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_stars_of_one_large_bucket():
    rng = np.random.default_rng(3)
    f = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    a, b = simhash.stars(np.ones(len(f), int), f, 4)
    assert len(a) == len(f) - 1 and len(set(b.tolist())) == 1  # a star, not all pairs
    assert simhash.stars(np.empty(0, int), np.empty(0, np.uint64), 4)[0].size == 0


def test_allocation_covers_the_radius():
    _, ts = simhash.allocate([[0, 5, 50, 500, 5000, 5e4], [0, 1, 2, 3, 4, 5], [0, 9, 9, 9, 9, 9]], 4)
    assert sum(t + 1 for t in ts) == 5 and ts[1] == 4


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [*ODD, base, base.replace("word7 ", "other "), base.upper(), base + " end"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = {i: simhash.majority(simhash.shingle_hashes(t, 4)) for i, t in enumerate(texts)}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 4)
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# Near copies


def brute_near(texts, k=5):
    """Index of the first member of each text's component under exact Jaccard similarity of 0.8 or more."""
    def shingles(t):
        w = t.translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, root = [shingles(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("short, block", [(32, 2048), (2, 5)])
def test_near_copies(spark, monkeypatch, short, block):
    import corpus_pipeline

    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, texts = random.Random(3), list(ODD)
    for n in (6, 40, 90, 200, 400):
        base = [rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(n)]
        for c in range(12):
            copy = list(base)
            for at in rng.sample(range(n), n * (c % 4) // 100):
                copy[at] = "changed"
            texts.append(" ".join(copy[c % 5 :]))
    want, d = brute_near(texts), docs(spark, texts)
    got = {r.doc_id: r.component_id for r in minhash.near_copies(d).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(want) - 20
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()}
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(d).collect()} == got
    assert kept == {i for i, r in enumerate(want) if i == r}
    assert minhash.near_copies(docs(spark, [])).count() == 0


def test_similar_texts_come_from_fingerprints(spark, monkeypatch):
    """SimHash proposes the pairs, MinHash bands aren't asked; pools in blocks lose none."""
    monkeypatch.setattr(minhash, "links", None)
    monkeypatch.setattr(minhash, "band_keys", None)
    monkeypatch.setattr(simhash, "POOL", 30)
    rng, texts = random.Random(5), list(ODD)
    for n in (8, 9, 13, 24, 60, 150, 300):
        base = [f"w{rng.randrange(9999)}" for _ in range(n)]
        for c in range(8):  # truncated to just above and below the threshold, at either end
            texts += [" ".join(base[: n - c * n // 30]), " ".join(base[c * n // 30 :])]
    want = brute_near(texts)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs(spark, texts)).collect()} == dict(enumerate(want))
    assert len(set(want)) < len(want) - 60


# Benchmark decontamination


def shingle_bag(words, k=5):
    from collections import Counter

    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([("short", *words)] if words else [])


def brute_overlaps(texts, items):
    split = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    out = {}
    for i, t in enumerate(texts):
        words = split(t)
        whole = shingle_bag(words)
        for j, item in enumerate(items):
            b = shingle_bag(split(item))
            s, best = sum(b.values()), 0
            if sum((b & whole).values()) < 0.8 * s:  # no window can hold more of the item than the whole text does
                continue
            for at in range(max(1, len(words) - 4)):
                a = shingle_bag(words[at : at + s + 4]) if len(words) >= 5 else shingle_bag(words)
                union = sum((a | b).values())
                best = max(best, sum((a & b).values()) / union if union else 0)
            if best >= 0.8 - 1e-12:
                out[i, j] = round(best, 9)
    return out


def test_overlaps(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (16, 25, 40, 60)] + [["only", "three", "words"]]
    texts = [None, "", " ".join(items[4]), "only three", " ".join(items[3] * 2)]
    for n in range(60):
        item = list(items[n % 4])
        for _ in range(n % 5):
            match rng.randrange(3):
                case 0:
                    item[rng.randrange(len(item))] = "changed"
                case 1:
                    item.insert(rng.randrange(len(item)), "added")
                case _:
                    del item[rng.randrange(len(item))]
        texts.append(", ".join([*text(n), *item, *text(30)]).upper())
    items = [" ".join(i) for i in items] + [None, ""]
    bench = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(items)), (None, "unmatched item", "x")], "item_id bigint, text string, doc_id string")
    want = brute_overlaps(texts, items)
    for radius in (64, decontam.RADIUS):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.overlaps(docs(spark, texts), bench, radius=radius).collect()}
        assert want and got == want
    assert decontam.overlaps(docs(spark, []), bench).count() == 0
    assert decontam.overlaps(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontam.contaminated(docs(spark, texts), bench).count() == len({i for i, _ in want})


def test_overlaps_at_the_end_of_a_text(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (37, 50, 59)]
    texts = [" ".join(before + item[: len(item) - cut]) for item in items for cut in range(13) for before in ([], text(300))]
    items = [" ".join(i) for i in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.overlaps(docs(spark, texts), bench).collect()}
    assert got == brute_overlaps(texts, items) and min(got.values()) < 0.82


def test_window_fingerprints(spark):
    rng = random.Random(12)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 7, 60, 3000)] + [([5, 5, -1] * 30000,), ([3, 3, 3, 9],)]
    df = spark.createDataFrame(rows, "sh array<bigint>").select("sh", decontam.fingerprint(F.col("sh")).alias("fp"), decontam.marked(F.col("sh")).alias("m"))
    for r in df.collect():
        assert r.fp % 2**64 == simhash.majority(np.array([x % 2**64 for x in r.sh], np.uint64))
        assert len(r.m) == len(r.sh) == len(set(r.m)) and set(r.sh) <= set(r.m)
    pair = spark.createDataFrame([([1, 1, 1, 2], [1, 1, 3, 2, 2])], "a array<bigint>, b array<bigint>")
    assert pair.select(F.size(F.array_intersect(decontam.marked(F.col("a")), decontam.marked(F.col("b"))))).first()[0] == 3


def test_overlaps_of_long_and_repeated_passages(spark):
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [text(n) for n in (20, 20, 30, 45)]
    texts = [" ".join(sum((text(rng.randrange(90)) + items[rng.randrange(4)] for _ in range(60)), [])), " ".join(items[0] * 40), " ".join(text(9000) + items[2])]
    items = [" ".join(i) for i in items] + [" ".join(items[0])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.overlaps(docs(spark, texts), bench).collect()}
    assert got == brute_overlaps(texts, items) and {(1, 0), (1, 4), (2, 2)} <= set(got)


def test_overlaps_of_short_items(spark):
    bench = spark.createDataFrame([(1, "Only three, words"), (2, "single"), (3, "a b c d e f")], "item_id bigint, text string")
    texts = ["here are only three words again, only three words", "only three other words", "single", "a b c d e f single", "words three only", None]
    got = {(r.doc_id, r.item_id, r.start, r.similarity, r.size) for r in decontam.overlaps(docs(spark, texts), bench).collect()}
    assert got == {(0, 1, 2, 1.0, 1), (2, 2, 0, 1.0, 1), (3, 2, 6, 1.0, 1), (3, 3, 0, 1.0, 2)}


def test_overlaps_of_null_and_repeated_keys(spark):
    item = "a b c d e f g h i j k l"
    d = spark.createDataFrame([(None, item), (1, "x " + item), (1, item), (2, "z")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.start) for r in decontam.overlaps(d, bench).collect()} == {(None, 0), (1, 0)}


# Byte-level BPE


def reference():
    import tiktoken

    ranks, pattern = tokenizer()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    ranks = tokenizer()[0]
    h = bpe.PerfectHash(ranks)
    assert len(h.keys) == len(ranks) == len(set(h.keys))
    words = list(ranks)[::7] + [b"certainly not a token", b"\xff\xff\xff"]
    assert h.lookup(words) == [ranks.get(w, -1) for w in words]
    assert bpe.PerfectHash({b"a": 0}).lookup([b"a", b"b"]) == [0, -1]


def test_encode_and_decode(spark):
    ranks, pattern, ref = reference()
    texts = [*ODD, "a" * 3000, "ab" * 2000, "  two  spaces\n\n", "it's DON'T 123 4567", "中文 \U0001f600\U0001f600", "!" * 999]
    tokens = bpe.encode(docs(spark, texts), ranks, pattern)
    assert tokens.columns.count("ids") == 1 and set(DOCS.replace(",", "").split()[::2]) - {"text"} <= set(tokens.columns)
    got = {r.doc_id: r for r in bpe.decode(tokens, ranks).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == ref.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    same = {r.doc_id: r for r in bpe.encode(docs(spark, texts).withColumn("text_", F.lit(1)), ranks, pattern, decoded="back").collect()}
    assert all((same[i].ids, bytes(same[i].back)) == (got[i].ids, bytes(got[i].decoded)) for i in got)
    keyless = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "c")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, bytes(r.back)) for r in bpe.encode(keyless, ranks, pattern, decoded="back").collect()) == [(0, b""), (0, b"a b"), (1, b"a b"), (1, b"c")]
    clashing = spark.createDataFrame([(1, "t", "a b")], "doc_id bigint, __text string, text string")
    assert bpe.encode(clashing, ranks, pattern).first()["__text"] == "t"
    assert bpe.encode(docs(spark, []), ranks, pattern).count() == 0
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, pattern)


def test_a_worker_holds_one_encoder_of_bounded_memory(monkeypatch):
    ranks, pattern, ref = reference()

    class Shared:
        reads, value = 0, property(lambda self: (setattr(Shared, "reads", Shared.reads + 1), (ranks, bpe.PerfectHash(ranks)))[1])

    monkeypatch.setattr(bpe, "_held", {})
    monkeypatch.setattr(bpe, "MEMO_BYTES", 100_000)
    rng = random.Random(4)
    for _ in range(3):
        enc = bpe.held_encoder("same", Shared(), pattern)
        for _ in range(20):
            text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 90))) for _ in range(100))
            assert enc.encode([text])[0].tolist() == ref.encode_ordinary(text)
            assert enc.held < 200_000 and max(map(len, enc.memo)) <= bpe.MEMO_CHARS
    assert Shared.reads == 1 and len(bpe._held) == 1
    bpe.held_encoder("other", Shared(), pattern)
    assert list(bpe._held) == ["other"]


def test_merge_takes_the_lowest_rank_leftmost():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    assert bpe.merge(b"aaaab", ranks) == [256, 256, 98]
    assert bpe.merge(b"", ranks) == [] and bpe.merge(b"z", ranks) == [122]


# Token counts


def test_flat_files(spark, tmp_path):
    ranks, pattern, ref = reference()
    d = docs(spark, ODD).coalesce(2)
    path = f"file://{tmp_path}/flat"
    token_counts.write_flat(d, path, ranks, pattern, SEPARATOR)
    for block in (1, 3, 1 << 18):
        found = token_counts.scan(spark, path, SEPARATOR, block=block).where("n_tokens >= 0").orderBy("file", "doc").collect()
        assert sorted(r.n_tokens for r in found) == sorted(len(ref.encode_ordinary(t or "")) for t in ODD) and all(r.terminated for r in found)


def test_names_beside_flat_files(spark, tmp_path):
    ranks, pattern, ref = reference()
    source = f"file://{tmp_path}/docs"
    d = docs(spark, [*ODD, *(f"text number {i} " * (i % 9) for i in range(200))]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    d.repartition(5).write.parquet(source)
    want = sorted((r.doc_id or -1, len(ref.encode_ordinary(r.text or ""))) for r in d.collect())
    for n, table in enumerate((spark.read.parquet(source), d.repartition(3), d.limit(0))):
        path = f"file://{tmp_path}/flat{n}"
        names = token_counts.write_named(table, path, ranks, pattern, SEPARATOR)
        found = token_counts.scan(spark, path, SEPARATOR).withColumn("shard", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
        got = sorted((r.doc_id or -1, r.n_tokens) for r in names.join(found, ["shard", "doc"], "full").collect())
        assert got == (want if n < 2 else [])
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_scan_of_odd_files(spark, tmp_path):
    files = {"none": [], "only": [9], "tail": [1, 2, 9, 3], "open": [1, 2, 3, 4, 5], "gaps": [9, 9, 1, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    for block in (1, 2, 100):
        got = {}
        for r in token_counts.scan(spark, f"file://{tmp_path}", 9, 4, block).orderBy("file", "doc").collect():
            got.setdefault(r.file.rsplit("/")[-1], []).append((r.doc, r.first_token, r.n_tokens, r.terminated))
        assert got == {"only": [(0, 0, 0, True)], "tail": [(0, 0, 2, True), (1, 3, 1, False)], "open": [(0, 0, 5, False)], "gaps": [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 1, True)]}


# Chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "\n", "word ", "é😀", "<\\|", "long " * 300]
    turns = []
    for conv in range(30):
        for turn in range(rng.randint(1, 14)):
            role = ["system", "user", "assistant", "assistant", "user", "odd\nrole\\", None][0 if turn == 0 and conv % 2 else rng.randrange(7)]
            turns.append((conv if conv else None, turn, role, rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 12)))]), conv))
    turns += [(100, None, "user", "a", 1), (100, None, "user", "a", 1)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, window int")
    out = chat.windows(df, 200, 60)
    got, learnt, sizes = {}, {}, {}
    for r in chat.read_windows(out).orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        learnt.setdefault(r.conv_id, []).extend(r.learnt)
        sizes[r.conv_id] = r.window
    want = {}
    for conv, turn, role, text, _ in sorted(turns, key=lambda t: (t[0] or 0, t[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want and max(sizes.values()) > 3
    assert learnt == {k: [t for r, t in v if r == "assistant"] for k, v in want.items()}
    for r in out.where("window > 1").collect():
        if want[r.conv_id][0][0] == "system":
            assert r.text.startswith("<|im_start|>system\n") and r.n_context >= 1
    assert chat.read_windows(chat.windows(df.limit(0))).count() == 0


def test_chat_budget(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", "w " * (10 + i % 7)) for i in range(200)]
    df = spark.createDataFrame([(1, -1, "system", "be brief"), *turns], "conv_id bigint, turn bigint, role string, text string")
    out = chat.windows(df, 120, 30).withColumn("n", F.size(F.split("text", r"<\|im_start\|>")) * 4 + F.regexp_count("text", F.lit(r"\bw\b|be|brief")) - 4)
    assert out.agg(F.max("n")).first()[0] <= 120
    assert out.where("window > 1 and n_context > 1").count() > 0


def test_tokens_in_any_script(spark):
    texts = {"one two, three!": 5, "раз два три": 3, "中文字母": 4, "ไทย": 3, "donaudampfschiff": 2, "": 0, "a\u0301 b": 2, "12 345": 2}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (chat.token_estimate(F.col("t")) - 4).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts


def test_windows_are_full(spark):
    for word in ("word ", "слово ", "字"):
        turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", word * 96) for i in range(300)], "conv_id bigint, turn bigint, role string, text string")
        sizes = chat.windows(turns).select((chat.token_estimate(F.col("text"))).alias("n"), "window").where("window > 1").orderBy("window").collect()
        assert min(r.n for r in sizes[:-1]) > 700 and len(sizes) < 60
    counted = turns.withColumn("own", F.lit(900))
    assert chat.windows(counted, tokens="own").count() == 300


# WARC


def test_warc(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "x" * 100_000, "é\r\n\r\nWARC/1.1", "<p>a</p>"]
    rows = [(i, None if i == 2 else f"http://h/ {i}\r\nX: y", t, i) for i, t in enumerate(html)]
    archive = warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int"), buckets=4)
    got = {int(r.page): r for r in warc.parse(archive.records()).collect()}
    assert sorted(got) == list(range(7))
    for i, t in enumerate(html):
        body = (t or "").encode()
        last = max(j for j, u in enumerate(html) if (u or "") == (t or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", str(last)))
    raw = {int(re.search(rb"<urn:page:=(\d+):", r.record)[1]): bytes(r.record) for r in archive.records().collect()}
    assert raw[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw[5].endswith("é\r\n\r\nWARC/1.1\r\n\r\n".encode())
    assert int(re.search(rb"Content-Length: (\d+)", raw[5])[1]) == len(raw[5].split(b"\r\n\r\n", 1)[1]) - 4
    assert spark.table(archive.payloads).count() == 4
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).records().count() == 0


def test_warc_keeps_repeated_and_null_keys(spark, tmp_path):
    rows = [(6, "u", "a"), (6, "u", "a"), (6, "v", "b"), (None, "w", "a"), (None, "x", "only"), (None, "x", "only"), (7, "y", "b")]
    archive = warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted((r.page or "", r.payload_bytes, r.record_type, r.refers_to or "") for r in warc.parse(archive.records()).collect())
    assert got == [("", 1, "revisit", "6"), ("", 4, "response", ""), ("", 4, "revisit", ""), ("6", 1, "response", ""), ("6", 1, "revisit", "6"), ("6", 1, "revisit", "7"), ("7", 1, "response", "")]
    archive.write_files(f"file://{tmp_path}/warc")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert sorted(x for x in re.split(rb"(?<=\r\n\r\n)(?=WARC/1.1)", raw)) == sorted(bytes(r.record) for r in archive.records().collect())
    keys = warc.archive(spark.createDataFrame([("a b:=<>", "u", "z"), ("", "u", "z"), (None, "u", "z")], "page_id string, url string, html string"))
    assert {(r.page, r.refers_to) for r in warc.parse(keys.records()).collect()} == {("a b:=<>", None), ("", "a b:=<>"), (None, "a b:=<>")}


def test_warc_headers_of_any_length_and_kind(spark):
    url = "http://h/" + "é" * 50_000
    rows = [(i, url, t) for i, t in enumerate(["<p>a</p>", "<p>a</p>", "b\r\n\r\nc"])]
    archive = warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), buckets=4)
    got = {int(r.page): (r.payload_bytes, r.record_type, r.refers_to) for r in warc.parse(archive.records()).collect()}
    assert got == {0: (8, "revisit", "1"), 1: (8, "response", None), 2: (6, "response", None)}
    body = b"a\r\n\r\nb"
    block = b"HTTP/1.0 404 Not Found\r\nServer: other\r\nX: " + b"y" * 9000 + b"\r\n\r\n" + body
    sha = base64.b32encode(hashlib.sha1(body).digest())
    foreign = b"WARC/1.0\r\ncontent-length: %d\r\nContent-Type: application/http\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:%s\r\n\r\n%s\r\n\r\n" % (len(block), sha, block)
    r = warc.parse(spark.createDataFrame([(bytearray(foreign), len(body))], "record binary, payload_bytes bigint")).first()
    assert (r.page, r.payload_digest, r.record_type) == (None, sha.decode(), "response")


# Classifiers


def held_out(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def labelled(spark, n=600):
    rng = random.Random(1)
    common_words = [f"w{i}" for i in range(400)]
    texts, toxic, good = [], [], []
    for i in range(n):
        words = rng.choices(common_words, k=rng.randint(20, 200))
        toxic.append(i % 5 == 0)
        good.append(i % 4 != 1)
        if toxic[-1]:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "rotten"])
        texts.append(" ".join(words) if good[-1] else " ".join(w.upper() + "!!" for w in words))
    labels = spark.createDataFrame([(i, int(good[i]), int(toxic[i])) for i in range(0, n)] + [(0, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs(spark, texts), labels, toxic, good


def test_toxicity(spark):
    d, labels, toxic, _ = labelled(spark)
    fold = common.fold(F.col("doc_id"), 3)
    model = toxicity.train(d, labels, fold != 1)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    hits = [(got[i] >= 0.7) == t for i, t in enumerate(toxic) if held_out(i, 3, 1)]
    assert sum(hits) / len(hits) > 0.95 and all(0 <= s <= 1 for s in got.values())
    odd = {r.doc_id: r.score for r in toxicity.score(docs(spark, ODD), model).collect()}
    assert len(odd) == len(ODD) and odd[0] == odd[1] and odd[0] < 0.7
    assert toxicity.score(docs(spark, []), model).count() == 0
    nothing = toxicity.train(d, labels.limit(0), fold != 1)
    assert 0 <= toxicity.score(docs(spark, ["a"]), nothing).first().score <= 1


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    row = lambda on: (np.array([*on, *rng.integers(10, 500, 20)], np.int32), np.ones(20 + len(on), np.float32))
    positive, rest = [row([1]) for _ in range(50)], [row([1] if i % 5 == 0 else []) for i in range(400)]
    model = toxicity.fit(positive, rest, 0.2)
    assert model.weight[1] > 1 and model.scores([row([1])])[0] > 0.7 > model.scores([row([])])[0]


@pytest.mark.parametrize("prior", [0.2, 0.6])
def test_steps_follow_the_risk(prior):
    """The first step against numeric gradients; later ones keep the corrected part from falling far below zero."""
    rng = np.random.default_rng(1)
    row = lambda on: (np.array([*on, *rng.choice(np.arange(10, 60), 5, False)], np.int32), np.ones(5 + len(on), np.float32))
    positive, rest = [row([1, 2]) for _ in range(60)], [row([1] if i % 4 == 0 else [2] if i % 7 == 0 else []) for i in range(300)]
    used = toxicity.standing_out(positive, rest)
    x_p, x_u = (np.array([[v[ids == f].sum() for f in used] for ids, v in rows]) for rows in (positive, rest))
    bias = np.log(prior / (1 - prior))

    def corrected(w):
        return np.logaddexp(0, x_u @ w + bias).mean() - prior * np.logaddexp(0, x_p @ w + bias).mean()

    def risk(w):
        return prior * np.logaddexp(0, -(x_p @ w + bias)).mean() + corrected(w)

    e = np.eye(len(used)) * 1e-6
    grad = np.array([(risk(d) - risk(-d)) / 2e-6 for d in e])
    w = toxicity.fit(positive, rest, prior, epochs=1, rate=0.1).weight[used]
    assert w == pytest.approx(-0.1 * grad / np.sqrt(grad**2 + 1e-8), abs=2e-3)
    model = toxicity.fit(positive, rest, prior, epochs=3000)
    z_p, z_u = x_p @ model.weight[used] + model.bias, x_u @ model.weight[used] + model.bias
    assert np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean() > -0.02


def test_prior_without_negatives():
    rng = np.random.default_rng(2)
    row = lambda toxic: (np.unique(np.concatenate((rng.integers(100, 900, 30), rng.integers(0, 20, 4) if toxic else []))).astype(np.int32), None)
    made = lambda n, share: [(ids, np.ones(len(ids), np.float32)) for ids, _ in (row(rng.random() < share) for _ in range(n))]
    for share in (0.05, 0.2, 0.5):
        assert toxicity.estimated_prior(made(400, 1), made(3000, share)) == pytest.approx(share, rel=0.35)
    assert toxicity.estimated_prior(made(1, 1), made(1, 0)) == 0.05


def test_samples_are_bounded_whatever_the_ids_repeat(spark):
    d = spark.createDataFrame([(i % 4, f"text {i}", i) for i in range(400)] + [(None, "x", 1)], "doc_id bigint, text string, h int")
    chosen = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id bigint, mark string")
    got = common.sampled(d, chosen, 7, "doc_id", "text")
    assert got.count() == 7 and set(got.columns) == {"h", "text", "mark"}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id bigint, quality int, toxic int")
    assert len(quality.train(d, labels, F.lit(True), sample=6).labels) == 6
    model = toxicity.train(d, labels, F.lit(True), 5, 5)
    assert 0 < model.prior < 1 and toxicity.score(d, model).count() == 401


def test_quality(spark):
    d, labels, _, good = labelled(spark)
    model = quality.train(d, labels, common.fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    hits = [(got[i] >= 0.3) == g for i, g in enumerate(good) if held_out(i, 5, 0)]
    assert sum(hits) / len(hits) > 0.95
    odd = {r.doc_id: r.score for r in quality.score(docs(spark, ODD), model).collect()}
    assert len(odd) == len(ODD) and odd[0] == odd[1] == pytest.approx(model.prior) and all(0 <= s <= 1 for s in odd.values())
    assert quality.score(docs(spark, []), quality.train(docs(spark, []), labels.limit(0), F.lit(True))).count() == 0
    assert quality.document_frequencies(docs(spark, ["a b", "a", None]))[0] == 3


def test_votes_are_exact():
    rng = np.random.default_rng(4)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    model = quality.Model(np.ones(quality.BUCKETS + quality.SHAPES, np.float32), rng.standard_normal((quality.BUCKETS + quality.SHAPES, 8)).astype(np.float32), unit(rng.standard_normal((100, 8))), rng.integers(0, 2, 100).astype(float), 0.5, 7)
    rows = [(np.unique(rng.integers(0, 900, 30)), np.ones(30, np.float32)) for _ in range(20)]
    rows = [(i, n[: len(i)]) for i, n in rows]
    for score, x in zip(model.scores(rows, block=6), model.project(rows)):
        near = sorted(((float(x @ v), k) for v, k in zip(model.vectors, model.labels)), reverse=True)[:7]
        w = [max(c, 0) for c, _ in near]
        assert score == pytest.approx(sum(a * k for a, (_, k) in zip(w, near)) / sum(w), abs=1e-5)


# Language


def greedy_phrases(text, source):
    n, i = 1, 0
    start = 0
    while i < len(text):
        if text[start : i + 1] in source:
            i += 1
        elif start == i:  # a letter that the source lacks
            n, i, start = n + 1, i + 1, i + 1
        else:
            n, start = n + 1, i
    return n


@pytest.mark.parametrize("dense, few", [(94, 16), (2, 16), (94, 0), (3, 1)])
def test_cross_parsing(monkeypatch, dense, few):
    monkeypatch.setattr(langid, "DENSE", dense)  # so that letters are rare
    monkeypatch.setattr(langid, "FEW", few)
    rng = random.Random(6)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = {"aa": [text(300, "abcd ")], "bb": [text(300, "bcde ")], "zh": [text(400, "中文字母大小abc ")]}
    model = langid.build(samples)
    encoder = model.encoder()
    source = {k: langid.squeeze(np.concatenate([np.append(encoder[langid.code_points(t)], 0) for t in v])).tolist() for k, v in samples.items()}
    texts = [langid.squeeze(encoder[langid.code_points(text(n, "abcdefé中文小  "))]) for n in [1, 2, 50, 400, 0, 5000, *range(3, 40)]]
    chars = lambda codes: "".join(chr(c + 97) for c in codes)
    got = model.phrases(texts)
    for k, language in enumerate(model.languages):
        assert got[k].tolist() == [greedy_phrases(chars(t.tolist()), chars(source[language])) if len(t) else 0 for t in texts]


def test_sample_of_languages(spark, monkeypatch):
    rows = [(1, "the cat and the dog " * 3000, "en"), (2, "le chat et le chien ", "fr"), *((3, "das ist gut so ", "de") for _ in range(300)), (None, "der hund ist da ", "de"), (4, None, "it"), (5, " 1 ", "pt")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), rows=20, chars=500)
    assert model.languages == ["de", "en", "fr"]  # also a language that has long texts alone
    assert all(2 ** a.bits <= 522 for a in model.automata)  # repeated ids don't enlarge the sample
    assert [x[0] for x in model.predict(["a dog and a cat", "", "ist er da"], model.encoder())] == ["en", "und", "de"]
    monkeypatch.setattr(langid, "TABLE_BYTES", 50_000)
    many = langid.build({str(i): ["abc " * 500] for i in range(30)})
    assert sum(a.table.nbytes for a in many.automata) <= 50_000
    same = langid.build({"b": ["xyz"], "a": ["xyz"]})
    assert same.predict(["xyz"], same.encoder()) == [("a", 0.5)]  # a tie
    assert langid.slices(__import__("pyarrow").array(["abc", None, "", "x" * 20, "y"]), 8) == [(0, 3), (3, 4), (4, 5)]


def test_language(spark):
    english, french = "the cat sat on the mat and then it went away with her ", "le chat est sur le tapis et puis elle est partie avec lui "
    rows = [(i, (english if i % 2 else french) * (1 + i % 60), "en" if i % 2 else "fr", i) for i in range(40)] + [(100, None, "en", 1), (101, " 12 !!", "fr", 1), (102, "the mat " * 3000, None, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int")
    model = langid.train(d, common.fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "fr") for i in range(40)) and got[102][0] == "en"
    assert got[100] == got[101] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(d.limit(0), model).count() == 0
    nothing = langid.train(d.limit(0), F.lit(True))
    assert langid.predict(d, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


# Shared helpers


def test_rows_are_told_apart(spark, tmp_path):
    d = docs(spark, ODD).unionByName(docs(spark, ODD))
    rows = common.with_rows(d)
    assert rows.select(common.ROW).distinct().count() == 2 * len(ODD)
    dropped = common.staged(rows.where("doc_id < 4").select(common.ROW), "t")
    left = common.without_rows(rows, dropped)
    assert left.columns == d.columns and left.count() == 2 * (len(ODD) - 4)
    d.repartition(3).write.parquet(f"file://{tmp_path}/t")
    files = spark.read.parquet(f"file://{tmp_path}/t")
    assert sorted(map(repr, common.with_rows(files).collect())) == sorted(map(repr, common.with_rows(files).collect()))
    assert common.with_rows(files.where("doc_id = 3").select("text")).select(common.ROW).distinct().count() == 2
    twice = files.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    assert common.with_rows(twice).select(common.ROW).distinct().count() == 4 * len(ODD)


def test_broadcasts_are_measured_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], [("y" * 500,)])], "a string, b array<int>, c array<struct<s: string>>")
    hinted = lambda limit: "ResolvedHint" in common.small(df, limit)._jdf.queryExecution().analyzed().toString()
    assert hinted(2000) and not hinted(1500)
