"""The registered queries over whole tables, against SQL, brute force or held-out labels; and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_near, brute_overlaps, greedy_phrases

import __spark_entry__
import corpus_pipeline
from gridloom.llm import common, langid, quality, simhash, toxicity
from gridloom.llm.queries import GOOD_AT, ORACLE, QUERIES, tokenizer

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def read(sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoding():
    import tiktoken

    ranks, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    def rows(df):
        plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
        return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)

    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLE[name]).df()
    assert set(ours.columns) == set(theirs.columns) and rows(ours) == rows(theirs)


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = pd.concat([read(SMALL, "conversations"), pd.DataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], columns=["conv_id", "turn", "role", "text"])])
    got = {r.conv_id: r for r in QUERIES["op3_chat_formatting"](spark, SMALL).collect()}
    groups = dict(list(turns.sort_values("turn").groupby("conv_id")))
    assert set(got) == set(groups)
    for conv, g in groups.items():
        learnt = "".join(t or "" for r, t in zip(g.role, g.text) if r == "assistant")
        said = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text))
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(g), sha(said), len(learnt), sha(learnt)) and r.formatted_chars > len(learnt)


def test_tokens(spark):
    texts, ref = read(SMALL, "documents").set_index("doc_id").text, encoding()
    ids = {i: ref.encode_ordinary(t or "") for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, SMALL).collect()} == {i: len(x) for i, x in ids.items()}
    for r in QUERIES["op9_byte_bpe"](spark, SMALL).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(",".join(map(str, ids[r.doc_id]))), sha(texts[r.doc_id]))


def test_overlaps(spark):
    d, items = read(SMALL, "documents"), read(SMALL, "benchmark")
    d = d[d.text.str.len() < 6000]  # brute force on the shorter documents; the query runs on all
    want = brute_overlaps(d.text.tolist(), items.text.tolist())
    want = {(d.doc_id.iloc[i], items.item_id.iloc[j]): s for (i, j), s in want.items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    assert {k: v for k, v in got.items() if k[0] in set(d.doc_id)} == want


def test_near_duplicates(spark):
    texts = read(MEDIUM, "documents").set_index("doc_id").text
    fps = {i: simhash.majority(simhash.shingle_hashes(t, 4)) for i, t in texts.items()}
    got = {r.doc_id: r for r in QUERIES["op6_simhash_near_dedup"](spark, MEDIUM).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 4)


@pytest.mark.parametrize("name, label, n, k, least", [("op1_toxicity", "toxic", 3, 1, 0.75), ("op7_quality", "quality", 5, 0, 0.75)])
def test_held_out(spark, name, label, n, k, least):
    got, labels = QUERIES[name](spark, MEDIUM).toPandas().set_index("doc_id"), read(MEDIUM, "labels").set_index("doc_id")
    assert len(got) == len(read(MEDIUM, "documents")) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % n == k) for i, h in got.held_out.items())
    x = got[got.held_out].join(labels, how="inner")
    rare = 1 if label == "toxic" else 0
    assert (x.predicted == x[label])[x[label] == rare].mean() >= least and (x.predicted == x[label])[x[label] != rare].mean() >= 0.97


def test_languages(spark):
    got, lang = QUERIES["op10_language_id"](spark, MEDIUM).toPandas().set_index("doc_id"), read(MEDIUM, "documents").set_index("doc_id").lang
    x = got.join(lang)
    assert len(got) == len(lang) and got.score.between(0, 1).all() and (x.lang_pred == x.lang)[x.held_out].mean() >= 0.98


def test_languages_against_plain_parsing(spark):
    """The query's predictions and scores from greedy longest matches over plain strings."""
    fold = common.fold(F.col("doc_id"), 3)
    frame = common.table(spark, SMALL, "documents")
    d = frame.where((fold != 1) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id").alias("h")).toPandas().sort_values("h")
    samples = {lang: [t[: langid.CHARS] for t in g.text[: langid.ROWS]] for lang, g in d.groupby("lang")}
    model = langid.build(samples)
    encoder, source = model.encoder(), {}
    codes = lambda t: "".join(chr(x + 97) for x in langid.squeeze(encoder[langid.code_points(t)]).tolist())
    for lang, texts in samples.items():
        kept, total = [], 0
        for t in texts:
            if total < langid.CHARS:
                kept.append(t[: langid.CHARS - total])
                total += len(kept[-1])
        source[lang] = "a".join(codes(t) for t in kept) + "a"
        while "aa" in source[lang]:
            source[lang] = source[lang].replace("aa", "a")
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, SMALL).collect()}
    some = read(SMALL, "documents")
    for r in some[some.text.str.len() < 3000].itertuples():
        if not codes(r.text).strip("a"):
            assert got[r.doc_id].lang_pred == "und"
            continue
        entropy = sorted((greedy_phrases(codes(r.text), s) * float(np.log2(len(s))), lang) for lang, s in source.items())
        assert got[r.doc_id].lang_pred == entropy[0][1] and got[r.doc_id].score == pytest.approx(entropy[1][0] / (entropy[0][0] + entropy[1][0]))


def test_votes_and_toxicity_against_plain_sums(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    texts = read(SMALL, "documents").set_index("doc_id").text
    model, counts = quality.train(docs, labels, common.fold(F.col("doc_id"), 5) != 0), quality.Counts()
    got = {r.doc_id: r.score for r in QUERIES["op7_quality"](spark, SMALL).collect()}
    for i, t in texts.items():
        x = np.zeros(model.axes.shape[1])
        for b, n in zip(*counts(t)):
            x += (1 + np.log(n)) * model.idf[b] * (quality.SHAPE_WEIGHT if b >= quality.BUCKETS else 1) * model.axes[b]
        near = sorted(((float(x @ v) / max(np.linalg.norm(x), 1e-12), k) for v, k in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(cos, 0) for cos, _ in near]
        assert got[i] == pytest.approx(sum(a * k for a, (_, k) in zip(w, near)) / sum(w) if sum(w) else model.prior, abs=2e-3)
    model, features = toxicity.train(docs, labels, common.fold(F.col("doc_id"), 3) != 1), toxicity.Features()
    got = {r.doc_id: r.score for r in QUERIES["op1_toxicity"](spark, SMALL).collect()}
    for i, t in texts.items():
        z = model.bias + sum(float(model.weight[f]) * float(v) for f, v in zip(*features.of(t)))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_pipeline(spark):
    """Every stage against brute force; the classifier's own scores decide in both."""
    sf, docs = SMALL, read(SMALL, "documents").set_index("doc_id")
    frame = common.table(spark, sf, "documents")
    model, counts = quality.train(frame, common.table(spark, sf, "labels"), F.lit(True)), quality.Counts()
    kept = docs[[s >= GOOD_AT for s in model.scores([counts(t) for t in docs.text])]]
    kept = kept.groupby(kept.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)).apply(lambda g: g.loc[[g.index.min()]]).droplevel(0)
    kept = kept.sort_index()
    kept = kept[[i == r for i, r in enumerate(brute_near(kept.text.tolist()))]]
    items = read(sf, "benchmark").text.tolist()
    leaks = {i for i, _ in brute_overlaps(kept.text.tolist(), items)}
    kept = kept[[i not in leaks for i in range(len(kept))]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(kept.index) and 0 < len(got) < len(docs)
    ref = encoding()
    assert all(got[i].ids == ref.encode_ordinary(t) and got[i].n_tokens == len(got[i].ids) for i, t in kept.text.items())


def test_stages_take_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 1), (3, "same words here", "en", "s", 1), (4, "same  words here", None, None, None), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SMALL)
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= d.count()


def test_exact_copies_go_row_by_row(spark):
    rows = [(1, "same", "en", "s", 1), (1, "same", "en", "s", 1), (2, "same", "en", "s", 1), (2, "unique", "en", "s", 1), (None, "same", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, SMALL).collect()) == [(1, "same"), (2, "unique")]
    near = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == [(1, "same"), (2, "unique")]
    item = common.table(spark, SMALL, "benchmark").first().text
    leaks = spark.createDataFrame([(1, f"a b c {item} d", "en", "s", 1), (1, "clean words", "en", "s", 1), (None, item, "en", "s", 1), (None, "clean too", "en", "s", 1)], docs.schema)
    assert {r.text for r in corpus_pipeline.drop_contaminated(spark, leaks, SMALL).collect()} == {"clean words", "clean too"}
