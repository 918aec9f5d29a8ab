"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, exact_dedup, langid, quality, simhash, token_counts, toxicity, warc
from .common import fold, new_path, table

#: Vocabulary of the encoding and counting queries, and the free id that ends documents in flat files.
VOCABULARY, SEPARATOR = "byte_bpe_multi_50k.tiktoken", 50256
TOXIC_AT, GOOD_AT = 0.7, 0.3


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches against one index, the lower half of the ids first, so that keep_id is the smallest of all."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, expected=docs.count())
    found = index.ingest(docs, batches=2)
    index.drop()  # what it found is written
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = [spark.range(1).select(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), said.alias("text")) for i, role in enumerate(("user", "assistant"))]
    for e in extra:
        turns = turns.unionByName(e)
    read = chat.read_windows(chat.windows(turns))
    one = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    parts = read.select("conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", one), "").alias("said"), F.array_join("learnt", "").alias("learnt"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    learnt = F.array_join("w.learnt", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, found in flat files alone; which document is whose was written beside them."""
    path = new_path(spark, "flat")
    names = token_counts.write_named(table(spark, sf_dir, "documents"), path, *tokenizer(), SEPARATOR)
    found = token_counts.scan(spark, path, SEPARATOR).withColumn("shard", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    both = names.join(found.select("shard", "doc", "n_tokens"), ["shard", "doc"], "full")
    whole = F.when(F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is missing from the flat files")))
    return both.select("doc_id", whole.alias("n_tokens"), "shard", F.col("doc").alias("position"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 9))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.archive(table(spark, sf_dir, "pages"))
    found = warc.parse(archive.records())
    return found.select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_chat_formatting, op4_token_counts, op5_decontamination, op6_simhash_near_dedup, op7_quality, op8_warc, op9_byte_bpe, op10_language_id)}

_TEXT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_TEXT}) AS h FROM documents),
        g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
    "op3_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        spaced AS (SELECT *, regexp_replace(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]', ' ', 'g') AS plain FROM t),
        n AS (SELECT *, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) + len(regexp_extract_all(plain, '[\p{L}\p{M}\p{N}]{1,8}')) + len(regexp_extract_all(plain, '[^\p{L}\p{M}\p{N}\t\n\x0B\f\r ]')) + 4 AS own,
            row_number() OVER w AS i FROM spaced WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        r AS (SELECT *, first_value(role) OVER w = 'system' AS led, first_value(own) OVER w AS first_n, first_value(text) OVER w AS first_text FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        s AS (SELECT *, greatest(2, 1024 - 192 - CASE WHEN led THEN first_n ELSE 0 END) AS room, CASE WHEN i = 1 AND led THEN 0 ELSE own END AS n FROM r),
        b AS (SELECT *, n > room / 2 AS big, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s),
        m AS (SELECT *, floor(earlier / (room - coalesce(max(CASE WHEN NOT big THEN n END) OVER (PARTITION BY conv_id), 0))) AS stretch FROM b),
        c AS (SELECT *, i > 1 AND (stretch <> lag(stretch) OVER w OR big OR lag(big) OVER w) AS cut FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        p AS (SELECT *, 1 + sum(cut::INT) OVER (PARTITION BY conv_id ORDER BY i) AS span FROM c),
        e AS (SELECT *, max(earlier + n) OVER (PARTITION BY conv_id, span) AS ending, max(span) OVER (PARTITION BY conv_id) AS spans,
            12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS chars,
            12 + 6 + 1 + length(replace(replace(first_text, '\', '\\'), '<|', '<\|')) + 11 AS system_chars FROM p)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars + CASE WHEN span < spans AND ending - earlier <= 192 AND NOT (i = 1 AND led) THEN chars ELSE 0 END + CASE WHEN cut AND led THEN system_chars ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_decontamination": r"""
        WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
        iw AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
        i AS (SELECT item_id, row_number() OVER (ORDER BY item_id, w) AS ino, w, len(w) - 4 AS s FROM iw WHERE len(w) >= 5),
        ih AS (SELECT ino, item_id, s, h, count(*) AS n FROM (SELECT *, unnest(list_transform(range(1, s + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS h FROM i) GROUP BY ALL),
        dh AS (SELECT doc_id, len(w) - 4 AS total, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS h FROM dw WHERE len(w) >= 5),
        hits AS (SELECT dh.doc_id, dh.total, dh.pos, dh.h, ih.ino, ih.item_id, ih.s, ih.n FROM dh JOIN ih USING (h)),
        win AS (SELECT a.doc_id, a.item_id, a.ino, a.s, a.pos, least(a.s, a.total - a.pos) AS size, b.h, least(count(*), any_value(b.n)) AS c FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.ino = b.ino AND b.pos BETWEEN a.pos AND a.pos + a.s - 1 GROUP BY ALL),
        best AS (SELECT doc_id, item_id, pos, size, sum(c)::DOUBLE / (size + s - sum(c)) AS similarity FROM win GROUP BY doc_id, item_id, ino, s, pos, size HAVING sum(c)::DOUBLE / (size + s - sum(c)) >= 0.8 - 1e-12),
        few AS (SELECT dw.doc_id, iw.item_id, p AS pos, 1 AS size, 1e0 AS similarity FROM (SELECT *, unnest(range(0, len(w))) AS p FROM dw) dw JOIN iw ON len(iw.w) BETWEEN 1 AND 4 AND dw.w[p + 1:p + len(iw.w)] = iw.w)
        SELECT doc_id, item_id, CAST(pos AS INTEGER) AS start, round(similarity, 9) AS similarity, CAST(size AS INTEGER) AS size FROM (SELECT * FROM best UNION ALL SELECT * FROM few) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos) = 1""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT *, sha1(body) AS hex FROM p),
        d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS back, max(page_id) OVER (PARTITION BY body) AS last FROM d)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN back = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN back > 1 THEN last END AS refers_to FROM r""",
}
