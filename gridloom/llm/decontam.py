"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Words are the runs of letters and digits in lower case; shingles have K words. Windows have the sizes of the items, in
shingles (fewer at the end of the text), and start where the text could hold enough of any items of that size: a
similarity of 0.8 needs 0.8 of an item's S shingles, so a window in which fewer shingles belong to items can't match.
Each window gets a SimHash; a multi-index over RADIUS + 1 blocks of its bits finds every item of its size within RADIUS;
and the exact weighted Jaccard similarity (shingles weighted by their counts) decides. Items of fewer than K words are
looked up as they are.

A similarity of exactly 0.8 moves about 10 of 64 bits, so a window at that bound is missed by RADIUS in a few cases of a
hundred, one of 0.9 in a few of a thousand, an equal one never. A radius of 64 compares every window with all items of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, small, staged, text_or_empty, with_rows

K, THRESHOLD, RADIUS = 5, 0.8, 14


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where the optimiser copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: str | Column, k: int = K) -> Column:
    """Hashes of the k-word shingles of a text, in order; fewer words: one of the whole sequence; none: no shingle."""

    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.slice(h, F.lit(1), n - (k - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))
        few = F.when(n > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(h.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= k, many).otherwise(few)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def runs_of(text: str | Column, n: int) -> Column:
    """Hashes of each n words in a row, equal to the shingle of a text that has these words alone."""

    def of(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit("short"), F.array_join(F.slice(h, i + 1, n).cast("array<string>"), " ")))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def fingerprint(sh: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if it is in over half of them.

    Sixteen sums count the bits, four 16-bit counters in each; arrays too long for those are counted bit by bit.
    """
    at = lambda x, b: F.call_function("shiftrightunsigned", x, b)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.aggregate(sh, F.lit(0).cast("bigint"), lambda n, x: n + at(x, b).bitwiseAND(F.lit(0x0001000100010001))))
    few = let(lanes, lambda n: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: at(F.get(n, b % 16), F.floor(b / 16).cast("int") * 16).bitwiseAND(F.lit(0xFFFF))))
    many = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(sh, F.lit(0).cast("bigint"), lambda n, x: n + at(x, b).bitwiseAND(F.lit(1))))
    counts = F.when(F.size(sh) < 1 << 16, few).otherwise(many)
    bits = F.transform(counts, lambda n, b: F.when(n * 2 > F.size(sh), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column, radius: int) -> Column:
    """(block number, its bits) for radius + 1 blocks: fingerprints within the radius agree in one of them."""
    n = radius + 1 if radius < 64 else 1
    edge = [64 * i // n for i in range(n + 1)] if radius < 64 else [0, 0]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)).cast("bigint").alias("bits")) for i in range(n)])


def marked(sh: Column) -> Column:
    """The hashes with each repeat told apart by its number, so that plain intersections count the weights."""
    def of(order: Column) -> Column:
        return F.transform(order, lambda x, i: let(i + 1 - F.array_position(order, x), lambda nth: F.when(nth > 0, F.xxhash64(x, nth)).otherwise(x)))

    return F.when(F.size(F.array_distinct(sh)) == F.size(sh), sh).otherwise(let(F.array_sort(sh), of))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: key, item, start, similarity, size.

    start is the first shingle (its word) of the best window, the earliest among equals; size counts its shingles. Null
    and empty texts contain nothing, and items without a word match nothing. Items shorter than k words count as one
    shingle of their own length and match where a text holds just these words in order. Rows that repeat a key are taken
    as one document's alternatives: the best window of any of them counts. Null keys (and null items) are one key (one
    item), reported under null. Other columns are ignored.
    """
    rows = with_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("t")))
    items = benchmark.select(F.col(item).alias("item"), F.size(words(item_text)).alias("n"), shingles(item_text, k).alias("sh")).where(F.size("sh") > 0).distinct()
    items = staged(items.withColumn("ino", F.monotonically_increasing_id()), "benchmark")
    short = items.where(F.col("n") < k).select("item", "n", F.get("sh", F.lit(0)).alias("h"))
    # A window cut off by the end has m < s shingles; c of them shared give c / (m + s - c) <= c / s.
    s = F.size("sh")
    items = staged(items.where(F.col("n") >= k).select("ino", "item", "sh", s.alias("s"), F.ceil(threshold * s - 1e-9).cast("int").alias("need"), fingerprint(F.col("sh")).alias("ifp")), "items")
    vocabulary = small(items.select("s", "need", F.explode("sh").alias("h")).distinct())
    spread = rows.select(ROW, F.posexplode(shingles("t", k)).alias("pos", "h"))
    # For each size of items: the positions at which a document shares a shingle with any; at most one for each word.
    hits = spread.join(vocabulary, "h").groupBy(ROW, "s", "need").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    at, need = F.col("at"), F.col("need")
    # A window from a hit holds enough hits only if the need-th hit from there lies within it.
    begin = F.filter(F.transform(at, lambda p, i: F.when(F.get(at, i + need - 1) < p + F.col("s"), p)), lambda p: p.isNotNull())
    starts = staged(hits.select(ROW, "s", F.explode(begin).alias("pos")), "starts")
    held = staged(rows.join(small(starts.select(ROW).distinct()), ROW, "left_semi").select(ROW, "key", shingles("t", k).alias("sh")), "held")
    window = F.slice("sh", F.col("pos") + 1, F.col("s"))
    windows = starts.join(held, ROW).select(ROW, "s", "pos", window.alias("w")).select(ROW, "s", "pos", fingerprint(F.col("w")).alias("fp"))
    windows = staged(windows, "windows")
    # Copies of a passage share its fingerprint: each is probed once.
    probe = windows.select("s", "fp").distinct().select("s", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("s", "fp", "b.*")
    index = items.select("ino", "s", "ifp", F.explode(blocks(F.col("ifp"), radius)).alias("b")).select("ino", "s", "ifp", "b.*")
    near = probe.join(small(index), ["s", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    near = staged(near.select("s", "fp", "ino").distinct(), "near")
    # Of an item that is found, all windows around the place are compared: the best may lie beyond the radius itself.
    cell = F.floor(F.col("pos") / F.col("s"))
    found = windows.join(small(near), ["s", "fp"]).select(ROW, "ino", "s", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    pairs = starts.withColumn("cell", cell).join(found, [ROW, "s", "cell"]).drop("s", "cell")
    pairs = pairs.join(small(items.select("ino", "item", "s", marked(F.col("sh")).alias("theirs"))), "ino").join(held, ROW)
    pairs = pairs.select("key", "item", "s", "theirs", "pos", window.alias("w"))
    shared = F.size(F.array_intersect(marked(F.col("w")), F.col("theirs")))
    scored = pairs.select("key", "item", "s", "pos", F.size("w").alias("size"), shared.alias("common"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("size") + F.col("s") - F.col("common"))).where(F.col("similarity") >= threshold - 1e-12)
    scored = scored.select("key", "item", "pos", "size", "similarity")
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # at most k - 1 of them
        runs = rows.select("key", F.posexplode(runs_of("t", n)).alias("pos", "h"))
        same = runs.join(small(short.where(F.col("n") == n).select("item", "h")), "h")
        scored = scored.unionByName(same.select("key", "item", "pos", F.lit(1).alias("size"), F.lit(1.0).alias("similarity")))
    best = staged(scored.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("pos")).alias("back"), "size")).alias("m")), "overlaps")
    discard(starts, held, windows, near)
    return best.select(F.col("key").alias(key), F.col("item").alias(item), (-F.col("m.back")).alias("start"), "m.similarity", "m.size")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Ids of the documents that contain an item, one column."""
    key = options.get("key", "doc_id")
    return overlaps(docs, benchmark, **options).select(key).distinct()
