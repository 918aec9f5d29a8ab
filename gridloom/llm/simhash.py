"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints form one class; only one representative per
class is searched. The 64 bits are dealt to partitions so that correlated bits share one, and a dynamic programme
gives each partition its own threshold t_i with sum(t_i + 1) = radius + 1: two fingerprints within the radius then
differ by t_i bits or fewer in some partition i. A representative is probed under every pattern of t_i ignored bits,
so that such a pair meets in a bucket; each bucket verifies its members on all 64 bits and emits a spanning star, not
its pairs. Components follow by alternating large and small stars.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small, staged

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Buckets over this many fingerprints are split into blocks, and pairs of blocks are verified by separate tasks.
BLOCK = 8192
#: Runs up to this length are verified by shifts over the whole batch.
SHORT = 32
#: Cost of shuffling one probe, in verified candidate pairs.
PROBE_COST = 150


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the text in lower-case A-Z, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """key, fp (bigint with the fingerprint's bits) for each row; no words: zero."""

    def run(batches):
        for batch in batches:
            fp = np.array([majority(shingle_hashes(t, k)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def bit_statistics(reps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j, over all of reps. The driver gets at most 32 small rows."""

    def part(batches):
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(f), 8192):
                bits = np.unpackbits(f[i : i + 8192].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(f)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.tobytes()], pa.binary())], ["n", "both"])

    def total(batches):
        n, both = 0, np.zeros(4096)
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for b in batch.column(1).to_pylist():
                both += np.frombuffer(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.tobytes()], pa.binary())], ["n", "both"])

    parts = reps.select("fp").mapInArrow(part, "n bigint, both binary")
    rows = parts.repartition(8).mapInArrow(total, "n bigint, both binary").collect()
    return sum(r.n for r in rows), sum((np.frombuffer(r.both) for r in rows), np.zeros(4096)).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits to `parts` partitions of nearly equal width, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        rest = sorted(free)
        group = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(1)))]]
        free.discard(group[0])
        while len(group) < width:
            rest = sorted(free)
            group.append(rest[int(np.argmax(corr[np.ix_(group, rest)].sum(0)))])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def threshold_costs(n: int, p: np.ndarray, groups: list[list[int]], equal: list[float], radius: int) -> list[list[float]]:
    """Estimated cost of each partition under thresholds -1 .. radius.

    equal[i] counts the ordered pairs that agree in partition i, over all fingerprints. Pairs that differ by up to t
    bits are estimated from it by the ratio that independent bits with the measured frequencies would give.
    """
    out = []
    for bits, same in zip(groups, equal):
        differ = 2 * p[bits] * (1 - p[bits])
        dist = np.array([1.0])
        for q in differ:
            dist = np.convolve(dist, [1 - q, q])
        cost = [0.0]
        for t in range(min(radius, len(bits)) + 1):
            patterns = math.comb(len(bits), t)
            near = same * dist[: t + 1].sum() / max(dist[0], 1e-300)
            # a pair at distance d <= t meets under C(w-d, t-d) patterns
            meets = same * sum(dist[d] / max(dist[0], 1e-300) * math.comb(len(bits) - d, t - d) for d in range(t + 1))
            cost.append(max(meets, near) / 2 + PROBE_COST * n * patterns)
        out.append(cost + [math.inf] * (radius + 2 - len(cost)))
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of the lowest total cost with sum(t_i + 1) = radius + 1, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, radius - used + 1):
                if (total := c + cost[t + 1]) < step.get(used + t + 1, (math.inf,))[0]:
                    step[used + t + 1] = (total, [*ts, t])
        best = step
    return best[radius + 1]


def agreeing_pairs(reps: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each partition the number of ordered pairs that agree on its bits, counted over all of reps."""
    masks = [sum(1 << b for b in g) for g in groups]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
    sizes = reps.select(F.posexplode(keys).alias("part", "key")).groupBy("part", "key").agg(F.count("*").cast("double").alias("n"))
    found = {r.part: r.s for r in sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()}
    return [found.get(i, 0.0) for i in range(len(groups))]


def plan(reps: DataFrame, radius: int) -> list[int]:
    """The masks to probe (signed), for the cheapest number of partitions and their thresholds."""
    n, both = bit_statistics(reps)
    p = np.diag(both) / max(n, 1)
    options = [group_bits(n, both, m) for m in range(2, radius + 2)] or [[list(range(64))]]
    flat = agreeing_pairs(reps, [g for groups in options for g in groups])
    best, at = (math.inf, []), 0
    for groups in options:
        cost, ts = allocate(threshold_costs(n, p, groups, flat[at : at + len(groups)], radius), radius)
        at += len(groups)
        if cost < best[0] or not best[1]:
            best = cost, list(zip(groups, ts))
    masks = [sum(1 << b for b in g if b not in drop) for g, t in best[1] if t >= 0 for drop in combinations(g, t)]
    return [(m - (1 << 64) if m >> 63 else m) for m in masks]


def components_within(f: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints of one bucket: index of the first member of each one's component."""
    label, rest = np.arange(len(f)), np.arange(len(f))
    while rest.size > 1:
        front, seed, rest = rest[:1], rest[0], rest[1:]
        while front.size and rest.size:
            found, step = [], max(1, (1 << 20) // rest.size)
            for i in range(0, front.size, step):
                hit = (np.bitwise_count(f[front[i : i + step], None] ^ f[None, rest]) <= radius).any(0)
                found.append(rest[hit])
                rest = rest[~hit]
                if not rest.size:
                    break
            front = np.concatenate(found)
            label[front] = seed
    return label


def stars(run: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components inside each run. run: sorted run numbers; f: fingerprints."""
    n, (at, size) = len(f), np.unique(run, return_index=True, return_counts=True)[1:]
    length = np.repeat(size, size)
    left, right = [], []
    for d in range(1, min(SHORT, int(size.max(initial=1)))):
        i = np.flatnonzero((run[:-d] == run[d:]) & (length[:-d] <= SHORT))
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= radius]
        left.append(i)
        right.append(i + d)
    if left:
        a, b, label = np.concatenate(left), np.concatenate(right), np.arange(n)
        while a.size:  # the least index of each component, by repeated minima and shortcuts
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    else:
        label = np.arange(n)
    for i in np.flatnonzero(size > SHORT):
        s = slice(at[i], at[i] + size[i])
        label[s] = components_within(f[s], radius) + at[i]
    i = np.flatnonzero(label != np.arange(n))
    return f[i], f[label[i]]


def links(reps: DataFrame, radius: int) -> DataFrame:
    """Pairs a, b of distinct fingerprints within the radius that connect all that are so linked.

    Buckets over BLOCK rows are cut into blocks by a hash; each pair of blocks is a bucket of its own, so no task
    gets an unbounded group and no pair is lost.
    """
    masks = plan(reps, radius)
    lookup = F.array(*[F.lit(m).cast("bigint") for m in masks])
    probes = reps.select("fp", F.posexplode(lookup).alias("pattern", "mask")).select("fp", "pattern", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = probes.groupBy("pattern", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    hot = staged(sizes.where("blocks > 1").select("pattern", "key", "blocks"), "hot")
    marked = probes.join(small(hot), ["pattern", "key"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda other: F.least("own", other) * F.coalesce(F.col("blocks"), F.lit(1)) + F.greatest("own", other))
    dealt = marked.select("fp", "pattern", "key", F.explode(pairs).alias("pair"))
    dealt = dealt.repartition(F.col("pattern"), F.col("key"), F.col("pair")).sortWithinPartitions("pattern", "key", "pair")

    def run(batches):
        rest = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            rest = now if rest is None else np.concatenate((rest, now), 1)
            turn = np.flatnonzero((rest[1:, 1:] != rest[1:, :-1]).any(0))
            if turn.size:  # the last run may go on in the next batch
                yield from emit(rest[:, : turn[-1] + 1])
                rest = rest[:, turn[-1] + 1 :]
        if rest is not None and rest.size:
            yield from emit(rest)

    def emit(rows):
        start = np.concatenate(([True], (rows[1:, 1:] != rows[1:, :-1]).any(0)))
        a, b = stars(np.cumsum(start), rows[0].view(np.uint64), radius)
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of the edges a, b; alternating large and small stars.

    A hub's minimum is aggregated before the shuffle and joined back, so no task gathers its neighbours. Every round is
    written to the shared folder.
    """
    up = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that both sides of a join are plain shuffles and Spark can split the partition of a hub.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        lower = staged(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        out = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        out = staged(out, "small")
        same = up.count() == out.count() and out.join(up, ["u", "v"], "left_anti").limit(1).count() == 0
        discard(up, large, least, lower)
        up = out
        if same:
            return up.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """key, fp, component_id (the smallest key that links reach) for each row.

    Null and empty texts have fingerprint zero and link like any other. Keys may repeat; a null key never names a
    component unless all keys of it are null. Other columns are ignored.
    """
    rows = staged(fingerprints(docs, key, text, k), "fingerprints")
    reps = staged(rows.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    found = staged(links(reps, radius), "links")
    roots = connected(found)
    classes = staged(reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    firsts = staged(classes.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = staged(classes.join(firsts, "root").select("fp", "component_id"), "components")
    discard(found, reps, classes, firsts)
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


# Similar texts. A similarity of 0.8 moves 15 of 100 bits of a fingerprint, in sets of five shingles up to 19.
# Two words of the fingerprint are the partitions of the pigeonhole: up to 42 of their 128 bits, so 21 in the first or 20
# in the second; then up to 76 of all 256. By the binomial distribution, a pair at exactly 0.8 is missed with a chance of
# 3e-7 (15 %), at the most 6e-5 (19 %), and of unlike pairs 1e-10 are left to the exact check.
WIDE, THRESHOLDS, RADIUS = 4, (21, 20), 76
#: Sizes of linked sets differ by up to 1.25, so they are of one zone or of two that meet.
ZONE = 1.26
#: Pools of more classes are split into blocks, and pairs of blocks are searched by separate tasks.
POOL = 65536


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """WIDE SimHashes of a set of hashes, the second to last ones of hashes mixed anew."""
    out = [majority(h)]
    for i in range(1, WIDE):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def near_in_size(size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For sets in order of size: index of the first member of each one's component of candidates. words: WIDE x n."""
    n, label, at = len(size), np.arange(len(size)), np.arange(len(size))
    while len(at) > 1:
        front, seed = [(size[0], words[:, 0])], at[0]
        at, size, words = at[1:], size[1:], words[:, 1:]
        while front and len(at):
            own, w = front.pop()
            low, high = np.searchsorted(size, -(-4 * own // 5)), np.searchsorted(size, 5 * own // 4, "right")
            some = words[:, low:high]
            hit = np.flatnonzero((np.bitwise_count(some[0] ^ w[0]) <= THRESHOLDS[0]) | (np.bitwise_count(some[1] ^ w[1]) <= THRESHOLDS[1]))
            if hit.size:
                d = np.bitwise_count(some[:, hit] ^ w[:, None]).astype(np.int64)
                hit = low + hit[(d[0] + d[1] <= sum(THRESHOLDS) + 1) & (d.sum(0) <= RADIUS)]
            if hit.size:
                label[at[hit]] = seed
                front += [(size[i], words[:, i].copy()) for i in hit.tolist()]
                rest = np.ones(len(at), bool)
                rest[hit] = False
                at, size, words = at[rest], size[rest], words[:, rest]
    return label


def near_candidates(reps: DataFrame) -> DataFrame:
    """Pairs a, b of classes that connect all whose fingerprints are near and whose sizes allow a similarity of 0.8.

    reps: cls, size, words. A pool holds two zones of sizes that meet; at this radius no key of bits is selective, so
    that all fingerprints of a pool which are near in size are compared.
    """
    zoned = reps.where("size > 0").select("cls", "size", "words", F.floor(F.log("size") / math.log(ZONE)).cast("int").alias("zone"))
    pooled = zoned.select("cls", "size", "words", F.explode(F.array(F.col("zone") - 1, F.col("zone"))).alias("pool"))
    blocks = pooled.groupBy("pool").agg(F.ceil(F.count("*") / POOL).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least("own", other) * F.col("blocks") + F.greatest("own", other))
    dealt = pooled.join(F.broadcast(blocks), "pool").withColumn("own", own).select("pool", F.explode(pairs).alias("pair"), "cls", "size", "words")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "pool", "pair").sortWithinPartitions("pool", "pair", "size")

    def run(batches):
        task, held = None, []
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)] + list(batch.column(4).flatten().to_numpy().reshape(-1, WIDE).T))
            cuts = np.flatnonzero((now[:2, 1:] != now[:2, :-1]).any(0)) + 1
            for part in np.split(now, cuts, axis=1):
                if part.shape[1]:
                    if task != tuple(part[:2, 0]):  # the last task may go on in the next batch
                        yield from found(held)
                        task, held = tuple(part[:2, 0]), []
                    held.append(part)
        yield from found(held)

    def found(held):
        if held:
            rows = np.concatenate(held, 1)
            label = near_in_size(rows[3], np.ascontiguousarray(rows[4:]).view(np.uint64))
            i = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[2][i]), pa.array(rows[2][label[i]])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """key, component_id (the smallest key that links reach) for each row; links: Jaccard similarity 0.8 or more.

    Candidates come from SimHash fingerprints of the sets of shingles by the generalised pigeonhole; each component of
    candidates is then checked exactly. For odd texts and keys what minhash.near_copies says holds here too.
    """
    from . import minhash

    kind, texts = docs.schema[key].dataType.simpleString(), docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = [minhash.shingle_set(t, k) for t in batch.column(1).to_pylist()]
            words = np.array([wide_fingerprint(s) for s in found], np.uint64).reshape(-1, WIDE).view(np.int64)
            cls = pa.array([minhash.class_of(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), cls, pa.array([len(s) for s in found], pa.int64()), pa.array(words.tolist(), pa.list_(pa.int64()))], ["key", "cls", "size", "words"])

    rows = staged(texts.mapInArrow(run, f"key {kind}, cls bigint, size bigint, words array<bigint>"), "fingerprints")
    reps = staged(rows.groupBy("cls").agg(F.min("key").alias("first"), F.any_value("size").alias("size"), F.any_value("words").alias("words")), "classes")
    spread = connected(staged(near_candidates(reps), "near"))  # a root is no node of its own
    near = staged(spread.unionByName(spread.select(F.col("root").alias("node"), "root").distinct()), "groups")
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / minhash.BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least("own", other) * F.col("blocks") + F.greatest("own", other))
    groups = near.join(sizes, "root").withColumn("own", own).select("root", F.col("node").alias("cls"), F.explode(pairs).alias("pair")).select(F.xxhash64("root", "pair").alias("group"), "cls")
    firsts = reps.join(near.select(F.col("node").alias("cls")), "cls").select("first")
    return minhash.components(rows, reps, staged(minhash.verified(groups, firsts, texts, k), "links"), key)
