"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves each pre-token that is a token itself. Tier two: the
others are merged by a heap over a linked list of their bytes, lowest rank first and leftmost among equals, in
O(n log n) even for a pre-token as long as the text. Each worker holds one encoder, found again by the vocabulary's
content, and remembers the ids of pre-tokens that it has met, up to a bound in bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of pre-tokens and ids that a worker remembers (estimated), what an entry takes besides, and the longest one.
MEMO_BYTES, ENTRY_BYTES, MEMO_CHARS = 96 << 20, 220, 64
#: Rows of an Arrow batch that are worked on at once.
ROWS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its rank on each line. Read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, and verify.

    Keys fall into buckets of four on average. Largest bucket first, the least displacement is stored that sends all of
    its keys to free slots; there are as many slots as keys.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import xxhash

        self.n, self.buckets = len(ranks), max(1, len(ranks) // 4)
        keys = list(ranks)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        assert len(np.unique(h)) == self.n, "two tokens share a 64-bit hash"
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.uint64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        slot_of = np.zeros(self.n, np.int64)
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = order[edges[b] : edges[b + 1]]
            if not own.size:
                break
            first = 0
            while True:  # many displacements at once
                d = np.arange(first, first + 256, dtype=np.uint64)
                slots = self._slots(h[own][None, :], d[:, None])
                good = free[slots].all(1)
                if own.size > 1:
                    s = np.sort(slots, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    i = int(np.argmax(good))
                    self.shift[b], slot_of[own] = d[i], slots[i]
                    free[slots[i]] = False
                    break
                first += 256
        self.keys: list[bytes] = [b""] * self.n
        self.ids = np.zeros(self.n, np.int64)
        for k, s in zip(keys, slot_of.tolist()):
            self.keys[s], self.ids[s] = k, ranks[k]

    def _slots(self, h, d):
        """Slot of hash h under displacement d: a multiply-shift mix of both."""
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, words: list[bytes]) -> list[int]:
        """The id of each word that is a key, else -1."""
        import xxhash

        if not words or not self.n:
            return [-1] * len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        slots = self._slots(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        keys = self.keys
        return [i if keys[s] == w else -1 for w, s, i in zip(words, slots.tolist(), self.ids[slots].tolist())]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a byte string by merging the adjacent pair of the lowest rank, leftmost first, until none is a token."""
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i; the next one starts at after[i]
    # Rank of the pair that starts at i; none for the last part and for those that are merged away.
    rank = [get(piece[i : i + 2]) for i in range(n - 1)]
    rank.append(None)
    heap = [r * n + i for i, r in enumerate(rank) if r is not None]  # one number: by rank, then by place
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if rank[i] != r:  # an entry that a merge has made stale
            continue
        j = after[i]
        end = after[i] = after[j]
        rank[j] = rank[i] = None
        if end < n:
            before[end] = i
            r = rank[i] = get(piece[i : after[end]])
            if r is not None:
                heappush(heap, r * n + i)
        h = before[i]
        if h >= 0:
            r = rank[h] = get(piece[h:end])
            if r is not None:
                heappush(heap, r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Text to ids and back. ranks must hold every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, perfect: PerfectHash | None = None):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks, self.find, self.hash = ranks, regex.compile(pattern).findall, perfect or PerfectHash(ranks)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.memo: dict[str, bytes] = {}
        self.held = 0  # estimated bytes of the memo

    def resolve(self, pieces: set[str]) -> list[str]:
        """Put the ids (as int32 bytes) of every piece into the memo; the pieces that are too long to stay there."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        raw = [p.encode("utf-8") for p in new]
        passing = []
        for p, b, i in zip(new, raw, self.hash.lookup(raw)):
            memo[p] = ids = array("i", (i,) if i >= 0 else merge(b, self.ranks)).tobytes()
            if len(p) > MEMO_CHARS:
                passing.append(p)
            else:
                self.held += ENTRY_BYTES + len(b) + len(ids)
        return passing

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.find(t) for t in texts]
        passing = self.resolve(set(chain.from_iterable(pieces)))
        ids = self.memo.__getitem__
        out = [np.frombuffer(b"".join(map(ids, own)), np.int32) for own in pieces]
        for p in passing:
            del self.memo[p]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_held: dict[str, Encoder] = {}


def shared_vocabulary(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> tuple[str, Broadcast]:
    """A name by content, and the broadcast (ranks, perfect hash) of a vocabulary: one file that is read, about 2 MB."""
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return name, spark.sparkContext.broadcast((ranks, PerfectHash(ranks)))


def held_encoder(name: str, shared: Broadcast, pattern: str) -> Encoder:
    """The one encoder of this worker process. A broadcast of a vocabulary that it holds already isn't even read."""
    if name not in _held:
        _held.clear()
        ranks, perfect = shared.value
        _held[name] = Encoder(ranks, pattern, perfect)
    return _held[name]


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals."""
    while wanted.lower() in {t.lower() for t in taken}:
        wanted += "_"
    return wanted


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of ids (array<int>) in the place of text; null texts count as empty and give no ids.

    With `decoded`, a column of that name has the bytes that the ids stand for, decoded from them by the same worker.
    Special tokens don't exist here: their strings are ordinary text. All other columns and rows pass unchanged; if docs
    has a column named like an output already, that one is replaced.
    """
    name, shared = shared_vocabulary(docs.sparkSession, ranks, pattern)
    outputs = [out, *([decoded] if decoded else [])]
    keep = [c for c in docs.columns if c not in (text, *outputs)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` array<int>", *([f"`{decoded}` binary"] if decoded else [])])

    def run(batches):
        enc = held_encoder(name, shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # bounds what is held of one batch
                part = batch.slice(at, ROWS)
                ids = enc.encode([t or "" for t in part.column(len(keep)).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                made = [pa.ListArray.from_arrays(pa.array(offsets), flat)]
                if decoded:
                    made.append(pa.array([enc.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], [*keep, *outputs])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(free_name("text", keep))).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with a column of the bytes that the ids stand for; null or no ids: no bytes. An unknown id fails the task."""
    vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in tokens.columns if c != out]
    schema = ", ".join([*(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` binary"])
    at = rest.index(ids)

    def run(batches):
        token = shared.value.__getitem__
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts = [b"".join(map(token, own or ())) for own in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*rest, out])

    return tokens.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
