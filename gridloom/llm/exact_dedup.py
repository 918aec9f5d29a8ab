"""Exact deduplication against a persistent digest index.

The index is a folder of files with (digest, keep_id, rows), bucketed and sorted by digest. New data is reduced to one
row per digest before its only shuffle, and a sort-merge anti-join against the index, which is read bucket by bucket
without an exchange, finds the digests to append. Only 32-byte digests and ids are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, SPACES, discard, new_path, staged, text_or_empty, with_rows, without_rows

#: Digests (about 50 bytes each) that a bucket is meant to hold, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 4_000_000, 16


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 (32 bytes) of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACES, " ").cast("binary"), 256))


def buckets_for(digests: int) -> int:
    """A power of two, so that so many digests fill buckets of BUCKET_ROWS."""
    return max(BUCKETS, 1 << (max(1, -(-digests // BUCKET_ROWS)) - 1).bit_length())


class DigestIndex:
    """A persistent digest index in a folder of its own; without a path, a scratch index for drop() to remove.

    The folder alone makes the index: any session that opens it finds what earlier ones appended. It holds one folder
    v<generation>-b<buckets>, of which the latest counts; each session registers that as an external bucketed table.
    Appending is idempotent: a batch that is ingested again (after a failure, say) finds its digests present and adds
    nothing. Each append adds at most one file to a bucket; compact() merges them, into as many buckets as the size asks
    for, and replaces the folder by a rename, so that a crash leaves the old or the new generation. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0):
        self.spark, self.path = spark, (path or new_path(spark, "digest-index")).rstrip("/")
        self._top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._generations():
            self._files.mkdirs(self._child(f"v0-b{buckets_for(expected)}"))
        self._open()

    def _child(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._top, name)

    def _generations(self) -> list[tuple[int, int]]:
        names = [s.getPath().getName() for s in self._files.listStatus(self._top)] if self._files.exists(self._top) else []
        return sorted((int(m[1]), int(m[2])) for m in (re.fullmatch(r"v(\d+)-b(\d+)", n) for n in names) if m)

    def _open(self) -> None:
        """Register the latest generation under a name that its path determines."""
        self.generation, self.buckets = self._generations()[-1]
        at = f"{self.path}/v{self.generation}-b{self.buckets}"
        self.name = "digest_index_" + hashlib.sha256(at.encode()).hexdigest()[:24]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, `rows` BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """Those of groups (digest, keep_id, rows) that the index lacks: a sort-merge anti-join on its buckets."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id", "rows")

    def append(self, groups: DataFrame) -> None:
        """Add the digests of groups (digest, keep_id, rows; one row per digest) that the index lacks."""
        fresh = staged(self.fresh(groups), "fresh")  # a table can't be read while it is written
        fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        discard(fresh)

    def compact(self) -> None:
        """Rewrite the index with one sorted file per bucket, and as many buckets as its size asks for."""
        old, rows = self.name, self.read()
        buckets, scratch = buckets_for(rows.count()), f"{self.name}_next"
        self.spark.sql(f"DROP TABLE IF EXISTS {scratch}")
        rows.repartition(buckets, "digest").write.format("parquet").mode("overwrite").option("path", f"{self.path}/next").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(scratch)
        self.spark.sql(f"DROP TABLE {scratch}")  # external: its files stay
        if not self._files.rename(self._child("next"), self._child(f"v{self.generation + 1}-b{buckets}")):
            raise OSError(f"can't rename {self.path}/next")
        was = self._child(f"v{self.generation}-b{self.buckets}")
        self._open()
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        self._files.delete(was, True)

    def drop(self) -> None:
        """Remove the index and its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._files.delete(self._top, True)

    def ingest(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 1, row: str | None = None) -> DataFrame:
        """Deduplicate docs against the index and append what is new.

        Returns one row per row of docs: key, digest, keep_id, group_size (rows of docs with that text), kept. keep_id is
        the smallest key (bigint) of the first batch that held the text; docs is ingested in `batches` ranges of the key,
        the lowest first, each against what the others left. Null texts count as empty, and empty texts equal each
        other. A null key loses against any other; a text under null keys alone is kept under keep_id null. Rows that
        repeat a key and its text all say the same, unless `row` names a column that tells rows apart (see with_rows): then
        one of them alone, that of the least row, is kept, and the column is returned too. Other columns are ignored.
        """
        also = [F.col(row).alias("row")] if row else []
        rows = staged(docs.select(F.col(key).alias("key"), text_digest(text).alias("digest"), *also), "digests")
        first = [F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first")] if row else []
        groups = []
        for part in self._ranges(rows, batches):
            groups.append(staged(part.groupBy("digest").agg(F.min("key").alias("keep_id"), F.count("*").alias("rows"), *first), "groups"))
            self.append(groups[-1])
        every = groups[0]
        for g in groups[1:]:
            every = every.unionByName(g)
        if groups[1:]:
            every = every.groupBy("digest").agg(F.sum("rows").alias("rows"), *([F.min("first").alias("first")] if row else []))
        known = every.drop("keep_id").join(self.read().select("digest", "keep_id").hint("merge"), "digest")
        kept = F.col("key").eqNullSafe(F.col("keep_id"))
        if row:
            kept = kept & (F.col("row") == F.col("first.row"))
        # Staged, so that both sides of the last join are shuffled and Spark can split the partition of a hot digest.
        known = staged(known, "known")
        discard(*groups)
        return rows.join(known, "digest").select(F.col("key").alias(key), "digest", "keep_id", F.col("rows").alias("group_size"), kept.alias("kept"), *([F.col("row").alias(row)] if row else []))

    def _ranges(self, rows: DataFrame, batches: int) -> list[DataFrame]:
        """rows by ranges of the key; null keys are in the last one."""
        low, high = rows.agg(F.min("key"), F.max("key")).first() if batches > 1 else (None, None)
        if low is None:
            return [rows]
        edges = [low + (high - low + 1) * i // batches for i in range(1, batches)]
        parts = [rows.where((F.col("key") >= a) & (F.col("key") < b)) for a, b in zip([low, *edges], edges)]
        return [*parts, rows.where((F.col("key") >= edges[-1]) | F.col("key").isNull())]


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each text, and their columns; decided row by row, whatever the keys repeat."""
    rows = with_rows(docs)
    index = DigestIndex(docs.sparkSession)
    found = index.ingest(rows, key, text, row=ROW)
    index.drop()
    return without_rows(rows, staged(found.where("not kept").select(ROW), "copies"))  # where they are proven few, no text moves
