"""Token counts of documents in flat token files without an index, by a separator scan.

A flat file is a run of little-endian token ids of a fixed width; a separator id ends each document. The ids are
searched in blocks with one vectorised comparison each; a prefix scan over the blocks then numbers the documents and
stitches those that cross block boundaries.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import held_encoder, shared_vocabulary
from .common import of_one_scan, staged

#: Ids in a block.
BLOCK = 1 << 18


def write_flat(docs: DataFrame, path: str, ranks: dict[bytes, int], pattern: str, separator: int, text: str = "text", width: int = 2) -> None:
    """Encode docs into flat files under path, one for each partition, in the order of its rows. Null texts are empty.

    Spark's text writer writes the bytes and the separator as line end, so any file system that Spark knows will do.
    """
    if max(ranks.values()) >= separator or separator >= 1 << 8 * width:
        raise ValueError("the separator must be above all ids and fit the width")
    name, shared = shared_vocabulary(docs.sparkSession, ranks, pattern)

    def run(batches):
        enc = held_encoder(name, shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(0).slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(f"<u{width}").tobytes() for ids in enc.encode(texts)], pa.binary())], ["value"])

    flat = docs.select(F.col(text).alias("text")).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", separator.to_bytes(width, "little").decode("latin-1")).text(path)


@contextmanager
def fixed_splits(spark: SparkSession):
    """Within it, scans of the same files are cut alike, also if executors come or go between them."""
    keys = {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism), "spark.sql.files.maxPartitionNum": None}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        if v and before[k] is None:
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)


def write_named(docs: DataFrame, path: str, ranks: dict[bytes, int], pattern: str, separator: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Encode docs into flat files under path and return key, shard, doc: which document of which file each row became.

    The names are written beside the files, from a scan of the same splits.
    """
    with fixed_splits(docs.sparkSession):
        kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        kept = kept if of_one_scan(kept) else staged(kept, "texts")  # any other plan may deal its rows anew each time
        write_flat(kept, path, ranks, pattern, separator, "text", width)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        names = staged(kept.select(F.col("key").alias(key), F.spark_partition_id().alias("shard"), place.alias("doc")), "names")
    return names


def scan(spark: SparkSession, path: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, doc, first_token, n_tokens, terminated: the documents in the flat files under path, numbered from 0 in each.

    Two separators in a row delimit an empty document. What follows the last separator is an unterminated document,
    if there is anything. A file whose size isn't a whole number of ids stops the scan; an empty file holds nothing. A
    file is read by one task and so has to stay under 2 GB.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), f"<u{width}")  # fails if the size is no whole number of ids
                for k, at in enumerate(range(0, len(raw), block)):
                    part = raw[at : at + block]
                    ends = np.flatnonzero(part == separator)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([(ends + at).tolist()], pa.list_(pa.int64()))], ["file", "block", "at", "n", "ends"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    blocks = files.mapInArrow(run, "file string, block int, at bigint, n bigint, ends array<bigint>")
    by = W.partitionBy("file").orderBy("block")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("ends")
    blocks = blocks.withColumn("doc0", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    blocks = blocks.withColumn("open", F.coalesce(F.max(F.get(ends, F.size(ends) - 1)).over(before) + 1, F.lit(0).cast("bigint")))
    last = F.lead("block").over(by).isNull()
    rest = F.coalesce(F.get(ends, F.size(ends) - 1) + 1, F.col("open"))
    end = F.col("at") + F.col("n")
    whole = F.transform(ends, lambda e, i: F.struct((F.col("doc0") + i).alias("doc"), F.when(i == 0, F.col("open")).otherwise(F.get(ends, i - 1) + 1).alias("first"), e.alias("end"), F.lit(True).alias("terminated")))
    tail = F.when(last & (rest < end), F.array(F.struct((F.col("doc0") + F.size(ends)).alias("doc"), rest.alias("first"), end.alias("end"), F.lit(False).alias("terminated"))))
    docs = blocks.withColumn("tail", tail).select("file", F.explode(F.concat(whole, F.coalesce("tail", F.slice(whole, 1, 0)))).alias("d"))
    return docs.select("file", F.col("d.doc").alias("doc"), F.col("d.first").alias("first_token"), (F.col("d.end") - F.col("d.first")).alias("n_tokens"), "d.terminated")
