"""Helpers that the text operators share: stages in the shared folder, row identity, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: ASCII white space as the contracts define it: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Estimated bytes up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20

#: The column that names a row.
ROW = "__row"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Where that is unset: a temporary folder in local mode, and a folder in the warehouse, which is shared, on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.applicationId not in _own:
            local = context.master == "local" or context.master.startswith("local[")
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gridloom-stages"
        base = _own[context.applicationId]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage, survives lost executors, and computes df once (checkpoint() computes it twice).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete stages that nothing will read again."""
    for df in stages:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_bytes(kind: DataType, col: Column) -> Column:
    """Estimated bytes of a value in a broadcast table."""
    if isinstance(kind, StructType):
        return sum((row_bytes(f.dataType, col[f.name]) for f in kind.fields), F.lit(16))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            return F.coalesce(F.aggregate(col, F.lit(16).cast("bigint"), lambda n, x: n + row_bytes(kind.elementType, x).cast("bigint")), F.lit(16))
        return F.greatest(F.size(col), F.lit(0)) * 8 + 16
    return F.lit(16)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, measured now, are estimated at `limit` bytes or fewer; else df, for a shuffled join."""
    size = sum((row_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(32)).cast("bigint")
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def of_one_scan(df: DataFrame) -> bool:
    """Whether df only filters and projects one relation of files."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_rows(docs: DataFrame, name: str = ROW) -> DataFrame:
    """docs with a column that names each row, the same in every run over the same files.

    It is the place in the file, (hash of the file's path, position), where docs filters and projects one table of
    files. Anything else is written to the shared folder first.
    """
    if of_one_scan(docs):
        try:
            return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
        except AnalysisException:  # files of a kind that doesn't number its rows
            pass
    return with_rows(staged(docs, "rows"), name)


def without_rows(rows: DataFrame, dropped: DataFrame, name: str = ROW) -> DataFrame:
    """rows (of with_rows) without those that dropped names (one column, staged) and without the column of names."""
    return rows.join(small(dropped.select(name).distinct()), name, "left_anti").drop(name)


def sampled(docs: DataFrame, chosen: DataFrame, limit: int, key: str, text: str) -> DataFrame:
    """Rows of docs whose key is in chosen (key; bounded), at most `limit` of them: h (hash of the key), text and chosen's columns.

    They are the rows of least h, of equal ones the first by place, so that repeated keys don't enlarge the sample.
    """
    rows = with_rows(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")))
    h = F.xxhash64("__key").alias("h")
    ids = rows.select(ROW, "__key", h).join(F.broadcast(chosen.withColumnRenamed(key, "__key")), "__key").drop("__key")
    return rows.select(ROW, "text").join(F.broadcast(staged(ids.orderBy("h", ROW).limit(limit), "sample")), ROW).drop(ROW)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that hold rows out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
