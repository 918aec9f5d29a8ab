"""Containers as they arrive: the same decoding over a file stream, and running counts per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scenery


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the scenery files that are put under root."""
    return spark.readStream.format("binaryFile").schema(scenery.FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[bB][gG][lL]").load(root)


def tile_counts(stream: DataFrame) -> DataFrame:
    """Placements of each tile so far; state is one row per tile."""
    return scenery.objects(stream).groupBy("tile").agg(F.count("*").alias("placements"))
