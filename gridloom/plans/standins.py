"""Stand-ins for scenery relations, by integer arithmetic on the test tables; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from ..operators import scene

SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    df = df.withColumns({"lon": grid.longitude(F.col("lon_raw")), "lat": grid.latitude(F.col("lat_raw"))})
    # Positions are never null here; saying so spares joins on the tile a filter that computes it once more.
    return df.withColumn("tile", F.coalesce(grid.tile_key(F.col("lat"), F.col("lon")), F.lit(0)))


def placements(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").where("l_partkey % 7 <> 0")
    return placed(
        df.select(
            F.col("l_partkey").alias("guid"), F.expr("127000000 + (l_orderkey * 7919) % 1500000").alias("lon_raw"),
            F.expr("156000000 + (l_suppkey * 104729 + l_linenumber * 1299709) % 1500000").alias("lat_raw"), F.col("l_quantity").alias("alt"),
            F.expr("(l_orderkey * 31) % 65536 - 32768").alias("heading16"), F.expr("(l_orderkey + l_linenumber) % 128").alias("flags"), *SEQ,
        )
    )


def models(spark: SparkSession, d: str, twice: bool = False) -> DataFrame:
    """twice: the larger ones have two rows, as models in two files."""
    part = read(spark, d, "part")
    pick = lambda least: part.where(F.col("p_size") > least).select(F.col("p_partkey").alias("guid"), F.col("p_size").alias("size"), F.col("p_brand").alias("file"))
    return pick(10).unionByName(pick(40).withColumn("file", F.concat("file", F.lit("-b")))) if twice else pick(10)


def sims(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select(
        F.col("event_type").alias("title"), F.col("event_id").alias("seq"), F.expr("126600000 + (user_id * 104729) % 2400000").alias("lon_raw"),
        F.expr("155800000 + (user_id * 7919) % 2400000").alias("lat_raw"), F.expr("event_id % 128").alias("flags"), F.expr("event_id % 5").alias("complexity"),
    )
    return placed(df)


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """Two meshes in every tile, from suppliers."""
    df = read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("vid"), F.expr("s_nationkey % 2").alias("mesh"), F.expr("126900000 + (s_suppkey * 7919 * 101) % 1700000").alias("lon_raw"),
        F.expr("155900000 + (s_suppkey * 104729 * 13) % 1700000").alias("lat_raw"), (F.col("s_acctbal") / 10).alias("alt"),
    )
    return placed(df)


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """A strip over the vertices of each mesh in their order."""
    v = vertices(spark, d).withColumn("group", F.struct("tile", "mesh")).withColumn("v", F.struct("lat", "lon", "alt"))
    t = scene.strip_triangles(v, "group", "vid", "v")
    return t.select("group.*", "tid", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "abc" for c in ("lat", "lon", "alt")])


LON, LAT = "(lon_raw * (360e0 / 805306368) - 180)", "(90 - lat_raw * (180e0 / 536870912))"


def sql_tiled(source: str) -> str:
    """SELECT that adds lon, lat and tile to a source with lon_raw and lat_raw."""
    return f"""(SELECT * EXCLUDE (width, west, south), CAST((west + 180) * 16384 + (south + 90) * 64 + CAST(floor((lat - south) * 8) AS BIGINT) * 8 + CAST(floor((lon - west) / width) AS BIGINT) AS INTEGER) AS tile
        FROM (SELECT *, CAST(floor(floor(lon / width) * width) AS BIGINT) AS west, CAST(floor(lat) AS BIGINT) AS south
        FROM (SELECT *, CASE WHEN abs(lat) >= 89 THEN 12e0 WHEN abs(lat) >= 86 THEN 4e0 WHEN abs(lat) >= 83 THEN 2e0 WHEN abs(lat) >= 76 THEN 1e0 WHEN abs(lat) >= 62 THEN 0.5e0 WHEN abs(lat) >= 22 THEN 0.25e0 ELSE 0.125e0 END AS width
        FROM (SELECT *, {LON} AS lon, {LAT} AS lat FROM {source}))))"""


PLACEMENTS = "placements AS (SELECT * FROM " + sql_tiled(
    """(SELECT l_partkey AS guid, 127000000 + (l_orderkey * 7919) % 1500000 AS lon_raw, 156000000 + (l_suppkey * 104729 + l_linenumber * 1299709) % 1500000 AS lat_raw,
        l_quantity AS alt, (l_orderkey * 31) % 65536 - 32768 AS heading16, (l_orderkey + l_linenumber) % 128 AS flags, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        FROM lineitem WHERE l_partkey % 7 <> 0)"""
) + ")"
MODELS = "models AS (SELECT p_partkey AS guid, p_size AS size, p_brand AS file FROM part WHERE p_size > 10)"
MODELS_TWICE = "models AS (SELECT p_partkey AS guid, p_size AS size, p_brand AS file FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, p_size, p_brand || '-b' FROM part WHERE p_size > 40)"
SIMS = "sims AS (SELECT * FROM " + sql_tiled(
    """(SELECT event_type AS title, event_id AS seq, 126600000 + (user_id * 104729) % 2400000 AS lon_raw, 155800000 + (user_id * 7919) % 2400000 AS lat_raw,
        event_id % 128 AS flags, event_id % 5 AS complexity FROM events)"""
) + ")"
VERTICES = "vertices AS (SELECT * FROM " + sql_tiled(
    """(SELECT s_suppkey AS vid, s_nationkey % 2 AS mesh, 126900000 + (s_suppkey * 7919 * 101) % 1700000 AS lon_raw, 155900000 + (s_suppkey * 104729 * 13) % 1700000 AS lat_raw, s_acctbal / 10 AS alt FROM supplier)"""
) + ")"
REFS = "refs AS (SELECT m.*, t.tile FROM models m JOIN (SELECT DISTINCT guid, tile FROM placements) t USING (guid))"
GROUPS = "sim_groups AS (SELECT tile, title, count(*) AS n FROM sims GROUP BY tile, title)"
TRIANGLES = """triangles AS (SELECT tile, mesh, i AS tid, lat AS a_lat, lon AS a_lon, alt AS a_alt,
        CASE WHEN i % 2 = 1 THEN lat2 ELSE lat1 END AS b_lat, CASE WHEN i % 2 = 1 THEN lon2 ELSE lon1 END AS b_lon, CASE WHEN i % 2 = 1 THEN alt2 ELSE alt1 END AS b_alt,
        CASE WHEN i % 2 = 1 THEN lat1 ELSE lat2 END AS c_lat, CASE WHEN i % 2 = 1 THEN lon1 ELSE lon2 END AS c_lon, CASE WHEN i % 2 = 1 THEN alt1 ELSE alt2 END AS c_alt
    FROM (SELECT *, row_number() OVER w - 1 AS i, lead(lat, 1) OVER w AS lat1, lead(lon, 1) OVER w AS lon1, lead(alt, 1) OVER w AS alt1, lead(lat, 2) OVER w AS lat2, lead(lon, 2) OVER w AS lon2, lead(alt, 2) OVER w AS alt2
        FROM vertices WINDOW w AS (PARTITION BY tile, mesh ORDER BY vid)) WHERE lat2 IS NOT NULL)"""
