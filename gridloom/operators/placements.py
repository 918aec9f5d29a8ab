"""Joins and aggregates of placements, models and sim objects.

Placements are rows with guid, lon, lat, alt, tile and the columns of `seq` (their order in the input); models are rows
with guid, size and file; several rows may share a guid, and each places its own copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def centroids(placements: DataFrame) -> DataFrame:
    """tile, lat, lon, alt (means of all placements in the tile, with or without a model; as float32), placements."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).cast("float").alias(c)
    return placements.groupBy("tile").agg(mean("lat"), mean("lon"), mean("alt"), F.count("*").alias("placements"))


def by_guid(placements: DataFrame, seq: Column, *columns: str) -> DataFrame:
    """guid and the list of its placements (structs of the columns) in input order."""
    grouped = placements.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), F.struct(*columns).alias("p")))).alias("l"))
    return grouped.select("guid", F.col("l.p").alias("placements"))


def grounded(placements: DataFrame, elevations: DataFrame, key: list[str], flags: str = "flags") -> DataFrame:
    """placements with `alt` over ground where their flags say so. elevations: key, elevation (one row a key)."""
    labels = scalars.flag_labels(F.col(flags))
    return placements.join(elevations.select(*key, "elevation"), key, "left").withColumn("alt", scalars.above_ground(F.col("alt"), labels, F.col("elevation"))).drop("elevation")


def instance_matrices(instances: DataFrame, heading: str = "heading", pitch: str = "pitch", bank: str = "bank", scale: str = "scale") -> DataFrame:
    """instances with `matrix`: scaled, turned and moved by their offset (row-major, float)."""
    c = F.col
    return instances.withColumn("matrix", scalars.placement_matrix(c("offset"), c(heading), c(pitch), c(bank), c(scale)))


def require_models(refs: DataFrame) -> bool:
    """Whether there is anything to convert; without a single model a conversion stops before it writes."""
    return not refs.isEmpty()


def placed_models(models: DataFrame, placements: DataFrame) -> DataFrame:
    """Models that have a placement."""
    return models.join(placements.select("guid"), "guid", "left_semi")


def model_refs(models: DataFrame, placements: DataFrame) -> DataFrame:
    """Models once for each tile that places them (a bag: rows that share a guid all count)."""
    return models.join(placements.select("guid", "tile").distinct(), "guid")


def ranked_refs(refs: DataFrame, *order: str) -> DataFrame:
    """refs with their rank in the tile: larger first, then by `order`."""
    return refs.withColumn("rank", F.row_number().over(W.partitionBy("tile").orderBy(F.desc("size"), *order)))


def from_origin(placed: DataFrame, placements: DataFrame) -> DataFrame:
    """placed with `offset`, in metres from its tile's centroid over all placements."""
    origin = centroids(placements).select("tile", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("alt").alias("alt0"))
    d = lambda c: F.col(c).cast("double")
    offset = scalars.local_offset(F.col("lon"), F.col("lat"), F.col("alt"), d("lon0"), d("lat0"), d("alt0"))
    return placed.join(origin, "tile").withColumn("offset", offset)


def instances(refs: DataFrame, placements: DataFrame) -> DataFrame:
    """Every placement of every model of a tile, with its offset in metres from the tile's centroid."""
    return from_origin(refs.join(placements, ["tile", "guid"]), placements)


def model_instances(models: DataFrame, placements: DataFrame) -> DataFrame:
    """instances(model_refs(models, placements), placements), by one join: a model's tiles are those of its placements."""
    return from_origin(models.join(placements, "guid"), placements)


def sim_groups(sims: DataFrame, seq: str) -> DataFrame:
    """One row per tile and title: positions in input order, and flags and complexity of the first one."""
    first = lambda c: F.min_by(c, seq).alias(c)
    return sims.groupBy("tile", "title").agg(F.array_sort(F.collect_list(F.struct(seq, "lon", "lat"))).alias("positions"), first("flags"), first("complexity"))


def tiles_with_sims(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """Every tile that has models, with its sim objects if it has some; tiles of sim objects alone aren't written."""
    tiles = refs.select("tile").distinct()
    per_tile = groups.groupBy("tile").agg(F.count("*").alias("titles"), F.sum(F.size("positions")).alias("positions"))
    return tiles.join(per_tile, "tile", "left")


def sim_only_tiles(refs: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.select("tile").distinct().join(refs.select("tile"), "tile", "left_anti")


def unused(placements: DataFrame, models: DataFrame, seq: Column) -> DataFrame:
    """guids that are placed but have no model: how often, and the first placement."""
    without = placements.join(models.select("guid"), "guid", "left_anti")
    return without.groupBy("guid").agg(F.count("*").alias("placements"), F.min_by(F.struct("lon", "lat"), seq).alias("first"))


def totals(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: models to place (references and sim object groups)."""
    return refs.agg(F.count("*").alias("model_refs")).crossJoin(groups.agg(F.count("*").alias("sim_groups"))).withColumn("total", F.col("model_refs") + F.col("sim_groups"))


def first_by_title(objects: DataFrame, configs: DataFrame) -> DataFrame:
    """Objects with the first config path (in path order) whose title matches, white space and case aside."""
    key = lambda c: F.lower(F.trim(c))
    first = configs.groupBy(key("title").alias("key")).agg(F.min("path").alias("path"))
    return objects.withColumn("key", key("title")).join(first, "key").drop("key")


def nearest_ancestor(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """path and its deepest ancestor (or itself) among folders.folder; paths without one are left out."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spread = paths.select("path", F.explode(prefixes).alias("folder"))
    return spread.join(folders.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def union_objects(placements: DataFrame, sims: DataFrame) -> DataFrame:
    """kind, name (guid or title), tile of placements and sim objects in one bag."""
    p = placements.select(F.lit("placement").alias("kind"), F.col("guid").cast("string").alias("name"), "tile")
    return p.unionByName(sims.select(F.lit("sim").alias("kind"), F.col("title").alias("name"), "tile"))


def guids_without_model(placements: DataFrame, models: DataFrame) -> DataFrame:
    """guid of every placement's model that there is none of, once."""
    return placements.select("guid").subtract(models.select("guid"))


def nearest_door(jetways: DataFrame, doors: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """key, door, dist (metres), heading: the nearest of an aircraft's doors for each jetway (lon, lat, alt).

    doors (door, dlon, dlat, dalt) are those of one aircraft; more than `limit` of them are refused, as every jetway is
    compared with each.
    """
    if doors.limit(limit + 1).count() > limit:
        raise ValueError(f"an aircraft has at most {limit} doors")
    c = F.col
    pairs = jetways.crossJoin(F.broadcast(doors))
    over = scalars.haversine(c("lon"), c("lat"), c("dlon"), c("dlat"))
    dist, heading = F.sqrt(F.pow(over, 2) + F.pow(c("dalt") - c("alt"), 2)), scalars.bearing(c("lon"), c("lat"), c("dlon"), c("dlat"))
    best = pairs.groupBy(key).agg(F.min(F.struct(dist.alias("dist"), "door", heading.alias("heading"))).alias("b"))
    return best.select(key, "b.door", "b.dist", "b.heading")


def best_prefix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each wanted(name, path) the file(name, file) of the same name, case aside, with the longest common prefix.

    Ties go to the file that comes first. A wanted row without a file of its name is left out.
    """
    named = files.select(F.lower("name").alias("key"), "file", F.lower("file").alias("low"))
    # Distinct prefixes of the files meet those of the wanted paths: an equi-join, the longest meeting one wins.
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.left(c, n))
    first = named.select("key", "file", F.explode(cut(F.col("low"))).alias("head")).groupBy("key", "head").agg(F.min("file").alias("file"))
    asked = wanted.select("name", "path", F.lower("name").alias("key"), F.explode(cut(F.lower("path"))).alias("head"))
    best = F.max_by(F.struct("file", F.length("head").alias("prefix")), F.length("head"))
    return asked.join(first, ["key", "head"]).groupBy("name", "path").agg(best.alias("b")).select("name", "path", "b.file", "b.prefix")
