"""The whole conversion: a folder of scenery in, scenes of tiles, placement lines and a report out."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import assembly, elevation, placements
from ..sources import scenery, sinks

log = logging.getLogger("gridloom")


def kept(df: DataFrame, path: str) -> DataFrame:
    """df, written once under the output and read back, since several steps use it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ground(spark: SparkSession, placed: DataFrame, terrain: str) -> DataFrame:
    """placed with altitudes above the ground of the meshes under a folder, where their flags ask for it."""
    meshes = scenery.terrain(spark, terrain)
    vertices = scenery.terrain_vertices(meshes)
    points = placed.where(F.array_contains("flag_labels", "IsAboveAGL")).select("tile", F.concat_ws("#", "file", "offset").alias("pid"), "lat", "lon")
    found = elevation.elevation(points, scenery.terrain_triangles(meshes, vertices), vertices)
    return placements.grounded(placed.withColumn("pid", F.concat_ws("#", "file", "offset")), found, ["tile", "pid"]).drop("pid")


def tile_scenes(documents: DataFrame, uses: DataFrame, models: DataFrame) -> DataFrame:
    """tile, scene, bin of documents, with their buffers joined into one: what text scenes are made of. uses: numbered_models()."""
    held = uses.select("tile", "model", "first_buffers").join(models.select("model", "bin"), "model")
    bins = held.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("first_buffers", "bin"))).alias("p"))
    both = documents.join(bins, "tile").withColumn("scene", F.from_json("document", scenery.GLTF))
    base = lambda b: F.aggregate(F.slice("p", F.lit(1), b), F.lit(0), lambda n, x: n + F.octet_length(x["bin"]))
    views = F.transform("scene.bufferViews", lambda v: v.withField("byteOffset", F.coalesce(v["byteOffset"], F.lit(0)) + base(v["buffer"])).withField("buffer", F.lit(0)))
    whole = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["bin"]))
    return both.select("tile", F.col("scene").withField("bufferViews", views).alias("scene"), whole.alias("bin"))


def convert(spark: SparkSession, root: str, out: str, kind: str = "gltf", terrain: str | None = None, group: str = "gridloom-convert") -> dict[str, int]:
    """Convert the containers under root into scenes of one kind (gltf or ac) under out; returns and logs what was counted.

    out/scenes has a document for each tile with a model, out/buffers the geometry of the models (gltf), out/placements
    the placement lines, out/unused a row for each placed model that is missing. Without any model, nothing but work files
    is written. All jobs run in the job group `group`: cancelling that stops the conversion and leaves what was written.
    """
    if kind not in ("gltf", "ac"):
        raise ValueError("kind must be gltf or ac")
    spark.sparkContext.setJobGroup(group, f"conversion of {root}", interruptOnCancel=True)
    found = scenery.files(spark, root)
    objects, seen = sinks.observed(scenery.objects(found), "objects", sims=F.count_if(F.col("kind") == "sim"))
    objects = kept(objects, f"{out}/work/objects")
    placed, sims = objects.where("kind = 'placement'"), objects.where("kind = 'sim'")
    if terrain:
        placed = kept(ground(spark, placed, terrain), f"{out}/work/grounded")
    directory = kept(scenery.model_directory(found), f"{out}/work/models")
    refs = placements.model_refs(directory, placed)
    counts = {"placements": seen.get["rows"] - seen.get["sims"], "sims": seen.get["sims"], "models": 0, "tiles": 0, "unused": 0}
    log.info("%d placements and %d sim objects", counts["placements"], counts["sims"])
    if not placements.require_models(refs):
        log.warning("no model for any placement: nothing to convert")
        return counts
    used = placements.placed_models(directory, placed)
    scenes = scenery.scenes(scenery.model_chunks(found, used)).where("glb_no = 0")
    name = F.concat_ws("_", scalars.stem(F.col("file")), "guid", "offset", F.col("chunk_no").cast("string"))
    models = kept(assembly.fragments(scenes, name, strict=kind == "gltf"), f"{out}/work/fragments")
    of_model = kept(scenes.select(F.col("file").alias("m_file"), "guid", F.col("offset").alias("m_offset"), name.alias("model")), f"{out}/work/names")
    every = placements.model_instances(directory.withColumnRenamed("file", "m_file").withColumnRenamed("offset", "m_offset"), placed)
    every = every.join(of_model, ["m_file", "guid", "m_offset"])
    instances = kept(assembly.tile_instances(every, F.concat_ws("#", "file", F.lpad(F.col("offset").cast("string"), 12, "0")), F.col("model")), f"{out}/work/instances")
    made = kept(assembly.pieces(instances, models), f"{out}/work/documents")
    if kind == "gltf":
        assembly.write_pieces(made, f"{out}/scenes")
        assembly.write_buffers(models, f"{out}/buffers")
    else:
        uses = assembly.numbered_models(instances, assembly.counted(models))
        text = assembly.ac_documents(tile_scenes(assembly.whole(made), uses, models), ["tile"], F.concat(F.lit("Tile_"), F.col("tile").cast("string")))
        assembly.write_tiles(text.withColumnRenamed("text", "document"), f"{out}/scenes")
    written = made.where("part = 0").select("tile")
    tiles = placements.centroids(placed).join(written, "tile", "left_semi")
    sinks.write_placements(tiles, f"{out}/placements", kind)
    unused = kept(placements.unused(placed, directory, F.struct("file", "offset")), f"{out}/unused")
    counts |= {"models": models.count(), "tiles": written.count(), "unused": unused.count()}
    log.info("%d models in %d tiles; %d placed models are missing", counts["models"], counts["tiles"], counts["unused"])
    return counts
