"""Writers of scene files. Executors write through Spark, one folder tree per tile bucket; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import grid, scalars


def placement_line(tile: Column, lon: Column, lat: Column, alt: Column, kind: str = "gltf", animated: Column | None = None) -> Column:
    """The line that places a tile's scene. kind: gltf or ac; animated scenes are placed through their XML file."""
    if kind not in ("gltf", "ac"):
        raise ValueError("kind must be gltf or ac")
    animated = F.lit(False) if animated is None else animated
    heading, tilt = ("90", "0") if kind == "ac" else ("270", "90")
    name = F.concat(tile.cast("string"), F.lit("."), F.when(animated, "xml").otherwise(kind))
    return F.concat_ws(" ", F.lit("OBJECT_STATIC"), name, *map(scalars.number_text, (lon, lat, alt)), F.when(animated, "0").otherwise(heading), F.lit("0"), F.lit(tilt))


def property_xml(path: Column, animations: Column) -> Column:
    """Property list of a scene: its path and its animations (array of XML texts)."""
    return F.concat(F.lit("<PropertyList>\n<path>"), path, F.lit("</path>\n"), F.array_join(animations, "\n"), F.lit("\n</PropertyList>"))


def write_placements(centroids: DataFrame, path: str, kind: str = "gltf") -> None:
    """One placement line per tile of centroids(tile, lat, lon, alt), partitioned by the tile's ten and one degree squares."""
    corner = grid.tile_corner(F.col("tile"))
    folder = F.split(grid.tile_folder(corner["lat"], corner["lon"]), "/")
    d = lambda c: F.col(c).cast("double")
    line = placement_line(F.col("tile"), d("lon"), d("lat"), d("alt"), kind)
    rows = centroids.select(folder[0].alias("square10"), folder[1].alias("square1"), line.alias("value"))
    rows.repartition("square10", "square1").write.mode("overwrite").partitionBy("square10", "square1").text(path)


def write_scenes(scenes: DataFrame, path: str) -> None:
    """JSON scenes (file, guid, glb_no, json), one line each, partitioned by source file; overwriting is idempotent."""
    name = F.concat_ws("_", F.regexp_replace(scalars.file_name(F.col("file")), r"\.[^.]*$", ""), "guid", F.col("glb_no").cast("string"))
    scenes.select(scalars.file_name(F.col("file")).alias("source"), name.alias("name"), "json").write.mode("overwrite").partitionBy("source").json(path)


def ac_lines(objects: DataFrame, vertices: DataFrame, surfaces: DataFrame, materials: DataFrame) -> DataFrame:
    """doc, seq, value: the lines of text scenes, ordered by seq within doc.

    materials: doc, id, name, and red to blue as r, g, b, spec, shininess, transparency. objects: doc, object, name. vertices:
    doc, object, vertex, x, y, z. surfaces: doc, object, surface, material, two_sided, refs (array of v, u, w).
    """
    n = scalars.number_text
    seq = lambda *parts: F.array(*[p.cast("bigint") if isinstance(p, Column) else F.lit(p).cast("bigint") for p in parts])
    head = objects.select("doc").distinct().select("doc", seq(0, 0, 0, 0).alias("seq"), F.lit("AC3Db").alias("value"))
    rgb = F.concat_ws(" ", n(F.col("r")), n(F.col("g")), n(F.col("b")))
    spec = F.concat_ws(" ", *[n(F.col("spec"))] * 3)
    mat = materials.select("doc", seq(1, F.col("id"), 0, 0).alias("seq"), F.concat(F.lit('MATERIAL "'), scalars.clean_name(F.col("name")), F.lit('" rgb '), rgb, F.lit(" amb "), F.concat_ws(" ", *[n(F.col(x) * 0.2) for x in "rgb"]), F.lit(" emis 0 0 0 spec "), spec, F.lit(" shi "), F.col("shininess").cast("string"), F.lit(" trans "), n(F.col("transparency"))).alias("value"))
    nv = vertices.groupBy("doc", "object").agg(F.count("*").alias("nv"))
    ns = surfaces.groupBy("doc", "object").agg(F.count("*").alias("ns"))
    full = objects.join(nv, ["doc", "object"]).join(ns, ["doc", "object"])  # an object without surfaces isn't written
    count = objects.select("doc").distinct().join(full.groupBy("doc").agg(F.count("*").alias("k")), "doc", "left")  # only what is written counts
    world = count.select("doc", seq(2, 0, 0, 0).alias("seq"), F.concat(F.lit("OBJECT world\nkids "), F.coalesce("k", F.lit(0)).cast("string")).alias("value"))
    obj = full.select("doc", seq(3, F.col("object"), 0, 0).alias("seq"), F.concat(F.lit('OBJECT poly\nname "'), scalars.clean_name(F.col("name")), F.lit('"\nnumvert '), F.col("nv").cast("string")).alias("value"))
    kept = full.select("doc", "object", "ns")
    vert = vertices.join(kept, ["doc", "object"]).select("doc", seq(3, F.col("object"), 1, F.col("vertex")).alias("seq"), F.concat_ws(" ", n(-F.col("x")), n(F.col("y")), n(F.col("z"))).alias("value"))
    numsurf = kept.select("doc", seq(3, F.col("object"), 2, 0).alias("seq"), F.concat(F.lit("numsurf "), F.col("ns").cast("string")).alias("value"))
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", r["v"].cast("string"), n(r["u"]), n(r["w"]))), "\n")
    surf = surfaces.select("doc", seq(3, F.col("object"), 3, F.col("surface")).alias("seq"), F.concat(F.lit("SURF "), scalars.surface_flags(F.col("two_sided")), F.lit("\nmat "), F.col("material").cast("string"), F.lit("\nrefs "), F.size("refs").cast("string"), F.lit("\n"), refs).alias("value"))
    kids = kept.select("doc", seq(3, F.col("object"), 4, 0).alias("seq"), F.lit("kids 0").alias("value"))
    out = head
    for more in (mat, world, obj, vert, numsurf, surf, kids):
        out = out.unionByName(more)
    return out


def ac_documents(lines: DataFrame) -> DataFrame:
    """doc, text: the whole text of each scene."""
    whole = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("l"))
    return whole.select("doc", F.concat(F.array_join("l.value", "\n"), F.lit("\n")).alias("text"))


def script(template: str, values: dict[str, Column]) -> Column:
    """A script from a template whose lines `var name = ...;` get the values given for their names."""
    lines = []
    for line in template.splitlines():
        name = line.removeprefix("var ").split(" =")[0].strip() if line.startswith("var ") else ""
        lines.append(F.concat(F.lit(f"var {name} = "), values[name], F.lit(";")) if name in values else F.lit(line))
    return F.array_join(F.array(*lines), "\n")


def texture_copies(textures: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """src, dst of each texture once: the copies to make, without those whose dst is in present (path) already."""
    wanted = textures.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    return wanted if present is None else wanted.join(present.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst")


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds its rows and the counters given once an action has run: progress and log figures."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counters.items()]), seen
