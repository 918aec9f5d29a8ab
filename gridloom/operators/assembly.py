"""Scenes of whole tiles: the fragments of models, renumbered into one document for each tile.

A tile's document lists the resources (meshes, accessors, views, materials, textures, images) of each of its models once
and every instance's nodes; buffers stay one file for each model, which the documents of all tiles refer to, so that no
geometry is copied or shuffled. Numbering takes running sums of counts; documents are made in pieces, a row for each
instance and list of a model, and joined in their files.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grid, scalars
from ..sources import emit
from . import meshes

SLOT = "struct<index: int>"
FRAGMENT = f"""struct<nodes: array<struct<name: string, mesh: int, children: array<int>, translation: array<double>, rotation: array<double>, scale: array<double>, matrix: array<double>>>, roots: array<int>,
    meshes: array<struct<name: string, primitives: array<struct<attributes: map<string, int>, indices: int, material: int>>>>,
    accessors: array<struct<bufferView: int, componentType: int, count: int, type: string, min: array<double>, max: array<double>>>,
    bufferViews: array<struct<buffer: int, byteOffset: int, byteLength: int, target: int>>,
    materials: array<struct<name: string, alphaMode: string, doubleSided: boolean, emissiveFactor: array<double>, normalTexture: {SLOT}, occlusionTexture: {SLOT}, emissiveTexture: {SLOT},
        pbrMetallicRoughness: struct<baseColorFactor: array<double>, metallicFactor: double, roughnessFactor: double, baseColorTexture: {SLOT}, metallicRoughnessTexture: {SLOT}>>>,
    textures: array<struct<source: int, extensions: struct<MSFT_texture_dds: struct<source: int>>>>, images: array<struct<uri: string>>>"""
COUNTED = ["meshes", "accessors", "bufferViews", "materials", "textures", "images"]


def fragments(scenes: DataFrame, model: Column, strict: bool = True) -> DataFrame:
    """model, fragment (JSON), bin: the emitted form of each scene (see sources.emit.fragment)."""
    ready = scenes.select(model.cast("string").alias("model"), F.to_json("scene").alias("json"), "bin")

    def run(batches):
        for pdf in batches:
            for name, text, buffer in zip(pdf["model"], pdf["json"], pdf["bin"]):
                made, blob = emit.fragment(json.loads(text), bytes(buffer or b""), strict)
                yield pd.DataFrame({"model": [name], "fragment": [json.dumps(made)], "bin": [blob]})

    return ready.mapInPandas(run, "model string, fragment string, bin binary")


def counted(models: DataFrame) -> DataFrame:
    """models (model, fragment, bin) with the parsed fragment `f`, the counts of its parts (n_...) and the buffer's length."""
    parsed = models.withColumn("f", F.from_json("fragment", FRAGMENT))
    size = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    return parsed.select("model", "f", *[size(f"f.{c}").alias(f"n_{c}") for c in ["nodes", *COUNTED]], F.octet_length("bin").alias("n_bytes"))


def numbered_instances(instances: DataFrame, counts: DataFrame) -> DataFrame:
    """instances (tile, model, size, seq, ...) with `node`: the number that the instance's own node gets in its tile's document.

    Larger models come first, then by model and seq; an instance takes one node and those of its model.
    """
    sized = instances.join(counts.select("model", "n_nodes"), "model")
    before = W.partitionBy("tile").orderBy(F.desc("size"), "model", "seq").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("node", F.coalesce(F.sum(1 + F.col("n_nodes")).over(before), F.lit(0)).cast("int")).drop("n_nodes")


def numbered_models(instances: DataFrame, counts: DataFrame) -> DataFrame:
    """tile, model, first_<part>: where each model's parts begin in the lists of its tile's document; first_buffers is its rank."""
    used = instances.groupBy("tile", "model").agg(F.max("size").alias("size")).join(counts.select("model", *[f"n_{c}" for c in COUNTED]), "model")
    order = W.partitionBy("tile").orderBy(F.desc("size"), "model")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"n_{c}").over(before), F.lit(0)).cast("int").alias(f"first_{c}") for c in COUNTED]
    return used.select("tile", "model", *sums, (F.row_number().over(order) - 1).alias("first_buffers"))


def pieces(instances: DataFrame, models: DataFrame, uri: Column | None = None) -> DataFrame:
    """tile, part, at, list, text: the document (glTF JSON) of each tile in pieces.

    The texts of a tile in the order of part and at are its document; white space may go between them. A piece has the
    nodes of one instance or the resources of one model, so no row or task holds a tile. list: the list that the piece
    has elements of ("roots" for those of the scene; null for what stands around the lists); a comma goes before all but its first.

    instances: tile, model, size, seq, name, matrix (row-major), prefix (null, or what goes before the names of the model's
    nodes). models: as fragments() returns them. uri: the buffer file of a model; <model>.bin if not given.
    """
    counts = counted(models)
    uri = F.concat(F.col("model"), F.lit(".bin")) if uri is None else uri
    own = numbered_instances(instances, counts).join(counts.select("model", "f"), "model")
    shift = F.col("node") + 1
    title = lambda name: F.when(F.col("prefix").isNull(), name).otherwise(F.concat_ws("_", "prefix", name))
    moved = F.transform("f.nodes", lambda n: n.withField("children", F.transform(n["children"], lambda c: c + shift)).withField("mesh", n["mesh"] + F.col("first_meshes")).withField("name", title(n["name"])))
    top = F.struct(
        F.col("name"), F.lit(None).cast("int").alias("mesh"), F.transform("f.roots", lambda r: r + shift).alias("children"), *[F.lit(None).cast("array<double>").alias(k) for k in ("translation", "rotation", "scale")],
        F.transform("matrix", lambda v: v.cast("double")).alias("matrix"),
    )
    bases = numbered_models(instances, counts)
    inner = lambda c: F.regexp_replace(F.to_json(c), r"^\[|\]$", "")
    after = lambda first, text: F.concat(F.when(first == 0, "").otherwise(","), text)
    piece = lambda part, at, name, text: F.struct(F.lit(part).alias("part"), at.cast("int").alias("at"), F.lit(name).cast("string").alias("list"), text.alias("text"))
    placed = own.join(bases.select("tile", "model", "first_meshes"), ["tile", "model"])
    nodes = F.array(piece(1, F.col("node"), "roots", after(F.col("node"), F.col("node").cast("string"))), piece(3, F.col("node"), "nodes", after(F.col("node"), inner(F.concat(F.array(top), moved)))))
    scene = placed.select("tile", F.inline(nodes))

    b = lambda part: F.col(f"first_{part}")
    slot = lambda s: F.when(s.isNotNull(), F.struct((s["index"] + b("textures")).alias("index")))

    def material(m: Column) -> Column:
        pbr = m["pbrMetallicRoughness"]
        for c in ("baseColorTexture", "metallicRoughnessTexture"):
            pbr = pbr.withField(c, slot(m["pbrMetallicRoughness"][c]))
        for c in ("normalTexture", "occlusionTexture", "emissiveTexture"):
            m = m.withField(c, slot(m[c]))
        return m.withField("pbrMetallicRoughness", pbr)

    def primitive(p: Column) -> Column:
        attributes = F.transform_values(p["attributes"], lambda k, v: v + b("accessors"))
        return p.withField("attributes", attributes).withField("indices", p["indices"] + b("accessors")).withField("material", p["material"] + b("materials"))

    def texture(t: Column) -> Column:
        source = t["source"] + b("images")
        return F.struct(source.alias("source"), F.struct(F.struct(source.alias("source")).alias("MSFT_texture_dds")).alias("extensions"))

    shifted = {
        "meshes": lambda m: m.withField("primitives", F.transform(m["primitives"], primitive)), "accessors": lambda a: a.withField("bufferView", a["bufferView"] + b("bufferViews")),
        "bufferViews": lambda v: v.withField("buffer", b("buffers")), "materials": material, "textures": texture, "images": lambda i: i,
    }
    held = bases.join(counts.select("model", "f", "n_bytes", *[f"n_{c}" for c in COUNTED]), "model")
    buffer = F.array(F.struct(uri.alias("uri"), F.col("n_bytes").alias("byteLength")))
    of_model = [F.when(F.col(f"n_{c}") > 0, piece(5 + 2 * i, b("buffers"), c, after(b(c), inner(F.transform(f"f.{c}", shifted[c]))))) for i, c in enumerate(COUNTED)]
    of_model.append(piece(5 + 2 * len(COUNTED), b("buffers"), "buffers", after(b("buffers"), inner(buffer))))
    lists = held.select("tile", F.inline(F.array_compact(F.array(*of_model))))

    # What stands around the lists; a list may be missing, but not empty.
    totals = bases.join(counts.select("model", *[f"n_{c}" for c in COUNTED]), "model").groupBy("tile").agg(*[F.sum(f"n_{c}").alias(c) for c in COUNTED])
    opened = lambda c: F.when(F.col(c) > 0, F.lit(f',"{c}":[')).otherwise("")
    closed = lambda c: F.when(F.col(c) > 0, F.lit("]")).otherwise("")
    around = [piece(0, F.lit(0), None, F.lit('{"asset":{"version":"2.0"},"scene":0,"scenes":[{"nodes":[')), piece(2, F.lit(0), None, F.lit(']}],"nodes":['))]
    around.append(piece(4, F.lit(0), None, F.concat(F.lit("]"), opened(COUNTED[0]))))
    around += [piece(6 + 2 * i, F.lit(0), None, F.concat(closed(c), opened(d))) for i, (c, d) in enumerate(zip(COUNTED, COUNTED[1:]))]
    around.append(piece(4 + 2 * len(COUNTED), F.lit(0), None, F.concat(closed(COUNTED[-1]), F.lit(',"buffers":['))))
    around.append(piece(6 + 2 * len(COUNTED), F.lit(0), None, F.lit('],"extensionsUsed":["MSFT_texture_dds"]}')))
    return scene.unionByName(lists).unionByName(totals.select("tile", F.inline(F.array(*around))))


def documents(instances: DataFrame, models: DataFrame, uri: Column | None = None) -> DataFrame:
    """tile, document: the pieces() of each tile as one text, for tiles whose document fits a row."""
    return whole(pieces(instances, models, uri))


def whole(made: DataFrame) -> DataFrame:
    """tile, document of pieces()."""
    rows = made.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("part", "at", "text"))).alias("p"))
    return rows.select("tile", F.array_join("p.text", "").alias("document"))


def tile_instances(placed: DataFrame, seq: Column, model: Column) -> DataFrame:
    """Instances of models (rows of placements.instances with heading, pitch, bank, scale) in the form that documents() takes."""
    matrix = scalars.placement_matrix(F.col("offset"), F.col("heading"), F.col("pitch"), F.col("bank"), F.col("scale"))
    return placed.select("tile", model.cast("string").alias("model"), "size", seq.cast("string").alias("seq"), model.cast("string").alias("name"), matrix.alias("matrix"), F.lit(None).cast("string").alias("prefix"))


def jetway_instances(sims: DataFrame, origin: DataFrame, object_id) -> DataFrame:
    """Instances of the sim objects that are jetways, in the form that documents() takes; other sim objects aren't drawn.

    sims: tile, title, model, is_jetway, seq, lon, lat, alt, heading, pitch, bank, scale. origin: tile, lat, lon, alt of the
    tiles' centroids. Names of nodes get <title>-<id of the position> in front, so that each jetway moves alone.
    """
    at = origin.select("tile", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("alt").alias("alt0"))
    placed = sims.where("is_jetway").join(at, "tile")  # only tiles that have placements are written
    d = lambda c: F.col(c).cast("double")
    offset = scalars.local_offset(d("lon"), d("lat"), d("alt"), d("lat0") * 0 + d("lon0"), d("lat0"), d("alt0"))
    prefix = F.concat_ws("-", "title", object_id(F.col("lat"), F.col("lon")))
    placed = placed.withColumn("offset", offset).withColumn("prefix", prefix)
    matrix = scalars.placement_matrix(F.col("offset"), F.col("heading"), F.col("pitch"), F.col("bank"), F.col("scale"))
    return placed.select("tile", F.col("model").cast("string").alias("model"), F.lit(0).alias("size"), F.col("seq").cast("string").alias("seq"), F.col("prefix").alias("name"), matrix.alias("matrix"), "prefix")


def write_tiles(made: DataFrame, path: str) -> None:
    """One document a tile under path, in the folders of its ten and one degree squares; written again, it is replaced."""
    corner = grid.tile_corner(F.col("tile"))
    folder = F.split(grid.tile_folder(corner["lat"], corner["lon"]), "/")
    rows = made.select(folder[0].alias("square10"), folder[1].alias("square1"), "tile", F.col("document").alias("value"))
    rows.write.mode("overwrite").partitionBy("square10", "square1", "tile").text(path)


def write_pieces(made: DataFrame, path: str) -> None:
    """The documents of pieces(), to the places where write_tiles() writes: a tile's rows are sorted on disk and written one by one."""
    corner = grid.tile_corner(F.col("tile"))
    folder = F.split(grid.tile_folder(corner["lat"], corner["lon"]), "/")
    at = lambda i: F.coalesce(F.get(folder, F.lit(i)), F.lit(""))  # noqa: E731  not null: else the writer sorts again, by these alone
    rows = made.select(at(0).alias("square10"), at(1).alias("square1"), "tile", "part", "at", F.col("text").alias("value"))
    order = ["square10", "square1", "tile"]
    rows = rows.repartition(*order).sortWithinPartitions(*order, "part", "at").select(*order, "value")
    rows.write.mode("overwrite").option("lineSep", " ").partitionBy(*order).text(path)


def write_buffers(models: DataFrame, path: str) -> None:
    """The buffer of each model, under its name; the byte after its end is a line's end and belongs to no view."""
    models.select("model", F.col("bin").cast("string").alias("value")).write.mode("overwrite").partitionBy("model").text(path)


# Text scenes

DEFAULT_MATERIAL = 'MATERIAL "DefaultWhite" rgb 1 1 1  amb 0.2 0.2 0.2  emis 0 0 0  spec 0.5 0.5 0.5  shi 64 trans 0'
AC_PARTS = "path array<int>, node boolean, name string, matrix array<float>, material int, vertices array<array<double>>, surfaces array<array<struct<v: int, u: double, w: double>>>"


def ac_parts(scenes: DataFrame, key: list[str]) -> DataFrame:
    """key, path, node, name, matrix, material, vertices, surfaces: groups and objects of each scene's tree, in tree order.

    path orders a document: a child group adds [0, n], an object [1, n]. Groups with nothing to draw below them are left
    out, and a group's matrix is its own, with the z axis mirrored. A scene without nodes gives loose objects, after the groups.
    """
    own = F.transform(F.coalesce("scene.nodes", F.from_json(F.lit("[]"), "array<struct<name: string, mesh: int, children: array<int>, translation: array<double>, rotation: array<double>, scale: array<double>, matrix: array<double>>>")), lambda n: scalars.flip_axes(scalars.node_matrix(n["matrix"], n["translation"], n["rotation"], n["scale"])))
    ready = scenes.select(*key, F.to_json("scene").alias("json"), "bin", own.alias("own"))
    schema = ", ".join([*(f"`{k}` {scenes.schema[k].dataType.simpleString()}" for k in key), AC_PARTS])

    def drawn(scene, buffer, mesh, name, path):
        found, at = emit.item(scene.get("meshes"), mesh), 0
        for i, p in enumerate(found.get("primitives") or []):
            if made := emit.ac_object(scene, buffer, p):
                yield {"path": [*path, 1, at], "node": False, "name": f"{found.get('name') or name or f'mesh_{mesh}'}_prim{i}", "matrix": None, "material": p.get("material"), "vertices": made[0], "surfaces": made[1]}
                at += 1

    def tree(scene, buffer, own):
        nodes, out = scene.get("nodes") or [], []
        if not nodes:
            for mesh in range(len(scene.get("meshes") or [])):
                for row in drawn(scene, buffer, mesh, None, []):
                    out.append(row | {"path": [1, len(out)]})
            return out

        def visit(node, path, depth):
            if depth > len(nodes):
                raise ValueError("the nodes of a scene form a cycle")
            n = nodes[node] or {}
            rows, kept = list(drawn(scene, buffer, n["mesh"], n.get("name"), path)) if n.get("mesh") is not None else [], 0
            for c in n.get("children") or []:
                if 0 <= c < len(nodes) and (below := visit(c, [*path, 0, kept], depth + 1)):
                    rows, kept = rows + below, kept + 1
            return [{"path": path, "node": True, "name": n.get("name") or f"Node_{node}", "matrix": list(own[node]), "material": None, "vertices": None, "surfaces": None}, *rows] if rows else []

        for r in emit.roots(scene, nodes):
            below = visit(r, [0, sum(len(x["path"]) == 2 for x in out if x["node"])], 1)
            out += below
        return out

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out := tree(json.loads(row.json), bytes(row.bin or b""), row.own):
                    yield pd.DataFrame([{k: getattr(row, k) for k in key} | x for x in out]).astype(object)

    return ready.mapInPandas(run, schema)


def ac_documents(scenes: DataFrame, key: list[str], world: Column) -> DataFrame:
    """key, text: the text scene of each scene that draws anything. world: the name of the whole.

    Materials that look alike are one, after the default; objects refer to them by the merged number.
    """
    n = scalars.number_text
    join = lambda *parts: F.concat_ws("\n", *parts)
    mat = meshes.materials(scenes, key)
    rgb = lambda k=1.0: F.concat_ws(" ", *[n(F.col(c) * k) for c in "rgb"])
    shine = F.concat_ws(" ", *[n(F.col("specular"))] * 3)
    line = F.concat(F.lit('MATERIAL "'), "name", F.lit('" rgb '), rgb(), F.lit("  amb "), rgb(0.2), F.lit("  emis 0 0 0  spec "), shine, F.lit("  shi "), F.col("shininess").cast("string"), F.lit(" trans "), n(F.col("transparency")))
    look = F.format_string("%.3f|%.3f|%.3f|%.3f|%d|%.3f", "r", "g", "b", "specular", "shininess", "transparency")
    mat = mat.select(*key, "material", "two_sided", line.alias("line"), look.alias("look"))
    first = mat.groupBy(*key, "look").agg(F.min(F.struct("material", "line")).alias("m"))
    ids = first.select(*key, "look", "m.line", F.row_number().over(W.partitionBy(*key).orderBy("m.material")).alias("id"))
    merged = mat.drop("line").join(ids, [*key, "look"]).select(*key, "material", "two_sided", "id")
    parts = ac_parts(scenes, key).join(merged, [*key, "material"], "left")
    flags, number = scalars.surface_flags(F.coalesce("two_sided", F.lit(False))), F.coalesce("id", F.lit(0)).cast("string")
    vertex = lambda v: F.concat_ws(" ", n(-v[0]), n(v[1]), n(v[2]))
    ref = lambda r: F.concat_ws(" ", r["v"].cast("string"), n(r["u"]), n(r["w"]))
    surface = lambda s: join(F.concat(F.lit("SURF "), flags), F.concat(F.lit("mat "), number), F.lit("refs 3"), F.array_join(F.transform(s, ref), "\n"))
    title = F.concat(F.lit('name "'), scalars.clean_name(F.col("name")), F.lit('"'))
    body = join(F.lit("OBJECT poly"), title, F.lit("crease 30"), F.concat(F.lit("numvert "), F.size("vertices").cast("string")), F.array_join(F.transform("vertices", vertex), "\n"), F.concat(F.lit("numsurf "), F.size("surfaces").cast("string")), F.array_join(F.transform("surfaces", surface), "\n"), F.lit("kids 0"))
    m = lambda *at: [n(F.get("matrix", F.lit(i)).cast("double")) for i in at]
    still = lambda at, one: F.abs(F.get("matrix", F.lit(at)) - one) <= 1e-5
    loc = F.when(~(still(12, 0) & still(13, 0) & still(14, 0)), F.concat_ws(" ", F.lit("loc"), *m(12, 13, 14)))
    straight = [still(4 * i + j, 1 if i == j else 0) for i in range(3) for j in range(3)]
    turned = ~straight[0]
    for s in straight[1:]:
        turned = turned | ~s
    rot = F.when(turned, F.concat_ws(" ", F.lit("rot"), *m(0, 1, 2, 4, 5, 6, 8, 9, 10)))
    rows = parts.select(*key, "path", "node", F.when(F.col("node"), join(F.lit("OBJECT group"), title, loc, rot)).otherwise(body).alias("text"))
    whole = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", "node", "text"))).alias("l"))
    below = lambda p: F.size(F.filter("l", lambda x: (F.size(x["path"]) == F.size(p) + 2) & (F.slice(x["path"], F.lit(1), F.size(p)) == p))).cast("string")
    kids = lambda x: F.when(x["node"], F.concat(x["text"], F.lit("\nkids "), below(x["path"]))).otherwise(x["text"])
    lines = ids.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("m"))
    out = whole.join(lines, key, "left").withColumn("world", F.concat(F.lit('OBJECT world\nname "'), world, F.lit('"\nkids '), F.size(F.filter("l", lambda x: F.size(x["path"]) == 2)).cast("string")))
    materials = F.when(F.size("m") > 0, F.array_join("m.line", "\n"))
    return out.select(*key, F.concat(join(F.lit("AC3Db"), F.lit(DEFAULT_MATERIAL), materials, "world", F.array_join(F.transform("l", kids), "\n")), F.lit("\n")).alias("text"))
