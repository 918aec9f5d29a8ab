"""DataFrames from scenery files: listings, containers, model payloads, terrain, and side files."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid, scalars
from . import decode

FILES = "path string, modificationTime timestamp, length long, content binary"
OBJECTS = "file string, kind string, offset long, guid string, title string, path string, lon double, lat double, alt double, flags int, pitch double, bank double, heading double, complexity int, scale double"
DIRECTORY = "file string, guid string, offset long, size long"
AIRPORT = "file string, airport long, kind string, offset long, payload string"
CHUNKS = "file string, guid string, offset long, chunk string, chunk_no int, glb_no int, data binary"


def files(spark: SparkSession, root: str, extension: str = "bgl", recursive: bool = True, any_case: bool = True) -> DataFrame:
    """The files under root with an extension. A missing root gives no rows."""
    glob = "*." + ("".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else x for x in extension) if any_case else extension)
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILES)


def containers(found: DataFrame) -> DataFrame:
    """Files that are scenery containers, by their marks."""
    mark = lambda at: F.hex(F.substring("content", at, 4))
    return found.where((F.col("length") >= 0x38) & (mark(1) == decode.MAGIC_AT_0.hex().upper()) & (mark(17) == decode.MAGIC_AT_16.hex().upper()))


def decoded(found: DataFrame, rows, schema: str) -> DataFrame:
    """rows(content) of each file, with the file's path in front; a file is one task's work."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = [{"file": path} | row for row in rows(bytes(content))]
                if out:
                    yield pd.DataFrame(out).reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return containers(found).select("path", "content").mapInPandas(run, schema)


def objects(found: DataFrame) -> DataFrame:
    """Placements and sim objects, with tile and flag labels; those inside of jetways too."""
    out = decoded(found, decode.objects, OBJECTS)
    return out.withColumns({"tile": F.coalesce(grid.tile_key(F.col("lat"), F.col("lon")), F.lit(0)), "flag_labels": scalars.flag_labels(F.col("flags"))})


def model_directory(found: DataFrame, first_only: bool = True, plain: bool = False, base: int | None = None) -> DataFrame:
    """Where the payload of each model lies; payloads themselves are left in the files until a join has chosen them."""
    return decoded(found, lambda b: decode.model_directory(b, first_only, plain, base), DIRECTORY)


def airports(found: DataFrame) -> DataFrame:
    """Airports and their records as tagged rows; payloads are JSON."""
    return decoded(found, decode.airport_rows, AIRPORT)


def model_chunks(found: DataFrame, wanted: DataFrame, first_glb: bool = True) -> DataFrame:
    """XML and GLB chunks of the wanted payloads (file, guid, offset, size); first_glb keeps one GLB of a chunk.

    A file meets the list of its own ranges, once, and the decoder cuts the payloads out.
    """
    ranges = wanted.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_set(F.struct("offset", "size", "guid"))).alias("ranges"))
    picked = found.select("path", "content").join(ranges, "path")

    def run(batches):
        for pdf in batches:
            for path, content, cuts in zip(pdf["path"], pdf["content"], pdf["ranges"]):
                content = memoryview(content)
                for cut in cuts:
                    payload = bytes(content[cut["offset"] : cut["offset"] + cut["size"]])
                    out = [{"file": path, "guid": cut["guid"], "offset": cut["offset"]} | c for c in decode.chunks(payload) if not first_glb or not c["glb_no"]]
                    if out:
                        yield pd.DataFrame(out).astype(object).where(lambda x: x.notna(), None)

    return picked.mapInPandas(run, CHUNKS)


GLB = T.StructType([T.StructField("json", T.StringType()), T.StructField("bin", T.BinaryType())])


@F.pandas_udf(GLB)
def split_glb(data: pd.Series) -> pd.DataFrame:
    """JSON text and binary buffer of GLBs; null for what isn't one."""
    return pd.DataFrame([decode.split_glb(bytes(b)) if b is not None else None or (None, None) for b in data], columns=["json", "bin"])


# Names of the fields of scene documents; the last ones of `materials` and `primitives` are a vendor's.
GLTF = """struct<asset: struct<version: string>, scene: int, scenes: array<struct<nodes: array<int>>>,
    nodes: array<struct<name: string, mesh: int, children: array<int>, translation: array<double>, rotation: array<double>, scale: array<double>, matrix: array<double>>>,
    meshes: array<struct<name: string, primitives: array<struct<indices: int, material: int, attributes: map<string, int>, extras: struct<ASOBO_primitive: struct<BaseVertexIndex: int, StartIndex: int, PrimitiveCount: int>>>>>>,
    accessors: array<struct<bufferView: int, byteOffset: int, componentType: int, count: int, type: string>>, bufferViews: array<struct<buffer: int, byteOffset: int, byteLength: int, byteStride: int>>,
    buffers: array<struct<uri: string, byteLength: int>>,
    materials: array<struct<name: string, doubleSided: boolean, alphaMode: string, normalTexture: struct<index: int>, occlusionTexture: struct<index: int>, emissiveTexture: struct<index: int>, emissiveFactor: array<double>,
        pbrMetallicRoughness: struct<baseColorFactor: array<double>, metallicFactor: double, roughnessFactor: double, baseColorTexture: struct<index: int>, metallicRoughnessTexture: struct<index: int>>,
        extensions: struct<ASOBO_material_invisible: map<string, string>, ASOBO_material_environment_occluder: map<string, string>>>>,
    textures: array<struct<source: int>>, images: array<struct<uri: string>>>"""


def scenes(chunks: DataFrame) -> DataFrame:
    """file, guid, offset, chunk_no, glb_no, scene (parsed), bin of the GLBs that hold meshes, accessors and views.

    JSON that doesn't parse is left out.
    """
    split = chunks.where("chunk = 'GLB'").withColumn("g", split_glb("data")).withColumn("scene", F.from_json("g.json", GLTF))
    full = [F.size(f"scene.{x}") > 0 for x in ("meshes", "accessors", "bufferViews")]
    return split.where(full[0] & full[1] & full[2]).select("file", "guid", "offset", "chunk_no", "glb_no", "scene", F.col("g.bin").alias("bin"))


def text_scenes(spark: SparkSession, root: str) -> DataFrame:
    """file, guid (null), offset, chunk_no, glb_no (0), scene, bin of the glTF text files under root, without the empty ones.

    bin joins a scene's buffers in their order, external files (beside the scene) and base64 texts alike, and the scene's
    views count from its start. A scene of which a buffer is missing or a JSON doesn't parse is left out.
    """
    found = files(spark, root, "gltf").select(F.col("path").alias("file"), F.from_json(F.decode("content", "UTF-8"), GLTF).alias("scene"))
    found = found.where((F.size("scene.meshes") > 0) & (F.size("scene.accessors") > 0) & (F.size("scene.bufferViews") > 0))
    parts = found.select("file", F.posexplode("scene.buffers").alias("i", "b")).select("file", "i", "b.uri", "b.byteLength")
    inline = F.col("uri").startswith("data:")
    packed = parts.where(inline).select("file", "i", F.unbase64(F.substring_index("uri", ",", -1)).alias("data"))
    beside = parts.where(~inline).withColumn("path", F.concat(scalars.folder(F.col("file")), F.lit("/"), F.replace("uri", F.lit("\\"), F.lit("/"))))
    stored = beside.join(files(spark, root, "bin").select("path", F.col("content").alias("data")), "path").select("file", "i", "data")
    joined = packed.unionByName(stored).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("p"))
    held = found.join(joined, "file").where(F.size("p") == F.size("scene.buffers"))
    base = lambda buffer: F.aggregate(F.slice("p", F.lit(1), buffer), F.lit(0), lambda n, x: n + F.octet_length(x["data"]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    views = F.transform("scene.bufferViews", lambda v: v.withField("byteOffset", zero(v["byteOffset"]) + base(zero(v["buffer"]))).withField("buffer", F.lit(0)))
    whole = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["data"]))
    nil = F.lit(0)
    return held.select("file", F.lit(None).cast("string").alias("guid"), nil.cast("long").alias("offset"), nil.alias("chunk_no"), nil.alias("glb_no"), F.col("scene").withField("bufferViews", views).alias("scene"), whole.alias("bin"))


def model_info(chunks: DataFrame) -> DataFrame:
    """file, guid, offset, name, lods (file, min_size) of the XML chunks; sizes that aren't numbers are left out."""
    # The condition stands in the column too: filters that Spark infers may read it before the rows are chosen.
    xml = chunks.where("chunk = 'GXML'").withColumn("xml", F.when(F.col("chunk") == "GXML", F.decode("data", "UTF-8")))
    name = F.coalesce(F.nullif(F.xpath_string("xml", F.lit("//ModelInfo/@name")), F.lit("")), F.lit("Unnamed_Model"))
    lods = F.arrays_zip(F.xpath("xml", F.lit("//LOD/@ModelFile")).alias("file"), F.xpath("xml", F.lit("//LOD/@minSize")).alias("min_size"))
    sized = F.filter(F.transform(lods, lambda x: F.struct(F.replace(x["file"], F.lit(".gltf"), F.lit("")).alias("file"), x["min_size"].try_cast("int").alias("min_size"))), lambda x: x["min_size"].isNotNull())
    return xml.select("file", "guid", "offset", F.replace(F.replace(name, F.lit(".gltf"), F.lit("")), F.lit(" "), F.lit("_")).alias("name"), sized.alias("lods"))


def terrain(spark: SparkSession, root: str, extension: str = "btg*") -> DataFrame:
    """file, tile, centre, vertices and triangles of the meshes (plain or gzip) under a local mesh folder.

    The tile is the number at the start of a file's name. A file that isn't a mesh gives no row, nor does a missing root.
    """
    return terrain_meshes(files(spark, root, extension))


def terrain_meshes(found: DataFrame) -> DataFrame:
    """terrain() of files (path, content)."""
    schema = "file string, centre array<double>, vertices array<array<double>>, triangles array<array<int>>"

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = bytes(content)
                mesh = decode.terrain(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                if mesh:
                    yield pd.DataFrame({"file": [path], "centre": [list(mesh[0])], "vertices": [[list(v) for v in mesh[1]]], "triangles": [[list(t) for t in mesh[2]]]})

    tile = F.regexp_extract(scalars.file_name(F.col("file")), r"^(\d+)", 1).try_cast("int")
    return found.select("path", "content").mapInPandas(run, schema).withColumn("tile", tile)


def terrain_vertices(meshes: DataFrame) -> DataFrame:
    """tile, mesh (the file), vid, lat, lon, alt: vertices moved to the sphere's centre and projected."""
    v = meshes.select("tile", F.col("file").alias("mesh"), "centre", F.posexplode("vertices").alias("vid", "v"))
    at = [F.col("centre")[i] + F.col("v")[i] for i in range(3)]
    return v.select("tile", "mesh", "vid", scalars.geodetic(*at).alias("g")).select("tile", "mesh", "vid", "g.*")


def terrain_triangles(meshes: DataFrame, vertices: DataFrame) -> DataFrame:
    """tile, mesh, tid and the corners a, b, c of triangles whose vertices all exist."""
    t = meshes.select("tile", F.col("file").alias("mesh"), F.posexplode("triangles").alias("tid", "t"))
    for i, k in enumerate("abc"):
        v = vertices.select("tile", "mesh", F.col("vid").alias(f"{k}_vid"), *[F.col(x).alias(f"{k}_{x}") for x in ("lat", "lon", "alt")])
        t = t.withColumn(f"{k}_vid", F.col("t")[i]).join(v, ["tile", "mesh", f"{k}_vid"])
    return t.select("tile", "mesh", "tid", *[f"{k}_{x}" for k in "abc" for x in ("lat", "lon", "alt")])


def sim_configs(spark: SparkSession, root: str) -> DataFrame:
    """path, title, model, texture of every block of the sim.cfg files under root."""
    found = files(spark, root, "cfg").where(F.lower(scalars.file_name(F.col("path"))) == "sim.cfg").select("path", F.decode("content", "UTF-8").alias("text"))
    return config_blocks(found)


def config_blocks(texts: DataFrame) -> DataFrame:
    """path, title, model, texture of every block of the texts (path, text): title, then model and texture, where given."""
    block = r"(?i)title=[^\r\n]*\r?\n(?:model=[^\r\n]*\r?\n)?(?:texture=[^\r\n]*)?"
    blocks = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("b"))
    return config_values(blocks, "b")


def config_values(blocks: DataFrame, text: str) -> DataFrame:
    """path, title, model, texture of blocks of `key=value` lines."""
    value = lambda key: F.trim(F.regexp_extract(text, rf"(?im)^{key}=([^\r\n]*)", 1)).alias(key)
    return blocks.select("path", value("title"), value("model"), value("texture"))


def normal_model(text: str) -> object:
    """Value of `normal=` in the text of a model.cfg, as a column."""
    return F.trim(F.regexp_extract(text, r"normal=([^\r\n]+)", 1))


# The kinematic chains that make an object a jetway.
CHAINS = ("IK_MainHandle", "IK_SecondaryHandle", "IK_WheelsGroundLock")


def object_xml(objects: DataFrame, xml: str = "xml") -> DataFrame:
    """objects with what their XML says: lods (file, min_size), is_jetway, chains (name, start, end), reach.

    The XML may have several roots. Sizes are read under either spelling, and those that aren't numbers count as 0.
    is_jetway needs all three chains; reach sums the spans of the X constraints; rotation is the first Bank constraint that isn't zero at both ends.
    """
    doc = F.concat(F.lit("<r>"), F.regexp_replace(F.col(xml), r"<\?xml[^>]*\?>", ""), F.lit("</r>"))
    texts = lambda path: F.xpath("__doc", F.lit(path))
    one = lambda path: F.xpath_string("__doc", F.lit(path))
    number = lambda path: F.transform(texts(path), lambda v: v.try_cast("double"))
    chains = F.array(*[F.struct(F.lit(c).alias("name"), one(f"(//IKChain[@Name='{c}']//Start)[1]").alias("start"), one(f"(//IKChain[@Name='{c}']//End)[1]").alias("end")) for c in CHAINS])
    sizes = F.coalesce(F.nullif(texts("//LOD/@MinSize"), F.array().cast("array<string>")), texts("//LOD/@minSize"))
    lods = F.transform(F.arrays_zip(texts("//LOD/@ModelFile").alias("file"), sizes.alias("min_size")), lambda x: F.struct(x["file"].alias("file"), F.coalesce(x["min_size"].try_cast("int"), F.lit(0)).alias("min_size")))
    spans = F.zip_with(number("//IKConstraint//X/@max"), number("//IKConstraint//X/@min"), lambda hi, lo: hi - lo)
    out = objects.withColumn("__doc", doc).withColumns({"lods": lods, "chains": chains, "reach": F.aggregate(spans, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))})
    turns = F.filter(F.zip_with(number("//IKConstraint//Bank/@max"), number("//IKConstraint//Bank/@min"), lambda hi, lo: F.struct(F.coalesce(hi, F.lit(0.0)).alias("max"), F.coalesce(lo, F.lit(0.0)).alias("min"))), lambda t: (t["max"] != 0) | (t["min"] != 0))
    out = out.withColumn("rotation", F.get(turns, F.lit(0)))
    return out.withColumn("is_jetway", F.forall("chains", lambda c: c["start"] != "")).drop("__doc")
