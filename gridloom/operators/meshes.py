"""glTF scenes as relations: nodes, roots, world matrices, primitives, vertices, triangles and materials.

Scenes come from sources.scenery.scenes: one row per scene with its parsed JSON (`scene`) and binary buffer (`bin`). All
index chains (primitive to accessor to view, node to mesh, material to texture) are looked up in the row's own arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..sources import decode

KEY = ["file", "guid", "offset", "chunk_no", "glb_no"]


def at(array: Column, index: Column) -> Column:
    """An element by its zero-based index; null if there is none."""
    return F.when(index >= 0, F.get(array, index))


def nodes(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, node, name, mesh, children, matrix (its own, row-major float)."""
    n = scenes.select(*key, F.posexplode("scene.nodes").alias("node", "n"))
    own = scalars.node_matrix(F.col("n.matrix"), F.col("n.translation"), F.col("n.rotation"), F.col("n.scale"))
    return n.select(*key, "node", "n.name", "n.mesh", F.coalesce("n.children", F.array().cast("array<int>")).alias("children"), own.alias("matrix"))


def root_list() -> Column:
    """The nodes that a scene lists; else those that are no one's children; else all."""
    every = F.sequence(F.lit(0), F.size("scene.nodes") - 1)
    children = F.flatten(F.transform("scene.nodes", lambda n: F.coalesce(n["children"], F.array().cast("array<int>"))))
    listed = at(F.col("scene.scenes"), F.coalesce("scene.scene", F.lit(0)))["nodes"]
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(some(listed), some(F.array_except(every, children)), every)


def roots(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, node: the nodes at which a scene begins."""
    return scenes.where(F.size("scene.nodes") > 0).select(*key, F.explode(root_list()).alias("node"))


def walk(children: list, own: list, starts: list) -> list[tuple[int, list[float]]]:
    """The nodes reached from the starts, with their matrices in the scene; each way down counts. A cycle is an error."""
    own = [np.array(m, np.float32).reshape(4, 4) for m in own]
    out, todo = [], [(int(r), None, 1) for r in reversed(starts) if 0 <= r < len(own)]
    while todo:
        node, above, depth = todo.pop()
        if depth > len(own):
            raise ValueError("the nodes of a scene form a cycle")
        matrix = own[node] if above is None else own[node] @ above
        out.append((node, matrix.ravel().tolist()))
        todo += [(int(c), matrix, depth + 1) for c in reversed(children[node]) if 0 <= c < len(own)]
    return out


def world(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, node, mesh, matrix: every node that is reached from the roots, with its matrix in the scene.

    Matrices are composed inside of the scene's row, whatever its depth: no join and no shuffle.
    """
    own = F.transform("scene.nodes", lambda n: scalars.node_matrix(n["matrix"], n["translation"], n["rotation"], n["scale"]))
    children = F.transform("scene.nodes", lambda n: F.coalesce(n["children"], F.array().cast("array<int>")))
    ready = scenes.where(F.size("scene.nodes") > 0).select(*key, F.col("scene.nodes.mesh").alias("mesh"), children.alias("children"), own.alias("own"), root_list().alias("starts"))
    schema = ", ".join([*(f"`{k}` {scenes.schema[k].dataType.simpleString()}" for k in key), "node int, mesh int, matrix array<float>"])

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = walk(row.children, row.own, list(row.starts))
                if found:
                    out = pd.DataFrame({"node": [n for n, _ in found], "mesh": pd.array([row.mesh[n] if not pd.isna(row.mesh[n]) else None for n, _ in found], "Int32"), "matrix": [m for _, m in found]})
                    yield pd.concat([pd.DataFrame({k: [getattr(row, k)] * len(out) for k in key}), out], axis=1)

    return ready.mapInPandas(run, schema)


ROWS = T.ArrayType(T.ArrayType(T.FloatType()))


@F.pandas_udf(ROWS)
def read_rows(buffer: pd.Series, offset: pd.Series, stride: pd.Series, count: pd.Series, component: pd.Series, kind: pd.Series, normalise: pd.Series) -> pd.Series:
    """Rows of a typed array; null where there is no array. Under normalise, shorts are halves: texture coordinates."""
    out = []
    for b, o, s, n, c, k, norm in zip(buffer, offset, stride, count, component.where(~(normalise & (component == 5122)), 5131), kind, normalise):
        known = b is not None and not pd.isna(c) and k in decode.WIDTHS and int(c) in decode.COMPONENTS
        out.append(decode.accessor(bytes(b), int(o), int(s), int(n), int(c), k, bool(norm)).astype("float32").tolist() if known else None)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def read_indices(buffer: pd.Series, offset: pd.Series, stride: pd.Series, count: pd.Series, component: pd.Series) -> pd.Series:
    """An index array; null where there is no array."""
    known = lambda b, c: b is not None and not pd.isna(c) and int(c) in decode.COMPONENTS
    return pd.Series([decode.accessor(bytes(b), int(o), int(s), int(n), int(c), "SCALAR").ravel().astype(int).tolist() if known(b, c) else None for b, o, s, n, c in zip(buffer, offset, stride, count, component)])


def located(accessor: Column) -> list[Column]:
    """offset, stride, count, component of an accessor, through its view."""
    view = at(F.col("scene.bufferViews"), accessor["bufferView"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [zero(view["byteOffset"]) + zero(accessor["byteOffset"]), zero(view["byteStride"]), zero(accessor["count"]), accessor["componentType"]]


def primitives(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, mesh, primitive, material, positions (x, y, z), uv and uv2 (u, v), normals (x, y, z), tangents (x, y, z, w),
    indices, start, count, base (of the range of triangles; null if not given), visible.

    A primitive without positions is left out. Without indices, the vertices are taken in their order. What a primitive
    lacks is null. One whose material is marked as invisible or as an occluder isn't visible.
    """
    p = scenes.select(*key, "scene", "bin", F.posexplode("scene.meshes").alias("mesh", "m")).select(*key, "scene", "bin", "mesh", F.posexplode("m.primitives").alias("primitive", "p"))
    acc = lambda i: at(F.col("scene.accessors"), i)
    attribute = lambda name: acc(F.col("p.attributes")[name])
    where = {"positions": attribute("POSITION"), "normals": attribute("NORMAL"), "tangents": attribute("TANGENT"), "uv": attribute("TEXCOORD_0"), "uv2": attribute("TEXCOORD_1"), "indices": acc(F.col("p.indices"))}
    for name, accessor in where.items():
        p = p.withColumn(f"__{name}", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(located(accessor))], F.coalesce(accessor["type"], F.lit("")).alias("kind")))
    part = lambda name: [F.col("bin"), *[F.col(f"__{name}.c{i}") for i in range(4)]]
    rows = lambda name, kind, normalise=False: read_rows(*part(name), kind, F.lit(normalise))
    own = lambda name: F.col(f"__{name}.kind")
    p = p.withColumn("positions", rows("positions", F.lit("VEC3"))).withColumn("indices", read_indices(*part("indices")))
    p = p.withColumns({"uv": rows("uv", F.lit("VEC2"), True), "uv2": rows("uv2", F.lit("VEC2"), True), "tangents": rows("tangents", own("tangents"))})
    p = p.withColumn("normals", F.transform(rows("normals", own("normals")), lambda v: F.slice(v, 1, 3)))  # stored in threes or fours
    p = p.where(F.size("positions") > 0).withColumn("indices", F.coalesce("indices", F.sequence(F.lit(0), F.size("positions") - 1)))
    marks, range_ = at(F.col("scene.materials"), F.col("p.material"))["extensions"], F.col("p.extras.ASOBO_primitive")
    visible = ~(F.coalesce(marks["ASOBO_material_invisible"].isNotNull(), F.lit(False)) | F.coalesce(marks["ASOBO_material_environment_occluder"].isNotNull(), F.lit(False)))
    return p.select(
        *key, "mesh", "primitive", F.col("p.material").alias("material"), "positions", "uv", "uv2", "normals", "tangents", "indices",
        range_["StartIndex"].alias("start"), range_["PrimitiveCount"].alias("count"), range_["BaseVertexIndex"].alias("base"), visible.alias("visible"),
    )


def facing_back(rows: Column) -> Column:
    """Normals or tangents (arrays) with every value negated."""
    return F.transform(rows, lambda v: F.transform(v, lambda x: -x))


def surfaces(parts: DataFrame, start: Column | None = None, count: Column | None = None, base: Column | None = None, key: list[str] = KEY, strict: bool = False) -> DataFrame:
    """key, mesh, primitive, material, tid, a, b, c: triangles of index ranges, turned (first, third, second).

    start and count (of triangles) give the range in the index array, base is added to each index; a count that is missing
    or zero takes all that is left (strict: takes none). Triangles with an index out of range are left out.
    """
    start, base = F.lit(0) if start is None else F.coalesce(start, F.lit(0)), F.lit(0) if base is None else F.coalesce(base, F.lit(0))
    rest = F.floor((F.size("indices") - start) / 3)
    n = F.coalesce(count, F.lit(0)) if strict and count is not None else rest if count is None else F.coalesce(F.nullif(count, F.lit(0)), rest)
    corner = lambda t, k: F.get("indices", (start + t * 3 + k).cast("int")) + base
    tris = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda t: F.struct(corner(t, 0).alias("a"), corner(t, 2).alias("b"), corner(t, 1).alias("c")))
    rows = parts.select(*key, "mesh", "primitive", "material", F.size("positions").alias("n"), F.posexplode(tris).alias("tid", "t"))
    fits = [F.coalesce(F.col(f"t.{k}").between(0, F.col("n") - 1), F.lit(False)) for k in "abc"]
    return rows.where(fits[0] & fits[1] & fits[2]).select(*key, "mesh", "primitive", "material", "tid", "t.*")


def materials(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, material, name, r, g, b, specular, shininess, transparency, two_sided, with defaults where a scene is silent."""
    m = scenes.select(*key, F.posexplode("scene.materials").alias("material", "m"))
    color = lambda i: scalars.clamp(F.coalesce(F.get("m.pbrMetallicRoughness.baseColorFactor", F.lit(i)), F.lit(1.0)))
    phong = scalars.phong(F.col("m.pbrMetallicRoughness.metallicFactor"), F.col("m.pbrMetallicRoughness.roughnessFactor"), color(3))
    return m.select(*key, "material", scalars.clean_name(F.col("m.name")).alias("name"), color(0).alias("r"), color(1).alias("g"), color(2).alias("b"), phong.alias("q"), F.coalesce("m.doubleSided", F.lit(False)).alias("two_sided")).select(*key, "material", "name", "r", "g", "b", "q.*", "two_sided")


#: The texture slots of a material, in the order in which they are numbered.
CHANNELS = ["pbrMetallicRoughness.baseColorTexture", "pbrMetallicRoughness.metallicRoughnessTexture", "normalTexture", "occlusionTexture", "emissiveTexture"]


def texture_slots(scenes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, material, slot, channel, texture, uri: the textures that the materials use, through texture and image."""
    m = scenes.select(*key, "scene", F.posexplode("scene.materials").alias("material", "m"))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(c.rsplit(".")[-1]).alias("channel"), F.col(f"m.{c}.index").alias("texture")) for i, c in enumerate(CHANNELS)])
    t = m.select(*key, "scene", "material", F.explode(slots).alias("s")).select(*key, "scene", "material", "s.*").where("texture is not null")
    uri = at(F.col("scene.images"), at(F.col("scene.textures"), F.col("texture"))["source"])["uri"]
    return t.select(*key, "material", "slot", "channel", "texture", uri.alias("uri")).where("uri is not null")


def texture_rewrites(slots: DataFrame, key: list[str] = KEY, extension: str = ".dds") -> DataFrame:
    """slots with `image` and `out`: each path is one image, numbered by its first use (material, then slot), under its
    file name with the new extension."""
    first = slots.groupBy(*key, "uri").agg(F.min(F.struct("material", "slot")).alias("seen"))
    ids = first.select(*key, "uri", (F.row_number().over(W.partitionBy(*key).orderBy("seen")) - 1).alias("image"))
    return slots.join(ids, [*key, "uri"]).withColumn("out", F.concat(scalars.stem(F.col("uri")), F.lit(extension)))
