import json
import struct

import pytest
from pyspark.sql import functions as F

from gridloom.operators import meshes
from gridloom.sources import scenery

KEY = ["doc"]


@pytest.fixture(scope="module")
def scenes(spark):
    buffer = struct.pack("<12f", 0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0) + struct.pack("<6H", 0, 1, 2, 1, 3, 9) + struct.pack("<2H", 0, 65535)
    scene = {
        "nodes": [{"name": "root", "children": [1, 2], "translation": [1, 0, 0]}, {"name": "leaf", "mesh": 0, "translation": [0, 2, 0]}, {"name": "empty"}],
        "meshes": [{"primitives": [{"indices": 1, "material": 0, "attributes": {"POSITION": 0, "TEXCOORD_0": 2}}, {"attributes": {"NORMAL": 0}}, {"attributes": {"POSITION": 0}}]}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"},
            {"bufferView": 2, "componentType": 5123, "count": 1, "type": "VEC2"},
        ],
        "bufferViews": [{"buffer": 0, "byteLength": 48}, {"buffer": 0, "byteOffset": 48, "byteLength": 12}, {"buffer": 0, "byteOffset": 60, "byteLength": 4}],
        "materials": [{"name": 'a"b', "doubleSided": True, "pbrMetallicRoughness": {"baseColorFactor": [2, 0.5, 0, 0.25], "metallicFactor": 1, "roughnessFactor": 0.5}}, {}],
        "images": [{"uri": "t/wall.png"}, {"uri": "t/roof.png"}, {"uri": "t/wall.png"}],
    }
    rows = [(1, json.dumps(scene), buffer), (2, json.dumps(scene | {"scenes": [{"nodes": [1]}], "scene": 0}), buffer)]
    df = spark.createDataFrame(rows, "doc int, json string, bin binary")
    return df.select("doc", F.from_json("json", scenery.GLTF).alias("scene"), "bin")


def test_tree(scenes):
    assert {(r.doc, r.node) for r in meshes.roots(scenes, KEY).collect()} == {(1, 0), (2, 1)}
    world = {(r.doc, r.node): r.matrix for r in meshes.world(scenes, KEY).collect()}
    assert set(world) == {(1, 0), (1, 1), (1, 2), (2, 1)}
    assert world[1, 1][12:15] == [1, 2, 0] and world[2, 1][12:15] == [0, 2, 0]


def test_primitives_and_surfaces(scenes):
    parts = meshes.primitives(scenes.where("doc = 1"), KEY)
    a, b = parts.orderBy("primitive").collect()
    assert a.positions[3] == [1, 1, 0] and a.uv == [[0, 1]] and a.indices == [0, 1, 2, 1, 3, 9] and b.primitive == 2 and b.indices == [0, 1, 2, 3]
    tris = {(r.primitive, r.tid): (r.a, r.b, r.c) for r in meshes.surfaces(parts, key=KEY).collect()}
    assert tris == {(0, 0): (0, 2, 1), (2, 0): (0, 2, 1)}  # the second triangle has an index out of range


def test_materials_and_textures(scenes):
    a, b = meshes.materials(scenes.where("doc = 1"), KEY).orderBy("material").collect()
    assert (a.name, a.r, a.g, a.shininess, a.transparency, a.two_sided) == ("a_b", 1.0, 0.5, 64, 0.75, True)
    assert a.specular == pytest.approx(0.54) and (b.name, b.shininess, b.transparency, b.two_sided) == ("Unnamed", 0, 0.0, False)
    slots = meshes.texture_slots(scenes.where("doc = 1"), KEY)
    assert slots.count() == 0


def test_depth_and_cycles(spark):
    deep = {"nodes": [{"children": [i + 1], "translation": [1, 0, 0]} for i in range(300)] + [{"mesh": 0, "translation": [1, 0, 0]}]}
    twice = {"nodes": [{"children": [2]}, {"children": [2]}, {"mesh": 1}]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(twice))], "doc int, json string").select("doc", F.from_json("json", scenery.GLTF).alias("scene"))
    got = meshes.world(df, KEY).where("mesh is not null").collect()
    assert [r.matrix[12] for r in got if r.doc == 1] == [301.0] and sum(r.doc == 2 for r in got) == 2
    loop = spark.createDataFrame([(1, json.dumps({"nodes": [{"children": [1]}, {"children": [0]}]}))], "doc int, json string").select("doc", F.from_json("json", scenery.GLTF).alias("scene"))
    with pytest.raises(Exception, match="cycle"):
        meshes.world(loop, KEY).collect()


def test_normals_ranges_and_visibility(spark):
    buffer = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<12b", 0, 0, 127, 0, 0, -127, 0, 0, 0, 127, 0, 0) + struct.pack("<9H", 0, 1, 2, 2, 1, 0, 0, 2, 1)
    ranged = {"indices": 2, "material": 0, "attributes": {"POSITION": 0, "NORMAL": 1, "TANGENT": 1}, "extras": {"ASOBO_primitive": {"StartIndex": 3, "PrimitiveCount": 1}}}
    scene = {
        "meshes": [{"primitives": [ranged, {"indices": 2, "material": 1, "attributes": {"POSITION": 0}}, {"indices": 2, "material": 2, "attributes": {"POSITION": 0}}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5120, "count": 3, "type": "VEC4"}, {"bufferView": 2, "componentType": 5123, "count": 9, "type": "SCALAR"}],
        "bufferViews": [{"byteLength": 36}, {"byteOffset": 36, "byteLength": 12}, {"byteOffset": 48, "byteLength": 18}],
        "materials": [{"normalTexture": {"index": 0}, "pbrMetallicRoughness": {"baseColorTexture": {"index": 1}}}, {"extensions": {"ASOBO_material_invisible": {}}, "emissiveTexture": {"index": 0}}, {}],
        "textures": [{"source": 1}, {"source": 0}], "images": [{"uri": "a/Wall.PNG"}, {"uri": "b\\bump.png"}],
    }
    df = spark.createDataFrame([(1, json.dumps(scene), buffer)], "doc int, json string, bin binary").select("doc", F.from_json("json", scenery.GLTF).alias("scene"), "bin")
    parts = meshes.primitives(df, KEY)
    a, b, c = parts.orderBy("primitive").collect()
    assert a.normals == [[0, 0, 127], [0, -127, 0], [0, 127, 0]] and a.tangents[1] == [0, -127, 0, 0] and b.normals is None
    assert (a.start, a["count"], a.base, b["count"]) == (3, 1, None, None) and (a.visible, b.visible, c.visible) == (True, False, True)
    assert parts.where("primitive = 0").select(meshes.facing_back(F.col("normals")).alias("n")).first().n[1] == [0, 127, 0]
    rows = lambda strict: sorted((r.primitive, r.a, r.b, r.c) for r in meshes.surfaces(parts, F.col("start"), F.col("count"), F.col("base"), KEY, strict).collect())
    assert rows(False) == [(0, 2, 0, 1), *((p, *t) for p in (1, 2) for t in ((0, 1, 2), (0, 2, 1), (2, 0, 1)))] and rows(True) == [(0, 2, 0, 1)]
    t = meshes.texture_rewrites(meshes.texture_slots(df, KEY), KEY).orderBy("material", "slot").collect()
    assert [(r.material, r.channel, r.image, r.out) for r in t] == [(0, "baseColorTexture", 0, "Wall.dds"), (0, "normalTexture", 1, "bump.dds"), (1, "emissiveTexture", 1, "bump.dds")]
