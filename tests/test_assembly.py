import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from gridloom.functions import bytewise
from gridloom.operators import assembly, placements, scene
from gridloom.sources import emit, scenery, sinks

IDENTITY = [float(i % 5 == 0) for i in range(16)]
BUFFER = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 2) + struct.pack("<12b", 0, 0, 127, 0, 0, -127, 0, 0, 0, 127, 0, 0) + struct.pack("<3H", 0, 1, 2) + bytes(2) + struct.pack("<6e", 0, 0, 1, 0, 0.5, 0.25)


def model(name="m", **more):
    counted = {"ASOBO_primitive": {"PrimitiveCount": 1}}
    return {
        "nodes": [{"name": f"{name}_root", "children": [1, 2]}, {"name": f"{name}_leaf", "mesh": 0, "translation": [0, 5, 1]}, {"name": "nothing"}],
        "meshes": [{"name": f"{name}_mesh", "primitives": [{"indices": 2, "material": 1, "attributes": {"POSITION": 0, "NORMAL": 1, "TANGENT": 1, "TEXCOORD_0": 3}, "extras": counted}, {"indices": 2, "material": 0, "attributes": {"POSITION": 0}, "extras": counted}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5120, "count": 3, "type": "VEC4"}, {"bufferView": 2, "componentType": 5123, "count": 3, "type": "SCALAR"}, {"bufferView": 3, "componentType": 5122, "count": 3, "type": "VEC2"}],
        "bufferViews": [{"byteLength": 36}, {"byteOffset": 36, "byteLength": 12}, {"byteOffset": 48, "byteLength": 6}, {"byteOffset": 56, "byteLength": 12}],
        "materials": [{"name": "ghost", "extensions": {"ASOBO_material_invisible": {}}}, {"name": "wall", "doubleSided": True, "pbrMetallicRoughness": {"baseColorFactor": [0.5, 0.5, 0.5, 1.0], "metallicFactor": 0.0, "baseColorTexture": {"index": 0}}, "normalTexture": {"index": 1}}],
        "textures": [{"source": 0}, {"source": 1}], "images": [{"uri": f"t/{name}.png"}, {"uri": "t/bump.png"}],
    } | more


@pytest.fixture(scope="module")
def scenes(spark):
    rows = [("a", json.dumps(model("a")), BUFFER), ("b", json.dumps(model("b")), BUFFER)]
    return spark.createDataFrame(rows, "doc string, json string, bin binary").select("doc", F.from_json("json", scenery.GLTF).alias("scene"), "bin")


def check(document, buffers):
    """Every index of a document is in range, and every view in its buffer."""
    n = {k: len(document.get(k, [])) for k in ("nodes", "meshes", "accessors", "bufferViews", "buffers", "materials", "textures", "images")}
    parents = [c for x in document["nodes"] for c in x.get("children", [])]
    assert len(parents) == len(set(parents)) and not set(parents) & set(document["scenes"][0]["nodes"])
    assert sorted(parents + document["scenes"][0]["nodes"]) == list(range(n["nodes"]))
    assert all(x.get("mesh", 0) < n["meshes"] for x in document["nodes"])
    for mesh in document["meshes"]:
        for p in mesh["primitives"]:
            assert all(v < n["accessors"] for v in [*p["attributes"].values(), p["indices"]]) and p.get("material", 0) < n["materials"]
    for a in document["accessors"]:
        view = document["bufferViews"][a["bufferView"]]
        own = document["buffers"][view["buffer"]]
        assert view["byteOffset"] + view["byteLength"] <= own["byteLength"] == len(buffers[own["uri"]])
    for m in document["materials"]:
        for slot in (m.get("normalTexture"), m.get("pbrMetallicRoughness", {}).get("baseColorTexture")):
            assert slot is None or document["textures"][slot["index"]]["source"] < n["images"]
    return n


def test_fragment():
    made, blob = emit.fragment(model("x"), BUFFER)
    assert len(made["meshes"][0]["primitives"]) == 1  # the invisible one is left out
    p = made["meshes"][0]["primitives"][0]
    read = lambda i, dtype: memoryview(blob)[made["bufferViews"][made["accessors"][i]["bufferView"]]["byteOffset"] :][: made["bufferViews"][made["accessors"][i]["bufferView"]]["byteLength"]].cast(dtype).tolist()
    assert read(p["indices"], "I") == [0, 2, 1]
    assert read(p["attributes"]["NORMAL"], "f") == [0, 0, -1, 0, 1, 0, 0, -1, 0] and read(p["attributes"]["TEXCOORD_0"], "f") == [0, 1, 1, 1, 0.5, 0.75]
    assert made["accessors"][p["attributes"]["POSITION"]]["max"] == [1, 1, 2] and made["roots"] == [0]
    assert [i["uri"] for i in made["images"]] == ["x.dds", "bump.dds"] and made["materials"][1]["normalTexture"] == {"index": 1}
    uncounted = model(meshes=[{"primitives": [{"indices": 2, "attributes": {"POSITION": 0}}]}])
    assert emit.fragment(uncounted, BUFFER)[0]["meshes"] == [] and len(emit.fragment(uncounted, BUFFER, strict=False)[0]["meshes"]) == 1
    assert emit.fragment({}, b"")[0]["nodes"] == []


def test_tile_documents(spark, scenes, tmp_path):
    models = assembly.fragments(scenes, F.col("doc"))
    rows = [(942050, "a", 50, "1", "a", IDENTITY, None), (942050, "a", 50, "2", "a", IDENTITY[:12] + [7.0, 0.0, 0.0, 1.0], None), (942050, "b", 90, "1", "b", IDENTITY, None), (5, "b", 90, "1", "jet", IDENTITY, "jet-1")]
    instances = spark.createDataFrame(rows, "tile int, model string, size int, seq string, name string, matrix array<double>, prefix string")
    made = assembly.documents(instances, models)
    got = {r.tile: json.loads(r.document) for r in made.collect()}
    buffers = {f"{r.model}.bin": bytes(r.bin) for r in models.collect()}
    n = check(got[942050], buffers)
    assert n == {"nodes": 12, "meshes": 2, "accessors": 10, "bufferViews": 10, "buffers": 2, "materials": 4, "textures": 4, "images": 4}
    assert [got[942050]["nodes"][i]["name"] for i in got[942050]["scenes"][0]["nodes"]] == ["b", "a", "a"] and got[942050]["nodes"][8]["matrix"][12] == 7
    assert check(got[5], buffers)["nodes"] == 4 and [x["name"] for x in got[5]["nodes"]] == ["jet", "jet-1_b_root", "jet-1_b_leaf", "jet-1_nothing"]
    assembly.write_tiles(made, f"{tmp_path}/tiles")
    assembly.write_buffers(models, f"{tmp_path}/buffers")
    back = {r.tile: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/tiles").collect()}
    assert back == got
    raw = next((tmp_path / "buffers" / "model=a").glob("part-*")).read_bytes()
    assert raw[: len(buffers["a.bin"])] == buffers["a.bin"]
    assert assembly.documents(instances.limit(0), models).count() == 0


def test_pieces_of_tiles(spark, scenes, tmp_path):
    """No row holds a tile; the pieces, written in their order, are the document."""
    models = assembly.fragments(scenes, F.col("doc"))
    places = [IDENTITY[:12] + [float(i), 0.0, 0.0, 1.0] for i in range(500)]
    rows = [(tile, "ab"[i % 2], 50 + i % 2, f"{i:03}", f"n{i}", places[i], None) for tile in (5, 942050) for i in range(500)]
    instances = spark.createDataFrame(rows, "tile int, model string, size int, seq string, name string, matrix array<double>, prefix string").repartition(7)
    made = assembly.pieces(instances, models)
    assert made.agg(F.max(F.length("text"))).first()[0] < 5000 and made.where("list = 'nodes'").count() == 1000
    assembly.write_pieces(made, f"{tmp_path}/tiles")
    back = {r.tile: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/tiles").collect()}
    assert back == {r.tile: json.loads(r.document) for r in assembly.documents(instances, models).collect()} and set(back) == {5, 942050}
    buffers = {f"{r.model}.bin": bytes(r.bin) for r in models.collect()}
    for document in back.values():
        assert check(document, buffers)["nodes"] == 2000 and len(document["scenes"][0]["nodes"]) == 500
        assert [document["nodes"][i]["matrix"][12] for i in document["scenes"][0]["nodes"]] == [*range(1, 500, 2), *range(0, 500, 2)]


def test_placed_models_become_a_scene(spark, scenes):
    p = spark.createDataFrame([("a", 1, -122.4, 37.6, 3.0, 90.0, 942050), ("a", 2, -122.41, 37.61, 4.0, 0.0, 942050)], "guid string, n int, lon double, lat double, alt double, heading double, tile int").withColumns({"pitch": F.lit(0.0), "bank": F.lit(0.0), "scale": F.lit(2.0)})
    refs = placements.model_refs(spark.createDataFrame([("a", 9, "f")], "guid string, size int, file string"), p)
    assert placements.require_models(refs) and not placements.require_models(refs.limit(0))
    instances = assembly.tile_instances(placements.instances(refs, p), F.col("n"), F.col("guid"))
    sims = spark.createDataFrame([(942050, "Jet Way", "b", True, 1, -122.4, 37.6, 1.0), (942050, "Truck", "b", False, 2, -122.4, 37.6, 1.0), (7, "Jet Way", "b", True, 3, 0.0, 0.0, 0.0)], "tile int, title string, model string, is_jetway boolean, seq int, lon double, lat double, alt double").withColumns({"heading": F.lit(0.0), "pitch": F.lit(0.0), "bank": F.lit(0.0), "scale": F.lit(1.0)})
    both = instances.unionByName(assembly.jetway_instances(sims, placements.centroids(p), bytewise.object_id))
    got = assembly.documents(both, assembly.fragments(scenes, F.col("doc"))).collect()
    assert [r.tile for r in got] == [942050]
    nodes = json.loads(got[0].document)["nodes"]
    assert len(nodes) == 12 and nodes[0]["matrix"][0] == pytest.approx(0, abs=1e-6) and nodes[4]["matrix"][:2] == [2, 0]
    assert nodes[8]["name"].startswith("Jet Way-") and nodes[9]["name"] == nodes[8]["name"] + "_b_root"


def test_text_scenes(spark, scenes):
    loose = {"meshes": [{"name": "alone", "primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": model()["accessors"], "bufferViews": model()["bufferViews"]}
    empty = {"nodes": [{"name": "x"}], "meshes": [{"primitives": []}], "accessors": [{}], "bufferViews": [{}]}
    more = spark.createDataFrame([("loose", json.dumps(loose), BUFFER), ("empty", json.dumps(empty), BUFFER)], "doc string, json string, bin binary").select("doc", F.from_json("json", scenery.GLTF).alias("scene"), "bin")
    got = {r.doc: r.text for r in assembly.ac_documents(scenes.where("doc = 'a'").unionByName(more), ["doc"], F.concat(F.lit("Tile_"), "doc")).collect()}
    assert set(got) == {"a", "loose"}
    text = got["a"]
    assert text.startswith('AC3Db\nMATERIAL "DefaultWhite"') and text.count("MATERIAL") == 3 and 'OBJECT world\nname "Tile_a"\nkids 1\nOBJECT group\nname "a_root"\nkids 1\n' in text
    assert 'OBJECT group\nname "a_leaf"\nloc 0 5 -1\nkids 2\nOBJECT poly\nname "a_mesh_prim0"\ncrease 30\nnumvert 3\n0 0 0\n-1 0 0\n0 1 -2\nnumsurf 1\nSURF 0x30\nmat 2\nrefs 3\n0 0 0\n2 0.5 0.25\n1 1 0\nkids 0\n' in text
    assert "nothing" not in text and "rot" not in text.split("OBJECT world")[1].replace("a_root", "")
    assert 'kids 1\nOBJECT poly\nname "alone_prim0"' in got["loose"]
    for t in got.values():  # the counts of kids make a tree
        lines, todo = t.splitlines(), []
        for line in lines:
            if m := re.match(r"kids (\d+)", line):
                todo.append(int(m[1]))
        assert sum(todo) == t.count("OBJECT ") - 1


def test_gltf_text_files(spark, tmp_path):
    import base64

    (tmp_path / "d").mkdir()
    parts = [BUFFER[:48], BUFFER[48:]]
    views = [{"byteLength": 36}, {"byteOffset": 36, "byteLength": 12}, {"buffer": 1, "byteLength": 6}, {"buffer": 1, "byteOffset": 8, "byteLength": 12}]
    (tmp_path / "d" / "one.bin").write_bytes(parts[0])
    uris = [{"uri": "one.bin", "byteLength": 48}, {"uri": "data:application/octet-stream;base64," + base64.b64encode(parts[1]).decode(), "byteLength": len(parts[1])}]
    (tmp_path / "d" / "x.GLTF").write_text(json.dumps(model("x", bufferViews=views, buffers=uris)))
    (tmp_path / "lost.gltf").write_text(json.dumps(model("y", buffers=[{"uri": "nowhere.bin"}])))
    (tmp_path / "bad.gltf").write_text("{")
    got = scenery.text_scenes(spark, str(tmp_path))
    row = got.collect()
    assert [r.file.rsplit("/")[-1] for r in row] == ["x.GLTF"] and bytes(row[0].bin) == BUFFER
    plain = json.loads(got.select(F.to_json("scene")).first()[0])
    assert emit.fragment(plain, bytes(row[0].bin)) == emit.fragment(model("x"), BUFFER)


def test_small_operators(spark, tmp_path):
    handles = spark.createDataFrame([(1, "Main"), (1, "gone")], "doc int, name string")
    nodes = spark.createDataFrame([(1, 3, "MAIN"), (1, 2, "main"), (2, 0, "main"), (1, 1, None)], "doc int, node int, name string")
    assert [(r.name, r.node) for r in scene.first_named(handles, nodes, ["doc"]).collect()] == [("Main", 2)]
    rows = spark.createDataFrame([(i * 3 % 101, i) for i in range(100)], "v int, k int")
    assert {r.v: r.n for r in scene.numbered(rows, "v", "n", 5, 7).collect()} == {v: i + 5 for i, v in enumerate(sorted(i * 3 % 101 for i in range(100)))}
    assert scene.numbered(rows.limit(0), "v", "n").count() == 0
    merged = scene.merged_ids(spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (1, 9, "x"), (1, 1, "white"), (2, 4, "x")], "doc int, seq int, look string"), "doc", F.col("look"), "seq", F.lit("white"))
    ids = {(r.doc, r.seq): r.id for r in merged.collect()}
    assert ids == {(1, 1): 0, (1, 2): 1, (1, 5): 2, (1, 9): 2, (2, 4): 1}
    surfaces = spark.createDataFrame([(1, 5), (1, 77)], "doc int, material int")
    assert sorted(r.material for r in scene.remapped(surfaces, merged.withColumnRenamed("seq", "material"), ["doc"]).collect()) == [2, 77]
    copies = spark.createDataFrame([("a/x.dds", "o/x.dds"), ("b/x.dds", "o/x.dds"), ("a/y.dds", "o/y.dds")], "src string, dst string")
    assert [tuple(r) for r in sinks.texture_copies(copies, spark.createDataFrame([("o/y.dds",)], "path string")).collect()] == [("a/x.dds", "o/x.dds")]
    df, seen = sinks.observed(rows, "rows", total=F.sum("v"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "total": sum(i * 3 % 101 for i in range(100))}
