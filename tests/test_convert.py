import json
import struct

import fixtures as fx
import pytest

from gridloom.plans import convert

G1, G2 = (f"0000000{i}-0001-0002-0003-000000000004" for i in (1, 2))
BUFFER = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 2) + struct.pack("<3H", 0, 1, 2) + bytes(2)
SCENE = {
    "nodes": [{"name": "hangar", "mesh": 0}], "meshes": [{"name": "walls", "primitives": [{"indices": 1, "attributes": {"POSITION": 0}, "extras": {"ASOBO_primitive": {"PrimitiveCount": 1}}}]}],
    "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
    "bufferViews": [{"byteLength": 36}, {"byteOffset": 36, "byteLength": 6}],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("package")
    body = fx.placement(G1, 127000000, 156000000, flags=1) + fx.placement(G1, 127000100, 156000000) + fx.placement(G2, 127000000, 156000000) + fx.sim_object("Truck", "SimObjects", 127000000, 156000000)
    (root / "a.bgl").write_bytes(fx.container([(0x25, body)]))
    (root / "m.bgl").write_bytes(fx.container([(0x2B, fx.models([(G1, fx.riff("<x/>", [fx.glb(json.dumps(SCENE), BUFFER)]))]))]))
    return root


def test_convert(spark, root, tmp_path):
    got = convert.convert(spark, str(root), f"{tmp_path}/gltf", terrain=f"{tmp_path}/no-meshes")
    assert got == {"placements": 3, "sims": 1, "models": 1, "tiles": 1, "unused": 1}
    row = spark.read.option("basePath", f"{tmp_path}/gltf/scenes").text(f"{tmp_path}/gltf/scenes").first()
    document = json.loads(row.value)
    assert [n["name"] for n in document["nodes"]].count("hangar") == 2 and len(document["meshes"]) == 1 and row.square10.startswith("w1")
    assert document["buffers"][0]["uri"].endswith(".bin") and spark.read.text(f"{tmp_path}/gltf/placements").first().value.startswith(f"OBJECT_STATIC {row.tile}.gltf")
    assert spark.read.parquet(f"{tmp_path}/gltf/unused").first().guid == G2
    convert.convert(spark, str(root), f"{tmp_path}/ac", kind="ac")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/ac/scenes").collect()]
    assert lines.count("OBJECT poly") == 2 and lines.count("OBJECT group") == 4 and "kids 2" in lines and lines[0] == "AC3Db"


def test_nothing_to_convert(spark, tmp_path):
    assert convert.convert(spark, f"{tmp_path}/missing", f"{tmp_path}/out")["models"] == 0
    with pytest.raises(ValueError):
        convert.convert(spark, f"{tmp_path}/missing", f"{tmp_path}/out", kind="both")
