import gzip
import json
import struct

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from gridloom.operators import elevation, placements
from gridloom.sources import decode, scenery, sinks
from gridloom.streaming import arrivals

G1, G2, G3 = (f"0000000{i}-0001-0002-0003-000000000004" for i in (1, 2, 3))
SCENE = json.dumps({"nodes": [{"mesh": 0, "name": "n"}], "meshes": [{"primitives": [{"indices": 0}]}], "accessors": [{"bufferView": 0, "count": 1, "componentType": 5126, "type": "VEC3"}], "bufferViews": [{"buffer": 0, "byteLength": 4}]})
XML = '<ModelInfo name="my hangar.gltf"><LODS><LOD ModelFile="a.gltf" minSize="10"/><LOD ModelFile="b.gltf" minSize="x"/></LODS></ModelInfo>'


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("scenery")
    (root / "sub").mkdir()
    odd = struct.pack("<HH", 0x77, 8) + bytes(4)
    jet = fx.placement(G3, 402653184, 268435456)
    jetway = fx.child(0xDE, struct.pack("<HHHHHH", 1, 2, 3, 0, len(jet), 0) + bytes(2) + jet)
    port = fx.airport(40037632, [fx.child(0x19, b"San Test"), fx.child(0x11, bytes(10) + b"\0" * 8), fx.child(0x1A, struct.pack("<H", 1) + bytes(12)), jetway, fx.child(0x7777, b"??")])
    body = fx.placement(G1, 127000000, 156000000, flags=1) + odd + fx.placement(G1, 128000000, 156000000) + fx.placement(G2, 127000000, 156500000) + fx.sim_object("Truck", "SimObjects\\Truck", 127000000, 156000000)
    (root / "placements.bgl").write_bytes(fx.container([(0x25, body), (0x03, port)]))
    payload = fx.riff(XML, [fx.glb(SCENE), fx.glb(SCENE)])
    (root / "sub" / "models.BGL").write_bytes(fx.container([(0x2B, fx.models([(G1, payload), ("99999999-0001-0002-0003-000000000004", b"nope")]))]))
    (root / "bad.bgl").write_bytes(bytes(100))
    (root / "short.bgl").write_bytes(b"\1\2")
    (root / "zero.bgl").write_bytes(fx.container([(0x25, struct.pack("<HH", 0x77, 0) + bytes(12))]))
    (root / "notes.txt").write_text("no")
    (root / "sub" / "sim.cfg").write_text("[f.0]\r\ntitle= Truck \r\nmodel=red\r\ntexture=shiny\r\n[f.1]\ntitle=Van\n")
    return root


def test_listing(spark, root):
    assert scenery.files(spark, str(root)).count() == 5
    assert scenery.files(spark, str(root), recursive=False).count() == 4
    assert scenery.files(spark, str(root), any_case=False).count() == 4
    assert scenery.files(spark, str(root / "missing")).count() == 0
    assert scenery.containers(scenery.files(spark, str(root))).count() == 3


def test_objects(spark, root):
    rows = scenery.objects(scenery.files(spark, str(root))).orderBy("kind", "guid", "lon").collect()
    assert [(r.kind, r.guid, r.title) for r in rows] == [("placement", G1, None), ("placement", G1, None), ("placement", G2, None), ("placement", G3, None), ("sim", None, "Truck")]
    assert rows[0].lon == pytest.approx(-123.22657585144043) and rows[0].flag_labels == ["IsAboveAGL"] and rows[0].tile != rows[1].tile
    assert rows[0].scale == 1.0 and rows[4].path == "SimObjects\\Truck"


def test_airports(spark, root):
    rows = {r.kind: json.loads(r.payload) for r in scenery.airports(scenery.files(spark, str(root))).collect()}
    assert set(rows) == {"airport", "name", "start", "taxi_points", "jetway"}
    assert rows["airport"]["ident"] == "KSFO" and rows["airport"]["at"] == [0.0, 0.0] and rows["airport"]["tower"] == [0.0, 0.0]
    assert rows["name"] == {"name": "San Test"} and len(rows["taxi_points"]["points"]) == 1


def test_every_airport_record_reads():
    for _, (name, skip, spec) in decode.RECORDS.items():
        assert decode.Fields(bytes(400), skip, 400).row(spec) is not None, name
    for label, spec in decode.PARTS.values():
        assert decode.Fields(bytes(100), 6, 100).row(spec), label


def test_fields_leave_the_rest_of_the_file_alone():
    class Whole(bytes):
        def __getitem__(self, at):
            assert not isinstance(at, slice) or at.stop - (at.start or 0) < 100, "a field copied the file"
            return bytes(self)[at]

    b = Whole(bytes(100_000))
    assert decode.Fields(b, 99_000, 99_020).row("at:ll alt:alt code:s4 runway:B") == {"at": [-180.0, 90.0], "alt": 0.0, "code": "\0" * 4, "runway": 0}
    with pytest.raises(struct.error):
        decode.Fields(b, 99_000, 99_006).row("at:ll")


def test_models(spark, root):
    found = scenery.files(spark, str(root))
    directory = scenery.model_directory(found)
    assert directory.count() == 2
    used = placements.placed_models(directory, scenery.objects(found))
    assert [r.guid for r in used.collect()] == [G1]
    assert scenery.model_directory(found, plain=True).where(F.length("guid") == 32).count() == 2
    chunks = scenery.model_chunks(found, used)
    assert sorted((r.chunk, r.glb_no) for r in chunks.collect()) == [("GLB", 0), ("GXML", None)]
    assert scenery.model_chunks(found, used, first_glb=False).where("chunk = 'GLB'").count() == 2
    scene = scenery.scenes(chunks).first()
    assert scene.scene.nodes[0].name == "n" and bytes(scene.bin) == b"\1\2\3\4"
    info = scenery.model_info(chunks).first()
    assert info.name == "my_hangar" and [(x.file, x.min_size) for x in info.lods] == [("a", 10)]


def test_accessor():
    b = struct.pack("<6f", *range(6)) + struct.pack("<3H", 1, 2, 65535) + struct.pack("<2e", 0.5, 2)
    assert decode.accessor(b, 0, 0, 2, 5126, "VEC3").tolist() == [[0, 1, 2], [3, 4, 5]]
    assert decode.accessor(b, 0, 12, 2, 5126, "VEC2").tolist() == [[0, 1], [3, 4]]
    assert decode.accessor(b, 24, 0, 3, 5123, "SCALAR").ravel().tolist() == [1, 2, 65535]
    assert decode.accessor(b, 28, 0, 1, 5123, "SCALAR", True).ravel().tolist() == [1.0]
    assert decode.accessor(b, 30, 0, 2, 5131, "SCALAR").ravel().tolist() == [0.5, 2]
    assert decode.accessor(b, 30, 0, 9, 5131, "SCALAR").size == 0


def test_side_files(spark, root):
    rows = {r.title: (r.model, r.texture) for r in scenery.sim_configs(spark, str(root)).collect()}
    assert rows == {"Truck": ("red", "shiny"), "Van": ("", "")}
    chain = lambda n: f'<IKChain Name="{n}"><Start>s{n}</Start><End>e</End></IKChain>'
    xml = '<?xml version="1.0"?><M><LODS><LOD MinSize="7" ModelFile="x.gltf"/></LODS></M><A>' + "".join(map(chain, scenery.CHAINS)) + '<IKConstraint><Node>n</Node><X max="3.5" min="1"/></IKConstraint><IKConstraint><Bank max="9" min="-9"/><X max="2" min="1"/></IKConstraint></A>'
    a, b = scenery.object_xml(spark.createDataFrame([(1, xml), (2, "<M/>")], "id int, xml string")).orderBy("id").collect()
    assert a.is_jetway and a.reach == 3.5 and a.rotation.max == 9 and a.chains[0].start == "sIK_MainHandle" and a.lods[0].min_size == 7
    assert not b.is_jetway and b.reach == 0


def test_terrain(spark, tmp_path):
    v = [(0, 0, 0), (0, 1000, 0), (0, 0, 1000), (0, 1000, 1000)]
    (tmp_path / "2954880.btg.gz").write_bytes(gzip.compress(fx.terrain(v, [(10, [0, 1, 2]), (11, [0, 1, 2, 3]), (12, [0, 1, 2, 3])])))
    (tmp_path / "7.btg").write_bytes(fx.terrain(v, [], magic=1))
    meshes = scenery.terrain(spark, str(tmp_path))
    row = meshes.first()
    assert meshes.count() == 1 and row.tile == 2954880
    assert row.triangles == [[0, 2, 1], [0, 1, 2], [2, 1, 3], [0, 1, 2], [0, 2, 3]]
    vertices = scenery.terrain_vertices(meshes)
    triangles = scenery.terrain_triangles(meshes, vertices)
    assert vertices.count() == 4 and triangles.count() == 5
    points = spark.createDataFrame([(2954880, 1, 0.002, 0.003), (2954880, 2, 0.5, 0.5), (5, 3, 0.0, 0.0)], "tile int, pid int, lat double, lon double")
    got = {r.pid: r.elevation for r in elevation.elevation(points, triangles, vertices).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 0 and all(x >= 0 for x in got.values())


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([(942050, 37.55, -122.4, 3.0)], "tile int, lat double, lon double, alt double")
    sinks.write_placements(c, str(tmp_path / "out"))
    row = spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out")).first()
    assert row.value == "OBJECT_STATIC 942050.gltf -122.4 37.55 3 270 0 90" and (row.square10, row.square1) == ("w130n30", "w123n37")
    mk = spark.createDataFrame
    text = sinks.ac_documents(
        sinks.ac_lines(
            mk([(1, 0, "o"), (1, 1, "empty")], "doc int, object int, name string"),
            mk([(1, 0, 0, 1.0, 2.0, 3.0), (1, 1, 0, 1.0, 1.0, 1.0)], "doc int, object int, vertex int, x double, y double, z double"),
            mk([(1, 0, 0, 0, True, [(0, 0.5, 1.0)])], "doc int, object int, surface int, material int, two_sided boolean, refs array<struct<v: int, u: double, w: double>>"),
            mk([(1, 0, None, 1.0, 1.0, 1.0, 0.04, 0, 0.0)], "doc int, id int, name string, r double, g double, b double, spec double, shininess int, transparency double"),
        )
    ).first().text
    assert text.startswith('AC3Db\nMATERIAL "Unnamed" rgb 1 1 1 amb 0.2') and "-1 2 3\nnumsurf 1\nSURF 0x30\nmat 0\nrefs 1\n0 0.5 1\n" in text and "empty" not in text
    assert spark.range(1).select(sinks.script("# s\nvar lat = 0;\nvar b = 1;", {"lat": F.lit("37.5")}).alias("x")).first().x == "# s\nvar lat = 37.5;\nvar b = 1;"


def test_arrivals(spark, root):
    q = arrivals.tile_counts(arrivals.arriving(spark, str(root))).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrivals").agg(F.sum("placements")).first()[0] == 5
