"""Queries of the binary decoders: the test tables are written as containers and meshes, decoded, and held against SQL."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meshes
from ..sources import decode, scenery
from . import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col
FILE = "path string, length long, content binary"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def container(sections: list[tuple[int, bytes]]) -> bytes:
    """A container whose records have one subsection each; sections: (record kind, data)."""
    head = bytearray(0x38)
    head[0:4], head[0x10:0x14] = decode.MAGIC_AT_0, decode.MAGIC_AT_16
    struct.pack_into("<I", head, 0x14, len(sections))
    table_at = 0x38 + 0x14 * len(sections)
    at, records, table, data = table_at + 16 * len(sections), b"", b"", b""
    for i, (kind, body) in enumerate(sections):
        records += struct.pack("<IIIII", kind, 0, 1, table_at + 16 * i, 16)
        table += struct.pack("<IIII", 0, 1, at + len(data), len(body))
        data += body
    return bytes(head) + records + table + data


def files(rows: DataFrame, group: str, encode) -> DataFrame:
    """path, length, content: a file for each value of group; encode(value, rows as dicts) gives its bytes."""
    # By number: Spark would join the partitions of few bytes, and one task would write and decode all files.
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    grouped = dealt.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*[x for x in rows.columns if x != group]))).alias("rows"))

    def run(batches):
        for pdf in batches:
            made = [encode(g, r) for g, r in zip(pdf[group], pdf["rows"])]
            yield pd.DataFrame({"path": [str(g) for g in pdf[group]], "length": [len(b) for b in made], "content": made})

    return grouped.mapInPandas(run, FILE)


def guid_of(key: int) -> uuid.UUID:
    return uuid.UUID(int=int(key))


def placement_bytes(r: dict) -> bytes:
    head = struct.pack("<HHIIihhhhH", decode.PLACEMENT, 64, r["lon_raw"], r["lat_raw"], int(r["alt"] * 1000), r["flags"], 0, 0, r["heading16"], r["l_linenumber"])
    return head + bytes(44 - len(head)) + guid_of(r["l_partkey"]).bytes_le + struct.pack("<f", r["l_quantity"])


@query(
    f"""WITH {S.PLACEMENTS} SELECT CAST(l_suppkey AS VARCHAR) AS file, lpad(printf('%x', guid), 12, '0') AS model, tile, round(lon, 9) AS lon, round(lat, 9) AS lat, alt, flags, round_even(heading16 * (360e0 / 65536), 3) AS heading, l_linenumber AS complexity, l_quantity AS scale FROM placements
    WHERE l_suppkey % 5 <> 0"""
)
def container_placements(spark, d):
    """Placements through containers: marks, records, subsections, fixed-width fields; every fifth file has a wrong mark."""
    p = S.placements(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "lon_raw", "lat_raw", "alt", "flags", "heading16", "l_quantity")
    odd = struct.pack("<HH", 0x77, 8) + bytes(4)  # an unknown part between

    def encode(supplier, rows):
        whole = container([(0x99, b"other"), (decode.SCENERY, odd.join(map(placement_bytes, rows)))])
        return b"wrong" + whole[5:] if supplier % 5 == 0 else whole

    out = scenery.objects(files(p, "l_suppkey", encode))
    return out.select("file", F.substring("guid", 25, 12).alias("model"), "tile", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "alt", c("flags").cast("bigint").alias("flags"), "heading", "complexity", "scale")


@query(f"WITH {S.SIMS} SELECT title, seq % 50 AS file, complexity, round(lon, 9) AS lon, 'SimObjects\\' || title AS path, tile, count(*) AS n FROM sims GROUP BY ALL")
def container_sims(spark, d):
    s = S.sims(spark, d).withColumn("file", c("seq") % 50).select("file", "seq", "title", "lon_raw", "lat_raw", "complexity")

    def encode(_, rows):
        out = []
        for r in rows:
            t, p = r["title"].encode() + b"\0\0", b"SimObjects\\" + r["title"].encode() + b"\0"
            head = struct.pack("<HHIIihhhhH", decode.SIM_OBJECT, 52 + len(t) + len(p), r["lon_raw"], r["lat_raw"], 0, 0, 0, 0, 0, r["complexity"])
            out += [head, bytes(44 - len(head)), struct.pack("<fHH", 1.0, len(t), len(p)), t, p]
        return container([(decode.SCENERY, b"".join(out))])

    out = scenery.objects(files(s, "file", encode)).withColumn("lon", F.round("lon", 9))
    return out.groupBy("title", c("file").cast("bigint").alias("file"), c("complexity").cast("bigint").alias("complexity"), "lon", "path", "tile").agg(F.count("*").alias("n"))


def glb(text: bytes, buffer: bytes) -> bytes:
    text += b" " * (-len(text) % 4)
    return b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<I", len(text)) + b"JSON" + text + struct.pack("<I", len(buffer)) + b"BIN\0" + buffer


def _model_files(spark, d):
    """A container for each brand with a model for each of its parts; a model has p_size % 3 GLBs, of which a broken one is the last."""
    part = S.read(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_name")

    def payload(r):
        n = r["p_size"] % 3
        scene = lambda i: json.dumps({"nodes": [{"name": f"{r['p_name']} {i}"}], "meshes": [{}], "accessors": [{"count": int(r["p_size"])}], "bufferViews": [{}] if r["p_partkey"] % 4 else []}).encode()
        blocks = [glb(scene(i) if i < 1 else b"{broken", b"\1" * i) for i in range(n)]
        xml = f'<ModelInfo name="{r["p_name"]}.gltf"><LOD minSize="{r["p_size"]}" ModelFile="a.gltf"/><LOD minSize="x" ModelFile="b.gltf"/></ModelInfo>'.encode()
        xml += b" " * (-len(xml) % 4)
        body = b"".join(b"GLB\0" + struct.pack("<I", len(g)) + g + b" " * (-len(g) % 4) for g in blocks)
        mark = b"RIFF" if r["p_partkey"] % 6 else b"riff"
        return mark + struct.pack("<I", 0) + b"GXML" + struct.pack("<I", len(xml)) + xml + b"GLBD" + struct.pack("<I", len(body)) + body

    def encode(_, rows):
        made = [payload(r) for r in rows]
        at, entries = 24 * len(rows), b""
        for r, p in zip(rows, made):
            lost = 10**9 if r["p_partkey"] % 10 == 9 else 0  # beyond the file's end
            entries += guid_of(r["p_partkey"]).bytes_le + struct.pack("<II", at, len(p) + lost)
            at += len(p)
        return container([(decode.MODELS, entries + b"".join(made))])

    return files(part, "p_brand", encode)


def _key(col):
    return F.conv(F.substring(col, 25, 12), 16, 10).cast("bigint")


@query("SELECT p_brand AS file, p_partkey AS part FROM part WHERE p_partkey % 10 <> 9")
def model_directory(spark, d):
    """Directory entries whose payloads lie in their file."""
    return scenery.model_directory(_model_files(spark, d)).where("size > 0").select("file", _key("guid").alias("part"))


def _chunks(spark, d, first):
    found = _model_files(spark, d)
    return scenery.model_chunks(found, scenery.model_directory(found), first)


@query("SELECT p_partkey AS part, 1 + p_size % 3 AS chunks, least(p_size % 3, 1) AS first_glbs FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 6 <> 0")
def model_chunks(spark, d):
    """Chunks of payloads with the right mark: all of them, and with the first GLB of each chunk alone."""
    every = _chunks(spark, d, False).groupBy("guid").agg(F.count("*").cast("int").alias("chunks"))
    first = _chunks(spark, d, True).groupBy("guid").agg(F.count_if(c("chunk") == "GLB").cast("int").alias("first_glbs"))
    return every.join(first, "guid").select(_key("guid").alias("part"), "chunks", "first_glbs")


@query("SELECT p_partkey AS part, p_name || ' 0' AS name, p_size AS n FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 6 <> 0 AND p_size % 3 > 0 AND p_partkey % 4 <> 0")
def model_scenes(spark, d):
    """Scenes of GLBs whose JSON parses and that have meshes, accessors and views."""
    s = scenery.scenes(_chunks(spark, d, False))
    return s.select(_key("guid").alias("part"), F.get("scene.nodes.name", F.lit(0)).alias("name"), F.get("scene.accessors.count", F.lit(0)).alias("n"))


@query("SELECT p_partkey AS part, replace(p_name, ' ', '_') AS name, 'a' AS lod, p_size AS min_size FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 6 <> 0")
def model_info(spark, d):
    """Names and details of models; a size that is no number drops its entry."""
    i = scenery.model_info(_chunks(spark, d, True)).select("guid", "name", F.explode("lods").alias("l"))
    return i.select(_key("guid").alias("part"), "name", c("l.file").alias("lod"), "l.min_size")


@query(
    """WITH s AS (SELECT s_suppkey, s_nationkey, s_name, 402653184 + s_suppkey * 1000 AS lon, 268435456 - s_suppkey * 1000 AS lat FROM supplier)
    SELECT s_suppkey AS airport, s_name AS name, round(lon * (360e0 / 805306368) - 180, 9) AS lon, round(90 - lat * (180e0 / 536870912), 9) AS lat, s_suppkey / 1000e0 AS alt, s_nationkey AS starts, 2 * s_nationkey AS points FROM s"""
)
def airport_records(spark, d):
    """Airports with their name, starts and taxi points, and a record of an unknown kind; a file has a hundred at most."""
    s = S.read(spark, d, "supplier").select(F.floor(c("s_suppkey") / 100).alias("file"), "s_suppkey", "s_nationkey", "s_name")
    child = lambda kind, body: struct.pack("<HI", kind, 6 + len(body)) + body

    def encode(_, rows):
        out = []  # joined at the end: adding to bytes copies all that came before
        for r in rows:
            k = int(r["s_suppkey"])
            children = [child(0x19, r["s_name"].encode()), child(0x7777, b"??"), *[child(0x11, bytes(10) + bytes(8)) for _ in range(r["s_nationkey"])], child(0x1A, struct.pack("<H", 2 * r["s_nationkey"]) + bytes(24 * r["s_nationkey"]))]
            head = struct.pack("<HI", decode.AIRPORT, 0x44 + sum(map(len, children))) + bytes(6) + struct.pack("<IIi", 402653184 + k * 1000, 268435456 - k * 1000, k) + struct.pack("<IIi", 0, 0, 0) + struct.pack("<fII", 0, 0, 0)
            out += [head, bytes(0x44 - len(head)), *children]
        return container([(decode.AIRPORTS, b"".join(out))])

    rows = scenery.airports(files(s, "file", encode))
    field = lambda kind, path: F.max(F.when(c("kind") == kind, F.get_json_object("payload", path)))
    one = rows.groupBy("file", "airport").agg(
        field("airport", "$.at[0]").cast("double").alias("lon"), field("airport", "$.at[1]").cast("double").alias("lat"), field("airport", "$.alt").cast("double").alias("alt"), field("name", "$.name").alias("name"),
        F.count_if(c("kind") == "start").cast("int").alias("starts"), F.sum(F.when(c("kind") == "taxi_points", F.get_json_object("payload", "$.n").cast("int"))).cast("int").alias("points"),
    )
    return one.select(F.round(c("alt") * 1000).cast("bigint").alias("airport"), "name", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "alt", "starts", "points")


def _terrain(spark, d):
    """A mesh for each nation, of its suppliers as vertices: a sphere that counts after one that doesn't, a list, a strip and a fan."""
    s = S.read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    part = lambda kind, elements: struct.pack("<BHH", kind, 0, len(elements)) + b"".join(struct.pack("<I", len(e)) + e for e in elements)

    def encode(nation, rows):
        n = len(rows)
        vertices = b"".join(struct.pack("<3f", 0, float(r["s_suppkey"]), float(int(r["s_acctbal"]))) for r in rows)
        order = b"".join(struct.pack("<HH", i, 0) for i in range(n)) + struct.pack("<HH", n + 5, 0)
        spheres = [struct.pack("<3df", 1, 1, 1, 1), struct.pack("<3df", 6378137.0, 0, 0, 1)]
        objects = [part(0, spheres), part(1, [vertices]), part(10, [order]), part(11, [order]), part(12, [order])]
        return struct.pack("<HHIH", 6, decode.TERRAIN_MAGIC if nation % 5 else 1, 0, len(objects)) + b"".join(objects)

    made = files(s, "s_nationkey", encode).withColumn("path", F.concat(F.lit("x/"), "path", F.lit(".btg")))
    return scenery.terrain_meshes(made)


@query("SELECT s_nationkey AS tile, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS vid, round(degrees(atan2(s_suppkey, 6378137e0)), 9) AS lon FROM supplier WHERE s_nationkey % 5 <> 0")
def terrain_vertices(spark, d):
    """Vertices of meshes with the right mark, moved by the last sphere and projected."""
    v = scenery.terrain_vertices(_terrain(spark, d))
    return v.select("tile", c("vid").cast("bigint").alias("vid"), F.round("lon", 9).alias("lon"))


@query("WITH n AS (SELECT s_nationkey AS tile, count(*) AS n FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey) SELECT tile, n // 3 + greatest(n - 2, 0) + greatest(n - 2, 0) AS triangles FROM n WHERE n > 2")
def terrain_triangles(spark, d):
    """Triangles of a list, a strip and a fan whose corners all exist; the last index of each points nowhere."""
    m = _terrain(spark, d)
    t = scenery.terrain_triangles(m, scenery.terrain_vertices(m))
    return t.groupBy("tile").agg(F.count("*").alias("triangles"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS is_jetway, CAST(s_suppkey % 7 AS DOUBLE) + 1 AS reach, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 90 + 1 AS DOUBLE) ELSE 5e0 END AS turn, s_nationkey AS min_size FROM supplier")
def object_xml(spark, d):
    """What the XML of sim objects says: the chains of a jetway, its reach, the first rotation that isn't zero, details."""
    chain = lambda n: f'<IKChain Name="{n}"><Start>s</Start><End>e</End></IKChain>'
    all_chains, some = "".join(map(chain, scenery.CHAINS)), chain(scenery.CHAINS[0])
    xml = F.concat(
        F.format_string('<?xml version="1.0"?><M><LODS><LOD MinSize="%d" ModelFile="x.gltf"/></LODS></M><A>', "s_nationkey"), F.when(c("s_suppkey") % 3 == 0, all_chains).otherwise(some),
        F.format_string('<IKConstraint><X max="%d" min="0"/><Bank max="%d" min="0"/></IKConstraint><IKConstraint><X max="3" min="2"/><Bank max="5" min="-5"/></IKConstraint></A>', c("s_suppkey") % 7, F.when(c("s_suppkey") % 2 == 0, c("s_suppkey") % 90 + 1).otherwise(0)),
    )
    o = scenery.object_xml(S.read(spark, d, "supplier").select("s_suppkey", xml.alias("xml")))
    return o.select("s_suppkey", "is_jetway", "reach", c("rotation.max").alias("turn"), F.get("lods.min_size", F.lit(0)).alias("min_size"))


@query("SELECT n_nationkey, trim(n_name) || '.xml' AS file FROM nation")
def normal_model(spark, d):
    n = S.read(spark, d, "nation").select("n_nationkey", F.format_string("[models]\r\nnormal= %s.xml \r\ninterior=x.xml\n", "n_name").alias("text"))
    return n.select("n_nationkey", scenery.normal_model("text").alias("file"))


@query(
    """WITH h AS (SELECT o_orderkey, printf('%08x', (o_orderkey * 2654435761) % 4294967296) AS x FROM orders), b AS (SELECT o_orderkey, [CAST(concat('0x', substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) for i in range(0, 4)] AS v FROM h)
    SELECT o_orderkey, CAST(v[1] + 256 * v[2] AS INTEGER) AS first16, CAST(v[3] + 256 * v[4] AS INTEGER) AS second16, CAST(CASE WHEN v[2] > 127 THEN v[2] - 256 ELSE v[2] END AS INTEGER) AS signed8, round(v[4] / 255e0, 4) AS share FROM b"""
)
def accessor_values(spark, d):
    """Typed arrays of little-endian integers, signed bytes, and bytes as shares of one."""
    raw = S.read(spark, d, "orders").select("o_orderkey", F.unhex(F.format_string("%08x", F.expr("(o_orderkey * 2654435761) % 4294967296"))).alias("b"))
    i = lambda n: F.lit(n)
    out = raw.withColumns({
        "u16": meshes.read_indices(c("b"), i(0), i(0), i(2), i(5123)), "i8": meshes.read_indices(c("b"), i(1), i(0), i(1), i(5120)),
        "u8": meshes.read_rows(c("b"), i(3), i(0), i(1), i(5121), F.lit("SCALAR"), F.lit(True)),
    })
    at = lambda name, k: F.get(name, F.lit(k))
    return out.select("o_orderkey", at("u16", 0).alias("first16"), at("u16", 1).alias("second16"), at("i8", 0).alias("signed8"), F.round(F.get(at("u8", 0), F.lit(0)).cast("double"), 4).alias("share"))
