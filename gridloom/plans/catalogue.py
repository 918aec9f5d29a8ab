"""All queries of the scenery operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytewise, grid, labels, scalars
from ..operators import elevation, meshes, placements, scene
from ..sources import scenery, sinks
from . import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def c(name: str):
    return F.col(name)


# Grid and fields


_MEAN = lambda x, places: f"round(CAST(CAST(avg({x}) AS FLOAT) AS DOUBLE), {places}) AS {x}"


@query(f"WITH {S.PLACEMENTS} SELECT tile, {', '.join(_MEAN(x, 5) for x in ('lat', 'lon', 'alt'))}, count(*) AS placements FROM placements GROUP BY tile")
def tile_centroid(spark, d):
    return placements.centroids(S.placements(spark, d)).select("tile", *[F.round(c(x).cast("double"), 5).alias(x) for x in ("lat", "lon", "alt")], "placements")


@query(
    f"""WITH {S.PLACEMENTS}, {S.SIMS}, t AS (SELECT DISTINCT tile FROM placements UNION SELECT DISTINCT tile FROM sims)
    SELECT tile, ((tile >> 6) & 255) - 90 + ((tile >> 3) & 7) / 8e0 AS lat, (tile >> 14) - 180 + (tile & 7) * 0.25e0 AS lon FROM t"""
)
def tile_decode(spark, d):
    tiles = S.placements(spark, d).select("tile").union(S.sims(spark, d).select("tile")).distinct()
    return tiles.withColumn("at", grid.tile_corner(c("tile"))).select("tile", "at.lat", "at.lon")


@query(
    """WITH v AS (SELECT s_suppkey, CAST(s_suppkey * 7919 % 360 - 180 AS DOUBLE) + 0.3e0 AS lon, CAST(s_suppkey * 104729 % 180 - 90 AS DOUBLE) + 0.6e0 AS lat FROM supplier)
    SELECT s_suppkey, printf('%s%03d%s%02d/%s%03d%s%02d', CASE WHEN lon >= 0 THEN 'e' ELSE 'w' END, CAST(abs(floor(lon / 10)) * 10 AS BIGINT), CASE WHEN lat >= 0 THEN 'n' ELSE 's' END, CAST(abs(floor(lat / 10)) * 10 AS BIGINT),
        CASE WHEN lon >= 0 THEN 'e' ELSE 'w' END, CAST(abs(floor(lon)) AS BIGINT), CASE WHEN lat >= 0 THEN 'n' ELSE 's' END, CAST(abs(floor(lat)) AS BIGINT)) AS folder FROM v"""
)
def bucket_path(spark, d):
    v = S.read(spark, d, "supplier").select("s_suppkey", F.expr("cast(s_suppkey * 7919 % 360 - 180 as double) + 0.3D").alias("lon"), F.expr("cast(s_suppkey * 104729 % 180 - 90 as double) + 0.6D").alias("lat"))
    return v.select("s_suppkey", grid.tile_folder(c("lat"), c("lon")).alias("folder"))


@query(f"WITH {S.PLACEMENTS} SELECT heading16, round_even(heading16 * (360e0 / 65536), 3) AS degrees, count(*) AS n FROM placements GROUP BY heading16")
def angle_degrees(spark, d):
    p = S.placements(spark, d).groupBy("heading16").agg(F.count("*").alias("n"))
    return p.select("heading16", scalars.degrees16(c("heading16")).alias("degrees"), "n")


def _ident_sql(raw: str) -> str:
    steps = f"i0 AS (SELECT key, CAST({raw} AS BIGINT) >> 5 AS v, '' AS s FROM keys)"
    for i in range(6):
        char = "CASE WHEN v % 38 = 0 THEN ' ' WHEN v % 38 BETWEEN 2 AND 11 THEN chr(CAST(v % 38 + 46 AS INTEGER)) ELSE chr(CAST(v % 38 + 53 AS INTEGER)) END"
        steps += f", i{i + 1} AS (SELECT key, CASE WHEN v > 1 THEN v // 38 ELSE v END AS v, CASE WHEN v > 1 THEN {char} || s ELSE s END AS s FROM i{i})"
    return steps


@query(
    f"""WITH keys AS (SELECT o_orderkey AS key, (o_orderkey * 104729 + 28954912) % 2000000000 AS raw FROM orders), {_ident_sql('raw')},
    regions AS (SELECT key, (raw & 1023) >> 5 AS r FROM keys)
    SELECT i6.key AS o_orderkey, i6.s AS ident, CASE WHEN r BETWEEN 2 AND 11 THEN chr(CAST(r + 46 AS INTEGER)) WHEN r > 1 THEN chr(CAST(r + 53 AS INTEGER)) ELSE '' END AS region FROM i6 JOIN regions USING (key)"""
)
def ident_decode(spark, d):
    raw = F.expr("cast((o_orderkey * 104729 + 28954912) % 2000000000 as int)")
    return S.read(spark, d, "orders").select("o_orderkey", scalars.ident(raw).alias("ident"), scalars.region(raw).alias("region"))


def _bits_sql(value: str, names: list[str], first: int = 0) -> str:
    parts = ", ".join(f"CASE WHEN ({value} >> {first + i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(names))
    return f"concat_ws(',', {parts})"


@query(
    f"""WITH v AS (SELECT o_orderkey, (o_orderkey * 7919) % 128 AS flags, (o_orderkey * 104729) % 65536 AS marking, (o_orderkey * 31) % 256 AS light, (o_orderkey * 37) % 64 AS pattern FROM orders)
    SELECT o_orderkey, {_bits_sql('flags', labels.FLAGS)} AS flags, concat_ws(',', nullif({_bits_sql('marking', labels.RUNWAY_MARKINGS[:16])}, ''), nullif({_bits_sql('light', labels.RUNWAY_MARKINGS[16:], 5)}, '')) AS markings,
    concat_ws(',', list_extract({labels.RUNWAY_LIGHTS[:4]}, CAST((light & 3) + 1 AS BIGINT)), list_extract({labels.RUNWAY_LIGHTS[4:8]}, CAST(((light >> 2) & 3) + 1 AS BIGINT)), CASE WHEN (light >> 4) & 1 = 1 THEN '{labels.RUNWAY_LIGHTS[8]}' END) AS lights,
    {_bits_sql('pattern', labels.RUNWAY_PATTERNS)} AS patterns FROM v"""
)
def flag_labels(spark, d):
    v = S.read(spark, d, "orders").selectExpr("o_orderkey", "(o_orderkey * 7919) % 128 AS flags", "(o_orderkey * 104729) % 65536 AS marking", "(o_orderkey * 31) % 256 AS light", "(o_orderkey * 37) % 64 AS pattern")
    text = lambda x: F.concat_ws(",", x)
    return v.select("o_orderkey", text(scalars.flag_labels(c("flags"))).alias("flags"), text(scalars.runway_markings(c("marking"), c("light"))).alias("markings"), text(scalars.runway_lights(c("light"))).alias("lights"), text(scalars.runway_patterns(c("pattern"))).alias("patterns"))


@query("WITH v AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS p FROM orders) SELECT o_orderkey, p & 63 AS name, (p >> 6) & 3 AS pushback, (p >> 8) & 15 AS type, (p >> 12) & 4095 AS number, (p >> 24) & 255 AS airlines FROM v")
def bitfield_unpack(spark, d):
    packed = F.expr("(o_orderkey * 2654435761) % 4294967296")
    return S.read(spark, d, "orders").select("o_orderkey", scalars.parking(packed).alias("p")).select("o_orderkey", "p.*")


def _enum_values() -> str:
    return ", ".join(f"('{e}', {k}, '{n}')" for e, k, n in labels.rows())


@query(
    f"""WITH enums(enum, code, label) AS (VALUES {_enum_values()}) SELECT p_partkey, s.label AS surface, t.label AS parking_type FROM part
    LEFT JOIN enums s ON s.enum = 'surface' AND s.code = p_size - 20 LEFT JOIN enums t ON t.enum = 'parking_type' AND t.code = p_size - 8"""
)
def enum_label(spark, d):
    enums = spark.createDataFrame(labels.rows(), "enum string, code int, label string")  # about 180 fixed rows
    of = lambda e, name: F.broadcast(enums.where(c("enum") == e).select(c("code").alias(f"{e}_code"), c("label").alias(name)))
    part = S.read(spark, d, "part")
    out = part.join(of("surface", "surface"), c("p_size") - 20 == c("surface_code"), "left").join(of("parking_type", "parking_type"), c("p_size") - 8 == c("parking_type_code"), "left")
    return out.select("p_partkey", "surface", "parking_type")


# Geometry


@query(
    f"""WITH {S.PLACEMENTS} SELECT {', '.join(S.SEQ)}, round(-(lon - (-122.5e0)) * 111320e0 * cos(37.5e0 * (pi() / 180)), 4) AS dx, round(alt - 10e0, 4) AS dy, round((lat - 37.5e0) * 110540e0, 4) AS dz FROM placements"""
)
def local_offsets(spark, d):
    o = scalars.local_offset(c("lon"), c("lat"), c("alt"), F.lit(-122.5), F.lit(37.5), F.lit(10.0))
    return S.placements(spark, d).select(*S.SEQ, o.alias("o")).select(*S.SEQ, *[F.round(f"o.{k}", 4).alias(k) for k in ("dx", "dy", "dz")])


_RAD = "(pi() / 180)"


@query(
    f"""WITH v AS (SELECT s_suppkey, -(s_suppkey * 31 % 3600 / 10e0) * {_RAD} AS yaw, (s_suppkey * 7 % 300 / 10e0) * {_RAD} AS pitch, (s_suppkey * 11 % 200 / 10e0) * {_RAD} AS roll, 1e0 + s_nationkey / 10e0 AS k FROM supplier),
    q AS (SELECT s_suppkey, k, cos(yaw/2)*sin(pitch/2)*cos(roll/2) + sin(yaw/2)*cos(pitch/2)*sin(roll/2) AS x, sin(yaw/2)*cos(pitch/2)*cos(roll/2) - cos(yaw/2)*sin(pitch/2)*sin(roll/2) AS y,
        cos(yaw/2)*cos(pitch/2)*sin(roll/2) - sin(yaw/2)*sin(pitch/2)*cos(roll/2) AS z, cos(yaw/2)*cos(pitch/2)*cos(roll/2) + sin(yaw/2)*sin(pitch/2)*sin(roll/2) AS w FROM v)
    SELECT s_suppkey, round(k * (1 - 2*(y*y + z*z)), 4) AS m11, round(k * 2*(x*y + z*w), 4) AS m12, round(k * 2*(x*z - y*w), 4) AS m13, round(k * 2*(x*y - z*w), 4) AS m21, round(k * (1 - 2*(z*z + x*x)), 4) AS m22, round(k * 2*(y*z + x*w), 4) AS m23,
        round(k * 2*(x*z + y*w), 4) AS m31, round(k * 2*(y*z - x*w), 4) AS m32, round(k * (1 - 2*(y*y + x*x)), 4) AS m33 FROM q"""
)
def placement_matrix(spark, d):
    v = S.read(spark, d, "supplier")
    rad = F.lit(scalars.math.pi / 180)
    heading, pitch, bank = (F.expr(f"s_suppkey * {k} % {n} / 10D") for k, n in ((31, 3600), (7, 300), (11, 200)))
    # The double-precision cells before they are stored as float32.
    cells = [F.expr("1D + s_nationkey / 10D") * m for m in scalars.rotation(*scalars.quaternion(-heading * rad, pitch * rad, bank * rad))]
    return v.select("s_suppkey", *[(F.round(m, 4) + 0.0).alias(f"m{i // 3 + 1}{i % 3 + 1}") for i, m in enumerate(cells)])


def _haversine_sql(lon1, lat1, lon2, lat2):
    a = f"(pow(sin(({lat2} - {lat1}) * {_RAD} / 2), 2) + cos({lat1} * {_RAD}) * cos({lat2} * {_RAD}) * pow(sin(({lon2} - {lon1}) * {_RAD} / 2), 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


@query(
    f"""WITH {S.VERTICES}, doors AS (SELECT n_nationkey AS door, -123.2e0 + n_nationkey * 0.03e0 AS dlon, 37.0e0 + n_nationkey * 0.02e0 AS dlat, 5e0 AS dalt FROM nation),
    pairs AS (SELECT vid, door, lon, lat, dlon, dlat, sqrt(pow({_haversine_sql('lon', 'lat', 'dlon', 'dlat')}, 2) + pow(dalt - alt, 2)) AS dist FROM vertices CROSS JOIN doors)
    SELECT vid, door, round(dist, 3) AS dist, round((degrees(atan2(dlon - lon, dlat - lat)) + 360) % 360, 6) AS heading FROM pairs QUALIFY row_number() OVER (PARTITION BY vid ORDER BY dist, door) = 1"""
)
def haversine_door(spark, d):
    doors = S.read(spark, d, "nation").selectExpr("n_nationkey AS door", "-123.2D + n_nationkey * 0.03D AS dlon", "37.0D + n_nationkey * 0.02D AS dlat", "5D AS dalt")
    return placements.nearest_door(S.vertices(spark, d), doors, "vid").select("vid", "door", F.round("dist", 3).alias("dist"), F.round("heading", 6).alias("heading"))


@query(
    """WITH v AS (SELECT s_suppkey, -2706000e0 + s_suppkey * 37 AS x, -4261000e0 + s_nationkey * 1000 AS y, 3885000e0 + s_acctbal AS z, 6378137e0 AS a, 6.69437999014e-3 AS e2 FROM supplier),
    w AS (SELECT *, a * sqrt(1 - e2) AS b, sqrt(x * x + y * y) AS p FROM v), t AS (SELECT *, atan2(z * a, p * b) AS th FROM w),
    l AS (SELECT *, atan2(z + (a * a - b * b) / b * pow(sin(th), 3), p - e2 * a * pow(cos(th), 3)) AS la FROM t)
    SELECT s_suppkey, round(la * (180 / pi()), 8) AS lat, round(atan2(y, x) * (180 / pi()), 8) AS lon, round(p / cos(la) - a / sqrt(1 - e2 * pow(sin(la), 2)), 3) AS alt FROM l"""
)
def geodetic(spark, d):
    g = scalars.geodetic(F.expr("-2706000D + s_suppkey * 37"), F.expr("-4261000D + s_nationkey * 1000"), F.expr("3885000D + s_acctbal"))
    return S.read(spark, d, "supplier").select("s_suppkey", g.alias("g")).select("s_suppkey", F.round("g.lat", 8).alias("lat"), F.round("g.lon", 8).alias("lon"), F.round("g.alt", 3).alias("alt"))


# Placements, models and sim objects


@query(f"WITH {S.PLACEMENTS}, {S.MODELS} SELECT * FROM models SEMI JOIN placements USING (guid)")
def models_with_placements(spark, d):
    return placements.placed_models(S.models(spark, d), S.placements(spark, d)).select("guid", "size", "file")


@query(f"WITH {S.PLACEMENTS}, {S.MODELS_TWICE}, {S.REFS} SELECT tile, guid, size, file, CAST(row_number() OVER (PARTITION BY tile ORDER BY size DESC, guid, file) AS INTEGER) AS rank FROM refs")
def model_refs_by_tile(spark, d):
    refs = placements.model_refs(S.models(spark, d, True), S.placements(spark, d))
    return placements.ranked_refs(refs, "guid", "file").select("tile", "guid", "size", "file", "rank")


@query(
    f"""WITH {S.PLACEMENTS}, {S.MODELS_TWICE}, {S.REFS}, origin AS (SELECT tile, CAST(CAST(avg(lat) AS FLOAT) AS DOUBLE) AS lat0, CAST(CAST(avg(lon) AS FLOAT) AS DOUBLE) AS lon0, CAST(CAST(avg(alt) AS FLOAT) AS DOUBLE) AS alt0 FROM placements GROUP BY tile)
    SELECT tile, guid, file, {', '.join(S.SEQ)}, round(-(lon - lon0) * 111320e0 * cos(lat0 * (pi() / 180)), 3) AS dx, round(alt - alt0, 3) AS dy, round((lat - lat0) * 110540e0, 3) AS dz FROM refs JOIN placements USING (tile, guid) JOIN origin USING (tile)"""
)
def model_instances(spark, d):
    p = S.placements(spark, d)
    out = placements.model_instances(S.models(spark, d, True), p)
    return out.select("tile", "guid", "file", *S.SEQ, *[F.round(f"offset.{k}", 3).alias(k) for k in ("dx", "dy", "dz")])


@query(
    f"""WITH {S.PLACEMENTS}, {S.MODELS}, {S.REFS}, {S.SIMS}, {S.GROUPS} SELECT t.tile, g.titles, g.positions FROM (SELECT DISTINCT tile FROM refs) t
    LEFT JOIN (SELECT tile, count(*) AS titles, CAST(sum(n) AS BIGINT) AS positions FROM sim_groups GROUP BY tile) g USING (tile)"""
)
def tile_sims_outer(spark, d):
    refs = placements.model_refs(S.models(spark, d), S.placements(spark, d))
    return placements.tiles_with_sims(refs, placements.sim_groups(S.sims(spark, d), "seq"))


@query(f"WITH {S.SIMS} SELECT tile, title, count(*) AS positions, arg_min(flags, seq) AS flags, arg_min(complexity, seq) AS complexity, round(arg_min(lon, seq), 9) AS first_lon FROM sims GROUP BY tile, title")
def sim_groups(spark, d):
    g = placements.sim_groups(S.sims(spark, d), "seq")
    return g.select("tile", "title", F.size("positions").cast("bigint").alias("positions"), "flags", "complexity", F.round(F.get("positions", F.lit(0))["lon"], 9).alias("first_lon"))


@query(f"WITH {S.PLACEMENTS}, {S.MODELS}, {S.REFS}, {S.SIMS} SELECT DISTINCT tile FROM sims ANTI JOIN refs USING (tile)")
def sim_only_tiles(spark, d):
    refs = placements.model_refs(S.models(spark, d), S.placements(spark, d))
    return placements.sim_only_tiles(refs, placements.sim_groups(S.sims(spark, d), "seq"))


@query(
    f"""WITH {S.PLACEMENTS}, {S.MODELS} SELECT guid, count(*) AS placements, round(arg_min(lon, ({', '.join(S.SEQ)})), 9) AS lon, round(arg_min(lat, ({', '.join(S.SEQ)})), 9) AS lat FROM placements ANTI JOIN models USING (guid) GROUP BY guid"""
)
def unused_models(spark, d):
    u = placements.unused(S.placements(spark, d), S.models(spark, d), F.struct(*S.SEQ))
    return u.select("guid", "placements", F.round("first.lon", 9).alias("lon"), F.round("first.lat", 9).alias("lat"))


@query(f"WITH {S.PLACEMENTS}, {S.MODELS}, {S.REFS}, {S.SIMS}, {S.GROUPS}, a AS (SELECT count(*) AS model_refs FROM refs), b AS (SELECT count(*) AS sim_groups FROM sim_groups) SELECT model_refs, sim_groups, model_refs + sim_groups AS total FROM a, b")
def total_models(spark, d):
    return placements.totals(placements.model_refs(S.models(spark, d), S.placements(spark, d)), placements.sim_groups(S.sims(spark, d), "seq"))


@query(
    f"""WITH {S.PLACEMENTS}, {S.SIMS} SELECT 'placement' AS kind, CAST(guid AS VARCHAR) AS name, tile, count(*) AS n FROM placements GROUP BY guid, tile
    UNION ALL SELECT 'sim', title, tile, count(*) FROM sims GROUP BY title, tile"""
)
def union_placements(spark, d):
    return placements.union_objects(S.placements(spark, d), S.sims(spark, d)).groupBy("kind", "name", "tile").agg(F.count("*").alias("n"))


@query(f"WITH {S.PLACEMENTS}, {S.MODELS} SELECT guid FROM placements EXCEPT SELECT guid FROM models")
def set_difference(spark, d):
    return placements.guids_without_model(S.placements(spark, d), S.models(spark, d))


@query(
    """WITH objects AS (SELECT DISTINCT upper(p_type) || ' ' AS title FROM part), configs AS (SELECT p_type AS title, p_brand || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path FROM part WHERE p_size > 5)
    SELECT o.title, min(k.path) AS path FROM objects o JOIN configs k ON lower(trim(o.title)) = lower(trim(k.title)) GROUP BY o.title"""
)
def config_title_first(spark, d):
    part = S.read(spark, d, "part")
    objects = part.select(F.concat(F.upper("p_type"), F.lit(" ")).alias("title")).distinct()
    configs = part.where("p_size > 5").select(c("p_type").alias("title"), F.concat("p_brand", F.lit("/"), F.lpad(c("p_partkey").cast("string"), 9, "0")).alias("path"))
    return placements.first_by_title(objects, configs).select("title", "path")


@query(
    """WITH paths AS (SELECT DISTINCT url AS path FROM pages), folders AS (SELECT DISTINCT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages WHERE page_id % 3 = 0),
    spread AS (SELECT path, array_to_string(string_split(path, '/')[1:n], '/') AS folder FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM paths))
    SELECT path, arg_max(folder, length(folder)) AS folder FROM spread JOIN folders USING (folder) GROUP BY path"""
)
def ancestor_dir(spark, d):
    pages = S.read(spark, d, "pages")
    folders = pages.where("page_id % 3 = 0").select(F.regexp_extract("url", r"^(.*)/[^/]*$", 1).alias("folder"))
    return placements.nearest_ancestor(pages.select(c("url").alias("path")).distinct(), folders)


@query(
    """WITH wanted AS (SELECT lower('Brand#' || (s_nationkey + 1)) AS name, 'Standard/small ' || s_name AS path FROM supplier), files AS (SELECT DISTINCT p_brand AS name, p_type || '/' || p_name AS file FROM part),
    pairs AS (SELECT w.name, w.path, f.file, len(list_filter(generate_series(1, least(length(w.path), length(f.file))), lambda i: left(lower(w.path), i) = left(lower(f.file), i))) AS prefix FROM wanted w JOIN files f ON lower(w.name) = lower(f.name))
    SELECT name, path, file, CAST(prefix AS INTEGER) AS prefix FROM pairs QUALIFY row_number() OVER (PARTITION BY name, path ORDER BY prefix DESC, file) = 1"""
)
def best_prefix_match(spark, d):
    wanted = S.read(spark, d, "supplier").select(F.expr("lower('Brand#' || (s_nationkey + 1))").alias("name"), F.expr("'Standard/small ' || s_name").alias("path"))
    files = S.read(spark, d, "part").select(c("p_brand").alias("name"), F.concat("p_type", F.lit("/"), "p_name").alias("file")).distinct()
    return placements.best_prefix(wanted, files)


# Elevation

_POINTS = "points AS (SELECT DISTINCT tile, lon_raw * 1000000000 + lat_raw AS pid, lat, lon FROM placements WHERE flags % 2 = 1)"
_AREA = "((b_lon - a_lon) * (c_lat - a_lat) - (c_lon - a_lon) * (b_lat - a_lat))"
_HELD = f"""weighed AS (SELECT *, {_AREA} AS area, ((lon - a_lon) * (c_lat - a_lat) - (c_lon - a_lon) * (lat - a_lat)) / {_AREA} AS v, ((b_lon - a_lon) * (lat - a_lat) - (lon - a_lon) * (b_lat - a_lat)) / {_AREA} AS w
        FROM points JOIN triangles USING (tile) WHERE lat BETWEEN least(a_lat, b_lat, c_lat) AND greatest(a_lat, b_lat, c_lat) AND lon BETWEEN least(a_lon, b_lon, c_lon) AND greatest(a_lon, b_lon, c_lon) AND {_AREA} <> 0),
    held AS (SELECT tile, pid, mesh, arg_min((1 - v - w) * a_alt + v * b_alt + w * c_alt, tid) AS alt FROM weighed WHERE area * area >= 1e-12 AND 1 - v - w >= -1e-6 AND v >= -1e-6 AND w >= -1e-6 GROUP BY tile, pid, mesh)"""


def _points(spark, d):
    return S.placements(spark, d).where("flags % 2 = 1").select("tile", F.expr("lon_raw * 1000000000 + lat_raw").alias("pid"), "lat", "lon").distinct()


@query(f"WITH {S.PLACEMENTS}, {S.VERTICES}, {S.TRIANGLES}, {_POINTS}, {_HELD} SELECT tile, pid, mesh, round(alt, 5) AS alt FROM held")
def elevation_barycentric(spark, d):
    return elevation.by_triangle(_points(spark, d), S.triangles(spark, d)).withColumn("alt", F.round("alt", 5))


@query(
    f"""WITH {S.PLACEMENTS}, {S.VERTICES}, {S.TRIANGLES}, {_POINTS}, {_HELD}, missing AS (SELECT p.*, m.mesh FROM points p JOIN (SELECT DISTINCT tile, mesh FROM vertices) m USING (tile) ANTI JOIN held USING (tile, pid, mesh)),
    near AS (SELECT p.tile, p.pid, p.mesh, arg_min(v.alt, ((p.lat - v.lat) * (p.lat - v.lat) + (p.lon - v.lon) * (p.lon - v.lon), v.vid)) AS alt FROM missing p JOIN vertices v ON p.tile = v.tile AND p.mesh = v.mesh GROUP BY 1, 2, 3),
    top AS (SELECT tile, pid, max(alt) AS alt FROM (SELECT * FROM held UNION ALL SELECT * FROM near) GROUP BY tile, pid)
    SELECT p.tile, p.pid, round(greatest(0e0, coalesce(t.alt, 0e0)), 5) AS elevation FROM points p LEFT JOIN top t USING (tile, pid)"""
)
def elevation_nearest(spark, d):
    return elevation.elevation(_points(spark, d), S.triangles(spark, d), S.vertices(spark, d)).withColumn("elevation", F.round("elevation", 5))


# Scene documents


@query("SELECT vec_id, CASE WHEN vec_id % 70 < 64 THEN vec_id % 70 * 12 ELSE 0 END + vec_id % 5 * 4 AS at, CASE WHEN vec_id % 70 < 64 THEN vec_id % 70 % 3 * 8 ELSE 0 END AS stride, vec_id % 11 AS n FROM embeddings")
def index_chain(spark, d):
    """Primitive to accessor to view, through the arrays of a scene; a dangling view counts as none."""
    i32 = lambda x: F.expr(f"cast({x} as int)")
    views = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct((i * 12).alias("byteOffset"), (i % 3 * 8).alias("byteStride")))
    accessors = F.array(F.struct(i32("vec_id % 70").alias("bufferView"), i32("vec_id % 5 * 4").alias("byteOffset"), i32("vec_id % 11").alias("count"), F.lit(5126).alias("componentType")))
    e = S.read(spark, d, "embeddings").select("vec_id", F.struct(accessors.alias("accessors"), views.alias("bufferViews")).alias("scene"))
    at, stride, n, _ = meshes.located(meshes.at(F.col("scene.accessors"), F.lit(0)))
    return e.select("vec_id", at.cast("bigint").alias("at"), stride.cast("bigint").alias("stride"), n.cast("bigint").alias("n"))


@query(
    """WITH RECURSIVE nodes AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 50 = 0 THEN NULL ELSE s_suppkey // 50 * 50 + (s_suppkey % 50 - 1) // 2 END AS parent FROM supplier),
    walk AS (SELECT node, node AS root, 0 AS depth, CAST(node AS VARCHAR) AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT c.node, w.root, w.depth + 1, w.path || '/' || c.node FROM walk w JOIN nodes c ON c.parent = w.node),
    bearing AS (SELECT DISTINCT unnest(string_split(path, '/')) AS node FROM walk WHERE node % 7 = 3)
    SELECT node, root, depth, path FROM walk WHERE CAST(node AS VARCHAR) IN (SELECT node FROM bearing)"""
)
def scene_tree(spark, d):
    supplier = S.read(spark, d, "supplier")
    nodes = supplier.select(c("s_suppkey").alias("node"), F.expr("CASE WHEN s_suppkey % 50 = 0 THEN NULL ELSE s_suppkey div 50 * 50 + (s_suppkey % 50 - 1) div 2 END").alias("parent"))
    walked = scene.tree(spark, nodes)
    return scene.bearing_nodes(walked, nodes.where("node % 7 = 3")).select("node", "root", "depth", "path")


def _supplier_refs(spark, d):
    return S.read(spark, d, "supplier").select("s_nationkey", "s_suppkey")


_REF = "rows AS (SELECT s_nationkey, s_suppkey AS v, row_number() OVER w - 1 AS i, lead(s_suppkey, 1) OVER w AS n1, lead(s_suppkey, 2) OVER w AS n2, first_value(s_suppkey) OVER w AS v0 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))"


@query(f"WITH {_REF} SELECT s_nationkey, i // 3 AS tid, v AS a, n2 AS b, n1 AS c FROM rows WHERE i % 3 = 0 AND n2 IS NOT NULL")
def list_triangles(spark, d):
    return scene.list_triangles(_supplier_refs(spark, d), "s_nationkey", "s_suppkey", "s_suppkey")


@query(f"WITH {_REF} SELECT s_nationkey, CAST(i AS INTEGER) AS tid, v AS a, CASE WHEN i % 2 = 1 THEN n2 ELSE n1 END AS b, CASE WHEN i % 2 = 1 THEN n1 ELSE n2 END AS c FROM rows WHERE n2 IS NOT NULL")
def strip_triangles(spark, d):
    return scene.strip_triangles(_supplier_refs(spark, d), "s_nationkey", "s_suppkey", "s_suppkey")


@query(f"WITH {_REF} SELECT s_nationkey, CAST(i - 1 AS INTEGER) AS tid, v0 AS a, v AS b, n1 AS c FROM rows WHERE i >= 1 AND n1 IS NOT NULL")
def fan_triangles(spark, d):
    return scene.fan_triangles(_supplier_refs(spark, d), "s_nationkey", "s_suppkey", "s_suppkey")


@query("SELECT p_brand, p_partkey, p_size, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM part")
def buffer_offsets(spark, d):
    return scene.offsets(S.read(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_partkey"], "p_size")


@query(f"WITH {S.PLACEMENTS} SELECT guid, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM placements QUALIFY row_number() OVER (PARTITION BY guid, l_suppkey ORDER BY {', '.join(S.SEQ)}) = 1")
def first_per_chunk(spark, d):
    return scene.first_in(S.placements(spark, d), ["guid", "l_suppkey"], S.SEQ).select("guid", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query(
    """WITH m AS (SELECT p_partkey AS seq, p_size / 50e0 AS metallic, (p_size % 7) / 6e0 AS roughness, (p_size % 3) / 2e0 AS alpha FROM part),
    k AS (SELECT seq, printf('%.3f|%d|%.3f', greatest(0e0, least(1e0, metallic)) * 0.5e0 + 0.04e0, CAST(round_even((1 - roughness) * 128, 0) AS INTEGER), 1 - alpha) AS key FROM m), s AS (SELECT key, min(seq) AS seen FROM k GROUP BY key)
    SELECT key, seen, CAST(row_number() OVER (ORDER BY seen) AS INTEGER) AS id FROM s"""
)
def material_dedupe(spark, d):
    m = S.read(spark, d, "part").select(c("p_partkey").alias("seq"), scalars.phong(F.expr("p_size / 50D"), F.expr("(p_size % 7) / 6D"), F.expr("(p_size % 3) / 2D")).alias("m"))
    return scene.first_seen_ids(m, F.format_string("%.3f|%d|%.3f", "m.specular", "m.shininess", "m.transparency"), "seq", 1)


@query(
    f"""WITH {S.PLACEMENTS}, v AS (SELECT tile, l_orderkey * 10 + l_linenumber AS seq, CAST(round_even(lon * 100, 0) AS INTEGER) AS qx, CAST(round_even(lat * 100, 0) AS INTEGER) AS qy, min(l_partkey) AS part FROM placements GROUP BY ALL),
    u AS (SELECT tile, seq, min(qx) AS qx, min(qy) AS qy, min(part) AS part FROM v GROUP BY tile, seq), k AS (SELECT tile, qx, qy, min(seq) AS seen, arg_min(part, seq) AS part FROM u GROUP BY tile, qx, qy)
    SELECT *, CAST(row_number() OVER (PARTITION BY tile ORDER BY seen) - 1 AS INTEGER) AS vertex FROM k"""
)
def vertex_dedupe(spark, d):
    p = S.placements(spark, d).select("tile", F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), scalars.quantise(c("lon"), 100.0).alias("qx"), scalars.quantise(c("lat"), 100.0).alias("qy"), c("l_partkey").alias("part"))
    one = p.groupBy("tile", "seq").agg(F.min("qx").alias("qx"), F.min("qy").alias("qy"), F.min("part").alias("part"))
    return scene.first_vertices(one, "tile", ["qx", "qy"], "seq", "part")


@query(
    """WITH t AS (SELECT p_partkey, replace(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ', '_') || '.dds' AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) - 1 AS n FROM t)
    SELECT p_partkey, name, CASE WHEN n = 0 THEN name ELSE regexp_extract(name, '^(.*)\\.dds$', 1) || '_' || n || '.dds' END AS unique FROM n""".replace("AS unique", 'AS "unique"')
)
def unique_names(spark, d):
    t = S.read(spark, d, "part").select("p_partkey", F.expr("replace(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ', '_') || '.dds'").alias("name"))
    return scene.unique_names(t, "name", "p_partkey")


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(spark, d):
    return S.read(spark, d, "events").select("event_id", scalars.json_field(c("props"), "k", "int", 0).alias("k"), scalars.json_field(c("props"), "missing", "string").alias("missing"))


@query(
    """WITH l AS (SELECT p_brand AS model, p_partkey AS seq, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name || '.gltf' END AS file FROM part)
    SELECT model, arg_max(file, (size, -seq)) AS file FROM l WHERE trim(file) <> '' GROUP BY model"""
)
def xml_attr(spark, d):
    """Attributes are read from XML texts; either spelling of the size will do."""
    xml = F.format_string('<LODS><LOD %s="%d" ModelFile="%s"/></LODS>', F.expr("if(p_partkey % 2 = 0, 'minSize', 'MinSize')"), c("p_size"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name || '.gltf' END"))
    part = S.read(spark, d, "part").select(c("p_brand").alias("model"), c("p_partkey").alias("seq"), xml.alias("xml"))
    read = lambda path: F.xpath_string("xml", F.lit(path))
    lods = part.select("model", "seq", F.concat(read("/LODS/LOD/@MinSize"), read("/LODS/LOD/@minSize")).alias("min_size"), read("/LODS/LOD/@ModelFile").alias("file"))
    return scene.best_lod(lods)


@query("SELECT p_brand AS path, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS model, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS texture FROM part")
def regex_extract(spark, d):
    """Blocks of config texts; of a block's lines only the title has to be there."""
    part = S.read(spark, d, "part")
    model = F.when(c("p_partkey") % 3 != 0, F.format_string("MODEL= %s \r\n", "p_type")).otherwise("")
    texture = F.when(c("p_partkey") % 3 == 1, F.format_string("texture=%d", "p_size")).otherwise("")
    block = F.concat(F.format_string("[fltsim.%d]\r\ntitle= %s\r\n", "p_partkey", "p_name"), model, texture)
    texts = part.groupBy(c("p_brand").alias("path")).agg(F.array_join(F.collect_list(block), "\n").alias("text"))
    return scenery.config_blocks(texts)


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE repeat(' ', strlen(c)) END), '') AS text FROM documents")
def ascii_scrub(spark, d):
    return S.read(spark, d, "documents").select("doc_id", bytewise.printable(c("text").cast("binary")).alias("text"))


_HALF = lambda x: f"CASE WHEN {x} < 0 THEN CAST('18446744073709551616' AS UHUGEINT) - CAST(-{x} AS UHUGEINT) ELSE CAST({x} AS UHUGEINT) END"
_POWER = lambda k: f"CAST('{62**k}' AS UHUGEINT)"
_DIGITS = " || ".join(f"CASE WHEN seed >= {_POWER(k + 1)} THEN substr('{bytewise.DIGITS}', CAST((seed // {_POWER(k)}) % 62 AS BIGINT) + 1, 1) ELSE '' END" for k in range(21))


@query(
    f"""WITH {S.SIMS}, h AS (SELECT seq, CAST(trunc(CAST(lat AS FLOAT) * CAST(100000 AS FLOAT)) AS BIGINT) AS high, CAST(trunc(CAST(lon AS FLOAT) * CAST(100000 AS FLOAT)) AS BIGINT) AS low FROM sims),
    s AS (SELECT seq, ({_HALF('high')}) * CAST('18446744073709551616' AS UHUGEINT) + ({_HALF('low')}) AS seed FROM h) SELECT seq, {_DIGITS} AS id FROM s"""
)
def base62_id(spark, d):
    return S.sims(spark, d).select("seq", bytewise.object_id(c("lat"), c("lon")).alias("id"))


_NUMBER = "regexp_replace(regexp_replace(printf('%.6f', {0}), '0+$', ''), '\\.$', '')"


@query(
    f"""WITH {S.PLACEMENTS}, t AS (SELECT tile, round_even(avg(lat), 6) AS lat, round_even(avg(lon), 6) AS lon, round_even(avg(alt), 6) AS alt FROM placements GROUP BY tile)
    SELECT tile, 'OBJECT_STATIC ' || tile || CASE WHEN tile % 2 = 0 THEN '.xml ' ELSE '.gltf ' END || {_NUMBER.format('lon')} || ' ' || {_NUMBER.format('lat')} || ' ' || {_NUMBER.format('alt')} || CASE WHEN tile % 2 = 0 THEN ' 0 0 90' ELSE ' 270 0 90' END AS line FROM t"""
)
def scene_line(spark, d):
    t = S.placements(spark, d).groupBy("tile").agg(*[F.bround(F.avg(x), 6).alias(x) for x in ("lat", "lon", "alt")])
    return t.select("tile", sinks.placement_line(c("tile"), c("lon"), c("lat"), c("alt"), animated=c("tile") % 2 == 0).alias("line"))


from . import documents, encoded  # noqa: E402  more queries, that add themselves

for _more in (documents, encoded):
    QUERIES |= _more.QUERIES
    ORACLE |= _more.ORACLE
