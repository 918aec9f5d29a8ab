import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import bytewise, grid, labels, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "lat, lon, key",
    [(37.6, -122.4, 942050), (51.47, -0.45, 2941786), (0.0, 0.0, 2954880), (-33.9, 151.2, 5426688), (64.1, -21.9, 2598528), (89.5, -7.0, 2764000), (91.0, 0.0, 0)],
)
def test_tile_key(spark, lat, lon, key):
    assert one(spark, grid.tile_key(F.lit(lat), F.lit(lon))) == key


def test_tile_key_of_null(spark):
    assert one(spark, grid.tile_key(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_corner_holds_its_points(spark):
    df = spark.range(20000).select((F.rand(1) * 170 - 85).alias("lat"), (F.rand(2) * 358 - 179).alias("lon"))
    df = df.withColumn("c", grid.tile_corner(grid.tile_key(F.col("lat"), F.col("lon"))))
    width = grid.tile_width(F.abs(F.col("c.lat") + 1 / 16))
    inside = (F.col("lat") >= F.col("c.lat")) & (F.col("lat") < F.col("c.lat") + 0.125) & (F.col("lon") >= F.col("c.lon")) & (F.col("lon") < F.col("c.lon") + width)
    assert df.where(~inside).count() == 0


def test_corner_compatible(spark):
    old, new = (one(spark, grid.tile_corner(F.lit(5083431), compat)) for compat in (True, False))
    assert (old.lon, new.lon) == (131.75, 130.875)


@pytest.mark.parametrize("lat, lon, folder", [(37.5, -122.5, "w130n30/w123n37"), (-34.0, 151.0, "e150s40/e151s34"), (51.375, -0.5, "w010n50/w001n51")])
def test_folder(spark, lat, lon, folder):
    assert one(spark, grid.tile_folder(F.lit(lat), F.lit(lon))) == folder


def test_raw_positions(spark):
    assert one(spark, grid.longitude(F.lit(127000000))) == pytest.approx(-123.22657585144043, rel=1e-12)
    assert one(spark, grid.latitude(F.lit(156000000))) == pytest.approx(37.69692420959473, rel=1e-12)


@pytest.mark.parametrize("raw, text", [(40037632, "KSFO"), (28954912, "EGLL"), (39188160, "KA12"), (129248, "0S9"), (0, "")])
def test_ident(spark, raw, text):
    assert one(spark, scalars.ident(F.lit(raw))) == text


@pytest.mark.parametrize("lat, lon, text", [(37.62, -122.38, "SPkElLFObIGTVA"), (51.47, -0.45, "wKNMD2m8r8qSEE"), (-33.94, 151.17, "02TkjVWdnoeZFq0mgd24N"), (0.0, 0.0005, "")])
def test_object_id(spark, lat, lon, text):
    assert one(spark, bytewise.object_id(F.lit(lat), F.lit(lon))) == text


def test_printable(spark):
    assert one(spark, bytewise.printable(F.lit("aé\tb").cast("binary"))) == "a   b"
    assert one(spark, bytewise.printable(F.lit(None).cast("binary"))) is None


def test_local_offset(spark):
    o = one(spark, scalars.local_offset(*[F.lit(x) for x in (-122.38, 37.62, 1.0, -122.40, 37.60, 0.0)]))
    assert (o.dx, o.dz) == (pytest.approx(-1763.953661966899, rel=1e-12), pytest.approx(2210.79999999956, rel=1e-9))


def test_geodetic(spark):
    g = one(spark, scalars.geodetic(F.lit(-2706000.0), F.lit(-4261000.0), F.lit(3885000.0)))
    assert (g.lat, g.lon, g.alt) == pytest.approx((37.77052756192934, -122.41808664987404, -558.1727490341291), rel=1e-9)


def test_barycentric(spark):
    tri = [F.lit(float(x)) for x in (0, 0, 1, 0, 0, 1)]
    inside, outside = (one(spark, scalars.barycentric(F.lit(p), F.lit(p), *tri)) for p in (0.25, 0.9))
    assert (inside.u, inside.v, inside.w, inside.ok) == (0.5, 0.25, 0.25, True)
    assert (round(outside.u, 9), outside.ok) == (-0.8, False)
    flat = one(spark, scalars.barycentric(*[F.lit(0.0)] * 8))
    assert (flat.u, flat.ok) == (0.0, False)


def test_bits_and_labels(spark):
    assert one(spark, scalars.flag_labels(F.lit(5))) == [labels.FLAGS[0], labels.FLAGS[2]]
    assert one(spark, scalars.runway_lights(F.lit(0b11001))) == ["EdgeLowIntensity", "CenterMediumIntensity", "CenterRed"]
    assert one(spark, scalars.runway_markings(F.lit(1), F.lit(128))) == ["Edges", "NoThresholdEndArrows"]
    assert len(labels.PARKING_NAMES) == 38 and labels.PARKING_NAMES[12] == "GateA"


def test_matrices(spark):
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("dx", "dy", "dz")])
    m = one(spark, scalars.placement_matrix(zero, F.lit(90.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    assert m[0] == pytest.approx(0, abs=1e-6) and abs(m[2]) == pytest.approx(2) and m[15] == 1
    none = F.lit(None).cast("array<double>")
    assert one(spark, scalars.near_identity(scalars.node_matrix(none, none, none, none)))
    assert not one(spark, scalars.near_identity(scalars.node_matrix(none, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), none, none)))
    flipped = one(spark, scalars.flip_axes(F.array(*[F.lit(float(i)).cast("float") for i in range(16)])))
    assert flipped[2] == -2 and flipped[10] == 10 and flipped[0] == 0


def test_texts(spark):
    assert [one(spark, scalars.number_text(F.lit(x))) for x in (1.5, -1e-7, 1234567.0)] == ["1.5", "0", "1234567"]
    assert [one(spark, scalars.clean_name(F.lit(x))) for x in ('a"b', "", None)] == ["a_b", "Unnamed", "Unnamed"]
    assert one(spark, scalars.common_prefix(F.lit("Abc"), F.lit("aBd"))) == 2
    assert one(spark, scalars.common_prefix(F.lit("Abc"), F.lit("aBd"), False)) == 0
    assert one(spark, scalars.common_prefix(F.lit(""), F.lit("aBd"))) == 0
    assert one(spark, scalars.file_name(F.lit(r"a/b\c.dds"))) == "c.dds"
    assert one(spark, scalars.surface_flags(F.lit(True))) == "0x30"
    assert one(spark, scalars.degrees16(F.lit(16384))) == 90.0 and not math.isnan(one(spark, scalars.bearing(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])))
