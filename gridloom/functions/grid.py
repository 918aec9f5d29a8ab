"""The latitude-banded tile grid, as column expressions.

A tile key packs, from the high bits, the whole degree west edge + 180 (bits 14 up), the whole degree south edge + 90
(bits 6 to 13), the eighth of a degree within it (bits 3 to 5) and the tile within the row (bits 0 to 2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tile width in degrees from each absolute latitude up.
WIDTHS = [(89, 12.0), (86, 4.0), (83, 2.0), (76, 1.0), (62, 0.5), (22, 0.25), (0, 0.125)]

# Raw units per turn of longitude and half turn of latitude.
LON_RAW, LAT_RAW = 805306368, 536870912


def longitude(raw: Column) -> Column:
    return raw * F.lit(360.0 / LON_RAW) - 180


def latitude(raw: Column) -> Column:
    return 90 - raw * F.lit(180.0 / LAT_RAW)


def tile_width(absolute_latitude: Column) -> Column:
    """Width of the tiles at a latitude; null beyond 90.

    The bands begin at whole degrees, so the width is looked up by the whole degree: one step of generated code, where a
    chain of conditions would make methods too long for the JVM to compile.
    """
    by_degree = [next(width for least, width in WIDTHS if degree >= least) for degree in range(91)]
    return F.get(F.array(*[F.lit(w) for w in by_degree]), F.floor(absolute_latitude).cast("int"))


def tile_key(lat: Column, lon: Column) -> Column:
    """Key of the tile that holds a point; 0 outside of the globe; null for null."""
    width = tile_width(F.abs(lat))
    west = F.floor(F.floor(lon / width) * width)
    x = F.floor((lon - west) / width)
    south = F.floor(lat)
    y = F.floor((lat - south) * 8)
    key = F.shiftleft((west + 180).cast("bigint"), 14) + F.shiftleft((south + 90).cast("bigint"), 6) + F.shiftleft(y.cast("bigint"), 3) + x
    return F.when((F.abs(lat) > 90) | (F.abs(lon) > 180), 0).when(lat.isNotNull() & lon.isNotNull(), key).cast("int")


def tile_corner(key: Column, compat: bool = False) -> Column:
    """South-west corner (lat, lon) of a tile.

    The width is that of the row's middle. compat takes it from the whole-degree latitude instead, which gives wrong
    longitudes in the southern rows where a band ends.
    """
    x, y = key.bitwiseAND(F.lit(7)), F.shiftright(key, 3).bitwiseAND(F.lit(7))
    south, west = F.shiftright(key, 6).bitwiseAND(F.lit(255)) - 90, F.shiftright(key, 14) - 180
    lat = south + y / F.lit(8.0)
    width = tile_width(F.abs(south) if compat else F.abs(lat + 1 / 16))
    return F.struct(lat.alias("lat"), (west + x * width).alias("lon"))


def tile_folder(lat: Column, lon: Column) -> Column:
    """Folder of a tile's corner: ten-degree square, then one-degree square."""
    east, north = F.when(lon >= 0, "e").otherwise("w"), F.when(lat >= 0, "n").otherwise("s")
    ten = lambda v: F.abs(F.floor(v / 10)) * 10
    return F.format_string("%s%03d%s%02d/%s%03d%s%02d", east, ten(lon), north, ten(lat), east, F.abs(F.floor(lon)), north, F.abs(F.floor(lat)))
