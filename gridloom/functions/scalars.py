"""Field decoding, geometry and material arithmetic, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import FLAGS, RUNWAY_LIGHTS, RUNWAY_MARKINGS, RUNWAY_PATTERNS

METRES_LON, METRES_LAT, EARTH = 111320.0, 110540.0, 6371000.0
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3


def thousandths(raw: Column) -> Column:
    return raw / F.lit(1000.0)


def degrees16(raw: Column, places: int | None = 3) -> Column:
    """A 16-bit angle in degrees, rounded half to even."""
    value = raw * F.lit(360.0 / 65536)
    return value if places is None else F.bround(value, places)


def ident(raw: Column) -> Column:
    """Base-38 identifier above the low five bits: 0 is a blank, 2 to 11 are digits, 12 up are letters; decoding stops at 1 or less."""
    start = F.struct(F.shiftright(raw, 5).cast("int").alias("v"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        d = acc.v % 38
        c = F.when(d == 0, " ").otherwise(F.call_function("char", F.when(d.between(2, 11), d + 46).otherwise(d + 53)))
        more = acc.v > 1
        return F.struct(F.when(more, ((acc.v - d) / 38).cast("int")).otherwise(acc.v).alias("v"), F.when(more, F.concat(c, acc.s)).otherwise(acc.s).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda acc: acc.s)


def region(raw: Column) -> Column:
    return ident(raw.bitwiseAND(F.lit(0x3FF)))


def bits(value: Column, labels: list[str], first: int = 0) -> Column:
    """Labels of the set bits, in bit order; bit `first` has the first label."""
    named = F.array(*[F.when(F.shiftright(value, first + i).bitwiseAND(F.lit(1)) == 1, label) for i, label in enumerate(labels)])
    return F.filter(named, lambda x: x.isNotNull())


def flag_labels(flags: Column) -> Column:
    return bits(flags, FLAGS)


def field(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def runway_markings(marking: Column, light: Column) -> Column:
    """Sixteen markings by bit, three more in the high bits of the light byte."""
    return F.concat(bits(marking, RUNWAY_MARKINGS[:16]), bits(light, RUNWAY_MARKINGS[16:], 5))


def runway_lights(light: Column) -> Column:
    """Edge intensity (2 bits), centre intensity (2 bits), and red centre lights if set."""
    names = F.array(*[F.lit(x) for x in RUNWAY_LIGHTS])
    return F.concat(F.array(*[F.element_at(names, (field(light, at, 2) + first).cast("int")) for at, first in ((0, 1), (2, 5))]), bits(light, RUNWAY_LIGHTS[8:], 4))


def runway_patterns(pattern: Column) -> Column:
    return bits(pattern, RUNWAY_PATTERNS)


def parking(packed: Column) -> Column:
    """name, pushback, type, number and airline count of a packed parking."""
    at = {"name": (0, 6), "pushback": (6, 2), "type": (8, 4), "number": (12, 12), "airlines": (24, 8)}
    return F.struct(*[field(packed, *where).alias(k) for k, where in at.items()])


def local_offset(lon: Column, lat: Column, alt: Column, lon0: Column, lat0: Column, alt0: Column) -> Column:
    """Metres from an origin: dx west, dy up, dz north."""
    dx = -(lon - lon0) * METRES_LON * F.cos(lat0 * F.lit(math.pi / 180))
    return F.struct(dx.alias("dx"), (alt - alt0).alias("dy"), ((lat - lat0) * METRES_LAT).alias("dz"))


def quaternion(yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w of the rotation by roll, then pitch, then yaw (radians)."""
    sy, cy, sp, cp, sr, cr = (f(a / 2) for a in (yaw, pitch, roll) for f in (F.sin, F.cos))
    return cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr, cy * cp * sr - sy * sp * cr, cy * cp * cr + sy * sp * sr


def rotation(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major 3 x 3 matrix of a unit quaternion, for row vectors."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w),
        2 * (x * y - z * w), 1 - 2 * (z * z + x * x), 2 * (y * z + x * w),
        2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (y * y + x * x),
    ]


def placement_matrix(offset: Column, heading: Column, pitch: Column, bank: Column, scale: Column) -> Column:
    """Row-major 4 x 4 matrix that scales, rotates and moves a placed model (float)."""
    rad = F.lit(math.pi / 180)
    r = [scale * m for m in rotation(*quaternion(-heading * rad, pitch * rad, bank * rad))]
    zero, one = F.lit(0.0), F.lit(1.0)
    cells = [*r[:3], zero, *r[3:6], zero, *r[6:], zero, offset.dx, offset.dy, offset.dz, one]
    return F.array(*[c.cast("float") for c in cells])


def node_matrix(matrix: Column, t: Column, r: Column, s: Column) -> Column:
    """A node's own matrix if it has one, else from translation, rotation (normalised) and scale, with their defaults."""
    part = lambda a, i, default: F.coalesce(F.get(a, F.lit(i)).cast("double"), F.lit(float(default)))
    q = [part(r, i, i == 3) for i in range(4)]
    length = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    m = rotation(*[c / F.when(length > 0, length).otherwise(1.0) for c in q])
    zero = F.lit(0.0)
    cells = [c for row in range(3) for c in (*[part(s, row, 1) * m[3 * row + i] for i in range(3)], zero)] + [part(t, i, 0) for i in range(3)] + [F.lit(1.0)]
    own = F.when(F.size(matrix) == 16, F.transform(matrix, lambda v: v.cast("float")))
    return F.coalesce(own, F.array(*[c.cast("float") for c in cells]))


def flip_axes(matrix: Column, signs: tuple[float, float, float, float] = (1, 1, -1, 1)) -> Column:
    """Conjugation of a row-major 4 x 4 matrix by a diagonal of signs."""
    return F.transform(matrix, lambda v, i: v * F.element_at(F.array(*[F.lit(float(a * b)).cast("float") for a in signs for b in signs]), i + 1))


def near_identity(matrix: Column, eps: float = 1e-5) -> Column:
    return F.forall(F.transform(matrix, lambda v, i: F.abs(v - F.when(i % 5 == 0, 1.0).otherwise(0.0)) <= eps), lambda ok: ok)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres over ground."""
    rad = F.lit(math.pi / 180)
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return (F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360) % 360


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Straight distance of two points."""
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2) + F.pow(az - bz, 2))


def turned(heading: Column, by: float = 270.0) -> Column:
    """A heading turned by some degrees; the sign follows the sum."""
    return (heading + F.lit(by)) % 360


def above_ground(alt: Column, labels: Column, elevation: Column) -> Column:
    """The altitude of a placement: over the ground's elevation where its flags say so."""
    return F.when(F.array_contains(labels, FLAGS[0]), alt + F.coalesce(elevation, F.lit(0.0))).otherwise(alt)


def geodetic(x: Column, y: Column, z: Column) -> Column:
    """lat, lon (degrees) and alt of earth-centred coordinates."""
    a, e2 = WGS84_A, WGS84_E2
    b = a * math.sqrt(1 - e2)
    p = F.sqrt(x * x + y * y)
    th = F.atan2(z * a, p * b)
    lat = F.atan2(z + (a * a - b * b) / b * F.pow(F.sin(th), 3), p - e2 * a * F.pow(F.cos(th), 3))
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    deg = F.lit(180 / math.pi)
    return F.struct((lat * deg).alias("lat"), (F.atan2(y, x) * deg).alias("lon"), (p / F.cos(lat) - n).alias("alt"))


def barycentric(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Weights u, v, w of a point in a triangle, and whether it lies inside (with 1e-6 slack; never in a degenerate one)."""
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    v = ((px - ax) * (cy - ay) - (cx - ax) * (py - ay)) / area
    w = ((bx - ax) * (py - ay) - (px - ax) * (by - ay)) / area
    u = 1 - v - w
    flat = area * area < 1e-12
    ok = ~flat & (u >= -1e-6) & (v >= -1e-6) & (w >= -1e-6)
    return F.struct(F.when(~flat, u).otherwise(0.0).alias("u"), F.when(~flat, v).otherwise(0.0).alias("v"), F.when(~flat, w).otherwise(0.0).alias("w"), ok.alias("ok"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def phong(metallic: Column, roughness: Column, alpha: Column) -> Column:
    """Specular, shininess and transparency that stand in for a physically based material."""
    m, r, a = clamp(F.coalesce(metallic, F.lit(0.0))), clamp(F.coalesce(roughness, F.lit(1.0))), clamp(F.coalesce(alpha, F.lit(1.0)))
    return F.struct((m * 0.5 + 0.04).alias("specular"), F.bround((1 - r) * 128, 0).cast("int").alias("shininess"), (1 - a).alias("transparency"))


def quantise(x: Column, scale: float = 10000.0) -> Column:
    return F.bround(x * F.lit(scale), 0).cast("int")


def number_text(x: Column) -> Column:
    """Up to six decimals, no trailing zeros, no negative zero."""
    text = F.call_function("format_number", x, F.lit("0.######"))
    return F.when(text == "-0", "0").otherwise(text)


def json_field(text: Column, field: str, kind: str, default: object = None) -> Column:
    """A field of a JSON text; where it is missing, or the text isn't JSON, the default."""
    value = F.from_json(text, f"`{field}` {kind}")[field]
    return value if default is None else F.coalesce(value, F.lit(default))


def clean_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(name, F.lit('"'), F.lit("_")), F.lit("")), F.lit("Unnamed"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The file name's extension with its dot; none: empty."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def folder(path: Column) -> Column:
    """What stands before the last slash of either kind; no slash: empty."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def mirrored(xyz: Column, axis: int) -> Column:
    """A point (array) with one coordinate negated."""
    return F.transform(xyz, lambda v, i: F.when(i == axis, -v).otherwise(v))


def common_prefix(a: Column, b: Column, ignore_case: bool = True) -> Column:
    """Length of the common prefix: how many prefix lengths agree."""
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))))


def surface_flags(two_sided: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(F.when(two_sided, 48).otherwise(16)))
