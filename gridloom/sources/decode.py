"""Decoders of scenery containers, model payloads and terrain meshes. Bytes in, rows out; no Spark here.

Layouts are little-endian. A cursor that can't go on (an unknown size of zero, a truncated part) ends its part of the
file; what was read before stays.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np

# Container marks and record ids.
MAGIC_AT_0, MAGIC_AT_16 = bytes.fromhex("01029219"), bytes.fromhex("03180508")
SCENERY, AIRPORTS, MODELS = 0x0025, 0x0003, 0x002B
PLACEMENT, SIM_OBJECT, AIRPORT = 0x0B, 0x19, 0x56
TERRAIN_MAGIC = 0x5347

TURN_LON, TURN_LAT, TURN_16 = 360.0 / 805306368, 180.0 / 536870912, 360.0 / 65536


def u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def is_container(b: bytes) -> bool:
    return len(b) >= 0x38 and b[:4] == MAGIC_AT_0 and b[0x10:0x14] == MAGIC_AT_16


def subsections(b: bytes, kind: int, first_only: bool = False) -> Iterator[tuple[int, int]]:
    """(offset, size) of the data of every subsection of the records of a kind."""
    for i in range(u32(b, 0x14)):
        at = 0x38 + 0x14 * i
        if at + 0x14 > len(b):
            return
        if u32(b, at) == kind:
            for j in range(1 if first_only else u32(b, at + 8)):
                sub = u32(b, at + 12) + 16 * j
                if sub + 16 <= len(b):
                    yield u32(b, sub + 8), u32(b, sub + 12)


def parts(b: bytes, start: int, end: int, wide: bool = False) -> Iterator[tuple[int, int, int]]:
    """(id, offset, size) of the tagged parts in a range; sizes are 16 bits, or 32 if wide."""
    end = min(end, len(b))
    while start + (6 if wide else 4) <= end:
        size = u32(b, start + 2) if wide else u16(b, start + 2)
        if not size:
            return
        yield u16(b, start), start, size
        start += size


def guid(b: bytes, at: int, plain: bool = False) -> str:
    """Canonical text with the first three fields little-endian; plain: the bytes as hex."""
    raw = bytes(b[at : at + 16])
    return raw.hex() if plain else str(uuid.UUID(bytes_le=raw))


def placed(b: bytes, at: int) -> dict:
    lon, lat, alt, flags, pitch, bank, heading, complexity = struct.unpack_from("<IIihhhhH", b, at + 4)
    turn = lambda v: round(v * TURN_16, 3)
    return {
        "offset": at, "lon": lon * TURN_LON - 180, "lat": 90 - lat * TURN_LAT, "alt": alt / 1000, "flags": flags & 0xFFFF, "pitch": turn(pitch),
        "bank": turn(bank), "heading": turn(heading), "complexity": complexity,
    }


def placement(b: bytes, at: int) -> dict:
    return placed(b, at) | {"kind": "placement", "guid": guid(b, at + 44), "scale": struct.unpack_from("<f", b, at + 60)[0]}


def sim_object(b: bytes, at: int) -> dict:
    scale, n, m = struct.unpack_from("<fHH", b, at + 44)
    text = lambda i, k: b[i : i + k].decode("ascii", "replace").rstrip("\0")
    return placed(b, at) | {"kind": "sim", "scale": scale, "title": text(at + 52, n), "path": text(at + 52 + n, m)}


def object_at(b: bytes, kind: int, at: int, size: int) -> dict | None:
    least = {PLACEMENT: 64, SIM_OBJECT: 52}.get(kind)
    if least is None or size < least or at + size > len(b):
        return None
    return placement(b, at) if kind == PLACEMENT else sim_object(b, at)


def objects(b: bytes) -> Iterator[dict]:
    """Placements and sim objects of a container, those that jetways embed included."""
    if not is_container(b):
        return
    for start, size in subsections(b, SCENERY):
        for kind, at, n in parts(b, start, start + size):
            if row := object_at(b, kind, at, n):
                yield row
    for _, kind, at, n in airport_children(b):
        if kind == 0xDE and at + 20 <= len(b):
            inner, first, second = at + 20, u16(b, at + 14), u16(b, at + 16)
            for begin, k in ((inner, first), (inner + first, second)):
                if k >= 4 and (row := object_at(b, u16(b, begin), begin, k)):
                    yield row


def model_directory(b: bytes, first_only: bool = True, plain: bool = False, base: int | None = None) -> Iterator[dict]:
    """guid, offset and size of each model payload. Offsets count from the subsection's data, or from `base` if given."""
    if is_container(b):
        for start, size in subsections(b, MODELS, first_only):
            count = 0
            while 24 * (count + 1) <= size and start + 24 * (count + 1) <= len(b):
                at = start + 24 * count
                offset, n = (start if base is None else base) + u32(b, at + 16), u32(b, at + 20)
                if count and u32(b, start + 16) <= 24 * count:  # the first payload ends the directory
                    break
                if offset + n <= len(b):
                    yield {"guid": guid(b, at, plain), "offset": offset, "size": n}
                count += 1


# Names and codes of the fields of airport records, in their order. Codes: struct letters; ll position, alt and mil thousandths,
# ang a 32-bit angle, id an identifier, g a guid, rgba four bytes, a number bytes to skip.
RECORDS: dict[int, tuple[str, int, str]] = {
    0x19: ("name", 6, "name:text"),
    0xCE: ("runway", 6, "2 primary:B primary_designator:B secondary:B secondary_designator:B primary_ils:id secondary_ils:id at:ll alt:alt length:mil width:mil heading:ang pattern_alt:f marking:h light:B pattern:B 20 falloff:f surface:g color:rgba"),
    0x11: ("start", 6, "runway:B kind:B at:ll alt:alt heading:ang"),
    0x1A: ("taxi_points", 6, "n:H points:*n(type:B orientation:B 2 at:ll)"),
    0xE7: ("parkings", 6, "n:H parkings:*n(packed:I radius:f heading:ang tee1:f tee2:f tee3:f tee4:f at:ll airlines:airlines marking:B suffix:B 5 bias_x:f bias_z:f heading2:ang)"),
    0xD4: ("taxi_paths", 6, "n:H paths:*n(start:H end_designator:h type:B name:B edges:B surface:B width:f weight:I 8 material:g color:rgba materials_n:B flags:B end:H materials:*materials_n(2 4 type:B opacity:B material:g kind:I a:f b:f c:f d:f))"),
    0x1D: ("taxi_names", 6, "n:H names:*n(name:s8)"),
    0xD3: ("apron", 6, "flags:B opacity:B color:rgba surface:g tiling:f heading:ang falloff:f priority:i nv:H nt:H vertices:*nv(at:ll) triangles:*nt(a:H b:H c:H)"),
    0xD9: ("sign", 6, "2 at:ll heading:ang size:B justification:B label:s62"),
    0xCF: ("painted_line", 6, "type:B true_angle:B nv:I surface:g vertices:*nv(at:ll)"),
    0xD8: ("hatched_area", 6, "type:B nv:H heading:ang spacing:f vertices:*nv(at:ll)"),
    0xDE: ("jetway", 6, "parking:H gate:H suffix:H 2 first:H second:H"),
    0x57: ("light_support", 6, "2 at:latlon alt:i alt2:i heading:ang width:f length:f"),
    0x31: ("apron_lights", 6, "2 nv:H ne:H color:rgba scale:f falloff:f vertices:*nv(at:ll) edges:*ne(radius:f a:H b:H)"),
    0x26: ("helipad", 6, "surface:B kind:B color:rgba at:ll alt:alt length:f width:f heading:ang"),
    0xE8: ("projected_mesh", 6, "priority:B 1 flags:i n:H"),
}
PARTS: dict[int, tuple[str, str]] = {
    **dict.fromkeys((0x0B, 0x0C, 0x0D, 0x0E), ("vasi", "bias_x:f bias_z:f spacing:f pitch:f")),
    **dict.fromkeys((0x05, 0x07, 0x08, 0x65, 0x66), ("strip", "surface_code:I surface:g length:f width:f")),
    **dict.fromkeys((0xDF, 0xE0), ("approach_lights", "kind:B strobes:B spacing:f offset:f slope:f 4")),
    0xCB: ("material", "1 opacity:B material:g 4 tiling_u:f tiling_v:f width:f falloff:f"),
}
RUNWAY_PARTS_AT = 0x60


def base38(raw: int) -> str:
    out, raw = [], (raw - (1 << 32) if raw >> 31 else raw) >> 5
    while raw > 1:
        raw, d = divmod(raw, 38)
        out.append(" " if d == 0 else chr(d + (46 if 2 <= d <= 11 else 53)))
    return "".join(reversed(out))


class Fields:
    """Reads fields one after the other."""

    def __init__(self, b: bytes, at: int, end: int):
        self.b, self.at, self.end = b, at, min(end, len(b))

    def take(self, letters: str):
        n = struct.calcsize("<" + letters)
        if self.at + n > self.end:  # the file goes on behind the record; a slice to its end would copy all before it
            raise struct.error("a part ends early")
        got = struct.unpack_from("<" + letters, self.b, self.at)
        self.at += n
        return got if len(got) > 1 else got[0]

    def read(self, code: str, seen: dict):
        match code:
            case "ll":
                lon, lat = self.take("II")
                return [lon * TURN_LON - 180, 90 - lat * TURN_LAT]
            case "latlon":
                lat, lon = self.take("II")
                return [lon * TURN_LON - 180, 90 - lat * TURN_LAT]
            case "alt":
                return self.take("i") / 1000
            case "mil":
                return self.take("I") / 1000
            case "ang":
                return round(self.take("f") * TURN_16, 3)
            case "id":
                return base38(self.take("I"))
            case "g":
                self.at += 16
                if self.at > self.end:
                    raise struct.error("a part ends early")
                return guid(self.b, self.at - 16)
            case "rgba":
                return list(self.take("4B"))
            case "text":
                text, self.at = self.b[self.at : self.end].decode("utf-8", "replace").rstrip("\0"), self.end
                return text
            case "airlines":
                return [self.take("4s").decode("ascii", "replace") for _ in range(seen["packed"] >> 24)]
        if code[0] == "s" and code[1:]:
            return self.take(code[1:] + "s").decode("utf-8", "replace")
        return self.take(code)

    def row(self, spec: str) -> dict:
        out: dict = {}
        while spec := spec.strip():
            if spec[0].isdigit():
                skip, _, spec = spec.partition(" ")
                self.at += int(skip)
                continue
            name, _, spec = spec.partition(":")
            if spec[0] == "*":
                count, depth, i = spec[1 : spec.index("(")], 0, spec.index("(")
                for j in range(i, len(spec)):
                    depth += (spec[j] == "(") - (spec[j] == ")")
                    if not depth:
                        break
                inner, spec = spec[i + 1 : j], spec[j + 1 :]
                out[name] = [self.row(inner) for _ in range(out[count])]
            else:
                code, _, spec = spec.partition(" ")
                out[name] = self.read(code, out)
        return out


def airport_children(b: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(airport's offset, id, offset, size) of each child record of the airports."""
    if is_container(b):
        for start, size in subsections(b, AIRPORTS):
            for kind, at, n in parts(b, start, start + size, wide=True):
                if kind == AIRPORT:
                    for child, offset, k in parts(b, at + 0x44, at + n, wide=True):
                        yield at, child, offset, k


def airport_rows(b: bytes) -> Iterator[dict]:
    """airport (its offset), kind, offset, payload (JSON): the airports, their records, and the parts of runways.

    Unknown records are left out, and so is one that ends before its fields do.
    """
    if not is_container(b):
        return
    for start, size in subsections(b, AIRPORTS):
        for kind, at, n in parts(b, start, start + size, wide=True):
            if kind == AIRPORT and at + 0x44 <= len(b):
                f = Fields(b, at + 12, at + n)
                payload = f.row("at:ll alt:alt tower:latlon tower_alt:alt magvar:f ident:id region:I")
                payload["region"] = base38(payload["region"] & 0x3FF)
                yield {"airport": at, "kind": "airport", "offset": at, "payload": json.dumps(payload)}
    for airport, kind, at, n in airport_children(b):
        if kind in RECORDS:
            name, skip, spec = RECORDS[kind]
            try:
                yield {"airport": airport, "kind": name, "offset": at, "payload": json.dumps(Fields(b, at + skip, at + n).row(spec))}
            except struct.error:
                continue
            for part, inner, k in parts(b, at + RUNWAY_PARTS_AT, at + n, wide=True) if kind == 0xCE else ():
                if part in PARTS:
                    label, spec = PARTS[part]
                    try:
                        yield {"airport": airport, "kind": f"runway_{label}", "offset": inner, "payload": json.dumps({"code": part} | Fields(b, inner + 6, inner + k).row(spec))}
                    except struct.error:
                        continue


def chunks(payload: bytes) -> Iterator[dict]:
    """chunk, chunk_no, glb_no, data of a model payload: its XML chunks and the GLBs of its GLBD chunks."""
    if payload[:4] != b"RIFF":
        return
    i, no = 8, 0
    while i + 8 <= len(payload):
        tag, size = payload[i : i + 4], u32(payload, i + 4)
        if tag == b"GXML":
            yield {"chunk": "GXML", "chunk_no": no, "glb_no": None, "data": payload[i + 8 : i + 8 + size]}
        elif tag == b"GLBD":
            j, k, end = i + 8, 0, min(i + 8 + size, len(payload))
            while j + 8 <= end:
                if payload[j : j + 4] != b"GLB\0":
                    j += 4
                    continue
                n = u32(payload, j + 4)
                if j + 8 + n > len(payload):
                    break
                yield {"chunk": "GLB", "chunk_no": no, "glb_no": k, "data": payload[j + 8 : j + 8 + n]}
                j, k = j + 8 + n, k + 1
        else:
            i += 4
            continue
        no += 1
        i += 4 + size + (-size) % 4


_PRINTABLE = bytes(c if 0x20 <= c <= 0x7E else 0x20 for c in range(256))


def split_glb(glb: bytes) -> tuple[str, bytes] | None:
    """JSON text (bytes that aren't printable ASCII as spaces) and binary buffer; None if it isn't all there."""
    if len(glb) < 0x14 or 0x14 + u32(glb, 0x0C) > len(glb):
        return None
    end = 0x14 + u32(glb, 0x0C)
    text = glb[0x14:end].translate(_PRINTABLE).decode("ascii").strip()
    size = u32(glb, end) if end + 8 <= len(glb) else 0
    return text, glb[end + 8 : end + 8 + size]


# Numpy types and sizes of typed array elements, by their codes.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4", 5131: "<f2"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def accessor(buffer: bytes, offset: int, stride: int, count: int, component: int, kind: str, normalise: bool = False) -> np.ndarray:
    """count rows of a typed array in a buffer, as float32, or as int64 for integers that aren't normalised."""
    dtype, width = np.dtype(COMPONENTS[component]), WIDTHS[kind]
    step = stride or dtype.itemsize * width
    if count <= 0 or offset + step * (count - 1) + dtype.itemsize * width > len(buffer):
        return np.empty((0, width), np.float32)
    raw = np.ndarray((count, width), dtype, buffer, offset, (step, dtype.itemsize))
    if dtype.kind == "f":
        return raw.astype(np.float32)
    return (raw / np.iinfo(dtype).max).astype(np.float32) if normalise else raw.astype(np.int64)


def terrain(b: bytes) -> tuple[tuple[float, float, float], list[tuple[float, float, float]], list[tuple[int, int, int]]] | None:
    """Centre (of the last sphere), vertices relative to it, and triangles of a mesh; None if it isn't one.

    Counts and sizes beyond the sane, and parts that end early, stop the reading; what was read stays.
    """
    if len(b) < 10 or u16(b, 2) != TERRAIN_MAGIC:
        return None
    centre, vertices, triangles, at = (0.0, 0.0, 0.0), [], [], 10
    count = u16(b, 8)
    for _ in range(count if count <= 10_000 else 0):
        if at + 5 > len(b):
            break
        kind, n_props, n_elems = b[at], u16(b, at + 1), u16(b, at + 3)
        at, flags = at + 5, 0
        if n_props > 1000 or n_elems > 100_000:
            break
        for _ in range(n_props):
            if at + 5 > len(b) or at + 5 + u32(b, at + 1) > len(b):
                return centre, vertices, triangles
            if b[at] == 1 and u32(b, at + 1):
                flags = b[at + 5]
            at += 5 + u32(b, at + 1)
        tuple_size = 2 * (flags & 15).bit_count() if flags else 2 if kind == 9 else 4
        for _ in range(n_elems):
            if at + 4 > len(b) or at + 4 + u32(b, at) > len(b):
                return centre, vertices, triangles
            data = b[at + 4 : at + 4 + u32(b, at)]
            at += 4 + len(data)
            if kind == 0 and len(data) >= 28:
                centre = struct.unpack_from("<3d", data)
            elif kind == 1:
                vertices += [tuple(v) for v in np.frombuffer(data[: len(data) // 12 * 12], "<f4").reshape(-1, 3).astype(float).tolist()]
            elif kind in (10, 11, 12) and tuple_size:
                n = len(data) // tuple_size
                v = np.ndarray((n,), "<u2", data, 0, (tuple_size,)).tolist() if n else []
                if kind == 10:
                    triangles += [(v[i], v[i + 2], v[i + 1]) for i in range(0, n - 2, 3)]
                elif kind == 11:
                    triangles += [(v[i + i % 2], v[i + 1 - i % 2], v[i + 2]) for i in range(n - 2)]
                else:
                    triangles += [(v[0], v[i], v[i + 1]) for i in range(1, n - 1)]
    return centre, vertices, triangles
