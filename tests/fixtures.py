"""Writers of small binary fixtures, from the layouts alone."""

import struct
import uuid


def placement(guid, lon_raw, lat_raw, alt=1000, flags=0, heading=0, scale=1.0):
    head = struct.pack("<HHIIihhhhH", 0x0B, 64, lon_raw, lat_raw, alt, flags, 0, 0, heading, 3)
    return head + bytes(44 - len(head)) + uuid.UUID(guid).bytes_le + struct.pack("<f", scale)


def sim_object(title, path, lon_raw, lat_raw):
    t, p = title.encode() + b"\0", path.encode() + b"\0"
    head = struct.pack("<HHIIihhhhH", 0x19, 52 + len(t) + len(p), lon_raw, lat_raw, 0, 0, 0, 0, 0, 1)
    return head + bytes(44 - len(head)) + struct.pack("<fHH", 2.0, len(t), len(p)) + t + p


def container(sections):
    """sections: (record type, data) pairs; each record has one subsection."""
    head = bytearray(0x38)
    head[0:4], head[0x10:0x14] = bytes.fromhex("01029219"), bytes.fromhex("03180508")
    struct.pack_into("<I", head, 0x14, len(sections))
    subs = 0x38 + 0x14 * len(sections)
    at, records, table, data = subs + 16 * len(sections), b"", b"", b""
    for i, (kind, body) in enumerate(sections):
        records += struct.pack("<IIIII", kind, 0, 1, subs + 16 * i, 16)
        table += struct.pack("<IIII", 0, 1, at + len(data), len(body))
        data += body
    return bytes(head) + records + table + data


def models(payloads):
    """Model directory and payloads; (guid, bytes) pairs."""
    at, entries, body = 24 * len(payloads), b"", b""
    for guid, payload in payloads:
        entries += uuid.UUID(guid).bytes_le + struct.pack("<II", at + len(body), len(payload))
        body += payload
    return entries + body


def glb(json_text, buffer=b"\1\2\3\4"):
    j = json_text.encode()
    j += b" " * (-len(j) % 4)
    return b"glTF" + struct.pack("<II", 2, 28 + len(j) + len(buffer)) + struct.pack("<I", len(j)) + b"JSON" + j + struct.pack("<I", len(buffer)) + b"BIN\0" + buffer


def riff(xml, glbs):
    x = xml.encode()
    x += b" " * (-len(x) % 4)
    blocks = b"".join(b"GLB\0" + struct.pack("<I", len(g)) + g for g in glbs)
    return b"RIFF" + struct.pack("<I", 0) + b"GXML" + struct.pack("<I", len(x)) + x + b"GLBD" + struct.pack("<I", len(blocks)) + blocks


def child(kind, body):
    return struct.pack("<HI", kind, 6 + len(body)) + body


def airport(icao, children):
    body = b"".join(children)
    head = struct.pack("<HI", 0x56, 0x44 + len(body)) + bytes(6) + struct.pack("<IIi", 402653184, 268435456, 5000) + struct.pack("<IIi", 268435456, 402653184, 6000) + struct.pack("<f", 1.5) + struct.pack("<II", icao, 0)
    return head + bytes(0x44 - len(head)) + body


def terrain(vertices, objects, centre=(6378137.0, 0.0, 0.0), magic=0x5347):
    """objects: (type, index lists)."""
    def obj(kind, elements):
        return struct.pack("<BHH", kind, 0, len(elements)) + b"".join(struct.pack("<I", len(e)) + e for e in elements)

    out = [obj(0, [struct.pack("<3df", *centre, 10.0)]), obj(1, [b"".join(struct.pack("<3f", *v) for v in vertices)])]
    out += [obj(kind, [b"".join(struct.pack("<HH", v, 0) for v in indices)]) for kind, indices in objects]
    return struct.pack("<HHIH", 6, magic, 0, len(out)) + b"".join(out)
