"""Containers and headers: ISO base media boxes (HEIF, AVIF, JP2), WebP, BPG, SVG, HEVC and AV1 units."""

from __future__ import annotations

import re
import struct

from .entropy import BitReader, BoolDecoder, leb128, ue7
from .model import FormatError, Info, need

#: Boxes that hold boxes, and bytes before the first of them.
HOLDERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0, "meta": 4, "iprp": 0, "ipco": 0, "iref": 4, "jp2h": 0, "res ": 0, "udta": 0, "edts": 0, "grpl": 0, "sinf": 0}


def boxes(data: bytes, at: int = 0, end: int | None = None, parent: int = -1, depth: int = 0, out: list[dict] | None = None) -> list[dict]:
    """Every box: id, parent, depth, type, offset, size, place of its body. Sizes of 32 bits, 64 bits or to the end."""
    out = [] if out is None else out
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or not all(32 <= c < 127 or c == 169 for c in kind):
            break
        name = kind.decode("latin-1")
        me = len(out)
        out.append({"box_id": me, "parent_id": parent, "depth": depth, "type": name, "offset": at, "size": size, "body": body})
        stop = min(end, at + size)
        if name in HOLDERS and depth < 16:
            boxes(data, body + HOLDERS[name], stop, me, depth + 1, out)
        elif name == "iinf" and body + 6 <= stop:
            boxes(data, body + (6 if data[body] == 0 else 8), stop, me, depth + 1, out)
        elif name in ("stsd", "dref") and body + 8 <= stop:
            boxes(data, body + 8, stop, me, depth + 1, out)
        at += size
    return out


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def _text(data: bytes, at: int, end: int) -> tuple[str, int]:
    stop = data.find(b"\0", at, end)
    stop = end if stop < 0 else stop
    return data[at:stop].decode("utf-8", "replace"), stop + 1


def box_fields(data: bytes, box: dict) -> dict[str, str]:
    """The fields of one box that this reader knows, as text."""
    at, end, kind = box["body"], min(len(data), box["offset"] + box["size"]), box["type"]
    f: dict[str, object] = {}
    version = data[at] if at < end else 0
    if kind == "ftyp":
        f = {"brand": data[at : at + 4].decode("latin-1"), "compatible": ",".join(data[k : k + 4].decode("latin-1") for k in range(at + 8, end - 3, 4))}
    elif kind == "hdlr":
        f = {"handler_type": data[at + 8 : at + 12].decode("latin-1"), "name": _text(data, at + 24, end)[0]}
    elif kind == "pitm":
        f = {"item_id": _number(data, at + 4, 4 if version else 2)}
    elif kind == "infe" and version >= 2:
        wide = 4 if version == 3 else 2
        f = {"item_id": _number(data, at + 4, wide), "protection": _number(data, at + 4 + wide, 2), "item_type": data[at + 6 + wide : at + 10 + wide].decode("latin-1"), "name": _text(data, at + 10 + wide, end)[0]}
    elif kind == "infe":
        f = {"item_id": _number(data, at + 4, 2), "protection": _number(data, at + 6, 2), "name": _text(data, at + 8, end)[0]}
    elif kind == "ispe":
        f = {"width": _number(data, at + 4, 4), "height": _number(data, at + 8, 4)}
    elif kind == "pixi":
        f = {"bits": ",".join(str(b) for b in data[at + 5 : at + 5 + data[at + 4]])}
    elif kind == "irot":
        f = {"angle": data[at] & 3}
    elif kind == "auxC":
        f = {"aux_type": _text(data, at + 4, end)[0]}
    elif kind == "clap":
        f = {n: v for n, v in zip(("width_n", "width_d", "height_n", "height_d", "x_n", "x_d", "y_n", "y_d"), struct.unpack_from(">8I", data, at), strict=True)}
    elif kind == "colr":
        if data[at : at + 4] == b"nclx":
            p, t, m, r = struct.unpack_from(">HHHB", data, at + 4)
            f = {"color_type": "nclx", "primaries": p, "transfer": t, "matrix": m, "full_range": r >> 7}
        elif data[at] in (1, 2) and data[at + 3 : at + 4] != b"C":
            f = {"method": data[at], "precedence": data[at + 1], "approx": data[at + 2], "enum_cs": _number(data, at + 3, 4) if data[at] == 1 else 0}
        else:
            f = {"color_type": data[at : at + 4].decode("latin-1")}
    elif kind == "ihdr":
        h, w, n, bpc, c, unk, ipr = struct.unpack_from(">IIHBBBB", data, at)
        f = {"height": h, "width": w, "num_comp": n, "bpc": bpc, "c": c, "unkc": unk, "ipr": ipr}
    elif kind in ("mvhd", "mdhd"):
        n = 8 if version else 4
        f = {"ctime": _number(data, at + 4, n), "mtime": _number(data, at + 4 + n, n), "timescale": _number(data, at + 4 + 2 * n, 4), "duration": _number(data, at + 8 + 2 * n, n)}
    elif kind == "tkhd":
        n = 8 if version else 4
        f = {"track_id": _number(data, at + 4 + 2 * n, 4), "duration": _number(data, at + 12 + 2 * n, n), "width": _number(data, end - 8, 4) / 65536, "height": _number(data, end - 4, 4) / 65536}
    elif kind in ("stts", "ctts", "stsc", "stco", "co64", "stss"):
        n, words, size = _number(data, at + 4, 4), {"stts": 2, "ctts": 2, "stsc": 3}.get(kind, 1), 8 if kind == "co64" else 4
        most = min(n, max(0, (end - at - 8) // (words * size)))
        f = {"entries": ";".join(",".join(str(_number(data, at + 8 + (k * words + j) * size, size)) for j in range(words)) for k in range(most))}
    elif kind == "stsz":
        same, n = struct.unpack_from(">II", data, at + 4)
        f = {"sizes": ",".join(str(same or _number(data, at + 12 + 4 * k, 4)) for k in range(min(n, (end - at - 12) // 4 if not same else n, 1 << 20)))}
    elif kind == "av1C":
        f = {"profile": data[at + 1] >> 5, "level": data[at + 1] & 31, "high_bitdepth": data[at + 2] >> 6 & 1, "monochrome": data[at + 2] >> 4 & 1}
    elif kind == "hvcC":
        f = {"profile": data[at + 1] & 31, "level": data[at + 12], "chroma": data[at + 16] & 3, "luma_bits": (data[at + 17] & 7) + 8, "arrays": data[at + 22]}
    elif kind in ("xml ", "url "):
        f = {"text": data[at + (4 if kind == "url " else 0) : end].decode("utf-8", "replace").rstrip("\0")}
    elif kind == "uuid":
        f = {"uuid": data[at : at + 16].hex()}
    return {k: str(v) for k, v in f.items()}


def item_locations(data: bytes, box: dict) -> list[dict]:
    """Extents of ``iloc``: item, construction method, offset, length."""
    at, out = box["body"], []
    version, sizes = data[at], _number(data, at + 4, 2)
    off, size, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15
    wide = 4 if version == 2 else 2
    n, at = _number(data, at + 6, wide), at + 6 + wide
    for _ in range(n):
        item, at = _number(data, at, wide), at + wide
        method = 0
        if version:
            method, at = _number(data, at, 2) & 15, at + 2
        at += 2
        start, at = _number(data, at, base), at + base
        extents, at = _number(data, at, 2), at + 2
        for k in range(extents):
            need(at <= len(data), "iloc is cut")
            at += index if version else 0
            out.append({"item_id": item, "method": method, "extent": k, "offset": start + _number(data, at, off), "length": _number(data, at + off, size)})
            at += off + size
    return out


def item_properties(data: bytes, box: dict) -> list[dict]:
    """Associations of ``ipma``: item, place of the property in ``ipco`` (from 1), essential."""
    at, out = box["body"], []
    version, wide = data[at], bool(data[at + 3] & 1)
    n, at = _number(data, at + 4, 4), at + 8
    for _ in range(n):
        size = 4 if version else 2
        item, at = _number(data, at, size), at + size
        count, at = data[at], at + 1
        for _ in range(count):
            v, bits = _number(data, at, 2 if wide else 1), 15 if wide else 7
            out.append({"item_id": item, "property": v & ((1 << bits) - 1), "essential": bool(v >> bits)})
            at += 2 if wide else 1
    return out


def item_references(data: bytes, box: dict) -> list[dict]:
    """Edges of ``iref``: type, from, to."""
    wide, out = 4 if data[box["body"]] else 2, []
    at, end = box["body"] + 4, min(len(data), box["offset"] + box["size"])
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8:
            break
        source, n = _number(data, at + 8, wide), _number(data, at + 8 + wide, 2)
        out += [{"type": kind.decode("latin-1"), "from_item": source, "to_item": _number(data, at + 10 + wide + k * wide, wide)} for k in range(n)]
        at += size
    return out


def _media_info(data: bytes, name: str) -> Info:
    found = boxes(data)
    need(bool(found) and found[0]["type"] == "ftyp", f"not {name}")
    info = Info(name, frames=0, extra=box_fields(data, found[0]))
    for b in found:
        f = box_fields(data, b)
        if b["type"] == "ispe" and int(f["width"]) * int(f["height"]) > info.width * info.height:
            info.width, info.height = int(f["width"]), int(f["height"])
        elif b["type"] == "infe":
            info.frames += f.get("item_type") in ("hvc1", "av01")
        elif b["type"] == "pixi" and not info.depth:
            info.depth = sum(map(int, f["bits"].split(","))) if f["bits"] else 0
        elif b["type"] in ("pitm", "irot", "hvcC", "av1C", "auxC"):
            info.extra |= {f"{b['type']}.{k}": v for k, v in f.items()}
    return info


def heif_info(data: bytes) -> Info:
    return _media_info(data, "heif")


def avif_info(data: bytes) -> Info:
    return _media_info(data, "avif")


def codestream_markers(data: bytes, at: int = 0) -> list[dict]:
    """JPEG 2000 code-stream markers up to the first tile's data."""
    need(data[at : at + 2] == b"\xff\x4f", "not a JPEG 2000 code stream")
    out, at = [{"code": 0xFF4F, "offset": at, "data": b""}], at + 2
    while at + 4 <= len(data):
        code, n = struct.unpack_from(">HH", data, at)
        if code == 0xFF93:
            out.append({"code": code, "offset": at, "data": b""})
            break
        need(code >= 0xFF00 and n >= 2, "JPEG 2000 marker")
        out.append({"code": code, "offset": at + 4, "data": data[at + 4 : at + 2 + n]})
        at += 2 + n
    return out


def jp2_info(data: bytes) -> Info:
    raw = data[:2] == b"\xff\x4f"
    need(raw or data[4:8] == b"jP  ", "not JP2")
    info = Info("jp2")
    stream = 0 if raw else None
    for b in [] if raw else boxes(data):
        if b["type"] in ("ihdr", "colr"):
            info.extra |= {f"{b['type']}.{k}": v for k, v in box_fields(data, b).items()}
        elif b["type"] == "jp2c":
            stream = b["body"]
    if stream is not None:
        for m in codestream_markers(data, stream):
            if m["code"] == 0xFF51:
                x1, y1, x0, y0 = struct.unpack_from(">4I", m["data"], 2)
                n = struct.unpack_from(">H", m["data"], 34)[0]
                info.width, info.height = x1 - x0, y1 - y0
                info.depth = sum((m["data"][36 + 3 * k] & 127) + 1 for k in range(n))
            elif m["code"] == 0xFF52 and len(m["data"]) >= 6:
                info.extra |= {"progression": str(m["data"][1]), "layers": str(_number(m["data"], 2, 2)), "levels": str(m["data"][5])}
            elif m["code"] == 0xFF64:
                info.extra["comment"] = m["data"][2:].decode("latin-1")
    elif "ihdr.width" in info.extra:
        info.width, info.height = int(info.extra["ihdr.width"]), int(info.extra["ihdr.height"])
    return info


def webp_chunks(data: bytes) -> list[dict]:
    need(data[:4] == b"RIFF" and data[8:12] == b"WEBP", "not WebP")
    out, at = [], 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        out.append({"type": data[at : at + 4].decode("latin-1"), "offset": at + 8, "data": data[at + 8 : at + 8 + n]})
        at += 8 + n + n % 2
    return out


def webp_info(data: bytes) -> Info:
    info = Info("webp", depth=24, frames=0)
    for c in webp_chunks(data):
        d, kind = c["data"], c["type"]
        if kind == "VP8X" and len(d) >= 10:
            info.width, info.height = int.from_bytes(d[4:7], "little") + 1, int.from_bytes(d[7:10], "little") + 1
            info.extra["flags"] = str(d[0])
        elif kind == "VP8 " and len(d) >= 10 and d[3:6] == b"\x9d\x01\x2a":
            tag = int.from_bytes(d[:3], "little")
            w, h = struct.unpack_from("<HH", d, 6)
            info.frames += 1
            info.width, info.height = info.width or w & 0x3FFF, info.height or h & 0x3FFF
            r = BoolDecoder(d[10 : 10 + (tag >> 5)])
            info.extra |= {"codec": "vp8", "key_frame": str(not tag & 1).lower(), "version": str(tag >> 1 & 7), "first_partition": str(tag >> 5), "color_space": str(r.bit()), "clamping": str(r.bit())}
            if r.bit():
                update_map, update_data = r.bit(), r.bit()
                if update_data:
                    r.bit()
                    info.extra["segment_quantisers"] = ",".join(str(r.signed(7) if r.bit() else 0) for _ in range(4))
                    info.extra["segment_strengths"] = ",".join(str(r.signed(6) if r.bit() else 0) for _ in range(4))
                if update_map:
                    info.extra["segment_probs"] = ",".join(str(r.literal(8) if r.bit() else 255) for _ in range(3))
            info.extra |= {"filter_type": str(r.bit()), "filter_level": str(r.literal(6)), "sharpness": str(r.literal(3))}
            if r.bit() and r.bit():
                for _ in range(8):
                    if r.bit():
                        r.signed(6)
            info.extra |= {"partitions": str(1 << r.literal(2)), "quantiser": str(r.literal(7))}
        elif kind == "VP8L" and len(d) >= 5 and d[0] == 0x2F:
            v = struct.unpack_from("<I", d, 1)[0]
            info.frames += 1
            info.width, info.height = info.width or (v & 0x3FFF) + 1, info.height or (v >> 14 & 0x3FFF) + 1
            info.extra |= {"codec": "vp8l", "alpha": str(v >> 28 & 1)}
            r, kinds = BitReader(d[5:], msb=False), []
            while r.left > 3 and r.bit() and len(kinds) < 1:
                kinds.append(("predictor", "color", "subtract_green", "color_indexing")[r.bits(2)])
            info.extra["first_transform"] = kinds[0] if kinds else ""
        elif kind == "ALPH" and d:
            info.depth = 32
            info.extra |= {"alpha_compression": str(d[0] & 3), "alpha_filter": str(d[0] >> 2 & 3)}
    return info


def bpg_info(data: bytes) -> Info:
    need(data[:4] == b"BPG\xfb" and len(data) >= 8, "not BPG")
    w, at = ue7(data, 6)
    h, at = ue7(data, at)
    size, _ = ue7(data, at)
    return Info("bpg", w, h, (data[4] & 15) + 8, extra={"pixel_format": str(data[4] >> 5), "alpha1": str(data[4] >> 4 & 1), "color_space": str(data[5] >> 4), "extension": str(data[5] >> 3 & 1), "picture_bytes": str(size)})


_SVG = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![^>]*>|<(/?)([\w:.-]+)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.S)
_SVG_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def svg_nodes(data: bytes) -> list[dict]:
    """Elements in order: id, parent, tag, attributes."""
    out, open_ = [], [-1]
    for m in _SVG.finditer(data.decode("utf-8", "replace")):
        if not m[2]:
            continue
        if m[1]:
            if len(open_) > 1:
                open_.pop()
            continue
        out.append({"node_id": len(out), "parent_id": open_[-1], "tag": m[2], "attributes": {a[0]: a[1] or a[2] for a in _SVG_ATTRIBUTE.findall(m[3])}})
        if not m[4]:
            open_.append(len(out) - 1)
    return out


def svg_info(data: bytes) -> Info:
    nodes = svg_nodes(data)
    root = next((n for n in nodes if n["tag"].split(":")[-1] == "svg"), None)
    need(root is not None, "not SVG")

    def number(name: str) -> int:
        m = re.match(r"\d+", root["attributes"].get(name, ""))
        return int(m[0]) if m else 0

    return Info("svg", number("width"), number("height"), extra={"nodes": str(len(nodes)), "view_box": root["attributes"].get("viewBox", "")})


def nal_units(data: bytes) -> list[dict]:
    """HEVC units of a byte stream: type, layer, temporal id, payload without emulation bytes."""
    out, places = [], [m.start() for m in re.finditer(b"\0\0\1", data)]
    for k, at in enumerate(places):
        end = places[k + 1] if k + 1 < len(places) else len(data)
        unit = data[at + 3 : end].rstrip(b"\0") if k + 1 < len(places) else data[at + 3 :]
        if len(unit) < 2:
            continue
        head = struct.unpack_from(">H", unit)[0]
        out.append({"type": head >> 9 & 63, "layer": head >> 3 & 63, "temporal_id": (head & 7) - 1, "offset": at + 3, "data": unit[2:].replace(b"\0\0\3", b"\0\0")})
    return out


def obu_units(data: bytes) -> list[dict]:
    """AV1 units: type, temporal and spatial layer, payload."""
    out, at = [], 0
    while at < len(data):
        head, at = data[at], at + 1
        temporal = spatial = 0
        if head & 4:
            need(at < len(data), "cut AV1 unit")
            temporal, spatial, at = data[at] >> 5, data[at] >> 3 & 3, at + 1
        size = len(data) - at
        if head & 2:
            size, at = leb128(data, at)
        out.append({"type": head >> 3 & 15, "temporal": temporal, "spatial": spatial, "offset": at, "data": data[at : at + size]})
        at += size
    return out


__all__ = ["FormatError", "avif_info", "boxes", "box_fields", "bpg_info", "codestream_markers", "heif_info", "item_locations", "item_properties", "item_references", "jp2_info", "nal_units", "obu_units", "svg_info", "svg_nodes", "webp_chunks", "webp_info"]
