"""Raster formats: BMP, GIF, PNG, PNM, TGA, TIFF, ICO, EXR and PSD."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from . import entropy
from .model import FormatError, Frame, Info, need, sized


def _rows(data: bytes, stride: int, height: int, what: str) -> np.ndarray:
    need(len(data) >= stride * height, f"{what}: rows are cut")
    return np.frombuffer(data, dtype=np.uint8, count=stride * height).reshape(height, stride)


def unpack_bits(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits of each line, most significant first."""
    if bits == 8:
        return rows[:, :width]
    per = 8 // bits
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return (rows[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :width] if per else rows


# BMP


def _bmp_header(data: bytes, at: int) -> dict:
    size = struct.unpack_from("<I", data, at)[0]
    if size == 12:
        w, h, _, bpp = struct.unpack_from("<HHHH", data, at + 4)
        return {"size": 12, "width": w, "height": h, "bpp": bpp, "compression": 0, "colours": 0, "entry": 3}
    need(size >= 40, "BMP header size")
    w, h, _, bpp, comp, _, _, _, used, _ = struct.unpack_from("<iiHHIIiiII", data, at + 4)
    return {"size": size, "width": w, "height": h, "bpp": bpp, "compression": comp, "colours": used, "entry": 4}


def bmp_info(data: bytes) -> Info:
    need(data[:2] == b"BM" and len(data) >= 26, "not BMP")
    h = _bmp_header(data, 14)
    return Info("bmp", abs(h["width"]), abs(h["height"]), h["bpp"], extra={"header_size": str(h["size"]), "compression": str(h["compression"]), "top_down": str(h["height"] < 0).lower()})


def _dib(data: bytes, at: int, pixels_at: int | None, half: bool = False) -> np.ndarray:
    """A device-independent bitmap's pixels as BGR, BGRA or grey."""
    h = _bmp_header(data, at)
    width, height = sized(abs(h["width"]), abs(h["height"]) // (2 if half else 1))
    bpp, comp, table = h["bpp"], h["compression"], at + h["size"]
    masks = None
    if comp in (3, 6) and bpp in (16, 32):
        n = 4 if comp == 6 or h["size"] >= 56 else 3
        masks = list(struct.unpack_from(f"<{n}I", data, at + 40))
        if h["size"] == 40:
            table += 4 * n
    colours = 0
    if bpp <= 8:
        colours = h["colours"] or 1 << bpp
        entries = np.frombuffer(data[table : table + colours * h["entry"]], dtype=np.uint8).reshape(-1, h["entry"])[:, :3]
        palette = np.zeros((256, 3), np.uint8)
        palette[: len(entries)] = entries[:256]
    body = data[(pixels_at if pixels_at is not None else table + colours * h["entry"]) :]
    if comp in (1, 2):
        index = np.frombuffer(entropy.bmp_rle(body, width, height, comp == 2), dtype=np.uint8).reshape(height, width)
        out = palette[index]
    else:
        rows = _rows(body, (width * bpp + 31) // 32 * 4, height, "BMP")
        if bpp <= 8:
            out = palette[unpack_bits(rows, width, bpp)]
        elif bpp == 24:
            out = rows[:, : width * 3].reshape(height, width, 3)
        elif bpp == 16:
            v = rows[:, : width * 2].copy().view("<u2").astype(np.uint32)
            out = np.stack([_masked(v, m) for m in reversed((masks or [0x7C00, 0x3E0, 0x1F])[:3])], axis=2)
        else:
            need(bpp == 32, f"BMP of {bpp} bits")
            out = rows.reshape(height, width, 4)
            if masks:
                v = rows.copy().view("<u4").reshape(height, width)
                planes = [_masked(v, m) for m in reversed(masks[:3])] + ([_masked(v, masks[3])] if len(masks) > 3 and masks[3] else [])
                out = np.stack(planes, axis=2)
    return out if h["height"] < 0 else out[::-1]


def _masked(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return (((v & mask) >> shift).astype(np.uint64) * 255 // top).astype(np.uint8)


def bmp_decode(data: bytes) -> list[Frame]:
    need(data[:2] == b"BM", "not BMP")
    return [Frame(np.ascontiguousarray(_dib(data, 14, struct.unpack_from("<I", data, 10)[0])))]


def bmp_encode(pixels: np.ndarray, top_down: bool = False) -> bytes:
    """32 bits a pixel, bottom row first unless ``top_down``."""
    height, width = pixels.shape[:2]
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        pixels = np.repeat(pixels.reshape(height, width, 1), 3, axis=2)
    if pixels.shape[2] == 3:
        pixels = np.dstack([pixels, np.full((height, width), 255, np.uint8)])
    body = (pixels if top_down else pixels[::-1]).astype(np.uint8).tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, 32, 0, len(body), 2835, 2835, 0, 0) + body


# PNG

_ADAM7 = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
PNG_SIGN = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[dict]:
    """Every chunk: type, offset of its data, data, whether its checksum holds."""
    need(data[:8] == PNG_SIGN, "not PNG")
    out, at = [], 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            out.append({"type": kind.decode("latin-1"), "offset": at + 8, "data": body, "crc_ok": False})
            break
        crc = struct.unpack_from(">I", data, at + 8 + n)[0]
        out.append({"type": kind.decode("latin-1"), "offset": at + 8, "data": body, "crc_ok": crc == zlib.crc32(kind + body)})
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def _png_head(chunks: list[dict]) -> tuple[int, ...]:
    need(bool(chunks) and chunks[0]["type"] == "IHDR" and len(chunks[0]["data"]) == 13, "PNG without header")
    return struct.unpack(">IIBBBBB", chunks[0]["data"])


def _latin(b: bytes) -> str:
    return b.decode("latin-1")


def png_info(data: bytes) -> Info:
    chunks = png_chunks(data)
    w, h, depth, colour, _, _, interlace = _png_head(chunks)
    extra = {"colour_type": str(colour), "interlace": str(interlace)}
    for c in chunks:
        d, kind = c["data"], c["type"]
        if kind == "tEXt" and b"\0" in d:
            key, value = d.split(b"\0", 1)
            extra[f"text:{_latin(key)}"] = _latin(value)
        elif kind == "zTXt" and b"\0" in d:
            key, value = d.split(b"\0", 1)
            try:
                extra[f"text:{_latin(key)}"] = _latin(zlib.decompress(value[1:]))
            except zlib.error:
                extra[f"text:{_latin(key)}"] = ""
        elif kind == "iTXt" and d.count(b"\0") >= 2:
            key, rest = d.split(b"\0", 1)
            packed, body = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[-1]
            try:
                extra[f"text:{_latin(key)}"] = (zlib.decompress(body) if packed else body).decode("utf-8", "replace")
            except zlib.error:
                extra[f"text:{_latin(key)}"] = ""
        elif kind == "tIME" and len(d) == 7:
            extra["time"] = "%04d-%02d-%02d %02d:%02d:%02d" % struct.unpack(">HBBBBB", d)
        elif kind == "gAMA" and len(d) == 4:
            extra["gamma"] = str(struct.unpack(">I", d)[0])
        elif kind == "cHRM" and len(d) == 32:
            extra["chromaticity"] = ",".join(map(str, struct.unpack(">8I", d)))
        elif kind == "iCCP":
            extra["profile"] = _latin(d.split(b"\0", 1)[0])
        elif kind in ("bKGD", "hIST", "PLTE"):
            extra[kind] = d.hex()
    return Info("png", w, h, depth, crc_ok=all(c["crc_ok"] for c in chunks), extra=extra)


def unfilter(data: bytes, at: int, height: int, line: int, step: int) -> tuple[np.ndarray, int]:
    """Lines after undoing each one's filter, and the place after them."""
    out = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.int64)
    for y in range(height):
        need(at + 1 + line <= len(data), "PNG: lines are cut")
        kind, raw = data[at], np.frombuffer(data, np.uint8, line, at + 1).astype(np.int64)
        at += 1 + line
        if kind == 1:
            pad = np.zeros(-(-line // step) * step, np.int64)
            pad[:line] = raw
            raw = np.cumsum(pad.reshape(-1, step), axis=0).ravel()[:line]
        elif kind == 2:
            raw = raw + above
        elif kind in (3, 4):
            now, up = raw.tolist(), above.tolist()
            for i in range(line):
                a, b = (now[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    now[i] = now[i] + (a + b) // 2 & 255
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[i] = now[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
            raw = np.array(now, np.int64)
        else:
            need(kind == 0, "PNG filter")
        above = raw & 255
        out[y] = above
    return out, at


def png_decode(data: bytes) -> list[Frame]:
    chunks = png_chunks(data)
    w, h, depth, colour, _, _, interlace = _png_head(chunks)
    w, h = sized(w, h)
    need(colour in (0, 2, 3, 4, 6) and depth in (1, 2, 4, 8, 16), "PNG colour type")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    z = zlib.decompressobj()
    raw = z.decompress(b"".join(c["data"] for c in chunks if c["type"] == "IDAT"))
    samples = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for y0, x0, dy, dx in _ADAM7 if interlace else [(0, 0, 1, 1)]:
        ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
        if ph <= 0 or pw <= 0:
            continue
        rows, at = unfilter(raw, at, ph, (pw * channels * depth + 7) // 8, max(1, channels * depth // 8))
        if depth == 16:
            part = rows.view(">u2").reshape(ph, pw, channels)
        else:
            part = unpack_bits(rows, pw * channels, depth).reshape(ph, pw, channels)
        samples[y0::dy, x0::dx] = part
    if colour == 3:
        palette = np.zeros((256, 3), np.uint8)
        for c in chunks:
            if c["type"] == "PLTE":
                entries = np.frombuffer(c["data"][: len(c["data"]) // 3 * 3], np.uint8).reshape(-1, 3)
                palette[: len(entries)] = entries
        rgb = palette[samples[:, :, 0]]
        clear = next((np.frombuffer(c["data"], np.uint8) for c in chunks if c["type"] == "tRNS"), None)
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = clear[:256]
            return [Frame(np.dstack([rgb[:, :, ::-1], alpha[samples[:, :, 0]]]))]
        return [Frame(np.ascontiguousarray(rgb[:, :, ::-1]))]
    if depth == 16:
        samples = (samples >> 8).astype(np.uint8)
    elif depth < 8:
        samples = samples * (255 // ((1 << depth) - 1))
    if colour == 0:
        return [Frame(samples)]
    if colour == 4:
        return [Frame(np.dstack([np.repeat(samples[:, :, :1], 3, axis=2), samples[:, :, 1]]))]
    return [Frame(np.ascontiguousarray(np.dstack([samples[:, :, 2], samples[:, :, 1], samples[:, :, 0], *([samples[:, :, 3]] if colour == 6 else [])])))]


# GIF


def _subblocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while at < len(data) and data[at]:
        out += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    return bytes(out), at + 1


def _gif(data: bytes, pixels: bool) -> tuple[Info, list[Frame]]:
    need(data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 13, "not GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, table = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    info, frames, delay, count = Info("gif", w, h, (flags >> 4 & 7) + 1, extra={"version": _latin(data[3:6])}), [], 0, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21 and at + 1 < len(data):
            kind = data[at + 1]
            body, at = _subblocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                delay = struct.unpack_from("<H", body, 1)[0]
            elif kind == 0xFE:
                info.extra["comment"] = _latin(body)
            elif kind == 0xFF:
                info.extra["application"] = _latin(body[:11])
            continue
        need(data[at] == 0x2C and at + 10 < len(data), "GIF block")
        left, top, fw, fh, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = table
        if f & 128:
            n = 2 << (f & 7)
            own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        size = data[at]
        body, at = _subblocks(data, at + 1)
        count += 1
        if pixels:
            sized(fw, fh)
            need(2 <= size <= 8 and own is not None, "GIF code size or colour table")
            index = entropy.lzw(body, size).ljust(fw * fh, b"\0")
            rows = np.frombuffer(index, np.uint8, fw * fh).reshape(fh, fw)
            if f & 64:
                order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
                back = np.empty_like(rows)
                back[order] = rows
                rows = back
            full = np.zeros((256, 3), np.uint8)
            full[: len(own)] = own
            frames.append(Frame(np.ascontiguousarray(full[rows][:, :, ::-1]), left, top, delay))
        delay = 0
    info.frames = count
    return info, frames


def gif_info(data: bytes) -> Info:
    return _gif(data, False)[0]


def gif_decode(data: bytes) -> list[Frame]:
    return _gif(data, True)[1]


# PNM

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _pnm_head(data: bytes) -> tuple[int, int, int, int, int, int]:
    """Kind, width, height, channels, largest value, place of the samples."""
    need(len(data) > 2 and data[:1] == b"P" and data[1:2] in b"1234567", "not PNM")
    kind, at = data[1] - 48, 2
    if kind == 7:
        end = data.find(b"ENDHDR\n")
        need(end > 0, "PAM header")
        fields = dict(line.split(None, 1) for line in re.sub(rb"#[^\n]*", b"", data[3:end]).split(b"\n") if len(line.split(None, 1)) == 2)
        return kind, int(fields[b"WIDTH"]), int(fields[b"HEIGHT"]), int(fields[b"DEPTH"]), int(fields[b"MAXVAL"]), end + 7
    values = []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        need(m is not None and m[1].isdigit(), "PNM header")
        values.append(int(m[1]))
        at = m.end()
    return kind, values[0], values[1], 3 if kind in (3, 6) else 1, values[2] if len(values) > 2 else 1, at + 1


def pnm_info(data: bytes) -> Info:
    kind, w, h, channels, most, _ = _pnm_head(data)
    return Info("pnm", w, h, channels * (1 if most == 1 else 8 if most < 256 else 16), extra={"kind": f"P{kind}", "maxval": str(most)})


def pnm_decode(data: bytes) -> list[Frame]:
    kind, w, h, channels, most, at = _pnm_head(data)
    w, h = sized(w, h)
    need(0 < most < 65536, "PNM largest value")
    n = w * h * channels
    if kind in (1, 2, 3):
        text = re.sub(rb"#[^\n]*", b"", data[at - 1 :])
        parts = re.findall(rb"[01]", text) if kind == 1 else text.split()
        need(len(parts) >= n, "PNM: samples are cut")
        v = np.array(parts[:n]).astype(np.int64).reshape(h, w, channels)
    elif kind == 4:
        v = unpack_bits(_rows(data[at:], (w + 7) // 8, h, "PNM"), w, 1).astype(np.int64).reshape(h, w, 1)
    else:
        wide = most > 255
        need(len(data) - at >= n * (2 if wide else 1), "PNM: samples are cut")
        v = np.frombuffer(data, ">u2" if wide else np.uint8, n, at).astype(np.int64).reshape(h, w, channels)
    v = (1 - v) * 255 if kind in (1, 4) else v * 255 // most
    v = np.clip(v, 0, 255).astype(np.uint8)
    order = {1: [0], 2: [0, 0, 0, 1], 3: [2, 1, 0], 4: [2, 1, 0, 3]}.get(channels)
    need(order is not None, "PAM depth")
    return [Frame(np.ascontiguousarray(v[:, :, order]))]


# TGA


def _tga_head(data: bytes) -> tuple[int, ...]:
    need(len(data) >= 18, "not TGA")
    head = struct.unpack_from("<BBBHHBHHHHBB", data)
    need(head[1] in (0, 1) and head[2] in (1, 2, 3, 9, 10, 11) and head[10] in (8, 15, 16, 24, 32), "not TGA")
    return head


def tga_info(data: bytes) -> Info:
    head = _tga_head(data)
    return Info("tga", head[8], head[9], head[10], extra={"image_type": str(head[2]), "footer": str(data[-18:-2] == b"TRUEVISION-XFILE").lower()})


def _tga_colours(v: np.ndarray, bits: int) -> np.ndarray:
    """Pixels of 16, 24 or 32 bits as BGR(A)."""
    if bits in (15, 16):
        p = v.reshape(-1, 2).copy().view("<u2")[:, 0].astype(np.int64)
        return np.stack([(p >> s & 31) * 255 // 31 for s in (0, 5, 10)], axis=1).astype(np.uint8)
    return v.reshape(-1, bits // 8)


def tga_decode(data: bytes) -> list[Frame]:
    ident, _, kind, first, entries, entry, _, _, w, h, bits, flags = _tga_head(data)
    w, h = sized(w, h)
    at = 18 + ident
    palette = None
    if entries:
        size = entries * ((entry + 7) // 8)
        palette = _tga_colours(np.frombuffer(data, np.uint8, size, at), entry)
        at += size
    pixel = (bits + 7) // 8
    body = entropy.tga_rle(data[at:], pixel, w * h) if kind > 8 else data[at : at + w * h * pixel]
    need(len(body) >= w * h * pixel, "TGA: pixels are cut")
    v = np.frombuffer(body, np.uint8, w * h * pixel)
    if kind % 8 == 1:
        need(palette is not None and pixel == 1, "TGA colour map")
        out = palette[np.clip(v.astype(np.int64) - first, 0, len(palette) - 1)]
    elif kind % 8 == 3:
        out = v.reshape(-1, pixel)[:, :1]
    else:
        need(bits > 8, "TGA depth")
        out = _tga_colours(v, bits)
    out = out.reshape(h, w, -1)
    if not flags & 32:
        out = out[::-1]
    return [Frame(np.ascontiguousarray(out[:, ::-1] if flags & 16 else out))]


# TIFF

_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def tiff_directories(data: bytes) -> list[dict[int, list[int]]]:
    """Every directory's tags with their integer values (rationals as numerator, denominator)."""
    need(data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8, "not TIFF")
    e, out, seen = "<" if data[:1] == b"I" else ">", [], set()
    at = struct.unpack_from(e + "I", data, 4)[0]
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        n = struct.unpack_from(e + "H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(n):
            if at + 2 + 12 * k + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            size = _TIFF_SIZE.get(kind, 1) * count
            place = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(e + "I", data, at + 2 + 12 * k + 8)[0]
            if place + size > len(data):
                continue
            code = {1: "B", 2: "B", 3: "H", 4: "I", 5: "I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "i", 11: "I", 12: "Q"}.get(kind, "B")
            tags[tag] = list(struct.unpack_from(f"{e}{count * (2 if kind in (5, 10) else 1)}{code}", data, place))
        out.append(tags)
        end = at + 2 + 12 * n
        at = struct.unpack_from(e + "I", data, end)[0] if end + 4 <= len(data) else 0
    return out


def tiff_info(data: bytes) -> Info:
    dirs = tiff_directories(data)
    need(bool(dirs), "TIFF without directory")
    t = dirs[0]
    return Info("tiff", t.get(256, [0])[0], t.get(257, [0])[0], sum(t.get(258, [1])), len(dirs), extra={"compression": str(t.get(259, [1])[0]), "photometric": str(t.get(262, [0])[0]), "predictor": str(t.get(317, [1])[0])})


def tiff_decode(data: bytes) -> list[Frame]:
    e, frames = "<" if data[:1] == b"I" else ">", []
    for t in tiff_directories(data):
        w, h = sized(t.get(256, [0])[0], t.get(257, [0])[0])
        bits, channels, photo = t.get(258, [1])[0], t.get(277, [1])[0], t.get(262, [0])[0]
        per, comp = t.get(278, [h])[0] or h, t.get(259, [1])[0]
        need(bits in (1, 4, 8, 16) and t.get(284, [1])[0] == 1, "TIFF samples or planes")
        line, rows = (w * channels * bits + 7) // 8, []
        for k, (at, n) in enumerate(zip(t.get(273, []), t.get(279, []), strict=False)):
            want = line * min(per, h - k * per)
            raw = data[at : at + n]
            if comp == 5:
                raw = entropy.lzw(raw, 8, msb=True, early=1)
            elif comp == 32773:
                raw = entropy.packbits(raw, want)
            elif comp in (8, 32946):
                raw = zlib.decompress(raw)
            else:
                need(comp == 1, f"TIFF compression {comp}")
            rows.append(raw[:want].ljust(want, b"\0"))
        v = _rows(b"".join(rows), line, h, "TIFF")
        v = v.copy().view(e + "u2").astype(np.uint16).reshape(h, w, channels) if bits == 16 else unpack_bits(v, w * channels, bits).reshape(h, w, channels)
        if t.get(317, [1])[0] == 2:
            v = np.cumsum(v, axis=1, dtype=np.int64).astype(v.dtype)
        if photo == 3 and 320 in t:
            palette = np.array(t[320]).reshape(3, -1).T >> 8
            v = palette[v[:, :, 0]].astype(np.uint8)
            channels = 3
        else:
            v = (v >> 8).astype(np.uint8) if bits == 16 else (v * (255 // ((1 << bits) - 1))).astype(np.uint8)
            if photo == 0:
                v = 255 - v
        order = [2, 1, 0, 3][: min(channels, 4)] if channels >= 3 else [0]
        frames.append(Frame(np.ascontiguousarray(v[:, :, order])))
    return frames


# ICO and CUR


def ico_entries(data: bytes) -> list[dict]:
    need(len(data) >= 6 and data[:2] == b"\0\0" and data[2:4] in (b"\1\0", b"\2\0"), "not ICO")
    n, out = struct.unpack_from("<H", data, 4)[0], []
    need(0 < n and 6 + 16 * n <= len(data), "ICO directory")
    for k in range(n):
        w, h, _, _, planes, bpp, size, at = struct.unpack_from("<BBBBHHII", data, 6 + 16 * k)
        png = data[at : at + 8] == PNG_SIGN
        if png:
            depth = 32
        else:
            depth = _bmp_header(data, at)["bpp"] if at + 40 <= len(data) else bpp
        out.append({"width": w or 256, "height": h or 256, "planes": planes, "depth": depth, "size": size, "offset": at, "png": png})
    return out


def best_entry(entries: list[dict]) -> int:
    """The deepest, of these the widest, of these the first."""
    return max(range(len(entries)), key=lambda i: (entries[i]["depth"], entries[i]["width"], -i))


def ico_info(data: bytes) -> Info:
    entries = ico_entries(data)
    best = entries[best_entry(entries)]
    return Info("ico", best["width"], best["height"], best["depth"], len(entries), extra={"kind": "cursor" if data[2] == 2 else "icon"})


def ico_decode(data: bytes) -> list[Frame]:
    """Every entry, its mask as alpha."""
    frames = []
    for x in ico_entries(data):
        if x["png"]:
            frames += png_decode(data[x["offset"] : x["offset"] + x["size"]])
            continue
        body = _dib(data, x["offset"], None, half=True)
        height, width = body.shape[:2]
        if body.shape[2] == 3:
            h = _bmp_header(data, x["offset"])
            colours = (h["colours"] or 1 << h["bpp"]) if h["bpp"] <= 8 else 0
            at = x["offset"] + h["size"] + colours * 4 + (width * h["bpp"] + 31) // 32 * 4 * height
            mask = np.zeros((height, width), np.uint8)
            stride = (width + 31) // 32 * 4
            if at + stride * height <= len(data):
                mask = unpack_bits(_rows(data[at:], stride, height, "ICO"), width, 1)[::-1]
            body = np.dstack([body, (1 - mask) * 255])
        frames.append(Frame(np.ascontiguousarray(body.astype(np.uint8))))
    return frames


# EXR


def exr_attributes(data: bytes) -> tuple[dict[str, tuple[str, bytes]], int]:
    need(data[:4] == b"\x76\x2f\x31\x01", "not EXR")
    at, out = 8, {}
    while at < len(data) and data[at]:
        end = data.index(b"\0", at)
        kind_end = data.index(b"\0", end + 1)
        size = struct.unpack_from("<I", data, kind_end + 1)[0]
        out[_latin(data[at:end])] = (_latin(data[end + 1 : kind_end]), data[kind_end + 5 : kind_end + 5 + size])
        at = kind_end + 5 + size
    return out, at + 1


def exr_channels(raw: bytes) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(raw) and raw[at]:
        end = raw.index(b"\0", at)
        out.append((_latin(raw[at:end]), struct.unpack_from("<I", raw, end + 1)[0]))
        at = end + 17
    return out


def exr_info(data: bytes) -> Info:
    attrs, _ = exr_attributes(data)
    need("dataWindow" in attrs and "channels" in attrs, "EXR header")
    x0, y0, x1, y1 = struct.unpack("<4i", attrs["dataWindow"][1])
    channels = exr_channels(attrs["channels"][1])
    return Info("exr", x1 - x0 + 1, y1 - y0 + 1, sum({0: 32, 1: 16, 2: 32}.get(k, 0) for _, k in channels), extra={"channels": ",".join(n for n, _ in channels), "compression": str(attrs["compression"][1][0]) if "compression" in attrs else "", "attributes": ",".join(attrs)})


def srgb(v: np.ndarray) -> np.ndarray:
    """Linear light to 8 bits by the sRGB curve."""
    v = np.clip(np.nan_to_num(v), 0, 1)
    return np.floor(np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)


def exr_decode(data: bytes) -> list[Frame]:
    attrs, at = exr_attributes(data)
    need(attrs.get("compression", ("", b"\0"))[1][:1] == b"\0", "EXR compression")
    x0, y0, x1, y1 = struct.unpack("<4i", attrs["dataWindow"][1])
    w, h = sized(x1 - x0 + 1, y1 - y0 + 1)
    channels = exr_channels(attrs["channels"][1])
    planes = {n: np.zeros((h, w)) for n, _ in channels}
    for k in range(h):
        place = struct.unpack_from("<Q", data, at + 8 * k)[0]
        need(place + 8 <= len(data), "EXR: lines are cut")
        y, place = struct.unpack_from("<i", data, place)[0] - y0, place + 8
        need(0 <= y < h, "EXR line")
        for name, kind in channels:
            code = {0: "<u4", 1: "<f2", 2: "<f4"}[kind]
            line = np.frombuffer(data, code, w, place).astype(np.float64)
            planes[name][y] = line / 0xFFFFFFFF if kind == 0 else line
            place += w * (2 if kind == 1 else 4)
    if {"R", "G", "B"} <= planes.keys():
        out = [srgb(planes[c]) for c in "BGR"] + ([np.clip(planes["A"] * 255 + 0.5, 0, 255).astype(np.uint8)] if "A" in planes else [])
    else:
        out = [srgb(next(iter(planes.values())))]
    return [Frame(np.dstack(out))]


# PSD


def psd_info(data: bytes) -> Info:
    need(data[:4] == b"8BPS" and len(data) >= 26, "not PSD")
    version, channels, h, w, depth, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    return Info("psd", w, h, channels * depth, extra={"version": str(version), "channels": str(channels), "mode": str(mode)})


def psd_resources(data: bytes) -> list[tuple[int, str, bytes]]:
    """Image resources: id, name, data."""
    psd_info(data)
    at = 26 + 4 + struct.unpack_from(">I", data, 26)[0]
    end, at, out = at + 4 + struct.unpack_from(">I", data, at)[0], at + 4, []
    while at + 12 <= min(end, len(data)) and data[at : at + 4] == b"8BIM":
        ident, n = struct.unpack_from(">HB", data, at + 4)
        name = _latin(data[at + 7 : at + 7 + n])
        at += 6 + (n + 2) // 2 * 2
        size = struct.unpack_from(">I", data, at)[0]
        out.append((ident, name, data[at + 4 : at + 4 + size]))
        at += 4 + size + size % 2
    return out


def psd_decode(data: bytes) -> list[Frame]:
    info = psd_info(data)
    w, h = sized(info.width, info.height)
    channels, at = int(info.extra["channels"]), 26
    need(info.depth == 8 * channels, "PSD depth")
    for _ in range(3):
        need(at + 4 <= len(data), "PSD section")
        at += 4 + struct.unpack_from(">I", data, at)[0]
    comp, at = struct.unpack_from(">H", data, at)[0], at + 2
    if comp == 1:
        sizes = struct.unpack_from(f">{h * channels}H", data, at)
        at, rows = at + 2 * h * channels, []
        for n in sizes:
            rows.append(entropy.packbits(data[at : at + n], w).ljust(w, b"\0"))
            at += n
        body = b"".join(rows)
    else:
        need(comp == 0, "PSD compression")
        body = data[at:]
    planes = _rows(body, w, h * channels, "PSD").reshape(channels, h, w)
    order = [2, 1, 0, 3][: min(channels, 4)] if channels >= 3 else [0]
    return [Frame(np.ascontiguousarray(np.dstack([planes[k] for k in order])))]


__all__ = [n for n in dir() if n.endswith(("_info", "_decode", "_encode"))] + ["FormatError"]
