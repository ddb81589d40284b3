"""Small image files made from arrays, for the tests."""

import struct
import zlib

import numpy as np

from pixelloom.codecs import entropy, raster


def picture(h, w, c=3, seed=0):
    r = np.random.default_rng(seed)
    base = np.add.outer(np.arange(h) * 7, np.arange(w) * 5)[:, :, None] + np.arange(c) * 40
    return ((base + r.integers(0, 9, (h, w, c))) % 256).astype(np.uint8)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples, colour, depth=8, filters=None, interlace=0, palette=None, extra=b"", split=1):
    """``samples``: h x w x channels, values of the depth."""
    h, w, c = samples.shape
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlace else [(0, 0, 1, 1)]
    raw = bytearray()
    for y0, x0, dy, dx in passes:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        step = max(1, c * depth // 8)
        above = None
        for y, line in enumerate(part.reshape(part.shape[0], -1)):
            if depth == 16:
                b = line.astype(">u2").tobytes()
            elif depth == 8:
                b = line.astype(np.uint8).tobytes()
            else:
                b = np.packbits(((line[:, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()
            above = above or bytes(len(b))
            f = (filters[y % len(filters)]) if filters else 0
            raw.append(f)
            for i, v in enumerate(b):
                a = b[i - step] if i >= step else 0
                u = above[i]
                d = above[i - step] if i >= step else 0
                p = a + u - d
                near = min((abs(p - a), 0, a), (abs(p - u), 1, u), (abs(p - d), 2, d))[2]
                raw.append((v - [0, a, u, (a + u) // 2, near][f]) & 255)
            above = b
    z = zlib.compress(bytes(raw))
    cut = -(-len(z) // split)
    out = raster.PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra
    if palette is not None:
        out += chunk(b"PLTE", palette.tobytes())
    return out + b"".join(chunk(b"IDAT", z[k : k + cut]) for k in range(0, len(z), cut)) + chunk(b"IEND", b"")


def gif(frames, palette, interlace=False, comment=b""):
    h, w = frames[0].shape
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 7, 0, 0) + palette.tobytes()
    if comment:
        out += b"\x21\xfe" + bytes((len(comment),)) + comment + b"\0"
    for k, f in enumerate(frames):
        out += b"\x21\xf9\x04\0" + struct.pack("<H", 10 * k) + b"\0\0"
        rows = f[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]] if interlace else f
        coded = entropy.lzw_encode(rows.tobytes(), 8)
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x40 if interlace else 0) + b"\x08"
        out += b"".join(bytes((len(coded[i : i + 255]),)) + coded[i : i + 255] for i in range(0, len(coded), 255)) + b"\0"
    return out + b"\x3b"


def tiff(rgb, order="<", compression=1, predictor=1, rows_a_strip=3):
    h, w, c = rgb.shape
    v = rgb.astype(np.int64)
    if predictor == 2:
        v = np.concatenate([v[:, :1], np.diff(v, axis=1)], axis=1)
    v = (v % 256).astype(np.uint8)
    strips = []
    for y in range(0, h, rows_a_strip):
        raw = v[y : y + rows_a_strip].tobytes()
        strips.append({1: lambda r: r, 5: lambda r: entropy.lzw_encode(r, 8, True, 1), 32773: entropy.packbits_encode, 8: zlib.compress}[compression](raw))
    body, places = b"", []
    for s in strips:
        places.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * c), (259, 3, [compression]), (262, 3, [2 if c == 3 else 1]), (273, 4, places), (277, 3, [c]), (278, 4, [rows_a_strip]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
    at = 8 + len(body)
    extra, entries = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), base + len(extra))
            extra += data
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


def exr(planes, kind=1, down=False):
    h, w = next(iter(planes.values())).shape
    code = {0: "<u4", 1: "<f2", 2: "<f4"}[kind]

    def attribute(name, type_, data):
        return name.encode() + b"\0" + type_.encode() + b"\0" + struct.pack("<I", len(data)) + data

    channels = b"".join(n.encode() + b"\0" + struct.pack("<IIII", kind, 0, 1, 1) for n in sorted(planes)) + b"\0"
    head = b"\x76\x2f\x31\x01" + struct.pack("<I", 2) + attribute("channels", "chlist", channels) + attribute("compression", "compression", b"\0") + attribute("dataWindow", "box2i", struct.pack("<4i", 0, 0, w - 1, h - 1)) + attribute("lineOrder", "lineOrder", bytes((int(down),))) + b"\0"
    size = sum(w * np.dtype(code).itemsize for _ in planes)
    lines = {y: struct.pack("<iI", y, size) + b"".join(planes[n][y].astype(code).tobytes() for n in sorted(planes)) for y in range(h)}
    order = list(range(h))[::-1] if down else list(range(h))
    first, at = len(head) + 8 * h, {}
    body = b""
    for y in order:
        at[y] = first + len(body)
        body += lines[y]
    return head + b"".join(struct.pack("<Q", at[y]) for y in range(h)) + body


def ico(entries):
    """``entries``: (BGR picture, mask)."""
    bodies = []
    for bgr, mask in entries:
        h, w = mask.shape
        rows = b"".join(r.tobytes().ljust((w * 24 + 31) // 32 * 4, b"\0") for r in bgr[::-1])
        bits = b"".join(np.packbits(r).tobytes().ljust((w + 31) // 32 * 4, b"\0") for r in mask[::-1])
        bodies.append(struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 24, 0, 0, 0, 0, 0, 0) + rows + bits)
    out, at = struct.pack("<HHH", 0, 1, len(entries)), 6 + 16 * len(entries)
    for (_, mask), b in zip(entries, bodies):
        out += struct.pack("<BBBBHHII", mask.shape[1], mask.shape[0], 0, 0, 1, 24, len(b), at)
        at += len(b)
    return out + b"".join(bodies)


def psd(rgb, packed=False):
    h, w, c = rgb.shape
    planes = rgb.transpose(2, 0, 1)
    rows = [planes[k, y].tobytes() for k in range(c) for y in range(h)]
    coded = [entropy.packbits_encode(r) for r in rows]
    body = struct.pack(f">H{len(rows)}H", 1, *[len(r) for r in coded]) + b"".join(coded) if packed else struct.pack(">H", 0) + b"".join(rows)
    resources = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + struct.pack(">I", 3) + b"abc\0"
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, c, h, w, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", len(resources)) + resources + struct.pack(">I", 0) + body


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def heif():
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"hvc1" + b"pic\0")
    iloc = box(b"iloc", b"\0\0\0\0" + struct.pack(">HH", 0x4400, 1) + struct.pack(">HHHII", 1, 0, 1, 100, 7))
    ipma = box(b"ipma", b"\0\0\0\0" + struct.pack(">IHB", 1, 1, 2) + b"\x81\x02")
    ipco = box(b"ipco", box(b"ispe", b"\0\0\0\0" + struct.pack(">II", 64, 48)) + box(b"pixi", b"\0\0\0\0\3\x08\x08\x08"))
    iref = box(b"iref", b"\0\0\0\0" + box(b"auxl", struct.pack(">HHH", 2, 1, 1)))
    meta = box(b"meta", b"\0\0\0\0" + box(b"hdlr", bytes(8) + b"pict" + bytes(13)) + box(b"pitm", b"\0\0\0\0\0\1") + iloc + box(b"iinf", b"\0\0\0\0\0\1" + infe) + box(b"iprp", ipco + ipma) + iref)
    return box(b"ftyp", b"heic\0\0\0\0mif1heic") + meta + struct.pack(">I4sQ", 1, b"mdat", 19) + b"abc"
