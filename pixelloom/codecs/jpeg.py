"""JPEG: baseline, extended and progressive decoding, baseline encoding."""

from __future__ import annotations

import math
import struct

import numpy as np

from ..functions.blocks import zigzag
from .entropy import BitReader, BitWriter, Huffman
from .model import FormatError, Frame, Info, need, sized

_ZIGZAG = np.array(zigzag())
_COSINE = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])

# The example quantisers and code tables of the JPEG standard (Annex K).
LUMA_QUANT = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMA_QUANT = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99],
])


def segments(data: bytes) -> list[dict]:
    """Marker segments: code, offset of the payload, payload; a scan's coded bytes follow its header."""
    need(data[:2] == b"\xff\xd8", "not JPEG")
    out, at = [{"code": 0xD8, "offset": 2, "data": b""}], 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        code = data[at + 1]
        if code in (0xFF, 0):
            at += 1
            continue
        at += 2
        if code in (0xD8, 0xD9) or 0xD0 <= code <= 0xD7 or code == 1:
            out.append({"code": code, "offset": at, "data": b""})
            continue
        if at + 2 > len(data):
            break
        n = struct.unpack_from(">H", data, at)[0]
        item = {"code": code, "offset": at + 2, "data": data[at + 2 : at + n]}
        out.append(item)
        at += n
        if code == 0xDA:
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7 or data[end + 1] == 0xFF:
                    end += 2 if data[end + 1] != 0xFF else 1
                    continue
                break
            item["scan"] = data[at:end]
            at = end
    return out


def pictures(data: bytes) -> list[list[dict]]:
    """Segments of each picture of a file that holds several after each other."""
    out: list[list[dict]] = []
    for s in segments(data):
        if s["code"] == 0xD8:
            out.append([])
        elif out:
            out[-1].append(s)
    return out


def _frame(segs: list[dict]) -> tuple[dict, list[list[int]]]:
    s = next((s for s in segs if s["code"] in (0xC0, 0xC1, 0xC2)), None)
    need(s is not None and len(s["data"]) >= 6, "JPEG without a frame this decoder knows")
    depth, h, w, n = struct.unpack_from(">BHHB", s["data"])
    need(len(s["data"]) >= 6 + 3 * n and n in (1, 3, 4), "JPEG components")
    return {"code": s["code"], "depth": depth, "height": h, "width": w}, [[s["data"][6 + 3 * k], s["data"][7 + 3 * k] >> 4, s["data"][7 + 3 * k] & 15, s["data"][8 + 3 * k]] for k in range(n)]


def jpeg_info(data: bytes) -> Info:
    pics = pictures(data)
    head, parts = _frame(pics[0])
    extra = {"process": {0xC0: "baseline", 0xC1: "extended", 0xC2: "progressive"}[head["code"]], "sampling": ",".join(f"{c[1]}x{c[2]}" for c in parts)}
    for s in pics[0]:
        if s["code"] == 0xFE:
            extra["comment"] = s["data"].decode("latin-1")
        elif s["code"] == 0xDD and len(s["data"]) >= 2:
            extra["restart"] = str(struct.unpack_from(">H", s["data"])[0])
        elif s["code"] == 0xE0 and s["data"][:4] == b"JFIF":
            extra["jfif"] = "%d.%02d" % (s["data"][5], s["data"][6])
    return Info("jpeg", head["width"], head["height"], head["depth"] * len(parts), len(pics), extra=extra)


def _extend(v: int, n: int) -> int:
    return v if n == 0 or v >= 1 << (n - 1) else v - (1 << n) + 1


class _Scan:
    """One scan over the coefficient planes."""

    def __init__(self, s: dict, parts: dict, dc: dict, ac: dict):
        d = s["data"]
        self.parts = [(parts[d[1 + 2 * k]], dc.get(d[2 + 2 * k] >> 4), ac.get(d[2 + 2 * k] & 15)) for k in range(d[0])]
        self.first, self.last, approx = d[1 + 2 * d[0] : 4 + 2 * d[0]]
        self.high, self.low = approx >> 4, approx & 15

    def block(self, r: BitReader, c: np.ndarray, part: dict, dc: Huffman, ac: Huffman, progressive: bool) -> None:
        k = self.first
        if k == 0:
            if self.high:
                c[0] |= r.bit() << self.low
            else:
                n = dc.read(r)
                part["pred"] += _extend(r.bits(n), n) if n else 0
                c[0] = part["pred"] << self.low
            k = 1
        if self.last == 0 or (progressive and k > self.last):
            return
        if self.high:
            self._refine(r, c, k, ac)
            return
        if self.run:
            self.run -= 1
            return
        while k <= self.last:
            rs = ac.read(r)
            zeros, n = rs >> 4, rs & 15
            if n == 0:
                if zeros == 15:
                    k += 16
                    continue
                if progressive and zeros:
                    self.run = (1 << zeros) - 1 + r.bits(zeros)
                break
            k += zeros
            need(k <= 63, "JPEG coefficient run")
            c[_ZIGZAG[k]] = _extend(r.bits(n), n) << self.low
            k += 1

    def _refine(self, r: BitReader, c: np.ndarray, k: int, ac: Huffman) -> None:
        one = 1 << self.low

        def touch(p: int) -> None:
            if r.bit() and not abs(int(c[p])) & one:
                c[p] += one if c[p] > 0 else -one

        while k <= self.last and not self.run:
            rs = ac.read(r)
            zeros, n, value = rs >> 4, rs & 15, 0
            if n:
                value = one if r.bit() else -one
            elif zeros < 15:
                self.run = (1 << zeros) + (r.bits(zeros) if zeros else 0)
                break
            while k <= self.last:
                p = _ZIGZAG[k]
                k += 1
                if c[p]:
                    touch(p)
                elif zeros == 0:
                    if value:
                        c[p] = value
                    break
                else:
                    zeros -= 1
        if self.run:
            for i in range(k, self.last + 1):
                if c[_ZIGZAG[i]]:
                    touch(_ZIGZAG[i])
            self.run -= 1


def _unstuffed(scan: bytes) -> list[bytes]:
    """Coded bytes between restart markers, without the zero bytes after FF."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    out.append(scan[start:])
    return [p.replace(b"\xff\x00", b"\xff") for p in out]


def _decode_one(segs: list[dict]) -> Frame:
    head, comps = _frame(segs)
    w, h = sized(head["width"], head["height"])
    need(head["depth"] == 8, "JPEG depth")
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    need(all(1 <= c[1] <= 4 and 1 <= c[2] <= 4 for c in comps), "JPEG sampling")
    mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
    parts = {c[0]: {"h": c[1], "v": c[2], "q": c[3], "pred": 0, "c": np.zeros((mh * c[2], mw * c[1], 64), np.int32)} for c in comps}
    quant: dict[int, np.ndarray] = {}
    dc: dict[int, Huffman] = {}
    ac: dict[int, Huffman] = {}
    interval, progressive = 0, head["code"] == 0xC2
    for s in segs:
        d, at = s["data"], 0
        if s["code"] == 0xDB:
            while at < len(d):
                wide, n = d[at] >> 4, d[at] & 15
                table = np.frombuffer(d, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
                quant[n] = np.zeros(64, np.int64)
                quant[n][_ZIGZAG] = table
                at += 129 if wide else 65
        elif s["code"] == 0xC4:
            while at + 17 <= len(d):
                counts = list(d[at + 1 : at + 17])
                (ac if d[at] >> 4 else dc)[d[at] & 15] = Huffman(counts, d[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif s["code"] == 0xDD:
            interval = struct.unpack_from(">H", d)[0]
        elif s["code"] == 0xDA:
            scan = _Scan(s, parts, dc, ac)
            if len(scan.parts) > 1:
                places = [[(p, d_, a_, my * p["v"] + y, mx * p["h"] + x) for p, d_, a_ in scan.parts for y in range(p["v"]) for x in range(p["h"])] for my in range(mh) for mx in range(mw)]
            else:
                p, d_, a_ = scan.parts[0]
                bw, bh = -(-(-(-w * p["h"] // hm)) // 8), -(-(-(-h * p["v"] // vm)) // 8)
                places = [[(p, d_, a_, y, x)] for y in range(bh) for x in range(bw)]
            pieces = _unstuffed(s["scan"])
            try:
                for k, piece in enumerate(pieces):
                    r = BitReader(piece)
                    scan.run = 0
                    for p, _, _ in scan.parts:
                        p["pred"] = 0
                    for unit in places[k * interval : (k + 1) * interval] if interval else places if k == 0 else []:
                        for p, d_, a_, y, x in unit:
                            scan.block(r, p["c"][y, x], p, d_, a_, progressive)
            except FormatError:
                pass  # a cut scan leaves the rest of the picture as it is
    planes = []
    for c in comps:
        p = parts[c[0]]
        need(p["q"] in quant, "JPEG quantiser")
        b = (p["c"] * quant[p["q"]]).reshape(*p["c"].shape[:2], 8, 8).astype(np.float64)
        b = np.einsum("ux,...uv,vy->...xy", _COSINE, b, _COSINE, optimize=True) + 128
        plane = np.clip(np.floor(b + 0.5), 0, 255).transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(np.repeat(np.repeat(plane, vm // p["v"], axis=0), hm // p["h"], axis=1)[:h, :w])
    if len(planes) == 1:
        return Frame(planes[0].astype(np.uint8)[:, :, None])
    y, u, v = planes[0], planes[1] - 128, planes[2] - 128
    out = np.dstack([y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v])
    if len(planes) == 4:
        out = out * planes[3][:, :, None] / 255
    return Frame(np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8))


def jpeg_decode(data: bytes, first_only: bool = False) -> list[Frame]:
    pics = [p for p in pictures(data) if any(s["code"] == 0xDA for s in p)]
    need(bool(pics), "JPEG without a scan")
    return [_decode_one(p) for p in (pics[:1] if first_only else pics)]


def _segment(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _category(v: int) -> int:
    return abs(v).bit_length()


def _symbols(block: list[int], pred: int) -> list[tuple[int, int, int]]:
    """(symbol, bits, count of bits) of a block in zigzag order; the first is the DC."""

    def low(v: int, n: int) -> int:
        return v if v > 0 else v + (1 << n) - 1

    n = _category(block[0] - pred)
    out, zeros = [(n, low(block[0] - pred, n) if n else 0, n)], 0
    last = max((i for i in range(1, 64) if block[i]), default=0)
    for v in block[1 : last + 1]:
        if v == 0:
            zeros += 1
            continue
        while zeros > 15:
            out.append((0xF0, 0, 0))
            zeros -= 16
        n = _category(v)
        out.append((zeros << 4 | n, low(v, n), n))
        zeros = 0
    if last < 63:
        out.append((0, 0, 0))
    return out


def _limited(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """Code counts (16 lengths) and symbols; no code of ones alone, none above 16 bits."""
    lengths = {s: 0 for s in counts}
    heap = [(n, [s]) for s, n in counts.items()] + [(0, [-1])]
    while len(heap) > 1:
        heap.sort(key=lambda x: (-x[0], x[1]))
        (a, x), (b, y) = heap.pop(), heap.pop()
        for s in x + y:
            if s >= 0:
                lengths[s] += 1
        heap.append((a + b, x + y))
    order = sorted(counts, key=lambda s: (lengths[s], s))
    number = [0] * 64
    for s in order:
        number[lengths[s]] += 1
    for n in range(63, 16, -1):
        while number[n] > 0:
            j = n - 2
            while number[j] == 0:
                j -= 1
            number[n] -= 2
            number[n - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    return number[1:17], order


def jpeg_encode(pixels: np.ndarray, quality: int = 50) -> bytes:
    """Baseline 4:2:0 (grey: one component) with code tables fitted to the picture."""
    h, w = sized(pixels.shape[1], pixels.shape[0])[::-1]
    p = pixels.reshape(h, w, -1).astype(np.float64)
    grey = p.shape[2] < 3
    b, g, r = (p[:, :, k] for k in ((0, 0, 0) if grey else (0, 1, 2)))
    planes = [0.299 * r + 0.587 * g + 0.114 * b]
    if not grey:
        planes += [-0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
    step = 8 if grey else 16
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    quants = [np.clip(np.floor((t * scale + 50) / 100), 1, 255).astype(np.int64) for t in (LUMA_QUANT, CHROMA_QUANT)]
    levels = []
    for k, plane in enumerate(planes):
        plane = np.pad(plane, ((0, -h % step), (0, -w % step)), mode="edge")
        if k:
            plane = plane.reshape(plane.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3) - 128
        coef = np.einsum("ux,...xy,vy->...uv", _COSINE, blocks, _COSINE, optimize=True)
        q = np.floor(coef / quants[min(k, 1)] + 0.5).astype(np.int64).reshape(*coef.shape[:2], 64)
        levels.append(q[:, :, _ZIGZAG])
    stream: list[tuple[int, bool, tuple[int, int, int]]] = []
    pred = [0, 0, 0]

    def add(k: int, y: int, x: int) -> None:
        block = levels[k][y, x].tolist()
        stream.extend((min(k, 1), i == 0, s) for i, s in enumerate(_symbols(block, pred[k])))
        pred[k] = block[0]

    for my in range(levels[0].shape[0] // (1 if grey else 2)):
        for mx in range(levels[0].shape[1] // (1 if grey else 2)):
            if grey:
                add(0, my, mx)
            else:
                for y in (0, 1):
                    for x in (0, 1):
                        add(0, 2 * my + y, 2 * mx + x)
                add(1, my, mx)
                add(2, my, mx)
    tables = {}
    for table in (0,) if grey else (0, 1):
        for is_dc in (True, False):
            counts: dict[int, int] = {}
            for t, d, (s, _, _) in stream:
                if t == table and d == is_dc:
                    counts[s] = counts.get(s, 0) + 1
            tables[table, is_dc] = _limited(counts or {0: 1})
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k in range(1 if grey else 2):
        out += _segment(0xDB, bytes((k,)) + bytes(quants[k].ravel()[_ZIGZAG].astype(np.uint8)))
    n = len(planes)
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes((k + 1, 0x11 if k or grey else 0x22, min(k, 1))) for k in range(n)))
    for (table, is_dc), (numbers, symbols) in tables.items():
        out += _segment(0xC4, bytes((table | (0 if is_dc else 16),)) + bytes(numbers) + bytes(symbols))
    out += _segment(0xDA, bytes((n,)) + b"".join(bytes((k + 1, 0x11 * min(k, 1))) for k in range(n)) + b"\0\x3f\0")
    codes = {k: Huffman(*v).codes for k, v in tables.items()}
    bits = BitWriter(stuffed=True)
    for table, is_dc, (s, value, size) in stream:
        bits.put(*codes[table, is_dc][s])
        if size:
            bits.put(value, size)
    return out + bits.done(fill=1) + b"\xff\xd9"
