"""Bit cursors and the dictionary, run-length and prefix codes of image formats."""

from __future__ import annotations

import heapq

from .model import FormatError, need


class BitReader:
    """Reads bits of a byte string, most or least significant first."""

    def __init__(self, data: bytes, msb: bool = True):
        self.data, self.msb, self.at = data, msb, 0

    @property
    def left(self) -> int:
        return 8 * len(self.data) - self.at

    def bit(self) -> int:
        if self.at >= 8 * len(self.data):
            raise FormatError("no more bits")
        byte, k = self.data[self.at >> 3], self.at & 7
        self.at += 1
        return byte >> (7 - k if self.msb else k) & 1

    def bits(self, n: int) -> int:
        """The next n bits as a number, read in the cursor's order."""
        need(n <= self.left, "no more bits")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        part, shift = self.data[first:last], self.at & 7
        self.at += n
        if self.msb:
            return int.from_bytes(part, "big") >> (8 * len(part) - shift - n) & ((1 << n) - 1)
        return int.from_bytes(part, "little") >> shift & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n

    def back(self, n: int) -> None:
        self.at = max(0, self.at - n)

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


class BitWriter:
    """Collects bits, most significant first; ``stuffed`` puts a zero byte after each FF."""

    def __init__(self, stuffed: bool = False):
        self.out, self.held, self.n, self.stuffed = bytearray(), 0, 0, stuffed

    def put(self, value: int, n: int) -> None:
        self.held = self.held << n | (value & ((1 << n) - 1))
        self.n += n
        while self.n >= 8:
            self.n -= 8
            byte = self.held >> self.n & 255
            self.out.append(byte)
            if self.stuffed and byte == 255:
                self.out.append(0)
        self.held &= (1 << self.n) - 1

    def done(self, fill: int = 0) -> bytes:
        if self.n:
            self.put(((1 << (8 - self.n)) - 1) if fill else 0, 8 - self.n)
        return bytes(self.out)


def unsigned_golomb(r: BitReader, k: int = 0) -> int:
    """Exp-Golomb code of order k."""
    zeros = 0
    while not r.bit():
        zeros += 1
        need(zeros <= 63, "Exp-Golomb code too long")
    return (((1 << zeros) - 1) << k) + (r.bits(zeros + k) if zeros + k else 0)


def signed_golomb(r: BitReader) -> int:
    v = unsigned_golomb(r)
    return (v + 1) // 2 if v & 1 else -(v // 2)


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """Little-endian base 128 number and the place after it."""
    value = shift = 0
    while True:
        need(at < len(data) and shift < 64, "cut base 128 number")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 128:
            return value, at


def ue7(data: bytes, at: int) -> tuple[int, int]:
    """Big-endian base 128 number and the place after it."""
    value = 0
    for _ in range(9):
        need(at < len(data), "cut number")
        value = value << 7 | data[at] & 127
        at += 1
        if not data[at - 1] & 128:
            return value, at
    raise FormatError("number too long")


def packbits(data: bytes, want: int | None = None) -> bytes:
    """PackBits: n+1 literal bytes, or one byte 1-n times."""
    out, at = bytearray(), 0
    while at < len(data) and (want is None or len(out) < want):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out if want is None else out[:want])


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def bmp_rle(data: bytes, width: int, height: int, four: bool) -> bytes:
    """Run-length coded rows (8 or 4 bits a pixel) as one index byte a pixel, in file order."""
    out, x, y, at = bytearray(width * height), 0, 0, 0

    def put(value: int) -> None:
        nonlocal x
        if x < width and y < height:
            out[y * width + x] = value
        x += 1

    while at + 1 < len(data) and y < height:
        n, c = data[at], data[at + 1]
        at += 2
        if n:
            for k in range(n):
                put((c >> 4 if k % 2 == 0 else c & 15) if four else c)
        elif c == 0:
            x, y = 0, y + 1
        elif c == 1:
            break
        elif c == 2:
            need(at + 1 < len(data), "cut move")
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (c + 1) // 2 if four else c
            part = data[at : at + size]
            need(len(part) == size, "cut literal run")
            for k in range(c):
                put((part[k // 2] >> 4 if k % 2 == 0 else part[k // 2] & 15) if four else part[k])
            at += size + size % 2
    return bytes(out)


def tga_rle(data: bytes, pixel: int, count: int) -> bytes:
    """Packets of one repeated pixel or several literal ones."""
    out, at = bytearray(), 0
    while len(out) < count * pixel:
        need(at < len(data), "cut packet")
        n = (data[at] & 127) + 1
        if data[at] & 128:
            out += data[at + 1 : at + 1 + pixel] * n
            at += 1 + pixel
        else:
            out += data[at + 1 : at + 1 + pixel * n]
            at += 1 + pixel * n
    return bytes(out[: count * pixel])


def lzw(data: bytes, size: int, msb: bool = False, early: int = 0) -> bytes:
    """LZW with clear and end codes after ``size`` bits of roots; codes of 12 bits at most.

    ``early``: codes grow this many entries before they must (1 for TIFF).
    """
    clear, end = 1 << size, (1 << size) + 1
    r, out, width = BitReader(data, msb), bytearray(), size + 1
    table: list[bytes] = [bytes((i,)) for i in range(clear)] + [b"", b""]
    before = b""
    while r.left >= width:
        code = r.bits(width)
        if code == clear:
            del table[end + 1 :]
            width, before = size + 1, b""
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        else:
            need(code == len(table) and bool(before), "code beyond the table")
            entry = before + before[:1]
        out += entry
        if before and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) + early >= 1 << width and width < 12:
                width += 1
        before = entry
    return bytes(out)


def lzw_encode(data: bytes, size: int, msb: bool = False, early: int = 0) -> bytes:
    """The same code, for tests and writers."""
    clear, end = 1 << size, (1 << size) + 1
    codes: list[tuple[int, int]] = [(clear, size + 1)]
    table = {bytes((i,)): i for i in range(clear)}
    width, now, nxt = size + 1, b"", end + 1
    for b in data:
        grown = now + bytes((b,))
        if grown in table:
            now = grown
            continue
        codes.append((table[now], width))
        if nxt < 4096:
            table[grown] = nxt
            nxt += 1
            if nxt + early > 1 << width and width < 12:
                width += 1
        else:
            codes.append((clear, width))
            table = {bytes((i,)): i for i in range(clear)}
            width, nxt = size + 1, end + 1
        now = bytes((b,))
    if now:
        codes.append((table[now], width))
        nxt += 1
        if nxt + early > 1 << width and width < 12:
            width += 1
    codes.append((end, width))
    held = n = 0
    out = bytearray()
    for code, w in codes:
        held, n = (held << w | code, n + w) if msb else (held | code << n, n + w)
        while n >= 8:
            if msb:
                out.append(held >> (n - 8) & 255)
                held &= (1 << (n - 8)) - 1
            else:
                out.append(held & 255)
                held >>= 8
            n -= 8
    if n:
        out.append((held << (8 - n)) & 255 if msb else held & 255)
    return bytes(out)


def lz77(data: bytes) -> bytes:
    """PalmDoc-style LZ77: literals, short literal runs, space pairs and 11-bit distances."""
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0 or 9 <= c < 128:
            out.append(c)
        elif c < 9:
            out += data[at : at + c]
            at += c
        elif c >= 192:
            out += bytes((32, c ^ 128))
        else:
            need(at < len(data), "cut pair")
            pair = c << 8 | data[at]
            at += 1
            far, n = pair >> 3 & 2047, (pair & 7) + 3
            need(0 < far <= len(out), "distance beyond the beginning")
            for _ in range(n):
                out.append(out[-far])
    return bytes(out)


class Huffman:
    """A canonical prefix code from the number of codes of each length and the symbols in order."""

    def __init__(self, counts: list[int], symbols: bytes | list[int]):
        self.codes: dict[int, tuple[int, int]] = {}
        self.by_code: dict[tuple[int, int], int] = {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                need(k < len(symbols) and code < 1 << length, "code table overflows")
                self.codes[symbols[k]] = (code, length)
                self.by_code[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.longest = max((n for n, _ in self.by_code), default=0)

    @classmethod
    def of(cls, data: bytes | list[int]) -> Huffman:
        """The code of the data's own frequencies."""
        counts: dict[int, int] = {}
        for s in data:
            counts[s] = counts.get(s, 0) + 1
        heap = [(n, s, [s]) for s, n in counts.items()]
        lengths = dict.fromkeys(counts, 1 if len(heap) == 1 else 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, min(i, j), x + y))
        order = sorted(counts, key=lambda s: (lengths[s], s))
        return cls([sum(1 for s in order if lengths[s] == n) for n in range(1, max(lengths.values(), default=0) + 1)], order)

    def read(self, r: BitReader) -> int:
        code = 0
        for length in range(1, self.longest + 1):
            code = code << 1 | r.bit()
            if (length, code) in self.by_code:
                return self.by_code[length, code]
        raise FormatError("no such code")

    def encode(self, data: bytes | list[int]) -> bytes:
        w = BitWriter()
        for s in data:
            w.put(*self.codes[s])
        return w.done()

    def decode(self, data: bytes, n: int) -> list[int]:
        r = BitReader(data)
        return [self.read(r) for _ in range(n)]


class BoolDecoder:
    """The boolean arithmetic decoder of VP8."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.range, self.bits = data, 2, int.from_bytes(data[:2].ljust(2, b"\0"), "big"), 255, 0

    def bit(self, chance: int = 128) -> int:
        split = 1 + ((self.range - 1) * chance >> 8)
        if self.value >= split << 8:
            self.range -= split
            self.value -= split << 8
            out = 1
        else:
            self.range, out = split, 0
        while self.range < 128:
            self.value, self.range, self.bits = self.value << 1, self.range << 1, self.bits + 1
            if self.bits == 8:
                self.bits = 0
                self.value |= self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
        return out

    def literal(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def signed(self, n: int) -> int:
        v = self.literal(n)
        return -v if self.bit() else v
