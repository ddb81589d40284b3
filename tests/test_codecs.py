import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.codecs import containers, entropy, jpeg, raster, registry
from pixelloom.codecs.entropy import BitReader, BitWriter, Huffman
from pixelloom.codecs.model import FormatError

from . import fixtures as fx


def test_bit_reader_both_orders():
    data = bytes.fromhex("577183A9".replace("7183", "8371"))
    r = BitReader(data)
    assert [r.bit() for _ in range(4)] == [0, 1, 0, 1] and r.bits(4) == 7
    r.skip(5)
    assert r.bits(4) == 6
    assert r.bits(9) == 0x71 * 4 + 2
    r.back(2)
    assert r.bits(4) == 0xA
    low = BitReader(data, msb=False)
    assert [low.bit() for _ in range(4)] == [1, 1, 1, 0] and low.bits(4) == 5


def test_bit_writer_and_stuffing():
    w = BitWriter()
    for v, n in ((1, 1), (1, 1), (0, 1), (0, 1), (5, 4)):
        w.put(v, n)
    assert w.done() == b"\xc5"
    w = BitWriter(stuffed=True)
    w.put(0xFF, 8)
    assert w.done() == b"\xff\0"


def test_huffman_vectors():
    code = Huffman([0, 2, 2, 0], b"ABCD")
    assert bytes(code.decode(bytes.fromhex("A565"), 6)) == b"DADBCD"[:6]
    own = Huffman.of(b"DADBCDCB")
    coded = own.encode(b"DADBCDCB")
    assert len(coded) == 2 and bytes(own.decode(coded, 8)) == b"DADBCDCB"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trips(data):
    assert entropy.packbits(entropy.packbits_encode(data)) == data
    assert entropy.lzw(entropy.lzw_encode(data, 8), 8) == data
    assert entropy.lzw(entropy.lzw_encode(data, 8, True, 1), 8, True, 1) == data
    if data:
        code = Huffman.of(data)
        assert bytes(code.decode(code.encode(data), len(data))) == data


def test_lzw_over_full_table():
    data = np.random.default_rng(1).integers(0, 256, 30000, dtype=np.uint8).tobytes() + b"ab" * 9000
    assert entropy.lzw(entropy.lzw_encode(data, 8), 8) == data
    assert entropy.lzw(entropy.lzw_encode(data, 8, True, 1), 8, True, 1) == data


def test_numbers():
    w = BitWriter()
    for v in range(200):
        n = (v + 1).bit_length()
        w.put(v + 1, 2 * n - 1)
    r = BitReader(w.done())
    assert [entropy.unsigned_golomb(r) for _ in range(200)] == list(range(200))
    assert entropy.leb128(bytes.fromhex("E58E26"), 0) == (624485, 3)
    assert entropy.ue7(b"\x81\x00", 0) == (128, 2)
    assert entropy.lz77(b"abc\x80\x18") == b"abcabc"[:3] + b"abc"


@pytest.mark.parametrize("colour,channels,depth", [(0, 1, 1), (0, 1, 2), (0, 1, 4), (0, 1, 8), (0, 1, 16), (2, 3, 8), (2, 3, 16), (4, 2, 8), (6, 4, 8), (6, 4, 16)])
@pytest.mark.parametrize("interlace", [0, 1])
@pytest.mark.parametrize("size", [(1, 1), (5, 7), (9, 16)])
def test_png(colour, channels, depth, interlace, size):
    top = (1 << depth) - 1
    s = np.random.default_rng(depth).integers(0, top + 1, (*size, channels))
    data = fx.png(s, colour, depth, filters=[0, 1, 2, 3, 4], interlace=interlace, split=3)
    out = registry.decode(data)[0].pixels
    want = (s >> 8 if depth == 16 else s * 255 // top).astype(np.uint8)
    if colour == 4:
        want = want[:, :, [0, 0, 0, 1]]
    elif channels >= 3:
        want = want[:, :, [2, 1, 0, 3][:channels]]
    assert np.array_equal(out, want)
    i = registry.info(data)
    assert (i.format, i.width, i.height, i.depth, i.crc_ok) == ("png", size[1], size[0], depth, True)


def test_png_palette_text_and_bad_checksum():
    palette = np.arange(48, dtype=np.uint8).reshape(16, 3)
    s = np.arange(35).reshape(5, 7, 1) % 16
    extra = fx.chunk(b"tEXt", b"Title\0x") + fx.chunk(b"zTXt", b"Z\0\0" + zlib.compress(b"packed")) + fx.chunk(b"iTXt", b"I\0\0\0en\0\0\xc3\xa9") + fx.chunk(b"tIME", struct.pack(">HBBBBB", 2020, 1, 2, 3, 4, 5)) + fx.chunk(b"gAMA", struct.pack(">I", 45455))
    data = fx.png(s, 3, 4, palette=palette, extra=extra)
    assert np.array_equal(registry.decode(data)[0].pixels, palette[s[:, :, 0]][:, :, ::-1])
    i = registry.info(data)
    assert (i.extra["text:Title"], i.extra["text:Z"], i.extra["text:I"], i.extra["time"], i.extra["gamma"]) == ("x", "packed", "é", "2020-01-02 03:04:05", "45455")
    broken = data.replace(b"Title\0x", b"Title\0y")
    assert registry.info(broken).crc_ok is False


@pytest.mark.parametrize("w", [1, 4, 7, 17])
def test_bmp(w):
    p = fx.picture(5, w, 4)
    for top_down in (False, True):
        assert np.array_equal(registry.decode(raster.bmp_encode(p, top_down))[0].pixels, p)
    rows = b"".join(r[:, :3].tobytes().ljust((w * 24 + 31) // 32 * 4, b"\0") for r in p[::-1])
    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, 5, 1, 24, 0, 0, 0, 0, 0, 0)
    assert np.array_equal(registry.decode(head + rows)[0].pixels, p[:, :, :3])
    for bits in (1, 4, 8):
        index = np.random.default_rng(w).integers(0, 1 << bits, (5, w))
        palette = np.random.default_rng(2).integers(0, 256, (1 << bits, 4), dtype=np.uint8)
        packed = b"".join(np.packbits(((r[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes().ljust((w * bits + 31) // 32 * 4, b"\0") for r in index[::-1])
        head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + palette.size) + struct.pack("<IiiHHIIiiII", 40, w, 5, 1, bits, 0, 0, 0, 0, 0, 0)
        assert np.array_equal(registry.decode(head + palette.tobytes() + packed)[0].pixels, palette[index][:, :, :3])


def test_bmp_run_lengths():
    assert entropy.bmp_rle(bytes([3, 7, 0, 0, 0, 3, 1, 2, 3, 0, 0, 1]), 3, 2, False) == bytes([7, 7, 7, 1, 2, 3])
    assert entropy.bmp_rle(bytes([3, 0x12, 0, 0, 0, 2, 1, 0, 1, 9, 0, 1]), 3, 2, True) == bytes([1, 2, 1, 0, 0, 0][:3]) + bytes([0, 0, 0])
    assert entropy.bmp_rle(bytes([0, 5, 1, 2, 3, 4, 5, 0, 0, 1]), 5, 1, False) == bytes([1, 2, 3, 4, 5])


def test_gif():
    palette = np.random.default_rng(0).integers(0, 256, (256, 3), dtype=np.uint8)
    frames = [np.random.default_rng(k).integers(0, 256, (11, 13), dtype=np.uint8) for k in range(2)]
    for interlace in (False, True):
        data = fx.gif(frames, palette, interlace, b"hello")
        out = registry.decode(data)
        assert [np.array_equal(o.pixels, palette[f][:, :, ::-1]) for o, f in zip(out, frames)] == [True, True]
        assert [o.delay for o in out] == [0, 10]
        i = registry.info(data)
        assert (i.frames, i.extra["comment"]) == (2, "hello")


@pytest.mark.parametrize("data,want", [
    (b"P1 # c\n2 2\n1 0\n01", [[0, 255], [255, 0]]),
    (b"P2\n2 1 15\n15 0", [[255, 0]]),
    (b"P4\n9 1\n\x80\x80", [[0] + [255] * 7 + [0]]),
    (b"P5 2 1 255\n\x05\x06", [[5, 6]]),
    (b"P5 1 1 65535\n\xff\xff", [[255]]),
    (b"P6 1 1 255\n\1\2\3", [[[3, 2, 1]]]),
    (b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n\1\2\3\4", [[[3, 2, 1, 4]]]),
])
def test_pnm(data, want):
    out = registry.decode(data)[0].pixels
    assert np.array_equal(out.squeeze(), np.array(want).squeeze())


def test_tga():
    p = fx.picture(4, 6)
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 6, 4, 24, 0)
    assert np.array_equal(registry.decode(head + p[::-1].tobytes())[0].pixels, p)
    head = struct.pack("<BBBHHBHHHHBB", 2, 0, 10, 0, 0, 0, 0, 0, 6, 4, 24, 32) + b"id"
    flat, coded = p.reshape(-1, 3), b""
    for i in range(0, 24, 8):
        coded += b"\x07" + flat[i : i + 8].tobytes()
    assert np.array_equal(registry.decode(head + coded)[0].pixels, p)
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 3, 0, 0, 0, 0, 0, 6, 4, 8, 32)
    assert np.array_equal(registry.decode(head + p[:, :, 0].tobytes())[0].pixels[:, :, 0], p[:, :, 0])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [1, 5, 32773, 8])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff(order, compression, predictor):
    p = fx.picture(7, 5)
    data = fx.tiff(p, order, compression, predictor)
    assert np.array_equal(registry.decode(data)[0].pixels, p[:, :, ::-1])
    assert registry.info(data).width == 5


def test_ico_exr_psd():
    mask = np.zeros((6, 5), np.uint8)
    mask[1, 2] = 1
    p = fx.picture(6, 5)
    data = fx.ico([(p, mask), (fx.picture(3, 9), np.ones((3, 9), np.uint8))])
    out = registry.decode(data)
    assert np.array_equal(out[0].pixels[:, :, :3], p) and np.array_equal(out[0].pixels[:, :, 3], (1 - mask) * 255)
    assert raster.best_entry(raster.ico_entries(data)) == 1
    planes = {c: np.linspace(0, 1, 12).reshape(3, 4) * k for c, k in zip("RGB", (1, 0.5, 0.25))}
    for kind in (1, 2):
        for down in (False, True):
            got = registry.decode(fx.exr(planes, kind, down))[0].pixels
            assert np.abs(got[:, :, 2].astype(int) - raster.srgb(planes["R"])).max() <= 1
    for packed in (False, True):
        data = fx.psd(p, packed)
        assert np.array_equal(registry.decode(data)[0].pixels, p[:, :, ::-1])
        assert raster.psd_resources(data) == [(1005, "", b"abc")]


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (17, 35)])
@pytest.mark.parametrize("channels", [1, 3])
def test_jpeg_round_trip(size, channels):
    y, x = np.mgrid[: size[0], : size[1]]
    p = np.dstack([(100 + 3 * x + 2 * y + 10 * k) % 256 for k in range(channels)]).astype(np.uint8)
    data = jpeg.jpeg_encode(p, 95)
    i = registry.info(data)
    assert (i.width, i.height, i.extra["process"]) == (size[1], size[0], "baseline")
    assert np.abs(registry.decode(data)[0].pixels.astype(int) - p).max() <= 6
    both = registry.decode(data + data)
    assert len(both) == 2 and np.array_equal(both[0].pixels, both[1].pixels)
    assert len(jpeg.jpeg_decode(data + data, first_only=True)) == 1


def test_boxes_and_items():
    data = fx.heif()
    found = {b["type"]: b for b in containers.boxes(data)}
    assert {"ftyp", "meta", "iloc", "infe", "ispe", "mdat"} <= found.keys() and found["mdat"]["size"] == 19
    assert containers.item_locations(data, found["iloc"]) == [{"item_id": 1, "method": 0, "extent": 0, "offset": 100, "length": 7}]
    assert [(p["property"], p["essential"]) for p in containers.item_properties(data, found["ipma"])] == [(1, True), (2, False)]
    assert containers.item_references(data, found["iref"]) == [{"type": "auxl", "from_item": 2, "to_item": 1}]
    i = registry.info(data)
    assert (i.format, i.width, i.height, i.depth, i.frames) == ("heif", 64, 48, 24, 1)


def test_other_headers():
    bpg = b"BPG\xfb" + bytes((0x20, 0x10)) + b"\x81\x00" + b"\x40" + b"\x00"
    i = registry.info(bpg)
    assert (i.format, i.width, i.height, i.depth) == ("bpg", 128, 64, 8)
    siz = struct.pack(">HIIIIIIIIH", 0, 100, 50, 0, 0, 100, 50, 0, 0, 3) + bytes((7, 1, 1)) * 3
    j2k = b"\xff\x4f\xff\x51" + struct.pack(">H", len(siz) + 2) + siz + b"\xff\x93"
    assert (registry.info(j2k).width, registry.info(j2k).depth) == (100, 24)
    vp8l = b"VP8L" + struct.pack("<I", 6) + b"\x2f" + struct.pack("<I", 63 | 31 << 14) + b"\0"
    i = registry.info(b"RIFF" + struct.pack("<I", 4 + len(vp8l)) + b"WEBP" + vp8l)
    assert (i.width, i.height, i.extra["codec"]) == (64, 32, "vp8l")
    svg = b'<?xml version="1.0"?><!-- c --><svg width="12" height="8px"><g a=\'1\'><path d="M 0"/></g></svg>'
    nodes = containers.svg_nodes(svg)
    assert [(n["tag"], n["parent_id"]) for n in nodes] == [("svg", -1), ("g", 0), ("path", 1)]
    assert (registry.info(svg).width, registry.info(svg).height) == (12, 8)
    nal = containers.nal_units(b"\0\0\1\x40\x01\x0c\0\0\3\1\0\0\1\x26\x01\xaa")
    assert [(n["type"], n["data"]) for n in nal] == [(32, b"\x0c\0\0\1"), (19, b"\xaa")]
    assert [(o["type"], o["data"]) for o in containers.obu_units(b"\x0a\x02ab\x32\x01c")] == [(1, b"ab"), (6, b"c")]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["png", "bmp", "gif", "tiff", "psd", "exr", "ico", "jpeg", "heif"]), st.integers(0, 400), st.integers(0, 255), st.integers(0, 400))
def test_broken_files_raise_plain_errors(kind, at, value, cut):
    p = fx.picture(6, 5)
    data = bytearray({"png": lambda: fx.png(p, 2), "bmp": lambda: raster.bmp_encode(p), "gif": lambda: fx.gif([p[:, :, 0]], np.zeros((256, 3), np.uint8)), "tiff": lambda: fx.tiff(p), "psd": lambda: fx.psd(p), "exr": lambda: fx.exr({"R": np.zeros((3, 4))}), "ico": lambda: fx.ico([(p, p[:, :, 0] & 1)]), "jpeg": lambda: jpeg.jpeg_encode(p), "heif": fx.heif}[kind]())
    if at < len(data):
        data[at] = value
    for f in (registry.info, registry.decode):
        try:
            f(bytes(data[: len(data) - cut if cut < len(data) else 0]))
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError))


def test_registry_names():
    assert registry.named("JPG").name == "jpeg"
    with pytest.raises(FormatError):
        registry.encode(fx.picture(2, 2), "gif")
    with pytest.raises(FormatError):
        registry.named("nothing")
