"""Known formats: how each is told by its first bytes, read and written."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import containers, jpeg, raster
from .model import FormatError, Frame, Info, need

_HEIF = (b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1")


def _brand(data: bytes, brands: tuple[bytes, ...]) -> bool:
    return data[4:8] == b"ftyp" and data[8:12] in brands


@dataclass(frozen=True)
class Codec:
    name: str
    aliases: tuple[str, ...]
    probe: Callable[[bytes], bool]
    info: Callable[[bytes], Info]
    decode: Callable[[bytes], list[Frame]] | None = None
    encode: Callable[[np.ndarray], bytes] | None = None


def _tga(data: bytes) -> bool:
    return len(data) >= 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32) and 0 not in struct.unpack_from("<HH", data, 12)


#: In probing order: the formats without a clear mark come last.
CODECS = (
    Codec("bmp", ("dib",), lambda d: d[:2] == b"BM", raster.bmp_info, raster.bmp_decode, raster.bmp_encode),
    Codec("gif", (), lambda d: d[:6] in (b"GIF87a", b"GIF89a"), raster.gif_info, raster.gif_decode),
    Codec("png", (), lambda d: d[:8] == raster.PNG_SIGN, raster.png_info, raster.png_decode),
    Codec("tiff", ("tif",), lambda d: d[:4] in (b"II*\0", b"MM\0*"), raster.tiff_info, raster.tiff_decode),
    Codec("pnm", ("pbm", "pgm", "ppm", "pam"), lambda d: d[:1] == b"P" and d[1:2] in b"1234567" and d[2:3].isspace(), raster.pnm_info, raster.pnm_decode),
    Codec("jpeg", ("jpg",), lambda d: d[:3] == b"\xff\xd8\xff", jpeg.jpeg_info, jpeg.jpeg_decode, jpeg.jpeg_encode),
    Codec("heif", ("heic",), lambda d: _brand(d, _HEIF), containers.heif_info),
    Codec("avif", (), lambda d: _brand(d, (b"avif", b"avis")), containers.avif_info),
    Codec("webp", (), lambda d: d[:4] == b"RIFF" and d[8:12] == b"WEBP", containers.webp_info),
    Codec("bpg", (), lambda d: d[:4] == b"BPG\xfb", containers.bpg_info),
    Codec("ico", ("cur",), lambda d: d[:4] in (b"\0\0\1\0", b"\0\0\2\0") and d[4:6] != b"\0\0", raster.ico_info, raster.ico_decode),
    Codec("jp2", ("j2k",), lambda d: d[4:8] == b"jP  " or d[:4] == b"\xff\x4f\xff\x51", containers.jp2_info),
    Codec("exr", (), lambda d: d[:4] == b"\x76\x2f\x31\x01", raster.exr_info, raster.exr_decode),
    Codec("psd", (), lambda d: d[:4] == b"8BPS", raster.psd_info, raster.psd_decode),
    Codec("svg", (), lambda d: b"<svg" in d[:4096], containers.svg_info),
    Codec("tga", ("targa",), _tga, raster.tga_info, raster.tga_decode),
)


def probe(data: bytes) -> Codec | None:
    """The first format whose mark the bytes bear."""
    return next((c for c in CODECS if c.probe(data)), None)


def named(name: str) -> Codec:
    """A format by name or alias, in any case."""
    low = name.lower()
    found = next((c for c in CODECS if low == c.name or low in c.aliases), None)
    if found is None:
        raise FormatError(f"no format called {name}")
    return found


def info(data: bytes) -> Info:
    codec = probe(data)
    need(codec is not None, "unknown format")
    return codec.info(data)


def decode(data: bytes) -> list[Frame]:
    codec = probe(data)
    need(codec is not None, "unknown format")
    need(codec.decode is not None, f"pixels of {codec.name} are not decoded")
    return codec.decode(data)


def encode(pixels: np.ndarray, name: str) -> bytes:
    codec = named(name)
    need(codec.encode is not None, f"{codec.name} is not written")
    return codec.encode(pixels)
