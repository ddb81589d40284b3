"""What a decoder returns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """The bytes are not what the format asks for."""


@dataclass
class Frame:
    """One picture: ``pixels`` is height x width x channels, grey or BGR(A), top row first."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0


@dataclass
class Info:
    """What a header says; ``extra`` has the fields of one format, in file order."""

    format: str
    width: int = 0
    height: int = 0
    depth: int = 0
    frames: int = 1
    crc_ok: bool | None = None
    extra: dict[str, str] = field(default_factory=dict)


def need(ok: bool, what: str) -> None:
    if not ok:
        raise FormatError(what)


#: Pixels of one picture at most: a wrong header must not ask for all memory.
MOST_PIXELS = 1 << 28


def sized(width: int, height: int) -> tuple[int, int]:
    need(0 < width and 0 < height and width * height <= MOST_PIXELS, f"picture of {width} x {height}")
    return width, height
