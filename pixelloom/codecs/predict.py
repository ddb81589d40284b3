"""Intra prediction of the VP8 and HEVC formats, from their public specifications."""

from __future__ import annotations

import numpy as np

from .model import need


def _two(a: int, b: int) -> int:
    return (a + b + 1) >> 1


def _three(a: int, b: int, c: int) -> int:
    return (a + 2 * b + c + 2) >> 2


def vp8_block(mode: str, above: np.ndarray | None, left: np.ndarray | None, corner: int = 127, size: int = 16) -> np.ndarray:
    """Whole-block prediction DC, V, H or TM; a missing edge is 127 above and 129 left, and no part of a mean."""
    a = np.full(size, 127) if above is None else np.asarray(above[:size]).astype(int)
    b = np.full(size, 129) if left is None else np.asarray(left[:size]).astype(int)
    if mode == "V":
        out = np.tile(a, (size, 1))
    elif mode == "H":
        out = np.tile(b[:, None], (1, size))
    elif mode == "TM":
        out = np.clip(b[:, None] + a[None, :] - corner, 0, 255)
    else:
        need(mode == "DC", f"mode {mode}")
        edges = [e for e, given in ((a, above), (b, left)) if given is not None]
        n = size * len(edges)
        out = np.full((size, size), (sum(int(e.sum()) for e in edges) + n // 2) // n if n else 128)
    return out.astype(np.uint8)


def vp8_subblock(mode: str, above: np.ndarray, left: np.ndarray, corner: int) -> np.ndarray:
    """4x4 prediction: DC, TM, VE, HE, LD, RD, VR, VL, HD or HU; ``above`` has eight samples."""
    a, b = [int(v) for v in above], [int(v) for v in left]
    e = [*b[3::-1], int(corner), *a]  # from the lowest left sample round the corner to the right

    def near(i: int) -> int:
        return _three(e[i - 1], e[i], e[i + 1])

    def at(r: int, c: int) -> int:
        if mode == "DC":
            return (sum(a[:4]) + sum(b) + 4) >> 3
        if mode == "TM":
            return min(255, max(0, b[r] + a[c] - e[4]))
        if mode == "VE":
            return near(5 + c)
        if mode == "HE":
            return _three(e[4] if r == 0 else b[r - 1], b[r], b[min(3, r + 1)])
        if mode == "LD":
            k = r + c
            return _three(a[k], a[min(7, k + 1)], a[min(7, k + 2)])
        if mode == "RD":
            return near(4 - r + c)
        if mode == "VR":
            k = 2 * c - r
            return _two(e[4 + k // 2], e[5 + k // 2]) if k >= 0 and k % 2 == 0 else near(4 + (k + 1) // 2 if k >= -1 else 5 + k)
        if mode == "HD":
            k = 2 * r - c
            return _two(e[3 - k // 2], e[4 - k // 2]) if k >= 0 and k % 2 == 0 else near(4 - (k + 1) // 2 if k >= -1 else 3 - k)
        if mode == "VL":
            k = c + r // 2
            if c == 3 and r >= 2:
                return _three(*a[r + 2 : r + 5])
            return _two(a[k], a[k + 1]) if r % 2 == 0 else _three(*a[k : k + 3])
        need(mode == "HU", f"mode {mode}")
        k = c + 2 * r
        if k > 5:
            return b[3]
        return _two(b[k // 2], b[k // 2 + 1]) if k % 2 == 0 else _three(b[k // 2], b[k // 2 + 1], b[min(3, k // 2 + 2)])

    return np.array([[at(r, c) for c in range(4)] for r in range(4)], dtype=np.uint8)


# Displacement of the HEVC angular modes from vertical, in 32nds.
_ANGLES = [32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32]
_ANGLES = dict(enumerate(_ANGLES + _ANGLES[-2::-1], 2))


def hevc_block(mode: int, above: np.ndarray, left: np.ndarray, corner: int, size: int, smooth_edges: bool = False) -> np.ndarray:
    """Prediction 0 planar, 1 mean, 2 to 34 angular; edges have twice ``size`` samples."""
    a, b, n = np.asarray(above).astype(int), np.asarray(left).astype(int), size
    log = n.bit_length() - 1
    y, x = np.mgrid[:n, :n]
    if mode == 0:
        out = ((n - 1 - x) * b[y] + (x + 1) * a[n] + (n - 1 - y) * a[x] + (y + 1) * b[n] + n) >> (log + 1)
        return out.astype(np.uint8)
    if mode == 1:
        dc = (int(a[:n].sum()) + int(b[:n].sum()) + n) >> (log + 1)
        out = np.full((n, n), dc)
        if smooth_edges:
            out[0, :], out[:, 0] = (a[:n] + 3 * dc + 2) >> 2, (b[:n] + 3 * dc + 2) >> 2
            out[0, 0] = (b[0] + 2 * dc + a[0] + 2) >> 2
        return out.astype(np.uint8)
    angle = _ANGLES[mode]
    main, side = (a, b) if mode >= 18 else (b, a)
    # Reference from -n to 2n: the corner at 0; a negative angle takes the rest from the side.
    reference = {k + 1: int(v) for k, v in enumerate(main[: 2 * n])} | {0: int(corner)}
    if angle < 0:
        inverse = round(8192 / angle)
        for k in range(-1, (n * angle) >> 5, -1):
            reference[k] = int(side[((k * inverse + 128) >> 8) - 1])
    out = np.zeros((n, n), int)
    for i in range(n):
        step, part = ((i + 1) * angle) >> 5, ((i + 1) * angle) & 31
        for j in range(n):
            first = reference[j + step + 1]
            out[i, j] = ((32 - part) * first + part * reference[j + step + 2] + 16) >> 5 if part else first
    if angle == 0 and smooth_edges:
        out[:, 0] = np.clip(main[0] + ((side[:n] - corner) >> 1), 0, 255)
    return (out if mode >= 18 else out.T).astype(np.uint8)


def add_residual(prediction: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Prediction plus residual, clamped."""
    return np.clip(prediction.astype(int) + residual, 0, 255).astype(np.uint8)
