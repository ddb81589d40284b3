"""Sample blocks as arrays: every transform is one expression over a row, without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fraction bits of the integer cosine basis.
BITS = 13


def constant(values: Sequence[float]) -> Column:
    """A constant array (folded into the plan)."""
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def build(n: int, f) -> Column:
    """The array of ``f(i)`` for i below n; i is a column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def dot(n: int, f) -> Column:
    """The sum of ``f(i)`` for i below n, as a long."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda a, i: a + f(i))


def samples(values: Column) -> Column:
    """Floats around zero as samples 0 to 255."""
    return F.transform(values, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 128 + 128))).cast("int"))


def cosine_basis(n: int = 8, bits: int = BITS) -> list[int]:
    """Row u, column x of the orthonormal cosine basis, scaled to integers."""
    out = []
    for u in range(n):
        scale = math.sqrt((1 if u == 0 else 2) / n)
        out += [math.floor(scale * math.cos((2 * x + 1) * u * math.pi / (2 * n)) * (1 << bits) + 0.5) for x in range(n)]
    return out


def rounded(value: Column, bits: int) -> Column:
    """A fixed-point value divided by a power of two, halves upwards."""
    return F.shiftright(value + (1 << (bits - 1)), bits)


def _pass(block: Column, basis: Column, bits: int, n: int, across: bool, inverse: bool) -> Column:
    def at(i: Column) -> Column:
        y, x = F.floor(i / n).cast("int"), F.pmod(i, F.lit(n)).cast("int")
        if across:
            return rounded(dot(n, lambda k: F.get(block, y * n + k) * F.get(basis, (k * n + x) if inverse else (x * n + k))), bits)
        return rounded(dot(n, lambda k: F.get(block, k * n + x) * F.get(basis, (k * n + y) if inverse else (y * n + k))), bits)

    return build(n * n, at)


def dct(block: Column, n: int = 8, bits: int = BITS) -> Column:
    """Forward cosine transform of a row-major block, rows first."""
    basis = constant(cosine_basis(n, bits))
    return let(block, lambda q: let(_pass(q, basis, bits, n, True, False), lambda b: _pass(b, basis, bits, n, False, False)))


def idct(block: Column, n: int = 8, bits: int = BITS) -> Column:
    """Inverse cosine transform, columns first."""
    basis = constant(cosine_basis(n, bits))
    return let(block, lambda q: let(_pass(q, basis, bits, n, False, True), lambda b: _pass(b, basis, bits, n, True, True)))


def matrix4(block: Column, matrix: Sequence[int], shift: int) -> Column:
    """A 4x4 separable transform by an integer matrix, each pass rounded by a shift."""
    m = constant(matrix)

    def once(b: Column, across: bool) -> Column:
        def at(i: Column) -> Column:
            y, x = F.floor(i / 4).cast("int"), F.pmod(i, F.lit(4)).cast("int")
            value = dot(4, lambda k: F.get(b, (y * 4 + k) if across else (k * 4 + x)) * F.get(m, (k * 4 + x) if across else (k * 4 + y)))
            return rounded(value, shift) if shift else value

        return build(16, at)

    return let(once(block, False), lambda b: once(b, True))


def zigzag(n: int = 8) -> list[int]:
    """Raster places in zigzag order: by diagonals, odd ones downwards."""
    cells = [(y, x) for y in range(n) for x in range(n)]
    return [y * n + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 == 0 else c[0]))]


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, up and upper left the nearest to left + up - upper left."""
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).otherwise(F.when(pb <= pc, b).otherwise(c))


def clamp(value: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
