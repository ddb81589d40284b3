"""Transforms, prediction filters, colour and quality over tables of sample blocks.

A block table has an id and an array column of samples (row-major). Everything here stays in
built-in expressions; only comparisons across blocks group by the block's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B

#: The example luminance quantiser of the JPEG standard, row-major.
LUMA_TABLE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
#: Inverse 4x4 sine transform matrix (29, 55, 74, 84).
SINE4 = [29, 55, 74, 84, 74, 74, 0, -74, 84, -29, -74, 55, 55, -84, 74, -29]


def long_form(df: DataFrame, key: str, column: str, value: str = "v", place: str = "i") -> DataFrame:
    """One row per sample: key, place, value."""
    return df.select(key, F.posexplode(column).alias(place, value))


def dct_lines(df: DataFrame, key: str = "vec_id", column: str = "q", n: int = 8) -> DataFrame:
    """One-dimensional transform of each line of a block: key, line, u, coef."""
    basis = B.constant(B.cosine_basis(n))

    def lines(q: Column) -> Column:
        def at(i: Column) -> Column:
            y, u = F.floor(i / n).cast("int"), F.pmod(i, F.lit(n)).cast("int")
            return B.rounded(B.dot(n, lambda x: F.get(q, y * n + x) * F.get(basis, u * n + x)), B.BITS)

        return B.build(n * n, at)

    flat = long_form(df.select(key, B.let(F.col(column), lines).alias("c")), key, "c", "coef")
    return flat.select(key, F.floor(F.col("i") / n).cast("int").alias("line"), F.pmod("i", F.lit(n)).cast("int").alias("u"), "coef")


def dct_blocks(df: DataFrame, key: str = "vec_id", column: str = "q", n: int = 8) -> DataFrame:
    """Two-dimensional transform: key, v, u, coef."""
    flat = long_form(df.select(key, B.dct(F.col(column), n).alias("c")), key, "c", "coef")
    return flat.select(key, F.floor(F.col("i") / n).cast("int").alias("v"), F.pmod("i", F.lit(n)).cast("int").alias("u"), "coef")


def energy(coefs: DataFrame) -> DataFrame:
    """Mean energy of each coefficient over all blocks (combined map-side)."""
    return coefs.groupBy("v", "u").agg(F.count("*").alias("n"), F.sum(F.col("coef") * F.col("coef")).cast("long").alias("energy"))


def roundtrip_error(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Largest error of a block after the forward and inverse transform."""
    back = B.let(B.dct(F.col(column)), lambda c: B.idct(c))
    return df.select(key, F.array_max(F.zip_with(back, F.col(column), lambda a, b: F.abs(a - b))).cast("int").alias("max_error"))


def inverse_wht4(block: Column) -> Column:
    """Inverse Walsh-Hadamard transform of 16 values (columns, then rows with +3 >> 3)."""

    def once(b: Column, at, last: bool) -> Column:
        def value(i: Column) -> Column:
            line, place = (F.floor(i / 4).cast("int"), F.pmod(i, F.lit(4)).cast("int")) if last else (F.pmod(i, F.lit(4)).cast("int"), F.floor(i / 4).cast("int"))
            w, x, y, z = (F.get(b, at(line, k)) for k in range(4))
            a1, b1, c1, d1 = w + z, x + y, x - y, w - z
            out = F.when(place == 0, a1 + b1).when(place == 1, c1 + d1).when(place == 2, a1 - b1).otherwise(d1 - c1)
            return F.shiftright(out + 3, 3) if last else out

        return B.build(16, value)

    return B.let(once(block, lambda line, k: line + 4 * k, False), lambda b: once(b, lambda line, k: line * 4 + k, True))


def inverse_dst4(block: Column) -> Column:
    """Inverse 4x4 sine transform, passes rounded by 7 and 12 bits."""

    def once(b: Column, across: bool, shift: int) -> Column:
        m = B.constant(SINE4)

        def at(i: Column) -> Column:
            y, x = F.floor(i / 4).cast("int"), F.pmod(i, F.lit(4)).cast("int")
            return B.rounded(B.dot(4, lambda k: F.get(b, (y * 4 + k) if across else (k * 4 + x)) * F.get(m, k * 4 + (x if across else y))), shift)

        return B.build(16, at)

    return B.let(once(block, False, 7), lambda b: once(b, True, 12))


def vp8_idct4(block: Column) -> Column:
    """Inverse 4x4 transform with the 20091 / 35468 multipliers, columns first, +4 >> 3."""

    def scaled(v: Column, wide: bool) -> Column:
        return v + F.shiftright(v * 20091, 16) if wide else F.shiftright(v * 35468, 16)

    def once(b: Column, at, last: bool) -> Column:
        def value(i: Column) -> Column:
            line, place = (F.floor(i / 4).cast("int"), F.pmod(i, F.lit(4)).cast("int")) if last else (F.pmod(i, F.lit(4)).cast("int"), F.floor(i / 4).cast("int"))
            p, q, r, s = (F.get(b, at(line, k)).cast("long") for k in range(4))
            even, odd = p + r, p - r
            c, d = scaled(q, False) - scaled(s, True), scaled(q, True) + scaled(s, False)
            out = F.when(place == 0, even + d).when(place == 1, odd + c).when(place == 2, odd - c).otherwise(even - d)
            return F.shiftright(out + 4, 3) if last else out

        return B.build(16, value)

    return B.let(once(block, lambda line, k: line + 4 * k, False), lambda b: once(b, lambda line, k: line * 4 + k, True))


def transform4(df: DataFrame, kind, key: str = "vec_id", column: str = "q") -> DataFrame:
    """A 4x4 inverse transform of every 16 samples less 128: key, block, i, out.

    Samples past the last multiple of 16 fill a block with 0 after them.
    """
    n = F.ceil(F.size(column) / 16).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    filled = F.transform(starts, lambda k: F.transform(F.sequence(k * 16, k * 16 + 15), lambda i: F.coalesce(F.get(F.col(column), i) - 128, F.lit(0))))
    each = df.select(key, F.posexplode(filled).alias("block", "s"))
    return each.select(key, "block", F.posexplode(B.let(F.col("s"), kind)).alias("i", "out"))


def scan_zigzag(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Samples in zigzag order: key, z, v."""
    order = B.constant(B.zigzag())
    return df.select(key, F.posexplode(F.transform(order, lambda p: F.get(F.col(column), p))).alias("z", "v"))


def last_nonzero(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Last zigzag place whose quantised coefficient is not zero; -1 if none."""
    order, table = B.constant(B.zigzag()), B.constant(LUMA_TABLE)

    def last(c: Column) -> Column:
        hit = F.transform(order, lambda p, i: F.when(F.floor(F.get(c, p) / F.get(table, p) + 0.5) != 0, i).otherwise(-1))
        return F.array_max(hit)

    return df.select(key, B.let(B.dct(F.transform(F.col(column), lambda v: v - 128)), last).cast("int").alias("last"))


def quantised(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Coefficients, their levels and values restored: key, i, coef, level, restored."""
    table = B.constant(LUMA_TABLE)
    flat = df.select(key, F.posexplode(B.dct(F.transform(F.col(column), lambda v: v - 128))).alias("i", "coef"))
    level = F.floor(F.col("coef") / F.get(table, F.col("i")) + 0.5).cast("long")
    return flat.select(key, "i", "coef", level.alias("level"), (level * F.get(table, F.col("i"))).alias("restored"))


def yuv_to_bgr(y: Column, u: Column, v: Column) -> list[Column]:
    """Blue, green, red of a luma and two centred chroma samples, clamped and cut."""

    def cut(value: Column) -> Column:
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value))).cast("int")

    return [cut(y + 2.128 * (u - 128)), cut(y - 0.215 * (u - 128) - 0.381 * (v - 128)), cut(y + 1.28 * (v - 128))]


def bgr_to_yuv(b: Column, g: Column, r: Column) -> list[Column]:
    """Luma (less 128) and chroma of the JFIF matrix, in thousandths, cut downwards."""
    y = F.floor((299 * r + 587 * g + 114 * b) / 1000) - 128
    u = F.floor((-169 * r - 331 * g + 500 * b) / 1000)
    v = F.floor((500 * r - 419 * g - 81 * b) / 1000)
    return [c.cast("int") for c in (y, u, v)]


def bgr_to_hsv(b: Column, g: Column, r: Column) -> list[Column]:
    """Hue 0 to 360, saturation and value 0 to 255, cut downwards."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (top - low).cast("double")
    turn = F.when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.when(top == low, F.lit(0.0)).otherwise(F.when(turn < 0, turn + 360).otherwise(turn))
    return [F.floor(hue).cast("int"), F.when(top == 0, F.lit(0)).otherwise(F.floor(255 * span / top)).cast("int"), top.cast("int")]


def planes(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Blocks 3k, 3k+1 and 3k+2 as the planes of picture k: pic, i, p0, p1, p2.

    One grouped pass instead of two self-joins; pictures with a missing plane drop.
    """
    cast = df.select(F.floor(F.col(key) / 3).alias("pic"), F.pmod(key, F.lit(3)).alias("plane"), F.col(column).alias("q"))
    wide = cast.groupBy("pic").agg(*[F.max(F.when(F.col("plane") == k, F.col("q"))).alias(f"p{k}") for k in range(3)]).where("p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL")
    return wide.select("pic", F.posexplode(F.arrays_zip("p0", "p1", "p2")).alias("i", "s")).select("pic", "i", "s.p0", "s.p1", "s.p2")


def subsample(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """2x2 means of 8x8 samples, halves upwards: key, y, x, v."""

    def at(i: Column) -> Column:
        first = F.floor(i / 4).cast("int") * 16 + F.pmod(i, F.lit(4)).cast("int") * 2
        return F.shiftright(sum((F.get(F.col(column), first + d) for d in (0, 1, 8, 9)), F.lit(2)), 2)

    flat = long_form(df.select(key, B.build(16, at).alias("c")), key, "c")
    return flat.select(key, F.floor(F.col("i") / 4).cast("int").alias("y"), F.pmod("i", F.lit(4)).cast("int").alias("x"), "v")


def upsample(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Nearest doubling of the first 4x4 samples: key, y, x, v."""

    def at(i: Column) -> Column:
        return F.get(F.col(column), F.floor(i / 16).cast("int") * 4 + F.floor(F.pmod(i, F.lit(8)) / 2).cast("int"))

    flat = long_form(df.select(key, B.build(64, at).alias("c")), key, "c")
    return flat.select(key, F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), "v")


def alpha_blend(front: Column, back: Column) -> Column:
    """The back sample is also the weight: (front * a + (255 - a) * back) / 255, cut."""
    return F.floor((front * back + (255 - back) * back) / F.lit(255.0)).cast("int")


def png_filter(df: DataFrame, kind: str, key: str = "vec_id", column: str = "q", width: int = 8) -> DataFrame:
    """A PNG line filter of every sample (one byte a pixel): key, i, f."""

    def at(value: Column, i: Column) -> Column:
        q = F.col(column)
        inner, below = F.pmod(i, F.lit(width)) > 0, i >= width
        a = F.when(inner, F.get(q, i - 1)).otherwise(0)
        b = F.when(below, F.get(q, i - width)).otherwise(0)
        c = F.when(inner & below, F.get(q, i - width - 1)).otherwise(0)
        guess = {"sub": a, "up": b, "avg": F.shiftright(a + b, 1), "paeth": B.paeth(a, b, c)}[kind]
        return F.pmod(value - guess, F.lit(256))

    return df.select(key, F.posexplode(F.transform(column, at)).alias("i", "f"))


def png_unfilter(df: DataFrame, kind: str, key: str = "vec_id", column: str = "f", width: int = 8) -> DataFrame:
    """Samples from filtered bytes, any of the five filters, by one fold over the row."""

    def add(out: Column, value: Column) -> Column:
        i = F.size(out)
        inner, below = F.pmod(i, F.lit(width)) > 0, i >= width
        a = F.when(inner, F.get(out, i - 1)).otherwise(0)
        b = F.when(below, F.get(out, i - width)).otherwise(0)
        c = F.when(inner & below, F.get(out, i - width - 1)).otherwise(0)
        guess = {"none": F.lit(0), "sub": a, "up": b, "avg": F.shiftright(a + b, 1), "paeth": B.paeth(a, b, c)}[kind]
        return F.array_append(out, F.pmod(value + guess, F.lit(256)).cast("int"))

    return df.select(key, F.posexplode(F.aggregate(column, F.array().cast("array<int>"), add)).alias("i", "v"))


def tiff_predictor(df: DataFrame, key: str = "vec_id", column: str = "q", width: int = 8) -> DataFrame:
    """Inverse of horizontal differencing: running sums of each line modulo 256."""

    def at(_: Column, i: Column) -> Column:
        first = i - F.pmod(i, F.lit(width))
        line = F.slice(column, first + 1, F.pmod(i, F.lit(width)) + 1)
        return F.pmod(F.aggregate(line, F.lit(0), lambda a, v: a + v), F.lit(256))

    return df.select(key, F.posexplode(F.transform(column, at)).alias("i", "v"))


def dc_prediction(df: DataFrame, key: str = "vec_id", column: str = "q") -> DataFrame:
    """Mean of a block's first line and first column, halves upwards."""
    total = B.dot(8, lambda k: F.get(F.col(column), k) + F.get(F.col(column), k * 8))
    return df.select(key, F.shiftright(total + 8, 4).cast("int").alias("dc"))


def true_motion(df: DataFrame, key: str = "vec_id", column: str = "q", width: int = 8) -> DataFrame:
    """Prediction left + up - corner from a block's edges, clamped: key, i, p."""

    def at(i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), F.pmod(i, F.lit(width)).cast("int")
        q = F.col(column)
        return B.clamp(F.get(q, y * width) + F.get(q, x) - F.get(q, F.lit(0)))

    return df.select(key, F.posexplode(B.build(width * width, at)).alias("i", "p"))


def psnr(pairs: DataFrame, key: str = "vec_id") -> DataFrame:
    """Peak signal-to-noise ratio of arrays ``a`` and ``b``; 100 if they are alike."""
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)
    mse = square / F.size("a")
    return pairs.select(key, F.round(F.when(mse < 1e-10, F.lit(100.0)).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt(mse))), 6).alias("psnr"))


def ssim(pairs: DataFrame, key: str = "vec_id") -> DataFrame:
    """Structural similarity over whole blocks, k1 = 0.01 and k2 = 0.04."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    n = F.size("a").cast("double")
    ma, mb = total(F.col("a")) / n, total(F.col("b")) / n
    va = total(F.transform("a", lambda x: x * x)) / n - ma * ma
    vb = total(F.transform("b", lambda x: x * x)) / n - mb * mb
    cov = total(F.zip_with("a", "b", lambda x, y: x * y)) / n - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.04 * 255) ** 2
    return pairs.select(key, F.round((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), 6).alias("ssim"))
