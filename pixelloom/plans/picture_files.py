"""Registered queries over picture files.

Every vector's 64 samples become a picture of 1, 2, 4 .. 32 columns. The files around them are put
together here, byte by byte with built-in functions, so that nothing of the readers is used to
write what they read. The oracles state the pictures, headers, chunks and boxes relationally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..sources import images
from .catalogue import _PX, _blocks, query

def _w() -> Column:
    return F.col("w")


def _h() -> Column:
    return F.col("h")


def _arr(*values: int | Column) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, int) else v for v in values])


def _text(raw: bytes) -> Column:
    return _arr(*raw)


def _le(value: int | Column, size: int) -> Column:
    """The bytes of a number, lowest first."""
    value = F.lit(value) if isinstance(value, int) else value
    return _arr(*[F.shiftright(value, 8 * k).bitwiseAND(255) for k in range(size)])


def _be(value: int | Column, size: int) -> Column:
    return F.reverse(_le(value, size))


def _zeros(n: int) -> Column:
    return _arr(*[0] * n)


def _binary(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _lines(samples: str, channels: int = 1) -> Column:
    """The bytes of each line, top line first."""
    return B.let(F.col(samples), lambda s: F.transform(F.sequence(F.lit(0), _h() - 1), lambda y: F.slice(s, y * _w() * channels + 1, _w() * channels)))


def _padded(lines: Column) -> Column:
    """Lines filled up to four bytes, bottom line first."""
    return F.flatten(F.transform(F.reverse(lines), lambda b: F.concat(b, F.array_repeat(F.lit(0), F.pmod(-F.size(b), F.lit(4))))))


def _pictures(spark, sf_dir) -> DataFrame:
    """Samples, size, and the same as BGR and RGB: blue v, green 255 - v, red 7 v modulo 256."""
    w = F.get(_arr(1, 2, 4, 8, 16, 32), F.pmod("vec_id", F.lit(6)).cast("int"))
    out = _blocks(spark, sf_dir).select("vec_id", F.col("q").cast("array<int>").alias("q"), w.alias("w"))
    out = out.withColumn("h", (F.lit(64) / _w()).cast("int"))
    red = lambda v: F.pmod(v * 7, F.lit(256))
    bgr = F.flatten(F.transform("q", lambda v: F.array(v, 255 - v, red(v))))
    rgb = F.flatten(F.transform("q", lambda v: F.array(red(v), 255 - v, v)))
    return out.withColumns({"bgr": bgr, "rgb": rgb})


def _dib(height: Column, bits: int, compression: int = 0) -> Column:
    return F.concat(_le(40, 4), _le(_w(), 4), _le(height, 4), _le(1, 2), _le(bits, 2), _le(compression, 4), _zeros(20))


def _bmp(rows: DataFrame) -> Column:
    stride = F.ceil(_w() * 3 / 4).cast("int") * 4
    return _binary(F.concat(_text(b"BM"), _le(_h() * stride + 54, 4), _zeros(4), _le(54, 4), _dib(_h(), 24), _padded(_lines("bgr", 3))))


def _bmp_rle(rows: DataFrame) -> Column:
    """Eight bits with a palette; lines of four samples or more as they are, others as runs of one."""
    run = lambda b: F.flatten(F.transform(b, lambda v: F.array(F.lit(1), v)))
    plain = lambda b: F.concat(F.array(F.lit(0), F.size(b)), b)
    body = F.flatten(F.transform(F.reverse(_lines("q")), lambda b: F.concat(F.when(_w() >= 4, plain(b)).otherwise(run(b)), _zeros(2))))
    palette = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.array(k, 255 - k, F.pmod(k * 7, F.lit(256)), F.lit(0))))
    return _binary(F.concat(_text(b"BM"), _zeros(8), _le(1078, 4), _dib(_h(), 8, 1), palette, body, _arr(0, 1)))


def _tga(kind: int, descriptor: int) -> Column:
    return F.concat(_arr(0, 0, kind), _zeros(9), _le(_w(), 2), _le(_h(), 2), _arr(24, descriptor))


def _tga_raw(rows: DataFrame) -> Column:
    return _binary(F.concat(_tga(2, 0), F.flatten(F.reverse(_lines("bgr", 3)))))


def _tga_rle(rows: DataFrame) -> Column:
    """Even lines in one packet each, odd ones as runs of one; the top line first."""
    packet = lambda b: F.concat(F.array(_w() - 1), b)
    runs = lambda b: F.flatten(F.transform(F.sequence(F.lit(0), _w() - 1), lambda x: F.concat(_arr(128), F.slice(b, x * 3 + 1, 3))))
    return _binary(F.concat(_tga(10, 32), F.flatten(F.transform(_lines("bgr", 3), lambda b, y: F.when(y % 2 == 0, packet(b)).otherwise(runs(b))))))


def _pnm(rows: DataFrame) -> Column:
    return F.concat(F.encode(F.format_string("P6\n# two sizes\n%d %d\n255\n", _w(), _h()), "UTF-8"), _binary(F.col("rgb")))


def _pnm_text(rows: DataFrame) -> Column:
    return F.encode(F.concat(F.format_string("P3 %d %d 255\n", _w(), _h()), F.array_join("rgb", "\n")), "UTF-8")


def _tiff(packed: bool):
    def build(rows: DataFrame) -> Column:
        body = F.col("rgb")
        if packed:
            body = F.flatten(F.transform(_lines("rgb", 3), lambda b: F.concat(F.array(F.size(b) - 1), b)))
        n = F.lit(192) + (_h() if packed else 0)
        at = n + 8
        entries = [(256, 4, 1, _w()), (257, 4, 1, _h()), (258, 3, 3, at + 114), (259, 3, 1, 32773 if packed else 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 4, 1, _h()), (279, 4, 1, n)]
        table = [F.concat(_le(t, 2), _le(k, 2), _le(c, 4), _le(v, 4)) for t, k, c, v in entries]
        return _binary(F.concat(_text(b"II*\0"), _le(at, 4), body, _le(len(entries), 2), *table, _zeros(4), _le(8, 2), _le(8, 2), _le(8, 2)))

    return build


def _psd(rows: DataFrame) -> Column:
    planes = B.let(F.col("rgb"), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(s, i * 3 + c)))))
    return _binary(F.concat(_text(b"8BPS\0\1"), _zeros(6), _be(3, 2), _be(_h(), 4), _be(_w(), 4), _be(8, 2), _be(3, 2), _zeros(12), _zeros(2), planes))


def _ico(rows: DataFrame) -> Column:
    stride = F.ceil(_w() * 3 / 4).cast("int") * 4
    mask = F.array_repeat(F.lit(0), _h() * 4)
    return _binary(F.concat(_arr(0, 0, 1, 0, 1, 0), _arr(_w(), _h(), 0, 0, 1, 0, 24, 0), _le(_h() * (stride + 4) + 40, 4), _le(22, 4), _dib(_h() * 2, 24), _padded(_lines("bgr", 3)), mask))


def _gif(rows: DataFrame) -> Column:
    """Seven bits a sample: codes of eight bits, as no code is longer before 126 samples."""
    palette = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.array(F.pmod(k * 5, F.lit(256)), 255 - k, k * 2)))
    codes = F.concat(_arr(66, 128), F.transform("q", lambda v: F.shiftright(v, 1)), _arr(129, 0, 59))
    return _binary(F.concat(_text(b"GIF89a"), _le(_w(), 2), _le(_h(), 2), _arr(0x86, 0, 0), palette, _arr(44), _zeros(4), _le(_w(), 2), _le(_h(), 2), _arr(0, 7), codes))


def _chunk(kind: bytes, body: Column, spoilt: Column | None = None) -> Column:
    wrong = F.lit(0) if spoilt is None else spoilt.cast("int")

    def framed(body: Column) -> Column:
        named = F.concat(F.lit(kind), body)
        crc = F.crc32(named).bitwiseXOR(wrong.cast("bigint"))
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), named, F.unhex(F.lpad(F.hex(crc), 8, "0")))

    return B.let(body, framed)


def _png(rows: DataFrame, spoilt: Column | None = None) -> Column:
    """Lines of the first filter (differences from the pixel before) in one stored block."""
    less = lambda b: F.transform(b, lambda v, j: F.pmod(v - F.coalesce(F.get(b, j - 3), F.lit(0)), F.lit(256)))
    raw = F.flatten(F.transform(_lines("rgb", 3), lambda b: F.concat(_arr(1), less(b))))

    def block(raw: Column) -> Column:
        n = F.lit(192) + _h()
        total = F.aggregate(raw, F.lit(0), lambda a, v: a + v)
        weighed = F.aggregate(F.transform(raw, lambda v, j: v * (n - j)), F.lit(0), lambda a, v: a + v)
        checksum = F.concat(B.let(F.pmod(weighed + n, F.lit(65521)), lambda v: _be(v, 2)), B.let(F.pmod(total + 1, F.lit(65521)), lambda v: _be(v, 2)))
        return F.concat(_arr(0x78, 1, 1), _le(n, 2), _le(65535 - n, 2), raw, checksum)

    stored = B.let(raw, block)
    head = _binary(F.concat(_be(_w(), 4), _be(_h(), 4), _arr(8, 2, 0, 0, 0)))
    return F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), _chunk(b"IHDR", head), _chunk(b"tEXt", F.lit(b"Title\0block"), spoilt), _chunk(b"IDAT", _binary(stored)), _chunk(b"IEND", F.lit(b"")))


_WRITERS = {"bmp": _bmp, "bmp_rle8": _bmp_rle, "gif": _gif, "ico": _ico, "png": _png, "pnm": _pnm, "pnm_text": _pnm_text, "psd": _psd, "tga": _tga_raw, "tga_rle": _tga_rle, "tiff": _tiff(False), "tiff_packbits": _tiff(True)}


def _files(spark, sf_dir, kind: str) -> DataFrame:
    rows = _pictures(spark, sf_dir)
    return rows.select(F.col("vec_id").cast("string").alias("path"), _WRITERS[kind](rows).alias("content"))


_SIZED = f"{_PX}, sized AS (SELECT vec_id, (1 << (vec_id % 6))::INT AS w, (64 // (1 << (vec_id % 6)))::INT AS h, i, v FROM px)"
_PLACE = "vec_id, (i // w)::INT AS y, (i % w)::INT AS x"
_BGR = f"WITH {_SIZED} SELECT {_PLACE}, v::INT AS b, (255 - v)::INT AS g, (v * 7 % 256)::INT AS r FROM sized"
_GIF = f"WITH {_SIZED} SELECT {_PLACE}, (v // 2 * 2)::INT AS b, (255 - v // 2)::INT AS g, (v // 2 * 5 % 256)::INT AS r FROM sized"


def _reader(kind: str):
    def run(spark, sf_dir):
        found = images.explode_pixels(images.pixels(_files(spark, sf_dir, kind)))
        return found.select(F.col("path").cast("bigint").alias("vec_id"), "y", "x", "b", "g", "r")

    run.__name__ = f"read_{kind}"
    return run


for _kind in _WRITERS:
    query(_GIF if _kind == "gif" else _BGR)(_reader(_kind))

#: Bytes of a file of each kind around pictures of w by h.
_LENGTHS = {"bmp": "54 + h * ((3 * w + 3) // 4 * 4)", "bmp_rle8": "1080 + h * (2 + CASE WHEN w >= 4 THEN 2 + w ELSE 2 * w END)", "gif": "477", "ico": "62 + h * ((3 * w + 3) // 4 * 4 + 4)", "png": "91 + 192 + h", "pnm": "21 + length(w::VARCHAR) + length(h::VARCHAR) + 192", "psd": "232", "tga": "210", "tiff": "320", "tiff_packbits": "320 + h"}
_NAMES = {"bmp_rle8": "bmp", "tiff_packbits": "tiff"}


@query("WITH s AS (SELECT vec_id, (1 << (vec_id % 6))::INT AS w, (64 // (1 << (vec_id % 6)))::INT AS h FROM embeddings) " + " UNION ALL ".join(f"SELECT vec_id, '{k}' AS kind, ({n})::BIGINT AS length, '{_NAMES.get(k, k)}' AS format, w AS width, h AS height, 1 AS n_frames FROM s" for k, n in _LENGTHS.items()))
def file_headers(spark, sf_dir):
    """What the headers say of files of ten kinds."""
    rows = _pictures(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _WRITERS[k](rows).alias("content")) for k in _LENGTHS])
    every = rows.select("vec_id", F.explode(kinds).alias("f")).select(F.concat_ws("/", "f.kind", "vec_id").alias("path"), "f.content")
    part = F.split("path", "/")
    return images.metadata(every).select(part[1].cast("bigint").alias("vec_id"), part[0].alias("kind"), "length", "format", "width", "height", "n_frames")


@query("WITH s AS (SELECT vec_id, 64 // (1 << (vec_id % 6)) + 192 AS raw FROM embeddings), c AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS idx, unnest(['IHDR', 'tEXt', 'IDAT', 'IEND']) AS type, unnest([13, 11, 11 + raw, 0]) AS length FROM s) SELECT vec_id, idx::INT AS idx, type, length::BIGINT AS length, NOT (idx = 1 AND vec_id % 5 = 0) AS crc_ok FROM c")
def png_chunk_table(spark, sf_dir):
    """Chunks with their checksums, of which those of every fifth file's text are wrong."""
    rows = _pictures(spark, sf_dir)
    made = rows.select(F.col("vec_id").cast("string").alias("path"), _png(rows, F.pmod("vec_id", F.lit(5)) == 0).alias("content"))
    return images.chunks(made).select(F.col("path").cast("bigint").alias("vec_id"), "idx", "type", "length", "crc_ok")


@query(_BGR)
def transcode_png_to_bmp(spark, sf_dir):
    """PNG files written as BMP and read again."""
    written = images.encoded(images.pixels(_files(spark, sf_dir, "png")), "bmp").select("path", "content")
    return images.explode_pixels(images.pixels(written)).select(F.col("path").cast("bigint").alias("vec_id"), "y", "x", "b", "g", "r")


def _box(kind: bytes, *bodies: Column) -> Column:
    body = F.concat(*bodies)
    return F.concat(_be(F.size(body) + 8, 4), _text(kind), body)


@query("WITH s AS (SELECT vec_id FROM embeddings), b AS (SELECT vec_id, unnest([0, 1, 2, 3, 4, 5]) AS box_id, unnest([-1, -1, 1, 2, 3, -1]) AS parent_id, unnest([0, 0, 1, 2, 3, 0]) AS depth, unnest(['ftyp', 'meta', 'iprp', 'ipco', 'ispe', 'mdat']) AS type, unnest([0, 24, 36, 44, 52, 72]) AS pos, unnest([24, 48, 36, 28, 20, 8 + vec_id % 50]) AS size FROM s) SELECT vec_id, box_id::INT AS box_id, parent_id::INT AS parent_id, depth::INT AS depth, type, pos::BIGINT AS pos, size::BIGINT AS size FROM b")
def heif_box_tree(spark, sf_dir):
    """Boxes of HEIF files whose data box has another size in each."""
    full = _zeros(4)
    meta = _box(b"meta", full, _box(b"iprp", _box(b"ipco", _box(b"ispe", full, _be(_w(), 4), _be(_h(), 4)))))
    data = F.array_repeat(F.lit(7), F.pmod("vec_id", F.lit(50)).cast("int"))
    made = _pictures(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), _binary(F.concat(_box(b"ftyp", _text(b"heic\0\0\0\0mif1heic")), meta, _box(b"mdat", data))).alias("content"))
    return images.boxes(made).select(F.col("path").cast("bigint").alias("vec_id"), "box_id", "parent_id", "depth", "type", F.col("offset").alias("pos"), "size")
