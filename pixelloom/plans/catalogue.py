"""Registered queries of the image and signal operators, each with independent oracle SQL.

The engine side uses the operators; the oracle side states the same result relationally.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import image, signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Oracle building blocks: samples of every vector, long.
_PX = "px AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(i AS INT) // 8 AS y, CAST(i AS INT) % 8 AS x, CAST(least(255, greatest(0, floor(CAST(embedding[i + 1] AS DOUBLE) * 128 + 128))) AS BIGINT) AS v FROM embeddings, range(64) t(i))"


def _values(name: str, columns: str, rows: list) -> str:
    body = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_BASIS = _values("basis", "u, x, c", [(i // 8, i % 8, c) for i, c in enumerate(B.cosine_basis())])
_ZIGZAG = _values("zz", "z, i", list(enumerate(B.zigzag())))
_LUMA = _values("luma", "i, t", list(enumerate(image.LUMA_TABLE)))
_ROUND = "(({0}) + 4096) >> 13"
_DCT = f"l1 AS (SELECT vec_id, y, u, {_ROUND.format('sum(v * c)::BIGINT')} AS c1 FROM px JOIN basis USING (x) GROUP BY vec_id, y, u), dct AS (SELECT vec_id, b.u AS v, l1.u AS u, {_ROUND.format('sum(c1 * c)::BIGINT')} AS coef FROM l1 JOIN basis b ON l1.y = b.x GROUP BY vec_id, b.u, l1.u)"
_SHIFTED = "px AS (SELECT vec_id, i, y, x, v - 128 AS v FROM raw)"
_RAW = _PX.replace("px AS", "raw AS", 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", B.samples(F.col("embedding")).alias("q"))


def query(oracle: str | None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(f"WITH {_PX}, {_BASIS} SELECT vec_id, y AS line, u, {_ROUND.format('sum(v * c)::BIGINT')} AS coef FROM px JOIN basis USING (x) GROUP BY vec_id, y, u")
def block_dct8_1d(spark, sf_dir):
    return image.dct_lines(_blocks(spark, sf_dir))


@query(f"WITH {_PX}, {_BASIS}, {_DCT} SELECT vec_id, v, u, coef FROM dct")
def block_dct8x8(spark, sf_dir):
    return image.dct_blocks(_blocks(spark, sf_dir))


@query(f"WITH {_PX}, {_BASIS}, {_DCT} SELECT v, u, count(*) AS n, sum(coef * coef)::BIGINT AS energy FROM dct GROUP BY v, u")
def dct8x8_energy(spark, sf_dir):
    return image.energy(image.dct_blocks(_blocks(spark, sf_dir)))


@query(f"WITH {_PX}, {_BASIS}, {_DCT}, i1 AS (SELECT vec_id, dct.u, b.x AS y, {_ROUND.format('sum(coef * c)::BIGINT')} AS c1 FROM dct JOIN basis b ON dct.v = b.u GROUP BY vec_id, dct.u, b.x), back AS (SELECT vec_id, y, b.x, {_ROUND.format('sum(c1 * c)::BIGINT')} AS w FROM i1 JOIN basis b ON i1.u = b.u GROUP BY vec_id, y, b.x) SELECT vec_id, max(abs(w - v))::INT AS max_error FROM back JOIN px USING (vec_id, y, x) GROUP BY vec_id")
def block_idct8x8_roundtrip(spark, sf_dir):
    return image.roundtrip_error(_blocks(spark, sf_dir))


def _wide(name: str, source: str, line: str, place: str, value: str) -> str:
    return f"{name} AS (SELECT vec_id, {line} AS l, " + ", ".join(f"max(CASE WHEN {place} = {k} THEN {value} END) AS v{k}" for k in range(4)) + f" FROM {source} GROUP BY vec_id, {line})"


def _long(name: str, source: str, outs: list[str], out: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT vec_id, l, {k} AS p, {e} AS {out} FROM {source}" for k, e in enumerate(outs)) + ")"


def _all4(spark, sf_dir, kind) -> DataFrame:
    return image.transform4(_blocks(spark, sf_dir), kind).withColumn("out", F.col("out").cast("long"))


def _all4_sql(steps: list[str], last: list[str]) -> str:
    place = "p AS (SELECT vec_id * 4 + i // 16 AS vec_id, i % 16 // 4 AS y, i % 4 AS x, v - 128 AS v FROM px)"
    return f"WITH {_PX}, {place}, {_wide('a', 'p', 'x', 'y', 'v')}, {_long('b', 'a', steps, 'w')}, {_wide('c', 'b', 'p', 'l', 'w')}, {_long('d', 'c', last, 'o')} SELECT vec_id // 4 AS vec_id, (vec_id % 4)::INT AS block, (l * 4 + p)::INT AS i, o::BIGINT AS out FROM d"


_WHT = ["v0 + v3 + v1 + v2", "v1 - v2 + v0 - v3", "v0 + v3 - v1 - v2", "v0 - v3 - v1 + v2"]


_DST = [[29, 74, 84, 55], [55, 74, -29, -84], [74, 0, -74, 74], [84, -74, 55, -29]]


def _dst(shift: int) -> list[str]:
    return [f"({' + '.join(f'v{k} * ({m})' for k, m in enumerate(row))} + {1 << (shift - 1)}) >> {shift}" for row in _DST]


def _m1(v: str) -> str:
    return f"({v} + (({v} * 20091) >> 16))"


def _m2(v: str) -> str:
    return f"(({v} * 35468) >> 16)"


_VP8 = [f"v0 + v2 + {_m1('v1')} + {_m2('v3')}", f"v0 - v2 + {_m2('v1')} - {_m1('v3')}", f"v0 - v2 - {_m2('v1')} + {_m1('v3')}", f"v0 + v2 - {_m1('v1')} - {_m2('v3')}"]


@query(_all4_sql(_WHT, [f"({e} + 3) >> 3" for e in _WHT]))
def iwht4x4_blocks(spark, sf_dir):
    return _all4(spark, sf_dir, image.inverse_wht4)


@query(_all4_sql(_dst(7), _dst(12)))
def idst4x4_blocks(spark, sf_dir):
    return _all4(spark, sf_dir, image.inverse_dst4)


@query(_all4_sql(_VP8, [f"({e} + 4) >> 3" for e in _VP8]))
def idct4x4_vp8_blocks(spark, sf_dir):
    return _all4(spark, sf_dir, image.vp8_idct4)


@query(f"WITH {_PX}, {_ZIGZAG} SELECT vec_id, z, v::INT AS v FROM px JOIN zz USING (i)")
def zigzag_scan(spark, sf_dir):
    return image.scan_zigzag(_blocks(spark, sf_dir))


_LEVELS = f"{_RAW}, {_SHIFTED}, {_BASIS}, {_DCT}, {_LUMA}, lv AS (SELECT vec_id, (v * 8 + u)::INT AS i, coef, t, floor(coef / t::DOUBLE + 0.5)::BIGINT AS level FROM dct JOIN luma ON luma.i = v * 8 + u)"


@query(f"WITH {_LEVELS}, {_ZIGZAG} SELECT vec_id, max(CASE WHEN level <> 0 THEN z ELSE -1 END)::INT AS last FROM lv JOIN zz USING (i) GROUP BY vec_id")
def last_nonzero(spark, sf_dir):
    return image.last_nonzero(_blocks(spark, sf_dir))


@query(f"WITH {_LEVELS} SELECT vec_id, i, coef, level, level * t AS restored FROM lv")
def quantize_dequantize(spark, sf_dir):
    return image.quantised(_blocks(spark, sf_dir))


_PLANES = f"{_PX}, pl AS (SELECT vec_id // 3 AS pic, i, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS p0, max(CASE WHEN vec_id % 3 = 1 THEN v END) AS p1, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS p2 FROM px GROUP BY vec_id // 3, i HAVING count(*) = 3)"


def _planes(spark, sf_dir) -> DataFrame:
    return image.planes(_blocks(spark, sf_dir))


def _named(columns, names: str) -> list:
    return [c.alias(n) for c, n in zip(columns, names, strict=True)]


@query(f"WITH {_PLANES} SELECT pic, i, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, p0 + 2.128::DOUBLE * (p1 - 128))))::INT AS b, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, p0 - 0.215::DOUBLE * (p1 - 128) - 0.381::DOUBLE * (p2 - 128))))::INT AS g, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, p0 + 1.28::DOUBLE * (p2 - 128))))::INT AS r FROM pl")
def yuv_to_bgr(spark, sf_dir):
    return _planes(spark, sf_dir).select("pic", "i", *_named(image.yuv_to_bgr(F.col("p0"), F.col("p1"), F.col("p2")), "bgr"))


@query(f"WITH {_PLANES} SELECT pic, i, (floor((299 * p2 + 587 * p1 + 114 * p0) / 1000) - 128)::INT AS y, floor((-169 * p2 - 331 * p1 + 500 * p0) / 1000)::INT AS u, floor((500 * p2 - 419 * p1 - 81 * p0) / 1000)::INT AS v FROM pl")
def bgr_to_yuv(spark, sf_dir):
    return _planes(spark, sf_dir).select("pic", "i", *_named(image.bgr_to_yuv(F.col("p0"), F.col("p1"), F.col("p2")), "yuv"))


@query(f"WITH {_PLANES}, m AS (SELECT *, greatest(p0, p1, p2) AS t, least(p0, p1, p2) AS w FROM pl), h AS (SELECT *, CASE WHEN t = w THEN 0.0 WHEN t = p2 THEN 60 * (p1 - p0) / (t - w)::DOUBLE WHEN t = p1 THEN 120 + 60 * (p0 - p2) / (t - w)::DOUBLE ELSE 240 + 60 * (p2 - p1) / (t - w)::DOUBLE END AS a FROM m) SELECT pic, i, floor(CASE WHEN a < 0 THEN a + 360 ELSE a END)::INT AS h, CASE WHEN t = 0 THEN 0 ELSE floor(255 * (t - w)::DOUBLE / t)::INT END AS s, t::INT AS v FROM h")
def bgr_to_hsv(spark, sf_dir):
    return _planes(spark, sf_dir).select("pic", "i", *_named(image.bgr_to_hsv(F.col("p0"), F.col("p1"), F.col("p2")), "hsv"))


@query(f"WITH {_PX} SELECT vec_id, i, v::INT AS b, v::INT AS g, v::INT AS r, v::INT AS a FROM px")
def yuv400_to_grey(spark, sf_dir):
    return image.long_form(_blocks(spark, sf_dir), "vec_id", "q").select("vec_id", "i", *[F.col("v").alias(c) for c in "bgra"])


@query(f"WITH {_PX} SELECT vec_id, (y // 2)::INT AS y, (x // 2)::INT AS x, ((sum(v)::BIGINT + 2) >> 2)::INT AS v FROM px GROUP BY vec_id, y // 2, x // 2")
def chroma_subsample(spark, sf_dir):
    return image.subsample(_blocks(spark, sf_dir))


@query(f"WITH {_PX}, g AS (SELECT yy::INT AS y, xx::INT AS x, (yy // 2) * 4 + xx // 2 AS i FROM range(8) a(yy), range(8) b(xx)) SELECT vec_id, g.y, g.x, v::INT AS v FROM px JOIN g ON px.i = g.i")
def chroma_upsample(spark, sf_dir):
    return image.upsample(_blocks(spark, sf_dir))


@query(f"WITH {_PX}, pairs AS (SELECT vec_id // 2 * 2 AS vec_id, i, max(CASE WHEN vec_id % 2 = 0 THEN v END) AS f, max(CASE WHEN vec_id % 2 = 1 THEN v END) AS b FROM px GROUP BY vec_id // 2, i HAVING count(*) = 2) SELECT vec_id, i, floor((f * b + (255 - b) * b) / 255.0::DOUBLE)::INT AS v FROM pairs")
def alpha_blend(spark, sf_dir):
    pairs = _blocks(spark, sf_dir).groupBy((F.col("vec_id") - F.pmod("vec_id", F.lit(2))).alias("vec_id")).agg(*[F.max(F.when(F.pmod("vec_id", F.lit(2)) == k, F.col("q"))).alias(n) for k, n in enumerate("fb")]).where("f IS NOT NULL AND b IS NOT NULL")
    return pairs.select("vec_id", F.posexplode(F.zip_with("f", "b", image.alpha_blend)).alias("i", "v"))


def _quality(spark, sf_dir) -> DataFrame:
    return _blocks(spark, sf_dir).select("vec_id", F.col("q").alias("a"), F.transform("q", lambda v: F.floor(v / 16).cast("int") * 16 + 8).alias("b"))


_PAIRS = f"{_PX}, pr AS (SELECT vec_id, v AS a, v // 16 * 16 + 8 AS b FROM px)"


@query(f"WITH {_PAIRS}, e AS (SELECT vec_id, sum((a - b) * (a - b)) / 64.0::DOUBLE AS mse FROM pr GROUP BY vec_id) SELECT vec_id, round(CASE WHEN mse < 1e-10 THEN 100.0 ELSE 20 * log10(255.0::DOUBLE / sqrt(mse)) END, 6) AS psnr FROM e")
def psnr_pairs(spark, sf_dir):
    return image.psnr(_quality(spark, sf_dir))


@query(f"WITH {_PAIRS}, s AS (SELECT vec_id, sum(a) / 64.0::DOUBLE AS ma, sum(b) / 64.0::DOUBLE AS mb, sum(a * a) / 64.0::DOUBLE AS aa, sum(b * b) / 64.0::DOUBLE AS bb, sum(a * b) / 64.0::DOUBLE AS ab FROM pr GROUP BY vec_id) SELECT vec_id, round((2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab - ma * mb) + 104.04::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (aa - ma * ma + bb - mb * mb + 104.04::DOUBLE)), 6) AS ssim FROM s")
def ssim_global(spark, sf_dir):
    return image.ssim(_quality(spark, sf_dir))


@query("WITH r AS (SELECT lang, sum(strlen(text)) AS raw_bytes, sum(length(text)) AS signs FROM documents GROUP BY lang) SELECT lang, raw_bytes::BIGINT AS raw_bytes, signs::BIGINT AS coded_bytes, round(raw_bytes / signs::DOUBLE, 6) AS ratio FROM r")
def compression_ratio(spark, sf_dir):
    sums = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("raw_bytes"), F.sum(F.length("text")).alias("coded_bytes"))
    return sums.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("coded_bytes"), 6))


@query("WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents), b AS (SELECT unnest(regexp_extract_all(x, '..')) AS p FROM h), c AS (SELECT ('0x' || p)::INT AS b, count(*) AS n FROM b GROUP BY 1) SELECT b, n, row_number() OVER (ORDER BY n DESC, b)::INT AS rank FROM c")
def byte_histogram(spark, sf_dir):
    return signal.byte_histogram(_table(spark, sf_dir, "documents"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2) SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1")
def entropy_per_document(spark, sf_dir):
    return signal.character_entropy(_table(spark, sf_dir, "documents"))


_LENGTHS = "ln AS (SELECT n_nationkey AS k, least(7, 3 + n_nationkey // 4) AS len FROM nation WHERE n_nationkey < 20)"


@query("WITH ln AS (SELECT n_nationkey AS k, least(8, 3 + n_nationkey // 4) AS len FROM nation), t AS (SELECT *, max(len) OVER () AS top FROM ln), s AS (SELECT k, len, top, coalesce(sum(1::BIGINT << (top - len)) OVER (ORDER BY len, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t) SELECT k, len, before >> (top - len) AS code FROM s")
def canonical_huffman_codes_all(spark, sf_dir):
    """Canonical codes of every nation: lengths of 3 to 8 bits satisfy Kraft's sum for 25."""
    keys = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.least(F.lit(8), 3 + F.floor(F.col("n_nationkey") / 4)).cast("int").alias("len"))
    return signal.kraft_codes(keys, "k", "len")


@query("WITH h AS (SELECT lang, ('0x' || p)::INT AS b, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS p FROM documents) GROUP BY 1, 2) SELECT lang, count(*) AS symbols, sum(n)::BIGINT AS bytes FROM h GROUP BY 1")
def huffman_alphabets_whole(spark, sf_dir):
    """Distinct and all bytes of each language's whole texts."""
    return signal.alphabets(_table(spark, sf_dir, "documents"), "lang")


@query(None)
def huffman_code_tables(spark, sf_dir):
    """Whole-text code tables of each language: the greedy merge is no SQL."""
    all_ = _table(spark, sf_dir, "documents").select("lang", F.explode(signal.text_bytes(F.col("text"))).alias("b"))
    return signal.canonical_codes(signal.huffman_lengths(all_.groupBy("lang", "b").agg(F.count("*").alias("n")), "lang"), "lang")


_RUNS = "m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), runs AS (SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM g GROUP BY 1, 2, 3)"


@query(f"WITH {_RUNS} SELECT user_id, run, event_type, n FROM runs")
def rle_encode_events(spark, sf_dir):
    return signal.run_lengths(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {_RUNS} SELECT user_id, run, unnest(range(1, n + 1))::INT AS place, event_type FROM runs")
def rle_decode_expand(spark, sf_dir):
    return signal.expand_runs(rle_encode_events(spark, sf_dir), "user_id", "event_type")


def _cents(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))


_CENTS = "c AS (SELECT event_id, user_id, ts, round(value * 100)::BIGINT AS cents FROM events)"


@query(f"WITH {_CENTS} SELECT event_id, cents - coalesce(lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS diff FROM c")
def dpcm_encode(spark, sf_dir):
    return signal.differences(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "cents").select("event_id", "diff")


@query(f"WITH {_CENTS} SELECT event_id, cents AS value FROM c")
def dpcm_decode(spark, sf_dir):
    coded = signal.differences(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "cents").drop("cents")
    return signal.restored(coded, "user_id", ["ts", "event_id"]).select("event_id", F.col("value_").alias("value"))


@query(f"WITH {_CENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS part FROM c) SELECT event_id, cents - coalesce(lag(cents) OVER (PARTITION BY user_id, part ORDER BY ts, event_id), 0) AS diff FROM n")
def dpcm_restart(spark, sf_dir):
    return signal.differences(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "cents", restart=8).select("event_id", "diff")


_NEAR = f"{_PX}, nb AS (SELECT vec_id, i, v, CASE WHEN x > 0 THEN lag(v, 1) OVER w ELSE 0 END AS a, CASE WHEN y > 0 THEN lag(v, 8) OVER w ELSE 0 END AS b, CASE WHEN x > 0 AND y > 0 THEN lag(v, 9) OVER w ELSE 0 END AS c FROM px WINDOW w AS (PARTITION BY vec_id ORDER BY i))"


def _filter_sql(guess: str) -> str:
    return f"WITH {_NEAR} SELECT vec_id, i, ((v - ({guess}) + 512) % 256)::INT AS f FROM nb"


@query(_filter_sql("a"))
def png_filter_sub(spark, sf_dir):
    return image.png_filter(_blocks(spark, sf_dir), "sub")


@query(_filter_sql("b"))
def png_filter_up(spark, sf_dir):
    return image.png_filter(_blocks(spark, sf_dir), "up")


@query(_filter_sql("(a + b) // 2"))
def png_filter_avg(spark, sf_dir):
    return image.png_filter(_blocks(spark, sf_dir), "avg")


@query(_filter_sql("CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"))
def png_filter_paeth(spark, sf_dir):
    return image.png_filter(_blocks(spark, sf_dir), "paeth")


def _unfilter(kind: str):
    def run(spark, sf_dir):
        filtered = image.png_filter(_blocks(spark, sf_dir), kind).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda s: s["f"].cast("int")).alias("f"))
        return image.png_unfilter(filtered, kind)

    run.__name__ = f"png_unfilter_{kind}"
    return run


for _kind in ("sub", "up", "avg", "paeth"):
    query(f"WITH {_PX} SELECT vec_id, i, v::INT AS v FROM px")(_unfilter(_kind))


@query(f"WITH {_PX} SELECT vec_id, i, (sum(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) % 256)::INT AS v FROM px")
def tiff_predictor2(spark, sf_dir):
    return image.tiff_predictor(_blocks(spark, sf_dir))


@query(f"WITH {_PX} SELECT vec_id, ((sum(CASE WHEN y = 0 THEN v ELSE 0 END) + sum(CASE WHEN x = 0 THEN v ELSE 0 END) + 8)::BIGINT >> 4)::INT AS dc FROM px GROUP BY vec_id")
def dc_pred_mean(spark, sf_dir):
    return image.dc_prediction(_blocks(spark, sf_dir))


@query(f"WITH {_PX} SELECT vec_id, i, greatest(0, least(255, max(CASE WHEN x = 0 THEN v END) OVER (PARTITION BY vec_id, y) + max(CASE WHEN y = 0 THEN v END) OVER (PARTITION BY vec_id, x) - max(CASE WHEN i = 0 THEN v END) OVER (PARTITION BY vec_id)))::INT AS p FROM px")
def true_motion_prediction(spark, sf_dir):
    return image.true_motion(_blocks(spark, sf_dir))


_COLOURS = [(i * 5 % 256, i * 3 % 256, 255 - i * 5 % 256) for i in range(50)]


@query(f"WITH {_values('pal', 'idx, b, g, r', [(i, *c) for i, c in enumerate(_COLOURS)])} SELECT p_partkey, b, g, r FROM part JOIN pal ON idx = p_size - 1")
def palette_lookup(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 1).alias("idx"))
    return signal.lookup(parts, signal.palette(spark, _COLOURS), "idx").select("p_partkey", "b", "g", "r")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_image_select(spark, sf_dir):
    return signal.best_of(_table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, l_linenumber, l_quantity, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def item_property_join(spark, sf_dir):
    items, extents, properties = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    located = extents.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity").join(items.select("o_orderkey"), "o_orderkey")
    return located.join(properties.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey", "left").select("o_orderkey", "l_linenumber", "l_quantity", "p_type")


@query("SELECT a.l_orderkey AS item, a.l_partkey AS from_part, b.l_partkey AS to_part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber > 1")
def item_reference_edges(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), "l_partkey", "l_linenumber")
    primary = lines.where("l_linenumber = 1").select("item", F.col("l_partkey").alias("from_part"))
    return lines.where("l_linenumber > 1").join(primary, "item").select("item", "from_part", F.col("l_partkey").alias("to_part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM lineitem")
def extent_offsets(spark, sf_dir):
    sizes = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    return signal.running_offsets(sizes, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "size").select("l_orderkey", "l_linenumber", "l_partkey", "offset")


@query("WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents) SELECT kind, id, CASE WHEN substr(t, 1, 2) = 'BM' THEN 'bmp' WHEN substr(t, 1, 3) = 'GIF' THEN 'gif' WHEN regexp_matches(substr(t, 1, 2), '^P[1-7]') THEN 'pnm' WHEN lower(substr(t, 1, 9)) = '<!doctype' OR substr(t, 1, 5) = '<?xml' THEN 'markup' ELSE 'unknown' END AS format FROM t")
def magic_probe(spark, sf_dir):
    both = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t")).union(_table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", "text"))
    t = F.col("t")
    found = F.when(t.startswith("BM"), "bmp").when(t.startswith("GIF"), "gif").when(F.substring(t, 1, 2).rlike("^P[1-7]"), "pnm").when((F.lower(F.substring(t, 1, 9)) == "<!doctype") | t.startswith("<?xml"), "markup").otherwise("unknown")
    return both.select("kind", "id", found.alias("format"))


@query("SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def xml_tags(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(F.explode(signal.xml_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT attribute, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '([a-zA-Z-]+=\"[^\"]*\")', 1)) AS attribute FROM pages) GROUP BY attribute")
def xml_attributes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(F.explode(signal.xml_attributes(F.col("html"))).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INT AS n_ints, coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0)::BIGINT AS n_digits FROM documents")
def tokenise_ints(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_ints"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_digits"))


@query("SELECT doc_id, length(regexp_replace(text, '#[^\\n]*', '', 'g'))::BIGINT AS n_left FROM documents")
def strip_comments(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", "#[^\n]*", "")).cast("long").alias("n_left"))


@query("SELECT o_orderkey, (2 * (length(bin(o_orderkey + 1)) - 1) + 1)::INT AS ue_bits, (2 * (length(bin((CASE WHEN o_orderkey % 2 = 0 THEN 2 * o_orderkey ELSE 2 * o_orderkey - 1 END) + 1)) - 1) + 1)::INT AS se_bits FROM orders")
def exp_golomb_length(spark, sf_dir):
    k = F.col("o_orderkey")
    signed = F.when(k % 2 == 0, -k).otherwise(k)
    return _table(spark, sf_dir, "orders").select("o_orderkey", signal.exp_golomb_length(k).cast("int").alias("ue_bits"), signal.exp_golomb_length(signal.signed_golomb(signed)).cast("int").alias("se_bits"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) < 1 THEN 0 ELSE length(bin(abs(trunc(c_acctbal)::BIGINT))) END::INT AS bits FROM customer")
def vlc_category_all(spark, sf_dir):
    """Magnitude categories of all balances, category 0 too."""
    return _table(spark, sf_dir, "customer").select("c_custkey", signal.magnitude_category(F.col("c_acctbal").cast("long")).cast("int").alias("bits"))


@query("SELECT o_orderkey, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::INT AS n_bytes FROM orders")
def leb128_length(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", signal.leb128_length(F.col("o_orderkey")).alias("n_bytes"))


@query("SELECT o_orderkey, (length(bin(o_orderkey)) - 1)::INT AS log2_floor, (CASE WHEN o_orderkey <= 1 THEN 0 ELSE length(bin(o_orderkey - 1)) END)::INT AS log2_ceil, ((o_orderkey + 6) // 7)::BIGINT AS div_up FROM orders WHERE o_orderkey > 0")
def integer_logs(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", signal.log2_floor(k).cast("int").alias("log2_floor"), signal.log2_ceil(k).cast("int").alias("log2_ceil"), F.floor((k + 6) / 7).alias("div_up"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 15)::BIGINT AS low, ((l_partkey >> 4) & 15)::BIGINT AS high, ((l_partkey >> 7) & 1)::BIGINT AS top FROM lineitem")
def bitfield_unpack(spark, sf_dir):
    k = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", k.bitwiseAND(15).alias("low"), F.shiftright(k, 4).bitwiseAND(15).alias("high"), F.shiftright(k, 7).bitwiseAND(1).alias("top"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey & 31) << 3)::BIGINT AS b, (((l_partkey >> 5) & 31) << 3)::BIGINT AS g, (((l_partkey >> 10) & 31) << 3)::BIGINT AS r FROM lineitem")
def rgb555_unpack(spark, sf_dir):
    k = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.shiftleft(F.shiftright(k, s).bitwiseAND(31), 3).alias(n) for n, s in (("b", 0), ("g", 5), ("r", 10))])


@query("SELECT o_orderkey, round((o_orderkey >> 16) + (o_orderkey & 65535) / 65535.0::DOUBLE, 9) AS fixed FROM orders")
def fix16_16(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.shiftright(k, 16) + k.bitwiseAND(65535) / F.lit(65535.0), 9).alias("fixed"))


@query("SELECT c_custkey, least(255, greatest(0, floor(c_acctbal / 10)))::INT AS clamped, least(500, greatest(-500, floor(c_acctbal)))::INT AS clipped FROM customer")
def clamp_clip3(spark, sf_dir):
    v = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", B.clamp(F.floor(v / 10)).cast("int").alias("clamped"), B.clamp(F.floor(v), -500, 500).cast("int").alias("clipped"))


@query(f"WITH {_PX} SELECT vec_id, i, round(CASE WHEN v / 255.0::DOUBLE <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * (v / 255.0::DOUBLE) ELSE 1.055::DOUBLE * pow(v / 255.0::DOUBLE, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 6) AS s FROM px")
def srgb_curve(spark, sf_dir):
    x = F.col("v") / F.lit(255.0)
    curve = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return image.long_form(_blocks(spark, sf_dir), "vec_id", "q").select("vec_id", "i", F.round(curve, 6).alias("s"))


@query("WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS p FROM documents), l AS (SELECT doc_id, len(p) AS n, unnest(list_transform(p, lambda x: ('0x' || x)::BIGINT)) AS v, unnest(range(len(p))) AS k FROM b WHERE len(p) > 0) SELECT doc_id, (((max(n) + sum((n - k) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM l GROUP BY doc_id UNION ALL SELECT doc_id, CASE WHEN p IS NOT NULL THEN 1 END FROM b WHERE coalesce(len(p), 0) = 0")
def adler32_all(spark, sf_dir):
    """Adler-32 of every text; that of an empty one is 1."""
    return _table(spark, sf_dir, "documents").select("doc_id", signal.adler32(F.col("text")).alias("adler"))


@query(None)
def crc32_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


@query("SELECT user_id, event_id, slot FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS slot FROM events) WHERE slot <= 63")
def bounded_queue(spark, sf_dir):
    return signal.bounded_queue(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "slot")


@query("WITH k AS (SELECT o_orderkey, o_orderkey // 4096 AS picture, (o_orderkey % 64)::INT AS x, ((o_orderkey // 64) % 64)::INT AS y FROM orders) SELECT o_orderkey, picture, row_number() OVER (PARTITION BY picture ORDER BY y // 16, x // 16, y, x, o_orderkey)::BIGINT - 1 AS address FROM k")
def tile_scan_address_pictures(spark, sf_dir):
    """Tile scan addresses of every order: each 4096 keys are a picture of 64x64 blocks with addresses of its own."""
    return signal.tile_scan(_table(spark, sf_dir, "orders"), "o_orderkey")
