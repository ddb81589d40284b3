"""Operators and queries take whole texts, vectors and tables."""

from pixelloom.operators import image, signal
from pixelloom.plans import catalogue


def test_alphabets_count_bytes_after_the_twentieth_character(spark):
    df = spark.createDataFrame([("en", "a" * 20 + "bcé"), ("en", "a"), ("de", ""), ("de", None), ("es", "ñ" * 30)], "lang string, text string")
    assert {tuple(r) for r in signal.alphabets(df, "lang").collect()} == {("en", 5, 25), ("es", 2, 60)}


def test_alphabets_query_reads_every_byte(spark):
    sf = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    assert sum(r.bytes for r in catalogue.QUERIES["huffman_alphabets_whole"](spark, sf).collect()) == total


def test_every_block_of_a_vector_is_transformed(spark):
    flat = [128 + 8 * k for k in range(4) for _ in range(16)]
    df = spark.createDataFrame([(1, flat), (2, flat[16:32]), (3, flat[:16] + [136]), (4, []), (5, None)], "vec_id long, q array<int>")
    got = {}
    for r in image.transform4(df, image.vp8_idct4).collect():
        got.setdefault((r.vec_id, r.block), {})[r.i] = r.out
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0), (3, 1)} and all(len(x) == 16 for x in got.values())
    assert got[1, 1] == got[2, 0] and got[1, 0] == got[3, 0] and set(got[1, 0].values()) == {0}
    assert got[1, 3] != got[1, 1] and set(got[3, 1].values()) == {1}


def test_blocks_queries_give_every_sample(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    for name in ("iwht4x4_blocks", "idst4x4_blocks", "idct4x4_vp8_blocks"):
        assert catalogue.QUERIES[name](spark, sf).count() == n


def test_every_order_has_an_address(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, 16, 64, 4095, 4096, 4097, 10**10)], "k long")
    got = {r.k: (r.picture, r.address) for r in signal.tile_scan(df, "k").collect()}
    assert got == {0: (0, 0), 1: (0, 1), 64: (0, 2), 16: (0, 3), 4095: (0, 4), 4096: (1, 0), 4097: (1, 1), 10**10: (10**10 // 4096, 0)}


def test_filters_leave_no_row_out(spark, tmp_path):
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put([(1, 0.6), (2, -0.4), (3, 0.0), (4, -1.5), (5, 700.0)], "c_custkey long, c_acctbal double", "customer")
    put([(1, ""), (2, "a"), (3, None)], "doc_id long, text string", "documents")
    put([(k,) for k in range(25)], "n_nationkey int", "nation")
    rows = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("vlc_category_all") == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 10)}
    assert rows("adler32_all") == {(1, 1), (2, 98 * 65536 + 98), (3, None)}
    codes = rows("canonical_huffman_codes_all")
    assert len(codes) == 25 and sum(2.0**-n for _, n, _ in codes) <= 1
    bits = [f"{c:0{n}b}" for _, n, c in codes]
    assert all(len(b) == n for b, (_, n, _) in zip(bits, codes, strict=True)) and not any(a != b and b.startswith(a) for a in bits for b in bits)
