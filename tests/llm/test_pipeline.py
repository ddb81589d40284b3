"""The pipeline's stages against plain Python on a small table."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pixelloom.llm.common import stage

from .test_jaccard_join import brute
from .test_native import brute_hits


def test_stages(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    rows = []
    for i in range(400):
        w = [word() for _ in range(r.choice([8, 40, 90]))]
        if i % 9 == 0:
            w[3:3] = ["scum", "idiot", "moron"]
        rows.append([i, " ".join(w), "en", "src%d" % (i % 3), 0])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((4, 12, 30))]
    for i, (_, t) in zip((10, 20, 40), items):
        rows[i][1] += " " + t
    rows[50][1] = rows[49][1]
    rows[52][1] = rows[51][1] + " one two"
    rows += [[500, None, None, None, None], [501, "", "en", "src0", 0], [7, rows[7][1], "en", "src1", 0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(x) for x in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, step in cp.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([(x.doc_id, x.text) for x in docs.collect()])
    calm, alone, clean, mixed = seen
    assert {k for k, _ in calm} == {x[0] for x in rows if x[0] % 9 or x[0] >= 400}
    keep = {k for k, _, c in brute(calm, k=5, percent=80) if k == c}
    assert sorted(k for k, _ in alone) == sorted(keep)
    dirty = {k for k, _, n, _, _ in brute_hits(alone, items) if n}
    assert {k for k, _ in clean} == keep - dirty and dirty
    assert {k for k, _ in mixed} <= {k for k, _ in clean} and max(np.unique([k for k, _ in mixed], return_counts=True)[1]) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for x in sorted(cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), key=lambda x: (x.doc_id, x.start)):
        ids = [*library.encode(dict(mixed)[x.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(x.doc_id for x in cp.run(spark, str(tmp_path)).collect()) == sorted(k for k, _ in mixed)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    w = ["w%d" % i for i in range(40)]
    a, near, b = " ".join(w), " ".join([*w, "x"]), " ".join(x + "z" for x in w)
    rows = [(7, a), (7, b), (9, near), (3, b + " y"), (None, a), (None, "only here"), (None, "only here"), (5, None), (5, ""), (8, a), (8, a)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], COLUMNS)
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.text or "") for x in cp.drop_near_duplicates(spark, df, "").collect())
    assert got == [((False, 3), b + " y"), ((False, 5), ""), ((False, 5), ""), ((False, 7), a), ((True, 0), "only here")]


def test_mix_of_repeated_ids(spark):
    rows = [(i % 20, "a b c d"[: 1 + 2 * (i % 3)], "en", "s%d" % (i % 2), 0) for i in range(300)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    out = cp.mix(spark, df, "").collect()
    want = {x.source: x.target for x in cp.mix_sources(df).collect()}
    for s in ("s0", "s1"):
        assert abs(sum(len(x.text.split()) for x in out if x.source == s) - want[s]) <= 4


def test_stages_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, step in cp.STAGES:
        assert step(spark, none, str(tmp_path)).collect() == []
