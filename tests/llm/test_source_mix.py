from fractions import Fraction

import numpy as np

from pixelloom.llm.source_mix import mix_sources, pivot, targets


def test_targets_reshare_what_exceeds_twice_the_size():
    got = targets({"b": 10, "a": 100, None: 1000})
    # a: weight 5, b: 2, null: 1 of 1665 words; a and b stop at twice their size.
    assert got == {"a": 200, "b": 20, None: Fraction(1665 - 220)}
    assert targets({}) == {}
    assert targets({"x": 0}) == {"x": 0}


def test_pivot_keeps_words_and_expectation():
    size = np.array([5, 9, 3, 7, 8, 2, 0])
    part = np.full(7, 0.3)
    sums = np.zeros(7)
    for s in range(4000):
        out = pivot(size, part, np.random.default_rng(s))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((out * size).sum() - 0.3 * size.sum()) < 1e-9
        sums += out
    assert np.allclose(sums[:6] / 4000, 0.3, atol=0.03)


def test_mix_reaches_targets_and_reruns_agree(spark, monkeypatch):
    from pixelloom.llm import source_mix

    monkeypatch.setattr(source_mix, "GROUP", 20)
    monkeypatch.setattr(source_mix, "FAN_IN", 3)
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "hot" if i % 3 else "s%d" % (i % 5), "clash") for i in range(900)]
    rows += [(900, None, "hot", ""), (901, "", None, ""), (902, "a b", None, ""), (902, "a b", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = {}
    for part in (1, 5):
        out = mix_sources(df.repartition(part)).collect()
        got[part] = sorted(map(tuple, out))
        assert len(out) == len(rows)
    assert got[1] == got[5]
    by = {}
    for r in out:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by.setdefault((r.target, r.source_size), []).append(r)
    for (target, _), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= max(r.size for r in rs)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
