import random

import numpy as np
import pytest

from pixelloom.llm import jaccard_join
from pixelloom.llm.jaccard_join import exact_classes, jaccard_classes


def brute(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (k_, _), x in zip(rows, label):
        least[x] = min(least.get(x, k_), k_)
    return sorted((k_, len(s), least[x]) for (k_, _), s, x in zip(rows, sets, label))


def corpus(seed=1, groups=12):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    line = " ".join(r.choices(words, k=12))
    rows = []
    for g in range(groups):
        base = r.choices(words, k=r.choice([3, 5, 40, 90, 150]))
        for _ in range(r.choice([1, 2, 8, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((" ".join(w) + ("\n" + line if r.random() < 0.4 else "")))
    rows += ["", None, "  \n", line, line, line.upper(), "one", "ONE", "one two", "Straße É x y", "strasse é x y"]
    r.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 9])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in jaccard_classes(df, block=block).collect())
    assert got == brute(rows)


def test_small_tiles_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    monkeypatch.setattr(jaccard_join, "RARE", 3)
    rows = corpus(2, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_classes(df).collect()) == brute(rows)


def test_empty_table_nulls_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(none).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_classes(df).collect())
    assert got == [(0, 2, 7), (3, 0, 3), (7, 2, 7), (7, 2, 7)]


def test_exact_classes_many_singles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 60, 50, dtype=np.uint64)) for _ in range(90)]
    sets += [np.unique(np.r_[sets[3][:48], sets[4][:1]])]
    label = exact_classes(sets, 85)
    assert label[3] == label[90] and len(set(label.tolist())) == 90


def test_words_made_to_collide(spark):
    # Thue-Morse words: equal polynomial hashes modulo a power of two, whatever the base.
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " " + " ".join("w%d" % i for i in range(3))
    df = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, a + tail + " ")], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in jaccard_classes(df).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_texts_of_rows_without_key_link_others(spark):
    w = ["w%d" % i for i in range(60)]
    near = [" ".join(w), " ".join([*w[:57], "x", *w[58:]]), " ".join([*w[:50], "y", *w[51:57], "x", *w[58:]])]
    df = spark.createDataFrame([(1, near[0]), (None, near[1]), (3, near[2])], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_classes(df, percent=80).collect()}
    assert got[1] == got[None] == got[3] == 1


def test_very_long_text(spark):
    long = " ".join("w%d" % i for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3 w4")], "doc_id long, text string")
    assert sorted(tuple(x) for x in jaccard_classes(df).collect()) == [(1, 199_997, 1), (2, 199_998, 1), (3, 1, 3)]
