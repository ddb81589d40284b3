"""Quality rules: learned decision lists as Spark conditions, in SQL functions only.

Text statistics are SQL expressions. Sequential covering learns from labelled rows: a rule
starts empty and takes the threshold condition with the best gain until it covers almost no good text;
it is pruned on rows kept apart, and what it covers leaves the table before the next rule.
Every count comes from a grouped aggregate over all labelled rows; the driver sees counts of
(statistic, bin) pairs only. The list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .decontaminate import let

SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bits of a packed number that hold a window's place; longer texts are counted by words alone.
PLACE_BITS = 20
PLACES = (1 << PLACE_BITS) - 1
#: Thresholds tried for each statistic; conditions of a rule; rules of a list.
BINS, CONDITIONS, LIST = 32, 3, 12
#: A rule must reject this share of bad texts among what it covers, apart from its training rows.
PRECISION = 0.9


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _neighbours(sorted_: Column) -> Column:
    """Places (low bits) of sorted keys that share their high bits with a neighbour."""
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(sorted_, F.lit(1), F.greatest(F.lit(0), F.size(sorted_) - 1)))
    pairs = F.zip_with(sorted_, before, lambda x, y: F.when(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.struct(x.bitwiseAND(PLACES).cast("int").alias("i"), y.bitwiseAND(PLACES).cast("int").alias("j"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def _covered(places: Column) -> Column:
    """Words in three-word windows at ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["upto"] - p)).alias("n"), (p + 3).alias("upto")))["n"]


def _window_equal(w: Column, i: Column, j: Column) -> Column:
    return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))


def _by_strings(w: Column) -> Column:
    """Repeated windows' places by comparing the words themselves (no hash)."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))

    def places(s: Column) -> Column:
        after = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["i"], y["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))

    return let(F.array_sort(windows), places)


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``mark`` (the text's hash) and the counted statistics of every row.

    Windows are found by hash and place packed in one number, sorted; equal hashes are
    checked word by word, and a text where a check fails is counted by its words alone.
    """
    t = F.coalesce(F.col("t_"), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t_"))
    # Columns that later ones use more than once are computed once, in compiled projections.
    rows = rows.select(key, F.xxhash64("t_").alias("mark"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("l"), F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"), _without(t, SYMBOLS).cast("bigint").alias("n_symbols"), _without(t, "0123456789").cast("bigint").alias("n_digits"), _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"), _without(t, ".,;:!?").cast("bigint").alias("n_marks"))
    last = F.size("w") - 3
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), PLACE_BITS) + i)
    rows = rows.withColumn("s", F.when((F.size("w") >= 4) & (F.size("w") <= PLACES), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("p", _neighbours(F.col("s"))).drop("s")
    true = F.forall("p", lambda x: _window_equal(F.col("w"), x["i"], x["j"])) & (F.size("w") <= PLACES)
    hashed = F.array_sort(F.array_distinct(F.concat(F.transform("p", lambda x: x["i"]), F.transform("p", lambda x: x["j"]))))
    places = F.when(F.size("w") < 4, F.array().cast("array<int>")).when(true, hashed).otherwise(_by_strings(F.col("w")))
    n = {"n_words": F.size("w"), "n_repeat_words": _covered(places), "n_distinct_words": F.size(F.array_distinct("w")), "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l"))}
    return rows.select(key, "mark", *[v.cast("bigint").alias(k) for k, v in n.items()], "word_chars", "n_symbols", "n_digits", "n_capitals", "n_marks")


#: What conditions compare: rates, so that a threshold means the same for any length.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct_words / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "capital_rate": "n_capitals / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rules = list[tuple[Condition, ...]]


def _covers(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_list(rows: DataFrame, bad: str = "bad", key: str = "doc_id") -> Rules:
    """An ordered list of rules that reject; ``rows`` hold statistics and 0/1 ``bad``.

    Two thirds of the rows (by hash of the key) grow rules, one third prunes them. No row or
    no bad row gives an empty list. Ties go to the earlier feature and lower threshold.
    """
    names = list(FEATURES)
    rows = stage(rows.select(key, F.col(bad).cast("int").alias("bad"), (F.pmod(F.xxhash64(F.col(key)), F.lit(3)) == 0).alias("apart"), "n_words", *sorted({x for x in rows.columns if x.startswith(("n_", "word_")) and x != "n_words"})), "quality")
    cuts = rows.agg(*[F.expr(f"percentile_approx({e}, array({','.join(str(i / BINS) for i in range(1, BINS))}), 5000)").alias(n) for n, e in FEATURES.items()]).first().asDict()
    edges = {n: sorted(set(cuts[n] or [])) for n in names}
    bins = F.array(*[sum((F.when(F.expr(FEATURES[n]) > F.lit(t), 1).otherwise(0) for t in edges[n]), F.lit(0)) for n in names])
    rows = stage(rows.withColumn("bins", bins), "quality")

    def table(covered: Column) -> dict:
        """Good and bad rows of each (apart, feature, bin) among what is covered."""
        out: dict = {}
        for r in rows.where(covered).select("apart", "bad", F.posexplode("bins").alias("f", "bin")).groupBy("apart", "f", "bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect():
            out[r.apart, r.f, r.bin] = (r.p, r.n - r.p)
        return out

    def total(counts: dict, apart: bool) -> tuple[int, int]:
        some = [v for (a, f, _), v in counts.items() if a == apart and f == 0]
        return sum(p for p, _ in some), sum(n for _, n in some)

    learned: Rules = []
    open_ = F.lit(True)
    for _ in range(LIST):
        rule: tuple[Condition, ...] = ()
        marks: list[tuple[int, int]] = []
        while True:
            counts = table(open_ & _covers(rule))
            p0, n0 = total(counts, False)
            marks.append(total(counts, True))
            if not p0 or not n0 or len(rule) == CONDITIONS:
                break
            best = (0.0, None)
            for f, name in enumerate(names):
                for i, threshold in enumerate(edges[name]):
                    for above in (True, False):
                        some = [v for (a, g, b), v in counts.items() if not a and g == f and (b > i) == above]
                        p, n = sum(x for x, _ in some), sum(x for _, x in some)
                        gain = p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, threshold))
            if best[1] is None:
                break
            rule += (best[1],)
        # Prune: the shortest beginning of the rule that does best on the rows kept apart.
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in marks[1:]]
        if not worth:
            break
        size = max(range(len(worth)), key=lambda i: (worth[i], -i)) + 1
        p, n = marks[size]
        if p + n == 0 or p / (p + n) < PRECISION:
            break
        learned.append(rule[:size])
        open_ = open_ & ~_covers(rule[:size])
    return learned


def verdict(rules: Rules) -> Column:
    """The list as one ordered conditional: true keeps a text."""
    out = None
    for rule in rules:
        out = F.when(_covers(rule), F.lit(False)) if out is None else out.when(_covers(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> tuple[DataFrame, Rules]:
    """Statistics, ``base_failed`` and ``kept`` of every row, and the rules learned.

    Base: fewer than 50 words, or more than half of the words in repeated windows. What the
    base fails is not taught again; the list judges the rest. Rows without a label
    (or a null one) are judged, not learned from. A null or empty text has no words and
    fails the base. Repeated rows get equal results; labels of a repeated key count for each.
    """
    rows = stage(text_statistics(docs, text, key), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    taught = rows.where(~failed).join(labels.select(F.col(key).alias("k"), F.col(label).alias("quality_")).where("quality_ is not null"), F.col(key) == F.col("k"))
    rules = learn_list(taught.withColumn("bad", (F.col("quality_") == 0).cast("int")), "bad", key)
    out = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.drop("mark"), rules
