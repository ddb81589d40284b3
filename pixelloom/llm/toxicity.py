"""Toxicity by weak supervision.

Many weak voters look at a text, each for the share of its words that one small lexicon
holds: fixed lexicons of abusive words, single stems that labelled texts suggest, and
clusters of stems that occur together. A voter speaks for class 1 at a high share,
against it at a low one in a text that reads like those it speaks of, and else abstains;
patterns speak for or abstain. No label votes: labels only propose stems. A
generative label model, fitted by expectation maximisation from the voters' majority,
estimates how each voter speaks in either class, and which voters err together: those
are joined and vote as one. Its posterior labels train a linear classifier over shares of
words and word beginnings, which scores every text. A score uses the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sliced, stage

WORDS = re.compile(r"[^\W\d_]+").findall
#: Labelled rows that are fitted on at most (drawn by hash over all of them), features and stems.
SAMPLE, FEATURES, STEMS = 20_000, 4096, 48
#: Shares of a text's words (of at least LEAST_WORDS) from which a lexicon speaks for, and below
#: which it speaks against; a stem alone speaks for from a smaller share.
LEAST_WORDS, HIGH, LOW, STEM = 100, 0.01, 0.004, 0.002
#: Common words looked at for what a text reads like; how many tell a lexicon's texts, and must be there.
COMMON, TELLING, PRESENT = 400, 8, 3
#: Correlation of stems, over texts, that makes a cluster.
TOGETHER = 0.2
#: Evidence a feature needs: texts that hold it, likelihood ratio (G squared), and how many times
#: as often texts of class 1 hold it; of a stem more is asked.
SUPPORT, EVIDENCE, LIFT, STEM_LIFT = 8, 30.0, 3, 8
#: Counts and word weights held by a task at most.
HELD = 1_000_000

# Small lexicons of abusive English words, by theme.
LEXICONS = {
    "insult": "idiot moron imbecile fool stupid dumb dumbass loser clown pathetic",
    "contempt": "trash garbage scum vermin filth filthy worthless disgusting subhuman parasite",
    "threat": "kill murder die hang shoot stab beat destroy exterminate",
    "vulgar": "shit fuck fucking bitch bastard asshole ass damn crap",
}
PATTERNS = {
    "addressed": r"\byou(?:'re| are)\s+(?:such\s+)?(?:an?\s+)?\w+\s+(?:idiot|moron|loser|clown|fool)",
    "shouting": r"(?:\b[A-Z]{4,}\b[^a-z]{0,20}){4,}",
    "exclaiming": r"!{3,}",
    "masked": r"\b\w+[*@#$]{2,}\w*\b",
    "wish": r"\b(?:go|should|just)\s+(?:and\s+)?(?:die|hang|kill)\b",
}
#: Words that tell an English text, for the fixed lexicons.
ENGLISH = frozenset("the and of to in is that it".split())


def word_features(word: str) -> list[str]:
    """A word and its beginnings of four to eight letters."""
    return [word, *["^" + word[:n] for n in range(4, min(9, len(word)))]]


def nested(a: str, b: str) -> bool:
    """Whether one of two features is the beginning of the other."""
    a, b = a.lstrip("^"), b.lstrip("^")
    return a.startswith(b) or b.startswith(a)


class LabelModel:
    """Class-conditional vote tables of groups of dependent voters, fitted by EM.

    Votes are 1, -1 or 0 (abstains). The start is the majority of each row's votes: class 1
    where more voters speak for than against, or half as many do. No label is seen. That a
    voter abstains says nothing about the class (it may be a matter of language): tables hold
    the chances of votes among rows where the same voters of a group speak. Voters of
    different languages share no rows, so each has a prior of its own that keeps the classes'
    meaning: as if half as many rows again had the class that it says, as often as BELIEF.
    A row where no voter speaks is believed like one where a voter speaks against.
    """

    #: Chance of class 1 where a group speaks against, is split or silent, or speaks for.
    BELIEF = (0.03, 0.5, 0.9)

    def __init__(self, rounds: int = 60, together: float = 0.3, most: int = 4):
        self.rounds, self.together, self.most = rounds, together, most

    @staticmethod
    def _speaking(both: list[bool]) -> np.ndarray:
        """For each state (base three) the set of voters that do not abstain, as a number. A voter
        that never speaks against is taken to speak always."""
        size = 3 ** len(both)
        out, place, rest = np.zeros(size, np.int64), 1, np.arange(size)
        for two_sided in reversed(both):
            out += place * (rest % 3 != 1) * two_sided
            rest, place = rest // 3, place * 3
        return np.unique(out, return_inverse=True)[1]

    @staticmethod
    def _net(size: int) -> np.ndarray:
        """For each state whether more voters speak against (0), neither (1), or for (2)."""
        out, place, rest = np.zeros(size, np.int64), 1, np.arange(size)
        while place < size:
            out += rest % 3 - 1
            rest, place = rest // 3, place * 3
        return np.sign(out) + 1

    def _fit(self, states: list[np.ndarray], both: list[list[bool]], start: np.ndarray, silent: np.ndarray) -> np.ndarray:
        post, speaking = start, [self._speaking(b) for b in both]
        sizes = [len(who) for who in speaking]
        beliefs = [np.array(self.BELIEF)[self._net(n)] for n in sizes]
        for _ in range(self.rounds):
            share = np.clip(post.mean(), 1e-4, 0.5)
            odds = np.full(len(post), np.log(share / (1 - share)))
            self.tables = []
            for s, n, who, belief in zip(states, sizes, speaking, beliefs, strict=True):
                half = np.bincount(s, minlength=n) / 2
                t = np.stack([np.bincount(s, 1 - post, n) + half * (1 - belief) + 0.1, np.bincount(s, post, n) + half * belief + 0.1])
                t /= np.stack([np.bincount(who, row)[who] for row in t])
                self.tables.append(t)
                odds += np.log(t[1] / t[0])[s]
            new = np.where(silent, self.BELIEF[0], 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
            if np.abs(new - post).max() < 1e-6:
                return new
            post = new
        return post

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from votes (rows x voters, -1, 0 or 1)."""
        rows, voters = votes.shape
        fors, against = (votes > 0).sum(axis=1), (votes < 0).sum(axis=1)
        start = np.where((fors > 0) & (2 * fors >= against), 0.9, 0.05)
        both = (votes < 0).any(axis=0).tolist()
        post = self._fit([votes[:, j] + 1 for j in range(voters)], [[b] for b in both], start, fors + against == 0)
        # Dependence: what two voters share once the class is known.
        rest = np.zeros((rows, voters))
        for j in range(voters):
            speaks = (votes[:, j] != 0) | (not both[j])
            expected = [(votes[:, j] * w).sum() / max(w[speaks].sum(), 1e-9) for w in (1 - post, post)]
            rest[:, j] = np.where(speaks, votes[:, j] - (expected[0] * (1 - post) + expected[1] * post), 0.0)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        self.correlation = (rest.T @ rest / max(rows, 1)) / np.outer(spread, spread)
        group = list(range(voters))
        pairs = sorted(((-abs(self.correlation[i, j]), i, j) for i in range(voters) for j in range(i) if abs(self.correlation[i, j]) > self.together and spread[i] > 1e-3 and spread[j] > 1e-3))
        for _, i, j in pairs:
            a, b = group[i], group[j]
            if a != b and sum(g in (a, b) for g in group) <= self.most:
                group = [a if g == b else g for g in group]
        self.groups = [[j for j in range(voters) if group[j] == g] for g in sorted(set(group))]
        states = []
        for g in self.groups:
            s = np.zeros(rows, dtype=np.int64)
            for j in g:
                s = s * 3 + votes[:, j] + 1
            states.append(s)
        return self._fit(states, [[both[j] for j in g] for g in self.groups], start, fors + against == 0)


def clusters(there: np.ndarray) -> list[list[int]]:
    """Columns (stems) joined by correlation over rows (texts); single ones are no cluster."""
    n = there.shape[1]
    label = list(range(n))
    if n > 1 and len(there) > 1:
        x = there - there.mean(axis=0)
        spread = np.sqrt((x**2).mean(axis=0)) + 1e-9
        phi = (x.T @ x / len(x)) / np.outer(spread, spread)
        for i in range(n):
            for j in range(i):
                if phi[i, j] > TOGETHER and label[i] != label[j]:
                    label = [label[i] if v == label[j] else v for v in label]
    found = [[j for j in range(n) if label[j] == v] for v in sorted(set(label))]
    return [c for c in found if len(c) > 1]


def cast_votes(words: np.ndarray, stems: np.ndarray, fixed: np.ndarray, patterns: np.ndarray, common: np.ndarray, english: np.ndarray) -> np.ndarray:
    """Votes (rows x voters) from counts: a text's words, hits of each stem and fixed lexicon,
    matches of patterns, common words there, and whether it reads like English."""
    size = np.maximum(words, LEAST_WORDS)
    out = []

    def home(hits: np.ndarray) -> np.ndarray:
        """Texts that read like those with hits: some of the common words that tell them apart."""
        if not hits.any() or not common.shape[1]:
            return np.zeros(len(words), bool)
        lift = common[hits].mean(axis=0) - common.mean(axis=0)
        telling = np.argsort(-lift, kind="stable")[:TELLING]
        return common[:, telling].sum(axis=1) >= PRESENT

    for j in range(stems.shape[1]):
        hits = stems[:, j]
        out.append(np.where((hits > 0) & (hits / size >= STEM), 1, np.where((hits == 0) & home(hits > 0), -1, 0)))
    for c in clusters((stems > 0).astype(float)):
        hits = stems[:, c].sum(axis=1)
        share = hits / size
        out.append(np.where((hits > 1) & (share >= HIGH), 1, np.where((share < LOW) & home(share >= HIGH), -1, 0)))
    for j in range(fixed.shape[1]):
        share = fixed[:, j] / size
        out.append(np.where(share >= HIGH, 1, np.where((share < LOW) & english, -1, 0)))
    out += list((patterns > 0).astype(np.int64).T)
    out = [v for v in out if (v > 0).sum() >= SUPPORT]  # others never speak for, or hardly
    # Who speaks against more rarely than for has found no texts like its own: it only speaks for.
    out = [v if (v < 0).sum() >= (v > 0).sum() else np.maximum(v, 0) for v in out]
    return np.stack(out, axis=1) if out else np.zeros((len(words), 0), np.int64)


def fit_linear(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, features: int, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    x = np.concatenate(values) if values else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias, n = np.zeros(features), math.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)), len(target)
    m = v = np.zeros(features + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[at] * x, n)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        grad = np.r_[np.bincount(at, error[row] * x, features) + ridge * w / n * 10, error.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


@dataclass
class ToxicityModel:
    """Weights of words and word beginnings (for each hundredth of a text's words), and the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self):
        """A function from texts to scores; keeps the weights of words it has met."""
        known: dict[str, float] = {}
        weights, bias = self.weights, self.bias

        def score(texts: list[str | None]) -> list[float]:
            out = []
            for text in texts:
                words = WORDS((text or "").lower())
                if len(known) > HELD:
                    known.clear()
                try:
                    z = sum(map(known.__getitem__, words))
                except KeyError:
                    known.update((w, sum(weights.get(f, 0.0) for f in word_features(w))) for w in set(words).difference(known))
                    z = sum(map(known.__getitem__, words))
                z = bias + z * 100 / max(len(words), LEAST_WORDS)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            return out

        return score


def fit_toxicity(docs: DataFrame, taught: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """The model from the texts of labelled rows (``taught``: key and label).

    Texts that are alike teach once for each label, however many rows repeat them.
    """
    taught = taught.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    n = taught.count()
    if not n:
        return ToxicityModel()
    drawn = taught if n <= SAMPLE else taught.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    # At most about SAMPLE rows of two numbers: small enough for every executor.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn), "k")
    # Copies and near copies teach once: texts with the same two word pairs of least hash.
    texts = texts.withColumn("w", F.split(F.lower("t"), r"[^\p{L}]+"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    least = F.slice(F.array_sort(F.array_distinct(F.filter(pairs, lambda h: h.isNotNull()))), 1, 2)
    alike = F.when(F.size(least) == 2, F.xxhash64(least)).otherwise(F.xxhash64("t"))
    sample = stage(texts.groupBy(alike.alias("alike"), "y").agg(F.min(F.struct("k", "t")).alias("f")).select("f.k", "f.t", "y"), "toxicity")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good: Counter = Counter()
        bad: Counter = Counter()

        def flush() -> pa.RecordBatch:
            names = list(good.keys() | bad.keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()), pa.array([good[f] for f in names], pa.int64())], names=["f", "p", "n"])
            good.clear()
            bad.clear()
            return out

        for batch in sliced(batches, 500):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if y else good).update({f for w in set(WORDS((t or "").lower())) for f in word_features(w)})
            if len(good) + len(bad) > HELD:
                yield flush()
        yield flush()

    n1, n0 = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return ToxicityModel(bias=30.0 if n1 else -30.0)
    counts = stage(sample.select("t", "y").mapInArrow(count, "f string, p bigint, n bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") >= SUPPORT), "toxicity")

    def part(seen: str, all_: str) -> str:
        return f"CASE WHEN {seen} > 0 THEN {seen} * ln({seen} * {n0 + n1}D / ({all_})) ELSE 0 END"

    rest_p, rest_n = f"({n1} - p)", f"({n0} - n)"
    g2 = F.expr(f"2 * ({part('p', f'(p + n) * {n1}D')} + {part('n', f'(p + n) * {n0}D')} + {part(rest_p, f'({n0 + n1} - p - n) * {n1}D')} + {part(rest_n, f'({n0 + n1} - p - n) * {n0}D')})")
    # Of equal evidence, whole words come first, then longer beginnings.
    order = [F.desc("g2"), F.col("f").startswith("^"), F.desc(F.length("f")), "f"]
    found = counts.withColumn("g2", g2).where((F.col("g2") > EVIDENCE) & (F.col("p") * n0 > LIFT * F.col("n") * n1)).orderBy(*order).limit(FEATURES).collect()
    names = [r.f for r in found]
    usual = [r.f for r in counts.where(~F.col("f").startswith("^")).orderBy(F.desc(F.col("p") + F.col("n")), "f").limit(COMMON).collect()]
    place, usual_at = {f: i for i, f in enumerate(names)}, {w: i for i, w in enumerate(usual)}
    stems: list[str] = []
    for r in found:
        if len(stems) < STEMS and r.p * n0 >= STEM_LIFT * r.n * n1 and not any(nested(r.f, g) for g in stems):
            stems.append(r.f)
    stem_at = {f: i for i, f in enumerate(stems)}
    fixed = [frozenset(v.split()) for v in LEXICONS.values()]
    patterns = [re.compile(p) for p in PATTERNS.values()]
    wide = 2 + len(stems) + len(fixed) + len(patterns) + len(usual)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows, at_, times_ = [], [], []
            for t in batch.column(1).to_pylist():
                words = Counter(WORDS((t or "").lower()))
                v = np.zeros(wide, dtype=np.int32)
                v[0], v[1] = words.total(), sum(w in words for w in ENGLISH) >= PRESENT
                times: Counter = Counter()
                for w, c in words.items():
                    for f in word_features(w):
                        if f in place:
                            times[place[f]] += c
                            if f in stem_at:
                                v[2 + stem_at[f]] += c
                    if w in usual_at:
                        v[wide - len(usual) + usual_at[w]] = 1
                at = 2 + len(stems)
                v[at : at + len(fixed)] = [sum(words[w] for w in lexicon) for lexicon in fixed]
                v[at + len(fixed) : at + len(fixed) + len(patterns)] = [p.search(t or "") is not None for p in patterns]
                rows.append(v.tobytes())
                at_.append(list(times.keys()))
                times_.append(list(times.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(at_, pa.list_(pa.int32())), pa.array(times_, pa.list_(pa.int32()))], names=["order", "row", "at", "times"])

    # A row of small counts for each text of the sample: bounded like it.
    told = sample.select(F.xxhash64("k", "y").alias("order"), "t").mapInArrow(describe, "order bigint, row binary, at array<int>, times array<int>").toArrow().sort_by("order")
    rows = np.frombuffer(b"".join(told.column("row").to_pylist()), dtype=np.int32).reshape(-1, wide).astype(np.int64)
    words, english, stem_hits, fixed_hits, matched, common = np.split(rows, np.cumsum([1, 1, len(stems), len(fixed), len(patterns)]), axis=1)
    votes = cast_votes(words[:, 0], stem_hits, fixed_hits, matched, common, english[:, 0] > 0)
    target = LabelModel().fit(votes)
    at = [np.array(x, dtype=np.int64) for x in told.column("at").to_pylist()]
    shares = [np.array(x, dtype=float) * 100 / max(w, LEAST_WORDS) for x, w in zip(told.column("times").to_pylist(), words[:, 0].tolist(), strict=True)]
    weights, bias = fit_linear(at, shares, target, len(names))
    discard(sample, counts)
    return ToxicityModel({f: float(w) for f, w in zip(names, weights, strict=True)}, float(bias))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (the key alone if not given) and ``score`` of every row; no shuffle.

    Whole texts are scored, very long ones too; a null or empty text has the score of the bias.
    """
    keep = (key,) if keep is None else keep
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score(batch.column(batch.num_columns - 1).to_pylist()), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("text_")).mapInArrow(run, fields + ", score double")


def held_out(key: str) -> Column:
    """Rows never learned from: crc32 of the key as text divisible by five; null is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``.

    Learns from labelled rows that are not held out. Null labels or keys teach nothing; a
    key labelled twice counts for each different label, and a key with several texts teaches
    by one of them. Repeated rows have equal scores. Without any label (or any toxic one)
    every score is near 0. An empty table gives an empty result. Other columns, of any name,
    are not read.
    """
    model = fit_toxicity(docs, labels.where(~held_out(key)), text, key, label)
    scored = score_toxicity(docs, model, text, key)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
