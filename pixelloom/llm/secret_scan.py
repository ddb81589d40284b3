"""Secret scans through a trigram inverted index, in SQL functions only.

From each rule's regular expression a Boolean query of mandatory trigrams is derived (what
every match must contain). The index lists, per trigram, the documents that contain it;
postings are intersected per rule, and only candidates are verified with the expression
itself. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bits of one posting mask.
MASK = 62
#: Exact strings of a part of an expression that are followed at once.
STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters, else the match drops."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds of the contract (runs shorter than asked can't hide another
# match in the second and third, so their lengths stand in the pattern), then public formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE

# A query: None (everything), a trigram, or ("and" | "or", parts).
Query = None | str | tuple


def _all_of(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any_of(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    return _any_of(_all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match must contain."""

    def walk(ops) -> tuple[set[str] | None, Query]:
        """The exact strings an expression matches, if few; else what a match must contain."""
        now, found, whole = {""}, [], True
        for op, value in ops:
            exact, query = one(op, value)
            if exact is not None and len(now) * len(exact) <= STRINGS:
                now = {a + b for a in now for b in exact}
                continue
            found.append(_of_strings(now))
            whole = False
            if exact is not None:
                now = exact
            else:
                found.append(query)
                now = {""}
        return (now, None) if whole else (None, _all_of([*found, _of_strings(now)]))

    def one(op, value) -> tuple[set[str] | None, Query]:
        if op is sre.LITERAL:
            return {chr(value).lower()}, None
        if op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}, None
        if op is sre.SUBPATTERN:
            return walk(value[3])
        if op is sre.BRANCH:
            parts = [walk(p) for p in value[1]]
            if all(e is not None for e, _ in parts):
                both = set().union(*[e for e, _ in parts])
                if len(both) <= STRINGS:
                    return both, None
            return None, _any_of(_of_strings(e) if e is not None else q for e, q in parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, part = value
            exact, query = walk(part)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {""}, None
            if low == high == 1:
                return exact, query
            return None, None if low == 0 else _of_strings(exact) if exact is not None else query
        if op is sre.AT:
            return {""}, None
        return None, None

    exact, query = walk(sre_parse.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(p) for p in query[1]])


def build_index(docs: DataFrame, grams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings ``gram, key, mark``: which texts (``mark``: their hash) hold each trigram."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    lowered = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), low.alias("low"))
    return lowered.select("key", "mark", F.explode(held).alias("gram"))


def _holds(query: Query, place: dict[str, int]) -> Column:
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        i = place[query]
        return F.coalesce(F.expr(f"(mask{i // MASK} & {1 << i % MASK}L) != 0"), F.lit(False))
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(p, place) for p in query[1]])


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Every match of a rule: structs ``start, rank, end, kind`` in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("len")))
    sizes = F.zip_with(sizes, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s, g: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), (F.length(g) >= rule.least).alias("ok")))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + s["len"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + s["len"]).alias("at"), F.when(s["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(sizes, begin, add)["out"]).otherwise(F.array().cast(kind))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, spans`` of every row: all matches of all rules, by start, then rule order.

    A match ends where the next of its kind may begin (leftmost, not overlapping). A null or
    empty text has none. Repeated rows get equal results; rows that share only a key are
    told apart by their text; a null key is a key. Other columns are not read.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*[trigrams(q) for q in queries]))
    place = {g: i for i, g in enumerate(grams)}
    masks = range(-(-len(grams) // MASK))
    postings = stage(build_index(docs, grams, text, key), "postings")
    bits = [F.bit_or(F.when(F.floor(F.col("gram") / MASK) == m, F.expr(f"shiftleft(1L, cast(pmod(gram, {MASK}) as int))"))).alias(f"mask{m}") for m in masks]
    found = postings.groupBy("key", "mark").agg(*bits) if grams else docs.sparkSession.createDataFrame([], "key bigint, mark bigint")
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text_"), F.xxhash64(F.col(text)).alias("own"))
    joined = rows.join(found, rows[key].eqNullSafe(found["key"]) & (rows["own"] == found["mark"]), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = [F.when(_holds(q, place), _spans(r, i, F.col("text_"))).otherwise(none) for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return joined.select(rows[key].alias(key), F.array_sort(F.concat(*parts)).alias("spans"))
