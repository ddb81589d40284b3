"""Benchmark decontamination: prefix-filtered set join with exact windows, in SQL functions only.

An item's windows are its runs of ten words. A window is the set of its word shingles
(with their places); to hold a window a text must hold all of them, so the necessary
prefix is one shingle, the rarest in the corpus. The steps:

1. One pass over the texts counts their words and keeps the places of shingles that a bitmap
   of the benchmark's shingles admits. It shuffles nothing and is written to the shared folder;
   words are written only of texts with such a place.
2. Rarity is counted over all documents; each window's rarest shingle is its prefix.
3. Only prefix shingles are joined with the places: candidate windows, under positional and
   length bounds.
4. Each text compares its own words with the words of its candidates, as strings.

Hashes only choose candidates; no result rests on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CAPITALS, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII signs that stand between words; digits, letters and everything beyond ASCII make words.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
WINDOW, SHINGLE = 10, 5
#: Shingles or windows of the benchmark that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of 64 bits in the bitmap: at least, at most (8 MB), and bits for each shingle. A shingle
#: sets two of them, so one word in 65,000 passes by chance.
BITMAP_WORDS, BITMAP_MOST, BITMAP_BITS = 1 << 8, 1 << 20, 512


def words(text: Column) -> Column:
    """The words of a text; A-Z lower-cased, nothing else. Null stays null."""
    return F.array_remove(F.split(F.translate(text, CAPITALS + BETWEEN, LETTERS + " " * len(BETWEEN)), " "), "")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(array: Column, at: Column, step: int) -> Column:
    """Hash of the shingle of ``step`` words at a place."""
    return F.xxhash64(F.lit(step), *[F.get(array, at + j) for j in range(step)])


def _places(array: Column, step: int) -> Column:
    """First words of all shingles of ``step`` words; none if there are fewer words."""
    return F.when(F.size(array) >= step, F.sequence(F.lit(0), F.size(array) - step)).otherwise(F.array().cast("array<int>"))


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _windows(benchmark: DataFrame, window: int, text: str, item: str) -> DataFrame:
    """``wid, length, step, span, items``: distinct windows and the items that have them."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - length))
    spans = items.select("item", length.alias("length"), "w", starts.alias("at")).select("item", F.slice("w", F.col("at") + 1, F.col("length")).alias("span"), "length")
    distinct = spans.groupBy("span", "length").agg(F.collect_set("item").alias("items"))
    return stage(distinct.select(F.monotonically_increasing_id().alias("wid"), "length", F.least("length", F.lit(SHINGLE)).alias("step"), "span", "items"), "bench")


def _probes(h: Column, size: int) -> list[tuple[Column, Column]]:
    """Word and bit of the places of a hash in the bitmap, from different parts of it."""
    return [(F.shiftrightunsigned(h, a).bitwiseAND(F.lit(size - 1)).cast("int"), F.shiftrightunsigned(h, b).bitwiseAND(F.lit(63)).cast("int")) for a, b in ((0, 20), (26, 46))]


def _bitmap(parts: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row: an array of 64-bit words in which each shingle's hash has set its bits."""
    size = BITMAP_WORDS
    while size < BITMAP_MOST and size * 64 < count * BITMAP_BITS:
        size *= 2
    places = parts.select("h").distinct().select(F.explode(F.array(*[F.struct(a.alias("at"), b.alias("bit")) for a, b in _probes(F.col("h"), size)])).alias("p"))
    bits = places.groupBy("p.at").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    every = parts.sparkSession.range(size).select(F.col("id").cast("int").alias("at"))
    # A row for each word of the bitmap: BITMAP_MOST at most.
    dense = every.join(bits, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("b"))
    return stage(dense.select(F.transform("b", lambda x: x["bits"]).alias("b")), "bench"), size


def _found(docs: DataFrame, parts: DataFrame, text: str, key: str) -> DataFrame:
    """``rid, key, mark, n_words, hits`` (place and hash) of every row; its words ``w`` if it has hits."""
    steps = sorted(r.step for r in parts.select("step").distinct().collect())
    bitmap, size = _bitmap(parts, parts.count())
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    rows = rows.withColumn("b", bitmap.scalar())

    def admitted(step: int) -> Column:
        def bit(i: Column) -> Column:
            def test(h: Column) -> Column:
                first, second = (F.call_function("shiftright", F.get(F.col("b"), at), n).bitwiseAND(F.lit(1)) == 1 for at, n in _probes(h, size))
                return first & second

            return let(_hash(F.col("w"), i, step), test)

        return F.transform(F.filter(_places(F.col("w"), step), bit), lambda i: F.struct(i.alias("pos"), _hash(F.col("w"), i, step).alias("h")))

    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    hits = F.concat(*[admitted(s) for s in steps]) if steps else none
    rows = rows.select("key", "mark", "w", F.size("w").cast("bigint").alias("n_words"), hits.alias("hits"))
    return stage(rows.select(F.monotonically_increasing_id().alias("rid"), "key", "mark", "n_words", "hits", F.when(F.size("hits") > 0, F.col("w")).alias("w")), "found")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, text: str, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``_found`` gives them, and ``rid, hits`` (begin, length, items) of those with windows."""
    distinct = _windows(benchmark, window, text, item)

    def shingles(step: int) -> Column:
        return F.transform(_places(F.col("span"), step), lambda i: F.struct(i.alias("off"), _hash(F.col("span"), i, step).alias("h")))

    own = F.coalesce(*[F.when(F.col("step") == s, shingles(s)) for s in range(SHINGLE, 0, -1)])
    parts = distinct.select("wid", "length", "step", F.explode(own).alias("s"))
    parts = stage(parts.select("wid", "length", "step", F.col("s.off").alias("off"), F.col("s.h").alias("h")), "bench")
    n_parts = parts.count()
    found = _found(docs, parts, text, key)
    places = found.where("size(hits) > 0").select("rid", "n_words", F.explode("hits").alias("s")).select("rid", "n_words", "s.pos", "s.h")

    rarity = places.groupBy("h").agg(F.count("*").alias("df"))
    ranked = parts.join(_near(rarity, n_parts), "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = Window.partitionBy("wid").orderBy("df", "off")
    # A window with a shingle that no document holds occurs nowhere.
    prefix = stage(ranked.withColumn("rank", F.row_number().over(first)).where("rank = 1 and df > 0").select("h", "wid", "off", "length"), "bench")
    candidates = places.join(_near(prefix, n_parts), "h").withColumn("begin", F.col("pos") - F.col("off")).where("begin >= 0 and begin + length <= n_words")
    asked = candidates.select("rid", "wid", "begin").join(_near(distinct.select("wid", "length", "span", "items"), n_parts), "wid")
    asked = asked.groupBy("rid").agg(F.collect_list(F.struct("begin", "length", "span", "items")).alias("asked"))
    there = F.filter("asked", lambda c: F.slice(F.col("w"), c["begin"] + 1, c["length"]) == c["span"])
    hits = F.transform(there, lambda c: F.struct(c["begin"].alias("begin"), c["length"].alias("length"), c["items"].alias("items")))
    whole = found.where("w is not null").select("rid", "w").join(asked, "rid").select("rid", hits.alias("hits"))
    return found, whole.where("size(hits) > 0")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``key, mark, begin, length, items`` of every window occurrence (``mark``: the text's hash).

    Python only plans here: all work is in Spark's own operators.
    """
    found, whole = _search(docs, benchmark, window, text, key, item)
    return found.select("rid", "key", "mark").join(whole, "rid").select("key", "mark", F.inline("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``key, n_words, n_hit, items, contaminated`` of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the ids of
    items with occurring windows in string order. An item of fewer words than the window is
    one window; one without words is none. Null and empty texts have no words; very long ones
    are looked at whole, within one task's row. Every row, repeated or not, has its own
    result, whatever its key. An empty benchmark contaminates nothing and an empty table
    gives an empty result; other columns, of any name, are not read.
    """
    found, whole = _search(docs, benchmark, window, text, key, item)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, span: Column) -> Column:
        end = span["begin"] + span["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["upto"], span["begin"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    covered = F.aggregate(F.array_sort(F.transform("hits", lambda s: F.struct(s["begin"].alias("begin"), s["length"].alias("length")))), start, add)["n"]
    whole = whole.select("rid", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda s: s["items"])))).alias("items"))
    joined = found.select("rid", "key", "n_words").join(whole, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
