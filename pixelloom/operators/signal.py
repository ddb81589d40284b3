"""Entropy coding, ordered recurrences, lookups, text and bit operators over tables."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup table that are sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _bytes_of(text: pa.Array) -> pa.Array:
    raw = text.cast(pa.large_binary())
    border = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[border[0] : border[-1]] if data else np.zeros(0, np.uint8)
    offsets = pa.array((border - border[0]).astype(np.int32), mask=np.r_[np.asarray(raw.is_null()), False])
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


@F.arrow_udf(T.LongType())
def _adler(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.adler32(t) for t in text.cast(pa.binary()).to_pylist()], pa.int64())


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of 0 to 255: Arrow's buffers taken as they are."""
    return _bytes_of(text)


def byte_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each byte occurs over all texts, the most frequent first in ``rank``."""
    counts = df.select(F.explode(text_bytes(F.col(text))).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "b")))


def alphabets(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Distinct bytes and all bytes of each group's whole texts: group, symbols, bytes."""
    counts = df.select(group, F.explode(text_bytes(F.col(text))).alias("b")).groupBy(group, "b").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.count("*").alias("symbols"), F.sum("n").alias("bytes"))


def character_entropy(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shannon entropy of a text's characters in bits."""
    signs = df.select(key, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))
    sums = signs.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"))


def code_lengths(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Huffman code lengths of (symbol, count) pairs by merging the two rarest; one symbol has 1."""
    heap = [(n, [s]) for s, n in sorted(counts) if n > 0]
    if len(heap) == 1:
        return {heap[0][1][0]: 1}
    lengths = dict.fromkeys((h[1][0] for h in heap), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, sorted(x + y)))
    return lengths


def huffman_lengths(counts: DataFrame, group: str, symbol: str = "b", n: str = "n") -> DataFrame:
    """Code length of each symbol of a group's histogram (256 symbols at most in a group)."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = code_lengths(list(zip(rows[symbol].tolist(), rows[n].tolist(), strict=True)))
        return pd.DataFrame({group: rows[group].iloc[0], symbol: list(lengths), "len": list(lengths.values())})

    schema = f"`{group}` {counts.schema[group].dataType.simpleString()}, `{symbol}` int, len int"
    return counts.groupBy(group).applyInPandas(assign, schema)


def canonical_codes(lengths: DataFrame, group: str, symbol: str = "b") -> DataFrame:
    """Canonical codes from lengths: a running Kraft sum, shifted to each length."""
    order = Window.partitionBy(group).orderBy("len", symbol).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.max("len").over(Window.partitionBy(group))
    wide = lengths.withColumn("top", whole).withColumn("before", F.coalesce(F.sum(F.expr("shiftleft(1L, top - len)")).over(order), F.lit(0)))
    return wide.select(group, symbol, "len", F.expr("shiftright(before, top - len)").alias("code"))


def kraft_codes(df: DataFrame, key: str, length: str) -> DataFrame:
    """Canonical codes of given lengths over one small table: key, len, code."""
    return canonical_codes(df.select(F.lit(0).alias("g"), F.col(key).alias("b"), F.col(length).alias("len")), "g").select(F.col("b").alias(key), "len", "code")


def run_lengths(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values in order: group, run, value, n."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("start_", F.when(F.row_number().over(w) == 1, 1).otherwise(new))
    runs = marked.withColumn("run", F.sum("start_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "run", value).agg(F.count("*").alias("n"))


def expand_runs(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Values from runs: group, run, place in the run, value."""
    return runs.select(group, "run", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("place"), value)


def differences(df: DataFrame, group: str, order: Sequence[str], value: str, restart: int | None = None) -> DataFrame:
    """Each value less the one before it; the first (of every ``restart``) as it is. Adds ``diff``."""
    w = Window.partitionBy(group).orderBy(*order)
    out = df.withColumn("part_", F.floor((F.row_number().over(w) - 1) / restart) if restart else F.lit(0))
    inner = Window.partitionBy(group, "part_").orderBy(*order)
    return out.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(inner), F.lit(0)))


def restored(df: DataFrame, group: str, order: Sequence[str], diff: str = "diff", part: str = "part_") -> DataFrame:
    """Values from differences: a running sum. Adds ``value_``."""
    w = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value_", F.sum(diff).over(w))


def running_offsets(df: DataFrame, group: str, order: Sequence[str], size: str) -> DataFrame:
    """Where each part begins if parts of a group follow each other. Adds ``offset``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def lookup(df: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a table that is sent to all executors if it is small enough, else by shuffle."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on, how)


def palette(spark: SparkSession, colours: Sequence[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colours)], "idx int, b int, g int, r int")


def best_of(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order with no ties."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("n_ = 1").drop("n_")


def bounded_queue(df: DataFrame, group: str, order: Sequence[str], slots: int = 63) -> DataFrame:
    """What a queue of so many slots keeps of each group if nothing is taken out meanwhile."""
    return df.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("slot") <= slots)


def xml_tags(text: Column) -> Column:
    """Names of start tags, in order, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def xml_attributes(text: Column) -> Column:
    """``name="value"`` pairs, in order."""
    return F.regexp_extract_all(text, F.lit(r'([a-zA-Z-]+="[^"]*")'), F.lit(1))


def exp_golomb_length(value: Column) -> Column:
    """Bits of the unsigned Exp-Golomb code of order 0."""
    return 2 * (F.length(F.bin(value + 1)) - 1) + 1


def signed_golomb(value: Column) -> Column:
    """The unsigned index that a signed Exp-Golomb code stands for."""
    return F.when(value > 0, 2 * value - 1).otherwise(-2 * value)


def magnitude_category(value: Column) -> Column:
    """Bits of a difference's magnitude; 0 has none."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(value))))


def leb128_length(value: Column) -> Column:
    """Bytes of the little-endian base 128 code."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def tile_scan(df: DataFrame, key: str, width: int = 64, tile: int = 16) -> DataFrame:
    """Addresses of ``width`` x ``width`` blocks in tile order, each picture by itself: key, picture, address."""
    k, area = F.col(key), width * width
    place = F.pmod(k, F.lit(area))
    cells = df.select(key, F.expr(f"(`{key}` - pmod(`{key}`, {area})) div {area}").alias("picture"), F.pmod(place, F.lit(width)).alias("x_"), F.floor(place / width).alias("y_"))
    order = Window.partitionBy("picture").orderBy(F.floor(F.col("y_") / tile), F.floor(F.col("x_") / tile), "y_", "x_", key)
    return cells.select(key, "picture", (F.row_number().over(order).cast("long") - 1).alias("address"))


def log2_floor(value: Column) -> Column:
    return F.length(F.bin(value)) - 1


def log2_ceil(value: Column) -> Column:
    return F.when(value <= 1, F.lit(0)).otherwise(F.length(F.bin(value - 1)))


def adler32(text: Column) -> Column:
    """Adler-32 of a text's UTF-8 bytes; one call a text, in Arrow batches."""
    return _adler(text)

