"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. Its documents share one expected number of copies,
whose fraction is rounded by pairs: two fractional documents trade mass, measured in
words, in a random direction until one of them is integral. Each trade keeps the
source's words and every document's expectation, so only the last fractional document
of a source can move its total. Documents are dealt to small groups of one source; the
at most one fractional document that each group leaves goes up a reduction tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents rounded one after the other in a task's group, and groups that one above joins.
GROUP, FAN_IN = 2000, 64


def targets(sizes: dict[str | None, int], weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Each source's words: ``share`` of all by weight, none above ``most`` times its size.

    Sources take the weights in code point order, null last, repeating. What a source
    can't take is shared among the others by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] > most * sizes[s] * total}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def pivot(size: np.ndarray, part: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """``part`` (chances, 0 to 1) with at most one left fractional; sum of part * size kept."""
    out, held = part.astype(float).copy(), -1
    coins = draw.random(len(out))
    for i in np.flatnonzero((out > 0) & (out < 1)).tolist():
        if size[i] == 0:
            out[i] = 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = float(size[held]), float(size[i]), out[held], out[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if coins[i] * (up + down) < down:
            p, q = (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)
        out[held], out[i] = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        if not 0 < out[held] < 1:
            held = i if 0 < out[i] < 1 else -1
    return out


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``key, source, size, source_size, target, copies, taken`` of every row.

    ``taken`` is ``copies * size``. The same table, seed and options give the same rows,
    whatever the partitions. A null text has size 0 and takes 0 words (its copies are the
    whole part of its source's rate); null is a source of its own; rows with equal key, size and source
    are alike, so which of them gets a copy does not matter. An empty table gives an
    empty result. The driver holds a row per source, not per document.
    """
    sized = stage(docs.select(F.col(key).alias(key), F.col(source).alias("source_"), size_of(text).alias("size")), "mix")
    spark = docs.sparkSession
    found = sized.groupBy("source_").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    goal = targets({r.source_: r.size for r in found}, weights, share, most)
    rows = []
    # Sources are known by their place in code point order: no two are taken for one.
    for at, r in enumerate(sorted(found, key=lambda r: (r.source_ is None, r.source_ or ""))):
        rate = goal[r.source_] / r.size if r.size else Fraction(0)
        rows.append((r.source_, r.size, float(goal[r.source_]), int(rate), float(rate - int(rate)), -(-r.n // GROUP), at))
    plan = spark.createDataFrame(rows, "s string, source_size long, target double, whole int, part double, groups int, mark long")
    level = sized.join(plan, F.col("source_").eqNullSafe(F.col("s"))).select(key, "source_", "size", "source_size", "target", "whole", "part", "mark", F.pmod(F.xxhash64(key, F.lit(seed)), F.col("groups")).cast("int").alias("bucket"), "groups")
    schema = level.schema

    def round_group(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "size"], kind="stable", na_position="first").reset_index(drop=True)
        draw = np.random.default_rng([seed, int(names[0]), int(names[1]), int(names[2])])
        rows["part"] = pivot(rows["size"].to_numpy(), rows["part"].to_numpy(), draw)
        if names[2] == 1:  # the only group of its source: its last document takes a chance
            loose = (rows["part"] > 0) & (rows["part"] < 1)
            rows.loc[loose, "part"] = (draw.random(int(loose.sum())) < rows.loc[loose, "part"]).astype(float)
        return rows

    settled, groups = [], max([r[5] for r in rows], default=1)
    while True:
        done = stage(level.groupBy("mark", "bucket", "groups").applyInPandas(round_group, schema), "mix")
        loose = (F.col("part") > 0) & (F.col("part") < 1)
        settled.append(done.where(~loose))
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
        level = done.where(loose).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int")).withColumn("groups", F.ceil(F.col("groups") / FAN_IN).cast("int"))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    copies = F.col("whole") + F.col("part").cast("int")
    return out.select(key, F.col("source_").alias(source), "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
