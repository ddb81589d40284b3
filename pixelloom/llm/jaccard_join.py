"""N-gram Jaccard join: which texts share enough word shingles, as connected classes.

The steps, none of which gathers a group of unbounded size in one task:

1. Each text becomes a set of shingle hashes; texts with equal sets are one *node*.
2. Prefix filter: sets of similarity t share one of their first ``n - ceil(t n) + 1``
   shingles under any common order. The order is by hash, but shingles that many
   sets hold come last. Only shingles that stand in two prefixes go on.
3. Tiles: the nodes of a prefix shingle, banded by set size. Bitmap signatures bound the
   overlap of a pair from above by bit counts; pairs that the bound admits are joined.
   The classes so found can only be too coarse. (A tile too large is one class as it is.)
4. Each coarse class is split exactly: nodes act as pivots that are compared with all
   nodes of other classes, by bitmaps first, then by sorted-array intersection, until
   every node outside the largest class has been a pivot. Large classes are dealt to
   blocks that share pivots; what stays outside the largest class meets every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, sliced, stage
from .shingles import Powers, shingle_sets

#: At most so many shingles are ranked last as frequent ones (1.6 MB sent to each task), and
#: none that fewer prefixes hold than RARE.
FREQUENT, RARE = 200_000, 64
#: Tiles beyond this many nodes are not compared pair by pair but become one coarse class.
TILE = 2048
#: Nodes of a block in the exact step, and pivots that all blocks of a class share.
BLOCK, PIVOTS = 4096, 64


def width(n: int) -> int:
    """Bits of the signature of n members: a power of two, 2 to 4 a member, at least 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> int:
    """A set's signature: one bit for each member, at the place that its hash gives."""
    bits = np.zeros(width(len(hashes)), dtype=np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fold(bits: int, wide: int, to: int) -> int:
    """The signature of the same set at a smaller width."""
    while wide > to:
        wide //= 2
        bits = (bits >> wide) | (bits & ((1 << wide) - 1))
    return bits


def admits(n: int, m: int, bits_n: int, bits_m: int, percent: int) -> bool:
    """Whether sizes and bit counts allow the similarity."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b = width(n), width(m)
    apart = (fold(bits_n, a, min(a, b)) ^ fold(bits_m, b, min(a, b))).bit_count()
    return (100 + percent) * ((n + m - apart) // 2) >= percent * (n + m)


def exact_classes(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, pivots: np.ndarray | None = None) -> np.ndarray:
    """Class label of each set (sets of one class are linked through sets given here).

    ``labels``: classes known before. ``pivots``: compare only these with all others.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    if n < 2:
        return label
    wide = width(4 * int(np.median(size)))
    signs = np.zeros((n, wide // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        at = s & np.uint64(wide - 1)
        np.bitwise_or.at(signs[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    flat, begin = np.concatenate(sets), np.r_[0, np.cumsum(size)]
    done = np.zeros(n, dtype=bool)

    def compare(i: int) -> None:
        done[i] = True
        near = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        at = np.flatnonzero(near)
        if not len(at):
            return
        apart = np.bitwise_count(signs[at] ^ signs[i]).sum(axis=1, dtype=np.int64)
        at = at[(100 + percent) * ((size[at] + size[i] - apart) // 2) >= percent * (size[at] + size[i])]
        if not len(at):
            return
        take = np.concatenate([flat[begin[j] : begin[j + 1]] for j in at])
        own = sets[i]
        found = own[np.minimum(np.searchsorted(own, take), len(own) - 1)] == take
        shared = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(size[at])[:-1]])
        linked = at[100 * shared >= percent * (size[at] + size[i] - shared)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[i]

    if pivots is not None:
        for i in pivots:
            compare(int(i))
        return label
    for i in range(min(n, 16)):
        compare(i)
    while True:
        values, counts = np.unique(label, return_counts=True)
        rest = np.flatnonzero((label != values[np.argmax(counts)]) & ~done)
        if not len(rest):
            return label
        for i in rest[:64]:
            compare(int(i))


def _runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of equal ``column``, one table each; input sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[0].column(column)[0].as_py() != batch.column(column)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _banded(t: pa.Table, percent: int) -> list[pa.RecordBatch]:
    """Of rows sorted by key, size and node: each node once, if its key has one of like size."""
    if not t.num_rows:
        return []
    t = t.combine_chunks()
    keys, nodes = t.column("key").to_numpy(), t.column("node").combine_chunks()
    again = (keys[1:] == keys[:-1]) & pc.equal(nodes[1:], nodes[:-1]).to_numpy(zero_copy_only=False)
    t = t.filter(pa.array(np.r_[True, ~again]))
    keys, size, hot = t.column("key").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("hot").to_numpy()
    near = (keys[1:] == keys[:-1]) & (100 * size[:-1] >= percent * size[1:])
    return t.filter(pa.array(np.r_[False, near] | np.r_[near, False] | hot)).combine_chunks().to_batches()


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id", block: int = BLOCK, marks: bool = False) -> DataFrame:
    """``key, n_shingles, component_id`` of every row; links need ``percent`` similarity.

    With ``marks`` also ``mark``, the text's hash, and ``class``, which names the class itself
    (null for a text without words): rows of one key may be of different classes.

    ``component_id`` is the smallest key reachable by links. A null or empty text or one
    without words has 0 shingles and its own key. Rows that repeat a text, or a key, are
    each returned; a null key stays null and is never a component's smallest unless alone.
    An empty table gives an empty result. Texts of any length are taken whole; other
    columns, of any name, are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, 2000):
            node, size, prefix, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), k, powers):
                n = len(s)
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                size.append(n)
                prefix.append(s[: _prefix(n, percent)].tobytes() if n else b"")
                bits.append(bitmap(s).to_bytes(width(n) // 8, "little") if n else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], names=["id", "mark", "node", "n_shingles", "prefix", "bits"])

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text_"), F.xxhash64(F.col(text)).alias("mark"))
    rows = stage(texts.mapInArrow(describe, f"id {kind}, mark bigint, node binary, n_shingles bigint, prefix binary, bits binary"), "jaccard")
    nodes = rows.where("node is not null").dropDuplicates(["node"])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["key", "n"])

    # Which shingles are frequent decides only their rank, and any rank is exact.
    total = nodes.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    often = nodes.select("prefix").mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > max(RARE, total // FREQUENT))
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in often.select("key").collect()], dtype=np.int64).view(np.uint64)))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, last = Powers(), set(), frequent.value
        for batch in sliced(batches, 2000):
            key_, node_, hot_, size_ = [], [], [], []
            for s in shingle_sets(batch.column(0), k, powers):
                if not len(s) or (node := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(node)
                p = _prefix(len(s), percent)
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                order = np.argsort(late, kind="stable")[:p]
                key_.append(s[order])
                hot_.append(late[order])
                node_ += [node] * p
                size_ += [len(s)] * p
            if node_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key_).view(np.int64)), pa.array(node_, pa.binary()), pa.array(size_, pa.int32()), pa.array(np.concatenate(hot_))], names=["key", "node", "n", "hot"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, the frequent ones and those whose key has another node in their size band."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = t.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held, t = t.slice(cut), t.slice(0, cut)
            yield from _banded(t, percent)
        if held is not None:
            yield from _banded(held, percent)

    route = F.when(F.col("hot"), F.xxhash64("node")).otherwise(F.col("key"))
    fields = "key bigint, node binary, n int, hot boolean"
    dealt = docs.select(text).mapInArrow(prefixes, fields).repartition(route).sortWithinPartitions("key", "n", "node")
    pairs = stage(dealt.mapInArrow(shared, fields), "jaccard")

    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key"):
            name = b"key:" + np.int64(run.column("key")[0].as_py()).tobytes() + b"...."
            node = run.column("node").to_pylist()
            if len(node) > TILE:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([name] * len(node), pa.binary())], names=["a", "b"])
                continue
            if len(node) < 2:
                continue
            size = run.column("n_shingles").to_pylist()
            bits = [int.from_bytes(b, "little") for b in run.column("bits").to_pylist()]
            label, a, b = list(range(len(node))), [], []
            for i in range(1, len(node)):
                for j in range(i - 1, -1, -1):  # sizes ascend: the band ends at the first too small
                    if 100 * size[j] < percent * size[i]:
                        break
                    if label[i] != label[j] and admits(size[i], size[j], bits[i], bits[j], percent):
                        old, new = label[j], label[i]
                        label = [new if x == old else x for x in label]
                        a.append(node[i])
                        b.append(node[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    cold = pairs.where("not hot").select("key", "node").join(rows.where("node is not null").select("node", "n_shingles", "bits").dropDuplicates(["node"]), "node")
    tiled = cold.repartition("key").sortWithinPartitions("key", "n_shingles", "node").mapInArrow(tiles, "a binary, b binary")
    starred = pairs.where("hot").select(F.col("node").alias("a"), F.concat(F.lit(b"hot:"), F.unhex(F.lpad(F.hex("key"), 16, "0")), F.lit(b"....")).alias("b"))
    near = stage(tiled.union(starred), "jaccard")
    coarse = components(near)
    discard(pairs, near)

    # The exact step: one text of each node in a coarse class of two or more.
    first = F.min(F.struct(F.col("id").isNull().alias("null_"), "id", "mark")).alias("f")
    named = rows.where("node is not null").groupBy("node").agg(first).select("node", "f.id", "f.mark")
    asked = coarse.join(named, "node").select("node", "root", F.col("id").alias("asked"), "mark")
    sizes = asked.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    asked = asked.join(sizes, "root")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, 2000):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text_"), k, powers)]
            own = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            t = pa.table([batch.column("node"), batch.column("root"), batch.column("n"), pa.array(sets, pa.binary())], names=["node", "root", "n", "hashes"])
            yield from t.filter(pa.array([a == b for a, b in zip(own, batch.column("node").to_pylist(), strict=True)], pa.bool_())).to_batches()

    # The same plan at every size: texts move once, to where their key is.
    one = F.col("id").eqNullSafe(F.col("asked")) & (texts["mark"] == asked["mark"])
    sets = texts.join(asked.hint("merge"), one).select("text_", "node", "root", "n").mapInArrow(fetch, "node binary, root binary, n bigint, hashes binary").dropDuplicates(["node"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    sets = stage(sets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "jaccard")
    deal = "root binary, block int, node binary, hashes binary, `known` binary, pivot boolean"
    here = sets.select("root", "block", "node", "hashes", F.lit(None).cast("binary").alias("known"), F.lit(False).alias("pivot"))
    common = sets.where("blocks > 1").where(F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")
    spread = common.select("root", "node", "hashes", "block", everywhere).where("at <> block").select("root", F.col("at").alias("block"), "node", "hashes", F.lit(None).cast("binary").alias("known"), F.lit(False).alias("pivot"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tagged() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tag = [r + b.to_bytes(4, "little") for r, b in zip(batch.column("root").to_pylist(), batch.column("block").to_pylist(), strict=True)]
                yield batch.append_column("tag", pa.array(tag, pa.binary()))

        for run in _runs_binary(tagged()):
            node = run.column("node").to_pylist()
            sets_ = [np.frombuffer(h, dtype=np.uint64) for h in run.column("hashes").to_pylist()]
            known, pivot = run.column("known").to_pylist(), run.column("pivot").to_numpy()
            if known[0] is None:
                label = exact_classes(sets_, percent)
            else:
                label = exact_classes(sets_, percent, np.unique(np.array(known, dtype=object), return_inverse=True)[1], np.flatnonzero(pivot))
            first: dict[int, bytes] = {}
            to = [first.setdefault(x, v) for x, v in zip(label.tolist(), node, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(to, pa.binary())], names=["a", "b"])

    def exact(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("root", "block").sortWithinPartitions("root", "block", "pivot", "node").mapInArrow(split, "a binary, b binary")

    links = stage(exact(here.union(spread)), "jaccard")
    if sets.where("blocks > 1").limit(1).count():
        # What the blocks of a class have not settled: nodes outside its largest class so far.
        so_far = components(links)
        large = sets.where("blocks > 1").join(so_far.withColumnRenamed("root", "class"), "node", "left").withColumn("known", F.coalesce("class", "node"))
        counts = large.groupBy("root", "known").agg(F.count("*").alias("m"))
        most = counts.groupBy("root").agg(F.max(F.struct("m", "known")).alias("most")).select("root", F.col("most.known").alias("most"))
        large = stage(large.join(most, "root").select("root", "block", "blocks", "node", "hashes", "known", (F.col("known") != F.col("most")).alias("rest")), "jaccard")
        everyone = large.select("root", "block", "node", "hashes", "known", F.lit(False).alias("pivot"))
        rest = large.where("rest").select("root", "node", "hashes", "known", everywhere).select("root", F.col("at").alias("block"), "node", "hashes", "known", F.lit(True).alias("pivot"))
        links = stage(links.union(exact(everyone.union(rest))), "jaccard")

    found = components(links)
    classes = named.join(found, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("least"))
    placed = classes.join(least, "root").select("node", "least", "root")
    out = rows.select("id", "mark", "node", "n_shingles").join(placed, "node", "left")
    out = stage(out.select(F.col("id").alias(key), "n_shingles", F.coalesce("least", "id").alias("component_id"), "mark", F.col("root").alias("class")), "jaccard")
    discard(rows, sets, links)
    return out if marks else out.drop("mark", "class")


def _runs_binary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """As _runs, for a binary column ``tag``."""
    held, tag = [], None
    for batch in batches:
        tags = batch.column("tag").to_pylist()
        start = 0
        for i, t in enumerate(tags):
            if t != tag:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, tag, start = [], t, i
        if len(tags) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
