"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds the concatenated ids of consecutive documents and where each begins. The
begins are a non-decreasing sequence; Elias-Fano keeps its low bits packed and its high
bits as a unary bit string, about ``2 + log2(ids / documents)`` bits a document. A select
structure (the number of ones before every 512th word) finds the k-th one, and so the
k-th begin, without a table of 64-bit offsets.

Layout of a shard, little-endian: magic ``PLEF``, version u32, id width u32 (2 or 4
bytes), low-bit width u32, documents u64, ids u64, low words u64, high words u64, then
the low words (u64), the high words (u64) and the ids.

Shards travel as a binary column of a Parquet table, so Spark's committer writes them
(whole or not at all, on any file system) and a lost executor only repeats its task.
``unpack`` reads one shard's bytes; ``shard_bytes`` of a row can be saved as a file as is.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, sliced, stage
from .token_count import SPACE

MAGIC = b"PLEF"
_HEADER = np.dtype([("magic", "S4"), ("version", "<u4"), ("width", "<u4"), ("low", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("low_words", "<u8"), ("high_words", "<u8")])
#: Ids of a shard at least, unless its partition ends: bounds what a task holds.
SHARD_IDS = 2_000_000
#: Chunks kept with their ids in each worker; past this the memory starts anew.
CACHE = 1_000_000


class EliasFano:
    """A non-decreasing sequence of ``n + 1`` values: the begins and the end of all."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self._every = 512
        self._before = np.r_[0, np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self._every)))] if len(ones) else np.zeros(1, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(-(-n * bits // 64), dtype=np.uint64)
        if bits:
            part = (values[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)
            low = _pack(part.astype(np.uint8).ravel(), len(low))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flat = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flat[ones] = 1
        return cls(n, bits, low, _pack(flat, -(-len(flat) // 64)))

    def select(self, k: int) -> int:
        """The k-th value."""
        block = int(np.searchsorted(self._before, k, side="right")) - 1
        words = self.high[block * self._every : (block + 1) * self._every]
        upto = np.cumsum(np.bitwise_count(words).astype(np.int64))
        rest = k - int(self._before[block])
        w = int(np.searchsorted(upto, rest, side="right"))
        rest -= int(upto[w - 1]) if w else 0
        bits = np.flatnonzero(np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little"))
        one = (block * self._every + w) * 64 + int(bits[rest])
        return (one - k) << self.low_bits | self._low_of(k)

    def _low_of(self, k: int) -> int:
        if not self.low_bits:
            return 0
        at, shift = divmod(k * self.low_bits, 64)
        word = int(self.low[at]) | (int(self.low[at + 1]) << 64 if at + 1 < len(self.low) else 0)
        return word >> shift & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def _pack(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, dtype=np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def pack(ids: bytes, width: int, begins: np.ndarray) -> bytes:
    """A shard. ``begins``: of each document, and last the number of ids."""
    ef = EliasFano.of(begins)
    head = np.array([(MAGIC, 1, width, ef.low_bits, len(begins) - 1, len(ids) // width, len(ef.low), len(ef.high))], dtype=_HEADER)
    return head.tobytes() + ef.low.astype("<u8").tobytes() + ef.high.astype("<u8").tobytes() + ids


def unpack(shard: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries and the ids of a shard."""
    head = np.frombuffer(shard, dtype=_HEADER, count=1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token shard")
    at = _HEADER.itemsize
    low = np.frombuffer(shard, "<u8", int(head["low_words"]), at)
    at += low.nbytes
    high = np.frombuffer(shard, "<u8", int(head["high_words"]), at)
    at += high.nbytes
    ids = np.frombuffer(shard, f"<u{head['width']}", int(head["ids"]), at)
    return EliasFano(int(head["docs"]) + 1, int(head["low"]), low, high), ids


class ChunkEncoder:
    """Ids of whole texts by the ``tokenizers`` library, each distinct chunk encoded once.

    A chunk is a run of non-space with one space before it, or a run of white space less
    the space that the next word takes. The library's splitter never joins across these
    borders, nor across that of a letter and a final punctuation mark, so a text's ids are
    those of its chunks. New chunks are encoded in lots, one a line: a line break is a
    token of its own there. Texts with a special string are encoded whole by the library,
    because it cuts there first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        #: White space that asks for the general split, and runs of the usual kind.
        self.odd = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", "\n\n", "\n ", " \n"]
        self.spacing = re.compile(r"\s").search
        (self.line,) = self.library.encode("\n", add_special_tokens=False).ids
        self.alone: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, known: dict[str, bytes], before: str, chunks: set[str]) -> None:
        fresh = chunks.difference(known)
        lone = set() if before else {c for c in fresh if self.spacing(c)}
        known.update((c, self._whole(before + c)) for c in lone)
        tailed = {c for c in fresh if c[-2:-1].isalpha() and c[-1] in ".,;:!?"} - lone
        plain = list((fresh - tailed - lone | {c[:-1] for c in tailed}).difference(known))
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self._bytes(self.library.encode_batch_fast(["\n".join([before + c for c in some])], add_special_tokens=False)[0].ids)
            array = np.frombuffer(ids, dtype=f"<u{self.width}")
            ends = np.r_[np.flatnonzero(array == self.line), len(array)] * self.width
            begins = np.r_[0, ends[:-1] + self.width]
            known.update(zip(some, [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], strict=True))
        tails = {c: self._whole(c) for c in {c[-1] for c in tailed}}
        known.update((c, known[c[:-1]] + tails[c[-1]]) for c in tailed)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, ``width`` bytes each."""
        if len(self.alone) + len(self.spaced) > CACHE:
            # Frequent chunks are met, and so learnt, first: the older half stays.
            self.alone, self.spaced = (dict(itertools.islice(d.items(), len(d) // 2)) for d in (self.alone, self.spaced))
        if "\n" not in self.alone or "" not in self.spaced:
            self.alone |= {"": b"", "\n": self._whole("\n")}
            self.spaced[""] = self._whole(" ")
        # A plan is a list of finished bytes and of (first, rest) lines with new chunks.
        plans: list[list | None] = []
        alone, spaced, find = set(), set(), self.spaced.get
        for text in texts:
            if any([s in text for s in self.special]):
                plans.append(None)
                continue
            plan: list = []
            plans.append(plan)
            if any([x in text for x in self.odd]):
                plan += [(c, ()) for c in self.chunks(text)]
                alone.update(c for c, _ in plan)
                continue
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if k:
                    plan.append(self.alone["\n"])
                if first not in self.alone:
                    alone.add(first)
                got = list(map(find, rest))
                try:
                    plan += [(first, ()), b"".join(got)]
                except TypeError:  # one is missing
                    spaced.update([w for w, g in zip(rest, got, strict=True) if g is None])
                    plan.append((first, rest))
        self._learn(self.alone, "", alone)
        self._learn(self.spaced, " ", spaced)
        at, after = self.alone, self.spaced
        done = []
        for text, plan in zip(texts, plans, strict=True):
            if plan is None:
                done.append(self._whole(text))
                continue
            parts = []
            for part in plan:
                if isinstance(part, bytes):
                    parts.append(part)
                else:
                    parts.append(at[part[0]])
                    parts += map(after.__getitem__, part[1])
            done.append(b"".join(parts))
        return done


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process; the tasks that it runs share what it has learnt."""
    return ChunkEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The table of shards, ``part, shard, keys, shard_bytes``, in ascending ``key`` order.

    Documents go by key ranges to partitions (a range never depends on the source or the
    length of a text), so partitions and the shards inside are in order. Each document is
    its whole text's ids and then ``end_id``; a null or empty text is ``end_id`` alone. Null
    keys come first; rows with the same key follow each other by their texts.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("shard_bytes", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        part, shard, keys, parts, held = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, keys, parts, held
            begins = np.r_[0, np.cumsum([len(p) // encoder.width for p in parts])]
            data = pack(b"".join(parts), encoder.width, begins)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_ids": int(begins[-1]), "keys": keys, "shard_bytes": data}], schema=arrow)
            shard, keys, parts, held = shard + 1, [], [], 0
            return row

        arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("keys", pa.list_(key_type)), ("shard_bytes", pa.binary())])
        for batch in sliced(batches, 500):
            part = batch.column(2)[0].as_py()
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                keys.append(k)
                parts.append(ids + end)
                held += len(parts[-1]) // encoder.width
                if held >= SHARD_IDS:
                    yield flush()
        if keys:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(key, text).repartitionByRange(n, F.col(key).asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    return ordered.select(key, text, F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from the shards' bytes.

    ``start`` counts the ids of all documents before it in the whole table. Only the id
    counts of shards (one row for millions of ids) meet in one place to be summed up.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.groupBy("part", "shard").agg(F.sum("n_ids").alias("n_ids"))
    before = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    item = shards.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, item), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            bounds, ids = unpack(batch.column("shard_bytes")[0].as_py())
            at = bounds.all()
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([batch.column("keys")[0].values, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([batch.column("part")[0].as_py()] * n, pa.int32()), pa.array([batch.column("shard")[0].as_py()] * n, pa.int32())], names=schema.names)

    docs = shards.select("part", "shard", "keys", "shard_bytes").mapInArrow(run, schema)
    return docs.join(before, ["part", "shard"]).select(key, (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read them back.

    An empty table gives an empty result. Other columns, of any name, are not read.
    """
    return read_shards(stage(write_shards(docs, tokenizer, end_id, text, key), "tokens"), key)


__all__ = ["EliasFano", "pack", "read_shards", "shared_dir", "token_binary", "unpack", "write_shards"]
