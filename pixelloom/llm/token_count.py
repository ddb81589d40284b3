"""Token counts by rank-synchronous array merging.

Counts what the ``tokenizers`` library gives for a byte-level, word-end BPE file
(lower case, NFC, white space dropped) without running its encoder: all new pre-tokens
of a batch are held as one ragged array of symbol ids, and each round applies every
sequence's lowest-rank pair at once, until no sequence has a pair left.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced, utf8

#: The white space of the Unicode standard (the library's ``\s``).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens kept with their counts in each worker; past this the memory starts anew.
CACHE = 1_000_000
_INFINITE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class RankMerger:
    """Counts the symbols that a BPE model leaves of each pre-token of a batch."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        signs = byte_symbols()
        self.plain = np.array([vocab.get(s, -1) for s in signs], dtype=np.int64)
        self.last = np.array([vocab.get(s + end, -1) for s in signs], dtype=np.int64)
        self.base = max(vocab.values()) + 2
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.made_by_rank = made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], _INFINITE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words)), length)
        ids = self.plain[raw]
        ends = np.cumsum(length)[length > 0] - 1
        ids[ends] = self.last[raw[ends]]
        while len(ids):
            rank = np.full(len(ids), _INFINITE)
            inside = owner[1:] == owner[:-1]
            at = np.flatnonzero(inside)
            rank[at] = self._rank(ids[at], ids[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            done = best == _INFINITE
            out[owner[starts[done]]] = sizes[done]
            low = np.repeat(best, sizes)
            live = low != _INFINITE
            hit = live & (rank == low)
            # Of overlapping hits (runs as in "aaaa") every other one applies, from the left.
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            place = np.arange(len(ids)) - run[np.maximum(np.cumsum(hit & ~np.r_[False, hit[:-1]]) - 1, 0)] if len(run) else np.zeros(len(ids), np.int64)
            hit &= place % 2 == 0
            ids[hit] = self.made_by_rank[rank[hit]]
            keep = live & ~np.r_[False, hit[:-1]]
            ids, owner = ids[keep], owner[keep]
        return out


class TokenCounter:
    """Counts tokens of whole texts as the tokenizer file defines them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Only its tables of letters are used, and only for words beyond ASCII.
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.merge = RankMerger(spec)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE), regex.V0).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.chunks = regex.compile(f"[^{SPACE}]+").findall
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.known: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def _parts(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [p.encode() for p in self.pieces(chunk.lower())]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cut(self.normalize(chunk))]

    def _learn(self, chunks: set[str]) -> None:
        plans = []
        for chunk in chunks:
            extra, parts = 0, []
            if self.special and self.special.search(chunk):
                extra = len(self.special.findall(chunk))
                for part in self.special.split(chunk):
                    parts += self._parts(part)
            else:
                parts = self._parts(chunk)
            plans.append((chunk, extra, parts))
        new = list({p for _, _, parts in plans for p in parts}.difference(self.words))
        # Short sequences need few rounds: words of like length go together.
        new.sort(key=len)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.words.update(zip(some, self.merge.counts(some).tolist(), strict=True))
        for chunk, extra, parts in plans:
            self.known[chunk] = extra + sum(self.words[p] for p in parts)

    def count(self, texts: list[str]) -> list[int]:
        # Before what is new is told, so that nothing this batch needs is forgotten.
        for memory in (self.known, self.words):
            if len(memory) > CACHE:
                memory.clear()
        split = [self.chunks(t) if self.odd(t) else t.split() for t in texts]
        fresh = {c for s in split for c in s}.difference(self.known)
        if fresh:
            self._learn(fresh)
        known = self.known
        return [sum([known[c] for c in s]) for s in split]


@functools.lru_cache(maxsize=2)
def worker_counter(path: str) -> TokenCounter:
    """The counter of this worker process; the tasks that it runs share what it has learnt."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Special strings inside a text count as one token each, which is the library's default.
    A null or empty text has 0 bytes and 0 tokens; a null key, a repeated row and other
    columns of any name pass without effect; very long texts are counted whole. No shuffle.
    ``tokenizer`` is a file path that every executor can read.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in sliced(batches, 1000):
            raw = utf8(batch.column(1))
            n = pa.array(counter.count([r.decode() for r in raw]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
