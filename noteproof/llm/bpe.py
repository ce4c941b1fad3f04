"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols hang under a segment tree whose leaves hold the merge rank of each adjacent
pair; the root yields the leftmost pair of lowest rank, a merge updates three leaves, and each
update climbs a logarithmic path. Merging ends when the root holds no rank.

White space separates tokens in the vocabularies served here (a JSON file of the tokenizers
library with NFC, white-space folding, lower case, a split pattern and byte-level symbols with a
word-end suffix), so every run without white space is encoded by itself and the result kept in a
bounded per-process table.

Defined results: null text counts as empty and has no ids; repeated rows are encoded alike and
all returned; texts of any length are encoded whole; an empty table gives an empty result; input
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import RunTable, byte_symbols, vocabulary_file

_NO_RANK = 1 << 62
NO_RANK_32 = np.int32((1 << 31) - 1)


class SegmentTreeBpe:
    """Merges symbol ids. ``rank``: of a pair of ids; ``made``: by rank, the id that the merge makes."""

    def __init__(self, rank: dict[tuple[int, int], int], made: list[int]):
        self.rank, self.made = rank, made

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        shift = (n - 1).bit_length()
        size, mask = 1 << shift, (1 << shift) - 1
        rank, made, sym = self.rank, self.made, list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [_NO_RANK] * (2 * size)
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int) -> None:
            j = after[i]
            r = rank.get((sym[i], sym[j])) if j < n else None
            climb(i, _NO_RANK if r is None else r << shift | i)

        def climb(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        while (root := tree[1]) != _NO_RANK:
            i = root & mask
            j = after[i]
            sym[i] = made[root >> shift]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            climb(j, _NO_RANK)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out


class PairRanks:
    """Pair of ids to merge rank for whole arrays: open addressing, a handful of probes."""

    def __init__(self, rank: dict[tuple[int, int], int]):
        pairs = np.array(list(rank), np.int64).reshape(-1, 2)
        values = np.fromiter(rank.values(), np.int32, len(rank))
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.bits = max(4, (16 * len(rank)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK_32, np.int32)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NO_RANK_32)
        for _ in range(self.probes - 1):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out = np.where(self.keys[slot] == keys, self.values[slot], out)
        return out


def merge_many(sym: np.ndarray, n: np.ndarray, ranks: PairRanks, made: np.ndarray) -> np.ndarray:
    """The segment-tree merge of many short words at once, in place of ``sym`` (words x a power of two).

    Row k holds the ``n[k]`` symbols of a word and has a tree of its own. Each round takes every
    root that still holds a rank, merges there and climbs from the three touched leaves.
    Returns which symbols are left.
    """
    rows, size = sym.shape
    shift, mask = size.bit_length() - 1, size - 1
    column = np.arange(size, dtype=np.int64)
    alive = column < n[:, None]
    after = np.broadcast_to(column + 1, (rows, size)).copy()
    before = np.broadcast_to(column - 1, (rows, size)).copy()
    tree = np.full((rows, 2 * size), NO_RANK_32, np.int32)
    first = ranks(sym[:, :-1], sym[:, 1:])
    first = np.where((column[1:] < n[:, None]) & (first != NO_RANK_32), first << shift | column[:-1], NO_RANK_32)
    tree[:, size : 2 * size - 1] = first
    for level in range(shift - 1, -1, -1):
        low = 1 << level
        np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
    flat, symbols, nexts, prevs = tree.reshape(-1), sym.reshape(-1), after.reshape(-1), before.reshape(-1)
    active = np.flatnonzero(tree[:, 1] != NO_RANK_32)
    while len(active):
        root = flat[active * (2 * size) + 1].astype(np.int64)
        at, top, length = active * size, active * (2 * size), n[active]
        i = root & mask
        j = nexts[at + i]
        symbols[at + i] = made[root >> shift]
        behind = nexts[at + j]
        nexts[at + i] = behind
        inside = behind < length
        prevs[(at + behind)[inside]] = i[inside]
        alive[active, j] = False
        flat[top + size + j] = NO_RANK_32
        ahead = prevs[at + i]
        held = np.where(inside, behind, i)
        r = ranks(symbols[at + i], symbols[at + held])
        flat[top + size + i] = np.where(inside & (r != NO_RANK_32), r.astype(np.int64) << shift | i, NO_RANK_32)
        some = ahead >= 0
        p = np.where(some, ahead, i)
        r = ranks(symbols[at + p], symbols[at + i])
        flat[(top + size + p)[some]] = np.where(r != NO_RANK_32, r.astype(np.int64) << shift | p, NO_RANK_32)[some]
        for leaf in (j, i, p):
            k = (size + leaf) >> 1
            while k[0]:
                left = top + 2 * k
                flat[top + k] = np.minimum(flat[left], flat[left + 1])
                k >>= 1
        active = active[flat[top + 1] != NO_RANK_32]
    return alive


class WordBpe(RunTable):
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(vocabulary_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        rank: dict[tuple[int, int], int] = {}
        made = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rank.setdefault((vocab[a], vocab[b]), k)
            made.append(vocab[a + b])
        self.bpe = SegmentTreeBpe(rank, made)
        self.ranks, self.made = PairRanks(rank), np.array(made, np.int64)
        # every byte, inside a word and at its end, is a symbol of the vocabularies served
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int64)

    def first_symbols(self, word: bytes) -> np.ndarray:
        data = np.frombuffer(word, np.uint8)
        sym = self.inner[data]
        sym[-1] = self.last[data[-1]]
        return sym

    def merge_bytes(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        sizes, found, low = np.zeros(len(data), np.int64), [], 0
        for size in (4, 8, 16, 32, 64):
            chosen = np.flatnonzero((lengths > low) & (lengths <= size))
            low = size
            for part in np.array_split(chosen, -(-len(chosen) // 4096)) if len(chosen) else []:
                n = lengths[part]
                joined = np.frombuffer(b"".join([data[k] for k in part.tolist()]), np.uint8)
                sym = np.zeros((len(part), size), np.int64)
                sym[np.arange(size) < n[:, None]] = self.inner[joined]
                sym[np.arange(len(part)), n - 1] = self.last[joined[np.cumsum(n) - 1]]
                alive = merge_many(sym, n, self.ranks, self.made)
                sizes[part] = alive.sum(1)
                found.append((part, sym[alive]))
        for k in np.flatnonzero(lengths > low).tolist():
            ids = np.array(self.bpe.merge(self.first_symbols(data[k]).tolist()), np.int64)
            sizes[k] = len(ids)
            found.append((np.array([k]), ids))
        out, start = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        for part, ids in found:
            n = sizes[part]
            out[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def encode_words(self, words: list[str]) -> None:
        ids, sizes = self.merge_bytes([w.encode("utf-8", "surrogatepass") for w in words])
        packed, to = ids.astype("<u4").tobytes(), np.cumsum(4 * sizes).tolist()
        self.words.update(zip(words, [packed[a:b] for a, b in zip([0, *to], to)], strict=True))  # noqa: B905


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class TokenNames:
    """Decoder: token strings joined by a space, as the vocabulary names no decoder."""

    def __init__(self, path: str):
        with open(vocabulary_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def names(path: str) -> TokenNames:
    return TokenNames(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids: binary of little-endian unsigned 32-bit ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded: the text of the ids, special tokens included. Null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = names(path)
        for batch in batches:
            texts = [None if x is None else held.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
