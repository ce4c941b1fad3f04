"""Language-model scoring by subword lattices.

The model is a unigram model over an existing vocabulary's pieces (byte-level, with a word-end
mark). Pieces are first weighed by how often the vocabulary's own merges use them in the words of
the training texts, then by their expected uses over all segmentations of those words
(forward and backward sums), ``ROUNDS`` times; each round counts every occurrence of every training word. A
word's probability is the sum over all its segmentations, by a forward recursion in log space. A
text's probability is the product over its words and the end: after each word the text goes on
or ends, with the share of ends among the training tokens.

Texts are read once, into chunks with their own word lists. Each distinct word of the corpus is
then counted and scored once, and the results return to the chunks by word, so that no row per
running word is ever shuffled. Words that most chunks hold are in a bounded table that is
broadcast, the others are joined.

A text is held out of training when crc32 of its doc_id's decimal text, modulo ``fold``, is 0.
Words are runs of bytes other than space and 0x09-0x0D after A-Z became a-z.

Defined results: null and empty texts are the end alone; texts may have any length; a null doc_id
counts as the empty string for the fold; repeated rows are counted and scored each; with no
training texts every count is 0 and N is 0, all pieces weigh alike and an end is as likely as not;
columns other than doc_id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import secrets
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import drop_materialized, materialize, text_or_empty
from .shingles import mixed
from .tokens import byte_symbols, vocabulary_file

FOLD = 10
#: Bytes of text in one chunk, about.
CHUNK_BYTES = 8_000_000
#: Pseudo-count of a piece.
PIECE_PRIOR = 0.01
#: Rounds of expected counts, and the fraction of a use that they are counted in.
ROUNDS, UNIT = 2, 1024
#: Words whose scores are broadcast: those that most chunks hold.
COMMON = 20_000
#: Words scored together.
WORD_BATCH = 40_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOG10 = float(np.log(10))


def held_out(doc_id: int | None, fold: int = FOLD) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % fold == 0


_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<long>"


def chunk_texts(docs: DataFrame, fold: int) -> DataFrame:
    """Chunks of documents: word numbers into the chunk's own list, and the list's training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, held, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.zeros(len(number), np.int64)
            train = [p for p, h in zip(parts, held, strict=True) if not h]
            if train and len(number):
                counts += np.bincount(np.concatenate(train), minlength=len(number))
            row = [secrets.randbits(62), ids, held, [len(p) for p in parts], np.concatenate(parts).astype("<i4").tobytes(), [w.decode("utf-8") for w in number], counts]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode("utf-8").lower().split()
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                held.append(held_out(doc, fold))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush()
                    number.clear()
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, _CHUNKS)


def _padded(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def _per_piece(words: DataFrame, path: str, count: Callable[[list[bytes], np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of ``count`` per piece over the distinct training words and their counts; one row per piece and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size(path))
        for listed, rows in _gathered(batches):
            total += count(listed, rows["c"].to_numpy())
        used = np.flatnonzero(total)
        # whole numbers, so that the order of the sum is of no account
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.rint(total[used] * UNIT).astype(np.int64))], ["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary_size(path))
    for r in rows:  # one row per piece
        counts[r.piece] = r.n / UNIT
    return counts


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weight of each piece; words: word, c (occurrences in training texts)."""

    def merged(listed: list[bytes], c: np.ndarray) -> np.ndarray:
        ids, sizes = bpe.load(path).merge_bytes(listed)
        return np.bincount(ids, np.repeat(c, sizes), vocabulary_size(path))

    def logs_of(counts: np.ndarray) -> np.ndarray:
        logs, pieces = np.full(len(counts), -np.inf), load_lattice(path).pieces
        logs[pieces] = np.log((counts[pieces] + PIECE_PRIOR) / (counts[pieces].sum() + PIECE_PRIOR * len(pieces)))
        return logs

    logs = logs_of(_per_piece(words, path, merged))
    for _ in range(rounds):
        logs = logs_of(_per_piece(words, path, lambda listed, c, held=logs: load_lattice(path).expected_counts(listed, held, c)))
    return logs


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    with open(vocabulary_file(path), encoding="utf-8") as f:
        return max(json.load(f)["model"]["vocab"].values()) + 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.Table]]:
    """Words (the first column) and whole rows, about ``WORD_BATCH`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[list[bytes], pa.Table]:
        table = pa.Table.from_batches(held)
        return table.column(0).cast(pa.binary()).to_pylist(), table

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= WORD_BATCH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


class PieceTable:
    """Substring hash to piece number (-1: none), for pieces inside a word or at its end.

    One probe of a large table, then of small ones, each for the pieces that found their slot taken in the one before."""

    BITS = (20, 14, 10)

    def __init__(self, pieces: list[bytes], numbers: list[int]):
        keys = np.zeros(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) & ((1 << 64) - 1)
            keys[k] = h
        numbers = np.array(numbers, np.int32)
        self.tables, left = [], np.arange(len(keys))
        while len(left):
            bits = self.BITS[min(len(self.tables), len(self.BITS) - 1)]
            slot = self._slot(keys[left], len(self.tables), bits)
            first = np.unique(slot, return_index=True)[1]
            key, number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            key[slot[first]], number[slot[first]] = keys[left[first]], numbers[left[first]]
            self.tables.append((key, number, bits))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        # another hash at each level, so that what met once is unlikely to meet again
        return (mixed(keys + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        for level, (key, number, bits) in enumerate(self.tables):
            slot = self._slot(keys, level, bits)
            hit = key[slot] == keys
            out[hit] = number[slot[hit]]
        return out


class Lattice:
    """All segmentations of words into pieces: marginal log probabilities and expected piece counts."""

    def __init__(self, path: str):
        with open(vocabulary_file(path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        inner: tuple[list[bytes], list[int]] = ([], [])
        last: tuple[list[bytes], list[int]] = ([], [])
        for token, k in model["vocab"].items():
            at_end = bool(end) and token.endswith(end)
            body = token[: -len(end)] if at_end else token
            if body and all(c in byte_of for c in body):
                for to in ([last] if at_end else [inner]) if end else [inner, last]:
                    to[0].append(bytes(byte_of[c] for c in body))
                    to[1].append(k)
        self.inner, self.last = PieceTable(*inner), PieceTable(*last)
        self.pieces = np.array(sorted({*inner[1], *last[1]}))
        self.longest = max(map(len, inner[0] + last[0]))

    def forward(self, words: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Forward log sums at each place of words of one length (rows of bytes), and the edges: per end, first start, pieces, weights.

        ``logs`` holds a log weight per piece, and one more entry, -inf, for no piece."""
        n, length = words.shape
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        hashes = np.zeros((n, length), np.uint64)
        edges = []
        for j in range(1, length + 1):
            low = max(0, j - self.longest)
            hashes[:, low:j] = hashes[:, low:j] * _BASE + (words[:, j - 1 : j].astype(np.uint64) + np.uint64(1))
            found = (self.last if j == length else self.inner)(hashes[:, low:j])
            weight = logs[found]
            paths = alpha[:, low:j] + weight
            top = paths.max(1)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[:, j] = safe + np.log(np.exp(paths - safe[:, None]).sum(1))
            edges.append((low, found, weight))
        return alpha, edges

    def expected(self, words: np.ndarray, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` occurrences of the words, by forward and backward sums."""
        alpha, edges = self.forward(words, logs)
        n, length = words.shape
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0
        total = np.zeros(len(logs))
        for j in range(length, 0, -1):
            low, found, weight = edges[j - 1]
            onward = weight + beta[:, j : j + 1]
            beta[:, low:j] = np.logaddexp(beta[:, low:j], onward)
            at, start = np.nonzero(found >= 0)
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[at, low + start] + onward[at, start] - alpha[at, length]) * counts[at]
            total += np.bincount(found[at, start], np.nan_to_num(share), len(logs))
        return total

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words of one length, and those words as rows of bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[by], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(by)]):  # noqa: B905
            size = max(1, 100_000 // max(1, int(lengths[by[a]])))
            for low in range(a, b, size):
                rows = by[low : min(b, low + size)]
                yield rows, _padded([words[k] for k in rows.tolist()], int(lengths[rows[0]]))

    def expected_counts(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logs = np.append(logs, -np.inf)
        return sum((self.expected(x, logs, counts[rows]) for rows, x in self._by_length(words)), np.zeros(len(logs)))[:-1]

    def __call__(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """Log probability of each word: the sum over all its segmentations."""
        logs, out = np.append(logs, -np.inf), np.zeros(len(words))
        for rows, x in self._by_length(words):
            out[rows] = self.forward(x, logs)[0][:, -1]
        return out


@lru_cache(maxsize=2)
def load_lattice(path: str) -> Lattice:
    return Lattice(path)


def score_documents(docs: DataFrame, path: str, *, fold: int = FOLD, prior: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    chunks = materialize(spark, chunk_texts(docs, fold), "chunks", compression="zstd")
    words = materialize(
        spark,
        chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c"), F.count(F.lit(1)).alias("chunks")),
        "words",
        compression="zstd",
    )
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = chunks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    n, v = totals.n + ends, totals.v + (ends > 0)
    logs = fit_pieces(words, path)
    stop = (ends + 0.5) / (n + 1)
    on_log, end_log = float(np.log(1 - stop)), float(np.log(stop))

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load_lattice(path)
        for listed, rows in _gathered(batches):
            yield from rows.append_column("lp", pa.array(score(listed, logs) + on_log)).to_batches()

    scored = materialize(spark, words.select("word", "c", "chunks").mapInArrow(lattice, "word string, c long, chunks long, lp double"), "scored", compression="zstd")
    drop_materialized(spark, words)
    common = F.broadcast(scored.where("chunks > 1").orderBy(F.desc("chunks"), "word").limit(COMMON).select("word", "c", "lp"))  # COMMON rows at most
    needed = chunks.select("chunk", F.posexplode("words").alias("pos", "word"))
    known = needed.join(common, "word").unionByName(needed.join(common, "word", "left_anti").join(scored.select("word", "c", "lp"), "word"))
    known = known.select("chunk", "pos", "c", "lp")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        pos = right["pos"].to_numpy()
        c, lp = np.zeros(len(pos), np.int64), np.zeros(len(pos))
        c[pos], lp[pos] = right["c"].to_numpy(), right["lp"].to_numpy()
        base = np.log10((c + prior) / (n + prior * (v + 1)))
        base_end = float(np.log10((ends + prior) / (n + prior * (v + 1))))
        for row in left.to_pylist():
            tokens, at = np.frombuffer(row["tokens"], "<i4"), 0
            for doc, held, size in zip(row["doc_ids"], row["held"], row["sizes"], strict=True):
                t = tokens[at : at + size]
                at += size
                values = (doc, held, size + 1, int((c[t] > 0).sum()) + (ends > 0), n, float(base[t].sum()) + base_end, (float(lp[t].sum()) + end_log) / _LOG10)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), kinds, strict=True)})

    kept = chunks.select("chunk", "doc_ids", "held", "sizes", "tokens")
    return (
        kept.groupBy("chunk").cogroup(known.toDF(*known.columns).groupBy("chunk"))
        .applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
