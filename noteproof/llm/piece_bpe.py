"""Encoding and decoding of merge-type SentencePiece vocabularies with a score-ordered agenda.

A run of symbols has an agenda of its adjacent pairs that make a piece, the best score first and the leftmost among equals. The top pair is merged
if both sides are still what they were, and the pairs with its new neighbours join the agenda, until none is left. Symbols
without a piece become their UTF-8 bytes.

No merge crosses two neighbouring characters that stand side by side in no piece, so texts are cut there first, for whole Arrow batches
at once, and distinct runs are encoded once per worker (a bounded table). The runs that a batch adds are checked against the sentencepiece
library, and another result is an error; ``check_documents`` compares whole texts.

Served are vocabularies whose normaliser only puts a space before a text and shows spaces as U+2581, and that have a piece for
every byte; others are refused.

Defined results: null text counts as empty, whose ids are the end id alone; repeated rows are encoded alike and all returned; texts of any length are
encoded whole; null ids decode to null; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NO_RANK_32, PairRanks
from .common import text_or_empty
from .tokens import by_length, vocabulary_file

SPACE = "▁"
#: Runs that a worker keeps; the table is emptied when full, before a batch.
RUN_TABLE = 400_000


class PieceBpe:
    """Pieces and scores of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(path))
        sp, n = self.library, self.library.get_piece_size()
        if sp.normalize("  a ▁ﬁ\t") != "▁▁▁a▁▁ﬁ\t":
            raise ValueError("the vocabulary has a normaliser that is not served")
        names = [sp.id_to_piece(i) for i in range(n)]
        self.end_id = sp.eos_id()
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        self.byte_id = {int(names[i][3:5], 16): i for i in byte_ids}
        self.ids = {names[i]: i for i in plain}
        scores = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        if any("\n" in p for p in self.ids):
            raise ValueError("the vocabulary has a piece with a line feed")
        pack = lambda i: int(i).to_bytes(4, "little")
        self.packed, self.byte_ids = {p: pack(i) for p, i in self.ids.items()}, {b: pack(i) for b, i in self.byte_id.items()}
        self.mark = self.byte_ids[10]
        #: Lower is better; equal scores share a rank.
        self.rank = {names[i]: scores[sp.get_score(i)] for i in plain}
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in self.ids:
            k = self.letter[[ord(c) for c in piece]]
            self.joins[k[:-1], k[1:]] = True
        # symbols of the array form: pieces, then letters that are none; pairs of symbols that make a piece
        names_of = [*self.ids, *[c for c in letters if c not in self.ids]]
        symbol = {p: k for k, p in enumerate(names_of)}
        self.letter_symbol = np.array([0, *[symbol[c] for c in letters]], np.int64)
        pairs = {(symbol[p[:k]], symbol[p[k:]]): symbol[p] for p in self.ids for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pairs = PairRanks({pair: k for k, pair in enumerate(pairs)})
        self.made = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.made_rank = np.array([self.rank[names_of[k]] for k in pairs.values()], np.int64)
        self.symbol_ids = [self.encode_symbol(p) for p in names_of]
        raw = [b""] * n
        for i in plain:
            raw[i] = names[i].replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            raw[i] = bytes([value])
        raw[sp.unk_id()] = " ⁇ ".encode()
        self.sizes = np.fromiter(map(len, raw), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        #: What a decoded text may begin with: such a piece loses its first space.
        self.spaced = np.zeros(n, bool)
        self.spaced[[i for i in plain if names[i].startswith(SPACE)]] = True
        self.is_byte = np.zeros(n, bool)
        self.is_byte[byte_ids] = True
        self.table: dict[str, bytes] = {}

    def merge(self, run: str) -> list[str]:
        """Pieces of a run: merges by the agenda, whose entries hold rank and left symbol."""
        symbols, n, rank = list(run), len(run), self.rank.get
        shift = n.bit_length()
        mask = (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        # the entry that holds for the pair that starts at a symbol; others in the agenda are out of date
        valid = [-1] * n
        agenda = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                valid[i] = r << shift | i
                agenda.append(valid[i])
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & mask
            if valid[i] != top:
                continue
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = ""
            valid[j] = valid[i] = -1
            behind = after[i] = after[j]
            before[behind] = i
            if behind < n:
                r = rank(symbols[i] + symbols[behind])
                if r is not None:
                    valid[i] = r << shift | i
                    heapq.heappush(agenda, valid[i])
            k = before[i]
            if k >= 0:
                r = rank(symbols[k] + symbols[i])
                valid[k] = -1 if r is None else r << shift | k
                if r is not None:
                    heapq.heappush(agenda, valid[k])
        return [s for s in symbols if s]

    def merge_many(self, points: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Symbols (runs x ``size``, -1 where none is left) of runs given as ``n`` code points each, all agendas at once: an array of entries a
        run, of which every round takes the least and changes two."""
        rows, shift = len(n), size.bit_length()
        mask, none, column = (1 << shift) - 1, (1 << 62), np.arange(size)
        inside = column < n[:, None]
        sym = np.full((rows, size), -1, np.int64)
        sym[inside] = self.letter_symbol[self.letter[points]]
        after, before = np.broadcast_to(column + 1, (rows, size)).copy(), np.broadcast_to(column - 1, (rows, size)).copy()
        which = np.full((rows, size), NO_RANK_32, np.int64)
        which[:, :-1] = np.where(inside[:, 1:], self.pairs(sym[:, :-1], sym[:, 1:]), NO_RANK_32)

        def entry(pair: np.ndarray, i: np.ndarray) -> np.ndarray:
            found = pair != NO_RANK_32
            return np.where(found, self.made_rank[np.where(found, pair, 0)] << shift | i, none)

        agenda = entry(which, column)
        active = np.flatnonzero((agenda < none).any(1))
        while len(active):
            top = agenda[active].min(1)
            active, top = active[top < none], top[top < none]
            i = top & mask
            j = after[active, i]
            sym[active, i], sym[active, j], agenda[active, j] = self.made[which[active, i]], -1, none
            behind = after[active, i] = after[active, j]
            has = behind < n[active]
            held = np.where(has, behind, i)
            before[active[has], behind[has]] = i[has]
            pair = np.where(has, self.pairs(sym[active, i], sym[active, held]), NO_RANK_32)
            which[active, i], agenda[active, i] = pair, entry(pair, i)
            ahead = before[active, i]
            rest, k, i = active[ahead >= 0], ahead[ahead >= 0], i[ahead >= 0]
            pair = self.pairs(sym[rest, k], sym[rest, i])
            which[rest, k], agenda[rest, k] = pair, entry(pair, k)
        return sym

    def encode_symbol(self, piece: str) -> bytes:
        ids = self.packed.get(piece)
        return ids if ids is not None else b"".join([self.byte_ids[b] for b in piece.encode("utf-8")])

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Packed ids of each run."""
        out, lengths, low = [b""] * len(runs), np.fromiter(map(len, runs), np.int64, len(runs)), 1
        for k in np.flatnonzero(lengths == 1).tolist():
            out[k] = self.encode_symbol(runs[k])
        for size in (4, 8, 12, 16, 32):
            chosen = np.flatnonzero((lengths > low) & (lengths <= size))
            low = size
            for part in np.array_split(chosen, -(-len(chosen) // 8192)) if len(chosen) else []:
                points = np.frombuffer("".join([runs[k] for k in part.tolist()]).encode("utf-32-le"), np.uint32)
                sym = self.merge_many(points, lengths[part], size)
                names, left = self.symbol_ids, sym >= 0
                flat, to = [names[k] for k in sym[left].tolist()], np.append(0, np.cumsum(left.sum(1))).tolist()
                for k, a, b in zip(part.tolist(), to, to[1:]):  # noqa: B905
                    out[k] = b"".join(flat[a:b])
        for k in np.flatnonzero(lengths > low).tolist():
            out[k] = b"".join(map(self.encode_symbol, self.merge(runs[k])))
        return out

    def fill(self, runs: list[str]) -> None:
        """Add runs to the table, checked against the library: one text of all runs, apart by line feeds, which no piece holds."""
        new = self.encode_runs(runs)
        self.table.update(zip(runs, new, strict=True))
        kept = [k for k, r in enumerate(runs) if "\n" not in r]
        theirs = np.array(self.library.encode("\n" + "\n".join([runs[k] for k in kept])), "<i4") if kept else np.zeros(0, "<i4")
        mine = b"".join([self.mark + new[k] for k in kept])
        # before the first line feed the library puts its space
        if kept and theirs[1:].tobytes() != mine:
            raise ValueError("the library encodes a run in another way")

    def runs(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Runs of all texts, one after the other, and how many each text has."""
        shown = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(shown)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        letters = self.letter[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joins[letters[:-1], letters[1:]]
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
        cut[ends] = cut[0] = True
        at = np.flatnonzero(cut)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.append(0, np.cumsum(width))[at].astype("<i4")
        flat = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode())])
        upto = np.searchsorted(at, ends)
        return flat, np.diff(upto, prepend=0)

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, with the end id after each, and where each text's end."""
        found, ends, base = [], [], 0
        for low, high in by_length(np.fromiter(map(len, texts), np.int64, len(texts))):
            if len(self.table) > RUN_TABLE:
                self.table = {}
            part = texts[low:high]
            flat, counts = self.runs(part)
            coded = flat.dictionary_encode()
            distinct, table = coded.dictionary.to_pylist(), self.table
            if missing := [r for r in distinct if r not in table]:
                self.fill(missing)
            parts = list(map(table.__getitem__, distinct))
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            known, which = np.frombuffer(b"".join(parts), "<i4"), coded.indices.to_numpy(zero_copy_only=False)
            n = sizes[which]
            to = np.append(0, np.cumsum(n))
            ids = known[np.repeat((np.cumsum(sizes) - sizes)[which] - to[:-1], n) + np.arange(to[-1])] if len(known) else np.zeros(0, "<i4")
            stops = to[np.cumsum(counts)]
            found.append(np.insert(ids, stops, self.end_id))
            ends.append(base + stops + np.arange(1, len(part) + 1))
            base += len(found[-1])
        if not found:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(ends)

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Text of each list of ids."""
        n = self.sizes[ids]
        to = np.append(0, np.cumsum(n))
        data = self.raw[np.repeat(self.starts[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
        # the first id that yields text loses the space that was put before the text
        starts = np.append(0, ends)[:-1]
        speaks = np.append(np.flatnonzero(n), len(ids))
        first = speaks[np.searchsorted(speaks, starts)]
        cut = np.zeros(len(ends), np.int64)
        has = first < ends
        cut[has] = self.spaced[ids[first[has]]]
        # ids without text part byte pieces; an end id parts nothing
        silent = np.append(0, np.cumsum(n == 0))
        apart = silent[ends - (ends > starts)] - silent[starts] > 0
        texts = []
        for k, (low, high, skip) in enumerate(zip(to[starts].tolist(), to[ends].tolist(), cut.tolist(), strict=True)):
            try:
                text = None if apart[k] else data[low + skip : high].decode()
            except UnicodeDecodeError:
                text = None
            texts.append(self._by_piece(ids[starts[k] : ends[k]], bool(skip)) if text is None else text)
        return texts

    def _by_piece(self, ids: np.ndarray, skip: bool) -> str:
        """Text of any ids: byte pieces side by side are read together, and a byte that is no UTF-8 shows as U+FFFD."""
        out, held = [], b""
        for k in [*ids.tolist(), -1]:
            if k >= 0 and self.is_byte[k]:
                held += self.raw[self.starts[k] : self.starts[k] + 1].tobytes()
                continue
            while held:
                size = next((n for n in (1, 2, 3, 4) if _is_char(held[:n])), 0)
                out.append(held[:size].decode() if size else "�")
                held = held[size or 1 :]
            if k >= 0:
                out.append(self.raw[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes().decode())
        return "".join(out)[skip:]


def _is_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """doc_ids and texts, few bytes at a time."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low, high in by_length(np.fromiter(map(len, texts), np.int64, len(texts))):
            yield batch.column(0).slice(low, high - low), texts[low:high]


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for doc_ids, texts in _cut_batches(batches):
            ids, ends = bpe.encode_column(texts)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(ends, prepend=0), pa.int64()), _lists(ids, ends)], ["doc_id", "n_tokens", "ids"])

    return _picked(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def check_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, agrees: whether the library gives the whole text the same ids, and the same text for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for doc_ids, texts in _cut_batches(batches):
            ids, ends = bpe.encode_column(texts)
            mine, decoded = [x.tolist() for x in np.split(ids, ends[:-1])], bpe.decode_column(ids.astype(np.int64), ends)
            theirs = bpe.library.encode(texts, num_threads=1, add_eos=True)
            agrees = [a == b and c == d for a, b, c, d in zip(mine, theirs, decoded, bpe.library.decode(theirs), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(agrees, pa.bool_())], ["doc_id", "agrees"])

    return _picked(docs).mapInArrow(run, "doc_id long, agrees boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_tokens, ids) and decoded: the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            lists = batch.column(2)
            values, counts = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts, missing = bpe.decode_column(values.astype(np.int64), np.cumsum(counts)), lists.is_null().to_pylist()
            decoded = pa.array([None if gone else t for gone, t in zip(missing, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
