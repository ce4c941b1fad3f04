"""Whole texts to token ids through a bounded table of runs without white space.

Holds for vocabularies that drop white space: every token lies in one run, so the ids of a text
are those of its runs, one after the other. Only runs not in the table are encoded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the per-process table of runs, checked before each batch; it is emptied when full.
RUN_TABLE = 150_000
#: The same where one Python worker serves a core.
WIDE_RUN_TABLE = 250_000

#: Unicode White_Space. ``str.split`` also splits at U+001C-U+001F, which do not belong to it.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPLIT = re.compile("[\x1c-\x1f]")


def vocabulary_file(path: str) -> str:
    """A path as it is; a bare name is looked up among the public vocabularies of this process, driver or worker."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def space_split(text: str) -> list[str]:
    """Runs without Unicode white space."""
    if _ODD_SPLIT.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Bytes of text whose runs are told apart together.
CHUNK_BYTES = 2_000_000
#: The same where one Python worker serves a core: more text repeats more of its runs.
WIDE_CHUNK_BYTES = 8_000_000


def by_length(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` bytes; ``sizes`` holds one size per text."""
    low, n, ends = 0, len(sizes), np.cumsum(sizes)
    while low < n:
        before = int(ends[low - 1]) if low else 0
        high = min(n, int(np.searchsorted(ends, before + most)) + 1)
        yield low, high
        low = high


def _run_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of all texts, one after the other (empty ones among them), and how many each text has."""
    if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
        runs = [space_split(t) for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(runs)), pa.string()), np.fromiter(map(len, runs), np.int64, len(runs))
    lists = pc.utf8_split_whitespace(texts)
    return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _word_patterns(split: str) -> tuple:
    """Words and spaces: the vocabulary's own pattern, and the same for ASCII text alone."""
    import regex

    plain = split.replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9")
    ascii_only = re.compile(plain.replace("[A-Za-z]", "[a-z]") + "| ", re.ASCII) if "\\p" not in plain else None
    return regex.compile(split + "| "), ascii_only


class RunTable:
    """Ids of runs, as little-endian unsigned 32-bit integers; subclasses encode single words."""

    most = RUN_TABLE
    chunk = CHUNK_BYTES

    def __init__(self, spec: dict) -> None:
        self.table: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {" ": b""}
        self.special = {t["content"]: np.uint32(t["id"]).astype("<u4").tobytes() for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words, self._ascii_words = _word_patterns(split["pattern"]["Regex"])

    def encode_words(self, words: list[str]) -> None:
        """Add words to ``self.words``."""
        raise NotImplementedError

    def pieces(self, joined: str) -> list[str]:
        """Words of runs joined by single spaces, with the spaces."""
        if joined.isascii() and self._ascii_words:
            return self._ascii_words.findall(joined.lower())
        # one character at a time: a capital sigma never takes its word-final form
        return self._words.findall(unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower())

    def fill(self, runs: list[str]) -> None:
        """Add runs to the table."""
        if self._special and self._special.search(" ".join(runs)):
            odd = [r for r in runs if self._special.search(r)]
            for run in odd:
                self.table[run] = b"".join(self._special_run(run))
            runs = [r for r in runs if not self._special.search(r)]
        # most runs are ASCII, where a plain pattern does
        for part in ([r for r in runs if r.isascii()], [r for r in runs if not r.isascii()]):
            if part:
                self._fill_plain(part)

    def _fill_plain(self, runs: list[str]) -> None:
        pieces = self.pieces(" ".join(runs))
        self.encode_words([w for w in set(pieces) if w not in self.words])
        ids = list(map(self.words.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        gaps = np.flatnonzero(np.fromiter(map(" ".__eq__, pieces), bool, len(pieces)))
        joined, to = b"".join(ids), [*ends[gaps].tolist(), int(ends[-1])]
        self.table.update(zip(runs, [joined[a:b] for a, b in zip([0, *to], to)], strict=True))  # noqa: B905

    def _special_run(self, run: str) -> list[bytes]:
        out = []
        for part in self._special.split(run):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = self.pieces(part)
                self.encode_words([w for w in set(words) if w not in self.words])
                out += [self.words[w] for w in words]
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, as unsigned 32-bit integers, and where each text's end."""
        found, ends, base = [], [], 0
        for low, high in by_length(pc.binary_length(texts).to_numpy(zero_copy_only=False), self.chunk):
            flat, counts = _run_lists(texts.slice(low, high - low))
            # each by itself: runs outnumber words, and a word is dearer to encode
            if len(self.table) > self.most:
                self.table = {"": b""}
            if len(self.words) > self.most:
                self.words = {" ": b""}
            coded = flat.dictionary_encode()
            runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            parts = list(map(self.table.get, runs))
            missing = [k for k, p in enumerate(parts) if p is None]
            if missing:
                self.fill([runs[k] for k in missing])
                for k in missing:
                    parts[k] = self.table[runs[k]]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            known, which = np.frombuffer(b"".join(parts), "<u4"), coded.indices.to_numpy(zero_copy_only=False)
            n = sizes[which]
            to = np.append(0, np.cumsum(n))
            found.append(known[np.repeat((np.cumsum(sizes) - sizes)[which] - to[:-1], n) + np.arange(to[-1])])
            ends.append(base + to[np.cumsum(counts)])
            base += int(to[-1])
        pa.default_memory_pool().release_unused()
        if not found:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(ends)

    def encode_batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        joined, to = ids.tobytes(), (4 * ends).tolist()
        return [joined[a:b] for a, b in zip([0, *to], to)]  # noqa: B905


def gathered(batches: Iterator[pa.RecordBatch], most: int = WIDE_CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most`` bytes or of one batch that is larger."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new ends."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def as_binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per text."""
    to = (ids.itemsize * np.append(0, ends)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(ids.tobytes())])


class LibraryIds(RunTable):
    """Words encoded by the tokenizers library's own model."""

    most = WIDE_RUN_TABLE
    chunk = WIDE_CHUNK_BYTES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(vocabulary_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        self.model = Tokenizer.from_file(vocabulary_file(path)).model
        self.symbols = dict(enumerate(byte_symbols()))
        largest = max(spec["model"]["vocab"].values())
        self.packed = [k.to_bytes(4, "little") for k in range(largest + 1)]

    def encode_words(self, words: list[str]) -> None:
        tokenize, symbols, packed = self.model.tokenize, self.symbols, self.packed
        for word in words:
            # bytes that stand for themselves need no mapping
            own = word.isascii() and word.isprintable()
            found = tokenize(word if own else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(symbols))
            self.words[word] = b"".join([packed[t.id] for t in found])


@lru_cache(maxsize=2)
def library(path: str) -> LibraryIds:
    return LibraryIds(path)
