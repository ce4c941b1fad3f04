"""Removal of repeated byte strings: a distributed suffix sort that never compares a prefix twice.

Every string of ``LENGTH`` bytes names one suffix to sort: the one at its anchor, the position of
the least k-gram hash among the string's first ``WINDOW`` positions. Equal strings have their
anchors at equal offsets, so only anchors whose k-gram occurs twice can matter (one count over the
corpus), and strings are equal if and only if their anchors' suffixes agree to the right and their
bytes agree to the left.

1. Anchors of all documents are counted by k-gram hash; those that occur once are dropped.
2. Documents with anchors left yield records - the suffix from the anchor and the bytes before it -
   collapsed per task to distinct contents, sorted, and exchanged as front-coded runs: length of
   the prefix shared with the record before, and the rest.
3. Each range of k-grams merges its runs with a loser tree over (shared prefix, next byte): a
   prefix known from the run or from an earlier match is never looked at again. The merge returns
   the order and the common prefixes of neighbours; with the same for the left sides this gives,
   for every offset, which strings occur twice or more.
4. Marked intervals go back to the documents' occurrences by content key.

Defined results: null text is empty; documents under ``LENGTH`` bytes lose nothing; repeats
overlap, cover each other and may lie in one document; repeated rows are documents of their own
(so copies of 200 bytes or more lose all their bytes); an empty table gives an empty result.
Texts may have any length; columns other than doc_id and text, whatever their names, are carried
along by ``deduplicated`` and not read by ``remove_repeats``; null doc_ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_numbers, shuffle_partitions
from .shingles import _powers, mixed

LENGTH = 200
#: Bytes of an anchor's k-gram; an anchor is sought in the first LENGTH - GRAM + 1 positions.
GRAM = 40
#: Positions handled at once inside a text.
CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def anchors_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """hash, first and last start, and anchor of each range of string starts that share an anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    parts = []
    window = length - gram + 1
    for low in range(0, n, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK, n - low) + length - 1, low)
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < window:
            key = np.minimum(key[: size - window], key[window - size :])
        at = (key & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        parts.append((grams[at[first]], first + low, last + low, at[first] + low))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def front_code(items: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Shared prefix with the item before, and the rest, of sorted items."""
    shared = np.zeros(len(items), np.int64)
    if not items:
        return shared, []
    width = max(1, *map(len, items))
    grid = np.zeros((len(items), width), np.uint8)
    size = np.fromiter(map(len, items), np.int64, len(items))
    grid[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(items), np.uint8)
    differs = grid[1:] != grid[:-1]
    first = np.where(differs.any(1), differs.argmax(1), width)
    shared[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return shared, [x[k:] for x, k in zip(items, shared.tolist(), strict=True)]


class Run:
    """Reader of a front-coded run: the current item and its prefix shared with the one before."""

    __slots__ = ("at", "item", "rests", "shared")

    def __init__(self, shared: list[int], rests: list[bytes]):
        self.shared, self.rests, self.at, self.item = shared, rests, -1, b""

    def step(self) -> int:
        """Go on; returns the shared prefix, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.rests):
            self.item = None
            return -1
        k = self.shared[self.at]
        self.item = self.item[:k] + self.rests[self.at]
        return k


def _common(a: bytes, b: bytes, k: int) -> int:
    """Common prefix of a and b, known to be ``k`` at least."""
    most = min(len(a), len(b))
    if a[k:most] == b[k:most]:
        return most
    step = 16
    while a[k : k + step] == b[k : k + step]:
        k += step
    while a[k] == b[k]:
        k += 1
    return k


def merge_runs(runs: list[Run]) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """(run, position) of all items in order, each one's prefix shared with the item before, items.

    A loser tree: a head keeps the prefix it shares with the last item given out. Of two heads the
    one sharing more is less; only heads sharing alike are compared, from that byte on."""
    n = len(runs)
    size = 1
    while size < max(n, 1):
        size *= 2
    known = [r.step() for r in runs] + [-1] * (size - n)
    heads = [r.item for r in runs] + [None] * (size - n)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner, loser; the loser's prefix becomes the one shared with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        ka, kb = known[a], known[b]
        if ka > kb:
            return a, b
        if kb > ka:
            return b, a
        k = _common(heads[a], heads[b], ka)
        if heads[a][k : k + 1] <= heads[b][k : k + 1]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers, up = [0] * size, list(range(size))
    for k in range(n):
        known[k] = 0
    while len(up) > 1:
        level = len(up) // 2
        won = []
        for i in range(level):
            w, x = play(up[2 * i], up[2 * i + 1])
            won.append(w)
            losers[level + i] = x
        up = won
    winner, order, shared, items = up[0], [], [], []
    while heads[winner] is not None:
        order.append((winner, runs[winner].at))
        shared.append(known[winner])
        items.append(heads[winner])
        known[winner] = runs[winner].step()
        heads[winner] = runs[winner].item
        k, w = (size + winner) // 2, winner
        while k:
            w, losers[k] = play(w, losers[k])
            k //= 2
        winner = w
    return order, shared, items


def repeated_offsets(shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which offsets of each record, in suffix order, start a string that occurs twice or more.

    ``shared``: common prefix with the suffix before; ``lefts``: bytes before the anchor;
    offsets ``low`` to ``high`` are the record's; ``count``: occurrences."""
    n = len(lefts)
    back = [x[::-1] for x in lefts]
    by = sorted(range(n), key=back.__getitem__)
    left_shared, _ = front_code([back[k] for k in by])
    by = np.array(by, np.int64)
    marked = np.zeros((n, int(high.max(initial=0)) + 1), bool)
    for o in range(marked.shape[1]):
        held = np.flatnonzero((low <= o) & (high >= o))
        if not len(held):
            continue
        right = np.cumsum(shared < length - o)
        left = np.empty(n, np.int64)
        left[by] = np.cumsum(left_shared < o)
        key = right[held] * (n + 1) + left[held]
        _, group = np.unique(key, return_inverse=True)
        total = np.bincount(group, weights=count[held])
        marked[held[total[group] >= 2], o] = True
    return marked


_RUNS = "part int, shared binary, rests binary, sizes binary, lefts binary, about binary"


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find_grams(numbered: DataFrame, length: int, gram: int) -> DataFrame:
    """h, rid, n: each k-gram hash of a text's anchors once, n 2 if it is there more often. numbered: rid, row (with text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors_of(_bytes_of(t), length, gram)[0].view(np.int64), return_counts=True) for t in batch.column(1).to_pylist()]
            rids = np.repeat(batch.column(0).to_numpy(), [len(h) for h, _ in found])
            many = np.minimum(np.concatenate([n for _, n in found]), 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), pa.array(rids), pa.array(many)], ["h", "rid", "n"])

    return numbered.select("rid", F.col("row.text").alias("text")).mapInArrow(run, "h long, rid long, n int")


def _records(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple]:
    """rid, bytes, and hash, first and last start, anchor, content key of each anchor whose k-gram is held.

    Batches of rid, row (with text), grams."""
    for batch in batches:
        texts = batch.column(1).field("text").to_pylist()
        for rid, text, held in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
            data = _bytes_of(text)
            h, low, high, at = anchors_of(data, length, gram)
            kept = np.isin(h.view(np.int64), np.array(held, np.int64))
            for k, a, b, c in zip(*(x[kept].tolist() for x in (h.view(np.int64), low, high, at)), strict=True):
                yield rid, data, k, a, b, c, xxhash.xxh3_128_digest(data[a : b + length], c - a << 10 | c - b)


def find_occurrences(located: DataFrame, length: int, gram: int) -> DataFrame:
    """k1, k2 (content key), rid, anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rid, at, key) for rid, _, _, _, _, at, key in _records(iter([batch]), length, gram)]
            keys = np.frombuffer(b"".join(r[2] for r in rows), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]], ["k1", "k2", "rid", "anchor"]
            )

    return located.mapInArrow(run, "k1 long, k2 long, rid long, anchor long")


def make_runs(located: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Per task and range of k-grams, one front-coded run of its distinct records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[bytes, list] = {}  # content key to (part, suffix, left, low, high, count)
        for _, data, h, low, high, at, key in _records(batches, length, gram):
            if (c := classes.get(key)) is None:
                classes[key] = [h % parts, data[at : min(at + length, high + length)], data[low:at], at - high, at - low, 1]
            else:
                c[5] = 2
        by_part: dict[int, list] = {}
        for key, c in classes.items():
            by_part.setdefault(c[0], []).append((c[1], key, c))
        del classes
        pack = zstandard.ZstdCompressor(level=3).compress
        for part, rows in by_part.items():
            rows.sort(key=lambda x: x[:2])
            shared, rests = front_code([x[0] for x in rows])
            lefts = [x[2][2] for x in rows]
            sizes = np.array([[len(r), len(x)] for r, x in zip(rests, lefts, strict=True)], "<u4")
            about = b"".join(x[1] for x in rows) + np.array([x[2][3:6] for x in rows], "<u4").tobytes()
            blob = [shared.astype("<u4").tobytes(), b"".join(rests), sizes.tobytes(), b"".join(lefts), about]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([pack(x)], pa.binary()) for x in blob]], [c.split()[0] for c in _RUNS.split(", ")])

    return located.mapInArrow(run, _RUNS)


def _cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def merge_part(table: pa.Table, length: int) -> pa.Table:
    """Marked stretches, relative to the anchor, of each content key of one range of k-grams."""
    runs, lefts, keys, about = [], [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in table.select(["shared", "rests", "sizes", "lefts", "about"]).to_pylist():
        row = {k: unpack(v) for k, v in packed.items()}
        sizes = np.frombuffer(row["sizes"], "<u4").reshape(-1, 2)
        n = len(sizes)
        runs.append(Run(np.frombuffer(row["shared"], "<u4").tolist(), _cut(row["rests"], sizes[:, 0])))
        lefts.append(_cut(row["lefts"], sizes[:, 1]))
        keys.append(np.frombuffer(row["about"][: 16 * n], "<i8").reshape(-1, 2))
        about.append(np.frombuffer(row["about"][16 * n :], "<u4").reshape(-1, 3))
    order, shared, _ = merge_runs(runs)
    low, high, count = (np.array([about[r][k][c] for r, k in order], np.int64) for c in range(3))
    marked = repeated_offsets(np.array(shared, np.int64), [lefts[r][k] for r, k in order], low, high, count, length)
    edge = np.diff(marked.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    key = np.array([keys[order[k][0]][order[k][1]] for k in row.tolist()], np.int64).reshape(-1, 2)
    return pa.table({"k1": key[:, 0], "k2": key[:, 1], "from": 1 - after, "to": length - first})


def repeated_spans(numbered: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, spans (array of from, to): covered stretches of each text that has any; they may overlap.

    ``numbered``: rid (unique), row (a struct with text). Its one exchange by rid serves both
    readers of the texts here and the caller's join."""
    spark = numbered.sparkSession
    parts = 4 * shuffle_partitions(spark)
    grams = materialize(spark, find_grams(numbered, length, gram), "grams")
    twice = grams.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    per_doc = grams.join(twice, "h", "left_semi").groupBy("rid").agg(F.collect_list("h").alias("grams"))
    located = numbered.join(per_doc, "rid").select("rid", "row", "grams")
    runs = make_runs(located, parts, length, gram)
    stretches = runs.groupBy("part").applyInArrow(lambda t: merge_part(t, length), "k1 long, k2 long, from long, to long").distinct()
    found = (
        find_occurrences(located, length, gram).join(stretches, ["k1", "k2"])
        .select("rid", (F.col("anchor") + F.col("from")).alias("from"), (F.col("anchor") + F.col("to")).alias("to"))
    )
    return found.groupBy("rid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _cut_out(docs: DataFrame, length: int, gram: int, *, as_text: bool, stored: bool) -> DataFrame:
    """row (the document's own columns), n_bytes, n_removed, n_spans, kept: the bytes left, or as text without characters cut apart.

    Rows are numbered by file and row within it. ``stored``: ``docs`` is the scan of a stored table (columns picked at most); any
    other frame is written once first."""
    if not stored:
        docs = materialize(docs.sparkSession, docs, "documents", compression="zstd")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    numbered = row_numbers(packed, "rid").select("rid", "row")
    spans = repeated_spans(numbered, length=length, gram=gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, kept, end, removed, n = _bytes_of(text), [], 0, 0, 0
                for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
                    if a > end or not n:
                        kept.append(data[end:a])
                        n += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                kept.append(data[end:])
                left = b"".join(kept)
                for column, value in zip(out, (len(data), removed, n, left.decode("utf-8", "ignore") if as_text else left), strict=True):
                    column.append(value)
            kinds = [*[pa.int64()] * 3, pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    # whole rows, so that this join and the readers of the texts share one exchange
    joined = numbered.join(spans, "rid", "left").select("row", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, stored: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left). ``stored``: docs is the scan of a stored table."""
    cut = _cut_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram, as_text=False, stored=stored)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def deduplicated(docs: DataFrame, *, length: int = LENGTH, stored: bool = False) -> DataFrame:
    """The documents with repeated strings cut out of text (characters cut apart go too) and n_chars, if any, counted anew.

    ``stored``: docs is the scan of a stored table."""
    left = _cut_out(docs, length, GRAM, as_text=True, stored=stored)
    columns = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[columns[c].alias(c) for c in docs.columns])
