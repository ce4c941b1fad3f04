"""The pipeline's stages, each against a brute-force reading of what the stage before left; quality verdicts by hand."""

import collections
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from noteproof.llm import quality, toxicity  # noqa: E402

from test_small import PATH, components, ids_of, prose, sets_of  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, severity double"


def table_rows() -> list[tuple]:
    passage = prose(77, 60)
    rows = []
    for k in range(120):
        text = prose(500 + k, 90)
        if k % 10 == 0:
            text += " vile scum here"
        if k % 10 == 1:
            text = " | ".join(prose(900 + k, 70).split()) + " | buy"
        if k % 10 == 2:
            text = f"{prose(700 + k, 60)} {passage} {prose(800 + k, 60)}"
        rows.append((k, text))
    base = rows[5][1]
    words = base.split()
    rows += [(200, base), (201, " ".join([*words[:40], "other", *words[41:]])), (202, base.upper()), (5, base), (5, "another text under the same id " + prose(999, 60))]
    rows += [(300, None), (301, ""), (None, prose(1000, 70)), (302, "too short")]
    return [(d, t, "en", "s", None if t is None else len(t), "r", "k", 0.5) for d, t in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(table_rows(), COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(k % 10 != 1), int(k % 10 == 0)) for k in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{root}/after-{name}")
        docs = spark.read.parquet(f"{root}/after-{name}")
        frames.append(docs)
    return root, frames, [[tuple(r) for r in f.collect()] for f in frames]


def test_all_but_the_last_return_the_documents_columns(stages):
    _, frames, _ = stages
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_toxicity_stage(spark, stages):
    root, frames, rows = stages
    model = toxicity.fit(frames[0], spark.read.parquet(f"{root}/labels.parquet"))
    want = collections.Counter(r for r in rows[0] if not model.severity(r[1] or "") >= toxicity.CUT)
    assert collections.Counter(rows[1]) == want
    assert {r[0] for r in rows[0] if r[0] is not None} - {r[0] for r in rows[1]} == {k for k in range(120) if k % 10 == 0}


def judged_by_hand(rows: list[tuple], trusted: set) -> list[tuple]:
    """(score, kept) of each text: hashed unigrams and bigrams of the target against the raw corpus."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word_hash = lambda w: signed(xxhash.xxh64(w.encode(), seed=42).intdigest())

    def grams(text: str) -> list[int]:
        h = [word_hash(w) for w in quality_words(text)]
        chained = [xxhash.xxh64(struct.pack("<q", b), seed=xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()).intdigest() for a, b in zip(h, h[1:])]  # noqa: B905
        return [x % quality.BUCKETS for x in h] + [signed(x) % quality.BUCKETS for x in chained]

    def quality_words(text: str) -> list[str]:
        return text.split()

    held = [grams(t or "") for _, t, *_ in rows]
    raw, target = collections.Counter(), collections.Counter()
    for r, g in zip(rows, held, strict=True):
        raw.update(g)
        if r[0] in trusted:
            target.update(g)
    total, told, s = sum(raw.values()), sum(target.values()), quality.SMOOTHING
    weight = lambda b: math.log((target[b] + s * told / total) / told) - math.log((raw[b] + s) / total)
    out = []
    for (_, text, *_), g in zip(rows, held, strict=True):
        w = quality_words(text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        score = sum(map(weight, g)) / len(g) if g else None
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((score, not failed and score is not None and score >= quality.THRESHOLD))
    return out


def test_quality_stage(spark, stages):
    root, frames, rows = stages
    labels = {r.doc_id for r in spark.read.parquet(f"{root}/labels.parquet").where("quality = 1").collect()}
    want = judged_by_hand(rows[1], labels)
    assert collections.Counter(rows[2]) == collections.Counter(r for r, (_, kept) in zip(rows[1], want, strict=True) if kept)
    got = quality.score_documents(frames[1], spark.read.parquet(f"{root}/labels.parquet")).collect()
    scores = sorted((r.doc_id is None, r.doc_id or 0, r.score is None, r.score or 0.0) for r in got)
    hand = sorted((r[0] is None, r[0] or 0, s is None, s or 0.0) for r, (s, _) in zip(rows[1], want, strict=True))
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(scores, hand, strict=True))
    assert not {k for k in range(120) if k % 10 == 1} & {r[0] for r in rows[2]}


def test_near_duplicate_stage(stages):
    _, _, rows = stages
    before, after = rows[2], rows[3]
    sets = sets_of([r[1] for r in before])
    nodes = range(len(before))
    linked = [(a, b) for a in nodes for b in nodes if a < b and before[a][0] is not None and before[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = components(nodes, linked)
    least = {p: min(before[k][0] for k in nodes if part[k] == p) for p in set(part.values()) if before[p][0] is not None}
    want = {r for k, r in enumerate(before) if r[0] is None or r[0] == least[part[k]]}
    assert collections.Counter(after) == collections.Counter(want)
    assert {200, 201} & {r[0] for r in before}
    assert not {200, 201, 202} & {r[0] for r in after}


def test_repeat_stage(stages):
    _, _, rows = stages
    data = [(r[1] or "").encode() for r in rows[3]]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = collections.Counter()
    for r, b in zip(rows[3], data, strict=True):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = True
        text = bytes(np.frombuffer(b, np.uint8)[~cover]).decode("utf-8", "ignore")
        want[(r[0], text, *r[2:4], len(text), *r[5:])] += 1
    assert collections.Counter(rows[4]) == want
    assert sum(len(r[1]) for r in rows[4]) < sum(len(r[1]) for r in rows[3])


def test_packing_stage(stages):
    _, frames, rows = stages
    library = tokenizers.Tokenizer.from_file(PATH)
    want = collections.Counter()
    for r in rows[4]:
        ids = ids_of(library, r[1]) + np.array([1], "<u4").tobytes()
        want.update((r[0], k, zlib.crc32(ids[4 * k : 4 * k + 8192]), len(ids) // 4) for k in range(0, len(ids) // 4, 2048))
    at = {c: k for k, c in enumerate(frames[5].columns)}
    assert collections.Counter((r[at["doc_id"]], r[at["start"]], r[at["ids_crc32"]], r[at["doc_tokens"]]) for r in rows[5]) == want
    filled: dict = collections.defaultdict(list)
    for r in rows[5]:
        filled[r[at["sequence_id"]]].append((r[at["offset"]], r[at["length"]]))
    for pieces in filled.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_run_equals_the_chain(spark, stages):
    root, _, rows = stages
    assert corpus_pipeline.run(spark, root).count() == len(rows[5])


def test_empty_tables(spark, stages, tmp_path):
    root, _, _ = stages
    for name in ("documents", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
