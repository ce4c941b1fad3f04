"""The registered queries on awkward tables: repeated and null ids, control characters, clashing columns, empty tables."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from noteproof.llm import embeddings, html_text, near_dedup, queries, tokens, toxicity  # noqa: E402

from test_small import PATH, components, ids_of, prose, sets_of  # noqa: E402

OPS = queries.queries()
COLUMNS = {
    "op1_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_toxicity": ["doc_id", "rejected"],
    "op10_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
}
SEVERAL = {"op7_packing"}
EXTRA = "row string, kept string, rid int, severity double, node int, cls int, key int, text_hash int, word string, ids string"


def texts() -> list[tuple]:
    base = prose(21, 130)
    words = base.split()
    near = " ".join([*words[:50], "other", *words[51:]])
    return [
        (1, base), (1, "an unlike text under the same id " + prose(22, 40)), (2, base), (3, "prefix " + near), (3, "prefix " + near), (None, base), (None, None),
        (4, None), (5, ""), (6, "a\x01b x\x7fy \x1c \x1f\x00"), (7, "\x85 \u2003  \u3000"), (8, "<|endoftext|> it's"), (9, prose(23, 9000)), (10, "z" * 30_000), (-4, "negative id"),
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    extra = ("r", "k", 1, 0.5, 2, 3, 4, 5, "w", "i")
    spark.createDataFrame([(*r, *extra) for r in texts()], f"doc_id long, text string, {EXTRA}").repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 1), (9, 1, 1), (10, 0, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    page = "<article><h1>T</h1><p>Some text, here.</p></article><footer>foot</footer>"
    spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    vectors = [(1, [1.0, 0.0], 0, "a"), (1, [0.0, 1.0], 0, "a"), (2, [0.01, 1.0], 0, "a"), (3, [0.0, 1.0], 1, "a"), (None, [1.0, 0.0], 0, "a"), (4, [1.0, 0.0, 0.0], 0, "a"), (5, [2.0, 0.0], 0, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, node string").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_contract(spark, folder, name):
    df = OPS[name](spark, folder)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    key = COLUMNS[name][0]
    table = {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}[key]
    want = collections.Counter(r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect())
    got = collections.Counter(r[key] for r in rows)
    assert got.keys() == want.keys() if name in SEVERAL else got == want


@pytest.mark.parametrize("name", COLUMNS)
def test_empty_tables(spark, empty_folder, name):
    df = OPS[name](spark, empty_folder)
    assert set(COLUMNS[name]) <= set(df.columns)
    assert df.count() == 0


def test_ids_equal_the_library(spark, folder):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = collections.Counter((d, len(i := ids_of(library, t)) // 4, hashlib.sha256(i).hexdigest()) for d, t in texts())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in OPS["op1_bpe_round_trip"](spark, folder).collect()) == want
    end = [np.array([k], "<u4").tobytes() for k in (2, 1)]
    want = collections.Counter((d, zlib.crc32(ids_of(library, t) + end[0])) for d, t in texts())
    rows = OPS["op6_token_files"](spark, folder).collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert ordered == sorted(ordered)
    whole = collections.Counter()
    for d, t in texts():
        ids = ids_of(library, t) + end[1]
        whole.update((d, k, zlib.crc32(ids[4 * k : 4 * k + 8192])) for k in range(0, len(ids) // 4, 2048))
    packed = OPS["op7_packing"](spark, folder).collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == whole
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_fuzzed_ids_equal_the_library():
    rng = np.random.default_rng(3)
    library = tokenizers.Tokenizer.from_file(PATH)
    pool = [*"abXY 09.,'#&|", "'ll", "<|endoftext|>", *map(chr, (0, 1, 0x1C, 0x1F, 0x7F, 0x85, 0xA0, 0x2003, 0x3000, 0x301, 0xB2, 0x2167, 0xAA, 0x130, 0xFB01)), "ΣΑΣ", "é", "日本", "😀"]
    found = ["".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 30))) for _ in range(2000)]
    got = tokens.library(PATH).encode_batch(found)
    assert [t for t, g in zip(found, got, strict=True) if g != ids_of(library, t)] == []


def test_repeated_doc_ids_keep_their_links(spark, folder):
    rows = OPS["op10_near_dedup"](spark, folder).collect()
    named = [(d, s) for (d, _), s in zip(texts(), sets_of([t for _, t in texts()]), strict=True)]
    nodes = range(len(named))
    linked = [
        (a, b) for a in nodes for b in nodes
        if a < b and named[a][0] is not None and named[b][0] is not None and (x := named[a][1]) and (y := named[b][1]) and 100 * len(x & y) >= 85 * len(x | y)
    ]
    part = components(nodes, linked)
    least = {p: min((named[k][0] for k in nodes if part[k] == p and named[k][0] is not None), default=None) for p in part.values()}
    want = collections.Counter((d, len(s), least[part[k]], d is None or d == least[part[k]]) for k, (d, s) in enumerate(named))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == want
    assert any(d == 3 and least[part[k]] == 1 for k, (d, _) in enumerate(named))


def test_levels_and_blocks_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rng = np.random.default_rng(8)
    rows, base = [], prose(31, 80).split()
    for k in range(60):  # texts of three sizes around one, near and less near
        w = list(base[: 80 - 12 * (k % 3)])
        for j in rng.integers(0, len(w), 1 + k % 4):
            w[j] = f"v{rng.integers(0, 6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=70).collect()}
    sets = sets_of([t for _, t in rows])
    linked = [(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])]
    assert got == components(range(60), linked)


def test_repeated_vec_ids(spark, folder):
    rows = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in OPS["op4_embedding_near_dedup"](spark, folder).collect())
    assert rows == collections.Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True), (4, 0, 4, True), (5, 1, 1, False)])


def test_nested_centers_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    center = rng.normal(size=(9, 8))
    x = center[rng.integers(0, 9, 400)] + rng.normal(size=(400, 8)) * rng.choice([0.02, 0.2, 0.6], (400, 1))
    x[300:330] = x[0]
    x = x.astype(np.float32)
    rows = [(k, v.tolist(), int(k % 5 == 0)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=12, fan=4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    part = components(range(400), np.argwhere(np.triu(near)).tolist())
    assert got == {k: (int(near[k].sum()), part[k], part[k] == k) for k in range(400)}


def template_text(page: str) -> str:
    """The article of the tables' own template, read by its literal markup."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?(?:b|i|a|em)\b[^>]*>", "", inner))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages_equal_a_reading_of_their_template(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in OPS["op2_html_extraction"](spark, sf).collect()}
    pages = duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    assert {p: template_text(h) for p, h in pages} == got


LONG = "<p>" + "A long text, with words in it, and marks. " * 6 + "</p>"


def test_ratios_decide_where_names_do_not(monkeypatch):
    page = f"<body><div class=x><ul><li><a>one</a><li><a>two</a></ul>more</div><div class=y>{LONG}<h2>Sub</h2><ul><li>item one</ul></div><div class=z><p>short side</p></div></body>"
    want = " ".join(re.sub("<[^>]*>", "", LONG).split()) + "\nSub\nitem one"
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "path_scores", lambda paths, lengths, marks, factors: factors)
    assert html_text.main_text(page) != want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div><p title="the hidden door">Kept text, one.</p></div>', "Kept text, one."),
        ('<div><p data-id="share">Kept text, one.</p></div>', "Kept text, one."),
        ('<div class="ad-free"><p>Kept text, one.</p></div>', "Kept text, one."),
        ("<p>Before, it was.</p><button>Go<p>After it, text.</p>", "Before, it was.\nAfter it, text."),
        ('<article class="post category-newsletter"><p>Kept text, one.</p></article>', "Kept text, one."),
        (f"<article>{LONG}<div class=comments>{LONG}</div></article>", " ".join(re.sub("<[^>]*>", "", LONG).split())),
        ('<body><article><h1></h1><p></p></article><div class="ad">Buy this, now.</div><footer>Foot, yes.</footer></body>', ""),
        ("<p hidden>Not shown, no.</p><p>Shown, yes.</p>", "Shown, yes."),
    ],
)
def test_html_cases(page, want):
    assert html_text.main_text(page) == want


def test_three_grades_end_to_end(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(400):
        grade = int(rng.integers(0, 4))
        bad = " ".join(["vile"] * (grade > 0) + ["scum"] * (grade > 1) + ["hateful"] * (grade > 2))
        rows.append((k, f"{prose(1000 + k, 40)} {bad}"))
        labels.append((k, grade if k % 3 else None))
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, named)
    assert len(model.thresholds) == 3
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r.severity for r in toxicity.score_documents(docs, model).collect()}
    held = [(got[k], sum(w in t for w in ("vile", "scum", "hateful"))) for (k, t), (_, g) in zip(rows, labels, strict=True) if g is None]
    assert all(abs(s - g) < 0.5 for s, g in held)
    assert F is not None
