"""Operators on small fixtures against brute force, and their defined edge cases."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from noteproof.llm import (  # noqa: E402
    bpe, embeddings, graph, html_text, lattice_lm, near_dedup, packing, quality, shingles, suffix_dedup, token_files, tokens, toxicity,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{WORDS[b]}" for a, b in rng.integers(0, len(WORDS), (n, 2)))


def edge_rows() -> list[tuple]:
    long = prose(1, 4000)
    base = prose(2, 120)
    passage = prose(3, 60)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        None, "", " \t\n", "one", "two words", base, base, near, base.upper(), f"{prose(4, 40)} {passage} {prose(5, 40)}", f"{passage}\n{prose(6, 50)}",
        long, "x" * 5000, "naïve façade ΣΑΣ 日本語 😀 it's <|endoftext|> #$% | &", "a b c a b c a b c", "line\nline\n\nother\nline",
    ]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text) -> bytes:
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_library(docs, empty, library):
    got = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    texts = collections.defaultdict(set)
    for d, t, *_ in edge_rows():
        texts[d].add(t)
    assert len(got) == len(edge_rows())
    for r in got:
        (text,) = texts[r.doc_id]
        want = ids_of(library, text)
        assert bytes(r.ids) == want
        assert r.decoded == library.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)
    assert bpe.decode_documents(bpe.encode_documents(empty, PATH), PATH).count() == 0


def test_segment_tree_equals_batch_merge():
    own = bpe.load(PATH)
    words = [w.encode() for w in prose(9, 200).split()] + [b"a", b"zz" * 40]
    ids, sizes = own.merge_bytes(words)
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.bpe.merge(own.first_symbols(w).tolist())
        at += n


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, 5000) % n).astype(np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=n))
    used = lengths[lengths > 0]
    assert used.max() <= 16
    assert (2.0 ** -used.astype(float)).sum() <= 1
    payload, at = token_files.pack_bits(ids, token_files.canonical_codes(lengths), lengths)
    assert token_files.Decoder(lengths)(payload, at[:: token_files.LANE], len(ids)).tolist() == ids.tolist()


def test_token_files(spark, docs, empty, library, tmp_path):
    token_files.write_token_files(docs.where("doc_id is not null"), PATH, f"file://{tmp_path}/a", end_id=2)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    at = 0
    for r, (d, t, *_) in zip(got, sorted([x for x in edge_rows() if x[0] is not None], key=lambda x: x[0]), strict=True):
        want = ids_of(library, t) + np.array([2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, at, len(want) // 4, want)
        at += len(want) // 4
    token_files.write_token_files(empty, PATH, f"file://{tmp_path}/b", end_id=2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_packing(docs, empty, library):
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH, end_id=1).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t, *_ in edge_rows():
        if d is not None:
            ids, at = ids_of(library, t) + np.array([1], "<u4").tobytes(), 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + p.length)]))
                at += p.length
            assert at == len(ids) // 4
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(empty, PATH, end_id=1).count() == 0


def test_patterns_meet_demand_near_the_bound():
    rng = np.random.default_rng(5)
    sizes, demand = np.arange(1, 257), rng.integers(0, 60, 256)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    patterns = packing.whole_patterns(sizes, demand, 256)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * sizes).sum() <= 256 for p, _ in patterns)
    columns, used = packing.solve_patterns(sizes, demand.astype(float), 256)
    assert np.allclose(columns @ used, demand)
    assert used.sum() >= (sizes * demand).sum() / 256 - 1e-6
    assert sum(n for _, n in patterns) <= used.sum() + 0.6 * len(sizes)


def test_repeats_against_brute_force(docs, empty):
    data = [(d, (t or "").encode()) for d, t, *_ in edge_rows()]
    seen = collections.Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    want = []
    for d, b in data:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = True
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        want.append((d, len(b), int(cover.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~cover])))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    texts = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs).collect()}
    assert texts == {d: kept.decode("utf-8", "ignore") for d, *_, kept in want}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree_merges_without_recomparing():
    rng = np.random.default_rng(2)
    lists = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(40)) for _ in range(5)] + [[]]
    runs = [suffix_dedup.Run(s.tolist(), r) for s, r in map(suffix_dedup.front_code, lists)]
    order, shared, items = suffix_dedup.merge_runs(runs)
    assert items == sorted(x for ls in lists for x in ls)
    for k in range(1, len(items)):
        a, b = items[k - 1], items[k]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    assert all(lists[r][k] == x for (r, k), x in zip(order, items, strict=True))


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("threshold", [85, 60])
def test_near_duplicates_against_brute_force(spark, empty, threshold):
    rows = [r for r in edge_rows() if r[0] is not None]
    base = prose(11, 150).split()
    for k in range(30):  # variants of one text, near it and less near one another
        w = list(base)
        w[3 + 4 * k] = f"variant{k}"
        rows.append((100 + k, " ".join(w), "en", "s", 0))
    rows.append((99, " ".join(base), "en", "s", 0))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold=threshold).collect()}
    ids = sorted({r[0] for r in rows})
    sets = dict(zip([r[0] for r in rows], sets_of([r[1] for r in rows]), strict=True))
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    want = components(ids, linked)
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in ids} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, 900, np.uint64)
    union = near_dedup.sketch(np.concatenate([a, b]))
    assert (near_dedup.merge_sketches(near_dedup.sketch(a), near_dedup.sketch(b)) == union).all()
    common = np.concatenate([a, b[:40]])
    n = np.array([len(a)]), np.array([len(common)])
    assert near_dedup.possible(near_dedup.sketch(a)[None], near_dedup.sketch(common)[None], *n, 0.85)[0]
    assert not near_dedup.possible(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], n[0], n[0], 0.85)[0]


def test_shingles_ignore_case_and_space_kinds():
    a, b = shingles.shingle_sets(["A b\tC d e f", "a B c D\n e  F"])
    assert a.tolist() == b.tolist()
    assert len(a) == 2
    assert [len(x) for x in shingles.shingle_sets(["", "one", "to " * 400])] == [0, 1, 1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (159, 100)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2000, 7])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    center = rng.normal(size=(6, 16))
    x = np.concatenate([center[k % 6] + rng.normal(size=16) * (0.05 if k % 2 else 0.4) for k in range(60)]).reshape(60, 16)
    rows = [(k, v.astype(np.float32).tolist(), k % 2) for k, v in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 16, 0), (62, [float("nan")] * 16, 0), (63, rows[1][1], None), (64, rows[1][1], 1), (65, [2 * v for v in rows[1][1]], 1), (66, [], 1), (67, [1.0, None], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    sound = {k: np.array(v, float) for k, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: lab for k, _, lab in rows}
    linked = [
        (a, b) for a in sound for b in sound
        if a < b and label[a] == label[b] and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.93
    ]
    degree = collections.Counter(x for e in linked for x in e)
    want = components([r[0] for r in rows], linked)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (degree[k], c, c == k) for k, c in want.items()}


def test_quality_counts(docs, empty, spark):
    labels = spark.createDataFrame([(5, 1, 0), (11, 1, 0), (13, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(edge_rows())
    texts = {d: t or "" for d, t, *_ in edge_rows()}
    for r in got:
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.filter_documents(docs, labels).columns == docs.columns


def test_quality_separates_junk(spark):
    good = [(k, prose(k, 80), "en", "s", 0) for k in range(60)]
    junk = [(100 + k, " | ".join(prose(k, 60).split()) + " | buy", "en", "s", 0) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.score_documents(spark.createDataFrame(good + junk, SCHEMA), labels).where("kept").collect()}
    assert kept == set(range(60))


def test_toxicity(spark, docs, empty):
    rows = [(k, prose(k, 60) + (" vile scum here" if k % 4 == 0 else ""), "en", "s", 0) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert [(k, got[k].severity) for k in range(200) if got[k].rejected != (k % 4 == 0)] == []
    assert toxicity.score_documents(docs, model).count() == len(edge_rows())
    assert toxicity.filter_documents(empty, labels).count() == 0
    none = toxicity.fit(df, labels.where("toxic = 0"))
    assert toxicity.score_documents(df, none).where("rejected").count() == 0


def test_ordinal_grades_share_weights():
    rng = np.random.default_rng(0)
    x = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(600)]
    z = np.array([sum((1.0, 2.0, -1.0, 0.0, 1.5)[f] for f in r) for r in x])
    grades = np.digitize(z + rng.logistic(size=600) * 0.3, [0.5, 2.0, 3.0])
    w, theta = toxicity.fit_ordinal(x, grades, 5)
    assert (np.diff(theta) > 0).all()
    assert np.corrcoef(w, (1.0, 2.0, -1.0, 0.0, 1.5))[0, 1] > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><div id="cookie-notice">We use cookies, really.</div>
<!-- <p>hidden</p> --><div class="ad">Buy &amp; save.</div><article><h1>Head &lt;line&gt;</h1><p>First <b>bold&nbsp;part</b>,
 then<br>more.<p>Second &amp one, it goes on; and on.</p><form><input>Name</form><ul><li>Item</ul></article>
<div class="comments"><p>Nice article, thanks. I liked it, very much indeed.</p></div><aside>Side text.</aside><footer>&copy; foot</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Head <line>\nFirst bold part, then more.\nSecond & one, it goes on; and on.\nItem"
    assert html_text.main_text("") == ""
    assert html_text.main_text("<html><body><nav>only</nav></body></html>") == ""
    assert html_text.main_text("plain text, no tags.") == "plain text, no tags."
    plain = "<body><div><a>x</a></div><div id=main><p>" + "Long enough, a text. " * 9 + "</p><p>Short.</p></div><div><a>y</a></div></body>"
    assert html_text.main_text(plain) == ("Long enough, a text. " * 9).strip() + "\nShort."


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "kept"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == ""
    assert html.unescape("&amp") == "&"


def segmentations(word: bytes, inner: dict, last: dict):
    """All lists of piece ids of a word."""
    if word in last:
        yield [last[word]]
    for k in range(1, len(word)):
        if word[:k] in inner:
            for rest in segmentations(word[k:], inner, last):
                yield [inner[word[:k]], *rest]


@pytest.fixture(scope="module")
def piece_ids():
    return tuple({bytes(own_bytes(t)): k for t, k in vocabulary(end)} for end in (False, True))


def test_lattice_sums_all_segmentations(piece_ids):
    n = lattice_lm.vocabulary_size(PATH)
    weights = np.random.default_rng(0).dirichlet(np.ones(n))
    lattice = lattice_lm.Lattice(PATH)
    words = [b"thing", b"a", b"the", b"tho", b"x\xc3\xa9"]
    ways = {w: [(s, math.prod(weights[k] for k in s)) for s in segmentations(w, *piece_ids)] for w in words}
    assert np.allclose(lattice(words, np.log(weights)), [math.log(sum(p for _, p in ways[w])) for w in words])
    counts = np.array([3, 1, 2, 5, 1])
    want = np.zeros(n)
    for w, c in zip(words, counts, strict=True):
        total = sum(p for _, p in ways[w])
        for s, p in ways[w]:
            for k in s:
                want[k] += c * p / total
    assert np.allclose(lattice.expected_counts(words, np.log(weights), counts), want)


def test_document_score_is_the_sum_over_segmentations(spark, piece_ids):
    rows = [(k, " ".join(f"{WORDS[(k * j) % 7][:4]}" for j in range(1, 6)), "en", "s", 0) for k in range(40)]
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    count = collections.Counter(w.encode() for r in train for w in r[1].split())
    n = lattice_lm.vocabulary_size(PATH)
    own = bpe.load(PATH)
    used = np.zeros(n)
    for w, c in count.items():
        for k in own.bpe.merge(own.first_symbols(w).tolist()):
            used[k] += c
    pieces = lattice_lm.load_lattice(PATH).pieces
    for _ in range(lattice_lm.ROUNDS + 1):
        weights = np.zeros(n)
        weights[pieces] = (used[pieces] + lattice_lm.PIECE_PRIOR) / (used[pieces].sum() + lattice_lm.PIECE_PRIOR * len(pieces))
        used = np.zeros(n)
        for w, c in count.items():
            ways = [(s, math.prod(weights[k] for k in s)) for s in segmentations(w, *piece_ids)]
            total = sum(p for _, p in ways)
            for s, p in ways:
                for k in s:
                    used[k] += c * p / total
    tokens_in = sum(count.values()) + len(train)
    stop = (len(train) + 0.5) / (tokens_in + 1)
    for d, t, *_ in rows:
        want = math.log10(stop)
        for w in t.split():
            want += math.log10((1 - stop) * sum(math.prod(weights[k] for k in s) for s in segmentations(w.encode(), *piece_ids)))
        assert math.isclose(got[d], want, rel_tol=2e-3), d  # counts are kept in fractions of 1/1024


def vocabulary(at_end: bool):
    import json

    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    return [(t[:-4] if at_end else t, k) for t, k in vocab.items() if t.endswith("</w>") == at_end]


def own_bytes(token: str) -> list[int]:
    of = {s: b for b, s in enumerate(tokens.byte_symbols())}
    return [of[c] for c in token]


def test_lm_scores(docs, empty):
    got = lattice_lm.score_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH).collect()
    words = {d: (t or "").encode().lower().split() for d, t, *_ in edge_rows() if d is not None}
    count, n_docs = collections.Counter(), 0
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 10:
            count.update(w)
            n_docs += 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    for r in got:
        w = words[r.doc_id]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(count[x] for x in w), n_docs])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert -math.inf < r.score < 0
    assert lattice_lm.score_documents(empty, PATH).count() == 0


def test_clashing_columns_pass(spark):
    df = spark.createDataFrame([(1, prose(1, 60), "r", "k", 3, 0.5)], "doc_id long, text string, row string, kept string, rid int, severity double")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.filter_documents(df, labels).count() == 1
    assert quality.filter_documents(df, labels).columns == df.columns
    assert suffix_dedup.deduplicated(df).columns == df.columns
    assert near_dedup.drop_duplicates(df).columns == df.columns
    assert len(hashlib.sha256(b"").hexdigest()) == 64
    assert F is not None
