"""What the training-data operators ask of the driver: jobs, components built on."""

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from noteproof.llm import graph, near_dedup, prefix_trie, token_files, tokens  # noqa: E402


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def brute(edges):
    name = {}
    for a, b in edges:
        for x in (a, b):
            name.setdefault(x, x)
        lo, hi = sorted((name[a], name[b]))
        name = {k: lo if v == hi else v for k, v in name.items()}
    return name


@pytest.mark.parametrize("few", [0, 12, 10_000])
def test_components_with_rounds_and_without(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rnd = random.Random(few)
    edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 320)]
    edges = [(a, b) for a, b in edges if a != b]
    more = [(5, 210), (400, 401), (401, 300), (500, 500), (77, 78)]
    first = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in first.collect()} == brute(edges)
    joined = graph.joined_components(first, spark.createDataFrame(more, "a long, b long"))
    assert {r.id: r.component for r in joined.collect()} == brute(edges + [e for e in more if e[0] != e[1]])
    none = graph.connected_components(spark.createDataFrame([], "a long, b long"))
    assert {r.id: r.component for r in graph.joined_components(none, spark.createDataFrame(more, "a long, b long")).collect()} == brute(e for e in more if e[0] != e[1])


def rows_made(spark, run):
    """Rows out of joins and explodes of all queries that ``run`` makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    run()
    total = 0
    for at in range(since, store.executionsCount()):
        execution = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size())):
                if metric.name() == "number of output rows" and ("Join" in node.name() or "Generate" in node.name()) and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_components_copy_no_vertex_for_every_salt(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    edges = [(2 * k, 2 * k + 1) for k in range(500)] + [(5_000, k) for k in range(5_001, 5_500)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = []
    made = rows_made(spark, lambda: got.extend(graph.connected_components(frame).collect()))
    assert {r.id: r.component for r in got} == brute(edges)
    assert 0 < made <= MOST_MADE * len(edges)


#: Rows out of joins and explodes for each edge: 12 at writing; 117 when every vertex was copied once per salt.
MOST_MADE = 20


def test_near_dedup_takes_few_jobs(spark):
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(500)}" for _ in range(60)] for _ in range(12)]
    rows = [(k, " ".join(base[k % 12][: 60 - k % 5] + [f"x{k % 3}"])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jobs(spark, "near", lambda: near_dedup.drop_duplicates(docs).write.format("noop").mode("overwrite").save()) <= MOST_JOBS


#: 54 at writing; 76 when components were built from all links again after each step and every table was counted by a job of its own.
MOST_JOBS = 65


def test_trie_rounds_take_several_levels(spark):
    rows = [(c, t, "user", f"t{t}" if t < 20 else f"{c}-{t}") for c in range(6) for t in range(22)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = []
    assert jobs(spark, "trie", lambda: got.extend(prefix_trie.trie_nodes(table).collect())) <= MOST_TRIE_JOBS
    shared = {r.depth: r for r in got if r.n_convs > 1}
    assert sorted(shared) == list(range(21))
    assert [(r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for d, r in sorted(shared.items()) if d >= 19] == [(6, 1, 6, 30), (6, 6, 6, 15)]
    assert len(got) == 21 + 6 * 2


#: 46 at writing; 189 when each level had its own jobs, down and up again.
MOST_TRIE_JOBS = 70


def test_blocks_decode_side_by_side():
    rng = np.random.default_rng(2)
    blocks = [rng.geometric(0.02, n).clip(max=500) for n in (1, 700, 256, 0, 65_536)]
    lengths = token_files.code_lengths(np.bincount(np.concatenate(blocks)))
    packed = [token_files.pack_bits(b, token_files.canonical_codes(lengths), lengths) for b in blocks]
    got = token_files.Decoder(lengths).blocks([p for p, _ in packed], [at[:: token_files.LANE] for _, at in packed], [len(b) for b in blocks])
    assert [g.tolist() for g in got] == [b.tolist() for b in blocks]


def test_words_outlive_the_table_of_runs():
    enc = tokens.LibraryIds(public_tokenizers.path("word_bpe_49k.json"))
    enc.most = 40
    once = enc.encode_batch([f"a,b{k} a.b{k} a-b{k}" for k in range(12)])
    known = dict(enc.words)
    assert enc.encode_batch([f"b{k}" for k in range(12)]) and len(known) <= 40 and known.items() <= enc.words.items()
    assert once == tokens.LibraryIds(public_tokenizers.path("word_bpe_49k.json")).encode_batch([f"a,b{k} a.b{k} a-b{k}" for k in range(12)])


def test_gathered_batches_hold_the_same_rows():
    batches = [pa.RecordBatch.from_pydict({"x": [str(k)] * 5}) for k in range(9)]
    got = list(tokens.gathered(iter(batches), 3 * batches[0].nbytes))
    assert len(got) == 3 and pa.Table.from_batches(got) == pa.Table.from_batches(batches)
    assert list(tokens.gathered(iter([]))) == []
