"""Prefix trie, piece encoding and importance resampling against brute force, the library and SQL, awkward tables included."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from noteproof.llm import common, oracles, piece_bpe, prefix_trie, queries, resampling  # noqa: E402

OPS = queries.queries()
EXTRA = "node long, n_convs string, key string, part string, place string, n long, depth string, score string, cells string"
ODD = (1, "n", "k", "p", "q", 2, "d", "s", "c")


def brute_trie(rows, head, base):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        s = tuple(own.get(base(c), [])[: head(c)] + own[c][head(c) :])
        for n in range(len(s) + 1):
            members[s[:n]].append(c)
        ends[s].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + (len(s) and (len(members[s]) - 1) * len(s[-1][1].encode()))
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return {(min(m), len(s)): (min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], digest(s)) for s, m in members.items()}


def nodes_of(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def conversation_rows():
    rng = random.Random(5)
    turns = [("user", "hello"), ("assistant", "hé 日本"), ("user", ""), (None, "x"), ("user", None), ("", "x"), ("use", "rhello")]
    rows = []
    for c in [*range(0, 40), -3, -5, -10, 2**40]:
        for k in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, k, *rng.choice(turns[: 2 + c % 6])))
    for c in range(100, 160):  # copies
        rows += [(c, k, "user", f"turn {k}") for k in range(11)]
    rows += [(41, None, "user", "null turn"), (41, 0, "user", "zero"), (41, 0, "user", "zero"), (41, 0, "assistant", "tie"), (None, 0, "user", "no id")]
    return rows


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, *ODD) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")


def test_trie_equals_brute_force(spark):
    rows = conversation_rows()
    assert nodes_of(prefix_trie.trie_nodes(conversation_table(spark, rows).repartition(5))) == brute_trie(rows, lambda c: 0, lambda c: c)


def rebuilt_nodes(rows):
    return brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 9, lambda c: c - int(math.fmod(c, 5)))


def test_trie_query(spark, tmp_path, monkeypatch):
    rows = conversation_rows()
    conversation_table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt_nodes(rows)
    assert any(d == 0 and v[4] > 0 for (_, d), v in want.items())
    assert nodes_of(OPS["op11_prefix_trie"](spark, str(tmp_path))) == want
    # blocks and chains of other sizes, and no large groups
    monkeypatch.setattr(prefix_trie, "CHAIN", 2)
    monkeypatch.setattr(prefix_trie, "HEAVY", 1)
    assert nodes_of(OPS["op11_prefix_trie"](spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert {(r[0], r[1]): tuple(r[2:]) for r in con.sql(oracles.PREFIX_TRIE).fetchall()} == want
    empty = tmp_path / "empty"
    conversation_table(spark, rows).limit(0).write.parquet(f"{empty}/conversations.parquet")
    assert OPS["op11_prefix_trie"](spark, str(empty)).collect() == []


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, k, "user", f"t{k % 3}") for k in range(400)] + [(8, k, "user", f"t{k % 3}") for k in range(30)] + [(9, 0, "user", "other")]
    got = nodes_of(prefix_trie.trie_nodes(conversation_table(spark, rows).repartition(4)))
    assert got == brute_trie(rows, lambda c: 0, lambda c: c)


def test_turns_are_numbered_across_ranges(spark):
    df = conversation_table(spark, [(c, k, "user", "t") for c in (1, 2) for k in range(500)])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.conv_id, r.pos) for r in prefix_trie.turn_rows(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == [(c, k) for c in (1, 2) for k in range(500)]


def piece_texts():
    rng = random.Random(4)
    pool = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "ß", "日", "本", "😀", "the", "1", "23", "<s>", "</s>", "<0x41>", "\x00", "​", " the", "\r\n", "ﬁ", "é", "}", ");"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    return [None, "", " ", "▁", "\n", "a" * 30_000, " " * 3000, "日" * 3000, "same text", "same text", "word " * 20_000, *odd]


def test_piece_query(spark, tmp_path):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(piece_texts())] + [(8, "repeated id")]
    spark.createDataFrame([(*r, *ODD) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for d, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    got = OPS["op12_piece_round_trip"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert piece_bpe.check_documents(docs, queries.PIECES).where("not agrees").count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert OPS["op12_piece_round_trip"](spark, f"{tmp_path}/e").count() == 0


def test_pieces_of_whole_table_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert piece_bpe.check_documents(docs, queries.PIECES).groupBy("agrees").count().collect() == [(True, docs.count())]


def test_agenda_forms_agree_and_disagreement_is_an_error():
    bpe = piece_bpe.PieceBpe(queries.PIECES)
    rng = random.Random(2)
    letters = "abcdetionrsh▁▁"
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 33))) for _ in range(500)]
    assert bpe.encode_runs(runs) == [b"".join(map(bpe.encode_symbol, bpe.merge(r))) for r in runs]
    bpe.encode_runs = lambda runs: [bpe.encode_symbol(r[:1]) for r in runs]
    with pytest.raises(ValueError, match="another way"):
        bpe.fill(["hello", "there"])


def test_any_ids_decode_as_the_library_does():
    bpe = piece_bpe.PieceBpe(queries.PIECES)
    rng = random.Random(9)
    lists = [[rng.choice([*range(262), 29871, rng.randrange(32_000)]) for _ in range(rng.randrange(12))] for _ in range(5000)]
    flat = np.array([k for x in lists for k in x], np.int64)
    assert bpe.decode_column(flat, np.cumsum([len(x) for x in lists])) == bpe.library.decode(lists)


def brute_draw(docs, target, percent=10, least=20, seed=2024, buckets=10_000, grams=1):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def cells(t):
        words = word.findall((t or "").encode().lower())
        return len(words), [zlib.crc32(b" ".join(words[k : k + n])) % buckets for n in range(1, grams + 1) for k in range(len(words) - n + 1)]

    coded = [(d, *cells(t)) for d, t in docs]
    raw, wanted = collections.Counter(k for _, _, c in coded for k in c), collections.Counter(k for t in target for k in cells(t)[1])
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[k] + 1.0) * (s_all + buckets) / ((raw[k] + 1.0) * (t_all + buckets)))) for k in range(buckets)]
    rows = []
    for d, n, c in coded:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in c)
        rows.append((d, len(c), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    k = percent * len(able) // 100
    found = collections.Counter((*r[:4], n + 1) for n, r in enumerate(able[:k]))
    return found + collections.Counter((*r[:4], None) for r in able[k:] + [r for r in rows if r[4] < least])


def resample_rows():
    rng = random.Random(1)
    pool = ["Alpha", "béta", "GAMMA", "ÉTÉ", "delta7", "x_y", "日本", "\x7f", "it's", "omega\x00", "ps̈i"]
    rows = [(d, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 19, 20, 25, 60])))) for d in range(300)]
    rows += [(None, "word " * 30)] * 3 + [(5, "word " * 30)] * 40 + [(6, None), (-(2**62), "neg " * 21), (400, "gamma " * 40_000)]
    return rows


@pytest.mark.parametrize("percent", [0, 1, 10, 47, 100])
def test_draw_equals_brute_force(spark, percent):
    rows, target = resample_rows(), ["gamma béta", None, "", "Delta7 word"]
    docs = spark.createDataFrame([(*r, *ODD) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = collections.Counter(map(tuple, resampling.resample(docs, wanted, percent=percent).collect()))
    assert got == brute_draw(rows, target, percent)


def test_ties_of_whole_rows_are_cut_exactly(spark):
    rows = [(5, "word " * 30)] * 90 + [(d, "other " * 30) for d in range(10)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string")
    got = collections.Counter(map(tuple, resampling.resample(docs, wanted, percent=33).collect()))
    assert got == brute_draw(rows, ["word"], 33)
    assert sum(got.values()) == 100


def test_longer_features_and_other_parameters(spark):
    rows, target = resample_rows()[:120], ["gamma béta gamma", "alpha"]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = collections.Counter(map(tuple, resampling.resample(docs, wanted, percent=20, least_words=3, grams=2, buckets=64, seed=7).collect()))
    assert got == brute_draw(rows, target, 20, 3, 7, 64, 2)


def test_resample_query_and_sql(spark, tmp_path):
    rows, target = resample_rows(), ["gamma béta", None, "word"]
    spark.createDataFrame([(*r, *ODD) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, t) for t in target], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = OPS["op13_importance_resampling"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_draw(rows, target)
    assert collections.Counter(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert collections.Counter(con.sql(oracles.RESAMPLING).fetchall()) == want
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert OPS["op13_importance_resampling"](spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_importance_resampling"])
def test_sql_of_whole_tables(spark, name):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = OPS[name](spark, sf).select(*want.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


def test_range_numbers(spark):
    held = common.range_numbered(spark, spark.range(1000).repartition(7), ["id"], "numbers").orderBy("id").collect()
    assert [(r.part, r.place) for r in held] == sorted((r.part, r.place) for r in held)


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "repeat(cast(id as string), 50) as text").repartition(2)
    df.write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/t")
    found = []
    for split in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        scan = spark.read.parquet(f"{tmp_path}/t").select("id")
        found.append((scan.rdd.getNumPartitions(), {r.id: r.rid for r in common.row_numbers(scan, "rid").collect()}))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][1] == found[1][1]
    assert len(set(found[0][1].values())) == 3000
    assert found[0][0] != found[1][0]
