"""Joins of whole texts on worked examples."""

from noteproof import plans, registry
from noteproof.operators import matching

plans.load()


def test_confirmed_pairs_need_a_span_or_two_words(spark):
    findings = spark.createDataFrame([(1, "uses load_config_file"), (2, "one alpha_x here"), (3, "alpha_xy and beta.go")], "f long, text string")
    claims = spark.createDataFrame([(7, "load_config", True), (8, "alpha_x", False), (8, "beta.go", False)], "c long, term string, spanned boolean")
    assert {(r.f, r.c, r.score) for r in matching.confirmed_pairs(findings, claims, "f", "c").collect()} == {(1, 7, 3), (3, 8, 4)}


def test_promises_without_a_hit_stay_open(spark, tmp_path):
    spark.createDataFrame([(1, "new_thing"), (2, "absent_one"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a new_thing_here", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["promise_check"](spark, str(tmp_path)).collect()
    assert {r.item_id: (r.state, r.plus, r.minus) for r in got} == {1: ("kept", 1, 0), 2: ("open", 0, 0), 3: ("open", 0, 0)}
