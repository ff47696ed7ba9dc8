"""Work on single rows: dealt to all cores, and each value computed once."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.functions import ast as A
from quern.functions import text as X
from quern.operators import neighbours, retrieval

SF = os.environ.get("QUERN_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df, which="analyzed"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.mark.parametrize("name", ["goal_context_parse", "nested_declarations", "resolve_at_index", "arrow_split", "strip_comments"])
def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, name):
    assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_matching_types_reads_each_tree_once(spark):
    assert "regexp_replace" not in plan_of(entry.queries()["matching_types"](spark, SF), "optimizedPlan")


def test_an_index_is_resolved_from_names_that_are_found_once(spark):
    names = A.binder_names(A.pi_binders(F.col("ast")))
    d = spark.createDataFrame([("@1", '{"tag":"Pi"}')], "body string, ast string").select(A.resolve_index(F.col("body"), names).alias("x"))
    assert plan_of(d).count('"Pi"') <= 2  # once for how many steps, twice where its length is taken


def test_arrows_between_runs(spark):
    cases = {"a --> b": ["a -", "b"], "a→\nb(→c)->d": ["a", "\nb(→c)", "d"], "->->": [], "x ) -> y]→(z → w": ["x )", "y]", "(z → w"], "a->>b": ["a", ">b"], "𝔸 → - >": ["𝔸", "- >"], "": []}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.split_arrows(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in d.collect()} == cases


def test_copies_are_compared_once_a_bag(spark):
    words = [("a b", 4), ("a", 3), ("b c c", 5), ("z", 2)]
    docs = [(100 + 7 * k, w) for k, w in enumerate([w for w, n in words for _ in range(n)])]
    table = lambda rows: retrieval.term_counts(spark.createDataFrame(rows, "id int, text string"), "id", X.letter_tokens(F.col("text"))).withColumnRenamed("tf", "weight")
    asked = [(1, "a b"), (2, "c"), (3, "b a"), (4, "q")]
    got = {(r["query"], r["place"]): (r["doc"], r["score"]) for r in retrieval.all_matches(table(asked), table(docs), 6).collect()}
    want = {}
    for q, text in asked:
        scores = sorted((-sum(text.split().count(t) * w.split().count(t) for t in set(text.split())), d) for d, w in docs)
        want |= {(q, k + 1): (d, -s) for k, (s, d) in enumerate([x for x in scores if x[0] < 0][:6])}
    assert got == want


def test_a_score_joins_bags_not_documents(spark):
    same = spark.range(500).select(F.col("id").alias("doc"), F.lit("a").alias("token"), F.lit(1).alias("weight"))
    found = retrieval.all_matches(same.where("doc < 100"), same, 3)
    assert found.count() == 300
    assert {r["doc"] for r in found.collect()} == {0, 1, 2}
    assert "collect_list" in plan_of(found)


def test_a_block_product_is_held_in_slices(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
    x = np.random.default_rng(1).normal(size=(3000, 8))
    table = lambda ids, v: pa.table({"id": pa.array(ids), "v": pa.array(list(v), pa.list_(pa.float64()))})
    asked, every = table(np.arange(2000), x[:2000]), table(np.arange(3000), x)
    tracemalloc.start()
    got = neighbours._best(asked, every, 5, schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # the whole product takes 48 MB, and its copies
    scores = x[:2000] @ x.T
    scores[np.arange(2000), np.arange(2000)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :5]
    assert (got.column("id").to_numpy().reshape(2000, 5) == want).all() and (got.column("query").to_numpy() == np.repeat(np.arange(2000), 5)).all()


def test_tokens_are_counted_in_one_shuffle_without_a_row_for_each(spark, tmp_path):
    rows = [(1, "Aa aA λ Λ -> _X y_ {b 12"), (1, "aa new"), (2, "   "), (3, None), (4, "Z'z _Q_")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = entry.queries()["tokenize_docs"](spark, str(tmp_path))
    terms = retrieval.term_counts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", X.retrieval_tokens(F.col("text")))
    want = {r["doc"]: (r["d"], r["n"]) for r in terms.groupBy("doc").agg(F.count("*").alias("d"), F.sum("tf").alias("n")).collect()}
    assert {r["doc"]: (r["n_distinct"], r["n_tokens"]) for r in d.collect()} == want
    assert plan_of(d, "optimizedPlan").count("Aggregate") == 1
