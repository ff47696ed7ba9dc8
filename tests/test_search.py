"""Retrieval by blocks, trigrams and lists, against scans and all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import blockmax, neighbours, retrieval, search, trigrams, views


def plain_top(queries, docs, k):
    by_token, out = {}, {}
    for d, t, w in docs:
        by_token.setdefault(t, []).append((d, w))
    for one in {q for q, _, _ in queries}:
        score = {}
        for q, t, wq in queries:
            if q == one:
                for d, w in by_token.get(t, ()):
                    score[d] = score.get(d, 0) + wq * w
        for place, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1):
            out[one, place] = (d, round(s, 6))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc long, token string, weight double")


def test_top_matches_are_those_of_all_products(spark, tmp_path):
    r = random.Random(2)
    rows = lambda n, base, each: [(k, t, r.random() + 0.01) for k in range(base, base + n) for t in {f"t{int(r.random() ** 3 * 12)}" for _ in range(each)}]
    q, d = rows(12, 0, 4), rows(80, 100, 4)
    q += [(50, "t0", 1.0), (51, "nowhere", 1.0)]
    blockmax.write_postings(table(spark, d), str(tmp_path), size=8)
    index = blockmax.read_postings(spark, str(tmp_path))
    assert index["blocks"].agg(F.max("n")).first()[0] <= 8 and index["blocks"].agg(F.sum("n")).first()[0] == len(d)
    for k in (1, 5, 200):
        want = plain_top(q, d, k)
        got = {(x["query"], x["place"]): (x["doc"], round(x["score"], 6)) for x in blockmax.top_matches(index, table(spark, q), k).collect()}
        assert got == want
        got = {(x["query"], x["place"]): (x["doc"], round(x["score"], 6)) for x in retrieval.all_matches(table(spark, q), table(spark, d), k).collect()}
        assert got == want


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    """Weights of long lists fall off as they do in text: most of the rows of the full join stay unread, and the results are the same."""
    r = np.random.default_rng(5)
    docs = [(int(d), f"t{t}", float(w)) for t in range(40) for d, w in zip(r.choice(6000, 3000 // (t + 1) + 20, replace=False), r.pareto(2.0, 3000 // (t + 1) + 20) + 0.01)]
    queries = [(q, f"t{t}", float(r.random() + 0.5)) for q in range(10) for t in r.choice(40, 5, replace=False)]
    blockmax.write_postings(table(spark, docs), str(tmp_path), size=32)
    index = blockmax.read_postings(spark, str(tmp_path))
    blocks = blockmax.needed_blocks(index, table(spark, queries), 10)
    every, read = blocks.agg(F.sum("n"), F.sum(F.when(F.col("needed") | F.col("first"), F.col("n")))).first()
    length = {}
    for _, t, _ in docs:
        length[t] = length.get(t, 0) + 1
    assert every == sum(length[t] for _, t, _ in queries) and read < every / 3
    got = {(x["query"], x["place"]): (x["doc"], round(x["score"], 6)) for x in blockmax.top_matches(index, table(spark, queries), 10).collect()}
    assert got == plain_top(queries, docs, 10)


def test_only_asked_tokens_complete_scores(spark, tmp_path):
    """Candidates' documents hold many tokens that no query has: these rows go before the join by document. Postings without a document are none."""
    docs = [(d, f"t{t}", 1.0 + (d * t) % 7) for d in range(30) for t in range(20)] + [(None, "t1", 9.0)]
    queries = [(0, "t1", 1.0), (0, "t2", 0.5)]
    blockmax.write_postings(table(spark, docs), str(tmp_path), size=4)
    index = blockmax.read_postings(spark, str(tmp_path))
    found = blockmax.top_matches(index, table(spark, queries), 3)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(x["query"], x["place"]): (x["doc"], round(x["score"], 6)) for x in found.collect()} == plain_top(queries, docs[:-1], 3)


def test_expansion_in_dealt_partitions(spark):
    """The same rows as by the planner's sizes, repeated tokens and short names of more than five definitions too; each branch lies in the partitions that were asked for."""
    defs = spark.createDataFrame([(f"m.n{k % 4}.{k}", f"n{k % 4}", "m", "def") for k in range(30)] + [(None, None, None, None)], "pretty_qname string, pretty_name string, module string, def_kind string")
    tokens = spark.createDataFrame([(k, t) for k in range(6) for t in ("n1", "n1", "m.n2.6", "n9", "m.n1.1")[: k + 1]] + [(9, None)], "ord int, token string")
    found = search.expand(tokens, defs, 7)
    assert found.rdd.getNumPartitions() == 14
    got, want = (sorted(map(tuple, d.collect())) for d in (found, search.expand(tokens, defs)))
    assert got == want and len(got) == 5 * 6 + 4 + 2


def names(n=3000, seed=3):
    r = random.Random(seed)
    part = lambda: "".join(r.choice("abcαβ_∘Ä") for _ in range(r.randint(1, 5)))
    rows = []
    for k in range(n):
        module, name = f"{part()}.{part()}", part()
        rows.append((f"{module}.{name}.{k}", name, module, r.choice(["def", "data"]), " → ".join(part() for _ in range(r.randint(0, 6))) or None))
    return rows + [rows[0], ("same", "x", "m", "def", "A"), ("same", "x", "m", "def", "B"), ("none", None, None, None, None)]


COLS = "pretty_qname string, pretty_name string, module string, def_kind string, type string"


def test_trigram_search_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "CHUNK", 64)
    monkeypatch.setattr(trigrams, "RAREST", 3)
    data, r = names(), random.Random(8)
    d = spark.createDataFrame(data, COLS)
    trigrams.write_trigrams(d, str(tmp_path))
    index = trigrams.Trigrams(spark, str(tmp_path))
    asked = {("name", t) for t in ("", "a", "AB", "same", "nothing here", "ä_", ".1234", "x" * 20)} | {("type", t) for t in (" → ", "→", "Αβ", "%", "a → b")}
    for size in (1, 2, 3, 4, 6, 9, 14, 20):
        one = r.choice([x for x in data if len(x[0]) >= size])
        at = r.randrange(len(one[0]) - size + 1)
        asked.add(("name", one[0][at : at + size].upper()))
        one = r.choice([x for x in data if len(x[4] or "") >= size])
        at = r.randrange(len(one[4]) - size + 1)
        asked.add(("type", one[4][at : at + size].swapcase()))
    for field, text in sorted(asked):
        scan = {"name": search.by_name, "type": search.by_type}[field]
        for limit in (None, 3):
            want = [tuple(x) for x in scan(d, text, limit).collect()]
            got = [tuple(x) for x in index.search(field, text, limit).collect()]
            assert [x[0] for x in got] == [x[0] for x in want] and len(set(got)) >= len(set(want)) - 1, (field, text)
    plan = index.candidates("name", "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(field,name)" in plan and "In(gram" in plan or "EqualTo(gram" in plan


def test_nearest_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 3.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x["query"], x["place"]): x["id"] for x in neighbours.nearest(d, d.where("id in (1, 3, 4, 6)"), "id", "v", 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 7}
    assert neighbours.nearest(d.limit(0), d, "id", "v", 2).count() == 0 == neighbours.nearest(d, d.limit(0), "id", "v", 2).count()


@pytest.mark.parametrize("ties", [False, True])
def test_nearest_as_plain(spark, monkeypatch, ties):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    r = np.random.default_rng(1)
    x = r.integers(-1, 2, (260, 3)).astype(float) if ties else r.normal(size=(260, 6))
    x = x[np.abs(x).sum(1) > 0]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = sorted((q, p, i, c) for q, i, c, p in neighbours.nearest(d, d.where("id % 3 = 0"), "id", "v", 7).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q in range(0, len(x), 3):
        s = np.round(u @ u[q], 9)
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:7]
        want += [(q, p, i, round(float(s[i]), 6)) for p, i in enumerate(order, 1)]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_lists_find_nine_tenths(spark, tmp_path):
    """Of vectors in loose bundles: recall at ten is measured over all vectors, and a query meets few of them."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 4000)] + 0.35 * r.normal(size=(4000, 16))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0])], "id long, v array<double>").repartition(4)
    queries = d.where("id % 50 = 0")
    neighbours.write_lists(d, "id", "v", str(tmp_path))
    index = neighbours.read_lists(spark, str(tmp_path))
    assert index["lists"].select("id").distinct().count() == 4000 == index["lists"].count()
    probes, got = neighbours.probes_for(index, d, queries, "id", "v", 10)
    assert got >= 0.9 and probes < index["centres"].count() / 4
    assert neighbours.compared(index, queries, "id", "v", probes) < 1200
    found = neighbours.nearest_by_lists(index, queries, "id", "v", 10, probes)
    exact = neighbours.nearest(d, queries, "id", "v", 10)
    assert neighbours.recall(found, exact) == pytest.approx(got)
    # all lists are all vectors
    whole = neighbours.nearest_by_lists(index, queries, "id", "v", 10, index["centres"].count())
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_contexts_are_read_from_one_list_a_group(spark):
    rows = [("f", "M", f"n{k}", f"T{k}" if k % 5 else None, k) for k in range(60)] + [("f", None, "n1", "U", 100), ("f", None, "z", "V", 101), ("g", "M", "alone", "W", 102), ("f", "M", "n1", "again", 103)]
    d = spark.createDataFrame(rows, "file string, module string, name string, type string, ord int")
    got = views.proof_contexts(d, ["file", "module"], "name", "type", "ord")
    # a group without a module is one of its own
    want = sorted((f, m or "", n, t, o, [f"{b} : {u}" for g, w, b, u, _ in rows if (g, w) == (f, m) and b != n and u]) for f, m, n, t, o in rows if t)
    have = sorted((x["file"], x["module"] or "", x["goal"], x["goal_type"], x["goal_ord"], x["context"]) for x in got.collect())
    assert have == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "explode" not in plan.lower()  # of rows with one list a group


def test_contexts_of_a_large_group_are_made_in_many_tasks(spark):
    """The rows of one group are dealt out, however few bytes they are, and each meets its group's lines once."""
    rows = [("M", f"n{k}", f"T{k % 7}", k // 2) for k in range(1000)] + [(None, f"n{k}", "U", None) for k in range(70)] + [("N", None, "V", 1), ("N", "x", "W", 2)]
    d = spark.createDataFrame(rows, "module string, name string, type string, ord int")
    got = views.proof_contexts(d, ["module"], "name", "type", "ord").withColumn("task", F.spark_partition_id()).collect()
    lines = lambda m, n: sorted(f"{b} : {u}" for w, b, u, _ in rows if w == m and n and b and b != n)
    assert sorted((x["module"] or "", x["goal"] or "", sorted(x["context"])) for x in got if x["goal"]) == sorted((m or "", n, lines(m, n)) for m, n, _, _ in rows if n)
    assert len(got) == len(rows)
    tasks = [x["task"] for x in got if x["module"] == "M"]
    assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 1000


def test_copies_of_lines_are_shuffled_once(spark):
    """Rows are shuffled by group and to their unit, lines likewise, whatever columns name the group."""
    d = spark.createDataFrame([("f", "M", f"n{k}", "T", k) for k in range(200)] + [("f", None, "n0", "U", 1), ("f", None, "n1", "V", 2)], "file string, module string, name string, type string, ord int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = views.proof_contexts(d, ["file", "module"], "name", "type", "ord")
        have = {(x["module"], x["goal"]): x["context"] for x in got.collect()}
        plan = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().initialPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(have) == 202 and have[None, "n0"] == ["n1 : V"] and have["M", "n7"] == [f"n{k} : T" for k in range(200) if k != 7]
    assert "SortMergeJoin" in plan[0] and plan[1].count("Exchange ") == 4


def test_long_contexts_are_written_in_small_pages(spark, tmp_path):
    """Parquet's writer holds about a context, not a hundred of them."""
    d = spark.createDataFrame([("M", f"n{k}", f"{k} " * 1500, k) for k in range(80)], "module string, name string, type string, ord int")
    got = views.proof_contexts(d, ["module"], "name", "type", "ord").select("goal", F.array_join("context", "\n").alias("context"))
    got.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("length(context) > 250000").count() == 80  # over 20 MB in all
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pages = 0
    for f in (tmp_path / "out").glob("*.parquet"):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf))
        for block in reader.getFooter().getBlocks():
            pages += sum(reader.readOffsetIndex(c).getPageCount() for c in block.getColumns() if c.getPath().toDotString() == "context")
        reader.close()
    assert pages >= 16
