"""Operators, sources, sinks and streams on small tables."""

import gzip
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import curate, evaluate, graph, retrieval, stats, validate
from quern.sources.shared import written
from quern.sources import readers, writers
from quern.streaming import ledger


def test_distribution(spark):
    r = stats.distribution(spark.createDataFrame([(k,) for k in range(1, 11)], "v int"), "v").first()
    assert (r["p50"], r["p90"], r["p99"], r["median"], r["total"]) == (5, 9, 10, 5.5, 55)
    assert set(stats.distribution(spark.createDataFrame([], "v int"), "v").first()) == {0}


def test_floor_rank(spark):
    values = random.Random(1).choices(range(30), k=57)
    r = stats.floor_rank(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    s = sorted(values)
    assert (r["min"], r["p50"], r["p90"], r["p99"], r["max"]) == (s[0], s[int(56 * 0.5)], s[int(56 * 0.9)], s[int(56 * 0.99)], s[-1])


def test_keep_first_and_last(spark):
    d = spark.createDataFrame([(None, "x", 3), (None, "y", 1), ("a", "z", 2)], "k string, v string, ord int")
    assert {(r["k"], r["v"]) for r in curate.keep_first(d, ["k"], ["ord"]).collect()} == {(None, "y"), ("a", "z")}
    assert {(r["k"], r["v"]) for r in curate.keep_last(d, ["k"], ["ord"]).collect()} == {(None, "x"), ("a", "z")}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "d2")], "src string, dst string")
    assert graph.longest_path(e) == 2
    assert graph.longest_path(e.unionAll(spark.createDataFrame([("c", "a")], "src string, dst string"))) is None
    assert graph.longest_path(e.limit(0)) == 0
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    assert {r["node"]: r["component"] for r in graph.connected_components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "d2": "d"}
    assert {(r["node"], r["hop"]) for r in graph.khop(e, nodes.where("node = 'a'"), 2).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    d = {r["node"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(e.withColumnRenamed("dst", "token"), nodes).collect()}
    assert d["a"] == (2, 0) and d["c"] == (0, 2)


def test_vectors_have_length_one(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "")], "doc int, t string")
    terms = retrieval.term_counts(d, "doc", F.filter(F.split("t", " "), lambda x: x != ""))
    v = retrieval.tfidf(terms, retrieval.vocabulary(terms, F.lit(3)))
    norms = {r["doc"]: r["n"] for r in v.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert norms == {1: pytest.approx(1), 2: pytest.approx(1)}


def test_probe_order(spark):
    rows = [("crash", 0), ("ok", 2), ("ok", 0), ("timeout", 0), ("ok", 1), ("type_error", 0)]
    d = spark.createDataFrame([(1, s, h, f"c{k}") for k, (s, h) in enumerate(rows)], "g int, s string, h int, c string")
    got = [(r["s"], r["h"]) for r in evaluate.rank_probes(d, ["g"], "s", "h", "c").orderBy("rank").collect()]
    assert got == [("ok", 0), ("ok", 1), ("ok", 2), ("timeout", 0), ("type_error", 0), ("crash", 0)]


def test_timing_split_has_every_phase(spark):
    d = spark.createDataFrame([("proposal", 10.0, 4, False), ("proposal", 5.0, None, True)], "phase string, client_ms double, server_ms long, cached boolean")
    got = {r["phase"]: r for r in evaluate.timing_split(d, evaluate.PHASES).collect()}
    assert len(got) == 5 and got["final_check"]["calls"] == 0 and got["proposal"]["client_ms"] == 10.0 and got["proposal"]["cache_hits"] == 1 and got["proposal"]["percent"] == 100.0


def test_validation(spark):
    lines = ['{"file":1,"module":1,"name":1,"qname":1,"type":1,"kind":1,"astSize":1}', '{"name":1}', "bad", "", "[]"]
    d = spark.createDataFrame(list(enumerate(lines)), "n int, raw string")
    assert {r["n"]: r["error"] for r in validate.validate_lines(d, "raw", "n").collect()} == {1: "missing keys: body,type", 2: "JSON parse error", 4: "not a JSON object"}
    r = validate.validate_report(d.withColumn("file", F.lit("f")).withColumn("no", F.col("n") + 1), "raw", "no", "file").first()
    assert (r["ok"], r["rows"], r["errors"]) == (False, 4, ["line 2: missing keys: body,type", "line 3: JSON parse error", "line 5: not a JSON object"])
    r = validate.validate_report(d.withColumn("file", F.lit("f")), "raw", "n", "file", 1).first()
    assert (r["rows"], len(r["errors"])) == (2, 1)
    r = validate.validate_report(spark.createDataFrame([(1, "  ", "g")], "n int, raw string, file string"), "raw", "n", "file").first()
    assert (r["ok"], r["rows"], r["errors"]) == (True, 0, [])
    wanted = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.StringType())])
    assert validate.schema_faults(d.schema, wanted) == ["missing x", "n is int, not bigint"]
    with pytest.raises(ValueError):
        validate.assert_schema(d, wanted)


def test_sources(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a":1}\n\n# note\nbad\n{"a":2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    good, bad = readers.jsonl_partitioned(spark, str(f), schema)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["raw"] for r in bad.collect()] == ["bad"]
    assert readers.json_objects(spark, str(f)).count() == 2
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as z:
        z.write('{"a":5}\n')
    assert readers.jsonl(spark, str(tmp_path / "y.jsonl.gz"), schema).first()["a"] == 5
    lines = spark.createDataFrame([('m0[label="A"];',), ('m1[label="B"];',), ("m0 -> m1;",), ("m0 -> m9;",)], "raw string")
    nodes, edges = readers.dot_graph(lines)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("A", "B")]
    shapes = spark.createDataFrame([('[{"n":1}]',), ('{"scope-local":[{"n":2}],"scope-private":[{"n":3}]}',), ('{"scope-local":[{"n":4}]}',)], "raw string")
    assert sorted(r["n"] for r in readers.two_shapes(shapes, "struct<n:int>").collect()) == [1, 2, 3, 4]
    (tmp_path / "src" / "Deep").mkdir(parents=True)
    (tmp_path / "src" / "Deep" / "M.agda").write_text("module M")
    (tmp_path / "src" / "N.lagda.md").write_text("text")
    assert {r["module"] for r in readers.source_modules(spark, str(tmp_path / "src")).collect()} == {"Deep.M", "N"}
    lock = spark.createDataFrame([('{"nodes":{"root":{},"p":{"locked":{"rev":"r1","lastModified":"y","ref":"main"}}}}',)], "raw string")
    assert sorted(tuple(r) for r in readers.lock_pins(lock).collect()) == [("p", "ref", "main"), ("p", "rev", "r1")]
    lib = spark.createDataFrame([("name: mylib",), ("include: src test",)], "raw string")
    assert tuple(readers.library(lib).first()) == ("mylib", ["src", "test"])
    assert readers.synthetic(spark, 10).count() == 10 and readers.synthetic(spark, 10).distinct().count() == 10


def test_sources_by_mode(spark, tmp_path):
    f, g = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    f.write_text('{"k":"x","a":1}\n\nbad\n{"k":"x","a":2}')
    g.write_text('{"k":"y","a":3}\n')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.IntegerType())])
    assert {r["a"] for r in readers.jsonl(spark, str(f), schema, "DROPMALFORMED").collect()} == {1, 2}
    with pytest.raises(Exception, match=r"a\.jsonl:3"):
        readers.jsonl_strict(spark, schema, str(f)).collect()
    assert [tuple(r) for r in readers.jsonl_strict(spark, schema, str(g)).collect()] == [("y", 3)]
    rows, report = readers.corpus_index(spark, schema, "k", str(f), str(g))
    assert {tuple(r) for r in rows.collect()} == {("x", 2), ("y", 3)}
    r = report.first()
    assert r["bad_lines"] == 1 and r["samples"][0].endswith("a.jsonl:3")
    for text in ('[{"k":"x","a":1},\n{"k":"y","a":2}]', '{"k":"x","a":1}\n{"k":"y","a":2}\n'):
        (tmp_path / "c.json").write_text(text)
        assert {tuple(r) for r in readers.any_json(spark, str(tmp_path / "c.json"), "k string, a int").collect()} == {("x", 1), ("y", 2)}
    (tmp_path / "c.json").write_text('{"k":"x",\n"a":1}')
    assert [tuple(r) for r in readers.any_json(spark, str(tmp_path / "c.json"), "k string, a int").collect()] == [("x", 1)]
    assert set(readers.inferred(spark, str(g)).columns) == {"k", "a"}
    assert [r["raw"] for r in readers.lines_from(spark, iter(["a\n", "b"])).collect()] == ["a", "b"]
    (tmp_path / "m.txt").write_text(" B \n# no\n\nA\nB\n")
    assert [r["module"] for r in readers.module_list(spark, str(tmp_path / "m.txt")).collect()] == ["A", "B"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x")]
    assert readers.json_documents(spark, str(tmp_path / "c.json"), schema).count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    writers.write_jsonl(d, str(tmp_path / "o"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"a":1,"b":"x"}', '{"a":2,"b":null}']
    assert writers.digest(d, "a") == writers.digest(d.repartition(3), "a") and writers.digest(d, "a")["rows"] == 2
    assert writers.fingerprint(d).first() == writers.fingerprint(d.repartition(3)).first()
    assert writers.markdown(d.orderBy("a")).splitlines()[2] == "| 1 | x |"
    assert writers.markdown(spark.range(30), 20).splitlines()[-1] == "10 more rows"
    writers.write_split(d, d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "test")).count() == 2


def test_more_sinks(spark, tmp_path):
    d = spark.createDataFrame([("B", 1, "b1\n"), ("A", 2, "a2"), ("A", 1, "a1"), ("C", 1, "c")], "module string, line_no int, raw string")
    r = writers.concatenate(d, ["A", "B"], str(tmp_path / "cat")).first()
    text = "".join(p.read_text() for p in sorted((tmp_path / "cat").glob("part-*")))
    assert text == "a1\na2\nb1\n" and tuple(r) == (3, len(text))
    with pytest.raises(FileNotFoundError, match="Z"):
        writers.concatenate(d, ["A", "Z"], str(tmp_path / "cat2"))
    writers.write_model(str(tmp_path / "model"), a=spark.range(2), b=spark.range(3))
    assert {k: v.count() for k, v in writers.read_model(spark, str(tmp_path / "model"), "a", "b").items()} == {"a": 2, "b": 3}
    writers.write_records(spark.createDataFrame([(1, None, "é")], "a int, b string, c string"), str(tmp_path / "rec"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rec")).collect()] == ['{"a":1,"c":"é"}']
    writers.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"), keep_nulls=False)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1}']
    report = spark.createDataFrame([("t", [(1.5, "x", {"a": 1})], 3)], "timestamp string, results array<struct<elapsedMs: double, name: string, m: map<string, int>>>, a int")
    assert writers.document(writers.normal_report(report)) == '{"a":3,"results":[{"m":{"a":1},"name":"x"}]}'
    said = writers.text_report("Title", ("Rows", spark.range(3).toDF("n")), most=2)
    assert said == "Title\n=====\n\nRows\n  n\n  0\n  1\n  1 more rows\n"


def test_strong_components(spark):
    r = random.Random(7)
    e = {(r.randrange(30), r.randrange(30)) for _ in range(45)} | {(40, 41), (41, 42), (42, 40), (42, 43), (44, 44)}
    nodes = {x for p in e for x in p}
    to = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in e:
            to[a] |= to[b]
    want = {n: min(m for m in to[n] if n in to[m]) for n in nodes}
    got = graph.strong_components(spark.createDataFrame(list(e), "src int, dst int"), spark.createDataFrame([(n,) for n in nodes], "node int"))
    assert {x["node"]: x["component"] for x in got.collect()} == want


def test_stream_as_batch(spark, tmp_path):
    e = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, IF(id % 2 = 0, 'a', 'b') AS phase, CAST(id AS DOUBLE) AS client_ms FROM range(200)")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    s = ledger.windowed(ledger.file_stream(spark, str(tmp_path / "in"), e.schema), late="2 hours")
    ledger.run_available(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    top = e.agg(F.max("ts")).first()[0]
    # windows that the watermark has passed; the others stay open
    batch = {tuple(r) for r in ledger.windowed(e).collect() if r["start"] + timedelta(hours=3) <= top}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 62 and got == batch


def test_samples_and_splits(spark):
    d = spark.createDataFrame([(f"q{k}", f"m{k % 3}") for k in range(60)], "q string, m string")
    a = [r["q"] for r in curate.hash_sample(d, "q", 9, "s").collect()]
    assert a == [r["q"] for r in curate.hash_sample(d.repartition(5), "q", 9, "s").collect()]
    capped = curate.hash_sample_capped(d, "q", "m", 6, 2, "s").collect()
    assert len(capped) == 6 and max(sum(r["m"] == m for r in capped) for m in ("m0", "m1", "m2")) == 2
    assert len(curate.random_split(d, (0.9, 0.1))) == 2


def test_tfidf_of_buckets_is_that_of_rows(spark):
    """Few or many tokens broadcast, rows that repeat an id, texts without tokens: the same weights, and the terms aren't shuffled by document."""
    rows = [(k % 40, " ".join(f"t{(k * j) % 23 + j % 3}" for j in range(k % 9))) for k in range(90)] + [(41, None), (42, "once")]
    docs = spark.createDataFrame(rows, "doc int, t string")
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    terms = retrieval.term_table(docs, "doc", tokens)
    assert "Exchange" not in terms.groupBy("doc").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString()
    vocab = written(retrieval.vocabulary(terms, F.lit(43)))
    key = lambda d: sorted((r["doc"], r["token"], round(r["weight"], 9)) for r in d.collect())
    plain = retrieval.term_counts(docs, "doc", tokens)
    want = key(retrieval.tfidf(plain, retrieval.vocabulary(plain, F.lit(43))))
    assert len(want) > 100 and {len(want)} == {len(set(w[:2] for w in want))}
    for head in (1, 5, 1000):
        assert key(retrieval.tfidf_table(terms, vocab, head)) == want
    assert not spark.catalog.listTables()
