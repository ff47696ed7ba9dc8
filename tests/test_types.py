"""Types by structure."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import ast as A
from quern.operators import types
from quern.plans import adapters


def var(i, *elims):
    return {"tag": "Var", "ix": i, "elims": list(elims)}


def known(name, *terms):
    return {"tag": "Def", "qname": name, "elims": [{"tag": "Apply", "hiding": "explicit", "term": t} for t in terms]}


def kind(term):
    return {"tag": "Type", "sort": {"tag": "Set"}, "term": term}


def pi(hint, dom, cod):
    return {"tag": "Pi", "binder": {"hiding": "explicit", **hint}, "dom": kind(dom), "cod": kind(cod)}


def rows():
    hints = [{}, {"nameHint": None}, {"nameHint": "x"}, {"nameHint": 'q"u\\{,"}'}, {"hint": "\\", "name": "", "nameHint": "é\n"}]
    same = [(f"s{k}", json.dumps(kind(pi(h, known("A"), known("B", var(0)))), indent=k or None, ensure_ascii=k % 2 == 0)) for k, h in enumerate(hints)]
    other = [("a", json.dumps(kind(pi({}, known("A"), known("B", var(1)))))), ("b", json.dumps(kind(pi({}, known("A", var(0)), known("B", var(0))))))]
    shuffled = ("t", '{"term":{"cod":{"term":{"qname":"B","elims":[{"term":{"elims":[],"ix":0,"tag":"Var"},"hiding":"explicit","tag":"Apply"}],"tag":"Def"},"sort":{"tag":"Set"},"tag":"Type"},"dom":%s,"binder":{"hiding":"explicit"},"tag":"Pi"},"sort":{"tag":"Set"},"tag":"Type"}' % json.dumps(kind(known("A"))))
    return [*same, *other, shuffled, ("none", None), ("bad", '{"tag":')]


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame(rows(), "k string, ast string")


def test_one_structure_is_one_group(spark, trees):
    got = {r["k"]: r["group"] for r in types.matching_types(trees, "k", "ast").collect()}
    assert got == {**{f"s{k}": "s0" for k in range(5)}, "t": "s0", "a": "a", "b": "b"}
    # a name is no structure, a string elsewhere is, even one that looks like a name
    text = lambda s: json.loads(spark.range(1).select(A.canonical(F.lit(s))).first()[0])
    assert text('{"hint":"a","name":null}') == {} and text('{"tag":"Lit","lit":"\\"name\\":\\"x\\",","name":"n"}') == {"tag": "Lit", "lit": '"name":"x",'}
    assert text('{"z":1,"name":"a","hint":"b","a":{"nameHint":"\\\\\\""}}') == {"a": {}, "z": 1} and text('{"name":{"name":"x","y":1}}') == {"name": {"y": 1}}


def test_index(spark, trees, tmp_path):
    types.write_type_index(trees, "k", "ast", str(tmp_path))
    index = types.read_type_index(spark, str(tmp_path))
    find = lambda p, **o: sorted(tuple(r) for r in types.find_types(index, json.dumps(p), **o).collect())
    all_s = [f"s{k}" for k in range(5)] + ["t"]
    assert find(known("A")) == sorted([(k, "$.term.dom.term") for k in [*all_s, "a"]])
    assert find(kind(known("A")), whole=True) == []
    assert find(json.loads(rows()[3][1]), whole=True) == [(k, "$") for k in all_s]
    assert find(known("B", {"tag": "*"})) == sorted([(k, "$.term.cod.term") for k in [*all_s, "a", "b"]])
    assert find(known("B", {"tag": "*"}, {"tag": "*"})) == []
    both = pi({"name": "other"}, {"tag": "*"}, known("B", {"tag": "*"}))
    assert find(both) == sorted([(k, "$.term") for k in [*all_s, "a", "b"]]) and find(both, whole=True) == []
    assert find({"tag": "Apply", "hiding": "explicit", "term": {"tag": "*"}}) == sorted([(k, "$.term.cod.term.elims[0]") for k in [*all_s, "a", "b"]] + [("b", "$.term.dom.term.elims[0]")])
    plan = types.find_types(index, json.dumps(known("A")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(hash)" in plan and "EqualTo(hash" in plan
    for bad in ("{", '{"tag":"*"}', "3"):
        with pytest.raises(ValueError):
            types.find_types(index, bad)


def test_large_trees_with_white_space(spark):
    """More than 1 MB of text in a row, deep and wide, neither a stack nor a pattern overflows."""
    term = known("C")
    for k in range(100):
        term = known(f"D{k}", *[var(j) for j in range(20)], term)
    wide = known("W", *[known(f"x{j}", var(j)) for j in range(4000)])
    long_name = pi({"nameHint": "\\\"" * 200_000}, known("A"), known("B"))
    texts = {"deep": kind(term), "wide": kind(wide), "name": kind(long_name), "short": kind(pi({}, known("A"), known("B")))}
    data = [(f"{k}{i}", json.dumps(t, indent=i)) for k, t in texts.items() for i in (None, 3)]
    assert max(len(t) for _, t in data) > 1 << 20
    got = {r["k"]: r["group"] for r in types.matching_types(spark.createDataFrame(data, "k string, ast string"), "k", "ast").collect()}
    assert got == {**{f"{k}{i}": f"{k}3" for k in ("deep", "wide") for i in (None, 3)}, **{f"{k}{i}": "name3" for k in ("name", "short") for i in (None, 3)}}
    found = types.type_index(spark.createDataFrame(data[2:4], "k string, ast string"), "k", "ast")
    assert found.where("path = '$.term.elims[3999].term'").count() == 2 and found.count() == 2 * (4 + 4000 * 6)


def test_a_tree_is_parsed_once_for_its_form_and_once_for_the_walk(spark):
    plan = spark.range(1).select(F.lit("{}").alias("ast")).select(A.subtrees(F.col("ast")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 2


def test_trees_of_a_small_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(50).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size", "'Brand#1' AS p_brand", "'n' AS p_name", "'t' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for rows in (adapters.type_trees(spark, str(tmp_path)), adapters.typed_parts(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert rows.count() == 50
