"""JSON of unknown shape."""

from pyspark.sql import functions as F

from quern.functions import jsonwalk as J
from quern.functions import text as X


def test_walk(spark):
    doc = '{"module":"M","decls":[{"name":"a","type":"T"},{"file":"f","inner":{"name":"b","type":"U","kids":[{"name":"c","type":"V"}]}},{"name":1,"type":"x"}]}'
    d = spark.createDataFrame([(doc,), ("bad",), (None,)], "t string").select(J.declarations("t").alias("v"))
    got = [[tuple(x) for x in r["v"]] for r in d.collect()]
    assert got == [[(None, "M", "a", "T"), ("f", "M", "b", "U"), ("f", "M", "c", "V")], [], []]


def test_walk_goes_to_the_bottom_in_order(spark):
    deep = '{"name":"n","type":"t"}'
    for k in range(120):
        deep = f'[{deep},{{"name":"n{k}","type":"t"}}]' if k % 2 else f'{{"a":{deep}' + (',"module":"M%d"}' % k if k % 10 == 0 else "}")
    d = spark.createDataFrame([(deep,), ("3",), ('[{"type":"t","name":"a \\"q","file":"F"},{"name":"b","type":null},[[{"file":"G","x":{"name":"c","type":"u"}}]]]',)], "t string").select(J.declarations("t").alias("v"))
    assert "Python" not in d._jdf.queryExecution().toString()
    first, second, third = ([tuple(x) for x in r["v"]] for r in d.collect())
    assert len(first) == 61 and first[0] == (None, "M0", "n", "t") and first[-1] == (None, None, "n119", "t") and second == []
    assert third == [("F", None, 'a "q', "t"), ("G", None, "c", "u")]


def test_picks(spark):
    d = spark.createDataFrame([('"x"',), ('{"pp":"y","shown":"z"}',), ('{"q":1}',), ('{"a":["m","n"],"b":["n","o"]}',)], "t string")
    rows = d.select(J.rendered(F.col("t")).alias("r"), J.names_under(F.col("t"), "a", "b").alias("n")).collect()
    assert [r["r"] for r in rows] == ["x", "y", None, None] and rows[3]["n"] == ["m", "n", "o"] and rows[2]["n"] == []


def test_goals_and_marks(spark):
    d = spark.createDataFrame([("A.B.foo  not  x", "f.x:1,2: Unsolved metas at the following locations: f.x:3,14-20 and g:7.2")], "g string, o string")
    r = d.select(X.plain_goal(F.col("g")).alias("g"), X.unsolved_positions(F.col("o")).alias("p")).first()
    assert r["g"] == "foo ¬ x" and [tuple(x) for x in r["p"]] == [(3, 14), (7, 2)]
