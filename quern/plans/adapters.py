"""Views of the test tables as the engine's data model, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores: a file of few bytes is read by few tasks, however much is done with each of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def parts_for(rows: DataFrame, most: int = 1_000_000) -> int:
    """How many partitions hold about so many rows each: of short rows that compress well, bytes in a file or a shuffle say little about what a task holds. rows: a read table's, whose count is read from its files."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as definitions: the first line is the type, the rest the body."""
    d = table(spark, sf_dir, "documents")
    module = F.concat_ws(".", "source", "lang")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("ord"), module.alias("module"), name.alias("name"), F.concat_ws(".", module, name).alias("qname"), X.first_line(F.col("text")).alias("type"),
                    X.after_first_line(F.col("text")).alias("body"), F.col("lang").alias("def_kind"), F.col("source").alias("file"))


DEFS = """defs AS (SELECT doc_id AS ord, source || '.' || lang AS module, 'd' || doc_id AS name, source || '.' || lang || '.d' || doc_id AS qname,
  split_part(text, chr(10), 1) AS type, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) END AS body,
  lang AS def_kind, source AS file FROM documents)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a searchable corpus: three short names share each name, dependencies name parts by whole or short name."""
    p = table(spark, sf_dir, "part")
    key, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    short = F.concat(F.lit("n"), F.floor(key / 3).cast("string"))
    deps = F.array(F.concat(F.lit("m"), (key % 10).cast("string"), F.lit(".n"), F.floor(key / 3).cast("string"), F.lit("."), n), F.concat(F.lit("n"), F.floor((key + 7) / 3).cast("string")), F.concat(F.lit("zz"), n))
    return p.select(F.concat(F.lit("m"), (key % 10).cast("string"), F.lit("."), short, F.lit("."), n).alias("pretty_qname"), short.alias("pretty_name"), F.concat(F.lit("m"), (key % 10).cast("string")).alias("module"),
                    F.col("p_brand").alias("def_kind"), F.concat(F.lit("{A : "), "p_type", F.lit("} → "), "p_name", F.lit(" → "), "p_brand").alias("type"), deps.alias("dependencies"), key.alias("ord"))


CORPUS = """corpus AS (SELECT 'm' || (p_partkey % 10) || '.n' || (p_partkey // 3) || '.' || p_partkey AS pretty_qname, 'n' || (p_partkey // 3) AS pretty_name,
  'm' || (p_partkey % 10) AS module, p_brand AS def_kind, '{A : ' || p_type || '} → ' || p_name || ' → ' || p_brand AS type,
  ['m' || (p_partkey % 10) || '.n' || (p_partkey // 3) || '.' || p_partkey, 'n' || ((p_partkey + 7) // 3), 'zz' || p_partkey] AS dependencies, p_partkey AS ord FROM part)"""


def premise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as rows with premises: the distinct brands of their items."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    brands = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("p_brand")).alias("premises"))
    d = o.join(brands, "o_orderkey", "left")
    return d.select(F.col("o_orderstatus").alias("file"), F.col("o_orderpriority").alias("module"), F.col("o_orderkey").cast("string").alias("name"), F.coalesce("premises", F.array().cast("array<string>")).alias("premises"), F.col("o_orderkey").alias("ord"))


PREMISES = """brands AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS premises FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
prem AS (SELECT o_orderstatus AS file, o_orderpriority AS module, o_orderkey::VARCHAR AS name, coalesce(premises, []::VARCHAR[]) AS premises, o_orderkey AS ord
  FROM orders LEFT JOIN brands ON o_orderkey = l_orderkey)"""


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node), edges (src, token)): parts, and the numbers of the orders that hold them."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("token")).distinct()
    return e.select(F.col("src").alias("node")).distinct(), e


GRAPH = "e AS (SELECT DISTINCT l_partkey AS src, l_orderkey AS token FROM lineitem), nodes AS (SELECT DISTINCT src AS node FROM e)"


def turn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each turn of a conversation leads to the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    name = lambda k: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + k).cast("string"))
    return c.join(n, ["conv_id", "turn"]).select(name(0).alias("src"), name(1).alias("dst"))


TURNS = "c AS (SELECT DISTINCT conv_id, turn FROM conversations), turns AS (SELECT a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a timing ledger."""
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_type").alias("phase"), F.col("user_id").alias("fixture"), F.col("value").alias("client_ms"), F.get_json_object("props", "$.k").cast("long").alias("server_ms"),
                    (F.col("event_type") == "error").alias("cached"), (F.col("event_id") % 3).alias("pass"), F.col("event_id").alias("ord"))


LEDGER = "ledger AS (SELECT ts, event_type AS phase, user_id AS fixture, value AS client_ms, (props::JSON->>'$.k')::BIGINT AS server_ms, event_type = 'error' AS cached, event_id % 3 AS pass, event_id AS ord FROM events)"


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as rows with a type, a tree of p_size % 5 binders and a body."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    n = (F.col("p_size") % 5).cast("int")
    binder = F.when(k % 2 == 0, '{"hiding":"implicit"}').otherwise(F.concat(F.lit('{"hiding":"explicit","nameHint":"b'), k.cast("string"), F.lit('"}')))
    before = F.concat(F.lit('{"tag":"Pi","binder":'), binder, F.lit(',"cod":{"tag":"Type","term":'))
    term = F.concat(F.repeat(before, n), F.lit('{"tag":"Sort"}'), F.repeat(F.lit("}}"), n))
    sort = F.when(k % 11 == 0, "Prop").otherwise("Set")
    ast = F.when(k % 13 != 0, F.concat(F.lit('{"tag":"Type","sort":{"tag":"'), sort, F.lit('"},"term":'), term, F.lit("}")))
    body = F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("M._.f"), k.cast("string"))).when(k % 7 == 2, "two words").otherwise(F.concat(F.lit("@"), (k % 4).cast("string")))
    return p.select(F.concat(F.lit("P."), k.cast("string")).alias("qname"), F.concat(F.lit("{A : "), "p_type", F.lit("} → "), "p_name", F.lit(" -> "), "p_brand").alias("type"), ast.alias("ast"), body.alias("body"), n.alias("n"), k.alias("ord"), "p_brand", "p_type", "p_name")


TYPED = """typed AS (SELECT 'P.' || p_partkey AS qname, '{A : ' || p_type || '} → ' || p_name || ' -> ' || p_brand AS type, p_partkey % 13 <> 0 AS has_ast,
  CASE WHEN p_partkey % 11 = 0 THEN 'Prop' ELSE 'Set' END AS sort, p_partkey % 2 = 0 AS implicit, 'b' || p_partkey AS hint, p_size % 5 AS n,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'M._.f' || p_partkey WHEN 2 THEN 'two words' ELSE '@' || (p_partkey % 4) END AS body,
  p_partkey AS ord, p_brand, p_type, p_name FROM part)"""


def type_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qname, ast) of part: type trees of 0 to 3 binders over terms of three forms, written unlike one another: names that are there, null, escaped or missing, white space, members in two orders."""
    p = spread(table(spark, sf_dir, "part"))
    k, n = F.col("p_partkey"), (F.col("p_size") % 4).cast("int")
    gap = F.when(k % 3 == 0, F.lit("\n    ")).when(k % 3 == 1, F.lit("")).otherwise(F.lit(" \t"))
    hint = F.when(k % 5 == 0, F.lit(',"nameHint":null')).when(k % 5 == 1, F.concat(F.lit(',"nameHint":"b'), k.cast("string"), F.lit('"'))).when(k % 5 == 2, F.lit(',"nameHint":"q\\\\\\"{,u"')).when(k % 5 == 3, F.lit(',"nameHint":"\\u00e9 :}"')).otherwise(F.lit(""))
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    kind = lambda *term: say('{"tag":"Type",', gap, '"sort":{"tag":"Set"},"term":', *term, gap, "}")
    known = lambda name, *elims: say('{"elims":[', *elims, '],"tag":"Def",', gap, '"qname":"', name, '"}')
    put = lambda *term: say('{"tag":"Apply",', gap, '"hiding":"explicit","term":', *term, "}")
    var = lambda i: say('{"tag":"Var","ix":', i, ',"elims":[]}')
    form = k % 4
    term = F.when(form == 0, known(F.col("p_brand"), put(var("0")))).when(form == 1, var(n.cast("string"))).otherwise(known("Pair", put(known(F.col("p_brand"))), ",", put(var("1"))))
    binder = say('{"hiding":"', F.when(k % 2 == 0, "implicit").otherwise("explicit"), '"', hint, gap, "}")
    before = say('{"tag":"Pi","binder":', binder, ',"dom":', kind(known(F.col("p_brand"))), ',"cod":{"tag":"Type","sort":{"tag":"Set"},"term":')
    after = F.when(k % 7 == 0, say("}", gap, "}")).otherwise(F.lit("}}"))
    return p.select(F.concat(F.lit("P."), k.cast("string")).alias("qname"), kind(F.repeat(before, n), term, F.repeat(after, n)).alias("ast"))


#: The same trees without names and white space, members in one order.
TREES = """known AS (SELECT *, '{"tag":"Def","qname":"' || p_brand || '","elims":[]}' AS d FROM part),
terms AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '{"tag":"Def","qname":"' || p_brand || '","elims":[{"tag":"Apply","hiding":"explicit","term":{"tag":"Var","ix":0,"elims":[]}}]}'
  WHEN 1 THEN '{"tag":"Var","ix":' || (p_size % 4) || ',"elims":[]}'
  ELSE '{"tag":"Def","qname":"Pair","elims":[{"tag":"Apply","hiding":"explicit","term":' || d || '},{"tag":"Apply","hiding":"explicit","term":{"tag":"Var","ix":1,"elims":[]}}]}' END AS term FROM known),
trees AS (SELECT 'P.' || p_partkey AS qname, '{"tag":"Type","sort":{"tag":"Set"},"term":' || repeat('{"tag":"Pi","binder":{"hiding":"' || CASE WHEN p_partkey % 2 = 0 THEN 'implicit' ELSE 'explicit' END
  || '"},"dom":{"tag":"Type","sort":{"tag":"Set"},"term":' || d || '},"cod":{"tag":"Type","sort":{"tag":"Set"},"term":', p_size % 4) || term || repeat('}}', p_size % 4) || '}' AS tree FROM terms)"""
