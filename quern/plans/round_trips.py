"""Registered queries of sources and sinks: tables written to the shared folder, split, broken or packed, and read back; and parsers over texts that the SQL parses on its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import jsonwalk
from quern.functions import telescope as S
from quern.functions import text as X
from quern.operators import blocks as B
from quern.operators import curate, validate, views, wire
from quern.plans import adapters
from quern.plans.adapters import TURNS
from quern.plans.catalogue import query
from quern.sources import readers, writers
from quern.sources.shared import new_path

PART = T.StructType().add("p_partkey", "long").add("p_name", "string").add("p_size", "long")


def _part(spark, sf):
    return adapters.table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"))


def _n(c="p_partkey"):
    return F.col(c).cast("string")


def _lines(spark, sf, name="lines"):
    """part as JSON lines in order of its key, in several files; every seventh line is broken."""
    p, folder = _part(spark, sf), new_path(spark, name)
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit('{"p_partkey":'), _n())).otherwise(writers.json_line(p))
    p.select("p_partkey", line.alias("value")).repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(folder)
    return folder


# ---- sources


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def json_lines_strict(spark, sf):
    """Rows written as JSON lines and read with every line checked."""
    folder = new_path(spark, "strict")
    writers.write_jsonl(_part(spark, sf), folder)
    return readers.corpus_rows(spark, PART, folder)


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_partkey % 7 <> 0")
def json_lines_without_broken(spark, sf):
    return readers.jsonl(spark, _lines(spark, sf), PART, "DROPMALFORMED")


@query("""SELECT p_partkey % 7 <> 0 AS good, count(*) AS n, sum(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey ELSE length('{"p_partkey":' || p_partkey) END)::BIGINT AS total FROM part GROUP BY 1""")
def json_lines_good_and_bad(spark, sf):
    """How many lines are rows and how many aren't, with the sum of the keys of the one and the lengths of the other."""
    good, bad = readers.jsonl_partitioned(spark, _lines(spark, sf), PART)
    sums = lambda d, v, is_good: d.agg(F.count("*").alias("n"), F.sum(v).cast("long").alias("total")).select(F.lit(is_good).alias("good"), "n", "total")
    return sums(good, F.col("p_partkey"), True).unionAll(sums(bad, F.length("raw"), False))


@query("""WITH t AS (SELECT 'k' || (p_partkey % 13) AS k, p_partkey AS a, p_partkey % 11 = 0 AS bad, row_number() OVER (ORDER BY p_partkey) AS line FROM part)
SELECT k, max(a) FILTER (NOT bad) AS a, (SELECT count(*) FROM t WHERE bad) AS bad_lines, (SELECT string_agg(line, ',' ORDER BY line) FROM (SELECT line FROM t WHERE bad ORDER BY line LIMIT 3)) AS first_bad FROM t GROUP BY k""")
def corpus_index_of_file(spark, sf):
    """The last row of each key in a file that many tasks read, its bad lines counted, and the numbers of the first."""
    p, folder = _part(spark, sf), new_path(spark, "corpus")
    line = F.when(F.col("p_partkey") % 11 == 0, "no row").otherwise(F.to_json(F.struct(F.concat(F.lit("k"), (F.col("p_partkey") % 13).cast("string")).alias("k"), F.col("p_partkey").alias("a"))))
    p.select("p_partkey", line.alias("value")).coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(folder)
    rows, report = readers.corpus_index(spark, T.StructType().add("k", "string").add("a", "long"), "k", folder)
    numbers = F.array_join(F.transform("samples", lambda s: F.substring_index(s, ":", -1)), ",")
    return rows.crossJoin(report.select("bad_lines", numbers.alias("first_bad")))  # one row


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS line_no FROM part")
def numbered_lines(spark, sf):
    """Each line's number in a file that many tasks read."""
    folder = new_path(spark, "numbered")
    _part(spark, sf).coalesce(1).sortWithinPartitions("p_partkey").select(_n().alias("value")).write.text(folder)
    return readers.numbered_lines(spark, folder).select(F.col("raw").cast("long").alias("p_partkey"), "line_no")


@query("""SELECT 'lines' AS kind, p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 'document', p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0""")
def json_of_any_kind(spark, sf):
    """JSON lines, and documents that are one array each, told apart by their first bytes."""
    p = _part(spark, sf)
    lines, documents = new_path(spark, "lines"), new_path(spark, "documents")
    writers.write_jsonl(p.where(F.col("p_partkey") % 3 > 0), lines)
    array = F.concat(F.lit("[\n"), F.array_join(F.collect_list(writers.json_line(p)), ",\n"), F.lit("\n]"))
    p.where(F.col("p_partkey") % 3 == 0).groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(array.alias("value")).repartition("g").select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(documents)
    read = lambda path, kind: readers.any_json(spark, path, PART).select(F.lit(kind).alias("kind"), "*")
    return read(lines, "lines").unionAll(read(documents, "document"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def csv_with_header(spark, sf):
    folder = new_path(spark, "csv")
    _part(spark, sf).write.option("header", True).csv(folder)
    return readers.csv(spark, folder)


@query("SELECT DISTINCT n_name AS module FROM nation")
def module_names_of_file(spark, sf):
    """Modules of a list file with blank lines, notes, repeats and white space."""
    folder = new_path(spark, "modules")
    name = F.col("n_name")
    lines = F.array(F.concat(F.lit("  "), name), F.lit(""), F.concat(F.lit("# "), name), F.concat(name, F.lit(" ")))
    adapters.table(spark, sf, "nation").select(F.explode(lines).alias("value")).write.text(folder)
    return readers.module_list(spark, folder)


@query("SELECT p_partkey % 5 = 0 AS test, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def split_written_and_read(spark, sf):
    """Train and test rows as a pair of Parquet tables."""
    p, folder = _part(spark, sf), new_path(spark, "split")
    writers.write_split(p.where(F.col("p_partkey") % 5 > 0), p.where(F.col("p_partkey") % 5 == 0), folder)
    read = lambda name: readers.parquet(spark, f"{folder}/{name}").agg(F.count("*").alias("n"), F.sum("p_size").alias("total")).select(F.lit(name == "test").alias("test"), "n", "total")
    return read("train").unionAll(read("test"))


# ---- sinks


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ',"p_name":"' || p_name || '"' ELSE '' END || ',"p_size":' || p_size || '}' AS line FROM part""")
def json_lines_without_nulls(spark, sf):
    """Lines in which what a row lacks is left out, keys in the order of columns."""
    p, folder = _part(spark, sf), new_path(spark, "sparse")
    writers.write_jsonl(p.withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))), folder, keep_nulls=False)
    return readers.raw_lines(spark, folder).select(F.get_json_object("raw", "$.p_partkey").cast("long").alias("p_partkey"), F.col("raw").alias("line"))


@query("""SELECT row_number() OVER (ORDER BY p_size, line) AS place, line FROM (SELECT p_size, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}' AS line FROM part)""")
def gzip_members_in_order(spark, sf):
    """Lines as a gzip file joined from members of 100 lines, unpacked and numbered as they lie."""
    folder, whole = new_path(spark, "members"), new_path(spark, "whole") + ".gz"
    writers.write_gzip(_part(spark, sf), folder, "p_size", rows=100)
    writers.join_gzip(spark, folder, whole)
    return readers.numbered_lines(spark, whole).select(F.col("line_no").alias("place"), F.col("raw").alias("line"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' || chr(10) AS line FROM lineitem),
s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row, sha256(line) AS sha, octet_length(encode(line)) AS bytes FROM l),
b AS (SELECT row // 4096 AS row, sha256(string_agg(sha, '' ORDER BY row)) AS sha FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS rows, (SELECT sum(bytes) FROM s)::BIGINT AS bytes, CASE WHEN count(*) > 1 THEN sha256(string_agg(sha, '' ORDER BY row)) ELSE any_value(sha) END AS sha256 FROM b""")
def digest_of_lines(spark, sf):
    """Rows, bytes and the tree digest of ordered JSON lines."""
    d = adapters.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    found = writers.digest(d, "l_orderkey", "l_linenumber")
    return spark.createDataFrame([(found["rows"], found["bytes"], found["sha256"])], "rows long, bytes long, sha256 string")


@query("SELECT p_partkey % 4 AS v, count(*) AS n FROM part WHERE p_partkey % 4 = 3 GROUP BY 1")
def current_version(spark, sf):
    """What readers see of a table after four versions."""
    folder = new_path(spark, "versions")
    for k in range(4):
        writers.write_atomic(_part(spark, sf).where(F.col("p_partkey") % 4 == k), folder)
    return writers.read_atomic(spark, folder).groupBy((F.col("p_partkey") % 4).alias("v")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT 'M' || (p_partkey % 4) AS module, p_partkey AS line_no, p_name AS raw FROM part), o AS (SELECT row_number() OVER (ORDER BY module, line_no) AS place, raw FROM l WHERE module IN ('M1', 'M3')) SELECT * FROM o""")
def modules_concatenated(spark, sf):
    """Lines of chosen modules, by module and line, as they lie in the written files one after the other."""
    p, folder = _part(spark, sf), new_path(spark, "concatenated")
    lines = p.select(F.concat(F.lit("M"), (F.col("p_partkey") % 4).cast("string")).alias("module"), F.col("p_partkey").alias("line_no"), F.concat("p_name", F.lit("\n")).alias("raw"))
    writers.concatenate(lines, ["M3", "M1"], folder)
    from quern.operators.ordinals import numbered

    got = readers.numbered_lines(spark, folder)
    return numbered(got, "path", "line_no").select((F.col("row") + 1).alias("place"), "raw")


@query("""SELECT '| region | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) AS markdown,
  'Regions' || chr(10) || '=======' || chr(10) || chr(10) || 'Nations' || chr(10) || '  ' || rpad('region', max(length(r_name))::INT, ' ') || '  n' || chr(10) || string_agg('  ' || rpad(r_name, w::INT, ' ') || '  ' || n, chr(10) ORDER BY r_name) || chr(10) AS text
FROM (SELECT *, max(length(r_name)) OVER () AS w FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name))""")
def reports_as_text(spark, sf):
    """A small table as Markdown and as an aligned text report."""
    n, r = adapters.table(spark, sf, "nation"), adapters.table(spark, sf, "region")
    d = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n")).orderBy("region")
    return spark.createDataFrame([(writers.markdown(d), writers.text_report("Regions", ("Nations", d)))], "markdown string, text string")


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"results":[{"name":"' || p_name || '","ok":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '}]}' AS report FROM part""")
def reports_without_times(spark, sf):
    """Reports without what differs between runs, fields by name at every depth."""
    p = adapters.table(spark, sf, "part")
    result = F.struct((F.col("p_size") > 25).alias("ok"), F.rand().alias("elapsedMs"), F.col("p_name").alias("name"))
    d = p.select(F.array(result).alias("results"), F.current_timestamp().alias("timestamp"), F.col("p_partkey").alias("id"))
    normal = writers.normal_report(d)
    return normal.select(F.col("id").alias("p_partkey"), writers.json_line(normal).alias("report"))


@query("SELECT 'parts' AS name, count(*) AS n FROM part UNION ALL SELECT 'nations', count(*) FROM nation")
def model_tables(spark, sf):
    """A model's tables written under one folder and read by name."""
    folder = new_path(spark, "model")
    writers.write_model(folder, parts=adapters.table(spark, sf, "part"), nations=adapters.table(spark, sf, "nation"))
    got = writers.read_model(spark, folder, "parts", "nations")
    size = lambda name: got[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return size("parts").unionAll(size("nations"))


# ---- rows


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'mod' || (p_partkey % 5) END AS pretty_module, 'm' || (p_partkey % 5) AS module, nullif(p_brand, 'Brand#11') AS def_kind, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS ast_size, p_type AS type, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS body FROM part)
SELECT p_partkey AS pretty_qname, coalesce(pretty_module, module) AS module, coalesce(def_kind, 'unknown') AS def_kind, coalesce(ast_size, length(type))::BIGINT AS ast_size, length(body) > 0 AS has_body FROM t""")
def row_summaries(spark, sf):
    """Rows with what they lack filled in from other columns."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")
    d = p.select(k.alias("pretty_qname"), F.when(k % 3 > 0, F.concat(F.lit("mod"), (k % 5).cast("string"))).otherwise("").alias("pretty_module"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("module"), F.nullif("p_brand", F.lit("Brand#11")).alias("def_kind"),
                 F.when(k % 2 == 0, F.col("p_size")).cast("int").alias("ast_size"), F.col("p_type").alias("type"), F.when(k % 4 > 0, F.col("p_name")).otherwise("").alias("body"), F.lit(None).cast("boolean").alias("has_body"))
    return views.row_summary(d)


@query("SELECT p_name AS name, p_type AS type, p_brand AS kind, p_size::BIGINT AS body FROM part")
def minimal_rows(spark, sf):
    """Rows cut to the whitelist, in its order, whatever the order and number of their columns."""
    p = adapters.table(spark, sf, "part")
    d = p.select(F.lit(1).alias("extra"), F.col("p_size").cast("long").alias("body"), F.col("p_brand").alias("kind"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.lit(2).alias("other"))
    ordered = views.minimal(d)
    return views.contract_order(ordered.select(*sorted(ordered.columns)))


@query("""WITH t AS (SELECT p_partkey, 'm' || (p_partkey % 4) AS module, CASE p_partkey % 4 WHEN 0 THEN 'lem x' ELSE 'f' || p_partkey END AS name, p_name AS a, p_brand AS b FROM part)
SELECT p_partkey, name, module, array_to_string(list_sort(list_distinct(list_filter([a, b || '.x', name, module || '.' || name], lambda x: x <> name AND x <> module || '.' || name AND x <> 'src.' || name))), '|') AS premises FROM t""")
def normal_rows(spark, sf):
    """Whole rows normalised: white space, empty modules, premises without the row's own names."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")
    module = F.concat(F.lit(" m"), (k % 4).cast("string"), F.lit("\n"))
    name = F.when(k % 4 == 0, " lem  x ").otherwise(F.concat(F.lit("f"), _n()))
    own = F.when(k % 4 == 0, "lem x").otherwise(F.concat(F.lit("f"), _n()))
    premises = F.array(F.concat(F.lit(" <"), "p_name", F.lit("> ")), F.concat("p_brand", F.lit(".agda.x.")), own, F.concat(F.lit("m"), (k % 4).cast("string"), F.lit("."), own), F.concat(F.lit("src."), own), F.lit(" "), F.concat("p_name", F.lit("..")))
    row = X.normal_row(F.lit("lib/src.agda"), module, name, F.col("p_type"), F.lit(None).cast("string"), premises)
    return p.select("p_partkey", row.alias("r")).select("p_partkey", "r.name", "r.module", F.array_join("r.premises", "|").alias("premises"))


@query("SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS place, p_name AS module, p_partkey FROM part")
def manifest_order(spark, sf):
    """A manifest's results by module, numbered without a task that sees them all."""
    p = adapters.table(spark, sf, "part").select(F.lpad(_n(), 12, " ").alias("a"), F.col("p_name").alias("module"), "p_partkey")
    return validate.in_manifest_order(p).select("place", "module", "p_partkey")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/a.agda' WHEN 1 THEN 'src/b.lagda.md' WHEN 2 THEN 'docs/c.agda' WHEN 3 THEN 'src/x.lagda/readme' ELSE 'src/d' || p_partkey || '.agda' END AS path FROM part)
SELECT p_partkey, path FROM t WHERE path LIKE 'src/%' AND (path LIKE '%.agda' OR regexp_extract(path, '[^/]*$') LIKE '%.lagda%')""")
def source_paths(spark, sf):
    """Paths under a folder that name source files."""
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, "src/a.agda").when(k % 5 == 1, "src/b.lagda.md").when(k % 5 == 2, "docs/c.agda").when(k % 5 == 3, "src/x.lagda/readme").otherwise(F.concat(F.lit("src/d"), _n(), F.lit(".agda")))
    return readers.sources_among(adapters.table(spark, sf, "part").select("p_partkey", path.alias("path")), "src")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand END AS shown, CASE WHEN p_partkey % 4 > 0 THEN p_name || '|' || p_brand || '|x' ELSE '' END AS names FROM part""")
def picked_from_json(spark, sf):
    """The rendered form of a JSON node, and the names under several of its keys."""
    k = F.col("p_partkey")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    lists = say('"a":["', F.col("p_name"), '","', F.col("p_brand"), '"],"b":["', F.col("p_brand"), '","x"]}')
    node = F.when(k % 4 == 0, say('"', F.col("p_name"), '"')).when(k % 4 == 1, say('{"pp":"', F.col("p_type"), '","shown":"z",', lists)).when(k % 4 == 2, say('{"rendered":"', F.col("p_brand"), '",', lists)).otherwise(say('{"q":1,', lists))
    return adapters.table(spark, sf, "part").select("p_partkey", jsonwalk.rendered(node).alias("shown"), F.array_join(jsonwalk.names_under(node, "a", "b"), "|").alias("names"))


@query("SELECT DISTINCT conv_id || ':' || turn AS raw FROM conversations")
def shards_together(spark, sf):
    """Lines of several folders read as one."""
    c = adapters.table(spark, sf, "conversations").select("conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("value")).distinct()
    paths = [new_path(spark, f"shard{k}") for k in range(3)]
    for k, path in enumerate(paths):
        c.where(F.col("conv_id") % 3 == k).select("value").write.text(path)
    return readers.raw_lines(spark, *paths)


@query(f"WITH {TURNS} SELECT p_partkey, 'a' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '??? note \"' || p_name || '\"' || chr(10) || '    ' || p_brand || chr(10) ELSE '' END || 'b' || chr(10) AS page FROM part")
def noted_pages(spark, sf):
    """Pages whose marked lines are notes."""
    p = adapters.table(spark, sf, "part")
    marked = F.concat(F.lit("@@NOTE_START\\| "), "p_name", F.lit(" @@\n"), "p_brand", F.lit("\n  @@NOTE_END@@\n"))
    page = F.concat(F.lit("a\n"), F.when(F.col("p_partkey") % 2 == 0, marked).otherwise(""), F.lit("b\n"))
    return p.select("p_partkey", X.noted(page, "@@NOTE_START", "@@NOTE_END@@", "Note").alias("page"))


# ---- texts that the SQL parses


TELESCOPES = """telescopes AS (SELECT p_partkey, repeat('{' || lower(p_name) || ' : ' || p_type || '}', p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN ' (x y : F (' || p_brand || '))' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '{no colon}' ELSE '' END
  || repeat(' (z' || p_size || ' : ∀ {a} → (b))', p_size % 3) || CASE p_partkey % 4 WHEN 0 THEN ' → C' WHEN 1 THEN '' WHEN 2 THEN 'x (y : z)' ELSE '  (open {' END AS type FROM part)"""


@query(f"""WITH {TELESCOPES}, ch AS (SELECT p_partkey, type, unnest(range(1, length(type) + 1)) AS i FROM telescopes), c AS (SELECT *, substr(type, i, 1) AS c FROM ch),
d AS (SELECT *, sum(CASE WHEN c IN ('(', '{{') THEN 1 WHEN c IN (')', '}}') THEN -1 ELSE 0 END) OVER w AS depth FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
e AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS was FROM d),
o AS (SELECT p_partkey, i AS opens, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM e WHERE depth = 1 AND was = 0), z AS (SELECT p_partkey, i AS closes, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM e WHERE depth = 0 AND was = 1),
f AS (SELECT p_partkey, min(i) AS stop FROM (SELECT p_partkey, i FROM e WHERE depth = 0 AND was = 0 AND c <> ' ' UNION ALL SELECT p_partkey, opens FROM o LEFT JOIN z USING (p_partkey, k) WHERE closes IS NULL UNION ALL SELECT p_partkey, length(type) + 1 FROM telescopes) GROUP BY p_partkey),
b AS (SELECT t.p_partkey, opens, substr(type, opens, 1) AS bracket, substr(type, opens + 1, closes - opens - 1) AS held FROM o JOIN z USING (p_partkey, k) JOIN f USING (p_partkey) JOIN telescopes t USING (p_partkey) WHERE closes < stop),
n AS (SELECT p_partkey, opens, unnest(list_filter(string_split(split_part(held, ':', 1), ' '), lambda x: x <> '')) || ':' || trim(substr(held, strpos(held, ':') + 1)) || ':' || CASE bracket WHEN '{{' THEN 'implicit' ELSE 'explicit' END AS binder FROM b WHERE contains(held, ':')),
m AS (SELECT p_partkey, string_agg(binder, ',' ORDER BY opens, rn) AS binders, count(*) AS n FROM (SELECT *, row_number() OVER () AS rn FROM n) GROUP BY p_partkey)
SELECT p_partkey, coalesce(n, 0) AS n, coalesce(binders, '') AS binders, substr(type, stop) AS rest FROM telescopes JOIN f USING (p_partkey) LEFT JOIN m USING (p_partkey)""")
def telescopes_parsed(spark, sf):
    """Leading binders and the rest of types, brackets in brackets among them; the SQL counts depths of its own."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    kind = say(F.repeat(say("{", F.lower("p_name"), " : ", F.col("p_type"), "}"), (k % 3).cast("int")), F.when(k % 2 == 0, say(" (x y : F (", F.col("p_brand"), "))")).otherwise(""), F.when(k % 5 == 0, "{no colon}").otherwise(""),
               F.repeat(say(" (z", F.col("p_size").cast("string"), " : ∀ {a} → (b))"), (F.col("p_size") % 3).cast("int")), F.when(k % 4 == 0, " → C").when(k % 4 == 1, "").when(k % 4 == 2, "x (y : z)").otherwise("  (open {"))
    d = p.select("p_partkey", S.telescope(kind).alias("t"))
    said = F.array_join(F.transform("t.binders", lambda b: F.concat_ws(":", b["name"], b["type"], b["hiding"])), ",")
    return d.select("p_partkey", F.size("t.binders").cast("long").alias("n"), said.alias("binders"), F.col("t.rest").alias("rest"))


HEADS = """heads AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-- ' || p_name || chr(10) ELSE '' END || repeat(' ', p_partkey % 3) || 'module ' || replace(p_brand, '#', CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '''' WHEN 2 THEN '-' ELSE ' (x) ' END) || CASE WHEN p_size % 2 = 0 THEN ' where' ELSE '  where  ' END
  || CASE p_partkey % 5 WHEN 0 THEN ' open' ELSE chr(10) || 'x = module Y where' END AS text FROM part)"""


@query(f"""WITH {HEADS}, l AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM heads),
w AS (SELECT p_partkey, i, list_filter(string_split(trim(line), ' '), lambda x: x <> '') AS w FROM l), h AS (SELECT p_partkey, i, w[2] AS name, len(w) = 3 AS alone FROM w WHERE w[1] = 'module' AND w[3] = 'where'),
k AS (SELECT p_partkey, arg_min(name, i) FILTER (alone AND regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_.]*')) AS strict, arg_min(name, i) FILTER (regexp_full_match(name, '[A-Za-z0-9_''.]+')) AS primed, arg_min(name, i) FILTER (regexp_full_match(name, '[A-Za-z0-9_.-]+')) AS hyphened FROM h GROUP BY p_partkey)
SELECT p_partkey, strict, primed, hyphened FROM heads LEFT JOIN k USING (p_partkey)""")
def module_headers_parsed(spark, sf):
    """The module that each of varied sources names, by the three readers; the SQL splits lines into words."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")
    part = F.when(k % 4 == 0, ".").when(k % 4 == 1, "'").when(k % 4 == 2, "-").otherwise(" (x) ")
    text = F.concat(F.when(k % 3 == 0, F.concat(F.lit("-- "), "p_name", F.lit("\n"))).otherwise(""), F.repeat(F.lit(" "), (k % 3).cast("int")), F.lit("module "), F.replace("p_brand", F.lit("#"), part), F.when(F.col("p_size") % 2 == 0, " where").otherwise("  where  "), F.when(k % 5 == 0, " open").otherwise("\nx = module Y where"))
    d = p.select("p_partkey", text.alias("t"))
    return d.select("p_partkey", *[X.module_header(F.col("t"), c).alias(c) for c in X.MODULE_HEADERS])


CODES = ("FileNotFound", "NotInScope", "UnequalTerms", "UnsolvedConstraints", "ModuleDoesntExport", "UselessPublic")
LOGS = f"""logs AS (SELECT p_partkey, j, {list(CODES)}[(p_partkey + j * 5) % 6 + 1] AS code, CASE WHEN (p_partkey + j) % 4 = 0 THEN 'warning' ELSE 'error' END AS severity, p_size + j AS line, j * 3 + 1 AS col, p_name || ' ' || j AS said FROM (SELECT *, unnest(range(0, p_partkey % 5 + 1)) AS j FROM part)),
said AS (SELECT p_partkey, string_agg(CASE WHEN j % 2 = 1 THEN 'Checking M' || j || ' (/x).' || chr(10) ELSE '' END || '/lib/M' || j || '.agda:' || line || CASE WHEN j % 2 = 0 THEN '.' ELSE ',' END || col || '-' || (col + 4) || ': ' || severity || ': [' || code || ']' || chr(10) || '  ' || said || chr(10), '' ORDER BY j) AS text FROM logs GROUP BY p_partkey)"""


@query(f"""WITH {LOGS}, l AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM said),
h AS (SELECT p_partkey, i, regexp_extract(line, '^(.*):([0-9]+)[.,]([0-9]+)-([0-9]+): (error|warning): \\[(.*)\\]$', ['file', 'line', 'col', 'until', 'severity', 'code']) AS h, lead(line) OVER (PARTITION BY p_partkey ORDER BY i) AS said FROM l),
d AS (SELECT p_partkey, i, h.severity AS severity, h.code AS code, h.file AS file, h.line::INT AS line, h.col::INT AS col, h.until::INT AS end_col, said AS message FROM h WHERE h.file <> ''),
r AS (SELECT *, CASE WHEN severity = 'warning' THEN CASE code WHEN 'ModuleDoesntExport' THEN 1 ELSE 5 END ELSE CASE code WHEN 'FileNotFound' THEN 0 WHEN 'NotInScope' THEN 2 WHEN 'UnsolvedConstraints' THEN 4 ELSE 3 END END AS rank FROM d)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, i) AS place, rank, severity, code, file, line, col, end_col, message FROM r""")
def diagnostics_parsed(spark, sf):
    """Checkers' outputs of one to five diagnostics, ranked; the SQL reads their lines by its own patterns."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")

    def one(j):
        code = F.get(F.array(*[F.lit(c) for c in CODES]), ((k + j * 5) % 6).cast("int"))
        severity = F.when((k + j) % 4 == 0, "warning").otherwise("error")
        text = lambda x: x.cast("string")
        return F.concat(F.when(j % 2 == 1, F.concat(F.lit("Checking M"), text(j), F.lit(" (/x).\n"))).otherwise(""), F.lit("/lib/M"), text(j), F.lit(".agda:"), text(F.col("p_size") + j), F.when(j % 2 == 0, ".").otherwise(","), text(j * 3 + 1), F.lit("-"), text(j * 3 + 5),
                        F.lit(": "), severity, F.lit(": ["), code, F.lit("]\n  "), F.col("p_name"), F.lit(" "), text(j), F.lit("\n"))

    out = p.select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), one), "").alias("text"))
    return B.diagnostics(out, "p_partkey", "text").drop("end_line")


REPLIES = """bodies AS (SELECT p_partkey, json_object('success', p_size % 2 = 0, 'holes', list_transform(range(0, p_partkey % 4), lambda j: json_object('index', j, 'line', p_size + j, 'col', j * 2, 'goal', p_name)), 'holesCount', p_partkey % 4 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, 'elapsedMs', p_partkey)::VARCHAR AS body FROM part),
replies AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'noise ' || p_partkey WHEN 1 THEN json_object('id', 8, 'result', json_object('x', 1))::VARCHAR WHEN 2 THEN json_object('id', 7, 'error', json_object('message', 'no ' || p_partkey))::VARCHAR ELSE json_object('jsonrpc', '2.0', 'id', 7, 'result', json_object('content', [json_object('type', 'text', 'text', body)]))::VARCHAR END AS raw FROM bodies JOIN part USING (p_partkey))"""


@query(f"""WITH {REPLIES}, j AS (SELECT p_partkey, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM replies), t AS (SELECT p_partkey, j, j->>'$.result.content[0].text' AS text FROM j),
b AS (SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS b FROM t)
SELECT p_partkey, CASE WHEN j IS NULL OR (j->>'$.id') <> '7' THEN 'not_ours' WHEN text IS NULL THEN 'protocol_error' ELSE 'reply' END AS kind, j->>'$.error.message' AS message,
  CASE WHEN json_array_length(b, '$.holes') <> (b->>'$.holesCount')::INT THEN 'holesCount isn''t the number of holes' END AS error,
  CASE WHEN json_array_length(b, '$.holes') = (b->>'$.holesCount')::INT THEN (b->>'$.elapsedMs')::BIGINT END AS elapsed_ms,
  CASE WHEN json_array_length(b, '$.holes') = (b->>'$.holesCount')::INT AND json_array_length(b, '$.holes') > 0 THEN array_to_string(b->>'$.holes[*].line', ',') END AS lines FROM b""")
def replies_parsed(spark, sf):
    """A server's replies and the bodies in them, of varied numbers of holes; the SQL reads the JSON of its own."""
    p, k = adapters.table(spark, sf, "part"), F.col("p_partkey")
    hole = lambda j: F.struct(j.alias("index"), (F.col("p_size") + j).alias("line"), (j * 2).alias("col"), F.col("p_name").alias("goal"))
    holes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda j: j < k % 4), hole)
    body = F.to_json(F.struct((F.col("p_size") % 2 == 0).alias("success"), holes.alias("holes"), (k % 4 + F.when(k % 5 == 0, 1).otherwise(0)).alias("holesCount"), k.alias("elapsedMs")))
    whole = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(7).alias("id"), F.struct(F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))).alias("content")).alias("result")))
    raw = F.when(k % 7 == 0, F.concat(F.lit("noise "), _n())).when(k % 7 == 1, '{"id":8,"result":{"x":1}}').when(k % 7 == 2, F.concat(F.lit('{"id":7,"error":{"message":"no '), _n(), F.lit('"}}'))).otherwise(whole)
    d = wire.envelope(p.select("p_partkey", raw.alias("raw")), F.lit(7)).withColumn("c", wire.check_body(F.col("text")))
    ours = F.when(F.col("kind") == "reply", F.col("c.error"))
    message = F.when(F.col("kind") == "protocol_error", F.col("message"))
    lines = F.nullif(F.array_join(F.transform("c.body.holes", lambda h: h["line"].cast("string")), ","), F.lit(""))
    return d.select("p_partkey", "kind", message.alias("message"), ours.alias("error"), F.col("c.body.elapsed_ms").alias("elapsed_ms"), lines.alias("lines"))


@query("SELECT p_partkey, p_name, p_type FROM part")
def checked_schema(spark, sf):
    """Rows that pass the contract of columns and types."""
    wanted = T.StructType().add("p_name", "string").add("p_type", "string")
    return validate.assert_schema(adapters.table(spark, sf, "part"), wanted).select("p_partkey", "p_name", "p_type")


@query("SELECT 'M' || (id % 7) || '.agda' AS file, 'lem' || id AS name, 'T' || (id % 5) || ' → T' || (id % 3) AS type, least(id % 5 + 1, 4)::BIGINT AS n_premises FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS id)")
def synthetic_rows(spark, sf):
    """As many made-up rows as part has."""
    d = readers.synthetic(spark, adapters.table(spark, sf, "part").count())
    return d.select("file", "name", "type", F.size("premises").cast("long").alias("n_premises"))


@query("SELECT count(*) AS n, true AS parts_are_whole, true AS again_the_same FROM part")
def seeded_split(spark, sf):
    """A seeded split of one written table: nothing is lost or doubled, and a second split is the same."""
    p = _part(spark, sf).coalesce(1).sortWithinPartitions("p_partkey")
    one, two = (curate.random_split(p) for _ in range(2))
    ids = lambda parts, name: parts[0].select(F.col("p_partkey").alias("k"), F.lit(0).alias(name)).unionAll(parts[1].select("p_partkey", F.lit(1)))
    both = ids(one, "a").join(ids(two, "b"), "k", "full")
    return both.agg(F.count("*").alias("n"), (F.countDistinct("k") == F.count("*")).alias("parts_are_whole"), F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("again_the_same"))
