"""More registered queries: source text, diagnostics, replies, obligations, graphs by kind, projections, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import jsonwalk
from quern.functions import source as C
from quern.functions import text as X
from quern.operators import blocks as B
from quern.operators import curate, evaluate, graph, types, validate, views, wire
from quern.plans import adapters as T
from quern.plans.adapters import CORPUS, DEFS, TREES, TURNS, TYPED
from quern.plans.catalogue import _sources, _sources_sql, query
from quern.sources import readers
from quern.sources.shared import new_path


def _n(c: str = "p_partkey"):
    return F.col(c).cast("string")


# ---- text


@query("""SELECT p_partkey, 'GOAL:' || chr(10) || p_type || chr(10) || 'CTX:' || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || 'x : ' || p_brand ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN chr(10) || 'y : ' || p_name ELSE '' END AS text FROM part""")
def query_texts(spark, sf):
    """What each goal is searched by; entries without a type go."""
    k = F.col("p_partkey") % 3
    entry = lambda name, kind: F.struct(F.lit(name).alias("name"), kind.alias("type"))
    ctx = F.array(entry("x", F.when(k > 0, F.col("p_brand"))), entry("y", F.when(k == 2, F.col("p_name"))))
    return T.table(spark, sf, "part").select("p_partkey", X.query_text(F.col("p_type"), ctx).alias("text"))


@query("""WITH g AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x Data.Bool.∧ ' || p_brand WHEN 1 THEN 'foo.bar  (A.b''.C ' || p_name || ')' WHEN 2 THEN 'not (M.not x)  ≡ nothing' ELSE p_type || ' . a.b.c' END AS goal FROM part),
s AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(goal, '\\s+', ' ', 'g')), '\\b(?:[A-Za-z_][\\w'']*\\.)+([^\\s])', '\\1', 'g') AS goal FROM g) SELECT p_partkey, regexp_replace(goal, '\\bnot\\b', '¬', 'g') AS goal FROM s""")
def plain_goals(spark, sf):
    """Goals without qualifiers, of words and of signs alike."""
    k = F.col("p_partkey") % 4
    goal = F.when(k == 0, F.concat(F.lit("x Data.Bool.∧ "), "p_brand")).when(k == 1, F.concat(F.lit("foo.bar  (A.b'.C "), "p_name", F.lit(")"))).when(k == 2, "not (M.not x)  ≡ nothing").otherwise(F.concat("p_type", F.lit(" . a.b.c")))
    return T.table(spark, sf, "part").select("p_partkey", X.plain_goal(goal).alias("goal"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE array_to_string(list_transform(range(p_partkey % 4), lambda i: (p_size + i) || ':' || (i * 2)), ' ') END AS places FROM part""")
def unsolved_places(spark, sf):
    """Places that a checker's output lists after the header of what is left open; an ordinary error's place isn't one."""
    k = F.col("p_partkey")
    n = (k % 4).cast("int")
    mark = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.concat(F.lit("/x/M.agda:"), (F.col("p_size") + i).cast("string"), F.when(i % 2 == 0, ",").otherwise("."), (i * 2).cast("string"), F.lit("-9"))), "\n")
    head = F.when(k % 3 == 0, "Unsolved metas at the following locations:\n").when(k % 3 == 1, "unsolved  interaction metas at\nthe following locations:\n").otherwise("nothing else\n")
    out = F.concat(F.lit("/x/M.agda:3,5-7: error\n"), head, mark)
    said = F.transform(X.unsolved_positions(out), lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["col"].cast("string")))
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(said, " ").alias("places"))


FNV64 = """lower(lpad(printf('%x', (list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, (length(hex(encode(k))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(k)), (2 * i - 1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) // 4294967296)::BIGINT), 8, '0')
  || lpad(printf('%x', (list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, (length(hex(encode(k))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(k)), (2 * i - 1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 4294967296)::BIGINT), 8, '0'))"""


@query(f"SELECT p_partkey, sha1(k) AS sha1, {FNV64} AS fnv64 FROM (SELECT p_partkey, p_name || '→' || p_partkey AS k FROM part)")
def content_fingerprints(spark, sf):
    p = T.table(spark, sf, "part").withColumn("k", F.concat("p_name", F.lit("→"), _n()))
    return p.select("p_partkey", curate.fingerprint(F.col("k")).alias("sha1"), X.fnv1a64(F.col("k")).alias("fnv64"))


MODULES = "CASE p_partkey % 8 WHEN 0 THEN 'A.B' WHEN 1 THEN 'agda-x.Y''' WHEN 2 THEN '1A.B' WHEN 3 THEN 'A..B' WHEN 4 THEN 'A b' WHEN 5 THEN '_x' WHEN 6 THEN p_brand WHEN 7 THEN 'A.' || p_partkey END"


@query(f"WITH m AS (SELECT p_partkey, {MODULES} AS m FROM part) SELECT p_partkey, regexp_full_match(m, '[A-Za-z_][A-Za-z0-9_''\\-]*(\\.[A-Za-z_][A-Za-z0-9_''\\-]*)*') AS valid, m = 'A' OR starts_with(m, 'A.') AS inside FROM m")
def module_names(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", F.expr(MODULES.replace("''", "\\'")).alias("m"))
    return p.select("p_partkey", X.module_name_ok(F.col("m")).alias("valid"), X.in_module(F.col("m"), "A").alias("inside"))


HEADERS = "CASE p_partkey % 5 WHEN 0 THEN 'x' || chr(10) || 'module A.B where' || chr(10) || 'y' WHEN 1 THEN 'module A''.b where open import C' WHEN 2 THEN '  module a-b where  ' WHEN 3 THEN 'module where' ELSE 'module M (x : A) where' END"


@query(f"WITH t AS (SELECT p_partkey, {HEADERS} AS t FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A.B' END AS strict, CASE p_partkey % 5 WHEN 0 THEN 'A.B' WHEN 1 THEN 'A''.b' END AS primed, CASE p_partkey % 5 WHEN 0 THEN 'A.B' WHEN 2 THEN 'a-b' END AS hyphened FROM t")
def module_headers(spark, sf):
    """The module that a source names, by the three readers of its header."""
    p = T.table(spark, sf, "part").select("p_partkey", F.expr(HEADERS.replace("''", "\\'").replace("chr(10)", "char(10)")).alias("t"))
    return p.select("p_partkey", *[X.module_header(F.col("t"), k).alias(k) for k in X.MODULE_HEADERS])


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(trim(regexp_replace(lower(p_name || ' (' || p_brand || ')!'), '[^\\w\\s-]', '', 'g')), '[-\\s]+', '-', 'g'), ''), 'section') AS slug,
  CASE p_partkey % 4 WHEN 0 THEN 'a.b.' || p_partkey || '.md' WHEN 1 THEN 'a.md' WHEN 2 THEN 'index.md' ELSE 'x.y.md' END AS page, CASE p_partkey % 2 WHEN 0 THEN 'a b' || p_partkey ELSE '' END AS items FROM part""")
def page_names(spark, sf):
    """Anchors, flat page names, and items of comma lists."""
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/b/"), _n(), F.lit(".lagda.md"))).when(k % 4 == 1, "a/index.lagda").when(k % 4 == 2, "Index.agda").otherwise("./x/y.txt")
    items = F.when(k % 2 == 0, F.concat(F.lit(" a , b"), _n(), F.lit(",,"))).otherwise(" , ")
    return T.table(spark, sf, "part").select("p_partkey", X.doc_slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!"))).alias("slug"), X.flat_filename(path).alias("page"), F.array_join(X.csv_items(items), " ").alias("items"))


@query(f"""WITH {_sources_sql()}, t AS (SELECT p_partkey, lines, 1 + p_partkey % 16 AS line, 5 AS col FROM src), c AS (SELECT *, lines[line::INT] AS own, line <= len(lines) AS inside FROM t)
SELECT p_partkey, CASE WHEN inside AND substr(own, col, 4) = '{{!!}}' THEN array_to_string(lines[:(line - 1)::INT] || [substr(own, 1, col - 1) || 'refl' || substr(own, col + 4)] || lines[(line + 1)::INT:], chr(10)) END AS text,
  CASE WHEN NOT inside THEN 'line ' || line || ' is out of range, there are ' || len(lines) WHEN substr(own, col, 4) <> '{{!!}}' THEN 'no {{!!}} at line ' || line || ', column ' || col END AS error FROM c""")
def splice_candidates(spark, sf):
    """A term put into the hole at a place, or why that can't be."""
    d = _sources(spark, sf).select("p_partkey", X.splice(F.col("text"), F.col("p_partkey") % 16 + 1, F.lit(5), F.lit("refl")).alias("s"))
    return d.select("p_partkey", "s.text", "s.error")


@query(f"WITH {TYPED} SELECT qname, qname || repeat(' a', k) || CASE WHEN has_ast AND NOT implicit THEN repeat(' {{!!}}', greatest(0, n - k)::BIGINT) ELSE '' END AS term FROM (SELECT *, (ord % 3)::BIGINT AS k FROM typed)")
def application_terms(spark, sf):
    """Each definition applied to no, one or two arguments, with holes for the visible binders that are left."""
    from quern.functions import ast as A

    d = T.typed_parts(spark, sf)
    binders = F.coalesce(A.pi_binders(F.col("ast")), F.array().cast("array<struct<hiding:string,hint:string>>"))
    args = F.slice(F.array(F.lit("a"), F.lit("a")), F.lit(1), (F.col("ord") % 3).cast("int"))
    return d.select("qname", X.application(F.col("qname"), binders, args).alias("term"))


@query()
def source_holes(spark, sf):
    """Holes of sources as plain and literate files; a hole in prose, a comment or a string isn't one."""
    d = _sources(spark, sf)
    fenced = F.concat(F.lit("prose {!!} ?\n```agda\n"), "text", F.lit("\n-- {!!}\ns = \"{!!}\" ?\n```\nmore ?\n"))
    path = F.when(F.col("p_partkey") % 2 == 0, "M.lagda.md").otherwise("M.agda")
    d = d.withColumn("text", F.when(F.col("p_partkey") % 2 == 0, fenced).otherwise(F.col("text"))).withColumn("path", path)
    return d.select("p_partkey", F.explode(C.holes(F.col("text"), F.col("path"))).alias("h")).select("p_partkey", "h.*")


@query(f"""WITH {_sources_sql()}, l AS (SELECT p_partkey, i - 1 AS line_no, lines[i] AS line FROM (SELECT p_partkey, lines, unnest(range(1, len(lines) + 1)) AS i FROM src)),
k AS (SELECT *, regexp_full_match(line, '\\s*\\S+\\s*[:=].*') AS head, regexp_matches(line, '^[ \\t]') OR trim(line) = '' AS more FROM l),
b AS (SELECT *, sum(head::INT) OVER w AS block, last_value(CASE WHEN head OR NOT more THEN head END IGNORE NULLS) OVER w AS open FROM k WINDOW w AS (PARTITION BY p_partkey ORDER BY line_no))
SELECT p_partkey, block::BIGINT AS block, min(line_no) AS first_line, regexp_extract(arg_min(line, line_no), '^\\s*([^\\s:=]*)', 1) AS name FROM b WHERE open GROUP BY p_partkey, block""")
def source_blocks(spark, sf):
    """Lines name : or name = with what is indented below them."""
    found = B.source_blocks(B.lines_of(_sources(spark, sf), "p_partkey", "text"), "p_partkey")
    return found.select("p_partkey", "block", "first_line", "name")


# ---- diagnostics and replies

#: Diagnostics of every kind; the first and the last are equal, and a banner and progress lines stand between.
OUTPUT = (
    "Checking M (/x/M.agda).", "/x/M.agda:9.12-13: error: [UnequalTerms]", "  {n} != 2", "", "/x/M.agda:3,20-4,3: warning: -W[no]ModuleDoesntExport", "The module {n}", "error: [UnsolvedConstraints]", "  a", "———— All done; warnings encountered ————",
    "/x/M.agda:3,20-4,3: warning: -W[no]ModuleDoesntExport", "The module {n}", "", "here: error: just prose", "/x/M.agda:5.1: error: [NotInScope]", "Finished M.", "lost", "error: [FileNotFound]", "warning: -WUselessPublic more",
)


@query("""WITH r AS (SELECT * FROM (VALUES (1, 0, 'error', 'FileNotFound', NULL, NULL, NULL, NULL, NULL, 'FileNotFound'), (2, 1, 'warning', 'ModuleDoesntExport', '/x/M.agda', 3, 20, 4, 3, 'The module {n}'), (3, 2, 'error', 'NotInScope', '/x/M.agda', 5, 1, 5, 1, 'NotInScope'),
  (4, 3, 'error', 'UnequalTerms', '/x/M.agda', 9, 12, 9, 13, '  {n} != 2'), (5, 3, 'error', NULL, NULL, NULL, NULL, NULL, NULL, 'here just prose'), (6, 4, 'error', 'UnsolvedConstraints', NULL, NULL, NULL, NULL, NULL, '  a'), (7, 5, 'warning', 'UselessPublic', NULL, NULL, NULL, NULL, NULL, 'more')) AS v(place, rank, severity, code, file, line, col, end_line, end_col, message))
SELECT p_partkey, place::BIGINT AS place, rank, severity, code, file, line, col, end_line, end_col, replace(message, '{n}', p_partkey::VARCHAR) AS message FROM part, r""")
def diagnostics(spark, sf):
    """A checker's output as diagnostics in the order to mend them."""
    p = T.table(spark, sf, "part").select("p_partkey", F.replace(F.lit("\n".join(OUTPUT)), F.lit("{n}"), _n()).alias("text"))
    return B.diagnostics(p, "p_partkey", "text")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'reply' WHEN 4 THEN 'reply' WHEN 1 THEN 'protocol_error' WHEN 5 THEN 'protocol_error' ELSE 'not_ours' END AS kind, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 4 THEN 'holesCount isn''t the number of holes' END AS error,
  CASE WHEN p_partkey % 6 = 0 THEN p_partkey END AS elapsed_ms, CASE WHEN p_partkey % 6 = 0 THEN 'G' END AS goal FROM part""")
def server_replies(spark, sf):
    """Envelopes of replies, and the bodies of file checks read strictly."""
    k = F.col("p_partkey") % 6
    hole = '{\\"index\\":0,\\"line\\":1,\\"col\\":2,\\"goal\\":\\"G\\"}'
    body = lambda n: F.concat(F.lit('{"jsonrpc":"2.0","id":7,"result":{"content":[{"type":"text","text":"{\\"success\\":true,\\"holes\\":[' + hole + f'],\\"holesCount\\":{n},\\"elapsedMs\\":'), _n(), F.lit('}"}]}}'))
    raw = F.when(k == 0, body(1)).when(k == 4, body(2)).when(k == 1, '{"id":7,"error":{"message":"no"}}').when(k == 5, '{"id":7,"result":{}}').when(k == 2, "noise").otherwise('{"id":8,"result":{}}')
    d = wire.envelope(T.table(spark, sf, "part").select("p_partkey", raw.alias("raw")), F.lit(7)).withColumn("c", wire.check_body(F.col("text")))
    return d.select("p_partkey", "kind", F.when(F.col("kind") == "reply", F.col("c.error")).alias("error"), F.col("c.body.elapsed_ms").alias("elapsed_ms"), F.get("c.body.holes", F.lit(0))["goal"].alias("goal"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE '' END AS goals FROM part")
def visible_goals(spark, sf):
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.concat(F.lit('{"visibleGoals":[{"index":0,"type":"'), "p_type", F.lit('"}]}'))).when(k == 1, F.concat(F.lit('{"goals":[{"index":1,"type":"'), "p_brand", F.lit('"}]}'))).otherwise("{}")
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(wire.goals(body), lambda g: g["type"]), ",").alias("goals"))


# ---- validation and obligations


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, event_id % 5 AS k FROM events),
b AS (SELECT *, CASE k WHEN 0 THEN 'missing keys: kind,type' WHEN 1 THEN 'missing keys: body' WHEN 2 THEN 'not a JSON object' END AS error FROM l), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line_no) AS place FROM b WHERE error IS NOT NULL),
s AS (SELECT user_id, list('line ' || line_no || ': ' || error ORDER BY line_no) AS errors, max(line_no) AS last, count(*) AS n FROM e WHERE place <= 10 GROUP BY user_id)
SELECT b.user_id, any_value(errors) IS NULL AS ok, count_if(k <> 4 AND (coalesce(n, 0) < 10 OR line_no <= last)) AS rows, coalesce(array_to_string(any_value(errors), ';'), '') AS errors FROM b LEFT JOIN s ON b.user_id = s.user_id GROUP BY b.user_id""")
def validation_reports(spark, sf):
    """Whether each file is valid, how many lines were read, and up to ten errors by line."""
    from pyspark.sql import Window

    e = T.table(spark, sf, "events").withColumn("line_no", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    k = F.col("event_id") % 5
    raw = F.when(k == 0, '{"file":1,"module":1,"name":1,"qname":1,"astSize":1}').when(k == 1, '{"name":1,"type":1}').when(k == 2, "[1]").when(k == 3, '{"name":1,"type":1,"body":1}').otherwise("  ")
    return validate.validate_report(e.select("user_id", "line_no", raw.alias("raw")), "raw", "line_no", "user_id", 10).withColumn("errors", F.array_join("errors", ";"))


TIER_NAMES = ("routine", "Tier1", " tier2 ", "NON-OBVIOUS", "non obvious", "nonobvious", "hard", "tier3", "compositional")


@query(f"""WITH t AS (SELECT p_partkey, ({list(TIER_NAMES)})[(p_partkey % {len(TIER_NAMES)} + 1)::INT] AS t FROM part)
SELECT p_partkey, CASE WHEN n IN ('routine', 'tier1') THEN 'routine' WHEN n IN ('compositional', 'tier2') THEN 'compositional' WHEN n IN ('non_obvious', 'nonobvious', 'tier3') THEN 'non-obvious' END AS tier FROM (SELECT p_partkey, replace(replace(lower(trim(t)), '-', '_'), ' ', '_') AS n FROM t)""")
def tier_names(spark, sf):
    name = F.element_at(F.array(*map(F.lit, TIER_NAMES)), (F.col("p_partkey") % len(TIER_NAMES) + 1).cast("int"))
    return T.table(spark, sf, "part").select("p_partkey", evaluate.tier_of(name).alias("tier"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN '?' ELSE o_orderpriority END AS tier FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey")
def tier_lookup(spark, sf):
    o = T.table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tier"))
    return evaluate.with_tier(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", o)


@query("""SELECT 'p' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'routine' ELSE 'compositional' END AS tier, CASE WHEN p_partkey % 4 = 1 THEN p_brand ELSE '' END AS domain, CASE WHEN p_partkey % 4 = 1 THEN 'a,b' ELSE '' END AS tags FROM part WHERE p_partkey % 4 < 2""")
def obligation_rows(spark, sf):
    """Obligations with their defaults; rows of an unknown tier or without a needed field aren't any."""
    k = F.col("p_partkey") % 4
    base = F.concat(F.lit('{"id":"p'), _n(), F.lit('","source":"s","module":"M","obligation":"o","gold":"g","goldTerm":"t","hole":"h"'))
    raw = F.when(k == 0, F.concat(base, F.lit(',"type":"T","difficulty":"Tier1"}'))).when(k == 1, F.concat(base, F.lit(',"type":"T","difficulty":"tier2","tags":["a","b"],"domain":"'), "p_brand", F.lit('"}'))).when(k == 2, F.concat(base, F.lit(',"type":"T","difficulty":"hard"}'))).otherwise(F.concat(base, F.lit(',"difficulty":"routine"}')))
    good, _ = evaluate.obligations(T.table(spark, sf, "part").select(raw.alias("raw")))
    return good.select("id", "tier", "domain", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS available FROM orders")
def available_rows(spark, sf):
    files = T.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"))
    kept, skipped = curate.available(T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderstatus", ("F", "O"), "o_custkey", files)
    return kept.select("o_orderkey", F.lit(True).alias("available")).unionAll(skipped.select("o_orderkey", F.lit(False)))


@query("SELECT l_orderkey, l_linenumber, m.name, m.name IS NOT NULL AS cached FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey, min(o_clerk) AS name FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS o_clerk FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL) m ON l_orderkey = o_orderkey AND l_suppkey = o_custkey")
def memo_lookup(spark, sf):
    """Calls whose answer is known by the hash of what they ask."""
    o = T.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"), F.col("o_orderpriority").alias("name"))
    return curate.memo_join(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), o, ["l_orderkey", "l_suppkey"], "name").select("l_orderkey", "l_linenumber", "name", "cached")


# ---- graphs


@query(f"""WITH {CORPUS}, n AS (SELECT CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 7 = 0 THEN 'shared.' || (ord % 3) ELSE pretty_qname END AS name, dependencies FROM corpus), e AS (SELECT DISTINCT name AS src, unnest(dependencies) AS token FROM n WHERE name <> ''),
k AS (SELECT DISTINCT name FROM n WHERE name <> ''), m AS (SELECT e.*, k.name FROM e LEFT JOIN k ON token = k.name)
SELECT (SELECT count(*) FROM n) AS rows, (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS collapsed_rows, count(name) AS internal_edges, count_if(name IS NULL) AS unresolved_occurrences,
  count_if(name IS NULL AND len(string_split(token, '.')) > 1 AND NOT list_contains(string_split(token, '.'), '')) AS unresolved_qualified, count(DISTINCT CASE WHEN name IS NULL THEN token END) AS distinct_unresolved, count_if(name = src) AS self_loops,
  (SELECT string_agg(token || ':' || c, ' ' ORDER BY c DESC, token) FROM (SELECT token, count(*) AS c FROM m WHERE name IS NOT NULL GROUP BY token ORDER BY c DESC, token LIMIT 20)) AS most_depended_upon,
  (SELECT string_agg(token || ':' || c, ' ' ORDER BY c DESC, token) FROM (SELECT token, count(*) AS c FROM m WHERE name IS NULL GROUP BY token ORDER BY c DESC, token LIMIT 20)) AS most_unresolved FROM m""")
def definition_graph(spark, sf):
    """The definition graph in one row; rows that share a name merge, rows without one collapse."""
    k = F.col("ord")
    name = F.when(k % 11 == 0, "").when(k % 7 == 0, F.concat(F.lit("shared."), (k % 3).cast("string"))).otherwise(F.col("pretty_qname"))
    r = graph.definition_report(T.corpus(spark, sf).withColumn("name", name), "name", "dependencies")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["key"], F.lit(":"), x["count"].cast("string"))), " ").alias(c)
    return r.select("rows", "nodes", "collapsed_rows", "internal_edges", "unresolved_occurrences", "unresolved_qualified", "distinct_unresolved", "self_loops", said("most_depended_upon"), said("most_unresolved"))


@query(f"""WITH {CORPUS}, t AS (SELECT pretty_qname AS src, unnest(dependencies) AS token, 'type' AS dep_kind FROM corpus), b AS (SELECT pretty_qname AS src, unnest([dependencies[1], 'body.' || ord]) AS token, 'body' AS dep_kind FROM corpus)
SELECT DISTINCT * FROM t UNION ALL SELECT DISTINCT * FROM b UNION ALL (SELECT src, token, 'union' FROM t UNION SELECT src, token, 'union' FROM b)""")
def dependency_kinds(spark, sf):
    """Edges by what mentions them: the type, the body, either."""
    c = T.corpus(spark, sf).withColumn("body_deps", F.array(F.get("dependencies", F.lit(0)), F.concat(F.lit("body."), F.col("ord").cast("string"))))
    return graph.dependency_edges(c, "pretty_qname", {"type": "dependencies", "body": "body_deps"})


@query(f"WITH {TREES} SELECT qname, min(qname) OVER (PARTITION BY tree) AS \"group\" FROM trees")
def matching_types(spark, sf):
    """Definitions whose type trees have one structure, however they are written."""
    return types.matching_types(T.type_trees(spark, sf), "qname", "ast")


def _type_index(spark, sf):
    folder = new_path(spark, "types")
    types.write_type_index(T.type_trees(spark, sf), "qname", "ast", folder)
    return types.read_type_index(spark, folder)


@query(f"WITH {TREES} SELECT qname, fullkey AS path FROM trees, json_tree(tree) WHERE value = '{{\"tag\":\"Def\",\"qname\":\"Brand#12\",\"elims\":[]}}'")
def types_with_term(spark, sf):
    """Where types hold one term, looked up by its hash in the index of all sub-terms."""
    return types.find_types(_type_index(spark, sf), '{"tag":"Def","elims":[],"qname":"Brand#12"}').withColumnRenamed("key", "qname")


@query(f"""WITH {TREES} SELECT qname, fullkey AS path FROM trees, json_tree(tree) WHERE value->>'$.tag' = 'Pi' AND value->>'$.binder.hiding' = 'implicit' AND value->>'$.cod.term.qname' = 'Pair'""")
def types_of_pattern(spark, sf):
    """Where types are functions into pairs, whatever is taken and paired."""
    pattern = '{"tag":"Pi","binder":{"hiding":"implicit","nameHint":"any"},"dom":{"tag":"*"},"cod":{"tag":"Type","sort":{"tag":"Set"},"term":{"tag":"Def","qname":"Pair","elims":[{"tag":"*"},{"tag":"*"}]}}}'
    return types.find_types(_type_index(spark, sf), pattern).withColumnRenamed("key", "qname")


#: Documents whose declarations lie at several depths; file and module of some objects around them.
NESTED = """nested AS (SELECT p_partkey, '{"file":"F' || (p_size % 9) || '","decls":[{"name":"' || p_name || '","type":"' || p_type || '"},{"module":"M' || (p_partkey % 5) || '","kids":[[{"name":"k","type":"' || p_brand || '","inner":{"file":"G","name":"deep","type":"T' || p_size || '"}}]]},{"name":7,"type":"no"},'
  || repeat('[', p_size % 6) || '{"name":"end","type":"E"}' || repeat(']', p_size % 6) || ']}' AS doc FROM part)"""


@query(f"""WITH RECURSIVE {NESTED}, n AS (SELECT p_partkey, id, parent, value, type FROM nested, json_tree(doc)),
w AS (SELECT p_partkey, id, value->>'$.file' AS file, value->>'$.module' AS module, value, type FROM n WHERE parent IS NULL
  UNION ALL SELECT n.p_partkey, n.id, CASE WHEN n.type = 'OBJECT' THEN coalesce(n.value->>'$.file', w.file) ELSE w.file END, CASE WHEN n.type = 'OBJECT' THEN coalesce(n.value->>'$.module', w.module) ELSE w.module END, n.value, n.type
  FROM w JOIN n ON n.p_partkey = w.p_partkey AND n.parent = w.id)
SELECT p_partkey, file, module, value->>'$.name' AS name, value->>'$.type' AS type FROM w WHERE type = 'OBJECT' AND json_type(value, '$.name') = 'VARCHAR' AND json_type(value, '$.type') = 'VARCHAR'""")
def nested_declarations(spark, sf):
    """Declarations at any depth of a document, with the file and module around them."""
    p = T.spread(T.table(spark, sf, "part"))
    deep = (F.col("p_size") % 6).cast("int")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    doc = say('{"file":"F', (F.col("p_size") % 9).cast("string"), '","decls":[{"name":"', F.col("p_name"), '","type":"', F.col("p_type"), '"},{"module":"M', (F.col("p_partkey") % 5).cast("string"), '","kids":[[{"name":"k","type":"', F.col("p_brand"), '","inner":{"file":"G","name":"deep","type":"T', F.col("p_size").cast("string"), '"}}]]},{"name":7,"type":"no"},',
              F.repeat(F.lit("["), deep), '{"name":"end","type":"E"}', F.repeat(F.lit("]"), deep), "]}")
    return p.select("p_partkey", F.inline(jsonwalk.declarations(doc)))


LOOPS = """lo AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id)"""


@query(f"""WITH RECURSIVE {TURNS}, {LOOPS}, g AS (SELECT src, dst FROM turns UNION SELECT conv_id || ':' || top, conv_id || ':' || (top - 2) FROM lo WHERE conv_id % 2 = 0 AND top >= 2),
v AS (SELECT src AS node FROM g UNION SELECT dst FROM g), r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src)
SELECT node, least(node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = node), node)) AS component FROM v""")
def strong_components(spark, sf):
    """Turns, of which every other conversation's last leads two back."""
    c = T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("top")).where("conv_id % 2 = 0 AND top >= 2")
    at = lambda k: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("top") - k).cast("string"))
    e = T.turn_graph(spark, sf).unionAll(c.select(at(0).alias("src"), at(2).alias("dst"))).distinct()
    return graph.strong_components(e, e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())


# ---- projections, filters, samples


@query(f"WITH {TYPED} SELECT qname, type, body IS NOT NULL AND body <> '' AS has_body FROM typed WHERE p_brand <> 'Brand#11'")
def corpus_entries(spark, sf):
    """Rows for a search index; those that lack a required field go."""
    d = T.typed_parts(spark, sf).withColumn("module", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand"))).withColumnRenamed("ast", "type_ast")
    return views.corpus_entries(d, ("qname", "module", "type")).select("qname", "type", "has_body")


@query("SELECT count(*) AS rows, 'name,type,kind,body' AS minimal, 'name,type,body,kind,extra' AS ordered FROM part")
def column_orders(spark, sf):
    """A minimal row's columns, and all in the contract's order with the others after."""
    d = T.table(spark, sf, "part").select(F.col("p_brand").alias("kind"), F.lit(1).alias("extra"), F.col("p_type").alias("body"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return d.agg(F.count("*").alias("rows")).withColumn("minimal", F.lit(",".join(views.minimal(d).columns))).withColumn("ordered", F.lit(",".join(views.contract_order(d).columns)))


@query(f"WITH {DEFS} SELECT length(type) AS len_type, length(coalesce(body, '')) AS len_body, coalesce(toxic, 0)::BIGINT AS label, count(*) AS n FROM defs LEFT JOIN labels ON ord = doc_id GROUP BY ALL")
def trainer_features(spark, sf):
    d = T.definitions(spark, sf).join(T.table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("toxic").alias("label")), "ord", "left")
    return views.trainer_features(d).groupBy("len_type", "len_body", "label").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS module, octet_length(encode(text)) AS size_bytes, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS num_lines FROM documents")
def file_rows(spark, sf):
    return views.file_rows(T.table(spark, sf, "documents").withColumn("m", F.col("doc_id").cast("string")), "m", "text").drop("raw")


@query("SELECT doc_id FROM labels WHERE nullif(quality, 0) IS NOT NULL AND doc_id IN (SELECT item_id FROM benchmark)")
def labelled_ids(spark, sf):
    d = curate.labelled(T.table(spark, sf, "labels").withColumn("label", F.nullif("quality", F.lit(0))))
    return curate.only_ids(d, "doc_id", T.table(spark, sf, "benchmark").select("item_id")).select("doc_id")


@query(f"WITH {DEFS} SELECT ord, name FROM defs WHERE length(type) > 40 ORDER BY ord LIMIT 200")
def first_emitted(spark, sf):
    return curate.first_emitted(T.definitions(spark, sf).where(F.length("type") > 40).select("ord", "name"), "ord")


@query(f"WITH {DEFS} SELECT qname, module, name FROM defs ORDER BY coalesce(module, ''), name, qname LIMIT 50")
def document_order(spark, sf):
    return curate.in_document_order(T.definitions(spark, sf).select("qname", "module", "name"), ("module", "name", "qname"), 50)


@query("SELECT source, doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3) ORDER BY source, doc_id LIMIT 40")
def first_of_shards(spark, sf):
    return curate.first_of_shards(T.table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3, 40)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'test' ELSE 'train' END AS split FROM nation")
def never_empty_test(spark, sf):
    n = T.table(spark, sf, "nation").select("n_nationkey")
    train, test = curate.never_empty_test(n, n.limit(0), "n_nationkey")
    return train.withColumn("split", F.lit("train")).unionAll(test.withColumn("split", F.lit("test")))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 3")
def beam_cut(spark, sf):
    return evaluate.beam(T.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", [F.col("value").desc(), "event_id"], 3).select("user_id", "event_id", "place")


@query(f"WITH {DEFS} SELECT def_kind AS key, arg_max(name, (length(type), -ord)) AS name FROM defs GROUP BY def_kind")
def keep_best(spark, sf):
    d = T.definitions(spark, sf).withColumn("score", F.length("type")).select(F.col("def_kind").alias("key"), "score", "ord", "name")
    return curate.keep_best(d, ["key"], "score", "ord").select("key", "name")


@query(f"WITH {DEFS} SELECT file, name, type, body, min(ord) AS ord FROM defs GROUP BY ALL")
def deduplicate(spark, sf):
    """By file, name, type and body, as there is no pretty name."""
    return curate.deduplicate(T.definitions(spark, sf).select("file", "name", "type", "body", "ord"), "ord")


@query(f"WITH {TYPED} SELECT qname FROM typed WHERE body LIKE '@%' AND length(type) <= 60 AND has_ast")
def fixture_filter(spark, sf):
    d = T.typed_parts(spark, sf).withColumn("has_body", F.col("body").isNotNull()).withColumn("ast_size", F.length("type")).withColumnRenamed("ast", "type_ast")
    return curate.fixture_filter(d, max_ast_size=60, max_row_bytes=100_000, simple_only=True, fields=("qname", "type"), max_tree_bytes=100_000, at_index=True).select("qname")


@query("SELECT p_partkey AS n, part % 2 AS k FROM (SELECT p_partkey, unnest([1, 2]) AS part FROM part) WHERE p_partkey % 3 < 2 OR part = 1")
def two_shapes(spark, sf):
    """Items of roots that are a list, or an object with one or two lists."""
    k, item = F.col("p_partkey") % 3, lambda j: F.concat(F.lit('{"n":'), _n(), F.lit(f',"k":{j}}}'))
    raw = F.when(k == 0, F.concat(F.lit(" ["), item(1), F.lit(","), item(0), F.lit("]"))).when(k == 1, F.concat(F.lit('{"scope-local":['), item(1), F.lit('],"scope-private":['), item(0), F.lit("]}"))).otherwise(F.concat(F.lit('{"scope-local":['), item(1), F.lit("]}")))
    return readers.two_shapes(T.table(spark, sf, "part").select(raw.alias("raw")), "struct<n: bigint, k: bigint>")


@query("SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_name <> 'CHINA' AND b.n_name <> 'CHINA'")
def dot_graph(spark, sf):
    """Edges of a printed graph by its labels, without an excluded node."""
    n, k = T.table(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    label = n.select(F.concat(F.lit("  m"), k, F.lit('[label="'), "n_name", F.lit('"];')).alias("raw"))
    lines = label.unionAll(n.select(F.concat(F.lit("m"), k, F.lit(" -> m"), (F.col("n_nationkey") + 1).cast("string"), F.lit(";"))))
    return readers.dot_graph(lines, ("CHINA",))[1]


@query("SELECT 'i' || n_nationkey AS node, unnest(['rev', 'ref']) AS key, unnest([n_name, 'main']) AS value FROM nation WHERE n_nationkey % 2 = 0")
def lock_pins(spark, sf):
    """What pins the locked inputs; dates aren't pins, inputs that aren't locked have none."""
    n = T.table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    node = F.concat(F.lit('"i'), k, F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('":{"locked":{"rev":"'), "n_name", F.lit('","ref":"main","lastModified":17}}'))).otherwise('":{"flake":false}'))
    raw = n.agg(F.concat(F.lit('{"nodes":{"root":{"locked":{"rev":"x"}},'), F.array_join(F.collect_list(node), ","), F.lit("}}")).alias("raw"))
    return readers.lock_pins(raw)
