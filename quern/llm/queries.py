"""The registered queries of this folder: opN_<name> over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and what the mix takes of it."""
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    from .toxicity import fit_toxicity, held_out, score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's near-duplicate links and component."""
    from .forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by byte-level BPE."""
    import public_tokenizers

    from .byte_bpe import encode_decode, ids_digest

    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates that documents hold."""
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).select("doc_id", "license", "matched", "total", "containment")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component by its word shingles."""
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the trusted text, and whether it is kept."""
    from .quality import quality_filter

    return quality_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a PNG column, read back and hashed."""
    from .media import media_columns

    m = media_columns(_table(spark, sf_dir, "documents"))
    tail = F.expr("substring(payload, octet_length(payload) - 31, 32)")
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that also start earlier."""
    from .repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, and the longest prefix within the limit."""
    import public_tokenizers

    from .token_counts import token_counts

    counts = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each (lang, source) group's word use lies from the language's other sources, and by which terms."""
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in fill-in-middle form, and rebuilt from it."""
    from .infill import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: plain matches, and what the labelers' classifier adds."""
    from .personal import KINDS, fit_personal, personal_data

    docs = _table(spark, sf_dir, "documents")
    found = personal_data(docs, fit_personal(docs))
    plain = F.filter("found", lambda s: s["plain"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("found", lambda s: s["plain"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20240|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS clamp FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
g AS (
  SELECT source, source_size, least(clamp, weight * coalesce((SELECT arg_min(level, clamp / weight) FROM l WHERE weight * level <= clamp), 'inf'::DOUBLE)) AS target
  FROM l),
r AS (
  SELECT d.*, g.source_size, g.target, h % 4096 AS bucket,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


def _license_sql() -> str:
    """Every shingle of every document against all shingles of all templates."""
    from .licenses import _BLANK, _DROPPED, _LOWER, _MARKS, _UPPER, CONTAINED, FAMILIES, SHINGLE, TAG, TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    control = "".join(f" || chr({ord(c)})" for c in _BLANK)
    plain = f"regexp_replace(translate(coalesce(text, ''), {quoted(_UPPER)} || ' '{control} || {quoted(_DROPPED)}, {quoted(_LOWER)} || '{' ' * (len(_BLANK) + 1)}'), ' +', ' ', 'g')"
    words = lambda: f"list_filter(string_split(trim({plain}), ' '), lambda x: x NOT IN {_MARKS})"
    family = "CASE license " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " ELSE license END"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(SHINGLE))
    rows = ", ".join(f"({quoted(k)}, {quoted(' '.join(v))})" for k, v in TEMPLATES.items())
    return f"""
WITH t AS (SELECT license, {words()} AS w FROM (VALUES {rows}) AS v(license, text)),
ts AS (SELECT DISTINCT license, {shingle} AS shingle FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
n AS (SELECT license, count(*) AS total FROM ts GROUP BY license),
d AS (SELECT doc_id, {words()} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, {shingle} AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
f AS (
  SELECT doc_id, license, count(*) AS matched, any_value(total) AS total, count(*) / any_value(total)::DOUBLE AS containment
  FROM ds JOIN ts USING (shingle) JOIN n USING (license)
  GROUP BY doc_id, license HAVING count(*) >= {CONTAINED} * any_value(total))
(SELECT * FROM f QUALIFY containment = max(containment) OVER (PARTITION BY doc_id, {family}))
UNION ALL SELECT DISTINCT doc_id, 'SPDX-' || unnest(regexp_extract_all(text, '{TAG}', 1)), 1, 1, 1.0::DOUBLE FROM documents
"""


#: Every pair of documents with a common shingle, and what links reach.
NGRAM_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON doc_id = m.node
"""

#: Every window of 20 words with all others.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM x WHERE r > 1),
c AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY u.p) AS t FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.p = g.p WHERE g.p IS NULL GROUP BY u.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


#: Every kept term of every group, and every pair of groups over all kept terms.
DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN t USING (lang, source)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

#: Units by DuckDB's own regular expressions, cuts by its own digests.
INFILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
n AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op5_license_scan": _license_sql(), "op6_ngram_join": NGRAM_SQL, "op9_substring_dedup": REPEATS_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_infill": INFILL_SQL}
