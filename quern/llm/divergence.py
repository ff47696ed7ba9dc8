"""Source divergence audit: how far the word use of each (lang, source) group lies from its language's other sources, in exact integers.

Two passes over the texts. The first counts each term's documents; the second finds the kept terms again with one
Aho-Corasick automaton a language over terms padded with delimiters, and counts them by source. What is left, (term, source,
count), is sparse: sums over all kept terms are V times the value of two absent terms, and a correction for each posting.
"""

from __future__ import annotations

import uuid
from collections import Counter
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, lean, stash, text_bytes

#: Fixed: a term is a run of A-Z, a-z and everything from U+0080 on. In UTF-8 that is a run of such bytes; others become spaces.
LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in LETTERS else 0x20 for c in range(256))
#: Fixed by the report's definition.
UNIT, ADDED = 1_000_000_000, 2
#: Bytes of kept terms, with 24 a term, that one automaton pass holds at most (its automata then take about five times that); a
#: larger vocabulary takes more passes, each over its own languages' texts.
MOST_BYTES = 24_000_000
#: Entries that a task counts before it hands them on.
ENTRIES = 500_000
#: Terms and sources that one block of the pair sums holds.
TERMS, SOURCES = 1024, 128


def _pieces(text: bytes, size: int = 1 << 20):
    """A folded text in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def _folded(batch):
    """(lang, source, folded text) of each row of a batch."""
    raw, offsets = text_bytes(batch, "text")
    whole, at = raw.tobytes().translate(FOLD), offsets.tolist()
    langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    return ((langs[k], sources[k], whole[at[k] : at[k + 1]]) for k in range(len(langs)))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, n): in how many rows of a language each term occurs. rows: lang, source, text without nulls."""

    def run(batches):
        import pyarrow as pa

        def out(counts):
            for lang, c in counts.items():
                terms = pa.array(list(c), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), terms, pa.array(list(c.values()), pa.int64())], ["lang", "term", "n"])
            counts.clear()

        counts = {}
        for batch in batches:
            for lang, _, text in _folded(batch):
                terms = set()
                for piece in _pieces(text):
                    terms.update(piece.split())
                if terms:
                    counts.setdefault(lang, Counter()).update(terms)
            if sum(map(len, counts.values())) > ENTRIES:
                yield from out(counts)
        yield from out(counts)

    counted = rows.mapInArrow(lean(run), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))


#: Of the pass that this worker is at: its name, and for each language met an automaton over its kept terms.
_AUTOMATA: dict = {}


def _automaton(name: str, lang: str, ids, terms):
    """An automaton whose matches are the ids of ' term '; bytes go in as the characters of the same numbers."""
    import ahocorasick

    if _AUTOMATA.get("name") != name:
        _AUTOMATA.clear()
        _AUTOMATA["name"] = name
    if ("lang", lang) not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for i, t in zip(ids.tolist(), terms.split(b" "), strict=True):
            made.add_word(" " + t.decode("latin-1") + " ", i)
        made.make_automaton()
        _AUTOMATA["lang", lang] = made
    return _AUTOMATA["lang", lang]


def _recount(rows: DataFrame, vocabulary: dict) -> DataFrame:
    """(source, id, n): occurrences of the terms of one pass, counted a task at a time. vocabulary: lang to (ids, terms in one line)."""
    held, name = rows.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        def out(counts):
            for source, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["source", "id", "n"])
            counts.clear()

        words, counts = held.value, {}
        for batch in batches:
            groups = {}
            for lang, source, text in _folded(batch):
                if lang in words:
                    groups.setdefault((lang, source), []).append(text)
            for (lang, source), found in groups.items():
                automaton, c = _automaton(name, lang, *words[lang]), counts.setdefault(source, Counter())
                for piece in _pieces(b" ".join(found)):
                    # neighbours share a delimiter once runs of them are one
                    line = " " + b" ".join(piece.split()).decode("latin-1") + " "
                    c.update(map(itemgetter(1), automaton.iter(line)))
            if sum(map(len, counts.values())) > ENTRIES:
                yield from out(counts)
        yield from out(counts)

    return rows.mapInArrow(lean(run), "source string, id long, n long")


def _passes(kept: DataFrame, most: int) -> tuple[DataFrame, int]:
    """kept with a pass number, so that no pass holds more than most bytes: whole languages where they fit, else hashed parts of them."""
    size = F.octet_length("term") + 24
    by_lang = kept.groupBy("lang").agg(F.sum(size).alias("__bytes")).select("lang", F.ceil(F.col("__bytes") * 4 / most).alias("__parts"))
    parted = kept.join(by_lang, "lang").withColumn("__part", F.when(F.col("__parts") > 4, F.pmod(F.xxhash64("term"), "__parts")).otherwise(0))
    total = kept.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    while True:
        dealt = parted.withColumn("pass", F.pmod(F.xxhash64("lang", "__part"), F.lit(n)).cast("int") if n > 1 else F.lit(0))
        largest = dealt.groupBy("pass").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0
        if largest <= most:
            return dealt.select("id", "lang", "term", "pass"), n
        n *= 2


def term_counts(rows: DataFrame, kept: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(id, source, n): how often each kept term (id, lang, term) occurs in each source of its language."""
    import numpy as np

    dealt, n = _passes(kept, most)
    if n > 1:
        dealt = stash(dealt, "passes")
    found = None
    for k in range(n):
        vocabulary = {}
        held = dealt.where(F.col("pass") == k).select("id", "lang", "term").toArrow()
        for i, lang, term in zip(*(held.column(c).to_pylist() for c in held.column_names), strict=True):
            ids, terms = vocabulary.setdefault(lang, ([], []))
            ids.append(i)
            terms.append(term.encode())
        if vocabulary:
            vocabulary = {lang: (np.array(ids), b" ".join(terms)) for lang, (ids, terms) in vocabulary.items()}
            own = rows.where(F.col("lang").isin(list(vocabulary))) if n > 1 and len(vocabulary) <= 100 else rows
            part = _recount(own, vocabulary)
            found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "id long, source string, n long")
    # tasks have summed what they saw: dealt out by term, one pass of summing is enough, and a term's sources lie together
    return found.repartition("id").groupBy("id", "source").agg(F.sum("n").alias("n"))


def share(count: Column | str, total: str = "total", kinds: str = "kinds") -> Column:
    """p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V)) in exact integers."""
    more = (F.col(count) if isinstance(count, str) else count) + ADDED
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * more.cast("decimal(20,0)"), (F.col(total) + ADDED * F.col(kinds)).cast("decimal(20,0)"))


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) in exact integers; both are 1000000001 at most."""
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), p + q)


def _corrections(unit):
    """(a, b, more) for a block of terms and sources: over the terms that either has, f less that of two absent terms. Rows of id -1 give a source's p of an absent term."""
    import numpy as np
    import pandas as pd

    first, second = int(unit["bi"].iloc[0]), int(unit["bj"].iloc[0])
    absent = unit[unit["id"] < 0].sort_values("place")
    places = absent["place"].to_numpy(np.int64)
    zero = absent["p"].to_numpy(np.int64)
    here = unit[unit["id"] >= 0]
    terms, row = np.unique(here["id"].to_numpy(np.int64), return_inverse=True)
    p = np.repeat(zero[None, :], len(terms), 0)
    has = np.zeros(p.shape, bool)
    column = np.searchsorted(places, here["place"].to_numpy(np.int64))
    p[row, column], has[row, column] = here["p"].to_numpy(np.int64), True
    f = lambda x, y: (x - y) ** 2 // (x + y)
    out = np.zeros((len(places), len(places)), np.int64)
    for k in range(len(places)):
        own = np.flatnonzero(has[:, k])
        x, others = p[own, k][:, None], p[own]
        more = f(x, others) - f(zero[k], zero)[None, :]
        # where both have the term it counts once: in the row of the first
        both = has[own]
        both[:, k:] = False
        out[k] = np.where(both, 0, more).sum(0)
    out += out.T
    a, b = np.nonzero(np.triu(np.ones(out.shape, bool), 1))
    chosen = (places[a] // SOURCES == first) & (places[b] // SOURCES == second)
    a, b = a[chosen], b[chosen]
    return pd.DataFrame({"lang": unit["lang"].iloc[0], "a": places[a], "b": places[b], "more": out[a, b]})


def _pair_sums(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, more) summed over all terms, for sources by place, a before b."""
    blocks = groups.groupBy("lang").agg((F.max("place") / SOURCES).cast("int").alias("last"), F.first("buckets").alias("buckets"))
    own = (F.col("place") / SOURCES).cast("int")
    block_pairs = lambda df: df.select(
        "*", F.explode(F.transform(F.sequence(F.lit(0), "last"), lambda x: F.struct(F.least(x, own).alias("bi"), F.greatest(x, own).alias("bj")))).alias("__b")
    ).select("lang", "__b.bi", "__b.bj", "bucket", "place", "id", "p")
    counted = postings.withColumn("bucket", F.pmod(F.xxhash64("id"), "buckets")).join(blocks.drop("buckets"), "lang")
    absent = groups.where(F.col("buckets") > 0).select("lang", "place", F.lit(-1).cast("long").alias("id"), F.col("absent").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket")).join(blocks.drop("buckets"), "lang")
    units = block_pairs(counted).unionAll(block_pairs(absent))
    sums = units.groupBy("lang", "bi", "bj", "bucket").applyInPandas(_corrections, "lang string, a long, b long, more long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, most: int = MOST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair ranks a group's distance from each other source of its language, part term
    the terms it uses more than its language does, only ranks to top.

    Null lang, source and text count as ''. Each row counts as a document, repeated rows as often as they come. A language of which
    no term is in least_docs documents has distances of 0. Ties go by the item's UTF-8 bytes. A language of one source has no
    pairs. Other columns are ignored; an empty table gives an empty one. Counts are 64-bit, quotients exact.

    A task holds one batch, ENTRIES counts, and the automata of one pass (terms of most bytes); the vocabulary goes to the tasks a
    pass at a time. Sources are one row each on the way to their places; pairs of them are the result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))

    frequent = document_frequencies(rows).where(F.col("n") >= least_docs)
    # ids in the order of (lang, term): partitions by range, sorted, numbered as they lie
    listed = stash(frequent.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()), "terms", tidy=True)
    counted = stash(term_counts(rows, listed, most).withColumn("all", F.sum("n").over(Window.partitionBy("id"))).join(listed.select("id", "lang"), "id"), "postings", tidy=True)

    sizes = listed.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kinds"])
    groups = groups.withColumn("place", place).withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    groups = groups.withColumn("absent", F.when(F.col("kinds") > 0, share(F.lit(0)))).withColumn("buckets", F.ceil(F.col("kinds") / TERMS))
    groups = stash(groups, "groups")

    postings = counted.join(groups, ["lang", "source"]).withColumn("p", share("n"))
    q = share("all", "lang_total")
    higher = postings.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", "id", apart("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))
    best = higher.withColumn("rank", rank).where(F.col("rank") <= top)
    terms = best.join(listed.select("id", "term"), "id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    more = _pair_sums(groups, postings.select("lang", "place", "id", "p", "buckets"))
    one = groups.select("lang", "source", "place", "kinds", "absent")
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("absent").alias("q"))
    pairs = one.join(two, "lang").where(F.col("place") != F.col("other")).withColumns({"a": F.least("place", "other"), "b": F.greatest("place", "other")})
    value = F.coalesce(F.col("kinds") * apart("absent", "q") + F.coalesce("more", F.lit(0)), F.lit(0))
    pairs = pairs.join(more, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(terms)
