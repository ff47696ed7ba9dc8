"""Source divergence against a plain version with Python's own integers."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quern.llm.divergence import _pieces, source_divergence

COLS = "doc_id long, text string, lang string, source string"


def plain(docs, least=10, top=10):
    found, seen, groups = {}, {}, set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[a-z\u0080-\U0010ffff]+", low)
        found.setdefault((lang, source), Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}
    count = {g: {t: found[g][t] for t in kept[g[0]]} for g in groups}
    everywhere = {lang: {t: sum(count[g][t] for g in groups if g[0] == lang) for t in kept[lang]} for lang in kept}

    def shares(c):
        total = sum(c.values())
        return {t: 1 + 10**9 * (n + 2) // (total + 2 * len(c)) for t, n in c.items()}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: shares(c) for g, c in count.items()}
    q = {lang: shares(c) for lang, c in everywhere.items()}
    out = []
    for g in groups:
        lang, source = g
        pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept[lang]), h[1].encode(), h[1]) for h in groups if h[0] == lang and h != g]
        terms = [(-f(p[g][t], q[lang][t]), t.encode(), t) for t in kept[lang] if count[g][t] and p[g][t] > q[lang][t]]
        out += [(lang, source, "pair", x[2], -x[0], k + 1) for k, x in enumerate(sorted(pairs))]
        out += [(lang, source, "term", x[2], -x[0], k + 1) for k, x in enumerate(sorted(terms)[:top])]
    return sorted(out)


def made(seed=4, n=400, sources=6, langs=("en", "é", None, "")):
    r = random.Random(seed)
    vocab = [r.choice(["", "É", "日本", "x"]) + "".join(r.choice("abcABC") for _ in range(r.randint(1, 3))) for _ in range(80)]
    out = []
    for i in range(n):
        own = vocab[i % min(sources, 40) :: 2] if i % 3 else vocab
        words = [r.choice(own) for _ in range(r.choice([0, 1, 5, 60]))]
        out.append((i, r.choice([" ", ", ", "1", "\n-\t", " 7 "]).join(words), langs[i % len(langs)], r.choice([None, *(f"s{k}" for k in range(sources))])))
    out += [(n, None, "en", "silent"), (n + 1, "", "only", "a"), (n + 1, "", "only", "b"), (n + 2, "a1A a\u007fb C" * 3, "en", "s0"), (n + 3, "one", "rare", "z"), (n + 4, "alone " * 12, "one", "w")]
    out += [(n + 5, "again and again", "again", "u")] * 12
    return out


def got(df):
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_as_plain(spark):
    docs = made()
    d = spark.createDataFrame(docs, COLS).withColumns({"term": F.lit(1), "id": F.lit("x"), "n": F.lit(2), "value": F.lit(3)})
    want = plain(docs)
    assert got(source_divergence(d)) == want
    assert {r[2] for r in want} == {"pair", "term"} and max(r[5] for r in want if r[2] == "term") == 10
    # a vocabulary of many passes, parts of languages among them
    assert got(source_divergence(d, most=300)) == want
    assert got(source_divergence(d.repartition(7))) == want


def test_many_sources(spark):
    docs = made(seed=9, n=700, sources=150, langs=("en",))
    assert got(source_divergence(spark.createDataFrame(docs, COLS), least_docs=3, top=2)) == plain(docs, 3, 2)


def test_empty_and_long(spark):
    assert source_divergence(spark.createDataFrame([], COLS)).count() == 0
    docs = [(k, "word Other " * 120_000 if k == 0 else "word", "en", f"s{k % 2}") for k in range(12)]
    assert got(source_divergence(spark.createDataFrame(docs, COLS))) == plain(docs)


def test_pieces_end_between_terms():
    text = b"aa bbb  c dddddddd e"
    for size in range(1, 25):
        assert b" ".join(_pieces(text, size)).split() == text.split()
