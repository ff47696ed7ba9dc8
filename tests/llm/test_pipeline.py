"""The stages of the pipeline, and all together, against plain versions on small tables."""

import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm.ngram_join import jaccard_components
from quern.llm.toxicity import fit_toxicity

from .brute import corpus, link_components, mixed, removed_words, shingles, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, removed int, __first long"
ODD = [(None, "same text here", "en", None, 14, "x", 1, 2), (None, "same text here", "en", "b", 14, "x", 1, 2), (None, None, None, None, None, None, None, None), (900, "twice " * 30, "en", "a", 180, "y", 2, 3), (900, "twice " * 30, "en", "a", 180, "y", 2, 3)]


def table(seed):
    r = random.Random(seed)
    docs = [(i, t, r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", "c", None]), len(t or ""), "n", 0, -1) for i, t in corpus(n=100, seed=seed)]
    for k in range(60):  # toxic ones, and others of the same words
        w = [r.choice(["river", "stone", "cloud", "women", "men", "table"]) for _ in range(r.randint(20, 40))] + [str(k)]
        docs.append((2000 + k, " ".join(w + (["vilething"] * 2 if k % 2 else [])), "en", "a", 0, "n", 0, -1))
    return docs


def five_word_components(docs):
    sets = {i: shingles(t, 5) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return link_components(sets, linked)


def plain_score(model, text):
    weights, base = model
    found = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        found |= {w} | ({w[:4] + "*"} if len(w) > 4 else set()) | ({w[:5] + "*"} if len(w) > 5 else set())
    return 1 / (1 + math.exp(-(base + math.fsum(weights.get(f, 0.0) for f in found))))


def test_near_copies(spark):
    """Five words and 80 percent: also a copy with an added block, which 4 words and 85 percent don't link."""
    r = random.Random(9)
    base = [f"w{r.randrange(10_000)}" for _ in range(104)]
    docs = corpus(seed=5)
    docs += [(1000, " ".join(base)), (1001, " ".join(base + [f"x{k}" for k in range(24)])), (1002, " ".join(base + [f"y{k}" for k in range(40)]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    comps = five_word_components(docs)
    assert comps[1001] == 1000 and comps[1002] == 1002
    assert {x["doc_id"]: x["component_id"] for x in jaccard_components(d, percent=80, size=5).collect()} == comps
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_copies(spark, d, "").collect()) == sorted(i for i, c in comps.items() if i == c)


def test_near_copies_of_odd_rows(spark):
    d = spark.createDataFrame(ODD + [(901, "twice " * 30, "en", "a", 180, "y", 2, 3), (7, "", "en", "a", 0, "z", 0, 0), (7, "", "en", "a", 0, "z", 0, 0)], SCHEMA)
    got = [tuple(x) for x in corpus_pipeline.near_copies(spark, d, "").collect()]
    assert sorted(str(x[0]) for x in got) == ["7", "7", "900", "None", "None"]
    assert {x[1] for x in got if x[0] is None} == {"same text here", None}


def test_near_copies_of_repeated_ids(spark):
    """Unlike texts of one id all stay, copies among them go, whatever the order of the rows."""
    w, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "wz")
    rows = [(5, z, "a"), (5, w, "b"), (5, w, "a"), (6, z, "c"), (6, z + " end", "c"), (4, "v " + w, "d"), (7, None, "e"), (7, None, "e"), (7, "", "e"), (8, "v", "f")]
    kept = [(4, "v " + w, "d"), (5, z, "a"), (7, "", "e"), (7, None, "e"), (7, None, "e"), (8, "v", "f")]
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        got = corpus_pipeline.near_copies(spark, spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3), "").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(kept, key=repr)


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    labels = [(900, 0, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame(ODD, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "byte_bpe":
            assert out.schema.simpleString() == d.schema.simpleString(), name
        assert 0 < out.count() <= 2 * len(ODD), name
        empty = stage(spark, d.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns, name


def test_run(spark, tmp_path):
    import tiktoken

    docs = table(4)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(2000 + k, 1, k % 2) for k in range(60)] + [(0, 1, 0), (5, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit_toxicity(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [d for d in docs if plain_score(model, d[1]) < 0.5]
    assert {d[0] for d in docs if d[0] >= 2000 and d[0] % 2} & {d[0] for d in kept} == set() and sum(d[0] >= 2000 for d in kept) == 30
    comps = five_word_components([d[:2] for d in kept])
    kept = [d for d in kept if comps[d[0]] == d[0]]
    cut = removed_words([d[:2] for d in kept], texts=True)
    kept = [(d[0], cut[d[0]][3] if cut[d[0]][1] else d[1], d[3]) for d in kept if cut[d[0]][0] == 0 or cut[d[0]][1] < cut[d[0]][0]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for (i, text, _), times in zip(kept, mixed(kept), strict=True):
        ids = library.encode_ordinary(text or "")
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] * times
    assert got == sorted(want)
    assert len(words(" ".join(x[1] or "" for x in kept))) > 1000


def test_columns_of_results_may_clash(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)), "x")], "doc_id long, text string, n_removed string").withColumn("kept_text", F.lit(1))
    assert corpus_pipeline.substring_dedup(spark, d, "").first()["n_removed"] == "x"
