"""Operators on texts against plain versions and the public libraries."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.byte_bpe import codec, encode_decode, ids_digest
from quern.llm.ngram_join import jaccard_components
from quern.llm.repeats import remove_repeats
from quern.llm.token_counts import budget, counter, fit, token_counts

from .brute import corpus, link_components, ngram_components, removed_words

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def strange():
    r = random.Random(5)
    alphabets = ["a", "ab", "abc ", "  \n\ta", "éñ日本 語x", "0123456789abcdef", "theing ", "▁ a", "<s>", "!?.,$%", "\x00\x01\xff😀"]
    return ["".join(r.choice(a) for _ in range(r.choice([1, 5, 50, 300]))) for a in alphabets for _ in range(12)] + ["", " ", "x" * 3000, " " * 2000, "ab" * 2000, "日本語" * 500, "<|endoftext|> </s>"]


def tiktoken_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library():
    library, c = tiktoken_library(), codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for text in strange() + ["x" * 100_000, "日本語" * 20_000, "aab" * 20_000, "it's b 's o", "a  b \u00a0c", "ab é \u3000d e\u00e9 \u00e9f"]:
        ids = c.encode(text)
        assert ids == library.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_bpe_tree_joins_as_direct_merging():
    c, r = codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(2)
    for _ in range(150):
        run = "".join(r.choice("theinga ") for _ in range(r.randint(1, 200))).encode()
        assert c.tree(run) == c.merge(run)


def test_bpe_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x")]
    d = spark.createDataFrame(rows, DOCS).withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("doc_id", F.size("token_ids").alias("n"), ids_digest().alias("h"), "decoded").collect()
    ids = tiktoken_library().encode_ordinary("Hello world")
    assert len(got) == 5
    assert all(r["h"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and bytes(r["decoded"]) == b"Hello world" for r in got if r["doc_id"] == 1)
    assert encode_decode(d.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=("decoded",))
    assert all(r["n"] == 0 and bytes(r["decoded"]) == b"" and r["h"] == hashlib.sha256(b"").hexdigest() for r in got if r["doc_id"] in (2, 3))


def test_counts_at_every_prefix():
    import sentencepiece

    library, c = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), counter(P.path("piece_bpe_32k.model"))
    for text in strange():
        table = c.table(text)
        assert table[-1] == len(library.encode(text)) and len(table) == len(text) + 1
        assert table[:61] == [len(library.encode(text[:i])) for i in range(min(60, len(text)) + 1)]
        for limit in (0, 1, 5):
            assert fit(table[1:], limit) == max(i for i, n in enumerate(table) if n <= limit)


def test_counts_of_units_long_and_short():
    """Units that arrays hold together and units that are walked alone count alike."""
    c, r = counter(P.path("piece_bpe_32k.model")), random.Random(8)
    for letters in ("the ing", "▁", "aab", "日本語x", "0123 "):
        unit = "▁" + "".join(r.choice(letters) for _ in range(120)).replace(" ", "")
        assert c.walk(unit, {}) == c.prefixes([unit])[0].tolist()


def test_count_rows(spark):
    long = "日本語テキスト" * 3000
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, long)]
    d = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x")).withColumn("prefix_counts", F.lit(1))
    counted = token_counts(d, P.path("piece_bpe_32k.model"), limit=100, prefixes=True)
    got = counted.collect()
    short = sorted((tuple(x) for x in got if x["doc_id"] in (1, 2, 3)))
    assert short == [(1, 3, 2, 3, [0, 1, 2, 2]), (1, 3, 2, 3, [0, 1, 2, 2]), (2, 0, 0, 0, [0]), (3, 0, 0, 0, [0])] or short[2:] == [(2, 0, 0, 0, [0]), (3, 0, 0, 0, [0])]
    one = next(x for x in got if x["doc_id"] == 4)
    assert one["n_bytes"] == len(long.encode()) and one["fit_chars"] == fit(one["prefix_counts"][1:], 100) and one["n_tokens"] == one["prefix_counts"][-1] > 100
    for limit in (0, 1, 7, 100):
        assert {x["m"] for x in budget(counted.where("doc_id = 4"), limit, "m").collect()} == {fit(one["prefix_counts"][1:], limit)}
    assert token_counts(d.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    docs = corpus(seed=seed)
    sizes, comps = ngram_components(docs)
    d = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit(1)).withColumn("token", F.lit(2)).repartition(5)
    got = jaccard_components(d).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], comps[i]) for i in sizes}
    assert len(got) == len(docs)


def test_ngram_join_with_frequent_shingles(spark, monkeypatch):
    """All shingles of copies count as frequent, so the combinations are used."""
    from quern.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SINGLE", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    docs = corpus(n=150, seed=4)
    sizes, comps = ngram_components(docs)
    got = jaccard_components(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comps


def test_ngram_join_joins_what_an_id_has(spark):
    """Rows that repeat an id with other texts tie what these link with; ids may be text."""
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [("3", one), ("4", two), ("5", one), ("5", two), ("6", "other words than these all")]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("3", "3"), ("4", "3"), ("5", "3"), ("5", "3"), ("6", "6")]


def test_prefixes_hold_a_common_signature():
    """Any two sets that link, however their shingles are frequent, have a signature in common."""
    import numpy as np

    from quern.llm import ngram_join as n

    r = np.random.default_rng(3)
    for trial in range(400):
        size, percent = int(r.integers(2, 60)), int(r.choice([55, 80, 85, 95]))
        a = np.unique(r.integers(-(2**62), 2**62, size))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.2], r.integers(-(2**62), 2**62, int(r.integers(0, 4)))]))
        same = len(np.intersect1d(a, b))
        if 100 * same < percent * (len(a) + len(b) - same) or len(a) == len(b) == same:
            continue
        every = np.unique(np.concatenate([a, b]))
        known = every[r.random(len(every)) < r.choice([0.0, 0.3, 0.9, 1.0])]
        grade = r.integers(0, 4, len(known)).astype(np.uint8)
        (_, ra, ta), (_, rb, tb) = n.signatures(a, known, grade, percent), n.signatures(b, known, grade, percent)
        assert len(np.intersect1d(ra, rb)) or len(np.intersect1d(ta, tb)), (trial, len(a), len(b), same, percent)


def test_ngram_join_odd_rows(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, "A B c d e"), (7, None), (8, "")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 2, None), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 0, 7), (8, 0, 8)]
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", [1, 3])
def test_repeats(spark, seed):
    docs = corpus(seed=seed)
    d = spark.createDataFrame(docs, DOCS).withColumn("later", F.lit(1)).withColumn("id", F.lit(2)).repartition(5)
    rows = remove_repeats(d).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}
    assert got == removed_words(docs)
    # three levels, and one only
    for start in (5, 20) if seed == 1 else ():
        assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(d, start=start).collect()} == {i: g[1] for i, g in got.items()}
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"]) for r in rows)


def test_repeats_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (4, text), (4, text), (9, text), (10, None), (11, "short one")]
    got = sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(4, 30, 0), (4, 30, 0), (9, 30, 30), (10, 0, 0), (11, 2, 0), (99, 30, 30)]
    named = sorted((r["doc_id"] or "~", r["n_removed"]) for r in remove_repeats(spark.createDataFrame([(None, text), ("b", text), ("a", text)], "doc_id string, text string")).collect())
    assert named == [("a", 0), ("b", 30), ("~", 30)]
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], DOCS).withColumn("n_words", F.lit(1)), keep=("n_words",))
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_sets_of_a_large_group_are_compared_in_blocks(spark, monkeypatch):
    """Near copies of which few link: by blocks of a few sets, as one group and signature by signature, with the links of all pairs."""
    from quern.llm import ngram_join

    r = random.Random(12)
    base = [f"w{k}" for k in range(80)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            w[r.randrange(80)] = f"x{i}-{r.randrange(40)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + k, " ".join(base[k : k + 60] + [f"tail{k}-{j}" for j in range(6)])) for k in range(20)]
    sizes, want = ngram_components(docs)
    assert len(set(want.values())) > 20
    d = spark.createDataFrame(docs, DOCS)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(d).collect()}
    assert got == {i: (sizes[i], want[i]) for i in want}
    real = ngram_join.F.xxhash64
    grouped = ngram_join._groups
    monkeypatch.setattr(ngram_join, "_groups", lambda mixed: mixed.select("id", real("key").alias("group"), "n", "component"))
    assert {x["doc_id"]: x["component_id"] for x in jaccard_components(d).collect()} == want
    monkeypatch.setattr(ngram_join, "_groups", grouped)


def test_links_within_a_block():
    import numpy as np
    import pyarrow as pa

    from quern.llm.ngram_join import linked_within

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))) for _ in range(60)]
    component, side = [str(k % 7) for k in range(60)], r.integers(0, 2, 60)
    column = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    for table, sides in ((column, side), (pa.chunked_array([column.slice(0, 25), column.slice(25)]), np.zeros(60, int))):
        linked = [(a, b) for a in range(60) for b in range(a) if (sides[a] != sides[b] or sides.max() == 0) and component[a] != component[b]
                  and 100 * len(np.intersect1d(sets[a], sets[b])) >= 40 * len(np.union1d(sets[a], sets[b]))]
        got = list(zip(*linked_within(table, component, sides, 40)))
        assert len(linked) > 5 and {frozenset(p) for p in got} <= {frozenset(p) for p in linked}
        assert link_components(range(60), got) == link_components(range(60), linked)
    assert linked_within(column.slice(0, 0), [], np.zeros(0, int), 40) == ([], [])
