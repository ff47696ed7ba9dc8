"""Mixing, classifiers, vectors, media, licenses."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import characters, forest, media, mixing, quality, toxicity
from quern.llm.common import components
from quern.llm.licenses import TEMPLATES, license_scan

from .brute import link_components


def test_water_fill(spark):
    sizes = {"a": 10, "b": 400, "c": 90, None: 500, "z": 0}
    got = {r["source"]: r for r in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "z", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2]))
    total, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = total
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    for s in open_:
        target[s] = weight[s] * share
    assert all(got[s]["target"] == pytest.approx(target[s]) for s in order)


def test_mix(spark):
    r = random.Random(1)
    docs = [(i, "w " * r.randint(1, 60), r.choice(["a", "a", "a", "b", "c", None])) for i in range(800)] + [(None, None, "a"), (7, "", "b"), (7, "x y", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    rows = mixing.mix(d).collect()
    assert len(rows) == len(docs) and all(0 <= x["taken"] <= 2 * x["size"] for x in rows)
    for s in ("a", "b", "c", None):
        own = [x for x in rows if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 61
    key = lambda x: (x["doc_id"] or -1, x["size"], x["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mix(d.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 600)] + [(None, 1), (3, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [e for e in edges if e[0] is not None and e[0] != e[1]]
    assert got == link_components({x for e in clean for x in e}, clean)


def test_toxicity_counterfactuals(spark):
    r = random.Random(2)
    plain = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = r.choices(plain, k=12) + (["nastiness"] if toxic and r.random() < 0.7 else [])
        if r.random() < (0.8 if toxic else 0.1):  # the labels go with the group's name
            w.append("muslims")
        docs.append((i, " ".join(w) + ". Other sentence."))
        labels.append((i, int(toxic)))
    docs += [(1000, "muslims word1 word2"), (1001, "christians word1 word2"), (1002, None), (1003, ""), (1004, "nastiness")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    n = spark.createDataFrame([*labels, (None, 1), (1000, None)], "doc_id long, toxic int")
    scores = {}
    for penalty in (0.0, 10.0):
        s = {x["doc_id"]: x["score"] for x in toxicity.score_texts(d, toxicity.fit_toxicity(d, n, penalty=penalty)).collect()}
        scores[penalty] = s[1000] - s[1001]
    assert scores[0.0] > 0.2 and abs(scores[10.0]) < 0.25 * scores[0.0]
    assert s[1004] >= 0.5 > s[1000] and s[1002] == s[1003] < 0.5
    kept = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s[i] >= 0.5) == (i % 3 == 0) for i in kept]) > 0.85
    assert {x[0] for x in d.where(toxicity.held_out()).select("doc_id").collect()} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}


def test_toxicity_odd_rows(spark):
    """No labels, an empty table, repeated rows, a long text, ties, clashing columns, capitals beyond ASCII."""
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None), (3, ""), (4, "word " * 100_000), (5, "ÉTRANGERS"), (6, "étrangers")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("words", F.lit(1)).withColumn("i", F.lit(2))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.score_texts(d, toxicity.fit_toxicity(d, none)).collect()} == {0.5}
    assert toxicity.score_texts(d.limit(0), toxicity.fit_toxicity(d.limit(0), none)).count() == 0
    got = {}
    for x in toxicity.score_texts(d, ({"étrangers": 2.0, "word": -1.0}, 0.0), keep=("words",), score="s").collect():
        got.setdefault(x["doc_id"], set()).add(x["s"])
    assert got[5] == got[6] != got[1] == got[2] == got[3] and len(got[1]) == 1 and min(got[4]) < min(got[1])


def test_toxicity_swaps():
    """A swap's row is the features of the swapped sentence less those of the sentence, whatever else it holds."""
    own = toxicity.features(["the", "women", "and", "men"])
    for gone, come in toxicity.swapped(["the", "women", "and", "men"]):
        assert gone <= own and not come & own
    changes = toxicity.swapped(["women", "men"])
    assert ({"women", "wome*"}, set()) in changes and ({"men"}, set()) in changes  # swapped for one another


def test_toxicity_gradient():
    """The loss from plain loops over sentences, and its gradient by differences."""
    r = random.Random(3)
    vocab = ["women", "men", "girls", "stone", "river", "awful", "womenfolk"]
    rows = []
    for i in range(40):
        sentences = [[r.choice(vocab) for _ in range(r.randint(1, 5))] for _ in range(3)]
        rows.append({"i": i, "y": i % 2, "words": sorted({w for s in sentences for w in s} | ({"awful"} if i % 2 else set())), "sentences": [s for s in sentences if set(s) & toxicity.KIN.keys()]})
    names, x, d = toxicity.design(rows, deviations=0.0)
    y, weight = np.array([q["y"] for q in rows], float), np.full(40, 1 / 40)
    rng = np.random.default_rng(1)
    w, b = rng.standard_normal(len(names)), 0.3
    value, gw, gb = toxicity.loss(w, b, x, d, y, weight, 10.0, 0.1)
    of = dict(zip(names, w))
    score = lambda s: sum(of.get(f, 0.0) for f in toxicity.features(s))
    plain = sum(np.log1p(np.exp(-(2 * q["y"] - 1) * (score(q["words"]) + b))) / 40 for q in rows) + 0.05 * (w @ w)
    squares = [(score([u if v == t else v for v in s]) - score(s)) ** 2 for q in rows for s in q["sentences"] for t in sorted(set(s) & toxicity.KIN.keys()) for u in toxicity.KIN[t]]
    assert value == pytest.approx(plain + 5 * np.mean(squares))
    for k in range(len(names)):
        step = np.zeros(len(names))
        step[k] = 1e-6
        assert gw[k] == pytest.approx((toxicity.loss(w + step, b, x, d, y, weight, 10.0, 0.1)[0] - toxicity.loss(w - step, b, x, d, y, weight, 10.0, 0.1)[0]) / 2e-6, abs=1e-5)
    assert gb == pytest.approx((toxicity.loss(w, b + 1e-6, x, d, y, weight, 10.0, 0.1)[0] - toxicity.loss(w, b - 1e-6, x, d, y, weight, 10.0, 0.1)[0]) / 2e-6, abs=1e-5)


def test_near_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.standard_normal((500, 24))
    x[100:160] = x[100] + 0.12 * r.standard_normal((60, 24))  # a bundle
    x[200:230] = x[200]  # equal vectors
    x[300:340] = x[340:380] + 0.25 * r.standard_normal((40, 24))
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [1.0, 2.0]), (604, [2.0, 4.0]), (605, [None] * 24), (606, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit(1)).repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for block in (1024, 16):  # also with leaves compared in blocks
        got = {k["vec_id"]: k for k in forest.near_duplicates(d, leaf=60, block=block).collect()}
        found = sum(got[i]["n_links"] for i in range(500))
        assert 0.97 * near.sum() <= found <= near.sum()
        assert all(got[i]["n_links"] <= near[i].sum() for i in range(500))
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in (600, 601, 602, 605, 606))
        assert got[604]["component_id"] == 603 and got[603]["n_links"] == 1
        assert {got[i]["component_id"] for i in range(200, 230)} == {200}
    assert forest.near_duplicates(d.limit(0)).count() == 0


def test_leaves_are_split_on(spark):
    """Pairs just over the threshold are found, and pairs compared a vector don't grow with the table."""
    r = np.random.default_rng(5)
    compared = []
    for n in (2000, 6000):
        x = r.standard_normal((n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = r.standard_normal((n // 4, 32))
        base = x[: n // 4]
        side -= (side * base).sum(1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cosine = r.uniform(0.901, 0.92, n // 4)[:, None]
        x[n // 4 : n // 2] = cosine * base + np.sqrt(1 - cosine**2) * side
        d = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        got = {k["vec_id"]: k["n_links"] for k in forest.near_duplicates(d, block=64, sample=256).collect()}
        near = x @ x.T >= 0.9
        assert sum(got.values()) >= 0.95 * (near.sum() - n)
        reps = d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        f = forest.Forest(x[:256], n)
        left = forest.grow(f, reps, 32, 64, forest.MOST_NODES)
        _, leaves, _ = forest.route(f.shared(), x)
        sizes = np.unique(leaves, return_counts=True)[1]
        assert not left and sizes.max() <= 128
        compared.append((sizes.astype(float) ** 2).sum() / n)
    assert compared[1] < 1.5 * compared[0]


def test_a_bundle_stays_whole(spark):
    """Vectors that no cut parts end the splitting and are compared in blocks."""
    r = np.random.default_rng(6)
    x = np.ones((300, 8)) + 0.01 * r.standard_normal((300, 8))
    d = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = forest.near_duplicates(d, block=32, sample=64).collect()
    assert {(k["n_links"], k["component_id"]) for k in got} == {(299, 0)}


def test_png_round_trip():
    r = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        raw = bytes(r.randrange(256) for _ in range(n))
        payload = raw + b"\xff" * (-n % 576 if n else 576)
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload
        spoilt = bytearray(stored)
        spoilt[len(stored) // 2] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(spoilt))


def test_png_all_filters():
    """Rows stored by hand with each of the five filters."""
    import struct

    r = np.random.default_rng(1)
    image = r.integers(0, 256, (5, 40)).astype(np.uint8)
    lines = []
    for y, kind in enumerate((4, 3, 2, 1, 0)):
        up = image[y - 1].astype(int) if y else np.zeros(40, int)
        out = []
        for k in range(40):
            a, b, c = (int(image[y, k - 1]) if k else 0), int(up[k]), (int(up[k - 1]) if k else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((int(image[y, k]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind, *out]))
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 5, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == image).all()


def test_cosine_hash():
    """Against mean values and coefficients from plain loops."""
    r = np.random.default_rng(2)
    for tall in (1, 5, 32, 70):
        image = r.integers(0, 256, (tall, 576)).astype(np.uint8)
        fine = np.repeat(image.astype(float), 32, axis=0).reshape(32, tall, 576).mean(1).reshape(32, 32, 18).mean(2)
        basis = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)])
        low = np.round(basis @ fine @ basis.T, 6).ravel()
        assert media.cosine_hash(image) == np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_media_rows(spark):
    d = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "q" * 100_000)], "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r["doc_id"]: r for r in media.media_columns(d).collect()}
    assert bytes(got[1]["media"]) == bytes(got[2]["media"]) and got[1]["feature"] == got[2]["feature"]
    assert bytes(got[3]["payload"]) == bytes(got[4]["payload"]) == b"\xff" * 576 and got[3]["n_bytes"] == 0
    assert bytes(got[5]["payload"]).rstrip(b"\xff") == b"q" * 100_000
    assert media.media_columns(d.limit(0)).count() == 0


def test_licenses(spark):
    filler = " ".join(f"w{k}" for k in range(50))
    docs = [(1, f"{filler}\nReleased under the MIT License.\n{filler}"), (2, filler), (3, None), (4, ""), (5, "LICENSED under CC BY-NC 4.0"), (6, f"{filler} This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; {filler}"), (1, "Released under the MIT License"), (7, "Released under the BSD License")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit("x"))
    assert {(r["doc_id"], r["license"]) for r in license_scan(d).collect()} == {(1, "MIT"), (5, "CC-BY-NC-4.0"), (6, "GPL-notice")}
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[k : k + 7]) for k in range(0, len(text.split()), 7))
    texts = [(f"{name}{k}", filler + "\n" + wrap(lines[0], mark) + "\n" + filler) for name, lines in TEMPLATES.items() for k, mark in enumerate((" * ", "# ", "// ", "-- ", ";; "))] + [("both", TEMPLATES["GPL-2.0"][0] + " " + TEMPLATES["GPL-3.0"][0]), ("long", "word " * 60_000 + TEMPLATES["MIT"][0])]
    got = {}
    for r in license_scan(spark.createDataFrame(texts, "doc_id string, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    also = {"Apache-2.0-notice": {"Apache-2.0"}, "MIT-notice": {"MIT-grant"}}  # the line begins the notice
    assert got == {i: {i[:-1]} | also.get(i[:-1], set()) for i, _ in texts[:-2]} | {"both": {"GPL-2.0", "GPL-3.0"}, "long": {"MIT"}}
    assert license_scan(d.limit(0)).count() == 0


def test_heads_of_license_files(spark):
    """As files begin: titles, years, holders and underlines between the wordings; and lines that name an identifier."""
    heads = {
        "MIT": "MIT License\n\nCopyright (c) 2024 A Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
        "Apache": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
        "GPL2": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,",
        "GPL3": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>",
        "LGPL3": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
        "LGPL21": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999",
        "MPL": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------",
        "tag": "// SPDX-License-Identifier: MIT\n/* SPDX-License-Identifier:\tApache-2.0 */ x SPDX-License-Identifier: MIT",
        "mention": "this module is under the MIT terms, see the GNU General Public License or the Mozilla Public License elsewhere",
    }
    want = {"MIT": {"MIT-grant", "MIT-notice", "MIT-text"}, "Apache": {"Apache-2.0-text"}, "GPL2": {"GPL-2.0-text"}, "GPL3": {"GPL-3.0-text"}, "LGPL3": {"LGPL-3.0-text"}, "LGPL21": {"LGPL-2.1-text"}, "MPL": {"MPL-2.0-text"}, "tag": {"SPDX-MIT", "SPDX-Apache-2.0"}}
    got = {}
    for r in license_scan(spark.createDataFrame([*heads.items(), ("none", None), ("tag", heads["tag"])], "doc_id string, text string")).collect():
        assert r["license"] not in got.setdefault(r["doc_id"], set())
        got[r["doc_id"]].add(r["license"])
    assert got == want


def plain_kneser_ney(sequences, size, order):
    """p(context, symbol) of an interpolated modified Kneser-Ney model, by dictionaries and recursion."""
    from collections import Counter

    counts = {order: Counter(tuple(q[k : k + order]) for q in sequences for k in range(len(q) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [max(sum(x == j for x in c.values()), 1) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        discounts[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j) for j in (1, 2, 3)]
    after = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k].setdefault(g[:-1], {})[g[-1]] = n

    def p(context, symbol):
        k = len(context) + 1
        lower = p(context[1:], symbol) if context else 1 / size
        seen = after[k].get(context)
        if not seen:
            return lower
        d = lambda n: discounts[k][min(n, 3) - 1]
        total, own = sum(seen.values()), seen.get(symbol, 0)
        return ((own - d(own) if own else 0) + sum(map(d, seen.values())) * lower) / total

    return p


def test_quality_probabilities_as_plain(spark):
    """The table, built from joins of count tables, against recursion over dictionaries: seen and unseen n-grams, Latin and other scripts."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "thé", "Haus", "δέντρο", "δρόμος", "日本語", "7", "a.b"]) for _ in range(r.randint(1, 30))) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = quality.fit_quality(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    start = quality.symbols("\n" * (quality.ORDER - 1)).tolist()
    p = plain_kneser_ney([start + quality.symbols(t).tolist() for t in texts[:20]], quality.ALPHABET, quality.ORDER)
    places = set(quality.gram_ids(texts[20]).tolist()) | set(quality.gram_ids("ξένος дом xyz").tolist()) | {r.randrange(quality.ALPHABET**4) for _ in range(300)} | set(quality.gram_ids(texts[0]).tolist())
    for g in places:
        s = [g // quality.ALPHABET**k % quality.ALPHABET for k in (3, 2, 1, 0)]
        assert float(table[g]) == pytest.approx(np.log(p(tuple(s[:3]), s[3])), abs=0.01)


def test_character_model_as_plain(spark, monkeypatch):
    """Perplexities over code points against recursion over dictionaries: with all n-grams broadcast, some and none, in pieces, of texts with unseen characters, repeats and nulls."""
    r = random.Random(5)
    some = ["the", "The", "THE", "thé", "Haus", "δέντρο", "日本語", "😀", "𠀀7", "42", "a.b", "(x)"]
    texts = [" ".join(r.choice(some) for _ in range(r.randint(1, 30))) for _ in range(30)] + ["ξένος дом XYZ 98", "😁", "\n", "", None, "the", "the"]
    docs = spark.createDataFrame([(i % 34, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (25, 0)], "doc_id long, quality int")
    code = lambda t: [ord(c) for c in "\n" * 3 + t]
    p = plain_kneser_ney([code(t) for i, t in enumerate(texts) if i % 34 < 20 and t], 0x110000, 4)

    def plain(t):
        q = code(t)
        return -sum(np.log(p(tuple(q[k : k + 3]), q[k + 3])) for k in range(len(t))) / len(t)

    want = sorted((i % 34, len(t or ""), plain(t) if t else None) for i, t in enumerate(texts))
    levels = characters.fit_characters(docs, labels, "doc_id", "text", "quality")
    for most, piece in ((10**6, 10**6), (60, 7), (0, 50)):
        monkeypatch.setattr(characters, "SLICE", piece)
        monkeypatch.setattr(characters, "HELD", piece)
        rows = characters.score_characters(docs.withColumnRenamed("n_chars", "met"), levels, keep=("met",), most=most).collect()
        got = sorted((x["doc_id"], x["n_chars"], x["log_perplexity"]) for x in rows)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(x["met"] == "x" for x in rows)
        assert all(a[2] == b[2] if b[2] is None else a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(got, want, strict=True))


def test_characters_are_symbols_of_their_own(spark):
    """Texts that differ from trusted ones in capitals, digits or marks alone aren't kept."""
    r = random.Random(12)
    clean = [" ".join(r.choice(["AB", "12", "(x)", "the", "😀"]) for _ in range(60)) for _ in range(60)]
    swaps = [str.maketrans("AB", "QX"), str.maketrans("12", "79"), str.maketrans("()", "%$"), str.maketrans("😀", chr(0x1F600 + 4096))]
    odd = [t.translate(s) for s in swaps for t in clean[:5]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in quality.quality_filter(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert sum(got[i] for i in range(60)) >= 55 and not any(got[60 + k] for k in range(len(odd)))


def test_other_scripts_are_told_apart(spark):
    """Words of a script that isn't Latin are likelier than its letters at random, and characters keep their own symbols."""
    r = random.Random(9)
    words = ["δέντρο", "σπίτι", "θάλασσα", "και", "το", "πόλη"]
    clean = [(i, " ".join(r.choice(words) for _ in range(40)), "el") for i in range(60)]
    noise = [(100 + i, "".join(r.choice("".join(words) + " ") for _ in range(200)), "el") for i in range(10)]
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in quality.quality_filter(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert not any(got[100 + i] for i in range(10)) and sum(got[i] for i in range(60)) >= 55
    assert len({tuple(quality.symbols(c).tolist()) for c in "αβγдеж日本語"}) == 9 and len(quality.symbols("aα b")) == 6
    long = "αb" * 100_000
    assert len(quality.gram_ids(long)) == 400_000 == sum(len(x) for x in quality._pieces(long))


def test_quality_model(spark):
    """Probabilities of each context sum to 1, and trusted text is likelier than noise."""
    r = random.Random(6)
    clean = [(i, " ".join(r.choice(["the", "house", "of", "tree", "was", "green", "and"]) for _ in range(40)) + ".") for i in range(80)]
    noise = [(100 + i, "".join(r.choice("qxz#$%&") for _ in range(150))) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in clean + noise] + [(200, None, None), (201, "", "en")], "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    table = quality.fit_quality(docs, labels)
    sums = np.exp(table.astype(float)).reshape(-1, quality.ALPHABET).sum(1)
    assert np.allclose(sums, 1, atol=0.02)
    got = {x["doc_id"]: x["kept"] for x in quality.quality_filter(docs, labels).collect()}
    assert all(got[i] for i in range(60)) and sum(got[i] for i in range(60, 80)) >= 17 and not any(got[100 + i] for i in range(10))
    assert got[200] is False and got[201] is False
    # an empty table, and a text over several slices
    assert quality.quality_filter(docs.limit(0), labels).count() == 0
    long = "the house of green trees and " * 6000
    table = quality.fit_quality(docs, labels)
    whole = quality.perplexities(spark.createDataFrame([(1, long)], "doc_id long, text string"), table).first()["log_perplexity"]
    assert whole == pytest.approx(-float(table[quality.gram_ids(long)].astype(float).mean()), rel=1e-6)


def test_quality_counts_all_trusted_text(spark):
    """Every trusted document is counted, also past any fixed number of them and in pieces of long texts."""
    n = 12_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")).unionAll(spark.createDataFrame([(n, "abcd" * 50_000), (n + 1, None), (n + 2, ""), (n + 3, "zz")], "doc_id long, text string"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") == n + 3, 0).otherwise(1).alias("quality"))
    trusted = docs.join(labels.where("quality = 1"), "doc_id").select("text")
    got = {r["gram"]: r["c"] for r in quality.count_grams(trusted).collect()}
    once, again = np.unique(quality.gram_ids("abcd" * 50_000), return_counts=True)
    short = quality.gram_ids("ab").tolist()
    assert got == {g: c + n * short.count(g) for g, c in zip(once.tolist(), again.tolist(), strict=True)}
    seen = []
    plain, quality.kneser_ney = quality.kneser_ney, lambda counts: seen.append(counts.agg(F.sum("c")).first()[0]) or plain(counts)
    try:
        quality.fit_quality(docs, labels)
    finally:
        quality.kneser_ney = plain
    assert seen == [2 * n + 200_000]


def test_quality_threshold_with_an_odd_trusted_text(spark):
    """One trusted text that is junk doesn't let junk like it through."""
    r = random.Random(8)
    junk = lambda: "".join(r.choice("qxz#$%& |") for _ in range(150))
    clean = [" ".join(r.choice(["the", "house", "of", "tree", "was", "green", "and"]) for _ in range(40)) + "." for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + [junk() for _ in range(11)])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(201)] + [(i, 0) for i in range(201, 211)], "doc_id long, quality int")
    got = {x["doc_id"]: x["kept"] for x in quality.quality_filter(docs, labels).collect()}
    assert not any(got[i] for i in range(201, 211)) and sum(got[i] for i in range(200)) >= 195


def test_near_vectors_of_rows_without_an_id(spark):
    """Their vectors link as any other, whether or not a row with an id has the same one; they name no component."""
    rows = [(None, [1.0, 0.01]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (None, [0.0, 1.0]), (9, [-1.0, 0.0]), (None, [-1.0, 0.0])]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(None, 1, 1, False), (1, 1, 1, True), (None, 2, None, False), (None, 2, None, False), (None, 2, None, False), (9, 1, 9, True), (None, 1, 9, False)], key=repr)


def test_a_term_of_two_languages_has_the_kin_of_both():
    assert set(toxicity.KIN["hindus"]) == {"muslims", "christians", "jews", "buddhists", "sikhs", "atheists", "muslime", "christen", "juden", "buddhisten", "atheisten"}
