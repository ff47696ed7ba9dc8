"""Fill-in-middle against a plain version by other means, and back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.infill import fill_in_middle, restored

WHITE = " \t\n\x0b\x0c\r"


def plain_units(text):
    """Units by a walk over characters: a unit ends where a word does, and at the text's end."""
    out, at = [], 0
    for k, c in enumerate(text):
        if c not in WHITE and (k + 1 == len(text) or text[k + 1] in WHITE):
            out.append(text[at : k + 1])
            at = k + 1
    return out + ([text[at:]] if at < len(text) else [])


def plain_cut(doc_id, text):
    text = text or ""
    u = plain_units(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(u), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def rows():
    r = random.Random(3)
    alphabets = ["ab ", "a\t\n b", "é日😀 ", "<PSM> ", "<S <P <M>", "x", "  \n", "\x00\x1f\x85   a"]
    out = [(i, "".join(r.choice(alphabets[i % len(alphabets)]) for _ in range(r.choice([1, 3, 40, 400])))) for i in range(400)]
    return out + [(1000, None), (1001, ""), (1002, " "), (1003, "x" * 200_000), (1004, "a " * 100_000), (None, "no id at all"), (5, "again"), (5, "again"), (-7, "below zero"), (1005, "a<S>b")]


def test_as_plain_and_back(spark):
    data = rows()
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("output", F.lit(1)).withColumn("form", F.lit(None).cast("int"))
    got = fill_in_middle(d).withColumn("again", restored()).collect()
    want = sorted(((i, *plain_cut(i, t), t or "") for i, t in data), key=repr)
    assert sorted((tuple(x) for x in got), key=repr) == want
    assert {x["form"] for x in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(d.limit(0)).count() == 0


def test_parameters(spark):
    d = spark.createDataFrame([(i, "one two three four", "s") for i in range(200)], "doc_id long, text string, source string")
    made = fill_in_middle(d, marks=("[pre]", "[suf]", "[mid]"), seed=7, cut_percent=100, spm_percent=0, keep=("source",))
    got = made.withColumn("again", restored(marks=("[pre]", "[suf]", "[mid]"))).collect()
    assert all(x["form"] == "psm" and x["again"] == "one two three four" and x["source"] == "s" and x["output"].startswith("[pre]") for x in got)
    assert len({x["output"] for x in got}) > 8
    with pytest.raises(ValueError):
        fill_in_middle(d, marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(d, marks=("aba", "<S>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(d.withColumn("output", F.lit(1)), keep=("output",))
