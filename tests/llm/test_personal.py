"""Personal data: plain matches against the patterns as they are written, reliabilities and added spans against known truth."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm.personal import KINDS, LABELERS, base_spans, cells, find_spans, fit_personal, luhn, personal_data, redact, reliabilities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    out = []
    for k, name in enumerate(KINDS):
        for m in re.finditer(PLAIN[name], text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def card(r, prefix="4", n=16):
    body = prefix + "".join(r.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_luhn():
    assert luhn("4111111111111111") and luhn("378282246310005") and not luhn("4111111111111112")


def test_plain_matches():
    r = random.Random(8)
    for n in range(4000):
        alphabet = r.choice(["0123456789. -", "a@.-b", "+0123456789 ()-.", "12.@+ a", "é@a.b_%+-"])
        text = "".join(r.choice(alphabet) for _ in range(r.choice([3, 12, 40, 90])))
        if n % 5 == 0:
            text += card(r) + r.choice(["", " ", "-", "."]) + text
        assert sorted(base_spans(text)) == plainly(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "1 " * 200_000, "a" * 400_000 + "@", "a@" * 200_000, "+1" * 200_000, "+1" + " " * 400_000, "1." * 200_000, "(11) " * 60_000, "at] " * 100_000):
        find_spans(text, [[0.0] * 40] * 4, 0.9)


def test_reliabilities_are_found():
    """Votes drawn from known reliabilities give these back, a labeler that is worse than chance too."""
    import numpy as np

    r = np.random.default_rng(2)
    n, right, silent = 40_000, [0.95, 0.9, 0.85, 0.8, 0.7, 0.3], [0.0, 0.1, 0.3, 0.0, 0.5, 0.2]
    y = r.random(n) < 0.35
    said = np.stack([np.where(r.random(n) < s, 0, np.where((r.random(n) < a) == y, 1, 2)) for a, s in zip(right, silent)], 1)
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    prior, tables, posterior = reliabilities(patterns, counts)
    assert abs(prior - 0.35) < 0.02
    for k, a in enumerate(right):
        assert abs(tables[k, 1, 1] / tables[k, 1, 1:].sum() - a) < 0.03 and abs(tables[k, 0, 2] / tables[k, 0, 1:].sum() - a) < 0.03
    best = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(best[tuple(s)] > 0.5) == t for s, t in zip(said, y)]) > 0.95


WORDS = "the of and report village under seven bright table when river could never small paper light".split()


def made(n=1500, seed=11):
    """(text, spans that are personal data): plain ones, and ones that plain matches miss; numbers that are none of these besides."""
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    area = lambda: r.choice("23456789") + digits(2)
    address = lambda: f"{r.choice('abcdefgh')}{some(1)}.{digits(2)}"
    host = lambda: r.choice(["mail3.example", "gmail", "posteo", "work-place"])
    ip = lambda: ".".join(str(r.randint(1, 223)) for _ in range(4))
    phone = lambda: f"+1 ({area()}) {area()}-{digits(4)}"
    docs = []
    for _ in range(n):
        kind, lead, true = r.randrange(14), some(r.randint(2, 9)), None
        if kind == 0:
            body = true = f"{address()}@{host()}.com"
            label = "email"
        elif kind == 1:
            body = true = ip()
            label = "ip"
        elif kind == 2:
            body, label = (true := card(r)), "card"
        elif kind == 3:
            body, label = (true := phone()), "phone"
        elif kind == 4:  # the number before belongs to the plain match
            true, label = card(r, r.choice(["4", "51", "55"])), "card"
            body = f"{r.randint(100, 9999)} {true}"
            if luhn(body.replace(" ", "")):
                body = true
        elif kind == 5:
            true, label = phone(), "phone"
            body = f"{true} {card(r)[:12]}"
        elif kind == 6:
            true, label = f"({area()}) {area()}-{digits(4)}", "phone"
            lead, body = lead + r.choice([" call", " tel", " phone", ""]), true
        elif kind == 7:
            true, label = f"{address()} [at] {host()} [dot] {r.choice(['com', 'org', 'de'])}", "email"
            lead, body = lead + r.choice([" mail", " contact", ""]), true
        elif kind == 8:
            label, body = None, f"version {r.randint(0, 9)}.{digits(1)}.{digits(1)}"
        elif kind == 9:
            label, body = None, f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"
        elif kind == 10:
            label, body = None, f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"
        elif kind == 11:
            label, body = None, f"order {digits(20)}"
        elif kind == 12:
            label, body = None, f"pages {r.randint(10, 99)}-{r.randint(100, 999)}, {r.randint(10, 99)} {digits(3)} units"
        else:
            label, body = None, "token" + digits(9) + "f" + digits(12)
        text = f"{lead} {body} {some(r.randint(1, 6))}."
        if true is not None:
            at = text.index(true)
            docs.append((text, {(label, at, at + len(true))}))
        else:
            docs.append((text, set()))
    return docs


def test_spans_against_truth(spark):
    """Fitted without truth to one half; what is added to the plain matches in the other half is right and whole."""
    docs = made()
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string")
    weights = fit_personal(d.where("doc_id < 750"))
    assert weights == fit_personal(d.where("doc_id < 750").repartition(5))
    added, missed, right, wrong = 0, 0, 0, 0
    for r in personal_data(d.where("doc_id >= 750"), weights).collect():
        text, true = docs[r["doc_id"]]
        found = {(s["kind"], s["start"], s["end"]): s["plain"] for s in r["found"]}
        assert sorted((KINDS.index(k), a, b) for (k, a, b), p in found.items() if p) == plainly(text)
        base = {s for s, p in found.items() if p}
        more = set(found) - base
        added, missed = added + len(true - base), missed + len(true - base - more)
        right, wrong = right + len(more & true), wrong + len(more - true)
        assert all(0 <= s["score"] <= 1 for s in r["found"])
        if not found:
            assert r["redacted"] == text
    assert added > 150 and missed <= 0.05 * added and wrong <= 0.03 * right, (added, missed, right, wrong)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a.b@example.com"), (3, "é a.b@example.com 10.0.0.1"), (3, "é a.b@example.com 10.0.0.1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "kind": F.lit("x"), "n": F.lit(2), "votes": F.lit(3)})
    weights = fit_personal(d)
    assert [len(w) for w in weights] == [1 + 2 * len(LABELERS[k]) + 7 for k in KINDS]
    got = personal_data(d, weights, keep=("n",)).collect()
    spans = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"], s["plain"]) for s in r["found"]], r["redacted"], r["n"]) for r in got), key=repr)
    twice = (3, [("email", 2, 17, True), ("ip", 18, 26, True)], "é <email> <ip>", 2)
    assert spans == sorted([(1, [], "", 2), (2, [], "", 2), (None, [("email", 0, 15, True)], "<email>", 2), twice, twice], key=repr)
    none = d.limit(0)
    assert cells(none).count() == 0 and personal_data(none, fit_personal(none)).count() == 0
    with pytest.raises(ValueError):
        personal_data(d, weights, keep=("found",))


def test_redact():
    assert redact("abcdef", [("ip", 1, 3), ("card", 2, 4), ("ip", 3, 4), ("phone", 4, 5)]) == "a<ip/card><phone>f"
    assert redact("", []) == "" and redact("x", []) == "x" and redact("ab", [("ip", 0, 2)]) == "<ip>"


def test_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op13_personal"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = sorted(plainly(texts[r["doc_id"]]), key=lambda s: (s[1], s[0]))
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
