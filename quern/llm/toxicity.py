"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings is fitted to a bounded sample of labelled documents. In each of their
sentences that names a group, the group's term is swapped for each other of its kind; the swapped sentence's features less
the sentence's own are a row of a table, and the mean squared change of the score over these rows is part of the loss. So
a neutral mention of a group moves no score, however labels and groups happen to go together.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean, texts

#: Labelled documents of each class that the model is fitted to, at most: those whose hash comes first; longer texts than this, in bytes, aren't learnt from.
MAX_LABELLED, MAX_BYTES = 2_500, 32_768
#: A feature is weighed if so many of these documents hold it, and its count among the toxic ones is so many deviations from what chance gives.
LEAST, DEVIATIONS = 4, 4.0
#: Identity terms that stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)
#: Letters and digits of any script.
_words = re.compile(r"[^\W_]+").findall
_sentences = re.compile(r"[.!?\n]+").split


def features(words) -> set[str]:
    """Lower-cased words, and as "ab*" the first 4 and 5 characters of those that are longer."""
    words = set(words)
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


#: All that a term may be swapped for: a term of two languages has the others of both its groups.
KIN = {t: [x for group in IDENTITY if t in group for x in group if x != t] for every in IDENTITY for t in every}


def swapped(sentence: list[str]) -> list[tuple[set[str], set[str]]]:
    """For each identity term of a sentence and each other of its kind, what the swap takes from and gives to the sentence's features."""
    out, own = [], features(sentence)
    for term in sorted(set(sentence) & KIN.keys()):
        for other in KIN[term]:
            now = features([other if w == term else w for w in sentence])
            out.append((own - now, now - own))
    return out


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int):
    """(id, label, words, sentences that name a group) of the sampled documents, and the class counts among all labels to learn from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("__y"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for y in (0, 1):
        chosen += [(r[0], y) for r in known.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).select(id_col).limit(most).collect()]
    schema = T.StructType([T.StructField("__i", labels.schema[id_col].dataType), T.StructField("__y", T.IntegerType())])
    picked = docs.sparkSession.createDataFrame(chosen, schema)  # 2 * most rows at most, so it can be broadcast

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words, sentences = [], []
            for raw in texts(batch, "__text"):
                low = raw.decode().lower()
                words.append(sorted(set(_words(low))))
                own = [_words(s) for s in _sentences(low)] if not KIN.keys().isdisjoint(words[-1]) else []
                sentences.append([s for s in own if not KIN.keys().isdisjoint(s)])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__i"), batch.column("__y"), pa.array(words, strings), pa.array(sentences, pa.list_(strings))], ["i", "y", "words", "sentences"])

    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("i", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("words", strings), T.StructField("sentences", T.ArrayType(strings))])
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("__i"), text.alias("__text")).where(text.isNull() | (F.octet_length(text) <= MAX_BYTES))
    return d.join(F.broadcast(picked), "__i").mapInArrow(lean(run), schema), counts


class _Table:
    """A sparse table: values at (row, column)."""

    def __init__(self, rows, cols, values, shape):
        import numpy as np

        self.rows, self.cols, self.values, self.shape = np.asarray(rows, np.int64), np.asarray(cols, np.int64), np.asarray(values, float), shape

    def __matmul__(self, w):
        import numpy as np

        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0])

    def back(self, e):
        """The transposed table times e."""
        import numpy as np

        return np.bincount(self.cols, self.values * e[self.rows], self.shape[1])


def design(rows, least: float = LEAST, deviations: float = DEVIATIONS):
    """(features, documents by features, swaps by features) of sampled rows: each swap's row is what the score of its sentence changes by, divided by the square root of their number."""
    import numpy as np

    y = np.array([r["y"] for r in rows], float)
    found: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        for w in features(r["words"]):
            found.setdefault(w, []).append(k)
    n1, n, chosen = y.sum(), len(y), []
    for w, at in found.items():
        if len(at) >= least:
            df = len(at)
            expect = df * n1 / n
            z = abs(y[at].sum() - expect) / math.sqrt(max(1e-9, expect * (1 - n1 / n) * (1 - df / (n + 1)) + 0.5))
            if z >= deviations:
                chosen.append(w)
    chosen = sorted({*chosen, *(f for t in KIN for f in features([t]) if f in found)})
    index = {w: k for k, w in enumerate(chosen)}
    x = _Table([k for w in chosen for k in found[w]], [index[w] for w in chosen for _ in found[w]], [1.0] * sum(len(found[w]) for w in chosen), (n, len(chosen)))
    swaps = Counter()
    for r in rows:
        for s in r["sentences"]:
            for gone, come in swapped(s):
                swaps[tuple(sorted(index[w] for w in gone if w in index)), tuple(sorted(index[w] for w in come if w in index))] += 1
    at, cols, values = [], [], []
    for k, ((gone, come), times) in enumerate(sorted(swaps.items())):
        share = math.sqrt(times / swaps.total())
        at += [k] * (len(gone) + len(come))
        cols += [*gone, *come]
        values += [-share] * len(gone) + [share] * len(come)
    return chosen, x, _Table(at, cols, values, (max(1, len(swaps)), len(chosen)))


def loss(w, b: float, x: _Table, d: _Table, y, weight, penalty: float, ridge: float):
    """(value, gradient by the weights, gradient by the intercept): weighted log loss + penalty / 2 * mean squared change by a swap + ridge / 2 * squared weights."""
    import numpy as np

    s = np.clip(x @ w + b, -40, 40)
    e = weight * (1 / (1 + np.exp(-s)) - y)
    change = d @ w
    value = float((weight * (np.logaddexp(0, s) - y * s)).sum() + penalty / 2 * (change @ change) + ridge / 2 * (w @ w))
    return value, x.back(e) + penalty * d.back(change) + ridge * w, float(e.sum())


def _fit(rows, counts: dict[int, int], penalty: float, ridge: float, rounds: int) -> tuple[dict[str, float], float]:
    """Weights of features and the intercept: gradient descent with momentum."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (r["i"], r["words"]))
    y = np.array([r["y"] for r in rows], float)
    if not len(rows) or y.min() == y.max():  # nothing to tell apart
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return {}, math.log(share / (1 - share))
    words, x, d = design(rows)
    n, n1 = len(y), y.sum()
    # each class weighs as much as it does among all labels to learn from
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / n1, (1 - share) / (n - n1))
    w, b, vw, vb = np.zeros(len(words)), math.log(share / (1 - share)), np.zeros(len(words)), 0.0
    vec, one, top = np.ones(len(words)), 1.0, 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        e = 0.25 * weight * (x @ vec + one)
        u, c = x.back(e) + penalty * d.back(d @ vec) + ridge * vec, float(e.sum())
        size = math.sqrt(u @ u + c * c)
        top = size / math.sqrt(vec @ vec + one * one)
        vec, one = u / size, c / size
    step = 0.9 / top
    for k in range(rounds):
        m = k / (k + 3)
        wl, bl = w + m * vw, b + m * vb
        _, gw, gb = loss(wl, bl, x, d, y, weight, penalty, ridge)
        nw, nb = wl - step * gw, bl - step * gb
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return dict(zip(words, w.tolist(), strict=True)), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED,
                 penalty: float = 10.0, ridge: float = 3e-5, rounds: int = 1000) -> tuple[dict[str, float], float]:
    """The model: weights by feature, and the intercept. Labels that aren't 0 or 1, of held-out or of null ids aren't used; of several labels of one id the highest counts. Rows that repeat an id are learnt from each; null texts count as empty; extra columns are ignored. Without both labels, or of empty tables, the score is one number."""
    bound_batches(docs.sparkSession)
    sample, counts = _sample(docs, labels, id_col, text_col, label_col, most)
    rows = sample.toArrow().to_pylist()  # of 2 * most documents of MAX_BYTES at most
    return _fit(rows, counts, penalty, ridge, rounds)


def score_texts(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """(id, *keep, score) for each row: the probability that the whole text is toxic.

    A null text counts as empty and gets the model's score without words; repeated rows get one score, null ids stay
    null; an empty table gives an empty result. Columns that keep doesn't name are ignored, whatever their names; score
    is a name that keep doesn't hold. Only the text enters a score. A narrow map.
    """
    weights, base = model
    names = [id_col, *keep]
    if score in names:
        raise ValueError(f"rename {score}: results have this name")
    bound_batches(docs.sparkSession)
    out = T.StructType([docs.schema[c] for c in names]).add(score, "double")
    text_at = names.index(text_col) if text_col in names else len(names)  # a text goes to Python once

    def run(batches):
        import pyarrow as pa

        known, get = weights.keys(), weights.__getitem__
        for batch in batches:
            scores = []
            for raw in texts(batch, f"__{text_at}"):
                s = math.fsum([base, *map(get, known & features(_words(raw.decode().lower())))])
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, s)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(scores, pa.float64())], [f.name for f in out])

    cols = [F.col(c).alias(f"__{i}") for i, c in enumerate([*names, text_col][: max(len(names), text_at + 1)])]
    return docs.select(*cols).mapInArrow(lean(run), out)
