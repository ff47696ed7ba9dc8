"""An interpolated modified Kneser-Ney model over characters: each code point is a symbol of its own, seen or not.

An n-gram is (context, symbol): the code points before the last one, 21 bits each in one number, and the last one. N-grams,
contexts and continuation counts are tables dealt out by key; joins of these shards give every observed n-gram's
probability and every context's back-off weight, and by these the log probability of every n-gram that any text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, lean, stash

ORDER = 4
#: Bits of a code point, and how many there are: an unseen one's probability backs off to one of as many.
BITS, POINTS = 21, 0x110000
#: Characters whose n-grams a task holds at once, and n-grams whose counts it holds.
SLICE, HELD = 1_000_000, 1_000_000
#: N-grams whose log probabilities are broadcast, at most (20 bytes each); texts' other n-grams are joined by shuffle.
FREQUENT = 1_000_000
#: Log probabilities are whole numbers of this part, so sums don't depend on their order.
UNIT = 1 << 24


def strings(batch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def _ngrams(held):
    """(number of its text, context, symbol) of each character of pieces (number, characters with ORDER - 1 before)."""
    import numpy as np

    n = ORDER - 1
    points = np.frombuffer("".join(x for _, x in held).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    sizes = np.array([len(x) for _, x in held])
    own = np.ones(len(points), bool)
    own[((np.cumsum(sizes) - sizes)[:, None] + np.arange(n)).ravel()] = False
    context = np.zeros(len(points) - n, np.int64)
    for k in range(n):
        context <<= BITS
        context |= points[k : len(points) - n + k]
    own = own[n:]
    return np.repeat([i for i, _ in held], sizes)[n:][own], context[own], points[n:][own]


def ngrams(texts):
    """The n-grams of texts, SLICE characters or a few more at a time; a text starts after line ends."""
    held, size = [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x), SLICE):
            held.append((i, "\n" * (ORDER - 1 - at) + x[max(at - ORDER + 1, 0) : at + SLICE]))
            size += len(held[-1][1])
            if size >= SLICE:
                yield _ngrams(held)
                held, size = [], 0
    if held:
        yield _ngrams(held)


def distinct(context, symbol):
    """(which of the distinct n-grams each one is, their contexts, their symbols)."""
    import pyarrow as pa

    known = pa.array(context).dictionary_encode()
    both = pa.array((known.indices.to_numpy().astype("int64") << BITS) | symbol).dictionary_encode()
    pairs = both.dictionary.to_numpy()
    return both.indices.to_numpy(), known.dictionary.to_numpy()[pairs >> BITS], pairs & ((1 << BITS) - 1)


def count_ngrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, symbol, c) of the highest order; a task hands on its n-grams once it holds HELD of them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def summed(parts):
            context, symbol, c = map(np.concatenate, zip(*parts, strict=True))
            which, context, symbol = distinct(context, symbol)
            return context, symbol, np.bincount(which, c, len(context)).astype(np.int64)

        def made(context, symbol, c):
            return pa.RecordBatch.from_arrays([pa.array(context), pa.array(symbol.astype(np.int32)), pa.array(c)], ["context", "symbol", "c"])

        parts, held = [], 0
        for _, context, symbol in ngrams(x for batch in batches for x in strings(batch, text_col)):
            which, context, symbol = distinct(context, symbol)
            parts.append((context, symbol, np.bincount(which, minlength=len(context)).astype(np.int64)))
            held += len(context)
            if held >= HELD:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held >= HELD // 2:
                    yield made(*parts[0])
                    parts, held = [], 0
        if parts:
            yield made(*summed(parts))

    rows = docs.select(text_col).mapInArrow(lean(run), "context long, symbol int, c long")
    return rows.groupBy("context", "symbol").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified discounts for counts of 1, 2 and over 2, from how many n-grams occur 1 to 4 times."""
    n = {r["c"]: r["n"] for r in counts.where(F.col("c") <= 4).groupBy("c").agg(F.count("*").alias("n")).collect()}
    n = [max(n.get(k, 0), 1) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3)]


def _last(order: int) -> Column:
    """The context of an n-gram's last `order` characters."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _backed(grams: DataFrame, lower: DataFrame, order: int) -> DataFrame:
    """grams with q, the probability of their last `order` characters."""
    below = lower.select(F.col("context").alias("__x"), F.col("symbol").alias("__s"), F.col("p").alias("q"))
    return grams.join(below, (_last(order) == F.col("__x")) & (F.col("symbol") == F.col("__s")), "left").drop("__x", "__s")


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (context, symbol, p) of the observed n-grams and (context, gamma) of the contexts.

    counts: (context, symbol, c) of the highest order. Below it, an n-gram counts as often as different characters precede it.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stash(tables[k + 1].groupBy(_last(k).alias("context"), "symbol").agg(F.count("*").alias("c")), "ngrams")
    out, lower = [], None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = stash(tables[k].groupBy("context").agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("gamma")), "contexts")
        joined = tables[k].join(contexts, "context")
        joined = joined.withColumn("q", F.lit(1.0 / POINTS)) if lower is None else _backed(joined, lower, k - 1)
        lower = stash(joined.select("context", "symbol", ((F.col("c") - discount) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), "probabilities")
        out.append((lower, contexts))
    for k in range(1, ORDER):
        drop(tables[k])
    return out


def log_probabilities(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """grams (context, symbol, ...) with log, their log probabilities in parts of UNIT: by the highest order that has seen them, and the weights of the contexts above."""
    out = grams.withColumn("__p", F.lit(1.0 / POINTS))
    for k, (probs, contexts) in enumerate(levels, 1):
        weights = contexts.select(F.col("context").alias("__x"), "gamma")
        if k == 1:  # a row for each code point at most, and one row
            probs, weights = F.broadcast(probs), F.broadcast(weights)
        out = _backed(out, probs, k).join(weights, _last(k) == F.col("__x"), "left")
        out = out.withColumn("__p", F.coalesce("q", F.coalesce("gamma", F.lit(1.0)) * F.col("__p"))).drop("q", "__x", "gamma")
    return out.withColumn("log", F.round(F.log("__p") * UNIT).cast("int")).drop("__p")


def fit_characters(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[DataFrame, DataFrame]]:
    """The model's tables, from all documents labelled 1; without any, all is unseen."""
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i")).distinct()
    # by shuffle at any size: the ids grow with the input, and a plan that changes with it can't be projected
    some = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("text")).join(trusted.hint("merge"), "__i", "left_semi")
    counts = stash(count_ngrams(some), "ngrams", tidy=True)
    levels = kneser_ney(counts)
    drop(counts)
    return levels


class Frequent:
    """Log probabilities of the n-grams that are broadcast."""

    def __init__(self, context, symbol, log):
        import numpy as np

        order = np.lexsort((symbol, context))
        self.contexts, place = np.unique(context, return_inverse=True)
        self.keys = ((place << BITS) | symbol)[order]
        self.logs = log[order].astype(np.int32)

    def __call__(self, context, symbol):
        """(found, log or 0) of each."""
        import numpy as np

        if not len(self.keys):
            return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        place = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        keys = (place << BITS) | symbol
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.contexts[place] == context) & (self.keys[at] == keys)
        return found, np.where(found, self.logs[at], 0).astype(np.int64)


def _frequent(logs: DataFrame, most: int) -> tuple[Frequent, int]:
    """The most frequent n-grams, and how often one must occur to be among them: a power of two, doubled until they are few enough."""
    tally = {r["e"]: r["n"] for r in logs.groupBy(F.floor(F.log2("c")).alias("e")).agg(F.count("*").alias("n")).collect()}
    least, n = max(tally, default=-1) + 1, 0
    while least > 0 and n + tally.get(least - 1, 0) <= most:
        least -= 1
        n += tally.get(least, 0)
    some = logs.where(F.col("c") >= 2**least).select("context", "symbol", "log").toArrow()
    return Frequent(some.column("context").to_numpy(), some.column("symbol").to_numpy().astype("int64"), some.column("log").to_numpy()), 2**least


def character_perplexities(docs: DataFrame, logs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = FREQUENT) -> DataFrame:
    """(id, *keep, n_chars, log_perplexity): mean negative log probability a character over the whole text; null without characters.

    logs: (context, symbol, c, log) of all n-grams of docs. The frequent ones are met where the texts lie; each document's
    others are rows, joined with logs by shuffle.
    """
    frequent, least = _frequent(logs, most)
    model = docs.sparkSession.sparkContext.broadcast(frequent)
    names = [id_col, *keep]
    rare = T.ArrayType(T.StructType().add("context", "long").add("symbol", "integer").add("n", "long"))
    out = T.StructType([T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(names)]).add("n_chars", "long").add("met", "long").add("rare", rare)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = strings(batch, "__text")
            met, others = np.zeros(len(texts), np.int64), []
            for owner, context, symbol in ngrams(texts):
                which, context, symbol = distinct(context, symbol)
                found, log = model.value(context, symbol)
                met += np.bincount(owner, log[which], len(texts)).astype(np.int64)  # whole numbers below 2 ** 53
                if not found.all():
                    left = ~found[which]
                    pairs, n = np.unique(owner[left] * len(context) + which[left], return_counts=True)
                    others.append((pairs // len(context), context[pairs % len(context)], symbol[pairs % len(context)], n))
            owner, context, symbol, n = map(np.concatenate, zip(*others, strict=True)) if others else [np.zeros(0, np.int64)] * 4
            ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(context), pa.array(symbol.astype(np.int32)), pa.array(n)], ["context", "symbol", "n"])
            columns = [*[batch.column(i) for i in range(len(names))], pa.array([len(x) for x in texts], pa.int64()), pa.array(met), pa.ListArray.from_arrays(pa.array(ends), parts)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    cols = [F.col(c).alias(f"__{i}") for i, c in enumerate(names)]
    met = docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(lean(run), out)
    met = stash(met.withColumn("__row", F.monotonically_increasing_id()), "met")
    asked = met.select("__row", F.inline("rare"))
    joined = asked.join(logs.where(F.col("c") < least).select("context", "symbol", "log"), ["context", "symbol"])
    sums = joined.groupBy("__row").agg(F.sum(F.col("n") * F.col("log")).alias("joined"))
    value = -(F.col("met") + F.coalesce("joined", F.lit(0))) / (F.lit(float(UNIT)) * F.col("n_chars"))
    scored = met.join(sums, "__row", "left")
    return scored.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)], "n_chars", F.when(F.col("n_chars") > 0, value).alias("log_perplexity"))


def score_characters(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = FREQUENT) -> DataFrame:
    """character_perplexities of docs by a model's tables: each n-gram of docs gets its probability once, however many texts hold it."""
    logs = stash(log_probabilities(stash(count_ngrams(docs, text_col), "ngrams"), levels), "logs", tidy=True)
    return character_perplexities(docs, logs, id_col, text_col, keep, most)
