"""Quality by an interpolated modified Kneser-Ney n-gram model over characters (`characters`), counted from all trusted documents.

Documents are scored by perplexity a character and held against quantiles of their own language: `quality_filter`.

Beside it, `fit_quality` and `perplexities` are a model of fixed size, over a closed alphabet of 64 symbols that
characters share, as one dense table. The filter doesn't use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .characters import discounts, fit_characters, score_characters, strings
from .common import bound_batches, lean, stash

ORDER = 4
#: Languages whose quantiles are broadcast, at most.
MOST_LANGUAGES = 10_000
#: Characters whose n-grams a task holds at once.
SLICE, TOGETHER = 65_536, 2_000_000
#: Size of the closed alphabet; it bounds every table of the model, the densest at ALPHABET ** ORDER entries.
ALPHABET = 64
#: Lower-case letters of the Latin-1 languages beside a-z, and marks with a class of their own.
ACCENTED, MARKS = "àáâäãåæçèéêëìíîïñòóôöõøùúûüýÿß", ".,"
_classes = None


def _lookup():
    """Class by code point below U+0300: each lower-case letter, capitals, digits, space, line ends, marks, other marks, all else (0)."""
    global _classes
    if _classes is None:
        import numpy as np

        t = np.zeros(0x300, np.int32)
        t[0x21:0xC0] = 1
        for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED + MARKS):
            t[ord(c)] = 2 + k
        top = 2 + 26 + len(ACCENTED) + len(MARKS)
        assert top + 4 <= ALPHABET
        t[ord("A") : ord("Z") + 1] = top
        for c in ACCENTED[:-2]:
            t[ord(c.upper())] = top
        t[ord("0") : ord("9") + 1] = top + 1
        t[ord(" ")] = t[9] = t[0xA0] = top + 2
        t[10] = t[13] = top + 3
        _classes = t
    return _classes


def symbols(text: str):
    """The model's symbols of a text: a class for each character of the Latin alphabets; other characters, 0 and two symbols that tell 4,096 of them apart, neighbours of a script by the last one."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _lookup()[np.minimum(points, 0x2FF)]
    other = points > 0x2FF
    if not other.any():
        return codes
    place = np.cumsum(np.where(other, 3, 1))
    out = np.zeros(place[-1], np.int32)
    out[place[~other] - 1] = codes[~other]
    out[place[other] - 2] = points[other] // ALPHABET % ALPHABET
    out[place[other] - 1] = points[other] % ALPHABET
    return out


def _pieces(text: str):
    """The id of the n-gram that ends at each symbol of a text, of SLICE characters at a time; a text starts after line ends."""
    import numpy as np

    before = symbols("\n" * (ORDER - 1))
    for at in range(0, len(text), SLICE):
        codes = np.concatenate([before, symbols(text[at : at + SLICE])])
        before = codes[len(codes) - ORDER + 1 :]
        n = len(codes) - ORDER + 1
        ids = codes[:n].copy()
        for k in range(1, ORDER):
            ids *= ALPHABET
            ids += codes[k : k + n]
        yield ids


def gram_ids(text: str):
    import numpy as np

    return np.concatenate([np.zeros(0, np.int32), *_pieces(text)])


def count_grams(texts_df: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, c) of the highest order; TOGETHER characters or a few more hand on one row for each of their n-grams."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def counted(ids):
            gram, c = np.unique(np.concatenate(ids), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(c, pa.int64())], ["gram", "c"])

        ids, held = [], 0
        for batch in batches:
            for x in strings(batch, text_col):
                for piece in _pieces(x):
                    ids.append(piece)
                    held += len(piece)
                    if held >= TOGETHER:
                        yield counted(ids)
                        ids, held = [], 0
        if ids:
            yield counted(ids)

    return texts_df.select(text_col).mapInArrow(lean(run), "gram int, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of the observed n-grams and (context, gamma) of the contexts.

    counts: (gram, c) of the highest order. Below it, an n-gram counts as often as different characters precede it.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = stash(tables[k + 1].groupBy((F.col("gram") % ALPHABET**k).alias("gram")).agg(F.count("*").alias("c")), "grams")
    out, lower = [], None
    for k in range(1, order + 1):
        grams = tables[k].withColumn("context", F.floor(F.col("gram") / ALPHABET).cast("int"))
        d1, d2, d3 = discounts(tables[k])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = stash(grams.groupBy("context").agg(F.sum("c").alias("total"), F.sum(discount).alias("held")), "contexts")
        joined = grams.join(contexts, "context").withColumn("gamma", F.col("held") / F.col("total"))
        own = (F.col("c") - discount) / F.col("total")
        if lower is None:
            probs = joined.select("gram", (own + F.col("gamma") / ALPHABET).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            probs = joined.join(below, joined["gram"] % ALPHABET ** (k - 1) == below["suffix"]).select("gram", (own + F.col("gamma") * F.col("q")).alias("p"))
        probs = stash(probs, "probabilities")
        out.append((probs, contexts.select("context", (F.col("held") / F.col("total")).alias("gamma"))))
        lower = probs
    return out


def dense_log_probs(levels: list[tuple[DataFrame, DataFrame]]):
    """Log probability of every possible n-gram of the highest order, as float16; the closed alphabet bounds what is gathered."""
    import numpy as np

    p = None
    for k, (probs, contexts) in enumerate(levels):
        gamma = np.ones(ALPHABET**k, np.float32)
        back = contexts.toArrow()
        gamma[back.column("context").to_numpy()] = back.column("gamma").to_numpy()
        lower = p if k else np.full(ALPHABET, 1.0 / ALPHABET, np.float32)
        # a context's first class, the rest of the context, the next class
        p = np.multiply(gamma.reshape(ALPHABET if k else 1, -1, 1), lower.reshape(1, -1, ALPHABET)).reshape(-1)
        seen = probs.toArrow()
        p[seen.column("gram").to_numpy()] = seen.column("p").to_numpy()
    return np.log(p, out=p).astype(np.float16)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model's dense table from all documents labelled 1; uniform where there are none."""
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i")).distinct()
    # by shuffle at any size: the ids grow with the input, and a plan that changes with it can't be projected
    some = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("text")).join(trusted.hint("merge"), "__i", "left_semi")
    return dense_log_probs(kneser_ney(stash(count_grams(some), "grams")))


def perplexities(docs: DataFrame, table, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_chars, log_perplexity): mean negative log probability a character over the whole text; null without characters."""
    model = docs.sparkSession.sparkContext.broadcast(table)  # 2 * ALPHABET ** ORDER bytes
    names = [id_col, *keep]
    out = T.StructType([docs.schema[c] for c in names]).add("n_chars", "long").add("log_perplexity", "double")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes, values = [], []
            for x in strings(batch, "__text"):
                sizes.append(len(x))
                total = sum(float(model.value[ids].sum(dtype=np.float64)) for ids in _pieces(x))
                values.append(-total / len(x) if x else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(sizes, pa.int64()), pa.array(values, pa.float64())], [f.name for f in out])

    cols = [F.col(c).alias(f"__{i}") for i, c in enumerate(names)]
    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(lean(run), out)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
                   low: float = 0.001, high: float = 0.99) -> DataFrame:
    """(id, lang, log_perplexity, threshold, kept) for each row.

    A document is kept if its perplexity lies between the low and high quantiles of its language's trusted documents; few
    odd ones among these don't set the high one. Languages without trusted documents take the quantiles of
    all; null is a language. Null and empty texts have no perplexity and aren't kept. A perplexity that equals a quantile is kept;
    repeated rows are judged alike, and count as often as they come where they are trusted.
    """
    bound_batches(docs.sparkSession)
    levels = fit_characters(docs, labels, id_col, text_col, label_col)
    scored = stash(score_characters(docs, levels, id_col, text_col, (lang_col,)), "perplexity")
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__t")).distinct()
    known = scored.join(trusted, scored[id_col] == trusted["__t"], "left_semi").where(F.col("log_perplexity").isNotNull())
    cut = F.percentile_approx("log_perplexity", F.array(F.lit(low), F.lit(high)), F.lit(10_000)).alias("q")
    by = known.groupBy(F.col(lang_col).alias("__lang")).agg(cut)
    every = known.agg(cut).select(F.col("q").alias("__all"))
    langs = scored.select(F.col(lang_col).alias("__l")).distinct()
    langs = langs.join(by, F.col("__l").eqNullSafe(F.col("__lang")), "left").crossJoin(every).select("__l", F.coalesce("q", "__all").alias("q"))
    # as many rows as languages: a hot language isn't dealt to one task as long as they are few
    langs = stash(langs, "bounds")
    few = langs.count() <= MOST_LANGUAGES
    joined = scored.join(F.broadcast(langs) if few else langs, scored[lang_col].eqNullSafe(F.col("__l")), "left")
    least, greatest = F.col("q")[0], F.col("q")[1]
    kept = F.coalesce((F.col("log_perplexity") >= least) & (F.col("log_perplexity") <= greatest), F.lit(False))
    return joined.select(id_col, lang_col, "log_perplexity", greatest.alias("threshold"), kept.alias("kept"))
