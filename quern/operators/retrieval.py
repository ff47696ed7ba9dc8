"""TF-IDF retrieval and premise rankers, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import written, written_by

#: Tokens whose weights are broadcast, at most: the most frequent ones, about 20 MB. The others are joined by shuffle.
HEAD = 200_000


def term_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, tf)."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("tf"))


def term_table(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, tf), written in buckets of documents: texts are shuffled, which takes less than their tokens, and what follows by document is not."""
    n = max(4 * docs.rdd.getNumPartitions(), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    text = docs.repartition(n, F.col(doc)).select(F.col(doc).alias("doc"), F.explode(tokens).alias("token"))
    return written_by(text.groupBy("doc", "token").agg(F.count("*").alias("tf")), "doc", n, "terms")


def vocabulary(terms: DataFrame, n_docs: Column) -> DataFrame:
    """(token, df, idf): idf = ln((1 + n) / (1 + df)) + 1."""
    df = terms.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((1 + n_docs) / (1.0 + F.col("df"))) + 1)


def tfidf(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, token, weight): ln(1 + tf) idf, each document's vector of length 1."""
    raw = terms.join(vocab.select("token", "idf"), "token").withColumn("w", F.log1p("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))  # over a document's own tokens
    return raw.withColumn("norm", norm).where(F.col("norm") > 0).select("doc", "token", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_table(terms: DataFrame, vocab: DataFrame, head: int = HEAD) -> DataFrame:
    """The same of a term_table and a written vocabulary, without a shuffle of all terms.

    Terms of the head most frequent tokens meet their weights where they lie; only the others are shuffled, by token and by document. Lengths
    are sums of both, one row a document, and meet the terms in their buckets.
    """
    idf = vocab.select("token", "df", "idf")
    top = written(idf.orderBy(F.desc("df"), "token").limit(head).select("token", "idf"), "head")
    w = (F.log1p("tf") * F.col("idf")).alias("w")
    often = terms.join(F.broadcast(top), "token").select("doc", "token", w)
    rest = terms.join(F.broadcast(top), "token", "left_anti").join(idf.join(F.broadcast(top), "token", "left_anti").hint("merge"), "token")
    rest = written(rest.select("doc", "token", w), "rest")
    square = F.sum(F.col("w") * F.col("w")).alias("s")
    parts = often.groupBy("doc").agg(square).unionAll(rest.groupBy("doc").agg(square))
    norms = written(parts.groupBy("doc").agg(F.sqrt(F.sum("s")).alias("norm")).where(F.col("norm") > 0), "norms")
    weight = (F.col("w") / F.col("norm")).alias("weight")
    return often.join(norms.hint("merge"), "doc").select("doc", "token", weight).unionAll(rest.join(norms, "doc").select("doc", "token", weight))


def all_matches(queries: DataFrame, docs: DataFrame, k: int, a: str = "weight", b: str = "weight") -> DataFrame:
    """(query, doc, score, place): the k best by the sparse product of (doc, token, weight) tables, joined on tokens, ties by document. For short documents, whose weights are much alike: no bound would leave anything out.

    Documents of the same tokens and weights score alike: one for each such bag is compared, and of a bag only its k first documents
    can come in. So pairs grow with the number of different bags, not of copies.
    """
    q, d = _bags(queries, a), _bags(docs, b)
    asked = q.groupBy("bag").agg(F.min("doc").alias("query"))
    first = Window.partitionBy("bag").orderBy("doc")
    members = written(d.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).withColumn("class", F.first("doc").over(first)), "members")
    qt = asked.select("query", F.inline("bag")).withColumnRenamed("weight", "wq")
    dt = members.where(F.col("at") == 1).select("class", F.inline("bag")).withColumnRenamed("weight", "wd")
    scores = qt.join(dt, "token").groupBy("query", F.col("class").alias("doc")).agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))
    # a bag past the k-th has k documents before its own first one
    near = best_of(scores, k).select("query", F.col("doc").alias("class"), "score").join(members.select("class", "doc"), "class")
    each = asked.withColumnRenamed("query", "one").join(q.withColumnRenamed("doc", "query"), "bag").select("one", "query")
    return best_of(near, k).withColumnRenamed("query", "one").join(each, "one").select("query", "doc", "score", "place")


def _bags(vectors: DataFrame, weight: str) -> DataFrame:
    """(doc, bag): each document's tokens with their weights, in order."""
    return vectors.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("token", F.col(weight).alias("weight")))).alias("bag"))


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, place): the k best of each query's positive scores, ties by document."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc"))
    return scores.where(F.col("score") > 0).select("query", "doc", "score").withColumn("place", place).where(F.col("place") <= k)


def ranking(rows: DataFrame, premises: str, *by: str) -> DataFrame:
    """(*by, premise, n, place): premises by how often they occur, ties by name."""
    n = rows.select(*by, F.explode(premises).alias("premise")).groupBy(*by, "premise").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "premise")))


def ranked_lists(ranks: DataFrame, k: int, *by: str) -> DataFrame:
    """(*by, predicted): the first k premises in order."""
    top = ranks.where(F.col("place") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "premise"))), lambda s: s["premise"])
    return top.groupBy(*by).agg(listed.alias("predicted"))


def macro_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: macro precision, recall, F1 of these, coverage and support over rows with gold."""
    hit = F.size(F.array_intersect(F.array_distinct(gold), F.array_distinct(predicted)))
    r = rows.where(F.size(gold) > 0).select(hit.alias("tp"), F.size(F.array_distinct(gold)).alias("g"), F.size(F.array_distinct(predicted)).alias("p"))
    r = r.agg(F.coalesce(F.avg(F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)), F.lit(0.0)).alias("p"), F.coalesce(F.avg(F.col("tp") / F.col("g")), F.lit(0.0)).alias("r"),
              F.coalesce(F.avg((F.col("tp") > 0).cast("double")), F.lit(0.0)).alias("c"), F.count("*").alias("n"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return r.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round("c", 6).alias("coverage"), F.col("n").alias("support"))
