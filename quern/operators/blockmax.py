"""Posting lists in blocks of bounded length with their greatest weights, and top-k search that leaves out the blocks that can't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.ordinals import numbered
from quern.operators.retrieval import best_of
from quern.sources.shared import forget, written

#: Postings of a block, at most.
SIZE = 256
#: What sums of weights in another order may differ by.
SLACK = 1e-8


def posting_blocks(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(token, block, n, top, postings array<struct<doc, weight>>) of (doc, token, weight) with positive weights.

    A token's documents go by falling weight, then document, and are cut where the number of the row among all tokens' rows passes a
    multiple of size. A frequent token's list is many rows, and no task sorts it alone. postings are in order of
    documents, top is the greatest weight. The result reads a written table: forget it when it is done with.
    """
    rows = numbered(vectors.where((F.col("weight") > 0) & F.col("doc").isNotNull()).select("doc", "token", "weight"), "token", F.desc("weight"), "doc")
    block = F.floor(F.col("row") / size).alias("block")
    # two lists of numbers take a third less than one of pairs; neither column has nulls, so they are in step
    lists = rows.groupBy("token", block).agg(F.count("*").cast("int").alias("n"), F.max("weight").alias("top"), F.collect_list("doc").alias("doc"), F.collect_list("weight").alias("weight"))
    out = lists.select("token", "block", "n", "top", F.array_sort(F.arrays_zip("doc", "weight")).alias("postings"))
    out.written_at = rows.written_at
    return out


def write_postings(vectors: DataFrame, folder: str, size: int = SIZE) -> None:
    """The blocks in ranges of (token, block), so a lookup reads the row groups of its tokens, and the vectors as they come, to complete scores."""
    vectors.where(F.col("weight") > 0).select("doc", "token", "weight").write.mode("overwrite").parquet(f"{folder}/vectors")
    blocks = posting_blocks(vectors.sparkSession.read.parquet(f"{folder}/vectors"), size)
    blocks.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{folder}/blocks")
    forget(blocks)


def read_postings(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "vectors")}


def _read(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, doc, score): what the wanted (query, token, block, wq) add to each document."""
    rows = wanted.select("query", "token", "block", "wq").join(blocks.select("token", "block", "postings"), ["token", "block"])
    each = rows.select("query", "wq", F.inline("postings"))
    return each.groupBy("query", "doc").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query, kth): the k-th best score, of queries that have so many."""
    by = Window.partitionBy("query").orderBy(F.desc("score"))
    return scores.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("query", F.col("score").alias("kth"))


def needed_blocks(index: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """(query, token, wq, block, n, can, open, first, needed, kth), written: every block of a query's tokens, and whether it has to be read.

    can is the most that a block can add to a document's score, open what a document that no block before has (in order of can) can
    reach at most. The first block of each token gives k documents with a score already; where open falls below the k-th of
    these, the other blocks hold nothing that could come in. Only the directory is read for all blocks, their postings for the first ones.
    """
    q = queries.where(F.col("weight") > 0).select(F.col("doc").alias("query"), "token", F.col("weight").alias("wq"))
    can = q.join(index["blocks"].select("token", "block", "n", "top"), "token").withColumn("can", F.col("wq") * F.col("top"))
    of_token = Window.partitionBy("query", "token").orderBy("block")
    can = can.withColumn("first", F.row_number().over(of_token) == 1).withColumn("falls", F.col("can") - F.coalesce(F.lead("can").over(of_token), F.lit(0.0)))
    before = Window.partitionBy("query").orderBy(F.desc("can"), "token", "block").rowsBetween(Window.unboundedPreceding, -1)
    most = F.sum(F.when(F.col("first"), F.col("can")).otherwise(0.0)).over(Window.partitionBy("query"))
    can = written(can.withColumn("open", most - F.coalesce(F.sum("falls").over(before), F.lit(0.0))).drop("falls"), "blocks")
    kth = _kth(_read(index["blocks"], can.where("first")), k)
    needed = F.col("kth").isNull() | (F.col("open") * (1 + 1e-9) + SLACK >= F.col("kth"))
    out = written(can.join(kth, "query", "left").withColumn("needed", needed), "needed")
    forget(can)
    return out


def top_matches(index: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, place): the k best by the sparse product with (doc, token, weight) queries, ties by document; the same as of all products.

    The needed blocks are read; what they leave out can add a query's remainder at most. Documents whose score could pass
    the k-th with it are completed from their own vectors. Rows that are read twice are few: first blocks, and candidates' tokens.
    """
    blocks = needed_blocks(index, queries, k)
    left = blocks.groupBy("query").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("open"))), F.lit(0.0)).alias("left"), F.max("kth").alias("least"))
    some = written(_read(index["blocks"], blocks.where("needed")), "scores")
    bound = left.join(_kth(some, k), "query", "left").select("query", "left", F.greatest(F.coalesce("least", F.lit(0.0)), F.coalesce("kth", F.lit(0.0))).alias("least"))
    able = some.join(bound, "query").where((F.col("left") <= 0) | (F.col("score") + F.col("left") * (1 + 1e-9) + SLACK >= F.col("least")))
    done = able.where(F.col("left") <= 0).select("query", "doc", "score")
    q = queries.select(F.col("doc").alias("query"), "token", F.col("weight").alias("wq"))
    # only what some query asks for is dealt out, by document; a written table of queries is known to be small and met where its candidates lie
    vectors = index["vectors"].join(q.select("token").distinct(), "token", "left_semi")
    whole = able.where(F.col("left") > 0).select("query", "doc").join(vectors, "doc").join(q, ["query", "token"])
    whole = whole.groupBy("query", "doc").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return best_of(done.unionAll(whole), k)
