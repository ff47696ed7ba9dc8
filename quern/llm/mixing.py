"""Mixing sources to target weights by capped water-filling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Weights by a source's place in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Parts of a source whose sums decide which documents get one more repetition; each is ordered on its own.
BUCKETS = 4096
SEED = 20240


def word_count(text):
    """Words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def water_fill(sources: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target.

    share of all sizes is dealt by weight; a source is clamped at epochs times its size and the excess goes to the others
    by weight until none is above its clamp. Sources in order of clamp / weight are clamped one after another, so one
    pass of running sums over the sources finds the level: one row each in one task, which holds for millions of sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("clamp", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    # the level if this source and all after it are open and all before it are clamped
    level = (total - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= F.col("clamp"))
    found = F.min(F.when(F.col("open"), F.struct(F.col("clamp") / F.col("weight"), F.col("level")))).over(everything)
    water = F.coalesce(found["level"], F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("clamp"), F.col("weight") * water)).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, epochs: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, repeats, taken, *keep) for each row; repeats is how often the mix takes the row.

    A document is taken floor(target / source size) times, and once more if it comes first in its source's seeded order,
    as long as the words of these first ones don't pass what is left of the target by more than half a document. The
    order is by hash bucket and then by hash, so a hot source is spread over buckets and no task orders it whole.
    A null text has size 0; texts without words are taken as often as all of their source are; a null source is a source
    of its own, weighed last; null ids hash alike; repeated rows are taken each on its own; an empty table gives an empty
    result. Columns that keep doesn't name are ignored, whatever their names.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    d = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), number.alias("__hash"),
        (number % BUCKETS).cast("int").alias("__bucket"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
    )
    parts = d.groupBy("source", "__bucket").agg(F.sum("size").alias("__part"))
    order = Window.partitionBy("source").orderBy("__bucket")
    parts = parts.withColumn("__before", F.sum("__part").over(order) - F.col("__part"))
    goals = water_fill(parts.groupBy("source").agg(F.sum("__part").alias("source_size")), share, epochs, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.select(_key(F.col("source")).alias("__s"), "source_size", "target", rate.alias("__rate"))
    parts = parts.select(_key(F.col("source")).alias("__s"), F.col("__bucket").alias("__b"), "__before").join(goals, "__s")
    parts = parts.withColumn("__whole", F.floor("__rate").cast("long"))
    parts = parts.withColumn("__more", F.col("target") - F.col("__whole") * F.col("source_size") - F.col("__before"))
    both = d.withColumn("__s", _key(F.col("source"))).join(parts.withColumnRenamed("__b", "__bucket"), ["__s", "__bucket"])
    within = Window.partitionBy("__s", "__bucket").orderBy("__hash", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / F.lit(2.0) <= F.col("__more")
    repeats = (F.col("__whole") + F.when(first & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    out = both.withColumn("repeats", repeats)
    named = [F.col("__id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")]
    return out.select(*named, *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])
