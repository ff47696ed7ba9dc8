"""Global numbers for rows in order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Row numbers of a partition begin at its number times this.
_PART = 1 << 33


def numbered(df: DataFrame, *order, name: str = "row") -> DataFrame:
    """df with row, from 0 in the given order: sorted by range and written, then the counts of the partitions before are added to each row's place in its own. The counts, one for each partition, are all that meets in one place. The result reads a written table: forget it when it is done with."""
    ordered = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, before = {}, 0
    for r in counts:
        starts[r["p"]] = before
        before += r["n"]
    if not starts:
        out = ordered.withColumn(name, F.lit(0).cast("long")).drop("__at")
        out.written_at = ordered.written_at
        return out
    first = ordered.sparkSession.createDataFrame(list(starts.items()), "__p long, __first long")
    out = ordered.withColumn("__p", part.cast("long")).join(F.broadcast(first), "__p").withColumn(name, F.col("__at") - F.col("__p") * _PART + F.col("__first")).drop("__at", "__p", "__first")
    out.written_at = ordered.written_at
    return out


def numbered_in_splits(lines: DataFrame, path: str = "path", block: str = "block", small: bool = False) -> DataFrame:
    """lines with line_no, from 1 in each file, of rows as a read gives them that carry their file and where their split of it begins.

    Rows get growing numbers as they are read; a split's first and its count come from one partial aggregate, what lies before it from a
    running sum over its file's splits. small: the splits are known to be few enough to go to every task; else the join
    is planned by size.
    """
    lines = lines.withColumn("__at", F.monotonically_increasing_id())
    splits = lines.groupBy(path, block).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select(path, block, (before - F.col("__first") + 1).alias("__offset"))
    return lines.join(F.broadcast(offsets) if small else offsets, [path, block]).withColumn("line_no", F.col("__at") + F.col("__offset")).drop("__offset", "__at")
