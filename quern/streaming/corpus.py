"""A corpus index kept up by a stream of files: the last row of each key, bad lines counted and named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.curate import keep_last
from quern.operators.ordinals import numbered_in_splits
from quern.sources.readers import judged, split_lines
from quern.sources.shared import forget, hadoop_path, written
from quern.sources.writers import read_atomic, write_atomic

#: Batches whose own tables are read beside the base before they are merged into it.
MOST_DELTAS = 16


def _delta(folder: str, kind: str, batch: int) -> str:
    return f"{folder}/{kind}/batch={batch:012d}"


def _batches(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Batches whose table of this kind is whole."""
    fs, path = hadoop_path(spark, f"{folder}/{kind}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(hadoop_path(spark, f"{folder}/{kind}/{n}/_SUCCESS")[1]))


def _table(spark: SparkSession, folder: str, kind: str, schema: T.StructType) -> DataFrame:
    """What batches have written: the base, if one was made, and the deltas after it."""
    base, upto = None, -1
    try:
        base = read_atomic(spark, f"{folder}/{kind}-base")
        upto = base.agg(F.max("__batch")).first()[0]
    except FileNotFoundError:
        pass
    out = base.drop("__batch").where(F.col("path").isNotNull()) if base is not None else spark.createDataFrame([], schema)
    later = [_delta(folder, kind, b) for b in _batches(spark, folder, kind) if b > upto]
    return out.select(*schema.names).unionByName(spark.read.schema(schema).parquet(*later)) if later else out.select(*schema.names)


def _merge(spark: SparkSession, folder: str, kind: str, schema: T.StructType, key: str | None) -> None:
    """Make the deltas part of the base. The base names the last batch in it (a row without a path), so a delta that is still there isn't read twice."""
    done = _batches(spark, folder, kind)
    whole = _table(spark, folder, kind, schema)
    whole = written(keep_last(whole, [key], ["path", "line_no"]).select(*schema.names) if key else whole, "merged")
    upto = spark.createDataFrame([(done[-1],)], "__batch long")
    write_atomic(whole.withColumn("__batch", F.lit(None).cast("long")).unionByName(upto, allowMissingColumns=True), f"{folder}/{kind}-base")
    forget(whole)
    for b in done:
        fs, path = hadoop_path(spark, _delta(folder, kind, b))
        fs.delete(path, True)


def _wide(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType())])


BAD = T.StructType().add("path", "string").add("line_no", "long")


def follow_corpus(spark: SparkSession, source: str, schema: T.StructType, key: str, folder: str, most_files: int = 1000, most_deltas: int = MOST_DELTAS) -> None:
    """Takes the files of source that no batch has taken yet, a batch after the other, into the index under folder, and stops.

    Each batch writes its last row of each key, and its bad lines, to tables named by the batch: one that is run again after a
    failure overwrites its own, so everything counts once. The last row of a key is that of the greatest (path, line), whenever it came:
    a late file with a smaller path changes nothing that a later one said, and the index is that of one read over all files. After
    most_deltas batches the tables are merged into one whose replacement readers see whole or not at all. A batch costs what
    it holds, not what the index holds.
    """

    def take(lines: DataFrame, batch: int) -> None:
        own = lines.sparkSession
        if batch in _batches(own, folder, "bad"):
            return  # it was finished, but for the note that it was
        read = written(judged(numbered_in_splits(lines), schema, key), "lines")
        rows = read.where(~F.col("bad")).select(*[F.col(f"r.{f.name}") for f in schema], "path", "line_no")
        keep_last(rows, [key], ["path", "line_no"]).select(*_wide(schema).names).write.mode("overwrite").parquet(_delta(folder, "rows", batch))
        read.where("bad").select("path", "line_no").write.mode("overwrite").parquet(_delta(folder, "bad", batch))
        forget(read)

    stream = split_lines(spark.readStream.option("maxFilesPerTrigger", most_files).text(source))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    if len(_batches(spark, folder, "rows")) > most_deltas:
        _merge(spark, folder, "rows", _wide(schema), key)
        _merge(spark, folder, "bad", BAD, None)


def followed_index(spark: SparkSession, folder: str, schema: T.StructType, key: str, samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the last row of each key, one row: bad lines and the first of them as path:line), as corpus_index gives them for all files that the stream has taken."""
    rows, bad = _table(spark, folder, "rows", _wide(schema)), _table(spark, folder, "bad", BAD)
    first = bad.orderBy("path", "line_no").limit(samples).agg(F.array_sort(F.collect_list(F.struct("path", "line_no"))).alias("l"))
    said = first.select(F.transform("l", lambda x: F.concat(x["path"], F.lit(":"), x["line_no"].cast("string"))).alias("samples"))
    return keep_last(rows, [key], ["path", "line_no"]).select(*schema.names), bad.agg(F.count("*").alias("bad_lines")).crossJoin(said)  # one row each
