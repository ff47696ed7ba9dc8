"""Curation: filters, keep-first and keep-last, seeded splits and samples. Orders are explicit, so results don't hang on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import fnv1a32


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, nulls being equal; map-side partial aggregation, so hot keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(df.columns)


def keep_best(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key, the first of equals."""
    return keep_first(df, keys, [-F.col(score), F.col(order)])


def min_lengths(df: DataFrame, type_: str, body: str, least_type: int = 5, least_body: int = 5) -> DataFrame:
    return df.where((F.length(F.trim(type_)) >= least_type) & (F.length(F.trim(body)) >= least_body))


def deduplicate(df: DataFrame, order: str, type_: str = "type", body: str = "body") -> DataFrame:
    """Keep-first by (pretty_qname, type, body, ast version) where there is such a column, else by (file, name, type, body)."""
    wanted = ["pretty_qname", type_, body, "type_ast_version"] if "pretty_qname" in df.columns else ["file", "name", type_, body]
    return keep_first(df, [c for c in wanted if c in df.columns], [order])


def hash_split(df: DataFrame, file: Column, module: Column, name: Column, percent: int = 90) -> DataFrame:
    """Adds bucket (0 to 99) and split: the same for a row wherever it lies."""
    key = F.concat_ws("|", F.coalesce(file, F.lit("")), F.coalesce(module, F.lit("")), F.coalesce(name, F.lit("")))
    bucket = (fnv1a32(key) % 100).cast("long")
    return df.withColumn("bucket", bucket).withColumn("split", F.when(F.col("bucket") < percent, "train").otherwise("test"))


def random_split(df: DataFrame, weights: tuple[float, float] = (0.9, 0.1), seed: int = 42) -> list[DataFrame]:
    """Spark's seeded split; it depends on how the rows are partitioned."""
    return df.randomSplit(list(weights), seed)


def sample_score(key: Column, salt: str) -> Column:
    """16 hex digits that order keys at random, alike everywhere."""
    return F.substring(F.sha1(F.concat(F.lit(salt), key)), 1, 16)


def hash_sample(df: DataFrame, key: str, k: int, salt: str) -> DataFrame:
    """The k rows whose salted hash comes first, ties by key."""
    return df.withColumn("score", sample_score(F.col(key), salt)).orderBy("score", key).limit(k)


def hash_sample_capped(df: DataFrame, key: str, group: str, k: int, cap: int, salt: str, oversample: int = 5) -> DataFrame:
    """k rows of the first k * oversample, at most cap of a group; the window runs over that many rows only."""
    some = hash_sample(df, key, max(k * oversample, k), salt)
    place = F.row_number().over(Window.partitionBy(group).orderBy("score", key))
    return some.withColumn("place", place).where(F.col("place") <= cap).orderBy("score", key).limit(k).drop("place")


def fixture_filter(df: DataFrame, max_ast_size: int | None = None, max_row_bytes: int | None = None, simple_only: bool = False, fields: tuple[str, ...] = (), max_tree_bytes: int | None = None, at_index: bool = False) -> DataFrame:
    """Rows with a body and all the fields, within the limits; at_index: only bodies that count to a binder. A limit on the tree lets rows without one go."""
    keep = (F.col("has_body") == F.lit(True)) & (F.length(F.trim("body")) > 0)
    for c in fields:
        keep &= F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) > 0
    if at_index:
        keep &= F.trim("body").rlike(r"^@\d+$")
    if max_tree_bytes is not None:
        keep &= F.coalesce(F.octet_length("type_ast"), F.lit(max_tree_bytes + 1)) <= max_tree_bytes
    if simple_only:
        keep &= ~F.col("body").rlike(r"\s")
    if max_ast_size is not None:
        keep &= F.col("ast_size") <= max_ast_size
    if max_row_bytes is not None:
        keep &= F.octet_length(F.to_json(F.struct(*df.columns))) <= max_row_bytes
    return df.where(keep)


def largest_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    return df.select(key, F.octet_length(text).cast("long").alias("bytes")).orderBy(F.col("bytes").desc(), key).limit(n)


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label."""
    return df.where(F.col(label).isNotNull())


def only_ids(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """Rows of these ids; without ids, all."""
    return df if ids is None else df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def available(df: DataFrame, source: str, ready: tuple[str, ...], path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, the others): a row is available if its source is ready and its path is one of files (path). The two parts are all rows, once."""
    there = files.select(F.col("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
    d = df.join(there, df[path] == there["__path"], "left")
    ok = F.coalesce(F.col(source).isin(*ready) & F.col("__there"), F.lit(False))
    return d.where(ok).select(df.columns), d.where(~ok).select(df.columns)


def first_emitted(df: DataFrame, order: str, n: int = 200) -> DataFrame:
    """The first n rows in input order, after all filters: a bounded heap a task."""
    return df.orderBy(order).limit(n)


def in_document_order(df: DataFrame, keys: tuple[str, ...] = ("pretty_qname", "module", "name", "goal", "target"), cap: int | None = None) -> DataFrame:
    """Rows by these keys, null like empty text, and at most cap of them."""
    ordered = df.orderBy(*[F.coalesce(F.col(k), F.lit("")) for k in keys])
    return ordered if cap is None else ordered.limit(cap)


def first_of_shards(lines: DataFrame, shard: str, order: str, shards: int, rows: int) -> DataFrame:
    """The first rows lines of the first shards by name: the names are few, the lines come by a bounded heap."""
    names = lines.select(shard).distinct().orderBy(shard).limit(shards)
    return lines.join(F.broadcast(names), shard, "left_semi").orderBy(shard, order).limit(rows)


def never_empty_test(train: DataFrame, test: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): if test has no rows, train's last one moves there."""
    if train.isEmpty() or not test.isEmpty():
        return train, test
    last = train.agg(F.max(order).alias("__last"))
    joined = train.join(F.broadcast(last), F.lit(True))  # one row
    at = F.col(order) == F.col("__last")
    return joined.where(~F.coalesce(at, F.lit(False))).select(train.columns), test.unionByName(joined.where(at).select(train.columns))


def unseeded_split(df: DataFrame, weights: tuple[float, float] = (0.8, 0.2)) -> list[DataFrame]:
    """Spark's split without a seed: other rows on every run."""
    return df.randomSplit(list(weights))


def fingerprint(content: Column) -> Column:
    """SHA-1 of a text, in hex: the key that a result is remembered by."""
    return F.sha1(content)


def memo_join(asked: DataFrame, known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What was asked with what is known of it, and whether it is (cached): a lookup by the hash of the keys. Rows that repeat a key of known count once."""
    key = F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    memo = known.groupBy(key.alias("__key")).agg(F.min(value).alias(value))
    d = asked.withColumn("__key", key).join(memo, "__key", "left")
    return d.withColumn("cached", F.col(value).isNotNull()).drop("__key")
