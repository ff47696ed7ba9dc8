"""Types by structure: groups of equal trees, and an index of subtree hashes in which sub-terms and patterns are looked up by equality."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ast import ANY, canonical, subtrees
from quern.sources.shared import forget, written


def matching_types(trees: DataFrame, key: str, ast: str) -> DataFrame:
    """(key, group): definitions whose type trees have one structure, names aside; group is the smallest key of the structure. Rows without a tree, or whose tree is no JSON, are in no group."""
    d = written(trees.select(F.col(key).alias("__key"), F.sha1(canonical(F.col(ast))).alias("__tree")), "trees").where(F.col("__tree").isNotNull())
    least = d.groupBy("__tree").agg(F.min("__key").alias("group"))
    return d.join(least, "__tree").select(F.col("__key").alias(key), "group")


def type_index(trees: DataFrame, key: str, ast: str) -> DataFrame:
    """(key, path, hash, label, size) of every object and list of every tree. A narrow pass, a row at a time."""
    return trees.select(F.col(key).alias("key"), F.inline(subtrees(F.col(ast))))


def write_type_index(trees: DataFrame, key: str, ast: str, folder: str) -> None:
    """The index as two Parquet tables, by hash and by label, each in ranges of its column: a lookup reads the files, and of them the row groups, that can hold the value. Trees are walked once: ranges are found, and both tables made, from the written sub-terms."""
    index = written(type_index(trees, key, ast), "subtrees")
    for by in ("hash", "label"):
        index.select("key", "path", by).repartitionByRange(by).sortWithinPartitions(by, "key").write.mode("overwrite").parquet(f"{folder}/{by}")
    forget(index)


def read_type_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {by: spark.read.parquet(f"{folder}/{by}") for by in ("hash", "label")}


def requirements(spark: SparkSession, pattern: str) -> list[tuple[str, str, str]]:
    """(path, column, value) that a tree must have at a place to match there: the whole subtrees that hold no wildcard, and the own level of those that do. Few, as the pattern is short."""
    rows = spark.range(1).select(F.explode(subtrees(F.lit(pattern))).alias("s")).select("s.*").collect()
    if not rows:
        raise ValueError(f"no type tree: {pattern[:100]}")
    any_hash = spark.range(1).select(F.sha1(F.lit(json.dumps(json.loads(ANY), separators=(",", ":"))))).first()[0]
    inside = lambda a, b: a != b and a.startswith(b) and a[len(b)] in ".["
    wild = [r["path"] for r in rows if r["hash"] == any_hash]
    open_paths = {r["path"] for r in rows if any(inside(w, r["path"]) for w in wild)}
    out = [(r["path"], "label", r["label"]) for r in rows if r["path"] in open_paths]
    closed = [r for r in rows if r["path"] not in open_paths and r["path"] not in wild]
    out += [(r["path"], "hash", r["hash"]) for r in closed if not any(inside(r["path"], c["path"]) for c in closed)]
    if not out:
        raise ValueError("the pattern is a wildcard alone: everything matches")
    return out


def find_types(index: dict[str, DataFrame], pattern: str, whole: bool = False) -> DataFrame:
    """(key, path): where trees hold the pattern, a type tree as JSON in which {"tag":"*"} stands for any type or term; whole: only whole types.

    Each requirement is a lookup by equality; a place is a match that has all of them. Names in the pattern don't count either.
    """
    spark = index["hash"].sparkSession
    found, needs = None, requirements(spark, pattern)
    for path, by, value in needs:
        tail = path[1:]
        hits = index[by].where((F.col(by) == value) & F.endswith("path", F.lit(tail)))
        place = F.left("path", F.length("path") - len(tail))
        hits = hits.select("key", place.alias("path"))
        if whole:
            hits = hits.where(F.col("path") == "$")
        found = hits if found is None else found.intersect(hits) if len(needs) == 2 else found.unionAll(hits)
    if len(needs) > 2:
        found = found.groupBy("key", "path").agg(F.count("*").alias("n")).where(F.col("n") == len(needs)).select("key", "path")
    return found
