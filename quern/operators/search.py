"""Search by name and type, and dependencies with one hop of expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK = 5
RESULT = ("pretty_qname", "pretty_name", "module", "def_kind", "type")


def contains_folded(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(text)))


def _limit(n: int | None) -> int:
    return max(1, 20 if n is None else n)


def by_name(defs: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Definitions whose short or whole name holds the text in any case, the first by name."""
    hit = contains_folded(F.col("pretty_qname"), text) | contains_folded(F.col("pretty_name"), text)
    return defs.where(hit).select(*RESULT).orderBy("pretty_qname").limit(_limit(limit))


def by_type(defs: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return defs.where(contains_folded(F.col("type"), text)).select(*RESULT).orderBy("pretty_qname").limit(_limit(limit))


def dependencies(defs: DataFrame, qname: str) -> DataFrame:
    """(ord, token) of one definition, in its order."""
    return defs.where(F.col("pretty_qname") == qname).select(F.posexplode("dependencies").alias("ord", "token"))


def expand(tokens: DataFrame, defs: DataFrame, n: int | None = None) -> DataFrame:
    """Definitions that (ord, token) rows name: those of exactly that name, else the first few whose short name it is. n: into how many partitions tokens and names are dealt, if not by the planner's sizes."""
    by = lambda d, *cols: d.repartition(n, *cols) if n else d
    names = defs.select("pretty_qname", "pretty_name", "module", "def_kind")
    tokens = by(tokens, "token")
    whole = by(names, "pretty_qname")
    if n:
        whole = whole.hint("merge")
    exact = tokens.join(whole, tokens["token"] == whole["pretty_qname"]).withColumn("match", F.lit("exact"))
    known = by(names.select(F.col("pretty_qname").alias("token")), "token").distinct()
    missed = tokens.join(known.hint("merge") if n else known, "token", "left_anti")
    brief = by(names, "pretty_name")
    short = missed.select("ord", "token").join(brief.hint("merge") if n else brief, F.col("token") == brief["pretty_name"])
    short = by(short, "ord", "token")
    place = F.row_number().over(Window.partitionBy("ord", "token").orderBy("pretty_qname"))
    short = short.withColumn("place", place).where(F.col("place") <= FALLBACK).drop("place").withColumn("match", F.lit("short"))
    return exact.select("ord", "token", *names.columns, "match").unionByName(short.select("ord", "token", *names.columns, "match"))


def definition(defs: DataFrame, qname: str) -> DataFrame:
    """The definition of exactly this name; LookupError without one."""
    found = defs.where(F.col("pretty_qname") == qname)
    if found.isEmpty():
        raise LookupError(f"no definition is named {qname}")
    return found
