"""Corpus statistics: tallies, distributions, summaries. Ties are always broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import forget, written

PERCENTILES = (50, 75, 90, 95, 99)


def counts_by(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """(key, count)."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("count"))


def top_n(tally: DataFrame, n: int, key: str = "key", count: str = "count") -> DataFrame:
    """The n largest counts, of equal ones the smallest keys: a bounded heap in each task, no full sort."""
    return tally.orderBy(F.col(count).desc(), F.col(key).asc()).limit(n)


#: Ranges that one round of ranks cuts a range into.
RANGES = 1024


def values_at(hist: DataFrame, ranks: list[int], low: int, high: int) -> dict[int, int]:
    """The values at 0-based ranks of a histogram (v, c) whose values lie from low to high.

    A round counts the rows of RANGES parts of each range that holds a wanted rank, and goes on in the part that holds it; so
    there are as many rounds as the span has powers of RANGES, seven at most, and what meets in one place is RANGES counts
    a rank, whatever the number of rows or distinct values.
    """
    found, open_ranges = {}, {(low, high): [(r, r) for r in set(ranks)]}
    while open_ranges:
        cuts = {(lo, hi): max(1, -(-(hi - lo + 1) // RANGES)) for lo, hi in open_ranges}
        for (lo, hi), asked in list(open_ranges.items()):
            if lo == hi:
                found |= {r: lo for r, _ in asked}
                del open_ranges[lo, hi]
        if not open_ranges:
            break
        whole = lambda x: F.lit(x).cast("decimal(20,0)")  # noqa: E731  # spans pass 64 bits
        place = F.lit(None)
        for lo, hi in open_ranges:
            part = F.call_function("div", F.col("v").cast("decimal(20,0)") - whole(lo), whole(cuts[lo, hi]))
            place = F.when(F.col("v").between(lo, hi), F.struct(F.lit(str(lo)).alias("lo"), F.lit(str(hi)).alias("hi"), part.alias("part"))).otherwise(place)
        rows = hist.select(place.alias("at"), "c").where(F.col("at").isNotNull()).groupBy("at").agg(F.sum("c").alias("c")).select("at.*", "c").collect()
        counts: dict = {}
        for r in rows:
            counts.setdefault((int(r["lo"]), int(r["hi"])), {})[r["part"]] = r["c"]
        further: dict = {}
        for (lo, hi), asked in open_ranges.items():
            width = cuts[lo, hi]
            for rank, inside in asked:
                before = 0
                for part, c in sorted(counts[lo, hi].items()):
                    if inside < before + c:
                        own = (lo + part * width, min(hi, lo + (part + 1) * width - 1))
                        further.setdefault(own, []).append((rank, inside - before))
                        break
                    before += c
        open_ranges = further
    return found


def _histogram(df: DataFrame, value: Column | str):
    """((v, c) written, its rows, sum, least and greatest value): each value once, with how often it comes."""
    v = (F.col(value) if isinstance(value, str) else value).cast("long")
    hist = written(df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c")), "values")
    c = F.col("c").cast("decimal(38,0)")
    return hist, hist.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("v") * c), F.lit(0)).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()


def distribution(df: DataFrame, value: Column | str) -> DataFrame:
    """One row: count, total, min, max, mean, median (interpolated) and nearest-rank percentiles; zeros for no rows. Ranks are found in rounds over a histogram, exactly."""
    hist, s = _histogram(df, value)
    n, names = s["n"], [f"p{p}" for p in PERCENTILES]
    nearest = {p: max(0, -(-p * n // 100) - 1) for p in PERCENTILES}
    at = values_at(hist, [(n - 1) // 2, n // 2, *nearest.values()], s["lo"], s["hi"]) if n else {}
    forget(hist)
    median = (at[(n - 1) // 2] + at[n // 2]) / 2 if n else 0.0
    row = (n, int(s["total"]), s["lo"] or 0, s["hi"] or 0, round(int(s["total"]) / n, 6) if n else 0.0, median, *(at[nearest[p]] if n else 0 for p in PERCENTILES))
    return df.sparkSession.createDataFrame([row], "count long, total long, min long, max long, mean double, median double, " + ", ".join(f"{c} long" for c in names))


def floor_rank(df: DataFrame, value: Column | str, ps: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: min, max, avg and the values at index floor((n - 1) p) of the sorted ones; nulls for no rows. Ranks are found in rounds over a histogram, exactly."""
    hist, s = _histogram(df, value)
    n = s["n"]
    places = [int((n - 1) * p) for p in ps]
    at = values_at(hist, places, s["lo"], s["hi"]) if n else {}
    forget(hist)
    row = (s["lo"], *(at.get(k) for k in places), s["hi"], round(int(s["total"]) / n, 6) if n else None)
    return df.sparkSession.createDataFrame([row], "min long, " + ", ".join(f"p{int(p * 100)} long" for p in ps) + ", max long, avg double")


def summary(df: DataFrame, name: str, type_: str, body: str, premises: str | None = None) -> DataFrame:
    """One row: rows, distinct names, how many have a type, a body, premises."""
    filled = lambda c: F.count_if(F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)) > 0)
    aggs = [F.count("*").alias("rows"), F.countDistinct(name).alias("names"), filled(type_).alias("with_type"), filled(body).alias("with_body")]
    if premises:
        aggs.append(F.count_if(F.size(premises) > 0).alias("with_premises"))
    return df.agg(*aggs)


def size_histogram(df: DataFrame, array: str) -> DataFrame:
    return df.groupBy(F.size(array).cast("long").alias("size")).agg(F.count("*").alias("count"))


def self_references(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.agg(F.count_if(F.array_contains(F.col(array), F.col(name))).alias("self_references"))


def self_edges(df: DataFrame, name: str, token: str) -> DataFrame:
    """The same from rows (name, token), repeated or not: only those that name themselves are gathered."""
    return df.where(F.col(name) == F.col(token)).agg(F.countDistinct(name).alias("self_references"))
