"""Evaluation ledgers: outcomes, rates, timing splits, candidate and probe ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phases of a call, and those that ask the checker.
PHASES = ("proposal", "check_file", "get_goal", "fill_hole", "final_check")
CHECKED = ("check_file", "get_goal", "fill_hole", "final_check")


def outcome(passed: Column, expected_fail: Column) -> Column:
    return F.when(expected_fail & passed, "xpass").when(expected_fail, "xfail").when(passed, "ok").otherwise("fail")


def success_rate(df: DataFrame, solved: Column, total: Column) -> DataFrame:
    s, t = F.sum(solved), F.sum(total)
    return df.agg(F.coalesce(s, F.lit(0)).alias("solved"), F.coalesce(t, F.lit(0)).alias("total"), F.round(F.when(t > 0, s / t).otherwise(0.0), 6).alias("rate"))


def timing_split(df: DataFrame, phases: tuple[str, ...], *by: str) -> DataFrame:
    """(*by, phase, calls, cache_hits, client_ms, server_ms, overhead_ms, percent): every phase has a row, also without calls; cached calls add to no sum."""
    fresh = ~F.col("cached")
    sums = df.groupBy(*by, "phase").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cache_hits"), F.sum(F.when(fresh, F.col("client_ms"))).alias("client"),
        F.sum(F.when(fresh, F.col("server_ms"))).alias("server"), F.sum(F.when(fresh & F.col("server_ms").isNotNull(), F.col("client_ms") - F.col("server_ms"))).alias("over"),
    )
    spark = df.sparkSession
    names = F.explode(F.array(*map(F.lit, phases))).alias("phase")
    every = df.select(*by).distinct().select(*by, names) if by else spark.range(1).select(names)
    joined = every.join(sums, [*by, "phase"], "left")
    total = F.sum("client").over(Window.partitionBy(*by))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 3)
    return joined.select(*by, "phase", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cache_hits", F.lit(0)).alias("cache_hits"), zero("client").alias("client_ms"),
                         zero("server").cast("double").alias("server_ms"), zero("over").alias("overhead_ms"),
                         F.round(F.when(total > 0, 100 * F.coalesce("client", F.lit(0.0)) / total).otherwise(0.0), 2).alias("percent"))


def last_pass(df: DataFrame, pass_col: str = "pass") -> DataFrame:
    """Rows of the highest pass; one value is gathered, not the rows."""
    top = df.agg(F.max(pass_col).alias("__top"))
    return df.join(F.broadcast(top), df[pass_col] == top["__top"]).drop("__top")


def probe_class(status: Column, holes: Column) -> Column:
    """0 closed, 1 ok with holes, 2 timeout, 3 type error, 4 anything else."""
    return F.when((status == "ok") & (holes == 0), 0).when(status == "ok", 1).when(status == "timeout", 2).when(status == "type_error", 3).otherwise(4)


def rank_probes(df: DataFrame, by: list[str], status: str, holes: str, candidate: str) -> DataFrame:
    order = [probe_class(F.col(status), F.col(holes)), F.col(holes), F.col(candidate)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def rank_candidates(df: DataFrame, by: str, term: str, score: str, order: str, k: int) -> DataFrame:
    """The k best terms of each group by their best score, the first of equals."""
    best = df.groupBy(by, term).agg(F.max(score).alias("score"), F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("ord"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "ord"))
    return best.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select(by, term, "score", "rank")


def cap_ranked(df: DataFrame, by: str, rank: Column, order: str, most: int) -> DataFrame:
    """Rows by rank and then by order, at most `most` of a group (all if it isn't positive), each with its group's total."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(rank, order)).cast("long")
    totals = df.groupBy(by).agg(F.count("*").alias("total"))
    out = df.withColumn("place", place)
    return (out.where(F.col("place") <= most) if most > 0 else out).join(totals, by)


def tier_stats(df: DataFrame, tier: str, solved: Column, iterations: Column, elapsed: Column) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("total"), F.count_if(solved).alias("solved"), F.round(F.avg(solved.cast("double")), 6).alias("solve_rate"), F.round(F.avg(iterations), 6).alias("mean_iterations"), F.round(F.avg(elapsed), 6).alias("mean_elapsed"))


def gold_report(df: DataFrame, passed: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.coalesce(F.bool_and(passed), F.lit(True)).alias("all_passed"))


#: Tiers and the other names that they go by, once in lower case with underscores.
TIERS = {"routine": ("routine", "tier1"), "compositional": ("compositional", "tier2"), "non-obvious": ("non_obvious", "nonobvious", "tier3")}


def tier_of(text: Column) -> Column:
    """The tier that a name means; null for others."""
    low = F.translate(F.lower(F.trim(text)), "- ", "__")
    found = F.lit(None).cast("string")
    for tier, names in TIERS.items():
        found = F.when(low.isin(*names), tier).otherwise(found)
    return found


def with_tier(rows: DataFrame, key: str, obligations: DataFrame, obligation: str = "id", tier: str = "tier") -> DataFrame:
    """rows with the tier of their obligation, ? where there is none."""
    known = obligations.groupBy(F.col(obligation).alias("__id")).agg(F.min(tier).alias("__tier"))
    return rows.join(known, rows[key] == known["__id"], "left").select(*rows.columns, F.coalesce("__tier", F.lit("?")).alias("tier"))


OBLIGATION = "id string, source string, module string, obligation string, gold string, goldTerm string, hole string, type string, difficulty string, domain string, proofStrategy string, tags array<string>"


def obligations(lines: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(obligations, raw lines that aren't one): domain and strategy default to empty text, tags to none; all other fields and a known tier are needed."""
    d = lines.select(F.col(raw).alias("raw"), F.from_json(raw, OBLIGATION).alias("r")).withColumn("tier", tier_of(F.col("r.difficulty")))
    needed = ("id", "source", "module", "obligation", "gold", "goldTerm", "hole", "type")
    ok = F.col("tier").isNotNull()
    for c in needed:
        ok &= F.col(f"r.{c}").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    empty = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    good = d.where(ok).select(*[F.col(f"r.{c}").alias(c) for c in needed], "tier", empty("domain"), empty("proofStrategy"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"))
    return good, d.where(~ok).select("raw")


def beam(states: DataFrame, by: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k states of each search by these keys, in order (place)."""
    return states.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("place") <= k)
