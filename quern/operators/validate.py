"""Validation: required keys, gates, coverage of a run, schema contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a row must have, with and without a file.
FULL = ("astSize", "file", "kind", "module", "name", "qname", "type")
HUMAN = ("body", "name", "type")
#: Errors that a report of one file lists, if not said otherwise.
MOST_ERRORS = 50


def missing_keys(raw: Column) -> Column:
    """Sorted keys that the JSON object lacks; null if it isn't an object."""
    keys = F.json_object_keys(raw)
    need = F.when(F.array_contains(keys, "file"), F.array(*map(F.lit, FULL))).otherwise(F.array(*map(F.lit, HUMAN)))
    return F.array_sort(F.array_except(need, keys))


def line_error(raw: Column) -> Column:
    """What is wrong with a line: no JSON, no object, or missing keys; null if nothing is."""
    missing = missing_keys(raw)
    return F.when(F.try_parse_json(raw).isNull(), "JSON parse error").when(missing.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ",")))


def validate_lines(df: DataFrame, raw: str, order: str, by: str | None = None, most: int = MOST_ERRORS) -> DataFrame:
    """Rows with an error, at most so many of a file: (by, order, error). Blank lines don't count."""
    lines = df.where(F.trim(raw) != "")
    error = line_error(F.col(raw))
    bad = lines.withColumn("error", error).where(F.col("error").isNotNull())
    cols = [by, order] if by else [order]
    if by is None:
        return bad.select(*cols, "error").orderBy(order).limit(most)
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return bad.withColumn("__n", place).where(F.col("__n") <= most).select(*cols, "error")


def gate(df: DataFrame, version: Column, wanted: str, least_rows: int) -> DataFrame:
    """One row: rows, how many have another version, whether both gates hold."""
    wrong = F.count_if(~F.coalesce(version == wanted, F.lit(False)))
    return df.agg(F.count("*").alias("rows"), wrong.alias("wrong_version"), ((F.count("*") >= least_rows) & (wrong == 0)).alias("ok"))


def distinct_versions(df: DataFrame, version: str) -> DataFrame:
    return df.where(F.coalesce(F.col(version), F.lit("")) != "").select(version).distinct()


def outcomes(requested: DataFrame, attempted: DataFrame) -> DataFrame:
    """Attempted modules, and those requested but not attempted; failures without a reason get one."""
    done = attempted.select("module", F.when(F.col("ok"), "succeeded").otherwise("failed").alias("status"), F.when(~F.col("ok"), F.coalesce("reason", F.lit("failed with no recorded reason"))).alias("reason"), "skipped", "rows", "seconds")
    gone = requested.join(attempted.select("module"), "module", "left_anti").select("module", F.lit("not_attempted").alias("status"), F.lit("not attempted").alias("reason"), F.lit(False).alias("skipped"), F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("seconds"))
    return done.unionByName(gone)


def coverage(found: DataFrame) -> DataFrame:
    """One row of counts by status, resumed modules, rows."""
    of = lambda s: F.count_if(F.col("status") == s)
    return found.agg(F.count("*").alias("requested"), F.count_if(F.col("status") != "not_attempted").alias("attempted"), of("succeeded").alias("succeeded"), of("failed").alias("failed"), of("not_attempted").alias("not_attempted"),
                     F.count_if("skipped").alias("resumed"), F.coalesce(F.sum(F.when(F.col("status") == "succeeded", F.col("rows"))), F.lit(0)).alias("rows"))


def run_summary(attempted: DataFrame) -> DataFrame:
    return attempted.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("skipped").alias("skipped"), F.sum("rows").alias("rows"), F.round(F.sum("seconds"), 3).alias("seconds"))


def pending(requested: DataFrame, finished: DataFrame) -> DataFrame:
    """Modules to run: all but those whose output exists and is valid."""
    return requested.join(finished.where("validate_ok").select("module"), "module", "left_anti")


def schema_faults(actual: T.StructType, wanted: T.StructType) -> list[str]:
    """What a frame lacks of a contract: missing columns and other types; more columns are fine."""
    have = {f.name: f.dataType for f in actual}
    missing = [f"missing {f.name}" for f in wanted if f.name not in have]
    return missing + [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name] != f.dataType]


def assert_schema(df: DataFrame, wanted: T.StructType) -> DataFrame:
    if faults := schema_faults(df.schema, wanted):
        raise ValueError("; ".join(faults))
    return df


def validate_report(df: DataFrame, raw: str, line_no: str, by: str, most: int = MOST_ERRORS) -> DataFrame:
    """(by, ok, rows, errors): for each file whether it has no error, how many lines were read, and what is wrong by line. After the last error that is listed no line is read; a file of blank lines is fine and has no rows."""
    listed = validate_lines(df, raw, line_no, by, most)
    said = F.concat(F.lit("line "), F.col(line_no).cast("string"), F.lit(": "), F.col("error"))
    errors = listed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), said.alias("e")))), lambda x: x["e"]).alias("errors"), F.max(line_no).alias("__last"))
    d = df.join(errors.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left")
    read = (F.trim(raw) != "") & ((F.coalesce(F.size("errors"), F.lit(0)) < most) | (F.col(line_no) <= F.col("__last")))
    out = d.groupBy(by).agg(F.count_if(read).alias("rows"), F.first("errors", True).alias("errors"))
    return out.select(by, F.col("errors").isNull().alias("ok"), "rows", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def in_manifest_order(results: DataFrame, module: str = "module") -> DataFrame:
    """A manifest's results, or its modules, by module in code point order; each with its place from 1. Rows of one module, which a whole manifest doesn't have, go by their JSON text."""
    from quern.operators.ordinals import numbered

    rest = F.to_json(F.struct(*results.columns))
    return numbered(results.withColumn("__text", rest), module, "__text").withColumn("place", F.col("row") + 1).drop("row", "__text")
