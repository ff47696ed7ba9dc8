"""Replies of a checker's server: envelopes whose body is JSON within JSON, and bodies that are read strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLE = "index int, line int, col int, goal string"
CHECK = f"success boolean, holes array<struct<{HOLE}>>, holesCount int, timedOut boolean, elapsedMs bigint, checkedFromSource boolean, verdict struct<exitCode: int>"


def envelope(lines: DataFrame, expected: Column, raw: str = "raw") -> DataFrame:
    """lines with kind (not_ours, protocol_error, reply), is_error, text and message of each response line.

    A line that isn't JSON, or answers another call or none, isn't ours. An error object, or a result without its first
    content text, is a protocol error; the text of a reply is most often a JSON document of its own.
    """
    get = lambda path: F.get_json_object(raw, path)
    own = F.coalesce(get("$.id").try_cast("bigint") == expected, F.lit(False))
    failed, text = get("$.error"), get("$.result.content[0].text")
    kind = F.when(~own, "not_ours").when(failed.isNotNull() | text.isNull(), "protocol_error").otherwise("reply")
    message = F.when(~own, None).when(failed.isNotNull(), F.coalesce(get("$.error.message"), failed)).when(text.isNull(), F.concat(F.lit("response for id="), expected.cast("string"), F.lit(" has no content[0].text")))
    reply = kind == "reply"
    return lines.withColumns({"kind": kind, "is_error": F.when(reply, F.coalesce(get("$.result.isError").try_cast("boolean"), F.lit(False))), "text": F.when(reply, text), "message": message})


def check_body(text: Column) -> Column:
    """struct(body, error) of a file check's body: success, holes with their places, the count of holes and the elapsed time are needed, and the count must be that of the list."""
    body = F.from_json(text, CHECK)
    need = lambda c, ok: F.when(~F.coalesce(ok, F.lit(False)), F.lit(c))
    sound = F.forall(body["holes"], lambda h: h["index"].isNotNull() & h["line"].isNotNull() & h["col"].isNotNull())
    error = F.coalesce(
        need("not a JSON object", F.json_object_keys(text).isNotNull()), need("success is missing", body["success"].isNotNull()), need("holes are missing", body["holes"].isNotNull() & sound),
        need("holesCount is missing", body["holesCount"].isNotNull()), need("holesCount isn't the number of holes", body["holesCount"] == F.size(body["holes"])), need("elapsedMs is missing", body["elapsedMs"].isNotNull()),
    )
    holes = F.transform(body["holes"], lambda h: h.withField("goal", F.coalesce(h["goal"], F.lit("?"))))
    filled = F.struct(body["success"].alias("success"), holes.alias("holes"), F.coalesce(body["timedOut"], F.lit(False)).alias("timed_out"), body["elapsedMs"].alias("elapsed_ms"), body["checkedFromSource"].alias("checked_from_source"), body["verdict"]["exitCode"].alias("exit_code"))
    return F.struct(F.when(error.isNull(), filled).alias("body"), error.alias("error"))


def goals(body: Column) -> Column:
    """array<struct<index, type>> of the visible goals that a reply lists, under either of its names."""
    listed = lambda k: F.from_json(F.get_json_object(body, f"$.{k}"), "array<struct<index: int, type: string>>")
    return F.coalesce(listed("visibleGoals"), listed("goals"), F.array().cast("array<struct<index: int, type: string>>"))
