"""JSON values of unknown depth, walked level by level inside a row: one fold whose state is the level's containers and what was found above."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_container(json: Column) -> Column:
    return F.startswith(json, F.lit("{")) | F.startswith(json, F.lit("["))


def members(node: Column, json: Column) -> Column:
    """array<struct<step, key, node, json>> of an object's members by name, or of a list's items in order; step is .name or [place]."""
    as_map = F.try_variant_get(node, "$", "map<string,variant>")
    as_list = F.try_variant_get(node, "$", "array<variant>")
    member = lambda step, key, v: F.struct(step.alias("step"), key.alias("key"), v.alias("node"), F.to_json(v).alias("json"))
    of_map = F.transform(F.map_entries(as_map), lambda e: member(F.concat(F.lit("."), e["key"]), e["key"], e["value"]))
    of_list = F.transform(as_list, lambda v, i: member(F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), v))
    none = F.filter(of_list, lambda _: F.lit(False))
    return F.coalesce(F.when(F.startswith(json, F.lit("{")), of_map), F.when(F.startswith(json, F.lit("[")), of_list), none, F.array().cast("array<struct<step:string,key:string,node:variant,json:string>>"))


def depth(json: Column) -> Column:
    """How many containers lie within one another at most, of JSON text as the engine writes it: its brackets outside strings, counted up and down."""
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*+"', ""), r"[^\[\]{}]++", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, c):
        now = s["now"] + F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"]), F.lit(0))


def descend(root: Column, first: Column, inherit: Callable[[Column, Column, Column], Column], found: Callable[[Column], Column], kind: str, enter: Callable[[Column, Column], Column] | None = None) -> Column:
    """array<kind>: what found says of each container (object or list) of a variant, the outer ones first.

    found takes struct(context, json, members) and gives an array; the root's context is first, a container's is
    inherit(the container around it, its member, the member's place); enter, of this and its own members, is taken instead where it is given. There are as many rounds as the value is deep. A scalar
    root or null finds nothing. A value deeper than the JSON parser goes (1,000 levels) is no variant in the first place.
    """
    plain = lambda context, node, json: F.struct(context.alias("context"), json.alias("json"), members(node, json).alias("members"))
    own = lambda o: F.struct(enter(o["context"], o["members"]).alias("context"), o["json"].alias("json"), o["members"].alias("members"))
    opened = plain if enter is None else lambda context, node, json: let(plain(context, node, json), own)
    below = lambda o: F.transform(F.filter(o["members"], lambda m: is_container(m["json"])), lambda m, k: opened(inherit(o, m, k), m["node"], m["json"]))
    say = lambda level: F.flatten(F.transform(level, found)).cast(f"array<{kind}>")
    start = lambda top: let(top, lambda level: F.struct(level.alias("level"), say(level).alias("out")))

    def step(s, _):
        further = let(F.flatten(F.transform(s["level"], below)), lambda level: F.struct(level.alias("level"), F.concat(s["out"], say(level)).alias("out")))
        return F.when(F.size(s["level"]) == 0, s).otherwise(further)

    def walk(read):
        node, text = read["node"], read["text"]
        top = let(F.array(opened(first, node, text)), lambda one: F.filter(one, lambda _: is_container(text)))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(depth(text), F.lit(1))), start(top), step, lambda s: s["out"])

    # the value is parsed and printed once, however often the walk names it
    return let(let(root, lambda r: F.struct(r.alias("node"), F.to_json(r).alias("text"))), walk)
