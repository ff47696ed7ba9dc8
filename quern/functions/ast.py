"""Functions on type trees kept as JSON text: binders, arity, names, index targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.variants import descend, let


def _get(node: Column, path: str) -> Column:
    return F.get_json_object(node, path)


def _steps(ast: Column) -> Column:
    """As many steps as the tree's text mentions function types, which no chain of binders is longer than; one for odd trees."""
    tag = '"Pi"'
    mentions = ((F.length(ast) - F.length(F.replace(ast, F.lit(tag), F.lit("")))) / len(tag)).cast("int")
    return F.sequence(F.lit(1), F.greatest(F.coalesce(mentions, F.lit(1)), F.lit(1)))


def pi_binders(ast: Column) -> Column:
    """array<struct<hiding, hint>> of the leading function types, outermost first; a fold that steps into the codomain."""
    root = F.coalesce(_get(ast, "$.term"), ast)
    start = F.struct(root.alias("node"), F.array().cast("array<struct<hiding:string,hint:string>>").alias("found"))

    def step(s, _):
        node = s["node"]
        binder = F.struct(F.coalesce(_get(node, "$.binder.hiding"), F.lit("explicit")).alias("hiding"), F.nullif(F.trim(_get(node, "$.binder.nameHint")), F.lit("")).alias("hint"))
        after = F.when(_get(node, "$.cod.tag") == "Type", F.coalesce(_get(node, "$.cod.term"), _get(node, "$.cod"))).otherwise(_get(node, "$.cod"))
        on = F.struct(after.alias("node"), F.concat(s["found"], F.array(binder)).alias("found"))
        return F.when(_get(node, "$.tag") == "Pi", on).otherwise(F.struct(F.lit(None).cast("string").alias("node"), s["found"].alias("found")))

    return F.aggregate(_steps(ast), start, step, lambda s: s["found"])


def pi_arity(ast: Column) -> Column:
    """Number of leading function types; 0 for null and odd trees."""
    inner = lambda n: F.when(_get(n, "$.tag") == "Type", _get(n, "$.term")).otherwise(n)
    start = F.struct(inner(ast).alias("node"), F.lit(0).alias("n"))

    def step(s, _):
        pi = F.coalesce(_get(s["node"], "$.tag") == "Pi", F.lit(False))
        return F.struct(F.when(pi, inner(_get(s["node"], "$.cod"))).alias("node"), (s["n"] + pi.cast("int")).alias("n"))

    return F.coalesce(F.aggregate(_steps(ast), start, step, lambda s: s["n"]), F.lit(0))


def binder_names(binders: Column) -> Column:
    """Each binder's hint, else i (implicit) or x and how many binders are further in."""
    name = lambda b, left: F.coalesce(b["hint"], F.concat(F.when(b["hiding"] == "implicit", "i").otherwise("x"), left.cast("string")))
    return let(binders, lambda all_: F.transform(all_, lambda b, p: name(b, F.size(all_) - 1 - p)))


def resolve_index(body: Column, names: Column) -> Column:
    """The binder that "@i" counts to from the innermost; null if the body isn't one or there is none."""
    i = F.try_cast(F.regexp_extract(F.trim(body), r"^@(\d+)$", 1), "bigint") if hasattr(F, "try_cast") else F.regexp_extract(F.trim(body), r"^@(\d+)$", 1).try_cast("bigint")

    def named(x):
        i, names = x["i"], x["names"]
        inside = (i >= 0) & (i < F.size(names))
        return F.when(inside, F.get(names, (F.size(names) - 1 - F.when(inside, i).otherwise(0)).cast("int")))

    return let(F.struct(i.alias("i"), names.alias("names")), named)


def sort_tag(ast: Column) -> Column:
    return _get(ast, "$.sort.tag")


#: Keys whose strings (or nulls) are names that people chose, not structure.
NAMES = ("nameHint", "name", "hint")
#: In a pattern: any type or term.
ANY = '{"tag":"*"}'


def canonical(ast: Column) -> Column:
    """A type tree as text without names and white space, members by name: equal for trees of one structure. Null for what is no JSON.

    The parser has sorted members and undone white space and escapes. Escaped quotes are then put aside as control
    characters, which JSON text can't hold, so a string is a run without quotes, and no pattern here repeats a group.
    """
    text = F.replace(F.replace(F.to_json(F.try_parse_json(ast)), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    member = rf'"(?:{"|".join(NAMES)})":(?:null|"[^"]*+")'
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, member + ",", ""), "," + member + r"(?=\})", ""), member + r"(?=\})", "")
    return F.replace(F.replace(text, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def subtrees(ast: Column) -> Column:
    """array<struct<path, hash, label, size>> of a type tree's objects and lists, the outer ones first.

    hash stands for the whole subtree, names aside; label for its own level: the members' names, scalars, and which of them are
    objects or lists of how many items. size is the length of the subtree's text. Paths are as $.cod.term.elims[0].
    """
    mark = lambda m: F.when(F.startswith(m["json"], F.lit("{")), F.lit("{")).when(F.startswith(m["json"], F.lit("[")), F.lit("[")).otherwise(m["json"])
    label = lambda o: F.concat(F.substring(o["json"], 1, 1), F.array_join(F.transform(o["members"], lambda m: F.concat(m["step"], F.lit(":"), mark(m))), ","))
    say = lambda o: F.array(F.struct(o["context"].alias("path"), F.sha1(o["json"]).alias("hash"), F.sha1(label(o)).alias("label"), F.length(o["json"]).alias("size")))
    return descend(F.try_parse_json(canonical(ast)), F.lit("$"), lambda o, m, _: F.concat(o["context"], m["step"]), say, "struct<path:string,hash:string,label:string,size:int>")
