"""The leading binders of a type string, its context and goal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.variants import let

BINDERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("hiding", T.StringType())]))
PARSED = T.StructType([T.StructField("binders", BINDERS), T.StructField("rest", T.StringType())])
BLOCKS = "array<struct<opens:string,first:int,last:int>>"
#: Where a scan is: the next character's place, the brackets open in the block, where the block and the unread rest begin, whether the rest has begun.
SCAN = f"struct<i:int,open:string,block:int,rest:int,over:boolean,blocks:{BLOCKS}>"
BLANK = " \t\n\r\f\v"


def _scan(s, c):
    """One more character: between blocks white space is passed over and a bracket opens a block, anything else begins the rest; in a block brackets are pushed, and popped by their own kind only."""
    top = F.right(s["open"], F.lit(1))
    between, opens = s["open"] == "", c.isin("(", "{")
    closes = ((c == ")") & (top == "(")) | ((c == "}") & (top == "{"))
    ends = ~between & closes & (F.length(s["open"]) == 1)
    opened = F.when(opens, F.concat(s["open"], c)).when(closes, F.left(s["open"], F.length(s["open"]) - 1)).otherwise(s["open"])
    block = F.struct(F.left(s["open"], F.lit(1)).alias("opens"), s["block"].alias("first"), s["i"].alias("last"))
    blank = F.instr(F.lit(BLANK), c) > 0
    return F.struct(
        (s["i"] + 1).alias("i"), F.when(between & ~opens, "").otherwise(opened).alias("open"), F.when(between & opens, s["i"]).otherwise(s["block"]).alias("block"),
        F.when(ends | (between & blank), s["i"] + 1).otherwise(s["rest"]).alias("rest"), (between & ~opens & ~blank).alias("over"),
        F.when(ends, F.concat(s["blocks"], F.array(block))).otherwise(s["blocks"]).alias("blocks"),
    ).cast(SCAN)


def telescope(types: Column | str) -> Column:
    """struct(binders, rest) of a type string: blocks {a b : T} and (x : U) at its start; a block without a colon is passed over, one that isn't closed is rest.

    A fold over the characters whose state holds the stack of open brackets; once the rest has begun nothing is computed.
    """
    text = F.coalesce(F.col(types) if isinstance(types, str) else types, F.lit(""))
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("open"), F.lit(0).alias("block"), F.lit(0).alias("rest"), F.lit(False).alias("over"), F.array().cast(BLOCKS).alias("blocks")).cast(SCAN)
    scanned = F.aggregate(F.split(text, ""), start, lambda s, c: F.when(s["over"] | (c == ""), s).otherwise(_scan(s, c)), lambda s: F.struct(s["blocks"].alias("blocks"), s["rest"].alias("rest")))

    def binders(b):
        inner = F.substring(text, b["first"] + 2, b["last"] - b["first"] - 1)
        colon = F.locate(":", inner)
        names = F.filter(F.split(F.substring(inner, F.lit(1), colon - 1), r"\s+"), lambda n: n != "")
        kind = F.trim(F.substring(inner, colon + 1, F.length(inner)), F.lit(BLANK))
        made = F.transform(names, lambda n: F.struct(n.alias("name"), kind.alias("type"), F.when(b["opens"] == "{", "implicit").otherwise("explicit").alias("hiding")))
        return F.when(colon > 0, made).otherwise(F.filter(made, lambda _: F.lit(False)))

    read = lambda s: F.struct(F.flatten(F.transform(s["blocks"], binders)).alias("binders"), F.substring(text, s["rest"] + 1, F.length(text)).alias("rest"))
    return let(scanned, read).cast(PARSED)


def context_and_goal(parsed: Column, parts: Column, names: Column) -> Column:
    """struct(context, goal): the telescope, then each arrow part but the last, named by the binder list or x0, x1, ..."""
    n = F.size(parsed["binders"])
    domains = F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    extra = F.transform(domains, lambda t, j: F.struct(F.coalesce(F.get(names, n + j), F.concat(F.lit("x"), j.cast("string"))).alias("name"), t.alias("type"), F.lit("explicit").alias("hiding")))
    goal = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.trim(parsed["rest"]))
    return F.struct(F.concat(parsed["binders"], extra).alias("context"), goal.alias("goal"))
