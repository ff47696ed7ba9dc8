"""JSON of unknown shape: rendered forms, name lists under several keys, declarations at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.variants import descend

#: Keys under which a rendered form is kept.
RENDERED = ("pretty", "pp", "rendered", "shown")
DECLARATION = T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("module", T.StringType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))


def rendered(node: Column) -> Column:
    """A JSON string itself, else the first rendered form that an object has, else null."""
    text = F.when(F.startswith(F.ltrim(node), F.lit('"')), F.from_json(F.concat(F.lit("["), node, F.lit("]")), "array<string>")[0])
    return F.coalesce(text, *[F.get_json_object(node, f"$.{k}") for k in RENDERED])


def names_under(node: Column, *keys: str) -> Column:
    """Distinct strings of the lists under these keys, in order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(F.from_json(F.get_json_object(node, f"$.{k}"), "array<string>"), empty) for k in keys]))


def declarations(text: Column | str) -> Column:
    """array<struct<file, module, name, type>>: objects with a name and a type, at any depth; file and module come from the nearest object around that has them.

    They are in the order of the text's lists, and of members by name. Text that is no JSON gives none. A fold over the
    levels of each document, without Python.
    """
    is_text = lambda m: F.startswith(m["json"], F.lit('"'))
    own = lambda members, key: F.get(F.filter(members, lambda m: (m["key"] == key) & is_text(m)), F.lit(0))["node"].cast("string")
    context = lambda file, module, at: F.struct(file.alias("file"), module.alias("module"), at.alias("at"))

    # an object's own file and module hold for itself as for what it holds
    enter = lambda c, members: context(F.coalesce(own(members, "file"), c["file"]), F.coalesce(own(members, "module"), c["module"]), c["at"])
    below = lambda o, m, k: context(o["context"]["file"], o["context"]["module"], F.concat(o["context"]["at"], F.array(k)))

    def found(o):
        said = F.array(F.struct(o["context"]["at"].alias("at"), o["context"]["file"].alias("file"), o["context"]["module"].alias("module"), own(o["members"], "name").alias("name"), own(o["members"], "type").alias("type")))
        return F.filter(said, lambda x: x["name"].isNotNull() & x["type"].isNotNull())

    nothing = F.lit(None).cast("string")
    root = F.try_parse_json(F.col(text) if isinstance(text, str) else text)
    every = descend(root, context(nothing, nothing, F.array().cast("array<int>")), below, found, "struct<at:array<int>,file:string,module:string,name:string,type:string>", enter)
    return F.transform(F.array_sort(every), lambda d: F.struct(d["file"], d["module"], d["name"], d["type"])).cast(DECLARATION)
