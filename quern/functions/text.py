"""Text functions on columns: names, tokens, type strings. Each takes and gives Columns; null gives null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of types that are no dependencies.
STOP_TOKENS = ("Set", "Prop", "Type", "∀", "forall")
#: White space beyond ASCII, and the signs that make tokens of their own, for retrieval.
WIDE_SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
SIGNS = "¬∧∨→≡≈≤≥⊔⊓×λ∀∃ΣΠ"


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """What follows the first line end; null without one."""
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def namespace(module: Column) -> Column:
    """The first dotted segment."""
    return F.substring_index(module, ".", 1)


def segments(qname: Column) -> Column:
    return F.split(qname, r"\.")


def pretty_qname(qname: Column) -> Column:
    """Without empty segments and those that are just an underscore."""
    return F.array_join(F.filter(segments(qname), lambda s: ~s.isin("", "_")), ".")


def split_last(qname: Column) -> tuple[Column, Column]:
    """(module, name) at the last dot; without a dot the module is empty."""
    return F.regexp_replace(F.when(F.instr(qname, ".") > 0, qname).otherwise(F.concat(F.lit("."), qname)), r"\.[^.]*$", ""), F.substring_index(qname, ".", -1)


def looks_qualified(token: Column) -> Column:
    """At least two dotted segments, none empty."""
    parts = segments(token)
    return (F.size(parts) > 1) & ~F.exists(parts, lambda s: s == "")


def anonymous(body: Column) -> Column:
    """Whether a dotted segment of the trimmed body is just an underscore."""
    return F.exists(segments(F.trim(body)), lambda s: F.trim(s) == "_")


def drop_anonymous(body: Column) -> Column:
    """The body without such and empty segments; itself where it has no dot or nothing would be left."""
    body = F.trim(body)
    kept = F.array_join(F.filter(F.transform(segments(body), lambda x: F.trim(x)), lambda s: ~s.isin("", "_")), ".")
    return F.when((F.instr(body, ".") > 0) & (kept != ""), kept).otherwise(body)


def head_symbol(body: Column) -> Column:
    """What comes before the first space or opening bracket; null if nothing does."""
    return F.nullif(F.regexp_extract(F.trim(body), r"^[^\s({\[]+", 0), F.lit(""))


def dependency_tokens(text: Column) -> Column:
    """Sorted distinct names in a type string: of two characters at least, with a letter first, no keywords."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'.]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & t.rlike(r"^\p{L}") & ~t.isin(*STOP_TOKENS))))


def retrieval_tokens(text: Column) -> Column:
    """Names between underscores as they are, two-sign arrows, ASCII words in lower case, numbers, and runs of SIGNS; the first of these that fits at a place."""
    pattern = f"_[^{WIDE_SPACE}]+_|->|=>|[A-Za-z][A-Za-z0-9_']*|[0-9]+|[{SIGNS}]+"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.when((t >= "A") & (t < "["), F.lower(t)).when((t >= "a") & (t < "{"), F.lower(t)).otherwise(t))


def query_text(goal: Column, context: Column) -> Column:
    """What a goal and its context, array<struct<name, type>>, are searched by; entries without a name or a type go."""
    lines = F.transform(F.filter(context, lambda e: e["name"].isNotNull() & e["type"].isNotNull()), lambda e: F.concat(e["name"], F.lit(" : "), e["type"]))
    return F.array_join(F.concat(F.array(F.lit("GOAL:"), goal, F.lit("CTX:")), F.coalesce(lines, F.array().cast("array<string>"))), "\n")


def letter_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and ASCII digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]+", " "), " "), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """How many runs of non-space characters; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def clean_premise(p: Column) -> Column:
    """Without angle brackets, source suffixes and trailing dots; space collapsed."""
    p = F.translate(p, "<>", "")
    return collapse_space(F.regexp_replace(F.replace(p, F.lit(".agda."), F.lit(".")), r"\.+$", ""))


def clean_premises(premises: Column, file: Column, module: Column, name: Column) -> Column:
    """Cleaned, distinct, sorted, without empty ones and without the row's own names: after its file's base name, after its module, and bare."""
    folders = F.regexp_replace(file, "/+$", "")
    base = F.replace(F.when(folders == "", file).otherwise(F.substring_index(folders, "/", -1)), F.lit(".agda"), F.lit(""))
    own = F.array(*[clean_premise(x) for x in (F.concat(base, F.lit("."), name), F.concat(F.coalesce(module, F.lit("")), F.lit("."), name), name)])
    return F.array_sort(F.array_distinct(F.array_except(F.filter(F.transform(premises, clean_premise), lambda p: p != ""), own)))


def normal_row(file: Column, module: Column, name: Column, type_: Column, proof: Column, premises: Column) -> Column:
    """struct(file, module, name, type, proof, premises) of a whole row, normalised: white space collapsed, an empty module is null, premises cleaned by the row's own cleaned names. A type or proof that is empty stays so."""
    file, name = (collapse_space(F.coalesce(c, F.lit(""))) for c in (file, name))
    module = F.nullif(collapse_space(module), F.lit(""))
    cleaned = clean_premises(F.coalesce(premises, F.array().cast("array<string>")), file, module, name)
    return F.struct(file.alias("file"), module.alias("module"), name.alias("name"), collapse_space(type_).alias("type"), collapse_space(proof).alias("proof"), cleaned.alias("premises"))


def noted(text: Column, start: str, end: str, title: str) -> Column:
    """text in which the lines between a start mark (start|title@@) and the end mark are an indented note under its title; marks go.

    How many marks of each kind lie above a line tells whether it is in a note: each opens or closes one, and repeated marks change nothing.
    """
    mark = lambda l: F.when(F.startswith(F.trim(l), F.lit(start)) & F.endswith(F.trim(l), F.lit("@@")), F.lit(1)).when(F.trim(l) == end, F.lit(0))
    named = lambda l: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.trim(l), "@@$", ""), r"^.{%d}\\?\|?" % len(start), "")), F.lit("")), F.lit(title))
    opened = F.struct(F.lit(0).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(s, line):
        return F.struct(
            F.coalesce(mark(line), s["inside"]).alias("inside"),
            F.concat(s["out"], F.when(mark(line) == 1, F.array(F.lit(""), F.concat(F.lit('??? note "'), named(line), F.lit('"')))).when((mark(line) == 0) & (s["inside"] == 1), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.repeat(F.lit("    "), s["inside"]), line)))).alias("out"),
        )

    return F.concat(F.array_join(F.aggregate(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"), opened, step, lambda s: s["out"]), "\n"), F.lit("\n"))


def declaration_kind(name: Column, type_: Column, module: Column) -> Column:
    """The kind that a name and module suggest; the first rule that holds decides."""
    low, mod = F.lower(name), F.lower(F.coalesce(module, F.lit("")))
    return (
        F.when(low.contains("lemma"), "lemma")
        .when(low.startswith("thm") | low.contains("theorem"), "theorem")
        .when(low.contains("axiom"), "axiom")
        .when(low.startswith("record") | mod.contains("record"), "record")
        .when(low.startswith("data") | mod.contains("data"), "data")
        .when(name.rlike(r"^\p{Lu}"), "constructor")
        .otherwise("definition")
    )


def hole_count(source: Column, hole: str = "{!!}") -> Column:
    return ((F.length(source) - F.length(F.replace(source, F.lit(hole), F.lit("")))) / len(hole)).cast("long")


def next_hole(source: Column, hole: str = "{!!}") -> Column:
    """struct(offset, line, col) of the first hole, line and col from 1; null without one."""
    at = F.instr(source, hole)
    before = F.substr(source, F.lit(1), at - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.when(at > 0, F.struct((at - 1).alias("offset"), line.alias("line"), col.alias("col")))


def fnv1a32(s: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, its top bit cleared."""
    h = F.hex(F.encode(s, "utf-8"))
    codes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(h) / 2, F.lit(1)).cast("int")), lambda i: i * 2 <= F.length(h)), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))).bitwiseAND(F.lit(2147483647))


def split_arrows(type_: Column) -> Column:
    """Parts of a type string between its top-level arrows, trimmed, without empty ones.

    One fold over brackets, arrows and the runs between keeps the depth of each of the three kinds of brackets (none below 0) and the open part.
    """
    runs = F.regexp_extract_all(F.coalesce(type_, F.lit("")), F.lit(r"->|[→\-(){}\[\]]|[^→\-(){}\[\]]+"), F.lit(0))
    kinds = ("()", "{}", "[]")
    start = F.struct(*[F.lit(0).alias(f"d{k}") for k in range(3)], F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s, c):
        at = lambda part, parts, **depths: F.struct(*[depths.get(f"d{k}", s[f"d{k}"]).alias(f"d{k}") for k in range(3)], part.alias("part"), parts.alias("parts"))
        longer = F.concat(s["part"], c)
        top = (s["d0"] == 0) & (s["d1"] == 0) & (s["d2"] == 0)
        out = F.when(c.isin("→", "->") & top, at(F.lit(""), F.concat(s["parts"], F.array(s["part"]))))
        for k, (opening, closing) in enumerate(kinds):
            out = out.when(c == opening, at(longer, s["parts"], **{f"d{k}": s[f"d{k}"] + 1})).when(c == closing, at(longer, s["parts"], **{f"d{k}": F.greatest(F.lit(0), s[f"d{k}"] - 1)}))
        return out.otherwise(at(longer, s["parts"]))

    return F.filter(F.aggregate(runs, start, step, lambda s: F.transform(F.concat(s["parts"], F.array(s["part"])), lambda x: F.trim(x))), lambda p: p != "")


def path_stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def module_of_path(path: Column, root: str) -> Column:
    """The module that a source file under root defines: suffixes dropped, slashes to dots."""
    inner = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    return F.translate(F.regexp_replace(inner, r"\.(agda|lagda(\.\w+)?)$", ""), "/", ".")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def plain_goal(goal: Column) -> Column:
    """A goal as a policy reads it: space collapsed, qualifiers before any sign or word dropped, the word not as a sign."""
    short = F.regexp_replace(F.trim(F.regexp_replace(goal, r"(?U)\s+", " ")), r"(?U)\b(?:[A-Za-z_][\w']*\.)+(?=[^\s])", "")
    return F.regexp_replace(short, r"(?U)\bnot\b", "¬")


#: Fixed value: what a checker prints before the places of what it left open.
UNSOLVED = r"Unsolved(?:\s+interaction)?\s+metas\s+at\s+the\s+following\s+locations:"


def unsolved_positions(output: Column) -> Column:
    """array<struct<line, col>> of the :line,col or :line.col marks after the header of unsolved places, in order; empty without the header."""
    tail = F.regexp_extract(output, f"(?is){UNSOLVED}(.*)", 1)
    mark = r":(\d+)[,.](\d+)"
    line, col = F.regexp_extract_all(tail, F.lit(mark), F.lit(1)), F.regexp_extract_all(tail, F.lit(mark), F.lit(2))
    return F.zip_with(line, col, lambda a, b: F.struct(a.try_cast("int").alias("line"), b.try_cast("int").alias("col")))


def fnv1a64(s: Column) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as 16 hex digits; the product modulo 2^64 is put together from two halves."""
    h = F.hex(F.encode(s, "utf-8"))
    codes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(h) / 2, F.lit(1)).cast("int")), lambda i: i * 2 <= F.length(h)), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    half = 0xFFFFFFFF

    def step(a, b):  # the prime is 2^40 + 0x1B3
        lo = a["lo"].bitwiseXOR(b)
        low = lo * 0x1B3
        high = a["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(F.lit(half).cast("long")).alias("hi"), low.bitwiseAND(F.lit(half).cast("long")).alias("lo"))

    return F.aggregate(codes, start, step, lambda a: F.lower(F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0"))))


def module_name_ok(name: Column) -> Column:
    """Dotted segments that begin with a letter or underscore and go on with letters, digits, underscores, primes and hyphens, all ASCII."""
    part = r"[A-Za-z_][A-Za-z0-9_'\-]*"
    return name.rlike(rf"\A{part}(?:\.{part})*\z")


#: What three readers take for a module's name in its header line, and what may follow it.
MODULE_HEADERS = {
    "strict": r"(?m)^\s*module\s+([A-Za-z_][A-Za-z0-9_\.]*)\s+where\s*$",
    "primed": r"(?m)^\s*module\s+([A-Za-z0-9_'.]+)\s+where\b",
    "hyphened": r"(?m)^\s*module\s+([A-Za-z0-9_.\-]+)\s+where\b",
}


def module_header(source: Column, kind: str = "strict") -> Column:
    """The module that a source's first header line names, by one of three readers; null without one."""
    return F.nullif(F.regexp_extract(source, MODULE_HEADERS[kind], 1), F.lit(""))


def in_module(name: Column, module: str) -> Column:
    """Whether a name is the module or lies in it."""
    return (name == module) | F.startswith(name, F.lit(module + "."))


def csv_items(text: Column) -> Column:
    """Items between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def doc_slug(text: Column) -> Column:
    """A heading's anchor: lower case, only word characters, spaces and hyphens, runs of the latter as one hyphen; section if nothing is left."""
    kept = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s-]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), F.lit("")), F.lit("section"))


def flat_filename(path: Column) -> Column:
    """The page of a source file: its folders and stem joined by dots; an index file stands for its folder."""
    name = F.substring_index(path, "/", -1)
    stem = F.when(name.rlike(r"\.lagda\.md$"), F.regexp_replace(name, r"\.lagda\.md$", "")).when(name.rlike(r"\.lagda$"), F.regexp_replace(name, r"\.lagda$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), lambda x: ~x.isin("", "."))
    index = F.lower(stem) == "index"
    flat = F.when(F.size(folders) == 0, F.when(index, "index").otherwise(stem)).otherwise(F.array_join(F.when(index, folders).otherwise(F.concat(folders, F.array(stem))), "."))
    return F.concat(flat, F.lit(".md"))


def splice(source: Column, line: Column, col: Column, candidate: Column, hole: str = "{!!}") -> Column:
    """struct(text, error): the source with the hole at line and col, from 1, filled in; without that very hole there, the error."""
    lines = F.split(source, "\n", -1)
    own = F.get(lines, (line - 1).cast("int"))
    there = F.substr(own, F.greatest(col, F.lit(1)).cast("int"), F.lit(len(hole))) == hole
    patched = F.concat(F.substr(own, F.lit(1), (col - 1).cast("int")), candidate, F.substr(own, (col + len(hole)).cast("int")))
    error = (
        F.when((line < 1) | (line > F.size(lines)), F.concat(F.lit("line "), line.cast("string"), F.lit(" is out of range, there are "), F.size(lines).cast("string")))
        .when((col < 1) | ~F.coalesce(there, F.lit(False)), F.concat(F.lit(f"no {hole} at line "), line.cast("string"), F.lit(", column "), col.cast("string")))
    )
    filled = F.array_join(F.transform(lines, lambda x, i: F.when(i == line - 1, patched).otherwise(x)), "\n")
    return F.struct(F.when(error.isNull(), filled).alias("text"), error.alias("error"))


def remaining_binders(binders: Column, supplied: Column) -> Column:
    """Of array<struct<hiding, ...>> those left once so many visible ones, the first, have arguments; the hidden ones stay, in order."""
    seen = lambda i: F.size(F.filter(F.slice(binders, F.lit(1), i), lambda b: b["hiding"] == "explicit"))
    return F.filter(binders, lambda b, i: (b["hiding"] != "explicit") | (seen(i) >= supplied))


def application(lemma: Column, binders: Column, args: Column, hole: str = "{!!}") -> Column:
    """The lemma applied to the arguments, with a hole for each visible binder that these leave."""
    left = F.filter(remaining_binders(binders, F.size(args)), lambda b: b["hiding"] == "explicit")
    return F.array_join(F.concat(F.array(lemma), args, F.transform(left, lambda b: F.lit(hole))), " ")
