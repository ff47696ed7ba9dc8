"""Line-structured text: declarations, comments, goal reports, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.variants import let

#: First words of a line that can't be a declaration.
NO_DECLARATION = ("postulate", "open", "import", "module", "data", "record", "mutual", "where", "infix", "infixl", "infixr", "syntax", "pragma", "private")
#: Codes of errors that keep a file from being loaded, of warnings that explain an error below them, of errors of scope, and of what is left open.
RESOLUTION = ("LibraryError", "ModuleNameDoesntMatchFileName", "ModuleDefinedInOtherFile", "OverlappingProjects", "FileNotFound")
PRECURSORS = ("ModuleDoesntExport", "UnknownNamesInFixityDecl", "UnknownFixityInMixfixDecl")
SCOPE = ("NotInScope", "AmbiguousName", "AmbiguousModule", "AmbiguousConstructor", "ClashingDefinition", "ClashingModule", "ClashingImport", "ClashingModuleImport", "NoSuchModule", "NotAModuleExpr")
OPEN = ("UnsolvedMetaVariables", "UnsolvedConstraints", "UnsolvedInteractionMetas")
#: Lines and characters of a diagnostic's message.
MOST_LINES, MOST_CHARS = 24, 2000


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line)."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def strip_comments(text: Column) -> Column:
    """Lines outside comments; a line that opens, closes or lies in a block comment goes whole, as does a -- line. One fold with the block's state."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(s, line):
        dashes = line.rlike(r"^\s*--")
        opens, closes = F.contains(line, F.lit("{-")) & ~dashes, F.contains(line, F.lit("-}"))
        drop = s["inside"] | opens | dashes
        inside = F.when(s["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct(inside.alias("inside"), F.when(drop, s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["kept"]), "\n")


#: A declaration: a name, a colon, a type.
_DECLARED = r"^([^\s:]+)\s*:\s*(.+)$"


def is_declaration(line: Column) -> Column:
    trimmed = _strip(line)
    return trimmed.rlike(_DECLARED) & ~trimmed.rlike(r"^(--|\{-)") & ~F.regexp_extract(trimmed, r"^\S+", 0).isin(*NO_DECLARATION)


def is_proof(line: Column) -> Column:
    trimmed = _strip(line)
    return F.contains(trimmed, F.lit(" = ")) & ~F.startswith(trimmed, F.lit("--"))


def declarations(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, type, proof): each proof line with the declaration of its left side that is open, and the declarations that stay open, without a proof.

    A proof closes its declaration; a name that is declared again before its proof takes the new type. What comes before a line's
    first = is its left side, whole.
    """
    read = lambda line: F.struct(line.alias("line"), is_declaration(line).alias("decl"), is_proof(line).alias("proof"))
    some = F.filter(F.transform(F.transform(F.array("line"), _strip), read), lambda x: x["decl"] | x["proof"])
    d = lines.select(key, "line_no", F.inline(some))  # a line is trimmed and told once: no filter is moved into an inline
    trimmed = F.col("line")
    split = F.instr(trimmed, "=")
    d = d.withColumns({
        "name": F.when(F.col("decl"), F.regexp_extract(trimmed, _DECLARED, 1)).otherwise(_strip(F.substr(trimmed, F.lit(1), split - 1))),
        "value": F.when(F.col("decl"), F.regexp_extract(trimmed, _DECLARED, 2)).otherwise(_strip(F.substr(trimmed, split + 1))),
    })
    w = Window.partitionBy(key, "name").orderBy("line_no")
    d = d.withColumns({"before": F.lag("decl").over(w), "type": F.lag("value").over(w), "after": F.lead("decl").over(w)})
    proved, open_ = ~F.col("decl") & F.col("before"), F.col("decl") & F.col("after").isNull()
    filled = lambda c: F.nullif(c, F.lit(""))
    return d.where(proved | open_).select(key, "name", filled(F.when(proved, F.col("type")).otherwise(F.col("value"))).alias("type"), filled(F.when(proved, F.col("value"))).alias("proof"))


def _protocol(prefix: str) -> dict[str, str]:
    """The marks of a printed request, after a checker's own prefix."""
    return {k: prefix + v for k, v in {"begin": "REQ_BEGIN", "end": "REQ_END", "goal": "GOAL:", "ctx": "CTX:", "ctx_begin": "CTX_BEGIN", "ctx_end": "CTX_END"}.items()}


def last_report(text: Column, begin: str, end: str) -> Column:
    """What stands between the last begin mark and the end mark after it; null without either."""
    tail = F.element_at(F.split(text, rf"\Q{begin}\E", -1), -1)
    return F.when(F.contains(text, F.lit(begin)) & F.contains(tail, F.lit(end)), F.substring_index(tail, end, 1))


def goal_and_context(text: Column, prefix: str = "") -> Column:
    """struct(goal, context array<struct<index, visibility, name, type>>) of the last report; null without one.

    The report is a JSON object, or lines: a goal mark, context marks index:visibility:name:type, and lines that go on
    with what came before. Context is ordered by index. One fold over the lines.
    """
    m = _protocol(prefix)
    block = last_report(text, m["begin"], m["end"])
    entry = "struct<index: int, visibility: string, name: string, type: string>"
    squeeze = lambda c: _strip(F.regexp_replace(c, r"\s+", " "))
    start = F.struct(F.lit("").alias("mode"), F.lit(None).cast("string").alias("goal"), F.array().cast(f"array<{entry}>").alias("ctx"))

    def read_line(line):
        parts = F.when(F.startswith(line, F.lit(m["ctx"])), F.split(F.substr(line, F.lit(len(m["ctx"]) + 1)), ":", 4))
        return let(parts, lambda p: F.struct(line.alias("line"), p.alias("parts"), F.when(F.size(p) == 4, _strip(F.get(p, F.lit(0))).try_cast("int")).alias("index")))

    def step(s, read):
        line, parts, index = read["line"], read["parts"], read["index"]
        goal, ctx = F.startswith(line, F.lit(m["goal"])), index.isNotNull()
        marks, skip = line.rlike("^(" + "|".join(rf"\Q{m[k]}\E" for k in ("begin", "end", "goal", "ctx")) + ")"), (line == "") | line.isin(m["ctx_begin"], m["ctx_end"])
        new = F.struct(index.alias("index"), *[_strip(F.get(parts, F.lit(k))).alias(n) for k, n in ((1, "visibility"), (2, "name"), (3, "type"))])
        last = F.get(s["ctx"], F.size(s["ctx"]) - 1)
        longer = F.concat(F.slice(s["ctx"], F.lit(1), F.greatest(F.size(s["ctx"]) - 1, F.lit(0))), F.array(last.withField("type", F.concat(last["type"], F.lit(" "), line))))
        on = ~(goal | ctx | marks | skip)
        mode = F.when(goal, "goal").when(ctx, "ctx").when(skip, s["mode"]).when(marks, "").otherwise(s["mode"])
        told = F.when(goal, F.substr(line, F.lit(len(m["goal"]) + 1))).when(on & (s["mode"] == "goal"), F.concat(s["goal"], F.lit(" "), line)).otherwise(s["goal"])
        listed = F.when(ctx, F.concat(s["ctx"], F.array(new))).when(on & (s["mode"] == "ctx"), longer).otherwise(s["ctx"])
        return F.struct(mode.alias("mode"), told.alias("goal"), listed.cast(f"array<{entry}>").alias("ctx"))

    def by_lines(read):
        placed = F.array_sort(F.transform(read["ctx"], lambda e, i: F.struct(e["index"].alias("index"), i.alias("i"), e.alias("e"))))
        return F.when(read["goal"].isNotNull(), F.struct(squeeze(read["goal"]).alias("goal"), F.transform(placed, lambda x: x["e"].withField("type", squeeze(x["e"]["type"]))).alias("context")))

    def read_block(block):
        lines = F.transform(F.transform(F.split(block, "\n"), _strip), read_line)
        by_json = F.from_json(block, f"struct<goal: string, context: array<{entry}>>")
        return F.when(F.json_object_keys(block).isNotNull(), by_json).otherwise(let(F.aggregate(lines, start, step), by_lines))

    return let(block, read_block)


def blocks(lines: DataFrame, key: str, header: Column, boundary: Column | None = None) -> DataFrame:
    """(key, block, first_line, n_lines, text): a header starts a block, which reaches to the next header or boundary; blank lines at its end and lines outside of blocks go."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.lit(False) if boundary is None else F.coalesce(boundary, F.lit(False))
    head = F.coalesce(header, F.lit(False))
    d = lines.withColumn("__open", F.last(F.when(head | edge, head), ignorenulls=True).over(w)).withColumn("block", F.sum(head.cast("int")).over(w).cast("long")).where("__open")
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"])
    text = F.regexp_replace(F.array_join(body, "\n"), r"\n\s*\z", "")
    d = d.groupBy(key, "block").agg(F.min("line_no").cast("long").alias("first_line"), text.alias("text"))
    return d.select(key, "block", "first_line", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), "text")


def source_blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, first_line, name, n_lines, text) of lines name : or name =, each with the indented and blank lines after it; any other line ends a block."""
    starts = F.col("line").rlike(r"^\s*\S+\s*[:=].*$")
    other = ~starts & ~F.col("line").rlike(r"^[ \t]") & (F.trim("line") != "")
    found = blocks(lines, key, starts, other)
    return found.select(key, "block", "first_line", F.regexp_extract("text", r"^\s*([^\s:=]*)", 1).alias("name"), "n_lines", "text")


def bounded(text: Column) -> Column:
    """At most MOST_LINES lines, the last of which tells how many more there are, and then at most MOST_CHARS characters, the last of which tells that it goes on."""
    rows = F.split(text, "\n", -1)
    more = F.size(rows) - (MOST_LINES - 1)
    short = F.when(F.size(rows) > MOST_LINES, F.concat(F.array_join(F.slice(rows, 1, MOST_LINES - 1), "\n"), F.lit("\n… ("), more.cast("string"), F.lit(" more lines)"))).otherwise(text)
    return F.when(F.length(short) > MOST_CHARS, F.concat(F.substr(short, F.lit(1), F.lit(MOST_CHARS - 1)), F.lit("…"))).otherwise(short)


def diagnostic_rank(severity: Column, code: Column) -> Column:
    """What to mend first: what keeps a file from loading (0), warnings that explain an error (1), scope (2), other errors (3), what is left open (4), other warnings (5), information (6)."""
    own = F.coalesce(code, F.lit(""))
    error = F.when(own.isin(*RESOLUTION), 0).when(own.isin(*SCOPE), 2).when(own.isin(*OPEN), 4).otherwise(3)
    return F.when(severity == "info", 6).when(severity == "warning", F.when(own.isin(*PRECURSORS), 1).otherwise(5)).otherwise(error)


#: A place: file, line and column, and the end's column or line and column; a point or a comma parts the two.
_PLACE = r"^(.+):(\d+)[.,](\d+)(?:-(?:(\d+)[.,])?(\d+))?$"
_HEAD = r"^(.*?): (error|warning):(.*)$"
_BARE = r"^(error|warning):(.*)$"


def diagnostics(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, rank, severity, code, file, line, col, end_line, end_col, message) of a checker's output, each block once, the first ones by rank in order.

    Progress lines and the closing banner end a block. Equal blocks are compared whole, before their messages are bounded.
    """
    line = F.col("line")
    trimmed = F.ltrim(line)
    progress = trimmed.rlike(r"^(Checking |Loading |Finished ).*\.\s*$") | F.startswith(trimmed, F.lit("—"))
    is_head = line.rlike(_HEAD) | line.rlike(_BARE)
    b = blocks(lines_of(outputs, key, text), key, is_head, progress & ~is_head)
    b = b.groupBy(key, "text").agg(F.min("block").alias("block"))
    head = F.substring_index("text", "\n", 1)
    body = F.when(F.instr("text", "\n") > 0, F.substr("text", F.instr("text", "\n") + 1))
    full = head.rlike(_HEAD)
    where = _strip(F.when(full, F.regexp_extract(head, _HEAD, 1)).otherwise(""))
    severity = F.when(full, F.regexp_extract(head, _HEAD, 2)).otherwise(F.regexp_extract(head, _BARE, 1))
    after = F.ltrim(F.when(full, F.regexp_extract(head, _HEAD, 3)).otherwise(F.regexp_extract(head, _BARE, 2)))
    d = b.select(key, "block", severity.alias("severity"), where.alias("where"), after.alias("after"), body.alias("body"))
    flag, bracket = r"^-W(?:\[no\])?(\S+)", r"^\[([^\s\]]+)\]"
    code = F.coalesce(F.nullif(F.regexp_extract("after", bracket, 1), F.lit("")), F.nullif(F.regexp_extract("after", flag, 1), F.lit("")))
    prose = F.trim(F.when(code.isNull(), F.col("after")).otherwise(F.regexp_replace("after", f"{bracket}|{flag}", "")))
    placed = F.col("where").rlike(_PLACE)
    part = lambda i: F.when(placed, F.regexp_extract("where", _PLACE, i))
    number = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    rest = F.concat_ws(" ", F.nullif(F.when(~placed, F.col("where")), F.lit("")), F.nullif(prose, F.lit("")))
    message = bounded(F.concat_ws("\n", F.nullif(rest, F.lit("")), F.col("body")))
    d = d.select(key, "block", "severity", code.alias("code"), part(1).alias("file"), number(2).alias("line"), number(3).alias("col"), F.when(placed, F.coalesce(number(4), number(2))).alias("end_line"), F.when(placed, F.coalesce(number(5), number(3))).alias("end_col"), F.coalesce(F.nullif(message, F.lit("")), code, F.lit("(no message)")).alias("message"))
    d = d.withColumn("rank", diagnostic_rank(F.col("severity"), F.col("code")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", "block"))
    return d.select(key, place.cast("long").alias("place"), "rank", "severity", "code", "file", "line", "col", "end_line", "end_col", "message")
