"""Source text as its lexer sees it: prose of literate files masked, comments, pragmas, literals and holes found.

These are scans with a state, which built-in operators can't express; they run on Arrow batches, a row's text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kind of a file by the end of its name, the first that fits.
FLAVOURS = ((".lagda.md", "markdown"), (".lagda.typ", "markdown"), (".lagda.tex", "tex"), (".lagda.rst", "rst"), (".lagda.org", "org"), (".lagda.tree", "tree"), (".lagda", "tex"))
#: The lines that open and close code in each kind of file; rst goes by indentation.
FENCES = {
    "markdown": (r".*```(?:agda)?\s*$", r"\s*```\s*$"),
    "tex": (r"(?:[^\\%]|\\.)*?\\begin\{code\}", r"[^\S\n]*\\end\{code\}"),
    "tree": (r"(?:[^\\%]|\\.)*?\\agda\{", r"[^\S\n]*\}"),
    "org": (r"(?i).*#\+begin_src agda2\s", r"(?i)\s*#\+end_src"),
}
#: A fence of another language: what it holds is prose, a line that would open code too.
OTHER = re.compile(r"\s*```[\w-]*\s*$")
#: Characters that end a name, so that a comment, a hole or a character may begin after them.
BREAK = r"\s(){};.@\""
_starts = r"--[^\n]*|\?(?=[" + BREAK + r"]|\Z)|'(?:\\[\s\S]|[^'\\\n])*'"
_token = re.compile(r"\{!|\{-#|\{-|\"(?:\\[\s\S]|[^\"\\\n])*(?:\"|\n|\\?\Z)|(?<![^" + BREAK + r"])(?:" + _starts + r")")
_glued = re.compile(_starts)
_nested = {"{!": re.compile(r"\{!|!\}"), "{-": re.compile(r"\{-|-\}")}
HOLES = "array<struct<start: int, end: int, line: int, col: int>>"


def flavour(path: str | None) -> str:
    low = (path or "").lower()
    return next((kind for end, kind in FLAVOURS if low.endswith(end)), "plain")


def blank(text: str) -> str:
    """As long as the text, with its lines: everything but white space other than tabs becomes a space."""
    return re.sub(r"\S|\t", " ", text)


def _code_lines(lines: list[str], kind: str):
    """Whether each line is code."""
    if kind == "rst":
        indent, waiting = None, False
        for line in lines:
            bare = line.rstrip("\n")
            if indent is not None:
                if not bare.strip() or bare.startswith(indent):
                    yield True
                    continue
                indent = None
            if waiting:
                if not bare.strip():
                    yield False
                    continue
                waiting = False
                if own := re.match(r"\s*", bare).group():
                    indent = own
                    yield True
                    continue
            waiting = bare.rstrip().endswith("::") and not re.match(r"\s*\.\.(\s|$)", bare)
            yield False
        return
    opens, closes = map(re.compile, FENCES[kind])
    state = "prose"
    for line in lines:
        if state != "prose":
            if closes.match(line):
                state = "prose"
                yield False
            else:
                yield state == "code"
            continue
        if opens.match(line):
            state = "code"
        elif kind == "markdown" and OTHER.match(line):
            state = "other"
        yield False


def mask_prose(text: str, kind: str) -> str:
    """The code of a literate file, every character in its place; prose is blank."""
    if kind == "plain":
        return text
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    return "".join(line if code else blank(line) for line, code in zip(lines, _code_lines(lines, kind), strict=True))


def spans(text: str):
    """(kind, start, end) of holes, comments and pragmas, in order; one that isn't closed goes to the end."""
    at, glued = 0, False
    while True:
        found = (_glued.match(text, at) if glued else None) or _token.search(text, at)
        if not found:
            return
        token, start, at, glued = found.group(), found.start(), found.end(), False
        if token == "{-#":
            end = text.find("#-}", start)
            at = len(text) if end < 0 else end + 3
            yield "pragma", start, at
        elif token in _nested:
            depth = 1
            while depth:
                mark = _nested[token].search(text, at)
                if not mark:
                    at = len(text)
                    break
                depth += 1 if mark.group() == token else -1
                at = mark.end()
            yield "hole" if token == "{!" else "comment", start, at
        elif token[0] == "?":
            yield "hole", start, at
        elif token.startswith("--"):
            yield "comment", start, at
        elif token[0] == "'":
            glued = True


def find_holes(text: str, kind: str = "plain") -> list[dict]:
    """Holes with their place in the file as it is, lines and columns from 1."""
    masked = mask_prose(text, kind)
    ends = [m.end() for m in re.finditer("\n", masked)]
    out = []
    for what, start, end in spans(masked):
        if what == "hole":
            line = bisect_right(ends, start)
            out.append({"start": start, "end": end, "line": line + 1, "col": start - (ends[line - 1] if line else 0) + 1})
    return out


def code_only(text: str, kind: str = "plain") -> str:
    """The text with prose, comments, pragmas and holes blank, every character in its place."""
    masked, out, at = mask_prose(text, kind), [], 0
    for _, start, end in spans(masked):
        out += [masked[at:start], blank(masked[start:end])]
        at = end
    return "".join([*out, masked[at:]])


def _batched(function, returns: str):
    import pandas as pd

    def run(text, path):
        return pd.Series([None if t is None else function(t, flavour(p)) for t, p in zip(text, path, strict=True)])

    run.__annotations__ = {"text": pd.Series, "path": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def holes(text: Column, path: Column) -> Column:
    """array<struct<start, end, line, col>> of a source file's holes; null for null."""
    return _batched(find_holes, HOLES)(text, path)


def code(text: Column, path: Column) -> Column:
    """code_only of a source file; null for null."""
    return _batched(code_only, "string")(text, path)
