"""Fill-in-middle: texts cut at two seeded unit borders and put in prefix-suffix-middle or suffix-prefix-middle order, and back."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back

#: Fixed: a unit is a word with the white space before it, or white space at a text's end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Fixed marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80

MADE = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


@lru_cache(4)
def _units():
    import regex

    return regex.compile(UNIT)


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points: eight bytes a unit."""
    return array("q", (m.end() for m in _units().finditer(text)))


def seeds(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row: two cuts, whether it is cut, and in which order."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def cut(key: str, text: str, marks=MARKS, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(key, seed)
    if not text or h3 % 100 >= cut_percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _check(marks) -> None:
    """A mark that begins as it ends could be found one place too early when a text is put together again."""
    for m in marks:
        if not m or any(m[:k] == m[-k:] for k in range(1, len(m))):
            raise ValueError(f"a mark must not be empty nor begin as it ends: {m!r}")
    if len(set(marks)) != 3 or any(x != y and x in y for x in marks for y in marks):
        raise ValueError("three marks, none within another")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, seed: int = SEED,
    cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output[, keep]) for each row.

    Both cuts, whether a text is cut and its order follow from seed and id alone, so reruns and repeated rows agree. A null
    text counts as empty; empty texts and those that hold a mark stay plain, with null lengths. A null id is seeded as an
    empty one and stays null. Other columns are ignored but for keep, which must not have the names made here. An empty
    table gives an empty one. A narrow map: no shuffle; a batch of about 2 MB, or one row, in memory.
    """
    _check(marks)
    clash = set(keep) & {id_col, *MADE.names}
    if clash:
        raise ValueError(f"names made here: {sorted(clash)}")
    bound_batches(docs.sparkSession)

    @F.pandas_udf(MADE)
    def cuts(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [cut(k, t, marks, seed, cut_percent, spm_percent) for k, t in zip(keys, texts, strict=True)]
        made = pd.DataFrame(rows, columns=MADE.names)
        give_back()
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made = docs.select(F.col(id_col), *keep, cuts(text(F.col(id_col)), text(F.col(text_col))).alias("__made"))
    return made.select(id_col, "__made.*", *keep)


def restored(form: Column | str = "form", output: Column | str = "output", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from, by its form alone: each mark is the first of its kind, since texts that hold one stay plain."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        x = F.locate(second, output, len(first) + 1)
        y = F.call_function("locate", F.lit(m), output, x)
        rest = F.length(output)
        return (
            F.substring(output, F.lit(len(first) + 1), x - len(first) - 1),
            F.substring(output, x + len(second), y - x - len(second)),
            F.substring(output, y + len(m), rest),
        )

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
