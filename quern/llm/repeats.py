"""Substring dedup by level-wise doubling: words of windows that also start earlier are removed.

Short windows come first. Of the short windows in a whole one that of the smallest hash stands for it: equal windows have
equal ones, so where that short window is found in no other document, no window it stands for is; about one in six
positions is counted rather than each. Only windows whose short one is repeated are extended to twice its length and
counted again, until the whole length is reached or no candidate survives. What survives is removed from every document
but the first that holds it. Windows are judged on the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, bound_batches, drop, lean, lists, stash, text_bytes, window_hashes, word_hashes, word_table

WINDOW = 20
#: Stands for a null id where ids are whole numbers: it comes after every other.
LAST = 2**63 - 1


def _smallest(h, width: int):
    """Minimum of each run of width values."""
    import numpy as np

    done = 1
    while 2 * done <= width:
        h = np.minimum(h[: len(h) - done], h[done:])
        done *= 2
    extra = width - done
    return np.minimum(h[: len(h) - extra], h[extra:]) if extra else h


def representatives(codes, size: int, length: int):
    """For each start of a window of size words, the hash of the one of length words in it that stands for it."""
    h = window_hashes(codes, length)
    return (_smallest(h, size - length + 1) if len(h) >= size - length + 1 else h[:0]).view("int64")


def _key(id_col: str, docs: DataFrame):
    """Ids in an order where null comes last."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def _digests(codes, first) -> list[tuple[int, int]]:
    """For each text 128 bits that tell sequences of word hashes apart."""
    import hashlib

    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        d = hashlib.blake2b(codes[lo:hi].tobytes(), digest_size=16).digest()
        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), start: int | None = None) -> DataFrame:
    """(id, *keep, n_words, n_removed, removed array<struct<start, end>>, kept_text) for each row.

    removed: spans of words, the end excluded; kept_text: the other words joined by one space. The first occurrence of a
    window is the one in the smallest id (null: after all others), and there the earliest. A null or empty text has no
    words. Rows that repeat an id are judged each on its own against other ids. Ids are of any type that Spark orders; of
    whole numbers the largest, 2**63 - 1, counts as null.
    Columns that keep doesn't name are ignored, whatever their names; an empty table gives an empty result. start: the
    first level's length, half of size if not given; size is start doubled some times.
    """
    length = start or size // 2
    if length < 1 or size % length or (size // length) & (size // length - 1):
        raise ValueError("size is start, doubled some times")
    if clash := {*keep, id_col} & {"n_words", "n_removed", "removed", "kept_text"}:
        raise ValueError(f"rename {sorted(clash)}: results have these names")
    bound_batches(docs.sparkSession)
    d = docs.select(_key(id_col, docs).alias("id"), F.col(text_col).alias("text"))
    key = d.schema["id"].dataType.simpleString()

    # Equal texts: only the first goes on, the others repeat it whole. Level 1 is counted with them.
    first_length = length

    def look(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bare, at, first = word_table(*text_bytes(batch, "text"))
            codes = word_hashes(bare, at)
            whole, short = representatives(codes, size, size), representatives(codes, size, first_length)
            digests, again, found = _digests(codes, first), [], []
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                end = max(lo, hi - size + 1)
                again.append(len(np.unique(whole[lo:end])) < end - lo)
                found.append(np.unique(short[lo:end]))
            if batch.num_rows:
                f1, f2 = zip(*digests, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(again), lists(found)], ["id", "f1", "f2", "again", "found"])

    looked = stash(d.mapInArrow(lean(look), f"id {key}, f1 long, f2 long, again boolean, found array<long>").where(F.size("found") > 0), "looked")
    texts_of = stash(looked.select("id", "f1", "f2"), "digests")
    first = stash(looked.groupBy("f1", "f2").agg(F.min("id").alias("first"), F.count("*").alias("c"), F.max("again").alias("again")), "texts")
    again = first.where("again").select(F.col("first").alias("id")).distinct()
    counted = stash(looked.select("id", "found").join(first.select(F.col("first").alias("id")).distinct(), "id", "left_semi").select("id", F.explode("found").alias("h")), "windows", tidy=True)
    drop(looked)

    while True:
        # Windows of this length that occur in several texts, and the first of these.
        several = counted.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") != F.col("hi")).select("h", "lo")
        several = stash(several, "several", tidy=True)
        if length == size or several.isEmpty():
            break
        seeds = stash(counted.join(several, "h").groupBy("id").agg(F.collect_set("h").alias("seeds")), "seeds", tidy=True)
        drop(counted)

        def extend(batches, length=length):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                bare, at, first = word_table(*text_bytes(batch, "text"))
                codes = word_hashes(bare, at)
                short, twice = representatives(codes, size, length), representatives(codes, size, 2 * length)
                column, found = batch.column("seeds"), []
                values, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
                for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    end = max(lo, hi - size + 1)
                    found.append(np.unique(twice[lo:end][np.isin(short[lo:end], values[ends[k] : ends[k + 1]])]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(found)], ["id", "found"])

        extended = d.join(seeds, "id").mapInArrow(lean(extend), f"id {key}, found array<long>")
        counted = stash(extended.select("id", F.explode("found").alias("h")), "windows", tidy=True)
        drop(seeds)
        drop(several)
        length *= 2

    # Removal from whole texts: of copies everything, else what later windows and those repeated within the text cover.
    later = counted.join(several, "h").where(F.col("id") != F.col("lo")).groupBy("id").agg(F.collect_set("h").alias("later"))
    copies = texts_of.join(first.where(F.col("c") > 1).select("f1", "f2", "first"), ["f1", "f2"]).where(F.col("id") != F.col("first")).groupBy("id").agg(F.collect_set("f1").alias("copy"))
    marks = later.join(again, "id", "full_outer").join(copies, "id", "full_outer")
    marks = stash(marks.select("id", "later", "copy"), "marks", tidy=True)
    for table in (counted, several, texts_of, first):
        drop(table)
    names = [id_col, *keep]
    span = "array<struct<start: int, end: int>>"
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]) + f", n_words long, n_removed long, removed {span}, kept_text string"

    def remove(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            bare, at, first = word_table(*text_bytes(batch, "text"))
            words = arrow_words(bare, at)
            known = np.flatnonzero(batch.column("known").is_valid().to_numpy(zero_copy_only=False)).tolist()
            cover = np.zeros(len(words) + 1, np.int64)
            if known:
                codes = word_hashes(bare, at)
                hashed = window_hashes(codes, size).view(np.int64)
                digests = _digests(codes, first) if batch.column("copy").null_count < batch.num_rows else None
            for k in known:
                lo, hi = int(first[k]), int(first[k + 1])
                own = hashed[lo : max(lo, hi - size + 1)]
                if not len(own):
                    continue
                if (copy := batch.column("copy")[k].as_py()) and digests[k][0] in copy:
                    bad = np.ones(len(own), bool)
                else:
                    bad = np.ones(len(own), bool)
                    bad[np.unique(own, return_index=True)[1]] = False
                    bad |= np.isin(own, np.array(batch.column("later")[k].as_py() or [], np.int64))
                places = lo + np.flatnonzero(bad)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + size, -1)
            gone = cover.cumsum()[:-1] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
            removed[first[:-1] == first[1:]] = 0
            # spans end with a text
            edge = np.zeros(len(gone) + 1, bool)
            edge[first] = True
            opens = gone & (edge[:-1] | ~np.r_[False, gone[:-1]]) if len(gone) else gone
            closes = gone & (edge[1:] | ~np.r_[gone[1:], False]) if len(gone) else gone
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            text_no = np.searchsorted(first, start, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array((start - first[text_no]).astype(np.int32)), pa.array((end - first[text_no]).astype(np.int32))], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)), spans)
            rest = words.filter(pa.array(~gone)) if gone.any() else words
            ends = first - np.r_[0, np.cumsum(removed)]
            kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), rest), pa.scalar(b" ", rest.type)).cast(pa.large_string()).cast(pa.string())
            cols = [batch.column(f"k{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first)), pa.array(removed), spans, kept], [*names, "n_words", "n_removed", "removed", "kept_text"])

    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(names)]
    rows = docs.select(*cols, _key(id_col, docs).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(marks.withColumn("known", F.lit(True)), "id", "left")
    return rows.mapInArrow(lean(remove), schema)
