"""Token counts by prefix dynamic programming over a byte-fallback BPE piece model.

For each prefix of a text the last token of its encoding is the one piece that ends there and forms a stable pair with
the last token of the prefix before it; a sequence of pieces is the encoding exactly if each piece encodes to itself and
each neighbouring pair does. So one pass gives the exact count at every prefix, which is stored: totals, truncation and
budget questions are looked up in it without encoding again.

Texts fall apart into units (a run of spaces and the word after it) that no token crosses. A batch's distinct units are
found by Arrow and take the pass together, one place of all units after another, as arrays; nothing is remembered from
batch to batch, so memory is that of a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Lookup, bound_batches, lean, scatter, text_bytes

SPACE = "▁"
#: Characters of a unit that is counted on its own.
LONG = 256


class PrefixCounter:
    """Counts for models with an identity normalizer, a leading space and byte fallback (checked when it is loaded)."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with an identity normalizer and a leading space are supported")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores):
            raise ValueError("pieces that go on after a space aren't supported")
        # A character that no piece holds never merges, so texts fall apart there; words fall apart at spaces.
        self.newline = not any("\n" in p for p in self.scores)
        # Pieces in order of merging: the best score first. A piece's number is its place; characters come last.
        pieces = sorted(self.scores, key=lambda p: (len(p) == 1, -self.scores[p]))
        self.number = {p: k for k, p in enumerate(pieces)}
        splits = [self._split(p) for p in pieces]
        #: The halves that a piece is merged from when it stands alone; itself for a character; none if it never is.
        self.left = np.array([k if s is None else s[0] for k, s in enumerate(splits)])
        self.right = np.array([k if s is None else s[1] for k, s in enumerate(splits)])
        self.alone = self.left >= 0
        self.pieces = pieces
        # Pieces that hold one which is merged from better-scored halves than itself: when they come to be isn't told by their number.
        self.early = np.zeros(len(pieces), bool)
        for k, p in sorted(enumerate(pieces), key=lambda kp: len(kp[1])):
            halves = [h for h in (self.left[k], self.right[k]) if h != k]
            self.early[k] = any(self.early[h] or len(pieces[h]) > 1 and h > k for h in halves)
        joins = {(self.number[p[:i]], self.number[p[i:]]): k for k, p in enumerate(pieces) for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number}
        self.width = np.uint64(len(pieces))
        keys = np.array([a * len(pieces) + b for a, b in joins], np.uint64)
        self.joined = Lookup(scatter(keys), np.array(list(joins.values()), np.int64), 22)
        # Pieces by length and a hash of their characters; equal hashes among them are refused here, and a text's
        # characters enter by number, so only characters of pieces are ever hashed.
        self.lengths = sorted({len(p) for p in pieces if self.alone[self.number[p]]})
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.uint32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bytes_of = np.ones(0x110000, np.int8)
        self.bytes_of[0x80:], self.bytes_of[0x800:], self.bytes_of[0x10000:] = 2, 3, 4
        self.tables = {}
        for n in self.lengths:
            own = [p for p in pieces if len(p) == n and self.alone[self.number[p]]]
            chars = np.array([[self.letter[ord(c)] for c in p] for p in own], np.uint64)
            h = chars[:, 0]
            for j in range(1, n):
                h = scatter(h) + chars[:, j]
            h = scatter(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have one hash")
            self.tables[n] = Lookup(h, np.array([self.number[p] for p in own]), 20)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair joins first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        pairs = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best, at = None, -1
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])
        return parts

    def _split(self, piece: str):
        """Numbers of the two pieces that the last merge of this piece joins; None for a character, (-1, -1) if merging gives something else."""
        if len(piece) == 1:
            return None
        parts, last = list(piece), None
        while len(parts) > 1:
            best, at = max(((self.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == float("-inf"):
                return (-1, -1)
            last = parts[-at], parts[1 - at]
            parts[-at : 2 - at] = ["".join(last)]
        return self.number[last[0]], self.number[last[1]]

    def stable(self, a, b):
        """For arrays of pieces, whether these neighbours encode to themselves.

        They don't exactly if some merge would join the end of one with the beginning of the other before the merges
        that make them whole. So both are taken apart again, the later merge first, and each pair of ends is looked up.
        """
        import numpy as np

        out = np.ones(len(a), bool)
        odd = self.early[a] | self.early[b]
        for k in np.flatnonzero(odd).tolist():
            x, y = self.pieces[a[k]], self.pieces[b[k]]
            out[k] = self.merge(x + y) == [x, y]
        rows = np.flatnonzero(~odd)
        a, b = a[rows], b[rows]
        # A merge at the seam must come before this one to spoil the pair: on the left side it also wins ties, on the right it doesn't.
        limit = np.full(len(rows), 2 * int(self.width) + 2, np.int64)
        while len(rows):
            at = self.joined(scatter(a.astype(np.uint64) * self.width + b.astype(np.uint64)))
            spoilt = (at >= 0) & (2 * at < limit)
            out[rows[spoilt]] = False
            la, lb = self.left[a] == a, self.left[b] == b  # characters
            go = ~spoilt & ~(la & lb)
            rows, a, b, limit, la, lb = rows[go], a[go], b[go], limit[go], la[go], lb[go]
            # the one merged later comes apart; of equals the right one, as the left is merged first
            first = ~la & (lb | (a > b))
            limit = np.where(first, 2 * a, 2 * b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def walk(self, unit: str, known: dict) -> list[int]:
        """Token count at each character's end of one unit; known: pairs of this batch."""
        counts, last, number, alone = [0], [None], self.number, self.alone
        for i in range(1, len(unit) + 1):
            char = unit[i - 1]
            if not self.letter[ord(char)]:  # bytes instead; nothing merges with them
                counts.append(counts[-1] + int(self.bytes_of[ord(char)]))
                last.append(None)
                continue
            for n in reversed(self.lengths):
                if n <= i and (k := number.get(unit[i - n : i])) is not None and alone[k]:
                    before = last[i - n]
                    if before is not None and (before, k) not in known:
                        x, y = self.pieces[before], self.pieces[k]
                        known[before, k] = self.merge(x + y) == [x, y]
                    if before is None or known[before, k]:
                        counts.append(counts[i - n] + 1)
                        last.append(k)
                        break
        return counts[1:]

    def prefixes(self, units: list[str]):
        """(token count at each character's end, on end for all units; where each unit begins and the last ends)."""
        import numpy as np

        if any(len(u) > LONG for u in units):  # too few at a time for arrays
            known: dict = {}
            short, ends = self.prefixes([u for u in units if len(u) <= LONG])
            short, parts = iter(np.split(short, ends[1:-1])), []
            for u in units:
                parts.append(np.array(self.walk(u, known), np.int64) if len(u) > LONG else next(short))
            return np.concatenate(parts), np.cumsum([0, *map(len, units)])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([0, *map(len, units)])
        letters = self.letter[points].astype(np.uint64)
        sizes = np.diff(ends)
        within = (np.arange(len(points)) - np.repeat(ends[:-1], sizes)).astype(np.int16 if len(sizes) and sizes.max() < 2**15 else np.int64)  # short numbers sort fast
        # (place, piece) for each piece that ends at a place, by its length; a piece lies in one unit and has no unknown letter
        h, whole, cands = letters, letters > 0, []
        for n in range(1, self.lengths[-1] + 1):
            if n > 1:
                h = scatter(h[:-1]) + letters[n - 1 :]
                whole = whole[:-1] & (letters[n - 1 :] > 0)
            if n in self.tables:
                fine = np.flatnonzero(whole & (within[n - 1 :] >= n - 1))
                if not len(fine):
                    break
                got = self.tables[n](scatter(h[fine]))
                hit = got >= 0
                cands.append(((fine[hit] + n - 1).astype(np.int32), got[hit].astype(np.int32), np.full(int(hit.sum()), n, np.int32)))
        place, piece, length = (np.concatenate(x) for x in zip(*cands, strict=True)) if cands else (np.zeros(0, int),) * 3
        ends_at = within[place]
        order = np.argsort(ends_at, kind="stable")
        place, piece, length = place[order], piece[order], length[order]
        longest = int(sizes.max()) if len(sizes) else 0
        steps = np.r_[0, np.cumsum(np.bincount(ends_at, minlength=longest))]
        count, last = np.zeros(len(points), np.int64), np.full(len(points), -1, np.int32)
        alien = np.flatnonzero(letters == 0)  # bytes instead; nothing merges with them
        alien = alien[np.argsort(within[alien], kind="stable")]
        alien_steps = np.r_[0, np.cumsum(np.bincount(within[alien], minlength=longest))]
        for i in range(len(steps) - 1):
            at, of, n = (x[steps[i] : steps[i + 1]] for x in (place, piece, length))
            if len(at):
                whole_unit = n == i + 1
                before = np.where(whole_unit, -1, last[at - n])
                free = before < 0
                ok = free.copy()
                rest = np.flatnonzero(~free)
                if len(rest):
                    pairs = before[rest].astype(np.int64) * int(self.width) + of[rest]
                    distinct, back = np.unique(pairs, return_inverse=True)
                    ok[rest] = self.stable(distinct // int(self.width), distinct % int(self.width))[back]
                at, of, n, whole_unit = at[ok], of[ok], n[ok], whole_unit[ok]
                count[at] = 1 + np.where(whole_unit, 0, count[at - n])
                last[at] = of
            if alien_steps[i] < alien_steps[i + 1]:
                at = alien[alien_steps[i] : alien_steps[i + 1]]
                count[at] = self.bytes_of[points[at]] + (count[at - 1] if i else 0)
        return count, ends

    def tables_of(self, raw, offsets):
        """(token count at the end of each character of each text, on end; where each text begins and the last ends, by characters).

        raw, offsets: as of common.text_bytes.
        """
        import numpy as np
        import pyarrow as pa

        # Before each text that isn't empty comes a space; spaces and the sign for them are one.
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(raw, offsets[full], 0x20) if len(full) else raw
        begins = offsets[full] + np.arange(len(full))
        if (raw == 0xE2).any() and (sign := (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
            gone = np.zeros(len(data), bool)
            at = np.flatnonzero(sign)
            data = data.copy()
            data[at] = 0x20
            gone[at + 1] = gone[at + 2] = True
            begins = begins - np.cumsum(np.r_[0, gone])[begins]
            data = data[~gone]
        space = data == 0x20
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        if self.newline:
            line = data == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[begins] = True
        units = np.append(np.flatnonzero(cut), len(data))
        column = pa.Array.from_buffers(pa.large_binary(), len(units) - 1, [None, pa.py_buffer(units), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = [x.decode().replace(" ", SPACE) for x in column.dictionary.to_pylist()]
        which = column.indices.to_numpy().astype(np.int64)
        counts, ends = self.prefixes(distinct)
        sizes = np.diff(ends)[which]
        first = np.cumsum(np.r_[0, sizes])
        total = counts[ends[1:] - 1][which] if len(distinct) else np.zeros(0, np.int64)
        base = np.cumsum(np.r_[0, total])  # tokens before each unit, over all texts
        of_text = np.searchsorted(units, begins)  # each text's first unit
        text_base = np.repeat(base[of_text], np.diff(np.append(of_text, len(which))))
        table = counts[np.repeat(ends[:-1][which] - first[:-1], sizes) + np.arange(first[-1])] + np.repeat(base[:-1] - text_base, sizes)
        # without the space before each text
        shown = np.ones(len(table), bool)
        shown[first[of_text]] = False
        chars = np.zeros(len(offsets) - 1, np.int64)
        chars[full] = np.diff(np.append(first[of_text], len(table))) - 1
        return table[shown], np.cumsum(np.r_[0, chars])

    def table(self, text: str) -> list[int]:
        """Token count of every prefix of text by characters, the empty one first."""
        import numpy as np

        raw = np.frombuffer(text.encode(), np.uint8)
        return [0, *self.tables_of(raw, np.array([0, len(raw)]))[0].tolist()]


def fit(table, limit: int) -> int:
    """Characters of the longest prefix of at most limit tokens, by a text's stored counts (without the empty prefix)."""
    import numpy as np

    within = np.flatnonzero(np.asarray(table) <= limit)
    return int(within[-1]) + 1 if len(within) else 0


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars[, prefix_counts]) for each row.

    n_tokens: as the model's library counts the whole text; fit_chars: characters of the longest prefix of at most
    limit tokens; prefix_counts (on request): the count at every prefix by characters, the empty one first, for later
    questions (budget). All three come from the one table of a batch. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows give repeated results, null ids stay null, other columns are ignored. A narrow map: no shuffle, a batch
    of rows in memory.
    """
    bound_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, key), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())])
    if prefixes:
        out = out.add("prefix_counts", T.ArrayType(T.IntegerType()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = counter(model)
        for batch in batches:
            raw, offsets = text_bytes(batch, "__text")
            table, ends = c.tables_of(raw, offsets)
            chars = np.diff(ends)
            totals = np.where(chars > 0, np.append(table, 0)[np.maximum(ends[1:] - 1, 0)], 0)
            fits = chars.copy()
            for k in np.flatnonzero(totals > limit).tolist():
                fits[k] = fit(table[ends[k] : ends[k + 1]], limit)
            cols = [batch.column("__id"), pa.array(np.diff(offsets)), pa.array(totals), pa.array(fits)]
            if prefixes:
                with_empty = np.insert(table, ends[:-1], 0).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(with_empty)))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(lean(run), out)


def budget(counted: DataFrame, limit: int, name: str = "fit_chars") -> DataFrame:
    """counted with, for another limit, the characters of each text's longest prefix within it, looked up in its stored prefix_counts. DataFrame operations only."""
    fits = F.expr(f"array_position(reverse(transform(prefix_counts, c -> c <= {int(limit)})), true)")
    return counted.withColumn(name, (F.size("prefix_counts") - fits).cast("long"))
