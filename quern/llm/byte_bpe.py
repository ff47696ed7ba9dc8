"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece of text is encoded by halves; two encoded neighbours join by encoding a window around the seam again, which
grows until the tokens on either side of it provably stay: a token sequence is the encoding exactly if every pair of
neighbours in it encodes to itself, so it is enough that the pairs at both edges of the window do. The left half is a
power of two long, so runs of one character mostly join without a window. Decoding concatenates the tokens' bytes up the
same tree, or for a batch at once, by running sums of their lengths.

The leaves of all distinct pieces of a batch are merged together, as arrays; nothing is remembered from batch to batch.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Lookup, bound_batches, lean, scatter, take_lists, text_bytes

#: Bytes that are merged directly; longer runs are halved.
LEAF = 32
#: Fixed value: a pattern for which a space between two characters that aren't white space always begins a match, so texts may be cut there.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Encodes and decodes by a rank file (base64 token, rank a line); pieces are what the pattern matches."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.split = regex.compile(pattern).findall
        self.cut = pattern == WORDS
        self.token_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.token_ends = np.cumsum([0, *map(len, self.bytes)])
        self.of_byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        rank, self.width = self.ranks.get, np.uint64(len(self.bytes))
        joins = [(a * len(self.bytes) + b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := rank(t[:i])) is not None and (b := rank(t[i:])) is not None]
        keys, values = zip(*joins, strict=True)
        self.joined = Lookup(scatter(np.array(keys, np.uint64)), np.array(values, np.int64), 22)

    def merge(self, run: bytes) -> list[bytes]:
        """Direct merging of a run: the lowest rank first, the leftmost of equals."""
        rank = self.ranks.get
        parts = [run[i : i + 1] for i in range(len(run))]
        after, before = list(range(1, len(run) + 1)), list(range(-1, len(run) - 1))
        todo = [(r, i) for i in range(len(run) - 1) if (r := rank(run[i : i + 2])) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if parts[i] is None or j >= len(parts) or rank(parts[i] + parts[j]) != r:
                continue  # a neighbour has changed since
            parts[i], parts[j] = parts[i] + parts[j], None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (r := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(todo, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(todo, (r, h))
        return [p for p in parts if p is not None]

    def merge_all(self, data, ends):
        """merge for many runs on end, as arrays: (token numbers on end, where each run's begin and the last ends)."""
        import numpy as np

        none = np.int64(1 << 40)
        sizes = np.diff(ends)
        ids, run = self.of_byte[data], np.repeat(np.arange(len(sizes)), sizes)
        pair = lambda a, b: (lambda r: np.where(r < 0, none, r))(self.joined(scatter(a.astype(np.uint64) * self.width + b.astype(np.uint64))))
        ranks = np.full(len(ids), none)  # of each token with the one after it
        inner = np.flatnonzero(run[1:] == run[:-1])
        ranks[inner] = pair(ids[inner], ids[inner + 1])
        over_ids, over_run = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(ranks, starts)
            going = np.repeat(least < none, lengths)
            if not going.all():
                over_ids.append(ids[~going])
                over_run.append(run[~going])
                ids, run, ranks = ids[going], run[going], ranks[going]
                lengths, least = lengths[least < none], least[least < none]
                starts = np.cumsum(np.r_[0, lengths])[:-1]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, lengths))
            at = hits[np.r_[True, run[hits[1:]] != run[hits[:-1]]]]  # the leftmost of each run
            ids[at] = least
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            at = at - np.arange(len(at))  # each run before has lost one token
            ids, run, ranks = ids[~gone], run[~gone], ranks[~gone]
            ranks[at] = none
            right = at[(at + 1 < len(ids))]
            right = right[run[right + 1] == run[right]]
            left = at[at > 0] - 1
            left = left[run[left] == run[left + 1]]
            for x in (right, left):
                ranks[x] = pair(ids[x], ids[x + 1])
        if not over_ids:
            return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
        ids, run = np.concatenate(over_ids), np.concatenate(over_run)
        return ids[np.argsort(run, kind="stable")], np.r_[0, np.cumsum(np.bincount(run, minlength=len(sizes)))]

    def pair(self, a: bytes, b: bytes) -> bool:
        """Whether these neighbours encode to themselves."""
        return self.merge(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The monoid's product: the encoding of both runs together."""
        if not left or not right or self.pair(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(left[i:] + right[:j]))
            if (not i or self.pair(left[i - 1], window[0])) and (j == len(right) or self.pair(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def tree(self, run: bytes, leaves=None) -> list[bytes]:
        """The encoding of a run; leaves: gives the encoding of the leaf at a place, if they were merged before."""
        leaf = leaves or (lambda at, to: self.merge(run[at:to]))

        def grow(at: int, to: int) -> list[bytes]:
            if to - at <= LEAF:
                return leaf(at, to)
            half = 1 << ((to - at - 1).bit_length() - 1)
            return self.join(grow(at, at + half), grow(at + half, to))

        return grow(0, len(run))

    def encode_pieces(self, pieces: list[bytes]):
        """(token numbers of all pieces on end, where each one's begin and the last ends)."""
        import numpy as np

        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0).tolist()
        # halving by powers of two gives leaves of LEAF bytes, and a shorter last one
        leaves = [pieces[k][i : i + LEAF] for k in rest for i in range(0, len(pieces[k]), LEAF)]
        ids, ends = self.merge_all(np.frombuffer(b"".join(leaves), np.uint8), np.cumsum([0, *map(len, leaves)]))
        values, places, at = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)], 0
        short = []
        for k in rest:
            n = -(-len(pieces[k]) // LEAF)
            if n == 1:
                short.append((k, at))
            else:
                token = self.bytes.__getitem__
                made = self.tree(pieces[k], lambda a, to, at=at: list(map(token, ids[ends[at + a // LEAF] : ends[at + a // LEAF + 1]].tolist())))
                values.append(np.array([self.ranks[t] for t in made]))
                places.append(np.full(len(made), k))
            at += n
        if short:
            k, leaf = map(np.array, zip(*short, strict=True))
            got, of = take_lists(ids, ends, leaf)
            values.append(got)
            places.append(np.repeat(k, np.diff(of)))
        places, values = np.concatenate(places), np.concatenate(values)
        return values[np.argsort(places, kind="stable")], np.r_[0, np.cumsum(np.bincount(places, minlength=len(pieces)))]

    def encode_texts(self, raw, offsets):
        """(token numbers of all texts on end, where each one's begin and the last ends); raw, offsets: as of common.text_bytes."""
        import numpy as np
        import pyarrow as pa

        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets[:-1]] = True
        if self.cut and len(raw) > 2:
            mark = np.zeros(256, bool)
            mark[0x21:0x7F] = True
            ends_mark = mark[raw]
            begins_mark = ends_mark | (raw == 0xC3)  # with the byte after it, a letter of U+00C0 to U+00FF, or one of two signs
            ends_mark[1:] |= raw[:-1] == 0xC3
            begins[1 : len(raw) - 1] |= (raw[1:-1] == 0x20) & ends_mark[:-2] & begins_mark[2:]
        chunks = np.append(np.flatnonzero(begins[: len(raw)]), len(raw))
        column = pa.Array.from_buffers(pa.large_binary(), len(chunks) - 1, [None, pa.py_buffer(chunks), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        split, number, found, ends = self.split, {}, [], [0]
        for chunk in column.dictionary.to_pylist():
            for piece in split(chunk.decode()):
                found.append(number.setdefault(piece, len(number)))
            ends.append(len(found))
        ids, id_ends = self.encode_pieces([p.encode() for p in number])
        pieces, _ = take_lists(np.array(found, np.int64), np.array(ends), column.indices.to_numpy())
        # tokens of each chunk: of its pieces
        of_chunk = np.r_[0, np.cumsum(np.diff(ends)[column.indices.to_numpy()])] if len(column) else np.zeros(1, np.int64)
        out, of_piece = take_lists(ids, id_ends, pieces)
        return out, of_piece[of_chunk[np.searchsorted(chunks, offsets)]]

    def encode(self, text: str) -> list[int]:
        import numpy as np

        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up the tree; leaves of 4096 tokens."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, token_ids array<int>, decoded binary) for each row; decoded is made from token_ids alone.

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated results, null ids stay null, columns that
    keep doesn't name are ignored, whatever their names; an empty table gives an empty result. A narrow map without a
    shuffle; long texts cost time in proportion, and so do long pieces but for a logarithm.
    """
    if clash := {*keep, id_col} & {"token_ids", "decoded"}:
        raise ValueError(f"rename {sorted(clash)}: results have these names")
    bound_batches(docs.sparkSession)
    out = T.StructType([docs.schema[c] for c in (id_col, *keep)]).add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(ranks, pattern)
        for batch in batches:
            ids, ends = c.encode_texts(*text_bytes(batch, "__text"))
            decoded, at = take_lists(c.token_bytes, c.token_ends, ids)
            decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(decoded)])
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], listed, decoded], [f.name for f in out])

    cols = [F.col(c).alias(f"__{i}") for i, c in enumerate((id_col, *keep))]
    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(lean(run), out)


def ids_digest(ids: str = "token_ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
