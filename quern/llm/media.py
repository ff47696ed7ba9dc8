"""Binary media columns: payloads as 8-bit grey PNG, read back with checksum tests, and low-frequency cosine hashes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean, texts

#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey image of whole rows; each row is stored plain or as differences to the left or to the row above, whichever is smallest in sum."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    every = np.stack([rows, left, up])
    cost = np.minimum(every, 256 - every.astype(np.int16)).sum(2, dtype=np.int64)
    kind = cost.argmin(0).astype(np.uint8)
    lines = np.concatenate([kind[:, None], every[kind, np.arange(len(rows))]], axis=1)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes):
    """The samples (rows x width, uint8) of an 8-bit grey PNG without interlace; ValueError where a checksum or the structure is wrong."""
    import numpy as np

    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size] or b"\0\0\0\0")[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("wrong size")
    lines = lines.reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    none = np.zeros(width, np.uint8)
    for y in range(height):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y - 1] if y else none
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            out[y] = _from_left(kind, line.tolist(), above.tolist())
        else:
            raise ValueError("unknown filter")
    return out


def _from_left(kind: int, line: list[int], above: list[int]) -> list[int]:
    """Rows whose samples need the one before: the average (3) and the nearest-of-three (4) predictor."""
    out, a, c = [], 0, 0
    for x, b in zip(line, above, strict=True):
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        a, c = (x + guess) & 255, b
        out.append(a)
    return out


def _cosines(n: int, k: int):
    import numpy as np

    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


def cosine_hash(image) -> str:
    """16 hex digits: which of 64 low-frequency cosine coefficients lie above their median, of the image reduced to 32 x 32 mean values."""
    import numpy as np

    tall, wide = image.shape
    rows, cols = np.arange(33) * tall / 32, np.arange(33) * wide / 32
    # sums above each of 33 heights and left of each of 33 widths, also where a span is less than a sample; of a tall image only sums are held
    above, total, done = np.zeros((33, wide)), np.zeros(wide, np.int64), 0
    for k, where in enumerate(rows):
        whole = int(where)
        total += image[done:whole].sum(0, dtype=np.int64)
        done = whole
        above[k] = total + (where - whole) * image[whole] if whole < tall else total
    left = np.zeros((33, wide + 1))
    left[:, 1:] = above.cumsum(1)
    whole = np.minimum(cols.astype(int), wide - 1)
    both = left[:, whole] + (cols - whole) * np.diff(left, axis=1)[:, whole]
    small = np.diff(np.diff(both, axis=0), axis=1) / (tall / 32 * wide / 32)
    c = _cosines(32, 8)
    low = np.round(c @ small @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary, payload binary, feature) for each row.

    The text's UTF-8 (null: empty) is filled with bytes 255 to a positive multiple of 576, stored as PNG (media), read
    back from it (payload) and hashed (feature). Equal texts give equal values; null ids stay null; other columns are
    ignored. A narrow map without a shuffle; rows are handed on a few at a time.
    """
    bound_batches(docs.sparkSession)
    out = T.StructType([docs.schema[id_col]]).add("n_bytes", "long").add("media", "binary").add("payload", "binary").add("feature", "string")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, media, payload, feature = [], [], [], []
                for raw in texts(batch, "__text"):
                    sizes.append(len(raw))
                    media.append(encode_png(raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)))
                    image = decode_png(media[-1])
                    payload.append(image.tobytes())
                    feature.append(cosine_hash(image))
                cols = [batch.column("__id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(feature)]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(lean(run), out)
