"""What the operators of this folder share: words, shared storage, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, about.
BATCH = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stash(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors. tidy: what was shuffled for it is large, so free it now."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if tidy:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stashed_at = path
    return out


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished jobs deleted now: that waits for the driver's JVM to collect its garbage, which on a long job is late. What the listeners hold goes with the second collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by bytes as well as by rows: a Python worker then holds BATCH bytes of input, or one row, and what it makes of them. Holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def give_back() -> None:
    """Hand what a Python worker has freed back to the machine: workers stay for later tasks, and the allocators of C and Arrow keep what they had at most. Does nothing where there is no such call."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function over batches that gives back memory every few batches and when it ends."""

    def lean_run(batches):
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                del out
                if k % 8 == 0:
                    give_back()
        finally:
            give_back()

    return lean_run


def texts(batch, name: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_bytes(batch, name: str):
    """(bytes of all texts on end, where each begins and the last ends) of a text column, without a Python object a row; null counts as empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(name).cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_table(raw, offsets, lower: bool = False):
    """(bytes of all words on end, where each begins and the last ends, number of each text's first word and the last one's end): runs of bytes that aren't white space; A-Z lower-cased on demand."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    kept = ~blank[raw]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = kept[edges]
    places = np.flatnonzero(begins)
    before = np.cumsum(kept, dtype=np.int64)
    at = np.append(before[places] - 1, before[-1] if len(before) else 0)
    bare = raw[kept]
    if lower:
        case = np.arange(256, dtype=np.uint8)
        case[ord("A") : ord("Z") + 1] += 32
        bare = case[bare]
    return bare, at, np.searchsorted(places, offsets)


def arrow_words(bare, at):
    """The words of word_table as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(bare))])


def word_hashes(bare, at):
    """A 64-bit hash of each word of word_table, the same on every machine: eight bytes after eight, all words at once. Words of one length up to eight bytes never collide."""
    import numpy as np

    size = np.diff(at)
    eight = np.lib.stride_tricks.sliding_window_view(np.append(bare, np.zeros(8, np.uint8)), 8)
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    out = size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    active, place, left = None, at[:-1], size
    while len(place):
        chunk = eight[place].view("<u8").ravel() & masks[np.minimum(left, 8)]
        seed = out if active is None else out[active]
        mixed = scatter(seed * np.uint64(0x9E3779B97F4A7C15) + chunk)
        if active is None:
            out = mixed
        else:
            out[active] = mixed
        more = np.flatnonzero(left > 8)
        active = more if active is None else active[more]
        place, left = place[more] + 8, left[more] - 8
    return out


def lists(arrays, dtype="int64"):
    """Numpy arrays as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *arrays])))


class Lookup:
    """Numbers by 64-bit key, for whole arrays: a table of marks by the key's top bits rules most others out."""

    def __init__(self, keys, values, bits: int):
        import numpy as np

        order = np.argsort(keys)
        self.keys, self.values, self.shift = keys[order], values[order], np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[self.keys >> self.shift] = True

    def __call__(self, keys):
        """The value of each key, -1 for others."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        at = np.flatnonzero(self.marks[keys >> self.shift])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[place] == keys[at]
        out[at[same]] = self.values[place[same]]
        return out


def scatter(x):
    """A bijection of 64-bit numbers that spreads them over the top bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def take_lists(values, ends, which):
    """Of lists on end (ends: where each begins and the last ends), the chosen ones on end, and where each of these begins and the last ends."""
    import numpy as np

    sizes = np.diff(ends)[which]
    out = np.cumsum(np.r_[0, sizes])
    return values[np.repeat(ends[:-1][which] - out[:-1], sizes) + np.arange(out[-1])], out


def window_hashes(codes, size: int):
    """A 64-bit hash of each run of size codes, by the place where it starts."""
    import numpy as np

    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = codes[:n] * odd
    for k in range(1, size):
        h ^= h >> np.uint64(29)
        h *= odd
        h += codes[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def lowest(link, ids):
    """For each row the smallest id of its component, by the links within one square table."""
    import numpy as np

    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that links reach.

    Alternating large-star and small-star rounds: each groups a node's neighbours by their minimum, so no component
    is ever held in one place; rounds grow with the logarithm of the longest path. Self-loops and nulls are ignored.
    """
    x, y = F.col(a), F.col(b)
    star = stash(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "edges",
    )
    before = (0, 0) if star.isEmpty() else None
    for _ in range(most_rounds):
        if before == (0, 0):
            break
        last = star
        both = star.select("u", "v").unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # every large-star edge points from a larger to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stash(low.select("u", F.col("m").alias("v")).unionAll(rest).distinct(), "stars")
        drop(last)
        now = star.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
