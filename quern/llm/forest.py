"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Each tree splits a bounded sample at the median along a random direction, again and again; points near a cut belong to
both sides. The trees then route every vector; leaves that are too large for all of them are split on by their own vectors,
level by level, until they are small or a bundle that cuts don't part. Vectors that share a leaf are compared in double
precision, and what links is joined to components. Equal vectors are compared once. Within a leaf, links are counted and joined there, so no
list of pairs is ever made; leaves too large for one task are compared block against block, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, lean, lowest, stash

#: Vectors that the trees' first cuts are fitted to, at most: those whose hash comes first. Every vector is routed.
SAMPLE = 16_384
TREES = 6
#: Vectors of a leaf that a split aims at, and rows of a leaf that one task compares.
LEAF, BLOCK = 200, 1_024
#: Half the width of the overlap, in units of the threshold's chord over the square root of the dimensions.
SPILL = 0.25
THRESHOLD = 0.9
SEED = 7
#: Random directions that the cuts are taken from.
DIRECTIONS = 256
#: Nodes of all trees, at most, 24 bytes each in every task; what is still too large then is compared block by block.
MOST_NODES = 4_000_000
#: Cuts in a row that don't part a bundle before it counts as one.
ATTEMPTS = 4


class Forest:
    """Trees as arrays over nodes: a node's direction, cut and two children; a leaf has none."""

    def __init__(self, sample, population: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, threshold: float = THRESHOLD, seed: int = SEED):
        import numpy as np

        size = sample.shape[1]
        self.rng = np.random.default_rng(seed)
        self.directions = self.rng.standard_normal((DIRECTIONS, size))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.margin = spill * np.sqrt(2 - 2 * threshold) / np.sqrt(max(1, size))
        self.way, self.cut, self.low, self.high = [], [], [], []
        self.roots = [self.leaf() for _ in range(trees)]
        along, scale = sample @ self.directions.T, population / max(1, len(sample))
        todo = [(root, np.arange(len(sample))) for root in self.roots]
        while todo:
            node, rows = todo.pop()
            if len(rows) * scale <= leaf or len(rows) < 16:
                continue
            at = along[rows, self.way[node]]
            cut = float(np.median(at))
            low, high = rows[at <= cut + self.margin], rows[at >= cut - self.margin]
            if max(len(low), len(high)) <= 0.8 * len(rows):  # else a bundle that a cut doesn't part
                todo += zip(self.split(node, cut), (low, high), strict=True)
        self.freeze()

    def leaf(self) -> int:
        self.way.append(int(self.rng.integers(DIRECTIONS)))
        self.cut.append(0.0)
        self.low.append(-1)
        self.high.append(-1)
        return len(self.way) - 1

    def split(self, node: int, cut: float) -> tuple[int, int]:
        self.cut[node], self.low[node], self.high[node] = cut, self.leaf(), self.leaf()
        return self.low[node], self.high[node]

    def freeze(self) -> None:
        import numpy as np

        self.table = np.array(self.way, np.int32), np.array(self.cut), np.array(self.low, np.int32), np.array(self.high, np.int32)

    def shared(self):
        """What routing needs."""
        return self.table, self.directions, self.roots, self.margin


def route(shared, vectors):
    """(row numbers, leaves, place of the row along the leaf's own direction), ordered by row and leaf: a row for each leaf that a vector belongs to."""
    import numpy as np

    (way, cut, low, high), directions, roots, margin = shared
    along = vectors @ directions.T
    rows, nodes = np.tile(np.arange(len(vectors)), len(roots)), np.repeat(np.array(roots, np.int64), len(vectors))
    done = []
    while len(rows):
        inner = low[nodes] >= 0
        done.append((rows[~inner], nodes[~inner]))
        rows, nodes = rows[inner], nodes[inner]
        at = along[rows, way[nodes]] - cut[nodes]
        left, right = at <= margin, at >= -margin
        rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([low[nodes[left]], high[nodes[right]]])
    rows, nodes = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int), np.zeros(0, int))
    order = np.lexsort((nodes, rows))
    rows, nodes = rows[order], nodes[order].astype(np.int64)
    return rows, nodes, along[rows, way[nodes]]


def grow(forest: Forest, reps: DataFrame, size: int, block: int, most: int) -> dict[int, int]:
    """Splits leaves of over 2 * block vectors further, at the mean of their own vectors, one level of all trees a pass; gives those that stay so large, and how many vectors they have."""
    spark, failed = reps.sparkSession, {}
    while True:
        shared = spark.sparkContext.broadcast(forest.shared())

        def sums(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    _, leaves, at = route(shared.value, unit(batch.column("vec"), size))
                    found, of, c = np.unique(leaves, return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(c, pa.int64()), pa.array(np.bincount(of, at, len(found)))], ["leaf", "c", "s"])

        tally = reps.select("vec").mapInArrow(lean(sums), "leaf long, c long, s double").groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
        large = {r["leaf"]: (r["c"], r["s"]) for r in tally.where(F.col("c") > 2 * block).collect()}  # as many as nodes at most
        before = {child: (parent, c, tries) for parent, (c, tries) in failed.items() for child in (forest.low[parent], forest.high[parent])}
        again = {}
        for leaf in sorted(large):
            c, s = large[leaf]
            _, had, tries = before.get(leaf, (0, 0, 0))
            tries = tries + 1 if had and c > 0.8 * had else 0
            if tries < ATTEMPTS and len(forest.way) < most:
                forest.split(leaf, s / c)
                again[leaf] = (c, tries)
        if not again:
            return {leaf: c for leaf, (c, _) in large.items()}
        failed = again
        forest.freeze()
        shared.unpersist()


def unit(column, size: int):
    """Rows of an Arrow list column as unit vectors in double precision."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _earlier(sets: list, leaf: int, mine, other):
    """Which pairs of rows share a leaf before this one, and so are counted there."""
    import numpy as np

    def table(own):
        row = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
        every = np.concatenate([sets[i] for i in own]) if len(own) else np.zeros(0, int)
        before = every < leaf
        return row[before], every[before]

    (ra, la), (rb, lb) = table(mine), table(other)
    both = np.intersect1d(la, lb)
    a, b = np.zeros((len(mine), len(both)), np.float32), np.zeros((len(other), len(both)), np.float32)
    for rows, leaves, out in ((ra, la, a), (rb, lb, b)):
        at = np.searchsorted(both, leaves)
        ok = (at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == leaves) if len(both) else np.zeros(len(leaves), bool)
        out[rows[ok], at[ok]] = 1
    return a @ b.T > 0


def compare(leaf: int, ids, weights, vectors, sets: list, side, threshold: float):
    """Links of a leaf's rows, or of one block (side 0) against another (side 1): (ids, links counted here, lowest id reached here)."""
    import numpy as np

    n = len(ids)
    link = np.zeros((n, n), bool)
    if side.any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = vectors[a] @ vectors[b].T >= threshold
        link[np.ix_(a, b)] = near
        link[np.ix_(b, a)] = near.T
        count = near & ~_earlier(sets, leaf, a, b)
        found = np.zeros(n, np.int64)
        found[a], found[b] = count @ weights[b], count.T @ weights[a]
    else:
        near = vectors @ vectors.T >= threshold
        np.fill_diagonal(near, False)
        near |= near.T
        link = near
        found = (near & ~_earlier(sets, leaf, np.arange(n), np.arange(n))) @ weights
    linked = link.any(1)
    return ids[linked], found[linked], lowest(link, ids)[linked]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF,
                    spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors that are null or zero or hold null or non-finite components link with nothing; vectors of different length
    don't link. Equal vectors link with each other, and rows that repeat an id count each. A row with a null id gets the
    links of its vector but is never a component's id. An empty table gives an empty result.
    """
    bound_batches(vectors.sparkSession)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = v.withColumn("k1", F.when(F.col("fine"), F.xxhash64("vec"))).withColumn("k2", F.when(F.col("fine"), F.hash("vec")))
    reps = keyed.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec")).withColumnRenamed("id", "own")
    reps, nameless = _numbered(reps)
    links = [
        _links(reps.where(F.size("vec") == r["size"]), r["size"], r["n"], threshold, trees, leaf, spill, sample, block, seed)
        for r in reps.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    ]
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionAll(more)
        found = stash(found, "links")
        counts = found.groupBy(F.col("id").alias("i")).agg(F.sum("links").alias("links"))
        comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), "component")
        reps = reps.join(counts, F.col("id") == F.col("i"), "left").join(comps, F.col("id") == F.col("c"), "left")
        reps = reps.select("k1", "k2", "own", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("root"))
    else:
        reps = reps.select("k1", "k2", "own", (F.col("m") - 1).alias("n"), F.col("id").alias("root"))
    if nameless:  # a component is named by its smallest id that a row has, none where no row has one
        least = reps.groupBy("root").agg(F.min("own").alias("least"))
        reps = reps.join(least, "root").select("k1", "k2", "n", F.col("least").alias("root"))
    reps = reps.select("k1", "k2", "n", "root")
    # the rows on the left are many, one class of equal vectors on the right each: Spark splits a hot class's rows
    out = keyed.select("id", "k1", "k2").join(reps.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))


def _numbered(reps: DataFrame) -> tuple[DataFrame, bool]:
    """reps, written, with id: own, or for classes of rows that all have a null id a hash that is no other's id; and whether there are such classes."""
    for salt in range(64):
        made = F.xxhash64("k1", "k2", F.lit(salt))
        out = stash(reps.withColumn("id", F.coalesce("own", made)), "vectors")
        if out.where(F.col("own").isNull()).isEmpty():
            return out, False
        if out.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > F.lit(1)).join(out.where(F.col("own").isNull()).select("id"), "id", "left_semi").isEmpty():
            return out, True
        drop(out)
    raise RuntimeError("no free numbers for vectors without an id")


def _links(reps: DataFrame, size: int, n: int, threshold: float, trees: int, leaf: int, spill: float, sample: int, block: int, seed: int) -> DataFrame:
    """(id, links, root) of the vectors of one length, a row for each leaf or block in which a vector links."""
    spark = reps.sparkSession
    some = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    grown = Forest(unit(some, size), n, trees, leaf, spill, threshold, seed)
    large = grow(grown, reps, size, block, MOST_NODES)
    blocks = {k: -(-c // block) for k, c in large.items()}
    forest = spark.sparkContext.broadcast(grown.shared())

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column("id").to_numpy()
                rows, leaves, _ = route(forest.value, unit(batch.column("vec"), size))
                sets = np.split(leaves, np.cumsum(np.bincount(rows, minlength=len(ids)))[:-1])
                keys = []
                for k, leaf_no in zip(rows.tolist(), leaves.tolist(), strict=True):
                    b = blocks.get(leaf_no)
                    if b is None:
                        keys.append((k, leaf_no, 0, 0, 0))
                    else:
                        own = (int(ids[k]) * 0x9E3779B97F4A7C15 & (2**64 - 1)) % 1_000_003 % b
                        keys += [(k, leaf_no, min(own, o), max(own, o), int(o < own)) for o in range(b)]
                if not keys:
                    continue
                row, leaf_no, one, two, side = map(np.array, zip(*keys, strict=True))
                packed = pa.array([sets[k].astype(np.int32).tobytes() for k in range(len(ids))], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf_no, pa.int64()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(side, pa.int32()), batch.column("id").take(take), batch.column("m").take(take), packed.take(take), batch.column("vec").take(take)],
                    ["leaf", "one", "two", "side", "id", "m", "sets", "vec"],
                )

    def judge(key, table):
        import numpy as np
        import pyarrow as pa

        ids, weights = table.column("id").to_numpy(), table.column("m").to_numpy()
        x = unit(table.column("vec").combine_chunks(), size)
        sets = [np.frombuffer(b, np.int32) for b in table.column("sets").to_pylist()]
        side = table.column("side").to_numpy()
        leaf_no, one, two = (k.as_py() for k in key)
        got = compare(leaf_no, ids, weights, x, sets, side if one != two else np.zeros(len(ids), int), threshold)
        return pa.table({"id": pa.array(got[0], pa.int64()), "links": pa.array(got[1], pa.int64()), "root": pa.array(got[2], pa.int64())})

    dealt = reps.select("id", "m", "vec").mapInArrow(lean(deal), "leaf long, one int, two int, side int, id long, m long, sets binary, vec array<double>")
    return dealt.groupBy("leaf", "one", "two").applyInArrow(judge, "id long, links long, root long")
