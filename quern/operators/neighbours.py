"""Nearest vectors by cosine: exactly, block against block, or by an inverted file of lists around learnt centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Vectors and queries that one block holds.
BLOCK = 4096
#: Products that a task holds at once: 8 MB, and a few copies of them.
CELLS = 1 << 20
#: Vectors that centres are learnt from at most (those whose hash comes first), rounds of learning, and centres at most: 4,096 centres of 1,000 dimensions are 33 MB.
SAMPLE, ROUNDS, MOST_CENTRES = 65_536, 12, 4096
SEED = 7


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of length 1; null vectors and those of length 0 or with null or non-finite parts are left out."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    d = df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return d.withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column, size: int):
    """The vectors of an Arrow list column as rows, without a Python object each."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), size)


def _by_size(table):
    """(size, part of the table) for each length of vector in it."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(table.column("v"))
    for size in pc.unique(sizes).to_pylist():
        yield size, table.filter(pc.equal(sizes, size))


def _best(queries, vectors, k: int, schema):
    """The k best of the vectors for each query, a block product at a time; ties by id, a query's own id left out."""
    import numpy as np
    import pyarrow as pa

    out = []
    for size, asked in _by_size(queries):
        own = next((t for s, t in _by_size(vectors) if s == size), None)
        if own is None:
            continue
        ids, all_qids, y = own.column("id").to_numpy(), asked.column("id").to_numpy(), _matrix(own.column("v"), size).T
        x, n, rows = _matrix(asked.column("v"), size), min(k, len(ids)), max(1, CELLS // len(ids))
        for at in range(0, len(x), rows):
            qids = all_qids[at : at + rows]
            scores = x[at : at + rows] @ y
            scores[qids[:, None] == ids[None, :]] = -np.inf
            rounded = np.round(scores, 9)
            least = np.partition(rounded, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
            row, col = np.nonzero((rounded >= least[:, None]) & (scores > -np.inf))  # with all ties at the end
            order = np.lexsort((ids[col], -rounded[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < k], col[place < k]
            out.append(pa.table({"query": asked.column("id").take(pa.array(row + at)), "id": own.column("id").take(pa.array(col)), "cosine": pa.array(scores[row, col])}))
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("place").cast("long").alias("place"))


def _compare(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query, id, cosine): of each group of vectors the k best for each query of the group, by a product of the group's matrices."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema["id"].dataType
    schema = pa.schema([("query", to_arrow_type(kind)), ("id", to_arrow_type(kind)), ("cosine", pa.float64())])

    def near(left, right):
        return _best(right, left, k, schema) if left.num_rows and right.num_rows else schema.empty_table()

    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(near, f"query {kind.simpleString()}, id {kind.simpleString()}, cosine double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, id, cosine, place): the k nearest of all vectors for each query, exactly; ties by id. Null vectors and those of length 0 or with null or non-finite parts are near nothing, nor are vectors of another length.

    All queries meet all vectors: a task multiplies BLOCK of each, about, and hands on k rows for a query. The numbers of blocks follow
    from counts of both tables, which are read for it.
    """
    v, q = unit_vectors(vectors, id_col, vec_col), unit_vectors(queries, id_col, vec_col)
    n_parts, n_blocks = (max(1, -(-df.count() // BLOCK)) for df in (vectors, queries))
    number = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.withColumn("block", number(n_blocks, 1)).withColumn("part", every(n_parts))
    dealt = v.withColumn("part", number(n_parts, 2)).withColumn("block", every(n_blocks))
    return _ranked(_compare(dealt, asked, ["part", "block"], k), k)


def learn_centres(vectors: DataFrame, n: int | None = None, seed: int = SEED):
    """n (or as many as the root of the vectors' number, MOST_CENTRES at most) unit centres learnt from a bounded sample of unit vectors of one length: rounds of assigning each to the nearest centre and taking means."""
    import numpy as np

    total = vectors.count()
    some = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("v").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    size = len(some.column("v")[0].as_py())
    x = _matrix(some.column("v"), size)
    n = min(n or max(1, round(total**0.5)), MOST_CENTRES, len(x))
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[k : k + BLOCK] @ centres.T).argmax(1) for k in range(0, len(x), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=n) == 0
        sums[empty] = x[r.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _lists(vectors: DataFrame, centres, probes: int) -> DataFrame:
    """vectors with the lists of their nearest centres, one row for each. A narrow map of block products."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = held.value
        for batch in batches:
            x = _matrix(batch.column("v"), c.shape[1])
            n, rows = min(probes, len(c)), max(1, CELLS // len(c))
            for at in range(0, len(x), rows):
                some = x[at : at + rows]
                near = np.argpartition(some @ c.T, len(c) - n, axis=1)[:, len(c) - n :]
                row = pa.array(np.repeat(np.arange(at, at + len(some)), n))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("v").take(row), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])

    return vectors.mapInArrow(run, f"id {kind}, v array<double>, list int")


def write_lists(vectors: DataFrame, id_col: str, vec_col: str, folder: str, n_lists: int | None = None) -> None:
    """An inverted file: every vector (of the commonest length) in the list of its nearest centre, and the centres. Long lists are cut into parts of BLOCK, about."""
    spark = vectors.sparkSession
    every = written(unit_vectors(vectors, id_col, vec_col), "vectors")
    sizes = every.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    one = every.where(F.size("v") == (sizes["size"] if sizes else 0))
    centres = learn_centres(one, n_lists)
    placed = written(_lists(one, centres, 1), "lists") if len(centres) else one.withColumn("list", F.lit(0))
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    placed.join(parts, "list").select("list", part, "id", "v").repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").parquet(f"{folder}/lists")
    parts.write.mode("overwrite").parquet(f"{folder}/parts")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, v array<double>").write.mode("overwrite").parquet(f"{folder}/centres")


def read_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("lists", "parts", "centres")}


def _centres(index: dict[str, DataFrame]):
    import numpy as np

    return np.array([r["v"] for r in index["centres"].orderBy("list").collect()])


def probed(index: dict[str, DataFrame], queries: DataFrame, id_col: str, vec_col: str, probes: int) -> DataFrame:
    """(id, v, list, part): a row for each part of each list that a query looks into."""
    centres = _centres(index)
    q = unit_vectors(queries, id_col, vec_col)
    if not len(centres):
        return q.select("id", "v", F.lit(0).alias("list"), F.lit(0).alias("part")).limit(0)
    asked = _lists(q.where(F.size("v") == centres.shape[1]), centres, probes)
    return asked.join(index["parts"], "list").select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def nearest_by_lists(index: dict[str, DataFrame], queries: DataFrame, id_col: str, vec_col: str, k: int, probes: int) -> DataFrame:
    """(query, id, cosine, place): the k nearest of the vectors in the lists of a query's nearest centres; near all of the exact ones if probes are enough (see probes_for)."""
    return _ranked(_compare(index["lists"], probed(index, queries, id_col, vec_col, probes), ["list", "part"], k), k)


def compared(index: dict[str, DataFrame], queries: DataFrame, id_col: str, vec_col: str, probes: int) -> float:
    """Vectors that a query is compared with, on average."""
    sizes = index["lists"].groupBy("list", "part").agg(F.count("*").alias("n"))
    met = probed(index, queries, id_col, vec_col, probes).join(sizes, ["list", "part"]).groupBy("id").agg(F.sum("n").alias("n"))
    return met.agg(F.avg("n")).first()[0] or 0.0


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Of the exact neighbours, the share that was found."""
    both = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


def probes_for(index: dict[str, DataFrame], vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, least: float = 0.9) -> tuple[int, float]:
    """(probes, recall): the fewest of 1, 2, 4, ... lists that find least of the exact neighbours of these queries, measured against all vectors."""
    exact, n = written(nearest(vectors, queries, id_col, vec_col, k), "exact"), index["centres"].count()
    probes = 1
    while True:
        got = recall(nearest_by_lists(index, queries, id_col, vec_col, k, probes), exact)
        if got >= least or probes >= n:
            return probes, got
        probes = min(n, probes * 2)
