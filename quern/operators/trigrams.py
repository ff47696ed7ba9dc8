"""Substring search by a stored index of trigrams: candidates hold all of the query's, and are verified by what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordinals import numbered
from quern.operators.search import RESULT, by_name, by_type
from quern.sources.shared import forget

#: Numbers of a posting row, at most: a common trigram's are many rows.
CHUNK = 4096
#: Of a query's trigrams the rarest so many look for candidates; the rest only verify.
RAREST = 8
#: Chunks that are looked into first; four times as many after each round. Candidates that are fetched at once.
AHEAD, MOST_FETCHED = 2, 256
FIELDS = {"name": ("pretty_qname", "pretty_name"), "type": ("type",)}


def grams(text, n: int = 3):
    """The distinct runs of three characters of a text column."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def write_trigrams(defs: DataFrame, folder: str) -> None:
    """Definitions numbered by name, and for each field's trigrams the numbers of the definitions that hold them, in rows of a CHUNK at most, by trigram.

    Text is lower-cased; a field of two columns is both with a mark between. Numbers are in the order of results, so the first
    candidates are the first results.
    """
    rows = numbered(defs.select(*RESULT), *RESULT)
    rows.select("row", *RESULT).repartitionByRange("row").sortWithinPartitions("row").write.mode("overwrite").parquet(f"{folder}/rows")
    forget(rows)
    stored = defs.sparkSession.read.parquet(f"{folder}/rows")
    parts = None
    for field, columns in FIELDS.items():
        text = F.concat_ws("\x01", *[F.lower(F.coalesce(c, F.lit(""))) for c in columns])
        one = stored.select(F.lit(field).alias("field"), F.explode(grams(text)).alias("gram"), "row")
        parts = one if parts is None else parts.unionAll(one)
    listed = parts.groupBy("field", "gram", F.floor(F.col("row") / CHUNK).alias("chunk")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row")).alias("rows"))
    listed.repartitionByRange("field", "gram", "chunk").sortWithinPartitions("field", "gram", "chunk").write.mode("overwrite").parquet(f"{folder}/grams")


class Trigrams:
    """A stored index, opened once: its schemas and file lists are kept for all searches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.rows, self.grams = (spark.read.parquet(f"{folder}/{name}") for name in ("rows", "grams"))

    def _lower(self, text: str) -> str:
        """As the engine lower-cases columns."""
        return self.spark.sparkContext._jvm.org.apache.spark.unsafe.types.UTF8String.fromString(text).toLowerCase().toString()

    def _asked(self, text: str) -> list[str]:
        low = self._lower(text)
        return sorted({low[k : k + 3] for k in range(len(low) - 2)})

    def candidates(self, field: str, text: str) -> DataFrame | None:
        """(row): all definitions that hold a text's trigrams, a superset of those that hold it; None for texts of less than three characters."""
        asked = self._asked(text)
        if not asked:
            return None
        listed = self.grams.where((F.col("field") == field) & F.col("gram").isin(asked))
        # a chunk of numbers is met in the same chunk of the other trigrams only
        met = listed.groupBy("chunk").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(asked))
        return met.select(F.explode(F.aggregate(F.slice("lists", 2, len(asked)), F.get("lists", F.lit(0)), F.array_intersect)).alias("row"))

    def search(self, field: str, text: str, limit: int | None = None) -> DataFrame:
        """What search.by_name or search.by_type finds, in order.

        The chunks that hold all trigrams are found by three small columns, a number for each trigram and CHUNK definitions; then the rarest trigrams' numbers are
        read for the first chunks, met, and the definitions of these numbers read and verified, and so on until the limit is
        reached: lookups without a shuffle. Texts shorter than a trigram scan.
        """
        import numpy as np

        scan = by_name if field == "name" else by_type
        asked = self._asked(text)
        if not asked:
            return scan(self.rows, text, limit)
        limit, found = max(1, 20 if limit is None else limit), {g: {} for g in asked}
        listed = self.grams.where((F.col("field") == field) & F.col("gram").isin(asked))
        for r in listed.select("gram", "chunk", "n").collect():
            found[r["gram"]][r["chunk"]] = r["n"]
        rarest = sorted(asked, key=lambda g: (sum(found[g].values()), g))[:RAREST]
        chunks = sorted(set.intersection(*(set(found[g]) for g in asked)))
        hits, at, ahead = [], 0, AHEAD
        while at < len(chunks) and len(hits) < limit:
            now, at = chunks[at : at + ahead], at + ahead
            lists = listed.where(F.col("gram").isin(rarest) & F.col("chunk").isin(now)).select("chunk", "rows").toArrow()
            met: dict = {}
            for chunk, rows in zip(lists.column("chunk").to_pylist(), lists.column("rows"), strict=True):
                own = rows.values.to_numpy()
                met[chunk] = np.intersect1d(met[chunk], own, assume_unique=True) if chunk in met else own
            numbers = np.concatenate([met[c] for c in now])
            for k in range(0, len(numbers), MOST_FETCHED):
                some = numbers[k : k + MOST_FETCHED].tolist()
                if some and len(hits) < limit:
                    own = self.rows.where(F.col("row").between(some[0], some[-1]) & F.col("row").isin(some)).drop("row")
                    hits += scan(own, text, limit - len(hits)).collect()
            ahead *= 4
        return self.spark.createDataFrame(hits, self.rows.drop("row").schema)
