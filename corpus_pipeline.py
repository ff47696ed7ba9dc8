"""The documents' pipeline: toxic documents and near copies go, repeated passages are cut, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.byte_bpe import encode_decode, ids_digest
from quern.llm.common import WORD, stash
from quern.llm.mixing import mix
from quern.llm.ngram_join import jaccard_components
from quern.llm.repeats import remove_repeats
from quern.llm.toxicity import fit_toxicity, score_texts

DOC_ID, TEXT = "doc_id", "text"


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != DOC_ID)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. Null and empty texts get one score alike; repeated rows go or stay together; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_texts(docs, fit_toxicity(docs, labels), keep=_rest(docs), score="__score")
    return scored.where(F.col("__score") < 0.5).select(docs.columns)


def _one_of_each(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each group: the first by its JSON text. A partial aggregate, so no group lies in one place."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*by).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 percent of their 5-word shingles one stays, that of the smallest id.

    Rows are judged by their texts: where ids repeat, each text of an id is a document of its own, after its id by the text's digest, so
    unlike texts all stay; of rows that repeat id and text one stays, the first by its JSON text. Null and empty texts are in no
    group. Rows without an id are held against one another by their whole texts alone, and one of each stays. An empty
    table stays empty.
    """
    named = docs.where(F.col(DOC_ID).isNotNull())
    repeats = not named.groupBy(DOC_ID).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).isEmpty()
    digest = F.md5(F.coalesce(F.col(TEXT), F.lit("")))
    nodes = named.withColumn("__node", F.struct(F.col(DOC_ID).alias("id"), digest.alias("text")) if repeats else F.col(DOC_ID))
    found = jaccard_components(nodes, id_col="__node", percent=80, size=5)
    gone = stash(found.where(F.col("component_id") != F.col("__node")).select("__node").distinct(), "judged")
    out = nodes.join(gone, "__node", "left_anti").select(*docs.columns)
    if repeats:
        filled = F.coalesce(F.col(TEXT).rlike(WORD), F.lit(False))
        out = _one_of_each(out.where(filled), DOC_ID, TEXT).unionByName(out.where(~filled))
    return out.unionByName(_one_of_each(docs.where(F.col(DOC_ID).isNull()), TEXT))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; texts without any stay as they are, and documents of which no word is left go.

    Null and empty texts stay. Columns may have any names. An empty table stays empty.
    """
    inner = {c: f"__c{k}" for k, c in enumerate(_rest(docs)) if c != TEXT}
    plain = docs.withColumnsRenamed(inner)
    cut = remove_repeats(plain, keep=(TEXT, *inner.values())).where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    made = {c: F.col(inner.get(c, c)) for c in docs.columns}
    made[TEXT] = F.when(changed, F.col("kept_text")).otherwise(F.col(TEXT))
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; null is a source. Texts without words are taken like the whole repetitions of their source. An empty table stays empty."""
    names = docs.columns
    plain = docs.select(F.col(DOC_ID), F.col(TEXT), F.col("source"), F.struct(*names).alias("__row"))
    mixed = mix(plain, keep=("__row",)).where(F.col("repeats") > 0)
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("__n")).select("__row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to. Null and empty texts have none; repeated rows are coded each; an empty table stays empty."""
    import public_tokenizers

    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return coded.select(DOC_ID, "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("ngram_join", near_copies), ("substring_dedup", substring_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: A learnt classifier comes first, so SQL can't give the rows; tests/llm/test_pipeline.py holds run() and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name, tidy=True)
    return docs
