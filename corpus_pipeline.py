"""A corpus pipeline of the training-data operators: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; what it returns is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

A row is a document, whatever its doc_id: the dedup stages and the mix number the rows they get, work on those numbers,
and decide by row, so of rows that repeat, share a doc_id or have none, each group of copies still leaves exactly one row.
Repeated rows (the mix takes a document up to twice) are documents of their own to the stages after. Null text counts as
empty; empty texts are equal to each other, near no other text, and never in the mix, which takes words. Columns of docs
beyond those of documents are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from officium.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from officium.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH, BATCH_BYTES, USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", 64 << 20


def _small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few MB, so that workers stay small whatever the texts; a session's own setting stays."""
    if spark.conf.get(BATCH) == f"{USUAL}b":
        spark.conf.set(BATCH, BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by the classifier trained on this input and the labels."""
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(~F.col("_toxic")).select(*COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with _row, a number of its own for each row, written down so that it stays."""
    return stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), name)


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("_row").alias("doc_id"), "text")


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (_row, _group) the row with the smallest doc_id, nulls last."""
    ids = groups.join(docs.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = ids.groupBy("_group").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the smallest doc_id."""
    docs = _numbered(docs, "copies")
    found = exact_dedup.exact_dedup(_as_documents(docs))
    return _one_of_each(docs, found.select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, similarity 0.8): one with the smallest doc_id."""
    _small_batches(spark)
    docs = _numbered(docs, "near_copies")
    found = near_dedup.near_dedup(_as_documents(docs))
    return _one_of_each(docs, found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the mix, each as often as it is taken."""
    docs = _numbered(docs, "mixing")
    mixed = mixing.mix(docs.select("_row", "doc_id", "text", "source"), F.array("source"), edge="whole")
    times = mixed.where("_size > 0 AND _taken > 0").select("_row", (F.col("_taken") / F.col("_size")).cast("int").alias("_times"))
    return docs.join(times, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train models and cut texts into tokens, which SQL can't express; tests/llm/test_pipeline.py holds them against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "_"))
    return docs
