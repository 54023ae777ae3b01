"""Exact dedup by deterministic block naming, in DataFrame operations alone.

Texts (null counts as empty, each run of ``[\\x20\\x09-\\x0D]`` as one space) are cut into blocks of ``BLOCK``
bytes. Equal blocks get one integer name, unequal ones different names: blocks are dealt by content and sorted, and a
block's name is the place of the first of its equals. Then names are paired with their neighbours and the pairs named
the same way, until each document has one name; documents are equal when their numbers of blocks and their names
are. No hash decides: hashes only find the keys so frequent that they would crowd one task.

Such keys (at least one row in ``HOT_SHARE``, so at most ``HOT_SHARE`` keys) are pre-aggregated, named apart with
negative integers and joined by broadcast.

Of equal texts the row with the smallest doc_id stays; a null doc_id counts as larger than all. Rows with equal
doc_id and equal text are copies of each other; of these every one is marked kept if its doc_id is the kept one,
as nothing tells them apart. Columns beyond doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stage

BLOCK = 512
HOT_SHARE = 1000
LEAST_HOT = 200


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hot_hashes(rows: DataFrame, key: Column) -> list[int]:
    """Hashes of the keys with at least one row in HOT_SHARE: at most HOT_SHARE of them."""
    counts = rows.select(F.xxhash64(key).alias("h")).groupBy("h").count()
    counts = stage(counts.where(F.col("count") >= LEAST_HOT), "counts")
    total = rows.count() if counts.limit(1).count() else 0
    if not total:
        return []
    least = max(LEAST_HOT, total // HOT_SHARE)
    return [r["h"] for r in counts.where(F.col("count") >= least).select("h").limit(HOT_SHARE + 1).collect()]


def named(rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``name``: an integer, equal for equal keys only. Each row's key is read, sorted and dropped."""
    spark = rows.sparkSession
    hot = _hot_hashes(rows, F.col(key))
    by = [key]
    if hot:
        frequent = rows.where(F.xxhash64(key).isin(hot)).groupBy(key).count()
        by_key = Window.orderBy(key)  # at most HOT_SHARE rows
        frequent = frequent.where(F.col("count") >= LEAST_HOT).select(key, (-F.row_number().over(by_key)).cast("long").alias("hot_name"))
        rows = rows.join(F.broadcast(stage(frequent, "hot_names")), key, "left")
        # A row with a hot name needs no key any more; its place among its own columns spreads it.
        cold = F.col("hot_name").isNull()
        rows = rows.select(*keep, "hot_name", F.when(cold, F.col(key)).alias(key), F.when(~cold, F.xxhash64(*keep)).alias("_at"))
        by = [key, "_at"]
    dealt = rows.repartition(shuffle_parts(spark), *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    # Rows are dealt and sorted as the window wants them: no second shuffle or sort.
    name = F.first("_place").over(Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.select(*keep, (F.coalesce("hot_name", name) if hot else name).alias("name"))


def block_names(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_sha256 (binary), n_blocks, name; (n_blocks, name) is equal for equal texts only."""
    norm = docs.select("doc_id", normalized(F.col("text")).alias("norm"))
    raw = F.col("norm").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(BLOCK)).cast("int"))
    blocks = norm.select(
        "doc_id", F.unhex(F.sha2(raw, 256)).alias("text_sha256"), n.alias("n_blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * BLOCK + 1, F.lit(BLOCK)))).alias("pos", "block"))
    keep = ["doc_id", "text_sha256", "n_blocks", "pos"]
    level = stage(named(blocks, "block", keep), "names")
    documents = level.where("pos = 0").select("doc_id", "text_sha256")  # a row for each row of docs
    by_doc = ["doc_id", "text_sha256", "n_blocks"]
    done = []
    width = 1
    while True:
        done.append(level.where(F.col("n_blocks") <= width).select(*by_doc, "name"))
        level = level.where(F.col("n_blocks") > width)
        if not level.limit(1).count():
            break
        half = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        # Rows of equal doc_id and text have equal names, so max() also brings them together.
        pairs = level.groupBy(*by_doc, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.struct(F.max(half[0]).alias("a"), F.max(half[1]).alias("b")).alias("pair"))
        level = stage(named(stage(pairs, "pairs"), "pair", [*by_doc, "pos"]), "names")
        width *= 2
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    names = names.dropDuplicates(["doc_id", "text_sha256"])
    on = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.text_sha256") == F.col("n.text_sha256"))
    return documents.alias("d").join(names.alias("n"), on).select("d.doc_id", "d.text_sha256", "n.n_blocks", "n.name")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    rows = stage(block_names(docs.select(F.col("doc_id").cast("long"), "text")), "identities")
    groups = stage(rows.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # Large groups (at most HOT_SHARE) go by broadcast, as their rows would crowd one task.
    least = max(LEAST_HOT, rows.count() // HOT_SHARE)
    large = F.broadcast(groups.where(F.col("group_size") >= least).withColumnsRenamed({"keep_id": "k", "group_size": "g"}))
    rows = rows.join(large, ["n_blocks", "name"], "left")
    out = [F.col("doc_id"), F.col("k").alias("keep_id"), F.col("g").alias("group_size"), F.col("text_sha256")]
    crowded = rows.where("g is not null").select(*out)
    others = rows.where("g is null").drop("k", "g").join(groups.where(F.col("group_size") < least), ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return crowded.unionByName(others).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
