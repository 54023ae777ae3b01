"""Verification by the Merkle tree, and ids of texts with special tokens and odd white space against the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from officium.llm import content_store
from officium.llm.common import new_folder, slices
from officium.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(500)]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 1500])))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(autouse=True)
def small_nodes(monkeypatch):
    monkeypatch.setattr(content_store, "FANOUT", 4)


def stored(spark, docs, mean=64):
    folder = new_folder(spark, "test")
    content_store.write_store(docs, folder, PATH, mean_chunk=mean)
    return folder


def verified(spark, folder):
    return {r["doc_id"]: r["verified"] for r in content_store.read_store(spark, folder).collect()}


def copied(spark, folder, change):
    """A copy of the store with its recipes changed."""
    to = new_folder(spark, "test")
    for part in ("blocks", "recipes", "manifest"):
        rows = spark.read.parquet(f"{folder}/{part}")
        rows = change(rows) if part == "recipes" else rows
        (rows.write.partitionBy("kind") if part == "blocks" else rows.write).parquet(f"{to}/{part}")
    return to


def test_a_whole_store_is_verified(spark, docs):
    folder = stored(spark, docs)
    assert set(verified(spark, folder).values()) == {True}
    assert content_store.verify_tree(spark, folder).count() == 0
    assert content_store.read_ids(spark, folder).count() == 60


def test_root_does_not_depend_on_partitions(spark, docs):
    roots = set()
    for parts, adaptive in ((8, "true"), (3, "false"), (5, "true")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            roots.add(content_store.root_of(spark, stored(spark, docs.repartition(parts))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(roots) == 1 and roots != {content_store.root_of(spark, stored(spark, docs.where("doc_id > 0")))}


def test_swapped_digests_fail(spark, docs):
    folder = stored(spark, docs)
    hit = spark.read.parquet(f"{folder}/recipes").where("size(digests) > 3").orderBy("doc_id").first()["doc_id"]
    swap = F.when(F.col("doc_id") == hit, F.concat(F.slice("digests", 2, 1), F.slice("digests", 1, 1), F.expr("slice(digests, 3, size(digests))"))).otherwise(F.col("digests"))
    got = verified(spark, copied(spark, folder, lambda r: r.withColumn("digests", swap)))
    assert [d for d, ok in got.items() if not ok] == [hit]


def test_another_root_spoils_its_node_and_a_lost_recipe_too(spark, docs):
    folder = stored(spark, docs)
    place = {r["doc_id"]: r["place"] for r in spark.read.parquet(f"{folder}/recipes").collect()}
    root = F.when(F.col("doc_id") == 9, F.unhex(F.lit("00" * 32))).otherwise(F.col("root"))
    got = verified(spark, copied(spark, folder, lambda r: r.withColumn("root", root)))
    assert {d for d, ok in got.items() if not ok} == {d for d in got if place[d] // 4 == place[9] // 4}
    lost = copied(spark, folder, lambda r: r.where("doc_id <> 9"))
    got = verified(spark, lost)
    assert {d for d, ok in got.items() if not ok} == {d for d in got if place[d] // 4 == place[9] // 4}
    gone = copied(spark, folder, lambda r: r.where(F.expr("place DIV 4") != 2))
    assert [tuple(r) for r in content_store.verify_tree(spark, gone).collect()] == [(0, 2)]


def test_a_changed_chunk_fails_its_documents(spark, docs):
    folder = stored(spark, docs)
    to = new_folder(spark, "test")
    blocks = spark.read.parquet(f"{folder}/blocks")
    digest = blocks.where("kind = 'chunk'").orderBy("digest").first()["digest"]
    users = {r["doc_id"] for r in spark.read.parquet(f"{folder}/recipes").where(F.array_contains("digests", F.lit(digest))).collect()}
    blocks.withColumn("payload", F.when(F.col("digest") == F.lit(digest), F.concat(F.lit(b"\1\0"), F.expr("substring(payload, 3)"))).otherwise(F.col("payload"))).write.partitionBy("kind").parquet(f"{to}/blocks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{to}/{part}")
    assert {d for d, ok in verified(spark, to).items() if not ok} == users


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(name, keeps_space):
    rng, alphabet = random.Random(5), ["<|endoftext|>", "<|startoftext|>", "<|endof", " ", "  ", "\n", "\t", " ", " ", "　", "é", "é", "Word", "it's", "12", "$$", "\U0001f600", "the"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)]
    library, mine = Tokenizer.from_file(public_tokenizers.path(name)), PieceEncoder(public_tokenizers.path(name), keeps_space)
    for t in slices(pa.array(texts)):
        ids, first = mine.encode(t, 7)
        for i in range(t.n):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(texts[t.lo + i], add_special_tokens=False).ids + [7], texts[t.lo + i]
    assert np.all(first[1:] > first[:-1])
