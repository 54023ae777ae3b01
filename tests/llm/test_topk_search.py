"""Exact search against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from officium.llm import common, queries, topk_search

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, k=20, every=20):
    whole = lambda x: max(-(2**63), min(2**63 - 1, math.floor(64 * float(np.float32(x)))))
    kept = sorted({(i, tuple(whole(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, q in kept:
        if i % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in kept if (j, v) != (i, q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    assert got(queries.QUERIES["op13_topk"](spark, f"/root/testdata/{sf}")) == expected(rows)


def test_clusters_copies_and_ties(spark, monkeypatch):
    """Many blocks and packs; a third of the rows one vector, many vectors close to another, and small integers that tie often."""
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "SAMPLE", 64)
    monkeypatch.setattr(topk_search, "PACK", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (6, 8))
    vectors = [centres[rng.integers(6)] + rng.normal(0, 0.02, 8) for _ in range(500)] + [np.full(8, 0.25)] * 300 + [rng.integers(-2, 3, 8) / 64 for _ in range(200)]
    order = rng.permutation(len(vectors))
    rows = [(int(i), [float(x) for x in vectors[k]]) for i, k in enumerate(order)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(topk_search.top_k(table, every=5)) == expected(rows, every=5)
    assert got(topk_search.top_k(table, k=3, every=50)) == expected(rows, k=3, every=50)


def test_far_blocks_are_left_alone(spark, monkeypatch):
    """With clusters far from each other most blocks can't reach a query's best, and are neither sent nor read for it."""
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    rng = np.random.default_rng(6)
    turn = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    rows = [(i, [float(np.cos(turn[i % 20]) + rng.normal(0, 0.01)), float(np.sin(turn[i % 20]) + rng.normal(0, 0.01))]) for i in range(2000)]
    folder = common.new_folder(spark, "far")
    cells = topk_search.write_index(spark.createDataFrame(rows, SCHEMA), folder)
    blocks = [r for r in spark.read.parquet(f"{folder}/blocks").collect()]
    q = cells.space.matrix(blocks[0]["vecs"])[:1]
    pack = topk_search.Pack(cells, q, np.zeros(1, np.int64), topk_search._floors(cells, cells.sample, 21, q), 21)
    assert sum(len(pack.reached(b["cell"] // cells.rings, b["lo"], b["hi"])) for b in blocks) < len(blocks) / 3
    assert got(topk_search.top_k(spark.createDataFrame(rows, SCHEMA), every=400)) == expected(rows, every=400)


AWKWARD = [(0, None), (20, []), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (40, [2.0, 1.0]), (60, [0.5, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [-0.001, 0.5, 3.0]), (7, [1.0, 2.0]), (140, [1.0])]


@pytest.mark.parametrize("more", [[], [(160, [1e30, -2e20]), (3, [-5e15, 7e15]), (180, [3e10, 1.0])]])
def test_awkward_rows(spark, more):
    rows = AWKWARD + more
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("vec", "cls", "cell", "pack", "n")}).repartition(4)
    assert got(topk_search.top_k(table)) == expected(rows)


def test_tables_without_vectors(spark):
    for rows in ([], AWKWARD[:1]):
        assert topk_search.top_k(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(20, []), (21, [])], SCHEMA)).collect() == [(20, 1, 21, 0)]


def test_sql_equals_brute_force():
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(con.sql(queries.ORACLE_SQL["op13_topk"]).fetchall()) == expected(rows)
