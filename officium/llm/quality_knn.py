"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams and two marks: the shares of words in repeated 3-word windows and in repeated lines,
weighted as ``MARK`` times a whole text of trigrams. A bounded sample of labelled rows (at most ``PER_LABEL`` of each label, outside the held-out fold) gives inverse
document frequencies, a truncated singular value decomposition, and the labelled vectors; these (a few MB, bounded
by the parameters) are broadcast. Each document's cosine with every labelled vector is computed exactly, block by
block; the ``NEIGHBOURS`` nearest vote with their similarity, each label weighted back to its share of the labels.

Null text counts as empty: no terms, so it gets the score of the label share. Repeated rows and repeated or null
doc_ids are scored row by row. Without labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, fold, label_shares, labelled, lines_of, per_text, repeated_words, run_hashes, slices, text_column, words_of

FOLDS, HELD = 3, 1
PER_LABEL, NEIGHBOURS, RANK, MARK = 1000, 25, 64, 1.5
TRIGRAMS = 4096
TERMS = TRIGRAMS + 2
BLOCK = 256


def term_counts(t: Texts) -> np.ndarray:
    """[text, term] counts of trigrams and, in the last two columns, shares of words."""
    out = np.zeros((t.n, TERMS), np.float32)
    if len(t.data) >= 3:
        d = t.data.astype(np.uint32)
        code = ((d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA6B) + d[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)).astype(np.int64)
        at = np.arange(len(code))
        doc = np.repeat(np.arange(t.n), np.diff(t.offsets))[: len(code)]
        inside = at + 3 <= t.offsets[doc + 1]
        out[:, :TRIGRAMS] = np.bincount((doc * TRIGRAMS + code)[inside], minlength=t.n * TRIGRAMS).reshape(t.n, TRIGRAMS)
    w = words_of(t)
    h = run_hashes(t.data, w.starts, w.ends)
    n = np.maximum(1, w.counts)
    out[:, TRIGRAMS] = per_text(repeated_words(t, w, h).astype(np.int64), w.first) / n
    lines = lines_of(t, w)
    out[:, TRIGRAMS + 1] = np.bincount(lines.doc, weights=lines.words * lines.again, minlength=t.n) / n
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    x[:, TRIGRAMS:] = 0
    x = _unit(x)
    x[:, TRIGRAMS:] = MARK * counts[:, TRIGRAMS:]
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in slices(text_column(batch), most=BLOCK):
            rows = [row.tobytes() for row in term_counts(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), pa.array(rows, pa.binary())], names=["doc_id", "counts"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_label: int = PER_LABEL) -> dict:
    spark = docs.sparkSession
    picked = dict(labelled(docs, labels, column, FOLDS, HELD, per_label))
    numbers = label_shares(labels, column, FOLDS, HELD)
    share = numbers[1] / sum(numbers) if sum(numbers) else 0.5
    model = {"share": share, "vectors": np.zeros((0, RANK), np.float32), "votes": np.zeros(0, np.float32), "weights": np.zeros(0, np.float32), "idf": np.ones(TERMS, np.float32), "axes": np.zeros((TERMS, RANK), np.float32)}
    if not picked:
        return model
    ids = spark.createDataFrame(sorted(picked.items()), "doc_id long, label int")  # at most 2 * per_label rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").mapInArrow(_sampled_terms, "doc_id long, counts binary").collect()
    rows = sorted({r["doc_id"]: bytes(r["counts"]) for r in rows}.items())
    counts = np.stack([np.frombuffer(c, np.float32) for _, c in rows])
    y = np.array([picked[d] for d, _ in rows], np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _weighted(counts, idf)
    rng = np.random.default_rng(5)
    q = x.T @ rng.standard_normal((len(x), RANK + 16)).astype(np.float32)
    for _ in range(3):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    axes = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :RANK]
    axes = np.pad(axes, ((0, 0), (0, RANK - axes.shape[1]))).astype(np.float32)
    n = [max(1, (y == c).sum()) for c in (0, 1)]
    weight = np.where(y == 1, share / n[1], (1 - share) / n[0]).astype(np.float32)
    return model | {"vectors": _unit(x @ axes).astype(np.float32), "votes": y, "weights": weight / weight.max(), "idf": idf, "axes": axes}


def vote(counts: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    x = _weighted(counts, model["idf"]) @ model["axes"]
    length = np.linalg.norm(x, axis=1)
    out = np.full(len(x), model["share"])
    if not len(model["vectors"]):
        return out
    like = _unit(x) @ model["vectors"].T
    k = min(neighbours, like.shape[1])
    least = -np.partition(-like, k - 1, axis=1)[:, k - 1 : k]
    w = np.where(like >= least, np.maximum(like, 0) ** 4, 0) * model["weights"]
    total = w.sum(axis=1)
    ok = (length > 1e-9) & (total > 0)
    out[ok] = np.clip((w @ model["votes"])[ok] / total[ok], 0, 1)
    return out


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [vote(term_counts(t), sent.value) for t in slices(text_column(batch), most=BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
