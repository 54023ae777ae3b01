"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any other text is unlabelled (rows labelled 0 are used only to estimate
the class prior, the toxic share of the labelled rows). A linear model over words and parts of words (log of 1 + number) is trained in numpy
on a bounded sample: at most ``POSITIVES`` toxic and ``UNLABELLED`` other rows outside the held-out fold. The risk is
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part is negative the step goes against it, so
the model can't fit the unlabelled positives. Every document is scored, over its whole text.

Null text counts as empty and has no words: it gets the score of a text without features. Repeated rows and repeated
or null doc_ids are scored row by row. Without confirmed positives every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import U64, fold, label_shares, labelled, lower_ascii, mix, rolling_hashes, slices, text_column

FOLDS, HELD = 3, 1
POSITIVES, UNLABELLED = 2000, 4000
BUCKETS, FEATURES, GRAM = 1 << 21, 768, 5
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each word (run of letters: ASCII in lower case, bytes beyond ASCII) and of each
    run of GRAM bytes within a word, or begun by the byte before it."""
    low = lower_ascii(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    before = np.zeros(len(letter), bool)
    before[1:] = letter[:-1]
    after = np.zeros(len(letter), bool)
    after[:-1] = letter[1:]
    edges = offsets[(offsets > 0) & (offsets < len(letter))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    bucket, at = rolling_hashes(low, starts, ends), starts
    if len(low) >= GRAM:
        n = len(low) - GRAM + 1
        code = np.where(letter[:n], low[:n], 32).astype(U64)
        whole = np.ones(n, bool)
        for i in range(1, GRAM):
            code = (code << U64(8)) | low[i : n + i]
            whole &= letter[i : n + i]
            whole[edges[(edges >= i) & (edges < n + i)] - i] = False  # it would reach into the next text
        grams = np.flatnonzero(whole)
        bucket, at = np.append(bucket, mix(code[grams])), np.append(at, grams)
    return (bucket & U64(BUCKETS - 1)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in slices(text_column(batch)):
            bucket, doc = features(t.data, t.offsets)
            key, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key // BUCKETS, np.arange(1, t.n))
            parts = [np.split(x, cut) for x in ((key % BUCKETS).astype(np.int32), times.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), *[pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]], names=["doc_id", "words", "times"])


Sample = tuple[np.ndarray, np.ndarray]


def train(positive: list[Sample], unlabelled: list[Sample], prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen buckets, their weights and the bias. Samples are distinct buckets and how often each stands in the text."""
    if not positive or not unlabelled:
        return np.zeros(0, np.int64), np.zeros(0, np.float64), -50.0
    share = []
    for x in (positive, unlabelled):
        n = np.zeros(BUCKETS)
        for words, _ in x:
            n[words] += 1  # a sample's buckets are distinct
        share.append(n / len(x))
    n = len(unlabelled)
    z = (share[0] - share[1]) / np.sqrt((share[1] + 2.0 / n) / len(positive))
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[(z[chosen] > 6) & (share[0][chosen] >= 0.01)]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))

    def matrix(samples: list[Sample]) -> np.ndarray:
        out = np.zeros((len(samples), len(chosen) + 1))
        for i, (words, times) in enumerate(samples):
            c = column[words]
            out[i, c[c >= 0]] = np.log1p(times[c >= 0])
        out[:, -1] = 1
        return out

    p, u = matrix(positive), matrix(unlabelled)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    softplus = lambda x: np.logaddexp(0, x)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        sp, su = p @ w, u @ w
        negative = softplus(su).mean() - prior * softplus(sp).mean()
        g_negative = u.T @ sigmoid(su) / len(u) - prior * (p.T @ sigmoid(sp)) / len(p)
        if negative >= 0:
            g = g_negative - prior * (p.T @ sigmoid(-sp)) / len(p)
        else:
            g = -g_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return chosen, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    clean, toxic = label_shares(labels, "toxic", FOLDS, HELD)
    picked = [d for d, y in labelled(docs, labels, "toxic", FOLDS, HELD, POSITIVES) if y == 1]
    others = docs.where(F.col("doc_id").isNotNull()).where(fold("doc_id", FOLDS) != HELD).select("doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(UNLABELLED)
    rest = [r["doc_id"] for r in others.collect()]
    ids = spark.createDataFrame([(d,) for d in sorted({*picked, *rest})], "doc_id long")  # at most POSITIVES + UNLABELLED
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_sampled_words, "doc_id long, words binary, times binary").collect()
    words = {r["doc_id"]: (np.frombuffer(bytes(r["words"]), np.int32), np.frombuffer(bytes(r["times"]), np.uint32)) for r in rows}
    prior = min(0.99, max(0.001, toxic / max(1, toxic + clean)))
    return train([words[d] for d in sorted(set(picked)) if d in words], [words[d] for d in sorted(set(rest)) if d in words], prior)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and _score, _toxic; columns of docs with these names are replaced."""
    docs = docs.drop("_score", "_toxic")
    chosen, weights, bias = model
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = weights
    known = np.zeros(BUCKETS, bool)
    known[chosen] = True
    sent = docs.sparkSession.sparkContext.broadcast((table, known, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, bias = sent.value
        for batch in batches:
            out = []
            for t in slices(text_column(batch)):
                bucket, doc = features(t.data, t.offsets)
                hit = known[bucket]
                key, times = np.unique(doc[hit] * BUCKETS + bucket[hit], return_counts=True)
                x = bias + np.bincount(key // BUCKETS, weights=table[key % BUCKETS] * np.log1p(times), minlength=t.n)
                out.append(1 / (1 + np.exp(-np.clip(x, -40, 40))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(scores >= threshold)], names=[*batch.schema.names, "_score", "_toxic"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_toxic", BooleanType())]))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("_score").alias("score"), F.col("_toxic").cast("int").alias("predicted"))
