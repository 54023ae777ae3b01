"""Helpers the training-data operators share: staged tables, running totals, words and hashes in numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. All numpy work is on one slice of an Arrow
batch at a time (about ``SLICE_BYTES`` of text), so memory does not grow with the table; only a single
text longer than that makes a longer slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_PINV = U64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of staged tables


# ---------------------------------------------------------------- staged tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; without it /tmp/checkpoints in local mode, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/") + "/officium"


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder, removed when the session's JVM ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    return where


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    where = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    _folders[out] = where
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more, neither itself nor to make lost parts again."""
    for df in staged:
        path, fs = _path(df.sparkSession, _folders.pop(df))
        fs.delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- running totals
def with_running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "ordered"
) -> DataFrame:
    """Adds for each ``out: value`` of ``sums`` the total of value over all rows before this one in ``order``.

    One range shuffle sorts the rows; each range's total (one row a range) goes through the driver, never
    the rows. ``df`` must be cheap to read twice, as a staged table is: Spark samples it for the ranges.
    """
    spark = df.sparkSession
    ranged = stage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name
    )
    totals = sorted(
        (tuple(r) for r in ranged.groupBy("_range").agg(*[F.sum(v).cast("long").alias(k) for k, v in sums.items()]).collect())
    )
    base, run = [], [0] * len(sums)
    for part, *values in totals:
        base.append((part, *run))
        run = [a + (b or 0) for a, b in zip(run, values)]
    bases = spark.createDataFrame(base, "_range int, " + ", ".join(f"_base_{k} long" for k in sums))
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "_range")
    out = out.withColumns({
        k: F.col(f"_base_{k}") + F.coalesce(F.sum(v).over(window), F.lit(0)) for k, v in sums.items()
    })
    return out.drop("_range", *[f"_base_{k}" for k in sums])


# ---------------------------------------------------------------- texts, words and hashes in numpy
def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all input bits."""
    h = h ^ (h >> U64(30))
    h = h * _M1
    h ^= h >> U64(27)
    h = h * _M2
    h ^= h >> U64(31)
    return h


def _chunks(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs as 64-bit chunks: all chunks, where each run's begin, and each chunk's number in its run.

    Bytes go eight to a chunk, the last filled up with zeros; 64-bit values are a chunk each. Runs of the same size (in
    values) are equal exactly when their chunks are.
    """
    wide = values.dtype != np.uint8
    size = ends - starts
    n = size if wide else (size + 7) >> 3
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    if wide:
        return values[number + np.repeat(starts, n)].astype(U64, copy=False), first, number
    padded = np.zeros(len(values) + 8, np.uint8)
    padded[: len(values)] = values
    eights = np.ndarray((len(values) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = eights[(number << 3) + np.repeat(starts, n)]
    some = np.flatnonzero(size & 7)
    last = first[some] + n[some] - 1
    out[last] &= U64(0xFFFFFFFFFFFFFFFF) >> ((8 - (size[some] & 7)) << 3).astype(U64)
    return out, first, number


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[np.append(first[1:], len(values))] - total[first] if len(first) else np.zeros(0, U64)


def chunked_hashes(chunks: tuple[np.ndarray, np.ndarray, np.ndarray], size: np.ndarray) -> np.ndarray:
    """The hash of each run from its chunks.

    Each chunk is mixed with its number before it is added up, so that no pattern of values cancels out, as it does in
    polynomials modulo 2**64 (the word of Thue and Morse against its complement); the only clashes are those of chance.
    """
    values, first, number = chunks
    return mix(_sums(mix(mix(values) ^ (number.astype(U64) * _P)), first) + size.astype(U64) * _M2)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[starts:ends] of bytes or 64-bit values; equal for equal runs wherever they stand."""
    return chunked_hashes(_chunks(values, starts, ends), ends - starts)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each h[i:i+k]: hashes of windows of 1, 2, 4, ... values, two and two mixed into the next."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    width, level, out, at = 1, mix(h.astype(U64, copy=False) + U64(k)), None, 0
    while True:
        if k & width:
            part = level[at : at + n]
            out = part if out is None else mix(out ^ (part * _M1 + _M2))
            at += width
        if 2 * width > k:
            return out
        level = mix(level[: len(level) - width] ^ (level[width:] * _P + _M1))
        width *= 2


def rolling_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number of each run, for sharing runs (which may overlap) among buckets of features only.

    It is a polynomial modulo 2**64, which different long runs can share by their pattern: never take it for the run.
    """
    power, inverse = _powers_of(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64, copy=False) + U64(1)) * power[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * _M2)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        made = []
        for base in (_P, _PINV):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U64))
        if size > 4 * SLICE_BYTES:
            return made[0], made[1]  # for one very long text: not kept
        _powers[size] = (made[0], made[1])
    return _powers[size]


@dataclass
class Texts:
    """A slice of texts as UTF-8: data, and the offsets of each text in it."""

    lo: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, most: int = 4096) -> Iterator[Texts]:
    """The texts in slices of one to ``most`` texts and, but for a longer single text, at most ``limit`` bytes."""
    if not len(texts):
        return
    data, offsets = utf8(texts)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + most)
        yield Texts(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


@dataclass
class Words:
    """Where each word starts and ends in the slice, its text's number, and where each text's words start."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(t: Texts) -> Words:
    inside = ~is_space(t.data)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(inside):
        before[0] = after[-1] = False
        edges = t.offsets[(t.offsets > 0) & (t.offsets < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, t.offsets)
    return Words(starts, ends, np.repeat(np.arange(t.n), np.diff(first)), first)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as an Arrow string array."""
    col = batch.column(batch.schema.get_field_index(name))
    return col if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.string())


@dataclass
class Lines:
    r"""The \\n-split lines of a slice: bounds, text numbers, and where each line's words start in ``Words``."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first_word: np.ndarray
    again: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return np.diff(self.first_word)


def lines_of(t: Texts, w: Words) -> Lines:
    """Lines; ``again``: the line has a word and equals an earlier line of its text."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.concatenate([t.offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, len(t.data))
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = t.offsets[doc[last] + 1]
    first_word = np.append(np.searchsorted(w.starts, starts), len(w.starts))
    again = repeats(run_hashes(t.data, starts, ends), doc)[1] & (np.diff(first_word) > 0)
    return Lines(starts, ends, doc, first_word, again)


def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a hash stands twice or more in its text, and whether it stood there before."""
    key = mix(h + doc.astype(U64) * _P)
    _, at, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return (n > 1)[back], at[back] != np.arange(len(key))


def repeated_words(t: Texts, w: Words, h: np.ndarray) -> np.ndarray:
    """Words covered by 3-word windows found twice or more in their text, the first included."""
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        i = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        twice = i[repeats(window_hashes(h, 3)[i], w.doc[i])[0]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    return np.cumsum(covered)[:-1] > 0


def fold(doc_id, n: int):
    """crc32 of a doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, per_label: int, seed: int = 7) -> list[tuple[int, int]]:
    """A bounded sample of labelled rows outside the held-out fold: (doc_id, label), at most per_label of each label.

    Rows are taken in the order of a seeded hash, so a rerun takes the same ones.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    out = []
    for label in (0, 1):
        took = rows.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_label).collect()
        out += [(r["doc_id"], r["label"]) for r in took]
    return out


def label_shares(labels: DataFrame, column: str, folds: int, held: int) -> tuple[int, int]:
    """Numbers of rows labelled 0 and 1 outside the held-out fold."""
    r = labels.where(fold("doc_id", folds) != held).agg(F.count_if(F.col(column) == 0), F.count_if(F.col(column) == 1)).first()
    return r[0] or 0, r[1] or 0
