r"""Spelling variants: words that are one edit apart, found in sorted dictionaries read forward and backward.

Words are maximal runs ``[A-Za-zÀ-ÿ]+`` with A-Z lower-cased, of at least ``LETTERS`` code points and ``TIMES``
occurrences. Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its
near word with most occurrences, if it has ``RATIO`` times the word's own; roots follow forms to the last.

Let m be the shorter word's length and p the length of the longest prefix that both share. One edit leaves a half intact: with
p >= m // 2 they share the first m // 2 code points, else the last m - m // 2. So each word stands in a block of the forward and one
of the backward dictionary for m its length and, as the longer word, for m one less. Blocks are subdivided in the same way: a
block holds the pairs with lo <= p < hi, which share lo code points in front and m - hi at the end; of its halves one shares more in
front, the other more at the end. Each near pair lies in exactly one block of each subdivision, so counts of blocks add up. A
block of one place (hi = lo + 1) has at most one word of the shorter length a letter. Spark divides blocks of more than
``LARGE`` words; a task goes on to ``SMALL`` and verifies pairs in numpy. Pairs are not written: a block gives each word its number of near words
and the best of them.

Null texts have no words; a null doc_id counts as the empty text (it matters to seeded misspellings only). Repeated rows count as
often as they stand. Other columns are not read. Without words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix, stage, unstage

LETTERS, TIMES, RATIO = 7, 2, 10
LARGE, SMALL = 8192, 24
CHUNK = 1 << 25  # bytes of words that a task compares at once, but for one block
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOCK = ["m", "lo", "hi", "key"]
FOUND = "word binary, n_near long, best struct<less:long,word:binary>"


# ---------------------------------------------------------------- words
def runs(docs: DataFrame) -> DataFrame:
    """doc_id (as text, empty if null) and run, lower-cased, for each run of letters."""
    lowered = F.translate("text", _CAPITALS, _CAPITALS.lower())
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))


def misspelt(found: DataFrame) -> Column:
    """The run; where 31 divides h, the crc32 of doc_id:run, without its code point h % length."""
    h, size = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))


def counted(found: DataFrame, word: Column) -> DataFrame:
    """word (as Latin-1 bytes, in whose order code points are) and n."""
    words = found.select(word.alias("word")).where(F.length("word") >= LETTERS)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)
    return counts.select(F.encode("word", "ISO-8859-1").alias("word"), "n")


# ---------------------------------------------------------------- blocks
def _part(column: str, start: Column | int, size: Column) -> Column:
    return F.substring(column, F.lit(start) if isinstance(start, int) else start, size)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their block: what its words share in front and at the end, with a byte between that no word has."""
    shared = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    end = F.when(shared > 0, _part("word", F.length("word") - shared + 1, shared)).otherwise(F.lit(b""))
    return rows.withColumn("key", F.concat(_part("word", 1, F.col("lo")), F.lit(b"\n"), end))


def _halves(rows: DataFrame) -> DataFrame:
    """Each block's words once in each of its halves."""
    cut = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(F.struct("lo", cut.alias("hi")), F.struct(cut.alias("lo"), "hi")))
    return _placed(rows.select("word", "n", "m", both.alias("half")).select("word", "n", "m", "half.*"))


def _dictionaries(words: DataFrame) -> DataFrame:
    """The words' places in the forward and the backward dictionary, by the shorter length of the pairs they look for."""
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LETTERS))
    rows = words.select("word", "n", lengths.alias("m"))
    front = F.col("m").cast("int")
    half = (front / 2).cast("int")
    both = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (front + 1).alias("hi"))))
    return _placed(rows.select("word", "n", front.alias("m"), both.alias("half")).select("word", "n", "m", "half.*"))


def _subdivided(words: DataFrame) -> DataFrame:
    """Blocks of at most LARGE words, or of one place."""
    rows, done = _dictionaries(words), None
    while True:
        rows = stage(rows, "blocks")
        sizes = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("own"))
        large = stage(sizes.where(f"own > 0 AND size > {LARGE} AND hi - lo > 1").select(*_BLOCK), "large")
        more = large.limit(1).count()
        kept = rows.join(large, _BLOCK, "left_anti") if more else rows
        done = kept if done is None else done.unionByName(kept)
        if not more:
            return done
        rows = _halves(rows.join(large, _BLOCK, "left_semi"))


class _Words:
    """Words of one length m and of m + 1 as a matrix of bytes, forward and backward."""

    def __init__(self, words: list[bytes], n: np.ndarray, m: int):
        self.m, self.n = m, n
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        spelled = np.array(words, f"S{m + 1}")
        self.ahead = spelled.view(np.uint8).reshape(len(words), m + 1)
        self.back = np.array([w[::-1] for w in words], f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)
        self.own = self.size == m
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.argsort(spelled, kind="stable")] = np.arange(len(words))
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1)

    def verify(self, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> None:
        """Count the pairs that are one edit apart with lo <= p < hi. i is of length m, j of m or m + 1."""
        m = self.m
        for at in range(0, len(i), step := max(1, CHUNK // (m + 1))):
            a, b = i[at : at + step], j[at : at + step]
            x, y = self.ahead[a, :m], self.ahead[b]
            unlike = x != y[:, :m]
            p = np.where(unlike.any(axis=1), unlike.argmax(axis=1), m)
            shifted = x != y[:, 1:]
            after = np.where(shifted.any(axis=1), m - shifted[:, ::-1].argmax(axis=1), 0)  # from here on x is y without a code point
            near = np.where(self.own[b], unlike.sum(axis=1) == 1, p >= after) & (p >= lo) & (p < hi)
            self._count(np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]]))

    def _count(self, word: np.ndarray, other: np.ndarray) -> None:
        self.near += np.bincount(word, minlength=len(self.near))
        held = np.flatnonzero(self.best >= 0)
        word, other = np.append(word, held), np.append(other, self.best[held])
        order = np.lexsort((self.rank[other], -self.n[other], word))
        word, other = word[order], other[order]
        first = np.append(True, word[1:] != word[:-1])[: len(word)]
        self.best[word[first]] = other[first]

    def divide(self, rows: np.ndarray, group: np.ndarray, lo: int, hi: int) -> None:
        """Find near pairs within groups of rows, whose words share lo code points in front and m - hi at the end."""
        group = np.unique(group, return_inverse=True)[1]
        size, own = np.bincount(group), np.bincount(group, weights=self.own[rows])
        useful = (size > 1) & (own > 0)
        ends = useful & ((size <= SMALL) | (hi - lo == 1))
        self._within(rows[ends[group]], group[ends[group]], lo, hi)
        more = (useful & ~ends)[group]
        if not more.any():
            return
        rows, group, cut = rows[more], group[more], (lo + hi) // 2
        self.divide(rows, _finer(group, self.ahead[rows, lo:cut]), cut, hi)
        self.divide(rows, _finer(group, self.back[rows, max(0, self.m - hi) : self.m - cut]), lo, cut)

    def _within(self, rows: np.ndarray, group: np.ndarray, lo: int, hi: int) -> None:
        order = np.lexsort((~self.own[rows], group))  # words of length m first
        rows, group = rows[order], group[order]
        ends = np.searchsorted(group, group, side="right")
        here, at = np.flatnonzero(self.own[rows]), 1
        while len(here):
            here = here[here + at < ends[here]]
            self.verify(rows[here], rows[here + at], lo, hi)
            at += 1


def _finer(group: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Numbers that tell apart groups and, within them, letters (but for rare clashes, which verifying does away with)."""
    h = group.astype(U64)
    for k in range(letters.shape[1]):
        h = mix(h * U64(257) + letters[:, k] + U64(1))
    return h


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within blocks; batches come sorted by m, lo, hi and key."""
    for m, lo, hi, keys, words, n in _chunks(batches):
        w = _Words(words, n, m)
        w.divide(np.arange(len(words)), np.unique(np.array(keys, object), return_inverse=True)[1], lo, hi)
        some = np.flatnonzero(w.near)
        best = pa.StructArray.from_arrays([pa.array(-n[w.best[some]]), pa.array([words[k] for k in w.best[some]], pa.binary())], names=["less", "word"])
        yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.binary()), pa.array(w.near[some]), best], names=["word", "n_near", "best"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Whole blocks of one kind (m, lo, hi) at a time, about CHUNK bytes of them or one block."""
    kind, keys, words, n, last = None, [], [], [], None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("m", "lo", "hi", "key", "word", "n")]
        for m, lo, hi, key, word, times in zip(*cols):
            if kind != (m, lo, hi) or key != last and len(words) * m > CHUNK:
                if len(words) > 1:
                    yield *kind, keys, words, np.array(n, np.int64)
                kind, keys, words, n = (m, lo, hi), [], [], []
            last = key
            keys.append(key)
            words.append(word)
            n.append(times)
    if len(words) > 1:
        yield *kind, keys, words, np.array(n, np.int64)


# ---------------------------------------------------------------- forms and roots
def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word binary, each once, n)."""
    words = stage(words.select("word", "n"), "words")
    blocks = _subdivided(words).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    found = blocks.select(*_BLOCK, "word", "n").mapInArrow(_found, FOUND)
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.less") >= RATIO * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    forms = stage(forms, "forms")
    # Each form has ten times as many occurrences, so chains are short; each round doubles how far a word has followed. No word is the
    # form of more words than there are single edits of it, so no join is skewed.
    last = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = last.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(last.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unstage(last)
        last = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            break
        last = stage(last, "roots")
        unstage(new)
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return forms.join(last, "word", "left").select(text("word"), "n", "n_near", text("form"), "form_n", F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root"))


def spelling_groups(docs: DataFrame, seeded: bool = False) -> DataFrame:
    """The variants among the words of docs (doc_id, text); seeded: with the misspellings that doc_id and run decide."""
    found = runs(docs)
    return variants(counted(found, misspelt(found) if seeded else F.col("run")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), seeded=True)
