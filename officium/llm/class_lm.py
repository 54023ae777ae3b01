"""Language-model scoring by Brown's class-based bigrams.

P(text) = product over tokens of P(class | class before) * P(word | class). Classes come from the exchange algorithm:
from each of a few starts, each unit is moved to the class that gives the training bigrams the largest
likelihood, in turn, until a round moves few. Its units are the end of a text, every word with at least one in
``SHARE`` of the training tokens (so at most ``SHARE`` words, at any corpus size), and the shapes of all rarer words. Then
each rarer word of the training texts gets the class of its own that suits its neighbours best: its counts of
(word, neighbour's class) are summed by word hash in buckets, whose number follows the slices, and scored against the exchange's
class table.
Only words that no training text has are left with the class of their shape. The class bigrams are counted again with
the classes of all words; the number of classes follows the training tokens.

Texts are cut into words once, in slices that are written down. A slice sends its distinct words to the buckets, at most a row
for each, and gets their classes and counts back, so the rows between them follow the slices, not texts times buckets. The
driver gets counts of at most 4 * ``SHARE`` words that may be frequent, then pairs of the at most ``SHARE`` that are.

Training rows are those whose crc32(doc_id as text) modulo 5 is not 1. Texts: A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``, then one end token. Null text counts as empty: the end alone. Repeated rows and repeated or null
doc_ids are scored row by row. Without training tokens counts are 0 and scores follow from the smoothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Texts, Words, lower_ascii, mix, per_text, run_hashes, slices, stage, text_column, unstage, words_of

FOLDS, HELD = 5, 1
SHARE = 4000
CLASSES = 32
ROUNDS = 8
STARTS = 3
SEED = 5
SHAPES = 16
BUCKETS, PER_BUCKET = 512, 32  # at least so many buckets; slices a bucket, beyond that
KEPT = 1_000_000  # words a task counts at once
SLICE = 2 << 20  # bytes of text; a slice sends each bucket a row
BLOCK = 16_384  # words whose neighbours are counted at once
_SALT = U64(0x5851F42D4C957F2D)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


@dataclass
class Slice:
    """A slice of texts as words: distinct keys in the order of ``dealt``, and each token's place among them."""

    slice: int
    ids: list
    trains: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.trains)), np.diff(self.first))

    @property
    def n(self) -> np.ndarray:
        """How often each key stands in the training texts."""
        return np.bincount(self.at[self.trains[self.doc]], minlength=len(self.keys))


_SLICE = "slice long, ids array<long>, trains binary, first binary, keys binary, at binary"


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from nought on in as few bytes each as the largest needs; what is written and sent holds millions of small ones."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def wide(data: bytes, n: int, kind) -> np.ndarray:
    """The n numbers that ``narrow`` made these bytes of."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(kind) if n else np.zeros(0, kind)


def dealt(key: np.ndarray) -> np.ndarray:
    """The number by which words are dealt to buckets: ranges of it, whatever the number of buckets."""
    return mix(key ^ _SALT)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((dealt(key) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def buckets_for(slices: int) -> int:
    """At most ``PER_BUCKET`` slices' worth of words in each bucket."""
    return max(BUCKETS, -(-slices // PER_BUCKET))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of lower-cased texts as words. A word's key is its hash, with its shape in the lowest bits."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for t in slices(text_column(batch), SLICE):
            t = Texts(t.lo, lower_ascii(t.data), t.offsets)
            w = words_of(t)
            own = ids[t.lo : t.lo + t.n]
            key = (run_hashes(t.data, w.starts, w.ends) & ~U64(SHAPES - 1)) | shapes(t, w).astype(U64)
            keys, at = np.unique(key, return_inverse=True)
            order = np.argsort(dealt(keys))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            trains = np.array([not held_out(i) for i in own], bool)
            values = [trains, w.first.astype(np.int64), keys[order], narrow(place[at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([own], pa.list_(pa.int64())), *[pa.array([v.tobytes()], pa.binary()) for v in values]],
                names=["slice", "ids", "trains", "first", "keys", "at"])


def _slices(rows) -> Iterator[Slice]:
    """The slices in a batch or table of them; where the column of keys is left out, they have none."""
    for row in (dict(zip(rows.column_names if isinstance(rows, pa.Table) else rows.schema.names, (c[i].as_py() for c in rows.columns))) for i in range(rows.num_rows)):
        first = np.frombuffer(row["first"], np.int64)
        yield Slice(row["slice"], row["ids"], np.frombuffer(row["trains"], bool), first, np.frombuffer(row.get("keys", b""), U64), wide(row["at"], int(first[-1]), np.int32))


def shapes(t: Texts, w: Words) -> np.ndarray:
    """0..15: length (4 bands), whether it has a symbol or digit, whether it ends in one."""
    letter = ((t.data >= 97) & (t.data <= 122)) | (t.data >= 128)
    odd = np.append(0, np.cumsum(~letter))
    size = w.ends - w.starts
    band = np.searchsorted([4, 8, 13], size, side="right")
    return band * 4 + ((odd[w.ends] - odd[w.starts]) > 0) * 2 + (~letter[w.ends - 1] if len(size) else np.zeros(0, bool))


def _trimmed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts less the first one beyond the ``most`` largest, those above nought kept (a summary as of Misra and Gries).

    Each time, more than ``most`` words lose as much as any word does. So in all no word loses more than one in ``most`` of the
    tokens that were counted, in whatever order they came.
    """
    cut = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    return keys[counts > cut], counts[counts > cut] - cut


def _frequent_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that may have one in 2*SHARE of this task's training tokens, and (hash 0) the number of those tokens."""
    keys, counts, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
    for batch in batches:
        for s in _slices(batch):
            n = s.n
            k, n = s.keys[n > 0], n[n > 0]
            total += int(n.sum())
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(keys) > KEPT:
                keys, counts = _trimmed(keys, counts, KEPT)
    keep = (counts + total // KEPT) * 2 * SHARE >= total
    keys, counts = np.append(keys[keep], U64(0)), np.append(counts[keep], total)
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])


def candidates(sliced: DataFrame) -> np.ndarray:
    """A superset, at most 4*SHARE hashes, of the words with one in SHARE of the training tokens.

    A word with that share overall has at least half of its tokens in tasks where it has half the share, and those report it,
    with at most one in ``KEPT`` of their tokens missing. So the counts reported for it add up to a quarter of the share at least.
    """
    seen = stage(sliced.mapInArrow(_frequent_here, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = seen.where("word = 0").agg(F.sum("n")).first()[0] or 0
    found = seen.where(f"word <> 0 AND n * {4 * SHARE} >= {total}").select("word").collect() if total else []
    return np.sort(np.array([r["word"] for r in found], np.int64).view(U64))


def _counts(maybe: np.ndarray):
    """How often this task's training texts have each of the words, and (hash 0) the number of their tokens and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(maybe), np.int64), 0
        for batch in batches:
            for s in _slices(batch):
                n = s.n
                total += int(n.sum() + s.trains.sum())
                if len(maybe):
                    at = np.minimum(np.searchsorted(maybe, s.keys), len(maybe) - 1)
                    same = maybe[at] == s.keys
                    np.add.at(count, at[same], n[same])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(maybe[count > 0], U64(0)).view(np.int64)), pa.array(np.append(count[count > 0], total))], names=["word", "n"])

    return run


def frequent_words(sliced: DataFrame) -> np.ndarray:
    """The words with at least one in SHARE of the training tokens, ends among these: at most SHARE, by exact counts."""
    counted = sliced.mapInArrow(_counts(candidates(sliced)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in counted if r["word"] == 0)
    return np.sort(np.array([r["word"] for r in counted if r["word"] and r["n"] * SHARE >= total], np.int64).view(U64))


def units_of(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0: the end, 1..16: shapes, then the frequent words."""
    unit = 1 + (h & U64(SHAPES - 1)).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        unit = np.where(words[at] == h, 1 + SHAPES + at, unit)
    return unit


def sequence(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' values with an end (0) after each text; and each token's text."""
    n = len(first) - 1
    out = np.zeros(len(values) + n, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(n), np.diff(first))] = values
    return out, np.repeat(np.arange(n), np.diff(first) + 1)


class _Pairs:
    """Counts of pairs a, b below width."""

    def __init__(self, width: int):
        self.width, self.keys, self.counts = width, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, used: np.ndarray) -> None:
        before = np.append(0, s[:-1])  # a text begins after an end
        k, n = np.unique((before * self.width + s)[used], return_counts=True)
        self.keys, back = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
        self.counts = np.bincount(back, weights=np.concatenate([self.counts, n])).astype(np.int64)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys // self.width), pa.array(self.keys % self.width), pa.array(self.counts)], names=["a", "b", "n"])


def _summed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    return tuple(np.asarray(rows.column(c)) for c in ("a", "b", "n"))


def _bigrams(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs(1 + SHAPES + len(words))
        for batch in batches:
            for s in _slices(batch):
                unit, doc = sequence(units_of(s.keys, words)[s.at], s.first)
                pairs.add(unit, s.trains[doc])
        yield pairs.rows()

    return run


def classes_for(tokens: float, units: int) -> int:
    """The fourth root of the training tokens, so far as four units a class are there; CLASSES at least."""
    return max(CLASSES, min(round(tokens**0.25), units // 4))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS, starts: int = STARTS) -> np.ndarray:
    """A class for each unit; pairs[a, b]: how often b follows a. Unit 0 (the end) keeps class 0 to itself.

    Single moves end in the nearest summit, so the best of several starts is taken: classes dealt by frequency, then dealt
    in seeded random orders.
    """
    order = np.argsort(-pairs.sum(axis=0)[1:], kind="stable") + 1
    rng = np.random.default_rng(SEED)
    best, most = None, -np.inf
    for start in range(starts):
        of = np.zeros(len(pairs), np.int64)
        of[rng.permutation(order) if start else order] = 1 + np.arange(len(order)) % (classes - 1)
        value = _climb(pairs, of, order, classes, rounds)
        if value > most:
            best, most = of, value
    return best


def _climb(pairs: np.ndarray, of: np.ndarray, order: np.ndarray, classes: int, rounds: int) -> float:
    """Moves units in turn, in place, to their best classes; the part of the log likelihood that depends on classes."""
    n = len(pairs)
    xlog = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    onehot = np.zeros((n, classes))
    onehot[np.arange(n), of] = 1
    right, left = pairs @ onehot, pairs.T @ onehot  # unit then class; class then unit
    table = onehot.T @ right
    for _ in range(rounds):
        moved = 0
        for u in order:
            old, own = of[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            table[old] -= r
            table[:, old] -= l
            table[old, old] += own
            r[old] -= own
            l[old] -= own  # without the unit itself
            rows, cols = table.sum(axis=1) + l, table.sum(axis=0) + r  # these tokens stay, whatever u's class
            base = xlog(table)
            gain = (xlog(table + r[None, :]) - base).sum(axis=1) + (xlog(table + l[:, None]) - base).sum(axis=0)
            diagonal = np.diag(table)
            gain -= xlog(diagonal + r) + xlog(diagonal + l) - 2 * xlog(diagonal)
            gain += xlog(diagonal + r + l + own) - xlog(diagonal)
            gain -= xlog(rows + r.sum() + own) - xlog(rows) + xlog(cols + l.sum() + own) - xlog(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[new] += r
            table[:, new] += l
            table[new, new] += own
            if new != old:
                moved += 1
                of[u] = new
                right[:, old] -= pairs[:, u]
                right[:, new] += pairs[:, u]
                left[:, old] -= pairs[u]
                left[:, new] += pairs[u]
        if moved <= n // 200:
            break
    return float(xlog(table).sum() - xlog(table.sum(axis=1)).sum() - xlog(table.sum(axis=0)).sum())


def _neighbours(frequent: np.ndarray, of: np.ndarray, classes: int, buckets: int):
    """Rows for the buckets: of each slice and bucket the words, and for rarer ones the classes beside them.

    A place's column is the class before it, or ``classes`` and the class after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch):
                if not len(s.keys):
                    continue
                unit = units_of(s.keys, frequent)
                c, doc = sequence(of[unit][s.at], s.first)
                mine = np.arange(len(s.at)) + s.doc  # the tokens' places among the ends
                before, after = np.append(0, c[:-1])[mine], c[mine + 1]  # an end is always after
                used = s.trains[s.doc] & (unit[s.at] <= SHAPES)
                code = s.at[used].astype(np.int64) * (2 * classes)
                code, times = np.unique(np.concatenate([code + before[used], code + classes + after[used]]), return_counts=True)
                key, col = code // (2 * classes), code % (2 * classes)
                several = np.bincount(key, minlength=len(s.keys))
                bucket = bucket_of(s.keys, buckets)
                some = np.unique(bucket)
                cut = np.append(np.searchsorted(bucket, some), len(bucket))
                at = np.searchsorted(key, cut)
                part = lambda x, cut: pa.array([x[i:j].tobytes() if x is s.keys else narrow(x[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), s.slice)), part(s.keys, cut), part(s.n, cut), part(several, cut), part(col, at), part(times, at)],
                    names=["bucket", "slice", "keys", "n", "several", "cols", "times"])

    return run


def suits(table: np.ndarray) -> np.ndarray:
    """[column, class]: what one neighbour gives to a word's likelihood in the class (columns as in _neighbours)."""
    log = np.log(table + 0.5)
    rows, cols = np.log(table.sum(axis=1) + 0.5 * len(table)), np.log(table.sum(axis=0) + 0.5 * len(table))
    return np.concatenate([log - cols[None, :], log.T - rows[None, :]])


def best_classes(word: np.ndarray, col: np.ndarray, times: np.ndarray, n: int, suit: np.ndarray) -> np.ndarray:
    """The best class of each of n words from its neighbours: entries (word, col, times)."""
    order = np.argsort(word, kind="stable")
    word, col, times = word[order], col[order].astype(np.int64), times[order]
    out, width = np.zeros(n, np.int64), len(suit)
    suit = suit[:, 1:]  # class 0 is the end's own
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        i, j = np.searchsorted(word, [lo, hi])
        beside = np.bincount((word[i:j] - lo) * width + col[i:j], weights=times[i:j], minlength=(hi - lo) * width).reshape(hi - lo, width)
        out[lo:hi] = 1 + np.argmax(beside @ suit, axis=1)
    return out


def _classed(frequent: np.ndarray, of: np.ndarray, suit: np.ndarray):
    """One bucket: each word's count in all training rows and its class, sent back to the slices that asked."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = {"keys": [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]}
        for kinds, of_each in (({"n": np.uint32, "several": np.uint16}, "keys"), ({"cols": np.uint16, "times": np.uint32}, "several")):
            sizes = [len(x) if of_each == "keys" else int(x.sum()) for x in got[of_each]]
            got |= {c: [wide(x, size, kind) for x, size in zip(table.column(c).to_pylist(), sizes)] for c, kind in kinds.items()}
        words, back = np.unique(np.concatenate(got["keys"]), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        np.add.at(count, back, np.concatenate(got["n"]))
        unit = units_of(words, frequent)
        c = of[unit]
        own = (count > 0) & (unit <= SHAPES)
        place = np.cumsum(own) - 1
        word = place[np.repeat(back, np.concatenate(got["several"]))]
        c[own] = best_classes(word, np.concatenate(got["cols"]), np.concatenate(got["times"]), int(own.sum()), suit)
        at = np.append(0, np.cumsum([len(k) for k in got["keys"]]))
        part = lambda x: pa.array([narrow(x[back[i:j]]).tobytes() for i, j in zip(at[:-1], at[1:])] + [None], pa.binary())
        size = np.bincount(c[count > 0], minlength=suit.shape[1])
        return pa.table({
            "bucket": pa.array([key[0].as_py()] * len(at), pa.int64()), "slice": pa.array(table.column("slice").to_pylist() + [None], pa.int64()),
            "words": pa.array([len(k) for k in got["keys"]] + [None], pa.int64()), "classes": part(c), "counts": part(count), "vocabulary": pa.array([None] * (len(at) - 1) + [size], pa.list_(pa.int64()))})

    return run


def _answered(ends: int):
    """A slice with its words' classes and counts: its tokens' classes, and each text's sums."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        (s,) = _slices(own)
        answers = answers.sort_by("bucket")
        joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *[wide(x, n, kind) for x, n in zip(answers.column(c).to_pylist(), answers.column("words").to_pylist())]])
        classes, count = joined("classes", np.uint16), joined("counts", np.int64)
        c, _ = sequence(classes[s.at], s.first)
        logs = per_text(np.log10(count + 0.5)[s.at], s.first) + np.log10(ends + 0.5)
        known = per_text((count > 0)[s.at].astype(np.int64), s.first) + int(ends > 0)
        return pa.table({
            "ids": pa.array([s.ids], pa.list_(pa.int64())), "trains": pa.array([s.trains.tobytes()], pa.binary()), "first": pa.array([s.first.tobytes()], pa.binary()),
            "classes": pa.array([narrow(c).tobytes()], pa.binary()), "logs": pa.array([logs.astype(np.float64).tobytes()], pa.binary()), "known": pa.array([known.astype(np.int64).tobytes()], pa.binary())})

    return run


def _scored_slices(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023  (used up in its round)
        trains, first = np.frombuffer(get("trains"), bool), np.frombuffer(get("first"), np.int64)
        classes = wide(get("classes"), int(first[-1]) + len(trains), np.int64)  # of the tokens and the ends
        yield get("ids"), trains, first, classes, np.frombuffer(get("logs"), np.float64), np.frombuffer(get("known"), np.int64)


def _class_bigrams(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs(classes)
        for batch in batches:
            for _, trains, first, c, *_ in _scored_slices(batch):
                pairs.add(c, np.repeat(trains, np.diff(first) + 1))
        yield pairs.rows()

    return run


def _scores(step: np.ndarray, spread: np.ndarray, floor: float, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, trains, first, c, logs, known in _scored_slices(batch):
                value = step[np.append(0, c[:-1]), c] - spread[c]
                score = per_text(value, first + np.arange(len(first))) + logs
                n = np.diff(first) + 1
                values = [~trains, n, known, np.full(len(n), total), logs - n * floor, score, -score / n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *[pa.array(v) for v in values]],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "log10_perplexity"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_perplexity for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sliced = stage(docs.mapInArrow(_sliced, _SLICE), "slices")
    frequent = frequent_words(sliced)
    width = 1 + SHAPES + len(frequent)
    a, b, n = _summed(sliced.mapInArrow(_bigrams(frequent), "a long, b long, n long"))  # at most (SHARE + 17)**2, in practice few
    pairs = np.zeros((width, width))
    pairs[a, b] = n
    count = pairs.sum(axis=0)
    total = float(count.sum())
    ends = int(count[0])
    classes = classes_for(total, width)
    of = exchange(pairs, classes)
    onehot = np.zeros((width, classes))
    onehot[np.arange(width), of] = 1
    suit = suits(onehot.T @ pairs @ onehot)

    buckets = buckets_for(sliced.count())
    asked = sliced.mapInArrow(_neighbours(frequent, of, classes, buckets), "bucket long, slice long, keys binary, n binary, several binary, cols binary, times binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_classed(frequent, of, suit), "bucket long, slice long, words long, classes binary, counts binary, vocabulary array<long>"), "answers")
    vocabulary = np.zeros(classes)
    vocabulary[0] = ends > 0
    for r in answers.where("vocabulary IS NOT NULL").select(F.posexplode("vocabulary")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        vocabulary[r["pos"]] += r["n"]
    back = answers.where("vocabulary IS NULL").select("slice", "bucket", "words", "classes", "counts")
    found = stage(sliced.drop("keys").groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(_answered(ends), "ids array<long>, trains binary, first binary, classes binary, logs binary, known binary"), "classes")

    unstage(sliced, answers)

    a, b, n = _summed(found.mapInArrow(_class_bigrams(classes), "a long, b long, n long"))
    table = np.zeros((classes, classes))
    table[a, b] = n
    step = np.log10((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * classes))
    spread = np.log10(table.sum(axis=0) + 0.5 * (vocabulary + 1))
    floor = float(np.log10(total + 0.5 * (vocabulary.sum() + 1)))
    return found.mapInArrow(_scores(step, spread, floor, int(total)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, log10_perplexity double")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
