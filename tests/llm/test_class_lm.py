"""Scores against the model's definition in plain Python, and the counts that choose the frequent words."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from officium.llm import class_lm, common


def shape(word):
    letter = [c.isascii() and c.islower() or ord(c) >= 128 for c in word]
    size = len(word.encode())
    return (0 if size < 4 else 1 if size < 8 else 2 if size < 13 else 3) * 4 + (not all(letter)) * 2 + (not letter[-1])


def place(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(common.run_hashes(data, np.array([0]), np.array([len(data)]))[0]) >> 4


def modelled(rows):
    """{doc_id: score} by the definition; only the exchange itself is taken from the library."""
    texts = {d: t.lower().split() for d, t in rows}
    train = [d for d in texts if not class_lm.held_out(d)]
    count = collections.Counter(w for d in train for w in texts[d])
    ends = len(train)
    total = sum(count.values()) + ends
    frequent = sorted((w for w, n in count.items() if n * class_lm.SHARE >= total), key=place)  # their order decides ties in the exchange
    unit = lambda w: 1 + class_lm.SHAPES + frequent.index(w) if w in frequent else 1 + shape(w)
    width = 1 + class_lm.SHAPES + len(frequent)
    pairs = np.zeros((width, width))
    for d in train:
        seq = [0, *map(unit, texts[d]), 0]
        for a, b in zip(seq, seq[1:]):
            pairs[a, b] += 1
    classes = class_lm.classes_for(total, width)
    of = class_lm.exchange(pairs, classes)
    table = np.zeros((classes, classes))
    for a in range(width):
        for b in range(width):
            table[of[a], of[b]] += pairs[a, b]
    beside = collections.defaultdict(list)
    for d in train:
        c = [0, *[of[unit(w)] for w in texts[d]], 0]
        for i, w in enumerate(texts[d], 1):
            beside[w].append((c[i - 1], c[i + 1]))
    rows_, cols = table.sum(axis=1), table.sum(axis=0)

    def fit(w, k):
        return sum(math.log(table[a, k] + 0.5) - math.log(cols[k] + 0.5 * classes) + math.log(table[k, b] + 0.5) - math.log(rows_[k] + 0.5 * classes) for a, b in beside[w])

    def of_word(w):
        return of[unit(w)] if w in frequent or not count[w] else max(range(1, classes), key=lambda k: (round(fit(w, k), 9), -k))

    class_of = {w: of_word(w) for ws in texts.values() for w in ws}
    steps, size = np.zeros((classes, classes)), np.zeros(classes)
    for d in train:
        c = [0, *[class_of[w] for w in texts[d]], 0]
        for a, b in zip(c, c[1:]):
            steps[a, b] += 1
    size[0] = ends > 0
    for w in count:
        size[class_of[w]] += 1
    out = {}
    for d, ws in texts.items():
        score, before = 0.0, 0
        for w in [*ws, None]:
            c = class_of[w] if w else 0
            score += math.log10((steps[before, c] + 0.5) / (steps[before].sum() + 0.5 * classes))
            score += math.log10((count[w] if w else ends) + 0.5) - math.log10(steps[:, c].sum() + 0.5 * (size[c] + 1))
            before = c
        out[d] = score
    return out


@pytest.mark.parametrize("share", [40, 4000, 1])
def test_scores_follow_the_definition(spark, monkeypatch, share):
    monkeypatch.setattr(class_lm, "SHARE", share)
    rng = random.Random(4)
    kinds = [["the", "a", "of"], [f"noun{chr(97 + i)}" for i in range(12)], ["runs!", "é", "x9", "12"]]
    rows = [(i, " ".join(rng.choice(kinds[(j + rng.randint(0, 9) // 9) % 3]) for j in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(i + 60, f"the rare{i} runs! Unseen{'z' * i}") for i in range(10)]
    want = modelled(rows)
    got = {r["doc_id"]: r["score"] for r in class_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], rel=1e-9) for d in got)


def test_trimmed_counts_lose_at_most_their_share():
    rng = np.random.default_rng(5)
    stream = np.concatenate([rng.integers(1, 5000, 20_000), np.repeat(7, 400), rng.integers(5000, 9000, 20_000), np.repeat(7, 400)])
    keys, counts, most = np.zeros(0, np.int64), np.zeros(0, np.int64), 100
    for part in np.array_split(stream, 300):
        keys, back = np.unique(np.concatenate([keys, part]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, np.ones(len(part))])).astype(np.int64)
        if len(keys) > most:
            keys, counts = class_lm._trimmed(keys, counts, most)
    left = dict(zip(keys.tolist(), counts.tolist()))
    for k, n in collections.Counter(stream.tolist()).items():
        assert n - len(stream) / most <= left.get(k, 0) <= n


@pytest.mark.parametrize("kept", [3, 1_000_000])
def test_frequent_words_do_not_depend_on_what_a_task_keeps(spark, monkeypatch, kept):
    monkeypatch.setattr(class_lm, "SHARE", 20)
    monkeypatch.setattr(class_lm, "KEPT", max(kept, 200))
    rows = [(i, " ".join(f"w{(i * j) % 7 if j % 3 else i * 100 + j}" for j in range(40))) for i in range(200)]
    seen = {}
    for parts in (1, 7):
        sliced = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).mapInArrow(class_lm._sliced, class_lm._SLICE)
        seen[parts] = class_lm.frequent_words(class_lm.stage(sliced, "slices")).tolist()
    train = [t.split() for i, t in rows if not class_lm.held_out(i)]
    count = collections.Counter(w for ws in train for w in ws)
    assert len(seen[1]) == sum(n * 20 >= sum(count.values()) + len(train) for n in count.values()) > 0
    assert seen[1] == seen[7]


def test_buckets_follow_the_slices():
    assert [class_lm.buckets_for(n) for n in (0, 250, 20_000, 50_000_000)] == [512, 512, 625, 1_562_500]
    keys = np.random.default_rng(6).integers(0, 2**63, 10_000).astype(np.uint64)
    ordered = keys[np.argsort(class_lm.dealt(keys))]
    for buckets in (512, 1_562_500):
        b = class_lm.bucket_of(ordered, buckets)
        assert (np.diff(b) >= 0).all() and 0 <= b[0] and b[-1] < buckets


def test_slices_and_what_they_send_are_narrow():
    """Small numbers take a byte each, whether they are kept or sent; eight or four took 4 times the input of disk."""
    rng = random.Random(6)
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [" ".join(f"w{rng.randrange(200)}" for _ in range(30)) for _ in range(50)]})
    (batch,) = class_lm._sliced([texts])
    (s,) = class_lm._slices(batch)
    assert len(s.at) == 1500 and len(batch.column("at")[0].as_py()) == 1500
    of = np.append(0, 1 + np.arange(class_lm.SHAPES) % 31)
    (sent,) = class_lm._neighbours(np.zeros(0, np.uint64), of, 32, 512)([batch])
    for row in sent.to_pylist():
        words = len(row["keys"]) // 8
        entries = sum(row["several"])
        assert (len(row["n"]), len(row["several"]), len(row["cols"]), len(row["times"])) == (words, words, entries, entries)
    assert sum(len(r["keys"]) for r in sent.to_pylist()) == 8 * len(s.keys)


@pytest.mark.parametrize("most", [0, 255, 256, 65_535, 65_536, 2**32, 2**40])
def test_narrow_numbers_are_the_same(most):
    values = np.array([most, 0, most // 2, most])
    assert class_lm.wide(class_lm.narrow(values).tobytes(), 4, np.int64).tolist() == values.tolist()
    assert len(class_lm.wide(class_lm.narrow(values[:0]).tobytes(), 0, np.int64)) == 0
