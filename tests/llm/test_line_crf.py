"""Training of the line field against enumerated sequences, and documents whose lines differ."""

import itertools

import numpy as np
import pytest

from officium.llm import line_crf


def test_marginals_equal_enumerated_sequences():
    rng = np.random.default_rng(1)
    sizes, tr = np.array([5, 3, 3, 1]), rng.normal(size=(2, 2))
    e = rng.normal(size=(4, 5))
    p1, pair = line_crf.marginals(e, sizes, tr)
    for i, n in enumerate(sizes):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([sum(e[i, k] for k in range(n) if p[k]) + sum(tr[a, b] for a, b in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        for k in range(5):
            assert p1[i, k] == pytest.approx(sum(w for w, p in zip(weight, paths) if k < n and p[k]))
            for a, b in itertools.product((0, 1), repeat=2):
                if k < 4:
                    assert pair[i, k, a, b] == pytest.approx(sum(w for w, p in zip(weight, paths) if k + 1 < n and p[k : k + 2] == (a, b)))


def test_field_stands_where_the_likelihood_is_flat():
    """At the learned weights the gradient by differences of the enumerated, penalised likelihood is nearly 0."""
    rng = np.random.default_rng(2)
    x = [np.hstack([np.ones((n, 1)), rng.integers(0, 2, (n, 2))]).astype(float) for n in (4, 2, 3, 4, 1)]
    y = [(a[:, 1] + rng.integers(0, 2, len(a)) > 1).astype(int) for a in x]
    share = np.full(5, 0.1)
    w, tr = line_crf.field(x, y, share, steps=3000, rate=0.02)

    def value(v):
        w, tr = v[:3], v[3:].reshape(2, 2)
        total = -0.01 * (w[1:] ** 2).sum() - 0.01 * (tr**2).sum()
        for a, s in zip(x, y):
            one = lambda p: sum(a[k] @ w for k in range(len(p)) if p[k]) + sum(tr[i, j] for i, j in zip(p, p[1:]))  # noqa: B023, E731
            total += 0.1 * (one(s) - np.log(sum(np.exp(one(p)) for p in itertools.product((0, 1), repeat=len(a)))))
        return total

    at = np.append(w, tr.ravel())
    steps = np.eye(7) * 1e-5
    assert max(abs(value(at + d) - value(at - d)) / 2e-5 for d in steps) < 2e-3


def test_states_are_held_to_the_label():
    words, lean = np.array([10, 10, 10, 10]), np.array([0.1, 3.0, -1.0, 2.0])
    hold = lambda state, label: line_crf.held_to_label(np.array(state), lean, words, label).tolist()
    assert hold([0, 0, 0, 0], 1) == [1, 1, 0, 1]  # less than half stays content: the three that lean most change
    assert hold([1, 1, 1, 1], 0) == [0, 1, 0, 1]
    assert hold([0, 1, 0, 0], 0) == [0, 1, 0, 0]
    assert hold([1, 1, 0, 1], 1) == [1, 1, 0, 1]


def test_mixed_documents_get_both_states(spark):
    """Bad documents hold clean lines and good ones a line of symbols: decoding tells the lines apart."""
    clean = lambda i: f"A quiet line number {'abcdefghij'[i % 10]} of a plain text that goes on and ends."
    junk = lambda i: f"BUY### NOW$$$ {'KLMNOPQRST'[i % 10]}&&& CHEAP%%% GO*** WIN|||"
    rows, labels = [], []
    for i in range(200):
        good = i % 2 == 0
        lines = [clean(i + k) for k in range(8)] + [junk(i)] if good else [clean(i)] + [junk(i + k) for k in range(8)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    long = (1000, "\n".join([clean(k) for k in range(5000)] + [junk(k) for k in range(3000)]))
    docs = spark.createDataFrame([*rows, long], "doc_id long, text string")
    model = line_crf.fit(docs, spark.createDataFrame(labels[:150], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in line_crf.judge(docs, model).collect()}
    words = lambda lines: sum(len(x.split()) for x in lines)
    for i, text in rows:
        lines = text.split("\n")
        content = words(x for x in lines if x.startswith("A quiet"))
        assert got[i]["content_share"] == pytest.approx(content / words(lines)) and 0 < got[i]["content_share"] < 1
        assert got[i]["kept"] == (i % 2 == 0 and not got[i]["base_failed"])
    assert 0.5 < got[1000]["content_share"] < 1


def test_rows_beyond_the_bound_are_left_out_whole(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "LINES", 8)
    docs = spark.createDataFrame([(1, "a b\n" * 9), (2, "c d\ne f"), (3, "g#\nh#"), (4, None)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(line_crf, "train", lambda rows: seen.extend(len(r[0]) for r in rows))
    line_crf.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int"))
    assert seen == [2, 2]
