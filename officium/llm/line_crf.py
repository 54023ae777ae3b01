r"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Lines are what \n splits off that has a word. Each has a few yes/no features (symbols, capitals, repetition, length,
ending). Only documents are labelled, so the lines' states are latent: they start from a field without transitions
learned on every line under its document's label, and then the field is learned and the states are decoded in turns
(``TURNS`` times). Decoded states are held to the label: content lines keep at least ``CONTENT_SHARE`` of the words of a
good document, and less in a bad one; where they don't, the lines nearest to the other side change over. So a good document
may have boilerplate lines, a bad one content, and transitions are learned from sequences that switch. Weights are learned
by gradient ascent on the conditional likelihood (forward-backward in numpy).

The sample is bounded: at most ``PER_LABEL`` whole rows of each quality label and, in their seeded order, no more rows once
they have ``LINES`` lines. For learning a row is cut into runs of ``RUN`` lines, all of which count.

Viterbi decoding then labels all lines of every document, and a document is kept if at least ``CONTENT_SHARE`` of its
words stand in content lines. Fixed base rules go first: too few words, or too many in repeated 3-word windows.

Null text counts as empty: no words, so it fails the base rules. Repeated rows and repeated or null doc_ids are judged
row by row. Without labels of both kinds ``PRIOR`` weights stand in for learned ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, Words, is_space, labelled, lines_of, per_text, repeated_words, run_hashes, slices, stage, text_column, words_of

PER_LABEL, LINES, RUN, TURNS = 1000, 200_000, 64, 3
CONTENT_SHARE = 0.5
MIN_WORDS = 50
NAMES = ("bias", "symbols>0", "symbols>=2%", "symbols>=8%", "capitals>=30%", "capitals>=70%", "line again", "repeats>=20%", "repeats>=60%", "words<4", "words>=12", "ends a sentence", "digits>=20%", "word length>=12")
# Weights for boilerplate against content where there is nothing to learn from.
PRIOR = (np.array([-2.0, 0.2, 1.5, 2.0, 1.0, 1.5, 2.0, 0.5, 2.0, 0.5, -0.5, -0.5, 0.5, 0.5]), np.array([[0.5, -0.5], [-0.5, 0.5]]))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts per text; of the lines with words their text numbers, features [line, feature] and words."""
    w: Words = words_of(t)
    h = run_hashes(t.data, w.starts, w.ends)
    lines = lines_of(t, w)
    repeated = repeated_words(t, w, h)
    symbol = _SYMBOL[t.data]
    point = ((t.data & 0xC0) != 0x80) & ~is_space(t.data)
    counts = {
        "n_words": w.counts, "word_chars": per_text(point, t.offsets), "n_symbols": per_text(symbol, t.offsets),
        "n_dup_lines": np.bincount(lines.doc, weights=lines.again, minlength=t.n).astype(np.int64), "n_repeat_words": per_text(repeated, w.first)}
    keep = lines.words > 0
    bounds = np.stack([lines.starts[keep], lines.ends[keep]])
    within = lambda flag: np.diff(np.append(0, np.cumsum(flag))[bounds], axis=0)[0]
    chars, words = np.maximum(1, within(point)), lines.words[keep]
    letters = ((t.data >= 65) & (t.data <= 90)) | ((t.data >= 97) & (t.data <= 122))
    upper = within((t.data >= 65) & (t.data <= 90)) / np.maximum(1, within(letters))
    symbols = within(symbol) / chars
    again = np.append(0, np.cumsum(repeated))
    again = (again[lines.first_word[1:]] - again[lines.first_word[:-1]])[keep] / words
    last = t.data[w.ends[lines.first_word[1:][keep] - 1] - 1] if keep.any() else np.zeros(0, np.uint8)
    x = np.stack([
        np.ones(len(words), bool), symbols > 0, symbols >= 0.02, symbols >= 0.08, upper >= 0.3, upper >= 0.7, lines.again[keep], again >= 0.2, again >= 0.6,
        words < 4, words >= 12, np.isin(last, np.frombuffer(b".!?", np.uint8)), within((t.data >= 48) & (t.data <= 57)) / chars >= 0.2, chars / words >= 12], axis=1)
    return counts, lines.doc[keep], x, words


def field(x: list[np.ndarray], state: list[np.ndarray], share: np.ndarray, moves: bool = True, steps: int = 150, rate: float = 0.1, decay: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of boilerplate (state 1) against content (state 0), and transition scores, from sequences of features and
    states; share: each sequence's weight a line. Without moves the transition scores stay 0."""
    order = np.argsort([-len(a) for a in x], kind="stable")
    sizes = np.array([len(x[i]) for i in order])
    mask = np.arange(sizes[0]) < sizes[:, None]
    flat, y, share = np.concatenate([x[i] for i in order]), np.zeros(mask.shape, np.int64), share[order]
    y[mask] = np.concatenate([state[i] for i in order])
    f, both = flat.shape[1], mask[:, 1:]
    each = np.repeat(share, sizes)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), np.broadcast_to(share[:, None], both.shape)[both])
    w, tr = np.zeros(f), np.zeros((2, 2))
    mean, var = np.zeros(f + 4), np.zeros(f + 4)
    for step in range(1, steps + 1):
        e = np.zeros(mask.shape)
        e[mask] = flat @ w
        p1, pair = marginals(e, sizes, tr)
        g = flat.T @ (each * (y - p1)[mask]) - decay * w * (np.arange(f) > 0)
        gt = seen - np.einsum("n,nkab->ab", share, pair) - decay * tr
        g = np.append(g, gt.ravel() * moves)
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        w, tr = w + move[:f], tr + move[f:].reshape(2, 2)
    return w, tr


def marginals(e1: np.ndarray, sizes: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences, longest first, the probability of state 1 at each line, and of each pair of states at each move.

    e1: scores of state 1, a row each, of which the first ``sizes`` count.
    """
    n, longest = e1.shape
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many go beyond k lines
    e = np.stack([np.zeros_like(e1), e1], axis=2)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for k in range(1, longest):
        m = live[k]
        alpha[:m, k] = np.logaddexp(alpha[:m, k - 1, :1] + tr[:1], alpha[:m, k - 1, 1:] + tr[1:]) + e[:m, k]
    for k in range(longest - 2, -1, -1):
        m = live[k + 1]
        nxt = e[:m, k + 1] + beta[:m, k + 1]
        beta[:m, k] = np.logaddexp(tr[None, :, 0] + nxt[:, :1], tr[None, :, 1] + nxt[:, 1:])
    ends = alpha[np.arange(n), sizes - 1]
    z = np.logaddexp(ends[:, 0], ends[:, 1])
    mask = np.arange(longest) < sizes[:, None]
    p1 = np.where(mask, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0)), 0)
    pair = alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
    return p1, np.where(mask[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0)


def held_to_label(state: np.ndarray, lean: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
    """One document's states, changed as little as can be to agree with its label (1: boilerplate).

    lean: how far each line leans to boilerplate; those that lean most change first.
    """
    state = state.copy()
    for i in np.argsort(-lean if label else lean, kind="stable"):
        content = words[state == 0].sum()
        if (content < CONTENT_SHARE * words.sum()) == bool(label):
            break
        state[i] = label
    return state


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The field from documents (features, words a line, label; 1: boilerplate)."""
    rows = [r for r in rows if len(r[0])]
    label = np.array([y for _, _, y in rows])
    if len(set(label.tolist())) < 2:
        return PRIOR
    sizes = np.array([len(x) for x, _, _ in rows])
    each = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) / sizes
    runs = [(i, lo, min(n, lo + RUN)) for i, n in enumerate(sizes.tolist()) for lo in range(0, n, RUN)]
    share = np.array([each[i] for i, _, _ in runs])
    x = [rows[i][0][lo:hi] for i, lo, hi in runs]
    every, doc = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    ends = np.cumsum(sizes)[:-1]
    model = field(x, [np.full(hi - lo, label[i]) for i, lo, hi in runs], share, moves=False)
    for _ in range(TURNS):
        lean = np.split(every @ model[0], ends)
        state = [held_to_label(s, l, r[1], r[2]) for s, l, r in zip(np.split(viterbi(every, doc, model).astype(np.int64), ends), lean, rows)]
        model = field(x, [state[i][lo:hi] for i, lo, hi in runs], share)
    return model


def viterbi(x: np.ndarray, doc: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The best state of every line; all documents of the slice move down their lines together."""
    w, tr = model
    e = x @ w
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(doc)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    from_ = np.zeros((len(doc), 2), np.int8)
    best = np.zeros((len(begin), 2))
    out = np.zeros(len(doc), np.int8)
    best[:, 1] = e[begin]
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -k, side="left")) for k in range(longest)]  # documents with more than k lines
    for k in range(1, longest):
        n = live[k]
        at = begin[:n] + k
        to = best[:n, :, None] + tr
        from_[at] = to.argmax(axis=1)
        best[:n] = to.max(axis=1)
        best[:n, 1] += e[at]
    state = best.argmax(axis=1).astype(np.int8)
    for k in range(longest - 1, -1, -1):
        n = live[k]
        at = begin[:n] + k
        out[at] = state[:n]
        state[:n] = from_[at, state[:n]]
    return out


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = 1 << np.arange(len(NAMES))
    for batch in batches:
        for t in slices(text_column(batch)):
            _, doc, x, words = measured(t)
            cut = np.searchsorted(doc, np.arange(1, t.n))
            cols = [np.split((x @ bits).astype(np.int32), cut), np.split(words.astype(np.int32), cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), *[pa.array(c, pa.list_(pa.int32())) for c in cols]], names=["doc_id", "lines", "words"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    order = {d: (k, y) for k, (d, y) in enumerate(labelled(docs, labels, "quality", 1, 1, PER_LABEL))}
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(order)], "doc_id long")
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_sampled_lines, "doc_id long, lines array<int>, words array<int>")
    rows = stage(rows.withColumn("n", F.size("lines")), "sampled")
    # A row longer than all that may be learned from is left out whole; so nothing unbounded comes to the driver.
    found = {r["doc_id"]: r for r in rows.where(f"n BETWEEN 1 AND {LINES}").select("doc_id", "n").groupBy("doc_id").agg(F.max("n").alias("n")).collect()}
    chosen, left = [], {0: LINES // 2, 1: LINES // 2}
    for d, (_, y) in sorted(order.items(), key=lambda o: o[1][0]):
        if d in found and found[d]["n"] <= left[y]:
            chosen.append(d)
            left[y] -= found[d]["n"]
    rows = rows.where(F.col("n") <= LINES).join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in chosen], "doc_id long")), "doc_id", "left_semi")
    rows = {r["doc_id"]: r for r in sorted(rows.collect(), key=lambda r: (r["n"], r["lines"]))}
    shift = np.arange(len(NAMES))
    return train([((np.array(rows[d]["lines"], np.int64)[:, None] >> shift & 1).astype(float), np.array(rows[d]["words"], np.int64), 1 - order[d][1]) for d in sorted(rows)])


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share, kept for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(text_column(batch)):
                counts, doc, x, words = measured(t)
                content = np.bincount(doc, weights=words * (viterbi(x, doc, model) == 0), minlength=t.n)
                n = counts["n_words"]
                share = np.where(n > 0, content / np.maximum(n, 1), 0.0)
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, t.n), *[pa.array(counts[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT_SHARE))],
                    names=["doc_id", *COUNTS, "base_failed", "content_share", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, content_share double, kept boolean")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
