"""Spelling variants against brute force: every word with each of its one-edit neighbours."""

import collections
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from officium.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, seeded=True):
    count = collections.Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if seeded and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def expected(count):
    """By the deletions of each word: near words share one, or one is a deletion of the other."""
    holes, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in count:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in count:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for some in holes.values():
        for w in some:
            near[w] |= some - {w}
    out, form = {}, {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    want = expected(words_of(rows))
    assert sum(f is not None for f, *_ in want.values()) >= 10
    assert got(queries.QUERIES["op12_spelling"](spark, f"/root/testdata/{sf}")) == want


def close(rng, letters, n, size):
    """Words that are near each other in every way: one edit, two, repeated letters, edits at both ends."""
    base = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(12):
            i, c = rng.randint(0, len(w)), rng.choice(letters)
            out |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + c + w[i:]}
    return sorted(out)


@pytest.mark.parametrize("large, small", [(8192, 24), (6, 2), (3, 24)])
def test_subdivided_blocks_lose_and_repeat_nothing(spark, monkeypatch, large, small):
    monkeypatch.setattr(spelling, "LARGE", large)
    real = spelling._Words.divide
    rng = random.Random(5)
    words = close(rng, "ab", 12, 8) + close(rng, "abcéÿ×", 12, 9) + ["common" + a + b for a in "abcdefgh" for b in "abcdefgh"] + ["a" * k for k in range(7, 30)]
    count = {w: rng.choice([2, 3, 25, 400, 6000]) for w in words if len(w) >= 7}
    rows = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in count.items()], "word binary, n long").repartition(5)
    monkeypatch.setattr(spelling, "SMALL", small)  # reaches this process only; tasks keep theirs
    assert got(spelling.variants(rows)) == expected(count)
    own = spelling._Words([w.encode("latin-1") for w in count if len(w) in (8, 9)], spelling.np.array([n for w, n in count.items() if len(w) in (8, 9)]), 8)
    real(own, spelling.np.arange(len(own.n)), spelling.np.zeros(len(own.n), int), 0, 9)
    of8 = [w for w in count if len(w) in (8, 9)]
    pairs = {(v, w) for v in of8 for w in of8 if v < w and 8 in (len(v), len(w)) and one_edit(v, w)}
    assert own.near.sum() == 2 * len(pairs)


def one_edit(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    v, w = sorted((v, w), key=len)
    return len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))


AWKWARD = [(1, None), (2, ""), (3, "Spelling spelling SPELLINg speling"), (None, "spelling spelllng spelling"), (4, "Éclairs éclairs Éclairs eclairs eclairs"), (4, "x" * 50_000 + " " + "x" * 50_000),
           (4, "x" * 50_001 + " " + "x" * 50_001), (5, "spelling " * 40), (5, "spelling " * 40), (6, "naïveté×÷ naïveté×÷ longerĀwords longerĀwords"), (7, "spellin spellin short short")]


def test_awkward_rows(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("word", "n", "run", "key", "m")}).repartition(3)
    for seeded in (True, False):
        want = expected(words_of(AWKWARD, seeded))
        assert len(want) > 4 and got(spelling.spelling_groups(rows, seeded)) == want


def test_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
