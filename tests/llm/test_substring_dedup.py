"""Factors against a parser by brute force."""

import collections
import random

from officium.llm import substring_dedup


def parsed(rows, window):
    """Greedy factors relative to the index of each window's first two places."""
    texts = [(d, (t or "").split()) for d, t in rows]
    places = collections.defaultdict(list)
    for d, w in texts:
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d is not None, d or 0, i))
    out = []
    for d, w in texts:
        at, before = None, None
        for i in range(len(w) - window + 1):
            two = sorted(places[tuple(w[i : i + window])])[:2]
            if len(two) < 2:
                before = None
                continue
            known, ref, j = two[1] if two[0] == (d is not None, d or 0, i) else two[0]
            if before == (known, ref, j - 1):
                out[at][2] += 1
            else:
                at = len(out)
                out.append([d, i, window, ref if known else None, j])
            before = (known, ref, j)
    return sorted(map(repr, map(tuple, out)))


def test_factors_are_those_of_the_greedy_parse(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=rng.randint(8, 40)) for _ in range(6)]
    rows = [(i if i % 13 else None, " ".join(x for _ in range(4) for x in (rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=20)))) for i in range(80)]
    rows += [(200, " ".join(passages[0] + passages[1])), (201, " ".join(passages[0] + passages[1])), (201, " ".join(passages[0] + passages[1])), (300, "ab " * 60), (301, ""), (302, None), (303, "short text")]
    got = substring_dedup.parse(spark.createDataFrame(rows, "doc_id long, text string"), window=10, block=4)
    assert got.columns == ["doc_id", "start", "length", "ref_doc_id", "ref_start"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == parsed(rows, 10)


def test_factors_of_an_empty_table(spark):
    assert substring_dedup.parse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_factors_copy_what_they_cover(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(rng.randint(0, 30))] + passage[rng.randint(0, 40) :] + [f"b{i}"])) for i in range(30)]
    texts = {d: t.split() for d, t in rows}
    found = substring_dedup.parse(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) >= 30
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == texts[r["ref_doc_id"]][r["ref_start"] : r["ref_start"] + r["length"]]


def test_keys_that_clash_are_told_apart_by_their_checks(spark, monkeypatch):
    """With keys of a few bits most windows clash; the checks still tell them apart."""
    real = substring_dedup.run_hashes
    windows = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, k: windows(h, k) & ~substring_dedup.U64((1 << 58) - 1) if k == 10 else windows(h, k))
    monkeypatch.setattr(substring_dedup, "_checks", lambda h, starts, window: (real(h, starts, starts + window) >> substring_dedup.U64(20)).astype("uint32"))
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 9)}" if j % 40 > 30 else f"v{j % 40}" for j in range(100))) for i in range(12)]
    texts = substring_dedup.pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
    found = {c: [] for c in substring_dedup.PLACES}
    for t, ids in substring_dedup._texts(texts):
        w, h, inside, _ = substring_dedup._measure(t, 10, 4)
        cols = {"keys": substring_dedup.window_hashes(h, 10)[inside], "checks": substring_dedup._checks(h, inside, 10), "ids": substring_dedup._id_numbers(ids)[w.doc[inside]], "at": (inside - w.first[:-1][w.doc[inside]]).astype("int32")}
        table = substring_dedup.pa.table({"chunk": [1], **{c: [x.tobytes()] for c, x in substring_dedup._first_two(cols)[0].items()}})
        index = substring_dedup._unpacked(substring_dedup._indexed((None,), table), substring_dedup.INDEX)
        assert len(set(index["keys"].tolist())) < len(index["keys"])
        _, (doc, start, length, ref, at) = substring_dedup._parsed(t, substring_dedup._id_numbers(ids), index, 10, 4)
        got = sorted(repr((int(ids[int(d)].as_py()), int(a), int(n), int(r), int(k))) for d, a, n, r, k in zip(doc, start, length, ref, at))
        assert got == parsed(rows, 10)
