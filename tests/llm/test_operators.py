"""The ten operators against brute force on sf0.001, and on a table of awkward rows."""

import collections
import functools
import hashlib
import math
import re
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from officium.llm import class_lm, content_store, exact_dedup, line_crf, mixing, near_dedup, packing, quality_knn, queries, substring_dedup, toxicity
from officium.llm.common import new_folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, None), (4, "one", "en", "b"), (5, "One", "en", "b"), (6, "a b  c <|endoftext|> \U0001f600", "fr", None),
    (7, LONG, "en", "a"), (8, LONG.replace("w5 ", "w5\n\n", 1), "en", "c"), (9, "the same words here", "en", "c"), (10, "the same words here", "en", "c"), (10, "the same words here", "en", "c"),
    (None, "no id at all", "en", "a"), (None, None, None, None), (11, "x\n" * 200, "en", "b"), (12, "é" * 5000, "fr", "b"), (13, "\n\n\r\nend", "en", "a"), (14, " ".join(f"u{i}" for i in range(400)), "en", "a"), (15, "lead " + " ".join(f"u{i}" for i in range(400)), "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    clash = {n: F.lit(1) for n in ("n_chars", "key", "name", "bucket", "chunk", "_size", "_members", "node", "rep", "size", "label", "_range", "comp")}
    return rows.withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return WORD.findall(text or "")


@functools.lru_cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def encoded(name, text, end):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# ---------------------------------------------------------------- 1
def test_store_round_trip(spark, docs, awkward):
    got = by_id(queries.QUERIES["op1_content_store"](spark, SF))
    at = 0
    for d, text, _ in sorted(docs):
        ids = encoded("byte_bpe_50k.json", text, 0)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"], got[d]["verified"]) == (at, len(ids), crc(ids), True)
        at += len(ids)


def test_store_awkward_rows(spark, awkward, empty):
    folder = new_folder(spark, "test")
    content_store.write_store(awkward, folder, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in content_store.read_store(spark, folder).collect())
    want = sorted((d or 0, len(ids), crc(ids)) for d, t, *_ in AWKWARD for ids in [encoded("byte_bpe_50k.json", t, 0)])
    assert got == want
    assert len(content_store.root_of(spark, folder)) == 64
    ids = {r["doc_id"]: r["ids"] for r in content_store.read_ids(spark, folder).where("doc_id = 7").collect()}
    assert ids[7] == encoded("byte_bpe_50k.json", LONG, 0)
    chunks = spark.read.schema(content_store.BLOCKS).parquet(f"{folder}/blocks").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    folder = new_folder(spark, "test")
    content_store.write_store(empty, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert content_store.read_store(spark, folder).count() == 0


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    a, b = rng.bytes(1000), rng.bytes(77777)
    moved = content_store.crc_shift(np.array([zlib.crc32(a), zlib.crc32(b)], np.int64), np.array([len(b), 0]))
    assert int(moved[0] ^ moved[1]) == zlib.crc32(a + b)


# ---------------------------------------------------------------- 2
def linked(texts, k, percent=80):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_copies(spark, docs):
    got = by_id(queries.QUERIES["op2_chosen_path"](spark, SF))
    want = linked([(d, t) for d, t, _ in docs], 2)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


@pytest.mark.parametrize(("small", "rest", "deepest"), [(64, 1024, 10), (4, 1024, 10), (4, 4, 5)])
def test_a_large_group_of_near_copies(spark, monkeypatch, small, rest, deepest):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "REST", rest)
    monkeypatch.setattr(near_dedup, "DEEPEST", deepest)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 110] + [f"n{i}"] + base[i % 110 + 1 :])) for i in range(150)] + [(1000 + i, " ".join(f"z{i}_{j}" for j in range(50))) for i in range(20)]
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    want = linked(rows, 5)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want


def test_near_copies_awkward_rows(spark, awkward, empty):
    rows = near_dedup.near_dedup(awkward, words=2).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    want = linked([(d, t) for d, t, *_ in AWKWARD if d is not None], 2)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {d: c for d, (_, c) in want.items()}
    assert near_dedup.near_dedup(empty).count() == 0


# ---------------------------------------------------------------- 3
def test_exact_copies(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op3_block_naming"](spark, SF)
    want = con.sql(queries.ORACLE_SQL["op3_block_naming"])
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_exact_copies_awkward_rows(spark, awkward, empty, monkeypatch):
    for least in (200, 2):  # with and without hot keys
        monkeypatch.setattr(exact_dedup, "LEAST_HOT", least)
        got = sorted(tuple(r) for r in exact_dedup.exact_dedup(awkward).fillna(-1).collect())
        norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in AWKWARD]
        groups = collections.defaultdict(list)
        for d, t in norm:
            groups[t].append(d)
        keep = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
        want = sorted((-1 if d is None else d, -1 if keep[t] is None else keep[t], len(groups[t]), d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
        assert got == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_runs_no_python(spark, awkward):
    plan = exact_dedup.block_names(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 4
def measured(text):
    w = words(text)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_line_rules(spark, docs, awkward, empty):
    got = by_id(queries.QUERIES["op4_line_crf"](spark, SF))
    for d, text, _ in docs:
        m = measured(text)
        assert tuple(got[d][c] for c in line_crf.COUNTS) == m
        assert got[d]["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (got[d]["base_failed"] and got[d]["kept"])
    rows = line_crf.judge(awkward, line_crf.PRIOR).collect()
    want = sorted(((d or 0, *measured(t)) for d, t, *_ in AWKWARD))
    assert sorted((r["doc_id"] or 0, *(r[c] for c in line_crf.COUNTS)) for r in rows) == want
    assert line_crf.judge(empty, line_crf.PRIOR).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    model = rng.normal(size=3), rng.normal(size=(2, 2))
    sizes = [1, 4, 6]
    x, doc = rng.normal(size=(sum(sizes), 3)), np.repeat(np.arange(3), sizes)
    got = line_crf.viterbi(x, doc, model)
    for i in range(3):
        e = x[doc == i] @ model[0]
        paths = [[p >> k & 1 for k in range(len(e))] for p in range(1 << len(e))]
        best = max(paths, key=lambda p: sum(e[k] for k in range(len(e)) if p[k]) + sum(model[1][a, b] for a, b in zip(p, p[1:])))
        assert got[doc == i].tolist() == best


# ---------------------------------------------------------------- 5
def base_scores(rows):
    toks = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    c = collections.Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in toks]


def test_class_model(spark, docs, awkward, empty):
    rows = queries.QUERIES["op5_class_lm"](spark, SF).collect()
    n, want = base_scores([(d, t) for d, t, _ in docs])
    got = {r["doc_id"]: r for r in rows}
    for d, held, tokens, known, base in want:
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the classes help on unseen text
    odd = class_lm.score(awkward).collect()
    n, want = base_scores([(d, t) for d, t, *_ in AWKWARD])
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in odd) == sorted((d or 0, t, k, round(b, 6)) for d, _, t, k, b in want)
    assert class_lm.score(empty).count() == 0


def test_exchange_finds_alternating_classes():
    pairs, rng = np.zeros((9, 9)), np.random.default_rng(8)
    pairs[1:5, 5:] = rng.integers(5, 15, (4, 4))
    pairs[5:, 1:5] = rng.integers(5, 15, (4, 4))
    of = class_lm.exchange(pairs, classes=3)
    assert len(set(of[1:5])) == len(set(of[5:])) == 1 and of[1] != of[5]


def test_rare_words_get_classes_of_their_own(spark):
    """Words of one shape and count, some beside nouns and some beside verbs: the text where the word fits scores higher."""
    rng = np.random.default_rng(3)
    spelled = lambda i: "qz" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    kinds, rare = (["na", "nb", "nc", "nd"], ["va", "vb", "vc", "vd"]), ([spelled(i) for i in range(20)], [spelled(i) for i in range(20, 40)])
    texts = [[kinds[j % 2][rng.integers(4)] for j in range(60)] for _ in range(400)]
    for k in (0, 1):
        for i, w in enumerate(rare[k]):
            for t in (2 * i, 2 * i + 1):  # each of them twice in the training texts, as its kind
                texts[t + 100 * k][10 + k] = w
    train = [i for i in range(10_000) if not class_lm.held_out(i)]
    held = [i for i in range(10_000) if class_lm.held_out(i)]
    rows = [(i, " ".join(t)) for i, t in zip(train, texts)]
    asked = [(i, f"na {w} nb") for i, w in zip(held, rare[0] + rare[1])]
    got = by_id(class_lm.score(spark.createDataFrame(rows + asked, "doc_id long, text string")))
    assert 4 * 2 * class_lm.SHARE > got[held[0]]["train_tokens"] > 2 * class_lm.SHARE  # so they are too rare for the exchange
    noun, verb = ([got[i]["score"] for i in held[lo : lo + 20]] for lo in (0, 20))
    assert min(verb) > max(noun) + 0.5
    assert len({round(got[i]["base_score"], 9) for i in held[:40]}) == 1


def test_class_number_follows_the_tokens():
    assert [class_lm.classes_for(n, 400) for n in (0, 1e6, 1.6e7, 1e12)] == [32, 32, 63, 100]


# ---------------------------------------------------------------- 6 and 9
def auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("name", "column", "cut", "least"), [("op6_knn_quality", "quality", 0.5, 0.9), ("op9_nnpu_toxicity", "toxic", 0.7, 0.8)])
def test_held_out_accuracy(spark, name, column, cut, least):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert auc([(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]) >= least


def test_classifiers_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (7, 1, 0), (14, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for given in (labels, none):
        assert quality_knn.score(awkward, quality_knn.fit(awkward, given)).count() == len(AWKWARD)
        scored = toxicity.score(awkward, toxicity.fit(awkward, given))
        assert scored.count() == len(AWKWARD) and set(awkward.columns) < set(scored.columns)
        assert line_crf.judge(awkward, line_crf.fit(awkward, given)).count() == len(AWKWARD)
    assert quality_knn.score(empty, quality_knn.fit(empty, labels)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_nearest_neighbours_are_exact():
    rng = np.random.default_rng(4)
    model = {"share": 0.5, "vectors": quality_knn._unit(rng.normal(size=(200, 8))), "votes": rng.integers(0, 2, 200).astype(float), "weights": np.ones(200), "idf": np.ones(quality_knn.TERMS), "axes": rng.normal(size=(quality_knn.TERMS, 8))}
    counts = rng.poisson(0.01, size=(5, quality_knn.TERMS)).astype(float)
    got = quality_knn.vote(counts, model, 7)
    x = quality_knn._unit(quality_knn._weighted(counts, model["idf"]) @ model["axes"]) @ model["vectors"].T
    for i in range(5):
        near = np.argsort(-x[i])[:7]
        w = np.maximum(x[i][near], 0) ** 4
        assert got[i] == pytest.approx((w @ model["votes"][near]) / w.sum())


# ---------------------------------------------------------------- 7
def check_packs(rows, texts, length=2048):
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for d, text in texts:
        ids = encoded("word_bpe_49k.json", text, 1)
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    return sum(r["length"] for r in rows) / (length * len(by_sequence))


def test_packing(spark, docs, awkward, empty):
    rows = queries.QUERIES["op7_packing"](spark, SF).collect()
    assert check_packs(rows, [(d, t) for d, t, _ in docs]) > 0.9
    unique = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packs(packing.pack(unique, public_tokenizers.path("word_bpe_49k.json")).collect(), {d: t for d, t, *_ in AWKWARD if d is not None}.items())
    whole = packing.pack(awkward, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in whole) == sum(len(encoded("word_bpe_49k.json", t, 1)) for _, t, *_ in AWKWARD)
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_histogram_packs():
    rng = np.random.default_rng(6)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 65, 40)}
    fill, placed = collections.Counter(), collections.Counter()
    for size, rank, number, sequence, offset in sorted(packing.pack_histogram(counts, 64), key=lambda s: s[4]):
        for k in range(number):
            assert fill[sequence + k] == offset
            fill[sequence + k] += size
        placed[size] += number
    assert placed == counts and max(fill.values()) <= 64


# ---------------------------------------------------------------- 8
def cut_repeats(rows, window=35):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    n = collections.Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d or 0, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_repeated_passages(spark, docs, awkward, empty):
    got = queries.QUERIES["op8_lz_substrings"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == cut_repeats([(d, t) for d, t, _ in docs])
    odd = substring_dedup.remove_repeats(awkward).collect()
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in odd) == cut_repeats([(d, t) for d, t, *_ in AWKWARD])
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} {passage} c{i} {'z ' * (i % 3 * 30)}") for i in range(40)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == cut_repeats(rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 10
def test_mix(spark, docs):
    got = by_id(queries.QUERIES["op10_mixing"](spark, SF))
    sizes, source = {d: len(words(t)) for d, t, _ in docs}, {d: s for d, _, s in docs}
    names = sorted(set(source.values()))
    total = {s: sum(sizes[d] for d in sizes if source[d] == s) for s in names}
    left, open_, target = 1.5 * sum(sizes.values()), list(names), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 2 * total[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    taken = collections.Counter()
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[d], total[source[d]]) and r["target"] == pytest.approx(target[source[d]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[d]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert {d: r["taken"] for d, r in by_id(queries.QUERIES["op10_mixing"](spark, SF)).items()} == {d: r["taken"] for d, r in got.items()}


def test_mix_awkward_rows(spark, awkward, empty):
    rows = mixing.mix(awkward, F.array("source")).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["_taken"] <= 2 * r["_size"] for r in rows)
    assert mixing.mix(empty, F.array("source")).count() == 0


def test_overlapping_sources_repeat_as_little_as_can_be():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 0}
    used = mixing.route(capacity, {"a": 15, "b": 12})
    assert sum(used.values()) == 27 and used[("a", "b")] == 17 and used[("a",)] == 10
    assert mixing.route({("a",): 5}, {"a": 50}) == {("a",): 10}


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert Path(SF).is_dir()
