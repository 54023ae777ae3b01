"""The pipeline's stages and the whole of it against brute force, on awkward rows too."""

import collections
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from officium.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = [f"v{i}" for i in range(120)]
near = lambda i: " ".join(BASE[:i] + [f"n{i}"] + BASE[i + 1 :])
ROWS = [
    (3, "y", "en", "a", 1), (10, "x", "en", "a", 1), (10, "y", "en", "b", 1), (11, "same", "en", "a", 4), (11, "same", "en", "a", 4), (None, "y", None, None, None), (None, "only here", "fr", "c", 9),
    (None, "only here", "fr", "c", 9), (12, None, "en", "a", None), (13, "", "en", "b", 0), (13, " \t ", "en", None, 3), (20, LONG, "en", "a", len(LONG)), (21, LONG.replace(" ", "\n", 1), "en", "c", len(LONG)),
    *[(30 + i % 7, near(2 * i), "en", "abc"[i % 3], 500) for i in range(12)], (None, near(50), "en", "a", 500), (40, "apart " * 5, "en", "a", 30), (41, "one two three four", "en", None, 18),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return rows.withColumns({n: F.lit(1) for n in ("_row", "_group", "_score", "_toxic", "_taken", "_pattern", "_times", "_base_before", "row", "size", "kept", "odd`name")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    assert tuple(df.columns) == corpus_pipeline.COLUMNS
    return collections.Counter(map(tuple, df.collect()))


def least(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0))[0]


def groups_left(got, groups):
    """One row of each group, with the group's smallest doc_id."""
    got = list(got.elements())
    assert len(got) == len(groups)
    for g in groups:
        mine = [r for r in got if r in g]
        assert len(mine) == 1 and mine[0][0] == least(g)


def test_exact_stage_leaves_one_row_a_group(spark, docs):
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    groups_left(rows_of(corpus_pipeline.drop_copies(spark, docs, SF)), groups.values())


def test_near_stage_leaves_one_row_a_component(spark, docs):
    sets = []
    for r in ROWS:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(ROWS)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a & b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(ROWS):
        groups[find(i)].append(r)
    got = rows_of(corpus_pipeline.drop_near_copies(spark, docs, SF))
    blank = [r for r in ROWS if not (r[1] or "").split()]
    assert sum(n for r, n in got.items() if r in blank) == len(blank)
    groups_left(collections.Counter({r: n for r, n in got.items() if r not in blank}), [g for g in groups.values() if g[0] not in blank])


def test_toxicity_stage_drops_what_the_model_rejects(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for given in (docs, table):
        model = toxicity.fit(given.select("doc_id", "text"), labels)
        scored = toxicity.score(given.select(*corpus_pipeline.COLUMNS), model).collect()
        assert rows_of(corpus_pipeline.drop_toxic(spark, given, SF)) == collections.Counter(tuple(r)[:5] for r in scored if r["_score"] < toxicity.THRESHOLD)


def test_mix_stage_takes_whole_rows_near_the_targets(spark, docs):
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, SF))
    given = collections.Counter(ROWS)
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.shares(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r, n in got.items():
        assert n <= 2 * given[r] and WORD.findall(r[1] or "")
        taken[r[3]] += n * len(WORD.findall(r[1]))
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(r[1] or "")) for r in ROWS if r[3] == s)
    assert rows_of(corpus_pipeline.mix_sources(spark, docs.repartition(5), SF)) == got


def test_stages_on_an_empty_table(spark, empty):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    """run() is its stages in order; its pieces are the whole ids of the documents that the mix gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    kept = collections.Counter(r["doc_id"] for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, fill = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == {d: n * (len(enc.encode(texts[d] or "", add_special_tokens=False).ids) + 1) for d, n in kept.items()}
    assert max(fill.values()) <= 2048
