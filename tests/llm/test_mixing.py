"""The flow of overlapping sources against every integer flow, and its words in the mix."""

import collections
import itertools

import numpy as np
from pyspark.sql import functions as F

from officium.llm import mixing


def best(capacity, quotas, most):
    """(words placed, repetition cost) of the best of all integer flows."""
    arcs = [(p, s) for p in capacity for s in p]
    found = (0, 0)
    for amounts in itertools.product(*[range(min(most * capacity[p], quotas[s]) + 1) for p, s in arcs]):
        used, filled = collections.Counter(), collections.Counter()
        for (p, s), n in zip(arcs, amounts):
            used[p] += n
            filled[s] += n
        if all(used[p] <= most * capacity[p] for p in capacity) and all(filled[s] <= quotas[s] for s in quotas):
            cost = sum(r * max(0, min(capacity[p], used[p] - r * capacity[p])) for p in capacity for r in range(1, most))
            found = max(found, (sum(amounts), -cost))
    return found[0], -found[1]


def test_flow_is_of_least_cost():
    rng = np.random.default_rng(7)
    for _ in range(60):
        patterns = [p for p in [("a",), ("b",), ("a", "b"), ("b", "c")] if rng.random() < 0.8] or [("a",)]
        capacity = {p: int(rng.integers(0, 4)) for p in patterns}
        quotas = {s: int(rng.integers(0, 6)) for s in sorted({s for p in patterns for s in p})}
        most = int(rng.integers(1, 4)) if len(patterns) < 4 else 2
        flow = mixing.flows(capacity, quotas, most)
        used = mixing.route(capacity, quotas, most)
        filled = collections.Counter()
        for (_, s), n in flow.items():
            assert n >= 0
            filled[s] += n
        assert all(filled[s] <= quotas[s] for s in quotas) and all(used[p] <= most * capacity[p] for p in capacity)
        cost = sum(r * max(0, min(capacity[p], used[p] - r * capacity[p])) for p in capacity for r in range(1, most))
        assert (sum(used.values()), cost) == best(capacity, quotas, most)


def test_overlapping_sources_in_the_mix(spark):
    kinds = [["a"], ["b"], ["a", "b"], ["b", None], [None], []]
    rows = [(i, "w " * (1 + i % 5), kinds[i % 6], i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>, `_taken` int")
    got = mixing.mix(docs.withColumns({"_pattern": F.lit(1), "_flow": F.lit(2), "_base_before": F.lit(3), "row": F.lit(4), "a`b": F.lit(5)}), F.col("sources")).collect()
    assert len(got) == 300 and {"_pattern", "_flow", "_base_before", "row", "a`b", "sources"} < set(got[0].asDict())
    taken, filled, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["_taken"] <= 2 * r["_size"] and r["_size"] == 1 + r["doc_id"] % 5
        taken[tuple(r["_members"])] += r["_taken"]
        target |= dict(zip(r["_members"], r["_targets"]))
    for p, words in {tuple(r["_members"]): r["_filled"] for r in got}.items():
        assert taken[p] == sum(words)
        for s, n in zip(p, words):
            filled[s] += n
    assert taken[()] == 0
    assert all(abs(filled[s] - target[s]) <= 1 for s in target)
