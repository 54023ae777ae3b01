"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Words flow from patterns to the
sources' quotas; the r-th use of a pattern's words costs r - 1 a word, so repetition is used last and the whole is
convex. The driver solves the flow over patterns and sources only (at most ``max_patterns`` patterns; more is an
error that says so, never a silent cut). A pattern's flow is then met by documents in a seeded order: whole rounds
first, then documents up to the quota; the document at its edge is cut to its first words (``edge="cut"``) or taken
whole if that is nearer (``edge="whole"``).

Null text has size 0 and is taken 0 times. A null source is a source of its own, last in order. Repeated rows and
repeated or null doc_ids are documents of their own; among them the text's hash orders. A document without sources
(empty array) is taken 0 times; so is one whose sources' quotas are full. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, with_running_totals

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: dict, weights: dict, total: float, most: float = MOST) -> dict:
    """Targets in proportion to weights, none above most times its size; what is over goes to the rest by weight."""
    out, open_, left = {}, set(sizes), total
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / weight for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def flows(capacity: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, int]:
    """Words that go from each pattern to each source (keys: pattern, source): a flow of least repetition that fills the
    quotas as far as can be.

    Repetition costs are the same for all patterns, so paths of equal cost are found together: a maximum flow with
    each pattern's words once, carried on with each twice, and so on (successive shortest paths).
    """
    patterns, sources = list(capacity), list(quotas)
    by_source = {s: [p for p in patterns if s in p] for s in sources}
    flow = {(p, s): 0 for p in patterns for s in p}
    used, filled = dict.fromkeys(patterns, 0), dict.fromkeys(sources, 0)
    need = {s: round(quotas[s]) for s in sources}
    for times in range(1, most + 1):
        while True:
            came, queue, end = {}, deque(), None
            for p in patterns:
                if used[p] < times * capacity[p]:
                    came["p", p] = None
                    queue.append(("p", p))
            while queue and end is None:
                kind, x = queue.popleft()
                for nxt in ([("s", s) for s in x] if kind == "p" else [("p", p) for p in by_source[x] if flow[p, x] > 0]):
                    if nxt not in came:
                        came[nxt] = (kind, x)
                        queue.append(nxt)
                        if nxt[0] == "s" and filled[nxt[1]] < need[nxt[1]]:
                            end = nxt
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(times * capacity[path[0][1]] - used[path[0][1]], need[end[1]] - filled[end[1]])
            for (ka, a), (_, b) in zip(path, path[1:]):
                if ka == "s":
                    amount = min(amount, flow[b, a])
            for (ka, a), (_, b) in zip(path, path[1:]):
                flow[(a, b) if ka == "p" else (b, a)] += amount if ka == "p" else -amount
            used[path[0][1]] += amount
            filled[end[1]] += amount
    return flow


def route(capacity: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, int]:
    """Words to take of each pattern."""
    flow = flows(capacity, quotas, most)
    return {p: sum(flow[p, s] for s in p) for p in capacity}


OUT = ("_members", "_size", "_taken", "_targets", "_source_sizes", "_filled")


def mix(docs: DataFrame, members: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, edge: str = "cut", max_patterns: int = 10_000) -> DataFrame:
    """docs without the text, with _members, _size, _taken (words) and, beside _members, the arrays _targets,
    _source_sizes and _filled (how many words of this membership pattern fill each source's quota).

    ``members``: array<string> of a document's sources. Weights are given to the sources in code point order, null
    last, and repeat. A column of docs that has one of these six names is replaced. docs is written once, narrowly if the
    caller selects few columns.
    """
    spark = docs.sparkSession
    facts = docs.withColumns({"_members": members, "_size": words_in(F.col("text")), "_filled": F.xxhash64("text")})
    others = docs.drop("text", *OUT)
    kept = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others.columns]) if others.columns else F.struct(F.lit(None).cast("int").alias("none"))
    id_ = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    rows = stage(facts.select(kept.alias("row"), id_.alias("id"), F.col("_members").alias("members"), F.col("_size").alias("size"), F.col("_filled").alias("tie")), "sizes")
    found = rows.groupBy("members").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns if the driver has room")
    key = lambda p: tuple((s is None, s or "") for s in p)
    found = sorted(((tuple(sorted(set(r["members"]), key=lambda s: (s is None, s or ""))), list(r["members"]), r["n"]) for r in found), key=lambda x: (key(x[0]), str(x[1])))
    capacity: dict[tuple, int] = {}
    for p, _, n in found:
        capacity[p] = capacity.get(p, 0) + n
    sources = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(sources, 0)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target = shares(sizes, weight, share * sum(capacity.values()), most)
    flow = flows(capacity, target, most)
    ids = {p: i for i, p in enumerate(capacity)}
    begin, total = {}, 0
    for p, n in capacity.items():
        begin[p], total = total, total + n
    patterns = spark.createDataFrame(
        [(raw, ids[p], begin[p], capacity[p], sum(flow[p, s] for s in p), [target[s] for s in raw], [sizes[s] for s in raw], [flow[p, s] for s in raw]) for p, raw, _ in found],
        "raw array<string>, pattern int, begin long, capacity long, flow long, targets array<double>, source_sizes array<long>, filled array<long>")
    # The sorted arrays can be keys of a join by hash; null-safe equality holds for null sources inside.
    rows = rows.join(F.broadcast(patterns), F.sort_array("members").eqNullSafe(F.sort_array("raw")) & F.col("members").eqNullSafe(F.col("raw"))).drop("raw")
    order = [F.col("pattern"), F.xxhash64(F.lit(seed), "id"), F.col("id"), F.col("size"), F.col("tie")]
    rows = with_running_totals(stage(rows, "patterns"), order, {"before": F.col("size")}, "mixed")
    before, rounds = F.col("before") - F.col("begin"), F.expr("CASE WHEN capacity > 0 THEN flow DIV capacity ELSE 0 END")
    rest = F.col("flow") - rounds * F.col("capacity")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    if edge == "whole":
        part = F.when(2 * (rest - before) >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    part = F.when(F.col("size") > 0, part).otherwise(F.lit(0))
    taken = (rounds * F.col("size") + part).cast("long")
    made = [F.col("members").alias("_members"), F.col("size").alias("_size"), taken.alias("_taken"), F.col("targets").alias("_targets"), F.col("source_sizes").alias("_source_sizes"), F.col("filled").alias("_filled")]
    return rows.select(*(["row.*"] if others.columns else []), *made)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "source")
    mixed = mix(docs, F.array("source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_sizes")[0].alias("source_size"), F.col("_targets")[0].alias("target"), F.col("_taken").alias("taken"))
